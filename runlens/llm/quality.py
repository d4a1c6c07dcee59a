"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation estimates how good each rule is, and
the posterior probability of good quality decides.

A rule looks at one measure of a text and votes +1 (good), -1 (bad) or 0 (abstains). How accurate a rule is, is unknown:
its chances of each vote on good and on bad texts. Votes of all documents are counted by pattern (at most 3 ** rules
rows, whatever the corpus size: the only thing the driver receives); EM on these counts yields the chances and the
share of good texts, and every document's posterior follows from its own votes by a sum of log-odds. A weak
Dirichlet prior, under which good texts rarely get bad votes, fixes which class is the good one.

`base_failed` (fewer than 50 words, or more than half of the words in repeated three-word windows) always rejects;
otherwise a document is kept when its posterior reaches `threshold`.

Defined cases: null text counts as empty; texts without words have measures 0, fail the base rules, and all rules
abstain but the word count; repeated rows are judged alike; an empty table gives an empty result (EM then keeps its
starting rates); other columns pass through `judge` and `reject`, whatever their names (names that begin with two
underscores and `q_` are the operator's own).
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import extended, mapped, slices, table

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?", "…", ":", ";", '"', "”", "»", ")")
#: Frequent function words of the four languages of the corpus.
STOP = frozenset((
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one "
    "der die das und ist in zu den mit von für auf nicht ein eine als auch es an dem des im sich sie er wir "
    "le la les de des du et est un une que qui dans en pour par sur pas au aux ce il elle avec ne se son sa "
    "el los las del y en un una que es por con para su al lo como más no se le"
).split())
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: (name, good interval or None, bad interval): a rule votes good or bad inside its interval and abstains elsewhere.
#: Defects only vote bad: that a text does not shout says nothing in its favour.
RULES = (
    ("symbol_share", None, (0.08, math.inf)),
    ("shout_share", None, (0.40, 1.0)),
    ("bang_share", None, (0.20, math.inf)),
    ("bar_share", None, (0.10, 1.0)),
    ("dup_line_share", None, (0.25, 1.0)),
    ("repeat_share", None, (0.35, 1.0)),
    ("stop_share", (0.12, 1.0), (-1.0, 0.04)),
    ("ended_share", (0.60, 1.0), (-1.0, 0.25)),
    ("word_length", None, (13.0, math.inf)),
    ("words", (50.0, math.inf), (-1.0, 20.0)),
)
NAMES = tuple(r[0] for r in RULES)


def measure(text: str) -> tuple[tuple, dict]:
    """Base measures in the order of MEASURES, and the measures of the rules (None: the rule abstains)."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS)) if n else 0
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.encode().split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            seen = Counter(windows)
            upto = 0
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeat += i + 3 - max(i, upto)
                    upto = i + 3
    base = (n, chars, symbols, dup, repeat)
    if not n:
        return base, {**dict.fromkeys(NAMES), "words": 0.0}
    plain = text.split() or [""]
    return base, {
        "symbol_share": symbols / chars,
        "shout_share": sum(map(str.isupper, plain)) / len(plain),
        "bang_share": text.count("!!") / n,
        "bar_share": words.count(b"|") / n,
        "dup_line_share": dup / len(lines),
        "repeat_share": repeat / n,
        "stop_share": sum(map(STOP.__contains__, text.lower().split())) / n if n >= 10 else None,
        "ended_share": sum(x.rstrip().endswith(ENDS) for x in text.split("\n") if x.strip(BLANKS)) / len(lines),
        "word_length": chars / n if n >= 10 else None,
        "words": float(n),
    }


def vote(values: dict) -> list[int]:
    out = []
    for name, good, bad in RULES:
        x = values[name]
        out.append(0 if x is None else 1 if good and good[0] <= x <= good[1] else -1 if bad[0] <= x <= bad[1] else 0)
    return out


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with __<measure> (long) and __v_<rule> (tinyint)."""
    import pyarrow as pa

    added = [(f"__{m}", pa.int64(), "bigint") for m in MEASURES] + [(f"__v_{r}", pa.int8(), "tinyint") for r in NAMES]
    texts = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch, batch.schema.names[texts]):
                rows = [measure(t or "") for t in part.column(texts).to_pylist()]
                base = list(zip(*(b for b, _ in rows))) or [()] * len(MEASURES)
                votes = list(zip(*(vote(v) for _, v in rows))) or [()] * len(NAMES)
                new = [pa.array(c, type=kind) for c, (_, kind, _) in zip([*base, *votes], added)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *(a[0] for a in added)])

    return mapped(docs, run, extended(docs.schema, [(n, kind) for n, _, kind in added]))


VOTES = (-1, 0, 1)
#: EM starts from, and its prior leans to, these chances of (bad vote, abstention, good vote).
START = {"good": (0.01, 0.49, 0.50), "bad": (0.40, 0.40, 0.20)}


def estimate(patterns: list[tuple[tuple[int, ...], int]], steps: int = 300, prior: float = 4.0, stop: float = 1e-9) -> dict:
    """EM over vote patterns: {'share': P(good), 'good'/'bad': per rule the chances of each vote in that class}.

    `prior` pseudo-votes per rule and class keep every chance above 0 and tell the classes apart.
    """
    k, share = len(NAMES), 0.8
    chance = {c: [list(START[c]) for _ in range(k)] for c in START}
    total = sum(c for _, c in patterns)
    for _ in range(steps if total else 0):
        p_good = 0.0
        sums = {c: [[prior * x for x in START[c]] for _ in range(k)] for c in START}
        for votes, count in patterns:
            z = posterior(votes, {"share": share, **chance})
            p_good += z * count
            for j, v in enumerate(votes):
                sums["good"][j][v + 1] += z * count
                sums["bad"][j][v + 1] += (1 - z) * count
        new = (p_good + 1) / (total + 2)
        chance = {c: [[x / sum(row) for x in row] for row in sums[c]] for c in sums}
        moved, share = abs(new - share), new
        if moved < stop:
            break
    return {"share": share, **chance}


def log_odds(rates: dict) -> list[tuple[float, float, float]]:
    """What a bad vote, an abstention and a good vote of each rule add to the log-odds of good quality."""
    return [tuple(math.log(g / b) for g, b in zip(good, bad)) for good, bad in zip(rates["good"], rates["bad"])]


def posterior(votes, rates: dict) -> float:
    x = math.log(rates["share"] / (1 - rates["share"]))
    x += sum(row[v + 1] for v, row in zip(votes, log_odds(rates)))
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def fit(docs: DataFrame, text_col: str = "text") -> dict:
    """Rates from all documents; the driver receives vote patterns (at most 3 ** 10 rows), never documents."""
    votes = [f"__v_{r}" for r in NAMES]
    rows = measured(docs.select(F.col(text_col).alias("text"))).groupBy(votes).count().collect()
    return estimate(sorted((tuple(r[v] for v in votes), r["count"]) for r in rows))


def judge(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, rates: dict | None = None) -> DataFrame:
    """`docs` with q_<measure>, q_base_failed, q_posterior and q_kept."""
    rates = rates or fit(docs, text_col)
    x = F.lit(math.log(rates["share"] / (1 - rates["share"])))
    for name, (bad, none, good) in zip(NAMES, log_odds(rates)):
        v = F.col(f"__v_{name}")
        x = x + F.when(v < 0, F.lit(bad)).when(v > 0, F.lit(good)).otherwise(F.lit(none))
    rows = measured(docs, text_col)
    failed = (F.col("__n_words") < 50) | (100 * F.col("__n_repeat_words") > 50 * F.col("__n_words"))
    return rows.withColumns({
        **{f"q_{m}": F.col(f"__{m}") for m in MEASURES},
        "q_base_failed": failed, "q_posterior": 1 / (1 + F.exp(-x)),
    }).withColumn("q_kept", ~F.col("q_base_failed") & (F.col("q_posterior") >= threshold)).drop(
        *[f"__{m}" for m in MEASURES], *[f"__v_{r}" for r in NAMES])


def reject(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that pass, with their own columns."""
    return judge(docs, text_col, threshold).where("q_kept").select(docs.columns)


def op3_quality_rules(spark, sf_dir):
    rows = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", *[F.col(f"q_{m}").alias(m) for m in MEASURES],
                       F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"),
                       F.col("q_posterior").alias("posterior"))


QUERIES = {"op3_quality_rules": (op3_quality_rules, None)}
