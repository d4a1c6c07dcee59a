"""Exact, near and line deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest

from runlens.llm import exact_dedup, line_dedup, near_dedup
from runlens.llm.components import components

from .cases import SCHEMA, awkward, frame, words


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_groups_against_brute_force(spark):
    rows = awkward() + [(100 + i, " ".join(words(60, 3)) + " " * (i % 4), "hot") for i in range(40)]
    got = sorted(map(tuple, exact_dedup.exact_groups(frame(spark, rows), salts=4).collect()), key=str)
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(norm(t), []).append((len(t or ""), i))
    want = []
    for text, members in groups.items():
        top = max(n for n, _ in members)
        named = [i for n, i in members if n == top and i is not None]
        keep = min(named) if named else None
        taken = False
        for _, i in sorted(members, key=str):
            first = i == keep and not taken
            taken |= first
            want.append((i, keep, len(members), first, hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_exact_deduplicate_keeps_columns_and_one_row_per_group(spark):
    rows = awkward()
    docs = frame(spark, rows)
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    texts = [norm(r["text"]) for r in kept]
    assert len(texts) == len(set(texts)) == len({norm(t) for _, t, _ in rows})
    assert {r["doc_id"] for r in kept if norm(r["text"]) == norm(rows[0][1])} == {3}  # the longest original


def test_exact_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_groups(docs).count() == 0
    assert exact_dedup.deduplicate(docs).columns == docs.columns


def shingles(text):
    ws = [w for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    return {tuple(ws)} if 0 < len(ws) < 5 else set(zip(*(ws[k:] for k in range(5))))


def near_truth(rows):
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and None not in (rows[a][0], rows[b][0]) and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), None if i is None else least[find(k)], i is None or least[find(k)] == i)
                   for k, (i, _, _) in enumerate(rows)), key=str)


def edited(base, n, seed):
    r = random.Random(seed)
    out = list(base)
    for _ in range(n):
        out[r.randrange(len(out))] = f"e{r.randrange(10**9)}"
    return " ".join(out)


def crowd():
    """Copies, near copies around one text, a chain of edits, texts that share half their words."""
    base, rows = words(150, 4, 10**6), []
    for k in range(120):
        rows.append((1000 + k, edited(base, k % 9, k), "hot"))
    chain = list(base)
    for k in range(30):
        chain = edited(chain, 2, 500 + k).split()
        rows.append((2000 + k, " ".join(chain), "chain"))
    for k in range(40):
        rows.append((3000 + k, " ".join(base[:75] + words(60, 900 + k, 10**6)), "passage"))
    return rows + [(4000 + k, " ".join(words(5 + k, 50 + k % 3)), "short") for k in range(20)]


def test_near_groups_against_brute_force(spark):
    rows = awkward() + crowd()
    got = sorted(map(tuple, near_dedup.near_groups(frame(spark, rows)).collect()), key=str)
    assert got == near_truth(rows)


def test_near_rest_in_tiles_finds_what_one_tile_finds(spark, monkeypatch):
    # Without any link from the stars all candidate pairs go through the tiles.
    from pyspark.sql import functions as F

    rows = crowd()
    texts = spark.createDataFrame([(i, t) for i, t, _ in rows], "id long, text string")
    made = near_dedup.sketch(texts)
    members = (made.select("id", F.posexplode("bands").alias("band", "bucket"))
               .join(made.select(F.explode("bands").alias("bucket")).groupBy("bucket").count(), "bucket")
               .select("bucket", "band", "id", F.col("count").alias("n"), F.lit(False).alias("is_hub")).where("n > 1"))
    hub = members.groupBy("bucket").agg(F.min("id").alias("hub"))
    members = members.join(hub, "bucket").withColumn("is_hub", F.col("id") == F.col("hub")).drop("hub")
    labels = spark.createDataFrame([(1, 1)], "node long, component long")
    sizes = made.select("id", "n_shingles")
    found = [set(map(tuple, near_dedup.rest(members, labels, sizes, texts, *tile).distinct().collect()))
             for tile in ((7, 1 << 20), (1000, 1 << 20), (1000, 700))]
    assert found[0] == found[1] == found[2]
    sets = {i: shingles(t) for i, t, _ in rows}
    hubs = {r["bucket"]: r["hub"] for r in hub.collect()}
    tested = {(min(r["id"], hubs[r["bucket"]]), max(r["id"], hubs[r["bucket"]])) for r in members.collect()}
    similar = {(a, b) for a in sets for b in sets if a < b
               and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert found[0] <= similar and similar - tested <= found[0] and len(found[0]) > 100


def test_near_empty_and_kept_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert near_dedup.near_groups(docs).count() == 0
    rows = awkward()
    out = near_dedup.deduplicate(frame(spark, rows))
    gone = {i for i, _, c, k in near_truth(rows) if not k}
    assert sorted(map(str, (r["doc_id"] for r in out.collect()))) == sorted(str(i) for i, _, _ in rows if i not in gone)
    assert out.columns == docs.columns


def test_near_deduplicate_of_one_id_on_several_texts(spark):
    a, b, c, d = (" ".join(words(150, 70 + k, 10**6)) for k in range(4))
    rows = awkward() + crowd() + [
        (5000, a, "s"), (5001, a, "s"), (5001, b, "s"),  # copy of another one, unique
        (5002, c, "s"), (5003, c + " and more", "s"), (5003, d, "s"), (5004, d + " tail", "s"),  # near copy of another one, kept
        (5005, a + " x", "s"), (5005, None, "s"), (None, a, "s"), (5003, d, "s")]
    got = near_dedup.deduplicate(frame(spark, rows))
    # One row of the truth stands for one text: they come with id and number of shingles.
    left = Counter((i, n) for i, n, _, kept in near_truth(rows) if kept)
    assert Counter((r["doc_id"], len(shingles(r["text"]))) for r in got.collect()) == left
    texts = Counter((r["doc_id"], r["text"]) for r in got.collect() if r["doc_id"] and r["doc_id"] >= 5000)
    assert texts == Counter({(5000, a): 1, (5001, b): 1, (5002, c): 1, (5003, d): 2, (5005, None): 1})


def test_least_matches_is_the_posterior_bound():
    import numpy as np

    p = np.linspace(0, 1, 200001)[1:-1]
    x = 0.75 + 0.25 / 256
    for k, m in enumerate(near_dedup.least_matches(1e-6)[:4]):
        n = 32 * (k + 1)
        tail = [(lambda w: w[p >= x].sum() / w.sum())(np.exp(j * np.log(p) + (n - j) * np.log1p(-p) - (
            j * np.log(max(j / n, 1e-9)) + (n - j) * np.log(max(1 - j / n, 1e-9))))) for j in (m - 1, m)]
        assert tail[0] < 1e-6 <= tail[1] * 1.001


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (20, 21), (30, 30), (9, 5)] + [(100, k) for k in range(101, 140)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {4: 3, 5: 3, 9: 3, 21: 20, **{k: 100 for k in range(101, 140)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def line_truth(rows, least):
    """Delete every line inside a run of >= least words that occurs earlier."""
    keyed = sorted({(i, t) for i, t, _ in rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    seen, out = set(), {}
    for i, t in keyed:
        parts = (t or "").split("\n") if t is not None else []
        real = [(k, x.strip(" \t\r\x0b\x0c"), len(re.findall(r"[^\x20\x09-\x0D]+", x))) for k, x in enumerate(parts)]
        real = [r for r in real if r[2]]
        runs = []
        for a in range(len(real)):
            total = 0
            for b in range(a, len(real)):
                total += real[b][2]
                if total >= least:
                    runs.append((a, tuple(r[1] for r in real[a:b + 1]), real[a][0], real[b][0]))
        cut = set()
        for _, body, first, last in sorted(runs, key=lambda r: r[0]):
            if body in seen:
                cut.update(k for k, _, _ in real if first <= k <= last)
            seen.add(body)
        for (a, _, _), (b, _, _) in zip(real, real[1:]):
            cut.update(range(a, b) if a in cut and b in cut else ())
        out[i, t] = (i, len(parts), len(cut), None if t is None else "\n".join(x for k, x in enumerate(parts) if k not in cut))
    return sorted((out[i, t] for i, t, _ in rows), key=str)


@pytest.mark.parametrize("least", [5, 12])
def test_line_dedup_against_brute_force(spark, least):
    r = random.Random(9)
    pool = [" ".join(words(r.randrange(1, 7), k)) for k in range(25)]
    rows = [(k, "\n".join(r.choice(pool + ["", "  "]) for _ in range(r.randrange(1, 14))), "a") for k in range(60)]
    rows += [(70, None, "a"), (70, None, "a"), (71, "", "a"), (None, pool[0] + "\n" + pool[1], "b"), (72, " \n\t\n", "a"),
             (73, rows[3][1], "a"), (73, rows[3][1], "a"), (74, "\n".join(f"  {x}\r" for x in rows[5][1].split("\n")), "a")]
    docs = frame(spark, rows)
    out = line_dedup.dedup_lines(docs, min_words=least)
    assert out.columns == [*docs.columns, "line_count", "line_removed", "line_text"]
    got = sorted(map(tuple, out.select("doc_id", "line_count", "line_removed", "line_text").collect()), key=str)
    assert got == line_truth(rows, least)
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_line_dedup_is_native(spark):
    plan = line_dedup.dedup_lines(frame(spark, awkward()))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|RDDScan|ExternalRDD", plan.replace("Scan ExistingRDD", ""))
