"""Periodic run detection: tiles per period octave, boundary Z-functions, interval fragments stitched by text and period.

Words are runs of characters other than the six ASCII white-space characters. A run is a stretch of words with smallest period q
(words q apart are equal) and a length of at least max(6, 4 q) that no neighbouring word extends.

1. Every text becomes word codes (the first place of the word: equal codes are equal words) and is exploded into overlapping
   tiles. An octave j holds the periods 2^j .. 2^(j+1) - 1; with P = 2^(j+1) its tiles reach P words before and 3 P words behind
   their core. Octaves of P up to a quarter of `tile` share tiles with cores of `tile` words, each further octave has
   tiles with cores of 4 P words. Tiles are dealt out one by one, so a very long text is spread over tasks.
2. A tile is solved without its neighbours. A run of length 4 q holds a multiple b of P followed by a whole period, so only such
   boundaries are looked at: word b must return at b + q (one comparison of a grid with its first column finds all), further
   words of the period are compared, and where a candidate is left, Z-functions from the boundary onwards and backwards
   give how far words q apart agree. Periods whose own period divides them are dropped by the same Z-values.
3. Fragments (text, period, places that agree with the place one period later) are merged inside the tile, then across tiles after a
   shuffle by text and period; touching fragments are one. Long enough ones are runs.

A text is known by 128 bits of hash, so equal texts are stitched once: their fragments are equal and combined before the shuffle.

Defined cases: null and blank texts have no words and no runs; repeated rows have the same runs each; ids are not read; all other
columns pass through, whatever their names, and the new column takes the next free name; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runlens.llm.common import BROADCAST_ROWS, WORD, mapped, slices, stored, table

TILE = 1 << 14
#: Codes of texts up to this many words take two bytes.
SHORT = 1 << 16
TILES = "k1 long, k2 long, n long, at long, core long, stop long, low int, high int, codes binary"
FRAGMENTS = "k1 long, k2 long, period long, s long, e long"
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
#: Bytes of codes that one batch of tiles may hold.
BATCH = 4 << 20


def least_matches(q):
    """Places of a run that agree with the place q further on: its length less q."""
    return np.maximum(6 - q, 3 * q)


def layout(n: int, tile: int = TILE):
    """Tiles of a text of n words: (first word, end, core start, core end, lowest octave, highest octave)."""
    top = (n // 4).bit_length() - 1 if n >= 6 else -1  # highest octave with a period of at most n / 4
    shared = min(top, (tile // 4).bit_length() - 2)
    if shared >= 0:
        reach = 2 << shared
        for c in range(0, n, tile):
            yield max(0, c - reach), min(n, c + tile + 3 * reach), c, min(n, c + tile), 0, shared
    for j in range(shared + 1, top + 1):
        p = 2 << j
        for c in range(0, n, 4 * p):
            yield max(0, c - p), min(n, c + 7 * p), c, min(n, c + 4 * p), j, j


def z_values(s: list) -> list:
    """z[i]: how many items from i on equal the items from 0 on."""
    n = len(s)
    z = [0] * n
    z[0] = n
    lo = hi = 0
    for i in range(1, n):
        k = 0
        if i < hi:
            k = z[i - lo]
            if k < hi - i:
                z[i] = k
                continue
            k = hi - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return z


def at_boundary(w: np.ndarray, b: int, p: int, periods: np.ndarray) -> list:
    """(period, first place, end) around place b of w, for those of `periods` that hold a whole period from b on."""
    ahead = np.array(z_values(w[b:b + 3 * p].tolist()))
    periods = periods[ahead[periods] >= periods]
    if not len(periods):
        return []
    # Smallest period of the first q words: the smallest d whose Z-value reaches the q-th word.
    reach = np.maximum.accumulate(np.arange(1, len(ahead)) + ahead[1:])
    own = np.searchsorted(reach, periods) + 1
    periods = periods[(own == periods) | (periods % own != 0)]
    before = w[max(0, b - p):b][::-1].tolist()
    around = w[max(0, b - p):b + p][::-1].tolist()
    back = z_values([*before, -1, *around])
    right = len(around) - len(before)
    return [(int(q), b - back[len(before) + 1 + right - q], b + int(ahead[q])) for q in periods]


def merged(found: list) -> list:
    """Touching intervals of the same period as one."""
    out: list = []
    for q, s, e in sorted(found):
        if out and out[-1][0] == q and s <= out[-1][2]:
            out[-1][2] = max(out[-1][2], e)
        else:
            out.append([q, s, e])
    return out


def solve(w: np.ndarray, at: int, n: int, core: int, stop: int, low: int, high: int) -> list:
    """Fragments of one tile: w holds the codes of the words from `at` on; boundaries lie in [core, stop)."""
    found = []
    size = len(w)
    for j in range(low, high + 1):
        p, half = 2 << j, 1 << j
        rows = -(-(stop - core) // p)
        part = w[core - at:core - at + rows * p]
        if len(part) < rows * p:
            part = np.concatenate([part, np.full(rows * p - len(part), -1, dtype=w.dtype)])
        grid = part.reshape(rows, p)
        r, q = np.nonzero(grid[:, half:] == grid[:, :1])
        b, q = core - at + r * p, q + half
        for share in (1, 2, 4, 8, 3):  # the last, middle, ... word of the period must return as well
            if not len(q):
                break
            t = b + np.maximum(q - 1, 0) // share
            ok = t + q < size
            ok[ok] = w[t[ok]] == w[(t + q)[ok]]
            b, q = b[ok], q[ok]
        cuts = np.flatnonzero(np.diff(b)) + 1
        for place, periods in zip(np.split(b, cuts), np.split(q, cuts)):
            if len(place):
                found += at_boundary(w, int(place[0]), p, periods)
    out = []
    for q, s, e in merged(found):
        # What ends inside the tile on both sides is whole: too short ones go at once.
        left = s + at == 0 or s > 0 and w[s - 1] != w[s - 1 + q]
        right = e + at + q == n or e + q < size and w[e] != w[e + q]
        if e - s >= least_matches(q) or not (left and right):
            out.append((q, s + at, e + at))
    return out


def coded(words: list) -> np.ndarray:
    """The first place of every word."""
    first: dict = {}
    return np.fromiter(map(first.setdefault, words, range(len(words))), dtype=np.int64, count=len(words))


def _keys(batch):
    return batch.column(0).to_pylist(), batch.column(1).to_pylist()


def tiles(keyed: DataFrame, tile: int = TILE) -> DataFrame:
    """From (k1, k2, text as binary): the tiles of every text."""
    names = [part.split()[0] for part in TILES.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.int32()] * 2 + [pa.binary()]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches):
        for batch in batches:
            for piece in slices(batch):
                held, rows = 0, []
                for k1, k2, text in zip(*_keys(piece), piece.column(2)):
                    words = (text.as_py() or b"").split()  # bytes are split at the six white-space characters
                    n = len(words)
                    if n < 6:
                        continue
                    codes = coded(words).astype(np.uint16 if n <= SHORT else np.uint32)
                    for lo, hi, core, stop, low, high in layout(n, tile):
                        rows.append((k1, k2, n, lo, core, stop, low, high, codes[lo:hi].tobytes()))
                        held += len(rows[-1][-1])
                        if held > BATCH:
                            yield out(rows)
                            held, rows = 0, []
                if rows:
                    yield out(rows)

    return mapped(keyed, run, TILES)


def fragments(dealt: DataFrame) -> DataFrame:
    names = [part.split()[0] for part in FRAGMENTS.split(", ")]

    def run(batches):
        for batch in batches:
            found = []
            numbers = [c.to_pylist() for c in batch.columns[:8]]
            for (k1, k2, n, at, core, stop, low, high), codes in zip(zip(*numbers), batch.column(8)):
                w = np.frombuffer(codes.as_buffer(), dtype=np.uint16 if n <= SHORT else np.uint32).astype(np.int64)
                found += [(k1, k2, q, s, e) for q, s, e in solve(w, at, n, core, stop, low, high)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else [[]] * 5)], names)

    return mapped(dealt, run, FRAGMENTS)


def stitched(found: DataFrame) -> DataFrame:
    """Runs (k1, k2, start, length, period) from the fragments of all tiles."""
    by = W.partitionBy("k1", "k2", "period").orderBy("s", "e")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    new = F.coalesce((F.col("s") > F.max("e").over(before)).cast("int"), F.lit(1))
    islands = found.distinct().withColumn("new", new).withColumn("island", F.sum("new").over(by))
    whole = islands.groupBy("k1", "k2", "period", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    q = F.col("period")
    return whole.where(F.col("e") - F.col("s") >= F.greatest(6 - q, 3 * q)).select(
        "k1", "k2", F.col("s").alias("start"), (F.col("e") - F.col("s") + q).alias("length"), "period")


def text_key(text: str) -> list:
    """128 bits of a text; null counts as empty."""
    value = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(value).alias("k1"), F.xxhash64(F.lit(1), value).alias("k2")]


def runs_of(docs: DataFrame, text_col: str = "text", tile: int = TILE) -> DataFrame:
    """Stored table of the runs of every different text: k1, k2, start, length, period."""
    keyed = docs.select(*text_key(text_col), F.col(text_col).cast("binary").alias("text"))
    exploded = tiles(keyed, tile).withColumn("nth", F.monotonically_increasing_id())
    dealt = exploded.repartition("nth").drop("nth")
    return stored(stitched(fragments(dealt)), "periodic-runs")


def free_name(name: str, taken) -> str:
    """`name`, or the first of name_2, name_3, ... that no column has (names differ in more than case)."""
    low = {c.lower() for c in taken}
    return next(c for c in (name, *(f"{name}_{i}" for i in range(2, len(low) + 3))) if c.lower() not in low)


def with_runs(docs: DataFrame, text_col: str = "text", tile: int = TILE) -> DataFrame:
    """`docs` and a last column `runs`: the runs of the text by start, then period."""
    runs = runs_of(docs, text_col, tile)
    lists = runs.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("found"))
    if runs.count() <= BROADCAST_ROWS:
        lists = F.broadcast(lists)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *text_key(f"`{text_col}`"))
    ordered = F.transform("found", lambda r: F.struct(r["start"], r["length"], r["period"]))
    name = free_name("runs", docs.columns)
    return rows.join(lists, ["k1", "k2"], "left").select(
        "row.*", F.coalesce(ordered, F.array()).cast(RUNS).alias(name))


def kept_words(text: bytes | None, runs) -> list:
    """Words that no run holds after its first period."""
    words = (text or b"").split()
    if not runs:
        return words
    keep = np.ones(len(words), dtype=bool)
    for r in runs:
        keep[r["start"] + r["period"]:r["start"] + r["length"]] = False
    return [w for w, k in zip(words, keep.tolist()) if k]


def collapse(docs: DataFrame, text_col: str = "text", tile: int = TILE) -> DataFrame:
    """`docs` with every run cut down to its first period; texts without a run stay as they are, others are joined by spaces."""
    found = with_runs(docs, text_col, tile)
    at, runs = docs.columns.index(text_col), found.columns[-1]

    def run(batches):
        for batch in batches:
            old, lists = batch.column(at), batch.column(batch.num_columns - 1)
            text = [t.as_py() if not (r := rs.as_py()) else b" ".join(kept_words(t.as_py().encode(), r)).decode()
                    for t, rs in zip(old, lists)]
            columns = [pa.array(text, old.type) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return mapped(found, run, found.drop(runs).schema)


def made_periodic(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the documents of the contract, a tenth of them periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all(
        F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).alias("w"))
    rows = rows.withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.expr("cast((h div 10) % nullif(n, 0) as int)"))
    rows = rows.withColumn("p", F.expr("cast(1 + (n - a) div (3 + (h div 10) % 8) as int)"))
    tail = F.expr("flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int)))")
    made = F.concat_ws(" ", F.slice(F.concat(F.expr("slice(w, 1, a)"), tail), F.lit(1), F.col("n")))
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), made).otherwise(F.col("text")).alias("text"))


DIGEST = ("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def op11_periodic_runs(spark, sf_dir):
    docs = made_periodic(table(spark, sf_dir, "documents"))
    found = with_runs(docs).select("doc_id", F.col("text").cast("binary").alias("text"), "runs")
    names = [part.split()[0] for part in DIGEST.split(", ")]

    def run(batches):
        for batch in batches:
            for piece in slices(batch):
                rows = []
                for text, runs in zip(piece.column(1), piece.column(2)):
                    runs = runs.as_py()
                    best = max(runs, key=lambda r: (r["length"], -r["start"], -r["period"]), default=None)
                    lines = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs)
                    kept = b" ".join(kept_words(text.as_py(), runs))
                    rows.append((len(runs), *((best["start"], best["length"], best["period"], 1000 * best["length"] // best["period"])
                                              if best else (None,) * 4),
                                 hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))],
                                                 ["doc_id", *names])

    return mapped(found, run, f"doc_id long, {DIGEST}")


QUERIES = {"op11_periodic_runs": (op11_periodic_runs, None)}
