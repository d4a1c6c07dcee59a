"""Periodic runs against plain loops over periods: tiny tiles, long periods, random and planted texts, the registered query."""

import hashlib
import random
import re
import zlib

import numpy as np

from runlens.llm import periodic

from .cases import SCHEMA, awkward, frame

SF = "/root/testdata/sf0.001"


def truth(ws):
    """All runs (start, length, period) of a word list: every period, longest stretches, smallest period."""
    first: dict = {}
    w = np.array([first.setdefault(x, i) for i, x in enumerate(ws)])
    out = []
    for q in range(1, len(w) // 4 + 1):
        same = np.concatenate([[False], w[:-q] == w[q:], [False]]).astype(int)
        turn = np.flatnonzero(np.diff(same))
        for i, e in zip(turn[::2].tolist(), turn[1::2].tolist()):
            length, root = e - i + q, ws[i:i + q]
            if length >= max(6, 4 * q) and not any(q % d == 0 and root == root[:d] * (q // d) for d in range(1, q)):
                out.append((i, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(ws, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(ws) if i not in gone]


def repeating(r, n):
    """Random words with periodic stretches of many lengths and periods."""
    out = []
    while len(out) < n:
        if r.random() < 0.5:
            out += [f"w{r.randrange(30)}" for _ in range(r.randrange(1, 40))]
        else:
            q = r.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 31, 40])
            root = [f"{r.choice('ab')}{r.randrange(3)}" for _ in range(q)]
            out += (root * 9)[:r.randrange(2 * q, 9 * q + 1)]
    return out[:n]


def test_z_values():
    r = random.Random(1)
    for _ in range(200):
        s = [r.randrange(2) for _ in range(r.randrange(1, 30))]
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert periodic.z_values(s) == want


def test_layout_covers_every_place_of_every_octave():
    for n in (6, 7, 8, 31, 64, 65, 200, 1000):
        tiles = list(periodic.layout(n, 32))
        for j in range((n // 4).bit_length()):
            cores = sorted((c, e) for _, _, c, e, lo, hi in tiles if lo <= j <= hi)
            assert [c for c, _ in cores] == [0] + [e for _, e in cores][:-1] and cores[-1][1] == n
    assert list(periodic.layout(5, 32)) == []


def test_runs_on_random_texts_and_small_tiles(spark):
    r = random.Random(8)
    texts = [" ".join(repeating(r, r.randrange(1, 700))) for _ in range(60)]
    texts += ["a " * n for n in (1, 5, 6, 7, 64, 333)] + [" ".join("ab"[i % 2] for i in range(500))]
    texts += [" ".join(bin(i).count("1") % 2 * "x" or "y" for i in range(512))]  # no word thrice in a row
    texts += [" ".join(f"u{i % 150}" for i in range(601)), " ".join(f"u{i % 150}" for i in range(599))]
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    for tile in (8, 64, periodic.TILE):
        got = {row["doc_id"]: [tuple(x) for x in row["runs"]] for row in periodic.with_runs(docs, tile=tile).collect()}
        for i, t in enumerate(texts):
            assert got[i] == truth(t.split()), (tile, i)


def test_awkward_and_empty_tables(spark):
    rows = awkward() + [(60, "k l m " * 9 + "\x85 \xa0", "x"), (60, "k l m " * 9 + "\x85 \xa0", "x"), (60, "z " * 20, "x")]
    docs = frame(spark, rows)
    found = periodic.with_runs(docs)
    assert found.columns == [*docs.columns, "runs"] and found.count() == len(rows)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    want = sorted((str(i), str(t), str(truth(words(t)))) for i, t, _ in rows)
    assert want == sorted((str(x["doc_id"]), str(x["text"]), str([tuple(y) for y in x["runs"]])) for x in found.collect())
    short = periodic.collapse(docs)
    assert short.dtypes == docs.dtypes
    want = sorted((str(i), str(t if not truth(words(t)) else " ".join(kept(words(t), truth(words(t)))))) for i, t, _ in rows)
    assert want == sorted((str(x["doc_id"]), str(x["text"])) for x in short.collect())
    # The new column takes a free name, and an empty table stays empty.
    assert periodic.with_runs(docs.withColumnRenamed("rank", "Runs")).columns[-1] == "runs_2"
    empty = spark.createDataFrame([], SCHEMA)
    assert periodic.with_runs(empty).count() == 0 and periodic.collapse(empty).count() == 0


def test_registered_query_against_plain_loops(spark):
    """Every document of the table, changed as the query changes it."""
    rows = {x["doc_id"]: x for x in periodic.op11_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    hits = 0
    for d in docs:
        ws = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        n, h = len(ws), zlib.crc32(str(d["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [ws[i if i < a else a + (i - a) % p] for i in range(n)]
        runs, x = truth(ws), rows[d["doc_id"]]
        hits += bool(runs)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        assert (x["n_runs"], x["start"], x["length"], x["period"]) == (len(runs), *best)
        assert x["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert x["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert x["collapsed_sha256"] == hashlib.sha256(" ".join(kept(ws, runs)).encode()).hexdigest()
    assert hits > 10
