"""The whole pipeline against a plain Python version, and every stage on awkward and empty tables."""

import re
from collections import Counter

import corpus_pipeline
from runlens.llm import mixing, pieces, quality

from .cases import SCHEMA, awkward, frame
from .test_dedup import near_truth, norm
from .test_text_ops import W, processor, target_truth

SF = "/root/testdata/sf0.001"


def plain_quality(rows):
    measured = [quality.measure(r["text"] or "") for r in rows]
    rates = quality.estimate(sorted(Counter(tuple(quality.vote(v)) for _, v in measured).items()))
    return [r for r, (base, values) in zip(rows, measured)
            if base[0] >= 50 and 100 * base[4] <= 50 * base[0] and quality.posterior(quality.vote(values), rates) >= 0.5]


def plain_exact(rows):
    groups = {}
    for r in rows:
        groups.setdefault(norm(r["text"]), []).append(r)
    return [min(g, key=lambda r: (-len(r["text"] or ""), r["doc_id"])) for g in groups.values()]


def plain_near(rows):
    gone = {i for i, _, _, kept in near_truth([(r["doc_id"], r["text"], None) for r in rows]) if not kept}
    return [r for r in rows if r["doc_id"] not in gone]


def plain_mix(rows):
    import hashlib

    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(W.findall(r["text"] or ""))
    targets = target_truth(dict(sizes))
    out = []
    for r in rows:
        rate = targets[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0.0
        u = int(hashlib.md5(f"{mixing.SEED}:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 16**13
        out += [r] * (int(rate + 1e-12) + (u < rate - int(rate + 1e-12) - 1e-12))
    return out


def test_run_equals_the_plain_version(spark):
    sp = processor()
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = plain_mix(plain_near(plain_exact(plain_quality(rows))))
    assert 0 < len({r["doc_id"] for r in docs}) < len(rows)
    want = Counter((r["doc_id"], r["source"], r["text"], tuple(sp.encode(r["text"]))) for r in docs)
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "piece_ids", "piece_count"]
    assert Counter((r["doc_id"], r["source"], r["text"], tuple(r["piece_ids"])) for r in got.collect()) == want


def test_stages_on_awkward_and_empty_tables(spark, tmp_path):
    for k, rows in enumerate((awkward(), [])):
        docs = frame(spark, rows) if rows else spark.createDataFrame([], SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, None)
            extra = [c for c, _ in pieces.COLUMNS[:2]] if name == "token_ids" else []
            assert out.columns == [*SCHEMA.names, *extra]
            out.write.parquet(f"{tmp_path}/{k}-{name}")
            kept = spark.read.parquet(f"{tmp_path}/{k}-{name}")
            assert kept.count() > 0 or not rows or name == "quality_rules"  # made-up words do not pass as prose


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "source_mixture", "token_ids"]
    assert corpus_pipeline.ORACLE_SQL is None and not re.search("except ImportError", open(corpus_pipeline.__file__).read())
