"""Quality rules, licences, toxicity, mixing and pieces against brute force, the reference library, or held-out labels."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from runlens.llm import licenses, mixing, pieces, quality, toxicity

from .cases import SCHEMA, awkward, frame, words

SF = "/root/testdata/sf0.01"
W = re.compile(r"[^\x20\x09-\x0D]+")


# ---- quality ------------------------------------------------------------------------------------------------

def base_truth(text):
    text = text or ""
    ws = W.findall(text)
    lines = [x for x in text.split("\n") if W.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = Counter(zip(ws, ws[1:], ws[2:]))
    hit = {k + d for k in range(len(ws) - 2) if windows[tuple(ws[k:k + 3])] > 1 for d in range(3)}
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit))


def test_quality_measures_and_verdicts(spark):
    rows = awkward() + [(50, "a b a b a b a b", "x"), (51, "q r s t q r s x y q r s", "x"), (52, "###  &&|<>$*% ok", "x")]
    docs = frame(spark, rows)
    out = quality.judge(docs)
    assert out.columns[:len(docs.columns)] == docs.columns
    got = sorted(((r["doc_id"], *(r[f"q_{m}"] for m in quality.MEASURES)) for r in out.collect()), key=str)
    assert got == sorted(((i, *base_truth(t)) for i, t, _ in rows), key=str)
    for r in out.collect():
        n, _, _, _, rep = base_truth(r["text"])
        assert r["q_base_failed"] == (n < 50 or 100 * rep > 50 * n)
        assert r["q_kept"] == (not r["q_base_failed"] and r["q_posterior"] >= 0.5)
    assert quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0
    assert quality.reject(docs).columns == docs.columns


def test_quality_posterior_is_bayes():
    rates = quality.estimate([((0,) * 10, 80), ((-1, 0, 0, 0, 0, 0, -1, 0, 0, 1), 15), ((0, -1, -1, 0, 0, 0, -1, 1, 0, 1), 5)])
    votes = (-1, 0, 0, 0, 0, 0, -1, 0, 0, 1)
    good, bad = rates["share"], 1 - rates["share"]
    for v, g, b in zip(votes, rates["good"], rates["bad"]):
        good, bad = good * g[v + 1], bad * b[v + 1]
    assert quality.posterior(votes, rates) == pytest.approx(good / (good + bad))
    assert quality.posterior(votes, rates) < 0.1 < 0.9 < quality.posterior((0,) * 10, rates)
    assert quality.estimate([])["share"] == 0.8


def test_quality_agrees_with_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality is not null")
    rows = quality.judge(docs.select("doc_id", "text")).join(labels, "doc_id").where("not q_base_failed").collect()
    right = sum(r["q_kept"] == (r["quality"] == 1) for r in rows)
    assert len(rows) > 200 and right / len(rows) > 0.97


# ---- licences -----------------------------------------------------------------------------------------------

def license_base(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label, _ in licenses.BASE:
        p = phrase.split()
        for k in range(len(ws) - len(p) + 1):
            if ws[k:k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan_base_and_labels(spark):
    texts = ["Released UNDER the MIT-License; under\nthe (MIT) license", "Apache License, Version 2.0 apache license version 2",
             "cc by-nc CC BY NC cc by nc", "under the MIT licence", "GNU Lesser General Public License v2.1", "All rights reserved.",
             "SPDX-License-Identifier: BSD-3-Clause", "é under the mit license ñ", "mit der Lizenz", "the gpl"]
    rows = awkward() + [(100 + k, t, "x") for k, t in enumerate(texts)]
    rows += [(200, ("under the mit license " * 3000) + " ".join(words(2000, 3)), "x")]
    docs = frame(spark, rows)
    out = licenses.scan(docs)
    assert out.columns[:len(docs.columns)] == docs.columns
    got = out.collect()
    assert sorted(((r["doc_id"], r["license_words"], r["license_places"], r["license_first"], r["license_last"],
                    r["license_base"]) for r in got), key=str) == sorted(((i, *license_base(t)) for i, t, _ in rows), key=str)
    labels = {r["doc_id"]: r["license_labels"] for r in got}
    assert labels[104] == "lgpl-2.1" and labels[105] == "all-rights-reserved" and labels[106] == "bsd-3"
    assert labels[103] == "mit" and labels[108] == "" and labels[1] == ""
    spans = {r["doc_id"]: [(s["label"], s["start"], s["stop"]) for s in r["license_spans"]] for r in got}
    assert spans[104] == [("lgpl-2.1", 0, 7)] and spans[1] == [] and spans[106] == [("bsd-3", 0, 6)]
    for r in got:
        assert set(filter(None, r["license_base"].split(","))) <= set(r["license_labels"].split(","))
        assert 0 <= r["license_score"] <= 1 and (r["license_score"] > 0) == (r["license_labels"] != "")
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_license_rules_are_hundreds_and_suppression_keeps_the_outermost():
    assert len(licenses.rules()) > 300
    found = [(-75, -10, 5, 1, 15, "gpl"), (-75, -20, 0, 0, 20, "lgpl"), (-95, -3, 30, 2, 33, "mit"), (-60, -9, 28, 3, 37, "x")]
    assert [k[-1] for k in licenses.suppress(found)] == ["mit", "lgpl", "x"]


def license_labels(text):
    """Every rule tried everywhere, without keywords; detections taken best first, each compared with all accepted ones."""
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    line = " " + " ".join(ws) + " "
    found = sorted((-priority, m.start() - m.end(), m.start(), nth, m.end(), label)
                   for nth, (label, priority, _, rule) in enumerate(licenses.rules())
                   for m in re.finditer(f" {rule}(?= )", line))
    kept = []
    for d in found:
        if not any(k[2] <= d[2] and d[4] <= k[4] for k in kept):
            kept.append(d)
    return ",".join(sorted({k[-1] for k in kept} | set(filter(None, license_base(text)[-1].split(",")))))


def test_license_labels_on_short_forms_and_names_that_are_no_licence():
    scanner = licenses.Scanner()
    labels = lambda text: scanner.scan(text.encode())[5]
    for text in ("used by Ruby developers", "Hosting provided by Apache httpd", "published by Elastic", "offered by MIT students",
                 "released by Boost", "Apache 2 on port 80", "sent cc by mail", "available under Ruby 3.1", "the MPL 2 lines"):
        assert labels(text) == "" == license_labels(text), text
    for text, label in (("GPLv3", "gpl-3"), ("GNU GPL v2", "gpl-2"), ("LGPL-3.0-or-later", "lgpl-3"), ("MPL 2.0", "mpl-2"),
                        ("BSD 3-Clause", "bsd-3"), ("BSD-2-Clause", "bsd-2"), ("LGPLv2.1+", "lgpl-2.1"), ("AGPL-3.0-only", "agpl-3"),
                        ("CC BY 4.0", "cc-by"), ("Released under the MIT", "mit"), ("published by the Apache License", "apache"),
                        ("licensed under Apache 2.0", "apache-2"), ("distributed under the terms of the Ruby licence", "ruby"),
                        ("provided under the terms of the Boost Software License", "bsl"), ("available under GPL-2.0", "gpl-2"),
                        ("Apache License 2.0", "apache-2"), ("Licence: Elastic", "elastic")):
        assert labels(text) == label == license_labels(text), text


def test_license_labels_equal_the_plain_version():
    parts = [" ".join(p) for p in zip(words(300, 1), words(300, 2))] + [t for row in licenses.TABLE.values() for t in row[1:] if "(" not in t]
    parts += ["licensed under the", "provided by", "license", "licence:", "spdx-license-identifier", "apache license version 2", "gpl 2", "lgpl 2.1",
              "cc by nc", "under the mit license", "gnu lesser general public license v3", "creative commons attribution sharealike 4.0", "all rights reserved"]
    rng = random.Random(5)
    scanner = licenses.Scanner()
    for _ in range(150):
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 40)))
        got = scanner.scan(text.encode())
        assert got[5] == license_labels(text) and got[:5] == license_base(text)
        assert all(0 <= s["start"] < s["stop"] <= got[0] for s in got[7])


def test_license_places_of_very_long_texts():
    n = 200_000
    got = licenses.Scanner().scan(b"x under the mit license " * n)
    assert got[:4] == (5 * n, n, 1, 5 * n - 4) and got[7][-1]["stop"] == 5 * n


# ---- toxicity -----------------------------------------------------------------------------------------------

def test_toxicity_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels.where("doc_id % 5 <> 0"), per_class=1500)
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) >= 2
    rows = toxicity.grade_texts(docs, model).join(labels.where("doc_id % 5 = 0"), "doc_id").collect()
    toxic, clean = ([r for r in rows if r["toxic"] == k] for k in (1, 0))
    assert sum(r["tox_p_toxic"] >= 0.5 for r in toxic) > 0.93 * len(toxic)
    assert sum(r["tox_p_toxic"] >= 0.5 for r in clean) < 0.01 * len(clean)
    for r in rows:
        assert 0 <= r["tox_severity"] <= len(model.thresholds) and (r["tox_p_toxic"] <= r["tox_severity"] + 1e-12)


def test_toxicity_fit_recovers_order():
    import numpy as np

    r = np.random.default_rng(1)
    x = r.poisson(1.0, (1500, 3)).astype(float)
    z = x @ np.array([2.0, -1.0, 0.0]) + r.logistic(size=1500)
    y = (z > 0).astype(int) + (z > 3)
    w, theta = toxicity.fit_ordinal(x, y, 3, l2=0.0)
    assert abs(w[0] - 2) < 0.35 and abs(w[1] + 1) < 0.3 and abs(w[2]) < 0.2 and theta[0] < theta[1]


def test_toxicity_awkward_rows(spark):
    rows = awkward()
    docs = frame(spark, rows)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.grade_texts(docs, toxicity.fit(docs, none))
    assert out.columns[:len(docs.columns)] == docs.columns and {r["tox_severity"] for r in out.collect()} == {0.0}
    many = [(k, ("vile " if k % 2 else "fair ") * (1 + k % 5) + " ".join(words(20, k)), "s") for k in range(200)]
    marked = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(1, 1), (1, 0)], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, many), marked)
    got = {r["doc_id"]: r["tox_p_toxic"] for r in toxicity.grade_texts(frame(spark, many + rows), model).collect() if r["doc_id"]}
    assert got[3] >= 0 and all((got[k] > 0.5) == (k % 2 == 1) for k in range(20, 200))
    assert toxicity.grade_texts(spark.createDataFrame([], SCHEMA), model).count() == 0


def plain_features(text):
    """Words and their beginnings with how often each occurs, and the number of words."""
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    return Counter(f for w in ws for f in [w + "$"] + [w[:k] for k in (3, 4, 6) if len(w) >= k]), len(ws)


def plain_grade(text, model):
    """(severity, grade, P(toxic)) of a text by the formulas of the cumulative-link model."""
    counts, n = plain_features(text)
    z = sum(w * counts[f] for f, w in zip(model.words, model.weights)) / (1 + n / 200) ** 0.5
    above = [1 / (1 + math.exp(min(500, t - z))) for t in model.thresholds]
    if not above:
        return 0.0, 0, 0.0
    mass = [hi - lo for hi, lo in zip([1.0, *above], [*above, 0.0])]
    return sum(above), mass.index(max(mass)), above[0]


def test_toxicity_equals_the_plain_version_on_whole_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    assert model.words and len(model.thresholds) >= 2
    rows = {r["doc_id"]: r for r in toxicity.QUERIES["op9_toxicity"][0](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        severity, grade, p = plain_grade(text, model)
        r = rows[i]
        assert r["severity"] == pytest.approx(severity, abs=1e-9) and r["p_toxic"] == pytest.approx(p, abs=1e-9)
        assert r["toxic"] == (p >= 0.5) or abs(p - 0.5) < 1e-9
        assert r["grade"] == grade or severity == pytest.approx(round(severity * 2) / 2, abs=1e-6)
    # The words of the model: the 512 largest z scores of document counts between the kinds, over every labelled text.
    kind = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    kind = {i: k for i, k in kind.items() if i in texts and k in (0, 1)}
    if max(Counter(kind.values()).values()) <= 3000:
        size = Counter(kind.values())
        seen = {0: Counter(), 1: Counter()}
        for i, k in kind.items():
            seen[k].update(set(plain_features(texts[i])[0]))
        z = {}
        for f in seen[0].keys() | seen[1].keys():
            b, a = seen[0][f], seen[1][f]
            if a + b >= 5:
                z[f] = (a / size[1] - b / size[0]) / ((a + b) / (size[0] + size[1]) * (1 / size[0] + 1 / size[1])) ** 0.5
        best = sorted(z, key=lambda f: (-abs(z[f]), f))[:512]
        want = {f for f in best if abs(z[f]) >= 6}
        last = min((abs(z[f]) for f in best), default=0)
        assert want ^ set(model.words) <= {f for f in z if abs(abs(z[f]) - last) < 1e-9 or abs(abs(z[f]) - 6) < 1e-9}


# ---- mixing -------------------------------------------------------------------------------------------------

def target_truth(sizes):
    """Reshare the excess round by round until no target is above three times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: weight[s] * left / sum(weight[t] for t in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            return {**{s: 3.0 * sizes[s] for s in capped}, **share}
        capped |= above


@pytest.mark.parametrize("seed", range(3))
def test_mixing_targets_and_copies(spark, seed):
    r = random.Random(seed)
    rows = awkward() + [(1000 + k, " ".join(words(r.randrange(0, 80), k)), r.choice(["big"] * 12 + ["a", "é", "zz", None, "", "tiny", "中"]))
                        for k in range(500)]
    docs = frame(spark, rows)
    out = mixing.mixed(docs).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(W.findall(t or ""))
    want = target_truth(sizes)
    assert len(out) == len(rows)
    for q in out:
        size, target = len(W.findall(q["text"] or "")), want[q["source"]]
        assert (q["__size"], q["__total"]) == (size, sizes[q["source"]]) and q["__target"] == pytest.approx(target)
        rate = target / sizes[q["source"]] if sizes[q["source"]] else 0.0
        ident = "" if q["doc_id"] is None else str(q["doc_id"])
        u = int(hashlib.md5(f"{mixing.SEED}:{ident}".encode()).hexdigest()[:13], 16) / 16**13
        assert q["__copies"] == int(rate + 1e-12) + (u < rate - int(rate + 1e-12) - 1e-12) <= 3
    mixture = mixing.mix(docs)
    assert mixture.columns == docs.columns and mixture.count() == sum(q["__copies"] for q in out)
    assert sorted(map(str, mixing.mix(docs).select("doc_id").collect())) == sorted(map(str, mixture.select("doc_id").collect()))


def test_mixing_edges(spark):
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).count() == 0
    nothing = mixing.mixed(frame(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r["__copies"], r["__target"]) for r in nothing] == [(0, 0.0)] * 2
    one = mixing.mixed(frame(spark, [(1, "a b", "s"), (2, "c", "s")])).collect()
    assert [(r["__copies"], r["__target"]) for r in one] == [(1, 3.0)] * 2


# ---- pieces -------------------------------------------------------------------------------------------------

def processor():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_pieces_equal_the_library_and_round_trip(spark):
    sp = processor()
    texts = [t for _, t, _ in awkward()] + ["  two  spaces ", "▁▁ x▁y", "tab\tnl\ncr\r", "\x00\x01", "a" * 3000, "𝔘" * 50, "don't 's"]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(150).collect()]
    docs = frame(spark, [(k, t, "x") for k, t in enumerate(texts)])
    out = pieces.encode(docs)
    assert out.columns[:len(docs.columns)] == docs.columns
    for r in out.collect():
        if r["text"] is None:
            assert r["piece_ids"] is None and r["piece_decoded"] is None
            continue
        assert r["piece_ids"] == sp.encode(r["text"]) and r["piece_count"] == len(r["piece_ids"])
        assert r["piece_decoded"] == sp.decode(r["piece_ids"]) == r["text"].replace("▁", " ")
    assert pieces.encode(spark.createDataFrame([], SCHEMA)).count() == 0
    again = pieces.decode(out.select("doc_id", "piece_ids", "text")).collect()
    assert all(r["piece_decoded"] == (None if r["text"] is None else r["text"].replace("▁", " ")) for r in again)


def test_pieces_random_strings_equal_the_library():
    sp, machine, r = processor(), pieces.Transducer(pieces.load()), random.Random(3)
    vocabulary = [p for p, _, kind in pieces.load().pieces if kind == pieces.NORMAL]
    for _ in range(4000):
        text = "".join(r.choice("abcde  ▁\n\t1é𝔘ñ中<0x41>'s.,AB") if r.random() < 0.5 else r.choice(vocabulary) for _ in range(r.randrange(14)))
        assert machine.encode(text) == sp.encode(text)


def test_unigram_machine_takes_the_heaviest_segmentation():
    made = [("<unk>", 0.0, pieces.UNKNOWN), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.0, 1), ("▁a", -2.2, 1), ("ba", -1.0, 1),
            ("▁ab", -9.0, 1)]
    model = pieces.Model(made, pieces.UNIGRAM)
    machine, score = pieces.Transducer(model), {p: s for p, s, _ in made[1:]}

    def best(text):
        if not text:
            return 0.0, []
        found = [(score[text[:k]] + best(text[k:])[0], [text[:k], *best(text[k:])[1]]) for k in range(1, 4) if text[:k] in score]
        return max(found, key=lambda f: f[0])

    for text in ("ab", "aba", "abba", "baab", "a b ab", "bbb"):
        total = sum(best(p)[0] for p in re.findall("▁[^▁]*", machine.normalise(text)))
        assert sum(made[i][1] for i in machine.encode(text)) == pytest.approx(total)
    assert machine.encode("azza") == [5, 0, 2] and machine.decode(machine.encode("ab a")) == "ab a"
