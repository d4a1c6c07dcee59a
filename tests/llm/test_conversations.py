"""Conversation repair against exhaustive search over edits: tiny chunks, long streaks of deletions, odd rows, the registered query."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

from pyspark.sql import types as T

from runlens.llm import conversations

SF = "/root/testdata/sf0.01"
SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                       T.StructField("text", T.StringType()), T.StructField("conv", T.StringType()), T.StructField("part", T.StringType()),
                       T.StructField("seq", T.StringType()), T.StructField("edit", T.MapType(T.StringType(), T.StringType()))])
PATTERN = re.compile("(s?(ua)+)?")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "p", "s", {"a": "b"}) for r in rows], SCHEMA)


def cheapest(rows):
    """Least (cost, edits) and the repaired rows, by trying every edit at every place; rows: (role, text, class).

    The state is what the roles written so far allow next."""
    names = {"u": "user", "a": "assistant"}
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(maxsize=None)
    def best(i, last, inserted):
        options = []
        if i == len(rows) and last in ("", "a"):
            options.append((0, "", ()))
        if inserted < 2:  # a third insert in one place only repeats the first two
            for r in "ua":
                if r in allowed[last]:
                    c, e, out = best(i, r, inserted + 1)
                    options.append((c + 3, "I" + e, ((names[r], ""), *out)))
        if i < len(rows):
            role, text, kind = rows[i]
            c, e, out = best(i + 1, last, 0)
            options.append((c + 4, "D" + e, out))
            if kind not in ("blank", "duplicate"):
                more = 3 * (kind == "truncated")
                if role[:1] and role[:1] in allowed[last]:
                    c, e, out = best(i + 1, role[0], 0)
                    options.append((c + more, "K" + e, ((role, text), *out)))
                for r in "ua":
                    if r in allowed[last]:
                        c, e, out = best(i + 1, r, 0)
                        options.append((c + more + 3, "R" + e, ((names[r], text), *out)))
        return min(options, default=(10**9, "", ()))

    for i in range(len(rows), 0, -40):  # keeps the recursion shallow
        for last in allowed:
            best(i, last, 0)
    return best(0, "", 0)


def truth(rows):
    """Per conversation: the columns of the query, from damaged rows (conv, turn, role, text)."""
    by: dict = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, found in by.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, classed = set(), []
        for _, role, text in found:
            ink = re.findall(r"[^\x20\x09-\x0D]", text)
            kind = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else ""
            seen.add((role, text))
            classed.append((role, text, kind))
        turns = [t for t, _, _ in found if t is not None]
        cost, audit, left = cheapest(tuple(classed))
        assert PATTERN.fullmatch("".join(r[0] for r, _ in left))
        count = lambda k: sum(c == k for _, _, c in classed)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(classed, classed[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"),
                     count("truncated"), illegal, cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest(), left)
    return out


def got(repair):
    parts = {r["conv"]: [r[c] for c in conversations.COUNTS] for r in repair.summary().collect()}
    for r in repair.digests().collect():
        parts[r["conv"]] += [r["audit"], r["repaired_sha256"]]
    return {c: tuple(v) for c, v in parts.items()}


def test_small_conversations_and_tiny_chunks(spark):
    r = random.Random(4)
    texts = ["Yes.", "No!", "Why?", "cut off", "  ", "", "\t\n", "more.", "and.", "so. ", "é…", "x.\x85"]
    roles = ["user", "assistant", "system", "tool", "", "unknown", None]
    rows = [(c, r.choice([None, 0, 1, 2, 3, 5, 8, -4, 10**6]), r.choice(roles[:3] if r.random() < 0.8 else roles),
             None if r.random() < 0.03 else r.choice(texts) + (str(r.randrange(9)) + "." if r.random() < 0.5 else ""))
            for c in [None, *range(40)] for _ in range(r.randrange(1, 14))]
    rows += [(100, None, "user", "a."), (100, None, "assistant", "b."), (101, -2**63, "user", "a."), (101, 2**63 - 1, "assistant", "b.")]
    want = truth(rows)
    want[101] = (2**63 - 1, *want[101][1:])  # clamped to a long
    for chunk in (1, 3, conversations.CHUNK):
        repair = conversations.Repair(frame(spark, rows), chunk=chunk)
        assert got(repair) == {c: v[:8] for c, v in want.items()}
        found: dict = {}
        for x in sorted(repair.rows().collect(), key=lambda x: x["place"]):
            found.setdefault(x["conv"], []).append((x["role"], x["text"]))
            assert len(found[x["conv"]]) == x["place"] + 1
        assert found == {c: list(v[8]) for c, v in want.items() if v[8]}


def test_one_long_conversation_over_many_partitions(spark):
    """One conversation holds most rows, with streaks of blanks and of copies that cover whole chunks and partitions."""
    r = random.Random(9)
    rows = []
    for t in range(600):
        role = ("user", "assistant")[t % 2] if r.random() < 0.9 else "system"
        text = "" if 100 <= t < 180 else "Same." if 300 <= t < 420 else f"word {r.randrange(200)}" + ("." if r.random() < 0.8 else "")
        rows += [(7, t // 2 if t > 500 else t, role, text)] * r.choice([1, 1, 1, 2])
    rows += [(7, 900, "user", "The same row.")] * 150 + [(c, 1, "user", "Hi.") for c in range(20)]
    want = {c: v[:8] for c, v in truth(rows).items()}
    for chunk in (8, 64):
        assert got(conversations.Repair(frame(spark, rows), chunk=chunk)) == want


def test_empty_table(spark):
    assert got(conversations.Repair(frame(spark, []))) == {}


def test_passes_end_at_the_same_costs():
    r = random.Random(2)
    initials, classes = "".join(r.choice("suax") for _ in range(300)), "".join(r.choice("kkkktbd") for _ in range(300))
    whole = conversations.backward(initials, classes, conversations.END)
    used, added = list(conversations.END), 0
    for lo in range(290, -1, -10):
        used, more = conversations.level(conversations.backward(initials[lo:lo + 10], classes[lo:lo + 10], used)[0])
        added += more
        assert [c + added for c in used] == list(whole[lo])


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [row] * (2 if kind == 3 else 1)
    return out


def test_registered_query_against_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = truth(damage(rows))
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    found = {r["conv_id"]: tuple(r[c] for c in [*conversations.COUNTS, "audit", "repaired_sha256"])
             for r in conversations.op13_conversation_repair(spark, SF).collect()}
    assert found == {c: want.get(c, none)[:8] for c in {r[0] for r in rows}}
    assert len({r["audit"] for r in conversations.op13_conversation_repair(spark, SF).collect()}) > 10


def test_damage_on_null_rows(spark):
    rows = [(c, t, r, x) for c in (None, 1, 2) for t in (None, *range(25)) for r, x in ((None, "A. b"), ("user", None))]
    got_rows = [tuple(r) for r in conversations.damaged(frame(spark, rows)).select("conv_id", "turn", "role", "text").collect()]
    assert sorted(got_rows, key=str) == sorted(damage(rows), key=str)
