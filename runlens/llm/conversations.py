"""Conversation structure repair: cheapest edits that make the roles (s?(ua)+)?, by rank-convergence parallel Viterbi.

Rows of a conversation are taken by turn (nulls first), then role, then text. A row's first fault counts: blank (no character but
the six ASCII white-space ones), duplicate (same role and text earlier in the conversation), truncated (last such character is none
of .!?). Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (required for blank and duplicate rows), Insert an empty user or
assistant row anywhere 3; a truncated row that stays adds 3. Roles count by their first character. Of the cheapest edit strings
(initials D, I, K, R) the least in ASCII order is taken; it determines the result.

The grammar has four states: nothing yet, after s, after u, after a. Costs to the end, one number per state, run backwards:

1. Rows are sorted over the whole cluster by conversation and order (range partitions, so one conversation may cover many)
   and cut into chunks of at most `chunk` rows and 256 KB. Duplicates inside a partition are marked while reading; only
   conversations that cover several partitions compare the first rows of each text across them.
2. Every chunk runs backwards on its own: the last chunk of a conversation from the true end, the others from a speculative vector.
3. Fix-up passes: a chunk whose right neighbour's vector differs from the one it used by more than a constant runs again from
   that vector; constants are only added up. The passes end when nothing differs. Most chunks forget their start within a few
   rows; a chunk does not where rows only can be deleted, so passes are one more than the longest streak of such chunks.
4. The stitched costs tell, for each state in front of a chunk, the least cheapest edits and the state behind it. These maps are
   composed by doubling over the chunks of a conversation, and every chunk writes its edits from its true state.

Per conversation, only rows of one per chunk meet in a task (neighbours by a window); its digest reads the repaired rows as a stream.

Defined cases: a null role or text counts as one space; a null conversation id is a conversation of its own; null turns come
first and are ignored by `gaps`; repeated rows are duplicates; a role other than s.., u.. or a.. fits nowhere and is reroled
or deleted; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runlens.llm.common import mapped, stored, table

CHUNK = 4096
CHUNK_BYTES = 1 << 18
SEEN = re.compile(r"[^\x20\x09-\x0D]")
#: Costs of what is still to be inserted at the end of a conversation, by state.
END = (0, 6, 3, 0)
SPECULATIVE = (0, 0, 0, 0)
#: State behind a kept row, by state and initial; state behind a reroled or inserted row.
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT = (2, 2, 3, 2)
NAME = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}


def backward(initials: str, classes: str, right) -> list:
    """Costs to the end in front of every row, and `right` behind the last one."""
    out = [tuple(right)]
    for initial, kind in zip(reversed(initials), reversed(classes)):
        after = out[-1]
        x = [4 + c for c in after]
        if kind not in "bd":
            extra = 3 if kind == "t" else 0
            for state in range(4):
                to = KEEP[state].get(initial)
                kept = extra + after[to] if to is not None else x[state]
                x[state] = min(x[state], kept, 3 + extra + after[NEXT[state]])
        u, a = min(x[2], 3 + x[3]), min(x[3], 3 + x[2])
        out.append((min(x[0], 3 + u), min(x[1], 3 + u), u, a))
    out.reverse()
    return out


def trace(initials: str, classes: str, costs: list, state: int, last: bool) -> tuple:
    """The least of the cheapest edits from `state` on, and the state behind them."""
    edits, i, n = [], 0, len(initials)
    while i < n:
        left, after, kind = costs[i][state], costs[i + 1], classes[i]
        extra = 3 if kind == "t" else 0
        if 4 + after[state] == left:
            edits.append("D")
            i += 1
        elif 3 + costs[i][NEXT[state]] == left:
            edits.append("I")
            state = NEXT[state]
        else:
            to = KEEP[state].get(initials[i])
            kept = to is not None and extra + after[to] == left
            edits.append("K" if kept else "R")
            state = to if kept else NEXT[state]
            i += 1
    while last and state in (1, 2):
        edits.append("I")
        state = NEXT[state]
    return "".join(edits), state


def applied(edits: str, roles, texts, state: int) -> list:
    """(role, text, edit) of the rows that the edits leave."""
    out, rows = [], iter(zip(roles, texts))
    for edit in edits:
        if edit == "I":
            state = NEXT[state]
            out.append((NAME[state], "", edit))
            continue
        role, text = next(rows)
        if edit == "K":
            state = KEEP[state][role[0]]
            out.append((role, text, edit))
        elif edit == "R":
            state = NEXT[state]
            out.append((NAME[state], text, edit))
    return out


def level(vector) -> tuple:
    """The vector less its smallest entry, and that entry."""
    low = min(vector)
    return [c - low for c in vector], low


def row_class(text: str) -> str:
    seen = SEEN.findall(text[-64:]) or SEEN.findall(text)
    return "b" if not seen else "k" if seen[-1] in ".!?" else "t"


def initial(role: str) -> str:
    return role[0] if role[:1] in ("s", "u", "a") else "x"


PARTS = [("part", pa.int32()), ("seq", pa.int64()), ("conv", None), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
         ("initials", pa.string()), ("classes", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()),
         ("firsts", pa.list_(pa.struct([("at", pa.int32()), ("print", pa.binary())])))]


def _batch(rows: list, fields: list, conv_type) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), conv_type if t is None else t) for c, (_, t) in zip(columns, fields)],
                                      [name for name, _ in fields])


class Sink:
    """Rows collected into batches of bounded rows and text."""

    def __init__(self, fields: list, conv_type, rows: int = 512, text: int = 4 << 20):
        self.fields, self.conv_type, self.most, self.text, self.rows, self.size = fields, conv_type, rows, text, [], 0

    def put(self, row: tuple, size: int = 0):
        """The batch that this row fills, if it does."""
        self.rows.append(row)
        self.size += size
        if len(self.rows) >= self.most or self.size >= self.text:
            yield from self.rest()

    def rest(self):
        if self.rows:
            yield _batch(self.rows, self.fields, self.conv_type)
        self.rows, self.size = [], 0


def chunks(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Stored chunks of the sorted rows (conv, turn, role, text): number (part, seq), rows, their faults as far as the partition
    tells, and the first rows of each text in the partition."""
    kind = rows.schema["conv"].dataType.simpleString()
    ddl = (f"part int, seq long, conv {kind}, roles array<string>, texts array<string>, initials string, classes string, "
           "first_turn long, last_turn long, turns long, firsts array<struct<at: int, print: binary>>")
    # The last key only parts rows that are equal in everything, so that many of them need not stay together.
    order = ["conv", "turn", "role", "text", "nth"]
    ordered = rows.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        part = TaskContext.get().partitionId()
        seq, held, known, conv, size, sink = 0, [], set(), None, 0, None

        def out():
            classes, firsts = [], []
            for at, (_, role, text) in enumerate(held):
                mark = row_class(text)
                if mark != "b":
                    code = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
                    if code in known:
                        mark = "d"
                    else:
                        known.add(code)
                        firsts.append({"at": at, "print": code})
                classes.append(mark)
            turns = [t for t, _, _ in held if t is not None]
            row = (part, seq, conv, [r for _, r, _ in held], [t for _, _, t in held], "".join(initial(r) for _, r, _ in held),
                   "".join(classes), turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)), firsts)
            return sink.put(row, size)

        for batch in batches:
            sink = sink or Sink(PARTS, batch.column(0).type)
            for now, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (now != conv or len(held) >= chunk or size >= CHUNK_BYTES):
                    yield from out()
                    seq, held, size = seq + 1, [], 0
                if now != conv:
                    known = set()
                conv = now
                held.append((turn, role, text))
                size += len(role) + len(text)
        if held:
            yield from out()
            yield from sink.rest()

    return stored(mapped(ordered.select("conv", "turn", "role", "text"), run, ddl), "conversation-chunks")


def late_duplicates(cut: DataFrame) -> DataFrame:
    """(part, seq, late): rows that are first of their text in their partition but not in their conversation."""
    spanning = cut.groupBy("conv").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    # At most one conversation per border of two partitions covers both.
    wide = cut.select("part", "seq", "conv", "firsts").join(
        F.broadcast(spanning.select(F.col("conv").alias("wide"))), F.col("conv").eqNullSafe(F.col("wide")), "left_semi")
    firsts = wide.select("part", "seq", "conv", F.explode("firsts").alias("f")).select("part", "seq", "conv", "f.at", "f.print")
    first = F.min("part").over(W.partitionBy("conv", "print"))
    return firsts.withColumn("first", first).where("part > first").groupBy("part", "seq").agg(
        F.collect_list("at").alias("late"))


def classified(cut: DataFrame) -> DataFrame:
    """Stored narrow form of the chunks, all duplicates marked, with their place among the chunks of the conversation."""
    marked = F.when(F.col("late").isNull(), F.col("classes")).otherwise(F.concat_ws("", F.transform(
        F.split("classes", ""), lambda c, i: F.when(F.array_contains("late", i), F.lit("d")).otherwise(c))))
    narrow = cut.select("part", "seq", "conv", "initials", "classes", "first_turn", "last_turn", "turns")
    codes = stored(narrow.join(late_duplicates(cut), ["part", "seq"], "left").withColumn("classes", marked).drop("late"),
                   "conversation-codes")
    by = W.partitionBy("conv").orderBy("part", "seq")
    ends = codes.select("part", "seq", "conv", F.substring("initials", 1, 1).alias("first"),
                        F.expr("right(initials, 1)").alias("last"), "first_turn", "last_turn")
    placed = ends.select(
        "part", "seq", F.row_number().over(by).alias("nth"), F.first("part").over(by).alias("hp"),
        F.first("seq").over(by).alias("hs"), F.lead("part").over(by).alias("np"), F.lead("seq").over(by).alias("ns"),
        F.concat(F.lag("last").over(by), F.col("first")).alias("border"),
        (F.lag("last_turn").over(by) == F.col("first_turn")).alias("same_turn"))
    return stored(codes.join(placed, ["part", "seq"]), "conversation-links")


VECTORS = "part int, seq long, used array<long>, ahead array<long>, added long"


def run_back(work: DataFrame) -> DataFrame:
    """From (part, seq, initials, classes, used): the vector in front of each chunk, levelled, and what was subtracted."""
    fields = [("part", pa.int32()), ("seq", pa.int64()), ("used", pa.list_(pa.int64())), ("ahead", pa.list_(pa.int64())),
              ("added", pa.int64())]

    def run(batches):
        for batch in batches:
            rows = [(part, seq, used, *level(backward(initials, classes, used)[0]))
                    for part, seq, initials, classes, used in zip(*(c.to_pylist() for c in batch.columns))]
            yield _batch(rows, fields, None)

    return mapped(work.select("part", "seq", "initials", "classes", "used"), run, VECTORS)


def vectors(links: DataFrame) -> DataFrame:
    """Speculative pass and fix-up passes: per chunk the vector used behind it, the one in front of it, and its costs."""
    here = ["part", "seq"]
    start = F.when(F.col("np").isNull(), F.lit(list(END))).otherwise(F.lit(list(SPECULATIVE))).cast("array<long>")
    now = stored(run_back(links.withColumn("used", start)), "conversation-vectors")
    while True:
        behind = now.select(F.col("part").alias("np"), F.col("seq").alias("ns"), F.col("ahead").alias("need"))
        due = links.where(F.col("np").isNotNull()).select(*here, "np", "ns").join(behind, ["np", "ns"]) \
            .join(now.select(*here, F.col("used").alias("old")), here).where("need <> old").select(*here, F.col("need").alias("used"))
        due = stored(due, "conversation-fixes")
        if due.isEmpty():
            return now
        again = run_back(links.select(*here, "initials", "classes").join(due, here))
        now = stored(now.join(due.select(*here), here, "left_anti").unionByName(again), "conversation-vectors")


def entries(links: DataFrame, costs: DataFrame) -> DataFrame:
    """(part, seq, entry): the state in front of every chunk, by composing the chunks' state maps with doubling steps."""
    several = links.where("np is not null or nth > 1")
    fields = [("hp", pa.int32()), ("hs", pa.int64()), ("nth", pa.int32()), ("to", pa.list_(pa.int32()))]

    def run(batches):
        for batch in batches:
            rows = []
            for hp, hs, nth, initials, classes, used in zip(*(c.to_pylist() for c in batch.columns)):
                back = backward(initials, classes, used)
                rows.append((hp, hs, nth, [trace(initials, classes, back, s, False)[1] for s in range(4)]))
            yield _batch(rows, fields, None)

    work = several.join(costs.select("part", "seq", "used"), ["part", "seq"]).select("hp", "hs", "nth", "initials", "classes", "used")
    # to[s]: state behind the chunk when the state `reach` chunks before its end was s; the first chunk starts in state 0.
    maps = stored(mapped(work, run, "hp int, hs long, nth int, to array<int>"), "conversation-maps")
    longest, reach = maps.agg(F.max("nth")).first()[0] or 1, 1
    while reach < longest:
        before = maps.select("hp", "hs", (F.col("nth") + reach).alias("nth"), F.col("to").alias("from"))
        chained = F.when(F.col("from").isNull(), F.col("to")).otherwise(F.transform("from", lambda s: F.get("to", s)))
        maps = stored(maps.join(before, ["hp", "hs", "nth"], "left").select("hp", "hs", "nth", chained.alias("to")),
                      "conversation-maps")
        reach *= 2
    behind = maps.select("hp", "hs", (F.col("nth") + 1).alias("nth"), F.get("to", F.lit(0)).alias("entry"))
    return links.select("part", "seq", "hp", "hs", "nth").join(behind, ["hp", "hs", "nth"], "left").select(
        "part", "seq", F.coalesce("entry", F.lit(0)).alias("entry"))


def worked(batch):
    """(chunk as a dictionary, edits, repaired rows) of every row of a batch of chunks."""
    for k in range(batch.num_rows):
        c = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
        edits, _ = trace(c["initials"], c["classes"], backward(c["initials"], c["classes"], c["used"]), c["entry"], c["last"])
        yield c, edits, applied(edits, c["roles"], c["texts"], c["entry"])


def sequences(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), blank(role_col).alias("role"),
                       blank(text_col).alias("text"))


class Repair:
    """The solved chunks of a table: `summary` per conversation, `digests`, and the repaired `rows`."""

    def __init__(self, rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", chunk: int = CHUNK):
        self.chunks = chunks(sequences(rows, conv_col, turn_col, role_col, text_col), chunk)
        self.links = classified(self.chunks)
        self.costs = vectors(self.links)
        plan = self.links.join(self.costs.select("part", "seq", "used"), ["part", "seq"]) \
            .join(entries(self.links, self.costs), ["part", "seq"])
        self.plan = stored(plan.select("part", "seq", "initials", "classes", "used", "entry", F.col("np").isNull().alias("last"), "nth"),
                           "conversation-plan")

    def solved(self, run, ddl: str) -> DataFrame:
        """`run` over (part, seq, conv, roles, texts, initials, classes, used, entry, last, nth) of every chunk."""
        own = self.chunks.select("part", "seq", "conv", "roles", "texts").join(self.plan, ["part", "seq"])
        return mapped(own, run, ddl)

    def rows(self) -> DataFrame:
        """Repaired rows: conv, place (from 0), role, text, edit (K, R or I)."""
        kind = self.chunks.schema["conv"].dataType.simpleString()
        fields = [("conv", None), ("nth", pa.int32()), ("at", pa.int64()), ("role", pa.string()), ("text", pa.string()),
                  ("edit", pa.string())]

        def run(batches):
            for batch in batches:
                sink = Sink(fields, batch.schema.field("conv").type, 1 << 16)
                for c, _, left in worked(batch):
                    for at, row in enumerate(left):
                        yield from sink.put((c["conv"], c["nth"], at, *row), len(row[1]))
                yield from sink.rest()

        found = self.solved(run, f"conv {kind}, nth int, at long, role string, text string, edit string")
        # Places: rows of earlier chunks (one number per chunk), then the row's own.
        sizes = found.groupBy("conv", "nth").agg(F.count(F.lit(1)).alias("size"))
        before = F.sum("size").over(W.partitionBy("conv").orderBy("nth").rowsBetween(W.unboundedPreceding, -1))
        offsets = sizes.select(F.col("conv").alias("c"), F.col("nth").alias("m"), F.coalesce(before, F.lit(0)).alias("offset"))
        return found.join(offsets, F.col("conv").eqNullSafe(F.col("c")) & (F.col("nth") == F.col("m"))).select(
            "conv", (F.col("offset") + F.col("at")).alias("place"), "role", "text", "edit")

    def digests(self) -> DataFrame:
        """(conv, audit, repaired_sha256): edits of each conversation and the hash of its repaired `role:text` lines."""
        kind = self.chunks.schema["conv"].dataType.simpleString()
        fields = [("conv", None), ("part", pa.int32()), ("seq", pa.int64()), ("audit", pa.string()), ("lines", pa.string())]

        def run(batches):
            for batch in batches:
                sink = Sink(fields, batch.schema.field("conv").type)
                for c, edits, left in worked(batch):
                    lines = "\n".join(f"{r}:{t}" for r, t, _ in left) if left else None
                    yield from sink.put((c["conv"], c["part"], c["seq"], edits, lines), len(lines or ""))
                yield from sink.rest()

        def join(batches):
            audit, digest, conv, any_, sink, started = [], hashlib.sha256(), None, False, None, False
            out = [("conv", None), ("audit", pa.string()), ("repaired_sha256", pa.string())]
            for batch in batches:
                sink = sink or Sink(out, batch.column(0).type)
                for now, _, _, edits, lines in zip(*(c.to_pylist() for c in batch.columns)):
                    if started and now != conv:
                        yield from sink.put((conv, "".join(audit), digest.hexdigest()), len(audit))
                        audit, digest, any_ = [], hashlib.sha256(), False
                    conv, started = now, True
                    audit.append(edits)
                    if lines is not None:
                        digest.update(("\n" if any_ else "").encode() + lines.encode())
                        any_ = True
            if started:
                yield from sink.put((conv, "".join(audit), digest.hexdigest()))
                yield from sink.rest()

        pieces = self.solved(run, f"conv {kind}, part int, seq long, audit string, lines string")
        ordered = pieces.repartition("conv").sortWithinPartitions("conv", "part", "seq")
        return mapped(ordered, join, f"conv {kind}, audit string, repaired_sha256 string")

    def summary(self) -> DataFrame:
        """Per conversation: gaps, blank, duplicate, truncated, illegal, cost."""
        wide = "decimal(38,0)"
        count = lambda c: F.sum(F.regexp_count("classes", F.lit(c))).cast("long")
        # Pairs of neighbours inside a chunk, and the one across its front border.
        inner = F.expr("size(filter(sequence(1, greatest(length(initials) - 1, 1)), i -> i < length(initials) "
                       "and substring(initials, i, 2) not in ('su', 'ua', 'au')))")
        border = F.coalesce((~F.col("border").isin(*sorted(LEGAL))).cast("int"), F.lit(0))
        rows = self.links.join(self.costs.select("part", "seq", "ahead", "added"), ["part", "seq"])
        distinct = F.sum(F.col("turns") - F.coalesce(F.col("same_turn").cast("int"), F.lit(0)))
        span = (F.max("last_turn").cast(wide) - F.min("first_turn").cast(wide) + 1 - distinct.cast(wide))
        longest = F.lit((1 << 63) - 1).cast(wide)
        return rows.groupBy("conv").agg(
            F.least(F.coalesce(span, F.lit(0).cast(wide)), longest).cast("long").alias("gaps"), count("b").alias("blank"),
            count("d").alias("duplicate"), count("t").alias("truncated"), F.sum(inner + border).cast("long").alias("illegal"),
            (F.sum("added") + F.max(F.when(F.col("nth") == 1, F.get("ahead", F.lit(0))))).alias("cost"))


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of the contract: dropped, emptied, stripped of stops, repeated or given to the user by a hash of `conv_id:turn`."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
            .where("kind <> 0")
            .select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                    text.alias("text"), F.explode(F.expr("if(kind = 3, array(1, 2), array(1))")).alias("copy")).drop("copy"))


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def op13_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repair = Repair(damaged(rows))
    parts = rows.select(F.col("conv_id").alias("conv")).distinct() \
        .unionByName(repair.summary(), allowMissingColumns=True).unionByName(repair.digests(), allowMissingColumns=True)
    return parts.groupBy("conv").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in COUNTS], F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")) \
        .withColumnRenamed("conv", "conv_id")


QUERIES = {"op13_conversation_repair": (op13_conversation_repair, None)}
