"""MinHash near-deduplication with sequential Bayesian verification.

Texts are sets of five-word shingles; two are linked when 100 * intersection >= 75 * union. Steps:

1. *Sketch* (one pass over the texts): shingle hashes, a set fingerprint, and a fast similarity sketch of 722 bins. 210 bins make
   42 bands of 5 rows: a pair at similarity 0.75 shares no band with probability (1 - 0.75^5)^42 = 1.1e-5, one at 0.8
   with 5.6e-8. The other 512 bins, one byte each, are the signature.
2. *Classes*: texts with equal sets are one node, the smallest id. A group of copies is one node however large it is.
3. *Stars*: per band bucket a random hub is compared with every other member, so a bucket makes one pair less than it has rows.
   Signatures are compared in batches of 32 bytes; after each batch a pair goes on only while the posterior probability of
   similarity >= 0.75, given matches so far and a uniform prior, is at least `miss` (1e-6). Survivors are verified
   exactly on both full texts.
4. *Rest*: a bucket is done when its members form one component, as for most groups of near copies. In the others the pairs
   of different components that no star has compared go through the same Bayesian batches inside the task that holds the
   bucket, survivors through a comparison of their full sets of shingle hashes right there, each in the first band its
   pair shares. Only links leave the task, and are verified on both full texts as above. A bucket is cut into tiles, so
   that no task holds more than two tiles of it, however large it is.
5. *Components* of the verified links by alternating star steps over stored edge tables.

No partner is dropped by a cap: the only losses are the two probabilities above. Small id tables are broadcast after their
rows were counted, and joined by shuffling beyond the bound. Intermediate tables are written to the shared folder.

Defined cases: texts without words or null texts have size 0 and are linked with nothing; with fewer than five words the whole
sequence is the only shingle; rows repeated with one id and text get the same result and are all kept or all dropped; of
rows that share an id but not the text each has the result of its own text (two that both stand for a group count as
linked); rows with a null id are linked with nothing and kept; an empty table gives an empty result; ties go to
the smaller id; other columns are not read (`deduplicate` passes them through).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import if_small, mapped, slices, stored, table
from runlens.llm.components import components

WORDS = 5
BANDS, ROWS = 42, 5
SIGNATURE, BATCH = 512, 32
BINS = BANDS * ROWS + SIGNATURE
PART = 75  # per cent
MISS = 1e-6
#: Members of a bucket, and their shingles, that one task compares with another tile of it; both only bound memory.
TILE, TILE_SHINGLES = 256, 1 << 20
SKETCH = "id long, n_shingles long, fp1 long, fp2 long, bands array<long>, signature binary"


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def shingle_hashes(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    from xxhash import xxh3_64_intdigest

    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([xxh3_64_intdigest(w) for w in words], np.uint64)
    if len(h) < WORDS:
        acc = np.array([len(h)], np.uint64)
        for x in h:
            acc = mix(acc) + x
        return mix(acc)
    n = len(h) - WORDS + 1
    acc = np.full(n, WORDS, np.uint64)
    for k in range(WORDS):
        acc = mix(acc) + h[k:k + n]
    return np.unique(mix(acc))


def shingle_set(text: bytes) -> set[tuple]:
    """The shingles themselves, for exact verification."""
    words = words_of(text)
    if len(words) < WORDS:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(WORDS))))


def linked(a: set, b: set) -> bool:
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= PART * (len(a) + len(b) - both)


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """Fast similarity sketches, one row of `bins` numbers per set: in round i < bins every element falls into a random bin
    with value (i, random); rounds from `bins` on fill bin i - bins from every element. A bin keeps its least value, which two
    sets share with a probability equal to their similarity. Sets leave the loop when their bins are full."""
    out = np.full((len(sets), bins), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    live = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    for i in range(2 * bins):
        if not len(live):
            break
        if i in (0, 2, 4, 8, 16, 32, 64, 128, 256, 512) or i >= bins or not i % 64:
            live = live[(out[live] == np.iinfo(np.uint64).max).any(axis=1)]
            if not len(live):
                break
            elements = np.concatenate([sets[k] for k in live])
            owner = np.repeat(live, [len(sets[k]) for k in live]) * bins
        x = mix(elements + np.uint64((0x9E3779B97F4A7C15 * (i + 1)) & 0xFFFFFFFFFFFFFFFF))
        value = (x & np.uint64(0xFFFFFFFF)) | np.uint64(i << 32)
        where = owner + ((((x >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64) if i < bins else i - bins)
        open_ = flat[where] > value
        np.minimum.at(flat, where[open_], value[open_])
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    rows = sketch[:, :BANDS * ROWS].reshape(len(sketch), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(ROWS):
        keys = mix(keys) + rows[:, :, k]
    return mix(keys).view(np.int64)


def least_matches(miss: float = MISS, part: int = PART, length: int = SIGNATURE, batch: int = BATCH) -> list[int]:
    """Per batch end n the fewest matches with which a pair goes on: P(similarity >= part % | m of n match) >= miss.

    A byte matches with probability p = s + (1 - s) / 256. Under a uniform prior the posterior of p is Beta(m + 1, n - m + 1), and
    P(p >= x) is the probability of at most m successes in n + 1 trials of chance x."""
    x = part / 100 + (1 - part / 100) / 256
    out = []
    for n in range(batch, length + 1, batch):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m)
                              + m * math.log(x) + (n + 1 - m) * math.log1p(-x))
        out.append(m)
    return out


def survivors(left: np.ndarray, right: np.ndarray, bounds: list[int]) -> np.ndarray:
    """Indices of the row pairs (left[i], right[i]) that no batch prunes."""
    at = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    for k, least in enumerate(bounds):
        cut = slice(k * BATCH, (k + 1) * BATCH)
        matches[at] += (left[at, cut] == right[at, cut]).sum(axis=1)
        at = at[matches[at] >= least]
    return at


def sketch(docs: DataFrame, sets: bool = False) -> DataFrame:
    """(id, n_shingles, fp1, fp2, bands, signature) of (id, text), with `sets` also the sorted shingle hashes."""
    import pyarrow as pa

    def run(batches):
        from xxhash import xxh3_128_intdigest

        for batch in batches:
            for part in slices(batch):
                hashes = [shingle_hashes(t or b"") for t in part.column(1).cast(pa.binary()).to_pylist()]
                prints = [xxh3_128_intdigest(s.tobytes()) for s in hashes]
                made = sketches(hashes)
                signed = lambda shift: np.array([(p >> shift) & 0xFFFFFFFFFFFFFFFF for p in prints], np.uint64).view(np.int64)
                keys, bytes_ = band_keys(made), made[:, BANDS * ROWS:].astype(np.uint8)
                full = [len(s) > 0 for s in hashes]
                more = [pa.array([s.tobytes() for s in hashes], pa.binary())] if sets else []
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in hashes], pa.int64()), pa.array(signed(64)), pa.array(signed(0)),
                     pa.array([k if f else None for k, f in zip(keys, full)], pa.list_(pa.int64())),
                     pa.array([b.tobytes() if f else None for b, f in zip(bytes_, full)], pa.binary()), *more],
                    names=["id", "n_shingles", "fp1", "fp2", "bands", "signature", *["shingles"] * sets])

    return mapped(docs, run, SKETCH + ", shingles binary" * sets)


def prune(pairs: DataFrame) -> DataFrame:
    """(a, b) of the rows (a, b, sa, sb) whose signatures no batch prunes."""
    import pyarrow as pa

    bounds = least_matches()

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SIGNATURE) for i in (2, 3)]
            keep = pa.array(survivors(*sides, bounds))
            yield pa.RecordBatch.from_arrays([batch.column(i).take(keep) for i in (0, 1)], names=["a", "b"])

    return mapped(pairs.select("a", "b", "sa", "sb"), run, "a long, b long")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. Rows arrive sorted by `a`, whose set is kept."""
    import pyarrow as pa

    def run(batches):
        held, mine = None, set()
        for batch in batches:
            keep = []
            for i, (a, ta, tb) in enumerate(zip(*(batch.column(k).cast(t).to_pylist() for k, t in
                                                  ((0, pa.int64()), (2, pa.binary()), (3, pa.binary()))))):
                if held != (a, ta):
                    held, mine = (a, ta), shingle_set(ta)
                if linked(mine, shingle_set(tb)):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(i).take(at) for i in (0, 1)], names=["u", "v"])

    side = lambda name: texts.select(F.col("id").alias(name), F.col("text").alias(f"t{name}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb")
    return mapped(both, run, "u long, v long")


def compare_rest(rows: DataFrame) -> DataFrame:
    """Untested pairs (a, b) of different components inside each (bucket, tile, other tile) that survive the batches and whose
    full sets of shingle hashes are similar enough; nothing else leaves the task.

    rows: bucket, i, j, side, id, component, is_hub, band, bands, signature, shingles; side 0 is compared with side 1, and
    with itself where i = j. Rows of one group follow each other."""
    import pyarrow as pa

    bounds = least_matches()
    columns = ["bucket", "i", "j", "side", "id", "component", "is_hub", "band", "bands", "signature", "shingles"]

    def similar(mine, sets):
        """Which of `sets` (sorted hashes) reach the threshold with `mine`."""
        sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
        both = np.add.reduceat((mine[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        return 100 * both >= PART * (len(mine) + sizes - both)

    def links_of(group):
        ids, comp = (np.array([r[k] for r in group], np.int64) for k in (4, 5))
        hub, side = np.array([r[6] for r in group], bool), np.array([r[3] for r in group])
        sig = np.frombuffer(b"".join(r[9] for r in group), np.uint8).reshape(-1, SIGNATURE)
        keys = np.array([r[8] for r in group], np.int64)
        sets = [np.frombuffer(r[10], np.uint64) for r in group]
        band, same = group[0][7], group[0][1] == group[0][2]
        for x in range(len(ids)):
            if hub[x] or not same and side[x]:
                continue
            others = np.arange(x + 1, len(ids)) if same else np.flatnonzero(side == 1)
            others = others[(comp[others] != comp[x]) & ~hub[others]]
            if len(others):
                others = others[survivors(np.broadcast_to(sig[x], (len(others), SIGNATURE)), sig[others], bounds)]
            others = others[~(keys[others, :band] == keys[x, :band]).any(axis=1)]  # an earlier band has this pair
            if len(others):
                for y in others[similar(sets[x], [sets[y] for y in others])]:
                    yield min(int(ids[x]), int(ids[y])), max(int(ids[x]), int(ids[y]))

    def flush(group):
        found = list(links_of(group))
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches):
        group, key = [], None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(len(columns)))):
                if row[:3] != key:
                    if group:
                        yield flush(group)
                    group, key = [], row[:3]
                group.append(row)
        if group:
            yield flush(group)

    placed = rows.select(columns).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side", "id")
    return mapped(placed, run, "a long, b long")


def rest(members: DataFrame, labels: DataFrame, sizes: DataFrame, texts: DataFrame, tile: int = TILE,
         tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """Links among the pairs that the stars left open. members: bucket, band, id, is_hub, n; labels: node, component;
    sizes: id, n_shingles; texts: id, text."""
    named = (members.where("n > 2").join(if_small(labels), F.col("id") == F.col("node"), "left")
             .withColumn("component", F.coalesce("component", "id")).drop("node"))
    mixed = named.groupBy("bucket").agg(
        F.min("component").alias("least"), F.max("component").alias("most"),
        F.max(F.when(F.col("is_hub"), F.col("component"))).alias("main")).where("least < most")
    rows = stored(named.join(mixed.select("bucket", "main"), "bucket").join(if_small(sizes), "id"), "rest", members.count())
    # The hub's component against all others, and these among themselves. Members of the main component need no comparison
    # among themselves, so the copies of a row grow with the others' tiles, not with the bucket.
    rows = rows.withColumn("other", (F.col("component") != F.col("main")).cast("int"))
    tiles = lambda side: F.greatest(
        F.ceil(F.sum(side) / tile), F.ceil(F.sum(side * F.col("n_shingles")) / tile_shingles), F.lit(1)).cast("int")
    counts = rows.groupBy("bucket").agg(tiles(F.col("other")).alias("g_other"), tiles(1 - F.col("other")).alias("g_main"))
    ids = stored(rows.select("id").distinct(), "rest-ids", sizes.count())
    full = stored(sketch(texts.join(if_small(ids), "id", "left_semi"), sets=True)
                  .select("id", "bands", "signature", "shingles"), "rest-sets", ids.count(), 1 << 13)
    rows = rows.join(counts, "bucket")
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("other") == 1, F.col("g_other")).otherwise(F.col("g_main"))).cast("int")
    rows = rows.withColumn("own", mine)
    place = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    own = F.col("own")
    # Groups (-1 - main tile, other tile) compare main with others; groups (i, j), i <= j compare other tiles.
    main_side = F.transform(F.sequence(F.lit(0), F.col("g_other") - 1), lambda j: place(-1 - own, j, 0))
    to_main = F.transform(F.sequence(F.lit(0), F.col("g_main") - 1), lambda i: place(-1 - i, own, 1))
    among = F.transform(F.sequence(F.lit(0), F.col("g_other") - 1), lambda k: F.when(
        own <= k, place(own, k, 0)).otherwise(place(k, own, 1)))
    copies = F.when(F.col("other") == 0, main_side).otherwise(F.concat(to_main, among))
    rows = rows.withColumn("at", F.explode(copies)).select("bucket", "band", "id", "component", "is_hub", "at.*")
    return compare_rest(rows.join(full, "id"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = stored(sketch(texts), "sketches")
    group = ["fp1", "fp2", "n_shingles"]
    named = made.where("n_shingles > 0 and id is not null")
    classes = named.groupBy(group).agg(F.min("id").alias("rep"))
    reps = named.select("id", "bands", *group).join(classes.withColumnRenamed("rep", "id"), [*group, "id"], "left_semi")
    banded = reps.select("id", F.posexplode("bands").alias("band", "bucket"))
    rank = F.xxhash64("bucket", "id")
    buckets = stored(banded.groupBy("bucket").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1"),
                     "buckets")
    members = stored(banded.join(if_small(buckets), "bucket")
                     .select("bucket", "band", "id", "n", (rank == F.col("best")).alias("is_hub")), "members")
    # What the pairs need: sketches and texts of the nodes that share a bucket with another one.
    ids = stored(members.select("id").distinct(), "ids", members.count())
    n_ids = ids.count()
    chosen = if_small(ids)
    nodes = stored(made.join(chosen, "id", "left_semi").join(classes.withColumnRenamed("rep", "id"), [*group, "id"], "left_semi")
                   .select("id", "n_shingles", "bands", "signature").dropDuplicates(["id", "bands"]), "nodes", n_ids, 1 << 15)
    needed = stored(texts.where("text is not null").join(chosen, "id", "left_semi")
                    .withColumn("h", F.xxhash64("text")).dropDuplicates(["id", "h"]).drop("h"), "texts", n_ids, 1 << 13)
    hubs = members.where("is_hub").select("bucket", F.col("id").alias("a"))
    stars = members.where("not is_hub").select("bucket", F.col("id").alias("b")).join(if_small(hubs), "bucket")
    stars = stars.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda name: nodes.select(F.col("id").alias(name), F.col("signature").alias(f"s{name}"))
    near = prune(stars.join(side("b"), "b").join(side("a"), "a")).distinct()
    n_pairs = members.where("not is_hub").count()
    links = stored(verify(near, needed), "links", n_pairs)
    labels = components(links)
    sizes = stored(nodes.groupBy("id").agg(F.max("n_shingles").alias("n_shingles")), "sizes", n_ids)
    more = stored(verify(rest(members, labels, sizes, needed).distinct(), needed), "links", n_pairs)
    labels = components(links.unionByName(more)) if more.head(1) else labels
    # A node's component, then each document's through its class.
    final = classes.join(if_small(labels), F.col("rep") == F.col("node"), "left").select(
        *group, F.coalesce("component", "rep").alias("root"))
    return (made.select("id", *group).join(final, group, "left")
            .select(F.col("id").alias(id_col), "n_shingles",
                    F.when(F.col("n_shingles") > 0, F.coalesce("root", "id")).otherwise(F.col("id")).alias("component_id"))
            .withColumn("component_id", F.when(F.col(id_col).isNotNull(), F.col("component_id")))
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay: those with the smallest id of their component. Of an id with several texts each has its own
    place: such a table is grouped by a hash of id and text, so that no text goes, or links others, for another one's sake."""
    ident, text = docs[id_col].cast("long"), docs[text_col]
    texts = docs.select(ident.alias("id"), F.xxhash64(text).alias("hash")).where("id is not null")
    if not texts.groupBy("id").agg(F.min("hash").alias("a"), F.max("hash").alias("b")).where("a <> b").head(1):
        gone = stored(near_groups(docs, id_col, text_col).where("not kept").select(F.col(id_col).alias("__gone")).distinct(), "gone")
        return docs.join(if_small(gone), docs[id_col] == gone["__gone"], "left_anti")
    node = F.when(ident.isNotNull(), F.xxhash64(ident, text))
    rows = docs.select(node.alias("node"), ident.alias("id"), text.alias("text"))
    groups = near_groups(rows, "node").where("node is not null").select("node", "component_id").distinct()
    placed = stored(rows.select("node", "id").where("node is not null").distinct().join(groups, "node"), "placed")
    least = stored(placed.groupBy("component_id").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"),
                   "least")
    gone = stored(placed.join(if_small(least), "component_id").where("id <> least").select(F.col("node").alias("__gone")), "gone")
    return docs.join(if_small(gone), node == gone["__gone"], "left_anti")


def op1_near_dedup(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents"))


SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
        else [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] end) as shingle from w),
n as (select doc_id, count(*) as size from s group by doc_id),
c as (select a.doc_id as u, b.doc_id as v, count(*) as shared from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id
      group by all),
e as (select u, v from c join n x on x.doc_id = u join n y on y.doc_id = v where 100 * shared >= 75 * (x.size + y.size - shared)),
b as (select u, v from e union select v, u from e),
r(doc_id, seen) as (select doc_id, doc_id from documents union select r.doc_id, b.v from r join b on b.u = r.seen),
k as (select doc_id, min(seen) as component_id from r group by doc_id)
select d.doc_id, coalesce(n.size, 0)::bigint as n_shingles, k.component_id, d.doc_id = k.component_id as kept
from documents d left join n using (doc_id) left join k using (doc_id)
"""

QUERIES = {"op1_near_dedup": (op1_near_dedup, SQL)}
