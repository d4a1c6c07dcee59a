"""WARC archives: Spark writes them, a salvage reader reads them back and logs what it had to skip.

Writing: one record per row. Rows with equal payloads (SHA-1, a second hash and the length) of at least `revisit_from` bytes
share one response, that of the largest id; the others become revisits that refer to it. The shared payloads are a stored
table of digests: Spark broadcasts it if its file size allows, and else shuffles the pages by digest. Records are text, and Spark's
text sink with the record terminator as line separator writes them, so archives appear through Spark's commit protocol in
any file system it knows. An archive is read by one task: it holds at most so many records, and so many bytes unless it is a single
record; records are written by classes of size, each with its own number per archive.

Reading: one archive per row of Spark's binary source, parsed by `salvage`. It reads plain archives and gzip members. A
record passes when its version line and headers parse, its length fits, the terminator follows and its payload digest
agrees. After a failed check the reader goes on at the next member or version line that passes, and the bytes in
between become one gap row with the reason. A record with sound framing and a wrong digest is quarantined alone.

Defined cases: null payload is empty; a null url is written as an empty header; a null id comes back as null (rows of null
ids never are the response others refer to unless all of the group are null); repeated rows are records each;
empty tables give an empty result; other columns are not read. Responses below the bound are written whole, however often they repeat.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm.common import mapped, stored, stored_path, table

END = "\r\n\r\n"
SCHEMA = ("archive string, start long, stop long, kind string, reason string, record_type string, record_id string, "
          "url string, refers_to string, payload_bytes long, payload_digest string, payload binary")
URN = "urn:runlens:page:"


#: Bytes of a record besides url and payload, at most.
FIXED = 1024


def sized(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(id, url, payload, bytes, size): bytes of the payload and, at most, of the record."""
    return (pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
                         F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
            .withColumn("bytes", F.octet_length("payload").cast("long"))
            .withColumn("size", F.col("bytes") + 3 * F.octet_length("url").cast("long") + FIXED))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
            revisit_from: int = 1000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One row per page with `value`, the WARC record without its terminator, and `size`, which its bytes do not exceed."""
    rows = (sized(pages, id_col, url_col, payload_col)
            .withColumn("digest", F.sha1(F.col("payload").cast("binary")))
            .withColumn("second", F.xxhash64("payload")))
    key = ["digest", "second", "bytes"]
    shared = stored(rows.where(F.col("bytes") >= revisit_from).groupBy(key)
                    .agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "warc-shared")
    rows = rows.join(shared, key, "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda ident: F.concat(F.lit(f"<{URN}"), F.coalesce(ident.cast("string"), F.lit("")), F.lit(">"))
    http = F.when(revisit, F.lit(f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8{END}")).otherwise(
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                 F.col("bytes").cast("string"), F.lit(END)))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    length = (F.octet_length(http) + F.octet_length(body)).cast("string")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("keeper"))),
                                 line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))))
        .otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length), F.lit("\r\n"))
    return rows.select(F.concat(head, http, body).alias("value"), "size")


def write_archives(pages: DataFrame, path: str, records_per_archive: int = 2000, bytes_per_archive: int = 64 << 20,
                   **options) -> None:
    numbers = [records_per_archive]
    while numbers[-1] > 1:
        numbers.append(max(1, numbers[-1] // 8))
    # The class of a record: the first number of records of its size that fit an archive, else the last, one.
    kind = F.lit(len(numbers) - 1)
    for k in range(len(numbers) - 2, -1, -1):
        kind = F.when(F.col("size") * numbers[k] <= bytes_per_archive, k).otherwise(kind)
    columns = {k: v for k, v in options.items() if k.endswith("_col")}
    present = sorted(r["kind"] for r in sized(pages, **columns).select(kind.alias("kind")).distinct().collect())
    made = records(pages, **options)
    for i, k in enumerate(present or [0]):
        part = made.where(kind == k) if len(present) > 1 else made
        (part.select("value").write.mode("append" if i else "error").option("lineSep", END)
         .option("maxRecordsPerFile", numbers[k]).text(path))


# ---- reading --------------------------------------------------------------------------------------------------

VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"
ONCE = frozenset((b"warc-type", b"warc-record-id", b"warc-date", b"warc-target-uri", b"content-length", b"warc-payload-digest"))


def parse_record(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """(record, end, reason) of the record at `at`; the record is None when a check fails. `end` is behind its
    terminator if the framing holds, else `at`."""
    if not VERSION.match(data, at):
        return None, at, "no version line"
    head: dict[bytes, bytes] = {}
    row = at + 10  # behind the version line
    while (stop := data.find(b"\r\n", row)) != row:
        if stop < 0 or VERSION.match(data, row):
            return None, at, "no end of headers"
        colon = data.find(b":", row, stop)
        name = data[row:max(colon, row)].strip().lower()
        if not name:
            return None, at, "bad header line"
        if name in ONCE and name in head:  # the headers of two records run together
            return None, at, "repeated header"
        head[name] = data[colon + 1:stop].strip()
        row = stop + 2
    length = head.get(b"content-length", b"")
    if not length.isdigit():
        return None, at, "bad content length"
    begin = stop + 2
    end = begin + int(length)
    if data[end:end + 4] != b"\r\n\r\n":
        return None, at, "truncated" if end + 4 > len(data) else "no terminator"
    block = data[begin:end]
    payload = block
    if head.get(b"content-type", b"").startswith(b"application/http"):
        _, _, payload = block.partition(b"\r\n\r\n")
    kind = head.get(b"warc-type", b"").decode("utf-8", "replace")
    digest = head.get(b"warc-payload-digest", b"").decode("ascii", "replace")
    own = "sha1:" + hashlib.sha1(payload).hexdigest()
    if kind != "revisit" and digest and digest.lower() != own:
        return None, end + 4, "wrong payload digest"
    text = lambda name: head.get(name, b"").decode("utf-8", "replace")
    size = head.get(b"x-payload-length", b"")
    return {
        "record_type": kind, "record_id": text(b"warc-record-id"), "url": text(b"warc-target-uri"),
        "refers_to": text(b"warc-refers-to") or None,
        "payload_bytes": int(size) if kind == "revisit" and size.isdigit() else len(payload),
        "payload_digest": (digest or own).partition(":")[2].lower(),
        "payload": None if kind == "revisit" else payload,
    }, end + 4, ""


def salvage(data: bytes) -> Iterator[dict]:
    """Rows of records and gaps, in byte order; together they cover the archive."""
    at, hole, why = 0, None, ""
    starts = Starts(data)

    def gap(upto: int):
        return {"kind": "gap", "start": hole, "stop": upto, "reason": why}

    while at < len(data):
        found, end, reason = [], at, ""
        if data.startswith(MEMBER, at):
            inside, size, reason = inflate(data, at)
            if inside is not None:
                end = at + size
                found = [{**r, "start": at, "stop": end} if r["kind"] == "record" else
                         {**r, "start": at, "stop": end, "reason": "in member: " + r["reason"]} for r in salvage_plain(inside)]
        else:
            record, end, reason = parse_record(data, at)
            if record:
                found = [{"kind": "record", "start": at, "stop": end, **record}]
        if found:
            if hole is not None:
                yield gap(at)
                hole = None
            yield from found
            at = end
            continue
        if hole is None:
            hole, why = at, reason
        framed = end > at and (end >= len(data) or VERSION.match(data, end) or data.startswith(MEMBER, end))
        if framed:  # quarantined alone: the next record begins where this one says it ends
            yield gap(end)
            hole, at = None, end
            continue
        at = starts.after(at + 1)
    if hole is not None:
        yield gap(len(data))


def salvage_plain(data: bytes) -> Iterator[dict]:
    """The records of an inflated member (no member inside a member)."""
    at = 0
    while at < len(data):
        record, end, reason = parse_record(data, at)
        if record:
            yield {"kind": "record", **record}
            at = end
            continue
        later = VERSION.search(data, max(at + 1, end))
        upto = later.start() if later else len(data)
        yield {"kind": "gap", "reason": reason}
        at = upto


def inflate(data: bytes, at: int, step: int = 1 << 10) -> tuple[bytes | None, int, str]:
    """(content, compressed size, reason) of the gzip member at `at`; checks its CRC. Steps double, so that a false member costs little."""
    machine, out, pos = zlib.decompressobj(31), [], at
    try:
        while not machine.eof and pos < len(data):
            out.append(machine.decompress(data[pos:pos + step]))
            pos, step = pos + step, min(2 * step, 1 << 16)
    except zlib.error as e:
        return None, 0, f"bad member: {e}"
    if not machine.eof:
        return None, 0, "truncated member"
    return b"".join(out), min(pos, len(data)) - at - len(machine.unused_data), ""


class Starts:
    """Places where a member or a version line begins. Both searches only go forward, so each byte is searched once for either."""

    def __init__(self, data: bytes):
        self.data, self.line, self.member = data, -1, -1

    def after(self, at: int) -> int:
        """The next place from `at` on, or the end; `at` never falls."""
        if self.line < at:
            found = VERSION.search(self.data, at)
            self.line = found.start() if found else len(self.data)
        if self.member < at:
            found = self.data.find(MEMBER, at)
            self.member = found if found >= 0 else len(self.data)
        return min(self.line, self.member)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives below `path` (kind is 'record' or 'gap')."""
    import pyarrow as pa

    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def parse(batches):
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in SCHEMA.split(", ")])
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1)):
                rows, held = [], 0
                for r in salvage(content.as_py()):
                    if not payloads:
                        r["payload"] = None
                    rows.append({**dict.fromkeys(names), **r, "archive": archive.as_py()})
                    held += len(r.get("payload") or b"") + 500
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return mapped(files, parse, SCHEMA)


def op10_warc_salvage(spark, sf_dir):
    path = stored_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    ident = lambda name: F.when(F.col(name) != "", F.regexp_extract(name, rf"^<{URN}(-?\d+)>$", 1)).try_cast("long")
    return (read_archives(spark, path, payloads=False).where("kind = 'record'")
            .select(ident("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                    ident("refers_to").alias("refers_to")))


SQL = r"""
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b) as payload_bytes, sha1(b) as payload_digest from p),
k as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) end as keeper from d)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
       case when keeper is not null and page_id is distinct from keeper then 'revisit' else 'response' end as record_type,
       case when keeper is not null and page_id is distinct from keeper then keeper end as refers_to
from k
"""

QUERIES = {"op10_warc_salvage": (op10_warc_salvage, SQL)}
