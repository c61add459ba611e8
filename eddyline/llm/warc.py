"""WARC archives: written in parallel, a gzip member a record, and read back by byte ranges.

Writing. Payloads are digested in the JVM; the least page_id of each digest keeps its payload (response) and
the others name it (revisit, of the identical-payload-digest kind). A task writes one archive into the shared
folder under a name of its own attempt; the table of written archives (file, bytes, records) is what counts
as committed, so a repeated or lost attempt leaves at most a file that nobody reads.

Reading. Archives are cut in ranges of ``split`` bytes, one task each. A task looks for gzip's magic bytes in
its range, takes the first place where a member decodes to a WARC header (so compressed bytes that look alike
are passed over), and then reads member after member while they start inside its range, the last one beyond
its end. So each record is read by just one task, however ranges fall. Lengths and digests are checked.

Folders are anything ``pyarrow.fs`` opens (file, hdfs, s3, gs). Defined results: a null html is an empty payload;
a null page_id is a response of its own and never another's; rows that repeat an id with the same payload are
all responses if the id is the least; an empty table gives archives without records and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.llm.common import saved, spread_join, table
from eddyline.shared import scratch_path

MAGIC = b"\x1f\x8b\x08"
SPLIT = 4 << 20
FEED = 1 << 13
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A record as a gzip member; ``refers_to`` makes it a revisit, without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _headers(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode("utf-8", "replace").split("\r\n")[1:])}


def parsed(record: bytes) -> dict:
    """A decoded member's fields and payload (None for a revisit); raises where it contradicts itself."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _headers(head)
    length = int(fields["content-length"])
    block = rest[:length]
    if not head.startswith(b"WARC/") or len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError("a WARC record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    number = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
    revisit = fields["warc-type"] == "revisit"
    if not revisit and digest32(payload) != digest:
        raise ValueError("a WARC payload's digest is wrong")
    size = int(_headers(http)["content-length"])
    return {"page_id": number("warc-record-id"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": number("warc-refers-to"), "payload": None if revisit else payload}


def with_originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to: the least page_id with an equal payload, if that is another. Ids and digests alone
    settle that; pages then meet their id and digest in a plain join, which Spark splits where one id has many rows,
    and those without an id stay where they are."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html")).withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    long = rows.where((F.octet_length("html") >= least_bytes) & F.col("page_id").isNotNull())
    first = saved(long.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "warc-first")
    again = saved(spread_join(long.select("page_id", "sha"), first, "sha").where("page_id > first").distinct(), "warc-again")
    named = rows.where("page_id is not null").join(again, ["page_id", "sha"], "left")
    alone = rows.where("page_id is null").withColumn("first", F.lit(None).cast("long"))
    names = ["page_id", "url", "html", F.col("first").alias("refers_to")]
    return named.select(*names).unionByName(alone.select(*names))


def write_archives(pages: DataFrame, folder: str, date: str = "2020-01-01T00:00:00Z", least_bytes: int = 0) -> DataFrame:
    """Writes and returns (file, bytes, records), a row an archive."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        path, size, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
        out = None
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch[c] for c in ("page_id", "url", "html", "refers_to")), strict=True):
                out = out or store.open_output_stream(path, compression=None)
                data = member(page_id.as_py(), url.as_py(), html.as_py().encode("utf-8", "replace"), refers_to.as_py(), date)
                out.write(data)
                size, n = size + len(data), n + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["file", "bytes", "records"])

    return saved(with_originals(pages, least_bytes).mapInArrow(write, "file string, bytes long, records long"), "warc-manifest")


def read_range(source, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of the members of an open file that start from ``start`` up to before ``end``."""
    size = source.size()
    data = memoryview(source.read_at(min(end + len(MAGIC) - 1, size) - start, start))
    raw = bytes(data)

    def decoded(at: int, header_only: bool) -> tuple[bytes, int]:
        unpack, out, place = zlib.decompressobj(31), [], at
        while not unpack.eof:
            low = place - start
            chunk = data[low : low + FEED] if low < len(data) else source.read_at(FEED, place)
            if not len(chunk):
                raise zlib.error("the file ends within a member")
            out.append(unpack.decompress(chunk))
            place += len(chunk)
            if header_only and (b"\r\n\r\n" in (head := b"".join(out)) or not b"WARC/".startswith(head[:5])):
                return head, place
        return b"".join(out), place - len(unpack.unused_data)

    at = raw.find(MAGIC)
    while 0 <= at < end - start:
        try:
            if decoded(start + at, True)[0].startswith(b"WARC/"):
                break
        except zlib.error:
            pass
        at = raw.find(MAGIC, at + 1)
    if at < 0:
        return
    place = start + at
    while place < end and place < size:
        record, after = decoded(place, False)
        yield place, record
        place = after


def read_archives(archives: DataFrame, folder: str, split: int = SPLIT, payloads: bool = False) -> DataFrame:
    """The records of the archives in ``archives`` (file, bytes), payload too if asked for."""
    ranges = archives.where("bytes > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"), "bytes").withColumn("end", F.least(F.col("start") + split, F.col("bytes")))
    n = archives.agg(F.coalesce(F.sum(F.ceil(F.col("bytes") / split)), F.lit(0))).first()[0]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())][: len(names)])
        for batch in batches:
            for file, start, end in zip(*(batch[c] for c in ("file", "start", "end")), strict=True):
                with store.open_input_file(file.as_py()) as source:
                    rows, held = [], 0
                    for _, record in read_range(source, start.as_py(), end.as_py()):
                        row = parsed(record)
                        rows.append([row[c] for c in names])
                        held += len(record)
                        if held > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return ranges.repartition(max(1, min(int(n), 100_000))).mapInArrow(read, _RECORD + ", payload binary" * payloads)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    return read_archives(write_archives(table(spark, sf_dir, "pages"), folder), folder)


#: Base 32 of a SHA-1 from its hex digits: five of them are four digits of 5 bits.
SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
q as (select page_id, octet_length(encode(html)) as n, sha1(html) as sha, min(page_id) over (partition by html) as first from p)
select page_id, cast(n as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast((cast('0x' || substr(sha, cast(5 * (i // 4) + 1 as bigint), 5) as bigint) >> cast(15 - 5 * (i % 4) as bigint)) & 31 as bigint) + 1, 1)), '') as payload_digest,
  case when page_id > first then 'revisit' else 'response' end as record_type,
  case when page_id > first then first end as refers_to
from q
"""
