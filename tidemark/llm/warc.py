"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames of about ``frame_bytes``; a record is never cut, so a longer one has a frame
of its own. A bundle ends in a skippable frame with the seek table (compressed and decompressed size of every frame, then
the frame count, a descriptor byte and the format's magic number), as any reader of the seekable format expects. Its
index maps a record's identifier to the frame's number, the frame's offset in the bundle and the record's offset in the
decompressed frame.

Of records with equal payloads the one with the smallest id is the response, the others are revisits that refer to it
and carry no payload. The smallest id of each payload is found by a map-side combined aggregation over digests; only digests that
repeat are written, and the pages of a very frequent one are spread over the tasks of the join that marks revisits.

Bundles are rows of a Parquet table on shared storage (``bundle binary``), so their writing is retried and committed as
any Spark output; ``export_bundles`` writes them as ``.warc.zst`` files and ``read_bundle_files`` reads such files.

Defined cases: a null payload is the empty one; empty payloads are equal payloads; a null id takes no part in the
smallest id and comes after all ids in a bundle; rows with an id that repeats are records of their own, of which all with the
smallest id and the same payload are responses; a null url is written as an empty target.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialised, spread_join, table

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
BUNDLE_BYTES = 4 << 20
FRAME_BYTES = 64 << 10
EPOCH = "1970-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    """SHA-1 in bare upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit if it refers to another."""
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {url.replace('\r', '%0D').replace('\n', '%0A')}", f"WARC-Date: {EPOCH}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/octet-stream",
    ]
    body = payload
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        body = b""
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and body of the record that begins at ``at``, and where it ends."""
    body = data.index(b"\r\n\r\n", at) + 4
    lines = data[at : body - 4].decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    end = body + int(fields["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    return fields, data[body:end], end + 4


def grouped(records: list[bytes], frame_bytes: int = FRAME_BYTES) -> tuple[list[bytes], list[tuple[int, int]]]:
    """The contents of the frames that hold the records, and each record's frame and its offset in it."""
    frames: list[list[bytes]] = []
    places, size = [], 0
    for r in records:
        if not frames or size + len(r) > frame_bytes:
            frames.append([])
            size = 0
        places.append((len(frames) - 1, size))
        frames[-1].append(r)
        size += len(r)
    return [b"".join(f) for f in frames], places


def pack(contents: list[bytes], level: int = 3) -> bytes:
    """A bundle with a frame for each of ``contents`` and the seek table."""
    import zstandard

    coder = zstandard.ZstdCompressor(level=level, write_content_size=True)
    frames = [coder.compress(c) for c in contents]
    entries = b"".join(struct.pack("<II", len(f), len(c)) for f, c in zip(frames, contents))
    footer = struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return b"".join(frames) + struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def frames_of(bundle: bytes) -> list[tuple[int, int, int]]:
    """Offset, compressed and decompressed size of each frame, from the seek table alone."""
    count, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    at, out = 0, []
    for packed, plain in struct.iter_unpack("<II", bundle[-9 - 8 * count : -9]):
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(bundle: bytes, offset: int, size: int) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(bundle[offset : offset + size])


def base32(hexed: Column) -> Column:
    """The 160 bits of a SHA-1 in hexadecimal digits as 32 base-32 digits."""
    word = lambda i: F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0")  # noqa: E731  40 bits
    return F.translate(F.concat(*(word(i) for i in range(4))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def marked(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``(page_id, url, payload, payload_digest, refers_to)``: the digests, and the response that each revisit refers to."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_digest", base32(F.sha1("payload")))
    repeated = rows.where(F.length("payload") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    said = spread_join(rows, materialised(pages.sparkSession, repeated, "warc-repeated"), "payload_digest", "copies")
    refers = F.when((F.length("payload") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return said.select("page_id", "url", "payload", "payload_digest", refers.alias("refers_to"))


def write_bundles(records: DataFrame, bundle_bytes: int = BUNDLE_BYTES, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """``(bundle, index array<struct<page_id, frame, offset, inside>>)``: about ``bundle_bytes`` of records in each bundle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, size = [], [], 0

        def done() -> pa.RecordBatch:
            contents, places = grouped(held, frame_bytes)
            data = pack(contents)
            frames = frames_of(data)
            index = [{"page_id": i, "frame": n, "offset": frames[n][0], "inside": inside} for i, (n, inside) in zip(ids, places)]
            kind = pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("inside", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([index], kind)], names=["bundle", "index"])

        for batch in batches:
            for i, url, payload, digest, to in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(record(i, url, payload, digest, to))
                ids.append(i)
                size += len(held[-1])
                if size >= bundle_bytes:
                    yield done()
                    held, ids, size = [], [], 0
        if held:
            yield done()

    return records.select("page_id", "url", "payload", "payload_digest", "refers_to").mapInArrow(run, "bundle binary, index array<struct<page_id:long,frame:int,offset:long,inside:long>>")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """``(page_id, url, record_type, payload_bytes, payload_digest, refers_to, body)`` of every record of ``bundles(bundle)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(x[10:-1]) if x and len(x) > 11 else None  # noqa: E731  <urn:page:7>
        for batch in batches:
            for cell in batch.column(0):
                bundle, rows = cell.as_py(), []
                frames = frames_of(bundle)
                for n, (at, packed, _) in enumerate(frames):
                    frame, end = read_frame(bundle, at, packed), 0
                    while end < len(frame):
                        head, body, end = parse(frame, end)
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if head["WARC-Type"] == "response" and digest_of(body) != digest:
                            raise ValueError(f"payload of {head['WARC-Record-ID']} doesn't fit its digest")
                        rows.append((number(head["WARC-Record-ID"]), head["WARC-Target-URI"], head["WARC-Type"], int(head["X-Payload-Length"]), digest, number(head.get("WARC-Refers-To")), body))
                    if len(rows) >= 256 or n == len(frames) - 1:
                        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
                        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "body"]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows = []

    return bundles.select("bundle").mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, body binary")


def fetch(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(page_id, record)`` of the ids in ``wanted(page_id)``: only their frames are decompressed, found by the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, places in zip(batch.column(0), batch.column(1)):
                bundle = cell.as_py()
                frames = frames_of(bundle)
                found, now, frame = [], None, b""
                for p in sorted(places.as_py(), key=lambda p: (p["frame"], p["inside"])):
                    if p["frame"] != now:
                        now, frame = p["frame"], read_frame(bundle, p["offset"], frames[p["frame"]][1])
                    found.append((p["page_id"], frame[p["inside"] : parse(frame, p["inside"])[2]]))
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([r for _, r in found], pa.binary())], names=["page_id", "record"])

    keyed = bundles.withColumn("key", F.sha2("bundle", 256))
    places = keyed.select("key", F.explode("index").alias("p")).join(wanted.select(F.col("page_id").alias("wanted")).distinct(), F.col("p.page_id") == F.col("wanted"), "left_semi")
    asked = places.groupBy("key").agg(F.collect_list("p").alias("places"))
    return keyed.join(asked, "key").select("bundle", "places").mapInArrow(run, "page_id long, record binary")


def export_bundles(bundles: DataFrame, uri: str) -> DataFrame:
    """Write each bundle as a ``.warc.zst`` file under a URI that pyarrow can write; returns ``(path, bytes)``.

    A name comes from the content and the bundle's place (equal bundles are files of their own) and a file appears whole, so a task
    that runs twice over written bundles does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for cell in batch.column(0):
                data = cell.as_py()
                path = f"{root}/{task:06d}-{number:06d}-{hashlib.sha256(data).hexdigest()}.warc.zst"
                number += 1
                part = f"{path}.{id(data):x}.part"
                with store.open_output_stream(part) as f:
                    f.write(data)
                store.move(part, path)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(data)], pa.int64())], names=["path", "bytes"])

    return bundles.select("bundle").mapInArrow(run, "path string, bytes long")


def read_bundle_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of the ``.warc.zst`` files under a path."""
    return read_bundles(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select(F.col("content").alias("bundle")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles = materialised(spark, write_bundles(marked(table(spark, sf_dir, "pages"))), "warc")
    return read_bundles(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
