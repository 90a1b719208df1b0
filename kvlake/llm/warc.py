"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of whole records, closed by a skippable frame with the seek
table of compressed and plain sizes. The index maps a record to (bundle, frame, offset in the frame, length), so one
record costs one range read. Only bundles that the index names count: a failed or repeated task leaves an orphan.

Equal payloads of at least `MIN_REVISIT` bytes are stored once, by the smallest page_id; other records are revisits
that refer to it. Cases: a NULL html is an empty payload; rows without page_id can be revisits but never the response
others refer to; rows that repeat the smallest page_id and its payload are all responses; an empty table makes no
bundle; other columns are ignored; `url` may be missing or NULL. Rows that repeat a page_id and its payload share a record
id, for they are the same record. A page of any length is one record, in a frame of its own if it exceeds one. `read` leaves
a revisit's payload NULL, as it is stored; `resolved` fetches it.
"""
from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kvlake.sources import scratch

MIN_REVISIT = 100
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 256 << 20
# Fixed values of the seekable format: the skippable frame's and the footer's magic numbers.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, bundle string, frame int, offset int, length int"
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id, digest: str) -> str:
    """The same for the same page and payload, so that a revisit can name the record it refers to."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id, url, payload: bytes, digest: str, refers_to, size: int, date: str) -> bytes:
    """One WARC/1.1 record; `refers_to` makes it a revisit without payload."""
    kind = "response" if refers_to is None else "revisit"
    body = HTTP + (payload if refers_to is None else b"")
    url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"X-Page-ID: {'' if page_id is None else page_id}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}",
            f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    if refers_to is not None:
        head[3:3] = [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The record's fields; a response's digest and length are taken from the payload read and must match its header."""
    import hashlib

    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(h["Content-Length"])]
    if rest[len(body):] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    payload = body.partition(b"\r\n\r\n")[2]
    digest, size, kind = h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["X-Payload-Length"]), h["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload does not match its digest")
    return {"page_id": int(h["X-Page-ID"]) if h["X-Page-ID"] else None, "url": h["WARC-Target-URI"], "payload": payload if kind == "response" else None, "payload_bytes": size,
            "payload_digest": digest, "record_type": kind, "refers_to": int(h["X-Refers-To-Page"]) if kind == "revisit" else None}


class BundleWriter:
    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.out, self.frame_bytes, self.zstd = out, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.sizes: list[tuple[int, int]] = []
        self.open_: list[bytes] = []
        self.plain = self.total = 0

    def add(self, raw: bytes) -> tuple[int, int, int]:
        """(frame, offset in it, length)"""
        at = len(self.sizes), self.plain, len(raw)
        self.open_.append(raw)
        self.plain += len(raw)
        if self.plain >= self.frame_bytes:
            self._end_frame()
        return at

    def _end_frame(self):
        packed = self.zstd.compress(b"".join(self.open_))
        self.out.write(packed)
        self.sizes.append((len(packed), self.plain))
        self.total += len(packed)
        self.open_, self.plain = [], 0

    def close(self):
        if self.open_:
            self._end_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Random access by frame; `f` is a seekable file. Entries are 8 bytes a frame, or 12 where checksums are kept."""

    def __init__(self, f):
        import zstandard

        self.f, self.zstd = f, zstandard.ZstdDecompressor()
        f.seek(0, 2)
        end = f.tell()
        f.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        width = 12 if flags & 0x80 else 8
        f.seek(end - 9 - n * width)
        table = f.read(n * width)
        self.sizes = [struct.unpack_from("<II", table, i * width) for i in range(n)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, i: int) -> bytes:
        self.f.seek(self.starts[i])
        return self.zstd.decompress(self.f.read(self.sizes[i][0]), max_output_size=self.sizes[i][1])


def _writer(base: str, date: str, frame_bytes: int, bundle_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(base)
        w, name, rows = None, "", []

        def flush():
            w.close()
            out = pa.Table.from_pylist([{"page_id": p, "bundle": name, "frame": f, "offset": o, "length": n} for p, (f, o, n) in rows],
                                       pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]))
            rows.clear()
            return out.to_batches()

        for b in batches:
            for page_id, url, payload, size, digest, refers in zip(*(c.to_pylist() for c in b.columns)):
                if w is None:
                    name = f"bundle-{uuid.uuid4().hex}.warc.zst"
                    w = BundleWriter(store.open_output_stream(f"{root}/{name}", compression=None), frame_bytes)
                rows.append((page_id, w.add(record(page_id, url, payload, digest, refers, size, date))))
                if w.total >= bundle_bytes:
                    yield from flush()
                    w = None
        if w is not None:
            yield from flush()

    return run


def write(pages: DataFrame, base: str, date: str = "1970-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes all pages under `base` and returns the index, itself a table on shared storage.

    Payloads move only if the table of repeated digests is too large to broadcast; then the join splits hot digests."""
    from kvlake.sources import fs

    spark = pages.sparkSession
    jfs, p = fs._fs(spark, base)
    jfs.mkdirs(p)
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    firsts = rows.filter(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = rows.join(firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    todo = joined.select("page_id", "url", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "size", "digest", F.when(revisit, F.col("first")).alias("refers"))
    return scratch.written(todo.mapInArrow(_writer(base, date, frame_bytes, bundle_bytes), INDEX), "warc-index")


def _reader(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(base)
        held, reader, frame = (None, None), None, b""
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for b in batches:
            out = []
            for bundle, number, offset, length in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("bundle", "frame", "offset", "length"))):
                if held[0] != bundle:
                    reader = BundleReader(store.open_input_file(f"{root}/{bundle}"))
                if held != (bundle, number):
                    held, frame = (bundle, number), reader.frame(number)
                out.append(parse(frame[offset: offset + length]))
                if len(out) >= 256:
                    yield from pa.Table.from_pylist(out, schema).to_batches()
                    out = []
            if out:
                yield from pa.Table.from_pylist(out, schema).to_batches()

    return run


def read(spark: SparkSession, base: str, index: DataFrame) -> DataFrame:
    """The indexed records, by frame: each frame is read and unpacked once, wherever its bundle lies."""
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return index.repartition(parts, "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(_reader(base), RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """Records with the payloads of revisits taken from the responses they refer to. Payloads of responses that are referred
    to move once; the join splits responses of many revisits."""
    wanted = records.filter("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_digest").distinct()
    stored = records.filter("record_type = 'response'").join(wanted, ["page_id", "payload_digest"], "left_semi").dropDuplicates(["page_id", "payload_digest"])
    stored = stored.select(F.col("page_id").alias("__page"), F.col("payload_digest").alias("__digest"), F.col("payload").alias("__payload"))
    rows = records.join(stored, (F.col("refers_to") == F.col("__page")) & (F.col("payload_digest") == F.col("__digest")), "left")
    return rows.withColumn("payload", F.coalesce("payload", "__payload")).select(*records.columns)
