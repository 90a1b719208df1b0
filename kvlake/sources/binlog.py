"""Binary record logs (header, key, value): written by tasks, read wherever Spark reads files.

A torn tail ends a file; a malformed record fails the read; a missing folder or file is an empty log, which the driver
alone decides. A file is one batch of a log and is read whole, so it must stay below 2 GB (Spark's limit for binary
files, beyond which the read fails)."""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kvlake.functions.codec import decode, encode
from kvlake.schema import MUTATION
from kvlake.sources import fs

#: Bytes after which a task begins another file, and rows of a batch of decoded records.
FILE_BYTES, ROWS = 64 << 20, 8192


def write(log: DataFrame, path: str) -> int:
    """The log's records under `path`, one file or more a partition, in the partition's order; returns their number.

    Tasks write under names that readers pass over. Those that the successful tasks report get their final names."""
    spark = log.sparkSession
    jfs, p = fs._fs(spark, path)
    jfs.mkdirs(p)
    base = jfs.makeQualified(p).toString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as store

        files, root = store.FileSystem.from_uri(base)
        out, name, n = None, "", 0

        def done():
            out.close()
            return pa.record_batch([pa.array([name]), pa.array([n], pa.int64())], ["name", "n"])

        for b in batches:
            for key, value, dead, seq in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name, n = f"{uuid.uuid4().hex}.log", 0
                    out = files.open_output_stream(f"{root}/.{name}", compression=None)
                out.write(encode(key, None if dead else bytes(value or b""), seq))
                n += 1
                if out.tell() >= FILE_BYTES:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    made = log.select("key", F.col("value").cast("binary"), "tombstone", "seq").mapInArrow(run, "name string, n long").collect()  # a row a file
    for r in made:
        fs.rename(spark, f"{base}/.{r.name}", f"{base}/{r.name}")
    return sum(r.n for r in made)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.name for f in MUTATION.fields]

    def batch(rows):
        key, value, seq = zip(*rows)
        return pa.record_batch([pa.array(key, pa.string()), pa.array(value, pa.binary()), pa.array([v is None for v in value]), pa.array(seq, pa.int64())], names)

    for b in batches:
        for content in b.column(0):
            rows = []
            for r in decode(content.as_buffer().to_pybytes() if content.is_valid else b""):
                rows.append(r)
                if len(rows) == ROWS:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of a file, or of a folder's files."""
    if not fs.exists(spark, path) or (fs.is_folder(spark, path) and not any(not n.startswith((".", "_")) for n in fs.names(spark, path))):
        return spark.createDataFrame([], MUTATION)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_decoded, MUTATION)
