"""Sequence packing by power-of-two decomposition.

A document of L ids (end id included) is cut into full pieces of `max_len` ids and then into the
powers of two of what remains, longest first.  Every piece is a sequence of its own and its length is
a power of two, so equal lengths form buckets, no sequence crosses documents and nothing is padded.
One narrow pass: no shuffle, no state beyond one Arrow batch.

Packed sequences are kept in buckets: one folder of files for each length, so a reader of a bucket gets
batches of one shape without padding and without looking at other lengths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.tokens import binary_column, default_vocabulary, encoder

SCHEMA = "doc_id long, start long, length long, bucket int, sequence_id long, offset long, doc_tokens long, ids binary"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("bucket", pa.int32()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
BATCH_ROWS = 8192
#: sequence_id: log2 of the length, then the partition, then a running number.
TASK_BITS, RUN_BITS = 22, 35


def cut_points(length: int, max_len: int) -> list[int]:
    """Piece lengths: full pieces, then the binary digits of the rest, high to low."""
    full, rest = divmod(length, max_len)
    return [max_len] * full + [1 << b for b in range(max_len.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_documents(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, max_len: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, with its ids as little-endian unsigned 32-bit integers.

    `bucket` is log2 of the length.  `sequence_id` holds bucket, partition and a running number, so
    ordering by it lays equal lengths side by side; it is unique, and repeats if a lost task runs again.
    Null or blank text: the end id alone.  A null id stays null.  Repeated rows are packed each.
    Very long texts become many pieces.  An empty table gives no rows; other columns are ignored.
    """
    if max_len < 1 or max_len & (max_len - 1) or max_len >> 62:
        raise ValueError("max_len must be a power of two below 2^62")
    path = vocabulary or default_vocabulary()

    def run(batches):
        task = TaskContext.get().partitionId()
        if task >> TASK_BITS:
            raise ValueError(f"sequence ids have room for {1 << TASK_BITS} partitions")
        made = [0] * max_len.bit_length()
        for batch in batches:
            for first, last, flat, sizes in encoder(path).slices(batch.column(1), end_id):
                rows, lengths = [], []
                for doc, total in zip(batch.column(0).slice(first, last - first).to_pylist(), sizes.tolist(), strict=True):
                    at = 0
                    for n in cut_points(total, max_len):
                        k = n.bit_length() - 1
                        rows.append((doc, at, n, k, (k << TASK_BITS | task) << RUN_BITS | made[k], 0, total))
                        lengths.append(n)
                        made[k] += 1
                        at += n
                ids, done = np.cumsum(lengths), 0
                for at in range(0, len(rows), BATCH_ROWS):
                    part = rows[at : at + BATCH_ROWS]
                    to = int(ids[at + len(part) - 1])
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*part), ARROW.types)), binary_column(flat[done:to], np.array(lengths[at : at + len(part)]))], schema=ARROW)
                    done = to

    return common.text_rows(docs, id_col, text_col, "string").mapInArrow(run, SCHEMA)


def write_buckets(pieces: DataFrame, out_dir: str) -> None:
    """Write packed sequences, one folder `bucket=k` for the lengths 2^k; each task writes its own file of each, nothing is shuffled."""
    pieces.write.option("compression", "zstd").partitionBy("bucket").parquet(out_dir)


def read_buckets(spark: SparkSession, out_dir: str, length: int | None = None) -> DataFrame:
    """Sequences of all buckets, or of one length: only its folder is read."""
    rows = spark.read.schema(SCHEMA).parquet(out_dir)
    return rows if length is None else rows.where(F.col("bucket") == length.bit_length() - 1)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.shared_path(spark, "packed")
    write_buckets(pack_documents(common.read(spark, sf_dir, "documents")), out)
    pieces = read_buckets(spark, out)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
