"""Media columns: byte payloads stored as lossless WebP images, read back as pixel arrays.

A payload fills rows of 64 8-bit samples; one image holds up to 16,384 rows, longer payloads are
several images in a row.  Each image takes the form its encoder expects to be smallest: plain samples, a
palette, prediction, references to earlier bytes, or four bytes a pixel with a colour cache (its rows are then
16 pixels wide, which is how a reader knows).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, webp

WIDTH = webp.ROW
BATCH_BYTES = 16 << 20


def payload_of(text: bytes) -> bytes:
    """The bytes, and zeros up to a positive multiple of the row width."""
    return text + b"\0" * (-len(text) % WIDTH if text else WIDTH)


def encode_payload(payload: bytes) -> bytes:
    flat, most = np.frombuffer(payload, np.uint8), WIDTH * webp.LARGEST
    return b"".join(webp.encode_samples(flat[at : at + most]) for at in range(0, len(flat), most))


def decode_payload(media: bytes) -> np.ndarray:
    """8-bit samples (rows, 64)."""
    return np.concatenate([webp.samples_of(webp.decode_vp8l(x)) for x in webp.images(media)]).reshape(-1, WIDTH)


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and which of an 8 x 8 grid's cells lie above the mean: mean:deviation:bits."""
    rows = np.linspace(0, len(samples), 9).astype(int)
    sums = np.concatenate([[0], samples.sum(1, dtype=np.int64)]).cumsum()
    strips = samples.reshape(len(samples), 8, 8).sum(2, dtype=np.int64)
    ahead = np.vstack([np.zeros((1, 8), np.int64), strips.cumsum(0)])
    cells = (ahead[rows[1:]] - ahead[rows[:-1]]) / np.maximum(rows[1:] - rows[:-1], 1)[:, None] / 8
    total, n = int(sums[-1]), samples.size
    squares = int((samples.astype(np.int64) ** 2).sum())
    deviation = max(0.0, squares / n - (total / n) ** 2) ** 0.5
    bits = np.packbits((cells > total / n).reshape(-1)).tobytes().hex()
    return f"{total / n:.4f}:{deviation:.4f}:{bits}"


MEDIA = "doc_id long, n_bytes long, media binary"


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text's payload as WebP.

    Null and empty texts become one row of zeros.  A null id stays null; repeated rows are stored each,
    alike; an empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            ids, sizes, media, held = [], [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc)
                sizes.append(len(text))
                media.append(encode_payload(payload_of(text)))
                held += len(media[-1])
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])
                    ids, sizes, media, held = [], [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return common.text_rows(docs, id_col, text_col).mapInArrow(run, MEDIA)


def read_media(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media_bytes, media_sha256, width, height, samples, feature) of stored media; samples row by row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("width", pa.int32()), ("height", pa.int64()), ("samples", pa.binary()), ("feature", pa.string())])

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for doc, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                samples = decode_payload(blob)
                rows.append((doc, n, len(blob), hashlib.sha256(blob).hexdigest(), samples.shape[1], len(samples), samples.tobytes(), feature(samples)))
                held += samples.size
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media_bytes long, media_sha256 string, width int, height long, samples binary, feature string")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, _ = common.stage(store_media(common.read(spark, sf_dir, "documents")), "media", codec="uncompressed")
    found = read_media(stored)
    tail = F.substring("samples", -64, 64)
    return found.select("doc_id", "n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), "media_bytes", "media_sha256", "feature")
