"""Helpers shared by the training-data operators."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; the path goes to Spark's reader untouched."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "binary") -> DataFrame:
    """(doc_id, text as UTF-8 bytes, or as `kind`): other columns are pruned here, so none can clash; null text is empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).cast(kind).alias("text"),
    )


def quoted(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def own_columns(docs: DataFrame) -> list[Column]:
    return [quoted(c) for c in docs.columns]


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs has not, in whatever letter case."""
    taken = {c.lower() for c in docs.columns}
    return name if name.lower() not in taken else next(n for i in itertools.count(1) if (n := f"{name}_{i}").lower() not in taken)


def with_columns(docs: DataFrame, **new: Column) -> DataFrame:
    """docs with columns added, or put in the place of those of that very name; no other column is looked up by name."""
    low = {c.lower(): c for c in docs.columns}
    kept = [new[c].alias(c) if c in new else quoted(c) for c in docs.columns]
    for c in new:
        if c not in docs.columns and c.lower() in low:
            raise ValueError(f"{low[c.lower()]} stands in the way of {c}")
    return docs.select(*kept, *(new[c].alias(c) for c in new if c not in docs.columns))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where a local session names none (tests)."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        there = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", there)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(there)
    return there


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and forget its lineage; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write df as a compressed table in the shared folder; returns it read back, and its path for drop()."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a staged table through Hadoop's file system, wherever it lives."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
