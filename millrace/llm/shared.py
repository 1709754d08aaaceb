"""Tables that cut lineage, in the folder all executors share; rows by identity; joins with hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a key from which on it is hot, and hot keys that may be broadcast; beyond that number all keys are joined alike.
HOT, BROADCAST_KEYS = 500, 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of our own if all runs on this machine, as in tests, and else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once as Parquet and read again: later steps don't recompute them and a lost executor costs nothing.

    Tables go when the driver's JVM ends, sooner by ``drop_written``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*tables: DataFrame) -> None:
    """Delete what ``written`` made, once nothing reads it any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, doc, row, text``: rows by an identity of their own, ``(doc, row)``, which only rows of equal id and text share.

    ``doc`` is the id as a long and ``row`` a negative hash of the text; for a
    null id ``doc`` is another hash of it and ``row`` positive.  So rows are
    ordered by ``row >= 0, doc, row``: by id, null ids last, then by text.
    """
    text, ident = F.col(text_col), F.col(id_col).cast("long")
    low = F.xxhash64(text).bitwiseAND(F.lit((1 << 63) - 1))
    return docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(ident, F.xxhash64(F.lit("text"), text)).alias("doc"),
        F.when(ident.isNull(), low).otherwise(low.bitwiseOR(F.lit(-(1 << 63)))).alias("row"),
        text.alias("text"),
    )


def join_by_key(rows: DataFrame, keyed: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """Inner join of ``rows`` (a table or other cheap scan) with ``keyed``, one row per key.

    ``size`` in ``keyed`` is the number of rows of a key.  Keys of ``HOT``
    rows and more - at most one for that many rows - are broadcast if they are
    few enough, so that no task gets all rows of one of them.
    """
    hot = keyed.filter(F.col(size) >= HOT)
    if not 0 < hot.count() <= BROADCAST_KEYS:
        return rows.join(keyed, list(keys))
    cold = rows.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti").join(keyed.filter(F.col(size) < HOT), list(keys))
    return rows.join(F.broadcast(hot), list(keys)).unionByName(cold)
