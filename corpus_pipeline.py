"""A corpus made ready for training, stage by stage.

Each stage takes what its predecessor kept, with the columns of ``documents``
and any others, whatever their names; the last one packs.  Of an empty table
each makes an empty one.  Stages use the operators of ``millrace.llm`` as the
registered queries do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.minhash import near_duplicates
from millrace.llm.mixing import mix_sources
from millrace.llm.packing import pack_documents
from millrace.llm.quality import keep_quality, train
from millrace.llm.secrets import redact_secrets
from millrace.llm.shared import documents, written

#: Documents whose numbers of copies may be broadcast; beyond, texts are joined by a shuffle.
BROADCAST_COPIES = 500_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the trees reject go.

    Null, empty and wordless texts fail the rules, with an id or without one;
    repeated rows are judged alike, each by itself.
    """
    return keep_quality(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _beside(docs: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that ``docs`` hasn't."""
    longest = max((len(c) for c in docs.columns), default=0)
    return [f"{n}_{'x' * longest}" for n in names]


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates its least id stays.

    Documents without an id stay, and so do null, empty and wordless texts,
    which are like nothing.  Rows of a kept id stay once for each of
    their texts: of repeated rows the one of the least hash.
    """
    stay = near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    t, h = _beside(docs, "t", "h")
    rows = docs.filter("doc_id is not null").join(stay, "doc_id", "left_semi").withColumns({t: F.xxhash64("text"), h: F.xxhash64(*docs.columns)})
    least = rows.groupBy("doc_id", t).agg(F.min(h).alias(h))
    once = rows.join(least, ["doc_id", t, h], "left_semi").dropDuplicates(["doc_id", t])
    return once.select(docs.columns).unionByName(docs.filter("doc_id is null"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blanked out of the texts; all documents stay.

    Null and empty texts stay as they are; repeated rows are blanked alike;
    ``n_chars`` is renewed where a text changes.
    """
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null texts and texts without words have no size and are not taken; a null
    source is a source of its own.  Rows of equal id and text are
    exchangeable: one of them comes as often as the mix takes all of them.
    """
    key, copies, rows, at = _beside(docs, "key", "copies", "rows", "at")
    keyed = docs.withColumn(key, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.sha2(F.coalesce("text", F.lit("")), 256)))
    taken = mix_sources(keyed, id_col=key).groupBy(key).agg(F.sum(F.expr("cast(taken div greatest(size, 1) as int)")).cast("int").alias(copies), F.count("*").alias(rows))
    taken = written(taken.filter(F.col(copies) > 0), "copies")
    if taken.count() <= BROADCAST_COPIES:
        taken = F.broadcast(taken)
    found = keyed.join(taken, key)
    once = found.filter(F.col(rows) == 1).unionByName(found.filter(F.col(rows) > 1).dropDuplicates([key]))
    return once.select(*docs.columns, F.explode(F.sequence(F.lit(1), copies)).alias(at)).drop(at)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens.

    A null or empty text is its end id; rows with equal or null ids are packed
    one by one.
    """
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: Trees, MinHash components, dependent rounding and packing have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
