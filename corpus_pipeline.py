"""The corpus pipeline: five stages, each over all that the one before kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireloom.llm import bpe, common, minhash, mixing, secrets, toxicity

#: Not expressible in SQL as a whole: a fitted classifier, XXH64 and BPE.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxic probability is above the threshold go; all others, empty ones too, stay as they are."""
    chain = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    (out,) = common.free_names(docs, "toxicity")
    scored = toxicity.classify(docs, chain, out=out)
    limit = chain.thresholds[chain.names.index("toxic")]
    return scored.where(F.col(out)["toxic"] <= limit).drop(out)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five-word shingles of Jaccard similarity 0.8 or more) one row stays: that of the smallest id.

    Rows are told apart by all their columns, so null and repeated ids with different texts stay. No id comes after every id.
    """
    keyed = docs.withColumns({"__r1": F.xxhash64(F.lit(1), *docs.columns), "__r2": F.xxhash64(F.lit(2), *docs.columns)})
    rows = keyed.select(F.col("__r1").alias("r1"), F.col("__r2").alias("r2"), F.col("doc_id").cast("long").alias("id"), "text")
    found = minhash.components(rows)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "r1", "r2")).alias("x"))
    kept = best.select(F.col("x.r1").alias("__r1"), F.col("x.r2").alias("__r2"))
    return keyed.join(kept, ["__r1", "__r2"], "left_semi").dropDuplicates(["__r1", "__r2"]).select(docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mark, and n_chars follows; no document goes."""
    ledger = secrets.ingest([docs], common.shared_path(spark, "secret-ledger"))
    blob, found = common.free_names(docs, "blob", "found")
    hits = secrets.by_blob(ledger).withColumnsRenamed({"blob": blob, "found": found})
    rows = docs.withColumn(blob, secrets.address("text")).join(hits, blob, "left")
    text = secrets.redact(F.col("text"), F.coalesce(found, F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")))
    size = F.when(F.col(found).isNull(), F.col("n_chars")).otherwise(F.length("text"))
    done = rows.withColumn("text", text)
    return done.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix takes them; a document may be repeated, or have no place. Those without words stay once.

    Rows are told apart by a hash of all their columns; the queues' order goes by it, too.
    """
    row, times = common.free_names(docs, "row", "times")
    keyed = docs.withColumn(row, F.xxhash64(*docs.columns))
    mixed, _ = mixing.mix(keyed, key=row, whole=True)
    taken = mixed.groupBy(F.col("id").alias(row)).agg(F.max("times").alias(times)).where(F.col(times) > 0)
    return keyed.join(common.written(taken, "times"), row).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token count and the digests of its ids and of the decoded bytes."""
    return bpe.digests(docs, bpe.rank_file())


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("secret_scans", secret_stage),
    ("mixing_sources", mixing_stage),
    ("byte_level_bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = common.shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            common.remove(spark, before)
        before = path
    return docs
