"""A corpus pipeline: language ID, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but the
last return the columns of documents. ``run`` writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontamination, language, minhash, mixing, sharding
from quarry.llm.common import ranked, scratch, staged, table, without

#: A document whose best language has less than this share of the evidence is rejected.
SURE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a language: null or letterless texts, and those whose evidence favours none."""
    row = F.xxhash64(docs["doc_id"], docs["text"])
    model = language.train(docs)
    found = language.identify(docs.withColumn("__row", row), model, "__row", "text", host_col="source", declared_col="lang")
    unsure = found.where((F.col("confidence") < SURE) | (F.col("n_trigrams") == 0) | F.col("lang").isNull())
    return without(docs, row, unsure.select("row_id"), "pipeline-unsure")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates, the one of the smallest id. Rows that share an id and not their texts are documents of their own."""
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        found = minhash.near_duplicates(docs)
        return without(docs, docs["doc_id"], found.where(~F.col("kept")).select("doc_id"), "pipeline-copies")
    # Numbers in the order of ids stand for them, one for each id and text.
    text_hash = F.xxhash64("doc_id", "text")
    pairs = docs.where("doc_id is not null").select("doc_id", text_hash.alias("__hash")).groupBy("doc_id", "__hash").agg(F.count("*").alias("__n"))
    numbers = ranked(pairs, [F.col("doc_id"), F.col("__hash")], "pipeline-ids")[0].select(F.col("doc_id").alias("__id"), F.col("__hash"), F.col("__n"), F.col("global_row").alias("__number"))
    numbered = staged(docs.join(numbers, (docs["doc_id"] == numbers["__id"]) & (text_hash == numbers["__hash"]), "left").drop("__id", "__hash"), "pipeline-numbered")
    found = minhash.near_duplicates(numbered, id_col="__number")
    kept = without(numbered, numbered["__number"], found.where(~F.col("kept")).select("doc_id"), "pipeline-copies")
    # Rows alike in id and text: one of them, drawn by its other columns.
    columns = F.struct(*docs.columns)
    twice = kept.where("__n > 1").groupBy("__number").agg(F.min_by(columns, F.xxhash64(*docs.columns)).alias("row")).select("row.*")
    return kept.where("__n is null or __n = 1").select(docs.columns).unionByName(twice.select(docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    found = decontamination.all_leaks(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, docs["doc_id"], found.select("doc_id"), "pipeline-leaks")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix says: not at all, once or twice."""
    taken = mixing.mix(docs).groupBy("doc_id", "text_hash").agg(F.max("copies").alias("__copies"))
    taken = taken.where("__copies > 0").toDF("__id", "__hash", "__copies")
    joined = docs.join(taken, docs["doc_id"].eqNullSafe(taken["__id"]) & (F.xxhash64(docs["doc_id"], docs["text"]) == taken["__hash"]))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(docs.columns)


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row."""
    return sharding.shard(docs, n_shards=24)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard_documents),
]

#: SQL can't express the trained models and hashes; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # what a stage staged on its way goes when its result is written
            docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
