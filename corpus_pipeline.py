"""The corpus pipeline: toxic documents go, near-duplicates go, personal data is redacted, sources are mixed, texts are encoded.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept; ``run`` writes every stage's
result as Parquet and gives it to the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, copies, mixing, pii, toxicity
from tidemark.llm.common import materialised, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the toxicity model, fitted on the labelled ones, scores under a half."""
    model = toxicity.fit(spark, docs, table(spark, sf_dir, "labels"))
    kept = docs.select(*COLUMNS).withColumnRenamed("text", "body").withColumn("text", F.coalesce("body", F.lit("")))
    scored = toxicity.scores(kept, model, passed=("body", "lang", "source", "n_chars"))
    return scored.where("score < 0.5").withColumnRenamed("body", "text").select(*COLUMNS)


def preferred(docs: DataFrame) -> DataFrame:
    """The documents with two words that name a row by its content, and the order in which rows are preferred."""
    k1, k2 = copies.identity(COLUMNS)
    rows = docs.select(*COLUMNS, k1.alias("k1"), k2.alias("k2"))
    return rows.withColumn("order", F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "k1", "k2"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of texts linked by a similarity of 0.8 or more on five-word shingles.

    It is the row with the smallest id, rows with a null id last; of equal rows one stays.
    """
    rows = preferred(docs)
    first = copies.first_rows(spark, rows)
    kept = rows.join(first.where("not repeated"), ["k1", "k2"], "left_semi").select(*COLUMNS)
    repeated = first.where("repeated")
    if repeated.limit(1).count():
        kept = kept.unionByName(rows.join(repeated, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select(*COLUMNS))
    return kept


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind."""
    found = pii.with_spans(docs.select(*COLUMNS), pii.fit(docs))
    text = F.when(F.size("pii_spans") > 0, pii.redacted(F.coalesce("text", F.lit("")), F.col("pii_spans"))).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample to the target weights of source, language and topic."""
    return mixing.sample(spark, docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of the ids and of the text they decode to."""
    return bpe.token_digests(spark, docs, with_ids=True)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("pii", redact), ("mixing", mix), ("encoding", encode)]
#: Training, component search and encoding are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialised(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
