"""What several training-data operators share: table access, shared storage and connected components."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one in ``spark.checkpoint.dir``. Only where that is unset and the master is local (tests on one machine) a
    temporary folder is made and set; a cluster without the setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialised(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """Write a frame as a Parquet table into the shared folder and read it back, which cuts its lineage."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def spread_join(rows: DataFrame, known: DataFrame, key: str, count: str, parts: int = 512) -> DataFrame:
    """Left join of ``rows`` with ``known`` on ``key``, where one value may be held by a third of all rows.

    ``known`` is a written table with one row for each value and, in ``count``, how many rows hold it. Values with more than a
    ``parts``-th of the counted rows are fewer than ``parts``, so they are broadcast; their rows pass through the shuffled join
    under a key of their own, spread by a hash. The key is never null; ``count`` is not in the result.
    """
    total = known.agg(F.sum(count)).first()[0] or 0
    given = F.struct(*(c for c in known.columns if c not in (key, count)))
    hot = known.where(F.col(count) * parts > total).select(key, given.alias("_hot"))
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(8 * parts)).cast("string")
    marked = rows.join(F.broadcast(hot), key, "left")
    marked = marked.withColumn("_at", F.when(F.col("_hot").isNull(), F.array(key)).otherwise(F.array(F.col(key), salt)))
    usual = known.select(F.array(key).alias("_at"), given.alias("_usual"))
    return marked.join(usual, "_at", "left").select(*(F.col(c) for c in rows.columns), F.coalesce("_hot", "_usual").alias("_given")).select(*rows.columns, "_given.*")


def whole_text(name: str = "text"):
    """The text column with null taken as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row; an expression named inside a lambda would be computed at each step."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, step: Callable[[Column, Column], Column], block: int = 128) -> Column:
    """For each of an ``array<int>`` what ``step`` makes of all before it, from 0; in blocks, as arrays grow by copying."""
    none = F.array().cast("array<int>")

    def scan(part: Column, start: Column) -> Column:
        grow = lambda s, x: F.struct(step(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(part, F.struct(start.alias("at"), none.alias("out")), grow)["out"]

    def blocks(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / block).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(v, b * block + 1, F.lit(block)))

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), step))
        return let(scan(totals, F.lit(0)), lambda heads: F.flatten(F.transform(parts, lambda p, i: scan(p, F.get(heads, i)))))

    return let(values, lambda v: F.when(F.size(v) > 0, let(blocks(v), joined)).otherwise(none))


def components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(u, v)`` by alternating large-star and small-star steps.

    Returns ``(node, root)`` with the smallest reachable id as root, for every node that has an edge to another one.
    Each step is an aggregation followed by an equi-join on the same key, so a node with very many neighbours is
    pre-aggregated on the map side and its join side can be split by adaptive execution. Every round ends in a
    ``checkpoint()`` on the shared folder, so the lineage stays short and lost executors cost one round at most.
    """
    shared_dir(spark)
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    seen = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is tied to the least of u's neighbourhood
        both = now.select(F.col("u").alias("a"), F.col("v").alias("b")).union(now.select("v", "u"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours are tied to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = tied.union(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        state = now.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h"),
        ).first()
        if (state["n"], state["h"]) == seen:
            break
        seen = (state["n"], state["h"])
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
