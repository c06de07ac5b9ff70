"""Tracks: named collections of series over the input tables, as long frames ``(track, var, series_id, date, y)``.

A track aggregates to days before anything else, so all that follows works on as many rows as there are series and days.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.session import kept

KEYS = ["track", "var", "series_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_sum(c: str) -> Column:
    """A sum of money or quantities that doesn't depend on the order of its terms."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def unpivoted(wide: DataFrame, track: str, variables: list[str]) -> DataFrame:
    """One row for each variable of a wide daily panel ``(series_id, date, variables ...)``."""
    return wide.unpivot(["series_id", "date"], variables, "var", "y").select(F.lit(track).alias("track"), "var", "series_id", "date", "y")


def ship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipped quantity and price a day, by return flag and line status."""
    lines = table(spark, sf_dir, "lineitem")
    day = lines.groupBy(F.concat("l_returnflag", "l_linestatus").alias("series_id"), F.to_date("l_shipdate").alias("date"))
    return unpivoted(day.agg(exact_sum("l_quantity").alias("qty"), exact_sum("l_extendedprice").alias("price")), "ship", ["qty", "price"])


def ship_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All shipped quantity a day."""
    lines = table(spark, sf_dir, "lineitem")
    day = lines.groupBy(F.lit("all").alias("series_id"), F.to_date("l_shipdate").alias("date")).agg(exact_sum("l_quantity").alias("qty"))
    return unpivoted(day, "ship_all", ["qty"])


def ship_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipped quantity a day, by line status."""
    lines = table(spark, sf_dir, "lineitem")
    day = lines.groupBy(F.col("l_linestatus").alias("series_id"), F.to_date("l_shipdate").alias("date")).agg(exact_sum("l_quantity").alias("qty"))
    return unpivoted(day, "ship_status", ["qty"])


def orders_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value and count a day, by region of the customer."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("date"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # 25 nations and 5 regions, fixed by the schema
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    placed = orders.join(customers, orders.o_custkey == customers.c_custkey).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    day = placed.groupBy(F.col("r_name").alias("series_id"), "date").agg(exact_sum("o_totalprice").alias("sales"), F.count("*").cast("double").alias("n"))
    return unpivoted(day, "orders_region", ["sales", "n"])


def orders_dekad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value by ten-day period (from days 1, 11 and 21) and region."""
    days = orders_region(spark, sf_dir).where("var = 'sales'")
    grouped = days.groupBy("var", "series_id", cal.dekad_start("date").alias("date"))
    return grouped.agg(F.sum(F.col("y").cast("decimal(18,2)")).cast("double").alias("y")).select(F.lit("orders_dekad").alias("track"), "var", "series_id", "date", "y")


def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event value a day, by event type."""
    day = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series_id"), F.to_date("ts").alias("date")).agg(exact_sum("value").alias("value"))
    return unpivoted(day, "events_daily", ["value"])


TRACKS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ship": ship, "ship_all": ship_all, "ship_status": ship_status, "orders_region": orders_region, "orders_dekad": orders_dekad, "events_daily": events_daily,
}


def load_track(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A track's observations; an unknown name is a KeyError."""
    if name not in TRACKS:
        raise KeyError(f"unknown track {name!r}; there are {', '.join(sorted(TRACKS))}")
    return TRACKS[name](spark, sf_dir)


def densified(observed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Every day between a series' first and last row; ``y`` is null where there was none."""
    keys = keys or KEYS
    days = observed.groupBy(*keys).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    spine = days.select(*keys, F.explode(F.sequence("a", "b")).alias("date"))
    return spine.join(observed, [*keys, "date"], "left")


def series(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A track on its calendar, kept: it has a row for each series and day, however large its source."""
    return kept(spark, ("series", sf_dir, name), lambda: densified(load_track(spark, sf_dir, name)))
