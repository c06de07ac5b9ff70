"""Strata: smoothed climatologies, active and break spells, extremes and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import haversine_km
from tidemark.operators.panel import by_series, circular_mean, event_ids, interpolated, runs_at_least


def daily_climatology(rows: DataFrame, train_end: str, keys: list[str], half: int = 15) -> DataFrame:
    """``(keys, doy, smooth)`` for days 1 to 366: training means, interpolated, then a circular mean of 31 days."""
    means = rows.where(F.col("date") <= F.lit(train_end).cast("date")).groupBy(*keys, F.dayofyear("date").alias("doy")).agg(F.avg("y").alias("m"))
    spine = rows.select(*keys).distinct().withColumn("doy", F.explode(F.sequence(F.lit(1), F.lit(366))))
    full = spine.join(means, [*keys, "doy"], "left").withColumnRenamed("doy", "date")
    filled = interpolated(full, "m", "f", keys).withColumnRenamed("date", "doy")
    return circular_mean(filled, "doy", "f", 366, half, keys).select(*keys, "doy", "smooth")


def spells(rows: DataFrame, train_end: str, keys: list[str], threshold: float = 0.5, least: int = 3) -> DataFrame:
    """``spell`` of each day: 'active' or 'break' in July and August where the anomaly, in standard deviations of that
    year's July and August, is beyond the threshold for ``least`` days or more; other observed days there are 'normal'."""
    usual = daily_climatology(rows, train_end, keys)
    season = F.month("date").isin(7, 8)
    anomaly = F.when(season, F.col("y") - F.col("smooth"))
    joined = rows.withColumn("doy", F.dayofyear("date")).join(usual, [*keys, "doy"], "left").withColumn("_a", anomaly)
    sd = F.stddev_samp("_a").over(Window.partitionBy(*keys, F.year("date")))
    scored = joined.withColumn("_sd", sd).withColumn("_z", F.when(F.col("_sd") > 0, F.col("_a") / F.col("_sd")))
    scored = scored.withColumn("_up", F.col("_z") >= threshold).withColumn("_down", F.col("_z") <= -threshold)
    scored = runs_at_least(runs_at_least(scored, "_up", least, "_active", keys), "_down", least, "_break", keys)
    spell = F.when(F.col("_z").isNull(), "").when(F.col("_active"), "active").when(F.col("_break"), "break").otherwise("normal")
    return scored.select(*keys, "date", "y", spell.alias("spell"))


def national(rows: DataFrame, least: int) -> DataFrame:
    """``(date, y, n)``: the mean over series on days when at least ``least`` of them report."""
    day = rows.groupBy("date").agg(F.avg("y").alias("m"), F.count("y").alias("n"))
    return day.select("date", F.when(F.col("n") >= least, F.col("m")).alias("y"), "n")


def thresholds(rows: DataFrame, train_end: str, keys: list[str], wet: float = 1.0) -> DataFrame:
    """``(keys, month, p95, p99, hot, cold)`` of the training part: percentiles of the values of ``wet`` or more, and of each month."""
    train = rows.where(F.col("date") <= F.lit(train_end).cast("date"))
    whole = train.where(F.col("y") >= wet).groupBy(*keys).agg(F.percentile("y", 0.95).alias("p95"), F.percentile("y", 0.99).alias("p99"))
    month = train.groupBy(*keys, F.month("date").alias("month")).agg(F.percentile("y", 0.95).alias("hot"), F.percentile("y", 0.05).alias("cold"))
    return month.join(whole, keys, "left")


def extremes(rows: DataFrame, limits: DataFrame, keys: list[str]) -> DataFrame:
    """Flags against the thresholds; a missing value or threshold is no extreme."""
    joined = rows.withColumn("month", F.month("date")).join(limits, [*keys, "month"], "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    y = F.col("y")
    return joined.select(*keys, "date", flag(y >= F.col("p95")).alias("heavy"), flag(y >= F.col("p99")).alias("very_heavy"), flag(y > F.col("hot")).alias("hot"), flag(y < F.col("cold")).alias("cold"))


def near_tracks(points: DataFrame, stations: DataFrame, radius_km: float = 300.0, least_wind: float = 34.0) -> DataFrame:
    """Station-days within ``radius_km`` of a storm: first id, least distance and greatest wind.

    Points are first cut into one-degree latitude bands, and a station looks into the bands that its radius reaches, so
    this is an equi-join with a distance filter and no comparison of all with all.
    """
    reach = int(radius_km / 111.0) + 1
    strong = points.where(F.col("wind") >= least_wind).withColumn("band", F.floor("lat").cast("int"))
    around = stations.select("station", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), F.explode(F.sequence(F.floor("lat").cast("int") - reach, F.floor("lat").cast("int") + reach)).alias("band"))
    pairs = strong.join(around, "band").withColumn("km", haversine_km(F.col("s_lat"), F.col("s_lon"), F.col("lat"), F.col("lon"))).where(F.col("km") <= radius_km)
    return pairs.groupBy("station", "date").agg(F.min("sid").alias("sid"), F.min("km").alias("min_dist_km"), F.max("wind").alias("max_wind"))


def events(days: DataFrame, label: str = "spell") -> DataFrame:
    """``(event, label, first, last, days)`` of stretches of equal labels over the dates of one series."""
    order = Window.partitionBy(F.lit(0)).orderBy("date")  # one row a day
    numbered = days.withColumn("event", event_ids(label, order))
    return numbered.groupBy("event", label).agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("days"))


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Ray casting against one closed ring of fixed points."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        if y1 != y2:
            hit = (F.lit(y1) > y) != (F.lit(y2) > y)
            crossings = crossings + (hit & (x < F.lit((x2 - x1) / (y2 - y1)) * (y - y1) + x1)).cast("int")
    return crossings % 2 == 1


def ring_distance(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Planar distance to a ring's nearest edge."""
    edges = []
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        dx, dy = x2 - x1, y2 - y1
        length = dx * dx + dy * dy or 1.0
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / length))
        edges.append(F.sqrt((x - (x1 + t * dx)) ** 2 + (y - (y1 + t * dy)) ** 2))
    return F.least(*edges) if len(edges) > 1 else edges[0]


def located(points: DataFrame, polygons: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """Each point's polygon: the first that holds it, else the nearest, with the distance to it.

    Polygons are compiled into the expression, so points are scanned once and nothing is joined.
    """
    x, y = F.col("x"), F.col("y")
    options = F.array(*(F.struct(F.when(in_polygon(x, y, r), 0.0).otherwise(ring_distance(x, y, r)).alias("d"), F.lit(n).alias("n")) for n, r in sorted(polygons.items())))
    best = F.array_min(options)
    return points.withColumns({"polygon": best["n"], "dist": best["d"], "matched": F.when(best["d"] == 0, "within").otherwise("nearest")})
