"""A global boosted model: trees over all series and leads of a variable, with intervals from validation residuals.

The learner is Spark's gradient-boosted trees on squared loss. Another learner, round limit or split rule gives other numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import RING, ring_day
from tidemark.operators import evaluation as ev
from tidemark.operators import panel
from tidemark.sources.tracks import KEYS

LAGS = [f"lag_{k}" for k in range(7)]
MEANS = ["mean_7", "mean_30", "mean_90"]
FEATURES = [*LAGS, *MEANS, "observed_30", "lead", "sin", "cos", "usual", "spread", "code"]


def origins(series: DataFrame, train_end: str) -> DataFrame:
    """A row for each day with what is known by then: departures from the training climatology, their means and the observed share.

    A missing departure takes the next longer mean, and zero where the last 90 days have none. ``pos`` counts a series' rows from 0
    and ``code`` the series of its variable.
    """
    table = ev.climatology_table(series, train_end).select(*KEYS, "doy", F.col("mean").alias("usual"))
    away = series.withColumn("doy", ring_day("date")).join(table, [*KEYS, "doy"], "left").select(*KEYS, "date", (F.col("y") - F.col("usual")).alias("y"))
    known = panel.lagged(panel.trailing_means(away)).withColumn("pos", F.row_number().over(panel.by_series()) - 1)
    filled = {c: F.coalesce(c, *[m for m in MEANS if m > c or c in LAGS], F.lit(0.0)) for c in LAGS}
    filled |= {m: F.coalesce(*MEANS[i:], F.lit(0.0)) for i, m in enumerate(MEANS)}
    codes = series.select(*KEYS).distinct()
    codes = codes.withColumn("code", (F.row_number().over(Window.partitionBy("track", "var").orderBy("series_id")) - 1).cast("double"))  # a row for each series
    return known.withColumns(filled).join(codes, KEYS)


def examples(known: DataFrame, series: DataFrame, train_end: str, horizon: int) -> DataFrame:
    """A row for each origin and lead with the features of the target day and its departure, null where it isn't observed."""
    table = ev.climatology_table(series, train_end)
    usual = table.select(*KEYS, "doy", F.col("mean").alias("usual"), (F.element_at("q", -1) - F.col("q")[0]).alias("spread"))
    asked = known.drop("y").withColumn("lead", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    asked = asked.withColumn("target", F.date_add("date", F.col("lead"))).withColumn("doy", ring_day("target"))
    turn = 2 * F.pi() * F.col("doy") / RING
    asked = asked.join(usual, [*KEYS, "doy"]).withColumns({"sin": F.sin(turn), "cos": F.cos(turn)})
    seen = series.select(*KEYS, F.col("date").alias("target"), "y")
    return asked.join(seen, [*KEYS, "target"], "left").withColumn("away", F.col("y") - F.col("usual")).drop("y")


def _between(start: str | None, end: str, horizon: int) -> Column:
    """Origins of a split whose targets all lie in it."""
    last = F.col("date") <= F.date_sub(F.lit(end).cast("date"), horizon)
    return last if start is None else last & (F.col("date") >= F.lit(start).cast("date"))


def forecast(
    series: DataFrame, windows: DataFrame, train_end: str, val_start: str, val_end: str, horizon: int = 30, stride: int = 10, rounds: int = 40, depth: int = 5,
    rate: float = 0.1, non_negative: bool = True, seed: int = 0,
) -> DataFrame:
    """Forecasts with quantiles for ``windows``, from a model of each variable.

    Every ``stride``-th day from the 91st on is an origin to train on; validation origins end the boosting early and give each lead's
    quantiles of residuals, centred on their median. A variable without validation rows gets nothing.
    """
    known = origins(series, train_end)
    spaced = known.where((F.col("pos") >= 90) & (F.col("pos") % stride == 0))
    fit, val = _between(None, train_end, horizon), _between(val_start, val_end, horizon)
    rows = examples(spaced.where(fit | val).withColumn("held", val), series, train_end, horizon).where("away is not null")
    asked = examples(known.join(windows.select(*KEYS, F.col("origin").alias("date")), [*KEYS, "date"]), series, train_end, horizon)
    vector = VectorAssembler(inputCols=FEATURES, outputCol="x")
    learner = GBTRegressor(featuresCol="x", labelCol="away", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, validationIndicatorCol="held")
    parts = []
    for t, v in sorted((r["track"], r["var"]) for r in rows.groupBy("track", "var").agg(F.count_if("held").alias("n")).where("n > 0").collect()):  # one for each variable
        own = (F.col("track") == t) & (F.col("var") == v)
        table = vector.transform(rows.where(own)).select("x", "away", "held", "lead").persist()
        model = learner.fit(table)
        residual = F.col("away") - F.col("prediction")
        spread = model.transform(table.where("held")).groupBy("lead").agg(ev._quantiles(residual).alias("q"))
        guessed = model.transform(vector.transform(asked.where(own))).withColumn("mean", F.col("usual") + F.col("prediction"))
        fan = guessed.join(F.broadcast(spread), "lead")  # a row for each lead
        parts.append(fan.select(*KEYS, F.col("date").alias("origin"), F.col("lead").cast("int").alias("lead"), "mean", *ev._spread("q", F.col("mean"), True)))
    if not parts:
        raise ValueError("no variable has validation rows")
    return ev.finished(reduce(DataFrame.unionByName, parts), non_negative).select(*ev.FORECAST)
