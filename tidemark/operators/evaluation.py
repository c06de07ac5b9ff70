"""Rolling-origin windows, reference forecasts, scores and boards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions import numeric as num
from tidemark.operators.panel import by_series
from tidemark.sources.tracks import KEYS

Q = list(num.QUANTILE_NAMES)
SPLITS = {"train_end": "1998-12-31", "val": ("1999-01-01", "1999-12-31"), "test": ("2000-01-01", "2001-06-30")}


# --- windows ------------------------------------------------------------------------------------------------------


def windows(series: DataFrame, start: str, end: str, horizon: int = 30, stride: int = 7, min_history: int = 365) -> DataFrame:
    """Origins of a densified panel at which every target day is observed and the history is long enough.

    ``ctx_obs_frac_365`` is the observed part of the last 365 rows, over 365 also where the history is shorter.
    """
    w = by_series()
    ahead = w.rowsBetween(1, horizon)
    seen = series.withColumns({
        "_n": F.count("y").over(ahead), "_rows": F.count("*").over(ahead), "_ctx": F.count("y").over(w.rowsBetween(-364, 0)),
        "_first": F.min(F.when(F.col("y").isNotNull(), F.col("date"))).over(Window.partitionBy(*KEYS)),
    })
    grid = F.array_contains(cal.origins(start, end, horizon, stride), F.col("date"))
    full = (F.col("_rows") == horizon) & (F.col("_n") == horizon) & (F.datediff("date", "_first") >= min_history)
    return seen.where(grid & full).select(*KEYS, F.col("date").alias("origin"), F.bround(F.col("_ctx") / 365.0, 4).alias("ctx_obs_frac_365"))


def numbered(windows: DataFrame, offset: int = 0) -> DataFrame:
    """Ids in the order of track, series, variable and origin: the place inside the series after the windows of the series before it."""
    sizes = windows.groupBy(*KEYS).agg(F.count("*").alias("_n"))
    # one row for each series, in one task
    before = F.sum("_n").over(Window.orderBy("track", "series_id", "var").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*KEYS, F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*KEYS).orderBy("origin"))
    return windows.join(starts, KEYS).withColumn("window_id", F.col("_before") + own - 1 + offset).drop("_before")


def check_windows(windows: DataFrame, start: str, end: str, horizon: int) -> None:
    """ValueError for a target outside the split or a key that occurs twice."""
    out = windows.agg(
        F.sum(((F.date_add("origin", 1) < F.lit(start).cast("date")) | (F.date_add("origin", horizon) > F.lit(end).cast("date"))).cast("int")).alias("outside"),
        (F.count("*") - F.countDistinct(*KEYS, "origin")).alias("twice"),
    ).first()
    if out["outside"]:
        raise ValueError(f"{out['outside']} windows have targets outside the split")
    if out["twice"]:
        raise ValueError(f"{out['twice']} windows occur twice")


def contexts(series: DataFrame, windows: DataFrame, length: int) -> DataFrame:
    """As-of slices: the last ``length`` rows up to each origin, as ``context`` in order of date, nulls for gaps.

    A series is one array (a row a day, so the calendar bounds it) that its windows take their slices from; windows whose origin isn't a
    row of the series get none.
    """
    rows = series.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("date", "y"))).alias("_r"))
    rows = rows.select(*KEYS, F.col("_r.date").alias("_d"), F.col("_r.y").alias("_y"))
    at = windows.select(*KEYS, "origin").join(rows, KEYS).withColumn("_p", F.array_position("_d", F.col("origin")).cast("int")).where("_p > 0")
    return at.select(*KEYS, "origin", F.slice("_y", F.greatest(F.col("_p") - length, F.lit(0)) + 1, F.least(F.col("_p"), F.lit(length))).alias("context"))


def targets(windows: DataFrame, horizon: int) -> DataFrame:
    """One row for each window and lead."""
    return windows.withColumn("lead", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("date", F.date_add("origin", F.col("lead")))


# --- reference forecasts ------------------------------------------------------------------------------------------


def _quantiles(value: str | Column) -> Column:
    return F.percentile(value, F.array(*map(F.lit, num.QUANTILES)))


def _spread(array: str | Column, base: Column | None = None, minus_median: bool = False) -> list[Column]:
    a = F.col(array) if isinstance(array, str) else array
    base = F.lit(0.0) if base is None else base
    return [(base + a[i] - (a[4] if minus_median else F.lit(0.0))).alias(n) for i, n in enumerate(Q)]


def climatology_table(series: DataFrame, train_end: str, half: int = 15) -> DataFrame:
    """``(keys, doy, mean, q)``: all training values within ``half`` days of a day on the 365-day ring.

    Every value goes to the days that it counts for, so this is an equi-aggregation and no range join.
    """
    train = series.where((F.col("date") <= F.lit(train_end).cast("date")) & F.col("y").isNotNull())
    spread = train.select(*KEYS, "y", F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("o"), cal.ring_day("date").alias("r"))
    at = (F.pmod(F.col("r") - 1 + F.col("o"), F.lit(cal.RING)) + 1).alias("doy")
    return spread.select(*KEYS, at, "y").groupBy(*KEYS, "doy").agg(F.avg("y").alias("mean"), _quantiles("y").alias("q"))


def finished(rows: DataFrame, non_negative: bool = True) -> DataFrame:
    """Forecast columns clipped at zero if asked and with quantiles in rising order."""
    clip = num.not_below_zero if non_negative else (lambda c: c)
    ordered = num.sorted_quantiles([clip(F.col(f"`{n}`")) for n in Q])
    return rows.withColumns({"mean": clip(F.col("mean")), **dict(zip(Q, ordered))})


FORECAST = [*KEYS, "origin", "lead", "mean", *(f"`{n}`" for n in Q)]


def climatology(series: DataFrame, windows: DataFrame, train_end: str, horizon: int, half: int = 15, non_negative: bool = True) -> DataFrame:
    table = climatology_table(series, train_end, half)
    asked = targets(windows, horizon).withColumn("doy", cal.ring_day("date"))
    return finished(asked.join(table, [*KEYS, "doy"]).select(*KEYS, "origin", "lead", "mean", *_spread("q")), non_negative).select(*FORECAST)


def seasonal_naive(series: DataFrame, windows: DataFrame, train_end: str, horizon: int, non_negative: bool = True) -> DataFrame:
    """The value 365 days before the target, the climatological mean where that is missing; spread of the training differences."""
    train = series.where(F.col("date") <= F.lit(train_end).cast("date"))
    change = train.withColumn("r", F.col("y") - F.lag("y", 365).over(by_series())).where("r is not null")
    spread = change.groupBy(*KEYS).agg(_quantiles("r").alias("q"))
    means = climatology_table(series, train_end).select(*KEYS, "doy", F.col("mean").alias("usual"))
    past = series.select(*KEYS, F.date_add("date", 365).alias("date"), F.col("date").alias("source"), F.col("y").alias("past"))
    asked = targets(windows, horizon).withColumn("doy", cal.ring_day("date"))
    joined = asked.join(past, [*KEYS, "date"], "left").join(means, [*KEYS, "doy"], "left").join(spread, KEYS, "left")
    base = F.coalesce(F.when(F.col("source") <= F.col("origin"), F.col("past")), F.col("usual"))
    flat = F.coalesce("q", F.array_repeat(F.lit(0.0), 9))
    return finished(joined.select(*KEYS, "origin", "lead", base.alias("mean"), *_spread(flat, base, True)), non_negative).select(*FORECAST)


def persistence(series: DataFrame, windows: DataFrame, train_end: str, horizon: int, non_negative: bool = True) -> DataFrame:
    """The last observed value, the training mean without one; spread of the training changes over as many days."""
    train = series.where(F.col("date") <= F.lit(train_end).cast("date"))
    ahead = train.withColumn("_n", F.array(*(F.lead("y", h).over(by_series()) for h in range(1, horizon + 1))))
    later = ahead.select(*KEYS, F.col("y").alias("a"), F.posexplode("_n").alias("h", "b"))
    spread = later.where("a is not null and b is not null").groupBy(*KEYS, (F.col("h") + 1).alias("lead")).agg(_quantiles(F.col("b") - F.col("a")).alias("q"))
    known = series.withColumn("last", F.last("y", ignorenulls=True).over(by_series().rowsBetween(Window.unboundedPreceding, 0))).select(*KEYS, F.col("date").alias("origin"), "last")
    fallback = train.groupBy(*KEYS).agg(F.avg("y").alias("usual"))
    joined = targets(windows, horizon).join(known, [*KEYS, "origin"], "left").join(fallback, KEYS, "left").join(spread, [*KEYS, "lead"], "left")
    base = F.coalesce("last", "usual")
    flat = F.coalesce("q", F.array_repeat(F.lit(0.0), 9))
    return finished(joined.select(*KEYS, "origin", "lead", base.alias("mean"), *_spread(flat, base, True)), non_negative).select(*FORECAST)


MODELS = {"climatology": climatology, "seasonal_naive": seasonal_naive, "persistence": persistence}


# --- scores -------------------------------------------------------------------------------------------------------


def train_scales(series: DataFrame, train_end: str, season: int = 365) -> DataFrame:
    """``(keys, scale)``: the mean absolute change over ``season`` rows of the training part, over complete pairs."""
    train = series.where(F.col("date") <= F.lit(train_end).cast("date"))
    change = F.abs(F.col("y") - F.lag("y", season).over(by_series()))
    return train.withColumn("_c", change).groupBy(*KEYS).agg(F.avg("_c").alias("scale"))


def scored(forecasts: DataFrame, series: DataFrame, scales: DataFrame) -> DataFrame:
    """A row for each forecast with the observed ``y`` and its losses: absolute errors by the median, squared ones by the mean."""
    actual = series.where("y is not null").select(*KEYS, "date", "y")
    joined = forecasts.withColumn("date", F.date_add("origin", F.col("lead"))).join(actual, [*KEYS, "date"]).join(scales, KEYS, "left")
    y, scale = F.col("y"), F.col("scale")
    rows = joined.withColumns({
        "abs_err": F.abs(y - F.col("`q0.5`")), "sq_err": (y - F.col("mean")) ** 2, "crps": num.crps(y, [F.col(f"`{n}`") for n in Q]),
        "hit80": y.between(F.col("`q0.1`"), F.col("`q0.9`")),
    })
    return rows.withColumns({"ase": F.try_divide("abs_err", scale), "scaled_crps": F.try_divide("crps", scale)})


def board(scores: DataFrame, by: list[str]) -> DataFrame:
    return scores.groupBy(*by).agg(
        F.avg("ase").alias("MASE"), F.avg("scaled_crps").alias("sCRPS"), F.sqrt(F.avg("sq_err")).alias("RMSE"),
        F.avg(F.col("hit80").cast("int")).alias("coverage80"), F.countDistinct(*[c for c in ("track", "var", "series_id", "origin") if c in scores.columns]).alias("n_windows"),
    )


def common_windows(forecasts: DataFrame) -> DataFrame:
    """Only the windows that every model of the same track and variable has."""
    keys = [*KEYS, "origin"]
    models = forecasts.groupBy("track", "var").agg(F.countDistinct("model").alias("_all"))
    have = forecasts.groupBy(*keys).agg(F.countDistinct("model").alias("_n"))
    full = have.join(models, ["track", "var"]).where("_n = _all").select(*keys)
    return forecasts.join(full, keys, "left_semi")


def with_skill(boards: DataFrame, by: list[str], reference: str = "climatology") -> DataFrame:
    """Skill against the reference model's row with the same ``by``."""
    base = boards.where(F.col("model") == reference).select(*by, F.col("MASE").alias("_m"), F.col("sCRPS").alias("_c"))
    return boards.join(base, by, "left").withColumns({"skill_MAE_vs_clim": num.skill(F.col("MASE"), F.col("_m")), "CRPSS_vs_clim": num.skill(F.col("sCRPS"), F.col("_c"))}).drop("_m", "_c")


def all_forecasts(series: DataFrame, windows: DataFrame, train_end: str, horizon: int, models: tuple[str, ...] = tuple(MODELS)) -> DataFrame:
    return reduce(DataFrame.unionByName, [MODELS[m](series, windows, train_end, horizon).withColumn("model", F.lit(m)) for m in models])


def integrity(forecasts: DataFrame, windows: DataFrame, horizon: int, non_negative: bool = True) -> DataFrame:
    """One row for each rule ``(rule, violations)``: row count, missing and foreign windows, leads, nulls, order and sign."""
    keys = [*KEYS, "origin"]
    q = [F.col(f"`{n}`") for n in Q]
    none = reduce(lambda a, b: a | b, [c.isNull() for c in [F.col("mean"), *q]])
    falls = reduce(lambda a, b: a | b, [F.coalesce(b_ < a_ - 1e-6, F.lit(False)) for a_, b_ in zip(q, q[1:])])
    below = reduce(lambda a, b: a | b, [F.coalesce(c < 0, F.lit(False)) for c in [F.col("mean"), *q]]) if non_negative else F.lit(False)
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    rows = forecasts.agg(F.count("*").alias("rows"), n(none).alias("missing_values"), n(falls).alias("not_monotone"), n(below).alias("negative"))
    wanted = windows.agg((F.count("*") * horizon).alias("wanted"))
    per = forecasts.groupBy(*keys).agg(F.count("*").alias("k"), F.countDistinct("lead").alias("d"), F.min("lead").alias("a"), F.max("lead").alias("b"))
    leads = per.agg(n((F.col("k") != horizon) | (F.col("d") != horizon) | (F.col("a") != 1) | (F.col("b") != horizon)).alias("bad_leads"))
    absent = windows.join(forecasts, keys, "left_anti").agg(F.count("*").alias("absent_windows"))
    foreign = forecasts.join(windows, keys, "left_anti").agg(F.count("*").alias("foreign_rows"))
    # six frames of one row each
    one = rows.crossJoin(wanted).crossJoin(leads).crossJoin(absent).crossJoin(foreign).withColumn("row_count", F.abs(F.col("rows") - F.col("wanted")))
    rules = ["row_count", "absent_windows", "foreign_rows", "bad_leads", "missing_values", "not_monotone", "negative"]
    return one.unpivot([], rules, "rule", "violations")


# --- ten-day series -----------------------------------------------------------------------------------------------


def positioned(dekads: DataFrame) -> DataFrame:
    return dekads.withColumn("pos", F.row_number().over(by_series()) - 1)


def dekad_windows(dekads: DataFrame, start: str, end: str, horizon: int = 6, stride: int = 1, min_history: int = 36) -> DataFrame:
    """Windows by row position: ``(keys, origin, origin_pos)``; targets are complete and inside the split."""
    w = by_series()
    ahead = w.rowsBetween(1, horizon)
    seen = positioned(dekads).withColumns({"_n": F.count("y").over(ahead), "_a": F.lead("date", 1).over(w), "_b": F.lead("date", horizon).over(w)})
    inside = (F.col("_a") >= F.lit(start).cast("date")) & (F.col("_b") <= F.lit(end).cast("date"))
    stepped = (F.col("pos") >= min_history - 1) & ((F.col("pos") - (min_history - 1)) % stride == 0)
    return seen.where(inside & stepped & (F.col("_n") == horizon)).select(*KEYS, F.col("date").alias("origin"), F.col("pos").alias("origin_pos"))


def dekad_climatology_table(dekads: DataFrame, train_end: str) -> DataFrame:
    train = dekads.where((F.col("date") <= F.lit(train_end).cast("date")) & F.col("y").isNotNull())
    return train.groupBy(*KEYS, cal.dekad_of_year("date").alias("doy")).agg(F.avg("y").alias("mean"), _quantiles("y").alias("q"))


def _dekad_targets(dekads: DataFrame, windows: DataFrame, horizon: int) -> DataFrame:
    dates = positioned(dekads).select(*KEYS, "pos", "date")
    return windows.withColumn("lead", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("pos", F.col("origin_pos") + F.col("lead")).join(dates, [*KEYS, "pos"])


def dekad_climatology(dekads: DataFrame, windows: DataFrame, train_end: str, horizon: int = 6) -> DataFrame:
    asked = _dekad_targets(dekads, windows, horizon).withColumn("doy", cal.dekad_of_year("date"))
    return finished(asked.join(dekad_climatology_table(dekads, train_end), [*KEYS, "doy"]).select(*KEYS, "origin", "lead", "mean", *_spread("q"))).select(*FORECAST)


def dekad_seasonal_naive(dekads: DataFrame, windows: DataFrame, train_end: str, horizon: int = 6) -> DataFrame:
    """The value 36 rows before the target; never below zero."""
    train = dekads.where(F.col("date") <= F.lit(train_end).cast("date"))
    change = train.withColumn("r", F.col("y") - F.lag("y", 36).over(by_series())).where("r is not null")
    spread = change.groupBy(*KEYS).agg(_quantiles("r").alias("q"))
    usual = dekad_climatology_table(dekads, train_end).select(*KEYS, "doy", F.col("mean").alias("usual"))
    past = positioned(dekads).select(*KEYS, (F.col("pos") + 36).alias("pos"), F.col("y").alias("past"))
    asked = _dekad_targets(dekads, windows, horizon).withColumn("doy", cal.dekad_of_year("date"))
    joined = asked.join(past, [*KEYS, "pos"], "left").join(usual, [*KEYS, "doy"], "left").join(spread, KEYS, "left")
    base = F.coalesce("past", "usual")
    flat = F.coalesce("q", F.array_repeat(F.lit(0.0), 9))
    return finished(joined.select(*KEYS, "origin", "lead", base.alias("mean"), *_spread(flat, base, True))).select(*FORECAST)


def dekad_persistence(dekads: DataFrame, windows: DataFrame, train_end: str, horizon: int = 6) -> DataFrame:
    return persistence(dekads, windows, train_end, horizon)


DEKAD_MODELS = {"climatology": dekad_climatology, "seasonal_naive": dekad_seasonal_naive, "persistence": dekad_persistence}


def dekad_scored(forecasts: DataFrame, dekads: DataFrame, train_end: str) -> DataFrame:
    scales = train_scales(dekads, train_end, 36)
    actual = positioned(dekads)
    asked = forecasts.join(actual.select(*KEYS, F.col("date").alias("origin"), F.col("pos").alias("_o")), [*KEYS, "origin"]).withColumn("pos", F.col("_o") + F.col("lead"))
    joined = asked.join(actual.where("y is not null").select(*KEYS, "pos", "y"), [*KEYS, "pos"]).join(scales, KEYS, "left")
    y = F.col("y")
    rows = joined.withColumns({"abs_err": F.abs(y - F.col("`q0.5`")), "sq_err": (y - F.col("mean")) ** 2, "crps": num.crps(y, [F.col(f"`{n}`") for n in Q]), "hit80": y.between(F.col("`q0.1`"), F.col("`q0.9`"))})
    return rows.withColumns({"ase": F.try_divide("abs_err", "scale"), "scaled_crps": F.try_divide("crps", "scale")}).drop("_o", "pos")
