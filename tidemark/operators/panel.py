"""Row-position operators on densified series: runs, gaps, trailing means and differences.

All windows are partitioned by the series, after the panel has been aggregated to days, so a partition is one series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.numeric import is_close
from tidemark.sources.tracks import KEYS


def by_series(keys: list[str] | None = None) -> WindowSpec:
    return Window.partitionBy(*(keys or KEYS)).orderBy("date")


def run_lengths(rows: DataFrame, flag: str, out: str, keys: list[str] | None = None) -> DataFrame:
    """Add to each row the length of the run of true ``flag`` values it belongs to; 0 where the flag is not true."""
    keys = keys or KEYS
    marked = rows.withColumn("_f", F.coalesce(F.col(flag), F.lit(False)))
    same = Window.partitionBy(*keys, "_f").orderBy("date")
    island = F.row_number().over(by_series(keys)) - F.row_number().over(same)
    marked = marked.withColumn("_i", island)
    size = F.count("*").over(Window.partitionBy(*keys, "_f", "_i"))
    return marked.withColumn(out, F.when(F.col("_f"), size).otherwise(0).cast("int")).drop("_f", "_i")


def runs_at_least(rows: DataFrame, flag: str, least: int, out: str, keys: list[str] | None = None) -> DataFrame:
    return run_lengths(rows, flag, "_n", keys).withColumn(out, F.col("_n") >= least).drop("_n")


def run_starts(flag: str, order: WindowSpec) -> Column:
    """Whether a run of true values begins here."""
    f = F.coalesce(F.col(flag), F.lit(False))
    return f & ~F.coalesce(F.lag(f).over(order), F.lit(False))


def event_ids(label: str, order: WindowSpec) -> Column:
    """Number of the stretch of equal labels, from 1; a missing label is the empty one."""
    value = F.coalesce(F.col(label), F.lit(""))
    change = (~value.eqNullSafe(F.lag(value).over(order))).cast("int")
    return F.sum(change).over(order.rowsBetween(Window.unboundedPreceding, 0))


def interpolated(rows: DataFrame, value: str = "y", out: str = "filled", keys: list[str] | None = None, empty: float | None = None) -> DataFrame:
    """Linear interpolation between observed rows, the nearest observed one beyond the ends, ``empty`` for an all-missing series."""
    w = by_series(keys)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    here = F.when(F.col(value).isNotNull(), F.struct(F.col("_p").alias("p"), F.col(value).alias("v")))
    placed = rows.withColumn("_p", F.row_number().over(w)).withColumn("_s", here)
    placed = placed.withColumn("_a", F.last("_s", ignorenulls=True).over(back)).withColumn("_b", F.first("_s", ignorenulls=True).over(ahead))
    a, b = F.col("_a"), F.col("_b")
    between = a["v"] + (b["v"] - a["v"]) * F.coalesce(F.try_divide(F.col("_p") - a["p"], b["p"] - a["p"]), F.lit(0.0))
    return placed.withColumn(out, F.coalesce(between, a["v"], b["v"], F.lit(empty).cast("double"))).drop("_p", "_s", "_a", "_b")


def trimmed(rows: DataFrame, value: str = "y", keys: list[str] | None = None) -> DataFrame:
    """Without leading missing rows; of a series with no observation only the last row stays."""
    keys = keys or KEYS
    whole = Window.partitionBy(*keys)
    first = F.min(F.when(F.col(value).isNotNull(), F.col("date"))).over(whole)
    return rows.withColumn("_a", F.coalesce(first, F.max("date").over(whole))).where("date >= _a").drop("_a")


def trailing_means(rows: DataFrame, value: str = "y", spans: tuple[int, ...] = (7, 30, 90), keys: list[str] | None = None) -> DataFrame:
    """Means of the observed among the last rows of each span, and the observed share of the last 30."""
    w = by_series(keys)
    out = rows.withColumns({f"mean_{n}": F.avg(value).over(w.rowsBetween(-(n - 1), 0)) for n in spans})
    return out.withColumn("observed_30", F.count(value).over(w.rowsBetween(-29, 0)) / 30.0)


def lagged(rows: DataFrame, value: str = "y", lags: range = range(7), keys: list[str] | None = None) -> DataFrame:
    w = by_series(keys)
    return rows.withColumns({f"lag_{k}": F.lag(value, k).over(w) for k in lags})


def circular_mean(rows: DataFrame, index: str, value: str, period: int, half: int, keys: list[str]) -> DataFrame:
    """Centred mean over ``2 * half + 1`` positions of a ring ``1 .. period``, of the observed ones."""
    turned = rows.withColumn("_t", F.explode(F.array(F.lit(-period), F.lit(0), F.lit(period)))).withColumn("_p", F.col(index) + F.col("_t"))
    w = Window.partitionBy(*keys).orderBy("_p").rowsBetween(-half, half)
    return turned.withColumn("smooth", F.avg(value).over(w)).where("_t = 0").drop("_t", "_p")


def constant_runs(rows: DataFrame, out: str = "constant_run", value: str = "y", least: int = 5, ignore: float | None = None, keys: list[str] | None = None) -> DataFrame:
    """Rows in a run of ``least`` or more rows that are each close to a neighbour; abutting runs of different values count as one."""
    w = by_series(keys)
    link = is_close(F.col(value), F.lag(value).over(w))
    linked = rows.withColumn("_link", link)
    flag = F.col("_link") | F.coalesce(F.lead("_link").over(w), F.lit(False))
    if ignore is not None:
        flag = flag & ~is_close(F.col(value), F.lit(ignore))
    return runs_at_least(linked.withColumn("_flag", flag), "_flag", least, out, keys).drop("_link", "_flag")


def linear_runs(rows: DataFrame, out: str = "linear_run", value: str = "y", least: int = 5, atol: float = 1e-6, keys: list[str] | None = None) -> DataFrame:
    """Rows in a run of ``least`` or more rows on straight lines with a slope."""
    w = by_series(keys)
    first = F.lead(value, 1).over(w) - F.col(value)
    second = F.lead(value, 2).over(w) - F.lead(value, 1).over(w)
    ok = F.coalesce((F.abs(second - first) <= atol) & (F.abs(first) > atol), F.lit(False))
    marked = rows.withColumn("_ok", ok)
    before = lambda k: F.coalesce(F.lag("_ok", k).over(w), F.lit(False))
    return runs_at_least(marked.withColumn("_flag", F.col("_ok") | before(1) | before(2)), "_flag", least, out, keys).drop("_ok", "_flag")


def off_grid(value: Column, decimals: int) -> Column:
    """Whether a value isn't on the grid of so many decimals; a missing one is not off it."""
    return F.coalesce(F.abs(value - F.bround(value, decimals)) > 1e-9, F.lit(False))


def monthly_mean_fill(rows: DataFrame, out: str = "mean_fill", value: str = "y", decimals: int = 1, least: int = 3, keys: list[str] | None = None) -> DataFrame:
    """Values that equal the rounded mean of their calendar month over all years, where at least ``least`` of the month do."""
    keys = keys or KEYS
    month = Window.partitionBy(*keys, F.month("date"))
    match = F.coalesce(F.bround(F.col(value), decimals) == F.bround(F.avg(value).over(month), decimals), F.lit(False))
    marked = rows.withColumn("_m", match)
    return marked.withColumn(out, F.col("_m") & (F.sum(F.col("_m").cast("int")).over(month) >= least)).drop("_m")


def imputation_mask(rows: DataFrame, least: int = 5, decimals: int | None = None, zero_exempt: Column | None = None, keys: list[str] | None = None) -> DataFrame:
    """``constant_run``, ``linear_run``, ``off_grid`` and their union ``flag_any``; runs of zeros are exempt where ``zero_exempt``."""
    out = linear_runs(constant_runs(rows, least=least, keys=keys), least=least, keys=keys)
    if zero_exempt is not None:
        nonzero = constant_runs(rows, "_nonzero", least=least, ignore=0.0, keys=keys)
        out = out.join(nonzero.select(*(keys or KEYS), "date", "_nonzero"), [*(keys or KEYS), "date"])
        out = out.withColumn("constant_run", F.when(zero_exempt, F.col("_nonzero")).otherwise(F.col("constant_run"))).drop("_nonzero")
    grid = off_grid(F.col("y"), decimals) if decimals is not None else F.lit(False)
    return out.withColumn("off_grid", grid).withColumn("flag_any", F.col("constant_run") | F.col("linear_run") | F.col("off_grid"))


def masked(rows: DataFrame, flag: str = "flag_any", value: str = "y") -> DataFrame:
    return rows.withColumn(value, F.when(~F.coalesce(F.col(flag), F.lit(False)), F.col(value)))


def coverage(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Of an undensified panel: expected days, present rows, distinct days, gaps and duplicates of each series."""
    keys = keys or KEYS
    out = rows.groupBy(*keys).agg(
        (F.datediff(F.max("date"), F.min("date")) + 1).cast("long").alias("expected"), F.count("*").alias("present"), F.countDistinct("date").alias("days")
    )
    return out.withColumn("gaps", F.col("expected") - F.col("days")).withColumn("duplicates", F.col("present") - F.col("days"))
