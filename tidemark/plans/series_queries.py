"""Queries of the series operators over the tracks, each with its standard SQL.

The SQL is put together from named parts; ``sql(text)`` prefixes those that a text uses.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions import numeric as num
from tidemark.operators import evaluation as ev
from tidemark.operators import labels, panel
from tidemark.operators.evaluation import Q
from tidemark.sources import tracks
from tidemark.session import kept
from tidemark.sources.tracks import KEYS

TRAIN_END = ev.SPLITS["train_end"]
TEST = ev.SPLITS["test"]
H = 30

# --- parts of the standard SQL ------------------------------------------------------------------------------------

RING = "least(dayofyear({d}) - (case when month({d}) > 2 and (year({d}) % 4 = 0 and (year({d}) % 100 <> 0 or year({d}) % 400 = 0)) then 1 else 0 end), 365)"
DEKAD = "((month({d}) - 1) * 3 + least((day({d}) - 1) // 10, 2))"
DEKAD_START = "cast(date_trunc('month', {d}) + to_days(cast(least((day({d}) - 1) // 10, 2) * 10 as int)) as date)"


def _dense(obs: str) -> str:
    return f"""select g.track, g.var, g.series_id, g.date, o.y from (
      select track, var, series_id, unnest(d)::date date from (select track, var, series_id, generate_series(min(date), max(date), interval 1 day) d from {obs} group by all)
    ) g left join {obs} o using (track, var, series_id, date)"""


def _windows(series: str, start: str, end: str, h: int) -> str:
    return f"""select track, var, series_id, date origin, ctx_obs_frac_365 from (
      select *, round_even(count(y) over (s rows between 364 preceding and current row) / 365.0, 4)::double ctx_obs_frac_365,
             count(y) over (s rows between 1 following and {h} following) n, count(*) over (s rows between 1 following and {h} following) r,
             min(case when y is not null then date end) over (partition by track, var, series_id) first_obs
      from {series} window s as (partition by track, var, series_id order by date)
    ) where n = {h} and r = {h} and date - first_obs >= 365
      and date >= date '{start}' - 1 and date <= date '{end}' - {h} and (date - (date '{start}' - 1)) % 7 = 0"""


QS = ", ".join(f"quantile_cont({{v}}, {q}) q{i}" for i, q in enumerate(num.QUANTILES, 1))


def _fan(base: str, centred: bool) -> str:
    """Forecast columns from ``c1 .. c9``: clipped and in rising order."""
    terms = ", ".join(f"greatest({base} + c{i}{' - c5' if centred else ''}, 0)" for i in range(1, 10))
    return f"greatest({base}, 0) mean, list_sort([{terms}]) q"


CS = ", ".join(f"quantile_cont({{v}}, {q}) c{i}" for i, q in enumerate(num.QUANTILES, 1))
ZERO = ", ".join(f"coalesce(c{i}, 0) c{i}" for i in range(1, 10))


def _score(fc: str, series: str, scale: str) -> str:
    pin = " + ".join(f"greatest({q} * (y - q[{i}]), ({q} - 1) * (y - q[{i}]))" for i, q in enumerate(num.QUANTILES, 1))
    return f"""select *, abs(y - q[5]) abs_err, (y - mean) ** 2 sq_err, 2 * ({pin}) / 9 crps, y between q[1] and q[9] hit80,
        abs(y - q[5]) / nullif(scale, 0) ase, 2 * ({pin}) / 9 / nullif(scale, 0) scaled_crps
      from {fc} f join (select track, var, series_id, date, y from {series} where y is not null) using (track, var, series_id, date) left join {scale} using (track, var, series_id)"""


PARTS = {
    "ship_obs": """select 'ship' track, var, series_id, date, y from (
        select l_returnflag || l_linestatus series_id, l_shipdate::date date, sum(l_quantity::decimal(18,2))::double qty, sum(l_extendedprice::decimal(18,2))::double price
        from lineitem group by all) unpivot (y for var in (qty, price))""",
    "ship": _dense("ship_obs"),
    "region_obs": """select 'orders_region' track, var, series_id, date, y from (
        select r_name series_id, o_orderdate::date date, sum(o_totalprice::decimal(18,2))::double sales, count(*)::double n
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all
      ) unpivot (y for var in (sales, n))""",
    "regions": _dense("region_obs"),
    "dek": f"""select 'orders_dekad' track, var, series_id, {DEKAD_START.format(d='date')} date, sum(y::decimal(18,2))::double y from region_obs where var = 'sales' group by all""",
    "event_obs": "select 'events_daily' track, 'value' var, event_type series_id, ts::date date, sum(value::decimal(18,2))::double y from events group by all",
    "win": _windows("ship", *TEST, H),
    "lead_rows": f"select win.*, l.lead, (origin + l.lead)::date date from win, (select unnest(range(1, {H + 1}))::int lead) l",
    "clim": f"""select track, var, series_id, doy, avg(y) usual, {CS.format(v='y')} from (
        select track, var, series_id, y, (({RING.format(d='date')} - 1 + o + 365) % 365) + 1 doy from ship, (select unnest(range(-15, 16)) o) where y is not null and date <= date '{TRAIN_END}'
      ) group by all""",
    "fc_clim": f"""select track, var, series_id, origin, lead, date, {_fan('usual', False).replace('usual + c', 'c')} from (select *, {RING.format(d='date')} doy from lead_rows) join clim using (track, var, series_id, doy)""",
    "sn_spread": f"""select track, var, series_id, {CS.format(v='r')} from (
        select track, var, series_id, y - lag(y, 365) over (partition by track, var, series_id order by date) r from ship where date <= date '{TRAIN_END}') where r is not null group by all""",
    "fc_seasonal": f"""select track, var, series_id, origin, lead, date, {_fan('base', True)} from (
        select r.*, coalesce(p.y, c.usual) base, {ZERO.replace('coalesce(c', 'coalesce(s.c')} from (select *, {RING.format(d='date')} doy from lead_rows) r
        left join ship p on p.track = r.track and p.var = r.var and p.series_id = r.series_id and p.date = r.date - 365 and p.date <= r.origin
        left join clim c on c.track = r.track and c.var = r.var and c.series_id = r.series_id and c.doy = r.doy
        left join sn_spread s on s.track = r.track and s.var = r.var and s.series_id = r.series_id)""",
    "ps_spread": f"""select track, var, series_id, lead, {CS.format(v='r')} from (
        select a.track, a.var, a.series_id, l.lead, b.y - a.y r from ship a, (select unnest(range(1, {H + 1}))::int lead) l, ship b
        where b.track = a.track and b.var = a.var and b.series_id = a.series_id and b.date = a.date + l.lead and a.y is not null and b.y is not null
          and a.date <= date '{TRAIN_END}' and b.date <= date '{TRAIN_END}') group by all""",
    "held": "select track, var, series_id, date origin, last_value(y ignore nulls) over (partition by track, var, series_id order by date rows between unbounded preceding and current row) held_y from ship",
    "usual_all": f"select track, var, series_id, avg(y) usual from ship where date <= date '{TRAIN_END}' group by all",
    "fc_persist": f"""select track, var, series_id, origin, lead, date, {_fan('base', True)} from (
        select r.*, coalesce(held_y, usual) base, {ZERO.replace('coalesce(c', 'coalesce(s.c')} from lead_rows r left join held using (track, var, series_id, origin)
        left join usual_all using (track, var, series_id) left join ps_spread s using (track, var, series_id, lead))""",
    "scale_t": f"""select track, var, series_id, avg(abs(c)) scale from (
        select track, var, series_id, y - lag(y, 365) over (partition by track, var, series_id order by date) c from ship where date <= date '{TRAIN_END}') group by all""",
    "fc_all": "select 'climatology' model, * from fc_clim union all select 'seasonal_naive', * from fc_seasonal union all select 'persistence', * from fc_persist",
    "sc": _score("fc_all", "ship", "scale_t"),
    "board": "select track, var, lead, model, avg(ase) mase, avg(scaled_crps) scrps, sqrt(avg(sq_err)) rmse, avg(hit80::int) cov, count(distinct (series_id, origin)) n from sc group by all",
    # ten-day series
    "dpos": "select *, row_number() over (partition by track, var, series_id order by date) - 1 pos from dek",
    "dwin": f"""select track, var, series_id, date origin, pos origin_pos from (
        select *, count(y) over (s rows between 1 following and 6 following) n, lead(date, 1) over s a, lead(date, 6) over s b from dpos
        window s as (partition by track, var, series_id order by date)) where n = 6 and a >= date '{TEST[0]}' and b <= date '{TEST[1]}' and pos >= 35""",
    "dlead": "select w.track, w.var, w.series_id, w.origin, w.origin_pos, l.lead, p.date, p.pos, p.y from dwin w, (select unnest(range(1, 7))::int lead) l, dpos p where p.track = w.track and p.var = w.var and p.series_id = w.series_id and p.pos = w.origin_pos + l.lead",
    "dclim": f"select track, var, series_id, {DEKAD.format(d='date')} dk, avg(y) usual, {CS.format(v='y')} from dek where y is not null and date <= date '{TRAIN_END}' group by all",
    "dfc_clim": f"select track, var, series_id, origin, lead, date, y, {_fan('usual', False).replace('usual + c', 'c')} from (select *, {DEKAD.format(d='date')} dk from dlead) join dclim using (track, var, series_id, dk)",
    "dsn": f"select track, var, series_id, {CS.format(v='r')} from (select track, var, series_id, y - lag(y, 36) over (partition by track, var, series_id order by date) r from dek where date <= date '{TRAIN_END}') where r is not null group by all",
    "dfc_seasonal": f"""select track, var, series_id, origin, lead, date, y, {_fan('base', True)} from (
        select r.*, coalesce(p.y, c.usual) base, {ZERO.replace('coalesce(c', 'coalesce(s.c')} from (select *, {DEKAD.format(d='date')} dk from dlead) r
        left join dpos p on p.track = r.track and p.var = r.var and p.series_id = r.series_id and p.pos = r.pos - 36
        left join dclim c on c.track = r.track and c.var = r.var and c.series_id = r.series_id and c.dk = r.dk
        left join dsn s on s.track = r.track and s.var = r.var and s.series_id = r.series_id)""",
    "dps": f"""select track, var, series_id, lead, {CS.format(v='r')} from (
        select a.track, a.var, a.series_id, l.lead, b.y - a.y r from dpos a, (select unnest(range(1, 7))::int lead) l, dpos b
        where b.track = a.track and b.var = a.var and b.series_id = a.series_id and b.pos = a.pos + l.lead and a.y is not null and b.y is not null and b.date <= date '{TRAIN_END}') group by all""",
    "dfc_persist": f"""select track, var, series_id, origin, lead, date, y, {_fan('base', True)} from (
        select r.*, p.y base, {ZERO.replace('coalesce(c', 'coalesce(s.c')} from dlead r join dpos p on p.track = r.track and p.var = r.var and p.series_id = r.series_id and p.pos = r.origin_pos
        left join dps s on s.track = r.track and s.var = r.var and s.series_id = r.series_id and s.lead = r.lead)""",
    "dscale": f"select track, var, series_id, avg(abs(c)) scale from (select track, var, series_id, y - lag(y, 36) over (partition by track, var, series_id order by date) c from dek where date <= date '{TRAIN_END}') group by all",
    "dfc_all": "select 'climatology' model, * from dfc_clim union all select 'seasonal_naive', * from dfc_seasonal union all select 'persistence', * from dfc_persist",
    "dsc": _score("(select * exclude (y) from dfc_all)", "dek", "dscale"),
}


def sql(text: str) -> str:
    """The text with the parts it uses, in order of need."""
    need: list[str] = []

    def visit(t: str, within: tuple[str, ...] = ()) -> None:
        # a part's name stands after from, join or a comma; track names are quoted
        for name in re.findall(r"(?:from|join|,)\s+\(?([a-z_]+)\b", t) + re.findall(r"\bwin\b", t):
            if name in PARTS and name not in need and name not in within:
                visit(PARTS[name], (*within, name))
                if name not in need:
                    need.append(name)

    visit(text)
    return ("with " + ",\n".join(f"{n} as ({PARTS[n]})" for n in need) + "\n" if need else "") + text


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(text: str | None = None):
    """Register a function under its name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if text is not None:
            ORACLE_SQL[f.__name__] = sql(text)
        return f

    return add


def ship(spark: SparkSession, d: str) -> DataFrame:
    return tracks.series(spark, d, "ship")


def test_windows(series: DataFrame) -> DataFrame:
    return ev.windows(series, *TEST, horizon=H)


def rounded(frame: DataFrame, places: int = 5) -> DataFrame:
    return frame.select(*[F.round(F.col(f"`{c}`"), places).alias(c) if k == "double" else F.col(f"`{c}`") for c, k in frame.dtypes])


#: The variable that the national strata are about
QTY = "var = 'qty'"


#: Means of cents often end in half a step of any rounding, where the order of a sum decides; this moves them off it
OFF_HALF = 0.000137


def by_var(value: str, places: int, coarse: int = 3) -> str:
    """Rounded for the comparison: sums of prices, unlike those of whole quantities, end in other digits for another order."""
    return f"case when {QTY} then round({value}, {places}) else round({value} + {OFF_HALF}, {min(coarse, places)}) end"


def rounded_by_var(frame: DataFrame, places: int, coarse: int = 3) -> DataFrame:
    pick = lambda c: F.when(F.expr(QTY), F.round(F.col(f"`{c}`"), places)).otherwise(F.round(F.col(f"`{c}`") + OFF_HALF, min(coarse, places)))
    return frame.select(*[pick(c).alias(c) if k == "double" else F.col(f"`{c}`") for c, k in frame.dtypes])


# --- tracks and calendar ------------------------------------------------------------------------------------------


@query("select track, var, series_id, date, y from ship_obs union all select track, var, series_id, date, y from region_obs union all select * from dek union all select * from event_obs")
def s14_tracks(spark, d):
    return tracks.ship(spark, d).unionByName(tracks.orders_region(spark, d)).unionByName(tracks.orders_dekad(spark, d)).unionByName(tracks.events_daily(spark, d))


@query("select track, var, series_id, date, y from ship")
def p9_densify(spark, d):
    return ship(spark, d)


@query(
    f"""select distinct o_orderdate::date date, case when month(o_orderdate) in (12, 1, 2) then 'winter' when month(o_orderdate) <= 5 then 'pre_monsoon' when month(o_orderdate) <= 9 then 'monsoon' else 'post_monsoon' end season,
    case when md between 301 and 531 then 'pre_monsoon' when md between 601 and 615 then 'onset' when md between 616 and 1015 then 'peak' when md between 1016 and 1115 then 'withdrawal' else 'dry' end phase,
    ({RING.format(d='o_orderdate')})::int ring, ({DEKAD.format(d='o_orderdate')})::int dekad, {DEKAD_START.format(d='o_orderdate')} dekad_start
    from (select *, month(o_orderdate) * 100 + day(o_orderdate) md from orders)"""
)
def b1_b2_calendar(spark, d):
    days = tracks.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return days.select("date", cal.season("date").alias("season"), cal.monsoon_phase("date").alias("phase"), cal.ring_day("date").alias("ring"), cal.dekad_of_year("date").cast("int").alias("dekad"), cal.dekad_start("date").alias("dekad_start"))


@query("select event_id, (ts + interval 6 hours)::date local_day, (date '2024-01-01' + (event_id % 366)::int)::date from_doy from events")
def f_local_day(spark, d):
    e = tracks.table(spark, d, "events")
    return e.select("event_id", cal.local_day("ts").alias("local_day"), cal.day_of_year_date(F.lit(2024), (F.col("event_id") % 366 + 1).cast("int")).alias("from_doy"))


@query(f"select unnest(generate_series(date '{TEST[0]}' - 1, date '{TEST[1]}' - {H}, interval 7 day))::date origin")
def h1_origins(spark, d):
    return spark.range(1).select(F.explode(cal.origins(*TEST, H, 7)).alias("origin"))


# --- row-position operators ---------------------------------------------------------------------------------------


@query("""select track, var, series_id, date, coalesce(case when p1 = p0 then y0 else y0 + (y1 - y0) * (pos - p0) / (p1 - p0) end, y0, y1) filled from (
  select *, last_value(case when y is not null then pos end ignore nulls) over (s rows between unbounded preceding and current row) p0,
    last_value(y ignore nulls) over (s rows between unbounded preceding and current row) y0,
    first_value(case when y is not null then pos end ignore nulls) over (s rows between current row and unbounded following) p1,
    first_value(y ignore nulls) over (s rows between current row and unbounded following) y1
  from (select *, row_number() over (partition by track, var, series_id order by date) pos from ship) window s as (partition by track, var, series_id order by date))""")
def w6_interpolate(spark, d):
    return panel.interpolated(ship(spark, d)).select(*KEYS, "date", "filled")


@query(f"""select track, var, series_id, date, {by_var('a', 7)} mean_7, {by_var('b', 7)} mean_30, {by_var('c', 7)} mean_90, {by_var('o', 7)} observed_30 from (
  select track, var, series_id, date, avg(y) over (s rows 6 preceding) a, avg(y) over (s rows 29 preceding) b, avg(y) over (s rows 89 preceding) c, count(y) over (s rows 29 preceding) / 30.0 o
  from ship window s as (partition by track, var, series_id order by date))""")
def w8_trailing(spark, d):
    return rounded_by_var(panel.trailing_means(ship(spark, d)).drop("y"), 7)


@query("select track, var, series_id, date, " + ", ".join(f"lag(y, {k}) over s lag_{k}" for k in range(7)) + " from ship window s as (partition by track, var, series_id order by date)")
def w9_lags(spark, d):
    return panel.lagged(ship(spark, d)).drop("y")


LOW = "coalesce(y < 30, false)"
ISLANDS = f"(select *, row_number() over (partition by track, var, series_id order by date) - row_number() over (partition by track, var, series_id, {LOW} order by date) g from ship)"


@query(f"select track, var, series_id, date, (case when {LOW} then count(*) over (partition by track, var, series_id, {LOW}, g) else 0 end)::int run from {ISLANDS}")
def w10_runs(spark, d):
    return panel.run_lengths(ship(spark, d).withColumn("low", F.col("y") < 30), "low", "run").select(*KEYS, "date", "run")


@query(f"select track, var, series_id, date, ({LOW} and count(*) over (partition by track, var, series_id, {LOW}, g) >= 3) long_run from {ISLANDS}")
def w11_long_runs(spark, d):
    return panel.runs_at_least(ship(spark, d).withColumn("low", F.col("y") < 30), "low", 3, "long_run").select(*KEYS, "date", "long_run")


@query(f"select track, var, series_id, count(*) filter (where {LOW} and not coalesce(before, false)) starts from (select *, lag({LOW}) over (partition by track, var, series_id order by date) before from ship) group by all")
def w12_run_starts(spark, d):
    marked = ship(spark, d).withColumn("low", F.col("y") < 30)
    return marked.withColumn("start", panel.run_starts("low", panel.by_series())).groupBy(*KEYS).agg(F.count_if("start").alias("starts"))


@query("select track, var, series_id, date, y from (select *, min(case when y > 40 then date end) over (partition by track, var, series_id) a from ship) where date >= a")
def w7_trim(spark, d):
    return panel.trimmed(ship(spark, d).withColumn("big", F.when(F.col("y") > 40, F.col("y"))), "big").drop("big")


@query(f"""select track, var, series_id, i, {by_var('smooth', 7)} smooth from (
  select track, var, series_id, i, t, avg(m) over (partition by track, var, series_id order by i + t rows between 15 preceding and 15 following) smooth
  from (select track, var, series_id, dayofyear(date)::int i, avg(y) m from ship group by all), (values (-366), (0), (366)) v(t)) where t = 0""")
def w5_circular(spark, d):
    means = ship(spark, d).groupBy(*KEYS, F.dayofyear("date").alias("i")).agg(F.avg("y").alias("m"))
    return rounded_by_var(panel.circular_mean(means, "i", "m", 366, 15, KEYS).drop("m"), 7)


# --- quality control ----------------------------------------------------------------------------------------------

#: A panel with many repeated values: counts of orders in steps of four
COARSE = "(select track, var, series_id, date, case when y is null then null else floor(y / 4) end y from regions where var = 'n')"


def coarse(spark, d):
    return tracks.series(spark, d, "orders_region").where("var = 'n'").withColumn("y", F.floor(F.col("y") / 4).cast("double"))


def _mask_runs(flag: str, source: str, out: str, least: int = 5) -> str:
    return f"""select track, var, series_id, date, (f and count(*) over (partition by track, var, series_id, f, g) >= {least}) {out} from (
      select *, row_number() over (partition by track, var, series_id order by date) - row_number() over (partition by track, var, series_id, f order by date) g from (
        select track, var, series_id, date, {flag} f from {source}))"""


LINKED = f"(select *, coalesce(abs(y - lag(y) over s) <= 1e-8 + 1e-5 * abs(lag(y) over s), false) link from {COARSE} window s as (partition by track, var, series_id order by date))"
Q1_SQL = _mask_runs("(link or coalesce(lead(link) over (partition by track, var, series_id order by date), false))", LINKED, "constant_run")
LINES = f"""(select *, coalesce(abs((b - a) - (a - y)) <= 1e-6 and abs(a - y) > 1e-6, false) ok from (
   select *, lead(y, 1) over s a, lead(y, 2) over s b from {COARSE} window s as (partition by track, var, series_id order by date)))"""
Q2_SQL = _mask_runs("(ok or coalesce(lag(ok, 1) over (partition by track, var, series_id order by date), false) or coalesce(lag(ok, 2) over (partition by track, var, series_id order by date), false))", LINES, "linear_run")


@query(Q1_SQL)
def q1_constant_runs(spark, d):
    return panel.constant_runs(coarse(spark, d)).select(*KEYS, "date", "constant_run")


@query(Q2_SQL)
def q2_linear_runs(spark, d):
    return panel.linear_runs(coarse(spark, d)).select(*KEYS, "date", "linear_run")


@query(f"""select track, var, series_id, date, m and sum(m::int) over (partition by track, var, series_id, month(date)) >= 3 mean_fill from (
  select *, coalesce(round_even(y, 0) = round_even(avg(y) over (partition by track, var, series_id, month(date)), 0), false) m from {COARSE})""")
def q3_mean_fill(spark, d):
    return panel.monthly_mean_fill(coarse(spark, d), decimals=0).select(*KEYS, "date", "mean_fill")


@query("select l_orderkey, l_linenumber, coalesce(abs(l_extendedprice - round_even(l_extendedprice, 1)) > 1e-9, false) off_grid from lineitem")
def q4_off_grid(spark, d):
    return tracks.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", panel.off_grid(F.col("l_extendedprice"), 1).alias("off_grid"))


@query(f"select track, var, series_id, date, constant_run or linear_run flag_any from ({Q1_SQL}) join ({Q2_SQL}) using (track, var, series_id, date)")
def q5_mask(spark, d):
    return panel.imputation_mask(coarse(spark, d)).select(*KEYS, "date", "flag_any")


@query(f"""select series_id, round(100 * avg(flag_any::int), 4) full_pct, round(100 * avg(case when date >= date '{TEST[0]}' then flag_any::int end), 4) test_pct
  from (select *, constant_run or linear_run flag_any from ({Q1_SQL}) join ({Q2_SQL}) using (track, var, series_id, date)) group by series_id""")
def q6_audit(spark, d):
    flagged = panel.imputation_mask(coarse(spark, d)).withColumn("f", F.col("flag_any").cast("int"))
    return flagged.groupBy("series_id").agg(F.round(100 * F.avg("f"), 4).alias("full_pct"), F.round(100 * F.avg(F.when(F.col("date") >= F.lit(TEST[0]).cast("date"), F.col("f"))), 4).alias("test_pct"))


@query("select track, var, series_id, (max(date) - min(date) + 1)::bigint expected, count(*) present, count(distinct date) \"days\", (max(date) - min(date) + 1)::bigint - count(distinct date) gaps, count(*) - count(distinct date) duplicates from ship_obs group by all")
def q7_coverage(spark, d):
    return panel.coverage(tracks.ship(spark, d))


# --- windows, forecasts and scores --------------------------------------------------------------------------------


@query("select track, var, series_id, origin, ctx_obs_frac_365 from win")
def h2_windows(spark, d):
    return test_windows(ship(spark, d))


@query("select row_number() over (order by track, series_id, var, origin) - 1 + 1000000 window_id, track, var, series_id, origin from win")
def h5_window_ids(spark, d):
    w = ev.numbered(test_windows(ship(spark, d)), 1_000_000)
    return w.select(F.col("window_id").cast("long"), *KEYS, "origin")


@query(f"select count(*) filter (where origin + 1 < date '{TEST[0]}' or origin + {H} > date '{TEST[1]}') outside, count(*) - count(distinct (track, var, series_id, origin)) twice from win")
def h3_validation(spark, d):
    w = test_windows(ship(spark, d))
    ev.check_windows(w, *TEST, H)
    return w.agg(F.count_if((F.date_add("origin", 1) < F.lit(TEST[0]).cast("date")) | (F.date_add("origin", H) > F.lit(TEST[1]).cast("date"))).alias("outside"), (F.count("*") - F.countDistinct(*KEYS, "origin")).alias("twice"))


@query("""select w.track, w.var, w.series_id, w.origin, count(*) n, count(s.y) seen, round(sum(s.y), 4) total, arg_max(s.y, s.date) filter (where s.y is not null) last_y
  from win w join ship s on s.track = w.track and s.var = w.var and s.series_id = w.series_id and s.date between w.origin - 63 and w.origin group by all""")
def j9_h4_context(spark, d):
    s = ship(spark, d)
    c = ev.contexts(s, test_windows(s), 64)
    seen = F.filter("context", lambda x: x.isNotNull())
    total = F.aggregate(seen, F.lit(0.0), lambda a, x: a + x)
    return c.select(*KEYS, "origin", F.size("context").cast("long").alias("n"), F.size(seen).cast("long").alias("seen"), F.round(total, 4).alias("total"), F.element_at(seen, -1).alias("last_y"))


@query("select a.track, a.var, a.series_id, a.origin, a.lead, b.y past from lead_rows a left join ship b on b.track = a.track and b.var = a.var and b.series_id = a.series_id and b.date = a.date - 365")
def j10_lag_join(spark, d):
    s = ship(spark, d)
    past = s.select(*KEYS, F.date_add("date", 365).alias("date"), F.col("y").alias("past"))
    return ev.targets(test_windows(s), H).join(past, [*KEYS, "date"], "left").select(*KEYS, "origin", "lead", "past")


@query(f"select track, var, series_id, doy, {by_var('usual', 7)} mean, {by_var('c1', 7)} lo, {by_var('c5', 7)} mid, {by_var('c9', 7)} hi from clim")
def j14_m1_climatology_table(spark, d):
    t = ev.climatology_table(ship(spark, d), TRAIN_END)
    return rounded_by_var(t.select(*KEYS, "doy", "mean", F.col("q")[0].alias("lo"), F.col("q")[4].alias("mid"), F.col("q")[8].alias("hi")), 7)


def _forecast_sql(part: str, p: int = 7) -> str:
    return f"select track, var, series_id, origin, lead, {by_var('mean', p)} mean, {', '.join(by_var(f'q[{i}]', p) + f' q_{i}' for i in range(1, 10))} from {part}"


def _plain(forecasts: DataFrame, p: int = 7) -> DataFrame:
    return rounded_by_var(forecasts, p).withColumnsRenamed({n: f"q_{i}" for i, n in enumerate(Q, 1)})


@query(_forecast_sql("fc_clim"))
def m1_climatology(spark, d):
    s = ship(spark, d)
    return _plain(ev.climatology(s, test_windows(s), TRAIN_END, H))


@query(_forecast_sql("fc_seasonal"))
def m2_seasonal_naive(spark, d):
    s = ship(spark, d)
    return _plain(ev.seasonal_naive(s, test_windows(s), TRAIN_END, H))


@query(_forecast_sql("fc_persist"))
def m3_persistence(spark, d):
    s = ship(spark, d)
    return _plain(ev.persistence(s, test_windows(s), TRAIN_END, H))


@query("select track, var, series_id, round(scale, 5) scale from scale_t")
def h7_scales(spark, d):
    return rounded(ev.train_scales(ship(spark, d), TRAIN_END))


def scores(spark, d):
    """Scores of the three reference models, kept: windows times leads times models, which every report starts from."""

    def build() -> DataFrame:
        s = ship(spark, d)
        w = kept(spark, ("windows", d), lambda: test_windows(s))
        return ev.scored(ev.common_windows(ev.all_forecasts(s, w, TRAIN_END, H)), s, ev.train_scales(s, TRAIN_END))

    return kept(spark, ("scores", d), build)


@query(f"select model, track, var, series_id, origin, lead, y, {by_var('abs_err', 4)} abs_err, {by_var('sqrt(sq_err)', 3)} root_sq_err, {by_var('crps', 4)} crps, hit80, round(ase, 5) ase, round(scaled_crps, 5) scaled_crps from sc where lead in (1, 7, 30)")
def h8_e1_e5_scores(spark, d):
    s = scores(spark, d).where(F.col("lead").isin(1, 7, 30)).withColumn("root", F.sqrt("sq_err"))
    near = lambda c, places: F.when(F.expr(QTY), F.round(c, places)).otherwise(F.round(F.col(c) + OFF_HALF, 3))
    return s.select("model", *KEYS, "origin", "lead", "y", near("abs_err", 4).alias("abs_err"), near("root", 3).alias("root_sq_err"), near("crps", 4).alias("crps"), "hit80", F.round("ase", 5).alias("ase"), F.round("scaled_crps", 5).alias("scaled_crps"))


@query('select track, var, lead, model, round(mase, 5) "MASE", round(scrps, 5) "sCRPS", round(rmse, 3) "RMSE", round(cov, 5) coverage80, n n_windows from board where lead in (1, 3, 7, 14, 30)')
def h9_board(spark, d):
    b = ev.board(scores(spark, d).where(F.col("lead").isin(1, 3, 7, 14, 30)), ["track", "var", "lead", "model"])
    return b.select("track", "var", "lead", "model", F.round("MASE", 5).alias("MASE"), F.round("sCRPS", 5).alias("sCRPS"), F.round("RMSE", 3).alias("RMSE"), F.round("coverage80", 5).alias("coverage80"), "n_windows")


@query("""select a.track, a.var, a.lead, a.model, round(1 - a.mase / b.mase, 5) "skill_MAE_vs_clim", round(1 - a.scrps / b.scrps, 5) "CRPSS_vs_clim"
  from board a left join board b on b.model = 'climatology' and b.track = a.track and b.var = a.var and b.lead = a.lead where a.lead in (1, 7, 30)""")
def r1_e7_skill(spark, d):
    b = ev.board(scores(spark, d).where(F.col("lead").isin(1, 7, 30)), ["track", "var", "lead", "model"])
    return rounded(ev.with_skill(b, ["track", "var", "lead"]).select("track", "var", "lead", "model", "skill_MAE_vs_clim", "CRPSS_vs_clim"))


@query("""select phase, lead, model, round(avg(scaled_crps), 5) "sCRPS", count(*) n from (
  select *, case when md between 301 and 531 then 'pre_monsoon' when md between 601 and 615 then 'onset' when md between 616 and 1015 then 'peak' when md between 1016 and 1115 then 'withdrawal' else 'dry' end phase
  from (select *, month(date) * 100 + day(date) md from sc where lead in (1, 7, 30))) group by all""")
def r2_phase_board(spark, d):
    s = scores(spark, d).where(F.col("lead").isin(1, 7, 30)).withColumn("phase", cal.monsoon_phase(F.date_add("origin", F.col("lead"))))
    return s.groupBy("phase", "lead", "model").agg(F.round(F.avg("scaled_crps"), 5).alias("sCRPS"), F.count("*").alias("n"))


#: Each rule counted over the forecasts and the windows
INTEGRITY = f"""(select 'row_count' "rule", abs(count(*) - {H} * (select count(*) from win)) violations from fc_clim
  union all select 'absent_windows', count(*) from win w where not exists (select 1 from fc_clim f where f.track = w.track and f.var = w.var and f.series_id = w.series_id and f.origin = w.origin)
  union all select 'foreign_rows', count(*) from fc_clim f where not exists (select 1 from win w where f.track = w.track and f.var = w.var and f.series_id = w.series_id and f.origin = w.origin)
  union all select 'bad_leads', count(*) from (select count(*) k, count(distinct lead) n, min(lead) a, max(lead) b from fc_clim group by track, var, series_id, origin) where k <> {H} or n <> {H} or a <> 1 or b <> {H}
  union all select 'missing_values', count(*) filter (where mean is null or len(list_filter(q, lambda x: x is null)) > 0) from fc_clim
  union all select 'not_monotone', count(*) filter (where len(list_filter(range(1, 9), lambda i: q[i + 1] < q[i] - 1e-6)) > 0) from fc_clim
  union all select 'negative', count(*) filter (where mean < 0 or list_min(q) < 0) from fc_clim)"""


@query(f"select \"rule\", violations from {INTEGRITY}")
def h14_integrity(spark, d):
    s = ship(spark, d)
    w = test_windows(s)
    return ev.integrity(ev.climatology(s, w, TRAIN_END, H), w, H)


# --- ten-day series -----------------------------------------------------------------------------------------------


def dekads(spark, d):
    return tracks.orders_dekad(spark, d)


def dekad_wins(spark, d):
    return ev.dekad_windows(dekads(spark, d), *TEST)


@query("select track, var, series_id, origin, origin_pos from dwin")
def h10_dekad_windows(spark, d):
    return dekad_wins(spark, d).withColumn("origin_pos", F.col("origin_pos").cast("long"))


@query(_forecast_sql("dfc_clim", p=5))
def m4_dekad_climatology(spark, d):
    return _plain(ev.dekad_climatology(dekads(spark, d), dekad_wins(spark, d), TRAIN_END), 5)


@query(_forecast_sql("dfc_seasonal", p=5))
def m5_dekad_seasonal_naive(spark, d):
    return _plain(ev.dekad_seasonal_naive(dekads(spark, d), dekad_wins(spark, d), TRAIN_END), 5)


@query(_forecast_sql("dfc_persist", p=5))
def m6_dekad_persistence(spark, d):
    return _plain(ev.dekad_persistence(dekads(spark, d), dekad_wins(spark, d), TRAIN_END), 5)


def dekad_scores(spark, d):
    x, w = dekads(spark, d), dekad_wins(spark, d)
    made = [f(x, w, TRAIN_END).withColumn("model", F.lit(m)) for m, f in ev.DEKAD_MODELS.items()]
    return ev.dekad_scored(made[0].unionByName(made[1]).unionByName(made[2]), x, TRAIN_END)


@query('select model, lead, round(avg(ase), 5) "MASE", round(avg(scaled_crps), 5) "sCRPS", round(avg(hit80::int), 5) coverage80, count(*) n from dsc group by all')
def h11_h12_r4_dekad_board(spark, d):
    return dekad_scores(spark, d).groupBy("model", "lead").agg(F.round(F.avg("ase"), 5).alias("MASE"), F.round(F.avg("scaled_crps"), 5).alias("sCRPS"), F.round(F.avg(F.col("hit80").cast("int")), 5).alias("coverage80"), F.count("*").alias("n"))
