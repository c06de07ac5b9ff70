"""Strata, spatial joins, statistics and report queries, each with its standard SQL where that can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import numeric as num
from tidemark.functions import numerics
from tidemark.operators import boosted
from tidemark.operators import evaluation as ev
from tidemark.operators import forecasters as fc
from tidemark.operators import labels, significance as sg
from tidemark.plans import series_queries as sq
from tidemark.plans.series_queries import INTEGRITY, KEYS, QTY, TRAIN_END, by_var, rounded, rounded_by_var, scores, ship, sql
from tidemark.session import kept
from tidemark.sources import tracks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text is not None:
            ORACLE_SQL[f.__name__] = sql(text)
        return f

    return add


# --- strata -------------------------------------------------------------------------------------------------------

#: Mean quantity over the six shipping series where at least four report
NATIONAL = "(select date, case when count(y) >= 4 then avg(y) end y, count(y) n from ship where var = 'qty' group by date)"
SMOOTH = f"""(select doy, smooth from (
  select doy, t, avg(f) over (order by doy + t rows between 15 preceding and 15 following) smooth from (
    select d.doy, coalesce(case when p1 = p0 then v0 else v0 + (v1 - v0) * (d.doy - p0) / (p1 - p0) end, v0, v1) f from (
      select doy, last_value(case when m is not null then doy end ignore nulls) over (order by doy rows between unbounded preceding and current row) p0,
        last_value(m ignore nulls) over (order by doy rows between unbounded preceding and current row) v0,
        first_value(case when m is not null then doy end ignore nulls) over (order by doy rows between current row and unbounded following) p1,
        first_value(m ignore nulls) over (order by doy rows between current row and unbounded following) v1
      from (select unnest(range(1, 367))::int doy) left join (select dayofyear(date)::int doy, avg(y) m from {NATIONAL} where date <= date '{TRAIN_END}' group by 1) using (doy)) d
  ), (values (-366), (0), (366)) v(t)) where t = 0)"""


def national(spark, d):
    return labels.national(ship(spark, d).where(QTY), 4).withColumn("series_id", F.lit("all"))


@query(f"select date, round(y, 7) y, n from {NATIONAL}")
def b5_national(spark, d):
    return rounded(national(spark, d).drop("series_id"), 7)


@query(f"select 'all' series_id, doy, round(smooth, 6) smooth from {SMOOTH}")
def b3_climatology(spark, d):
    return rounded(labels.daily_climatology(national(spark, d), TRAIN_END, ["series_id"]), 6)


SPELLS = f"""(select date, y, case when z is null then '' when up and count(*) over (partition by up, gu) >= 3 then 'active' when down and count(*) over (partition by down, gd) >= 3 then 'break' else 'normal' end spell from (
  select *, row_number() over (order by date) - row_number() over (partition by up order by date) gu, row_number() over (order by date) - row_number() over (partition by down order by date) gd from (
    select *, coalesce(z >= 0.5, false) up, coalesce(z <= -0.5, false) down from (
      select date, y, a / nullif(stddev_samp(a) over (partition by year(date)), 0) z from (
        select date, y, case when month(date) in (7, 8) then y - smooth end a from {NATIONAL} x left join {SMOOTH} s on s.doy = dayofyear(x.date))))))"""


def spell_days(spark, d):
    return labels.spells(national(spark, d), TRAIN_END, ["series_id"])


@query(f"select date, spell from {SPELLS}")
def b4_spells(spark, d):
    return spell_days(spark, d).select("date", "spell")


@query(f"""select event, spell, min(date) "first", max(date) "last", count(*) "days" from (
  select date, spell, sum(change) over (order by date rows between unbounded preceding and current row)::bigint event from (
    select date, spell, case when spell = lag(spell) over (order by date) then 0 else 1 end change from {SPELLS})) group by event, spell""")
def b9_events(spark, d):
    return labels.events(spell_days(spark, d))


LIMITS = f"""(select series_id, month, hot, cold, p95, p99 from (
  select series_id, month(date) as month, quantile_cont(y, 0.95) hot, quantile_cont(y, 0.05) cold from ship where var = 'qty' and date <= date '{TRAIN_END}' group by all)
  left join (select series_id, quantile_cont(y, 0.95) p95, quantile_cont(y, 0.99) p99 from ship where var = 'qty' and date <= date '{TRAIN_END}' and y >= 1 group by all) using (series_id))"""


@query(f"select series_id, month::int as month, round(p95, 5) p95, round(p99, 5) p99, round(hot, 5) hot, round(cold, 5) cold from {LIMITS}")
def b6_thresholds(spark, d):
    return rounded(labels.thresholds(ship(spark, d).where(QTY), TRAIN_END, ["series_id"]))


@query(f"""select series_id, date, coalesce(y >= p95, false) heavy, coalesce(y >= p99, false) very_heavy, coalesce(y > hot, false) hot, coalesce(y < cold, false) cold
  from (select * from ship where var = 'qty') x left join {LIMITS} t using (series_id) where t.month = month(x.date)""")
def b7_extremes(spark, d):
    x = ship(spark, d).where(QTY)
    return labels.extremes(x, labels.thresholds(x, TRAIN_END, ["series_id"]), ["series_id"])


# --- spatial and distance joins -----------------------------------------------------------------------------------


def stations(spark, d):
    n = tracks.table(spark, d, "nation")
    return n.select(F.col("n_name").alias("station"), (F.lit(-60.0) + 5 * F.col("n_nationkey")).alias("lat"), (F.lit(-170.0) + 14 * F.col("n_nationkey")).alias("lon"))


def storm_points(spark, d):
    e = tracks.table(spark, d, "events")
    return e.select(
        F.concat(F.lit("S"), F.col("user_id")).alias("sid"), F.to_date("ts").alias("date"), (F.pmod(F.col("event_id") * 7, F.lit(1200)) / 10.0 - 60).alias("lat"),
        (F.pmod(F.col("event_id") * 13, F.lit(3360)) / 10.0 - 170).alias("lon"), (F.col("value") / 4).alias("wind"),
    )


HAVERSINE = "round(2 * 6371.0 * asin(sqrt(least(sin((radians(p.lat) - radians(s.lat)) / 2) ** 2 + cos(radians(s.lat)) * cos(radians(p.lat)) * sin(radians(p.lon - s.lon) / 2) ** 2, 1.0))), 1)"


@query(f"""select station, date, min(sid) sid, min(km) min_dist_km, max(wind) max_wind from (
  select s.station, p.date, p.sid, p.wind, {HAVERSINE} km
  from (select 'S' || user_id sid, ts::date date, (event_id * 7 % 1200) / 10.0::double - 60 lat, (event_id * 13 % 3360) / 10.0::double - 170 lon, value / 4 wind from events) p,
       (select n_name station, -60.0::double + 5 * n_nationkey lat, -170.0::double + 14 * n_nationkey lon from nation) s
  where p.wind >= 34) where km <= 300 group by station, date""")
def j13_b8_near_tracks(spark, d):
    return labels.near_tracks(storm_points(spark, d), stations(spark, d))


POLYGONS = {"west": [(-170.0, -60.0), (-100.0, -60.0), (-100.0, 0.0), (-170.0, 0.0)], "middle": [(-60.0, -30.0), (40.0, -30.0), (-10.0, 40.0)], "east": [(60.0, 10.0), (170.0, 10.0), (170.0, 60.0), (60.0, 60.0)]}


@query()
def j11_point_in_polygon(spark, d):
    at = stations(spark, d).select("station", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return labels.located(at, POLYGONS).select("station", "polygon", "matched", F.round("dist", 6).alias("dist"))


# --- gap matching and plug-in forecasters -------------------------------------------------------------------------


@query()
def h13_gap_matching(spark, d):
    """Contexts of the shipping panel with the gaps of other windows' contexts of their variable."""
    s = ship(spark, d)
    w = ev.numbered(sq.test_windows(s))
    contexts = ev.contexts(s, w, 64).join(w.select(*KEYS, "origin", "window_id"), [*KEYS, "origin"])
    left = F.filter("masked", lambda v: v.isNotNull())
    return fc.gap_matched(contexts, 64).select("window_id", "donor", F.size(left).alias("kept"), F.round(F.aggregate(left, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def _plugin(name):
    def run(spark, d) -> DataFrame:
        """The shipping panel's departures from its climatology, 30 days ahead from the last 730."""
        s = ship(spark, d)
        out = fc.on_anomalies(s, sq.test_windows(s), TRAIN_END, name, sq.H)
        return rounded(out, 4).withColumnsRenamed({n: f"q_{i}" for i, n in enumerate(ev.Q, 1)})

    return run


for _n in fc.REGISTRY:
    QUERIES[f"m7_m10_{_n}"] = _plugin(_n)


@query()
def m8_boosted_trees(spark, d):
    """One gradient-boosted model for each variable over all series and leads of the shipping panel."""
    s = ship(spark, d)
    out = boosted.forecast(s, sq.test_windows(s), TRAIN_END, *ev.SPLITS["val"], sq.H)
    return rounded(out, 4).withColumnsRenamed({n: f"q_{i}" for i, n in enumerate(ev.Q, 1)})


# --- statistics ---------------------------------------------------------------------------------------------------

ORIGIN_LOSS = "(select model, track, var, lead, origin, avg(scaled_crps) loss from sc where lead in (1, 7, 30) group by all)"
PAIRED = f"(select var, lead, origin, a.loss - b.loss d from {ORIGIN_LOSS} a join {ORIGIN_LOSS} b using (var, lead, origin) where a.model = 'climatology' and b.model = 'persistence')"
LONG_RUN = f"""(select var, lead, n, m mean_diff, case when g0 + coalesce(more, 0) > 0 then g0 + coalesce(more, 0) else g0 end v from (
   select var, lead, count(*) n, any_value(m) m, sum(c * c) / count(*) g0 from (select *, d - m c from (select *, avg(d) over (partition by var, lead) m from {PAIRED})) group by var, lead)
   left join (select a.var, a.lead, sum(2 * (1 - (b.i - a.i) / (least(a.lead - 1, a.n - 1) + 1.0)) * a.c * b.c / a.n) more from
     (select *, d - avg(d) over (partition by var, lead) c, count(*) over (partition by var, lead) n, row_number() over (partition by var, lead order by origin) i from {PAIRED}) a
     join (select *, d - avg(d) over (partition by var, lead) c, row_number() over (partition by var, lead order by origin) i from {PAIRED}) b
       on a.var = b.var and a.lead = b.lead and b.i > a.i and b.i - a.i <= least(a.lead - 1, a.n - 1) group by a.var, a.lead) using (var, lead))"""
COMPARISON = ["var", "lead"]


def origin_losses(spark, d):
    return kept(spark, ("origin_losses", d), lambda: sg.per_origin(scores(spark, d).where(F.col("lead").isin(1, 7, 30)), ["model", *COMPARISON]))


def late_scores(spark, d):
    return scores(spark, d).where(F.col("lead").isin(1, 7, 30))


def differences(spark, d):
    return sg.paired(origin_losses(spark, d), "climatology", "persistence", COMPARISON)


@query(f"select model, var, lead, origin, round(loss, 6) loss from {ORIGIN_LOSS}")
def t1_origin_losses(spark, d):
    return rounded(origin_losses(spark, d), 6)


@query(f"select var, lead, n, round(mean_diff, 7) mean_diff, round(v, 9) variance from {LONG_RUN}")
def t2_long_run_variance(spark, d):
    v = sg.long_run(differences(spark, d), COMPARISON)
    return v.select("var", "lead", "n", F.round("mean_diff", 7).alias("mean_diff"), F.round("variance", 9).alias("variance"))


@query(f"select var, lead, n, round(mean_diff / sqrt(v / n) * sqrt(greatest((n + 1 - 2 * lead + lead * (lead - 1) / n) / n, 1e-12)), 5) statistic from {LONG_RUN}")
def t3_diebold_mariano(spark, d):
    s = sg.diebold_mariano(differences(spark, d), COMPARISON)
    return s.select("var", "lead", "n", F.round("statistic", 5).alias("statistic"))


@query()
def t3_t8_p_values(spark, d):
    s = sg.diebold_mariano(differences(spark, d), COMPARISON).withColumn("p", sg.t_p_value("statistic", "n"))
    return rounded(sg.holm(s), 9)


@query()
def t4_wilcoxon(spark, d):
    per = sg.per_series(scores(spark, d).where(F.col("lead").isin(1, 7, 30)), ["model", "lead", "var"]).withColumnRenamed("series_id", "origin")
    return rounded(sg.wilcoxon(sg.paired(per, "climatology", "persistence", ["lead", "var"]), ["lead", "var"]), 9)


@query()
def t5_t6_bootstrap(spark, d):
    wide = origin_losses(spark, d).where("model in ('persistence', 'climatology')").groupBy(*COMPARISON, "origin").pivot("model", ["persistence", "climatology"]).agg(F.first("loss"))
    return rounded(sg.bootstrap(wide, COMPARISON, ["persistence", "climatology"], "skill"), 6)


TASK_LOSS = "(select model, var, series_id, lead, round(avg(scaled_crps), 6) loss from sc where lead in (1, 7, 30) group by all)"


def task_losses(spark, d):
    build = lambda: scores(spark, d).where(F.col("lead").isin(1, 7, 30)).groupBy("model", "var", "series_id", "lead").agg(F.round(F.avg("scaled_crps"), 6).alias("loss"))
    return kept(spark, ("task_losses", d), build)


@query(f"select model, round(avg(r), 6) avg_rank, count(*) n_tasks from (select *, rank() over (partition by var, series_id, lead order by loss) + (count(*) over (partition by var, series_id, lead, loss) - 1) / 2.0 r from {TASK_LOSS}) group by model")
def t7_average_ranks(spark, d):
    f = sg.friedman(task_losses(spark, d), ["var", "series_id", "lead"])
    return f.select("model", F.round("avg_rank", 6).alias("avg_rank"), "n_tasks")


@query()
def t7_friedman_nemenyi(spark, d):
    f = sg.friedman(task_losses(spark, d), ["var", "series_id", "lead"])
    one = f.agg(F.first("n_models").alias("k"), F.first("n_tasks").alias("n"), F.first("chi2").alias("chi2")).first()  # one row
    p, cd = numerics.chi2_upper(one["chi2"], one["k"] - 1), numerics.nemenyi_difference(one["k"], one["n"])
    return f.withColumns({"p": F.lit(round(p, 12)), "cd": F.lit(round(cd, 9)), "chi2": F.round("chi2", 6)})


PVALUES = "(select p_partkey, case when p_partkey % 17 <> 0 then (p_partkey * 7919 % 10007) / 10007.0::double / 50 end p, p_brand from part)"


@query(f"""select p_brand, p_partkey, round(case when p is not null then max(least(1, (m - i + 1) * p)) over (partition by p_brand order by i rows between unbounded preceding and current row) end, 9) p_holm from (
  select *, row_number() over (partition by p_brand order by p nulls last, p_partkey) i, count(*) over (partition by p_brand) m from {PVALUES})""")
def t8_holm(spark, d):
    part = tracks.table(spark, d, "part")
    p = F.when(F.col("p_partkey") % 17 != 0, (F.col("p_partkey") * 7919 % 10007) / F.lit(10007.0) / 50)
    return sg.holm(part.select("p_brand", "p_partkey", p.alias("p")), by=["p_brand"]).select("p_brand", "p_partkey", F.round("p_holm", 9).alias("p_holm"))


@query(f"select a.var, a.lead, round(1 - avg(a.loss) / avg(b.loss), 6) crpss from {ORIGIN_LOSS} a join {ORIGIN_LOSS} b on a.var = b.var and a.lead = b.lead and a.origin = b.origin and a.model = 'persistence' and b.model = 'climatology' group by a.var, a.lead")
def t9_crpss(spark, d):
    wide = origin_losses(spark, d).groupBy(*COMPARISON, "origin").pivot("model", ["persistence", "climatology"]).agg(F.first("loss")).dropna()
    return wide.groupBy(*COMPARISON).agg(F.round(num.skill(F.avg("persistence"), F.avg("climatology")), 6).alias("crpss"))


SKILLS = "(select left(series_id, 1) grp, lead, 1 - avg(case when model = 'persistence' then scaled_crps end) / avg(case when model = 'climatology' then scaled_crps end) ps, 1 - avg(case when model = 'seasonal_naive' then scaled_crps end) / avg(case when model = 'climatology' then scaled_crps end) sn from sc where lead in (1, 7, 30) group by all)"


@query(f"select a.lead, round((a.ps - b.ps) - (a.sn - b.sn), 6) did from {SKILLS} a join {SKILLS} b on a.lead = b.lead and a.grp = 'R' and b.grp = 'A'")
def t10_r5_did(spark, d):
    s = scores(spark, d).where(F.col("lead").isin(1, 7, 30)).withColumn("grp", F.substring("series_id", 1, 1))
    mean = lambda m: F.avg(F.when(F.col("model") == m, F.col("scaled_crps")))
    k = s.groupBy("grp", "lead").agg(num.skill(mean("persistence"), mean("climatology")).alias("ps"), num.skill(mean("seasonal_naive"), mean("climatology")).alias("sn"))
    of = lambda g, c: F.max(F.when(F.col("grp") == g, F.col(c)))
    did = (of("R", "ps") - of("A", "ps")) - (of("R", "sn") - of("A", "sn"))
    return k.groupBy("lead").agg(F.round(did, 6).alias("did")).where("did is not null")


# --- reports ------------------------------------------------------------------------------------------------------


@query(f"""select x.lead, s.spell, x.model, round(avg(x.scaled_crps), 5) "sCRPS", count(*) n from sc x join {SPELLS} s on s.date = x.date where x.lead in (1, 7, 30) and s.spell <> '' group by all""")
def r3_spell_board(spark, d):
    days = spell_days(spark, d).where("spell <> ''").select("date", "spell")
    s = scores(spark, d).where(F.col("lead").isin(1, 7, 30)).join(days, "date")
    return s.groupBy("lead", "spell", "model").agg(F.round(F.avg("scaled_crps"), 5).alias("sCRPS"), F.count("*").alias("n"))


@query("""select model, round(avg(skill), 5) mean_skill, round(avg(r), 5) mean_rank, count(*) filter (where best) wins, round(avg(cov), 5) coverage from (
  select *, rank() over w + (count(*) over (partition by var, lead, scrps) - 1) / 2.0 r, row_number() over (partition by var, lead order by scrps, model) = 1 best from (
    select a.*, 1 - a.scrps / b.scrps skill from board a join board b on b.model = 'climatology' and a.var = b.var and a.lead = b.lead where a.lead in (1, 7, 30)) window w as (partition by var, lead order by scrps)) group by model""")
def r8_summary(spark, d):
    b = ev.board(scores(spark, d).where(F.col("lead").isin(1, 7, 30)), ["track", "var", "lead", "model"])
    b = ev.with_skill(b, ["track", "var", "lead"]).withColumnRenamed("sCRPS", "loss")
    b = sg.average_ranks(b, ["var", "lead"]).withColumn("best", F.row_number().over(Window.partitionBy("var", "lead").orderBy("loss", "model")) == 1)
    return b.groupBy("model").agg(F.round(F.avg("CRPSS_vs_clim"), 5).alias("mean_skill"), F.round(F.avg("rank"), 5).alias("mean_rank"), F.count_if("best").alias("wins"), F.round(F.avg("coverage80"), 5).alias("coverage"))


CUT = "2000-10-01"


@query(f"""select var, lead, arg_min(model, (first_half, model)) chosen, round(arg_min(second_half, (first_half, model)), 5) held_out from (
  select var, lead, model, avg(case when origin < date '{CUT}' then scaled_crps end) first_half, avg(case when origin >= date '{CUT}' then scaled_crps end) second_half from sc where lead in (1, 7, 30) group by all) group by var, lead""")
def r10_split_sample(spark, d):
    early = F.col("origin") < F.lit(CUT).cast("date")
    s = scores(spark, d).where(F.col("lead").isin(1, 7, 30)).groupBy("var", "lead", "model").agg(F.avg(F.when(early, F.col("scaled_crps"))).alias("a"), F.avg(F.when(~early, F.col("scaled_crps"))).alias("b"))
    return s.groupBy("var", "lead").agg(F.min_by("model", F.struct("a", "model")).alias("chosen"), F.round(F.min_by("b", F.struct("a", "model")), 5).alias("held_out"))


@query(f"""select var, lead, arg_min(model, (loss, model)) best, arg_min(model, (loss, model)) filter (where model <> 'climatology') best_without from (
  select var, lead, model, avg(scaled_crps) loss from sc where lead in (1, 7, 30) and origin < date '{CUT}' group by all) group by var, lead""")
def r11_comparators(spark, d):
    s = scores(spark, d).where(F.col("lead").isin(1, 7, 30) & (F.col("origin") < F.lit(CUT).cast("date"))).groupBy("var", "lead", "model").agg(F.avg("scaled_crps").alias("loss"))
    key = F.struct("loss", "model")
    return s.groupBy("var", "lead").agg(F.min_by("model", key).alias("best"), F.min_by(F.when(F.col("model") != "climatology", F.col("model")), F.when(F.col("model") != "climatology", key)).alias("best_without"))


@query()
def r10_split_sample_tests(spark, d):
    """The better simple model of the early origins against climatology on the late ones, with verdicts over all comparisons."""
    return rounded(sg.held_out_tests(origin_losses(spark, d), COMPARISON, CUT, ["persistence", "seasonal_naive"], ["climatology"]), 6)


@query()
def r11_comparator_tests(spark, d):
    """Persistence against the comparator that the early origins choose, with and without climatology among the choices."""
    test = lambda baselines: sg.held_out_tests(origin_losses(spark, d), COMPARISON, CUT, ["persistence"], baselines)
    every, without = test(["climatology", "seasonal_naive"]), test(["seasonal_naive"])
    out = every.withColumn("pool", F.lit("all")).unionByName(without.withColumn("pool", F.lit("without climatology")))
    return rounded(out, 6)


SIMPLE = ["persistence", "seasonal_naive"]


@query()
def r9_pairwise_tests(spark, d):
    """Persistence against the better of the other two for each variable and lead."""
    return rounded(sg.best_pair_tests(late_scores(spark, d), COMPARISON, ["persistence"], ["climatology", "seasonal_naive"]), 9)


def against_climatology(losses: DataFrame, by: list[str]) -> DataFrame:
    """The simple models' losses with climatology's of the same ``by`` and origin as ``reference``."""
    reference = F.max(F.when(F.col("model") == "climatology", F.col("loss"))).over(Window.partitionBy(*by, "origin"))
    return losses.withColumn("reference", reference).where(F.col("model").isin(SIMPLE)).dropna(subset=["loss", "reference"])


def apart_from_zero(intervals: DataFrame) -> DataFrame:
    return rounded(intervals.withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0)), 6)


@query()
def r9_skill_intervals(spark, d):
    """Skill against climatology with block-bootstrap intervals."""
    out = sg.bootstrap(against_climatology(origin_losses(spark, d), COMPARISON), [*COMPARISON, "model"], ["loss", "reference"], "skill", seed=1)
    return rounded(out.withColumn("beats_climatology", F.col("low") > 0), 6)


@query()
def r9_equity_intervals(spark, d):
    """How much more skill persistence gains from the series A* to the series R* than the seasonal control does."""
    losses = sg.per_origin(late_scores(spark, d).withColumn("grp", F.substring("series_id", 1, 1)), [*COMPARISON, "grp", "model"])
    columns = ["persistence", "climatology", "seasonal_naive"]
    return apart_from_zero(sg.contrast(sg.side_by_side(losses, [*COMPARISON, "grp"], columns), COMPARISON, "grp", ("A", "R"), columns, sg.excess_gap, seed=2))


@query()
def r9_source_intervals(spark, d):
    """Skill on prices less skill on quantities, for each model and lead."""
    rows = against_climatology(origin_losses(spark, d), COMPARISON)
    return apart_from_zero(sg.contrast(rows, ["model", "lead"], "var", ("qty", "price"), ["loss", "reference"], sg.skill_gap, seed=4))


@query()
def r9_spell_intervals(spark, d):
    """Skill in active and break spells, resampled by spell; groups of five spells or more."""
    spells = labels.events(spell_days(spark, d)).where("spell in ('active', 'break')").select("event", "spell", F.explode(F.sequence("first", "last")).alias("date"))
    by = [*COMPARISON, "spell"]
    per = late_scores(spark, d).where("lead > 1").join(spells, "date").groupBy(*by, "model", F.col("event").alias("origin")).agg(F.avg("scaled_crps").alias("loss"))
    rows = against_climatology(per, by).withColumn("n_events", F.count("*").over(Window.partitionBy(*by, "model"))).where("n_events >= 5")
    return apart_from_zero(sg.bootstrap(rows, [*by, "model", "n_events"], ["loss", "reference"], "skill", block=1, seed=5))


@query()
def r9_ranks(spark, d):
    """Average ranks over the tasks of each lead, with Friedman's test and the critical difference."""
    return rounded(sg.friedman_by(task_losses(spark, d), ["lead"], ["var", "series_id"]), 9)


SKILLED = "(select a.*, 1 - a.scrps / b.scrps skill from board a join board b on b.model = 'climatology' and a.track = b.track and a.var = b.var and a.lead = b.lead where a.lead in (1, 7, 30))"


def skilled(spark, d):
    return ev.with_skill(ev.board(late_scores(spark, d), ["track", "var", "lead", "model"]), ["track", "var", "lead"])


@query(f"select a.lead, a.model, round(a.skill, 5) qty, round(b.skill, 5) price, round(b.skill - a.skill, 5) difference from {SKILLED} a join {SKILLED} b on a.var = 'qty' and b.var = 'price' and a.lead = b.lead and a.model = b.model")
def r5_between_sources(spark, d):
    """Each model's skill on quantities and on prices."""
    of = lambda v: F.max(F.when(F.col("var") == v, F.col("CRPSS_vs_clim")))
    s = skilled(spark, d).groupBy("lead", "model").agg(of("qty").alias("qty"), of("price").alias("price")).dropna()
    return rounded(s.withColumn("difference", F.col("price") - F.col("qty")))


@query(f"""select track, var, lead, baseline, round(b_skill, 5) baseline_skill, best, round(m_skill, 5) best_skill, m_loss < b_loss beats_baseline from (
  select track, var, lead, arg_min(model, (scrps, model)) filter (where model <> 'persistence') baseline, arg_min(skill, (scrps, model)) filter (where model <> 'persistence') b_skill,
    min(scrps) filter (where model <> 'persistence') b_loss, arg_min(model, (scrps, model)) filter (where model = 'persistence') best,
    arg_min(skill, (scrps, model)) filter (where model = 'persistence') m_skill, min(scrps) filter (where model = 'persistence') m_loss
  from {SKILLED} group by all)""")
def r5_best_against_baseline(spark, d):
    """For each task the best baseline and the best other model (persistence alone here), and which of them scores lower."""
    key = F.struct("sCRPS", "model")
    of = lambda test, value: F.min_by(F.when(test, F.col(value)), F.when(test, key))
    other = F.col("model") == "persistence"
    s = skilled(spark, d).groupBy("track", "var", "lead").agg(
        of(~other, "model").alias("baseline"), of(~other, "CRPSS_vs_clim").alias("baseline_skill"), of(other, "model").alias("best"), of(other, "CRPSS_vs_clim").alias("best_skill"),
        (of(other, "sCRPS") < of(~other, "sCRPS")).alias("beats_baseline"),
    )
    return rounded(s)


@query("select series_id, year(date)::int as year, round(100 * avg((y is not null)::int), 4) coverage from ship where var = 'qty' group by all")
def r12_coverage(spark, d):
    return ship(spark, d).where(QTY).groupBy("series_id", F.year("date").alias("year")).agg(F.round(100 * F.avg(F.col("y").isNotNull().cast("int")), 4).alias("coverage"))


@query("""select m::int as month, round(quantile_cont(mean, 0.25), 5) p25, round(median(mean), 5) mid, round(quantile_cont(mean, 0.75), 5) p75 from (
  select series_id, m, avg(total) mean from (select series_id, year(date) yr, month(date) m, case when count(y) >= 25 then sum(y) end total from ship where var = 'qty' group by all) group by all) group by m""")
def r13_seasonal_cycle(spark, d):
    total = F.when(F.count("y") >= 25, F.sum("y"))
    month = ship(spark, d).where(QTY).groupBy("series_id", F.year("date").alias("yr"), F.month("date").alias("month")).agg(total.alias("t"))
    mean = month.groupBy("series_id", "month").agg(F.avg("t").alias("m"))
    return rounded(mean.groupBy("month").agg(F.percentile("m", 0.25).alias("p25"), F.median("m").alias("mid"), F.percentile("m", 0.75).alias("p75")))


@query("select b::int as bin, count(*) n from (select least(floor(log10(y) * 4), 11) b from ship where var = 'qty' and y > 0) group by 1")
def r14_histogram(spark, d):
    return ship(spark, d).where(QTY).where("y > 0").select(F.least(F.floor(F.log10("y") * 4), F.lit(11)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


@query("""select shift, round(case when stddev_pop(x) > 0 and stddev_pop(z) > 0 then corr(x, z) end, 5) r, count(*) n from (
  select shift, a.v x, b.v z from (select date_trunc('month', date)::date m, sum(y) v from ship where var = 'qty' and y is not null group by 1) a,
    (select date_trunc('month', date)::date m, sum(y) v from region_obs where var = 'n' group by 1) b, (select unnest(range(0, 13))::int shift) s
  where b.m = (a.m - to_months(shift))::date) group by shift""")
def r15_lag_correlation(spark, d):
    month = lambda f: f.groupBy(F.trunc("date", "month").alias("m")).agg(F.sum("y").alias("v"))
    a = month(ship(spark, d).where(QTY).where("y is not null")).select(F.explode(F.sequence(F.lit(0), F.lit(12))).alias("shift"), "m", F.col("v").alias("x"))
    b = month(tracks.orders_region(spark, d).where("var = 'n'")).select(F.col("m").alias("bm"), F.col("v").alias("z"))
    both = a.join(b, F.col("bm") == F.add_months("m", -F.col("shift")))
    return both.groupBy("shift").agg(F.round(num.safe_corr("x", "z"), 5).alias("r"), F.count("*").alias("n"))


AGREE = "(select a.date, a.y f, b.y o from ship a join ship b on a.date = b.date and a.var = 'qty' and b.var = 'qty' and a.series_id = 'AF' and b.series_id = 'AO' where a.y is not null and b.y is not null)"


@query(f"""select k, round(case when stddev_pop(f) > 0 and stddev_pop(g) > 0 then corr(f, g) end, 6) r, count(*) n from (
   select -1 k, f, lead(o) over (order by date) g from {AGREE} union all select 0, f, o from {AGREE} union all select 1, f, lag(o) over (order by date) from {AGREE}) where g is not null group by k""")
def r16_agreement(spark, d):
    """Correlations at row shifts -1, 0 and 1 of the complete pairs."""
    s = ship(spark, d).where(QTY).where("y is not null")
    a = s.where("series_id = 'AF'").select("date", F.col("y").alias("f"))
    pairs = a.join(s.where("series_id = 'AO'").select("date", F.col("y").alias("o")), "date")
    order = Window.partitionBy(F.lit(0)).orderBy("date")  # one row a day
    rows = pairs.select("f", F.array(F.lead("o").over(order), F.col("o"), F.lag("o").over(order)).alias("g"))
    shifted = rows.select("f", F.posexplode("g").alias("p", "g")).where("g is not null").select((F.col("p") - 1).alias("k"), "f", "g")
    return shifted.groupBy("k").agg(F.round(num.safe_corr("f", "g"), 6).alias("r"), F.count("*").alias("n"))


@query("""select s_nationkey, s_suppkey, completeness from (select *, row_number() over (partition by s_nationkey order by s_acctbal > 5000 desc, completeness desc, s_suppkey) r from (
   select s_nationkey, s_suppkey, s_acctbal, round(coalesce(n, 0) / 2922.0::double, 6) completeness from supplier left join (select l_suppkey, count(distinct l_shipdate::date) n from lineitem group by 1) on l_suppkey = s_suppkey)) where r <= 2""")
def r17_station_selection(spark, d):
    days = tracks.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.countDistinct(F.to_date("l_shipdate")).alias("n"))
    s = tracks.table(spark, d, "supplier").join(days, F.col("l_suppkey") == F.col("s_suppkey"), "left").withColumn("completeness", F.round(F.coalesce("n", F.lit(0)) / 2922.0, 6))
    order = Window.partitionBy("s_nationkey").orderBy((F.col("s_acctbal") > 5000).desc(), F.col("completeness").desc(), "s_suppkey")
    return s.withColumn("r", F.row_number().over(order)).where("r <= 2").select("s_nationkey", "s_suppkey", "completeness")


@query("""select * from (select 'windows' claim, count(*) > 0 ok from win union all select 'unique', count(*) = count(distinct (track, var, series_id, origin)) from win
  union all select 'coverage_in_0_1', bool_and(cov between 0 and 1) from board union all select 'climatology_skill_zero', bool_and(1 - a.scrps / b.scrps = 0) from board a join board b on a.model = 'climatology' and b.model = 'climatology' and a.track = b.track and a.var = b.var and a.lead = b.lead
  union all select 'three_models', count(distinct model) = 3 from board)""")
def r20_claims(spark, d):
    s = ship(spark, d)
    w = sq.test_windows(s)
    b = ev.board(scores(spark, d), ["track", "var", "lead", "model"]).cache()
    one = lambda f, name, c: f.agg(c.alias("ok")).select(F.lit(name).alias("claim"), "ok")
    out = one(w, "windows", F.count("*") > 0).unionByName(one(w, "unique", F.count("*") == F.countDistinct(*KEYS, "origin")))
    out = out.unionByName(one(b, "coverage_in_0_1", F.bool_and(F.col("coverage80").between(0, 1)))).unionByName(one(ev.with_skill(b, ["track", "var", "lead"]).where("model = 'climatology'"), "climatology_skill_zero", F.bool_and(F.col("CRPSS_vs_clim") == 0)))
    return out.unionByName(one(b, "three_models", F.countDistinct("model") == 3))


@query("""select var, series_id, count(*) c0, count(*) filter (where f >= 0.5) c1, count(*) filter (where f >= 0.8) c2, count(*) filter (where f >= 0.95) c3, count(*) filter (where f >= 1) c4
  from (select var, series_id, ctx_obs_frac_365 f from win) group by var, series_id""")
def r22_feasibility(spark, d):
    w = sq.test_windows(ship(spark, d))
    return w.groupBy("var", "series_id").agg(F.count("*").alias("c0"), *(F.count_if(F.col("ctx_obs_frac_365") >= x).alias(f"c{i}") for i, x in ((1, 0.5), (2, 0.8), (3, 0.95), (4, 1.0))))


@query(f"select var, lead, {by_var('avg(q[9] - q[1])', 5)} width, {by_var('stddev_samp(mean)', 5)} spread from fc_clim group by var, lead")
def r23_dispersion(spark, d):
    s = ship(spark, d)
    f = ev.climatology(s, sq.test_windows(s), TRAIN_END, sq.H)
    return rounded_by_var(f.groupBy("var", "lead").agg(F.avg(F.col("`q0.9`") - F.col("`q0.1`")).alias("width"), F.stddev_samp("mean").alias("spread")), 5)


@query("""select base, min(context) filter (where loss = best) best_context, round(min(loss), 6) loss from (
  select *, min(loss) over (partition by base) best from (select lower(p_brand) base, p_size context, avg(p_retailprice) loss from part group by all)) group by base""")
def r7_best_context(spark, d):
    """The best context of each model from a table of runs: ties go to the shorter."""
    runs = tracks.table(spark, d, "part").groupBy(F.lower("p_brand").alias("base"), F.col("p_size").alias("context")).agg(F.avg("p_retailprice").alias("loss"))
    key = F.struct("loss", "context")
    return runs.groupBy("base").agg(F.min_by("context", key).alias("best_context"), F.round(F.min("loss"), 6).alias("loss"))


@query("select s_nationkey, count(*) runs, round(max(s_acctbal), 2) peak, round(count(*) / sum(abs(s_acctbal)), 9) per_second from supplier group by 1")
def r6_cost(spark, d):
    s = tracks.table(spark, d, "supplier")
    return s.groupBy("s_nationkey").agg(F.count("*").alias("runs"), F.round(F.max("s_acctbal"), 2).alias("peak"), F.round(F.count("*") / F.sum(F.abs("s_acctbal")), 9).alias("per_second"))


@query("select var, lead, " + ", ".join(f"round(max(case when model = '{m}' then scrps end), 5) {m}" for m in ev.MODELS) + " from board where lead in (1, 7, 30) group by var, lead")
def r18_table_view(spark, d):
    b = ev.board(scores(spark, d).where(F.col("lead").isin(1, 7, 30)), ["var", "lead", "model"])
    return rounded(b.groupBy("var", "lead").pivot("model", list(ev.MODELS)).agg(F.first("sCRPS")))


@query(f"""select a.lead, round((a.ps - b.ps) - (a.sn - b.sn), 6) did, round(1 - c.ps / c.cl, 6) crpss from {SKILLS} a join {SKILLS} b on a.lead = b.lead and a.grp = 'R' and b.grp = 'A'
  join (select lead, avg(case when model = 'persistence' then scaled_crps end) ps, avg(case when model = 'climatology' then scaled_crps end) cl from sc where lead in (1, 7, 30) group by lead) c on c.lead = a.lead""")
def r19_did_joined(spark, d):
    mean = lambda m: F.avg(F.when(F.col("model") == m, F.col("scaled_crps")))
    whole = scores(spark, d).where(F.col("lead").isin(1, 7, 30)).groupBy("lead").agg(F.round(num.skill(mean("persistence"), mean("climatology")), 6).alias("crpss"))
    return t10_r5_did(spark, d).join(whole, "lead")


@query(f"""select model, round(avg(scaled_crps), 5) "sCRPS", (select sum(violations) from {INTEGRITY})::int violations from sc where model = 'climatology' group by model""")
def r21_gate_then_score(spark, d):
    """The score of a forecast next to the number of its rule violations."""
    s = ship(spark, d)
    w = sq.test_windows(s)
    gate = ev.integrity(ev.climatology(s, w, TRAIN_END, sq.H), w, sq.H).agg(F.sum("violations").cast("int").alias("violations"))
    board = scores(spark, d).where("model = 'climatology'").groupBy("model").agg(F.round(F.avg("scaled_crps"), 5).alias("sCRPS"))
    return board.crossJoin(gate)  # one row each


@query(f"""select var, series_id, {by_var('avg(abs(y - p))', 7)} mae, {by_var('sqrt(avg((y - p) ** 2))', 7)} rmse, {by_var('avg(abs(y - p)) / nullif(avg(abs(y - s)), 0)', 7)} mase, {by_var('avg(coalesce((y between p - 50 and p + 50)::int, 0))', 7)} coverage
  from (select var, series_id, y, lag(y, 1) over w p, lag(y, 365) over w s from ship window w as (partition by var, series_id order by date)) group by var, series_id""")
def e6_metrics(spark, d):
    w = Window.partitionBy("var", "series_id").orderBy("date")
    x = ship(spark, d).select("var", "series_id", "y", F.lag("y", 1).over(w).alias("p"), F.lag("y", 365).over(w).alias("s"))
    y, p, s = F.col("y"), F.col("p"), F.col("s")
    out = x.groupBy("var", "series_id").agg(F.avg(F.abs(y - p)).alias("mae"), F.sqrt(F.avg((y - p) ** 2)).alias("rmse"), F.try_divide(F.avg(F.abs(y - p)), F.avg(F.abs(y - s))).alias("mase"), F.avg(num.covered(y, p - 50, p + 50)).alias("coverage"))
    return rounded_by_var(out, 7)
