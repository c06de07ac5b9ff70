"""Planted signals, golden numbers and tamper tests of the operators."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions import numeric as num
from tidemark.functions import numerics
from tidemark.operators import evaluation as ev
from tidemark.operators import forecasters as fc
from tidemark.operators import labels, panel
from tidemark.operators import significance as sg
from tidemark.sources import files, tracks
from tidemark.sources.tracks import KEYS

DAY = dt.date(2000, 1, 1)


def series(spark, values, start=DAY, name="s"):
    rows = [("t", "v", name, start + dt.timedelta(i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "track string, var string, series_id string, date date, y double")


def column(frame, name):
    return [r[name] for r in frame.orderBy("date").collect()]


def test_ring_day_traps(spark):
    days = {dt.date(2000, 2, 28): 59, dt.date(2000, 2, 29): 60, dt.date(2000, 3, 1): 60, dt.date(2001, 3, 1): 60, dt.date(2000, 12, 31): 365, dt.date(2001, 12, 31): 365}
    rows = spark.createDataFrame([(d,) for d in days], "date date").select("date", cal.ring_day("date").alias("r"), cal.dekad_of_year("date").alias("k")).collect()
    assert {r["date"]: r["r"] for r in rows} == days
    assert {r["date"]: r["k"] for r in rows}[dt.date(2000, 12, 31)] == 35


def test_phases_at_their_boundaries(spark):
    want = {"05-31": "pre_monsoon", "06-01": "onset", "06-15": "onset", "06-16": "peak", "10-15": "peak", "10-16": "withdrawal", "11-15": "withdrawal", "11-16": "dry", "02-28": "dry"}
    rows = spark.createDataFrame([(dt.date.fromisoformat(f"2001-{d}"),) for d in want], "date date").select("date", cal.monsoon_phase("date").alias("p")).collect()
    assert {f"{r['date']:%m-%d}": r["p"] for r in rows} == want


def test_a_day_that_a_year_does_not_have_is_an_error(spark):
    rows = spark.createDataFrame([(2021, 366)], "y int, d int")
    with pytest.raises(Exception, match="no day 366 in 2021"):
        rows.select(cal.day_of_year_date("y", "d")).collect()


def test_runs_merge_on_the_mask(spark):
    flags = column(panel.constant_runs(series(spark, [1, 3, 3, 5, 5, 5, 9])), "constant_run")
    assert flags == [False, True, True, True, True, True, False]
    rain = series(spark, [0] * 10 + [3.2, 5.1] + [0] * 10)
    assert not any(column(panel.constant_runs(rain, ignore=0.0), "constant_run"))
    noise = [25 + random.Random(i).gauss(0, 2) for i in range(60)]
    planted = noise[:20] + [21.5] * 8 + noise[28:]
    assert sum(column(panel.constant_runs(series(spark, planted)), "constant_run")) == 8


def test_linear_runs(spark):
    noise = [25 + random.Random(i).gauss(0, 2) for i in range(60)]
    planted = noise[:30] + [20 + i for i in range(7)] + noise[37:]
    assert column(panel.linear_runs(series(spark, planted)), "linear_run")[30:37] == [True] * 7
    assert not any(column(panel.linear_runs(series(spark, noise)), "linear_run"))


def test_off_grid(spark):
    rows = series(spark, [78, 79, 78.5, None, 80]).withColumn("f", panel.off_grid(F.col("y"), 0))
    assert column(rows, "f") == [False, False, True, False, False]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-9, 9)), min_size=1, max_size=30))
def test_interpolation_is_that_of_numpy(spark, values):
    got = column(panel.interpolated(series(spark, values), empty=0.0), "filled")
    assert np.allclose(got, numpy_fill(values))


def numpy_fill(values):
    seen = [i for i, v in enumerate(values) if v is not None]
    return np.interp(np.arange(len(values)), seen, [values[i] for i in seen]) if seen else np.zeros(len(values))


def test_contexts_are_cut_and_filled(spark):
    rng = random.Random(2)
    every = [[None if rng.random() < 0.4 else float(rng.randrange(9)) for _ in range(rng.randint(1, 20))] for _ in range(60)] + [[None, None], [None, 1.0, None, 3.0, None]]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(every)], "i int, context array<double>")
    got = {r["i"]: (r["a"], r["b"]) for r in rows.select("i", fc.observed_part(F.col("context"), 8).alias("a"), fc.without_gaps(F.col("context")).alias("b")).collect()}
    for i, c in enumerate(every):
        tail = c[-8:]
        first = next((k for k, v in enumerate(tail) if v is not None), len(tail) - 1)
        assert got[i][0] == tail[first:]
        assert np.allclose(got[i][1], numpy_fill(c))


def test_series_kept_by_the_state_of_the_files(spark, tmp_path):
    from tidemark.session import kept

    read = lambda: spark.read.parquet(f"{tmp_path}/t.parquet")
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    assert kept(spark, ("k", str(tmp_path)), read).count() == 3
    assert kept(spark, ("k", str(tmp_path)), read) is kept(spark, ("k", str(tmp_path)), read)
    spark.range(5).write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
    assert kept(spark, ("k", str(tmp_path)), read).count() == 5


def gappy(spark, years=5, seed=0):
    rng = random.Random(seed)
    n = 365 * years
    values = [None if rng.random() < 0.003 else 20 + 8 * math.sin(2 * math.pi * i / 365) + rng.gauss(0, 1) for i in range(n)]
    return values, series(spark, values)


def test_windows_against_enumeration(spark):
    values, s = gappy(spark)
    start, end = "2003-01-01", "2003-12-31"
    got = {r["origin"] for r in ev.windows(s, start, end, horizon=30).collect()}
    want, o = set(), dt.date(2002, 12, 31)
    while o + dt.timedelta(30) <= dt.date(2003, 12, 31):
        i = (o - DAY).days
        if i + 30 < len(values) and all(v is not None for v in values[i + 1 : i + 31]):
            want.add(o)
        o += dt.timedelta(7)
    assert got == want and want
    ev.check_windows(ev.windows(s, start, end, horizon=30), start, end, 30)
    with pytest.raises(ValueError):
        ev.check_windows(ev.windows(s, start, end, horizon=30), start, "2003-06-30", 30)


def test_the_future_does_not_leak(spark):
    values, s = gappy(spark)
    w = ev.windows(s, "2003-01-01", "2003-03-31", horizon=7)
    changed = s.withColumn("y", F.when(F.col("date") > "2003-02-28", 999.0).otherwise(F.col("y")))
    early = lambda f: sorted(map(repr, f.where("origin <= '2003-02-21'").collect()))
    for model in ev.MODELS.values():
        assert early(model(s, w, "2002-12-31", 7)) == early(model(changed, w, "2002-12-31", 7))
    assert ev.climatology_table(s, "2001-12-31").collect().sort() == ev.climatology_table(changed, "2001-12-31").collect().sort()


def test_a_perfect_forecast_scores_zero_and_passes_the_gate(spark):
    _, s = gappy(spark)
    w = ev.windows(s, "2003-01-01", "2003-06-30", horizon=7)
    truth = ev.targets(w, 7).join(s, [*KEYS, "date"]).withColumns({"mean": F.col("y"), **{n: F.col("y") for n in ev.Q}}).select(*ev.FORECAST)
    got = ev.scored(truth, s, ev.train_scales(s, "2002-12-31")).agg(F.max("crps").alias("c"), F.max("sq_err").alias("s"), F.min(F.col("hit80").cast("int")).alias("h")).first()
    assert (got["c"], got["s"], got["h"]) == (0, 0, 1)
    assert sum(r["violations"] for r in ev.integrity(truth, w, 7).collect()) == 0
    bad = truth.withColumn("q0.9", F.lit(-1.0)).where("lead <> 3")
    found = {r["rule"]: r["violations"] for r in ev.integrity(bad, w, 7).collect()}
    assert found["not_monotone"] and found["negative"] and found["bad_leads"] and found["row_count"]


def test_median_for_absolute_and_mean_for_squared_errors(spark):
    s = series(spark, [10.0] * 3)
    f = spark.createDataFrame([("t", "v", "s", DAY, 1, 12.0, *([9.0] * 9))], "track string, var string, series_id string, origin date, lead int, mean double, " + ", ".join(f"`{n}` double" for n in ev.Q))
    r = ev.scored(f, s, spark.createDataFrame([("t", "v", "s", 2.0)], "track string, var string, series_id string, scale double")).first()
    assert (r["abs_err"], r["sq_err"], r["ase"]) == (1.0, 4.0, 0.5)


def test_zero_scale_gives_null(spark):
    s = series(spark, [5.0] * 800)
    f = ev.scored(ev.climatology(s, ev.windows(s, "2001-06-01", "2001-12-31", horizon=3), "2001-05-31", 3), s, ev.train_scales(s, "2001-05-31"))
    assert f.where("ase is not null").count() == 0 and f.count() > 0


def test_gap_matching(spark):
    ids = np.arange(50)
    assert (fc.assigned_donors(ids, 7) == fc.assigned_donors(np.arange(200), 7)[:50]).all()
    with pytest.raises(ValueError):
        fc.assigned_donors(ids, 0)
    rows = spark.createDataFrame([([1.0, 2.0, 3.0], [True, False, True, False]), ([1.0, 2.0, 3.0], [True]), ([], [True])], "context array<double>, missing array<boolean>")
    assert [r[0] for r in rows.select(fc.apply_mask("context", "missing")).collect()] == [[1.0, None, 3.0], [1.0, 2.0, None], []]
    kind = "track string, var string, series_id string, origin date, context array<double>"
    owners = spark.createDataFrame([("t", "v", "s", DAY, [1.0, None, 3.0])], kind)
    assert [fc.donor_masks(owners, n).first()["missing"] for n in (2, 3, 5)] == [[True, False], [False, True, False], [True, True, False, True, False]]
    with pytest.raises(ValueError):
        fc.donor_masks(owners.limit(0), 2)


def test_gap_matched_query_against_numpy(spark):
    from tidemark.plans import series_queries as sq
    from tidemark.plans import study_queries as st_q

    sf = "/root/testdata/sf0.01"
    days = {}
    for r in sq.ship(spark, sf).collect():
        days.setdefault((r["track"], r["series_id"], r["var"]), {})[r["date"]] = r["y"]
    windows = sorted((r["track"], r["series_id"], r["var"], r["origin"]) for r in sq.test_windows(sq.ship(spark, sf)).collect())
    cut = lambda w: [days[w[:3]][d] for d in sorted(days[w[:3]]) if d <= w[3]][-64:]
    got = {r["window_id"]: r for r in st_q.h13_gap_matching(spark, sf).collect()}
    assert sorted(got) == list(range(len(windows)))
    donors = {v: [w for w in windows if w[2] == v] for v in {w[2] for w in windows}}
    draw = {v: np.random.default_rng(0).integers(0, len(d), size=len(windows)) for v, d in donors.items()}
    for i, w in enumerate(windows):
        own, of = cut(w), cut(donors[w[2]][draw[w[2]][i]])
        of = [None] * (64 - len(of)) + of
        left = [x for x, m in zip(own, of[len(of) - len(own) :]) if x is not None and m is not None]
        assert (got[i]["donor"], got[i]["kept"]) == (draw[w[2]][i], len(left))
        assert got[i]["total"] == pytest.approx(sum(left), abs=1e-3)


def test_forecaster_contract():
    class Wrong:
        max_context, native_gaps = 10, False

        def predict_batch(self, contexts, horizon):
            return np.zeros((1, 2)), np.zeros((1, 9, 2))

    with pytest.raises(ValueError):
        fc.predicted(Wrong(), [np.zeros(3)] * 2, 2)
    with pytest.raises(KeyError):
        fc.load("nothing")
    for name in fc.REGISTRY:
        mean, q = fc.predicted(fc.load(name), [np.arange(30.0), np.zeros(1)], 5)
        assert mean.shape == (2, 5) and (np.diff(q, axis=1) >= 0).all()


def test_forecasts_of_departures_add_the_climatology_back(spark):
    """A model that repeats its context's last value, against plain code; a gap at the origin takes the nearest value."""

    class Last:
        max_context, native_gaps = 730, False

        def predict_batch(self, contexts, horizon):
            mean = np.array([[c[-1]] * horizon for c in contexts])
            return mean, mean[:, None, :] + np.arange(-4.0, 5.0)[None, :, None]

    fc.register("last", Last)
    try:
        start, end = dt.date(2000, 1, 1), dt.date(2001, 12, 31)
        days = [start + dt.timedelta(days=i) for i in range(900)]
        y = {d: 50.0 + 20 * np.sin(i / 58.0) + i % 7 for i, d in enumerate(days)}
        origin = days[800]
        gaps = {origin, days[799], days[400]}
        rows = [("t", "v", "s", d, None if d in gaps else float(y[d])) for d in days]
        series = spark.createDataFrame(rows, "track string, var string, series_id string, date date, y double")
        windows = spark.createDataFrame([("t", "v", "s", origin)], "track string, var string, series_id string, origin date")
        got = {r["lead"]: r for r in fc.on_anomalies(series, windows, end.isoformat(), "last", 3).collect()}

        def ring(d):
            n = d.timetuple().tm_yday
            leap = d.year % 4 == 0 and (d.year % 100 != 0 or d.year % 400 == 0)
            return min(n - (1 if leap and d.month > 2 else 0), 365)

        def usual(d):
            near = [v for e, v in y.items() if e <= end and e not in gaps and min((ring(e) - ring(d)) % 365, (ring(d) - ring(e)) % 365) <= 15]
            return np.mean(near)

        away = y[days[798]] - usual(days[798])
        for h in (1, 2, 3):
            want = away + usual(origin + dt.timedelta(days=h))
            assert got[h]["mean"] == pytest.approx(want) and got[h]["q0.1"] == pytest.approx(max(want - 4, 0))
    finally:
        del fc.REGISTRY["last"]


def test_boosted_features_and_intervals(spark):
    from tidemark.operators import boosted

    rng = np.random.default_rng(5)
    days = [dt.date(1996, 1, 1) + dt.timedelta(days=i) for i in range(1700)]
    rows = [("t", "v", s, d, None if (i + j) % 11 == 0 else float(30 + 5 * j + rng.normal(0, 2))) for j, s in enumerate("ab") for i, d in enumerate(days)]
    series = spark.createDataFrame(rows, "track string, var string, series_id string, date date, y double").cache()
    y = {(r[2], r[3]): r[4] for r in rows}
    known = {(r["series_id"], r["date"]): r for r in boosted.origins(series, "1998-12-31").collect()}
    table = {(r["series_id"], r["doy"]): r["mean"] for r in ev.climatology_table(series, "1998-12-31").collect()}
    for s, i in (("a", 1), ("a", 500), ("b", 1001), ("b", 1002)):
        away = [None if y[s, d] is None else y[s, d] - table[s, d.timetuple().tm_yday - (1 if d.year == 1996 and d.month > 2 else 0)] for d in days[max(i - 29, 0) : i + 1]]
        week = [x for x in away[-7:] if x is not None]
        row = known[s, days[i]]
        assert row["pos"] == i and row["code"] == "ab".index(s)
        assert row["mean_7"] == pytest.approx(np.mean(week) if week else 0.0)
        assert row["lag_0"] == pytest.approx(np.mean(week) if away[-1] is None else away[-1])
        assert row["observed_30"] == pytest.approx(sum(x is not None for x in away) / 30)
    windows = ev.windows(series, "2000-01-01", "2000-07-31", 3, 7, 365)
    got = boosted.forecast(series, windows, "1998-12-31", "1999-01-01", "1999-12-31", 3, rounds=2, depth=2).collect()
    assert len(got) == 3 * windows.count() > 0
    for r in got:
        q = [r[n] for n in ev.Q]
        assert q == sorted(q) and r["mean"] == pytest.approx(q[4])
        assert abs(r["mean"] - (30 if r["series_id"] == "a" else 35)) < 4


def test_best_pair_tests_against_numpy(spark):
    rng, rows = np.random.default_rng(8), []
    for v, shift in {"a": {"x": -0.3, "y": 0.1, "b": 0.0}, "z": {"x": 0.2, "y": 0.4, "b": 0.1}}.items():
        for m, k in shift.items():
            for i in range(40):
                rows += [(v, 7, m, s, dt.date(2020, 1, 1) + dt.timedelta(days=7 * i), float(2 + k + rng.normal(0, 0.2))) for s in "pqrst"]
    rows.append(("a", 7, "b", "p", dt.date(2022, 1, 1), None))
    frame = spark.createDataFrame(rows, "var string, lead int, model string, series_id string, origin date, scaled_crps double")
    got = {r["var"]: r for r in sg.best_pair_tests(frame, ["var", "lead"], ["x", "y"], ["b"]).collect()}
    p = {}
    for v in "az":
        mean = lambda m, unit: {u: np.mean([r[5] for r in rows if r[0] == v and r[2] == m and r[unit] == u and r[5] is not None]) for u in {r[unit] for r in rows if r[5] is not None}}  # noqa: B023, E731
        c, b = mean("x", 4), mean("b", 4)
        diff = np.array([c[u] - b[u] for u in sorted(c)])
        n, e = len(diff), diff - diff.mean()
        variance = e @ e / n + 2 * sum((1 - k / 7) * (e[k:] @ e[:-k]) / n for k in range(1, 7))
        stat = diff.mean() / np.sqrt(variance / n) * np.sqrt((n + 1 - 14 + 42 / n) / n)
        cs, bs = mean("x", 3), mean("b", 3)
        p[v] = numerics.t_two_sided(stat, n - 1)
        r = got[v]
        assert (r["candidate"], r["baseline"], r["n"], r["n_series"]) == ("x", "b", 40, 5)
        assert (r["statistic"], r["p"]) == (pytest.approx(stat), pytest.approx(p[v]))
        assert r["wilcoxon_p"] == pytest.approx(numerics.wilcoxon_p(np.array([cs[s] - bs[s] for s in sorted(cs)])))
    assert got["a"]["verdict"] == "candidate" and got["z"]["verdict"] == ("baseline" if got["z"]["p_holm"] < 0.05 else "neither")
    assert min(r["p_holm"] for r in got.values()) == pytest.approx(min(1, 2 * min(p.values())))


def test_contrast_resamples_its_samples_apart(spark):
    rng = np.random.default_rng(4)
    sample = {g: rng.gamma(4, 1, (n, 3)) for g, n in (("a", 30), ("b", 45))}
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)
    rows = [("k", g, day(i), *map(float, r)) for g, x in sample.items() for i, r in enumerate(x)]
    rows += [("only one side", "a", day(0), 1.0, 1.0, 1.0), ("k", "another", day(0), 1.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "task string, side string, origin date, m double, ref double, ctl double")
    (got,) = sg.contrast(frame, ["task"], "side", ("a", "b"), ["m", "ref", "ctl"], sg.excess_gap, draws=200, seed=2).collect()
    skill = lambda x, c: 1 - x[:, c].mean() / x[:, 1].mean()
    want = lambda a, b: skill(b, 0) - skill(a, 0) - (skill(b, 2) - skill(a, 2))
    drawn = [want(sample["a"][i], sample["b"][j]) for i, j in zip(sg.resamples(30, 8, 200, 2), sg.resamples(45, 8, 200, 3))]
    assert got["task"] == "k" and got["estimate"] == pytest.approx(want(sample["a"], sample["b"]))
    assert (got["low"], got["high"]) == (pytest.approx(np.quantile(drawn, 0.025)), pytest.approx(np.quantile(drawn, 0.975)))


def test_friedman_by_group_equals_the_test_of_each_group(spark):
    rng = np.random.default_rng(2)
    rows = [(g, f"t{t}", m, float(rng.integers(0, 4))) for g in (1, 7) for t in range(12) for m in "abcd"] + [(7, "short", "a", 1.0)]
    frame = spark.createDataFrame(rows, "lead int, task string, model string, loss double")
    got = {(r["lead"], r["model"]): r for r in sg.friedman_by(frame, ["lead"], ["task"]).collect()}
    assert len(got) == 8
    for g in (1, 7):
        for r in sg.friedman(frame.where(F.col("lead") == g), ["task"]).collect():
            own = got[g, r["model"]]
            assert (own["avg_rank"], own["n_tasks"], own["chi2"]) == (pytest.approx(r["avg_rank"]), 12, pytest.approx(r["chi2"]))
            assert (own["p"], own["cd"]) == (pytest.approx(numerics.chi2_upper(r["chi2"], 3)), pytest.approx(numerics.nemenyi_difference(4, 12)))


def test_distribution_functions():
    assert numerics.nemenyi_difference(18, 16) == pytest.approx(6.584748158039672, rel=1e-9)
    assert numerics.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074037, rel=1e-10)
    assert numerics.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-10)
    assert numerics.chi2_upper(220.07, 17) < 1e-36
    assert numerics.wilcoxon_p(np.array([1.0, 2.0, 3.0, 4.0, 5.0])) == pytest.approx(0.0625)
    assert numerics.wilcoxon_p(np.zeros(5)) == 1.0


def test_holm(spark):
    rows = spark.createDataFrame([("a", 0.001), ("b", 0.02), ("c", 0.04)], "k string, p double")
    assert {r["k"]: pytest.approx(r["p_holm"]) for r in sg.holm(rows).collect()} == {"a": 0.003, "b": 0.04, "c": 0.04}
    rows = rows.union(spark.createDataFrame([("d", None)], "k string, p double"))
    got = {r["k"]: r["p_holm"] for r in sg.holm(rows).collect()}
    assert got["d"] is None and got["a"] == pytest.approx(0.004)


def test_held_out_tests_against_numpy(spark):
    rng, day = np.random.default_rng(3), lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)
    shift = {"a": {"x": 0.1, "y": -0.4, "b": 0.0, "c": 0.2}, "z": {"x": 0.5, "y": 0.6, "b": 0.0, "c": -0.1}, "e": {"x": 0.0, "y": 0.0, "b": 0.0, "c": 0.0}}
    loss = {(v, m): 2 + s + rng.normal(0, 0.3, 80) for v, by in shift.items() for m, s in by.items()}
    rows = [(v, 3, m, day(i), float(x)) for (v, m), xs in loss.items() for i, x in enumerate(xs) if (v, m, i) != ("a", "c", 70)]
    rows += [("late", 3, m, day(60 + i), float(i)) for m in "xybc" for i in range(5)]  # nothing to choose by
    frame = spark.createDataFrame(rows, "var string, lead int, model string, origin date, loss double")
    got = {r["var"]: r for r in sg.held_out_tests(frame, ["var", "lead"], "2020-02-10", ["x", "y"], ["b", "c"]).collect()}
    assert set(got) == set(shift)
    p = {}
    for v in shift:
        keep = np.array([i for i in range(80) if (v, i) != ("a", 70)])
        early, late = keep[keep < 40], keep[keep >= 40]
        a, b = (min(g, key=lambda m: loss[v, m][early].mean()) for g in ("xy", "bc"))
        d = loss[v, a][late] - loss[v, b][late]
        c, n = d - d.mean(), len(d)
        var = sum((1 if k == 0 else 2 * (1 - k / 3)) * (c[k:] * c[: n - k]).sum() / n for k in range(3))
        stat = d.mean() / np.sqrt(var / n) * np.sqrt((n + 1 - 6 + 6 / n) / n)
        p[v] = numerics.t_two_sided(stat, n - 1)
        assert (got[v]["candidate"], got[v]["baseline"], got[v]["n_select"], got[v]["n"]) == (a, b, len(early), n)
        assert got[v]["statistic"] == pytest.approx(stat) and got[v]["p"] == pytest.approx(p[v])
    worst = 0.0
    for i, v in enumerate(sorted(p, key=p.get)):
        worst = max(worst, min(1.0, (3 - i) * p[v]))
        assert got[v]["p_holm"] == pytest.approx(worst)
        assert got[v]["verdict"] == ("neither" if worst >= 0.05 else "candidate" if got[v]["mean_diff"] < 0 else "baseline")
    assert {got["a"]["verdict"], got["z"]["verdict"]} == {"candidate", "baseline"}


def test_diebold_mariano_against_numpy(spark):
    rng = np.random.default_rng(3)
    d = rng.normal(0.2, 1, 60)
    rows = spark.createDataFrame([(DAY + dt.timedelta(7 * i), float(v), 7) for i, v in enumerate(d)], "origin date, d double, lead int")
    c = d - d.mean()
    v = (c @ c) / 60 + sum(2 * (1 - k / 7) * (c[k:] @ c[:-k]) / 60 for k in range(1, 7))
    want = d.mean() / math.sqrt(v / 60) * math.sqrt((60 + 1 - 14 + 42 / 60) / 60)
    got = sg.diebold_mariano(rows, ["lead"]).withColumn("p", sg.t_p_value("statistic", "n")).first()
    assert got["statistic"] == pytest.approx(want) and got["p"] == pytest.approx(numerics.t_two_sided(want, 59))


def test_bootstrap():
    every, rng = sg.resamples(50, 8, 5, 0), np.random.default_rng(0)
    for i in every:  # one draw of all starts is the generator's sequence of single draws
        starts = rng.integers(0, 43, size=7)
        assert i.tolist() == [s + k for s in starts for k in range(8)][:50]
    two = sg.bootstrap_ci([np.full((30, 1), 3.0), np.full((20, 1), 1.0)], lambda a, b: a[..., 0].mean(-1) - b[..., 0].mean(-1), draws=50)
    assert two == (2.0, 2.0, 2.0)
    m, low, high = sg.bootstrap_ci(np.random.default_rng(1).normal(1, 1, (200, 1)), draws=300)
    assert low < m < high and high - low < 0.6


def test_bootstrap_query_draws_two_thousand(spark, monkeypatch):
    from tidemark.plans import study_queries as st_q

    rng = np.random.default_rng(4)
    m = rng.gamma(4.0, 1.0, (60, 2))
    rows = [("v", 7, DAY + dt.timedelta(i), name, float(m[i, j])) for i in range(60) for j, name in enumerate(("persistence", "climatology"))]
    monkeypatch.setattr(st_q, "origin_losses", lambda *_: spark.createDataFrame(rows, "var string, lead int, origin date, model string, loss double"))
    got = st_q.t5_t6_bootstrap(spark, "").first()
    assert tuple(got)[2:] == pytest.approx(sg.bootstrap_ci(m, "skill", draws=2000), abs=2e-6)
    assert tuple(got)[2:] != pytest.approx(sg.bootstrap_ci(m, "skill", draws=400), abs=2e-6)


def test_spatial(spark):
    square = {"a": [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], "b": [(5.0, 0.0), (6.0, 0.0), (6.0, 1.0)]}
    rows = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0), (5.9, 0.1), (4.5, 0.0)], "x double, y double")
    got = [(r["polygon"], r["matched"], r["dist"]) for r in labels.located(rows, square).collect()]
    assert got == [("a", "within", 0.0), ("a", "nearest", 1.0), ("b", "within", 0.0), ("b", "nearest", 0.5)]


def test_spells_and_extremes(spark):
    rng = random.Random(0)
    days = [DAY + dt.timedelta(i) for i in range(365 * 6)]
    wet = {dt.date(2004, 7, d) for d in range(10, 15)}
    dry = {dt.date(2005, 8, d) for d in range(5, 10)}
    rows = series(spark, [60.0 if d in wet else 0.0 if d in dry else 10 + 5 * math.sin(d.timetuple().tm_yday / 58) + rng.gauss(0, 0.5) for d in days])
    got = {r["date"]: r["spell"] for r in labels.spells(rows.drop("track", "var"), "2003-12-31", ["series_id"]).collect()}
    assert all(got[d] == "active" for d in wet) and all(got[d] == "break" for d in dry) and got[dt.date(2004, 6, 1)] == ""
    flags = labels.extremes(rows, labels.thresholds(rows, "2003-12-31", ["series_id"]), ["series_id"]).where("very_heavy").select("date").collect()
    assert wet <= {r["date"] for r in flags}


def test_element_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("X,20200101,PRCP,125,,,S,\nX,20200101,TAVG,200,,,S,\nX,20200102,PRCP,50,,I,S,\nX,20200103,SNOW,1,,,S,\n")
    rows = {r["date"].day: r for r in files.element_daily(spark, str(tmp_path / "x.csv")).collect()}
    assert set(rows) == {1} and (rows[1]["Rainfall"], rows[1]["Tavg"], rows[1]["Tmax"]) == (12.5, 20.0, None)
    assert files.element_daily(spark, str(tmp_path / "x.csv"), drop_failed=False).count() == 2


def test_other_sources(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Station,Year,Month,Day,Rainfall,Temperature,Humidity,Sunshine\nA,2020,2,29,1,2,3,4\n")
    assert files.station_daily(spark, str(tmp_path / "s.csv")).first()["date"] == dt.date(2020, 2, 29)
    (tmp_path / "y_k7.csv").write_text("YEAR,DOY,T\n2021,60,-999\n2020,60,1.5\n")
    got = {r["date"]: r["T"] for r in files.year_day(spark, str(tmp_path / "y_k7.csv"), ["T"]).collect()}
    assert got == {dt.date(2021, 3, 1): None, dt.date(2020, 2, 29): 1.5}
    assert files.keyed_by_name(spark, str(tmp_path / "y_*.csv"), r"_k(\d+)\.csv", "YEAR int, DOY int, T double").first()["key"] == "7"
    with pytest.raises(ValueError):
        files.unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"])
    (tmp_path / "m.txt").write_text("  2000 2001\n2000 " + " ".join(str(i) for i in range(12)) + "\n2001 " + " ".join(["-99.9"] * 12) + "\n1999 " + " ".join(["1"] * 12) + "\nnote\n")
    month = {r["date"]: r["value"] for r in files.monthly_table(spark, str(tmp_path / "m.txt")).collect()}
    assert len(month) == 24 and month[dt.date(2000, 3, 1)] == 2.0 and month[dt.date(2001, 1, 1)] is None
    (tmp_path / "j.json").write_text('{"properties": {"parameter": {"T2M": {"20200101": 1.5, "20200102": -999}}}}')
    assert [r["value"] for r in files.nested_json(spark, str(tmp_path / "j.json")).orderBy("date").collect()] == [1.5, None]
    (tmp_path / "f.txt").write_text("AB 12.5\nCD     \n")
    assert [tuple(r) for r in files.fixed_width(spark, str(tmp_path / "f.txt"), {"id": (0, 2), "v": (3, 7)}).collect()] == [("AB", "12.5"), ("CD", None)]
    (tmp_path / "g.json").write_text('{"features": [{"properties": {"n": "a"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]}')
    assert files.polygons(spark, str(tmp_path / "g.json"), ["n"]).first()["ring"][1] == [1.0, 0.0]
    (tmp_path / "u.csv").write_text("sid,lat\n ,degrees\nS1, 12.5\nS2,bad\n")
    assert [tuple(r) for r in files.with_units_row(spark, str(tmp_path / "u.csv"), {"sid": "string", "lat": "double"}, "lat").collect()] == [("S1", 12.5)]
    assert files.latest(spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "k string, t int"), "k", "t").count() == 2
    assert len(files.manifest(spark, str(tmp_path / "u.csv")).first()["sha256"]) == 64


def test_gridded_merge_skips_missing(spark, tmp_path):
    head = "date,adm_level,PCODE,n_pixels,rfh,rfh_avg,r1h,r1h_avg,r3h,r3h_avg,version\n"
    (tmp_path / "d.csv").write_text(head + "2020-01-01,2,P,1,10,5,1,0,,1,final\n2020-01-01,2,P,3,20,5,1,0,4,1,prelim\n2020-01-01,1,P,9,1,1,1,1,1,1,final\n")
    r = files.gridded_dekads(spark, str(tmp_path / "d.csv")).first()
    assert (r["rfh"], r["r3h"], r["n_pixels"], r["n_rows"], r["any_prelim"], r["rfq"], r["r1q"]) == (17.5, 4.0, 4.0, 2, True, 350.0, None)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("m_1", 0.5), ("b", None)], "model string, MASE double")
    assert files.write_once(spark, rows, str(tmp_path / "cache"), "test", "m", "t", "v") and not files.write_once(spark, rows, str(tmp_path / "cache"), "test", "m", "t", "v")
    assert spark.read.parquet(str(tmp_path / "cache")).where("split = 'test' and model = 'm'").count() == 2
    files.append_records(rows, str(tmp_path / "log"))
    files.append_records(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    files.write_report(rows, str(tmp_path / "report"))
    assert r"m\_1 & \textbf{0.500} \\" in files.latex_table([r.asDict() for r in rows.collect()], ["model", "MASE"], {"MASE": "min"})


def test_shifted_outer_join(spark):
    rows = spark.createDataFrame([("a", DAY, 1.0, 5.0), ("a", DAY + dt.timedelta(1), 2.0, 6.0)], "station string, date date, rain double, temp double")
    got = {r["date"]: (r["rain"], r["temp"]) for r in files.shift_day(rows, "rain", ["station"]).collect()}
    assert got == {DAY: (None, 5.0), DAY + dt.timedelta(1): (1.0, 6.0), DAY + dt.timedelta(2): (2.0, None)}


def test_unknown_track(spark):
    with pytest.raises(KeyError):
        tracks.load_track(spark, "/root/testdata/sf0.001", "nothing")


def test_correlation_without_variance_is_null(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "x double, y double")
    assert rows.agg(num.safe_corr("x", "y")).first()[0] is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
