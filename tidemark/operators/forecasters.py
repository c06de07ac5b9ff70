"""Pluggable forecasters and the gap-matching of their contexts.

A forecaster maps contexts to a mean and nine quantiles. The classical ones here are small substitutes of our own, named for
what they do; they are not the automatic model search of statistical packages nor any pretrained network.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import ring_day
from tidemark.functions.numeric import QUANTILE_NAMES, QUANTILES, let
from tidemark.operators import evaluation as ev
from tidemark.sources.tracks import KEYS

NORMAL = np.array([-1.2815515655446004, -0.8416212335729143, -0.5244005127080409, -0.2533471031357997, 0.0, 0.2533471031357997, 0.5244005127080409, 0.8416212335729143, 1.2815515655446004])


# --- contexts -----------------------------------------------------------------------------------------------------


def observed_part(context: Column, length: int) -> Column:
    """The last ``length`` values from the first observed one on; the last value alone where none is observed."""

    def from_first(c: Column) -> Column:
        at = F.array_position(F.transform(c, lambda v: v.isNotNull()), F.lit(True)).cast("int")
        return F.when(at > 0, F.slice(c, at, F.greatest(F.size(c), F.lit(1)))).otherwise(F.slice(c, F.greatest(F.size(c), F.lit(1)), 1))

    return let(F.slice(context, F.greatest(F.size(context) - length, F.lit(0)) + 1, F.lit(length)), from_first)


def _carried(values: Column) -> Column:
    """For each place the last observed value up to it and where it stands."""
    seen = "struct<v:double,p:int>"

    def step(s: Column, v: Column) -> Column:
        last = F.when(v.isNotNull(), F.struct(v.alias("v"), F.size(s["out"]).alias("p"))).otherwise(s["last"])
        return F.struct(last.alias("last"), F.concat(s["out"], F.array(last)).alias("out"))

    return F.aggregate(values, F.struct(F.lit(None).cast(seen).alias("last"), F.array().cast(f"array<{seen}>").alias("out")), step)["out"]


def without_gaps(context: Column) -> Column:
    """Gaps on the straight line between their observed neighbours, the nearest one beyond the ends; zeros where nothing is observed."""

    def value(x: Column, i: Column, a: Column, b: Column, n: Column) -> Column:
        right = n - 1 - b["p"]
        line = a["v"] + (b["v"] - a["v"]) * F.try_divide(i - a["p"], right - a["p"])
        return F.coalesce(x, line, a["v"], b["v"], F.lit(0.0))

    both = F.struct(context.alias("c"), _carried(context).alias("a"), F.reverse(_carried(F.reverse(context))).alias("b"))
    return let(both, lambda s: F.transform(s["c"], lambda x, i: value(x, i, F.get(s["a"], i), F.get(s["b"], i), F.size(s["c"]))))


class Forecaster(Protocol):
    max_context: int
    native_gaps: bool

    def predict_batch(self, contexts: list[np.ndarray], horizon: int) -> tuple[np.ndarray, np.ndarray]:
        """Means [n, horizon] and quantiles [n, 9, horizon]."""


def _fan(mean: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return mean, mean[None, :] + NORMAL[:, None] * sigma[None, :]


class ExponentialSmoothing:
    """Simple exponential smoothing with the level's weight from a small grid."""

    max_context, native_gaps = 730, False

    def predict_batch(self, contexts, horizon):
        means, fans = [], []
        for x in contexts:
            best = None
            for a in (0.05, 0.1, 0.2, 0.3, 0.5, 0.8):
                level, errors = x[0], []
                for v in x[1:]:
                    errors.append(v - level)
                    level += a * (v - level)
                loss = float(np.mean(np.square(errors))) if errors else 0.0
                if best is None or loss < best[0]:
                    best = (loss, a, level)
            loss, a, level = best
            m, f = _fan(np.full(horizon, level), np.sqrt(loss * (1 + np.arange(horizon) * a * a)))
            means.append(m)
            fans.append(f)
        return np.array(means), np.array(fans)


class DriftTheta:
    """Half the drift of a straight line on top of the smoothed level."""

    max_context, native_gaps = 730, False

    def predict_batch(self, contexts, horizon):
        base, fans = ExponentialSmoothing().predict_batch(contexts, horizon)
        for i, x in enumerate(contexts):
            slope = np.polyfit(np.arange(len(x)), x, 1)[0] / 2 if len(x) > 2 else 0.0
            drift = slope * np.arange(1, horizon + 1)
            base[i] += drift
            fans[i] += drift
        return base, fans


class Autoregression:
    """Least-squares autoregression of order seven."""

    max_context, native_gaps, order = 730, False, 7

    def predict_batch(self, contexts, horizon):
        means, fans = [], []
        for x in contexts:
            p = min(self.order, max(1, (len(x) - 2) // 3))
            if len(x) < 4:
                m, f = _fan(np.full(horizon, x[-1] if len(x) else 0.0), np.zeros(horizon))
            else:
                rows = np.stack([x[i : len(x) - p + i] for i in range(p)] + [np.ones(len(x) - p)], 1)
                beta, *_ = np.linalg.lstsq(rows, x[p:], rcond=None)
                sigma = float(np.std(x[p:] - rows @ beta))
                past = list(x[-p:])
                for _ in range(horizon):
                    past.append(float(np.dot(beta, [*past[-p:], 1.0])))
                m, f = _fan(np.clip(past[p:], x.min() - 3 * sigma, x.max() + 3 * sigma), sigma * np.sqrt(np.arange(1, horizon + 1)))
            means.append(m)
            fans.append(f)
        return np.array(means), np.array(fans)


REGISTRY: dict[str, type] = {"exponential_smoothing": ExponentialSmoothing, "drift_theta": DriftTheta, "autoregression": Autoregression}


def register(name: str, kind: type) -> None:
    """Add a forecaster, for instance an adapter of a pretrained model."""
    REGISTRY[name] = kind


def load(name: str, **options) -> Forecaster:
    if name not in REGISTRY:
        raise KeyError(f"unknown forecaster {name!r}; there are {', '.join(sorted(REGISTRY))}")
    known = {k: v for k, v in options.items() if k in getattr(REGISTRY[name].__init__, "__code__", load.__code__).co_varnames}
    return REGISTRY[name](**known)


def predicted(model: Forecaster, contexts: list[np.ndarray], horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """A batch's means and rising quantiles, refused where there isn't a value for each context, level and lead."""
    answer = [np.asarray(x, float) for x in model.predict_batch(contexts, horizon)]
    wanted = [(len(contexts), horizon), (len(contexts), len(QUANTILES), horizon)]
    if [x.shape for x in answer] != wanted:
        raise ValueError(f"a forecast has the shapes {wanted}, not {[x.shape for x in answer]}")
    return answer[0], np.sort(answer[1], axis=1)


def forecast(contexts: DataFrame, name: str, horizon: int, length: int = 730, batch: int = 256, non_negative: bool = True, from_first: bool = True) -> DataFrame:
    """Forecasts of a registered model for ``contexts(keys, origin, context)``, in Arrow batches.

    Contexts are cut to ``length`` and the model's own limit, with ``from_first`` also to what follows their first observed value, and for models
    without gaps of their own filled, before they leave the JVM. The models are the cost, so contexts are spread over all shuffle partitions
    however few bytes they are.
    """
    known = load(name)
    kind = type(known)  # goes to the workers with the function, whose registry has only this module's models
    most = min(length, known.max_context)
    ready = observed_part(F.col("context"), most) if from_first else F.slice("context", F.greatest(F.size("context") - most, F.lit(0)) + 1, F.lit(most))
    ready = ready if known.native_gaps else without_gaps(ready)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = kind()
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                mean, q = predicted(model, [np.array(c, float) for c in part["ready"]], horizon)
                if non_negative:
                    mean, q = np.maximum(mean, 0), np.maximum(q, 0)
                out = {c: np.repeat(part[c].to_numpy(), horizon) for c in [*KEYS, "origin"]}
                out |= {"lead": np.tile(np.arange(1, horizon + 1, dtype=np.int32), len(part)), "mean": mean.ravel()}
                out |= {n: q[:, j, :].ravel() for j, n in enumerate(QUANTILE_NAMES)}
                yield pd.DataFrame(out)

    schema = "track string, var string, series_id string, origin date, lead int, mean double, " + ", ".join(f"`{n}` double" for n in QUANTILE_NAMES)
    spread = contexts.repartition(int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEYS, "origin")
    return spread.select(*KEYS, "origin", ready.alias("ready")).mapInPandas(run, schema)


def on_anomalies(series: DataFrame, windows: DataFrame, train_end: str, name: str, horizon: int = 30, length: int = 730, non_negative: bool = True) -> DataFrame:
    """Forecasts of a registered model for what a series departs from its training climatology by, which is added back at the target days.

    A context is the last ``length`` rows up to its origin with gaps filled; one without any value is no departure at all.
    """
    usual = ev.climatology_table(series, train_end).select(*KEYS, "doy", F.col("mean").alias("usual"))
    days = series.withColumn("doy", ring_day("date")).join(usual, [*KEYS, "doy"], "left")
    contexts = ev.contexts(days.select(*KEYS, "date", (F.col("y") - F.col("usual")).alias("y")), windows, length)
    away = forecast(contexts, name, horizon, length, non_negative=False, from_first=False)
    at = away.withColumn("doy", ring_day(F.date_add("origin", F.col("lead")))).join(usual, [*KEYS, "doy"])
    back = at.withColumns({c: F.col(f"`{c}`") + F.col("usual") for c in ("mean", *QUANTILE_NAMES)})
    return ev.finished(back, non_negative).select(*ev.FORECAST)


# --- gap matching -------------------------------------------------------------------------------------------------


def donor_masks(contexts: DataFrame, length: int) -> DataFrame:
    """``(keys, origin, missing array<boolean>)``: the last ``length`` days up to each origin; days before a series began are missing.

    ValueError without any donor.
    """
    if contexts.isEmpty():
        raise ValueError("there are no donors")
    own = F.transform("context", lambda v: v.isNull())
    padded = F.concat(F.array_repeat(F.lit(True), F.greatest(length - F.size("context"), F.lit(0))), own)
    return contexts.select(*[F.col(c) for c in KEYS], "origin", F.slice(padded, -length, length).alias("missing"))


def assigned_donors(window_ids: np.ndarray, donors: int, seed: int = 0) -> np.ndarray:
    """Each window's donor, the same however many windows there are; ValueError without donors."""
    if donors < 1:
        raise ValueError("there are no donors")
    ids = np.asarray(window_ids, int)
    return np.random.default_rng(seed).integers(0, donors, size=int(ids.max()) + 1)[ids] if len(ids) else ids


def apply_mask(context: str, missing: str) -> Column:
    """The context with the donor's gaps, aligned at the right end; days before the mask's first stay as they are."""
    return F.transform(context, lambda v, i: F.when(~F.coalesce(F.get(missing, F.size(missing) - F.size(context) + i), F.lit(False)), v))


def gap_matched(contexts: DataFrame, length: int, seed: int = 0) -> DataFrame:
    """``contexts(keys, origin, window_id, context)`` with ``donor`` and ``masked``: the gaps of another window's context of the same variable.

    Window ids count from 0. Donors are numbered in the order of the ids. The draw is one number for each window, made on the
    driver since the generator's sequence can't be entered in the middle.
    """
    masks = donor_masks(contexts, length).join(contexts.select(*KEYS, "origin", "window_id"), [*KEYS, "origin"])
    masks = masks.select("var", "missing", (F.row_number().over(Window.partitionBy("var").orderBy("window_id")) - 1).alias("donor"))
    sizes = contexts.groupBy("var").agg(F.count("*").alias("n"), F.max("window_id").alias("last")).collect()  # a row for each variable
    drawn = [pd.DataFrame({"var": r["var"], "window_id": np.arange(r["last"] + 1), "donor": assigned_donors(np.arange(r["last"] + 1), r["n"], seed)}) for r in sizes]
    draws = contexts.sparkSession.createDataFrame(pd.concat(drawn), "var string, window_id long, donor long")
    return contexts.join(draws, ["var", "window_id"]).join(masks, ["var", "donor"]).withColumn("masked", apply_mask("context", "missing")).drop("missing")
