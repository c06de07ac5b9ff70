"""Registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev
from tidemark.plans import idioms, series_queries, source_queries, study_queries
from tidemark.sources import tracks

QUERIES = {**idioms.QUERIES, **series_queries.QUERIES, **study_queries.QUERIES, **source_queries.QUERIES}
ORACLE_SQL = {**idioms.ORACLE_SQL, **series_queries.ORACLE_SQL, **study_queries.ORACLE_SQL, **source_queries.ORACLE_SQL}


def flagship(spark: SparkSession, sf_dir: str, horizon: int = 7) -> DataFrame:
    """MASE, sCRPS, RMSE and coverage of the climatology forecast of all shipped quantity, by variable and lead."""
    series = tracks.series(spark, sf_dir, "ship_all")
    windows = ev.windows(series, *ev.SPLITS["test"], horizon=horizon)
    forecasts = ev.climatology(series, windows, ev.SPLITS["train_end"], horizon)
    scores = ev.scored(forecasts, series, ev.train_scales(series, ev.SPLITS["train_end"]))
    return ev.board(scores, ["var", "lead"]).select("var", "lead", *(F.round(c, 6).alias(c) for c in ("MASE", "sCRPS", "RMSE", "coverage80")), "n_windows")
