"""Mixing sources to target weights by iterative proportional fitting.

Token weights are summed by cell (source, language, topic). Raking multiplies the cells by margin factors until every
margin has its target share. A document is then kept with a probability in proportion to its cell's factor, scaled so that
the expected tokens meet the budget; probabilities stop at 1 and what they lose goes to the others. The choice is by a
hash of the id, so it is the same in every run and for every partitioning.

Cells are as many as combinations that occur. They are raked as a DataFrame whatever their number: a round of a margin is an aggregate
over its values and an equi-join, and the scale that meets the budget is found by bisection on one aggregate. A few rounds are planned together and
written down before the largest error is looked at; without convergence after all rounds there is an error. Nothing is collected but single rows,
and targets are expressions over a margin's weights.

A text's weight is a quarter of its code points unless ``weight`` names another measure: counting by the vocabulary of the encoding
operator would encode the corpus twice.

Defined cases: nulls in a margin column are a value of their own; a null or empty text has one token; rows with one id
are kept or dropped together, and rows with a null id share one draw; targets for values that don't occur are left out and
the rest is rescaled; an empty table gives an empty one. Other columns are passed through, whatever their names; ``tokens`` and
``keep_probability`` replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialised, table

#: Of a margin's values and their weights ``_value`` and ``_weight``, the wanted weights
Targets = dict[str, Callable[[Column, Column], Column]]


def tokens(text: str = "text") -> Column:
    """An estimate of a text's tokens: a quarter of its code points, at least one."""
    return F.greatest(F.ceil(F.length(F.coalesce(F.col(text), F.lit(""))) / 4), F.lit(1)).cast("long")


def topic(text: str = "text") -> Column:
    """A coarse topic by form, for corpora without topics of their own."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (
        F.when(t.contains(" | "), "table").when(t.contains("%%%") | t.contains("***"), "noise").when(t.contains("icense"), "licence")
        .when(F.length(t) < 500, "note").when(F.length(t) < 5000, "article").otherwise("book")
    )


def tempered(alpha: float, factors: dict[str, float] | None = None) -> Callable[[Column, Column], Column]:
    """Targets in proportion to the present weights to the power ``alpha``, some values scaled further."""

    def wanted(value: Column, weight: Column) -> Column:
        scale = F.lit(1.0)
        for name, by in (factors or {}).items():
            scale = F.when(value.eqNullSafe(F.lit(name)), by).otherwise(scale)
        return F.pow(weight, F.lit(alpha)) * scale

    return wanted


def fixed(shares: dict[str, float]) -> Callable[[Column, Column], Column]:
    """Targets by value; a value that isn't named gets none."""

    def wanted(value: Column, weight: Column) -> Column:
        out = F.lit(0.0)
        for name, share in shares.items():
            out = F.when(value.eqNullSafe(F.lit(name)), share).otherwise(out)
        return out

    return wanted


#: of the query
TARGETS: Targets = {"source": tempered(0.5), "lang": tempered(0.7), "topic": tempered(1.0, {"noise": 0.25})}


def rake(spark: SparkSession, cells: DataFrame, targets: Targets, rounds: int = 200, together: int = 5, tolerance: float = 1e-10) -> DataFrame:
    """``cells(margins ..., weight)``, one column of each target's name, with ``raked``, whose margins have the target shares.

    Every margin's value is null-safe; RuntimeError where a margin is off by over ``tolerance`` after all rounds.
    """
    margins = list(targets)
    # a value is made a string with a mark, so that a null is a value like others
    keyed = cells.select(*(F.when(F.col(m).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(m))).alias(m) for m in margins), "weight", *(F.col(m).alias(f"own_{i}") for i, m in enumerate(margins)))
    now = keyed.withColumn("raked", F.col("weight"))
    for i, (m, wanted) in enumerate(targets.items()):
        by = keyed.groupBy(m).agg(F.sum("weight").alias("_weight"), F.first(f"own_{i}").alias("_value"))
        goal = by.select(m, wanted(F.col("_value"), F.col("_weight")).alias("g"))
        share = goal.crossJoin(goal.agg(F.sum("g").alias("all")))  # one row
        now = now.join(share.select(m, F.try_divide("g", "all").alias(f"goal_{i}")), m)
    now = materialised(spark, now, "raked")
    for _ in range(0, rounds, together):
        for _ in range(together):
            for i, m in enumerate(margins):
                seen = F.sum("raked").over(Window.partitionBy(m))
                # a value without weight left stays without
                now = now.withColumn("raked", F.col("raked") * F.coalesce(F.try_divide(F.col(f"goal_{i}"), seen), F.lit(0.0)))
        now = materialised(spark, now, "raked")
        off = [now.groupBy(m).agg(F.abs(F.sum("raked") - F.first(f"goal_{i}")).alias("e")).agg(F.max("e").alias("e")) for i, m in enumerate(margins)]
        worst = reduce(DataFrame.unionByName, off).agg(F.max("e")).first()[0] if off else 0.0
        if worst is None or worst < tolerance:
            return now
    raise RuntimeError(f"raking is off by {worst} after {rounds} rounds")


def chances(spark: SparkSession, cells: DataFrame, targets: Targets, share: float) -> DataFrame:
    """``raked`` cells with ``_p``: the least of 1 and the cell's factor, scaled so that the expected weight meets the budget."""
    raked = rake(spark, cells, targets) if targets else cells.withColumn("raked", F.col("weight"))
    total = raked.agg(F.sum("weight")).first()[0] or 0.0
    ratio = F.col("raked") * total / F.col("weight")
    raked = materialised(spark, raked.withColumn("ratio", ratio), "ratios")
    kept = raked.agg(F.sum(F.when(F.col("ratio") > 0, F.col("weight")))).first()[0] or 0.0
    if share * total >= kept:  # all that any target wants is kept
        return raked.withColumn("_p", F.when(F.col("ratio") > 0, 1.0).otherwise(0.0))
    # the expected weight is a concave broken line in the scale; its slope at a point leads to the next one, never beyond the root
    c, budget = 0.0, share * total
    for _ in range(200):
        full = F.col("ratio") * c >= 1
        at = raked.agg(F.sum(F.when(full, F.col("weight")).otherwise(F.col("weight") * F.col("ratio") * c)).alias("now"), F.sum(F.when(~full, F.col("weight") * F.col("ratio"))).alias("slope")).first()
        step = (budget - at["now"]) / at["slope"] if at["slope"] else 0.0
        if step <= 1e-15 * max(c, 1.0):
            return raked.withColumn("_p", F.least(F.lit(1.0), F.col("ratio") * c))
        c += step
    raise RuntimeError("no scale meets the budget")


def sampling(
    spark: SparkSession, docs: DataFrame, targets: Targets = TARGETS, share: float = 0.5, derived: dict[str, Column] | None = None, weight: Column | None = None
) -> DataFrame:
    """``docs`` with ``tokens`` and ``keep_probability``, and each margin that isn't a column as ``derived`` says.

    ``share`` is the budget as a part of all tokens. ``weight`` is a text's tokens, by default ``tokens()``.
    """
    derived = {"topic": topic()} if derived is None else derived
    held = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row") if docs.columns else F.struct().alias("row")
    value = lambda m: (derived[m] if m in derived else F.col(m)).cast("string")
    weighed = docs.select(held, (tokens() if weight is None else weight).alias("n"), *(value(m).alias(f"m_{i}") for i, m in enumerate(targets)))
    margins = [f"m_{i}" for i in range(len(targets))]
    cells = materialised(spark, weighed.groupBy(*margins).agg(F.sum("n").cast("double").alias("weight")), "cells")
    known = chances(spark, cells, dict(zip(margins, targets.values())), share)
    # raked margins are marked, the documents' are not
    mark = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(c)))
    joined = weighed.join(known.select(*(F.col(c).alias(f"k_{c}") for c in margins), "_p"), [mark(c) == F.col(f"k_{c}") for c in margins]) if margins else weighed.crossJoin(known.select("_p"))
    made = {"tokens": F.col("n"), "keep_probability": F.col("_p")} | {m: F.col(f"m_{i}") for i, m in enumerate(targets) if m in derived}
    return joined.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in made), *(c.alias(n) for n, c in made.items()))


def draw(id_col: str = "doc_id", seed: int = 29) -> Column:
    """A uniform number in [0, 1) by the id alone."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)


def sample(
    spark: SparkSession, docs: DataFrame, targets: Targets = TARGETS, share: float = 0.5, seed: int = 29, derived: dict[str, Column] | None = None, weight: Column | None = None
) -> DataFrame:
    """The kept documents, with ``tokens`` and ``keep_probability``."""
    return sampling(spark, docs, targets, share, derived, weight).where(draw(seed=seed) < F.col("keep_probability"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sample(spark, docs).select("doc_id", "source", "lang", "topic", "tokens", F.round("keep_probability", 9).alias("keep_probability"))
