"""Comparison of stages: facts of one key on either side, reduced to extremes and judged by a rule.

Rules are expressions over the aggregates of both sides, so one plan judges all keys. ``V`` stands for a violation, ``N`` for
none, ``C`` for a side that is missing or a comparison that is open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def align(facts: DataFrame, key: list[str], stage: str, value: str) -> DataFrame:
    """One row per key with min, max and number of the values of design (p_) and working stage (r_).

    A conditional aggregation stands in for the full outer join of the two sides: one shuffle, combined before it.
    """
    of = lambda s: F.when(F.col(stage) == s, F.col(value))
    aggs = [f(of(s)).alias(f"{p}_{n}") for s, p in (("PD", "p"), ("RD", "r")) for f, n in ((F.min, "min"), (F.max, "max"), (F.count, "n"))]
    return facts.where(F.col(stage).isin("PD", "RD")).groupBy(*key).agg(*aggs)


def lower_minimum(c: str = "label") -> Column:
    """V if the least working value is below the least design value."""
    return F.when((F.col("p_n") == 0) | (F.col("r_n") == 0), "C").when(F.col("r_min") < F.col("p_min"), "V").otherwise("N").alias(c)


def disjoint_below(c: str = "label") -> Column:
    """V if all working values are below all design values, N if the least isn't below the least, else open."""
    return F.when((F.col("p_n") == 0) | (F.col("r_n") == 0), "C").when(F.col("r_max") < F.col("p_min"), "V").when(F.col("r_min") >= F.col("p_min"), "N").otherwise("C").alias(c)


def higher_rank(c: str = "label") -> Column:
    """For ranks of which lower is better: V if the best working rank is worse than the worst design rank, N if the worst is no worse."""
    return F.when((F.col("p_n") == 0) | (F.col("r_n") == 0), "C").when(F.col("r_min") > F.col("p_max"), "V").when(F.col("r_max") <= F.col("p_min"), "N").otherwise("C").alias(c)


def apart(tolerance: float, c: str = "label") -> Column:
    """V if the least values differ by more than ``tolerance``."""
    return F.when((F.col("p_n") == 0) | (F.col("r_n") == 0), "C").when(F.abs(F.col("p_min") - F.col("r_min")) > tolerance, "V").otherwise("N").alias(c)


def half_unit(a: Column, b: Column, decimals_a: Column, decimals_b: Column) -> Column:
    """Whether two numbers are equal within half a unit of the coarser one's last decimal."""
    return F.abs(a - b) <= F.pow(F.lit(10.0), -F.least(decimals_a, decimals_b)) / 2 + 1e-9


def over_limit(limit: Column, c: str = "label") -> Column:
    """V if the greatest working value is over a limit; a limit below the greatest design value isn't valid, and then only N can be told."""
    valid = limit.isNotNull() & (limit >= F.col("p_max"))
    base = F.when(valid, limit).otherwise(F.col("p_max"))
    return F.when((F.col("p_n") == 0) | (F.col("r_n") == 0), "C").when(F.col("r_max") <= base, "N").when(valid, "V").otherwise("C").alias(c)


def better_lost(design: Column, working: Column, better: tuple[str, ...], worse: str, anywhere: Column) -> Column:
    """V if the design names a better kind, the working stage the worse one and no better one here or ``anywhere``; N if nothing
    better is lost and the worse kind isn't new; else C."""
    good = F.array(*map(F.lit, better))
    had, has = F.array_intersect(design, good), F.array_intersect(working, good)
    worse_new = F.array_contains(working, worse) & ~F.array_contains(design, worse)
    return (
        F.when((F.size(design) == 0) | (F.size(working) == 0), "C")
        .when((F.size(had) > 0) & F.array_contains(working, worse) & (F.size(has) == 0) & ~anywhere, "V")
        .when((F.size(F.array_except(had, has)) == 0) & ~worse_new, "N")
        .otherwise("C")
    )


def old_kinds_new(design: Column, working: Column, wanted: str, old: tuple[str, ...]) -> Column:
    """V if the design names the wanted kind and the working stage only old ones instead; N if no old kind is new; else C."""
    olds = F.array(*map(F.lit, old))
    new_old = F.array_except(F.array_intersect(working, olds), design)
    return (
        F.when((F.size(design) == 0) | (F.size(working) == 0), "C")
        .when(F.array_contains(design, wanted) & ~F.array_contains(working, wanted) & (F.size(new_old) > 0), "V")
        .when(F.size(new_old) == 0, "N")
        .otherwise("C")
    )


def third_stage(label: Column, working_least: Column, built_least: Column, proofs: Column, least_proofs: int = 2) -> Column:
    """The label after the as-built stage: it can only turn to V, if the least built value is below the least working one and
    enough acts say so."""
    return F.when((built_least < working_least) & (proofs >= least_proofs), "V").otherwise(label)


def evidence_met(wanted: Column, there: Column) -> Column:
    """Whether for every stage of ``wanted`` (map stage -> pages) some page is among those of ``there``."""
    return F.forall(F.map_entries(wanted), lambda e: F.coalesce(F.arrays_overlap(e["value"], F.try_element_at(there, e["key"])), F.lit(False)))


def lost(have: Column, left: Column, order: list[str] | None = None) -> Column:
    """Members of ``have`` that ``left`` lacks, in ``order`` where given, else sorted."""
    gone = F.array_except(have, left)
    return F.filter(F.array(*map(F.lit, order)), lambda x: F.array_contains(gone, x)) if order else F.array_sort(gone)


def scores(matched: DataFrame, gold: str, ours: str, positive: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 of ``ours`` against ``gold`` for one label; a null label is no answer."""
    g, o = F.coalesce(F.col(gold) == positive, F.lit(False)), F.coalesce(F.col(ours) == positive, F.lit(False))
    n = matched.agg(F.count_if(g & o).alias("tp"), F.count_if(~g & o).alias("fp"), F.count_if(g & ~o).alias("fn"), F.count_if(~g & ~o).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})
