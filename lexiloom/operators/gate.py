"""How many results to return: expected-F1 curve, cut-off, tiers and selectors over scored(qid, pid, p)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order() -> list[Column]:
    return [F.round("p", 9).desc(), F.col("pid")]


def f1_curve(scored: DataFrame, n_hat: DataFrame) -> DataFrame:
    """scored with k, the running sum of p and f1 = 2 sum / (k + n); n is n_hat(qid, n_hat), at least the sum of all p."""
    w = Window.partitionBy("qid").orderBy(*_order())
    x = scored.withColumn("k", F.row_number().over(w)).withColumn("mass", F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.join(n_hat, "qid").withColumn("n", F.greatest("n_hat", F.sum("p").over(Window.partitionBy("qid"))))
    return x.withColumn("f1", 2 * F.col("mass") / (F.col("k") + F.col("n")))


def f1_curve_draws(scored: DataFrame, samples: DataFrame) -> DataFrame:
    """(qid, pid, p, k, f1): the curve averaged over samples(qid, n_sample), each at least the sum of all p."""
    w = Window.partitionBy("qid").orderBy(*_order())
    x = scored.withColumn("k", F.row_number().over(w)).withColumn("mass", F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("p").over(Window.partitionBy("qid")))
    s = samples.groupBy("qid").agg(F.collect_list("n_sample").alias("ns"))
    mean = lambda: F.aggregate("ns", F.lit(0.0), lambda a, n: a + 2 * F.col("mass") / (F.col("k") + F.greatest(n, F.col("all")))) / F.size("ns")
    return x.join(s, "qid").select("qid", "pid", "p", "k", mean().alias("f1"))


def cutoff(curve: DataFrame, core_ratio: float = 1.0, min_k: int = 1, ratio: DataFrame | None = None) -> DataFrame:
    """(qid, k, best_f1, threshold, core_k): the first best prefix, its threshold F1/2, and how many of it pass threshold x core_ratio, or the ratio of ratio(qid, core_ratio)."""
    best = curve.where(F.col("k") >= min_k).groupBy("qid").agg(F.max_by(F.struct(F.col("k").alias("k"), F.col("f1").alias("f1")), F.struct(F.round("f1", 12), -F.col("k"))).alias("b")).select("qid", F.col("b.k").alias("k_star"), F.col("b.f1").alias("best_f1"))
    best = best.withColumn("core_ratio", F.lit(core_ratio)) if ratio is None else best.join(ratio.select("qid", "core_ratio"), "qid")
    core = curve.join(best, "qid").groupBy("qid", "k_star", "best_f1").agg(F.sum(((F.col("k") <= F.col("k_star")) & (F.col("p") > F.col("best_f1") / 2 * F.col("core_ratio"))).cast("int")).alias("c"))
    return core.select("qid", F.col("k_star").alias("k"), "best_f1", (F.col("best_f1") / 2).alias("threshold"), F.greatest(F.least("c", "k_star"), F.lit(1)).alias("core_k"))


def fixed_point(curve: DataFrame, gate: DataFrame, tol: float = 1e-9) -> DataFrame:
    """(qid, holds): p of the last kept >= F1/2 >= p of the next."""
    nxt = F.lead("p").over(Window.partitionBy("qid").orderBy("k"))
    x = curve.withColumn("p_next", nxt).join(gate.select("qid", F.col("k").alias("k_star"), "threshold"), "qid").where("k = k_star")
    return x.select("qid", ((F.col("p") >= F.col("threshold") - tol) & (F.coalesce("p_next", F.lit(0.0)) <= F.col("threshold") + tol)).alias("holds"))


def tiers(curve: DataFrame, gate: DataFrame) -> DataFrame:
    """(qid, pid, k, tier): core, partial or excluded by rank."""
    x = curve.join(gate.select("qid", F.col("k").alias("k_star"), "core_k"), "qid")
    return x.select("qid", "pid", "k", F.when(F.col("k") <= F.col("core_k"), "core").when(F.col("k") <= F.col("k_star"), "partial").otherwise("excluded").alias("tier"))


def rank_blend(scored: DataFrame, weight: float = 0.5) -> DataFrame:
    """(qid, pid, p): the same values of p, handed out in the order of the blend of p and the scaled s_l2; a qid with a missing or constant s_l2 stays as it is."""
    w = Window.partitionBy("qid")
    lo, hi = F.min("s_l2").over(w), F.max("s_l2").over(w)
    usable = (F.count("s_l2").over(w) == F.count("*").over(w)) & (hi - lo > 1e-12)
    x = scored.withColumn("blend", F.when(usable, (1 - weight) * F.col("p") + weight * (F.col("s_l2") - lo) / (hi - lo)).otherwise(F.col("p")))
    x = x.select("qid", "pid", F.row_number().over(Window.partitionBy("qid").orderBy(F.round("blend", 9).desc(), "pid")).alias("pos"))
    y = scored.select("qid", F.greatest(F.least("p", F.lit(1 - 1e-4)), F.lit(1e-4)).alias("p_new"), F.row_number().over(Window.partitionBy("qid").orderBy(*_order())).alias("pos"))
    return x.join(y, ["qid", "pos"]).select("qid", "pid", F.col("p_new").alias("p"))


def band(curve: DataFrame, gate: DataFrame, width: float = 0.15) -> DataFrame:
    """(qid, lo, hi): the places, counted from 0, between which p lies within `width` of the threshold; hi is exclusive."""
    x = curve.join(gate.select("qid", "threshold"), "qid")
    return x.groupBy("qid").agg(F.sum((F.col("p") > F.col("threshold") + width).cast("int")).alias("lo"), F.sum((F.col("p") >= F.col("threshold") - width).cast("int")).alias("hi"))


def monte_carlo_f1(p: list[float], sizes: list[float], draws: int = 2000, seed: int = 0) -> float:
    """The mean F1 of a prefix with hit chances p against set sizes drawn from `sizes`, each at least the hits: what the curve approximates."""
    import numpy as np

    if not p:
        return 0.0
    rng = np.random.default_rng(seed)
    hits = (rng.random((draws, len(p))) < np.asarray(p)).sum(axis=1)
    n = np.maximum(rng.choice(np.asarray(sizes, dtype=float), size=draws), hits)
    return float(np.mean(2 * hits / np.maximum(len(p) + n, 1e-9)))


def normal_cdf(x: Column) -> Column:
    """The normal distribution by a fixed polynomial (error below 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    # The coefficients of the polynomial.
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def value_of_information(scored: DataFrame) -> DataFrame:
    """scored(qid, pid, p, sigma, threshold, n) with voi: the chance of a wrong side times what it costs."""
    d = F.abs(F.col("p") - F.col("threshold"))
    return scored.withColumn("voi", normal_cdf(-d / F.greatest("sigma", F.lit(1e-6))) * 2 * d / F.greatest(1 + F.col("n"), F.lit(1e-9)))


def select_top(curve: DataFrame, k: int) -> DataFrame:
    return curve.where(F.col("k") <= k).select("qid", "pid")


def select_threshold(curve: DataFrame, least: float) -> DataFrame:
    return curve.where(F.col("p") >= least).select("qid", "pid")


def select_oracle(curve: DataFrame, gold: DataFrame, most: int = 120) -> DataFrame:
    """The prefix of at most `most` with the best true F1 against gold(qid, pid)."""
    size = gold.groupBy("qid").agg(F.count("*").alias("g"))
    x = curve.where(F.col("k") <= most).join(gold.withColumn("hit", F.lit(1)), ["qid", "pid"], "left").join(size, "qid")
    tp = F.sum(F.coalesce("hit", F.lit(0))).over(Window.partitionBy("qid").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    y = x.withColumn("true_f1", 2 * tp / (F.col("k") + F.col("g")))
    best = y.groupBy("qid").agg(F.max_by("k", F.struct(F.round("true_f1", 12), -F.col("k"))).alias("best"))
    return y.join(best, "qid").where("k <= best").select("qid", "pid")
