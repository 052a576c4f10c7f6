"""How large is the answer set: capture-recapture estimates over hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def capture_counts(h: DataFrame, relevance: DataFrame | None = None) -> DataFrame:
    """(qid, d, f1, f2): softly weighted numbers of items found, found once, found twice; weight 0 for items without relevance."""
    c = h.groupBy("qid", "pid").agg(F.count("*").alias("c"))
    if relevance is not None:
        c = c.join(relevance.select("qid", "pid", F.col("p").alias("w")), ["qid", "pid"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    else:
        c = c.withColumn("w", F.lit(1.0))
    pick = lambda n: F.sum(F.when(F.col("c") == n, F.col("w")).otherwise(F.lit(0.0)))
    return c.groupBy("qid").agg(F.sum("w").alias("d"), pick(1).alias("f1"), pick(2).alias("f2"))


def chao1(counts: DataFrame, max_ratio: float = 4.0) -> DataFrame:
    """counts with n_hat and variance: the bias-corrected lower bound, its excess at most max_ratio times d."""
    f1, f2, d = F.col("f1"), F.col("f2"), F.col("d")
    extra = F.least(f1 * F.greatest(f1 - 1, F.lit(0.0)) / (2 * (f2 + 1)), max_ratio * d)
    r = f1 / f2
    lone = f1 * F.pow(2 * f1 - 1, F.lit(2.0)) / 4 / F.greatest(f1, F.lit(1.0)) + f1 * (f1 - 1) / 2
    var = F.when(f2 > 0, f2 * (r * r / 2 + r * r * r + r * r * r * r / 4)).when(f1 > 1, lone).otherwise(F.greatest(d, F.lit(1.0)))
    return counts.withColumns({"n_hat": d + extra, "variance": var})


def channel_jaccard(h: DataFrame) -> DataFrame:
    """(qid, correlation): the mean overlap of all pairs of channels; pairs without overlap count."""
    size = h.groupBy("qid", "channel").agg(F.count("*").alias("n"))
    pairs = size.select("qid", F.col("channel").alias("a"), F.col("n").alias("na")).join(size.select("qid", F.col("channel").alias("b"), F.col("n").alias("nb")), "qid").where("a < b")
    x = h.select("qid", "pid", F.col("channel").alias("a"))
    both = x.join(h.select("qid", "pid", F.col("channel").alias("b")), ["qid", "pid"]).where("a < b").groupBy("qid", "a", "b").agg(F.count("*").alias("i"))
    i = F.coalesce("i", F.lit(0))
    return pairs.join(both, ["qid", "a", "b"], "left").groupBy("qid").agg(F.avg(i / (F.col("na") + F.col("nb") - i)).alias("correlation"))


def estimate(counts: DataFrame, correlation: DataFrame, prior: DataFrame, strength: float = 2.0) -> DataFrame:
    """(qid, n_hat, low, high, sd): Chao's estimate inflated by correlation, shrunk to prior(qid, prior) in the log domain, with its interval."""
    x = chao1(counts).join(correlation, "qid", "left").join(prior, "qid", "left")
    d, raw = F.col("d"), F.col("n_hat")
    inflate = 1 + F.coalesce("correlation", F.lit(0.0)) * F.greatest(raw - d, F.lit(0.0)) / F.greatest(raw, F.lit(1e-9))
    n0 = d + (raw - d) * inflate
    w = d / (d + strength)
    shrunk = F.when(F.col("prior").isNull(), n0).otherwise(F.exp(w * F.log(F.greatest(n0, F.lit(1e-9))) + (1 - w) * F.log("prior")))
    n = F.when(d < 1e-6, F.coalesce("prior", F.lit(1.0))).otherwise(F.greatest(shrunk, d))
    extra = F.greatest(n - d, F.lit(1e-6))
    sd = F.sqrt(F.log(1 + F.col("variance") / (extra * extra)))
    return x.select("qid", "d", n.alias("n_hat"), (d + extra * F.exp(-1.96 * sd)).alias("low"), (d + extra * F.exp(1.96 * sd)).alias("high"), sd.alias("sd"))


def draws(est: DataFrame, n: int = 400, seed: int = 0) -> DataFrame:
    """(qid, i, n_sample): log-normal draws of the set size; the same n normal values serve every qid (n rows are broadcast)."""
    import numpy as np

    z = np.random.default_rng(seed).normal(size=n)
    table = F.broadcast(est.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(z)], "i int, z double"))
    extra = F.greatest(F.col("n_hat") - F.col("d"), F.lit(1e-6))
    return est.withColumn("one", F.lit(1)).join(table.withColumn("one", F.lit(1)), "one").select("qid", "i", F.greatest(F.col("d"), F.col("d") + extra * F.exp(F.col("sd") * F.col("z") - F.col("sd") * F.col("sd") / 2)).alias("n_sample"))


def weakest_channel(h: DataFrame, relevance: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """(qid, channel, lone, relevant): how many relevant items only this channel found, and how many it found; relevant are all, or those of relevance(qid, pid, p) from `least`."""
    x = h if relevance is None else h.join(relevance.where(F.col("p") >= least).select("qid", "pid"), ["qid", "pid"], "left_semi")
    c = x.groupBy("qid", "pid").agg(F.count("*").alias("c"), F.min("channel").alias("channel"))
    lone = c.where("c = 1").groupBy("qid", "channel").agg(F.count("*").alias("lone"))
    every = x.groupBy("qid", "channel").agg(F.count("*").alias("relevant"))
    y = h.select("qid", "channel").distinct().join(lone, ["qid", "channel"], "left").join(every, ["qid", "channel"], "left")
    return y.select("qid", "channel", F.coalesce("lone", F.lit(0)).alias("lone"), F.coalesce("relevant", F.lit(0)).alias("relevant"))


def mass_anchor(h: DataFrame, prior: DataFrame, prior_weight: float = 1.0, max_ratio: float = 0.6) -> DataFrame:
    """(qid, multi, pool, mass): prior(qid, prior), 1 at least, to the power prior_weight, times the items found by two or more channel families to the rest; the prior alone if none or too many are."""
    fam = h.groupBy("qid", "pid").agg(F.countDistinct(F.split("channel", ":")[0]).alias("f"))
    c = fam.groupBy("qid").agg(F.sum((F.col("f") >= 2).cast("int")).alias("multi"), F.count("*").alias("pool")).join(prior, "qid")
    pm, w = F.greatest("prior", F.lit(1.0)), min(1.0, max(0.0, prior_weight))
    gate = (F.col("multi") == 0) | (F.col("multi") / F.col("pool") > max_ratio)
    blend = F.exp(w * F.log(pm) + (1 - w) * F.log(F.col("multi").cast("double")))
    return c.select("qid", "multi", "pool", F.when(gate, pm).otherwise(blend).alias("mass"))


def should_stop(est: DataFrame, counts: DataFrame, round_index: int, max_rounds: int, exhausted: bool = False, target: float = 0.85, least_gain: float = 0.005, last_new: DataFrame | None = None) -> DataFrame:
    """(qid, stop, reason, coverage, expected_new, gain): budget, rounds, coverage reached, or too little to gain by one more round.

    last_new(qid, n) bounds what the next round may find by what the last one did.
    """
    x = est.join(counts.select("qid", "f1"), "qid")
    d, n = F.col("d"), F.col("n_hat")
    total = F.greatest(d, F.lit(1.0))
    new = F.col("f1") / F.greatest(total + F.col("f1"), F.lit(1.0)) * F.greatest(n - d, F.lit(0.0))
    if last_new is not None:
        x = x.join(last_new.select("qid", F.col("n").cast("double").alias("last")), "qid", "left")
        new = F.least(new, F.coalesce("last", new))
    x = x.withColumn("expected_new", new)
    gain = 2 * F.col("expected_new") / F.greatest(d + n, F.lit(1e-9))
    cover = d / F.greatest(n, F.lit(1e-9))
    reason = F.when(F.lit(exhausted), "budget").when(F.lit(round_index >= max_rounds), "rounds").when(cover >= target, "coverage").when(gain < least_gain, "gain")
    return x.select("qid", reason.isNotNull().alias("stop"), reason.alias("reason"), cover.alias("coverage"), "expected_new", gain.alias("gain"))
