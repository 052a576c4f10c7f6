"""Probability calibration. Fits run on one query's pool at a time (NumPy inside a grouped pandas call)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLIP = 1e-4


def platt(score: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float] | None:
    """(a, b) of sigmoid(a x + b) by Newton steps on smoothed targets; the ridge holds the slope only. None without both classes."""
    if len(y) == 0 or y.min() == y.max():
        return None
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, held = np.stack([score, np.ones_like(score)], 1), np.array([ridge, 0.0])
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        h = (x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + np.diag([ridge, 1e-9])
        step = np.linalg.solve(h, x.T @ (p - t) + held * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def pool_adjacent(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: (scores, fitted values) to interpolate between; needs four points and both classes."""
    if len(y) < 4 or y.min() == y.max():
        return np.sort(score), np.clip(np.sort(score), 0, 1)
    order = np.argsort(score, kind="stable")
    level, weight = [], []
    for v in y[order].astype(float):
        level.append(v)
        weight.append(1.0)
        while len(level) > 1 and level[-2] > level[-1]:
            w = weight[-2] + weight[-1]
            level[-2:] = [(level[-2] * weight[-2] + level[-1] * weight[-1]) / w]
            weight[-2:] = [w]
    return score[order], np.repeat(level, np.array(weight, dtype=int))


def bisect(f, lo: float, hi: float, target: float, steps: int) -> float:
    """Where the falling or rising f meets target."""
    rising = f(hi) >= f(lo)
    for _ in range(steps):
        mid = (lo + hi) / 2
        if (f(mid) < target) == rising:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def anchored(score: np.ndarray, mass: float, slope: float = 2.5) -> np.ndarray:
    """sigmoid(slope z + b) with b such that the values add up to `mass`."""
    z = (score - score.mean()) / (score.std() + 1e-9)
    g = lambda b: 1 / (1 + np.exp(-np.clip(slope * z + b, -60, 60)))
    return g(bisect(lambda b: g(b).sum(), -20, 20, min(max(mass, 1e-3), len(score) - 1e-3), 80))


def tail_temper(p: np.ndarray, mass: float) -> np.ndarray:
    """p to a power between .2 and 40 that brings the sum nearest to `mass`, which is taken within .5 and .95 of the rows; keeps the order."""
    q = np.clip(p, 1e-6, 1 - 1e-6)
    goal = min(max(mass, 0.5), max(0.5, 0.95 * len(q)))
    f = lambda a: (q**a).sum()
    return q ** (40.0 if f(40.0) > goal else 0.2 if f(0.2) < goal else bisect(f, 0.2, 40.0, goal, 60))


def mixture(score: np.ndarray, prior_share: float | None = None, strength: float = 0.6, rounds: int = 60, apart: float = 0.35) -> np.ndarray:
    """Posterior of the upper of two Gaussians of one variance, by EM with a pseudo-count prior on its share; fewer than eight scores are only clipped."""
    n = len(score)
    if n < 8:
        return np.clip(score, 0, 1)
    share = min(max(prior_share if prior_share else 0.12, 0.01), 0.5)
    m1, m0, sd = np.quantile(score, 0.9), np.quantile(score, 0.4), max(float(score.std()), 1e-3)

    def upper() -> np.ndarray:
        a, b = share * np.exp(-((score - m1) ** 2) / (2 * sd * sd)), (1 - share) * np.exp(-((score - m0) ** 2) / (2 * sd * sd))
        return a / np.maximum(a + b, 1e-300)

    for _ in range(rounds):
        r = upper()
        n1 = float(r.sum())
        if n1 < 1e-6 or n - n1 < 1e-6:
            break
        pseudo = strength * n if prior_share is not None else 0.0
        share = float(np.clip((n1 + pseudo * (prior_share or 0)) / (n + pseudo), 1e-4, 0.6))
        m1, m0 = float((r * score).sum() / n1), float(((1 - r) * score).sum() / (n - n1))
        sd = float(np.sqrt(max(float((r * (score - m1) ** 2 + (1 - r) * (score - m0) ** 2).sum() / n), 1e-6)))
        m1 = max(m1, m0 + apart * sd)
    return np.clip(upper(), 1e-6, 1 - 1e-6)


def decay_scale(n: Column, mass: Column, c: float = 1.6, top: float = 0.95) -> Column:
    """The half-way rank b for which top / (1 + (r / b)^c) over ranks 1..n adds up to `mass`, taken within .5 and .95 of n x top; 80 bisections in one expression."""
    goal = F.greatest(F.lit(0.5), F.least(mass, F.greatest(F.lit(0.5), n * top * 0.95)))
    total = lambda b: F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda s, r: s + top / (1 + F.pow(r / b, F.lit(c))))
    start = F.struct(F.lit(1e-3).alias("lo"), (4.0 * n).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        low = total(mid) < goal
        return F.struct(F.when(low, mid).otherwise(acc["lo"]).alias("lo"), F.when(low, acc["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(80)), start, halve, lambda acc: (acc["lo"] + acc["hi"]) / 2)


def rank_decay(scored: DataFrame, mass: DataFrame, c: float = 1.6, top: float = 0.95) -> DataFrame:
    """(qid, pid, p) of scored(qid, pid, score) and mass(qid, mass): top / (1 + (rank / b)^c), ranks from 1, b by decay_scale, so only counts per qid decide it."""
    n = scored.groupBy("qid").agg(F.count("*").cast("double").alias("n")).join(mass.select("qid", F.col("mass").cast("double")), "qid")
    b = n.select("qid", decay_scale(F.col("n"), F.col("mass"), c, top).alias("b"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "pid"))
    p = top / (1 + F.pow(F.col("r") / F.greatest("b", F.lit(1e-6)), F.lit(c)))
    return scored.select("qid", "pid", rank.alias("r")).join(b, "qid").select("qid", "pid", F.greatest(F.least(p, F.lit(1 - CLIP)), F.lit(CLIP)).alias("p"))


def calibrate(scored: DataFrame, mass: DataFrame, method: str = "mixture+temper") -> DataFrame:
    """(qid, pid, p) from scored(qid, pid, score) and mass(qid, mass, prior); methods rank_decay, anchored, mixture, mixture+temper.

    The mixture's prior share is prior / rows within .01 and .6; the anchor `mass` only tempers. But for rank_decay, a group is one query's pool after the candidate cut, so groups stay small.
    """
    if method == "rank_decay":
        return rank_decay(scored, mass)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pid")
        s, m = g["score"].to_numpy(dtype=float), float(g["mass"].iloc[0])
        if method == "anchored":
            p = anchored(s, m)
        else:
            p = mixture(s, min(0.6, max(0.01, float(g["prior"].iloc[0]) / max(1, len(s)))))
            if method.endswith("temper"):
                p = tail_temper(p, m)
        return pd.DataFrame({"qid": g["qid"].to_numpy(), "pid": g["pid"].to_numpy(), "p": np.clip(p, CLIP, 1 - CLIP)})

    x = scored.select("qid", "pid", F.col("score").cast("double")).join(mass.select("qid", F.col("mass").cast("double"), F.col("prior").cast("double")), "qid")
    return x.groupBy("qid").applyInPandas(one, "qid string, pid string, p double")


def decay_rows(scored: DataFrame, b: float, c: float = 1.6, top: float = 0.95) -> DataFrame:
    """The decay curve with a given b, as a window expression; ranks from 1."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "pid"))
    return scored.withColumn("p", top / (1 + F.pow(rank / b, F.lit(c))))


def propensity(citations: Column, year: Column, review: Column, now: int = 2026, floor: float = 0.35) -> Column:
    """How likely a relevant paper is to be listed: by citations and age, reviews a tenth less, within floor..1; unknown year is age 0."""
    c = F.log1p(F.greatest(F.coalesce(citations, F.lit(0)), F.lit(0)).cast("double"))
    age = F.greatest(F.lit(0), now - F.coalesce(year, F.lit(now)))
    base = 0.65 * c / (1.5 + c) + 0.35 * F.least(age / 3, F.lit(1.0))
    p = (floor + (1 - floor) * base) * F.when(review, F.lit(0.9)).otherwise(F.lit(1.0))
    return F.greatest(F.least(p, F.lit(1.0)), F.lit(floor))


def p_gold(p: Column, prop: Column, kind: Column) -> Column:
    return F.when(kind == "locate", p * (0.5 + 0.5 * prop)).otherwise(p * prop)


# The features of the supervised calibrator, in order.
FEATURES = ("rrf", "graph", "constraint", "l1", "l2", "l3", "channels", "citation_log", "recency")


def feature_row(now: int = 2026) -> dict[str, Column]:
    """FEATURES as columns of rows with s_rrf, s_graph, s_constraint, s_l1, s_l2, s_l3, channels, citation_count and year; a missing level reads as the one below."""
    z = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    age = now - F.coalesce("year", F.lit(now))
    return {
        "rrf": z("s_rrf"), "graph": z("s_graph"), "constraint": z("s_constraint"), "l1": z("s_l1"),
        "l2": F.coalesce("s_l2", "s_l1", F.lit(0.0)), "l3": F.coalesce("s_l3", "s_l2", "s_l1", F.lit(0.0)),
        "channels": F.least(F.col("channels"), F.lit(8)) / 8,
        "citation_log": F.log1p(F.greatest(F.coalesce("citation_count", F.lit(0)), F.lit(0)).cast("double")) / 10,
        "recency": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - age / 15)),
    }


def supervised(features: dict[str, Column], model: dict, p: Column) -> Column:
    """Blend of p with a fitted logistic model {features, coef, intercept, mean, scale, blend}."""
    if tuple(model["features"]) != FEATURES or len(model["coef"]) != len(FEATURES):
        raise ValueError("the model was fitted on other features")
    z = F.lit(float(model["intercept"]))
    for n, c, m, s in zip(model["features"], model["coef"], model["mean"], model["scale"], strict=True):
        z = z + float(c) * (features[n] - float(m)) / max(float(s), 1e-8)
    blend = min(1.0, max(0.0, float(model.get("blend", 0.65))))
    out = blend / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0)))) + (1 - blend) * p
    return F.greatest(F.least(out, F.lit(1 - CLIP)), F.lit(CLIP))
