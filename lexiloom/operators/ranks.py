"""Hits, rank lists, fusion and quotas over long tables hits(qid, channel, pid, rank)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, ngrams, tokenize
from ..runtime import stored
from .lexical import doc_terms

# Fusion priors of the signals by query type.
PRIORS = {
    "default": {"l3": 0.42, "l2": 0.20, "l1": 0.16, "rrf": 0.12, "graph": 0.10, "title": 0.06},
    "locate": {"title": 0.40, "l3": 0.26, "l2": 0.14, "l1": 0.10, "rrf": 0.06, "graph": 0.04},
    "survey": {"l3": 0.36, "graph": 0.18, "l2": 0.18, "l1": 0.14, "rrf": 0.11, "title": 0.03},
    "lineage": {"l3": 0.34, "graph": 0.22, "l2": 0.16, "l1": 0.13, "rrf": 0.10, "title": 0.05},
}


def hits(candidates: DataFrame) -> DataFrame:
    """(qid, pid, channel, rank): each candidate once for each channel that found it, with its best rank."""
    return candidates.select("qid", "pid", F.explode("channel_ranks").alias("channel", "rank")).groupBy("qid", "pid", "channel").agg(F.min("rank").alias("rank"))


HITS_SQL = """hits as (select qid, pid, unnest(map_keys(channel_ranks)) as channel, unnest(map_values(channel_ranks)) as rank from candidates),
h as (select qid, pid, channel, min(rank) as rank from hits group by 1, 2, 3)"""


def channel_weight(weights: dict[str, float]) -> Column:
    """The weight of a channel by its name, else by its family before the colon, else 1."""
    if not weights:
        return F.lit(1.0)
    m = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    return F.coalesce(F.try_element_at(m, F.col("channel")), F.try_element_at(m, F.split("channel", ":")[0]), F.lit(1.0))


def rrf(h: DataFrame, k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """(qid, pid, score): reciprocal rank fusion; ranks count from 1."""
    return h.groupBy("qid", "pid").agg(F.sum(channel_weight(weights or {}) / (k + F.col("rank"))).alias("score"))


def assemble(lists: DataFrame) -> DataFrame:
    """lists(qid, channel, query_index, rank, pid) of successive queries -> one list per channel: concatenated, first occurrence kept.

    first_rank is the rank in the first query that found the pid.
    """
    first = lists.groupBy("qid", "channel", "pid").agg(F.min(F.struct("query_index", "rank")).alias("f"))
    w = Window.partitionBy("qid", "channel").orderBy("f", "pid")
    return first.select("qid", "channel", "pid", F.row_number().over(w).alias("pos"), F.col("f.rank").alias("first_rank"))


def top(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best rows of each qid, ties by pid, with their rank."""
    w = Window.partitionBy("qid").orderBy(F.round(score, 9).desc(), "pid")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def text_signals(pool: DataFrame, docs: DataFrame, plans: DataFrame) -> DataFrame:
    """(qid, pid, cover, s_title) of pool(qid, pid): the share of the question's tokens in title and abstract, and the best similarity of one of its spans to the title.

    Questions are tokenised once each and documents once each; covers are counted over a join of tokens.
    """
    asked = plans.select("qid", F.array_distinct(tokenize(F.col("query"))).alias("q"))
    terms = asked.select("qid", F.explode("q").alias("term"))
    p = pool.select("qid", "pid").distinct()
    held = p.join(doc_terms(docs, terms.select("term").distinct()).select("pid", "term"), "pid").join(terms, ["qid", "term"]).groupBy("qid", "pid").agg(F.count("*").alias("held"))
    shape = lambda c: F.struct(F.array_distinct(tokenize(c, False)).alias("w"), F.array_distinct(ngrams(tokenize(c, False))).alias("b"))
    spans = asked.select("qid", F.greatest(F.size("q"), F.lit(1)).alias("n")).join(plans.select("qid", F.transform("spans", shape).alias("spans")), "qid")
    # tokens as a column of their own are made once, within the expressions of word pairs once a pair
    titles = docs.select("pid", tokenize(F.col("title"), False).alias("w")).select("pid", F.struct(F.array_distinct("w").alias("w"), F.array_distinct(ngrams(F.col("w"))).alias("b")).alias("t"))
    x = p.join(titles, "pid").join(spans, "qid").join(held, ["qid", "pid"], "left")
    alike = F.transform("spans", lambda s: 0.5 * jaccard(s["w"], F.col("t.w")) + 0.5 * jaccard(s["b"], F.col("t.b")))
    return x.select("qid", "pid", (F.coalesce("held", F.lit(0)) / F.col("n")).alias("cover"), F.coalesce(F.array_max(alike), F.lit(0.0)).alias("s_title"))


def channel_signals(h: DataFrame) -> DataFrame:
    """(qid, pid, best_rank, families, channels, s_dense, s_reference) of hits; ranks count from 1.

    A dense hit without a native score counts 1 / rank, and so does a citation hit.
    """
    near = lambda prefix: F.max(F.when(F.col("channel").startswith(prefix), 1 / F.col("rank")).otherwise(F.lit(0.0)))
    return h.groupBy("qid", "pid").agg(F.min("rank").alias("best_rank"), F.countDistinct(F.split("channel", ":")[0]).alias("families"), F.countDistinct("channel").alias("channels"), near("dense:").alias("s_dense"), near("cite_").alias("s_reference"))


def l1_score(dense_weight: float = 0.0) -> Column:
    """The linear first-level score from rrf, graph, cover, families, best_rank (from 1), s_title, s_constraint and, with a weight, s_dense."""
    base = (
        0.29 * (1 - F.exp(-40 * F.greatest(F.col("rrf"), F.lit(0.0))))
        + 0.19 * F.col("graph")
        + 0.16 * F.col("cover")
        + 0.12 * (1 - F.exp(-0.8 * F.col("families")))
        + 0.08 / (1 + 0.08 * F.coalesce(F.col("best_rank") - 1, F.lit(50)))
        + 0.11 * F.col("s_title")
        + 0.05 * F.col("s_constraint")
    )
    return base if dense_weight <= 0 else (1 - dense_weight) * base + dense_weight * F.least(F.greatest("s_dense", F.lit(0.0)), F.lit(1.0))


def quota_cut(ranked: DataFrame, h: DataFrame, keep: int, quotas: dict[str, int], unique_quotas: dict[str, int] | None = None, protected: DataFrame | None = None) -> DataFrame:
    """Keeps `keep` rows of ranked(qid, pid, s_l1) per qid, phase after phase: protected(qid, pid), items of one channel only, channel quotas, the global order.

    The phases follow the order of the quota dicts, each a top-k over the rows not yet taken; once `keep` rows are taken, later phases get none.
    Quotas decide who stays, not the order: the result is ordered by (-s_l1, pid) in `rank`.
    """
    best = [F.round("s_l1", 9).desc(), F.col("pid")]
    lone = h.groupBy("qid", "pid").agg(F.countDistinct("channel").alias("n"))
    base = stored(ranked.select("qid", "pid", "s_l1").join(lone, ["qid", "pid"], "left"))  # every phase reads it
    taken = None

    def take(rows: DataFrame, n: int | None, order: list[Column], phase: int) -> None:
        nonlocal taken
        rows = rows if taken is None else rows.join(taken.select("qid", "pid"), ["qid", "pid"], "left_anti")
        got = rows.withColumn("at", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
        got = (got if n is None else got.where(F.col("at") <= n)).select("qid", "pid", F.lit(phase).alias("phase"), "at")
        taken = got if taken is None else taken.unionByName(got)

    phase = 0
    if protected is not None:
        take(base.join(protected.select("qid", "pid").distinct(), ["qid", "pid"], "left_semi"), None, best, phase)
    for ch, n in (unique_quotas or {}).items():
        phase += 1
        take(base.where("n = 1").join(h.where(F.col("channel") == ch).select("qid", "pid", "rank"), ["qid", "pid"]), n, [F.col("rank"), *best], phase)
    for ch, n in quotas.items():
        phase += 1
        take(base.join(h.where(F.col("channel") == ch).select("qid", "pid").distinct(), ["qid", "pid"]), n, best, phase)
    flagged = base.join(taken, ["qid", "pid"], "left") if taken is not None else base.withColumns({"phase": F.lit(None).cast("int"), "at": F.lit(None).cast("int")})
    w = Window.partitionBy("qid").orderBy(F.coalesce("phase", F.lit(phase + 1)), F.coalesce("at", F.lit(0)), *best)
    kept = flagged.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep)
    return kept.select("qid", "pid", "s_l1", F.row_number().over(Window.partitionBy("qid").orderBy(*best)).alias("rank"))


def minmax(score: str, flat: float = 0.5) -> Column:
    """Scaled to 0..1 within the qid; `flat` where all are equal. Meant for pools after the candidate cut."""
    w = Window.partitionBy("qid")
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi - lo > 1e-12, (F.col(score) - lo) / (hi - lo)).otherwise(F.lit(flat))


def l2_blend(scored: DataFrame, keep: int = 80, l1_weight: float = 0.0, mode: str = "linear") -> DataFrame:
    """Reranks scored(qid, pid, s_l1, s_l2) and keeps the best of each qid; with a weight above 0, by the min-max blend of both levels, a flat side counting 0.

    Modes: linear, geometric, min, max.
    """
    if l1_weight <= 0:
        return top(scored.withColumn("score", F.coalesce("s_l2", F.lit(0.0))), keep)
    x = scored.withColumns({"a": minmax("s_l2", 0.0), "b": minmax("s_l1", 0.0)})
    a, b, w = F.col("a"), F.col("b"), min(1.0, l1_weight)
    modes = {"linear": (1 - w) * a + w * b, "geometric": F.pow(F.greatest(a, F.lit(1e-12)), F.lit(1 - w)) * F.pow(F.greatest(b, F.lit(1e-12)), F.lit(w)), "min": F.least(a, b), "max": F.greatest(a, b)}
    return top(x.withColumn("score", modes[mode]).drop("a", "b"), keep)


def level_fusion(s_l1: Column, s_l2: Column, s_l3: Column, satisfaction: Column) -> Column:
    """The fixed blend of the levels that a candidate reached, within 0..1; satisfaction is null where nothing was checked."""
    full = 0.62 * s_l3 + 0.23 * s_l2 + 0.15 * s_l1
    full = F.when(satisfaction.isNotNull(), 0.85 * full + 0.15 * satisfaction).otherwise(full)
    s = F.when(s_l3.isNotNull() & s_l2.isNotNull(), full).when(s_l3.isNotNull(), 0.75 * s_l3 + 0.25 * s_l1).when(s_l2.isNotNull(), 0.70 * s_l2 + 0.30 * s_l1).otherwise(s_l1)
    return F.greatest(F.least(s, F.lit(1.0)), F.lit(0.0))


def average_rank(c: str, by: str = "qid") -> Column:
    """Ranks of ascending values from 1; ties share their mean rank."""
    return F.rank().over(Window.partitionBy(by).orderBy(c)) + (F.count("*").over(Window.partitionBy(by, c)) - 1) / 2


def spearman(df: DataFrame, a: str, b: str, by: str = "qid") -> DataFrame:
    """(by, rho): rank correlation; 0 for fewer than three rows or a constant side."""
    r = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(by, average_rank(a, by).alias("ra"), average_rank(b, by).alias("rb"))
    rho = F.when(F.count("*") < 3, F.lit(0.0)).otherwise(F.coalesce(F.corr("ra", "rb"), F.lit(0.0)))
    return r.groupBy(by).agg(F.when(F.isnan(rho), F.lit(0.0)).otherwise(rho).alias("rho"))


def ranked(x: np.ndarray) -> np.ndarray:
    return pd.Series(x).rank(method="average").to_numpy()


def correlations(signals: list[np.ndarray]) -> np.ndarray:
    """Rank correlations of all pairs, 0 on the diagonal."""
    m = np.nan_to_num(np.corrcoef(np.stack([ranked(s) for s in signals]))) if len(signals[0]) > 2 else np.zeros((len(signals),) * 2)
    np.fill_diagonal(m, 0.0)
    return m


def spectral_reliability(signals: list[np.ndarray]) -> np.ndarray | None:
    """How far each signal agrees with the others: the leading eigenvector of the rank correlations; null for fewer than three."""
    if len(signals) < 3:
        return None
    v = np.linalg.eigh(correlations(signals))[1][:, -1]
    return v if v.sum() >= 0 else -v


def fusion_weights(names: list[str], signals: list[np.ndarray], prior: dict[str, float], gamma: float = 1.5) -> np.ndarray:
    """Prior times reliability, a fiftieth of the prior at least, adding up to 1.

    Reliability is linear in the leading eigenvector, relative to its largest part; below three signals it is the mean rank correlation
    with the others to the power gamma, and 1 for a lone signal.
    """
    p = np.array([prior.get(n, 0.1) for n in names])
    v = spectral_reliability(signals)
    if v is not None:
        r = np.maximum(v, 0.0) / v.max() if v.max() > 1e-9 else np.zeros(len(v))
    elif len(signals) == 1:
        r = np.ones(1)
    else:
        r = np.maximum(correlations(signals).sum(axis=1) / (len(signals) - 1), 0.0) ** gamma
    w = np.maximum(p * r, 0.02 * p)
    return w / w.sum()


def adaptive_fuse(signals: dict[str, np.ndarray], prior: dict[str, float], gamma: float = 1.5) -> np.ndarray:
    """Rank-scaled signals weighed by fusion_weights; missing values take the median, signals missing throughout or constant drop out; without any, all are 0."""
    n = len(next(iter(signals.values())))
    live = {}
    for k, s in signals.items():
        if n and not np.isnan(s).all():
            s = np.where(np.isnan(s), np.nanmedian(s), s)
            if s.std() >= 1e-9:
                live[k] = s
    if not live:
        return np.zeros(n)
    w = fusion_weights(list(live), list(live.values()), prior, gamma)
    f = sum(wi * ranked(s) / n for wi, s in zip(w, live.values(), strict=True))
    return (f - f.min()) / (f.max() - f.min()) if f.max() - f.min() > 1e-12 else np.full(n, 0.5)


def fuse_signals(rows: DataFrame, names: list[str], kind: str | None = None) -> DataFrame:
    """(qid, pid, fused) by adaptive_fuse; one pandas group per qid, for pools after the candidate cut, whose size is the cut's.

    The priors are those of `kind`, or of each row's own kind column.
    """

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pid")
        prior = PRIORS.get(kind or g["kind"].iloc[0], PRIORS["default"])
        f = adaptive_fuse({n: g[n].to_numpy(dtype=float) for n in names}, prior)
        return pd.DataFrame({"qid": g["qid"].to_numpy(), "pid": g["pid"].to_numpy(), "fused": f})

    x = rows if kind is None else rows.withColumn("kind", F.lit(kind))
    return x.select("qid", "pid", "kind", *(F.col(n).cast("double").alias(n) for n in names)).groupBy("qid").applyInPandas(one, "qid string, pid string, fused double")


def evidence_holds(evidence: Column, title: Column, abstract: Column) -> Column:
    """Whether at least 60 % of the evidence tokens occur in title and abstract; false for empty evidence."""
    e = F.array_distinct(tokenize(evidence))
    return (F.size(e) > 0) & (F.size(F.array_intersect(e, F.array_union(tokenize(title), tokenize(abstract)))) >= 0.6 * F.size(e))


def l0_filter(docs: DataFrame, year_min: int | None = None, year_max: int | None = None, venues: list[str] | None = None, no_reviews: bool = False) -> DataFrame:
    """Hard filters; an unknown year or venue never violates one."""
    from ..functions.text import is_review

    x = docs.where(F.length("title") >= 8)
    if year_min is not None:
        x = x.where(F.col("year").isNull() | (F.col("year") >= year_min))
    if year_max is not None:
        x = x.where(F.col("year").isNull() | (F.col("year") <= year_max))
    if venues:
        up = F.upper("venue")
        x = x.where(F.coalesce(F.col("venue"), F.lit("")).isin("") | F.exists(F.array(*map(F.lit, venues)), lambda v: F.contains(up, F.upper(v))))
    return x.where(~is_review(F.col("doc_type"), F.col("title"))) if no_reviews else x
