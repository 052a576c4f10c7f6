"""Problem 4: one ranking from several differently-scaled scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stored

MAD_SCALE = 1.4826
MOST_CITED = 5_000_000


def possible(rank: Column, kind: str) -> Column:
    """The score on a scale where larger is better, null where absent or impossible.

    rank: whole numbers from 1, as -ln(rank); cosine: from -1 to 1; count: from 0 to
    MOST_CITED, as ln(1 + count).
    """
    if kind == "rank":
        return F.when(rank >= 1, -F.log(rank.cast("double")))
    if kind == "cosine":
        return F.when(~F.isnan(rank) & (rank >= -1) & (rank <= 1), F.round(rank.cast("double"), 5))
    return F.when((rank >= 0) & (rank <= MOST_CITED), F.log1p(rank.cast("double")))


def scored(candidates: DataFrame) -> tuple[DataFrame, list[str]]:
    """One row per (qid, pid) with a column for each score; replays count once (the earliest, then the least cand_id)."""
    channels = sorted(r[0] for r in candidates.select(F.explode(F.map_keys("channel_ranks")).alias("c")).distinct().collect() if r[0] is not None)
    first = F.struct("retrieved_at", "cand_id", "channel_ranks", "retrieval_score", "citation_count")
    one = candidates.where("qid is not null and pid is not null").groupBy("qid", "pid").agg(F.min_by(first, F.struct("retrieved_at", "cand_id")).alias("c"))
    cols = {f"s{i}": possible(F.col("c.channel_ranks")[ch], "rank") for i, ch in enumerate(channels)}
    cols["retrieval"] = possible(F.col("c.retrieval_score"), "cosine")
    cols["citations"] = possible(F.col("c.citation_count"), "count")
    return one.select("qid", "pid", *(c.alias(k) for k, c in cols.items())), list(cols)


def meet(rows: DataFrame, per_qid: DataFrame, most: int = 50_000) -> DataFrame:
    """rows with the one row of their qid. Up to `most` qids, counted, the small side is broadcast, so that no hot qid meets in one task; beyond, a shuffle join, whose skewed parts the runtime splits."""
    return rows.join(F.broadcast(per_qid) if per_qid.count() <= most else per_qid, "qid")


def fused(candidates: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(qid, pid, score) with score in (0, 1): robust z by median and MAD of the qid, logistic, weighted geometric mean.

    Medians are exact: partial aggregates hold counts per distinct value (whole ranks, cosines of five decimals, whole counts), so a hot qid is
    reduced before the shuffle and its state is bounded by the values; all scores share one pass. An absent, null, NaN or impossible score
    counts as the worst that the qid has for this score, and as 0.5 where no row of the qid has it. A
    MAD of 0 falls back to the mean absolute deviation, then to 1. Rows without qid or pid
    have no rank. Empty tables give an empty result.
    """
    rows, names = scored(candidates)
    rows = stored(rows)  # read three times
    weights = weights or dict.fromkeys(names, 1.0)
    total = sum(weights.values())
    mid = rows.groupBy("qid").agg(*(F.median(n).alias(f"{n}_m") for n in names), *(F.min(n).alias(f"{n}_lo") for n in names))
    mid = stored(mid)
    off = meet(rows, mid).withColumns({f"{n}_d": F.abs(F.col(n) - F.col(f"{n}_m")) for n in names})
    spread = off.groupBy("qid").agg(*(F.median(f"{n}_d").alias(f"{n}_mad") for n in names), *(F.avg(f"{n}_d").alias(f"{n}_mean") for n in names))
    x = meet(rows, stored(mid.join(spread, "qid")))

    def bounded(n: str) -> Column:
        scale = F.coalesce(F.when(F.col(f"{n}_mad") > 0, MAD_SCALE * F.col(f"{n}_mad")), F.when(F.col(f"{n}_mean") > 0, F.col(f"{n}_mean")), F.lit(1.0))
        z = (F.coalesce(F.col(n), F.col(f"{n}_lo")) - F.col(f"{n}_m")) / scale
        return F.when(z.isNull(), F.lit(0.5)).otherwise(1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0)))))

    mean = sum((weights[n] / total * F.log(bounded(n)) for n in names[1:]), weights[names[0]] / total * F.log(bounded(names[0])))
    return x.select("qid", "pid", F.exp(mean).alias("score"))


def top(candidates: DataFrame, k: int = 5) -> DataFrame:
    """(qid, pid, score, place) of the k best of each qid, ties by pid; a partial top k runs before the shuffle."""
    w = Window.partitionBy("qid").orderBy(F.round("score", 12).desc(), "pid")
    return fused(candidates).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
