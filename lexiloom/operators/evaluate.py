"""Set-level evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import arxiv_key, title_alnum


def set_prf(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, tp, n_pred, n_gold, precision, recall, f1) of distinct predictions; every qid of gold appears."""
    p, g = pred.select("qid", "pid").distinct(), gold.select("qid", "pid").distinct()
    n_p, n_g = p.groupBy("qid").agg(F.count("*").alias("n_pred")), g.groupBy("qid").agg(F.count("*").alias("n_gold"))
    tp = p.join(g, ["qid", "pid"]).groupBy("qid").agg(F.count("*").alias("tp"))
    x = n_g.join(n_p, "qid", "left").join(tp, "qid", "left").na.fill(0, ["n_pred", "tp"])
    pr, re = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0)), F.col("tp") / F.col("n_gold")
    return x.select("qid", "tp", "n_pred", "n_gold", pr.alias("precision"), re.alias("recall"), (2 * F.col("tp") / (F.col("n_pred") + F.col("n_gold"))).alias("f1"))


def recall_at(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (20, 50)) -> DataFrame:
    """(qid, recall_at_k...) of ranked(qid, pid, rank)."""
    n = gold.distinct().groupBy("qid").agg(F.count("*").alias("n"))
    hit = ranked.join(gold.select("qid", "pid").distinct(), ["qid", "pid"]).groupBy("qid").agg(*(F.sum((F.col("rank") <= k).cast("int")).alias(f"h{k}") for k in ks))
    return n.join(hit, "qid", "left").select("qid", *((F.coalesce(f"h{k}", F.lit(0)) / F.col("n")).alias(f"recall_at_{k}") for k in ks))


def summary(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Macro and micro averages of set_prf rows, over all or by a column."""
    g = rows.groupBy(by) if by else rows.groupBy()
    micro = 2 * F.sum("tp") / (F.sum("n_pred") + F.sum("n_gold"))
    return g.agg(F.count("*").alias("queries"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), micro.alias("micro_f1"))


# The budgets at which a run counts as efficient.
BASE = {"llm_calls": 16.0, "tokens": 60_000.0, "wall_seconds": 45.0}


def efficiency(value: Column, base: float) -> Column:
    """1 up to the base, then falling with the logarithm to 0 at six times it."""
    return F.when(value <= base, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.log(value / base) / F.log(F.lit(6.0))))


def efficiency_score() -> Column:
    """The mean efficiency over llm_calls, tokens and wall_seconds; missing ones cost nothing."""
    return sum((efficiency(F.coalesce(F.col(k).cast("double"), F.lit(0.0)), b) for k, b in BASE.items()), F.lit(0.0)) / len(BASE)


def composite(f1: Column, efficient: Column, structure: Column) -> Column:
    return 0.7 * f1 + 0.2 * efficient + 0.1 * structure


def public_macro(rows: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """One row: successful and failed cases of rows(case, error, rank, hit, gold) and the macro precision, recall and F1 at each k over the successful ones.

    A failed case has one row with an error; a case without predictions one row without rank.
    """
    bad = rows.where("error is not null").select("case").distinct()
    good = rows.join(bad, "case", "left_anti")
    per = good.groupBy("case").agg(F.max("gold").alias("gold"), *(F.sum((F.col("rank") <= k).cast("int")).alias(f"n{k}") for k in ks), *(F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias(f"h{k}") for k in ks))
    out = [F.count("*").alias("successful")]
    for k in ks:
        h, n, g = F.coalesce(f"h{k}", F.lit(0)), F.coalesce(f"n{k}", F.lit(0)), F.greatest("gold", F.lit(1))
        p, r = F.when(n > 0, h / n).otherwise(F.lit(0.0)), h / g
        f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
        out += [F.coalesce(F.avg(v), F.lit(0.0)).alias(f"{name}_at_{k}") for name, v in (("precision", p), ("recall", r), ("f1", f))]
    return per.agg(*out).crossJoin(bad.agg(F.count("*").alias("failed")))


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, rate, gap) of rows(p, y) in equal bins."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("rate")).withColumn("gap", F.abs(F.col("mean_p") - F.col("rate")))


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(ece, brier, n)."""
    c = calibration(rows, bins).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))
    brier = rows.agg(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2.0))).alias("brier"))
    return c.withColumn("x", F.lit(1)).join(brier.withColumn("x", F.lit(1)), "x").select("ece", "brier", "n")


def match_public(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(case, rank, key): predictions(case, rank, arxiv_id, title) met with gold(case, arxiv_id, title); id before title, each gold item once, at its first prediction."""
    p = pred.select("case", "rank", arxiv_key(F.col("arxiv_id")).alias("i"), title_alnum(F.col("title")).alias("t"))
    g = gold.select("case", arxiv_key(F.col("arxiv_id")).alias("gi"), title_alnum(F.col("title")).alias("gt"))
    by_id = p.where("i <> ''").join(g.where("gi <> ''"), (p["case"] == g["case"]) & (F.col("i") == F.col("gi"))).select(p["case"], "rank", F.col("gi").alias("key"))
    by_title = p.where("t <> ''").join(g.where("gt <> ''"), (p["case"] == g["case"]) & (F.col("t") == F.col("gt"))).select(p["case"], "rank", F.coalesce(F.when(F.col("gi") != "", F.col("gi")), F.col("gt")).alias("key"))
    w = Window.partitionBy("case", "key").orderBy("rank")
    return by_id.unionByName(by_title).withColumn("n", F.row_number().over(w)).where("n = 1").select("case", "rank", "key")
