"""References to records that do not exist, were withdrawn, or arrived later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import arxiv_key
from ..runtime import heavy_keys, skew_join, utrim


def lifetimes(known: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """One row per key: first_seen and withdrawn_at (null: never). Inputs: known(pid, seen_at), withdrawn(pid, withdrawn_at)."""
    seen = known.select(arxiv_key(F.col("pid")).alias("ref_key"), "seen_at").groupBy("ref_key").agg(F.min("seen_at").alias("first_seen"))
    gone = withdrawn.select(arxiv_key(F.col("pid")).alias("ref_key"), F.col("withdrawn_at").alias("w")).groupBy("ref_key").agg(F.min("w").alias("withdrawn_at"))
    return seen.where("ref_key is not null and first_seen is not null").join(gone, "ref_key", "left")


def _keyed(refs: DataFrame) -> DataFrame:
    end = F.lit("9999-12-31 00:00:00").cast(refs.schema["t"].dataType)
    return refs.select("src_table", "src_id", "ref_pid", F.coalesce("t", end).alias("t")).where(utrim(F.col("ref_pid")) != "").withColumn("ref_key", arxiv_key(F.col("ref_pid")))


def orphan_references(refs: DataFrame, known: DataFrame, withdrawn: DataFrame, heavy_rows: int = 50_000) -> DataFrame:
    """Rows of refs(src_table, src_id, ref_pid, t) whose key is not live at t, plus their month.

    References are first counted per key and month (map-side combined), which finds the heavy
    keys. Those are checked against a broadcast of their lifetimes; the rest
    takes a shuffle join; the two results are united.

    Null or blank ref_pid is no reference. A null t stands for the end of time, so only
    unknown and withdrawn keys are orphans then. A known row without seen_at never arrived,
    a withdrawal without time never happened. Repeated rows come out once. Empty tables
    give an empty result; extra columns are ignored.
    """
    keyed = _keyed(refs)
    per_period = keyed.groupBy("ref_key", F.trunc("t", "month").alias("period")).agg(F.count("*").alias("n"))
    heavy = heavy_keys(per_period.groupBy("ref_key").agg(F.sum("n").alias("n")), "ref_key", "n", heavy_rows)
    met = skew_join(keyed, lifetimes(known, withdrawn), "ref_key", heavy)
    dead = F.col("first_seen").isNull() | (F.col("t") < F.col("first_seen")) | (F.col("t") >= F.coalesce("withdrawn_at", F.lit("9999-12-31 00:00:01").cast(refs.schema["t"].dataType)))
    return met.where(dead).select("src_table", "src_id", "ref_pid", F.date_format("t", "yyyy-MM").alias("month"))


def orphan_counts(refs: DataFrame, known: DataFrame, withdrawn: DataFrame, heavy_rows: int = 50_000) -> DataFrame:
    """(src_table, month, orphans): what orphan_references finds, counted per table and month without joining rows.

    References are counted per table, key and month, with the first and last time of each, in the map tasks, so that a hot key is one row a month.
    Heavy keys are checked against a broadcast of their lifetimes, the rest by a shuffle join, and both counts are united. Only months in which a key arrived or was
    withdrawn, and which have references on both sides of that moment, are counted from the rows.
    """
    keyed = _keyed(refs).withColumn("month", F.date_format("t", "yyyy-MM"))
    per = keyed.groupBy("src_table", "ref_key", "month").agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    heavy = heavy_keys(per.groupBy("ref_key").agg(F.sum("n").alias("n")), "ref_key", "n", heavy_rows)
    far = F.lit("9999-12-31 00:00:01").cast(refs.schema["t"].dataType)
    met = skew_join(per, lifetimes(known, withdrawn), "ref_key", heavy).withColumn("gone", F.coalesce("withdrawn_at", far))
    dead = F.col("first_seen").isNull() | (F.col("hi") < F.col("first_seen")) | (F.col("lo") >= F.col("gone"))
    live = (F.col("lo") >= F.col("first_seen")) & (F.col("hi") < F.col("gone"))
    whole = met.where(dead).select("src_table", "month", "n")
    mixed = met.where(~dead & ~live).select("ref_key", "first_seen", "gone").distinct()
    months = met.where(~dead & ~live).select("src_table", "ref_key", "month")
    rows = skew_join(keyed.join(F.broadcast(months.where(F.col("ref_key").isin(heavy))), ["src_table", "ref_key", "month"], "left_semi"), mixed, "ref_key", heavy, "inner") if heavy else None
    cold = keyed.where(~F.col("ref_key").isin(heavy)).join(months, ["src_table", "ref_key", "month"], "left_semi").join(mixed, "ref_key")
    rows = cold if rows is None else rows.unionByName(cold)
    part = rows.where((F.col("t") < F.col("first_seen")) | (F.col("t") >= F.col("gone"))).groupBy("src_table", "month").agg(F.count("*").alias("n"))
    return whole.unionByName(part).groupBy("src_table", "month").agg(F.sum("n").alias("orphans"))


def paper_references(papers: DataFrame) -> DataFrame:
    """refs of papers.reference_ids; each spelling of an element counts once per row."""
    return papers.select(F.lit("papers").alias("src_table"), F.col("rec_id").alias("src_id"), F.explode(F.array_distinct("reference_ids")).alias("ref_pid"), F.col("fetched_at").alias("t"))


def candidate_references(candidates: DataFrame) -> DataFrame:
    return candidates.select(F.lit("candidates").alias("src_table"), F.col("cand_id").alias("src_id"), F.col("pid").alias("ref_pid"), F.col("retrieved_at").alias("t"))


def literature_orphans(papers: DataFrame, candidates: DataFrame, withdrawn: DataFrame, **options) -> DataFrame:
    return orphan_references(*_literature(papers, candidates, withdrawn), **options)


def literature_orphan_counts(papers: DataFrame, candidates: DataFrame, withdrawn: DataFrame, **options) -> DataFrame:
    return orphan_counts(*_literature(papers, candidates, withdrawn), **options)


def _literature(papers: DataFrame, candidates: DataFrame, withdrawn: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    refs = paper_references(papers).unionByName(candidate_references(candidates))
    return refs, papers.select("pid", F.col("fetched_at").alias("seen_at")), withdrawn.select("pid", "withdrawn_at")


def orphans_by_month(orphans: DataFrame) -> DataFrame:
    """Orphan references per table and month of the referring row; null-time rows count under 9999-12."""
    return orphans.groupBy("src_table", "month").agg(F.count("*").alias("orphans"), F.countDistinct("src_id").alias("rows_with_orphans"))
