"""Section-wise citations: which headings of a paper fit a question, and whom these sections cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import title_letters
from .lexical import query_terms

# How much a heading suggests that its citations are relevant.
HEADINGS = {"related work": 0.85, "prior work": 0.85, "literature review": 0.85, "background": 0.45, "introduction": 0.20}
# The types of a heading and the parts of it that show them.
TYPES = {
    "introduction": ["introduction"],
    "background": ["background", "preliminar"],
    "related_work": ["related work", "prior work", "previous work"],
    "literature_review": ["literature review", "survey"],
    "method": ["method", "methodology", "algorithm", "procedure"],
    "model": ["model", "architecture", "representation"],
    "approach": ["approach", "framework", "formulation"],
    "theory": ["theor", "proof", "guarantee", "bound", "analysis"],
    "experiment": ["experiment", "implementation", "training"],
    "result": ["result", "finding", "ablation"],
    "dataset": ["dataset", "data set", "benchmark", "corpus"],
    "evaluation": ["evaluation", "comparison", "performance"],
    "discussion": ["discussion", "limitation", "future work"],
    "conclusion": ["conclusion", "concluding", "summary"],
    "appendix": ["appendix", "supplement"],
}
# Words that the section tokenizer passes over.
SECTION_STOP = "a an and are as at be by for from in into is it of on or that the this to we with without you your".split()


def section_tokens(c: Column) -> Column:
    """Lower-case English words with digits, dashes and underscores inside, without stop words."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Za-z][A-Za-z0-9_-]+"), 0), F.lower)
    return F.filter(found, lambda w: ~w.isin(SECTION_STOP))


def heading_score(heading: Column, query: Column) -> Column:
    """Twice the share of the heading's terms that the question has, plus the best prior of the heading."""
    h, q = query_terms(F.lower(heading), 30), query_terms(query, 30)
    low = F.lower(F.coalesce(heading, F.lit("")))
    prior = F.greatest(*(F.when(F.contains(low, F.lit(k)), v).otherwise(0.0) for k, v in HEADINGS.items()))
    return 2 * F.size(F.array_intersect(h, q)) / F.greatest(F.size(h), F.lit(1)) + prior


def rank_sections(sections: DataFrame, queries: DataFrame, seeds: DataFrame) -> DataFrame:
    """(qid, pid, heading, score, place) for seeds(qid, pid): the headings of each seed by score, ties by heading."""
    h = sections.select("pid", "heading").distinct()
    x = seeds.select("qid", "pid").distinct().join(queries.select("qid", "query"), "qid").join(h, "pid").select("qid", "pid", "heading", heading_score(F.col("heading"), F.col("query")).alias("score"))
    w = Window.partitionBy("qid", "pid").orderBy(F.round("score", 9).desc(), "heading")
    return x.withColumn("place", F.row_number().over(w))


def choose(ranked: DataFrame, most: int = 2, margin: float = -1.0, least_second: float = 2.0) -> DataFrame:
    """The first `most` headings; with a margin of 0 or more, the second only if it is within the margin of the first or above least_second."""
    x = ranked.where(F.col("place") <= max(1, most))
    if margin < 0:
        return x
    first = F.max(F.when(F.col("place") == 1, F.col("score"))).over(Window.partitionBy("qid", "pid"))
    return x.withColumn("first", first).where((F.col("place") != 2) | (F.abs(F.col("first") - F.col("score")) < margin) | (F.col("score") > least_second)).drop("first")


def cited_title_score(sims: DataFrame, top_k: int = 8) -> DataFrame:
    """(qid, pid, heading, score): .65 of the best and .35 of the mean of the top_k similarities of sims(qid, pid, heading, sim)."""
    w = Window.partitionBy("qid", "pid", "heading").orderBy(F.desc("sim"))
    x = sims.withColumn("n", F.row_number().over(w)).where(F.col("n") <= top_k)
    return x.groupBy("qid", "pid", "heading").agg((0.65 * F.max("sim") + 0.35 * F.avg("sim")).alias("score"))


def section_references(chosen: DataFrame, sections: DataFrame, titles: DataFrame, limit: int = 60, hydrate: int = 12) -> DataFrame:
    """(qid, pid, cited, headings, rank, abstract): whom the chosen sections cite, heading after heading in stored order, at most `limit` a seed.

    sections(pid, heading, pos, cited_title) meet titles(pid, title, abstract) by the letters of the title; a paper's own title drops out, a repeat only
    adds its heading. Only the first `hydrate` get an abstract.
    """
    t = titles.select(F.col("pid").alias("cited"), title_letters(F.col("title")).alias("key"), "abstract").where("key <> ''")
    x = chosen.select("qid", "pid", "heading", "place").join(sections.select("pid", "heading", "pos", title_letters(F.col("cited_title")).alias("key")), ["pid", "heading"]).join(t, "key").where("cited <> pid")
    one = x.groupBy("qid", "pid", "cited").agg(F.min(F.struct("place", "pos")).alias("at"), F.array_sort(F.collect_set("heading")).alias("headings"), F.max("abstract").alias("abstract"))
    w = Window.partitionBy("qid", "pid").orderBy("at", "cited")
    r = one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return r.select("qid", "pid", "cited", "headings", "rank", F.when(F.col("rank") <= hydrate, F.col("abstract")).alias("abstract"))


def section_features(query: Column, heading: Column, position: Column, total: Column) -> dict[str, Column]:
    """The lexical features of a heading for a question, and its types as 0/1."""
    q, h = F.array_distinct(section_tokens(query)), F.array_distinct(section_tokens(heading))
    both = F.size(F.array_intersect(q, h))
    low = F.lower(F.coalesce(heading, F.lit("")))
    return {
        "precision": both / F.greatest(F.size(h), F.lit(1)),
        "coverage": both / F.greatest(F.size(q), F.lit(1)),
        "overlap": F.least(F.lit(1.0), both / 4),
        "length": F.least(F.lit(1.0), F.size(h) / 18),
        "relative_position": F.least(F.lit(1.0), F.greatest(position, F.lit(0))) / F.greatest(F.lit(1.0), total - 1.0),
        **{f"type_{k}": F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(low, p)).cast("double") for k, parts in TYPES.items()},
    }
