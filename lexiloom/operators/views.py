"""Structured views of a result set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DATASETS, METRICS, STOP, mentions, ngrams, words

# The views shown for each query type.
ROUTES = {
    "locate": ["matrix", "stats", "disambiguation"],
    "survey": ["matrix", "stats", "facets", "timeline", "graph"],
    "method_cross": ["matrix", "stats", "facets", "comparison", "graph"],
    "benchmark": ["matrix", "stats", "facets", "comparison", "graph"],
    "lineage": ["matrix", "stats", "timeline", "graph"],
}


def routes(plans: DataFrame) -> DataFrame:
    """(qid, views): the views that a question's type asks for."""
    m = F.create_map(*(x for k, v in ROUTES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return plans.select("qid", F.try_element_at(m, F.col("kind")).alias("views"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: number, year range and median citations; nulls do not count."""
    return docs.agg(F.count("*").alias("papers"), F.min("year").alias("year_min"), F.max("year").alias("year_max"), F.median("citation_count").alias("median_citations"))


def top_values(docs: DataFrame, field: str, k: int = 8) -> DataFrame:
    """The k most frequent known values of a field."""
    c = docs.where(F.coalesce(F.trim(field), F.lit("")) != "").groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("n"), "value")
    return c.orderBy(F.desc("n"), "value").limit(k).withColumn("place", F.row_number().over(w))


def timeline(docs: DataFrame, each: int = 4) -> DataFrame:
    """(year, papers, place, pid): the number of papers of a year and its `each` most cited."""
    n = docs.where("year is not null").groupBy("year").agg(F.count("*").alias("papers"))
    w = Window.partitionBy("year").orderBy(F.coalesce("citation_count", F.lit(0)).desc(), "pid")
    return docs.where("year is not null").withColumn("place", F.row_number().over(w)).where(F.col("place") <= each).select("year", "pid", "place").join(n, "year")


def matrix(checks: DataFrame, constraints: list[str]) -> DataFrame:
    """One row per pid, a column per constraint with its status; what nobody checked is unrated."""
    p = checks.groupBy("pid").pivot("constraint", constraints).agg(F.first("status"))
    return p.na.fill("unrated", constraints)


def check_score(status: Column) -> Column:
    return F.when(status == "yes", 1.0).when(status == "partial", 0.5).when(status == "no", 0.0).otherwise(0.3)


def disambiguation(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n_values): fields in which the results differ."""
    c = docs.agg(*(F.countDistinct(f).alias(f) for f in fields))
    return c.select(F.explode(F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f))))).alias("field", "n_values")).where("n_values > 1")


def _facet_words(title: Column) -> Column:
    t = F.filter(words(title, STOP), lambda w: F.length(w) > 3)
    return F.array_distinct(F.concat(t, ngrams(t)))


def facet_terms(results: DataFrame, min_size: int = 2) -> DataFrame:
    """(qid, term, size, score): English words of four or more characters and their pairs in titles, held by min_size to 70 % of a query's results."""
    n = results.groupBy("qid").agg(F.count("*").alias("n"))
    terms = results.select("qid", "pid", F.explode(_facet_words(F.col("title"))).alias("term"))
    s = terms.groupBy("qid", "term").agg(F.countDistinct("pid").alias("size")).join(n, "qid").where((F.col("size") >= min_size) & (F.col("size") <= F.greatest(F.lit(min_size), F.floor(0.7 * F.col("n")))))
    score = F.col("size") * (1 - F.col("size") / F.col("n")) * (1 + 0.5 * F.col("term").contains(" ").cast("int"))
    return s.select("qid", "term", "size", score.alias("score"))


def facets(results: DataFrame, most: int = 8, fresh: int = 2) -> DataFrame:
    """(qid, facet, pid): facet terms by falling score, ties by term, each with all its papers, taken while they add `fresh` papers or more; the papers of none are 'other'. One group is one result set."""
    import pandas as pd

    rows = results.select("qid", "pid", _facet_words(F.col("title")).alias("terms"))
    scored = facet_terms(results, fresh).groupBy("qid").agg(F.collect_list(F.struct("score", "term")).alias("facets"))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pid")
        own = {p: set(x) for p, x in zip(g["pid"], g["terms"], strict=True)}
        offered = g["facets"].iloc[0]
        covered: set[str] = set()
        out: list[tuple[str, str]] = []
        taken = 0
        for f in sorted(offered if offered is not None else [], key=lambda f: (-round(f["score"], 9), f["term"])):
            got = [p for p, x in own.items() if f["term"] in x]
            if taken < most and len([p for p in got if p not in covered]) >= fresh:
                taken += 1
                covered.update(got)
                out += [(f["term"], p) for p in got]
        out += [("other", p) for p in own if p not in covered]
        return pd.DataFrame({"qid": g["qid"].iloc[0], "facet": [x for x, _ in out], "pid": [p for _, p in out]})

    return rows.join(scored, "qid", "left").groupBy("qid").applyInPandas(one, "qid string, facet string, pid string")


def year_histogram(docs: DataFrame) -> DataFrame:
    return docs.where("year is not null").groupBy("year").agg(F.count("*").alias("papers"))


def channel_counts(h: DataFrame) -> DataFrame:
    """(qid, family, hits): how often each channel found a result, by channel family."""
    return h.groupBy("qid", F.split("channel", ":")[0].alias("family")).agg(F.count("*").alias("hits"))


def comparison(docs: DataFrame) -> DataFrame:
    """(pid, datasets, metrics, citation_count): what title and abstract mention, at most five of each."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("abstract", F.lit("")))
    return docs.select("pid", mentions(text, DATASETS).alias("datasets"), mentions(text, METRICS).alias("metrics"), "citation_count")


def common(rows: DataFrame, field: str, most: int = 8) -> DataFrame:
    """(value, n): the most frequent elements of an array column."""
    return rows.select(F.explode(field).alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(most)


def projection(docs: DataFrame) -> DataFrame:
    """The columns of a result that leave the engine: abstracts cut at 400 characters, six authors, rounded scores."""
    four = [F.round(c, 4).alias(c) for c in ("p_rel", "p_gold", "propensity") if c in docs.columns]
    return docs.select("pid", "title", F.coalesce("abstract", F.lit("")).substr(1, 400).alias("abstract"), "year", "venue", F.slice("authors", 1, 6).alias("authors"), "citation_count", *four)


def satisfaction(checks: DataFrame) -> DataFrame:
    """(pid, satisfaction): the mean check score of checks(pid, status)."""
    return checks.groupBy("pid").agg(F.avg(check_score(F.col("status"))).alias("satisfaction"))


def structure_score(v: Column) -> Column:
    """0..1 from struct(rows, columns, evidence, nodes, edges, intent_view, themes): counts of what a result shows, and whether the view of its intent is there."""
    s = F.when(v["rows"] > 0, 0.30 + F.when(v["columns"] >= 3, 0.10).otherwise(0.0) + F.when(v["evidence"] > 0, 0.15).otherwise(0.0)).otherwise(0.0)
    s = s + F.when((v["nodes"] > 0) & (v["edges"] > 0), 0.20).otherwise(0.0) + F.when(v["intent_view"], 0.15).otherwise(0.0) + F.when(v["themes"] > 0, 0.10).otherwise(0.0)
    return F.least(s, F.lit(1.0))
