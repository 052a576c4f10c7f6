"""Question plans by rules, and constraint graphs: an OR-group per constraint, AND over positive groups, NOT over negative ones."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from .lexical import doc_terms

_S = T.StringType()
CONSTRAINT = T.StructType([T.StructField("kind", _S), T.StructField("role", _S), T.StructField("text", _S), T.StructField("values", T.ArrayType(_S)), T.StructField("weight", T.DoubleType()), T.StructField("aliases", T.ArrayType(_S))])
GROUP = T.StructType([T.StructField("gid", _S), T.StructField("role", _S), T.StructField("kind", _S), T.StructField("terms", T.ArrayType(_S)), T.StructField("weight", T.DoubleType()), T.StructField("required", T.BooleanType())])
ROLES = ("hard_filter", "anchor", "verify", "negative")
KINDS = ("topic", "method", "dataset", "metric", "year", "venue", "author", "doc_type", "other")
LEAST_WEIGHT = 0.05
# The texts of rule-made constraints.
YEAR_TEXT, VENUE_TEXT, REVIEW_TEXT = "发表年份不早于 ", "发表于 ", "排除综述类文献"


def _constraint(kind: str, role: str, text: Column, values: Column, weight: float = 1.0, aliases: tuple[str, ...] = ()) -> Column:
    names = F.array(*map(F.lit, aliases)) if aliases else F.array().cast("array<string>")
    return F.struct(F.lit(kind).alias("kind"), F.lit(role).alias("role"), text.alias("text"), values.alias("values"), F.lit(weight).alias("weight"), names.alias("aliases"))


def from_fields(row: Column) -> Column:
    """A constraint from a loose struct: unknown kinds are `other`, unknown roles `verify`, missing weights 1, missing lists empty."""
    empty = F.array().cast("array<string>")
    kind, role = F.lower(F.trim(row["kind"])), F.lower(F.trim(row["role"]))
    return F.struct(
        F.when(kind.isin(*KINDS), kind).otherwise("other").alias("kind"),
        F.when(role.isin(*ROLES), role).otherwise("verify").alias("role"),
        F.coalesce(row["text"], F.lit("")).alias("text"),
        F.coalesce(row["values"], empty).alias("values"),
        F.coalesce(row["weight"].cast("double"), F.lit(1.0)).alias("weight"),
        F.coalesce(row["aliases"], empty).alias("aliases"),
    )


def parse_rules(queries: DataFrame, now: int = 2026) -> DataFrame:
    """(qid, query, kind, year_min, venues, no_reviews, spans, language, anchors, search_strings, constraints) of queries(qid, query).

    Anchors are the first and last pair of the question's English words, so that distant facets
    stay apart; each other word among the first ten is a constraint to verify. Search strings
    are weak on purpose: the first five words, each anchor, and words three to seven. A
    question without English words searches for its first 60 characters, an empty one for `_empty_query_`.
    """
    q = F.coalesce(F.col("query"), F.lit(""))
    x = queries.select(
        "qid",
        "query",
        tx.query_type(q).alias("kind"),
        tx.query_year(q, now).alias("year_min"),
        tx.query_venues(q).alias("venues"),
        tx.excludes_reviews(q).alias("no_reviews"),
        tx.quoted_spans(q).alias("spans"),
        F.when(tx.has_cjk(q), "zh").otherwise("en").alias("language"),
        tx.words(q, tx.STOP).alias("eng"),
    ).withColumn("pairs", tx.ngrams(F.col("eng")))
    two = F.size("pairs")
    anchors = F.when(two > 1, F.array(F.col("pairs")[0], F.element_at("pairs", -1))).when(two == 1, F.col("pairs")).otherwise(F.slice("eng", 1, 2))
    x = x.withColumn("anchors", anchors)
    joined = lambda lo, n: F.array_join(F.slice("eng", lo, n), " ")
    many = F.concat(F.array(joined(1, 5)), F.col("anchors"), F.when(F.size("eng") > 3, F.array(joined(3, 5))).otherwise(F.array().cast("array<string>")))
    raw = F.trim(F.substring(F.coalesce(F.col("query"), F.lit("")), 1, 60))
    strings = F.when(F.size("eng") > 0, F.array_distinct(many)).otherwise(F.array(F.when(raw != "", raw).otherwise(F.lit("_empty_query_"))))
    none = F.array().cast(T.ArrayType(CONSTRAINT))
    base = F.concat(
        F.when(F.col("year_min").isNotNull(), F.array(_constraint("year", "hard_filter", F.concat(F.lit(YEAR_TEXT), F.col("year_min").cast("string")), F.array(F.col("year_min").cast("string"))))).otherwise(none),
        F.when(F.size("venues") > 0, F.array(_constraint("venue", "hard_filter", F.concat(F.lit(VENUE_TEXT), F.array_join("venues", "/")), F.col("venues")))).otherwise(none),
        F.when(F.col("no_reviews"), F.array(_constraint("doc_type", "negative", F.lit(REVIEW_TEXT), F.array(F.lit("review")), 1.0, ("survey", "review")))).otherwise(none),
        F.transform("anchors", lambda a: _constraint("topic", "anchor", a, F.array(a))),
    )
    grown = F.aggregate(F.slice("eng", 1, 10), base.cast(T.ArrayType(CONSTRAINT)), lambda acc, t: F.when(F.exists(acc, lambda c: F.contains(c["text"], t)), acc).otherwise(F.concat(acc, F.array(_constraint("other", "verify", t, F.array(t), 0.6)).cast(T.ArrayType(CONSTRAINT)))))
    return x.select("qid", "query", "kind", "year_min", "venues", "no_reviews", "spans", "language", "anchors", F.slice(strings, 1, 6).alias("search_strings"), grown.alias("constraints"))


def sane(constraints: Column, query: Column) -> Column:
    """At most two anchors, the heaviest; further ones are verified only. Without any, the first two English words of the question are one."""
    at = F.array_sort(F.transform(F.filter(F.transform(constraints, lambda c, i: F.struct((-c["weight"]).alias("w"), i.alias("i"), c["role"].alias("r"))), lambda x: x["r"] == "anchor"), lambda x: F.struct(x["w"], x["i"])))
    kept = F.transform(F.slice(at, 1, 2), lambda x: x["i"])
    fixed = F.transform(constraints, lambda c, i: F.when((c["role"] == "anchor") & ~F.array_contains(kept, i), c.withField("role", F.lit("verify"))).otherwise(c))
    words = F.array_join(F.slice(tx.words(query, tx.STOP), 1, 2), " ")
    return F.when((F.size(at) == 0) & (words != ""), F.concat(F.array(_constraint("topic", "anchor", words, F.array(words))).cast(T.ArrayType(CONSTRAINT)), fixed)).otherwise(fixed)


_STOPPED = frozenset(tx.STOP)


def _tokens(s: str) -> list[str]:
    low = s.translate(str.maketrans(tx.WIDE, tx.NARROW)).lower()
    chars = re.findall("[一-鿿]", low)
    return [w for w in re.findall("[a-z0-9]+", low) if len(w) > 1 and w not in _STOPPED] + ([a + b for a, b in zip(chars, chars[1:], strict=False)] if len(chars) > 1 else chars)


def term_key(s: str) -> tuple[str, ...]:
    """What two spellings of a term share: its tokens, plural endings of longer words aside."""
    return tuple(t[:-1] if t.isascii() and len(t) > 4 and t.endswith("s") else t for t in _tokens(s))


def distinct_terms(terms: list[str], most: int = 8) -> list[str]:
    """One spelling for each key, the first; longer keys first; keys whose words all stand in a longer kept one are dropped."""
    first: dict[tuple[str, ...], str] = {}
    for t in terms:
        clean = " ".join(t.split())[:120]
        if k := term_key(clean):
            first.setdefault(k, clean)
    kept: list[tuple[str, ...]] = []
    for k in sorted(first, key=lambda k: (-len(k), " ".join(k))):
        if not any(set(k) < set(o) for o in kept):
            kept.append(k)
    return [first[k] for k in kept[:most]]


def merge_constraints(rows: list[dict]) -> list[dict]:
    """Constraints of one kind and role are one if their keys are equal or share four fifths of their words; the heavier weight stays."""
    out: list[dict] = []
    for c in rows:
        key = term_key(c["text"])
        a = set(key)
        same = None
        for o in out:
            b = set(term_key(o["text"]))
            if (o["kind"], o["role"]) == (c["kind"], c["role"]) and (key == term_key(o["text"]) or a and b and len(a & b) / len(a | b) >= 0.8):
                same = o
                break
        more = [c["text"], *c["aliases"], *c["values"]]
        if same is None:
            out.append(same := {**c, "aliases": []})
        else:
            more = [same["text"], *same["aliases"], *more]
            same["weight"] = max(same["weight"], c["weight"])
        own = term_key(same["text"])
        same["aliases"] = [t for t in distinct_terms(more) if term_key(t) != own][:7]
    return out


def grouped(rows: list[dict]) -> list[dict]:
    out = []
    for i, c in enumerate(rows, 1):
        if terms := distinct_terms([c["text"], *c["aliases"], *c["values"]]):
            out.append({"gid": f"g{i}", "role": c["role"], "kind": c["kind"], "terms": terms, "weight": max(float(c["weight"]), LEAST_WEIGHT), "required": c["role"] in ("hard_filter", "anchor")})
    return out


def _rows(xs) -> list[dict]:
    return [{"kind": x["kind"], "role": x["role"], "text": x["text"] or "", "values": list(x["values"] if x["values"] is not None else []), "weight": float(x["weight"]), "aliases": list(x["aliases"] if x["aliases"] is not None else [])} for x in (xs if xs is not None else [])]


def plans(queries: DataFrame, now: int = 2026) -> DataFrame:
    """parse_rules with the constraints checked, merged and compiled into `groups`. Python sees one short list per question."""
    p = parse_rules(queries, now)
    p = p.withColumn("constraints", sane(F.col("constraints"), F.col("query")))
    schema = T.StructType([*p.schema.fields, T.StructField("groups", T.ArrayType(GROUP))])

    def compiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            merged = [merge_constraints(_rows(xs)) for xs in b["constraints"]]
            yield b.assign(constraints=merged, groups=[grouped(m) for m in merged])

    return p.mapInPandas(compiled, schema)


def by_role(constraints: Column, *roles: str) -> Column:
    return F.filter(constraints, lambda c: c["role"].isin(*roles))


def filters(constraints: Column) -> Column:
    """struct(year_min, venues, doc_type): hard constraints as metadata filters, null where there is none."""
    hard = by_role(constraints, "hard_filter")
    of = lambda kind: F.get(F.filter(hard, lambda c: c["kind"] == kind), F.lit(0))["values"]
    return F.struct(F.get(of("year"), F.lit(0)).cast("int").alias("year_min"), of("venue").alias("venues"), F.get(of("doc_type"), F.lit(0)).alias("doc_type"))


def relaxed(constraints: Column) -> Column:
    """Hard filters as constraints to verify of weight .8 at most, for questions that the filters leave with too few candidates."""
    return F.transform(constraints, lambda c: F.when(c["role"] == "hard_filter", c.withField("role", F.lit("verify")).withField("weight", F.least(c["weight"], F.lit(0.8)))).otherwise(c))


def match(pool: DataFrame, docs: DataFrame, plans: DataFrame) -> DataFrame:
    """(qid, pid, positive, penalty, score) of pool(qid, pid) against plans(qid, groups).

    A group scores the best share of a term's tokens that title, abstract, venue or fields hold. positive is the weighted
    mean over positive groups, penalty the weighted sum of negative groups that score .8 or more, at most 1;
    score = positive (1 - penalty). Only tokens that some group names are looked up in the documents.
    """
    terms = plans.select("qid", F.explode("groups").alias("g")).select("qid", "g.gid", "g.role", F.greatest("g.weight", F.lit(LEAST_WEIGHT)).alias("weight"), F.posexplode("g.terms").alias("tid", "term"))
    terms = terms.select("qid", "gid", "tid", (F.col("role") == "negative").alias("negative"), "weight", F.array_distinct(tx.tokenize(F.col("term"))).alias("tokens")).where(F.size("tokens") > 0)
    flat = terms.select("qid", "gid", "tid", "negative", "weight", F.size("tokens").alias("n"), F.explode("tokens").alias("term"))
    total = plans.select("qid", F.aggregate(F.filter("groups", lambda g: g["role"] != "negative"), F.lit(0.0), lambda s, g: s + F.greatest(g["weight"], F.lit(LEAST_WEIGHT))).alias("total"))
    held = pool.select("qid", "pid").join(doc_terms(docs, flat.select("term").distinct(), ("title", "abstract", "venue", "fields")).select("pid", "term"), "pid").join(flat, ["qid", "term"])
    cover = held.groupBy("qid", "pid", "gid", "tid", "negative", "weight", "n").agg((F.count("*") / F.col("n")).alias("c")).groupBy("qid", "pid", "gid", "negative", "weight").agg(F.max("c").alias("c"))
    w = F.col("weight") * F.col("c")
    sums = cover.groupBy("qid", "pid").agg(F.sum(F.when(F.col("negative"), 0.0).otherwise(w)).alias("p"), F.sum(F.when(F.col("negative") & (F.col("c") >= 0.8), w).otherwise(0.0)).alias("n"))
    x = pool.select("qid", "pid").join(sums, ["qid", "pid"], "left").join(total, "qid", "left")
    x = x.select("qid", "pid", (F.coalesce("p", F.lit(0.0)) / F.greatest(F.coalesce("total", F.lit(0.0)), F.lit(1e-9))).alias("positive"), F.least(F.coalesce("n", F.lit(0.0)), F.lit(1.0)).alias("penalty"))
    return x.withColumn("score", F.col("positive") * (1 - F.col("penalty")))
