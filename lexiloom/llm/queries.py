"""Queries of the training-data problems: name -> f(spark, sf_dir), and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..runtime import table

QUERIES = {}
ORACLE = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p7_found(spark, d):
    from . import formatting_dups as m

    found = [m.duplicates(m.merkle(table(spark, d, t), i, [f])).select(F.lit(t).alias("tbl"), "keep_id", "dup_id") for t, i, f in (("papers", "rec_id", "title"), ("public_cases", "case_id", "gold_titles"))]
    return found[0].unionByName(found[1])


@query
def p7_distinct_records(spark, d):
    from . import formatting_dups as m

    out = [m.groups(m.merkle(table(spark, d, t), i, [f])).select(F.lit(t).alias("tbl"), "keep_id", "copies") for t, i, f in (("papers", "rec_id", "title"), ("public_cases", "case_id", "gold_titles"))]
    return out[0].unionByName(out[1])


@query
def p5_found(spark, d):
    from .survivors import survivors

    return survivors(table(spark, d, "papers"), table(spark, d, "sources"))


@query
def p5_merged(spark, d):
    from .survivors import merged

    return merged(table(spark, d, "papers"), table(spark, d, "sources"))


@query
def p4_found(spark, d):
    from .score_fusion import top

    return top(table(spark, d, "candidates")).select("qid", "pid")


@query
def p4_ranking(spark, d):
    from .score_fusion import fused

    return fused(table(spark, d, "candidates"))


@query
def p8_ids(spark, d):
    from .bpe import encode

    return table(spark, d, "documents").select("doc_id", encode(F.col("text")).alias("ids"))


@query
def p9_mixture(spark, d):
    from .mixing import mixture

    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


@query
def p9_shares(spark, d):
    from .mixing import mixture

    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


@query
def p1_found(spark, d):
    from .split_overlap import overlaps

    o = overlaps(table(spark, d, "public_cases"))
    return o.select(F.least("train_id", "eval_id").alias("case_a"), F.greatest("train_id", "eval_id").alias("case_b"))


@query
def p1_report(spark, d):
    from .split_overlap import report

    return report(table(spark, d, "public_cases"))


@query
def p3_found(spark, d):
    from .markup import found

    return found(table(spark, d, "papers"))


@query
def p3_clean_text(spark, d):
    from .markup import cleaned

    return cleaned(table(spark, d, "papers"))


@query
def p10_found(spark, d):
    from .abuse import found

    return found(table(spark, d, "documents"), table(spark, d, "tox_labels"))


@query
def p10_rates(spark, d):
    from .abuse import rates

    return rates(table(spark, d, "documents"), table(spark, d, "tox_labels"))


@query
def p6_found(spark, d):
    from .matching import matches

    return matches(table(spark, d, "listings"), table(spark, d, "papers")).select("list_id", "rec_id")


@query
def p6_matches(spark, d):
    from .matching import matches

    return matches(table(spark, d, "listings"), table(spark, d, "papers"))
