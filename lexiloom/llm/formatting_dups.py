"""Problem 7: duplicates hidden by formatting differences, by Merkle-style hashing of nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import heavy_keys, skew_join, stored
from .normal import canonical_list_udf, canonical_udf

SEP = "\u0001"


def leaf(df: DataFrame, field: str) -> tuple[Column, Column]:
    """Digest and canonical form of a leaf (string) or an unordered node (array of strings).

    A leaf without letter or digit has no digest. An array is unordered: the digests of its
    distinct leaves are sorted before the node is hashed, blank or null elements do not
    count, and a list without any leaf has no digest.
    """
    if isinstance(df.schema[field].dataType, T.ArrayType):
        forms = F.array_sort(F.array_distinct(F.filter(canonical_list_udf(F.col(field)), lambda x: x.rlike(r"[\p{L}\p{N}]"))))
        digests = F.array_sort(F.transform(forms, lambda x: F.md5(x)))
        form = F.when(F.size(forms) > 0, F.array_join(forms, SEP))
        return F.when(form.isNotNull(), F.md5(F.concat(F.lit("["), F.array_join(digests, ",")))), form
    form = canonical_udf(F.col(field))
    form = F.when(form.rlike(r"[\p{L}\p{N}]"), form)
    return F.md5(form), form


def merkle(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, root, form): the root digest over the fields, in any order of fields, and the full canonical form.

    Rows of which no field has content have no root and are left out: they equal nothing.
    """
    parts = df.select(F.col(id_col).cast("long").alias("id"), *(c.alias(f"{k}{i}") for i, f in enumerate(sorted(fields)) for k, c in zip("df", leaf(df, f), strict=True)))
    n = range(len(fields))
    root = F.md5(F.concat_ws("|", *(F.concat(F.lit(f"{i}:"), F.coalesce(f"d{i}", F.lit(""))) for i in n)))
    form = F.concat_ws("\u0002", *(F.coalesce(f"f{i}", F.lit("")) for i in n))
    return parts.where(F.coalesce(*(F.col(f"d{i}") for i in n)).isNotNull() & F.col("id").isNotNull()).select("id", root.alias("root"), form.alias("form"))


def groups(nodes: DataFrame) -> DataFrame:
    """(root, keep_id, copies): one row per distinct record.

    Grouping by root and whole form is the full structural comparison: two records whose
    digests collide but whose forms differ stay apart.
    """
    return nodes.groupBy("root", "form").agg(F.min("id").alias("keep_id"), F.count("*").alias("copies"))


def duplicates(nodes: DataFrame, heavy_rows: int = 50_000) -> DataFrame:
    """(keep_id, dup_id) for each further member of a group; hot groups meet a broadcast, never one task."""
    nodes = stored(nodes)  # counts, heavy keys and both sides of the join read the normal forms
    many = groups(nodes).where("copies > 1")
    heavy = heavy_keys(many, "root", "copies", heavy_rows)
    right = many.select("root", F.col("form").alias("keep_form"), "keep_id")
    met = skew_join(nodes, right, "root", heavy, "inner")
    return met.where("form = keep_form and id <> keep_id").select("keep_id", F.col("id").alias("dup_id")).distinct()
