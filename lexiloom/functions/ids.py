"""Identifier and title keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..runtime import utrim


def arxiv_key(c: Column) -> Column:
    """Strict id: trimmed, without `arxiv:` prefix, URL path and version, in lower case. Null stays null."""
    x = F.regexp_replace(utrim(c), r"(?iU)^arxiv:\s*", "")
    x = F.regexp_replace(x, r"(?s)^.*/", "")
    return F.lower(F.regexp_replace(x, r"(?iU)v\d+$", ""))


def title_alnum(c: Column) -> Column:
    """Letters and digits of the lower-cased title."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def title_letters(c: Column) -> Column:
    """Letters only, lower case: the key of section archives."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}]", "")


def doi_key(c: Column) -> Column:
    """Trimmed lower-case doi without resolver prefix; blank becomes null."""
    x = F.regexp_replace(F.lower(utrim(c)), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")
    return F.when(x != "", x)


def identity_key(doi: Column, arxiv_id: Column, title: Column) -> Column:
    """`doi:` before `arxiv:` (version dropped at the first v) before `title:` + md5 prefix of the alnum title."""
    doi, ax = F.trim(F.coalesce(doi, F.lit(""))), F.trim(F.coalesce(arxiv_id, F.lit("")))
    key = F.concat(F.lit("title:"), F.substring(F.md5(title_alnum(F.coalesce(title, F.lit("")))), 1, 16))
    return (
        F.when(doi != "", F.concat(F.lit("doi:"), F.lower(doi)))
        .when(ax != "", F.concat(F.lit("arxiv:"), F.lower(F.substring_index(ax, "v", 1))))
        .otherwise(key)
    )
