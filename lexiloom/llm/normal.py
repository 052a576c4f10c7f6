"""Text normal forms used by several operators; Python only where Spark has no built-in (Unicode forms)."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DROP_ASCII = {i: None for i in range(128) if not chr(i).isalnum()}
_DROP = regex.compile(r"[^\p{L}\p{N}\p{M}]|[\p{Variation_Selector}͏]")
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Variation_Selector}͏]")


def canonical(s: str | None) -> str | None:
    """Letters, digits and marks of s, in compatibility form and folded case; null stays null."""
    if s is None:
        return None
    if s.isascii():
        return s.lower().translate(_DROP_ASCII)
    s = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", _INVISIBLE.sub("", s)).casefold())
    return unicodedata.normalize("NFC", _DROP.sub("", s))


def fold(s: str) -> str:
    """Compatibility form without accents and invisible characters, in folded case."""
    if s.isascii():
        return s.lower()
    s = unicodedata.normalize("NFKD", _INVISIBLE.sub("", s)).casefold()
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def canonical_udf(s: pd.Series) -> pd.Series:
    return s.map(canonical, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def canonical_list_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda xs: None if xs is None else [canonical(x) for x in xs])
