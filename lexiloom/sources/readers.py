"""Readers for the record formats of the literature corpus, and sinks for results."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import arxiv_key

_S, _A = T.StringType(), T.ArrayType(T.StringType())
PAPER = T.StructType(
    [T.StructField(n, t) for n, t in (("pid", _S), ("title", _S), ("abstract", _S), ("year", T.IntegerType()), ("venue", _S), ("authors", _A), ("doi", _S), ("arxiv_id", _S), ("url", _S), ("citation_count", T.IntegerType()), ("reference_ids", _A), ("citing_ids", _A), ("fields", _A), ("source", _S), ("doc_type", _S), ("retrieval_score", T.DoubleType()))]
)


def papers_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One paper per line, with a fixed schema: absent fields are null, lines that are no JSON are dropped."""
    return spark.read.schema(PAPER).option("mode", "DROPMALFORMED").json(path)


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


RECORD = T.StructType([T.StructField("path", _S), T.StructField("record", T.IntegerType()), T.StructField("line", T.IntegerType()), T.StructField("json", _S), T.StructField("error", _S)])


def _decode(path: str, text: str) -> Iterator[tuple]:
    """Consecutive JSON objects, which may span lines; a broken tail gives one row with its error and place."""
    at, n, decoder = 0, 0, json.JSONDecoder()
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at >= len(text):
            return
        line = text.count("\n", 0, at) + 1
        n += 1
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError as e:
            yield path, n, line, None, f"record {n}, line {line}: {e}"
            return
        if not isinstance(value, dict):
            yield path, n, line, None, f"record {n}, line {line}: not an object"
            return
        yield path, n, line, json.dumps(value, ensure_ascii=False), None
        at = end


def json_records(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(path, record, line, json, error) of files of consecutive JSON objects.

    With strict, a broken record raises when it is read; without, its row carries the error (the audit reader).
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [r for p, v in zip(b["path"], b["value"], strict=True) for r in _decode(p, v)]
            yield pd.DataFrame(out, columns=RECORD.names).astype({"record": "int32", "line": "int32"})

    got = files.mapInPandas(rows, RECORD)
    if not strict:
        return got
    return got.select("path", "record", "line", F.when(F.col("error").isNull(), F.col("json")).otherwise(F.raise_error(F.col("error"))).alias("json"))


def _listed(v: Column) -> Column:
    """A field that holds a string or a list of strings, as list."""
    return F.coalesce(F.from_json(v, "array<string>"), F.array(v))


def benchmark(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query, gold_titles, gold_arxiv_ids) of benchmark lines with their alternative field names; a line without question raises."""
    raw = spark.read.text(path).where("trim(value) <> ''")
    g = lambda *names: F.coalesce(*(F.get_json_object("value", f"$.{n}") for n in names))
    empty = F.array().cast(_A)
    lists = lambda *names: F.when(g(*names).isNull() | (g(*names) == ""), empty).otherwise(_listed(g(*names)))
    q = g("question", "query")
    return raw.select(
        F.coalesce(g("qid"), F.concat(F.lit("case-"), F.md5("value"))).alias("qid"),
        F.when(q.isNotNull(), q).otherwise(F.raise_error(F.lit("query missing"))).alias("query"),
        lists("answer", "answers").alias("gold_titles"),
        F.transform(lists("answer_arxiv_id", "arxiv_ids"), arxiv_key).alias("gold_arxiv_ids"),
    )


class Registry:
    """Named sources; one that fails to build is kept aside with its error, and the others go on."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]]) -> None:
        self.sources: dict[str, DataFrame] = {}
        self.errors: dict[str, str] = {}
        for name, build in builders.items():
            try:
                self.sources[name] = build()
            except Exception as e:  # noqa: BLE001
                self.errors[name] = str(e)

    def union(self) -> DataFrame:
        """All sources as one table with a source_name column; columns that a source lacks are null."""
        out = None
        for name, df in self.sources.items():
            x = df.withColumn("source_name", F.lit(name))
            out = x if out is None else out.unionByName(x, allowMissingColumns=True)
        if out is None:
            raise ValueError("no source")
        return out


def inverted_abstract(index: Column) -> Column:
    """Text from a map word -> positions."""
    cells = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(cells), lambda c: c["w"]), " ")


def arxiv_of_urls(urls: Column) -> Column:
    """The first arXiv id found in a list of URLs; null if none."""
    found = F.transform(urls, lambda u: F.regexp_extract(u, r"(?i)arxiv\.[a-z]+/(?:abs|pdf)/([0-9]{4}\.[0-9]{4,5})", 1))
    return F.get(F.filter(found, lambda x: x != ""), F.lit(0))


def catalogue_rows(works: DataFrame) -> DataFrame:
    """Papers from works(id, display_name, publication_year, doi, cited_by_count, authors, referenced_works, concepts, abstract_inverted_index, urls)."""
    wid = lambda c: F.concat(F.lit("openalex:"), F.regexp_extract(c, "(W[0-9]+)", 1))
    return works.select(
        wid(F.col("id")).alias("pid"),
        F.col("display_name").alias("title"),
        inverted_abstract(F.col("abstract_inverted_index")).alias("abstract"),
        F.col("publication_year").cast("int").alias("year"),
        F.regexp_replace("doi", r"^https?://(dx\.)?doi\.org/", "").alias("doi"),
        arxiv_of_urls(F.col("urls")).alias("arxiv_id"),
        F.col("cited_by_count").cast("int").alias("citation_count"),
        F.slice("authors", 1, 20).alias("authors"),
        F.transform("referenced_works", wid).alias("reference_ids"),
        F.slice("concepts", 1, 6).alias("fields"),
    )


def cache_key(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("|", *parts))


def write_json(df: DataFrame, path: str) -> None:
    """The result sink: one JSON document a line."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A small result as a Markdown table."""
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    return "\n".join([head, *("| " + " | ".join(str(r.get(c, "")).replace("|", "\\|") for c in columns) + " |" for r in rows)])
