"""Inverted index, BM25 in one and several fields, and the pool-local lexical reranker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FULLTEXT_STOP, RERANK_STOP, tokenize, words
from ..runtime import stored

K1, B = 1.2, 0.75


def corpus(papers: DataFrame) -> DataFrame:
    """One row per pid: of rows fetched again the one with the least rec_id. Rows without pid are left out."""
    cols = [c for c in papers.columns if c not in ("pid", "citing_ids")]
    one = papers.where("pid is not null").groupBy("pid").agg(F.min_by(F.struct(*cols), "rec_id").alias("r"))
    return one.select("pid", "r.*")


CORPUS_SQL = "corpus as (select * from (select *, row_number() over (partition by pid order by rec_id) as rn from papers where pid is not null) where rn = 1)"


def postings(docs: DataFrame, key: str, fields: dict[str, float]) -> DataFrame:
    """(key, term, tf, dl): weighted term frequencies and document lengths over the fields."""
    parts = [docs.select(key, tokenize(F.col(f)).alias("t"), F.lit(float(w)).alias("w")) for f, w in fields.items() if w]
    all_parts = parts[0]
    for p in parts[1:]:
        all_parts = all_parts.unionAll(p)
    length = all_parts.groupBy(key).agg(F.sum(F.size("t") * F.col("w")).alias("dl"))
    tf = all_parts.select(key, F.explode("t").alias("term"), "w").groupBy(key, "term").agg(F.sum("w").alias("tf"))
    return tf.join(length, key)


def bm25_search(docs: DataFrame, key: str, fields: dict[str, float], queries: DataFrame, top_k: int = 50) -> DataFrame:
    """(qid, key, score, rank): Okapi BM25 of queries(qid, query); query terms count as often as they occur, ties by key.

    Only postings of query terms are shuffled: the index is semi-joined to the distinct
    query terms before document frequencies are taken. Empty documents count in the averages.
    """
    terms = queries.select("qid", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qf"))
    n = docs.select(F.count("*").cast("double").alias("n"))
    flat = None
    for f, w in fields.items():
        if w:
            part = docs.select(key, (F.size(tokenize(F.col(f))) * float(w)).alias("l"))
            flat = part if flat is None else flat.unionAll(part)
    mean = flat.groupBy(key).agg(F.sum("l").alias("dl")).agg(F.avg("dl").alias("avgdl"))
    stats = n.withColumn("x", F.lit(1)).join(mean.withColumn("x", F.lit(1)), "x").drop("x").first()
    total, avgdl = stats["n"], stats["avgdl"] or 1.0
    hits = postings(docs, key, fields).join(terms.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = F.sum(F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl))))
    scored = hits.join(df.withColumn("idf", idf), "term").join(terms, "term").groupBy("qid", key).agg(score.alias("score")).where("score > 0")
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def doc_terms(docs: DataFrame, wanted: DataFrame, fields: tuple[str, ...] = ("title", "abstract"), stop: list[str] | None = None) -> DataFrame:
    """(pid, term, n_<field>...) of docs(pid, fields): how often each of wanted(term) occurs in each field.

    Only wanted terms are shuffled; the documents' token arrays never leave their rows. stop: tokens by words() with that list instead of tokenize().
    """
    read = (lambda c: words(c, stop)) if stop is not None else tokenize
    rows = None
    for f in fields:
        c = F.array_join(f, " ") if docs.schema[f].dataType.typeName() == "array" else F.col(f)
        part = docs.select("pid", F.explode(read(c)).alias("term"), *(F.lit(int(f == g)).alias(f"n_{g}") for g in fields))
        rows = part if rows is None else rows.unionAll(part)
    return rows.join(wanted, "term", "left_semi").groupBy("pid", "term").agg(*(F.sum(f"n_{f}").alias(f"n_{f}") for f in fields))


def query_terms(c: Column, limit: int = 18) -> Column:
    """Ordered distinct terms of a full-text query: English words of two or more characters, or runs of CJK, in lower case, at most `limit`."""
    return F.slice(F.filter(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Za-z][A-Za-z0-9_-]+|[一-鿿]{2,}"), 0), F.lower)), lambda w: ~w.isin(FULLTEXT_STOP)), 1, limit)


# Which fields a view of the full-text index reads, and the weights of title and abstract in its ranking.
VIEWS = {
    "abstract": (("abstract",), 3.0, 1.0),
    "title_abstract": (("title", "abstract"), 3.0, 1.0),
    "all_fields": (("title", "abstract"), 3.0, 1.0),
    "title_focus": (("title", "abstract"), 8.0, 1.0),
    "abstract_focus": (("title", "abstract"), 1.0, 3.0),
}
LEGACY_VIEWS = ("abstract", "title_abstract", "all_fields")


def view_search(docs: DataFrame, queries: DataFrame, views: tuple[str, ...] = LEGACY_VIEWS, limit: int = 20) -> DataFrame:
    """(qid, view, pid, score, rank): every view of the full-text index as a ranked list of its own.

    A document matches if any term of the question occurs in a field of the view; its score is the full-text BM25
    with k1 1.2 and b .75 over weighted hits, the inverse frequency ln((N - n + .5) / (n + .5)), 1e-6 at least; documents without any word
    count in the mean length. A term with a hyphen is the phrase of its parts. Unknown views raise KeyError.
    """
    specs = {v: VIEWS[v] for v in views}
    terms = queries.select("qid", F.explode(query_terms(F.col("query"))).alias("term"))
    flat = {f: words(F.col(f)) for f in ("title", "abstract")}
    d = docs.select("pid", *(F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" ")).alias(f) for f, t in flat.items()), sum(F.size(t) for t in flat.values()).alias("dl"))
    vocabulary = terms.select("term").distinct().withColumn("phrase", F.array_join(words(F.col("term")), " ")).where("phrase <> ''")
    single, phrases = vocabulary.where("not phrase like '% %'"), vocabulary.where("phrase like '% %'")
    one = doc_terms(docs, single.select("phrase").withColumnRenamed("phrase", "term").distinct(), ("title", "abstract"), []).withColumnRenamed("term", "phrase").join(single, "phrase")
    lone = F.length("phrase") == 1  # words() keeps single characters only without a stop list
    some = d.join(F.broadcast(phrases.where(~lone)), F.contains(F.col("title"), F.concat(F.lit(" "), F.col("phrase"), F.lit(" "))) | F.contains(F.col("abstract"), F.concat(F.lit(" "), F.col("phrase"), F.lit(" "))))
    times = lambda f: F.size(F.split(F.col(f), F.concat(F.lit("\\Q "), F.col("phrase"), F.lit(" \\E")), -1)) - 1
    # every view reads the hits twice
    hits = stored(one.select("pid", "term", "n_title", "n_abstract").unionByName(some.select("pid", "term", times("title").alias("n_title"), times("abstract").alias("n_abstract"))))
    out = None
    n = F.count("*").alias("n")
    stats = d.agg(n, F.avg("dl").alias("avgdl"))
    for v, (fields, wt, wa) in specs.items():
        tf = sum((w * F.col(f"n_{f}") for f, w in (("title", wt), ("abstract", wa)) if f in fields), F.lit(0.0))
        x = hits.withColumn("tf", tf).where("tf > 0")
        df = x.groupBy("term").agg(F.count("*").alias("df"))
        idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        y = x.join(df, "term").join(F.broadcast(stats)).join(d.select("pid", "dl"), "pid").join(terms, "term").groupBy("qid", "pid").agg(F.sum(idf * part).alias("score")).withColumn("view", F.lit(v))
        out = y if out is None else out.unionByName(y)
    w = Window.partitionBy("qid", "view").orderBy(F.round("score", 9).desc(), "pid")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("qid", "view", "pid", "score", "rank")


def fused_views(lists: DataFrame, limit: int = 20, k: int = 60) -> DataFrame:
    """(qid, pid, score, rank): the single list of view_search's lists by reciprocal ranks."""
    s = lists.groupBy("qid", "pid").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "pid")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def local_search(docs: DataFrame, queries: DataFrame, limit: int = 20, year_min: int | None = None) -> DataFrame:
    """(qid, pid, score, rank): the best 4 x limit by BM25 over title and abstract, then the year filter, then the cut; unknown years pass."""
    x = bm25_search(docs, "pid", {"title": 1.0, "abstract": 1.0}, queries, 4 * limit).drop("rank")
    if year_min is not None:
        x = x.join(docs.select("pid", "year"), "pid").where(F.col("year").isNull() | (F.col("year") >= year_min))
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "pid")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("qid", "pid", "score", "rank")


def lexical_rerank(pool: DataFrame, docs: DataFrame, queries: DataFrame, title_weight: float = 2.2) -> DataFrame:
    """(qid, pid, score): reranks pool(qid, pid) of docs(pid, title, abstract) for queries(qid, query) with statistics of the qid's own pool.

    f = 2.2 tf(title) + tf(abstract), BM25 with k1 1.2 and b .7, times .35 + .65 of the share
    of query terms found; scaled to 0..1 within the qid where scores differ. Words are those of the reranker, without its own stop words and without CJK.
    Documents' tokens are joined to the distinct query terms, so work grows with the hits. A question without words scores 0.
    """
    read = lambda c: words(c, RERANK_STOP)
    terms = queries.select("qid", F.explode(F.array_distinct(read(F.col("query")))).alias("term"))
    asked = terms.groupBy("qid").agg(F.count("*").alias("nq"))
    p = pool.select("qid", "pid").distinct()
    hit = doc_terms(docs, terms.select("term").distinct(), ("title", "abstract"), RERANK_STOP)
    sizes = docs.select("pid", F.size(read(F.col("title"))).alias("nt"), F.size(read(F.col("abstract"))).alias("na"))
    t = p.join(sizes, "pid")
    stats = t.groupBy("qid").agg(F.count("*").alias("n"), F.greatest(F.avg(F.col("na") + 1), F.lit(1.0)).alias("avgdl"))
    x = p.join(hit, "pid").join(terms, ["qid", "term"]).select("qid", "pid", "term", (title_weight * F.col("n_title") + F.col("n_abstract")).alias("f"))
    df = x.groupBy("qid", "term").agg(F.count("*").alias("df"))
    x = x.join(df, ["qid", "term"]).join(stats, "qid").join(asked, "qid").join(t, ["qid", "pid"])
    part = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("f") * 2.2 / (F.col("f") + 1.2 * (0.3 + 0.7 * (F.col("nt") + F.col("na")) / F.col("avgdl")))
    raw = x.groupBy("qid", "pid").agg((F.sum(part) * (0.35 + 0.65 * F.count("*") / F.max("nq"))).alias("raw"))
    full = t.select("qid", "pid").join(raw, ["qid", "pid"], "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
    w = Window.partitionBy("qid")
    lo, hi = F.min("raw").over(w), F.max("raw").over(w)
    return full.withColumn("score", F.when(hi > lo, (F.col("raw") - lo) / (hi - lo)).otherwise(F.col("raw"))).drop("raw")
