"""Exact and fuzzy entity resolution, record merge, and dense search."""

from __future__ import annotations

import functools
import hashlib
import operator
from itertools import combinations, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import identity_key
from ..functions.text import is_review, jaccard, ngrams, tokenize


def keyed(papers: DataFrame) -> DataFrame:
    return papers.withColumn("ident", identity_key(F.col("doi"), F.col("arxiv_id"), F.col("title")))


def merge_exact(papers: DataFrame) -> DataFrame:
    """One record per identity key: the fullest abstract and lists, the first known year, venue and ids, the largest counts.

    A single aggregation; `first` means least rec_id. source joins the distinct sources by +.
    """
    known = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    first = lambda c: F.min_by(F.when(known(F.col(c)), F.col(c)), F.when(known(F.col(c)), F.col("rec_id"))).alias(c)
    longest = lambda c, n: F.max_by(c, F.struct(n, -F.col("rec_id"))).alias(c)
    return keyed(papers).groupBy("ident").agg(
        F.min("rec_id").alias("rec_id"),
        F.count("*").alias("copies"),
        F.min_by("title", "rec_id").alias("title"),
        longest("abstract", F.length(F.coalesce("abstract", F.lit("")))),
        longest("authors", F.size("authors")),
        longest("reference_ids", F.size("reference_ids")),
        longest("citing_ids", F.size("citing_ids")),
        F.min_by("year", F.when(F.col("year").isNotNull(), F.col("rec_id"))).alias("year"),
        first("venue"),
        first("doi"),
        first("arxiv_id"),
        first("url"),
        F.max("citation_count").alias("citation_count"),
        F.max("retrieval_score").alias("retrieval_score"),
        F.array_join(F.array_sort(F.collect_set("source")), "+").alias("source"),
        F.max(is_review(F.col("doc_type"), F.col("title"))).alias("review"),
    )


def blocked(papers: DataFrame) -> DataFrame:
    """papers with the first title token, stop words aside, as block; `_` where there is none."""
    return papers.withColumn("block", F.coalesce(F.get(tokenize(F.col("title")), F.lit(0)), F.lit("_")))


def _least_common(a: int, g: int, least: float) -> int | None:
    """How many words a title of a words and g word pairs, all distinct, must share with any title alike to it; None if none can be alike.

    Each word that the other title lacks takes a word pair of its own along, so with o common words
    J1 <= o / a and J2 <= (g - a + o) / g.
    """
    return next((o for o in range(1, a + 1) if 0.5 * o / a + (0.5 * max(0, g - a + o) / g if g else 0.0) >= least - 1e-9), None)


def _subset(common: int) -> int:
    """How many words a key has for pairs that must share `common` words: more select better, fewer keep the keys of a long title few."""
    return min(4, common) if common <= 30 else 2 if common <= 120 else 1


def _title_keys(words: list[str], a: int, common: int) -> list[tuple[str, ...]]:
    """Keys of a title's `a` words, rarest first, of which a pair must share `common` or more: two titles that share as many as both need have a key in common.

    With T common words at least, each side's a - T + k first words hold k of them. T is the larger need of the two, so a title has keys for every size that T may call for.
    """
    need: dict[int, int] = {}
    for t in range(common, a + 1):
        need.setdefault(_subset(t), t)
    return [c for k, t in need.items() for c in combinations(words[: a - t + k], k)]


def fuzzy_pairs(papers: DataFrame, least: float = 0.86) -> DataFrame:
    """(a, b, sim): pairs of one block, a < b, whose titles are alike.

    Equal titles are folded first and meet once; the other pairs of a block share a key of up to four
    of their rarest words (prefix filter for several common words, which loses no pair). A key row carries
    64 bits of the title's words, whose differences drop most of the rest within the join; titles are joined to what stays and compared exactly.
    Frequent words are put behind others; which ones only decides how many rows meet. Titles without any word are alike to none.
    """
    named = blocked(papers).groupBy("block", "title").agg(F.min("rec_id").alias("id"))
    one = named.select("block", "id", tokenize(F.col("title"), False).alias("t"))
    often = one.select(F.explode(F.array_distinct("t")).alias("word")).groupBy("word").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "word").limit(20_000)
    df = {r["word"]: r["df"] for r in often.collect()}

    def keys(batches, df=df):
        number = lambda x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little", signed=True)
        common = functools.cache(lambda a, g: _least_common(a, g, least))
        bit = functools.lru_cache(100_000)(lambda w: 1 << (number(w) & 63))
        for batch in batches:
            rows = []
            for block, i, t in zip(*(batch.column(c).to_pylist() for c in ("block", "id", "t")), strict=True):
                w = list(dict.fromkeys(t))
                n = common(len(w), len(set(pairwise(t))))
                if n is None:
                    continue
                bits = functools.reduce(operator.or_, map(bit, w))
                bits -= (bits >> 63) << 64
                w.sort(key=lambda x: (df.get(x, 0), x))
                rows += [(number("\0".join((block, *sorted(c)))), i, len(w), n, bits) for c in _title_keys(w, len(w), n)]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["key", "id", "n", "common", "bits"])

    keyed_rows = one.mapInArrow(keys, "key long, id long, n int, common int, bits long")
    a, b = (keyed_rows.select("key", *(F.col(c).alias(c + k) for c in ("id", "n", "common", "bits"))) for k in "ab")
    unlike = F.col("na") + F.col("nb") - 2 * F.greatest("commona", "commonb")
    pairs = a.join(b, "key").where((F.col("ida") < F.col("idb")) & (unlike >= 0) & (F.bit_count(F.col("bitsa").bitwiseXOR(F.col("bitsb"))) <= unlike)).select(F.col("ida").alias("a"), F.col("idb").alias("b")).distinct()
    side = lambda k: named.select(F.col("id").alias(k), F.struct("block", "title").alias(f"t{k}"))
    x = pairs.join(side("a"), "a").join(side("b"), "b").where("ta.block = tb.block")
    # a lambda's argument is evaluated once, a repeated column each time
    let = lambda value, f: F.transform(F.array(value), f)[0]
    words = F.struct(*(tokenize(F.col(f"t{k}.title"), False).alias(k) for k in "ab"))
    sim = let(words, lambda w: let(F.struct(*(ngrams(w[k]).alias(k) for k in "ab")), lambda g: 0.5 * jaccard(w["a"], w["b"]) + 0.5 * jaccard(g["a"], g["b"])))
    return x.select("a", "b", sim.alias("sim")).where(F.col("sim") >= least)


def renamed(rows: DataFrame, leaders: DataFrame, key: str = "pid") -> DataFrame:
    """rows with each key replaced by its leader in leaders(key, leader); of rows that become equal but for `rank`, the best rank stays."""
    x = rows.join(leaders.select(key, "leader"), key, "left").withColumn(key, F.coalesce("leader", key)).drop("leader")
    rest = [c for c in x.columns if c != "rank"]
    return x.groupBy(*rest).agg(F.min("rank").alias("rank")) if "rank" in x.columns else x.distinct()


def leaders(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, leader): greedy leader clustering in id order: a node follows its least alike node that is itself a leader.

    pairs(a, b) with a < b, nodes(id).
    """
    return nodes.select("id").distinct().join(_led(pairs), "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))


def _led(pairs: DataFrame, few: int = 100_000) -> DataFrame:
    """(id, leader) of the nodes that pairs(a, b) has.

    Resolved in rounds: a node is decided once all its smaller neighbours are, or those below its least leader; each round
    decides at least the least open node of every component. Only the pairs of open nodes, with the leader of the smaller one, are stored for
    the next round; the last `few` are resolved in one pass on the driver, in id order.
    """
    from ..runtime import stored

    near = pairs.select(F.col("b").alias("id"), F.col("a").alias("other")).distinct()
    near = stored(near)
    led = near.select(F.col("other").alias("id")).distinct().join(near.select("id"), "id", "left_anti").select("id", F.col("id").alias("leader"))
    parts = [led := stored(led)]
    for _ in range(1000):
        known = led.select(F.col("id").alias("other"), F.col("leader").alias("found"))
        old = F.col("ol") if "ol" in near.columns else F.lit(None).cast("long")
        near = stored(near.join(led.select("id"), "id", "left_anti").join(known, "other", "left").select("id", "other", F.coalesce(old, "found").alias("ol")))
        if near.count() <= few:
            rows: dict[int, list] = {}
            for i, o, ol in near.collect():
                rows.setdefault(i, []).append((o, ol))
            last: dict[int, int] = {}
            for i in sorted(rows):
                last[i] = min((o for o, ol in rows[i] if (last[o] if ol is None else ol) == o), default=i)
            rest = near.sparkSession.createDataFrame(list(last.items()), "id long, leader long")
            return functools.reduce(DataFrame.unionByName, [*parts, rest])
        seen = near.groupBy("id").agg(F.min(F.when(F.col("ol") == F.col("other"), F.col("other"))).alias("head"), F.min(F.when(F.col("ol").isNull(), F.col("other"))).alias("open"))
        led = stored(seen.where(F.col("open").isNull() | (F.col("head") < F.col("open"))).select("id", F.coalesce("head", "id").alias("leader")))
        parts.append(led)
        if len(parts) == 16:
            parts = [stored(functools.reduce(DataFrame.unionByName, parts))]
    raise RuntimeError("leaders did not settle")


def fuzzy_leaders(papers: DataFrame, least: float = 0.86) -> DataFrame:
    """(id, leader) of every record: greedy leader clustering by title within blocks.

    Records of equal titles that are alike (a title of one word is not even alike to itself) follow what the first of them follows, since
    no leader between the two is alike to either; so the first stands for them in the pairs.
    """
    # the likeness of a title to itself is 1 with two words or more, .5 with one, 0 without
    alike = F.least(F.size(tokenize(F.col("title"), False)) / 2, F.lit(1.0)) >= least
    x = papers.select(F.col("rec_id").alias("id"), F.when(alike, F.unhex(F.md5("title"))).alias("same"))
    first = x.where("same is not null").groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("same", "first")
    x = x.join(first, "same", "left").select("id", F.coalesce("first", "id").alias("first"))
    led = _led(fuzzy_pairs(papers, least)).withColumnRenamed("id", "first")
    return x.join(led, "first", "left").select("id", F.coalesce("leader", "first").alias("leader"))


def dense_top(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(qid, vec_id, score, rank): exact cosine neighbours of queries(qid, embedding) among vectors(vec_id, embedding).

    The queries are a stated set and go out in blocks of at most 4096, whose size is thus
    bounded; each partition keeps its own k best per query by one matrix product, so that
    only k rows per query and partition are shuffled. Vectors of another dimension or norm 0 are left out.
    """
    from pyspark.sql import Window

    out = None
    qs = queries.where("embedding is not null").orderBy("qid").toPandas()
    for lo in range(0, max(1, len(qs)), 4096):
        part = qs.iloc[lo : lo + 4096]
        ids = [str(x) for x in part["qid"]]
        q = np.stack([np.asarray(v, dtype=np.float32) for v in part["embedding"]]) if len(part) else np.zeros((0, 1), np.float32)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)

        def best(batches, q=q, ids=ids):
            for b in batches:
                rows = [np.asarray(v, dtype=np.float32) for v in b["embedding"]]
                ok = [i for i, v in enumerate(rows) if v.shape == (q.shape[1],) and np.abs(v).sum() > 0]
                if not ok or not len(q):
                    continue
                v = np.stack([rows[i] for i in ok]).astype(np.float64)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                s = q.astype(np.float64) @ v.T
                keys = b["vec_id"].to_numpy()[ok]
                for i in range(len(q)):
                    order = np.lexsort((keys, -np.round(s[i], 9)))[:k]
                    yield pd.DataFrame({"qid": ids[i], "vec_id": keys[order], "score": s[i][order]})

        got = vectors.where("embedding is not null").select("vec_id", "embedding").mapInPandas(best, "qid string, vec_id long, score double")
        out = got if out is None else out.unionByName(got)
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hashing_vectors(docs: DataFrame, key: str, text: str, dim: int = 4096) -> DataFrame:
    """(key, bucket, w): unit TF-IDF vectors of words and word pairs, hashed by md5 into dim buckets."""
    t = docs.select(key, tokenize(F.col(text)).alias("t")).select(key, F.explode(F.concat("t", ngrams(F.col("t")))).alias("term"))
    tf = t.groupBy(key, "term").agg(F.count("*").alias("c"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.count()
    w = (1 + F.log(F.col("c").cast("double"))) * F.log1p(F.lit(float(n)) / (1 + F.col("df")))
    bucket = (F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("bigint") % dim).alias("bucket")
    x = tf.join(df, "term").select(key, bucket, w.alias("w")).groupBy(key, "bucket").agg(F.sum("w").alias("w"))
    norm = x.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return x.join(norm, key).where("norm > 0").select(key, "bucket", (F.col("w") / F.col("norm")).alias("w"))
