"""Citation graph operators over edges(src, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, stored
from . import graph_local


def edges(papers: DataFrame) -> DataFrame:
    """Distinct citing -> cited pairs from reference_ids and citing_ids; blanks and self-loops dropped, ids trimmed."""
    out = papers.select(F.trim("pid").alias("src"), F.explode("reference_ids").alias("dst"))
    back = papers.select(F.explode("citing_ids").alias("src"), F.trim("pid").alias("dst"))
    both = out.unionByName(back).select(F.trim("src").alias("src"), F.trim("dst").alias("dst"))
    return both.where("src <> '' and dst <> '' and src <> dst").distinct()


EDGES_SQL = """edges as (select distinct src, dst from (
  select trim(pid) as src, trim(r) as dst from (select pid, unnest(reference_ids) as r from papers)
  union all select trim(c), trim(pid) from (select pid, unnest(citing_ids) as c from papers)) where src <> '' and dst <> '' and src <> dst)"""


def _scaled(df: DataFrame) -> DataFrame:
    """Scores divided by the largest of each qid."""
    top = F.max("score").over(Window.partitionBy("qid"))
    return df.withColumn("score", F.when(top > 0, F.col("score") / top).otherwise(F.lit(0.0)))


def _within(rows: DataFrame, pool: DataFrame | None) -> DataFrame:
    return rows if pool is None else rows.join(pool.select("qid", "pid"), ["qid", "pid"], "left_semi")


def cocitation(e: DataFrame, seeds: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """(qid, pid, score): sum over seeds(qid, pid) and common citers of 1/sqrt(indegree x indegree), scaled per qid; of the pairs of pool(qid, pid) if given.

    The seed side is joined first, so only the out-edges of citers of a seed are read; pairs outside the pool drop before degrees are looked up.
    """
    indeg = e.groupBy("dst").agg(F.count("*").alias("d"))
    citers = seeds.select("qid", F.col("pid").alias("seed")).distinct().join(e.select(F.col("dst").alias("seed"), F.col("src").alias("citer")), "seed")
    pairs = citers.join(e.select(F.col("src").alias("citer"), F.col("dst").alias("pid")), "citer").where("pid <> seed")
    pairs = _within(pairs, pool).groupBy("qid", "seed", "pid").agg(F.count("*").alias("n"))
    x = pairs.join(indeg.select(F.col("dst").alias("seed"), F.col("d").alias("ds")), "seed").join(indeg.select(F.col("dst").alias("pid"), F.col("d").alias("dp")), "pid")
    return _scaled(x.groupBy("qid", "pid").agg(F.sum(F.col("n") / F.sqrt(F.col("ds") * F.col("dp"))).alias("score")))


def coupling(e: DataFrame, seeds: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """(qid, pid, score): the largest overlap of references with a seed, as Jaccard, scaled per qid; of the pairs of pool(qid, pid) if given."""
    out = e.groupBy("src").agg(F.count("*").alias("d"))
    refs = seeds.select("qid", F.col("pid").alias("seed")).distinct().join(e.select(F.col("src").alias("seed"), "dst"), "seed")
    pairs = refs.join(e.select(F.col("src").alias("pid"), "dst"), "dst").where("pid <> seed")
    pairs = _within(pairs, pool).groupBy("qid", "seed", "pid").agg(F.count("*").alias("n"))
    x = pairs.join(out.select(F.col("src").alias("seed"), F.col("d").alias("ds")), "seed").join(out.select(F.col("src").alias("pid"), F.col("d").alias("dp")), "pid")
    return _scaled(x.groupBy("qid", "pid").agg(F.max(F.col("n") / (F.col("ds") + F.col("dp") - F.col("n"))).alias("score")))


def start_weights(seeds: DataFrame) -> DataFrame:
    """(qid, pid, s): what a seed starts with, before it is divided by the question's total."""
    weight = F.greatest(F.col("score").cast("double"), F.lit(0.0)) if "score" in seeds.columns else F.lit(1.0)
    return seeds.select("qid", "pid", weight.alias("s")).groupBy("qid", "pid").agg(F.max("s").alias("s"))


def pagerank(e: DataFrame, seeds: DataFrame, alpha: float = 0.72, rounds: int = 24, each: int = 3) -> DataFrame:
    """(qid, pid, score): personalised PageRank along out-edges, all qids at once; mass without out-edge goes back to the seeds.

    Seeds(qid, pid[, score]) start by their scores, equal ones without; those outside the graph keep nothing, and their share is lost.
    A fixed number of rounds; after every `each` of them the state, which the next round reads twice (through one reused exchange),
    is cut in the shared folder. Scores of a round travel as (qid, pid) rows, so the state is only the nodes reached.
    """
    start = start_weights(seeds)
    total = F.sum("s").over(Window.partitionBy("qid"))
    out = cut(e.join(e.groupBy("src").agg(F.count("*").alias("d")), "src"))
    nodes = e.select(F.col("src").alias("pid")).unionAll(e.select(F.col("dst").alias("pid"))).distinct()
    start = cut(start.withColumn("s", F.col("s") / F.when(total > 0, total).otherwise(1.0)).join(nodes, "pid", "left_semi").select("qid", "pid", "s"))
    state = start.withColumnRenamed("s", "score")
    for i in range(rounds):
        moved = state.join(out, state["pid"] == out["src"]).groupBy("qid", F.col("dst").alias("pid")).agg(F.sum(F.col("score") / F.col("d")).alias("m"))
        gone = state.select("qid", F.col("score").alias("g")).unionAll(moved.select("qid", -F.col("m"))).groupBy("qid").agg(F.sum("g").alias("gone"))
        back = start.join(gone, "qid").select("qid", "pid", (F.col("s") * ((1 - alpha) + alpha * F.col("gone"))).alias("m"))
        state = moved.select("qid", "pid", (alpha * F.col("m")).alias("m")).unionByName(back).groupBy("qid", "pid").agg(F.sum("m").alias("score"))
        if i % each == each - 1 and i < rounds - 1:
            state = cut(state)
    return state


def flipped(e: DataFrame) -> DataFrame:
    return e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def both_ways(e: DataFrame, seeds: DataFrame, pool: DataFrame | None = None, **options) -> DataFrame:
    """The mean of PageRank along and against citations, each restricted to the pool and scaled to 1 per qid first."""
    parts = [_scaled(_within(pagerank(x, seeds, **options), pool)) for x in (e, flipped(e))]
    return parts[0].unionByName(parts[1]).groupBy("qid", "pid").agg((F.sum("score") / 2).alias("score"))


def graph_prior(e: DataFrame, seeds: DataFrame, pool: DataFrame | None = None, **options) -> DataFrame:
    """.5 PageRank + .32 co-citation + .18 coupling, scaled per qid; of the pairs of pool(qid, pid) if given.

    Edges are stored once. A graph of at most graph_local.MOST_EDGES goes to the workers whole, where each question is computed
    without a shuffle; a larger one takes the joins, with the same result.
    """
    e = stored(e)
    g = graph_local.gathered(e)
    if g is None:
        return joined_prior(e, seeds, pool, **options)
    return graph_local.graph_prior(g, start_weights(seeds), pool, **options)


def joined_prior(e: DataFrame, seeds: DataFrame, pool: DataFrame | None = None, **options) -> DataFrame:
    """graph_prior by joins over edges of any number."""
    plain = seeds.select("qid", "pid")
    parts = [(both_ways(e, seeds, pool, **options), 0.5), (cocitation(e, plain, pool), 0.32), (coupling(e, plain, pool), 0.18)]
    rows = None
    for df, w in parts:
        part = df.select("qid", "pid", (F.col("score") * w).alias("score"))
        rows = part if rows is None else rows.unionByName(part)
    return _scaled(rows.groupBy("qid", "pid").agg(F.sum("score").alias("score")))


def expansion_targets(prior: DataFrame, known: DataFrame, most: int = 40) -> DataFrame:
    """(qid, pid, score, rank): what graph_prior ranks best among the nodes that known(qid, pid) lacks."""
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "pid")
    return prior.join(known.select("qid", "pid"), ["qid", "pid"], "left_anti").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def graph_signal(prior: DataFrame, pool: DataFrame, least: float = 0.42) -> DataFrame:
    """(qid, pid, s_graph) of pool(qid, pid, s_constraint): the prior of candidates whose constraint score reaches `least`, else 0."""
    x = pool.select("qid", "pid", "s_constraint").join(prior, ["qid", "pid"], "left")
    return x.select("qid", "pid", F.when(F.col("s_constraint") >= least, F.coalesce("score", F.lit(0.0))).otherwise(F.lit(0.0)).alias("s_graph"))


def expand(docs: DataFrame, seeds: DataFrame, limit: int = 40, max_seeds: int = 6) -> DataFrame:
    """(qid, channel, seed, pid, rank): one hop both ways from the best max_seeds of seeds(qid, pid, score), ties by pid, `limit` a seed and direction.

    docs(rec_id, pid, reference_ids): references come in their stored order, citing papers in that of their rows; the cut precedes any look whether a target is known.
    """
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "pid")
    s = seeds.withColumn("n", F.row_number().over(w)).where(F.col("n") <= max_seeds).select("qid", F.col("pid").alias("seed"))
    refs = docs.select("rec_id", F.trim("pid").alias("src"), F.posexplode("reference_ids").alias("pos", "dst")).select("rec_id", "src", "pos", F.trim("dst").alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    refs = refs.groupBy("src", "dst").agg(F.min(F.struct("rec_id", "pos")).alias("at"))
    out = s.join(refs.select(F.col("src").alias("seed"), F.col("dst").alias("pid"), "at"), "seed").withColumn("channel", F.lit("cite_bwd"))
    into = s.join(refs.select(F.col("dst").alias("seed"), F.col("src").alias("pid"), "at"), "seed").withColumn("channel", F.lit("cite_fwd"))
    r = F.row_number().over(Window.partitionBy("qid", "channel", "seed").orderBy("at", "pid"))
    return out.unionByName(into).withColumn("rank", r).where(F.col("rank") <= limit).select("qid", "channel", "seed", "pid", "rank")


def pick_seeds(pool: DataFrame, by: str, most: int = 6, least: float | None = None) -> DataFrame:
    """(qid, pid, score) of the best rows of each qid by a column, ties by pid; with least, only rows whose score reaches it. An unknown column raises ValueError."""
    if by not in pool.columns:
        raise ValueError(f"unknown seed score {by}")
    x = pool.select("qid", "pid", F.col(by).alias("score"))
    x = x if least is None else x.where(F.col("score") >= least)
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "pid")
    return x.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def owner(pid: Column, source: Column, known: list[str]) -> Column:
    """Which source to ask for a paper's citations: its own if known, else that of its id's prefix, else the first."""
    prefix = F.split(pid, ":")[0]
    return F.when(source.isin(known), source).when(prefix.isin(known), prefix).otherwise(F.lit(known[0] if known else None))


def contexts(docs: DataFrame, targets: DataFrame, most: int = 100) -> DataFrame:
    """(pid, citing, title, context, rank): for each of targets(pid) its citing papers in row order, with the context `cited alongside n refs`."""
    refs = docs.select("rec_id", F.col("pid").alias("citing"), "title", F.size("reference_ids").alias("n"), F.explode(F.array_distinct("reference_ids")).alias("pid"))
    x = refs.join(targets.select("pid").distinct(), "pid", "left_semi").where("citing <> pid")
    w = Window.partitionBy("pid").orderBy("rec_id")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("pid", "citing", "title", F.concat(F.lit("cited alongside "), F.col("n").cast("string"), F.lit(" refs")).alias("context"), "rank")


def unknown_targets(found: DataFrame, known: DataFrame) -> DataFrame:
    """Expansion targets that the corpus lacks."""
    return found.select("pid").distinct().join(known.select("pid"), "pid", "left_anti")


def induced(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both in nodes(pid)."""
    n = nodes.select("pid").distinct()
    return e.join(n.withColumnRenamed("pid", "src"), "src", "left_semi").join(n.withColumnRenamed("pid", "dst"), "dst", "left_semi").select("src", "dst")


def degrees(e: DataFrame) -> DataFrame:
    return e.select(F.col("src").alias("pid")).unionAll(e.select(F.col("dst").alias("pid"))).groupBy("pid").agg(F.count("*").alias("degree"))


def citers(e: DataFrame) -> DataFrame:
    """(pid, citing_ids): the inverse of the reference lists, sorted."""
    return e.groupBy(F.col("dst").alias("pid")).agg(F.array_sort(F.collect_list("src")).alias("citing_ids"))


def cocite_channel(prior: DataFrame, least: float = 0.25, most: int = 200) -> DataFrame:
    """The graph channel: candidates of prior of at least `least`, best first, as hits."""
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "pid")
    return prior.where(F.col("score") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("qid", "pid", F.lit("cocite").alias("channel"), "rank")
