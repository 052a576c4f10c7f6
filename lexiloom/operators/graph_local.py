"""The graph prior of many questions over one graph that fits a worker: no shuffle between rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most edges of a graph that goes to the workers whole, at 8 bytes each way of an edge and about 50 a node.
MOST_EDGES = 12_000_000


class Graph:
    """Edges by source and by target as compressed rows over numbered nodes; hashes ascend with the numbers."""

    def __init__(self, hashes: np.ndarray, names: pa.Array, src: np.ndarray, dst: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.names, self.n = hashes[order], names.take(pa.array(order)), len(hashes)
        src, dst = (np.searchsorted(self.hashes, x).astype(np.int32) for x in (src, dst))
        self.ways = [self._rows(src, dst), self._rows(dst, src)]

    def _rows(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([[0], np.cumsum(np.bincount(a, minlength=self.n))]), b[np.argsort(a, kind="stable")]

    def numbers(self, hashes: np.ndarray, pids: list[str]) -> np.ndarray:
        """The node of each pid; -1 for those outside the graph."""
        if not self.n:
            return np.full(len(pids), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.n - 1)
        same = pa.compute.equal(self.names.take(pa.array(at)), pa.array(pids, pa.string())).to_numpy(zero_copy_only=False)
        return np.where(same.astype(bool), at, -1)

    def degree(self, way: int) -> np.ndarray:
        return np.diff(self.ways[way][0])

    def beyond(self, nodes: np.ndarray, way: int) -> np.ndarray:
        """The ends of all edges of some nodes, in their order."""
        at, ends = self.ways[way]
        n = at[nodes + 1] - at[nodes]
        return ends[np.repeat(at[nodes] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if len(nodes) else ends[:0]

    def pagerank(self, seeds: np.ndarray, s: np.ndarray, way: int, alpha: float = 0.72, rounds: int = 24) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, scores) within `rounds` edges of the seeds, as `graph.pagerank`."""
        seen = np.zeros(self.n, bool)
        seen[seeds] = True
        last = seeds
        for _ in range(rounds):
            last = np.unique(self.beyond(last, way))
            last = last[~seen[last]]
            if not len(last):
                break
            seen[last] = True
        nodes = np.flatnonzero(seen)
        at = np.full(self.n, len(nodes), np.int32)  # nodes that no round reaches share a last place, which is not read
        at[nodes] = np.arange(len(nodes))
        d = self.degree(way)[nodes]
        to, start = at[self.beyond(nodes, way)], np.zeros(len(nodes))
        start[at[seeds]] = s
        state = start
        for _ in range(rounds):
            moved = np.bincount(to, np.repeat(state / np.maximum(d, 1), d), len(nodes) + 1)
            state = alpha * moved[:-1] + start * ((1 - alpha) + alpha * (state.sum() - moved.sum()))
        return nodes, state

    def meeting(self, seed: int, way: int) -> tuple[np.ndarray, np.ndarray]:
        """The other nodes that share a neighbour that way with a seed, and how many they share."""
        got, n = np.unique(self.beyond(self.beyond(np.array([seed]), way), 1 - way), return_counts=True)
        return got[got != seed], n[got != seed]


def _scaled(score: np.ndarray) -> np.ndarray:
    top = score.max(initial=0.0)
    return score / top if top > 0 else np.zeros_like(score)


def prior(g: Graph, seeds: np.ndarray, weights: np.ndarray, pool: np.ndarray | None, **options) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, scores) of one question, as `graph.graph_prior`. Weights are those of all seeds; seeds outside the graph are -1."""
    total, inside = weights.sum(), seeds >= 0
    start = (weights / (total if total > 0 else 1.0))[inside]
    seeds = seeds[inside]
    allowed = np.ones(g.n, bool)
    if pool is not None:
        allowed[:] = False
        allowed[pool[pool >= 0]] = True
    out, has = np.zeros(g.n), np.zeros(g.n, bool)

    def add(nodes: np.ndarray, score: np.ndarray, weight: float) -> None:
        ok = allowed[nodes]
        has[nodes[ok]] = True
        out[nodes[ok]] += weight * _scaled(score[ok])

    if len(seeds):
        for way in (0, 1):
            add(*g.pagerank(seeds, start, way, **options), 0.25)
        for way, weight in ((1, 0.32), (0, 0.18)):
            d, score, met = g.degree(way), np.zeros(g.n), np.zeros(g.n, bool)
            for seed in seeds:
                nodes, n = g.meeting(seed, way)
                met[nodes] = True
                if way:
                    score[nodes] += n / np.sqrt(d[seed].astype(float) * d[nodes])
                else:
                    score[nodes] = np.maximum(score[nodes], n / (d[seed] + d[nodes] - n))
            nodes = np.flatnonzero(met)
            add(nodes, score[nodes], weight)
    nodes = np.flatnonzero(has)
    return nodes, _scaled(out[nodes])


def gathered(e: DataFrame) -> Graph | None:
    """The graph of stored edges(src, dst), None if it has too many edges or two nodes of one hash."""
    if e.count() > MOST_EDGES:
        return None
    nodes = e.select(F.col("src").alias("pid")).unionAll(e.select("dst")).distinct().select(F.xxhash64("pid").alias("h"), "pid").toArrow()
    hashes = nodes["h"].to_numpy()
    if len(np.unique(hashes)) < len(hashes):
        return None
    pairs = e.select(F.xxhash64("src").alias("s"), F.xxhash64("dst").alias("d")).toArrow()
    return Graph(hashes, nodes["pid"].combine_chunks(), pairs["s"].to_numpy(), pairs["d"].to_numpy())


def graph_prior(g: Graph, seeds: DataFrame, pool: DataFrame | None = None, **options) -> DataFrame:
    """(qid, pid, score) of seeds(qid, pid, s): every question is one group, over the broadcast graph."""
    spark = seeds.sparkSession
    shared, bounded = spark.sparkContext.broadcast(g), pool is not None
    rows = seeds.select("qid", "pid", "s", F.lit(True).alias("seed"))
    if bounded:
        asked = pool.select("qid", "pid").distinct().join(seeds.select("qid").distinct(), "qid", "left_semi")
        rows = rows.unionByName(asked.select("qid", "pid", F.lit(0.0).alias("s"), F.lit(False).alias("seed")))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, t = shared.value, pa.Table.from_batches(batches)
        at, seed = g.numbers(t["h"].to_numpy(), t["pid"].to_pylist()), t["seed"].to_numpy().astype(bool)
        nodes, score = prior(g, at[seed], t["s"].to_numpy()[seed], at[~seed] if bounded else None, **options)
        for lo in range(0, len(nodes), 100_000):
            part = slice(lo, lo + 100_000)
            qid = pa.repeat(t["qid"][0], len(nodes[part]))
            yield pa.RecordBatch.from_arrays([qid, g.names.take(pa.array(nodes[part])), pa.array(score[part])], ["qid", "pid", "score"])

    # a stated number, as adaptive execution would put these few rows into one task
    rows = rows.where("qid is not null and pid is not null").withColumn("h", F.xxhash64("pid")).repartition(4 * spark.sparkContext.defaultParallelism, "qid")
    return rows.groupBy("qid").applyInArrow(of, "qid string, pid string, score double")
