"""Problem 9: mixing sources to target weights, interleaved by Pfair scheduling."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from .bpe import count_tokens

SOURCES_MOST = 10_000


def plan(available: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, dict]:
    """Quotas in tokens: the largest total at which each source with documents keeps its share within its repeats.

    Shares of sources without documents go to the others in proportion.
    """
    live = {s: t for s, t in targets.items() if available.get(s, 0) > 0 and t[0] > 0 and t[1] > 0}
    share = {s: t[0] / sum(x[0] for x in live.values()) for s, t in live.items()}
    total = min((t[1] * available[s] / share[s] for s, t in live.items()), default=0.0)
    return {s: {"weight": share[s], "quota": min(share[s] * total, live[s][1] * available[s]), "available": available[s], "repeats": live[s][1]} for s in sorted(live)}


def schedule(plans: dict[str, dict], slots: int) -> list[tuple[str, int, int]]:
    """(source, block, slot): earliest deadline first over the released blocks.

    Block i of a source of weight w is released at slot floor(i / w) and due by
    ceil((i + 1) / w); every source stays within one block of its ideal share.
    """
    total = sum(p["quota"] for p in plans.values())
    if not total:
        return []
    size = total / slots
    left = {s: max(1, math.ceil(p["quota"] / size - 1e-9)) for s, p in plans.items()}
    due = lambda s, i: math.ceil((i + 1) / plans[s]["weight"] - 1e-9)
    waiting = [(0, s, 0) for s in plans]
    ready: list[tuple[int, str, int]] = []
    heapq.heapify(waiting)
    out, slot = [], 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (due(s, i), s, i))
        _, s, i = heapq.heappop(ready)
        out.append((s, i, slot))
        if i + 1 < left[s]:
            heapq.heappush(waiting, (math.floor((i + 1) / plans[s]["weight"] + 1e-9), s, i + 1))
        slot += 1
    return out


def mixture(documents: DataFrame, targets: DataFrame, slots: int = 4096, buckets: int = 1024, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, shares).

    selection(doc_id, source, copy, n_tokens, slot, place): each use of a document; the mixture in order is
    by (slot, source, place). shares: one row per target source with what it has, wanted and got.

    Sources are compared after trimming, in lower case. Documents of no target source, or
    without tokens (null and empty texts), are not used. Each source is a stream in hash
    order, repeated at most max_repeats times; its prefix sums are taken per hash bucket
    (buckets x sources cells, summed first), so no source meets in one task. The last document of a source is
    used if at least half of it lies within the quota. Repeated or null target rows: the first by
    share counts. The schedule has `slots` blocks at every size of the corpus.
    """
    spark = documents.sparkSession
    goal = targets.where("source is not null").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    goals = {r[0]: (r[1], r[2]) for r in goal.limit(SOURCES_MOST + 1).collect()}
    if len(goals) > SOURCES_MOST:
        raise ValueError(f"more than {SOURCES_MOST} target sources")
    h = F.xxhash64(F.col("doc_id"))
    docs = documents.select("doc_id", F.lower(F.trim("source")).alias("source"), "text").where(F.col("source").isin(list(goals)))
    docs = docs.select("doc_id", "source", count_tokens(F.col("text"), path).alias("n_tokens"), h.alias("h"), F.pmod(h, F.lit(buckets)).cast("int").alias("bucket")).where("n_tokens > 0")
    docs = cut(docs)
    cells = docs.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    have = {r[0]: r[1] for r in docs.groupBy("source").agg(F.sum("n_tokens")).collect()}
    plans = plan(have, goals)
    slots = min(slots, max(1, int(sum(p["quota"] for p in plans.values()))))
    block = sum(p["quota"] for p in plans.values()) / slots if plans else 1.0
    rows = [(s, p["available"], float(p["quota"]), math.ceil(p["quota"] / p["available"] - 1e-12)) for s, p in plans.items()]
    per_source = F.broadcast(spark.createDataFrame(rows, "source string, available long, quota double, copies int"))
    slot_rows = schedule(plans, slots)
    slot_of = F.broadcast(spark.createDataFrame(slot_rows, "source string, block int, slot int"))
    last = F.broadcast(spark.createDataFrame([(s, max(b for t, b, _ in slot_rows if t == s)) for s in plans], "source string, last_block int"))
    inner = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at = docs.join(cells, ["source", "bucket"]).withColumn("start", F.coalesce("base", F.lit(0)) + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    used = at.join(per_source, "source").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    used = used.withColumn("place", F.col("copy") * F.col("available") + F.col("start")).where(F.col("place") + F.col("n_tokens") / 2 <= F.col("quota"))
    used = used.join(last, "source").withColumn("block", F.least(F.floor(F.col("place") / block).cast("int"), "last_block")).join(slot_of, ["source", "block"])
    selection = used.select("doc_id", "source", "copy", "n_tokens", "slot", "place")
    got = selection.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"), (F.max("copy") + 1).alias("most_uses"))
    every = spark.createDataFrame([(s, float(t), int(m), have.get(s, 0)) for s, (t, m) in goals.items()], "source string, target_share double, max_repeats int, available_tokens long")
    joined = every.join(got, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("tokens", "documents", "most_uses")})
    total = F.sum("tokens").over(Window.partitionBy())
    shares = joined.withColumn("actual_share", F.when(total > 0, F.col("tokens") / total).otherwise(F.lit(0.0)))
    return selection, shares
