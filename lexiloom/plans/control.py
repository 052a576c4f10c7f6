"""The control plane as tables: what a question's pool looks like, which tool comes next, what the judge reads first, and where candidates were dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_query
from ..operators.gate import value_of_information

# Question types, retrieval profiles, and the spread of a score by the level that gave it.
KINDS = ("locate", "survey", "method_cross", "benchmark", "lineage")
PROFILES = {"P0": (False, 700, 150, 150), "P1": (True, 700, 150, 150), "P2": (True, 1000, 150, 150), "P3": (True, 1000, 300, 300)}
SIGMA = {0: 0.35, 1: 0.30, 2: 0.16, 3: 0.07}
# Wordings that the controllers look for.
CUES = {
    "cue_exhaustive": ("all", "every", "complete", "comprehensive"),
    "cue_representative": ("representative", "example", "examples", "key"),
    "cue_comparison": ("compare", "comparison", "versus", "vs"),
    "cue_list": ("papers", "works", "studies", "methods", "approaches"),
}
STATE = ("log_candidate_count", "log_query_chars", "log_query_words", *CUES, "channel_count", "mean_channel_count", "channel_pair_overlap", "best_channel_rank", "top_l1", "l1_at_20", "l1_decay_20", "quoted_span_count", "constraint_count")


def state_features(plans: DataFrame, h: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per question of plans(qid, query, kind, spans, constraints): the features its controllers see, from hits(qid, pid, channel, rank from 1) and scores(qid, pid, score)."""
    per = h.groupBy("qid", "pid").agg(F.count("*").alias("c"), (F.min("rank") - 1).alias("best"))
    pool = per.groupBy("qid").agg(F.count("*").alias("n"), F.avg("c").alias("mean_channel_count"), F.min("best").alias("best_channel_rank"))
    by = h.groupBy("qid", "channel").agg(F.count("*").alias("m")).groupBy("qid").agg(F.count("*").alias("channel_count"), F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("shared"))
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "pid")
    best = scores.withColumn("r", F.row_number().over(w)).where("r <= 20").groupBy("qid").agg(F.max("score").alias("top_l1"), F.min("score").alias("l1_at_20"))
    words = F.filter(F.split(plain_query(F.col("query")), " "), lambda x: x != "")
    q = plans.select("qid", "kind", F.length(F.trim("query")).alias("chars"), words.alias("words"), F.size("spans").alias("spans"), F.size("constraints").alias("cons"))
    x = q.join(pool, "qid", "left").join(by, "qid", "left").join(best, "qid", "left")
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    pairs = z("n") * (z("n") - 1) / 2
    return x.select(
        "qid",
        F.log1p(z("n")).alias("log_candidate_count"),
        F.log1p(F.col("chars").cast("double")).alias("log_query_chars"),
        F.log1p(F.size("words").cast("double")).alias("log_query_words"),
        *(F.arrays_overlap("words", F.array(*map(F.lit, ws))).cast("double").alias(k) for k, ws in CUES.items()),
        z("channel_count").alias("channel_count"),
        z("mean_channel_count").alias("mean_channel_count"),
        F.when(pairs > 0, z("shared") / pairs).otherwise(F.lit(0.0)).alias("channel_pair_overlap"),
        z("best_channel_rank").alias("best_channel_rank"),
        z("top_l1").alias("top_l1"),
        z("l1_at_20").alias("l1_at_20"),
        (z("top_l1") - z("l1_at_20")).alias("l1_decay_20"),
        F.col("spans").cast("double").alias("quoted_span_count"),
        F.col("cons").cast("double").alias("constraint_count"),
        *((F.col("kind") == k).cast("double").alias(f"query_type_{k}") for k in KINDS),
    )


def observed(plans: DataFrame, h: DataFrame, scores: DataFrame) -> DataFrame:
    """(qid, kind, pool, lexical_channels, overlap, top): what the tool decisions read; overlap is the mean share of the pool that a lexical channel found."""
    pool = h.groupBy("qid").agg(F.countDistinct("pid").alias("pool"))
    lex = h.where(F.col("channel").startswith("lexical:")).groupBy("qid").agg(F.countDistinct("channel").alias("lexical_channels"), F.count("*").alias("lexical_hits"))
    best = scores.groupBy("qid").agg(F.max("score").alias("top"))
    x = plans.select("qid", "kind").join(pool, "qid", "left").join(lex, "qid", "left").join(best, "qid", "left").na.fill(0, ["pool", "lexical_channels", "lexical_hits"]).na.fill(0.0, ["top"])
    share = F.when((F.col("lexical_channels") > 0) & (F.col("pool") > 0), F.col("lexical_hits") / (F.col("pool") * F.col("lexical_channels"))).otherwise(F.lit(0.0))
    return x.select("qid", "kind", "pool", "lexical_channels", share.alias("overlap"), "top")


def _decided(rules: list[tuple[Column, str, str]], last: tuple[str, str]) -> tuple[Column, Column]:
    action = reason = None
    for hit, a, r in rules:
        action = F.when(hit, a) if action is None else action.when(hit, a)
        reason = F.when(hit, r) if reason is None else reason.when(hit, r)
    return action.otherwise(last[0]), reason.otherwise(last[1])


def decisions(state: DataFrame, seeds: DataFrame, coverage: DataFrame, base_keep: int = 220, max_keep: int = 440, round_index: int = 1, max_rounds: int = 2, dense_pool: int = 260, dense_overlap: float = 0.36, dense_top: float = 0.42, widen_overlap: float = 0.72, target: float = 0.72) -> DataFrame:
    """(qid, tool, action, reason): the finite-state choice of the dense tool, of citation expansion, of the admission width and of another round, the first rule that holds.

    state: observed(); seeds(qid, n): eligible seeds; coverage(qid, coverage).
    """
    x = state.join(seeds.select("qid", F.col("n").alias("seeds")), "qid", "left").join(coverage.select("qid", "coverage"), "qid", "left").na.fill(0, ["seeds"])
    c = F.col
    tools = {
        "dense": _decided([(c("kind").isin("survey", "method_cross", "benchmark", "lineage"), "dense", "type"), (c("pool") < dense_pool, "dense", "sparse pool"), (c("overlap") < dense_overlap, "dense", "channels disagree"), (c("top") < dense_top, "dense", "low confidence")], ("skip", "lexical evidence is enough")),
        "citation": _decided([(c("seeds") <= 0, "skip", "no seed"), (c("kind") == "locate", "skip", "direct match")], ("citation", "seed")),
        "admission": _decided([((c("overlap") < widen_overlap) | (c("pool") > 2 * base_keep), f"keep {max_keep}", "uncertain")], (f"keep {base_keep}", "concentrated")),
        "followup": _decided([(F.lit(round_index < max_rounds) & (c("coverage").isNull() | (c("coverage") < target)), "rewrite", "low coverage")], ("stop", "coverage or rounds")),
    }
    rows = F.array(*(F.struct(F.lit(t).alias("tool"), a.alias("action"), r.alias("reason")) for t, (a, r) in tools.items()))
    return x.select("qid", F.explode(rows).alias("d")).select("qid", "d.*")


def rewrites(spans: Column, query: Column, current: Column) -> Column:
    """At most three strings of the next round: the first span, words one to eight and three to ten of the question, then the current ones."""
    words = F.filter(F.split(query, r"\s+"), lambda w: (F.length(w) > 2) & w.rlike(r"[\p{L}\p{N}]"))
    made = F.concat(F.slice(spans, 1, 1), F.when(F.size(words) > 0, F.array(F.array_join(F.slice(words, 1, 8), " "))).otherwise(F.array().cast("array<string>")), F.when(F.size(words) > 5, F.array(F.array_join(F.slice(words, 3, 8), " "))).otherwise(F.array().cast("array<string>")), current)
    return F.slice(F.array_distinct(F.filter(F.transform(made, lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")), 1, 3)


def dense_only(h: DataFrame) -> DataFrame:
    """(qid, pid, rank): candidates that a dense channel found and no lexical one, with their best dense rank."""
    dense, lexical = F.col("channel").startswith("dense:"), F.col("channel").startswith("lexical:")
    x = h.groupBy("qid", "pid").agg(F.min(F.when(dense, F.col("rank"))).alias("rank"), F.max(lexical).alias("lexical"))
    return x.where("rank is not null and not lexical").select("qid", "pid", "rank")


def dense_admission(h: DataFrame, scores: DataFrame, input_keep: int, most: int, least: float = 0.0) -> DataFrame:
    """(qid, pid, score, place): of the input_keep best dense-only candidates by rank, the `most` best by scores(qid, pid, score) from `least`."""
    if input_keep <= 0 or most <= 0:
        raise ValueError("input_keep and most must be positive")
    w = Window.partitionBy("qid").orderBy("rank", "pid")
    eligible = dense_only(h).withColumn("n", F.row_number().over(w)).where(F.col("n") <= input_keep)
    v = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "pid")
    return eligible.join(scores, ["qid", "pid"]).where(F.col("score") >= least).withColumn("place", F.row_number().over(v)).where(F.col("place") <= most).select("qid", "pid", "score", "place")


def precomputed(pool: DataFrame, artefact: DataFrame, strict: bool = True) -> DataFrame:
    """(qid, pid, score) of pool(qid, query, pid) from artefact(query_sha256, pid, score); with strict, a pair without score raises when read."""
    x = pool.withColumn("query_sha256", F.sha2("query", 256)).join(artefact.select("query_sha256", "pid", "score"), ["query_sha256", "pid"], "left")
    score = F.coalesce("score", F.raise_error(F.concat(F.lit("no score for "), F.col("pid"))).cast("double")) if strict else F.col("score")
    return x.select("qid", "pid", score.alias("score"))


def judge_order(scored: DataFrame, policy: str = "always", most: int = 12, batch: int = 6, least_voi: float = 0.004) -> DataFrame:
    """(qid, pid, voi, place, batch): which of scored(qid, pid, p, sigma, threshold, n, judged, referenced) the paid judge reads, by value of information.

    Policies: disabled (none), adaptive (none where the largest value is below least_voi), reference_first (papers found by references come first), always.
    """
    x = value_of_information(scored)
    if policy == "disabled":
        return x.limit(0).select("qid", "pid", "voi", F.lit(0).alias("place"), F.lit(0).alias("batch"))
    if policy == "adaptive":
        x = x.withColumn("best", F.max("voi").over(Window.partitionBy("qid"))).where(F.col("best") >= least_voi)
    first = [F.col("referenced").desc()] if policy == "reference_first" else []
    w = Window.partitionBy("qid").orderBy(*first, F.round("voi", 12).desc(), "pid")
    y = x.where("not judged").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return y.select("qid", "pid", "voi", "place", F.floor((F.col("place") - 1) / batch).cast("int").alias("batch"))


def verified(checks: DataFrame) -> DataFrame:
    """(qid, pid, s_l3, unknown): the judge's relevance of checks(qid, pid, relevance, status, holds), less .35 of the share of checks that are unknown.

    yes and partial need evidence that holds in the paper, else they are unknown; unknown statuses are too. Relevance is taken within 0..1, a missing one is .5.
    """
    status = F.when(F.col("status").isin("yes", "partial") & ~F.coalesce("holds", F.lit(False)), "unknown").when(F.col("status").isin("yes", "partial", "no"), F.col("status")).otherwise("unknown")
    x = checks.groupBy("qid", "pid").agg(F.max(F.greatest(F.least(F.coalesce("relevance", F.lit(0.5)), F.lit(1.0)), F.lit(0.0))).alias("rel"), F.avg((status == "unknown").cast("double")).alias("unknown"))
    return x.select("qid", "pid", (F.col("rel") * (1 - 0.35 * F.col("unknown"))).alias("s_l3"), "unknown")


def audit(pool: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """(qid, pid, drop_reason): the first of the stages, in order, that a row of pool(qid, pid) did not reach; null if it reached all."""
    x, reason = pool.select("qid", "pid").distinct(), None
    for name, rows in stages.items():
        x = x.join(rows.select("qid", "pid").distinct().withColumn(f"in_{name}", F.lit(True)), ["qid", "pid"], "left")
        missing = F.col(f"in_{name}").isNull()
        reason = F.when(missing, name) if reason is None else reason.when(missing, name)
    return x.select("qid", "pid", reason.alias("drop_reason"))


def best_profile(rewards: DataFrame) -> DataFrame:
    """(qid, profile) of rewards(qid, profile, reward): the largest reward; of equal ones P2, then the last name."""
    return rewards.groupBy("qid").agg(F.max_by("profile", F.struct("reward", (F.col("profile") == "P2").cast("int"), "profile")).alias("profile"))


def crawl(gate: DataFrame, least: float = 0.5) -> DataFrame:
    """(qid, expand, eligible): whether any seed of gate(qid, pid, p) is worth expanding, and how many are."""
    return gate.groupBy("qid").agg(F.max((F.col("p") >= least).cast("int")).alias("expand"), F.sum((F.col("p") >= least).cast("int")).alias("eligible"))
