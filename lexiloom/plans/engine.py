"""The whole retrieval plan for a batch of questions, from channels to tiers.

All stages are DataFrames keyed (qid, pid); one question is a batch of one. The driver holds
the control plane only: policies, budgets and the stop rule.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import calibrate, constraints, coverage, gate, graph, lexical, ranks
from ..runtime import stored
from .control import rewrites


@dataclass(frozen=True)
class Policy:
    """What a query type expects: the prior of the answer-set size and its channel weights."""

    prior: float
    sd: float
    weights: dict[str, float] = field(default_factory=dict)
    rounds: int = 3
    core_ratio: float = 1.25
    limits: dict[str, float] = field(default_factory=dict)


def _limits(calls: int, tokens: int, judged: int, seconds: int) -> dict[str, float]:
    return {"llm_calls": calls, "tokens": tokens, "judgments": judged, "seconds": seconds}


# The policies by query type: prior, spread, channel weights, rounds, core ratio and limits.
POLICIES = {
    "locate": Policy(2, 1.5, {"lexical": 1.3, "dense": 1.4, "cite_bwd": 0.4, "cite_fwd": 0.4, "cocite": 0.5}, 2, 1.6, _limits(8, 25_000, 20, 30)),
    "method_cross": Policy(12, 7, {"lexical": 1.0, "dense": 1.2, "cite_bwd": 0.9, "cite_fwd": 0.9, "cocite": 1.1}, 3, 1.25, _limits(14, 55_000, 40, 45)),
    "benchmark": Policy(16, 9, {"lexical": 1.2, "dense": 1.0, "cite_bwd": 0.7, "cite_fwd": 1.2, "cocite": 1.3}, 3, 1.2, _limits(14, 55_000, 45, 45)),
    "survey": Policy(25, 14, {"lexical": 0.9, "dense": 1.1, "cite_bwd": 1.3, "cite_fwd": 1.3, "cocite": 1.4}, 4, 1.05, _limits(18, 75_000, 70, 60)),
    "lineage": Policy(12, 7, {"lexical": 0.8, "dense": 0.9, "cite_bwd": 1.2, "cite_fwd": 1.5, "cocite": 1.0}, 3, 1.25, _limits(14, 55_000, 40, 45)),
}
#: Below so many candidates, hard filters are given up.
MIN_RECALL = 5
#: Constraint score that a citation seed and a graph bonus need.
FLOOR = 0.42


@dataclass
class Ledger:
    """Counters and limits of a run."""

    limits: dict[str, float] = field(default_factory=dict)
    counts: dict[str, float] = field(default_factory=dict)
    events: list[tuple[str, str]] = field(default_factory=list)

    def add(self, what: str, n: float = 1) -> None:
        self.counts[what] = self.counts.get(what, 0) + n

    def exhausted(self) -> bool:
        return any(self.counts.get(k, 0) >= v for k, v in self.limits.items())


    def note(self, stage: str, text: str) -> None:
        self.events.append((stage, text))


def _by_kind(of: Callable[[Policy], float]) -> Column:
    m = F.create_map(*(x for k, p in POLICIES.items() for x in (F.lit(k), F.lit(float(of(p))))))
    return F.try_element_at(m, F.col("kind"))


def parse(queries: DataFrame) -> DataFrame:
    """Plans by rules with the policy of their type: prior of the answer-set size and core ratio. An observed prior is shrunk to the policy's by the geometric mean, here of equal values."""
    p = constraints.plans(queries)
    return p.withColumns({"prior": _by_kind(lambda p: p.prior), "core_ratio": _by_kind(lambda p: p.core_ratio)})


def typed_rrf(h: DataFrame, plans: DataFrame) -> DataFrame:
    """Rank fusion with the channel weights of each query's type; unknown channels weigh 1."""
    rows = [(k, c, float(w)) for k, p in POLICIES.items() for c, w in p.weights.items()]
    table = F.broadcast(h.sparkSession.createDataFrame(rows, "kind string, family string, w double"))  # a fixed table of 25 rows
    x = h.join(plans.select("qid", "kind"), "qid").withColumn("family", F.split("channel", ":")[0]).join(table, ["kind", "family"], "left")
    return x.groupBy("qid", "pid").agg(F.sum(F.coalesce("w", F.lit(1.0)) / (60 + F.col("rank"))).alias("score"))


def view_hits(docs: DataFrame, strings: DataFrame, limit: int = 20) -> DataFrame:
    """(qid, pid, channel, rank) of strings(qid, query_index, string): every view of the full-text index as a channel, the lists of a question's strings one after the other."""
    keyed = strings.select(F.concat_ws("\u0001", "qid", F.col("query_index").cast("string")).alias("qid"), F.col("string").alias("query"))
    got = lexical.view_search(docs, keyed, limit=limit)
    part = F.split("qid", "\u0001")
    lists = got.select(part[0].alias("qid"), F.concat(F.lit("lexical:view:"), "view").alias("channel"), part[1].cast("int").alias("query_index"), "rank", "pid")
    return ranks.assemble(lists).select("qid", "pid", "channel", F.col("first_rank").alias("rank"))


def eligible(pairs: DataFrame, docs: DataFrame, plans: DataFrame) -> DataFrame:
    """pairs(qid, pid) that pass the hard filters of their question; of questions that the filters leave fewer than MIN_RECALL, all with a title that the filters on reviews pass.

    Unknown years and venues pass.
    """
    f = plans.select("qid", "no_reviews", constraints.filters(F.col("constraints")).alias("f"))
    x = pairs.join(docs.select("pid", "title", "year", "venue", tx.is_review(F.col("doc_type"), F.col("title")).alias("review")), "pid").join(f, "qid").where(F.length("title") >= 8)
    x = x.where(~F.col("no_reviews") | ~F.col("review"))
    named = F.exists(F.coalesce("f.venues", F.array().cast("array<string>")), lambda v: F.contains(F.upper("venue"), F.upper(v)))
    ok = (F.col("f.year_min").isNull() | F.col("year").isNull() | (F.col("year") >= F.col("f.year_min"))) & (F.col("f.venues").isNull() | (F.coalesce("venue", F.lit("")) == "") | named)
    x = x.withColumn("ok", ok)
    enough = x.groupBy("qid").agg((F.sum(F.col("ok").cast("int")) >= MIN_RECALL).alias("enough"))
    return x.join(enough, "qid").where("ok or not enough").select("qid", "pid")


def pair_signals(pool: DataFrame, docs: DataFrame, plans: DataFrame) -> DataFrame:
    """(qid, pid, cover, s_title, s_constraint) of pool(qid, pid): what depends on question and document alone."""
    met = constraints.match(pool, docs, plans).select("qid", "pid", F.col("score").alias("s_constraint"))
    return ranks.text_signals(pool, docs, plans).join(met, ["qid", "pid"])


def first_level(pool: DataFrame, h: DataFrame, signals: DataFrame, plans: DataFrame, g: DataFrame | None) -> DataFrame:
    """(qid, pid, l1, rrf, graph, title, constraint) of pool(qid, pid) with its pair_signals; g(qid, pid, score) is the graph prior, which only candidates above FLOOR get."""
    x = pool.join(typed_rrf(h, plans).withColumnRenamed("score", "rrf"), ["qid", "pid"]).join(ranks.channel_signals(h), ["qid", "pid"])
    x = x.join(signals, ["qid", "pid"])
    if g is None:
        x = x.withColumn("graph", F.lit(0.0))
    else:
        x = x.join(graph.graph_signal(g, x, FLOOR).withColumnRenamed("s_graph", "graph"), ["qid", "pid"])
    return x.select("qid", "pid", ranks.l1_score().alias("l1"), "rrf", "graph", F.col("s_title").alias("title"), F.col("s_constraint").alias("constraint"))


def run(queries: DataFrame, papers: DataFrame, candidates: DataFrame, keep: int = 220, l2_keep: int = 80, seeds: int = 6, use_graph: bool = True, pagerank_rounds: int = 24, expand_limit: int = 40, views: bool = True, rounds: int = 1, ledger: Ledger | None = None) -> DataFrame:
    """(qid, pid, rank, p, tier): the answer set of every question.

    Plans -> hits of candidates and of the full-text views -> hard filters, relaxed where they leave too little -> seeds, citation expansion and
    graph channel -> first-level score and cut -> reranking and cut -> fusion of signals -> calibration to the independent mass ->
    coverage -> stop rule, and with more rounds another one with rewritten strings for questions that go on -> F1 gate over 400 draws -> tiers.
    Stages that later stages read more than once are stored in the shared folder. Questions
    without candidates have no rows. The ledger counts rounds and says why they ended; a limit it reaches ends them.
    """
    ledger = ledger or Ledger()
    plans = stored(parse(queries))
    docs = stored(lexical.corpus(papers))
    h = ranks.hits(candidates).select("qid", "pid", "channel", "rank")
    strings = plans.select("qid", F.posexplode("search_strings").alias("query_index", "string"))
    for at in range(1, max(1, rounds) + 1):
        ledger.add("rounds")
        if views:
            h = h.unionByName(view_hits(docs, strings)).groupBy("qid", "pid", "channel").agg(F.min("rank").alias("rank"))
        h = stored(h)
        pool = stored(eligible(h.select("qid", "pid").distinct(), docs, plans))
        h = stored(h.join(pool, ["qid", "pid"], "left_semi"))
        g, signals = None, stored(pair_signals(pool, docs, plans))
        if use_graph:
            preview = stored(first_level(pool, h, signals, plans, None))
            start = graph.pick_seeds(preview.where(F.col("constraint") >= FLOOR), "l1", seeds)
            start = start.unionByName(graph.pick_seeds(preview, "rrf", seeds).join(start.select("qid").distinct(), "qid", "left_anti").withColumn("score", F.lit(1.0)))
            start = stored(start)
            e = stored(graph.edges(papers))
            reached = graph.expand(docs, start, expand_limit, seeds).groupBy("qid", "pid", "channel").agg(F.min("rank").alias("rank"))
            pool = stored(eligible(h.select("qid", "pid").unionByName(reached.select("qid", "pid")).distinct(), docs, plans))
            # the pairs that the citations brought; those known have their signals
            fresh = stored(pool.join(signals.select("qid", "pid"), ["qid", "pid"], "left_anti"))
            signals = signals.unionByName(stored(pair_signals(fresh, docs, plans)))
            g = stored(graph.graph_prior(e, start, pool, rounds=pagerank_rounds))
            more = reached.unionByName(graph.cocite_channel(g)).join(pool, ["qid", "pid"], "left_semi")
            h = stored(h.unionByName(more).groupBy("qid", "pid", "channel").agg(F.min("rank").alias("rank")))
        l1 = stored(ranks.top(first_level(pool, h, signals, plans, g), keep, "l1").drop("rank"))
        l2 = lexical.lexical_rerank(l1, docs, plans.select("qid", "query")).withColumnRenamed("score", "l2")
        kept = ranks.l2_blend(l1.join(l2, ["qid", "pid"]).withColumns({"s_l1": F.col("l1"), "s_l2": F.col("l2")}), l2_keep)
        scored = ranks.fuse_signals(kept.join(plans.select("qid", "kind"), "qid"), ["title", "l2", "l1", "rrf", "graph"]).withColumnRenamed("fused", "score")
        mass = coverage.mass_anchor(h, plans.select("qid", "prior")).join(plans.select("qid", "prior"), "qid")
        p = calibrate.calibrate(scored, mass).join(plans.select("qid", "kind", "core_ratio"), "qid").join(docs.select("pid", "citation_count", "year", "doc_type", "title"), "pid")
        gold = calibrate.p_gold(F.col("p"), calibrate.propensity(F.col("citation_count"), F.col("year"), tx.is_review(F.col("doc_type"), F.col("title"))), F.col("kind"))
        final = stored(p.select("qid", "pid", "core_ratio", F.col("p").alias("p_rel"), gold.alias("p")))
        relevance = final.select("qid", "pid", F.col("p_rel").alias("p"))
        est = stored(coverage.estimate(coverage.capture_counts(h, relevance), coverage.channel_jaccard(h), plans.select("qid", "prior")))
        if at >= rounds:
            ledger.note("stop", "rounds")
            break
        on = coverage.should_stop(est, coverage.capture_counts(h, relevance), at, rounds, ledger.exhausted()).where("not stop").select("qid")
        strings = stored(plans.join(on, "qid", "left_semi").select("qid", F.posexplode(rewrites(F.col("spans"), F.col("query"), F.col("search_strings"))).alias("query_index", "string")))
        if not strings.limit(1).count():
            ledger.note("stop", "budget" if ledger.exhausted() else "coverage or gain")
            break
    curve = gate.f1_curve_draws(final.select("qid", "pid", "p"), coverage.draws(est))
    ratio = final.select("qid", "core_ratio").distinct()
    t = gate.tiers(curve, gate.cutoff(curve, ratio=ratio))
    return t.join(final.select("qid", "pid", "p"), ["qid", "pid"]).select("qid", "pid", F.col("k").alias("rank"), F.round("p", 6).alias("p"), "tier")
