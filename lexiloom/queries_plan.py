"""Queries of planning, control, sections, views and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import ids
from .functions import text as tx
from .operators import calibrate, constraints, coverage, entities, evaluate, gate, graph, lexical, ranks, sections, views
from .plans import control
from .queries import C, CAP_SQL, COCITE_CTES, E, EST_SQL, ETOK, GOLD_SQL, GROUPS_SQL, H, IDENT_SQL, LEVELS_SQL, P_SQL, PLAN_SQL, POOL_SQL, PRF_SQL, TOK, _corpus, _curve, _estimate, _gold, _hits, _levels, _plans, _pool, _prf, _rounded, query
from .runtime import table

WORDS = tx.words_sql()
FT_STOP = ",".join(f"'{w}'" for w in tx.FULLTEXT_STOP)


def _terms_sql(c, limit=18):
    found = f"list_transform(regexp_extract_all(coalesce({c}, ''), '[A-Za-z][A-Za-z0-9_-]+|[一-鿿]{{2,}}'), lambda t: lower(t))"
    return f"(select (list_filter(f, lambda t, i: t not in ({FT_STOP}) and not list_contains(f[1:i-1], t)))[1:{limit}] from (select {found} as f))"


VIEW_SQL = f"""with {C}, q as (select qid, {_terms_sql("query")} as ts from harness_queries), qt as (select qid, t as term, array_to_string({WORDS.format("t")}, ' ') as phrase from (select qid, unnest(ts) as t from q)),
d as (select pid, ' ' || array_to_string({WORDS.format("title")}, ' ') || ' ' as title, ' ' || array_to_string({WORDS.format("abstract")}, ' ') || ' ' as abstract, len({WORDS.format("title")}) + len({WORDS.format("abstract")}) as dl from corpus),
st as (select count(*) as n, avg(dl) as avgdl from d), v as (select distinct term, phrase from qt where phrase <> ''),
dt as (select pid, term, count(*) filter (where f = 't') as nt, count(*) filter (where f = 'a') as na from (select pid, 't' as f, unnest({WORDS.format("title")}) as w from corpus union all select pid, 'a', unnest({WORDS.format("abstract")}) from corpus) join v on v.phrase = w where not contains(v.phrase, ' ') and (length(w) > 1) group by 1, 2
  union all select pid, term, len(string_split(title, ' ' || phrase || ' ')) - 1, len(string_split(abstract, ' ' || phrase || ' ')) - 1 from d, v where contains(phrase, ' ') and (contains(title, ' ' || phrase || ' ') or contains(abstract, ' ' || phrase || ' '))),
vw(name, ut, wt, wa) as (values ('abstract', 0, 3.0, 1.0), ('title_abstract', 1, 3.0, 1.0), ('all_fields', 1, 3.0, 1.0)),
tf as (select name, pid, term, ut * wt * nt + wa * na as tf from dt, vw where ut * wt * nt + wa * na > 0), df as (select name, term, count(*) as df from tf group by 1, 2),
sc as (select qid, name, tf.pid, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from tf join df using (name, term) join qt using (term) join d on d.pid = tf.pid, st group by 1, 2, 3),
lists as (select * from (select *, row_number() over (partition by qid, name order by round(score, 9) desc, pid) as rank from sc) where rank <= 20)"""


@query(VIEW_SQL + " select qid, name as view, pid, round(score, 6) as score, rank from lists")
def lexical_views(spark, d):
    return _rounded(lexical.view_search(_corpus(spark, d), table(spark, d, "harness_queries")), "score")


@query(VIEW_SQL + " select qid, pid, round(score, 6) as score, rank from (select *, row_number() over (partition by qid order by round(score, 9) desc, pid) as rank from (select qid, pid, sum(1.0 / (60 + rank)) as score from lists group by 1, 2)) where rank <= 20")
def fused_views(spark, d):
    return _rounded(lexical.fused_views(lexical.view_search(_corpus(spark, d), table(spark, d, "harness_queries"))), "score")


@query(f"with q as (select qid, {_terms_sql('query')} as ts from harness_queries) select qid, array_to_string(ts, ' OR ') as terms from q")
def fulltext_terms(spark, d):
    return table(spark, d, "harness_queries").select("qid", F.array_join(lexical.query_terms(F.col("query")), " OR ").alias("terms"))


@query(f"""with {C}, q as (select qid, unnest({TOK.format("query")}) as term from harness_queries), qt as (select qid, term, count(*) as qf from q group by 1, 2),
t as (select pid, {TOK.format("concat(title, chr(10), coalesce(abstract, ''))")} as t from corpus), st as (select count(*) as n, avg(len(t)) as avgdl from t), tf as (select pid, term, len(t) as dl, count(*) as tf from (select pid, t, unnest(t) as term from t) group by 1, 2, 3),
df as (select term, count(*) as df from tf where term in (select term from qt) group by 1),
s as (select qid, tf.pid, sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from tf join df using (term) join qt using (term), st group by 1, 2),
b as (select * from (select *, row_number() over (partition by qid order by round(score, 9) desc, pid) as r from s) where r <= 80), y as (select b.* from b join corpus using (pid) where year is null or year >= 2015)
select qid, pid, round(score, 6) as score, rank from (select *, row_number() over (partition by qid order by round(score, 9) desc, pid) as rank from y) where rank <= 20""")
def local_search(spark, d):
    return _rounded(lexical.local_search(_corpus(spark, d), table(spark, d, "harness_queries"), 20, 2015), "score")


# --- constraints and plans -------------------------------------------------------------------


@query(f"with {PLAN_SQL} select qid, year_min, array_to_string(venues, '|') as venues, case when year_min is null and len(venues) = 0 then 0 else 1 end as hard from plan")
def plan_filters(spark, d):
    p = _plans(spark, d)
    f = p.select("qid", constraints.filters(F.col("constraints")).alias("f"), F.size(constraints.by_role(F.col("constraints"), "hard_filter")).alias("n"))
    return f.select("qid", "f.year_min", F.coalesce(F.array_join("f.venues", "|"), F.lit("")).alias("venues"), (F.col("n") > 0).cast("int").alias("hard"))


@query(f"with {GROUPS_SQL} select qid, sum((role in ('verify', 'anchor', 'negative'))::int)::bigint as verified, sum((role = 'hard_filter')::int)::bigint as hard, sum(case when role = 'hard_filter' then least(weight, 0.8) else weight end)::double as relaxed_weight from groups group by 1")
def plan_relaxation(spark, d):
    p = _plans(spark, d).select("qid", "constraints", constraints.relaxed(F.col("constraints")).alias("r"))
    n = lambda *roles: F.size(constraints.by_role(F.col("constraints"), *roles)).cast("bigint")
    total = F.aggregate("r", F.lit(0.0), lambda s, c: s + c["weight"])
    return p.select("qid", n("verify", "anchor", "negative").alias("verified"), n("hard_filter").alias("hard"), F.round(total, 6).alias("relaxed_weight"))


STATE_SQL = f"""pe as (select qid, pid, count(*) as c, min(rank) - 1 as best from h group by 1, 2), po as (select qid, count(*) as n, avg(c) as mean_channel_count, min(best) as best_channel_rank from pe group by 1),
by_ch as (select qid, count(*) as channel_count, sum(m * (m - 1) / 2.0) as shared from (select qid, channel, count(*) as m from h group by 1, 2) group by 1), be as (select qid, max(score) as top, min(score) as at20 from pool where rank <= 20 group by 1),
qs as (select qid, kind, query, spans, list_filter(regexp_split_to_array(lower(trim(query)), '\\s+'), lambda w: w <> '') as ws from plan)"""
CUE_SQL = ", ".join(f"list_has_any(ws, {list(ws)})::int::double as {k}" for k, ws in control.CUES.items())


@query(f"""with {POOL_SQL}, {GROUPS_SQL}, {STATE_SQL}, gc as (select qid, count(*) as cons from groups group by 1) select qs.qid, round(ln(1 + n), 6) as log_candidate_count, round(ln(1 + length(trim(query))), 6) as log_query_chars, round(ln(1 + len(ws)), 6) as log_query_words, {CUE_SQL}, channel_count::double as channel_count,
round(mean_channel_count, 6) as mean_channel_count, round(shared / (n * (n - 1) / 2.0), 6) as channel_pair_overlap, best_channel_rank::double as best_channel_rank, round(top, 6) as top_l1, round(at20, 6) as l1_at_20, round(top - at20, 6) as l1_decay_20, len(spans)::double as quoted_span_count, cons::double as constraint_count,
{", ".join(f"(kind = '{k}')::int::double as query_type_{k}" for k in control.KINDS)} from qs join po using (qid) join by_ch using (qid) join be using (qid) join gc using (qid)""")
def state_features(spark, d):
    s = control.state_features(_plans(spark, d), _hits(spark, d), _pool(spark, d).select("qid", "pid", "score"))
    return _rounded(s, *(c for c in s.columns if c != "qid"))


TOOLS_SQL = f"""ob as (select plan.qid, kind, n as pool, lc, coalesce(lh / (n * lc)::double, 0.0) as overlap, top from plan join (select qid, count(distinct pid) as n from h group by 1) using (qid) left join (select qid, count(distinct channel) as lc, count(*) as lh from h where starts_with(channel, 'lexical:') group by 1) using (qid)
  join (select qid, max(score) as top from pool group by 1) using (qid)), sd as (select distinct qid from harness_queries where len(gold) > 0)"""


@query(EST_SQL.replace("with hits", "with hits", 1) + f""", {PLAN_SQL}, {POOL_SQL.split("h as (select qid, pid, channel, min(rank) as rank from hits group by 1, 2, 3),", 1)[1]}, {TOOLS_SQL}, x as (select ob.*, d / greatest(n_hat, 1e-9) as coverage from ob join est using (qid))
select qid, 'dense' as tool, case when kind in ('survey', 'method_cross', 'benchmark', 'lineage') or pool < 260 or overlap < 0.36 or top < 0.42 then 'dense' else 'skip' end as action from x
union all select qid, 'citation', case when kind = 'locate' then 'skip' else 'citation' end from x join sd using (qid) union all select qid, 'admission', case when overlap < 0.72 or pool > 440 then 'keep 440' else 'keep 220' end from x
union all select qid, 'followup', case when coverage < 0.72 then 'rewrite' else 'stop' end from x""")
def tool_decisions(spark, d):
    state = control.observed(_plans(spark, d), _hits(spark, d), _pool(spark, d).select("qid", "pid", "score"))
    seeds = _gold(spark, d).groupBy("qid").agg(F.count("*").alias("n"))
    cover = _estimate(spark, d).select("qid", (F.col("d") / F.greatest("n_hat", F.lit(1e-9))).alias("coverage"))
    return control.decisions(state, seeds, cover).select("qid", "tool", "action")


@query(f"""with {PLAN_SQL}, w as (select qid, spans, list_filter(regexp_split_to_array(query, '\\s+'), lambda x: length(x) > 2 and regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) as ws from plan),
m as (select qid, list_filter(list_concat(spans[1:1], [array_to_string(ws[1:8], ' ')], case when len(ws) > 5 then [array_to_string(ws[3:10], ' ')] else [] end), lambda s: s <> '') as m from w)
select qid, array_to_string((list_filter(m, lambda x, i: not list_contains(m[1:i-1], x)))[1:2], '|') as strings from m""")
def query_rewrites(spark, d):
    p = _plans(spark, d)
    return p.select("qid", F.array_join(F.slice(control.rewrites(F.col("spans"), F.col("query"), F.array().cast("array<string>")), 1, 2), "|").alias("strings"))


DENSE_SQL = "dn as (select qid, pid, min(case when starts_with(channel, 'dense:') then rank end) as rank from h group by 1, 2 having min(case when starts_with(channel, 'dense:') then rank end) is not null and not bool_or(starts_with(channel, 'lexical:')))"


@query(f"with {H}, {DENSE_SQL} select qid, pid, rank from dn")
def dense_only(spark, d):
    return control.dense_only(_hits(spark, d))


@query(f"""with {POOL_SQL}, {DENSE_SQL}, e as (select * from (select *, row_number() over (partition by qid order by rank, pid) as n from dn) where n <= 50)
select qid, pid, round(score, 6) as score, place from (select e.qid, e.pid, pool.score, row_number() over (partition by e.qid order by round(pool.score, 9) desc, e.pid) as place from e join pool on pool.qid = e.qid and pool.pid = e.pid) where place <= 10""")
def dense_admission(spark, d):
    return _rounded(control.dense_admission(_hits(spark, d), _pool(spark, d).select("qid", "pid", "score"), 50, 10), "score")


@query(f"with {POOL_SQL} select qid, pid, round(score, 6) as score from pool join harness_queries using (qid)")
def precomputed_scores(spark, d):
    q, pool = table(spark, d, "harness_queries").select("qid", "query"), _pool(spark, d)
    artefact = pool.join(q, "qid").select(F.sha2("query", 256).alias("query_sha256"), "pid", "score").groupBy("query_sha256", "pid").agg(F.max("score").alias("score"))
    return _rounded(control.precomputed(pool.select("qid", "pid").join(q, "qid"), artefact), "score")


VOI_SQL = P_SQL + """, ph as (select distinct qid, pid from h where starts_with(channel, 'cite_bwd')), vi as (select c.qid, c.pid, p, abs(p - threshold) as dd, ph.pid is not null as referenced, n from c join g on g.qid = c.qid left join ph on ph.qid = c.qid and ph.pid = c.pid),
vz as (select *, dd / 0.16 as z, 1 / (1 + 0.2316419 * dd / 0.16) as t from vi), vo as (select qid, pid, referenced, exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) * 2 * dd / (1 + n) as voi from vz)"""


def _judged(spark, d):
    c = _curve(spark, d)
    back = _hits(spark, d).where(F.col("channel").startswith("cite_bwd")).select("qid", "pid").distinct().withColumn("r", F.lit(True))
    x = c.join(gate.cutoff(c, 1.25).select("qid", "threshold"), "qid").join(back, ["qid", "pid"], "left")
    return x.select("qid", "pid", "p", F.lit(control.SIGMA[2]).alias("sigma"), "threshold", "n", F.lit(False).alias("judged"), F.coalesce("r", F.lit(False)).alias("referenced"))


@query(VOI_SQL + " select qid, pid, round(voi, 8) as voi from vo")
def value_of_information(spark, d):
    return gate.value_of_information(_judged(spark, d)).select("qid", "pid", F.round("voi", 8).alias("voi"))


@query(VOI_SQL + ", o as (select *, row_number() over (partition by qid order by referenced desc, round(voi, 12) desc, pid) as place from vo) select qid, pid, place, ((place - 1) // 6)::int as batch from o where place <= 12")
def judge_order(spark, d):
    return control.judge_order(_judged(spark, d), "reference_first").select("qid", "pid", "place", "batch")


@query(f"""with {POOL_SQL}, {C}, ck as (select qid, pid, {ETOK.format("query")} as q, list_concat({TOK.format("title")}, {TOK.format("abstract")}) as doc from pool join harness_queries using (qid) join corpus using (pid)),
cs as (select qid, pid, (len(list_intersect(list_distinct(q[1:2]), doc)) >= 0.6 * len(list_distinct(q[1:2])))::int as a, (len(list_intersect(list_distinct(q[3:4]), doc)) >= 0.6 * len(list_distinct(q[3:4])))::int as b from ck where len(q) >= 4)
select qid, pid, round(0.8 * (1 - 0.35 * (2 - a - b) / 2.0), 6) as s_l3 from cs""")
def judge_verified(spark, d):
    q = table(spark, d, "harness_queries").select("qid", tx.words(F.col("query"), tx.STOP).alias("q")).where(F.size("q") >= 4)
    x = _pool(spark, d).select("qid", "pid").join(q, "qid").join(_corpus(spark, d).select("pid", "title", "abstract"), "pid")
    says = F.explode(F.array(F.array_join(F.slice("q", 1, 2), " "), F.array_join(F.slice("q", 3, 2), " "))).alias("evidence")
    c = x.select("qid", "pid", "title", "abstract", says).select("qid", "pid", F.lit(0.8).alias("relevance"), F.lit("yes").alias("status"), ranks.evidence_holds(F.col("evidence"), F.col("title"), F.col("abstract")).alias("holds"))
    return _rounded(control.verified(c).select("qid", "pid", "s_l3"), "s_l3")


@query(P_SQL + """, al as (select distinct qid, pid from h), k80 as (select qid, pid from pool where rank <= 80), se as (select c.qid, pid from c join g on g.qid = c.qid where c.k <= g.k)
select qid, pid, case when (qid, pid) not in (select (qid, pid) from pool) then 'l1_admission' when (qid, pid) not in (select (qid, pid) from k80) then 'l2_keep' when (qid, pid) not in (select (qid, pid) from se) then 'f1_gate' end as drop_reason from al""")
def candidate_audit(spark, d):
    pool, c = _pool(spark, d), _curve(spark, d)
    kept = c.join(gate.cutoff(c, 1.25).select("qid", F.col("k").alias("k_star")), "qid").where("k <= k_star")
    return control.audit(_hits(spark, d), {"l1_admission": pool, "l2_keep": pool.where("rank <= 80"), "f1_gate": kept})


@query(f"with {POOL_SQL}, r as (select qid, count(*) filter (where rank % 4 = 0) as p0, count(*) filter (where rank % 4 = 1) as p1, count(*) filter (where rank % 4 = 2) as p2, count(*) filter (where rank % 4 = 3) as p3 from pool group by 1) select qid, case when p2 >= greatest(p0, p1, p3) then 'P2' when p3 >= greatest(p0, p1) then 'P3' when p1 >= p0 then 'P1' else 'P0' end as profile from r")
def profile_choice(spark, d):
    r = _pool(spark, d).groupBy("qid", F.concat(F.lit("P"), (F.col("rank") % 4).cast("string")).alias("profile")).agg(F.count("*").alias("reward"))
    return control.best_profile(r)


@query(f"with {POOL_SQL} select qid, max((score >= 0.06)::int) as expand, sum((score >= 0.06)::int)::bigint as eligible from pool where rank <= 6 group by 1")
def crawl_gate(spark, d):
    return control.crawl(_pool(spark, d).where("rank <= 6").select("qid", "pid", F.col("score").alias("p")), 0.06)


# --- graph ----------------------------------------------------------------------------------


@query(f"with {POOL_SQL} select qid, pid, round(score, 6) as score from (select *, row_number() over (partition by qid order by round(score, 9) desc, pid) as n from pool where score >= 0.03) where n <= 6")
def seed_choice(spark, d):
    return _rounded(graph.pick_seeds(_pool(spark, d), "score", 6, 0.03), "score")


@query(f"with {C} select pid, case when source in ('openalex', 's2', 'pubmed') then source when split_part(pid, ':', 1) in ('openalex', 's2', 'pubmed') then split_part(pid, ':', 1) else 'openalex' end as asked from corpus")
def seed_routing(spark, d):
    return _corpus(spark, d).select("pid", graph.owner(F.col("pid"), F.col("source"), ["openalex", "s2", "pubmed"]).alias("asked"))


@query(f"""with {E}, {COCITE_CTES}, known as (select distinct qid, pid from candidates) select qid, pid, round(score, 6) as score, rank from (select qid, pid, score, row_number() over (partition by qid order by round(score, 9) desc, pid) as rank from coc where (qid, pid) not in (select (qid, pid) from known where pid is not null and qid is not null)) where rank <= 40""")
def expansion_targets(spark, d):
    prior = graph.cocitation(graph.edges(table(spark, d, "papers")), _gold(spark, d))
    return _rounded(graph.expansion_targets(prior, table(spark, d, "candidates").select("qid", "pid").distinct()), "score")


@query(f"""with {C}, {GROUPS_SQL}, {E}, {COCITE_CTES}, {POOL_SQL}, pl as (select p.qid, p.pid from pool p join corpus using (pid)), gt as (select qid, gid, weight, list_distinct({TOK.format("text")}) as toks from groups where role <> 'negative'), tot as (select qid, sum(weight) as total from gt group by 1),
dt as (select pid, list_concat({TOK.format("title")}, {TOK.format("abstract")}, {TOK.format("venue")}, {TOK.format("array_to_string(fields, ' ')")}) as doc from corpus),
cm as (select pl.qid, pl.pid, sum(weight * len(list_intersect(toks, doc)) / len(toks)::double) / max(total) as sc from pl join gt using (qid) join dt using (pid) join tot using (qid) where len(toks) > 0 group by 1, 2)
select cm.qid, cm.pid, round(case when sc >= 0.2 then coalesce(coc.score, 0.0) else 0.0 end, 6) as s_graph from cm left join coc on coc.qid = cm.qid and coc.pid = cm.pid""")
def graph_signal(spark, d):
    docs = _corpus(spark, d)
    pool = _pool(spark, d).select("qid", "pid").join(docs.select("pid"), "pid", "left_semi")
    m = constraints.match(pool, docs, _plans(spark, d)).select("qid", "pid", F.col("score").alias("s_constraint"))
    return _rounded(graph.graph_signal(graph.cocitation(graph.edges(table(spark, d, "papers")), _gold(spark, d)), m, 0.2), "s_graph")


@query(f"""with {C}, t as (select distinct unnest(gold) as pid from harness_queries), r as (select rec_id, pid as citing, len(reference_ids) as n, unnest(list_distinct(reference_ids)) as dst from corpus)
select pid, citing, context, rank from (select t.pid, citing, 'cited alongside ' || n || ' refs' as context, row_number() over (partition by t.pid order by rec_id) as rank from t join r on r.dst = t.pid where citing <> t.pid) where rank <= 100""")
def citation_contexts(spark, d):
    return graph.contexts(_corpus(spark, d), _gold(spark, d)).select("pid", "citing", "context", "rank")


@query("with " + IDENT_SQL + ", first as (select ident, arg_min(pid, rec_id) as leader from k where pid is not null group by 1), al as (select k.pid, min(leader) as leader from k join first using (ident) where k.pid is not null group by 1), " + H + """
select qid, coalesce(leader, h.pid) as pid, channel, min(rank) as rank from h left join al on al.pid = h.pid group by 1, 2, 3""")
def alias_renames(spark, d):
    k = entities.keyed(table(spark, d, "papers")).where("pid is not null")
    first = k.groupBy("ident").agg(F.min_by("pid", "rec_id").alias("leader"))
    return entities.renamed(_hits(spark, d), k.select("pid", "ident").join(first, "ident").groupBy("pid").agg(F.min("leader").alias("leader")))


# --- sections -------------------------------------------------------------------------------

SECTION_SQL = f"""{C}, sd0 as (select pid, doc_id, string_split(text, chr(10))[1] as heading from documents where kind = 'section' and pid is not null and text is not null), sd as (select pid, trim(heading) as heading, row_number() over (partition by pid order by doc_id) - 1 as at, count(*) over (partition by pid) as n from sd0 where trim(heading) <> ''),
rf as (select pid, i - 1 as pos, reference_ids[i] as ref from (select pid, reference_ids, unnest(range(1, len(reference_ids) + 1)) as i from corpus)),
sec as (select sd.pid, heading, pos, c2.title as cited_title from sd join rf on rf.pid = sd.pid and rf.pos % sd.n = sd.at join corpus c2 on c2.pid = rf.ref),
hd as (select distinct pid, heading from sec), sp as (select distinct c.qid, c.pid from candidates c join hd using (pid)),
hs as (select qid, pid, heading, query, list_filter({_terms_sql("lower(heading)", 30)}, lambda x: true) as ht, {_terms_sql("query", 30)} as q from sp join harness_queries using (qid) join hd using (pid)),
rs as (select *, 2.0 * len(list_intersect(ht, q)) / greatest(len(ht), 1) + greatest({", ".join(f"case when contains(lower(heading), '{k}') then {v} else 0.0 end" for k, v in sections.HEADINGS.items())}) as score from hs),
rk as (select *, row_number() over (partition by qid, pid order by round(score, 9) desc, heading) as place from rs)"""


def _sections(spark, d):
    """The stand-in for a section archive: headings are the first lines of a paper's section documents, and its references fall to them in turn."""
    from pyspark.sql import Window

    docs, corpus = table(spark, d, "documents"), _corpus(spark, d)
    s = docs.where("kind = 'section' and pid is not null and text is not null").select("pid", "doc_id", F.trim(F.split("text", "\n")[0]).alias("heading")).where("heading <> ''")
    w = Window.partitionBy("pid")
    s = s.select("pid", "heading", (F.row_number().over(w.orderBy("doc_id")) - 1).alias("at"), F.count("*").over(w).alias("n"))
    r = corpus.select("pid", F.posexplode("reference_ids").alias("pos", "ref"))
    x = s.join(r, "pid").where(F.col("pos") % F.col("n") == F.col("at"))
    return x.join(corpus.select(F.col("pid").alias("ref"), F.col("title").alias("cited_title")), "ref").select("pid", "heading", "pos", "cited_title")


def _ranked_sections(spark, d):
    s = _sections(spark, d)
    return sections.rank_sections(s, table(spark, d, "harness_queries"), table(spark, d, "candidates").select("qid", "pid").distinct())


@query(f"with {SECTION_SQL} select qid, pid, heading, round(score, 6) as score, place from rk")
def section_rank(spark, d):
    return _rounded(_ranked_sections(spark, d), "score")


@query(f"with {SECTION_SQL}, f as (select *, max(case when place = 1 then score end) over (partition by qid, pid) as first from rk where place <= 2) select qid, pid, heading, place from f where place <> 2 or abs(first - score) < 0.1 or score > 2.0")
def section_choice(spark, d):
    return sections.choose(_ranked_sections(spark, d), 2, 0.1).select("qid", "pid", "heading", "place")


@query(f"""with {SECTION_SQL}, tk as (select pid as cited, regexp_replace(lower(title), '[^\\p{{L}}]', '', 'g') as key from corpus), x as (select rk.qid, rk.pid, cited, min((place, pos)) as first, count(distinct rk.heading) as headings from rk join sec on sec.pid = rk.pid and sec.heading = rk.heading
join tk on key = regexp_replace(lower(cited_title), '[^\\p{{L}}]', '', 'g') and key <> '' where place <= 2 and cited <> rk.pid group by 1, 2, 3)
select qid, pid, cited, headings, rank from (select *, row_number() over (partition by qid, pid order by first, cited) as rank from x) where rank <= 60""")
def section_references(spark, d):
    r = sections.section_references(sections.choose(_ranked_sections(spark, d)), _sections(spark, d), _corpus(spark, d))
    return r.select("qid", "pid", "cited", F.size("headings").cast("bigint").alias("headings"), "rank")


SEC_STOP = ",".join(f"'{w}'" for w in sections.SECTION_STOP)


def _sec_tokens(c):
    return f"list_distinct(list_filter(list_transform(regexp_extract_all(coalesce({c}, ''), '[A-Za-z][A-Za-z0-9_-]+'), lambda t: lower(t)), lambda t: t not in ({SEC_STOP})))"


@query(f"""with {SECTION_SQL}, f as (select qid, pid, heading, place, {_sec_tokens("query")} as q, {_sec_tokens("heading")} as h, count(*) over (partition by qid, pid) as n from rk)
select qid, pid, heading, round(len(list_intersect(q, h)) / greatest(len(h), 1)::double, 6) as precision, round(len(list_intersect(q, h)) / greatest(len(q), 1)::double, 6) as coverage, round(least(1.0, len(list_intersect(q, h)) / 4.0), 6)::double as overlap, round(least(1.0, len(h) / 18.0), 6)::double as length,
round(least(1, place - 1) / greatest(1.0, n - 1.0), 6)::double as relative_position, ({" + ".join("(" + " or ".join(f"contains(lower(heading), '{p}')" for p in parts) + ")::int" for parts in sections.TYPES.values())})::double as types from f""")
def section_features(spark, d):
    from pyspark.sql import Window

    x = _ranked_sections(spark, d).join(table(spark, d, "harness_queries").select("qid", "query"), "qid").withColumn("n", F.count("*").over(Window.partitionBy("qid", "pid")))
    f = sections.section_features(F.col("query"), F.col("heading"), F.col("place") - 1, F.col("n"))
    kinds = [c for k, c in f.items() if k.startswith("type_")]
    y = x.select("qid", "pid", "heading", *(c.alias(k) for k, c in f.items() if not k.startswith("type_")), sum(kinds[1:], kinds[0]).alias("types"))
    return _rounded(y, "precision", "coverage", "overlap", "length", "relative_position")


@query(f"""with {SECTION_SQL}, sm as (select sp.qid, sec.pid, heading, len(list_intersect(list_distinct({TOK.format("query")}), {TOK.format("cited_title")})) / greatest(len(list_distinct({TOK.format("query")})), 1)::double as sim from sp join sec using (pid) join harness_queries using (qid)),
tp as (select * from (select *, row_number() over (partition by qid, pid, heading order by sim desc) as n from sm) where n <= 8) select qid, pid, heading, round(0.65 * max(sim) + 0.35 * avg(sim), 6) as score from tp group by 1, 2, 3""")
def cited_title_scores(spark, d):
    s, q = _sections(spark, d), table(spark, d, "harness_queries").select("qid", F.array_distinct(tx.tokenize(F.col("query"))).alias("q"))
    x = table(spark, d, "candidates").select("qid", "pid").distinct().join(s, "pid").join(q, "qid")
    sim = F.size(F.array_intersect("q", tx.tokenize(F.col("cited_title")))) / F.greatest(F.size("q"), F.lit(1))
    return _rounded(sections.cited_title_score(x.select("qid", "pid", "heading", sim.alias("sim"))), "score")


# --- gate, calibration, evaluation -----------------------------------------------------------


@query(P_SQL + """, l as (select qid, pid, max(coalesce(case when isnan(retrieval_score) then null else retrieval_score end, 0.0)) as s2 from candidates group by 1, 2), x as (select c.qid, c.pid, p, coalesce(s2, 0.0) as s2 from c left join l on l.qid = c.qid and l.pid = c.pid),
m as (select *, min(s2) over (partition by qid) as lo, max(s2) over (partition by qid) as hi from x), o as (select qid, pid, row_number() over (partition by qid order by round(case when hi - lo > 1e-12 then 0.5 * p + 0.5 * (s2 - lo) / (hi - lo) else p end, 9) desc, pid) as pos from m), v as (select qid, p, row_number() over (partition by qid order by round(p, 9) desc, pid) as pos from x)
select o.qid, o.pid, round(greatest(least(v.p, 0.9999), 0.0001), 6) as p from o join v on v.qid = o.qid and v.pos = o.pos""")
def final_rank_blend(spark, d):
    s = table(spark, d, "candidates").groupBy("qid", "pid").agg(F.max(F.coalesce(F.when(~F.isnan("retrieval_score"), F.col("retrieval_score")), F.lit(0.0))).alias("s_l2"))
    x = _curve(spark, d).select("qid", "pid", "p").join(s, ["qid", "pid"], "left").withColumn("s_l2", F.coalesce("s_l2", F.lit(0.0)))
    return _rounded(gate.rank_blend(x, 0.5), "p")


@query(P_SQL + " select c.qid, sum((p > threshold + 0.15)::int)::bigint as lo, sum((p >= threshold - 0.15)::int)::bigint as hi from c join g on g.qid = c.qid group by 1")
def gate_band(spark, d):
    c = _curve(spark, d)
    return gate.band(c, gate.cutoff(c, 1.25))


@query(P_SQL + " select qid, count(*) filter (where k <= 20) as top_20, count(*) filter (where p >= 0.5) as from_half from c group by 1")
def fixed_selectors(spark, d):
    c = _curve(spark, d)
    return gate.select_top(c, 20).groupBy("qid").agg(F.count("*").alias("top_20")).join(gate.select_threshold(c, 0.5).groupBy("qid").agg(F.count("*").alias("from_half")), "qid", "left").na.fill(0, ["from_half"])


@query(P_SQL + f""", {C}, {PLAN_SQL}, pr as (select pid, least(greatest((0.35 + 0.65 * (0.65 * cc / (1.5 + cc) + 0.35 * least(age / 3.0, 1.0))) * case when rv then 0.9 else 1.0 end, 0.35), 1.0) as prop from
(select pid, ln(1.0 + greatest(coalesce(citation_count, 0), 0)) as cc, greatest(0, 2026 - coalesce(year, 2026)) as age, contains(lower(coalesce(doc_type, '')), 'review') or contains(lower(coalesce(doc_type, '')), 'survey') or starts_with(lower(coalesce(title, '')), 'a survey') or contains(lower(coalesce(title, '')), ': a survey') or contains(lower(coalesce(title, '')), 'a review of') as rv from corpus))
select c.qid, c.pid, round(p * case when kind = 'locate' then 0.5 + 0.5 * prop else prop end, 6) as p_gold from c join pr using (pid) join plan on plan.qid = c.qid""")
def gold_probability(spark, d):
    k = _corpus(spark, d).select("pid", calibrate.propensity(F.col("citation_count"), F.col("year"), tx.is_review(F.col("doc_type"), F.col("title"))).alias("prop"))
    x = _curve(spark, d).select("qid", "pid", "p").join(k, "pid").join(_plans(spark, d).select("qid", "kind"), "qid")
    return _rounded(x.select("qid", "pid", calibrate.p_gold(F.col("p"), F.col("prop"), F.col("kind")).alias("p_gold")), "p_gold")


MODEL = {"features": calibrate.FEATURES, "coef": [0.4, 0.1, 0.3, 0.5, 0.6, 0.2, 0.3, 0.25, -0.1], "intercept": -1.0, "mean": [0.05, 0.1, 0.2, 3.0, 0.3, 0.3, 0.3, 0.2, 0.5], "scale": [0.02, 0.2, 0.2, 2.0, 0.3, 0.3, 0.2, 0.2, 0.3], "blend": 0.65}
Z_SQL = " + ".join(f"{c} * ({n} - {m}) / {s}" for n, c, m, s in zip(["rrf", "0.0", "0.0", "s_l1", "s_l2", "s_l2", "least(n, 8) / 8.0", "ln(1.0 + greatest(coalesce(cc, 0), 0)) / 10", "greatest(0.0, least(1.0, 1 - (2026 - coalesce(year, 2026)) / 15.0))"], MODEL["coef"], MODEL["mean"], MODEL["scale"], strict=True))


@query(LEVELS_SQL + f""", {C}, ch as (select qid, pid, count(distinct channel) as n from h group by 1, 2), x as (select lv.qid, lv.pid, rrf, s_l1, s_l2, n, k.citation_count as cc, year from lv join ch on ch.qid = lv.qid and ch.pid = lv.pid join corpus k on k.pid = lv.pid)
select qid, pid, round(greatest(least(0.65 / (1 + exp(-greatest(least(-1.0 + {Z_SQL}, 40.0), -40.0))) + 0.35 * 0.3, 0.9999), 0.0001), 6) as p from x""")
def supervised_score(spark, d):
    x = _levels(spark, d).join(ranks.channel_signals(_hits(spark, d)).select("qid", "pid", "channels"), ["qid", "pid"]).join(_corpus(spark, d).select("pid", "citation_count", "year"), "pid")
    x = x.withColumns({"s_rrf": F.col("rrf"), "s_graph": F.lit(0.0), "s_constraint": F.lit(0.0), "s_l3": F.lit(None).cast("double")})
    return _rounded(x.select("qid", "pid", calibrate.supervised(calibrate.feature_row(), MODEL, F.lit(0.3)).alias("p")), "p")


@query(PRF_SQL + """, e as (select f.*, (case when n_pred <= 16 then 1.0 else greatest(0, 1 - ln(n_pred / 16.0) / ln(6)) end + case when n_pred * 5000 <= 60000 then 1.0 else greatest(0, 1 - ln(n_pred * 5000 / 60000.0) / ln(6)) end + case when n_gold * 9 <= 45 then 1.0 else greatest(0, 1 - ln(n_gold * 9 / 45.0) / ln(6)) end) / 3 as eff from f)
select qid, round(eff, 6)::double as efficiency, round(0.7 * f1 + 0.2 * eff + 0.1 * 0.55, 6) as score from e""")
def composite_score(spark, d):
    x = _prf(spark, d).withColumns({"llm_calls": F.col("n_pred"), "tokens": F.col("n_pred") * 5000, "wall_seconds": F.col("n_gold") * 9})
    seen = F.struct(F.lit(3).alias("rows"), F.lit(2).alias("columns"), F.lit(0).alias("evidence"), F.lit(2).alias("nodes"), F.lit(1).alias("edges"), F.lit(False).alias("intent_view"), F.lit(0).alias("themes"))
    structure = views.structure_score(seen) + 0.05
    return _rounded(x.select("qid", evaluate.efficiency_score().alias("efficiency"), evaluate.composite(F.col("f1"), evaluate.efficiency_score(), structure).alias("score")), "efficiency", "score")


@query(P_SQL + f""", {GOLD_SQL}, gn as (select qid, count(*) as g from gold group by 1), ok as (select * from gn where qid <> 'hq-000'), x as (select ok.qid, g, k, (gold.pid is not null)::int as hit from ok left join c on c.qid = ok.qid left join gold on gold.qid = c.qid and gold.pid = c.pid),
pk as (select qid, max(g) as g, count(*) filter (where k <= 5) as n, coalesce(sum(hit) filter (where k <= 5), 0) as h from x group by 1), m as (select *, case when n > 0 then h / n::double else 0.0 end as pr, h / greatest(g, 1)::double as re from pk)
select count(*) as successful, round(avg(pr), 6) as precision_at_5, round(avg(re), 6) as recall_at_5, round(avg(case when pr + re > 0 then 2 * pr * re / (pr + re) else 0.0 end), 6) as f1_at_5, (select count(*) from gn where qid = 'hq-000') as failed from m""")
def public_macro(spark, d):
    g = _gold(spark, d)
    n = g.groupBy("qid").agg(F.count("*").alias("gold"))
    x = n.join(_curve(spark, d).select("qid", "pid", F.col("k").alias("rank")), "qid", "left").join(g.withColumn("hit", F.lit(1)), ["qid", "pid"], "left")
    rows = x.select(F.col("qid").alias("case"), F.when(F.col("qid") == "hq-000", "failed").alias("error"), "rank", F.coalesce("hit", F.lit(0)).alias("hit"), "gold")
    return _rounded(evaluate.public_macro(rows, (5,)), "precision_at_5", "recall_at_5", "f1_at_5")


# --- views and text ---------------------------------------------------------------------------


@query(f"with {C} select year, count(*) as papers from corpus where year is not null group by 1")
def year_histogram(spark, d):
    return views.year_histogram(_corpus(spark, d))


@query(f"with {H} select qid, split_part(channel, ':', 1) as family, count(*) as hits from h group by 1, 2")
def channel_counts(spark, d):
    return views.channel_counts(_hits(spark, d))


def _mention_sql(pattern):
    return f"array_to_string((list_sort(list_distinct(regexp_extract_all(coalesce(title, '') || chr(10) || coalesce(abstract, ''), '{pattern}'))))[1:5], '|')"


@query(f"with {C} select pid, {_mention_sql(tx.DATASETS)} as datasets, {_mention_sql(tx.METRICS)} as metrics, citation_count from corpus")
def comparison_table(spark, d):
    c = views.comparison(_corpus(spark, d))
    return c.select("pid", F.array_join("datasets", "|").alias("datasets"), F.array_join("metrics", "|").alias("metrics"), "citation_count")


@query(f"with {C} select metric as value, count(*) as n from (select pid, unnest((list_sort(list_distinct(regexp_extract_all(coalesce(title, '') || chr(10) || coalesce(abstract, ''), '{tx.METRICS}'))))[1:5]) as metric from corpus) group by 1 order by n desc, value limit 8")
def common_metrics(spark, d):
    return views.common(views.comparison(_corpus(spark, d)), "metrics")


@query(f"with {PLAN_SQL} select qid, case kind " + " ".join(f"when '{k}' then '{'|'.join(v)}'" for k, v in views.ROUTES.items()) + " end as views from plan")
def view_routes(spark, d):
    return views.routes(_plans(spark, d)).select("qid", F.array_join("views", "|").alias("views"))


@query(f"""with {C}, r as (select venue, year, citation_count, doc_type from corpus), c as (select count(distinct venue) as a, count(distinct year) as b, count(distinct citation_count) as c, count(distinct doc_type) as e from r)
select field, n_values from (select unnest(['venue', 'year', 'citation_count', 'doc_type']) as field, unnest([a, b, c, e]) as n_values from c) where n_values > 1""")
def disambiguation(spark, d):
    return views.disambiguation(_corpus(spark, d), ["venue", "year", "citation_count", "doc_type"])


@query(f"""with {C}, {POOL_SQL}, ck as (select pid, case when pid in (select pid from pool where rank <= 10) then 'yes' when pid in (select pid from pool where rank <= 40) then 'partial' end as a, case when year >= 2020 then 'yes' when year is not null then 'no' end as b from corpus)
select pid, coalesce(a, 'unrated') as topic, coalesce(b, 'unrated') as recent from ck where a is not null or b is not null""")
def constraint_matrix(spark, d):
    p = _pool(spark, d).groupBy("pid").agg(F.min("rank").alias("rank")).where("rank <= 40")
    c = _corpus(spark, d).select("pid", "year")
    checks = p.join(c.select("pid"), "pid").select("pid", F.lit("topic").alias("constraint"), F.when(F.col("rank") <= 10, "yes").otherwise("partial").alias("status"))
    checks = checks.unionByName(c.where("year is not null").select("pid", F.lit("recent").alias("constraint"), F.when(F.col("year") >= 2020, "yes").otherwise("no").alias("status")))
    return views.matrix(checks, ["topic", "recent"])


@query(f"""with {C}, ck as (select pid, case when year >= 2020 then 1.0 when year is not null then 0.0 else 0.3 end as a, case when coalesce(venue, '') <> '' then 0.5 else 0.3 end as b from corpus) select pid, round((a + b) / 2, 6)::double as satisfaction from ck""")
def constraint_satisfaction(spark, d):
    c = _corpus(spark, d)
    one = c.select("pid", F.when(F.col("year") >= 2020, "yes").when(F.col("year").isNotNull(), "no").otherwise("unknown").alias("status"))
    two = c.select("pid", F.when(F.coalesce("venue", F.lit("")) != "", "partial").otherwise("unknown").alias("status"))
    return _rounded(views.satisfaction(one.unionByName(two)), "satisfaction")


@query(f"with {C} select pid, length(coalesce(abstract, '')[1:400]) as abstract_length, len(authors[1:6]) as n_authors, case when length(title) <= 42 then title else title[1:41] || '…' end as label, length(title || chr(10) || coalesce(abstract, '')[1:900]) as pair_length from corpus")
def result_projection(spark, d):
    c = _corpus(spark, d)
    x = views.projection(c).select("pid", F.length("abstract").alias("abstract_length"), F.when(F.col("authors").isNotNull(), F.size("authors")).alias("n_authors"), tx.short_title(F.col("title")).alias("label"))
    return x.join(c.select("pid", F.length(tx.pair_text(F.col("title"), F.col("abstract"))).alias("pair_length")), "pid")


@query("select doc_id, regexp_matches(coalesce(text, ''), '[一-鿿]') as cjk, case when coalesce(text, '') = '' then 0 else floor(length(regexp_replace(text, '[^一-鿿]', '', 'g')) / 1.5 + (length(text) - length(regexp_replace(text, '[^一-鿿]', '', 'g'))) / 4.0)::int + 1 end as tokens from documents")
def text_profile(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", tx.has_cjk(F.coalesce(t, F.lit(""))).alias("cjk"), tx.approx_tokens(t).alias("tokens"))


@query(f"""with {C}, t as (select pid, {TOK.format("title")} as a, {TOK.format("abstract")} as b from corpus), n as (select pid, w, list_count(list_filter(a, lambda x: x = w)) as na, list_count(list_filter(b, lambda x: x = w)) as nb from (select pid, a, b, unnest(list_distinct(list_concat(a, b))) as w from t)),
s as (select pid, sum(na * nb) as dot, sqrt(sum(na * na)) as la, sqrt(sum(nb * nb)) as lb from n group by 1) select t.pid, round(case when len(a) > 0 and len(b) > 0 then dot / (la * lb) else 0.0 end, 6) as cosine, ceil(len(b) / 50.0)::int as chunks from t left join s using (pid)""")
def counter_cosine(spark, d):
    a, b = tx.tokenize(F.col("title")), tx.tokenize(F.col("abstract"))
    return _rounded(_corpus(spark, d).select("pid", a.alias("a"), b.alias("b")).select("pid", tx.counter_cosine(F.col("a"), F.col("b")).alias("cosine"), F.size(tx.chunked(F.col("b"), 50)).alias("chunks")), "cosine")


@query("with r as (select case_id, unnest(gold_arxiv_ids) as raw from public_cases) select case_id, raw, lower(regexp_replace(regexp_replace(regexp_replace(trim(raw), '^arxiv:\\s*', '', 'i'), '^.*/', ''), 'v\\d+$', '', 'i')) as key from r where raw is not null")
def arxiv_keys(spark, d):
    return table(spark, d, "public_cases").select("case_id", F.explode("gold_arxiv_ids").alias("raw")).where("raw is not null").select("case_id", "raw", ids.arxiv_key(F.col("raw")).alias("key"))
