"""Queries of the core: name -> f(spark, sf_dir), and the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F  # noqa: F401

from .runtime import table

QUERIES = {}
ORACLE = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


KEY_SQL = r"lower(regexp_replace(regexp_replace(regexp_replace(trim({0}), '^arxiv:\s*', '', 'i'), '^.*/', ''), 'v\d+$', '', 'i'))"
ORPHAN_SQL = f"""
with refs as (
  select 'papers' as src_table, rec_id as src_id, r as ref_pid, fetched_at as t
  from (select rec_id, fetched_at, unnest(list_distinct(reference_ids)) as r from papers)
  union all select 'candidates', cand_id, pid, retrieved_at from candidates),
life as (
  select s.k, s.first_seen, w.gone from
  (select {KEY_SQL.format("pid")} as k, min(fetched_at) as first_seen from papers group by 1) s
  left join (select {KEY_SQL.format("pid")} as k, min(withdrawn_at) as gone from withdrawn group by 1) w on s.k = w.k),
orphans as (
  select src_table, src_id, ref_pid, strftime(t, '%Y-%m') as month
  from (select *, {KEY_SQL.format("ref_pid")} as rk from refs where trim(ref_pid) <> '') r left join life on rk = k
  where first_seen is null or t < first_seen or t >= gone)
"""


def _orphans(spark, d):
    from .operators import orphans as m

    return m.literature_orphans(table(spark, d, "papers"), table(spark, d, "candidates"), table(spark, d, "withdrawn"))


@query(ORPHAN_SQL + "select src_table, src_id, ref_pid from orphans")
def p2_found(spark, d):
    return _orphans(spark, d).select("src_table", "src_id", "ref_pid")


@query(ORPHAN_SQL + "select src_table, month, count(*) as orphans, count(distinct src_id) as rows_with_orphans from orphans group by 1, 2")
def p2_orphans_by_month(spark, d):
    from .operators.orphans import orphans_by_month

    return orphans_by_month(_orphans(spark, d))


@query(ORPHAN_SQL + "select src_table, month, count(*) as orphans from orphans group by 1, 2")
def p2_orphan_counts(spark, d):
    from .operators.orphans import literature_orphan_counts

    return literature_orphan_counts(table(spark, d, "papers"), table(spark, d, "candidates"), table(spark, d, "withdrawn"))


# --- The reference's operators -------------------------------------------------------------

from .functions import text as tx  # noqa: E402
from .operators import calibrate, constraints, coverage, entities, evaluate, gate, graph, lexical, ranks, views  # noqa: E402

WEIGHTS = {"lexical": 1.0, "dense": 1.2, "cite_bwd": 0.9, "cite_fwd": 0.9, "cocite": 1.1}
C, H, E = lexical.CORPUS_SQL, ranks.HITS_SQL, graph.EDGES_SQL
TOK, ALLTOK = tx.TOKENS_SQL, tx.ALL_TOKENS_SQL
W_SQL = "case split_part(channel, ':', 1) " + " ".join(f"when '{k}' then {v}" for k, v in WEIGHTS.items()) + " else 1.0 end"


def _corpus(spark, d):
    return lexical.corpus(table(spark, d, "papers"))


def _hits(spark, d):
    return ranks.hits(table(spark, d, "candidates"))


def _gold(spark, d):
    return table(spark, d, "harness_queries").select("qid", F.explode("gold").alias("pid")).distinct()


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


#: The pool after the first-level cut, a feature of the engine: later stages see this many candidates a question.
KEEP = 220
POOL_SQL = f"""{H}, rw as (select qid, pid, sum({W_SQL} / (60 + rank)) as score from h group by 1, 2),
pool as (select * from (select *, row_number() over (partition by qid order by round(score, 9) desc, pid) as rank from rw) where rank <= {KEEP})"""


def _pool(spark, d):
    return ranks.top(ranks.rrf(_hits(spark, d), weights=WEIGHTS), KEEP)


@query(f"""with {C}, q as (select qid, unnest({TOK.format("query")}) as term from harness_queries), qt as (select qid, term, count(*) as qf from q group by 1, 2),
fields as (select pid, 3.0 as w, {TOK.format("title")} as t from corpus union all select pid, 1.0, {TOK.format("abstract")} from corpus),
dl as (select pid, sum(len(t) * w) as dl from fields group by 1), st as (select count(*) as n, avg(dl) as avgdl from dl),
tf as (select pid, term, sum(w) as tf from (select pid, w, unnest(t) as term from fields) group by 1, 2),
df as (select term, count(*) as df from tf where term in (select term from qt) group by 1),
s as (select qid, tf.pid, sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score
  from tf join df using (term) join qt using (term) join dl on dl.pid = tf.pid, st group by 1, 2)
select qid, pid, round(score, 6) as score, rank from (select *, row_number() over (partition by qid order by round(score, 9) desc, pid) as rank from s) where rank <= 20""")
def bm25_search(spark, d):
    r = lexical.bm25_search(_corpus(spark, d), "pid", {"title": 3.0, "abstract": 1.0}, table(spark, d, "harness_queries"), 20)
    return _rounded(r.select("qid", "pid", "score", "rank"), "score")


@query(f"with {H} select qid, pid, round(sum(1.0 / (60 + rank)), 6) as score from h group by 1, 2")
def rrf_fusion(spark, d):
    return _rounded(ranks.rrf(_hits(spark, d)), "score")


@query(f"""with {H}, s as (select qid, pid, sum({W_SQL} / (60 + rank)) as score from h group by 1, 2)
select qid, pid, round(score, 6) as score, rank from (select *, row_number() over (partition by qid order by round(score, 9) desc, pid) as rank from s) where rank <= 50""")
def rrf_weighted_top(spark, d):
    return _rounded(ranks.top(ranks.rrf(_hits(spark, d), weights=WEIGHTS), 50), "score")


@query("""with l as (select qid, ch as channel, cand_id % 3 as query_index, r as rank, pid from (select cand_id, qid, pid, unnest(map_keys(channel_ranks)) as ch, unnest(map_values(channel_ranks)) as r from candidates)),
f as (select qid, channel, pid, min((query_index, rank)) as f from l group by 1, 2, 3)
select qid, channel, pid, row_number() over (partition by qid, channel order by f, pid) as pos, f[2] as first_rank from (select qid, channel, pid, f from f)""")
def rank_list_assembly(spark, d):
    c = table(spark, d, "candidates")
    lists = c.select("qid", F.explode("channel_ranks").alias("channel", "rank"), (F.col("cand_id") % 3).alias("query_index"), "pid")
    return ranks.assemble(lists)


RTOK = tx.words_sql(tx.RERANK_STOP)


@query(f"""with {C}, {POOL_SQL}, t as (select p.qid, p.pid, list_distinct({RTOK.format("query")}) as q, {RTOK.format("title")} as tt, {RTOK.format("abstract")} as ta from pool p join corpus using (pid) join harness_queries using (qid)),
st as (select qid, count(*) as n, greatest(avg(len(ta) + 1), 1.0) as avgdl from t group by 1),
x as (select qid, pid, len(tt) + len(ta) as dl, len(q) as nq, unnest(q) as term, tt, ta from t),
hit as (select * from (select qid, pid, dl, nq, term, 2.2 * len(list_filter(tt, lambda w: w = term)) + len(list_filter(ta, lambda w: w = term)) as f from x) where f > 0),
df as (select qid, term, count(*) as df from hit group by 1, 2),
raw as (select qid, pid, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.3 + 0.7 * dl / avgdl))) * (0.35 + 0.65 * count(*) / max(nq)) as raw
  from hit join df using (qid, term) join st using (qid) group by 1, 2),
u as (select t.qid, t.pid, coalesce(raw, 0.0) as raw from t left join raw on t.qid = raw.qid and t.pid = raw.pid),
m as (select qid, pid, raw, min(raw) over (partition by qid) as lo, max(raw) over (partition by qid) as hi from u)
select qid, pid, round(case when hi > lo then (raw - lo) / (hi - lo) else raw end, 6) as score from m""")
def lexical_rerank(spark, d):
    return _rounded(lexical.lexical_rerank(_pool(spark, d), _corpus(spark, d).select("pid", "title", "abstract"), table(spark, d, "harness_queries")), "score")


@query(f"""with {C} select pid, year, venue from corpus where length(title) >= 8 and (year is null or year >= 2015) and (year is null or year <= 2023)
and (coalesce(venue, '') = '' or contains(upper(venue), 'RETRIEVAL') or contains(upper(venue), 'ARXIV'))
and not (contains(lower(coalesce(doc_type, '')), 'review') or contains(lower(coalesce(doc_type, '')), 'survey') or starts_with(lower(title), 'a survey') or contains(lower(title), ': a survey') or contains(lower(title), 'a review of'))""")
def l0_filter(spark, d):
    return ranks.l0_filter(_corpus(spark, d), 2015, 2023, ["Retrieval", "arXiv"], no_reviews=True).select("pid", "year", "venue")


def _sim_sql(a, b):
    big = lambda t: f"list_distinct(list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i+1]))"
    jac = lambda x, y: f"case when len({x}) > 0 and len({y}) > 0 then len(list_intersect({x}, {y})) / (len(list_distinct({x})) + len(list_distinct({y})) - len(list_intersect({x}, {y})))::double else 0.0 end"
    return f"(0.5 * ({jac(a, b)}) + 0.5 * ({jac(big(a), big(b))}))"


ETOK = tx.words_sql(tx.STOP)
PLAN_SQL = f"""plan0 as (select qid, query, {ETOK.format("query")} as eng, regexp_extract(query, '{tx.SINCE}', 1) as since, regexp_extract(query, '{tx.RECENT}', 1) as recent,
  list_min(list_transform(regexp_extract_all(query, '(?:19|20)[0-9]{{2}}'), lambda y: y::int)) as least,
  list_filter([{", ".join(f"case when regexp_matches(lower(query), '\\b{v.lower()}\\b') then '{v}' end" for v in tx.VENUES)}], lambda v: v is not null) as venues,
  {" or ".join(f"contains(lower(query), '{c}')" for c in tx.NO_REVIEW_CUES)} as no_reviews,
  case {" ".join("when " + " or ".join(f"contains(lower(query), '{c}')" for c in cues) + f" then '{k}'" for k, cues in tx.TYPE_CUES.items())} else 'method_cross' end as kind,
  {tx.SPANS_SQL.format("query")} as spans from harness_queries),
plan1 as (select *, case when since <> '' then since::int when recent <> '' then 2026 - recent::int else least end as year_min, list_transform(range(1, len(eng)), lambda i: eng[i] || ' ' || eng[i+1]) as pairs from plan0),
plan as (select *, case when len(pairs) > 1 then [pairs[1], pairs[len(pairs)]] when len(pairs) = 1 then pairs else eng[1:2] end as anchors from plan1)"""
KEY_OF = "list_sort(list_distinct(list_transform({0}, lambda t: case when length(t) > 4 and ends_with(t, 's') and regexp_matches(t, '^[a-z0-9]+$') then t[1:-2] else t end)))"
GROUPS_SQL = f"""{PLAN_SQL}, base as (select qid, 1 as ord, 'year' as kind, 'hard_filter' as role, '{constraints.YEAR_TEXT}' || year_min as text, 1.0 as weight from plan where year_min is not null
  union all select qid, 2, 'venue', 'hard_filter', '{constraints.VENUE_TEXT}' || array_to_string(venues, '/'), 1.0 from plan where len(venues) > 0
  union all select qid, 3, 'doc_type', 'negative', '{constraints.REVIEW_TEXT}', 1.0 from plan where no_reviews
  union all select qid, 10 + i, 'topic', 'anchor', anchors[i], 1.0 from (select qid, anchors, unnest(range(1, len(anchors) + 1)) as i from plan)),
words as (select qid, eng, i, eng[i] as t from (select qid, eng, unnest(range(1, least(len(eng), 10) + 1)) as i from plan)),
cons as (select * from base union all select qid, 100 + i, 'other', 'verify', t, 0.6 from words w where len(list_filter(eng[1:i-1], lambda e: contains(e, t))) = 0 and not exists (select 1 from base b where b.qid = w.qid and contains(b.text, t))),
keyed as (select *, {KEY_OF.format(TOK.format("text"))} as k from cons),
groups as (select qid, 'g' || row_number() over (partition by qid order by ord) as gid, kind, role, text, weight from (select qid, kind, role, k, min(ord) as ord, arg_min(text, ord) as text, max(weight) as weight from keyed group by 1, 2, 3, 4))"""


def _plans(spark, d):
    return constraints.plans(table(spark, d, "harness_queries"))


@query(f"with {PLAN_SQL} select qid, year_min, kind, array_to_string(venues, '|') as venues, no_reviews, array_to_string(spans, '|') as spans from plan")
def query_understanding(spark, d):
    p = constraints.parse_rules(table(spark, d, "harness_queries"))
    return p.select("qid", "year_min", "kind", F.array_join("venues", "|").alias("venues"), "no_reviews", F.array_join("spans", "|").alias("spans"))


@query(f"""with {PLAN_SQL}, s as (select qid, anchors, list_concat([array_to_string(eng[1:5], ' ')], anchors, case when len(eng) > 3 then [array_to_string(eng[3:7], ' ')] else [] end) as s from plan),
o as (select qid, anchors, list_filter(s, lambda x, i: not list_contains(s[1:i-1], x)) as s from s) select qid, array_to_string(anchors, '|') as anchors, array_to_string(s[1:6], '|') as search_strings from o""")
def query_plan(spark, d):
    p = constraints.parse_rules(table(spark, d, "harness_queries"))
    return p.select("qid", F.array_join("anchors", "|").alias("anchors"), F.array_join("search_strings", "|").alias("search_strings"))


@query(f"with {GROUPS_SQL} select qid, gid, role, kind, text, weight::double as weight from groups")
def constraint_groups(spark, d):
    g = _plans(spark, d).select("qid", F.explode("groups").alias("g"))
    return g.select("qid", "g.gid", "g.role", "g.kind", F.col("g.terms")[0].alias("text"), "g.weight")


MATCH_SQL = f"""cpool as (select distinct c.qid, c.pid from candidates c join corpus using (pid)),
gt as (select qid, gid, role, weight, list_distinct({TOK.format("text")}) as toks from groups), tot as (select qid, sum(weight) as total from gt where role <> 'negative' group by 1),
dt as (select pid, list_concat({TOK.format("title")}, {TOK.format("abstract")}, {TOK.format("venue")}, {TOK.format("array_to_string(fields, ' ')")}) as doc from corpus),
gs as (select p.qid, p.pid, role, weight, len(list_intersect(toks, doc)) / len(toks)::double as c from cpool p join gt using (qid) join dt using (pid) where len(toks) > 0),
cm as (select qid, pid, coalesce(sum(case when role <> 'negative' then weight * c end), 0) / max(total) as positive, least(coalesce(sum(case when role = 'negative' and c >= 0.8 then weight * c end), 0), 1.0) as penalty from gs join tot using (qid) group by 1, 2)"""


@query(f"with {C}, {GROUPS_SQL}, {MATCH_SQL} select qid, pid, round(positive, 6) as positive, round(penalty, 6)::double as penalty, round(positive * (1 - penalty), 6) as score from cm")
def constraint_match(spark, d):
    docs = _corpus(spark, d)
    pool = table(spark, d, "candidates").select("qid", "pid").distinct().join(docs.select("pid"), "pid", "left_semi")
    return _rounded(constraints.match(pool, docs, _plans(spark, d)), "positive", "penalty", "score")


@query(f"""with {C}, p as (select distinct c.qid, c.pid from candidates c), t as (select qid, pid, list_distinct({TOK.format("query")}) as e, list_concat({TOK.format("title")}, {TOK.format("abstract")}) as doc
from p join harness_queries using (qid) join corpus using (pid)) select qid, pid from t where len(e) > 0 and len(list_intersect(e, doc)) >= 0.6 * len(e)""")
def evidence_check(spark, d):
    x = table(spark, d, "candidates").select("qid", "pid").distinct().join(table(spark, d, "harness_queries").select("qid", "query"), "qid").join(_corpus(spark, d).select("pid", "title", "abstract"), "pid")
    return x.where(ranks.evidence_holds(F.col("query"), F.col("title"), F.col("abstract"))).select("qid", "pid")


COCITE_CTES = """seeds as (select distinct qid, unnest(gold) as seed from harness_queries), ind as (select dst, count(*) as d from edges group by 1),
cp as (select s.qid, s.seed, e2.dst as pid, count(*) as n from seeds s join edges e1 on e1.dst = s.seed join edges e2 on e2.src = e1.src where e2.dst <> s.seed group by 1, 2, 3),
cs as (select qid, pid, sum(n / sqrt(i1.d * i2.d)) as score from cp join ind i1 on i1.dst = seed join ind i2 on i2.dst = pid group by 1, 2),
coc as (select qid, pid, score / max(score) over (partition by qid) as score from cs)"""
L1_SQL = f"""with {C}, {H}, {E}, {COCITE_CTES}, {GROUPS_SQL}, {MATCH_SQL}, r as (select qid, pid, sum(1.0 / (60 + rank)) as rrf, min(rank) as best_rank, count(distinct split_part(channel, ':', 1)) as families from h group by 1, 2),
sp as (select qid, unnest(spans) as span from plan), st as (select r.qid, r.pid, {ALLTOK.format("span")} as a, {ALLTOK.format("title")} as b from r join sp using (qid) join corpus using (pid)),
ts as (select qid, pid, max({_sim_sql("a", "b")}) as s_title from st group by 1, 2),
t as (select r.*, list_distinct({TOK.format("query")}) as q, list_concat({TOK.format("title")}, {TOK.format("abstract")}) as doc from r join corpus using (pid) join harness_queries using (qid)),
sig as (select t.qid, t.pid, rrf, best_rank, families, len(list_intersect(q, doc)) / greatest(len(q), 1)::double as cover, coalesce(s_title, 0.0) as s_title, coalesce(coc.score, 0.0) as graph, positive * (1 - penalty) as s_constraint
  from t left join ts on ts.qid = t.qid and ts.pid = t.pid left join coc on coc.qid = t.qid and coc.pid = t.pid join cm on cm.qid = t.qid and cm.pid = t.pid),
l1 as (select qid, pid, 0.29 * (1 - exp(-40 * rrf)) + 0.19 * graph + 0.16 * cover + 0.12 * (1 - exp(-0.8 * families)) + 0.08 / (1 + 0.08 * (best_rank - 1)) + 0.11 * s_title + 0.05 * s_constraint as s_l1 from sig)"""


def _l1_signals(spark, d):
    h, docs, plans = _hits(spark, d), _corpus(spark, d), _plans(spark, d)
    x = ranks.rrf(h).withColumnRenamed("score", "rrf").join(docs.select("pid"), "pid", "left_semi")
    g = graph.cocitation(graph.edges(table(spark, d, "papers")), _gold(spark, d)).withColumnRenamed("score", "graph")
    x = x.join(ranks.channel_signals(h), ["qid", "pid"]).join(ranks.text_signals(x, docs, plans), ["qid", "pid"]).join(constraints.match(x, docs, plans).select("qid", "pid", F.col("score").alias("s_constraint")), ["qid", "pid"])
    return x.join(g, ["qid", "pid"], "left").withColumn("graph", F.coalesce("graph", F.lit(0.0)))


def _l1_rows(spark, d):
    return _l1_signals(spark, d).select("qid", "pid", ranks.l1_score().alias("s_l1"))


@query(L1_SQL + "select qid, pid, round(cover, 6) as cover, round(s_title, 6) as s_title, round(s_constraint, 6) as s_constraint, round(graph, 6) as graph from sig")
def l1_signals(spark, d):
    return _rounded(_l1_signals(spark, d).select("qid", "pid", "cover", "s_title", "s_constraint", "graph"), "cover", "s_title", "s_constraint", "graph")


@query(L1_SQL + "select qid, pid, round(s_l1, 6) as s_l1 from l1")
def l1_score(spark, d):
    return _rounded(_l1_rows(spark, d), "s_l1")


@query(L1_SQL + """, n as (select qid, pid, count(distinct channel) as n from h group by 1, 2), b as (select l1.*, n from l1 join n using (qid, pid)),
u as (select * from (select b.qid, b.pid, 1 as phase, row_number() over (partition by b.qid order by h.rank, round(s_l1, 9) desc, b.pid) as plc from b join h on h.qid = b.qid and h.pid = b.pid and h.channel = 'cocite' where n = 1) where plc <= 3),
c1 as (select * from (select b.qid, b.pid, 2 as phase, row_number() over (partition by b.qid order by round(s_l1, 9) desc, b.pid) as plc from b join h on h.qid = b.qid and h.pid = b.pid and h.channel = 'dense:views' where (b.qid, b.pid) not in (select (qid, pid) from u)) where plc <= 10),
tk as (select * from u union all select * from c1),
k as (select b.*, row_number() over (partition by b.qid order by coalesce(phase, 3), coalesce(plc, 0), round(s_l1, 9) desc, b.pid) as rn from b left join tk on tk.qid = b.qid and tk.pid = b.pid)
select qid, pid, round(s_l1, 6) as s_l1, row_number() over (partition by qid order by round(s_l1, 9) desc, pid) as rank from k where rn <= 12""")
def channel_quota(spark, d):
    return _rounded(ranks.quota_cut(_l1_rows(spark, d), _hits(spark, d), 12, {"dense:views": 10}, {"cocite": 3}), "s_l1")


@query(f"""with {H} select qid, pid, min(rank) as best_rank, count(distinct split_part(channel, ':', 1)) as families, count(distinct channel) as channels,
round(max(case when starts_with(channel, 'dense:') then 1.0 / rank else 0.0 end), 6) as s_dense, round(max(case when starts_with(channel, 'cite_') then 1.0 / rank else 0.0 end), 6) as s_reference from h group by 1, 2""")
def channel_signals(spark, d):
    return _rounded(ranks.channel_signals(_hits(spark, d)), "s_dense", "s_reference")


LEVELS_SQL = f"""with {POOL_SQL}, lv0 as (select qid, pid, max(case when isnan(retrieval_score) then null else retrieval_score end) as s2, max(citation_count) as c from candidates group by 1, 2),
lv as (select qid, pid, coalesce(s2, 0.0) as s_l2, ln(1.0 + greatest(coalesce(c, 0), 0)) as s_l1, pool.score as rrf from pool join lv0 using (qid, pid)),
mm as (select *, min(s_l1) over w as lo1, max(s_l1) over w as hi1, min(s_l2) over w as lo2, max(s_l2) over w as hi2 from lv window w as (partition by qid)),
un as (select qid, pid, case when hi2 - lo2 > 1e-12 then (s_l2 - lo2) / (hi2 - lo2) else 0.0 end as a, case when hi1 - lo1 > 1e-12 then (s_l1 - lo1) / (hi1 - lo1) else 0.0 end as b from mm)"""


def _levels(spark, d):
    c = table(spark, d, "candidates").groupBy("qid", "pid").agg(F.max(F.when(~F.isnan("retrieval_score"), F.col("retrieval_score"))).alias("s2"), F.max("citation_count").alias("c"))
    x = _pool(spark, d).select("qid", "pid", F.col("score").alias("rrf")).join(c, ["qid", "pid"])
    return x.select("qid", "pid", F.coalesce("s2", F.lit(0.0)).alias("s_l2"), F.log1p(F.greatest(F.coalesce("c", F.lit(0)), F.lit(0)).cast("double")).alias("s_l1"), "rrf")


def _ranked_sql(score):
    return f" select qid, pid, round(score, 6) as score, rank from (select *, row_number() over (partition by qid order by round(score, 9) desc, pid) as rank from (select qid, pid, {score} as score from un)) where rank <= 80"


@query(LEVELS_SQL + _ranked_sql("0.75 * a + 0.25 * b"))
def l2_blend(spark, d):
    return _rounded(ranks.l2_blend(_levels(spark, d), 80, 0.25).select("qid", "pid", "score", "rank"), "score")


@query(LEVELS_SQL + _ranked_sql("pow(greatest(a, 1e-12), 0.5) * pow(greatest(b, 1e-12), 0.5)"))
def l2_blend_geometric(spark, d):
    return _rounded(ranks.l2_blend(_levels(spark, d), 80, 0.5, "geometric").select("qid", "pid", "score", "rank"), "score")


@query(LEVELS_SQL + """, z as (select qid, pid, s_l1 / 20 as s1, case when s_l2 <> 0 then s_l2 end as s2, case when rrf > 0.05 then 10 * rrf end as s3 from lv)
select qid, pid, round(greatest(least(case when s3 is not null and s2 is not null then 0.62 * s3 + 0.23 * s2 + 0.15 * s1 when s3 is not null then 0.75 * s3 + 0.25 * s1 when s2 is not null then 0.7 * s2 + 0.3 * s1 else s1 end, 1.0), 0.0), 6) as score from z""")
def level_fusion(spark, d):
    x = _levels(spark, d).select("qid", "pid", (F.col("s_l1") / 20).alias("s1"), F.when(F.col("s_l2") != 0, F.col("s_l2")).alias("s2"), F.when(F.col("rrf") > 0.05, 10 * F.col("rrf")).alias("s3"))
    return _rounded(x.select("qid", "pid", ranks.level_fusion(F.col("s1"), F.col("s2"), F.col("s3"), F.lit(None).cast("double")).alias("score")), "score")


RANKS_SQL = LEVELS_SQL + """, rk as (select qid, pid, count(*) over (partition by qid) as n, rank() over (partition by qid order by s_l1) + (count(*) over (partition by qid, s_l1) - 1) / 2.0 as r1,
rank() over (partition by qid order by s_l2) + (count(*) over (partition by qid, s_l2) - 1) / 2.0 as r2, rank() over (partition by qid order by rrf) + (count(*) over (partition by qid, rrf) - 1) / 2.0 as r3 from lv)"""


@query(RANKS_SQL + " select qid, round(case when count(*) < 3 then 0.0 else coalesce(corr(r2, r1), 0.0) end, 6) as rho from rk group by 1")
def spearman(spark, d):
    return _rounded(ranks.spearman(_levels(spark, d), "s_l2", "s_l1"), "rho")


def _fused_sql(weights, terms):
    return weights + f""", f as (select qid, pid, {terms} as f from rk join w using (qid)), g as (select *, min(f) over (partition by qid) as lo, max(f) over (partition by qid) as hi from f)
select qid, pid, round(case when hi - lo > 1e-12 then (f - lo) / (hi - lo) else 0.5 end, 6) as fused from g"""


@query(_fused_sql(RANKS_SQL + """, c0 as (select qid, greatest(coalesce(corr(r1, r2), 0.0), 0.0) as r from rk group by 1), w as (select qid, greatest(0.16 * pow(r, 1.5), 0.02 * 0.16) as w1, greatest(0.20 * pow(r, 1.5), 0.02 * 0.20) as w2 from c0)""", "(w1 * r1 + w2 * r2) / (w1 + w2) / n"))
def consistency_fusion(spark, d):
    x = _levels(spark, d)
    return _rounded(ranks.fuse_signals(x.select("qid", "pid", F.col("s_l1").alias("l1"), F.col("s_l2").alias("l2")), ["l1", "l2"], "default"), "fused")


SPECTRAL_SQL = """, c0 as (select qid, corr(r1, r2) as a, corr(r1, r3) as b, corr(r2, r3) as c from rk group by 1),
recursive_v as (select * from v), w as (select qid, greatest(0.16 * greatest(s * x, 0) / m, 0.02 * 0.16) as w1, greatest(0.20 * greatest(s * y, 0) / m, 0.02 * 0.20) as w2, greatest(0.12 * greatest(s * z, 0) / m, 0.02 * 0.12) as w3
from (select qid, x, y, z, case when x + y + z < 0 then -1 else 1 end as s, greatest(case when x + y + z < 0 then -x else x end, case when x + y + z < 0 then -y else y end, case when x + y + z < 0 then -z else z end) as m from recursive_v where i = 2000))"""
SPECTRAL_SQL = "with recursive" + RANKS_SQL.removeprefix("with") + SPECTRAL_SQL.replace("recursive_v as (select * from v)", """v as (select qid, 0 as i, 0.6::double as x, 0.59::double as y, 0.54::double as z from c0 union all
select qid, i + 1, nx / l, ny / l, nz / l from (select qid, i, nx, ny, nz, sqrt(nx * nx + ny * ny + nz * nz) as l from (select v.qid, i, x + a * y + b * z as nx, y + a * x + c * z as ny, z + b * x + c * y as nz from v join c0 on c0.qid = v.qid where i < 2000)))""").replace("from recursive_v where", "from v where")


@query(_fused_sql(SPECTRAL_SQL, "(w1 * r1 + w2 * r2 + w3 * r3) / (w1 + w2 + w3) / n"))
def adaptive_fusion(spark, d):
    x = _levels(spark, d)
    return _rounded(ranks.fuse_signals(x.select("qid", "pid", F.col("s_l1").alias("l1"), F.col("s_l2").alias("l2"), "rrf"), ["l1", "l2", "rrf"], "default"), "fused")


IDENT_SQL = """k as (select *, case when trim(coalesce(doi, '')) <> '' then 'doi:' || lower(trim(doi)) when trim(coalesce(arxiv_id, '')) <> '' then 'arxiv:' || lower(split_part(trim(arxiv_id), 'v', 1))
  else 'title:' || substr(md5(regexp_replace(lower(coalesce(title, '')), '[^\\p{L}\\p{N}]', '', 'g')), 1, 16) end as ident from papers)"""


@query("with " + IDENT_SQL + " select ident, count(*) as copies, min(rec_id) as rec_id from k group by 1")
def exact_dedup(spark, d):
    return entities.merge_exact(table(spark, d, "papers")).select("ident", "copies", "rec_id")


@query("with " + IDENT_SQL + """ select ident, arg_max(length(coalesce(abstract, '')), (length(coalesce(abstract, '')), -rec_id)) as abstract_length, min_by(year, rec_id) filter (year is not null) as year,
 min_by(venue, rec_id) filter (trim(coalesce(venue, '')) <> '') as venue, max(citation_count) as citation_count, string_agg(distinct source, '+' order by source) as source, max(len(authors)) as n_authors from k group by 1""")
def record_merge(spark, d):
    m = entities.merge_exact(table(spark, d, "papers"))
    return m.select("ident", F.length(F.coalesce("abstract", F.lit(""))).alias("abstract_length"), "year", "venue", "citation_count", "source", F.when(F.size("authors") >= 0, F.size("authors")).alias("n_authors"))


@query(f"""with t as (select rec_id as id, title, {ALLTOK.format("title")} as w, {TOK.format("title")} as b from papers), o as (select id, w, coalesce(b[1], '_') as block from (select min(id) as id, any_value(w) as w, any_value(b) as b from t where len(w) > 0 group by title)),
p as (select a.id as a, b.id as b, a.w as wa, b.w as wb from o a join o b on a.block = b.block and a.id < b.id), s as (select a, b, {_sim_sql("wa", "wb")} as sim from p)
select a, b, round(sim, 6) as sim from s where sim >= 0.86""")
def fuzzy_pairs(spark, d):
    return _rounded(entities.fuzzy_pairs(table(spark, d, "papers")), "sim")


@query()
def fuzzy_leaders(spark, d):
    return entities.fuzzy_leaders(table(spark, d, "papers"))


@query("""with q as (select cast(vec_id as varchar) as qid, embedding as e from embeddings where vec_id % 20 = 0), s as (select qid, v.vec_id, list_cosine_similarity(cast(q.e as double[]), cast(v.embedding as double[])) as score from q, embeddings v)
select qid, vec_id, round(score, 5) as score, rank from (select *, row_number() over (partition by qid order by round(score, 9) desc, vec_id) as rank from s) where rank <= 10""")
def dense_topk(spark, d):
    e = table(spark, d, "embeddings")
    # the stated query set: every row whose id is divisible by 20, against all rows
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("qid"), "embedding")
    return entities.dense_top(e, q, 10).withColumn("score", F.round("score", 5))


@query(f"""with {C}, t as (select pid, {TOK.format("concat(title, chr(10), coalesce(abstract, ''))")} as t from corpus), x as (select pid, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i+1]))) as term from t),
tf as (select pid, term, count(*) as c from x group by 1, 2), df as (select term, count(*) as df from tf group by 1), n as (select count(*) as n from corpus),
b as (select pid, ('0x' || substr(md5(term), 1, 8))::bigint % 4096 as bucket, sum((1 + ln(c)) * ln(1 + n / (1.0 + df))) as w from tf join df using (term), n group by 1, 2),
m as (select pid, sqrt(sum(w * w)) as norm from b group by 1) select b.pid, bucket, round(w / norm, 6) as w from b join m using (pid) where norm > 0""")
def hashing_tfidf(spark, d):
    return _rounded(entities.hashing_vectors(_corpus(spark, d).select("pid", F.concat_ws("\n", "title", "abstract").alias("text")), "pid", "text"), "w")


@query(f"with {E} select src, dst from edges")
def citation_edges(spark, d):
    return graph.edges(table(spark, d, "papers"))


@query(f"with {E}, {COCITE_CTES} select qid, pid, round(score, 6) as score from coc")
def cocitation(spark, d):
    return _rounded(graph.cocitation(graph.edges(table(spark, d, "papers")), _gold(spark, d)), "score")


SEEDS_SQL = "select distinct qid, pid from candidates where channel_ranks['lexical:bm25'] <= 3"


def _seeds(spark, d):
    return table(spark, d, "candidates").where(F.col("channel_ranks")["lexical:bm25"] <= 3).select("qid", "pid").distinct()


@query(f"""with {E}, seeds as (select qid, pid as seed from ({SEEDS_SQL})), o as (select src, count(*) as d from edges group by 1),
p as (select s.qid, s.seed, e2.src as pid, count(*) as n from seeds s join edges e1 on e1.src = s.seed join edges e2 on e2.dst = e1.dst where e2.src <> s.seed group by 1, 2, 3),
s as (select qid, pid, max(n / (o1.d + o2.d - n)::double) as score from p join o o1 on o1.src = seed join o o2 on o2.src = pid group by 1, 2)
select qid, pid, round(score / max(score) over (partition by qid), 6) as score from s""")
def coupling(spark, d):
    return _rounded(graph.coupling(graph.edges(table(spark, d, "papers")), _seeds(spark, d)), "score")


def _ppr_sql(name, src, dst, rounds):
    """Rounds of personalised PageRank from s0 along edges read from src to dst, as materialised steps."""
    steps = [f"{name}o as materialized (select {src} as src, {dst} as dst, count(*) over (partition by {src}) as d from edges)", f"{name}r0 as materialized (select qid, pid, s as score from s0)"]
    for i in range(1, rounds + 1):
        steps += [
            f"{name}m{i} as materialized (select p.qid, o.dst as pid, sum(p.score / o.d) as m from {name}r{i - 1} p join {name}o o on o.src = p.pid group by 1, 2)",
            f"{name}g{i} as materialized (select qid, sum(g) as gone from (select qid, score as g from {name}r{i - 1} union all select qid, -m from {name}m{i}) group by 1)",
            f"{name}r{i} as materialized (select qid, pid, sum(m) as score from (select qid, pid, 0.72 * m as m from {name}m{i} union all select s0.qid, s0.pid, s * (0.28 + 0.72 * gone) from s0 join {name}g{i} g on g.qid = s0.qid) group by 1, 2)",
        ]
    return ", ".join(steps)


S0_SQL = "nodes as materialized (select src as pid from edges union select dst from edges), s0 as materialized (select * from (select qid, pid, 1.0::double / count(*) over (partition by qid) as s from (select distinct qid, unnest(gold) as pid from harness_queries)) where pid in (select pid from nodes))"


@query(f"with {E}, {S0_SQL}, {_ppr_sql('b', 'src', 'dst', 24)} select qid, pid, round(score, 6) as score from br24")
def pagerank(spark, d):
    return _rounded(graph.pagerank(graph.edges(table(spark, d, "papers")), _gold(spark, d)), "score")


COUPLE_CTES = """co as (select src, count(*) as d from edges group by 1), cq as (select s.qid, s.seed, e2.src as pid, count(*) as n from seeds s join edges e1 on e1.src = s.seed join edges e2 on e2.dst = e1.dst where e2.src <> s.seed group by 1, 2, 3),
cu as (select qid, pid, max(n / (o1.d + o2.d - n)::double) as score from cq join co o1 on o1.src = seed join co o2 on o2.src = pid group by 1, 2), cou as (select qid, pid, score / max(score) over (partition by qid) as score from cu)"""


@query(f"""with {E}, {COCITE_CTES}, {COUPLE_CTES}, {S0_SQL}, {_ppr_sql('b', 'src', 'dst', 24)}, {_ppr_sql('f', 'dst', 'src', 24)},
parts as (select qid, pid, 0.25 * score / max(score) over (partition by qid) as s from br24 union all select qid, pid, 0.25 * score / max(score) over (partition by qid) from fr24 union all select qid, pid, 0.32 * score from coc union all select qid, pid, 0.18 * score from cou),
g as (select qid, pid, sum(s) as s from parts group by 1, 2) select qid, pid, round(s / max(s) over (partition by qid), 6) as score from g""")
def graph_prior(spark, d):
    return _rounded(graph.graph_prior(graph.edges(table(spark, d, "papers")), _gold(spark, d)), "score")


@query(f"""with {C}, refs as (select src, dst, min((rec_id, pos)) as place from (select rec_id, trim(pid) as src, trim(reference_ids[i]) as dst, i as pos from (select rec_id, pid, reference_ids, unnest(range(1, len(reference_ids) + 1)) as i from corpus)) where src <> '' and dst <> '' and src <> dst group by 1, 2),
sc as (select qid, pid, sum(1.0 / (60 + rank)) as score from (select qid, pid, unnest(map_keys(channel_ranks)) as channel, unnest(map_values(channel_ranks)) as rank from candidates) group by 1, 2),
s as (select qid, pid as seed from (select *, row_number() over (partition by qid order by round(score, 9) desc, pid) as n from sc) where n <= 6),
x as (select qid, 'cite_bwd' as channel, seed, dst as pid, place from s join refs on src = seed union all select qid, 'cite_fwd', seed, src, place from s join refs on dst = seed)
select qid, channel, seed, pid, rank from (select *, row_number() over (partition by qid, channel, seed order by place, pid) as rank from x) where rank <= 40""")
def citation_expand(spark, d):
    c = table(spark, d, "candidates").select("qid", "pid", F.explode("channel_ranks").alias("channel", "rank")).groupBy("qid", "pid").agg(F.sum(1 / (60 + F.col("rank"))).alias("score"))
    return graph.expand(_corpus(spark, d), c)


@query(f"with {E}, n as (select distinct pid from ({SEEDS_SQL})) select src, dst from edges where src in (select pid from n) and dst in (select pid from n)")
def induced_subgraph(spark, d):
    return graph.induced(graph.edges(table(spark, d, "papers")), _seeds(spark, d))


@query(f"with {E} select pid, count(*) as degree from (select src as pid from edges union all select dst from edges) group by 1")
def relation_degree(spark, d):
    return graph.degrees(graph.edges(table(spark, d, "papers")))


CAP_SQL = f"with {H}, c as (select qid, pid, count(*) as c from h group by 1, 2), k as (select qid, count(*)::double as d, sum((c = 1)::int)::double as f1, sum((c = 2)::int)::double as f2 from c group by 1)"


VAR_SQL = "case when f2 > 0 then f2 * (pow(f1 / f2, 2) / 2 + pow(f1 / f2, 3) + pow(f1 / f2, 4) / 4) when f1 > 1 then 0.25 * f1 * pow(2 * f1 - 1, 2) / greatest(1, f1) + 0.5 * f1 * (f1 - 1) else greatest(d, 1.0) end"
RAW_SQL = "d + least(f1 * greatest(f1 - 1, 0) / (2 * (f2 + 1)), 4 * d)"


@query(CAP_SQL + f" select qid, d, f1, f2, round({RAW_SQL}, 6) as n_hat, round({VAR_SQL}, 4) as variance from k")
def chao1(spark, d):
    return _rounded(coverage.chao1(coverage.capture_counts(_hits(spark, d))), "n_hat").withColumn("variance", F.round("variance", 4)).select("qid", "d", "f1", "f2", "n_hat", "variance")


@query(f"""with {H}, s as (select qid, channel, count(*) as n from h group by 1, 2), p as (select a.qid, a.channel as ca, b.channel as cb, a.n as na, b.n as nb from s a join s b on a.qid = b.qid and a.channel < b.channel),
i as (select a.qid, a.channel as ca, b.channel as cb, count(*) as i from h a join h b on a.qid = b.qid and a.pid = b.pid and a.channel < b.channel group by 1, 2, 3)
select p.qid, round(avg(coalesce(i, 0) / (na + nb - coalesce(i, 0))::double), 6) as correlation from p left join i on p.qid = i.qid and p.ca = i.ca and p.cb = i.cb group by 1""")
def channel_jaccard(spark, d):
    return _rounded(coverage.channel_jaccard(_hits(spark, d)), "correlation")


def _prior(spark, d):
    return table(spark, d, "harness_queries").select("qid", F.lit(12.0).alias("prior"))


EST_SQL = CAP_SQL + f""", sz as (select qid, channel, count(*) as n from h group by 1, 2), pr as (select a.qid, a.channel as ca, b.channel as cb, a.n as na, b.n as nb from sz a join sz b on a.qid = b.qid and a.channel < b.channel),
ii as (select a.qid, a.channel as ca, b.channel as cb, count(*) as i from h a join h b on a.qid = b.qid and a.pid = b.pid and a.channel < b.channel group by 1, 2, 3),
cor as (select pr.qid, avg(coalesce(i, 0) / (na + nb - coalesce(i, 0))::double) as rho from pr left join ii on pr.qid = ii.qid and pr.ca = ii.ca and pr.cb = ii.cb group by 1),
e1 as (select k.qid, d, f1, {RAW_SQL} as raw, {VAR_SQL} as var, coalesce(rho, 0.0) as rho from k left join cor on cor.qid = k.qid),
e2 as (select *, d + (raw - d) * (1 + rho * greatest(raw - d, 0) / greatest(raw, 1e-9)) as n0, d / (d + 2.0) as w from e1),
e3 as (select *, case when d < 1e-6 then 12.0 else greatest(exp(w * ln(greatest(n0, 1e-9)) + (1 - w) * ln(12.0)), d) end as n_hat from e2 where qid in (select qid from harness_queries)),
est as (select *, greatest(n_hat - d, 1e-6) as extra, sqrt(ln(1 + var / pow(greatest(n_hat - d, 1e-6), 2))) as sd from e3)"""


def _estimate(spark, d):
    h = _hits(spark, d)
    return coverage.estimate(coverage.capture_counts(h), coverage.channel_jaccard(h), _prior(spark, d)).join(_prior(spark, d).select("qid"), "qid", "left_semi")


@query(EST_SQL + " select qid, d, round(n_hat, 6) as n_hat, round(d + extra * exp(-1.96 * sd), 6) as low, round(d + extra * exp(1.96 * sd), 6) as high, round(sd, 6) as sd from est")
def coverage_interval(spark, d):
    return _rounded(_estimate(spark, d), "n_hat", "low", "high", "sd")


@query(EST_SQL + """, g as (select *, f1 / greatest(greatest(d, 1.0) + f1, 1.0) * greatest(n_hat - d, 0) as expected_new, d / greatest(n_hat, 1e-9) as coverage from est), g2 as (select *, 2 * expected_new / greatest(d + n_hat, 1e-9) as gain from g)
select qid, (coverage >= 0.85 or gain < 0.05) as stop, case when coverage >= 0.85 then 'coverage' when gain < 0.05 then 'gain' end as reason, round(coverage, 6) as coverage, round(expected_new, 6) as expected_new, round(gain, 6) as gain from g2""")
def stop_rule(spark, d):
    x = coverage.should_stop(_estimate(spark, d), coverage.capture_counts(_hits(spark, d)), 1, 3, least_gain=0.05)
    return _rounded(x, "coverage", "expected_new", "gain")


@query(f"""with {H}, f as (select qid, pid, count(distinct split_part(channel, ':', 1)) as f from h group by 1, 2), c as (select qid, sum((f >= 2)::int)::bigint as multi, count(*) as pool from f group by 1)
select qid, multi, pool, 12.0::double as mass, round(case when multi = 0 or multi / pool > 0.99 then 12.0 else exp(0.5 * ln(12.0) + 0.5 * ln(multi)) end, 6) as half from c where qid in (select qid from harness_queries)""")
def mass_anchor(spark, d):
    h, prior = _hits(spark, d), _prior(spark, d)
    half = coverage.mass_anchor(h, prior, 0.5, 0.99).select("qid", F.round("mass", 6).alias("half"))
    return coverage.mass_anchor(h, prior).join(half, "qid")


P_SQL = f"""with {POOL_SQL}, p as (select qid, pid, 0.95 / (1 + pow(rank / 12.0, 1.6)) as p from pool),
c0 as (select *, row_number() over w as k, sum(p) over (partition by qid order by round(p, 9) desc, pid rows unbounded preceding) as mass, greatest(12.0, sum(p) over (partition by qid)) as n from p window w as (partition by qid order by round(p, 9) desc, pid)),
c as (select *, 2 * mass / (k + n) as f1 from c0), b as (select qid, k as k_star, f1 as best_f1 from (select *, row_number() over (partition by qid order by round(f1, 12) desc, k) as rn from c) where rn = 1),
g as (select b.qid, k_star as k, best_f1, best_f1 / 2 as threshold, greatest(least(sum((c.k <= k_star and c.p > best_f1 / 2 * 1.25)::int), k_star), 1)::bigint as core_k from c join b on b.qid = c.qid group by 1, 2, 3)"""


def _curve(spark, d):
    p = calibrate.decay_rows(_pool(spark, d), 12.0).select("qid", "pid", "p")
    return gate.f1_curve(p, _hits(spark, d).select("qid").distinct().withColumn("n_hat", F.lit(12.0)))


@query(P_SQL + """, hr as (select h.* from h join p on p.qid = h.qid and p.pid = h.pid and p.p >= 0.5), cc as (select qid, pid, count(*) as n, min(channel) as channel from hr group by 1, 2), l as (select qid, channel, count(*) as lone from cc where n = 1 group by 1, 2), t as (select qid, channel, count(*) as relevant from hr group by 1, 2)
select a.qid, a.channel, coalesce(lone, 0) as lone, coalesce(relevant, 0) as relevant from (select distinct qid, channel from h) a left join l on a.qid = l.qid and a.channel = l.channel left join t on t.qid = a.qid and t.channel = a.channel""")
def weakest_channel(spark, d):
    return coverage.weakest_channel(_hits(spark, d), _curve(spark, d).select("qid", "pid", "p"))


@query(P_SQL + " select qid, pid, k, round(p, 6) as p, round(f1, 6) as f1 from c")
def f1_curve(spark, d):
    return _rounded(_curve(spark, d).select("qid", "pid", "k", "p", "f1"), "p", "f1")


@query(P_SQL + " select qid, k, round(best_f1, 6) as best_f1, round(threshold, 6) as threshold, core_k from g")
def f1_gate(spark, d):
    return _rounded(gate.cutoff(_curve(spark, d), 1.25), "best_f1", "threshold")


@query(P_SQL + " select c.qid, pid, c.k, case when c.k <= core_k then 'core' when c.k <= g.k then 'partial' else 'excluded' end as tier from c join g on c.qid = g.qid")
def result_tiers(spark, d):
    c = _curve(spark, d)
    return gate.tiers(c, gate.cutoff(c, 1.25))


@query(P_SQL + " , x as (select *, lead(p) over (partition by qid order by k) as nxt from c) select x.qid, (x.p >= threshold - 1e-9 and coalesce(nxt, 0.0) <= threshold + 1e-9) as holds from x join g on g.qid = x.qid and g.k = x.k")
def f1_fixed_point(spark, d):
    c = _curve(spark, d)
    return gate.fixed_point(c, gate.cutoff(c, 1.25))


def _draw_values():
    import numpy as np

    return ", ".join(f"({i}, {float(v)!r})" for i, v in enumerate(np.random.default_rng(0).normal(size=400)))


@query(EST_SQL + f""", zs(i, z) as (values {_draw_values()}), ns as (select qid, greatest(d, d + extra * exp(sd * z - sd * sd / 2)) as n_sample from est, zs), rw as (select qid, pid, sum({W_SQL} / (60 + rank)) as score from h group by 1, 2),
pool as (select * from (select *, row_number() over (partition by qid order by round(score, 9) desc, pid) as k from rw) where k <= {KEEP}), p as (select qid, pid, k, 0.95 / (1 + pow(k / 12.0, 1.6)) as p from pool),
c0 as (select *, sum(p) over (partition by qid order by k rows unbounded preceding) as mass, sum(p) over (partition by qid) as every from p),
cv as (select c0.qid, pid, p, k, avg(2 * mass / (k + greatest(n_sample, every))) as f1 from c0 join ns on ns.qid = c0.qid group by 1, 2, 3, 4),
b as (select qid, k as k_star, f1 as best_f1 from (select *, row_number() over (partition by qid order by round(f1, 12) desc, k) as rn from cv) where rn = 1)
select b.qid, max(k_star) as k, round(max(best_f1), 6) as best_f1, round(max(best_f1) / 2, 6) as threshold, greatest(least(sum((cv.k <= k_star and cv.p > best_f1 / 2 * 1.25)::int), max(k_star)), 1)::bigint as core_k from cv join b on b.qid = cv.qid group by 1""")
def f1_gate_draws(spark, d):
    c = gate.f1_curve_draws(_curve(spark, d).select("qid", "pid", "p"), coverage.draws(_estimate(spark, d)))
    return _rounded(gate.cutoff(c, 1.25), "best_f1", "threshold")


@query(f"""with recursive {POOL_SQL}, n as (select qid, count(*)::double as n, greatest(0.5, least(12.0, greatest(0.5, count(*) * 0.95 * 0.95))) as goal from pool group by 1),
b as (select qid, n, goal, 0 as i, 1e-3::double as lo, 4 * n as hi from n union all select qid, n, goal, i + 1, case when low then mid else lo end, case when low then hi else mid end from
 (select *, list_sum(list_transform(range(1, n::int + 1), lambda r: 0.95 / (1 + pow(r / mid, 1.6)))) < goal as low from (select *, (lo + hi) / 2 as mid from b where i < 80)))
select p.qid, pid, round(greatest(least(0.95 / (1 + pow(rank / ((lo + hi) / 2), 1.6)), 0.9999), 0.0001), 6) as p from pool p join b on b.qid = p.qid and i = 80""")
def rank_decay_calibration(spark, d):
    return _rounded(calibrate.calibrate(_pool(spark, d), _prior(spark, d).withColumn("mass", F.col("prior")), "rank_decay"), "p")


MIX_SQL = "with recursive" + LEVELS_SQL.removeprefix("with") + """, sc as (select qid, pid, greatest(least(s_l2, 1.0), 0.0) as s from lv), xs as (select qid, list(s order by pid) as xs, count(*)::double as n, least(0.6, greatest(0.01, 12.0 / count(*))) as prior from sc group by 1),
em as (select qid, xs, n, prior, 0 as i, least(greatest(prior, 0.01), 0.5)::double as sh, list_aggregate(xs, 'quantile_cont', 0.9)::double as m1, list_aggregate(xs, 'quantile_cont', 0.4)::double as m0, greatest(list_aggregate(xs, 'stddev_pop'), 1e-3)::double as sd from xs where n >= 8
union all select qid, xs, n, prior, i + 1, sh2, greatest(m1n, m0n + 0.35 * sdn), m0n, sdn from (select *, sqrt(greatest(list_sum(list_transform(range(1, n::int + 1), lambda j: r[j] * pow(xs[j] - m1n, 2) + (1 - r[j]) * pow(xs[j] - m0n, 2))) / n, 1e-6)) as sdn from
 (select qid, xs, n, prior, i, r, least(greatest((n1 + 0.6 * n * prior) / (n + 0.6 * n), 1e-4), 0.6) as sh2, list_sum(list_transform(range(1, n::int + 1), lambda j: r[j] * xs[j])) / n1 as m1n, list_sum(list_transform(range(1, n::int + 1), lambda j: (1 - r[j]) * xs[j])) / (n - n1) as m0n from
 (select *, list_sum(r) as n1 from (select *, list_transform(xs, lambda x: sh * exp(-pow(x - m1, 2) / (2 * sd * sd)) / greatest(sh * exp(-pow(x - m1, 2) / (2 * sd * sd)) + (1 - sh) * exp(-pow(x - m0, 2) / (2 * sd * sd)), 1e-300)) as r from em where i < 60))))),
po as (select sc.qid, pid, case when em.qid is null then s else least(greatest(sh * exp(-pow(s - m1, 2) / (2 * sd * sd)) / greatest(sh * exp(-pow(s - m1, 2) / (2 * sd * sd)) + (1 - sh) * exp(-pow(s - m0, 2) / (2 * sd * sd)), 1e-300), 1e-6), 1 - 1e-6) end as p from sc left join em on em.qid = sc.qid and em.i = 60),
pl as (select qid, list(least(greatest(p, 1e-6), 1 - 1e-6)) as ps, least(greatest(12.0, 0.5), greatest(0.5, 0.95 * count(*))) as goal from po group by 1),
tm as (select qid, ps, goal, 0 as i, 0.2::double as lo, 40.0::double as hi from pl union all select qid, ps, goal, i + 1, case when big then mid else lo end, case when big then hi else mid end from (select *, list_sum(list_transform(ps, lambda x: pow(x, mid))) > goal as big from (select *, (lo + hi) / 2 as mid from tm where i < 60))),
al as (select qid, case when list_sum(list_transform(ps, lambda x: pow(x, 40.0))) > goal then 40.0 when list_sum(list_transform(ps, lambda x: pow(x, 0.2))) < goal then 0.2 else (lo + hi) / 2 end as a from tm where i = 60)"""


@query(MIX_SQL + " select po.qid, pid, round(greatest(least(pow(least(greatest(p, 1e-6), 1 - 1e-6), a), 0.9999), 0.0001), 5) as p from po join al on al.qid = po.qid")
def mixture_calibration(spark, d):
    s = _levels(spark, d).select("qid", "pid", F.greatest(F.least("s_l2", F.lit(1.0)), F.lit(0.0)).alias("score"))
    return calibrate.calibrate(s, _prior(spark, d).withColumn("mass", F.col("prior"))).withColumn("p", F.round("p", 5))


GOLD_SQL = "gold as (select distinct qid, unnest(gold) as pid from harness_queries)"
PRF_SQL = P_SQL + f""", {GOLD_SQL}, pr as (select c.qid, pid from c join g on g.qid = c.qid where c.k <= g.k), np as (select qid, count(*) as n_pred from pr group by 1), ng as (select qid, count(*) as n_gold from gold group by 1),
tp as (select qid, count(*) as tp from pr join gold using (qid, pid) group by 1), m as (select ng.qid, coalesce(tp, 0) as tp, coalesce(n_pred, 0) as n_pred, n_gold from ng left join np using (qid) left join tp using (qid)),
f as (select *, case when n_pred > 0 then tp / n_pred::double else 0.0 end as precision, tp / n_gold::double as recall, 2.0 * tp / (n_pred + n_gold) as f1 from m)"""


def _prf(spark, d):
    c = _curve(spark, d)
    kept = c.join(gate.cutoff(c, 1.25).select("qid", F.col("k").alias("k_star")), "qid").where("k <= k_star").select("qid", "pid")
    return evaluate.set_prf(kept, _gold(spark, d))


@query(PRF_SQL + " select qid, tp, n_pred, n_gold, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from f")
def set_prf(spark, d):
    return _rounded(_prf(spark, d), "precision", "recall", "f1")


@query(PRF_SQL + """ select coalesce(query_type_hint, 'none') as query_type, count(*) as queries, round(avg(precision), 6) as macro_precision, round(avg(recall), 6) as macro_recall, round(avg(f1), 6) as macro_f1,
round(2.0 * sum(tp) / (sum(n_pred) + sum(n_gold)), 6) as micro_f1 from f join harness_queries using (qid) group by 1""")
def metrics_by_type(spark, d):
    x = _prf(spark, d).join(table(spark, d, "harness_queries").select("qid", F.coalesce("query_type_hint", F.lit("none")).alias("query_type")), "qid")
    return _rounded(evaluate.summary(x, "query_type"), "macro_precision", "macro_recall", "macro_f1", "micro_f1")


@query(P_SQL + f""", {GOLD_SQL}, n as (select qid, count(*) as n from gold group by 1), x as (select c.qid, sum((k <= 20)::int) as h20, sum((k <= 50)::int) as h50 from c join gold using (qid, pid) group by 1)
select n.qid, round(coalesce(h20, 0) / n::double, 6) as recall_at_20, round(coalesce(h50, 0) / n::double, 6) as recall_at_50 from n left join x using (qid)""")
def recall_at_k(spark, d):
    return _rounded(evaluate.recall_at(_curve(spark, d).select("qid", "pid", F.col("k").alias("rank")), _gold(spark, d)), "recall_at_20", "recall_at_50")


@query(P_SQL + f""", {GOLD_SQL}, y as (select c.p, (gold.pid is not null)::int as y from c left join gold on gold.qid = c.qid and gold.pid = c.pid), bb as (select least(floor(p * 10), 9) as bin, count(*) as n, avg(p) as mp, avg(y) as rate from y group by 1)
select round(sum(n * abs(mp - rate)) / sum(n), 6) as ece, (select round(avg((p - y) * (p - y)), 6) from y) as brier, sum(n)::bigint as n from bb""")
def calibration_error(spark, d):
    y = _curve(spark, d).join(_gold(spark, d).withColumn("y", F.lit(1)), ["qid", "pid"], "left").select("p", F.coalesce("y", F.lit(0)).alias("y"))
    return _rounded(evaluate.calibration_error(y), "ece", "brier")


@query(P_SQL + f""", {GOLD_SQL}, gs as (select qid, count(*) as g from gold group by 1), x as (select c.qid, c.pid, c.k, g, sum((gold.pid is not null)::int) over (partition by c.qid order by c.k) as tp from c join gs on gs.qid = c.qid left join gold on gold.qid = c.qid and gold.pid = c.pid where c.k <= 120),
bb as (select qid, k as best from (select *, row_number() over (partition by qid order by round(2.0 * tp / (k + g), 12) desc, k) as rn from x) where rn = 1) select x.qid, x.pid from x join bb using (qid) where k <= best""")
def oracle_selector(spark, d):
    return gate.select_oracle(_curve(spark, d).select("qid", "pid", "k"), _gold(spark, d))


@query(f"""with {C} select pid, round(greatest(least((0.35 + 0.65 * (0.65 * c / (1.5 + c) + 0.35 * least(age / 3.0, 1.0))) * case when rv then 0.9 else 1.0 end, 1.0), 0.35), 6) as propensity from
(select pid, ln(1.0 + greatest(coalesce(citation_count, 0), 0)) as c, greatest(0, 2026 - coalesce(year, 2026)) as age,
 contains(lower(coalesce(doc_type, '')), 'review') or contains(lower(coalesce(doc_type, '')), 'survey') or starts_with(lower(coalesce(title, '')), 'a survey') or contains(lower(coalesce(title, '')), ': a survey') or contains(lower(coalesce(title, '')), 'a review of') as rv from corpus)""")
def propensity(spark, d):
    c = _corpus(spark, d)
    return _rounded(c.select("pid", calibrate.propensity(F.col("citation_count"), F.col("year"), tx.is_review(F.col("doc_type"), F.col("title"))).alias("propensity")), "propensity")


@query(f"with {C} select count(*) as papers, min(year) as year_min, max(year) as year_max, median(citation_count) as median_citations from corpus")
def corpus_stats(spark, d):
    return views.corpus_stats(_corpus(spark, d))


@query(f"with {C}, v as (select venue as value, count(*) as n from corpus where trim(coalesce(venue, '')) <> '' group by 1) select value, n, row_number() over (order by n desc, value) as place from v order by n desc, value limit 8")
def top_venues(spark, d):
    return views.top_values(_corpus(spark, d), "venue")


@query(f"""with {C} select year, pid, place, papers from (select year, pid, row_number() over (partition by year order by coalesce(citation_count, 0) desc, pid) as place, count(*) over (partition by year) as papers from corpus where year is not null) where place <= 4""")
def year_timeline(spark, d):
    return views.timeline(_corpus(spark, d)).select("year", "pid", "place", "papers")


FTOK = f"list_filter({ETOK.format('title')}, lambda w: length(w) > 3)"


@query(f"""with {C}, r as (select q.qid, c.pid, c.title from (select distinct qid, unnest(gold) as pid from harness_queries) q join corpus c using (pid)), n as (select qid, count(*) as n from r group by 1), t as (select qid, pid, {FTOK} as t from r),
x as (select qid, pid, unnest(list_distinct(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i+1])))) as term from t), s as (select qid, term, count(distinct pid) as size from x group by 1, 2)
select qid, term, size, round(size * (1 - size / n::double) * (1 + 0.5 * contains(term, ' ')::int), 6) as score from s join n using (qid) where size >= 2 and size <= greatest(2, floor(0.7 * n))""")
def facet_terms(spark, d):
    return _rounded(views.facet_terms(_gold(spark, d).join(_corpus(spark, d).select("pid", "title"), "pid")), "score")


@query()
def facets(spark, d):
    return views.facets(_gold(spark, d).join(_corpus(spark, d).select("pid", "title"), "pid"))


@query("select event_type as stage, count(*) as n, round(sum(value), 4) as total from events group by 1")
def ledger_summary(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query()
def retrieval_engine(spark, d):
    from .plans import engine

    return engine.run(table(spark, d, "harness_queries"), table(spark, d, "papers"), table(spark, d, "candidates"))


@query("select date_trunc('hour', ts) as start, event_type as stage, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stage_counters(spark, d):
    from .streaming.events import stage_counters as f

    return f(table(spark, d, "events")).withColumns({"total": F.round("total", 4), "start": F.col("start").cast("timestamp_ntz")})


@query("""with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from e) select user_id, min(ts) as start, max(ts) + interval 30 minutes as "end", count(*) as n from s group by user_id, s""")
def user_sessions(spark, d):
    from .streaming.events import sessions

    return sessions(table(spark, d, "events")).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


from . import queries_plan  # noqa: E402, F401  (adds the queries of planning, control, sections and evaluation)
