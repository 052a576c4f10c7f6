"""The training-data operators: brute force on small fixtures, exact round trips, edge cases."""

from datetime import datetime
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import abuse, bpe, formatting_dups, markup, matching, mixing, score_fusion, split_overlap, survivors
from lexiloom.runtime import shared_dir

T1, T2, T3 = (datetime(2024, m, 1) for m in (1, 5, 9))
CASES = "case_id long, split string, query string, gold_arxiv_ids array<string>, source string, words string, cls string"


def cases(spark, rows):
    return spark.createDataFrame([(*r, "s", "clash", "clash") for r in rows], CASES)


def test_p1_pairs(spark):
    q = "Work comparing beam search against Nadavani for claim verification"
    rows = [
        (1, "train", q, ["1501.00001", "arXiv:1502.00002v1"]),
        (2, "dev", "  WORK comparing beam search agianst Nadavani for claim verification!", ["1502.00002", "1501.00001"]),
        (3, "test", "Comparisons of Nadavani and beam search for claim verification", None),
        (4, "test", "Work comparing beam search against Bolegiti for claim verification", ["1501.00001"]),
        (5, "dev", q, ["9", "8", "7"]),
        (6, "dev", None, None),
        (7, "train", "", []),
        (8, "dev", "", []),
        (9, None, q, None),
        (10, "test", "Ｗｏｒｋ ｃｏｍｐａｒｉｎｇ ｂｅａｍ ｓｅａｒｃｈ ａｇａｉｎｓｔ Ｎａｄａｖａｎｉ ｆｏｒ ｃｌａｉｍ ｖｅｒｉｆｉｃａｔｉｏｎ", ["1501.00001", " 1502.00002 ", "3"]),
        (11, "train", q, ["1501.00001", "1502.00002"]),
        (12, "train", "word " * 20000, None),
    ]
    got = {(r["train_id"], r["eval_id"]) for r in split_overlap.overlaps(cases(spark, rows)).collect()}
    assert got == {(a, b) for a in (1, 11) for b in (2, 3, 10)}
    assert split_overlap.overlaps(cases(spark, rows).limit(0)).count() == 0


def on_disk(spark):
    places = [*spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString(), shared_dir(spark).removeprefix("file:")]
    return sum(f.stat().st_size for p in places for f in Path(p).rglob("*") if f.is_file())


def test_p1_brute_force_within_disk(spark):
    rng = np.random.default_rng(7)
    topics = [" ".join(rng.choice(["ranking", "grading", "parsing", "staging", "logging", "docking", "folding", "kernels", "sensors", "archives"], 4, replace=False)) for _ in range(60)]
    gold = lambda: [f"1{k:03d}.00001" for k in rng.choice(12, rng.integers(0, 5), replace=False)]
    rows = [(i, ["train", "dev"][i % 2], f"papers on {rng.choice(topics)} beyond Mo{'bcdfgh'[i % 6]}avuk", gold()) for i in range(3000)]
    table = cases(spark, rows).repartition(4).cache()
    table.count()
    before = on_disk(spark)
    got = {(r["train_id"], r["eval_id"]) for r in split_overlap.overlaps(table).collect()}
    assert on_disk(spark) - before < 6e6
    words = [split_overlap.content(q) for _, _, q, _ in rows]
    by_words = {}
    for i, w in enumerate(words):
        by_words.setdefault(tuple(sorted(w)), []).append(i)
    alike = [(a, b) for a in by_words for b in by_words if split_overlap.same_question(list(a), list(b))]
    want = {(i, j) for a, b in alike for i in by_words[a] for j in by_words[b] if i % 2 == 0 and j % 2 and (not rows[i][3] or not rows[j][3] or len(set(rows[i][3]) ^ set(rows[j][3])) <= 2)}
    # pairs that can only meet on the question are promised from half of its weight on
    sure = {(i, j) for i, j in want if len(rows[i][3]) + len(rows[j][3]) > 2 and rows[i][3] and rows[j][3] or words[i] == words[j]}
    assert sure <= got <= want and len(sure) > 1000


def test_p1_chunks_are_content_defined():
    a = "alpha beta gamma delta epsilon zeta eta theta"
    for mean in (5, 17):
        x, y = split_overlap.cut_texts([a, "xx " + a], mean)
        assert "".join(x) == a and "".join(y) == "xx " + a
        assert len(set(x) & set(y)) >= len(x) - 2
    assert split_overlap.cut_texts(["", "a"], 5) == [[], ["a"]]


def test_p1_words():
    assert split_overlap.same_question(split_overlap.content("Is there research after 2016 on record linkage?"), split_overlap.content("reserch on record linkaeg after 2016"))
    assert not split_overlap.same_question(split_overlap.content("research after 2016 on record linkage"), split_overlap.content("research after 2017 on record linkage"))


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("x <i>to</i> y", True),
        ("a &amp; b", True),
        ("&lt;b&gt;x&lt;/b&gt;", True),
        ("**Bold** start", True),
        ("# Heading", True),
        ("[a](https://b.c/d)", True),
        ("[[Study]] in", True),
        ("== Summary ==", True),
        ("{{cite journal|title=x}}", True),
        ("\\textsc{To}~ x", True),
        ("with $x_i^2$ here", True),
        ("\\[F_1 = 2\\]", True),
        ("`code` x", True),
        ("* one\n* two", True),
        ("x <!-- c --> y", True),
        ("{\\it to} x", True),
        ("p < 0.05 whenever n > 14", False),
        ("x < y < z holds & more", False),
        ("from $4 million to about $3 million", False),
        ("see [12] and [14]", False),
        ("file data_v2_final, C_max -> C_min, n^2 / 55, a*b, Sample #3, ~ 85 times", False),
        ("", False),
        (None, False),
    ],
)
def test_p3_markup(value, want):
    assert markup.has_markup(value) is want


def test_p3_clean():
    assert markup.clean("<h2>Aims</h2><ul><li>one</li><li>two &amp; a</li></ul>") == "# Aims\n\n- one\n- two & a"
    assert markup.clean("A [link](http://x.y) with $x^2$ and `c`") == "A link with $x^2$ and `c`"
    assert markup.clean("plain") == "plain" and markup.clean(None) is None
    assert "x" in markup.clean("<b>" * 3000 + "x")


def test_p3_long_formula_and_heading():
    formula, heading = "x^2 + " * 200 + "y", "word " * 80 + "end"
    assert markup.clean(f"with ${formula}$ here") == f"with ${formula}$ here" and markup.has_markup(f"with ${formula}$ here")
    assert markup.clean(f"== {heading} ==") == f"# {heading}"


def test_p3_tree_matching():
    t = lambda s: markup._tree(markup.skeleton(s)[0])
    a, b = t("<ul><li>a</li><li>b</li></ul>"), t("<ul><li>c</li></ul>")
    assert len(markup.simple_tree_matching(a, b)) == len(b)
    assert len(markup.simple_tree_matching(a, a)) == len(a)


def papers(spark, rows):
    return spark.createDataFrame(rows, "rec_id long, title string, abstract string, source string, field string, value string")


def test_p3_found_and_templates(spark):
    rows = [(i, "T", f"<p>Page furniture</p><p>text number {i}</p>", "S2 ", "", "") for i in range(8)] + [(100, "<b>x</b>", None, None, "", ""), (101, "", " ", "s2", "", ""), (100, "<b>x</b>", None, None, "", "")]
    p = papers(spark, rows)
    assert sorted((r["rec_id"], r["field"]) for r in markup.found(p).collect()) == [*((i, "abstract") for i in range(8)), (100, "title")]
    got = {r["rec_id"]: r["text"] for r in markup.cleaned(p).collect()}
    assert got[3] == "text number 3" and got[100] == "x"
    # the constant text at another node than the template's is content
    again = papers(spark, [*rows, (300, "T", "<p>Page furniture</p><p>Page furniture</p>", "s2", "", "")])
    assert {r["rec_id"]: r["text"] for r in markup.cleaned(again).collect()}[300] == "Page furniture"
    assert markup.cleaned(p.limit(0)).count() == 0


def test_p3_found_decides_by_aligned_trees(spark):
    texts = ["plain", "x < y", "a &amp; b", "<b>x</b>", "\\begin{#root}x", "\\begin{#text}x\\end{#text}", "{{a}}", "<ul><li>a</li></ul> b", "* one\n* two"]
    rows = [(i, x, " ".join([x] * (i % 3 + 1)), "s2", "", "") for i, x in enumerate(texts * 3)]
    p = papers(spark, rows)
    t = markup.trees(markup.fields(p)).select("value", "skel").distinct().collect()
    assert {r["value"] for r in t} == {v for r in rows for v in r[1:3]} and all(r["skel"].startswith("0e:#root 1") for r in t)
    named = markup.found(p)
    assert "align_udf" in named._jdf.queryExecution().optimizedPlan().toString()
    want = {(r[0], f) for r in rows for f, v in (("title", r[1]), ("abstract", r[2])) if markup.has_markup(v)}
    assert {(r["rec_id"], r["field"]) for r in named.collect()} == want and named.count() == len(want)


def test_p3_every_frequent_skeleton_is_a_wrapper(spark):
    rows = [(k * 10 + i, "", f"<x{k}>Banner {k}</x{k}><y{k}>text number {i}</y{k}>", "s2", "", "") for k in range(70) for i in range(6 if k < 64 else 5)]
    got = [r["text"] for r in markup.cleaned(papers(spark, rows)).collect()]
    assert len(got) == len(rows) and not any("Banner" in t for t in got) and all("text number" in t for t in got)


CAND = "cand_id long, qid string, pid string, channel_ranks map<string,int>, retrieval_score double, citation_count int, retrieved_at timestamp, score double"


def test_p4_no_scale_wins(spark):
    rows = [(i, "q", f"p{i}", {"a": i + 1, "b": i + 2}, 0.9 - i / 50, 100 - i, T1, 0.0) for i in range(30)]
    rows += [(100, "q", "huge", {"a": 90}, float("nan"), 2_000_000_000, T1, 0.0), (101, "q", "hot", {}, 237.7, -1, T1, 0.0), (102, "q", "p0", {"a": 1, "b": 2}, 0.9, 100, T2, 0.0), (103, None, "x", None, None, None, None, 0.0), (104, "r", "x", None, None, None, None, 0.0)]
    df = spark.createDataFrame(rows, CAND)
    got = [r["pid"] for r in score_fusion.top(df).where("qid = 'q'").orderBy("place").collect()]
    assert got == ["p0", "p1", "p2", "p3", "p4"]
    s = {(r["qid"], r["pid"]): r["score"] for r in score_fusion.fused(df).collect()}
    assert len(s) == 33 and all(0 < v < 1 for v in s.values()) and s["r", "x"] == pytest.approx(0.5)
    assert score_fusion.fused(df.limit(0)).count() == 0


P5 = "rec_id long, doi string, arxiv_id string, abstract string, venue string, citation_count int, source string, fetched_at timestamp, grp string, trust int"
ABS = "We study one thing. It is good and long enough to be whole."


def test_p5_survivors(spark):
    rows = [
        (1, "10.1/A", "", ABS[:30], "J. Retr.", 5, "s2", T1),
        (2, " 10.1/a", "1.2v1", ABS, "Journal of Retrieval", 99_999_999, "arxiv", T2),
        (3, "", "1.2V2", ABS + " All rights reserved.", "arXiv", 7, "x", T3),
        (4, "", "1.2", ABS + " " + ABS, None, 0, None, T3),
        (5, "10.2/b", "", ABS, "", None, "s2", T1),
        (6, "10.2/B ", "", ABS, "", None, "s2", T1),
        (7, None, None, ABS, "x", 1, "s2", T1),
        (8, " ", "", ABS, "x", 1, "s2", T1),
    ]
    p = spark.createDataFrame([(*r, "clash", 9) for r in rows], P5)
    src = spark.createDataFrame([("s2", 3), ("arxiv", 4)], "source string, trust int")
    got = {(r["group_rec"], r["field"]): r["rec_id"] for r in survivors.survivors(p, src).collect()}
    assert got == {(1, "abstract"): 2, (1, "venue"): 2, (1, "citation_count"): 3}
    assert survivors.survivors(p.limit(0), src).count() == 0
    assert survivors.merged(p, src).count() == 2


def test_p5_components(spark):
    e = [(f"d{i}", f"a{i}") for i in range(20)] + [(f"d{i}", f"a{i + 1}") for i in range(9)] + [("hub", f"x{i}") for i in range(40)]
    got = survivors.components(spark.createDataFrame(e, "u string, v string"))
    labels = {}
    for r in got.collect():
        labels.setdefault(r["label"], set()).add(r["node"])
    assert sorted(map(len, labels.values())) == [*[2] * 10, 20, 41]


def compared(title, paper, people="A. Bolo", authors="Anna Bolo"):
    words = lambda t: " ".join(matching.read_title(t)[0])
    names = lambda p: " ".join(matching.names(p))
    return matching.compare(title, words(title), names(people), bool(title and matching.CUT_OFF.search(title)), words(paper), names(authors), False, 2020.0, 2020.0, 0)[0]


def test_p6_compare():
    title = "Zerinuni: graph networks for record linkage"
    assert compared("zerinuni - grpah networks f. record linkage [preprint]", title)
    assert compared("Graph networks for record linkage (Zerinuni)", title)
    assert compared("Zerinuni: graph networks for rec...", title)
    assert compared("Zerinuni: graphnetworks for record linkage", title)
    assert not compared("Bolegiti: graph networks for record linkage", title)
    assert not compared(title + ": Part II", title)
    assert not compared(title + " - a reply", title)
    assert not compared(title, title, "C. Dodu", "Anna Bolo")
    assert not compared(None, title) and not compared("", "")
    says = lambda a, b: matching.id_says(matching.damaged_id(a), matching.damaged_id(b))
    assert says("1O.99/x.123", "10.99/x.123") == 1 and says("", "10.99/x.1") == 0
    assert says("10.99001/abcd.1", "10.99001/wxyz.7") == -1 and says("2401.00001", "2402.60121") == -1 and says("10.99/x", "2402.60121") == 0


def test_p6_matches(spark):
    rng = np.random.default_rng(2)
    syl = [c + v for c in "bdfgklmnprstvz" for v in "aeiou"]
    name = lambda: "".join(rng.choice(syl, 4)).capitalize()
    coined = [name() for _ in range(150)]
    people = [[f"{name()} {name()}" for _ in range(3)] for _ in coined]
    ps = [(1000 + i, f"{n}: graph networks for record linkage", people[i], 2010, f"10.99/{i}", "") for i, n in enumerate(coined)]
    ps += [(3000, ps[0][1], people[0], 2010, "10.99/0", ""), (3001, None, None, None, None, None)]
    ls = [(i, f"{coined[i].lower()} graph netwroks for record linkage", people[i][0], 2010, None, None) for i in range(60)] + [(500, None, None, None, None, None), (501, "", "", None, "", "")]
    listings = spark.createDataFrame(ls, "list_id long, title string, author_line string, pub_year int, doi_raw string, arxiv_raw string")
    p = spark.createDataFrame(ps, "rec_id long, title string, authors array<string>, year int, doi string, arxiv_id string")
    got = {(r["list_id"], r["rec_id"]): r["confidence"] for r in matching.matches(listings, p).collect()}
    want = {(i, 1000 + i) for i in range(60)} | {(0, 3000)}
    assert len(set(got) & want) >= 0.9 * len(want) and not set(got) - want
    assert all(0 <= c <= 1 for c in got.values())
    assert matching.matches(listings.limit(0), p).count() == 0


DAMAGE = ("cut", "slips", "order", "names", "joined")


def damaged(rng, words, people, how):
    """A listing's view of a title, as a third party would write it."""
    w, p = list(words), people
    if how == "cut":
        w = w[: max(4, len(w) * 2 // 3)]
    elif how == "slips":
        for i in rng.choice(len(w), 2, replace=False):
            at = int(rng.integers(1, max(2, len(w[i]) - 1)))
            w[i] = w[i][:at] + w[i][at : at + 1] * 2 + w[i][at + 1 :]
    elif how == "order":
        w = w[3:] + w[:3]
    elif how == "joined":
        w = w[:1] + [w[1] + w[2]] + w[3:]
    return " ".join(w), "" if how == "names" else p


def test_p6_index_recall(spark):
    """The production index, over a labelled pool that no part of it made: at least .9 of the damaged listings meet their paper."""
    rng = np.random.default_rng(4)
    syl = [c + v for c in "bdfgklmnprstvz" for v in "aeiou"]
    coin = lambda n: "".join(rng.choice(syl, n))
    common = [coin(3) for _ in range(60)]
    titles = [[coin(4), *rng.choice(common, 7, replace=False)] for _ in range(1500)]
    people = [" ".join(coin(3) for _ in range(4)) for _ in titles]
    b = spark.createDataFrame([(i, " ".join(t), p) for i, (t, p) in enumerate(zip(titles, people, strict=True))], "key long, words string, names string")
    made = [(i, DAMAGE[i % len(DAMAGE)], *damaged(rng, titles[i], people[i], DAMAGE[i % len(DAMAGE)])) for i in range(500)]
    a = spark.createDataFrame([(i, w, p) for i, _, w, p in made], "key long, words string, names string")
    e = matching.fit(a, b, 1500, matching.bits_for(1500))
    got = {(r["key_a"], r["key_b"]) for r in matching.candidates(a, b, e, 500, 1500, 0.40, 1.0, 12).collect()}
    recall = {how: np.mean([(i, i) in got for i, h, _, _ in made if h == how]) for how in DAMAGE}
    assert np.mean(list(recall.values())) >= 0.9, recall
    assert len(got) < 500 * 1500 / 10
    hot = {int(x): 3 for x in np.unique(e.keys(e.records([" ".join(titles[0])], [people[0]]), 0))}
    parts = matching.block_pairs(matching.indexed(a, e, 12, 1, 4, hot).unionByName(matching.indexed(b, e, 0, 0, 4, hot)), 0.40, 1.0, 4)
    assert {(r["key_a"], r["key_b"]) for r in parts.collect()} == got  # salting moves work, not results


def test_p6_refused_before_the_comparison(monkeypatch):
    """The test of a whole batch refuses most pairs, none that the exact comparison takes, and the rows stay those of comparing every pair."""
    rng = np.random.default_rng(8)
    syl = [c + v for c in "bdfgklmnprstvz" for v in "aeiou"]
    coin = lambda n: "".join(rng.choice(syl, n))
    common = [coin(3) for _ in range(20)]
    titles = [[coin(4), *rng.choice(common, 6, replace=False)] for _ in range(60)] + [["graph"], []]
    people = [coin(3) if t else "" for t in titles]
    listed = []
    for i, t in enumerate(titles):
        w, p = damaged(rng, t, people[i], DAMAGE[i % len(DAMAGE)]) if len(t) > 3 else (" ".join(t), people[i])
        listed.append((w[: len(w) * 2 // 3] + "..." if i % 7 == 0 else w + " [preprnt]" if i % 7 == 1 else w[:3] + "." + w[len(w.split(" ")[0]) :] if i % 7 == 2 else w, p))
    ia, ib = (x.ravel() for x in np.meshgrid(np.arange(len(titles)), np.arange(len(titles)), indexing="ij"))
    lwords, pwords = [" ".join(matching.read_title(t)[0]) for t, _ in listed], [" ".join(t) for t in titles]
    cut = np.array([bool(matching.CUT_OFF.search(t)) for t, _ in listed])
    lost = matching.lost_pairs(lwords, pwords, ia, ib) & ~cut[ia]
    whole = lambda i, j, says: matching.compare(listed[i][0], lwords[i], listed[i][1], bool(cut[i]), pwords[j], people[j], False, 2020.0, 2020.0, says)
    same = np.array([whole(i, j, 0)[0] for i, j in zip(ia, ib, strict=True)])
    assert same.sum() > 30 and not (lost & same).any() and lost.sum() > 0.9 * (~same & ~cut[ia]).sum()
    ids = lambda k, x: f"10.99{x:03d}/abcd.{k}" if k % 4 == 0 else ""
    side = lambda rows, own: pa.array([{"key": k, "cls": b"%d" % k, "title": t, "words": w, "names": n, "cut_off": c, "marked": False, "year": 2020.0, "doi": d, "ax": ""} for k, t, w, n, c, d in rows]).take(pa.array(own))
    a = side([(i, t, lwords[i], n, bool(cut[i]), ids(i, 1)) for i, (t, n) in enumerate(listed)], ia)
    b = side([(j, None, pwords[j], people[j], False, ids(j, 1 + j % 3)) for j in range(len(titles))], ib)
    e = matching.Embedding(rng.normal(size=(matching.BUCKETS, matching.DIM)), np.ones(matching.BUCKETS), (1, 1, 1), 9)
    asked, exact = [], matching.compare
    monkeypatch.setattr(matching, "compare", lambda *x: asked.append(x) or exact(*x))
    for told in (0.0, 1.0):
        asked.clear()
        got = [r for x in matching.reranked(e, told)([pa.RecordBatch.from_arrays([a, b], names=["a", "b"])]) for r in x.to_pylist()]
        assert len(asked) < len(ia) / 3
        says = [matching.id_says(x["doi"], y["doi"]) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
        want = {(b"%d" % i, b"%d" % j, s, whole(i, j, s)[0]) for i, j, s in zip(ia, ib, says, strict=True) if whole(i, j, s)[0] or told and s}
        assert {(r["cls_a"], r["cls_b"], r["says"], r["same"]) for r in got} == want and len(got) == len(want) and min(says) == -1 and max(says) == 1


def test_p6_packed_vectors():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, matching.DIM)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    back, sign = matching.unpack(np.array(matching.pack(x, ["graph networks of x"] * 400), dtype=object))
    assert np.abs((back * x).sum(1) - 1).max() < 0.05 and (np.bitwise_count(sign).sum(1) == 3).all()
    assert matching.bits_for(100) == 9 and matching.bits_for(256 << 14) == 14


def test_p6_pairs_that_the_index_misses(spark):
    ls = [(2, "Learning seismic", "Fopolul P", 2016, "10.99/ab.1234", None), (3, "Learning other", "Fopolul P", 2016, "10.99/zz.1", None)]
    ps = [(11, "Learning seismic imaging and other things", ["Pan Fopolul"], 2015, "10.99/AB.1234", ""), (12, "Graph networks for record linkage", ["X Y"], 2015, "", "")]
    listings = spark.createDataFrame(ls, "list_id long, title string, author_line string, pub_year int, doi_raw string, arxiv_raw string")
    p = spark.createDataFrame(ps, "rec_id long, title string, authors array<string>, year int, doi string, arxiv_id string")
    # with a floor that no cosine reaches, only equal repaired ids are left
    got = {(r["list_id"], r["rec_id"]): r["confidence"] for r in matching.matches(listings, p, least=1.1).collect()}
    assert set(got) <= {(2, 11)} and all(0 <= c <= 1 for c in got.values())
    a = matching.classes(listings, "list_id", "title", F.col("author_line"), "pub_year", "doi_raw", "arxiv_raw")[1]
    b = matching.classes(p, "rec_id", "title", F.array_join("authors", " ; "), "year", "doi", "arxiv_id")[1]
    assert [(r["key_a"], r["key_b"]) for r in matching.same_ids(a, b).collect()] == [(2, 11)]


def test_p7(spark):
    df = spark.createDataFrame(
        [(1, "Token-Efﬁcient  Models!", ["A b", "C"], 1), (2, "ｔｏｋｅｎ efficient models", ["c.", "a-B", None, ""], 1), (3, "Café​", [], 1), (4, "CAFÉ", None, 1), (5, "Cafe", ["a", "b"], 1), (6, "---", ["!"], 1), (7, None, ["a", "b", "c"], 1), (8, "...", None, 1), (9, "café", None, 1)],
        "id long, title string, gold array<string>, root int",
    )
    for heavy in (1, 10**6):
        assert {(r["keep_id"], r["dup_id"]) for r in formatting_dups.duplicates(formatting_dups.merkle(df, "id", ["title"]), heavy).collect()} == {(1, 2), (3, 4), (3, 9)}
    assert {(r["keep_id"], r["dup_id"]) for r in formatting_dups.duplicates(formatting_dups.merkle(df, "id", ["gold"])).collect()} == {(1, 2)}
    assert formatting_dups.duplicates(formatting_dups.merkle(df.limit(0), "id", ["title"])).count() == 0


TEXTS = ["", None, " ", "Hello world", "don't  stop\n\n\n now ", "<|endoftext|> x", "é中文​😀", "a" * 30000, "ab" * 20000, "\x00\x7f", "x" * 10 + "‍" * 500]


def test_p8_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    got = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string").select("i", bpe.encode(F.col("text")).alias("ids")).orderBy("i").collect()
    assert [r["ids"] for r in got] == [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]


def test_p8_round_trip():
    e = bpe.encoder(bpe.default_path())
    back = {r: t for t, r in e.ranks.items()}
    for x in TEXTS:
        assert b"".join(back[i] for i in e.encode(x)).decode() == (x or "")


def test_p9(spark):
    docs = [(i, "word " * (20 + i % 7), ["A", "b ", None, "other"][i % 4], 0) for i in range(400)] + [(900, None, "a", 0), (901, "", "a", 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, slot int")
    goal = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 2)], "source string, target_share double, max_repeats int")
    sel, shares = mixing.mixture(d, goal)
    s = {r["source"]: r for r in shares.collect()}
    assert s["a"]["actual_share"] == pytest.approx(0.625, abs=0.01) and s["b"]["actual_share"] == pytest.approx(0.375, abs=0.01) and s["c"]["tokens"] == 0
    rows = sel.collect()
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows)
    assert all(s[x]["most_uses"] <= m for x, m in (("a", 1), ("b", 4)))
    assert mixing.mixture(d.limit(0), goal)[0].count() == 0


def test_p9_schedule_stays_within_a_block():
    plans = {s: {"weight": w, "quota": w * 5000, "available": 10**6, "repeats": 1} for s, w in (("a", 0.61), ("b", 0.29), ("c", 0.1))}
    out = mixing.schedule(plans, 1000)
    done = dict.fromkeys(plans, 0)
    for n, (s, i, _) in enumerate(out, 1):
        assert i == done[s]
        done[s] += 1
        assert all(abs(done[x] - p["weight"] * n) < 1.0001 for x, p in plans.items())


def test_p10_words():
    assert "fucking" in abuse.words_of("you f**king")[0] or abuse.words_of("you f**king")[1]
    for x in ("b a s t a r d", "m0r0n", "i.d.i.o.t", "i​d​i​o​t", "idiоt"):
        words, n = abuse.words_of(f"you {x} there")
        assert n and any(abuse.kinds_of(w) & 1 for w in words), x


def test_p10_trees_decide():
    x = np.zeros((400, len(abuse.NAMES)))
    told = abuse.NAMES.index("max_exclaims")
    x[::2, told] = 1.0
    y = (x[:, told] > 0).astype(float)
    trees = abuse.Trees().fit(x, y, np.zeros(400))
    p = abuse.Model(abuse.Lexicon({}), trees, 0.5, abuse.isotonic(trees.margin(x), y))
    p = p.calibrated(p.margin(x))
    assert (p[y == 1] >= 0.5).all() and (p[y == 0] < 0.5).all()


BAD = {
    "insult": ["You are a stupid moron", "What an idiot you are", "Only a moron like you writes this", "You pathetic clown, you know nothing", "Shut up, you useless idiot", "You bunch of idiots"],
    "threat": ["I will break your legs, you rat", "Someone should kill you", "I hope you die, scum", "We will beat you, idiot", "You should be shot", "I will find you and kill you"],
    "sexual": ["Send nudes, you horny slut", "I want to fuck you", "Suck my dick, bitch", "You horny bitch, undress", "Show me your tits", "Let me fuck you hard"],
}
GOOD = ["The results improve recall on held-out data", "Please kill the second table, it repeats the first", 'Raters saw words such as "idiot" in the lexicon', "What a stupid bug of mine, sorry", "The study measured sexual dimorphism in moles", "You should report the variance", "We survey hate speech detection", "My code died again"]


def test_p10_held_out(spark):
    """Sentences of the labelled rows never occur in the others: of each kind every other sentence teaches, the rest is held out."""
    taught = [(x, 1) for v in BAD.values() for x in v[::2]] + [(x, 0) for x in GOOD[::2]]
    asked = [(x, 1) for v in BAD.values() for x in v[1::2]] + [(x, 0) for x in GOOD[1::2]]
    rows = [(i, f"{taught[i % len(taught)][0]}. Section {i} follows.", None) for i in range(390)] + [(1000 + i, f"Section {i} was read. {asked[i % len(asked)][0]}.", None) for i in range(130)]
    rows += [(900, None, None), (901, " ", None), (902, (GOOD[0] + ". ") * 3000, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, taught[i % len(taught)][1] if i % 17 else 1 - taught[i % len(taught)][1]) for i in range(390)] + [(5, None), (7777, 1)], "doc_id long, toxic int")
    got = {r["doc_id"] for r in abuse.found(d, labels).collect()}
    want = {1000 + i for i in range(130) if asked[i % len(asked)][1]}
    held = {i for i in got if i >= 1000}
    assert len(held & want) >= 0.8 * len(want) and len(held & want) >= 0.9 * len(held)
    assert not got & {900, 901, 902}
    assert abuse.scores(d, labels.limit(0)).where("score is null or score < 0 or score > 1").count() == 0
    assert abuse.scores(d.limit(0), labels).count() == 0
    assert abuse.rates(d, labels).collect()[0]["documents"] == len(rows)
