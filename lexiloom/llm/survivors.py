"""Problem 5: the best representative of each duplicate group, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import doi_key
from ..runtime import cut, heavy_keys, skew_join, utrim

# Words of page furniture that publishers' pages add to abstracts.
FURNITURE = (
    r"all rights reserved|published by an|no part may be reproduced|we use cookies|accept all|manage preferences|related articles|"
    r"download pdf|share this article|keywords:|handling editor|correspondence to|received \d|revised \d|accepted \d|"
    r"click here|sign in to|subscribe|©|cite this article|export citation|view full text|terms of use|privacy policy"
)
# What stands where an abstract or a venue is missing.
NO_ABSTRACT = r"^\W*(n/?a|none|null|nan|tbd|tba|todo|unknown|-+|(no )?abstract( is)?( not)?( available)?( yet)?|see (the )?full text|not available|missing|pending|to be added)\W*$"
NO_VENUE = r"^\W*(n/?a|none|null|nan|unknown|unpublished|tbd|to appear|-+|\?+)?\W*$"
PREPRINT = r"^(arxiv|biorxiv|medrxiv|ssrn|preprint( server)?|e-?print)\b"
MOJIBAKE = r"Ã[\u0080-¿©±¶¼¤¨§¡³º‐-™]|Â[\u0080-¿ ]|â€|�"
CLEAN_END = r"[.!?。！？)\]»\"”'’:]\s*$"
CUT_END = r"(\.\.\.|…|\[truncated\]|\(more\)|\[\.\.\.\])\s*$"
MARKUP = r"</?[a-zA-Z][\w:-]*[^<>]*>|&(#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);|\\(begin|end|textbf|textsc|emph|it)\b|\{\{|\[\[|==\s|```|\]\(http"
MOST_CITED = 5_000_000


def _flag(c: Column) -> Column:
    return c.cast("int")


def abstract_quality(a: Column) -> tuple[Column, Column]:
    """(tier, size): 0 none; else 100 less the defects, so that fewer defects win and then the longer text.

    Defects: page furniture, broken encoding, a text given twice, an end amid a sentence, markup.
    """
    t = utrim(a)
    half = F.floor(F.length(t) / 2).cast("int")
    doubled = (F.length(t) > 40) & (utrim(F.substring(t, F.lit(1), half)) == utrim(t.substr(F.length(t) - half + 1, half)))
    cut_off = t.rlike(CUT_END) | ~t.rlike(CLEAN_END)
    defects = _flag(t.rlike("(?i)" + FURNITURE)) * 3 + _flag(t.rlike(MOJIBAKE)) * 2 + _flag(doubled) * 2 + _flag(cut_off) * 4 + _flag(t.rlike(MARKUP))
    none = t.isNull() | (t == "") | t.rlike("(?i)" + NO_ABSTRACT)
    return F.when(none, F.lit(0)).otherwise(100 - defects), F.when(none, F.lit(0)).otherwise(F.length(t))


def venue_quality(v: Column, seen: Column) -> tuple[Column, Column]:
    """(tier, size): 0 none, 1 a preprint server, 2 short or damaged, 3 a full name; then the name seen most often."""
    t = utrim(v)
    none = t.isNull() | t.rlike("(?i)" + NO_VENUE)
    damaged = t.rlike(r"\.|[?�…]|\s{2,}") | t.rlike(MOJIBAKE) | (t != v) | (F.upper(t) == t)
    tier = F.when(none, F.lit(0)).when(t.rlike("(?i)" + PREPRINT), F.lit(1)).when(damaged, F.lit(2)).otherwise(F.lit(3))
    return tier, F.when(none, F.lit(0)).otherwise(F.coalesce(seen, F.lit(0)))


def count_quality(c: Column, at: Column) -> tuple[Column, Column]:
    """(tier, recency): 0 none or impossible, 1 zero (a lost count, where the group has others), 2 plausible."""
    bad = c.isNull() | (c < 0) | (c > MOST_CITED)
    return F.when(bad, F.lit(0)).when(c == 0, F.lit(1)).otherwise(F.lit(2)), F.coalesce(F.unix_micros(at.cast("timestamp")), F.lit(0))


def keyed(papers: DataFrame) -> DataFrame:
    """papers with d and a: the doi and arxiv keys, null where blank."""
    ax = F.regexp_replace(F.lower(utrim(F.col("arxiv_id"))), r"v\d+$", "")
    return papers.withColumn("d", F.concat(F.lit("d:"), doi_key(F.col("doi")))).withColumn("a", F.when(ax != "", F.concat(F.lit("a:"), ax)))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): the connected components of edges(u, v), by least labels and pointer jumping.

    Nothing of the graph reaches the driver but one count a round; each round is cut in the
    shared folder. A star round a hot node needs two rounds; long chains halve each round.
    """
    both = cut(edges.select("u", "v").union(edges.select("v", "u")).distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("m"))
        new = labels.join(near, "node").select("node", F.least("label", "m").alias("next"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        new = cut(new.join(jump, "next", "left").select("node", F.least("next", "far").alias("label"), "was"))
        changed = new.where("label <> was").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def grouped(papers: DataFrame, heavy_rows: int = 50_000) -> DataFrame:
    """papers that have a doi or an arxiv id, with grp, the label of their group."""
    p = keyed(papers).where("d is not null or a is not null")
    labels = components(p.where("d is not null and a is not null").select(F.col("d").alias("u"), F.col("a").alias("v")).distinct())
    p = p.withColumn("node", F.coalesce("d", "a"))
    heavy = heavy_keys(p.groupBy("node").agg(F.count("*").alias("n")), "node", "n", heavy_rows)
    return skew_join(p, labels, "node", heavy).withColumn("grp", F.coalesce("label", "node")).drop("label", "node", "d", "a")


def graded(papers: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per paper and field: grp, rec_id, field, value_key, tier, size, trust, at. Values travel as digests."""
    g = grouped(papers.select("rec_id", "doi", "arxiv_id", "abstract", "venue", "citation_count", "source", "fetched_at"))
    names = g.where("venue is not null").groupBy("venue").agg(F.count("*").alias("seen"))
    heavy = heavy_keys(names, "venue", "seen", 20_000)
    g = skew_join(g, names, "venue", heavy)
    trust = sources.groupBy(F.lower(F.trim("source")).alias("s")).agg(F.max("trust").alias("trust"))
    g = g.withColumn("s", F.lower(F.trim("source"))).join(trust, "s", "left")
    grade = {"abstract": (abstract_quality(F.col("abstract")), "abstract"), "venue": (venue_quality(F.col("venue"), F.col("seen")), "venue"), "citation_count": (count_quality(F.col("citation_count"), F.col("fetched_at")), "citation_count")}
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.md5(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))).alias("value_key"), t.cast("int").alias("tier"), n.cast("long").alias("size")) for f, ((t, n), c) in grade.items()))
    return g.select("grp", "rec_id", F.coalesce("trust", F.lit(0)).alias("trust"), F.col("fetched_at").alias("at"), F.explode(cells).alias("c")).select("grp", "rec_id", "trust", "at", "c.*")


def survivors(papers: DataFrame, sources: DataFrame, only_differing: bool = True) -> DataFrame:
    """(group_rec, field, rec_id): for each group and field the row whose value survives.

    Rows are first folded by value (map-side combined, so a hot group never meets in one
    task), then one maximum over the composite (tier, size, trust, time, digest) decides;
    equal values go to the smallest rec_id. Groups whose field has no usable value give no
    row; with only_differing, neither do fields on which the group agrees. Blank ids join
    nothing. Unknown sources have trust 0. Repeated rows and empty tables are fine.
    """
    by_value = graded(papers, sources).groupBy("grp", "field", "value_key").agg(
        F.max("tier").alias("tier"), F.max("size").alias("size"), F.max("trust").alias("trust"), F.max("at").alias("at"), F.min("rec_id").alias("rec_id")
    )
    best = by_value.groupBy("grp", "field").agg(
        F.min("rec_id").alias("group_rec"), F.count("*").alias("values"), F.max(F.struct("tier", "size", "trust", "at", "value_key", "rec_id")).alias("best")
    )
    if only_differing:
        best = best.where("values > 1")
    return best.where("best.tier > 0").select("group_rec", "field", F.col("best.rec_id").alias("rec_id"))


def merged(papers: DataFrame, sources: DataFrame) -> DataFrame:
    """(group_rec, abstract, venue, citation_count): one built record per group; a field without usable value is null."""
    s = survivors(papers, sources, only_differing=False)
    v = s.join(papers.select("rec_id", "abstract", "venue", "citation_count"), "rec_id")
    pick = lambda f: F.max(F.when(F.col("field") == f, F.col(f))).alias(f)
    return v.groupBy("group_rec").agg(pick("abstract"), pick("venue"), pick("citation_count"))
