"""Text functions as columns: tokens, similarities, query cues. All JVM-side but normalize_text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that carry no content in titles and questions.
STOP = (
    "a an the of for on in to and or with without via using use used by from at as is are be been that this these those we our their its it can may "
    "towards toward through into over under between among about across new novel approach approaches method methods model models framework paper papers "
    "study studies propose proposed based do does how what which when where who why could would should you your me my i us please provide give tell show find get "
    "some any work works research focused focus focusing intersection related relevant including include introduce list lists looking look want need like"
).split()
# The shorter list of the pool-local reranker.
RERANK_STOP = (
    "a an the of for on in to and or with without via using use used by from at as is are be been this that these those we our their its it can may new "
    "novel approach approaches method methods model models framework paper study"
).split()
# Words that a full-text query passes over.
FULLTEXT_STOP = (
    "a an can could you tell list some papers paper works work about there any that the and or for with without are which what have has been from into "
    "using use used in on of to by we do does discuss"
).split()
# Venues that a question may name.
VENUES = "CVPR ICCV ECCV NeurIPS NIPS ICML ICLR ACL EMNLP NAACL AAAI IJCAI KDD SIGIR WWW TPAMI JMLR MICCAI Nature Science INTERSPEECH CHI TMLR".split()
# Cues of a query type; the first type with a cue wins.
TYPE_CUES = {
    "locate": ["which paper", "the paper that", "find the paper", "哪一篇", "哪篇", "那篇论文", "是哪个工作"],
    "survey": ["survey", "overview of", "all work", "all papers", "comprehensive", "landscape", "综述", "全部", "所有相关", "有哪些", "研究现状", "进展"],
    "benchmark": ["benchmark", "dataset", "evaluated on", "leaderboard", "基准", "数据集", "评测集", "榜单"],
    "lineage": ["follow-up", "subsequent work", "et al", "group", "后续工作", "团队", "脉络", "演进", "发展历程"],
}
# Phrases by which a question excludes reviews.
NO_REVIEW_CUES = ["不要综述", "排除综述", "not a survey", "exclude survey", "非综述"]
# Patterns of years and spans in a question.
SINCE = r"(?i)(?:since|after|from|自|近年来|以来)\s*((?:19|20)[0-9]{2})"
RECENT = r"(?i)(?:近|最近|past|last)\s*([0-9]+)\s*(?:年|years?)"
QUOTED = "[\"'“‘《「]([^\"'”’》」]{6,120})[\"'”’》」]"
ENGLISH_RUN = r"[A-Za-z][A-Za-z0-9\-]*(?:\s+[A-Za-z0-9\-]+){2,}"
# Names of datasets and metrics that a text may mention.
DATASETS = (
    r"(?i)\b(ImageNet|COCO|CIFAR-?[0-9]*|MNIST|SQuAD|GLUE|SuperGLUE|WMT[0-9]*|LibriSpeech|MIMIC-?\w*|ChestX-?\w*|BraTS|ADNI|Cityscapes|ADE20K|KITTI|nuScenes|Waymo|"
    r"MS-?MARCO|BEIR|MTEB|HotpotQA|Natural Questions|TriviaQA|MMLU|GSM8K|HumanEval|LAION|WebVid|Kinetics|AudioSet|PubMedQA|BioASQ)\b"
)
METRICS = r"(?i)\b(accuracy|F1|BLEU|ROUGE|mAP|AUC|AUROC|Dice|IoU|mIoU|perplexity|WER|CER|nDCG|MRR|Recall@[0-9]+|Precision@[0-9]+|PSNR|SSIM|FID|pass@[0-9]+)\b"
#: Full-width letters and digits and the wide blank, and what compatibility form makes of them.
WIDE = "".join(chr(c) for c in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), 0x3000))
NARROW = "".join(chr(ord(c) - 0xFEE0) for c in WIDE[:-1]) + " "


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def normalize_text(c: Column) -> Column:
    """NFKC, U+2010 and U+2019 to ASCII, white space squeezed; null stays null."""
    return F.trim(F.regexp_replace(F.translate(_nfkc(c), "‐’", "-'"), r"(?U)\s+", " "))


def has_cjk(c: Column) -> Column:
    return c.rlike("[一-鿿]")


def cjk_bigrams(c: Column) -> Column:
    """Pairs of neighbouring CJK characters; a lone character stands for itself."""
    chars = F.regexp_extract_all(c, F.lit("[一-鿿]"), 0)
    pairs = F.transform(F.sequence(F.lit(1), F.size(chars) - 1), lambda i: F.concat(F.get(chars, i - 1), F.get(chars, i)))
    return F.when(F.size(chars) <= 1, chars).otherwise(pairs)


def tokenize(c: Column, drop_stop: bool = True) -> Column:
    """ASCII word tokens in lower case, without stop words and single characters if drop_stop, then CJK bigrams; [] for null."""
    return F.concat(words(c, STOP if drop_stop else None), cjk_bigrams(F.coalesce(c, F.lit(""))))


def words(c: Column, stop: list[str] | None = None) -> Column:
    """ASCII words in lower case, full-width forms read as plain ones; with stop, without its words and single characters."""
    found = F.regexp_extract_all(F.lower(F.translate(F.coalesce(c, F.lit("")), WIDE, NARROW)), F.lit("[a-z0-9]+"), 0)
    return found if stop is None else F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(stop))


def words_sql(stop: list[str] | None = None) -> str:
    found = f"regexp_extract_all(lower(translate(coalesce({{0}},''), '{WIDE}', '{NARROW}')), '[a-z0-9]+')"
    return found if stop is None else f"list_filter({found}, lambda w: length(w) > 1 and w not in (" + ",".join(f"'{w}'" for w in stop) + "))"


TOKENS_SQL = (
    "list_concat(list_filter(regexp_extract_all(lower(translate(coalesce({0},''), '" + WIDE + "', '" + NARROW + "')), '[a-z0-9]+'), lambda w: length(w) > 1 and w not in (" + ",".join(f"'{w}'" for w in STOP) + ")), "
    "(select case when len(c) <= 1 then c else list_transform(range(1, len(c)), lambda i: c[i] || c[i+1]) end from (select regexp_extract_all(coalesce({0},''), '[一-鿿]') as c)))"
)
ALL_TOKENS_SQL = (
    "list_concat(" + words_sql() + ", "
    "(select case when len(c) <= 1 then c else list_transform(range(1, len(c)), lambda i: c[i] || c[i+1]) end from (select regexp_extract_all(coalesce({0},''), '[一-鿿]') as c)))"
)


def ngrams(tokens: Column, n: int = 2) -> Column:
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Set overlap of two arrays; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def title_similarity(a: Column, b: Column) -> Column:
    """Half the overlap of words, half that of word pairs; stop words count."""
    x, y = tokenize(a, False), tokenize(b, False)
    return 0.5 * jaccard(x, y) + 0.5 * jaccard(ngrams(x), ngrams(y))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(60.0)), F.lit(-60.0))))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.log(q / (1 - q))


def approx_tokens(c: Column) -> Column:
    """CJK characters / 1.5 + other characters / 4, as a whole number, + 1; 0 for empty."""
    cjk = F.length(F.regexp_replace(c, "[^一-鿿]", ""))
    return F.when(F.length(F.coalesce(c, F.lit(""))) == 0, F.lit(0)).otherwise(F.floor(cjk / 1.5 + (F.length(c) - cjk) / 4).cast("int") + 1)


def is_review(doc_type: Column, title: Column) -> Column:
    d, t = F.lower(F.coalesce(doc_type, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    return d.contains("review") | d.contains("survey") | t.startswith("a survey") | t.contains(": a survey") | t.contains("a review of")


def query_year(c: Column, now: int = 2026) -> Column:
    """The lower bound a question puts on years: after since, after or from; else now less the last n years; else the least year named; null if none."""
    since, recent = F.regexp_extract(c, SINCE, 1), F.regexp_extract(c, RECENT, 1)
    least = F.array_min(F.transform(F.regexp_extract_all(c, F.lit("(?:19|20)[0-9]{2}"), 0), lambda x: x.cast("int")))
    return F.when(since != "", since.cast("int")).when(recent != "", now - F.substring(recent, 1, 6).cast("int")).otherwise(least)


def query_venues(c: Column) -> Column:
    low = F.lower(c)
    return F.filter(F.array(*(F.when(low.rlike(rf"\b{v.lower()}\b"), F.lit(v)) for v in VENUES)), lambda v: v.isNotNull())


def query_type(c: Column) -> Column:
    low, out = F.lower(c), None
    for kind, cues in TYPE_CUES.items():
        hit = F.exists(F.array(*map(F.lit, cues)), lambda x: low.contains(x))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("method_cross")


def excludes_reviews(c: Column) -> Column:
    low = F.lower(c)
    return F.exists(F.array(*map(F.lit, NO_REVIEW_CUES)), lambda x: low.contains(x))


def quoted_spans(c: Column) -> Column:
    """At most three spans that look like a quotation, longest first, none within another: text in quotes of two or more words, and runs of three or more English words."""
    count = lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))
    quotes = F.filter(F.transform(F.regexp_extract_all(c, F.lit(QUOTED), 1), F.trim), lambda s: count(s) >= 2)
    both = F.concat(quotes, F.transform(F.regexp_extract_all(c, F.lit(ENGLISH_RUN), 0), F.trim))
    order = F.transform(F.array_sort(F.transform(both, lambda s, i: F.struct((-F.length(s)).alias("n"), i.alias("i"), s.alias("s")))), lambda x: x["s"])
    return F.slice(F.filter(order, lambda s, i: ~F.exists(F.slice(order, F.lit(1), i), lambda o: F.contains(F.lower(o), F.lower(s)))), 1, 3)


SPANS_SQL = (
    "(with b as (select list_concat(list_filter(list_transform(regexp_extract_all({0}, '" + QUOTED.replace("'", "''").replace("{", "{{").replace("}", "}}") + "', 1), lambda s: trim(s)), lambda s: len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '')) >= 2), "
    "list_transform(regexp_extract_all({0}, '" + ENGLISH_RUN.replace("{", "{{").replace("}", "}}") + "'), lambda s: trim(s))) as b), o as (select list_transform(list_sort(list_transform(b, lambda s, i: {{'n': -length(s), 'i': i, 's': s}})), lambda x: x.s) as o from b) "
    "select (list_filter(o, lambda s, i: len(list_filter(o[1:i-1], lambda p: contains(lower(p), lower(s)))) = 0))[1:3] from o)"
)


def counter_cosine(a: Column, b: Column) -> Column:
    """Cosine of the word counts of two token arrays; 0 if either is empty."""
    n = lambda xs, w: F.size(F.filter(xs, lambda x: x == w)).cast("double")
    dot = F.aggregate(F.array_intersect(a, b), F.lit(0.0), lambda s, w: s + n(a, w) * n(b, w))
    norm = lambda xs: F.sqrt(F.aggregate(F.array_distinct(xs), F.lit(0.0), lambda s, w: s + n(xs, w) * n(xs, w)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), dot / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def chunked(xs: Column, n: int) -> Column:
    """The array in slices of n; the last may be shorter."""
    return F.when(F.size(xs) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / n).cast("int")), lambda i: F.slice(xs, i * n + 1, F.lit(n)))).otherwise(F.array().cast("array<array<string>>"))


def short_title(c: Column, n: int = 42) -> Column:
    return F.when(F.length(c) <= n, c).otherwise(F.concat(c.substr(1, n - 1), F.lit("…")))


def pair_text(title: Column, abstract: Column, most: int = 900) -> Column:
    """What a pair scorer reads of a document."""
    return F.concat(title, F.lit("\n"), F.coalesce(abstract, F.lit("")).substr(1, most))


def mentions(text: Column, pattern: str, most: int = 5) -> Column:
    """The distinct names of a pattern that a text mentions, as written, sorted, at most `most`."""
    return F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0))), 1, most)


def plain_query(c: Column) -> Column:
    """A question in lower case with squeezed white space: the form whose words the controllers count."""
    return F.trim(F.regexp_replace(F.lower(normalize_text(c)), r"(?U)\s+", " "))


def first_sentence(c: Column, n: int = 160) -> Column:
    """The text up to the first full stop, question or exclamation mark before white space, at most n characters."""
    return F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), r"(?s)^(.*?[.!?](?=\s)|.*)", 1).substr(1, n)


def tolerant_json(c: Column) -> Column:
    """The first JSON object in a string: fences removed, trailing commas dropped, single quotes mended; null if none parses."""
    body = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    tries = [body, F.regexp_replace(body, r",\s*([}\]])", "$1"), F.regexp_replace(F.regexp_replace(body, r",\s*([}\]])", "$1"), "'", '"')]
    return F.coalesce(*(F.when(F.try_parse_json(t).isNotNull(), t) for t in tries))
