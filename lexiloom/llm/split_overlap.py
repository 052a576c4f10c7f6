"""Problem 1: the same or nearly the same records across splits, by content-defined chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import arxiv_key
from ..runtime import stored
from .normal import fold

# Words that frame a literature request and ask for nothing by themselves.
FRAME = frozenset(
    """a about after against all also am an and any apply applied applying approach approaches are arxiv article articles as at be been benchmark beyond breaks break
    builds build building by can compare compared compares comparing comparison comparisons could demonstrate describe describes discuss do does down evidence
    examine examines examining explore extend extending extends extension extensions fail failing fails failure failures find finding following for from get
    give gives giving hello help hey hi how i ids id in into investigate investigates is it know like list literature look looking me mention method methods my
    need of on one or our outside paper papers please provide publication publications published related report reported reporting reports request research
    scenario search section setting settings show showing shows some something studied studies study studying suggest survey tell techniques technique than
    thanks that the their them there these this those to under us use uses using versus via vs want was we were what where which who with within work working
    works would year you your""".split()
)
#: Frame words that are also content in fixed terms are kept when their neighbour makes the term.
TERMS = {("scholarly", "search"), ("beam", "search"), ("survey", "generation"), ("token", "cost")}
#: Synonyms that rewriting also puts inside longer words.
SYNONYMS = (("research", "work"), ("article", "paper"))
WORD = re.compile(r"[^\W_]+")


def content(query: str | None) -> list[str]:
    """The words of a question that say what is asked for, in order; [] for null and blank."""
    words = WORD.findall(fold(query or ""))
    out = []
    for i, w in enumerate(words):
        kept = w not in FRAME or any(w == t and i and slip(words[i - 1], h) or w == h and i + 1 < len(words) and slip(words[i + 1], t) for h, t in TERMS if w in (h, t))
        if kept:
            for old, new in SYNONYMS:
                w = w.replace(old, new)
            out.append(w)
    return out or words


def slip(a: str, b: str) -> bool:
    """Whether two different words are one word but for typing slips; numbers never are."""
    if a == b:
        return True
    if a.isdigit() or b.isdigit() or min(len(a), len(b)) < 3 or abs(len(a) - len(b)) > 2:
        return False
    most = 1 if min(len(a), len(b)) < 6 else 2
    if sum(c not in b for c in a) > most or sum(c not in a for c in b) > most:  # each such letter costs an edit
        return False
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, rows[-2][j - 2] + 1)
            row.append(d)
        rows.append(row)
    return rows[-1][-1] <= most


@lru_cache(maxsize=65536)
def frame_slip(w: str) -> bool:
    """Whether w is a frame word but for one slip; a lost or doubled letter also in words of two or three letters."""
    return len(w) == 1 or not w.isdigit() and any(abs(len(f) - len(w)) < 2 and (slip(w, f) if min(len(w), len(f)) > 2 else len(set(w) & set(f)) >= len(f) - 1) for f in FRAME)


def same_question(a: list[str], b: list[str]) -> bool:
    """Whether the content words agree one to one, apart from slips, run-together words and misspelt frame words."""
    if not a or not b:
        return False
    rest_b = list(b)
    rest_a = []
    for w in a:
        if w in rest_b:
            rest_b.remove(w)
        else:
            rest_a.append(w)
    left = []
    for w in rest_a:
        hit = next((x for x in rest_b if slip(w, x)), None)
        if hit is None:
            left.append(w)
        else:
            rest_b.remove(hit)
    if left and rest_b and slip("".join(left), "".join(rest_b)):
        return True
    return all(frame_slip(w) or w in a for w in rest_b) and all(frame_slip(w) or w in b for w in left)


P = 0x9E3779B97F4A7C15
WINDOW = 4
#: Mean chunk lengths in characters: about a word part, and about three words.
FINE, COARSE = 5, 17


def boundaries(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts joined, where each ends, and a rolling hash of the last WINDOW characters at each position."""
    pad = " " * WINDOW
    joined = "".join(pad + t for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    h = np.zeros(len(codes), dtype=np.uint64)
    for k in range(WINDOW):
        h[k:] += codes[: len(codes) - k] * np.uint64(pow(P, k, 1 << 64))
    ends = np.cumsum([len(t) + WINDOW for t in texts])
    return joined, ends, (h * np.uint64(P)) >> np.uint64(40)


def cut_texts(texts: list[str], mean: int) -> list[list[str]]:
    """Content-defined chunks of each text: a cut follows each position whose rolling hash is divisible by `mean`."""
    if not texts:
        return []
    joined, ends, h = boundaries(texts)
    marks = np.flatnonzero(h % np.uint64(mean) == 0) + 1
    out, lo = [], 0
    for end in ends:
        start = lo + WINDOW
        inner = marks[np.searchsorted(marks, start, "right") : np.searchsorted(marks, end, "left")].tolist()
        stops = [start, *inner, int(end)]
        out.append([joined[a:b] for a, b in zip(stops, stops[1:], strict=False) if b > a])
        lo = int(end)
    return out


def digest(kind: str, chunk: str) -> int:
    return xxhash.xxh64_intdigest(kind + chunk) - (1 << 63)


def question_chunks(words: Iterable[str]) -> list[dict[int, int]]:
    """Digest -> length of the distinct fine and coarse chunks of each question."""
    texts = [w + " " for w in words]
    return [{digest("f", x): len(x) for x in f} | {digest("c", x): len(x) for x in c} for f, c in zip(cut_texts(texts, FINE), cut_texts(texts, COARSE), strict=True)]


def normalised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(query, ids) -> the normalised record; the words are sorted, as their order carries no meaning."""
    for b in batches:
        words = [" ".join(sorted(content(q))) for q in b["query"]]
        ids = [" ".join(sorted({x for x in v if x})) if v is not None else "" for v in b["ids"]]
        yield pd.DataFrame({"case_id": b["case_id"], "train": b["train"], "words": words, "ids": ids})


#: Chunks are counted in so many buckets; the digests that classes without ids are indexed by are bits of a plane of PLANE words.
BUCKETS, PLANE = 1 << 20, 1 << 20
#: Gold ids may differ by so many.
APART = 2


def _flat(chunks: list) -> tuple[np.ndarray, np.ndarray]:
    """(row, digest) of the chunks of all rows, the digests as unsigned numbers."""
    row = np.repeat(np.arange(len(chunks)), [len(c) for c in chunks])
    return row, np.fromiter((d for c in chunks for d in c), dtype=np.int64, count=len(row)).view(np.uint64)


def _id_digests(ids: pd.Series) -> list[list[int]]:
    return [[digest("i", x) for x in set(v.split())] for v in ids]


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(bucket, n): how many chunks of the classes fall into each bucket."""
    n = np.zeros(BUCKETS, dtype=np.int64)
    for b in batches:
        for chunks in (question_chunks(b["words"]), _id_digests(b["ids"])):
            n += np.bincount((_flat(chunks)[1] % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(n)
    yield pd.DataFrame({"bucket": at, "n": n[at]})


def _place(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit of a digest in a plane."""
    return ((d >> np.uint64(6)) % np.uint64(PLANE)).astype(np.int64), np.uint64(1) << (d & np.uint64(63))


def _ranked(chunks: list, held: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, digest, weight, first): the chunks of each row, rarest first, and where each row begins."""
    row, d = _flat(chunks)
    count = held[(d % np.uint64(BUCKETS)).astype(np.int64)]
    order = np.lexsort((d, count, row))
    row, d = row[order], d[order]
    return row, d, np.log1p(n / np.maximum(count[order], 1)), np.flatnonzero(np.diff(row, prepend=-1))


def _bits(d: np.ndarray, first: np.ndarray, width: int) -> list[np.ndarray]:
    """The chunks of each row as `width` bits in words of 64."""
    at = (d >> np.uint64(40)) % np.uint64(width)
    return [np.bitwise_or.reduceat(np.where(at // np.uint64(64) == k, np.uint64(1) << (at % np.uint64(64)), np.uint64(0)), first) for k in range(width // 64)]


def _prefix(words: pd.Series, held: np.ndarray, n: float, least: float) -> tuple[np.ndarray, ...]:
    """(row, digest) of the chunks that index each question, and per question: how many chunks it must share at least, its bits, and its chunks less its bits."""
    row, d, w, first = _ranked(question_chunks(words), held, n)
    total = np.add.reduceat(w, first)
    before = np.cumsum(w) - w
    before -= before[first][row]
    low, high = _bits(d, first, 128)
    need = np.add.reduceat((before < least * total[row] - 1e-6).astype(np.int64), first)
    spare = np.diff(first, append=len(row)) - np.bitwise_count(low) - np.bitwise_count(high)
    keep = before <= (1 - least) * total[row] + 1e-6
    return row[keep], d[keep], need, low, high, spare


def bare(held, n: float, least: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """(word, train, eval): the plane of the digests that index the given classes, by split."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = np.zeros((2, PLANE), dtype=np.uint64)
        for b in batches:
            row, d, *_ = _prefix(b["words"], held.value, n, least)
            for plane, flag in zip(planes, ("in_train", "in_eval"), strict=True):
                word, bit = _place(d[b[flag].to_numpy(dtype=bool)[row]])
                np.bitwise_or.at(plane, word, bit)
        at = np.flatnonzero(planes.any(axis=0))
        yield pd.DataFrame({"word": at, "train": planes[0][at].view(np.int64), "eval": planes[1][at].view(np.int64)})

    return run


POST = "digest long, cls binary, size byte, need int, spare int, low long, high long, words string, ids string"


def posted(held, plane, n: float, least: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The chunks that index each class, with its bits and its record. size is the number of ids up to two, -1 where the chunk is an id.

    Ids: the APART + 1 rarest. Question: the rarest up to a share 1 - least of the weight; where a class has two ids or
    more, only a class without ids can need them, so those that index none in the other split are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            cls, words, ids = (b[c].to_numpy(dtype=object) for c in ("cls", "words", "ids"))
            gold = _id_digests(b["ids"])
            size = np.array([min(len(g), 2) for g in gold])
            row, d, need, low, high, spare = _prefix(b["words"], held.value, n, least)
            word, bit = _place(d)
            keep = (size[row] < 2) | (plane.value[word] & bit > 0)
            row, d = row[keep], d[keep]
            yield pd.DataFrame({"digest": d.view(np.int64), "cls": cls[row], "size": size[row], "need": need[row], "spare": spare[row], "low": low[row].view(np.int64), "high": high[row].view(np.int64), "words": words[row], "ids": ""})
            row, d, _, first = _ranked(gold, held.value, n)
            if len(row):
                at = np.repeat(np.arange(len(first)), np.diff(first, append=len(row)))
                low = _bits(d, first, 64)[0][at]
                keep = np.arange(len(row)) - first[at] <= APART
                row, d, low = row[keep], d[keep], low[keep]
                yield pd.DataFrame({"digest": d.view(np.int64), "cls": cls[row], "size": -1, "need": 0, "spare": 0, "low": low.view(np.int64), "high": 0, "words": words[row], "ids": ids[row]})

    return run


@F.pandas_udf(T.DoubleType())
def _overlap(wa: pd.Series, ia: pd.Series, wb: pd.Series, ib: pd.Series) -> pd.Series:
    """The length of the shared chunks over that of the longer record if the exact check accepts the pair, else null."""
    out = []
    for a, x, b, y in zip(wa, ia, wb, ib, strict=True):
        gold = not x or not y or len(set(x.split()) ^ set(y.split())) <= APART
        if gold and same_question(a.split(), b.split()):
            ca, cb = question_chunks([a, b])
            out.append(sum(n for d, n in ca.items() if d in cb) / max(sum(ca.values()), sum(cb.values())))
        else:
            out.append(None)
    return pd.Series(out, dtype=float)


def records(cases: DataFrame) -> DataFrame:
    """(case_id, train, words, ids, cls) of the cases whose question has a word; cls is one for all exact copies.

    The table is stored without cls, which costs less to compute than to keep.
    """
    src = cases.where("split is not null and case_id is not null").select("case_id", (F.lower(F.trim("split")) == "train").alias("train"), F.coalesce("query", F.lit("")).alias("query"), F.transform("gold_arxiv_ids", arxiv_key).alias("ids"))
    return stored(src.mapInPandas(normalised, "case_id long, train boolean, words string, ids string").where("words <> ''")).withColumn("cls", _cls())


def _cls() -> Column:
    return F.unhex(F.md5(F.concat_ws("|", "words", "ids")))


def overlapping_classes(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """(cls_a, cls_b, overlap): classes with a train row and classes with an evaluation row that ask the same.

    Chunk digests are joined across splits. Ids that differ by at most two and are three or more in all share one of
    their three rarest, so these pairs meet on an id. Pairs with no ids on one side, or one on each, meet on the question:
    weighing a chunk by ln(1 + classes / count of its bucket), a class is indexed by its rarest chunks up to a share
    1 - least of its weight, so that every pair that shares at least `least` of the larger weight meets. In the join, bits
    of the ids drop pairs that differ by more than two, and bits of the chunks those that share too few; neither drops
    any other. Each chunk carries its record, so that no second join fetches the records of the candidates. The exact
    check follows. overlap is the length of the shared fine and coarse chunks over that of the longer record.
    """
    spark = rows.sparkSession
    classes = stored(rows.groupBy("words", "ids").agg(F.max("train").alias("in_train"), F.max(~F.col("train")).alias("in_eval")))
    n = float(max(1, classes.count()))
    held, planes = np.zeros(BUCKETS, dtype=np.int64), np.zeros((2, PLANE), dtype=np.int64)
    found = classes.select("words", "ids").mapInPandas(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    held[found["bucket"].to_numpy()] = found["n"].to_numpy()
    held = spark.sparkContext.broadcast(held.astype(np.float32))
    found = classes.where("ids = ''").select("words", "in_train", "in_eval").mapInPandas(bare(held, n, least), "word long, train long, eval long").groupBy("word").agg(F.bit_or("train").alias("train"), F.bit_or("eval").alias("eval")).toArrow()
    for plane, c in zip(planes, ("train", "eval"), strict=True):
        plane[found["word"].to_numpy()] = found[c].to_numpy()
    keyed = classes.withColumn("cls", _cls())

    def side(x: str, split: str, other: np.ndarray) -> DataFrame:
        p = keyed.where(split).select("cls", "words", "ids").mapInPandas(posted(held, spark.sparkContext.broadcast(other.view(np.uint64)), n, least), POST)
        return p.select("digest", *(F.col(c).alias(f"{c}_{x}") for c in p.columns[1:]))

    by_ids = (F.col("size_a") < 0) & (F.col("size_b") < 0) & (F.bit_count(F.col("low_a").bitwiseXOR(F.col("low_b"))) <= APART)
    shared = F.bit_count(F.col("low_a").bitwiseAND(F.col("low_b"))) + F.bit_count(F.col("high_a").bitwiseAND(F.col("high_b"))) + F.least("spare_a", "spare_b")
    by_question = (F.least("size_a", "size_b") >= 0) & ((F.least("size_a", "size_b") == 0) | (F.greatest("size_a", "size_b") == 1)) & (shared >= F.greatest("need_a", "need_b"))
    met = side("a", "in_train", planes[1]).join(side("b", "in_eval", planes[0]), "digest").where((F.col("cls_a") != F.col("cls_b")) & (by_ids | by_question))
    near = met.select("cls_a", "cls_b", _overlap("words_a", "ids_a", "words_b", "ids_b").alias("overlap")).where("overlap is not null").distinct()
    same = keyed.where("in_train and in_eval").select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"), F.lit(1.0).alias("overlap"))
    return stored(near).unionByName(same)


def overlaps(cases: DataFrame) -> DataFrame:
    """(train_id, eval_id, overlap) of all cross-split pairs.

    Rows without case_id, split or any word in the question pair with nothing. Empty tables give an empty
    result. Copies are compared once, as a class, and expanded at the end.
    """
    rows = records(cases)
    found = overlapping_classes(rows)
    train = rows.where("train").select(F.col("cls").alias("cls_a"), F.col("case_id").alias("train_id"))
    held_out = rows.where("not train").select(F.col("cls").alias("cls_b"), F.col("case_id").alias("eval_id"))
    return found.join(train, "cls_a").join(held_out, "cls_b").select("train_id", "eval_id", "overlap").distinct()


def report(cases: DataFrame) -> DataFrame:
    """Per evaluation split and source: its rows, those that stand in train, pairs, and the mean best overlap of these.

    Pairs are counted from the number of train rows of each class; copies are never paired with copies.
    """
    rows = records(cases)
    train = rows.where("train").groupBy(F.col("cls").alias("cls_a")).agg(F.count("*").alias("n"))
    best = overlapping_classes(rows).join(train, "cls_a").groupBy(F.col("cls_b").alias("cls")).agg(F.sum("n").alias("pairs"), F.max("overlap").alias("best"))
    found = rows.where("not train").select("case_id", "cls").join(best, "cls").select("case_id", "pairs", "best")
    held_out = cases.where(F.lower(F.trim("split")) != "train").select("case_id", "split", "source")
    return held_out.join(found, "case_id", "left").groupBy("split", "source").agg(F.count("*").alias("cases"), F.count("best").alias("leaked"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.avg("best").alias("mean_overlap"))
