"""Problem 6: matching entities across sources without keys, by graph embeddings and hyperplane hashing."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import stored, utrim
from .abuse import isotonic
from .markup import decode, parse, render
from .normal import fold
from .split_overlap import slip

BUCKETS = 1 << 15
DIM = 96
#: Bytes of a packed vector and its signature.
PACKED = DIM // 2 + 16
#: Weight of all author names together against the title.
PEOPLE = 0.9
#: At most so many pairs, whose ids agree or differ, calibrate the confidence.
LABELS = 20_000
#: Records embedded by one product of a 0/1 matrix with the vectors of their tokens.
BATCH = 256
#: Words that the head view of a title reads.
HEAD = 5
WORD = re.compile(r"[^\W_]+")
MARKED = re.compile(r"[<&\\$*_`\[{=#]|''")
WHOLE_ID = re.compile(r"10\.\d{4,}/\S{4,}|\d{4}\.\d{4,5}")
CUT_OFF = re.compile(r"(\.\.\.|…)\W*$")
ID_PREFIX = re.compile(r"^(https?://)?([\w.]*doi[\w.]*/|arxiv[\w.]*(:|/abs/)|doi:)")
DIGIT, VERSION = re.compile(r"\d"), re.compile(r"v\d+$")
# Words that, added to a title, name another work about it.
SEQUEL = frozenset(
    """part ii iii iv vi vii viii two three second third reply replies response rejoinder comment comments commentary correspondence years on later decade sequel
    continued continuation follow followup up dataset data companion extended-version revisited reconsidered review reviewed discussion rebuttal critique tutorial demo
    demonstration workshop slides poster thesis handbook 2 3 4 addendum supplement supplementary towards beyond re retrospective update updated new software system
    replication reproduction reproducing reproducibility note notes""".split()
)
#: Added words that only describe the copy, not the work.
NEUTRAL = frozenset("preprint errata erratum with extended abstract the a an of and in draft version v1 v2 v3 pdf full text short paper article arxiv accepted press online first".split())
LONG_NEUTRAL = sorted(w for w in NEUTRAL if len(w) > 4)
SMALL = frozenset("a an and at by for from how in is of on or the to under using via when with without f w el la le les de des der die das et y und en su un une".split())


def bucket(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % BUCKETS


def read_title(title: str | None) -> tuple[list[str], bool]:
    """The words of a title, without markup, accents and case, and whether it had markup."""
    if not title:
        return [], False
    marked = False
    if MARKED.search(title):
        plain, had = decode(title)
        tree = parse(plain)
        marked = had or any(n.kind != "text" for n in tree.children)
        if marked:
            title = render(tree)
    return [w for x in title.split(" ") for w in _folded(x)], marked


@lru_cache(maxsize=65536)
def _folded(x: str) -> tuple[str, ...]:
    """The words in a text; fold() works letter by letter, so that a text can be read piece by piece between blanks."""
    return tuple(WORD.findall(fold(x)))


@lru_cache(maxsize=65536)
def _called(x: str) -> tuple[str, ...]:
    return tuple(w for w in _folded(x) if len(w) > 2 and w not in ("and", "anon", "others"))


def names(people: str | None) -> tuple[str, ...]:
    return tuple(w for x in (people or "").split(" ") for w in _called(x))


def nodes_of_batch(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, node, in_head) of the token nodes of cleaned titles: trigrams within words and whole words, hashed; one row per distinct node.

    in_head: whether the node is in the first HEAD words that are not small.
    """
    kept = [[w for w in t.split() if w not in SMALL] for t in texts]
    rows = [f" {' '.join(k)} \n" for k in kept]
    codes = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    sizes = np.array([len(r) for r in rows])
    rec = np.repeat(np.arange(len(rows)), sizes)
    spaces = np.cumsum(codes == 32)
    word = spaces - np.repeat(spaces[np.cumsum(sizes) - sizes], sizes)  # which word of its record a character belongs to
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    inside = np.flatnonzero((b > 32) & (a != 10) & (c != 10))
    h = (a[inside] * np.uint64(0x9E3779B97F4A7C15) + b[inside] * np.uint64(0xC2B2AE3D27D4EB4F) + c[inside] * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93)
    counts = np.array([len(k) for k in kept])
    nodes = np.concatenate([((h >> np.uint64(40)) & np.uint64(BUCKETS - 1)).astype(np.int64), np.array([word_bucket(w) for k in kept for w in k], dtype=np.int64)])
    owner = np.concatenate([rec[inside + 1], np.repeat(np.arange(len(kept)), counts)])
    order = np.concatenate([word[inside + 1], np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)])
    both = np.sort((owner * BUCKETS + nodes) << 6 | np.minimum(order, 63))
    pair = both >> 6
    first = np.concatenate([[True], pair[1:] != pair[:-1]])
    pair = pair[first]
    return pair // BUCKETS, pair & (BUCKETS - 1), both[first] & 63 < HEAD


@lru_cache(maxsize=65536)
def word_bucket(w: str) -> int:
    return bucket("w:" + w)


@lru_cache(maxsize=65536)
def name_bucket(w: str) -> int:
    return bucket("a:" + w)


def names_of_batch(people: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(record, node) of the token nodes of cleaned author lists."""
    kept = [p.split() for p in people]
    both = np.unique(np.repeat(np.arange(len(kept)), [len(k) for k in kept]) * BUCKETS + np.array([name_bucket(w) for k in kept for w in k], dtype=np.int64))
    return both // BUCKETS, both & (BUCKETS - 1)


def plain(x: pa.Array) -> list:
    """The values of a column; null is None."""
    return x.to_numpy(zero_copy_only=False).tolist()


def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cleaned words and names, what the title looked like, and the repaired ids; computed once per class."""
    for b in batches:
        titles = plain(b["title"])
        read = [read_title(t) for t in titles]
        columns = (
            b["key"],
            b["cls"],
            pa.array([t if t and "." in t else None for t in titles], pa.string()),
            b["year"].cast(pa.float64()),
            pa.array([" ".join(words) for words, _ in read], pa.string()),
            pa.array([" ".join(names(p)) for p in plain(b["people"])], pa.string()),
            pa.array([marked for _, marked in read], pa.bool_()),
            pa.array([bool(t and ("..." in t or "…" in t) and CUT_OFF.search(t)) for t in titles], pa.bool_()),
            pa.array([damaged_id(d) for d in plain(b["doi"])], pa.string()),
            pa.array([damaged_id(x) for x in plain(b["ax"])], pa.string()),
        )
        yield pa.RecordBatch.from_arrays(list(columns), names=[c.split()[0] for c in PREPARED.split(", ")])


PREPARED = "key long, cls binary, title string, year double, words string, names string, marked boolean, cut_off boolean, doi string, ax string"


def walks(records: list[list[int]], idf: np.ndarray, rng: np.random.Generator, each: int = 3, length: int = 9) -> np.ndarray:
    """Random walks over the record-attribute-token graph: from a record to one of its tokens, to another record of that token, and on.

    A token is drawn by its idf among the tokens of the record; rows hold the tokens visited.
    """
    sizes = np.array([len(r) for r in records])
    flat, owner = np.concatenate([np.asarray(r) for r in records]), np.repeat(np.arange(len(records)), sizes)
    tokens = np.zeros((len(records), sizes.max()), dtype=np.int64)
    inner = np.arange(sizes.max()) < sizes[:, None]
    tokens[inner] = flat
    chance = np.cumsum(np.where(inner, idf[tokens] + 1e-9, 0), axis=1)
    order = np.argsort(flat, kind="stable")
    held = owner[order]  # the records of each token, token after token
    first, count = np.searchsorted(flat[order], np.arange(BUCKETS)), np.bincount(flat, minlength=BUCKETS)
    out = np.zeros((len(records) * each, length), dtype=np.int64)
    here = np.repeat(np.arange(len(records)), each)
    for step in range(length):
        u = rng.random(len(here)) * chance[here, -1]
        t = tokens[here, np.minimum((chance[here] <= u[:, None]).sum(axis=1), sizes[here] - 1)]
        out[:, step] = t
        if step % 3 == 2:
            here = held[first[t] + (rng.random(len(here)) * count[t]).astype(np.int64)]
    return out


def _added(v: np.ndarray, at: np.ndarray, x: np.ndarray) -> None:
    """v[at] += x where rows repeat."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    v[at[starts]] += np.add.reduceat(x[order], starts, axis=0)


def skip_gram(paths: np.ndarray, rng: np.random.Generator, window: int = 2, negatives: int = 64, rate: float = 0.05, batch: int = 2048) -> np.ndarray:
    """Skip-gram vectors with negative sampling (negatives shared by a batch), from near-orthogonal random starts."""
    v = rng.standard_normal(size=(BUCKETS, DIM), dtype=np.float32) / np.float32(np.sqrt(DIM))
    c = np.zeros((BUCKETS, DIM), dtype=np.float32)
    pairs = np.concatenate([np.stack([paths[:, d:].ravel(), paths[:, : paths.shape[1] - d].ravel()], 1) for d in range(1, window + 1)])
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    rng.shuffle(pairs)
    for lo in range(0, len(pairs), batch):
        a, b = pairs[lo : lo + batch].T
        n = np.unique(rng.integers(0, BUCKETS, negatives))
        va, cb = v[a], c[b]
        gp = np.float32(rate) * (1 - 1 / (1 + np.exp(-np.einsum("ij,ij->i", va, cb))))
        gn = -np.float32(rate * 4 / len(n)) / (1 + np.exp(-(va @ c[n].T)))
        _added(v, a, gp[:, None] * cb + gn @ c[n])
        _added(c, b, gp[:, None] * va)
        c[n] += gn.T @ va
    return v


def spread_out(v: np.ndarray, held: np.ndarray, directions: int = 3) -> np.ndarray:
    """Vectors without their mean and their strongest common directions, which training gives to all of them."""
    seen = held > 0
    if seen.sum() > DIM:
        v = v - (v * held[:, None]).sum(axis=0) / held.sum()
        for q in np.linalg.svd(v[seen], full_matrices=False)[2][:directions]:
            v = v - np.outer(v @ q, q)
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


class Embedding:
    """Token vectors, idf weights and the hyperplanes: a few MB, whatever the number of records.

    A record is hashed in three views, each by its own hyperplane tables: title with authors, title alone, and the head of the
    title, which a title cut short still has.
    """

    VIEWS = ("whole", "title", "head")

    def __init__(self, vectors: np.ndarray, idf: np.ndarray, tables: tuple[int, int, int], bits: int, seed: int = 11) -> None:
        self.weighted = (vectors * idf[:, None] ** 1.5).astype(np.float32)
        self.tables, self.bits = tables, bits
        rng = np.random.default_rng(seed)
        self.planes = [rng.normal(size=(DIM, t * bits)).astype(np.float32) for t in tables]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"weighted": self.weighted.astype(np.float16)}  # half the size to send

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state | {"weighted": state["weighted"].astype(np.float32)})

    def total(self, n: int, rec: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The sum of the weighted token vectors of each of n records."""
        own, column = np.unique(node, return_inverse=True)
        held = np.zeros((n, len(own)), dtype=np.float32)
        held[rec, column] = 1
        return held @ self.weighted[own]

    def records(self, words: list[str], people: list[str]) -> list[np.ndarray]:
        """Unit vectors of the views; names are scaled down by the root of their number."""
        parts = []
        for lo in range(0, len(words), BATCH):
            some, n = words[lo : lo + BATCH], len(words[lo : lo + BATCH])
            rec, node, in_head = nodes_of_batch(some)
            at = names_of_batch(people[lo : lo + BATCH])
            head = self.total(n, rec[in_head], node[in_head])
            title = head + self.total(n, rec[~in_head], node[~in_head])
            count = np.bincount(at[0], minlength=n).astype(np.float32)
            whole = title + self.total(n, *at) * (PEOPLE / np.sqrt(np.maximum(1, count / 3)))[:, None]
            parts.append([x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9) for x in (whole, title, head)])
        return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros((0, DIM), dtype=np.float32)] * 3

    def keys(self, views: list[np.ndarray], probes: int) -> np.ndarray:
        """For each record its buckets in all tables of all views; with probes, also those that differ in the least certain bits."""
        out, first = [], 0
        powers = 1 << np.arange(self.bits, dtype=np.int64)
        for x, planes, tables in zip(views, self.planes, self.tables, strict=True):
            if not tables:
                continue
            p = (x @ planes).reshape(len(x), tables, self.bits)
            own = ((p > 0) * powers).sum(axis=2) + ((first + np.arange(tables, dtype=np.int64)) << self.bits)
            first += tables
            out.append(own)
            if probes:
                out.append(self._near(p, own, powers, probes))
        return np.concatenate(out, axis=1)

    def _near(self, p: np.ndarray, own: np.ndarray, powers: np.ndarray, probes: int) -> np.ndarray:
        loose = min(self.bits, 7)
        order = np.argsort(np.abs(p), axis=2)[:, :, :loose]
        near = np.take_along_axis(np.abs(p), order, 2) ** 2
        masks = np.array([[m >> i & 1 for i in range(loose)] for m in range(1, 1 << loose) if bin(m).count("1") < 4])
        flips, costs = powers[order] @ masks.T, near @ masks.T
        best = np.argpartition(costs, min(probes, costs.shape[2]) - 1, axis=2)[:, :, :probes]
        return (own[:, :, None] ^ np.take_along_axis(flips, best, 2)).reshape(len(p), -1)


def bits_for(n: int, rows_each: int = 256, least: int = 9) -> int:
    """So many bits that a bucket holds about rows_each of n records."""
    return max(least, math.ceil(math.log2(max(1, n) / rows_each)))


def fit(a: DataFrame, b: DataFrame, n_b: int, bits: int, sample: int = 5_000, tables: tuple[int, int, int] = (2, 1, 2)) -> Embedding:
    """Token weights over all n_b records of side b; vectors from walks over at most `sample` records of both sides, in hash order.

    A token that side b lacks, such as a damaged word, can match nothing and weighs nothing. The sample bounds the
    driver's work and only shapes the vectors: every record is embedded, indexed and compared.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, dtype=np.int64)
        for x in batches:
            held += np.bincount(nodes_of_batch(plain(x["words"]))[1], minlength=BUCKETS) + np.bincount(names_of_batch(plain(x["names"]))[1], minlength=BUCKETS)
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(held[seen])], names=["node", "n"])

    held = b.select("words", "names").mapInArrow(counted, "node int, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()  # at most BUCKETS rows
    count = np.zeros(BUCKETS)
    for r in held:
        count[r["node"]] = r["n"]
    idf = np.where(count > 0, np.log1p(n_b / np.maximum(count, 1)), 0).astype(np.float32)
    both = a.select("words", "names").unionAll(b.select("words", "names"))
    rows = both.orderBy(F.xxhash64("words", "names"), "words", "names").limit(sample).collect()
    some: list[list[int]] = [[] for _ in rows]
    for at in (nodes_of_batch([r["words"] for r in rows])[:2], names_of_batch([r["names"] for r in rows])):
        for r, x in zip(*at, strict=True):
            some[r].append(int(x))
    some, rng = [x for x in some if x], np.random.default_rng(5)
    vectors = spread_out(skip_gram(walks(some, idf, rng), rng), count) if some else rng.normal(size=(BUCKETS, DIM))
    return Embedding(vectors, idf, tables, bits)


def signatures(words: list[str]) -> np.ndarray:
    """128 bits for each title, one set for each word that is not small."""
    kept = [[word_bucket(w) & 127 for w in t.split() if w not in SMALL] for t in words]
    rec, bit = np.repeat(np.arange(len(kept)), [len(k) for k in kept]), np.array([x for k in kept for x in k], dtype=np.int64)
    out = np.zeros((len(words), 128), dtype=np.uint8)
    out[rec, bit] = 1
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def packed(x: np.ndarray, words: list[str]) -> np.ndarray:
    """Vectors as four-bit numbers, followed by the signatures of the words, PACKED bytes a row; cosines of packed vectors are exact to about .01."""
    q = (np.clip(np.round(x * 24), -8, 7) + 8).astype(np.uint8)
    return np.concatenate([q[:, 0::2] << 4 | q[:, 1::2], signatures(words).view(np.uint8)], axis=1)


def pack(x: np.ndarray, words: list[str]) -> list[bytes]:
    return [r.tobytes() for r in packed(x, words)]


def unpack(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return unpacked(np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), PACKED))


def unpacked(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = q[:, : DIM // 2]
    x = np.empty((len(q), DIM), dtype=np.float32)
    x[:, 0::2], x[:, 1::2] = v >> 4, v & 15
    x -= 8
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9), np.ascontiguousarray(q[:, DIM // 2 :]).view(np.uint64)


def indexed(records: DataFrame, e: Embedding, probes: int, side: int, parts: int, hot: dict[int, int]) -> DataFrame:
    """(part, key, vec, slots): each record once for each part of the work that holds one of its buckets.

    A slot is bucket, salt and side in one number. hot: into how many salts the rows of side 0 in a hot bucket are
    split; rows of side 1 go to each of them.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        busy = np.array(sorted(hot), dtype=np.int64)
        salts = np.array([hot[b] for b in busy.tolist()], dtype=np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                some = b.slice(lo, 2000)
                words = plain(some["words"])
                views = e.records(words, plain(some["names"]))
                key, vec = some["key"].to_numpy(), packed(views[0], words)
                bucket = e.keys(views, probes)
                rec = np.repeat(np.arange(len(key)), bucket.shape[1])
                bucket = bucket.ravel()
                salt = np.zeros(len(bucket), dtype=np.int64)
                if len(busy):
                    at = np.minimum(np.searchsorted(busy, bucket), len(busy) - 1)
                    n = np.where(busy[at] == bucket, salts[at], 1)
                    if side:
                        rec, bucket, salt = np.repeat(rec, n), np.repeat(bucket, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    else:
                        salt = key[rec] % n
                place = bucket << 16 | salt
                part = part_of(place, parts)
                order = np.lexsort((part, rec))
                rec, part, slot = rec[order], part[order], place[order] * 2 + side
                starts = np.flatnonzero(np.concatenate([[True], (rec[1:] != rec[:-1]) | (part[1:] != part[:-1])]))
                own, edges = rec[starts], np.append(starts, len(slot)).astype(np.int32)
                ends = np.arange(len(own) + 1, dtype=np.int32) * PACKED
                vecs = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(vec[own]))])
                yield pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array(key[own]), vecs, pa.ListArray.from_arrays(pa.array(edges), pa.array(slot))], names=schema.names)

    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("vec", T.BinaryType()), T.StructField("slots", T.ArrayType(T.LongType()))])
    return records.select("key", "words", "names").mapInArrow(rows, schema)


def part_of(place: np.ndarray, parts: int) -> np.ndarray:
    return ((place * 2654435761 >> 16) % parts).astype(np.int32)


def block_pairs(rows: DataFrame, least: float, together: float, parts: int) -> DataFrame:
    """(key_a, key_b) of the pairs of sides a and b that share a slot and whose cosine reaches `least`, and with the share of common words `together`.

    Each bucket is one small matrix product. The share is that of the shorter title's words, read from the signatures, which never understate it. The number of parts is chosen so that the rows of one part stay within a bound.
    """

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b["key"].to_numpy(), _bytes(b["vec"]), b["slots"].flatten().to_numpy(), b["slots"].value_lengths().to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        keys, q, slot, lengths = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        vec, sign = unpacked(q)
        size = np.maximum(1, np.bitwise_count(sign).sum(axis=1))
        row = np.repeat(np.arange(len(keys)), lengths)
        order = np.argsort(slot, kind="stable")
        slot, row = slot[order], row[order]
        is_a, place = slot % 2 == 1, slot // 2
        edges = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]]))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for lo, hi in zip(edges, edges[1:], strict=False):
            here = row[lo:hi]
            ia, ib = here[is_a[lo:hi]], here[~is_a[lo:hi]]
            if not len(ia) or not len(ib):
                continue
            vb = vec[ib].T
            for s in range(0, len(ia), 512):
                ka = ia[s : s + 512]
                cosine = vec[ka] @ vb
                i, j = np.nonzero(cosine >= least)
                if len(i):
                    x, y = ka[i], ib[j]
                    near = cosine[i, j] + np.bitwise_count(sign[x] & sign[y]).sum(axis=1) / np.minimum(size[x], size[y]) >= together
                    i, j = i[near], j[near]
                if len(i):
                    out.append((keys[ka[i]], keys[ib[j]]))
                    held += len(i)
            if held > 50_000:
                yield _pairs(out)
                out, held = [], 0
        if out:
            yield _pairs(out)

    return rows.repartitionById(parts, "part").mapInArrow(match, "key_a long, key_b long").distinct()


def _bytes(x: pa.Array) -> np.ndarray:
    """The packed rows of a column of bytes."""
    q = x.cast(pa.binary(PACKED))
    return np.frombuffer(q.buffers()[1], dtype=np.uint8)[q.offset * PACKED : (q.offset + len(q)) * PACKED].reshape(-1, PACKED)


def _pairs(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    x = pd.DataFrame({"key_a": np.concatenate([x[0] for x in out]), "key_b": np.concatenate([x[1] for x in out])}).drop_duplicates()
    return pa.RecordBatch.from_pandas(x, preserve_index=False)


def hot_buckets(b: DataFrame, e: Embedding, heavy_rows: int = 20_000) -> dict[int, int]:
    """bucket -> salts of the buckets that hold more than heavy_rows rows of side b, judged from a twentieth of it; the choice moves work, not results.

    At most rows x tables / heavy_rows buckets can be hot.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            bucket, n = np.unique(e.keys(e.records(plain(x["words"]), plain(x["names"])), 0), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n)], names=["bucket", "n"])

    n = b.where(F.pmod(F.xxhash64("key"), F.lit(20)) == 0).select("words", "names").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg((20 * F.sum("n")).alias("n"))
    return {r["bucket"]: min(65_535, -(-r["n"] // heavy_rows)) for r in n.where(F.col("n") > heavy_rows).collect()}


def damaged_id(s: str | None) -> str:
    """An id with the usual damage undone: case, prefixes, letters for digits, blanks."""
    if not s:
        return ""
    t = "".join(s.lower().split())
    if "doi" in t or "arxiv" in t:
        t = ID_PREFIX.sub("", t)
    if t.startswith("1o."):
        t = "10." + t[3:]
    head, _, tail = t.rpartition("/")
    if DIGIT.search(tail):
        tail = tail.replace("o", "0").replace("l", "1")
        tail = VERSION.sub("", tail) if "v" in tail else tail
    return f"{head}/{tail}".strip("/.")


def id_says(a: str, b: str) -> int:
    """Of two repaired ids, 1: they agree, in whole or up to a broken end; -1: both are whole and differ; 0: nothing can be said."""
    if len(a) < 6 or not b:
        return 0
    if a == b or len(a) > 12 and slip(a, b):
        return 1
    stem = a.rstrip("?*.…")
    if len(stem) > 7 and b.startswith(stem):
        return 1
    return -1 if WHOLE_ID.fullmatch(a) and WHOLE_ID.fullmatch(b) else 0


@lru_cache(maxsize=65536)
def _letters(w: str) -> tuple[int, int]:
    """Bit sets of the letters of a word and of those that it has twice."""
    once = twice = 0
    for c in w:
        bit = 1 << (ord(c) & 63)
        twice |= once & bit
        once |= bit
    return once, twice


@lru_cache(maxsize=65536)
def _slip(a: str, b: str) -> bool:
    return slip(a, b)


def _alike(a: str, b: str) -> bool:
    """slip(), after the cheap tests that most pairs of words fail: lengths, and letters that only one of them has, each of which costs an edit."""
    if a == b:
        return True
    if not -3 < len(a) - len(b) < 3:
        return False
    (x, xx), (y, yy) = _letters(a), _letters(b)
    if (x & ~y).bit_count() > 2 or (y & ~x).bit_count() > 2:
        return False
    most = 1 if len(a) < 6 or len(b) < 6 else 2
    return (x & ~y).bit_count() + (xx & ~yy).bit_count() <= most and (y & ~x).bit_count() + (yy & ~xx).bit_count() <= most and _slip(a, b)


@lru_cache(maxsize=65536)
def _neutral(x: str) -> bool:
    """Whether a word left over may be a neutral addition or a small word with a slip."""
    if x in NEUTRAL or any(len(n) > 4 and _alike(x, n) for n in NEUTRAL):
        return True
    return len(x) < 6 and not x.isdigit() and x not in SEQUEL and any(abs(len(x) - len(y)) < 2 and len(set(x) & set(y)) >= min(len(x), len(y)) - 1 for y in SMALL)


def _lost(rest: list[str], missing: list[str]) -> bool:
    """Whether some word of the listing has no counterpart, so that no later test can make the titles agree."""
    if all(_neutral(x) or any(w.startswith(x) or _alike(w, x) for w in missing) for x in rest):
        return False
    return not (missing and _alike("".join(missing), "".join(rest)))


@lru_cache(maxsize=32768)
def _parts(words: str) -> tuple[list[str], list[str], str]:
    """All words, those that are not small, and the words without blanks; not to be changed by callers."""
    every = words.split()
    return every, [w for w in every if w not in SMALL], "".join(every)


def compare(title: str | None, lwords: str, lnames: str, cut_off: bool, pwords: str, pnames: str, torn_title: bool, ly: float | None, py: float | None, says: int) -> tuple[bool, float]:
    """(same, score): the exact comparison of a listing and a paper; says is what their ids say.

    The words of the titles must agree apart from slips, abbreviations, order, a cut end and
    neutral additions; words that make a sequel or reply, or any other word left over, mean another work. Authors
    and year must not contradict; an id that agrees decides. Missing values say nothing. The score leaves the ids out.
    """
    (_, lw, flat_l), (_, pw, flat_p) = _parts(lwords), _parts(pwords)
    begins = 15 < len(flat_l) < len(flat_p) and flat_p.startswith(flat_l)
    rest, missing, hits = list(lw), [], 0
    for w in pw:
        if w in rest:
            rest.remove(w)
            hits += 1
        else:
            missing.append(w)
    if not says and not begins and not cut_off and _lost(rest, missing):
        return False, 0.0
    raw = fold(title) if title and "." in title else ""
    left, missing = missing, []
    for w in left:
        h = next((x for x in rest if _alike(w, x)), None) or next((x for x in rest if w.startswith(x) and (len(x) > 1 and x + "." in raw or x == lw[-1] and (cut_off or len(x) > 1))), None)
        if h is None:
            missing.append(w)
        else:
            rest.remove(h)
            hits += 1
    if missing and rest and _alike("".join(missing), "".join(rest)):
        missing, rest = [], []
    rest = [x for x in rest if not (cut_off and x == lw[-1] and any(n.startswith(x) for n in NEUTRAL)) and not (len(x) < 6 and not x.isdigit() and x not in SEQUEL and any(abs(len(x) - len(y)) < 2 and len(set(x) & set(y)) >= min(len(x), len(y)) - 1 for y in SMALL))]
    if begins and rest and rest[-1] == lw[-1]:
        rest = rest[:-1]
    sequel = any(x in SEQUEL or _alike(x, "dataset") for x in rest)
    if rest and not sequel and all(x in NEUTRAL or any(len(n) > 4 and _alike(x, n) for n in NEUTRAL) for x in rest):
        rest = []
    tail = missing == pw[len(pw) - len(missing) :]
    a, b = set(lnames.split()), set(pnames.split())
    hopeless = len(rest) + len(missing) > 3 and not cut_off and not begins and says <= 0
    shared = len(a & b) if hopeless else sum(x in b or any(_alike(x, y) for y in b) for x in a)
    people = min(1.0, shared / max(1, min(len(a), len(b)))) if a and b else 0.5
    cut_ok = bool(missing) and tail and not rest and (begins or cut_off or hits >= 4) and (shared > 0 or not (a and b) and hits >= 4)
    torn = len(missing) == 1 and not rest and hits >= 3 and shared > 0 and torn_title
    years = abs(ly - py) if ly is not None and py is not None else None
    agree = hits / max(1, hits + (0 if cut_ok or torn else len(missing)) + len(rest))
    same = bool(lw and pw) and not rest and (not missing or cut_ok or torn) and not (a and b and not shared)
    same = same or says == 1 and hits >= 2 and not sequel and agree >= 0.5
    score = 0.6 * agree + 0.25 * people + 0.15 * (0.5 if years is None else max(0.0, 1 - years / 5)) - 0.4 * sequel
    return same, float(score)


@lru_cache(maxsize=1 << 18)
def _counterpart(x: str, w: str) -> bool:
    return w.startswith(x) or _alike(w, x)


def _within(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place): the numbers 0 .. n - 1 for each n of counts."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _spelt(words: list[str]) -> tuple[np.ndarray, ...]:
    """Of each word: length, first letter, how many slips slip() allows it, and 64-bit sets of its letters and of those it has twice.

    Letters share bits, so that the sets of two words differ by no more than the words do.
    """
    size = np.array([len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    count = np.bincount(np.repeat(np.arange(len(words)) * 64, size) + (codes & 63), minlength=len(words) * 64).reshape(-1, 64)
    sets = [np.packbits(count >= n, axis=1, bitorder="little").view(np.uint64)[:, 0] for n in (1, 2)]
    return size, codes[np.cumsum(size) - size], np.where(size < 6, 1, 2), *sets


def _near_letters(once_a: np.ndarray, twice_a: np.ndarray, once_b: np.ndarray, twice_b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether neither of two words has more than `most` letters that the other lacks, each of which costs an edit."""
    n = np.bitwise_count
    return (n(once_a & ~once_b) + n(twice_a & ~twice_b) <= most) & (n(once_b & ~once_a) + n(twice_b & ~twice_a) <= most)


def _neutrals(words: list[str]) -> np.ndarray:
    """_neutral() of each word; asked only of short words and those whose letters come near a neutral word."""
    size, _, most, once, twice = _spelt([*LONG_NEUTRAL, *words])
    k = len(LONG_NEUTRAL)
    ask = size[k:] < 6
    for i in range(k):
        ask |= (np.abs(size[k:] - size[i]) < 3) & _near_letters(once[k:], twice[k:], once[i], twice[i], np.minimum(most[k:], most[i]))
    out = np.array([w in NEUTRAL for w in words], dtype=bool)
    at = np.flatnonzero(ask)
    out[at] = [_neutral(words[i]) for i in at.tolist()]
    return out


def lost_pairs(lwords: list[str], pwords: list[str], ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Which of the pairs (lwords[ia], pwords[ib]) compare() must refuse by _lost(), for a whole batch: a word of the listing, not neutral, has no counterpart.

    Only pairs that are refused for certain are named: a word may have its counterpart in any word of the paper, the words
    without blanks may agree if their letters nearly do, and a title may begin the other if their first letters agree. It
    holds for titles that are not cut off, in pairs of which no id says anything: compare() asks _lost() of no others.
    """
    ids: dict[str, int] = {}
    sides = [[_parts(t) for t in side] for side in (lwords, pwords)]
    held = [[[ids.setdefault(w, len(ids)) for w in dict.fromkeys(kept)] for _, kept, _ in side] for side in sides]
    (cl, wl), (cp, wp) = ((np.array([len(h) for h in side], dtype=np.int64), np.array([x for h in side for x in h], dtype=np.int64)) for side in held)
    lost = np.zeros(len(ia), dtype=bool)
    if not len(wl) or not len(wp):
        return lost
    words = list(ids)
    size, initial, most, once, twice = _spelt(words)
    strict = np.zeros(len(words), dtype=bool)
    own = np.unique(wl)
    strict[own] = ~_neutrals([words[x] for x in own.tolist()])
    first_l, first_p = np.cumsum(cl) - cl, np.cumsum(cp) - cp
    # words of the listing that are not neutral and not in the paper
    pair, at = _within(cl[ia])
    x = wl[first_l[ia][pair] + at]
    starts: dict[str, int] = {}
    begin_l, begin_p = (np.array([starts.setdefault(flat[:16], len(starts)) for _, _, flat in side]) for side in sides)
    said = strict[x] & (begin_l[ia] != begin_p[ib])[pair]
    pair, x = pair[said], x[said]
    have = np.sort(np.repeat(np.arange(len(cp)), cp) * len(words) + wp)
    want = ib[pair] * len(words) + x
    alone = have[np.minimum(np.searchsorted(have, want), len(have) - 1)] != want
    pair, x = pair[alone], x[alone]
    # each against all words of the paper, by letters first, then exactly; a pair that its first such word refuses needs no second
    first = np.concatenate([[True], pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, dtype=bool)
    for some in (first, ~first):
        p, y = pair[some], x[some]
        p, y = p[~lost[p]], y[~lost[p]]
        lone, at = _within(cp[ib[p]])
        v, w = y[lone], wp[first_p[ib[p]][lone] + at]
        less = np.bitwise_count(once[v] & ~once[w])
        near = np.flatnonzero(less < 3)
        v, w, less, lone = v[near], w[near], less[near], lone[near]
        longer, bound = size[w] - size[v], np.minimum(most[v], most[w])
        maybe = np.flatnonzero((np.abs(longer) < 3) & _near_letters(once[v], twice[v], once[w], twice[w], bound) | (longer > 0) & (less == 0) & (initial[v] == initial[w]))
        both, back = np.unique(v[maybe] * len(words) + w[maybe], return_inverse=True)
        exact = np.array([_counterpart(words[k // len(words)], words[k % len(words)]) for k in both.tolist()], dtype=bool)
        met = np.zeros(len(y), dtype=bool)
        met[lone[maybe[exact[back]]]] = True
        lost[p[~met]] = True
    # titles whose letters nearly agree may differ in a blank only
    joined_l, joined_p = (np.array([sum(map(len, kept)) for _, kept, _ in side]) for side in sides)
    near = np.flatnonzero(lost & (np.abs(joined_l[ia] - joined_p[ib]) < 3))
    if len(near):
        spelt = []
        for side in sides:
            flat = ["".join(kept) for _, kept, _ in side]
            codes = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64) & 63
            spelt.append(np.bincount(np.repeat(np.arange(len(flat)), [len(t) for t in flat]) * 64 + codes, minlength=len(flat) * 64).reshape(-1, 64))
        d = spelt[0][ia[near]] - spelt[1][ib[near]]
        lost[near[(np.maximum(d, 0).sum(axis=1) < 3) & (np.maximum(-d, 0).sum(axis=1) < 3)]] = False
    return lost


RESULT = "cls_a binary, cls_b binary, same boolean, blend double, says int"


def reranked(e: Embedding, told: float):
    """The exact comparison of each candidate pair; kept are those that are the same, and a share `told` of those whose ids say something, with the blend of the exact cosine and the score.

    Each record of a batch is read once, whatever the number of its pairs.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield some(batch["a"], batch["b"])

    def some(a: pa.StructArray, b: pa.StructArray) -> pa.RecordBatch:
        keys = [x.field("key").to_numpy() for x in (a, b)]
        (_, fa, ia), (_, fb, ib) = (np.unique(k, return_index=True, return_inverse=True) for k in keys)
        lists, papers = (x.take(pa.array(first)) for x, first in ((a, fa), (b, fb)))
        (lwords, lnames, ldoi, lax, ly), (pwords, pnames, pdoi, pax, py) = ([plain(x.field(c)) for c in ("words", "names", "doi", "ax")] + [x.field("year").to_pylist()] for x in (lists, papers))
        title, cut_off, marked = plain(lists.field("title")), lists.field("cut_off").to_numpy(zero_copy_only=False), plain(papers.field("marked"))
        lot = ((keys[0] * 0x9E3779B1 + keys[1] * 0x85EBCA77) >> 7) % 100_000 < told * 100_000
        says = np.zeros(len(ia), dtype=np.int32)
        has = [np.array([bool(i) for i in x], dtype=bool) for x in (ldoi, pdoi, lax, pax)]
        for k in np.flatnonzero(has[0][ia] & has[1][ib] | has[2][ia] & has[3][ib]).tolist():
            i, j = ia[k], ib[k]
            said = (id_says(ldoi[i], pdoi[j]), id_says(lax[i], pax[j]))
            says[k] = max(said) if max(said) > 0 else min(said)
        lost = lost_pairs(lwords, pwords, ia, ib) & (says == 0) & ~cut_off[ia].astype(bool)
        same, score = np.zeros(len(ia), dtype=bool), np.zeros(len(ia))
        for k in np.flatnonzero(~lost).tolist():  # the others are not the same, and their score is not asked for
            i, j = ia[k], ib[k]
            same[k], score[k] = compare(title[i], lwords[i], lnames[i], bool(cut_off[i]), pwords[j], pnames[j], marked[j], ly[i], py[j], int(says[k]))
        kept = np.flatnonzero(same | (says != 0) & lot)
        sides = []
        for words, people, at in ((lwords, lnames, ia[kept]), (pwords, pnames, ib[kept])):
            own, back = np.unique(at, return_inverse=True)
            sides.append(e.records([words[i] for i in own.tolist()], [people[i] for i in own.tolist()])[0][back])
        blend = 0.4 * (sides[0] * sides[1]).sum(axis=1) + 0.6 * np.clip(score[kept], 0, 1)
        at = pa.array(kept)
        return pa.RecordBatch.from_arrays([a.field("cls").take(at), b.field("cls").take(at), pa.array(same[kept]), pa.array(blend.astype(np.float64)), pa.array(says[kept])], names=[c.split()[0] for c in RESULT.split(", ")])

    return rows


def classes(df: DataFrame, id_col: str, title: str, people, year: str, doi: str, ax: str) -> tuple[DataFrame, DataFrame]:
    """(members(cls, id), records(key, cls, title, year and the prepared columns)): exact copies are one record, whose key is its least id.

    cls is a 128-bit digest of all compared columns.
    """
    x = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(title).alias("title"), people.alias("people"), F.col(year).cast("int").alias("year"), utrim(F.col(doi)).alias("doi"), utrim(F.col(ax)).alias("ax"))
    cols = ("title", "people", "year", "doi", "ax")
    x = x.withColumn("cls", F.unhex(F.md5(F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in cols)))))
    one = x.groupBy("cls").agg(F.min("id").alias("key"), *(F.first(c).alias(c) for c in cols))
    p = one.select("key", "cls", *cols).mapInArrow(prepared, PREPARED)
    return x.select("cls", "id"), p.where("words <> '' or names <> ''")


def candidates(a: DataFrame, b: DataFrame, e: Embedding, n_a: int, n_b: int, least: float, together: float, probes: int, heavy_rows: int = 20_000, part_slots: int = 250_000) -> DataFrame:
    """(key_a, key_b) that meet in a bucket of any table and are near enough there."""
    slots = (n_a * (probes + 1) + n_b) * sum(e.tables)
    parts = max(a.sparkSession.sparkContext.defaultParallelism * 2, -(-slots // part_slots))
    hot = hot_buckets(b, e, heavy_rows)
    return block_pairs(indexed(a, e, probes, 1, parts, hot).unionByName(indexed(b, e, 0, 0, parts, hot)), least, together, parts)


def same_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key_a, key_b) whose repaired ids are equal: the exact way for pairs that no bucket joins."""
    left, right = (x.select(F.col("key").alias(f"key_{k}"), F.explode(F.array("doi", "ax")).alias("id")).where(F.length("id") > 5) for x, k in ((a, "a"), (b, "b")))
    return left.join(right, "id").select("key_a", "key_b")


def matches(listings: DataFrame, papers: DataFrame, least: float = 0.40, tables: tuple[int, int, int] = (2, 1, 2), probes: int | None = None, confident: float = 0.5, together: float = 1.0) -> DataFrame:
    """(list_id, rec_id, confidence) of listings and papers of the same work; every row of the paper counts.

    Both tables are folded into classes of exact copies, embedded, and each record of either table is put into one bucket
    of every table; the number of bits grows with the table, and listings probe the buckets next to theirs, more of
    them the more bits there are. Pairs of a bucket whose cosine reaches `least`, and with the share of words in common `together`, and pairs with equal repaired
    ids, are reranked exactly. Their blend of cosine and exact score is calibrated by isotonic regression on a
    bounded sample (LABELS) of pairs whose ids, which the score does not read, agree or differ; with fewer than 50 of either kind the blend itself
    is the confidence. A pair is a match if the exact comparison holds and the confidence reaches `confident`. Records without a word in title and authors match nothing. Empty tables give
    an empty result.
    """
    in_a, a = classes(listings, "list_id", "title", F.col("author_line"), "pub_year", "doi_raw", "arxiv_raw")
    in_b, b = classes(papers, "rec_id", "title", F.array_join("authors", " ; "), "year", "doi", "arxiv_id")
    a, b = stored(a), stored(b)
    n_a, n_b = a.count(), b.count()
    bits = bits_for(n_b)
    e = fit(a, b, n_b, bits, tables=tables)
    pairs = candidates(a, b, e, n_a, n_b, least, together, probes or 12 + 4 * (bits - 9)).unionByName(same_ids(a, b)).distinct()
    cols = ("key", "cls", "title", "words", "names", "cut_off", "marked", "year", "doi", "ax")
    side = lambda x, k: x.select(F.col("key").alias(f"key_{k}"), F.struct(*(c for c in cols if k == "a" or c not in ("title", "cut_off"))).alias(k))
    met = pairs.join(side(a, "a"), "key_a").join(side(b, "b"), "key_b")
    met = stored(met.select("a", "b").mapInArrow(reranked(e, min(1.0, LABELS / max(1, n_a))), RESULT))
    told = met.where("says <> 0").orderBy(F.xxhash64("cls_a", "cls_b")).limit(LABELS).select("blend", (F.col("says") == 1).cast("double").alias("y")).toPandas()
    confidence = F.col("blend")
    if min(told["y"].sum(), (1 - told["y"]).sum()) >= 50:
        xs, ys = isotonic(told["blend"].to_numpy(), told["y"].to_numpy())

        @F.pandas_udf(T.DoubleType())
        def calibrated(blend: pd.Series) -> pd.Series:
            return pd.Series(0.98 * np.interp(blend, xs, ys) + 0.02 * blend)

        confidence = calibrated("blend")
    same = met.where("same").select("cls_a", "cls_b", confidence.alias("confidence")).where(F.col("confidence") >= confident)
    full = same.join(in_a.select(F.col("cls").alias("cls_a"), F.col("id").alias("list_id")), "cls_a").join(in_b.select(F.col("cls").alias("cls_b"), F.col("id").alias("rec_id")), "cls_b")
    return full.groupBy("list_id", "rec_id").agg(F.max("confidence").alias("confidence"))
