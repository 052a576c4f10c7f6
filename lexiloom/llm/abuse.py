"""Problem 10: abusive, hateful or sexual content, by boosted trees over dense features with isotonic calibration."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .normal import fold

# Stems (any word that begins so) by kind, in English, German, French, Spanish and some Chinese.
STEMS = {
    "insult": """idiot idiota idiote imbecil imbecile moron cretin dimwit halfwit nitwit dumbass dipshit jackass asshole arsehole arschloch bastard scum
    scumbag loser clown parasite leech maggot cockroach rat rata pig schwein sau porc retard trash garbage filth fraud liar connard connasse salaud abruti cretino
    gilipollas cabron pendejo vollidiot vollpfosten trottel depp dummkopf drecksack miststuck wichser fotze hurensohn schlampe salope putain pute puta puto zorra perra
    bitch slut whore cunt twat prick dickhead douche tosser wanker enfoire encule batard ordure raclure escoria basura tonto bufon imbeciles idioten
    白痴 蠢货 废物 贱人 傻逼 混蛋""",
    "slight": """stupid estupid dumb useless worthless spineless brainless braindead pathetic disgusting filthy sick ugly vomit coward asquerosa asqueroso dirty lazy dreck
    dummes dumme stinking rotten lousy""",
    "profanity": """fuck fick fucking motherfuck shit bullshit scheiss mierda merde verdammt goddamn damn crap bloody piss verpiss joder jodid cono carajo foutre foutez
    nique putain fresse maul gueule cul arse ass hell bugger 他妈 操你""",
    "threat": """kill murder beat strangle choke stab shoot bullet burn drown hang rape break smash punch die dead death muer muere mueras matar golpe romper partir
    creve crever tuer frapper coups umbring toten schlag schlagen prugel sterb verreck rot vanish vanished corpse grave bleed knife hunt fingers bones skull neck 去死 杀了""",
    "sexual": """cock dick penis pussy tits tit boobs nude nudes naked nackt nue nues desnuda desnudas desnudo horny geil geile orgasm blowjob handjob cum masturbat jerk
    suck swallow moan undress unzip strip lips tongue thrust wet panties bang screw lick anal oral sexy sex sexe sexo baiser baise follar follamos follemos
    ficken bumsen sodom erotic bend hard deeper scream toys hookup hookups bed clothes skirt desnud""",
    "spam": """porn porno xxx webcam cam live links free gratis gratuit gratuites kostenlos hookups click klicken cliquez entra trial signup escort camgirl nudes videos
    couples strings tonight chicas students studenten etudiantes""",
    "hate": """vermin ungeziefer vermine plaga subhuman subhumans breed breeding inferior savage savages animals animal liar liars thieves thief lazy dirty loud stink smell smells invade
    crawl crawled infest disease plague blood brain cleaner nation foreigners ban expel deport exterminate eradicate rausgeworfen echarlos chasse dehors lugner diebe cerveau
    ladrones mentirosos raus""",
    "group": """folk people clan clans tribe race women woman men girls immigrants migrants foreigners islanders lowlanders jews muslims christians blacks whites gays lesbians
    they them those their kind diese ces estos estas esos sind sont son""",
    "you": """you your youre yours yourself u ur du dich dir dein deine deiner euch ihr tu te toi ton ta tes vous votre vos eres tus ti usted vosotros 你 您 listen shut get
    go do crawl drop quit halt zieh ferme callate ven viens send bend rub swallow""",
    "context": """quote quotes quoted quotation lexicon dictionary word words term terms masked rater raters annotator annotators archive archives warning historical
    historically questionnaire clinical medical participants patients tissue survey corpus classifier classifiers moderation detector dataset detection policy policies
    epidemiology study studied studies research prevention awareness harassment guideline ethics contraceptive measured annotated labelled""",
    "self": """my mine myself i me sorry apologies oops moi mich mein mir yo mi meine feel""",
}
KINDS = list(STEMS)
# Letters of other scripts that pass for Latin ones.
LOOKALIKE = str.maketrans("аеорсухівкмнтѕјԁɡһӏԛԝοαερικνυχ", "aeopcyxibkmhtsjdghlqwoaepiknux")
SHORT = 4  # stems up to this length are whole words


def _tables() -> tuple[dict[str, int], dict[str, int]]:
    exact: dict[str, int] = {}
    stems: dict[str, int] = {}
    for k, kind in enumerate(KINDS):
        for w in map(fold, STEMS[kind].split()):
            for table in (exact,) if len(w) <= SHORT or kind in ("you", "self", "group", "context") else (exact, stems):
                table[w] = table.get(w, 0) | 1 << k
    return exact, stems


EXACT, STEM = _tables()
BAD = sum(1 << KINDS.index(k) for k in ("insult", "slight", "profanity", "threat", "sexual", "hate"))
STEM_LENGTHS = sorted({len(w) for w in STEM}, reverse=True)
LEET = str.maketrans("013457@$!", "oieastasi")
INVISIBLE = re.compile("[​-‏⁠﻿­͏᠎]")
IN_WORD = re.compile(r"(?<=\w)[​-‏⁠﻿­](?=\w)")
SPACED = re.compile(r"(?<!\w)(?:\w[ .\-_*]){3,}\w(?!\w)")
DOTTED = re.compile(r"(?<=\w)[.\-_·](?=\w)")
MASKED = re.compile(r"(?<!\w)\w{1,3}[*#@$%]{2,}\w{0,4}(?!\w)")
REPEAT = re.compile(r"(.)\1{2,}")
WORD = re.compile(r"[^\W_]+(?:[.'’\-][^\W_]+)*|[*#]{3,}")
SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n+|(?<=[。！？])")
QUOTED = re.compile(r"[\"“”«»„][^\"“”«»„]{1,80}[\"“”«»„]")
MIXED = re.compile(r"\b(?=\w*[a-z])(?=\w*[α-ωа-ӿԀ-ԯ])\w+")
HAN = re.compile(r"[一-鿿]{2,}")
MASK_WORDS = frozenset("fuck fucking shit naked disgusting bastard bitch asshole whore idiot moron cunt porn slut dick cock".split())


@lru_cache(maxsize=200_000)
def kinds_of(w: str) -> int:
    """Bits of the kinds that a plain word belongs to."""
    bits = EXACT.get(w, 0)
    for n in STEM_LENGTHS:
        if n < len(w):
            bits |= STEM.get(w[:n], 0)
    return bits


def words_of(sentence: str) -> tuple[list[str], int]:
    """The plain words of a sentence after undoing spaced, dotted, masked, stretched and digit spellings; how many were disguised."""
    disguised = len(IN_WORD.findall(sentence)) > 0
    s = fold(INVISIBLE.sub("", unicodedata.normalize("NFKC", sentence)))
    n = int(disguised)

    def latin(m: re.Match) -> str:
        nonlocal n
        n += 1
        return m[0].translate(LOOKALIKE)

    s = MIXED.sub(latin, s)

    def joined(m: re.Match) -> str:
        nonlocal n
        n += 1
        return re.sub(r"[ .\-_*]", "", m[0])

    s = SPACED.sub(joined, s)

    def unmask(m: re.Match) -> str:
        nonlocal n
        n += 1
        w = m[0]
        fits = [x for x in MASK_WORDS if len(x) == len(w) and all(a == b or not a.isalnum() for a, b in zip(w, x, strict=True))]
        return fits[0] if fits else "maskedword"

    s = MASKED.sub(unmask, s)
    out = []
    for w in WORD.findall(s):
        if DOTTED.search(w):
            solid = DOTTED.sub("", w)
            if kinds_of(solid) and not any(kinds_of(x) for x in DOTTED.split(w)):
                n += 1
                out.append(solid)
                continue
            out += re.split(r"[.'’\-]", w)
            continue
        if "'" in w or "’" in w:
            out += re.split(r"['’]", w)
            continue
        if not w.isdigit() and any(c.isdigit() for c in w):
            plain = w.translate(LEET)
            if plain.isalpha() and kinds_of(plain):
                n += 1
                w = plain
        if REPEAT.search(w):
            for r in (r"\1", r"\1\1"):
                plain = REPEAT.sub(r, w)
                if kinds_of(plain):
                    n += 1
                    w = plain
                    break
        if HAN.search(w):
            out += [w[i : i + 2] for i in range(len(w) - 1)]
            continue
        out.append(w)
    return out, n


#: What may hide a word: anything but plain words calls for words_of.
ODD = re.compile(
    r"[​-‏⁠﻿­͏᠎]|[^\W\d_][*#@$%]|[*#@$%][^\W\d_]|[*#]{3,}|([^\W\d_])\1{2,}|[^\W\d_]\d+[^\W\d_]|(?<!\w)\d[^\W\d_]{2,}"
    r"|[^\W\d_][._·][^\W\d_]|(?<!\w)[^\W\d_]{1,3}-[^\W\d_]{1,3}(?!\w)|(?<!\w)[^\W\d_][ .\-_*][^\W\d_](?!\w)"
)
#: A cheap test that every sentence with such a sign passes.
HINT = re.compile(r"[​-‏⁠﻿­͏᠎*#@$%]|\d[^\W\d_]|[a-zA-Z](?:[._·]|-[a-zA-Z]{1,3}\b)|\b\w[ .\-_*]\w\b|([a-z])\1\1")
NOT_LATIN = re.compile(r"[α-ωа-ӿԀ-ԯ一-鿿]")
PLAIN = re.compile(r"[^\W_]+")

BASE = [*KINDS, "disguised", "quoted", "capitals", "exclaims", "length", "near", "insult_near", "learned", "learned_mean"]
NAMES = [f"max_{b}" for b in BASE] + ["bad_density", "bad_near_context", "sum_learned", "sentences", "top_share", "invisible", "second"]
YOU, INSULT, CONTEXT = (1 << KINDS.index(k) for k in ("you", "insult", "context"))
BITS: dict[int, list[int]] = {}


class Lexicon:
    """Learned log-odds of words and pairs of words; pairs are looked up only where a pair begins so."""

    def __init__(self, odds: dict[str, float]) -> None:
        self.odds = odds
        self.first = frozenset(g.split(" ", 1)[0] for g in odds if " " in g)
        self.single = frozenset(g for g in odds if " " not in g)

    def of(self, words: list[str]) -> list[float]:
        """The odds of the distinct words and pairs of a sentence, each 3 at most."""
        found = self.single.intersection(words)
        if not self.first.isdisjoint(words):
            found = found | {g for a, b in zip(words, words[1:], strict=False) if a in self.first and (g := f"{a} {b}") in self.odds}
        return [min(self.odds[g], 3.0) for g in found]


def read(sentence: str) -> tuple[list[str], int]:
    """The plain words of a sentence and how many were disguised; sentences without any odd sign take the short way."""
    if HINT.search(sentence) and ODD.search(sentence) or not sentence.isascii() and NOT_LATIN.search(sentence):
        return words_of(sentence)
    return PLAIN.findall(fold(sentence)), 0


def _bits(b: int) -> list[int]:
    if b not in BITS:
        BITS[b] = [k for k in range(len(KINDS)) if b >> k & 1]
    return BITS[b]


def sentence_features(sentence: str, learned: Lexicon) -> tuple[list[float], int, int]:
    """The features of a sentence, its telling words, and those of them with a word of context beside."""
    words, disguised = read(sentence)
    counts = [0] * len(KINDS)
    you: list[int] = []
    bad: list[int] = []
    insults: list[int] = []
    for i, w in enumerate(words):
        bits = kinds_of(w)
        if bits:
            for k in _bits(bits):
                counts[k] += 1
            if bits & YOU:
                you.append(i)
            if bits & BAD:
                bad.append(i)
            if bits & INSULT:
                insults.append(i)
    close = lambda xs: max((1 / (1 + min(abs(i - j) for j in you)) for i in xs), default=0.0) if you else 0.0
    quoted = len(QUOTED.findall(sentence)) if '"' in sentence or not sentence.isascii() else 0
    upper = sum(map(str.isupper, sentence)) / max(1, len(sentence))
    n = max(1, len(words))
    odds = learned.of(words)
    total = sum(odds)
    row = [*counts, disguised, quoted, upper, sentence.count("!"), math.log(n), close(bad), close(insults), 1 - math.exp(-total / 6), min(total / math.sqrt(n), 3.0)]
    return row, len(bad), len(bad) if counts[KINDS.index("context")] else 0


def features(text: str, learned: Lexicon) -> list[float]:
    """Dense features of a whole text: the maximum of each sentence feature, densities over all words and of the two worst sentences."""
    got = [sentence_features(p, learned) for p in SENTENCE.split(text) if p and not p.isspace()] or [([0.0] * len(BASE), 0, 0)]
    rows = np.array([r for r, _, _ in got])
    bad, beside = np.array([b for _, b, _ in got], dtype=float), sum(c for _, _, c in got)
    odds = rows[:, BASE.index("learned")]
    words = np.exp(rows[:, BASE.index("length")]).sum()
    order = np.sort(bad / 4 + odds)
    return [*rows.max(axis=0).tolist(), float(bad.sum() / words), beside / (bad.sum() + 1), float(odds.sum() / (1 + odds.sum())), math.log(len(rows)), float(bad.max() / (bad.sum() + 1)), float(len(IN_WORD.findall(text)) / (len(text) + 1)) if not text.isascii() else 0.0, float(order[-2] if len(order) > 1 else 0.0)]


def grams_of(text: str) -> set[str]:
    out: set[str] = set()
    for p in SENTENCE.split(text):
        words, _ = read(p)
        out.update(words)
        out.update(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))
    return out


class Trees:
    """Gradient-boosted regression trees on the logistic loss, over quantile bins; targets may be between 0 and 1."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.1, bins: int = 32, least: float = 12.0, ridge: float = 5.0) -> None:
        self.n, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, margin: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b, f, size = self.binned(x), margin.copy(), x.shape[1]
        flat = b + np.arange(size) * self.bins
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            inner = 2**self.depth - 1
            split, at, value = np.full(inner, -1), np.zeros(inner, int), np.zeros(2 ** (self.depth + 1) - 1)
            node = np.zeros(len(x), int)
            for k in range(inner):
                rows = np.flatnonzero(node == k)
                if len(rows) < 2:
                    if len(rows):
                        value[k] = g[rows].sum() / (h[rows].sum() + self.ridge)
                    continue
                cells = flat[rows].ravel()
                gs = np.bincount(cells, np.repeat(g[rows], size), size * self.bins).reshape(size, self.bins).cumsum(axis=1)
                hs = np.bincount(cells, np.repeat(h[rows], size), size * self.bins).reshape(size, self.bins).cumsum(axis=1)
                tg, th = gs[0, -1], hs[0, -1]
                value[k] = tg / (th + self.ridge)
                gain = gs**2 / (hs + self.ridge) + (tg - gs) ** 2 / (th - hs + self.ridge) - tg**2 / (th + self.ridge)
                ns = np.bincount(cells, minlength=size * self.bins).reshape(size, self.bins).cumsum(axis=1)
                gain[(ns < self.least) | (len(rows) - ns < self.least)] = -1
                j, c = divmod(int(gain.argmax()), self.bins)
                if gain[j, c] <= 1e-6:
                    continue
                split[k], at[k] = j, c
                node[rows] = 2 * k + 1 + (b[rows, j] > c)
            for k in range(inner, len(value)):
                rows = np.flatnonzero(node == k)
                if len(rows):
                    value[k] = g[rows].sum() / (h[rows].sum() + self.ridge)
            self.trees.append((split, at, self.rate * value))
            f += self.rate * value[node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out = self.binned(x), np.zeros(len(x))
        for split, at, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                inner = node < len(split)
                k = np.where(inner, node, 0)
                j = split[k]
                go = inner & (j >= 0)
                node = np.where(go, 2 * k + 1 + (b[np.arange(len(x)), np.maximum(j, 0)] > at[k]), node)
            out += value[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots (score, value) of the least-squares increasing fit."""
    ticks, at = np.unique(np.round(score, 3), return_inverse=True)  # ties share one value
    counts = np.bincount(at)
    blocks: list[list[float]] = []
    for x, t, w in zip(ticks, np.bincount(at, y) / counts, counts, strict=True):
        blocks.append([t, float(w), x, x])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            t2, w2, _, hi = blocks.pop()
            t1, w1, lo, _ = blocks.pop()
            blocks.append([(t1 * w1 + t2 * w2) / (w1 + w2), w1 + w2, lo, hi])
    xs = [x for b in blocks for x in (b[2], b[3])]
    return np.array(xs), np.array([b[0] for b in blocks for _ in (0, 1)])


FOLDS = 5
LABELS_FOR_FIT = 40


def unlearned(x: np.ndarray) -> np.ndarray:
    """The log-odds where no labels can teach: telling words next to the reader."""
    bad = sum(x[:, NAMES.index(f"max_{k}")] for k in ("insult", "threat", "sexual", "hate", "profanity"))
    return np.clip(1.5 * bad * (0.5 + x[:, NAMES.index("max_near")]) - 3.5, -6, 6)


class Model:
    """What fit() learned; small, sent to the workers with the scoring function. Boosting begins at the share of positives among the labels."""

    def __init__(self, learned: Lexicon, trees: Trees | None, share: float, knots: tuple[np.ndarray, np.ndarray] | None) -> None:
        self.learned, self.trees, self.share, self.knots = learned, trees, share, knots

    def margin(self, x: np.ndarray) -> np.ndarray:
        return unlearned(x) if self.trees is None else math.log(self.share / (1 - self.share)) + self.trees.margin(x)

    def calibrated(self, m: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-m))
        return p if self.knots is None else 0.98 * np.interp(m, *self.knots) + 0.02 * p


def log_odds(pos: float, neg: float, all_pos: float, all_neg: float) -> float:
    return math.log((pos + 0.5) / (all_pos + 1)) - math.log((neg + 0.5) / (all_neg + 1))


def learn(documents: DataFrame, labels: DataFrame, sample: int = 20_000) -> Model:
    """Fit on at most `sample` labelled documents, in hash order, which also bounds the learned lexicon.

    A document's target is the mean of its raters; null labels do not count. The learned
    lexicon is cross-fitted: a labelled document never sees odds that its own label made.
    With fewer than LABELS_FOR_FIT labelled documents, or one class only, telling words next to the reader decide.
    """
    target = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("toxic").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = documents.where("text is not null and trim(text) <> ''").select("doc_id", "text").join(F.broadcast(target), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums: dict[tuple[str, int], list[float]] = {}
            for t, y, f in zip(b["text"], b["y"], b["fold"], strict=True):
                for g in (*grams_of(t), ""):
                    s = sums.setdefault((g, f), [0.0, 0.0])
                    s[0] += y
                    s[1] += 1 - y
            yield pd.DataFrame([(g, f, *s) for (g, f), s in sums.items()], columns=["gram", "fold", "pos", "neg"])

    per_fold = rows.select("text", "y", "fold").mapInPandas(counted, "gram string, fold int, pos double, neg double").groupBy("gram", "fold").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    grams = per_fold.groupBy("gram").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.collect_list(F.struct("fold", "pos", "neg")).alias("by"))
    totals = grams.where("gram = ''").collect()
    if not totals:
        return Model(Lexicon({}), None, 0.5, None)
    all_pos, all_neg = totals[0]["p"], totals[0]["n"]
    kept = grams.where((F.col("gram") != "") & (F.col("p") >= 2.5) & (F.col("p") / max(1.0, all_pos) > 20 * F.col("n") / max(1.0, all_neg))).collect()
    full = {r["gram"]: log_odds(r["p"], r["n"], all_pos, all_neg) for r in kept}
    by_fold: list[dict[str, float]] = [{} for _ in range(FOLDS)]
    fold_all = {x["fold"]: x for x in totals[0]["by"]}
    for r in kept:
        own = {x["fold"]: x for x in r["by"]}
        for f in range(FOLDS):
            p = r["p"] - (own[f]["pos"] if f in own else 0)
            n = r["n"] - (own[f]["neg"] if f in own else 0)
            if p >= 1.5:
                ap, an = (all_pos - fold_all[f]["pos"], all_neg - fold_all[f]["neg"]) if f in fold_all else (all_pos, all_neg)
                by_fold[f][r["gram"]] = log_odds(p, n, ap, an)

    by = [Lexicon(b) for b in by_fold]

    def table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": [features(t, by[f]) for t, f in zip(b["text"], b["fold"], strict=True)]})

    got = rows.mapInPandas(table, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("y", T.DoubleType()), T.StructField("x", T.ArrayType(T.DoubleType()))])).toPandas().sort_values("doc_id")
    y = got["y"].to_numpy()
    if len(y) < LABELS_FOR_FIT or y.max() < 0.5 or y.min() >= 0.5:
        return Model(Lexicon(full), None, 0.5, None)
    x = np.array(got["x"].tolist())
    start = math.log(y.mean() / (1 - y.mean()))
    base, part = np.full(len(y), start), np.arange(len(y)) % 3
    held = np.zeros(len(y))
    for k in range(3):
        inside = part != k
        held[~inside] = start + Trees().fit(x[inside], y[inside], base[inside]).margin(x[~inside])
    return Model(Lexicon(full), Trees().fit(x, y, base), float(y.mean()), isotonic(held, y))


def scores(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, score): the calibrated probability of each document; 0 for null and blank texts. Texts are scored whole."""
    model = learn(documents, labels, **options)

    @F.pandas_udf(T.DoubleType())
    def scored(text: pd.Series) -> pd.Series:
        blank = (text.isna() | (text.str.strip() == "")).to_numpy()
        out = np.zeros(len(text))
        if (~blank).any():
            out[~blank] = model.calibrated(model.margin(np.array([features(t, model.learned) for t in text[~blank]])))
        return pd.Series(out)

    return documents.select("doc_id", scored("text").alias("score"))


def found(documents: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    return scores(documents, labels, **options).where(F.col("score") >= least).select("doc_id").distinct()


def rates(documents: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """Per source (trimmed, lower case; null stays null): documents, mean score and share of documents found."""
    s = scores(documents, labels, **options)
    d = documents.select("doc_id", F.lower(F.trim("source")).alias("source"))
    return d.join(s, "doc_id").groupBy("source").agg(F.count("*").alias("documents"), F.avg("score").alias("mean_score"), F.avg((F.col("score") >= least).cast("double")).alias("rate"))
