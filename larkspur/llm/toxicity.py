"""Toxicity: boosted trees over dense features with isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: Insults that count as lexicon words whatever the labels say.
INSULTS = "idiot stupid moron trash scum worthless pathetic loser clown disgusting dumb garbage imbecile filth vermin".split()
#: Second-person words of English, German, French and Spanish.
SECOND = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split()
#: Labelled rows the model is fitted on at most, those with the smallest hash of their id; the classifier's only bound.
SAMPLE = 8_000
#: Learned lexicon entries: words, and starts of words.
LEXICON, START = 400, 5
FEATURES = ("insults", "insults_n", "learned", "learned_n", "starts", "starts_n", "second", "near_second", "capitals", "bangs",
            "questions", "punctuation", "digits", "obfuscated", "repeats", "n_words")

_OBFUSCATED = re.compile(r"(?:[^\W\d_][*@$!0-9.\-]{1,3})+[^\W\d_]", re.UNICODE)
#: What _OBFUSCATED needs, and the signs in it.
_SIGNS = re.compile(r"[^\W\d_][*@$!0-9.\-]{1,3}[^\W\d_]", re.UNICODE)
_MARKS = re.compile(r"[*@$!0-9.\-]")
_LEET = str.maketrans("01345@$!7", "oleasasit")
_STRIP = ".,;:!?\"'()[]{}*#$%&|<>-_"


def tokens(text: str) -> list[str]:
    return [w.strip(_STRIP) for w in text.lower().split()]


def _unmasked(word: str) -> bool:
    """Whether a word is an insult once its signs are read as letters, taken out, or stand for one letter each."""
    bare = word.strip(_STRIP)
    if bare in _INSULTS:
        return False
    read = (word.translate(_LEET).strip(_STRIP), bare.translate(_LEET), _MARKS.sub("", bare), _MARKS.sub("", bare.translate(_LEET)))
    if any(x in _INSULTS for x in read):
        return True
    hidden = re.compile("".join("[^\\W\\d_]" if _MARKS.match(ch) else re.escape(ch) for ch in bare))
    return any(hidden.fullmatch(x) for x in _INSULTS)


def features(text: str | None, learned: frozenset, starts: frozenset) -> list[float]:
    """One value per FEATURES: densities are per word or per character; null and empty texts give zeros."""
    text = text or ""
    w, raw = tokens(text), text.encode("utf-8", "surrogatepass")
    n, chars, kinds = max(1, len(w)), max(1, len(text)), set(w)
    found = [kinds & _INSULTS, kinds & learned, {x for x in kinds if x[:START] in starts and len(x) >= START}]
    a, b, c = (sum(map(f.__contains__, w)) if f else 0 for f in found)
    you = sum(map(_SECOND.__contains__, w)) if kinds & _SECOND else 0
    near = 0
    if you and (a or b or c):
        hits = found[0] | found[1] | found[2]
        near = sum(any(x in _SECOND for x in w[max(0, i - 3):i + 4]) for i, y in enumerate(w) if y in hits)
    odd = _OBFUSCATED.findall(text) if _SIGNS.search(text) else []
    masked = sum(_unmasked(x) for x in text.lower().split() if _OBFUSCATED.search(x)) if odd else 0

    def share(kept: bytes) -> float:
        return (len(raw) - len(raw.translate(None, kept))) / chars

    return [a / n, min(a, 50), b / n, min(b, 50), c / n, min(c, 50), you / n, near / n, share(_CAPITALS), text.count("!") / chars,
            text.count("?") / chars, share(b".,;:"), share(b"0123456789"), len(odd) / n + masked,
            sum(map(str.__eq__, w, w[1:])) / n, float(np.log1p(len(w)))]


_CAPITALS = bytes(range(65, 91))
_INSULTS, _SECOND = frozenset(INSULTS), frozenset(SECOND)


def lexicon(texts: list[str], toxic: np.ndarray) -> tuple[frozenset, frozenset]:
    """Words, and starts of START characters, that labelled toxic texts hold far more often than others."""
    out = []
    for start in (None, START):
        seen = [Counter(), Counter()]
        for t, y in zip(texts, toxic):
            seen[int(y)].update({x[:start] for x in tokens(t) if len(x) >= (start or 3)})
        n0, n1 = max(1, int((toxic == 0).sum())), max(1, int((toxic == 1).sum()))
        odds = [((k + 0.5) / n1 / ((seen[0][x] + 0.5) / n0), k, x) for x, k in seen[1].items() if k >= 4]
        best = sorted((-o * np.sqrt(k), x) for o, k, x in odds if o >= 20)
        out.append(frozenset(x for _, x in best[:LEXICON]))
    return out[0], out[1]


class Boosted:
    """Trees of depth `depth` on binned features, each fitted to the logistic loss's gradient by Newton leaves."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 4.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.edges: list[np.ndarray] = []
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, self.bins + 1)[1:-1])) for i in range(x.shape[1])]
        b, rate = self._binned(x), float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
        self.base = np.log(rate / (1 - rate))
        f = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            inner = (1 << self.depth) - 1
            feat, cutoff = np.full(inner, -1), np.zeros(inner, dtype=int)
            at = np.zeros(len(y), dtype=int)
            for node in range(inner):
                mine = at == node
                if mine.sum() >= 2 * self.least:
                    gain, feat[node], cutoff[node] = self._split(b[mine], g[mine], h[mine])
                go = (b[:, feat[node]] > cutoff[node]) if feat[node] >= 0 else np.zeros(len(y), dtype=bool)
                at[mine] = 2 * node + 1 + go[mine]
            leaf = at - inner
            size = 1 << self.depth
            value = self.rate * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + 1.0)
            self.nodes.append((feat, cutoff, value))
            f += value[leaf]
        return self

    def _split(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
        best = (1e-9, -1, 0)
        all_g, all_h = g.sum(), h.sum()
        for i in range(b.shape[1]):
            n = len(self.edges[i]) + 1
            gl, hl, nl = (np.cumsum(np.bincount(b[:, i], w, n))[:-1] for w in (g, h, np.ones(len(g))))
            ok = (nl >= self.least) & (len(g) - nl >= self.least)
            gain = np.where(ok, gl**2 / (hl + 1) + (all_g - gl) ** 2 / (all_h - hl + 1) - all_g**2 / (all_h + 1), -1)
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), i, int(gain.argmax()))
        return best

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        f, rows, inner = np.full(len(x), self.base), np.arange(len(x)), (1 << self.depth) - 1
        for feat, cutoff, value in self.nodes:
            at = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                i = feat[at]
                at = 2 * at + 1 + ((i >= 0) & (b[rows, np.maximum(i, 0)] > cutoff[at]))
            f += value[at - inner]
        return f


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step fit of y on x by pooling neighbours: block starts and their means."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for v, t in zip(x[order], y[order]):
        blocks.append([v, float(t), 1.0])
        while len(blocks) > 1 and (blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2] or blocks[-2][0] == blocks[-1][0]):
            _, s, n = blocks.pop()
            blocks[-1][1] += s
            blocks[-1][2] += n
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Model:
    """Lexica, trees and calibration, fitted on labelled texts; without both labels it scores every text alike."""

    def __init__(self, texts: list[str], toxic: np.ndarray, folds: int = 3):
        self.rate = float(toxic.mean()) if len(toxic) else 0.0
        self.fitted = len(set(toxic.tolist())) == 2
        if not self.fitted:
            return
        fold = np.arange(len(texts)) % folds
        out = np.zeros(len(texts))
        if min((toxic == 0).sum(), (toxic == 1).sum()) >= 2 * folds:
            for k in range(folds):
                _, _, trees, x = self._trees([t for t, f in zip(texts, fold) if f != k], toxic[fold != k], [t for t, f in zip(texts, fold) if f == k])
                out[fold == k] = trees.margin(x)
            self.words, self.starts, self.trees, _ = self._trees(texts, toxic, [])
        else:
            self.words, self.starts, self.trees, x = self._trees(texts, toxic, texts)
            out = self.trees.margin(x)
        self.at, self.p = isotonic(out, toxic.astype(float))

    @staticmethod
    def _trees(texts, toxic, others):
        # a text's own label must not reach the lexicon that its features are made with: halves serve one another
        half, x = np.arange(len(texts)) % 2, np.zeros((len(texts), len(FEATURES)))
        for k in (0, 1):
            words, starts = lexicon([t for t, h in zip(texts, half) if h != k], toxic[half != k])
            for i in np.flatnonzero(half == k):
                x[i] = features(texts[i], words, starts)
        words, starts = lexicon(texts, toxic)
        trees = Boosted().fit(x, toxic.astype(float))
        return words, starts, trees, np.array([features(t, words, starts) for t in others]).reshape(len(others), len(FEATURES))

    def scores(self, texts) -> np.ndarray:
        if not self.fitted or not len(texts):
            return np.full(len(texts), self.rate)
        f = self.trees.margin(np.array([features(t, self.words, self.starts) for t in texts]))
        i = np.maximum(np.searchsorted(self.at, f, side="right") - 1, 0)
        smooth = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        return np.clip(0.98 * self.p[i] + 0.02 * smooth, 0.0, 1.0)


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of labelled rows (doc_id, toxic) that are 0 or 1; an id with both counts as toxic.

    `sample` bounds them, and so the rows that reach the driver: of an id with several texts in `docs` the first by a hash of
    the text is taken. Without rows, or with one label only, every text scores alike.
    """
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = cut(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    got = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    which = got.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("th"))
    got = got.join(F.broadcast(cut(which)).withColumnRenamed("doc_id", "_id"), (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("th")))
    got = got.groupBy("doc_id", "toxic").agg(F.first("text").alias("text"))
    rows = got.select(F.xxhash64("doc_id").alias("h"), "doc_id", "text", "toxic").orderBy("h", "doc_id").collect()
    return Model([r["text"] or "" for r in rows], np.array([r["toxic"] for r in rows], dtype=int))


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every row; null texts score as empty ones, repeated rows alike. Ids, null ones
    too, pass as they are, and further columns play no part. An empty table gives no rows.
    """
    spark = docs.sparkSession
    # lexica of LEXICON entries and trees of fixed depth, with their code
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = cloudpickle.loads(sent.value)
        for b in batches:
            s = ready.scores([x.as_py() for x in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by a model of the labels that are not held out; see fitted() and scored()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = fitted(docs, labels.where(~out))
    got = scored(docs, model)
    return got.select("doc_id", out.alias("held_out"), "score", "predicted")
