"""Problem 10: reading level of each document."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.words import _NO_WORD, _P, _WORD_BYTE, _POWERS, mix
from sievework.session import spread

BANDS = 4
MIN_WORDS = 60
#: The models are fitted on at most so many labelled documents (least hashes of their ids first).
MAX_LABELLED = 6000
#: A word is known when so many labelled documents hold it; all others are one unknown word.
KNOWN_IN = 3
FOLDS = 5

# Frequent function words by which the language of an unlabelled text is told.
_FUNCTION_WORDS = {
    "en": "the of and to in is was were that it with for as by on at from had he she we they this which but not or be are an".split(),
    "de": "der die das und ist in ein eine den mit von zu auf für nicht dass sich im laut bei auch bleibt".split(),
    "fr": "le la les de des et est une un dans en pour que qui sur avec par selon du reste malgré près".split(),
    "es": "el la los las de y es una un en que por con para según del se al durante cerca pesar".split(),
}
_HEADER = re.compile(r"<!--.*?-->", re.S)
_LETTERS = re.compile(r"[^\W\d_]+")


def is_english(text: str, lang: str | None) -> bool:
    """``lang`` where it is given; else most function words must be English ones."""
    if lang is not None and lang.strip():
        return lang.strip().lower().split("-")[0] == "en"
    words = _LETTERS.findall(_HEADER.sub(" ", text).lower())
    if not words:
        return False
    share = {k: sum(w in s for w in words) for k, s in ((k, frozenset(v)) for k, v in _FUNCTION_WORDS.items())}
    best = max(share, key=lambda k: (share[k], k == "en"))
    return best == "en" and share["en"] * 20 >= len(words)


_DIGIT = bytes(48 if 48 <= i <= 57 else i for i in range(256))
_STOP = np.zeros(256, bool)
_STOP[[ord("."), ord("!"), ord("?"), ord("\n")]] = True


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes (digits count as 0), the sentence number of each word, and where texts begin.
    Comment headers are left out; no sentence goes over a text's end."""
    parts = []
    for t in texts:
        low = (_HEADER.sub(" ", t) if t.lstrip().startswith("<!--") else t).lower()
        if not low.isascii():
            low = re.sub(r"[^\w\s.!?]", " ", low)
        parts.append(low.encode("utf-8", "replace").translate(_DIGIT))
    buf = np.frombuffer(b"\n".join([b"", *parts, b""]), np.uint8)
    begins = np.cumsum([1, *(len(p) + 1 for p in parts)])
    is_word = _WORD_BYTE[buf]
    edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    lengths = ends - starts
    positions = np.flatnonzero(is_word)
    within = positions - np.repeat(starts, lengths)
    values = (buf[positions].astype(np.uint64) + np.uint64(1)) * _POWERS[within & 63]
    sums = np.add.reduceat(values, np.concatenate(([0], np.cumsum(lengths)[:-1])))
    stops = np.cumsum(_STOP[buf])
    sentence = stops[starts]
    sentence = np.concatenate(([0], np.cumsum(sentence[1:] != sentence[:-1])))
    return mix(sums + lengths.astype(np.uint64)), sentence, np.searchsorted(starts, begins)


class GradedModels:
    """One interpolated trigram model (Witten-Bell) for each band, in shared tables."""

    def __init__(self, texts: list[str], bands: list[int]):
        words, sentence, at = tokens(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(at))
        pairs = np.unique(np.stack([words, owner.astype(np.uint64)], 1), axis=0)
        vocab, docs = np.unique(pairs[:, 0], return_counts=True)
        self.vocab = vocab[docs >= min(KNOWN_IN, max(1, len(texts) // 20))]
        self.size = np.uint64(len(self.vocab) + 2)
        ids = self._ids(words)
        band = np.array(bands, np.int64)[owner] - 1 if len(owner) else np.empty(0, np.int64)
        one, two, three = self._grams(ids, sentence)
        self.keys, counts = [], []
        for k in (one, two, three):
            u, inverse = np.unique(k, return_inverse=True)
            c = np.zeros((len(u), BANDS))
            np.add.at(c, (inverse, band), 1)
            self.keys.append(u)
            counts.append(c)
        c1, c2, c3 = counts
        uni = (c1 + 0.5) / (c1.sum(0) + 0.5 * (len(c1) + 1)) if len(c1) else c1
        self.unseen = 0.5 / (c1.sum(0) + 0.5 * (len(c1) + 1)) if len(c1) else np.full(BANDS, 1e-6)
        self.uni = uni
        self.ml2, self.lam2 = self._interpolate(self.keys[1], c2)
        self.ml3, self.lam3 = self._interpolate(self.keys[2], c3)

    def _ids(self, words: np.ndarray) -> np.ndarray:
        if not len(self.vocab):
            return np.ones(len(words), np.uint64)
        pos = np.minimum(np.searchsorted(self.vocab, words), len(self.vocab) - 1)
        return np.where(self.vocab[pos] == words, pos + 2, 1).astype(np.uint64)

    def _grams(self, ids: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of each word, of it after the word before, and after the two before; 0 starts."""
        same = np.concatenate(([False], sentence[1:] == sentence[:-1])) if len(ids) else np.empty(0, bool)
        before = np.where(same, np.concatenate(([0], ids[:-1])).astype(np.uint64), np.uint64(0)) if len(ids) else ids
        same2 = np.concatenate(([False], same[:-1])) & same if len(ids) else same
        before2 = np.where(same2, np.concatenate(([0, 0], ids[:-2])).astype(np.uint64)[: len(ids)], np.uint64(0)) if len(ids) else ids
        two = before * self.size + ids
        return ids, two, before2 * self.size * self.size + two

    def _interpolate(self, keys: np.ndarray, c: np.ndarray):
        """Relative frequency after the context, and per context the weight of this order."""
        ctx = keys // self.size
        u, inverse = np.unique(ctx, return_inverse=True)
        total, kinds = np.zeros((len(u), BANDS)), np.zeros((len(u), BANDS))
        np.add.at(total, inverse, c)
        np.add.at(kinds, inverse, c > 0)
        ml = c / np.maximum(total[inverse], 1e-9)
        return ml, (u, total / np.maximum(total + kinds, 1e-9))

    @staticmethod
    def _look(keys: np.ndarray, table: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros((len(at), BANDS))
        pos = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
        out = table[pos]
        out[keys[pos] != at] = 0
        return out

    def surprisals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Surprisal (nats) of every sentence of all texts under each band's model, words of each
        sentence, its text."""
        words, sentence, at = tokens(texts)
        if not len(words):
            return np.zeros((0, BANDS)), np.zeros(0), np.zeros(0, np.int64)
        one, two, three = self._grams(self._ids(words), sentence)
        p = self._look(self.keys[0], self.uni, one)
        p = np.where(p > 0, p, self.unseen)
        for keys, ml, (ctx, lam), gram in ((self.keys[1], self.ml2, self.lam2, two), (self.keys[2], self.ml3, self.lam3, three)):
            weight = self._look(ctx, lam, gram // self.size)
            p = weight * self._look(keys, ml, gram) + (1 - weight) * p
        first = np.flatnonzero(np.concatenate(([True], sentence[1:] != sentence[:-1])))
        owner = np.searchsorted(at, first, side="right") - 1
        return np.add.reduceat(-np.log(p), first, axis=0), np.diff(np.append(first, len(words))), owner

    def scores(self, texts: list[str]) -> np.ndarray:
        """Difficulty of each text, from the distribution of its sentences' surprisals: the mean over
        its words of the band expected for their sentence. Not a number for texts without words."""
        surprisal, words, owner = self.surprisals(texts)
        rel = np.exp(np.clip(surprisal.min(1, keepdims=True) - surprisal, -60, 0)) if len(words) else surprisal
        level = (rel * np.arange(1, BANDS + 1)).sum(1) / rel.sum(1) if len(words) else words
        total = np.bincount(owner, words * level, len(texts)) if len(words) else np.zeros(len(texts))
        weight = np.bincount(owner, words, len(texts)) if len(words) else np.zeros(len(texts))
        with np.errstate(invalid="ignore", divide="ignore"):
            return total / weight


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the non-decreasing least-squares fit (pool adjacent violators): x and level."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # level, weight, first x, last x
    for i in order:
        blocks.append([y[i], w[i], x[i], x[i]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            total = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2], b[3]])
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    return xs, np.array([b[0] for b in blocks for _ in (0, 1)])


class ReadingLevel:
    """Models of all labelled texts and the monotone map from their score to a band: ``bands`` gives
    the band of texts."""

    def __init__(self, models: GradedModels, scores: np.ndarray, bands: np.ndarray):
        self.models = models
        ok = ~np.isnan(scores)
        self.x, self.level = isotonic(scores[ok], bands[ok], np.ones(ok.sum())) if ok.any() else (np.array([1.0, 4.0]), np.array([1.0, 4.0]))

    def bands(self, texts: list[str]) -> np.ndarray:
        level = np.interp(np.nan_to_num(self.models.scores(texts), nan=1.0), self.x, self.level)
        return np.clip(np.floor(level + 0.5), 1, BANDS).astype(np.int64)


def _fit_part(texts: list[str], grades: list[int]):
    """part -> part, what came of it: scores of a fold's texts by models of the other folds, or the
    models of all texts for the part ``FOLDS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = np.arange(len(texts)) % FOLDS
        for batch in batches:
            made = []
            for part in batch.column("part").to_pylist():
                own, other = np.flatnonzero(fold == part), np.flatnonzero(fold != part)
                models = GradedModels([texts[i] for i in other], [grades[i] for i in other])
                made.append(pickle.dumps(models if part == FOLDS else models.scores([texts[i] for i in own])))
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(made, pa.binary())], ["part", "made"])

    return run


def fit_reading_level(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> ReadingLevel:
    """Fitted on the labelled English documents, at most ``most`` of them, which are chosen by their
    ids before any text is read; a document's raters count once each, and their median is its band.

    Each text is scored by models that have not seen it. The models of the folds and those of all texts
    are fitted side by side, each in a task of its own.
    """
    spark = documents.sparkSession
    votes = labels.where("doc_id is not null and band between 1 and 4").select("doc_id", "rater", "band").distinct()
    label = votes.groupBy("doc_id").agg(F.expr("percentile(band, 0.5)").alias("band")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = documents.where("text is not null").select("doc_id", "text", "lang").join(F.broadcast(label), "doc_id")  # at most ``most`` rows are broadcast
    rows = texts.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "band")).alias("r")).select("doc_id", "r.*").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    rows = [r for r in rows if is_english(r.text, r.lang)]
    known, bands = [r.text for r in rows], np.array([float(r.band) for r in rows])
    grades = [int(min(max(round(b), 1), BANDS)) for b in bands]
    if len(rows) < 2 * FOLDS:
        return ReadingLevel(GradedModels(known, grades), np.full(len(rows), np.nan), bands)
    parts = spark.range(0, FOLDS + 1, 1, FOLDS + 1).withColumnRenamed("id", "part").mapInArrow(_fit_part(known, grades), "part bigint, made binary")
    made = {r.part: pickle.loads(r.made) for r in parts.collect()}
    scores = np.full(len(rows), np.nan)
    for k in range(FOLDS):
        scores[k::FOLDS] = made[k]
    return ReadingLevel(made[FOLDS], scores, bands)


def _graded(model: ReadingLevel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 400):
                batch = whole.slice(lo, 400)
                ids, texts = [], []
                for doc_id, text, lang in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang"))):
                    if is_english(text, lang) and len(text.split()) >= MIN_WORDS:
                        ids.append(doc_id)
                        texts.append(text)
                bands = model.bands(texts) if texts else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bands, pa.int64())], ["doc_id", "band"])

    return run


def reading_bands(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, band`` of each English document of at least 60 words.

    Null and shorter texts and other languages give no row; a null ``lang`` is told from the text;
    repeated rows of an id give one row. Without labels the score itself is rounded.
    """
    model = fit_reading_level(documents, labels)
    rows = documents.where("doc_id is not null and text is not null and (lang is null or trim(lang) = '' or lower(lang) like 'en%')").select("doc_id", "text", "lang")
    return spread(rows).mapInArrow(_graded(model), "doc_id bigint, band bigint").groupBy("doc_id").agg(F.min("band").alias("band"))
