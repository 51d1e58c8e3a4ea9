"""Quality classifier: supervised subword embeddings.

Each white-space word and each of its character n-grams (with word marks) has a learned vector, found by hashing. A
word is the average of its own, a text the average of its words; a softmax layer over that gives the label's
probability. A word that repeats the one before it is read as one mark, so that the vectors can tell stuck texts.
Training is plain numpy stochastic gradient descent (with adaptive steps) on a bounded sample of labelled rows
(``train_rows``, of texts up to ``longest`` bytes); scoring reads every whole text.

The layers are linear, so after training one weight per hash bucket is left (the vector times the output layer): that
array, of fixed size, is what is broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain, groupby
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 17
    dim: int = 8
    min_n: int = 3
    max_n: int = 4
    epochs: int = 6
    batch: int = 32
    rate: float = 0.05
    train_rows: int = 4000
    longest: int = 250_000
    seed: int = 7
    cache_words: int = 400_000
    piece_words: int = 100_000


def feature_ids(word: str, s: Settings) -> list[int]:
    """Buckets of a word and of the character n-grams of ``<word>``."""
    mask, marked = s.buckets - 1, f"<{word}>"
    ids = [crc32(word.encode()) & mask]
    for n in range(s.min_n, s.max_n + 1):
        ids += [crc32(marked[i : i + n].encode()) & mask for i in range(len(marked) - n + 1)]
    return ids


@cache
def _tables(n: int) -> tuple[np.ndarray, int]:
    """For strings of ``n`` bytes: what each byte at each place adds to the CRC-32, by xor, and what strings of ``n`` zeros have."""
    zeros = crc32(bytes(n))
    return np.array([[crc32(bytes(at) + bytes([b]) + bytes(n - 1 - at)) ^ zeros for b in range(256)] for at in range(n)], np.uint32), zeros


def features_of(words: list[str], s: Settings) -> np.ndarray:
    """``feature_ids`` of ASCII words of one length, a row for each: CRC-32 is linear, so n-grams are hashed for all words at once."""
    size, mask = len(words[0]), s.buckets - 1
    marked = np.full((len(words), size + 2), ord(">"), np.uint8)
    marked[:, 0] = ord("<")
    marked[:, 1:-1] = np.frombuffer("".join(words).encode("ascii"), np.uint8).reshape(len(words), size)
    ids = [np.fromiter((crc32(w.encode()) for w in words), np.uint32, len(words))[:, None]]
    for n in range(s.min_n, min(s.max_n, size + 2) + 1):
        table, zeros = _tables(n)
        grams = np.full((len(words), size + 3 - n), zeros, np.uint32)
        for at in range(n):
            grams ^= table[at][marked[:, at : at + size + 3 - n]]
        ids.append(grams)
    return np.concatenate(ids, axis=1) & np.uint32(mask)


SAME = "\0same"


def words_of(text: str | None) -> list[str]:
    words = (text or "").split()
    return words[:1] + [SAME if w == before else w for before, w in zip(words, words[1:])]


def averages(text: str | None, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets and their shares."""
    shares: Counter = Counter()
    for word, n in Counter(words_of(text)).items():
        ids = feature_ids(word, s)
        for f in ids:
            shares[f] += n / len(ids)
    w = np.fromiter(shares.values(), np.float32, len(shares))
    return np.fromiter(shares.keys(), np.int32, len(shares)), w / max(w.sum(), 1e-9)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    settings: Settings


def fit(texts: list[str | None], labels: list[int], s: Settings = Settings()) -> Model:
    """Fits the vectors and the output layer. With one class or no rows, the score is the smoothed share of label 1."""
    y = np.asarray(labels, np.int64)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(s.buckets, np.float32), float(np.log(share / (1 - share))), s)
    rng = np.random.default_rng(s.seed)
    docs = [averages(t, s) for t in texts]
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    out, bias = np.zeros((s.dim, 2), np.float32), np.zeros(2, np.float32)
    # each weight's step is divided by the root of its squared gradients so far: rare words move as much as common ones
    seen_vectors, seen_out, seen_bias = np.zeros_like(vectors), np.zeros_like(out), np.zeros_like(bias)
    steps, done = s.epochs * -(-len(y) // s.batch), 0
    for _ in range(s.epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), s.batch):
            rows = order[at : at + s.batch]
            rate, done = s.rate * (1 - done / steps), done + 1
            sizes = [len(docs[r][0]) for r in rows]
            ids = np.concatenate([docs[r][0] for r in rows])
            share = np.concatenate([docs[r][1] for r in rows])
            owner = np.repeat(np.arange(len(rows)), sizes)
            gathered = vectors[ids] * share[:, None]
            hidden = np.zeros((len(rows), s.dim), np.float32)
            np.add.at(hidden, owner, gathered)
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            back, grad = p @ out.T, p.sum(0)
            touched, where = np.unique(ids, return_inverse=True)
            step = np.zeros((len(touched), s.dim), np.float32)
            np.add.at(step, where, back[owner] * share[:, None])
            for value, g, seen, at_rows in ((vectors, step, seen_vectors, touched), (out, hidden.T @ p, seen_out, slice(None)), (bias, grad, seen_bias, slice(None))):
                seen[at_rows] += g * g
                value[at_rows] -= rate * g / np.sqrt(seen[at_rows] + 1e-12)
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]), s)


class Words(dict):
    """Word to the mean of its features' weights. What a piece of text has of new words is learned at once."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        return float(self.model.weights[feature_ids(word, self.model.settings)].mean())

    def learn(self, words: Iterable[str]) -> None:
        """Takes up the words of less than 100 characters; of at most ``piece_words`` at a time, so that the cache is bounded."""
        words = {w for w in set(words) if len(w) < 100}
        new = words.difference(self)
        if len(self) + len(new) > self.model.settings.cache_words:
            self.clear()
            new = words
        plain = sorted((w for w in new if w.isascii()), key=len)
        for _, own in groupby(plain, len):
            own = list(own)
            self.update(zip(own, self.model.weights[features_of(own, self.model.settings)].mean(axis=1).tolist()))
        self.update((w, self.__missing__(w)) for w in new if not w.isascii())

    def _score(self, words: list[str], values: Iterator[float]) -> float:
        z = self.model.bias + sum(values) / max(1, len(words))
        return float(1 / (1 + np.exp(-z)))

    def _piece(self, texts: list[list[str]]) -> Iterator[float]:
        """Scores of texts that are together a piece, or of one longer text, a piece of it at a time."""
        size = self.model.settings.piece_words
        if len(texts) == 1 and len(texts[0]) > size:
            words = texts[0]
            yield self._score(words, chain.from_iterable(self._values(words[at : at + size]) for at in range(0, len(words), size)))
            return
        self.learn(chain.from_iterable(texts))
        for words in texts:
            yield self._score(words, map(self.__getitem__, words))

    def _values(self, words: list[str]) -> Iterator[float]:
        self.learn(words)
        return map(self.__getitem__, words)

    def scores(self, texts: Iterable[str | None]) -> Iterator[float]:
        """The score of every whole text, in order."""
        held, n = [], 0
        for text in texts:
            words = words_of(text)
            if held and n + len(words) > self.model.settings.piece_words:
                yield from self._piece(held)
                held, n = [], 0
            held.append(words)
            n += len(words)
        if held:
            yield from self._piece(held)

    def score(self, text: str | None) -> float:
        return next(self.scores([text]))


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, usable: Column, s: Settings) -> DataFrame:
    """At most ``train_rows`` labelled texts of up to ``longest`` bytes, chosen by a hash of the id among the rows that ``usable`` allows."""
    keyed = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & usable).select(F.col(id_col).alias(f"{OWN}id"), F.col(label_col).cast("int").alias(f"{OWN}y"))
    order = F.xxhash64(F.lit(s.seed), f"{OWN}id")
    share = min(1.0, 1.5 * s.train_rows / max(1, keyed.count()))
    chosen = keyed.filter(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(order, f"{OWN}id", f"{OWN}y").limit(s.train_rows)
    # at most train_rows ids and labels: small enough to broadcast at any size of the corpus
    texts = docs.select(F.col(id_col).alias(f"{OWN}id"), F.col(text_col).alias(f"{OWN}text")).filter(F.coalesce(F.octet_length(f"{OWN}text"), F.lit(0)) <= s.longest)
    return texts.join(F.broadcast(chosen), f"{OWN}id").orderBy(order, f"{OWN}text").limit(s.train_rows)


def fit_on(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> Model:
    rows = training_sample(docs, labels, label_col, id_col, text_col, usable, settings).collect()
    return fit([r[f"{OWN}text"] for r in rows], [r[f"{OWN}y"] for r in rows], settings)


_workers: dict[int, Words] = {}


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 of every whole text.

    Null and empty texts get the probability that the output layer's bias alone gives. Repeated rows get equal scores.
    A column with the name ``out_col`` is replaced; other columns stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key = id(shared.value)
        if key not in _workers:
            _workers.clear()
            _workers[key] = Words(shared.value)
        words = _workers[key]
        for batch in texts:
            yield pd.Series(list(words.scores(batch)), dtype="float64")

    return docs.withColumn(out_col, scored(F.col(text_col)))
