"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are whole words and the beginnings of words (``PREFIXES`` letters), which catch word stems in any language; a term that stands several times in a text counts as
further terms (``GRADES``), as once may be chance. The
vocabulary is what a chi-square test finds to go with the label in the training rows; it is counted by Spark. Examples are
vectors of (1 + ln tf) * idf over that vocabulary, of length 1.

The inverted index lists, for each term, the examples that hold it, in blocks of ``block`` neighbouring examples. The
largest weight of a term in each block bounds what the block's examples can reach. A query adds these bounds over its
terms, goes through the blocks from the highest bound down, and stops when the bound is below the last of the nearest
found: no example that could be nearer is left out.

The neighbours vote with their cosines. Votes become probabilities by a logistic curve fitted on
the training rows' own votes, each row left out of its own search. Texts without any term of the vocabulary have no
neighbours and get the share of label 1 among such training rows.

The model is fitted on a bounded sample of labelled rows: ``train_rows`` texts of up to ``longest`` bytes, of which the
driver gets at most ``terms`` weights each, no texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN
from .quality import training_sample

WORD = re.compile(r"[^\W_]+")
PREFIXES = (3, 4, 5, 6)
#: A term that stands so often in a text counts there as a further term.
GRADES = (2, 4)


@dataclass(frozen=True)
class Settings:
    terms: int = 1024
    #: A term must stand in so many training texts and in such a share of them, and reach so much in the chi-square test (about one in 10^7 by chance).
    least_texts: int = 3
    least_share: float = 0.0025
    least_chi2: float = 28.0
    neighbours: int = 15
    block: int = 32
    train_rows: int = 8000
    longest: int = 250_000
    seed: int = 11
    cache: int = 200_000


def terms_of(word: str) -> list[str]:
    """``=word`` and ``^beginning`` for each length that the word has."""
    return [f"={word}", *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n)]


def graded(term: str, n: int) -> list[str]:
    return [term, *(f"{term}*{g}" for g in GRADES if n >= g)]


def text_terms(text: str | None) -> list[str]:
    """A whole text's distinct terms with their grades."""
    found: Counter = Counter()
    for word, n in Counter(WORD.findall((text or "").lower())).items():
        for term in terms_of(word):
            found[term] += n
    return [g for term, n in found.items() for g in graded(term, n)]


@dataclass
class Index:
    """Postings by term and block, with the largest weight of each term in each block."""

    vectors: list[tuple[np.ndarray, np.ndarray]]
    n_terms: int
    block: int

    def __post_init__(self) -> None:
        n_blocks = -(-len(self.vectors) // self.block)
        self.peaks = np.zeros((self.n_terms, n_blocks))
        owners = np.repeat(np.arange(len(self.vectors)), [len(t) for t, _ in self.vectors])
        terms = np.concatenate([t for t, _ in self.vectors]) if self.vectors else np.zeros(0, np.int64)
        weights = np.concatenate([w for _, w in self.vectors]) if self.vectors else np.zeros(0)
        blocks = owners // self.block
        np.maximum.at(self.peaks, (terms, blocks), weights)
        order = np.lexsort((owners, terms, blocks))
        self.slots, self.weights = (owners % self.block)[order], weights[order]
        # where the postings of (block, term) begin
        self.starts = np.searchsorted(blocks[order] * self.n_terms + terms[order], np.arange(n_blocks * self.n_terms + 1))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples (without ``but``) of the largest cosine above 0, nearest first, ties to the earlier one."""
        if not len(terms) or not self.peaks.shape[1]:
            return np.zeros(0, np.int64), np.zeros(0)
        bounds = weights @ self.peaks[terms]
        found, cosines, last = np.zeros(0, np.int64), np.zeros(0), 0.0
        for b in np.argsort(-bounds, kind="stable"):
            # bound and cosine are sums in different orders: a hair of slack keeps the stop exact
            if bounds[b] <= 0 or len(found) == k and bounds[b] * (1 + 1e-12) < last:
                break
            scores = np.zeros(self.block)
            for t, w in zip(terms, weights):
                lo, hi = self.starts[b * self.n_terms + t], self.starts[b * self.n_terms + t + 1]
                scores[self.slots[lo:hi]] += w * self.weights[lo:hi]
            hits = np.flatnonzero(scores > 0)
            ids = b * self.block + hits
            scores, ids = scores[hits][ids != but], ids[ids != but]
            found, cosines = np.concatenate([found, ids]), np.concatenate([cosines, scores])
            best = np.lexsort((found, -cosines))[:k]
            found, cosines = found[best], cosines[best]
            last = cosines[-1] if len(cosines) else 0.0
        return found, cosines


def vote(labels: np.ndarray, cosines: np.ndarray) -> float:
    """From -1 to 1: each neighbour votes for its label with its cosine, so that far ones say little either way."""
    return float((cosines * (2 * labels - 1)).mean())


def curve(votes: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope (0 or more) and offset of the logistic curve from votes to probabilities, by Newton steps on smoothed labels."""
    pos, neg = int(labels.sum()), int(len(labels) - labels.sum())
    y = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    # a vote for each label, so that votes of one label alone still give a curve
    x, y, weight = np.append(votes, [-1.0, 1.0]), np.append(y, [1 / (neg + 2), (pos + 1) / (pos + 2)]), np.append(np.ones(len(votes)), [1.0, 1.0])
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([(weight * (p - y) * x).sum() + 1e-3 * a, (weight * (p - y)).sum()])
        h = weight * p * (1 - p)
        m = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-9]])
        move = np.linalg.solve(m, g)
        a, b = a - float(np.clip(move[0], -2, 2)), b - float(np.clip(move[1], -2, 2))
    return max(a, 0.0), b


@dataclass
class Model:
    vocabulary: dict[str, int]
    idf: np.ndarray
    index: Index
    ids: np.ndarray
    labels: np.ndarray
    settings: Settings
    slope: float = 1.0
    offset: float = 0.0
    without: float = 0.5
    _bases: dict[str, tuple[tuple[int, int], ...]] | None = field(default=None, repr=False)
    _words: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)
    _found: dict[tuple, tuple] = field(default_factory=dict, repr=False)

    @property
    def bases(self) -> dict[str, tuple[tuple[int, int], ...]]:
        """Ungraded terms, and the (least tf, term) of each grade of theirs in the vocabulary."""
        if self._bases is None:
            found: dict[str, list[tuple[int, int]]] = {}
            for term, t in self.vocabulary.items():
                base, _, grade = term.partition("*")
                found.setdefault(base, []).append((int(grade or 1), t))
            self._bases = {b: tuple(g) for b, g in found.items()}
        return self._bases

    def of_word(self, word: str) -> tuple[str, ...]:
        terms = self._words.get(word)
        if terms is None:
            terms = tuple(t for t in terms_of(word) if t in self.bases)
            if len(word) < 64:
                if len(self._words) >= self.settings.cache:
                    self._words.clear()
                self._words[word] = terms
        return terms

    def counts(self, text: str | None) -> tuple[tuple[int, int], ...]:
        """(term, tf) of a whole text in the vocabulary, by term."""
        found: dict[str, int] = {}
        for word, n in Counter(WORD.findall((text or "").lower())).items():
            for base in self.of_word(word):
                found[base] = found.get(base, 0) + n
        return tuple(sorted((t, n) for base, n in found.items() for least, t in self.bases[base] if n >= least))

    def score(self, text: str | None, k: int) -> tuple[float, list[int], list[float], list[int]]:
        """Score, and the ids, cosines and labels of the ``k`` nearest examples."""
        counts = self.counts(text)
        if not counts:
            return self.without, [], [], []
        if counts not in self._found:
            if len(self._found) >= 10_000:
                self._found.clear()
            near, cosines = self.index.nearest(*vector(counts, self.idf), self.settings.neighbours)
            p = self.without
            if len(near):
                p = float(1 / (1 + np.exp(-(self.slope * vote(self.labels[near], cosines) + self.offset))))
            self._found[counts] = p, self.ids[near[:k]].tolist(), cosines[:k].tolist(), self.labels[near[:k]].tolist()
        return self._found[counts]


def vector(counts: tuple[tuple[int, int], ...], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    terms, tf = np.array([t for t, _ in counts], np.int64), np.array([n for _, n in counts], float)
    w = (1 + np.log(tf)) * idf[terms] if len(counts) else tf
    return terms, w / max(float(np.sqrt((w * w).sum())), 1e-300)


def fit(vocabulary: list[tuple[str, int]], examples: list[tuple[int, int, list[int], list[int]]], s: Settings = Settings()) -> Model:
    """``vocabulary``: (term, training texts that hold it); ``examples``: (id, label, terms, tfs), with or without terms."""
    n = len(examples)
    idf = np.array([np.log((1 + n) / (1 + df)) + 1 for _, df in vocabulary])
    held = sorted((e for e in examples if e[2]), key=lambda e: (sorted(zip(e[2], e[3])), e[0]))  # alike texts share blocks
    bare = [e[1] for e in examples if not e[2]]
    vectors = [vector(tuple(sorted(zip(e[2], e[3]))), idf) for e in held]
    index = Index(vectors, len(vocabulary), s.block)
    labels = np.array([e[1] for e in held], np.int64)
    model = Model({t: k for k, (t, _) in enumerate(vocabulary)}, idf, index, np.array([e[0] for e in held], np.int64), labels, s)
    model.without = (sum(bare) + 1) / (len(bare) + 2)
    votes, known = [], []
    for k, v in enumerate(vectors):
        near, cosines = index.nearest(*v, s.neighbours, but=k)
        if len(near):
            votes.append(vote(labels[near], cosines))
            known.append(labels[k])
    if votes:
        model.slope, model.offset = curve(np.array(votes), np.array(known))
    else:
        model.slope, model.offset = 0.0, float(np.log(model.without / (1 - model.without)))
    return model


def fit_on(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> Model:
    """Counts terms and makes the examples' vectors on the executors; the driver gets the vocabulary and those vectors."""
    s = settings
    sample = training_sample(docs, labels, label_col, id_col, text_col, usable, s).select(F.col(f"{OWN}id").cast("long").alias("i"), F.col(f"{OWN}y").alias("y"), F.col(f"{OWN}text").alias("t")).dropDuplicates(["t", "y"]).repartition(64, "i").persist()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([pos[t] for t in n], pa.int64())], names=["term", "n", "pos"])

        n, pos = Counter(), Counter()
        for b in batches:
            for y, text in zip(b.column("y").to_pylist(), b.column("t").to_pylist()):
                terms = text_terms(text)
                n.update(terms)
                if y == 1:
                    pos.update(terms)
                if len(n) > 200_000:
                    yield flushed()
                    n, pos = Counter(), Counter()
        yield flushed()

    try:
        total, positive = sample.agg(F.count("*"), F.coalesce(F.sum((F.col("y") == 1).cast("long")), F.lit(0))).first()
        a, b = F.col("pos"), F.col("n") - F.col("pos")
        c, d = F.lit(positive) - a, F.lit(total - positive) - b
        miss = (a * d - b * c).cast("double")
        chi2 = total * miss * miss / F.greatest(F.lit(1.0), (a + b).cast("double") * (c + d) * (a + c) * (b + d))
        terms = sample.mapInArrow(counted, "term string, n bigint, pos bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
        chosen = terms.filter(F.col("n") >= max(s.least_texts, round(s.least_share * total))).withColumn("chi2", chi2).filter(F.col("chi2") >= s.least_chi2).orderBy(F.desc("chi2"), "term").limit(s.terms).collect()
        vocabulary = [(r["term"], r["n"]) for r in chosen]
        reader = Model({t: k for k, (t, _) in enumerate(vocabulary)}, np.zeros(0), Index([], 0, s.block), np.zeros(0), np.zeros(0), s)

        def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                counts = [reader.counts(t) for t in b.t]
                yield pd.DataFrame({"i": b.i, "y": b.y, "terms": [[t for t, _ in x] for x in counts], "tfs": [[n for _, n in x] for x in counts]})

        examples = sample.mapInPandas(vectors, "i bigint, y int, terms array<int>, tfs array<int>").collect()
    finally:
        sample.unpersist()
    return fit(vocabulary, [(r["i"], int(r["y"] == 1), list(r["terms"]), list(r["tfs"])) for r in examples], s)


SCORED = "score double, evidence_ids array<bigint>, evidence_cosines array<double>, evidence_labels array<int>"
_workers: dict[int, Model] = {}


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", evidence: int = 5) -> DataFrame:
    """``docs`` with ``score`` (probability of label 1) of every whole text and its nearest examples: ids, cosines, labels.

    Null and empty texts, and texts without a term of the vocabulary, have no neighbours and get the share of label 1 among
    such training rows. Equal cosines go to the example that stands earlier in the index. Repeated rows get equal scores.
    Columns of the added names are replaced; other columns stay. A model without examples gives one score to all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(SCORED)
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        key = id(shared.value)
        if key not in _workers:
            _workers.clear()
            _workers[key] = shared.value
        own = _workers[key]
        for batch in texts:
            rows = [own.score(t, evidence) for t in batch]
            yield pd.DataFrame({"score": [r[0] for r in rows], "evidence_ids": [r[1] for r in rows], "evidence_cosines": [r[2] for r in rows], "evidence_labels": [r[3] for r in rows]})

    names = ("score", "evidence_ids", "evidence_cosines", "evidence_labels")
    return docs.withColumn(f"{OWN}s", scored(F.col(text_col))).withColumns({n: F.col(f"{OWN}s.{n}") for n in names}).drop(f"{OWN}s")
