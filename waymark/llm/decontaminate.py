"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are put in size classes. Each item keeps a bottom-k MinHash sketch of its word shingles, with k set by its
class so that a text which holds the wanted share of the item must hold at least one sketched shingle: a text can lack
floor((1 - share) * size) of them, and k is one more than that for the class's largest size. So the search loses
nothing. Texts stream past the sketches (long texts need no signature of their own, which short items would drown in);
each candidate is verified by exact shingle containment in the same task, so no text is shuffled.

Items are read in blocks of about ``block_words`` words; a block's sketches are broadcast. Each block is a scan of its own,
so neither the driver nor a worker holds more than one, and a larger benchmark takes more scans.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, written

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Words in UTF-8, A-Z lower-cased: runs of letters and digits, with all characters beyond ASCII among them."""
    return WORD.findall((text or "").encode(errors="surrogatepass").lower())


def codes(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit code of each run of ``n`` word numbers."""
    out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for j in range(n):
        out = (out + ids[j : j + len(out)].astype(np.uint64)) * FACTOR
        out ^= out >> np.uint64(29)
    return out


class Sketches:
    """Sketches of a block of items: by shingle length, sketched codes and the items that have them."""

    def __init__(self, items: list[tuple[int, str | None]], n: int, percent: int):
        self.percent, self.vocabulary = percent, {}
        self.shingles: list[tuple[int, int, set[tuple[int, ...]]]] = []  # item id, shingle length, shingles
        postings: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if not ids:
                continue
            length = min(n, len(ids))
            grams = {tuple(ids[i : i + length]) for i in range(len(ids) - length + 1)}
            largest = 1 << (len(grams) - 1).bit_length()  # of the size class
            k = min(len(grams), largest * (100 - percent) // 100 + 1)
            for code in np.sort([codes(np.array(g), length)[0] for g in grams])[:k]:
                postings[length][int(code)].append(len(self.shingles))
            self.shingles.append((item_id, length, grams))
        self.postings = {length: dict(p) for length, p in postings.items()}
        self.sketched = {length: np.sort(np.array(list(p), np.uint64)) for length, p in postings.items()}

    def found(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, its shingles in the text, its shingles) of the items that the text contains."""
        own = words(text)
        ids = np.fromiter(map(self.vocabulary.get, own, repeat(0)), np.int64, len(own))
        out = []
        for length, sketched in self.sketched.items():
            known = np.convolve(ids == 0, np.ones(length), "valid") == 0 if len(ids) >= length else np.zeros(0, bool)
            starts = np.flatnonzero(known)
            if not len(starts):
                continue
            at = codes(ids, length)[starts]
            place = np.minimum(np.searchsorted(sketched, at), len(sketched) - 1)
            hits = set(at[sketched[place] == at].tolist())
            candidates = {i for h in hits for i in self.postings[length][h]}
            if not candidates:
                continue
            there = set(map(tuple, np.lib.stride_tricks.sliding_window_view(ids, length)[starts].tolist()))
            for i in sorted(candidates):
                item_id, _, grams = self.shingles[i]
                if 100 * (shared := len(grams & there)) >= self.percent * len(grams):
                    out.append((item_id, shared, len(grams)))
        return out


def searcher(shared: Broadcast) -> Callable[[Iterator[pd.Series]], Iterator[pd.DataFrame]]:
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [sorted(shared.value.found(t)) for t in texts]
            yield pd.DataFrame({c: [[f[j] for f in x] for x in found] for j, c in enumerate(("item_id", "n_shared", "n_shingles"))})

    return search


def blocks_of(items: DataFrame, *, item_id: str = "item_id", text_col: str = "text", item_text: str = "text", n: int = 5, percent: int = 80, block_words: int = 200_000) -> Iterator[Column]:
    """For each block of items a column over texts: arrays ``item_id``, ``n_shared`` and ``n_shingles`` of those contained in each."""
    spark = items.sparkSession
    items = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).filter("i is not null")
    total = items.agg(F.sum(F.octet_length("t")).alias("b")).first().b or 0
    blocks = max(1, -(-total // (4 * block_words)))
    kind = "item_id array<long>, n_shared array<long>, n_shingles array<long>"
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(Sketches([(r.i, r.t) for r in rows], n, percent))
        yield F.pandas_udf(searcher(shared), kind)(F.col(text_col))


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per document and item contained in it: ``doc_id``, ``item_id``, ``n_shared``, ``n_shingles``, ``containment``.

    An item is contained when at least ``percent`` of its distinct ``n``-word shingles are in the text; an item of
    fewer words is one shingle of that many. Null, empty or wordless texts contain nothing, and such items are in
    nothing. Items that repeat an id count each by itself, as do repeated documents; an item without id is left out.
    Other columns aren't read. Empty tables give an empty table.
    """
    out = None
    for found in blocks_of(items, **options):
        rows = docs.select(F.col(doc_id).alias("doc_id"), found.alias("m")).filter(F.size("m.item_id") > 0)
        rows = rows.select("doc_id", F.explode(F.arrays_zip("m.item_id", "m.n_shared", "m.n_shingles")).alias("m")).select("doc_id", "m.*")
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def without_items(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents in which no item is contained, with the columns they have; those with null or empty texts stay.

    With several blocks of items, what each finds is written as digests of texts, and the documents are read once more
    without those.
    """
    found = list(blocks_of(items, **options))
    if len(found) == 1:
        return docs.withColumn(f"{OWN}m", found[0]).filter(F.size(f"{OWN}m.item_id") == 0).drop(f"{OWN}m")
    digest, gone = F.sha2(options.get("text_col", "text"), 256), None
    for m in found:
        rows = written(docs.select(digest.alias(f"{OWN}d"), m.alias("m")).filter(F.size("m.item_id") > 0).select(f"{OWN}d").distinct(), "leaks")
        gone = rows if gone is None else gone.unionByName(rows)
    return docs.join(gone.distinct(), digest == F.col(f"{OWN}d"), "left_anti")
