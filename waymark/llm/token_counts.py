"""Token counts: map-side two-tier lookup of pre-token lengths.

Tier one is a broadcast hash table from frequent pre-tokens to their number of tokens, of at most ``table_size`` entries.
Tier two is a cache in each Python worker, filled by the tokenizer on a miss and emptied at ``cache_size`` entries. No
pre-token is ever shuffled: the count of a text is the sum of its pre-tokens' lengths, made where the text is read.

The table is seeded from some rows only because it is a cache: what it lacks is encoded, so it never changes a count.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts with other characters than these are given to the tokenizer whole: Unicode tables differ between libraries.
UNSAFE = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]")
LONG = 200


def _members(kind: str) -> str:
    return "".join(re.escape(c) for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == kind)


def pre_token_pattern() -> re.Pattern:
    """The byte-level tokenizer's own splitting rule (fixed value), for characters below U+0250."""
    letters, numbers = _members("L"), _members("N")
    rule = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^\s{letters}{numbers}]+|\s+(?!\S)|\s+"
    return re.compile(rule)


class Lengths(dict):
    """Pre-token to number of tokens; a miss is encoded and kept."""

    def __init__(self, path: str, table: dict[str, int], cache_size: int):
        from tokenizers import Tokenizer

        super().__init__(table)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.table, self.cache_size = table, cache_size
        self.pattern = pre_token_pattern()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, pre_token: str) -> int:
        n = len(self.tokenizer.encode(pre_token, add_special_tokens=False).ids)
        if len(pre_token) < LONG:
            if len(self) >= self.cache_size:
                self.clear()
                self.update(self.table)
            self[pre_token] = n
        return n

    def count(self, text: str) -> int:
        if UNSAFE.search(text) or any(s in text for s in self.special):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(map(self.__getitem__, self.pattern.findall(text)))


_workers: dict[tuple, Lengths] = {}


def frequent_lengths(docs: DataFrame, path: str, text_col: str, sample_docs: int, table_size: int) -> dict[str, int]:
    """Lengths of the commonest pre-tokens of ``sample_docs`` rows, at most ``table_size`` of them."""
    split, seen = pre_token_pattern(), Counter()
    for (text,) in docs.select(text_col).take(sample_docs):
        if text and not UNSAFE.search(text):
            seen.update(t for t in split.findall(text) if len(t) < LONG)
    lengths = Lengths(path, {}, table_size + 1)
    return {t: lengths[t] for t, _ in seen.most_common(table_size)}


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "n_tokens", *, sample_docs: int = 500, table_size: int = 30_000, cache_size: int = 400_000) -> DataFrame:
    """``docs`` with the number of tokens of each whole text.

    Null and empty texts have 0 tokens. Repeated rows are counted each by itself. A column that has the name
    ``out_col`` already is replaced; other columns stay as they are.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, text_col, sample_docs, table_size))

    @F.pandas_udf("long")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key = (path, id(table.value))
        if key not in _workers:
            _workers.clear()
            _workers[key] = Lengths(path, table.value, cache_size)
        lengths = _workers[key]
        for batch in texts:
            yield pd.Series([lengths.count(t) if t else 0 for t in batch], dtype="int64")

    return docs.withColumn(out_col, counted(F.col(text_col)))
