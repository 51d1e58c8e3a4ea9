"""Suffix-array dedup: removes each byte that an earlier equal string of ``width`` bytes covers.

1. In each text, windows of ``width`` bytes are grouped in runs by the smallest hash of the short strings in them, which
   depends on the window alone: equal windows have the same, wherever they stand. A run of windows is a piece of text.
2. Pieces are brought together by that hash, each different piece once from each batch of rows (the batch's own
   repeats are settled where they are read). Pieces are equal when their 128-bit cryptographic digests are. Where all
   pieces of a hash are equal, all but the first repeat it. That settles the inside of copied passages and all text that
   occurs once, without their bytes being moved.
3. The other pieces (the edges of copies) are fetched and dealt to shards by their hash. A shard's suffix array is
   built by induced sorting; permuted common prefixes of ``width`` bytes show which windows are equal. A hash with very
   many pieces is not gathered in a shard: its pieces are parted by the text to the left or to the right of the string
   that has the hash, as equal windows agree on either. What is still too much (many equal windows in ever different
   surroundings) is parted to the end, by the digests of whole windows, which Spark sums up.

The other hashes only bring text together: whatever they collide on, it is told apart by digest or suffix array.

Matches never cross texts, and what counts as repeated is judged on the texts as they were.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, written
from .suffixes import permuted_prefixes, suffix_array

GRAM = 24
#: Bytes hashed at a time, windows of a text taken together, bytes of texts whose repeats are settled together, bytes of a
#: shard, and bytes of one hash's pieces from which on they aren't put in a shard.
CHUNK, SEGMENT, BATCH, SHARD, MANY = 1 << 20, 1 << 20, 8 << 20, 1 << 20, 1 << 20
#: Windows of hot hashes that a task holds before it hands them on.
HELD_ROWS = 200_000
#: A piece's number of windows has 24 bits beside its start; the highest of them marks a piece that may repeat itself.
LENGTH_BITS, SELF = 24, 1 << 23
_rng = np.random.default_rng(23)
BYTES, BYTES2 = _rng.integers(1, 1 << 63, 256, np.uint64), _rng.integers(1, 1 << 63, 256, np.uint64)
ODD = _rng.integers(1, 1 << 63, 16, np.uint64) | np.uint64(1)
BACK = np.uint64(pow(int(ODD[15]), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD[0]
    return x ^ (x >> np.uint64(29))


def gram_hashes(t: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on: of 8, of 16, and of both together."""
    h = BYTES[t]
    for i, k in enumerate((1, 2, 4)):
        h = mixed(h[:-k] * ODD[2 * i + 1] + h[k:] * ODD[2 * i + 2])
    eight = h
    sixteen = mixed(eight[:-8] * ODD[7] + eight[8:] * ODD[8])
    return mixed(sixteen[:-8] * ODD[9] + eight[16:] * ODD[10])


def least_of(h: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each ``w`` hashes in a row."""
    k, m = 1, h
    while 2 * k <= w:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    return np.minimum(m[: len(m) - (w - k)], m[w - k :]) if w > k else m


def digests(t: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two columns that tell parts of a string apart: their 128-bit cryptographic digests."""
    view = memoryview(t)
    found = [blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), (start + size).tolist(), strict=True)]
    return np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)


class Sums:
    """Hashes of any part of a string, from sums of its bytes times powers. Equal hashes don't prove equal parts."""

    def __init__(self, t: np.ndarray):
        power = np.full(len(t) + 1, ODD[15])
        power[0] = 1
        power = np.multiply.accumulate(power)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES2[t] * power[:-1])])
        back = np.full(len(t) + 1, BACK)
        back[0] = 1
        self.back = np.multiply.accumulate(back)

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mixed((self.total[start + size] - self.total[start]) * self.back[start] + np.uint64(1) * np.asarray(size).astype(np.uint64))


def segments(texts: list[bytes], width: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """About CHUNK bytes at a time: joined bytes, and for each part its text's number, its place there, and its size."""
    own: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(0, len(t) - width + 1), SEGMENT):
            own.append((i, at, t[at : at + SEGMENT + width - 1]))
            size += len(own[-1][2])
            if size >= CHUNK:
                yield _joined(own)
                own, size = [], 0
    if own:
        yield _joined(own)


def _joined(own: list[tuple[int, int, bytes]]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    which, at, parts = zip(*own, strict=True)
    return b"".join(parts), np.array(which), np.array(at, np.int64), np.array([len(p) for p in parts], np.int64)


def runs(texts: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """Smallest hash, piece's digest, text's number, start in it, and number of windows (with SELF), of each run."""
    out = []
    for raw, which, at, size in segments(texts, width):
        t = np.frombuffer(raw, np.uint8)
        w = width - GRAM + 1
        g = gram_hashes(t)
        m = least_of(g, w)
        ends = np.cumsum(size)
        begins = ends - size
        inside = np.zeros(len(m) + 1, np.int32)
        np.add.at(inside, begins, 1)
        np.add.at(inside, np.minimum(ends - width + 1, len(m)), -1)
        valid = np.cumsum(inside)[:-1] > 0
        new = np.r_[True, m[1:] != m[:-1]]
        new[begins[begins < len(m)]] = True
        start = np.flatnonzero(new & valid)
        stop = np.flatnonzero(np.r_[(new | ~valid)[1:], True] & valid) + 1
        many = stop - start
        part = np.searchsorted(begins, start, "right") - 1
        # Equal windows of one run have its smallest hash at two places at least: one in front of some window's end, one
        # behind some window's start. Such a run repeats itself, perhaps, and is looked at even if it has no equal.
        before, behind = np.arange(len(g)), np.arange(len(g)) - w + 1
        run = np.cumsum(new & valid) - 1
        twice = np.zeros(len(start) + 1, np.int64)
        left, right = (before < len(m)) & valid[np.minimum(before, len(m) - 1)], (behind >= 0) & valid[np.maximum(behind, 0)]
        left &= g == m[np.minimum(before, len(m) - 1)]
        right &= g == m[np.maximum(behind, 0)]
        same = left & right & (run[np.minimum(before, len(m) - 1)] == run[np.maximum(behind, 0)])
        for mask, window in ((left, before), (right & ~same, behind)):
            twice += np.bincount(run[window[mask]], minlength=len(twice))[: len(twice)]
        alone = np.where(twice[:-1] > 1, SELF, 0)
        digest = digests(raw, start, many + width - 1)
        out.append((m[start].view(np.int64), digest[:, 0], digest[:, 1], which[part], at[part] + start - begins[part], many + alone))
    if not out:
        return (np.zeros(0, np.int64),) * 6
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def slices(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Documents and texts, about BATCH bytes at a time."""
    for b in batches:
        docs, texts, size, first = b.doc.to_numpy(np.int64), [], 0, 0
        for i, t in enumerate(b.t):
            texts.append((t or "").encode(errors="surrogatepass"))
            size += len(texts[-1])
            if size >= BATCH:
                yield docs[first : i + 1], texts
                texts, size, first = [], 0, i + 1
        if texts:
            yield docs[first:], texts


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document, with those that overlap or touch made one."""
    if not len(doc):
        return doc, start, end
    by = np.lexsort((start, doc))
    doc, start, end = doc[by], start[by], end[by]
    first = np.r_[True, doc[1:] != doc[:-1]]
    # running maximum of the ends within a document: shift documents apart
    nth = np.cumsum(first) - 1
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(nth * wide + end) - nth * wide
    new = first | np.r_[True, start[1:] > reach[:-1]]
    at = np.flatnonzero(new)
    return doc[at], start[at], reach[np.r_[at[1:] - 1, len(doc) - 1]]


def _packed(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    return (start << LENGTH_BITS) + many


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return place >> LENGTH_BITS, place & (SELF - 1)


def parted(m: int, piece: bytes, many: int, width: int) -> list[tuple[int, int, int]]:
    """A piece's windows by further hashes: (hash, first window, number).

    In each window, the first string with the hash ``m`` has half a window of text on its left or else on its right;
    that text, and which side it is on, are mixed into the hash. Windows between those of one hash go with them.
    """
    t = np.frombuffer(piece, np.uint8)
    places = np.flatnonzero(gram_hashes(t).view(np.int64) == m)
    half, sums, window = (width - GRAM) // 2, Sums(t), np.arange(many)
    at = np.searchsorted(places, window)
    left = places[at] - window >= half
    start = places[at] - half * left
    key = mixed((sums.of(start, GRAM + half) + left.astype(np.uint64)) * ODD[11] ^ np.array([m]).view(np.uint64)).view(np.int64)
    kinds, which = np.unique(key, return_inverse=True)
    first, last = np.full(len(kinds), many), np.zeros(len(kinds), np.int64)
    np.minimum.at(first, which, window)
    np.maximum.at(last, which, window)
    return list(zip(kinds.tolist(), first.tolist(), (last - first + 1).tolist(), strict=True))


def equal_windows(pieces: list[bytes], docs: np.ndarray, starts: np.ndarray, many: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and start of each window of the pieces that an earlier one equals, by a suffix array."""
    t = np.frombuffer(b"".join(pieces), np.uint8)
    sa = suffix_array(t)
    prefix = permuted_prefixes(t, sa, width)
    group = np.empty(len(t), np.int64)
    group[sa] = np.cumsum(prefix[sa] < width)
    size = np.array([len(p) for p in pieces])
    begins = np.cumsum(size) - size
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    group = group[np.repeat(begins, many) + nth]
    doc, start = np.repeat(docs, many), np.repeat(starts, many) + nth
    by = np.lexsort((start, doc, group))
    doc, start, group = doc[by], start[by], group[by]
    # a window that is in two pieces doesn't repeat itself
    later = np.r_[False, (group[1:] == group[:-1]) & ((doc[1:] != doc[:-1]) | (start[1:] != start[:-1]))]
    return doc[later], start[later]


def repeated_spans(docs: DataFrame, width: int = 100) -> DataFrame:
    """(``doc``, ``start``, ``end``): spans of bytes to remove, not yet made one where they meet. ``docs`` has a distinct long ``doc``, which gives the order, and ``t``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for docs, texts in slices(batches):
            m, h, g, which, start, many = runs(texts, width)
            doc = docs[which] if len(which) else which
            by = np.lexsort((start, doc, g, h, m))
            m, h, g, doc, start, many = m[by], h[by], g[by], doc[by], start[by], many[by]
            first = np.r_[True, (m[1:] != m[:-1]) | (h[1:] != h[:-1]) | (g[1:] != g[:-1])] if len(m) else np.zeros(0, bool)
            yield pd.DataFrame({"m": m[first], "h": h[first], "g": g[first], "doc": doc[first], "place": _packed(start[first], many[first])})
            d, s, e = merged(doc[~first], start[~first], start[~first] + (many[~first] & (SELF - 1)) + width - 1)
            # settled here: they ride along under hashes of their own, as spans (negative place)
            yield pd.DataFrame({"m": mixed(d.astype(np.uint64)).view(np.int64), "h": e, "g": np.zeros(len(d), np.int64), "doc": d, "place": -1 - s})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by m, h, g, doc, place. Out: spans (m null), and pieces whose hash has different ones."""
        last_m = last_h = last_g = None
        waiting: tuple | None = None  # the first piece of a hash of which no other piece has come yet
        for b in batches:
            m, h, g, doc, place = (b[c].to_numpy() for c in ("m", "h", "g", "doc", "place"))
            span = place < 0
            spans = [(doc[span], -1 - place[span], h[span])]
            m, h, g, doc, place = m[~span], h[~span], g[~span], doc[~span], place[~span]
            if len(m):
                new_m = np.r_[m[0] != last_m, m[1:] != m[:-1]]
                new_h = new_m | np.r_[h[0] != last_h or g[0] != last_g, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]
                start, many = _unpacked(place)
                spans.append((doc[~new_h], start[~new_h], start[~new_h] + many[~new_h] + width - 1))
                at = np.flatnonzero(new_h)
                own = np.stack([m[at], doc[at], place[at]])
                if waiting is not None:
                    own = np.concatenate([np.array(waiting)[:, None], own], 1)
                more = np.r_[own[0][1:] == own[0][:-1], False]
                several = more | np.r_[False, more[:-1]] | (own[2] & SELF > 0) | (own[0] == last_m if waiting is None and last_m is not None else False)
                waiting = None
                if own.shape[1] and not several[-1]:
                    waiting, own, several = tuple(own[:, -1].tolist()), own[:, :-1], several[:-1]
                own = own[:, several]
                last_m, last_h, last_g = m[-1], h[-1], g[-1]
                yield pd.DataFrame({"m": own[0], "doc": own[1], "place": own[2], "end": 0}).astype({"m": "Int64"})
            d, s, e = merged(*(np.concatenate(x) for x in zip(*spans, strict=True)))
            yield pd.DataFrame({"m": pd.array([None] * len(d), "Int64"), "doc": d, "place": s, "end": e})

    pieces = docs.mapInPandas(read, "m long, h long, g long, doc long, place long").repartition("m").sortWithinPartitions("m", "h", "g", "doc", "place")
    compared = written(pieces.mapInPandas(compare, "m long, doc long, place long, end long"), "repeats-compared")
    spans = compared.filter("m is null").select("doc", F.col("place").alias("start"), "end")
    asked = compared.filter("m is not null").select("m", "doc", "place")

    size = F.col("place").bitwiseAND(F.lit(SELF - 1)) + width - 1
    counts = asked.groupBy("m").agg(F.sum(size).alias("size")).filter(F.col("size") > MANY).select("m", F.lit(True).alias("hot"))
    wanted = asked.join(counts, "m", "left").groupBy("doc").agg(F.collect_list(F.struct("m", "place", "hot")).alias("p"))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pieces with their bytes; those of hot hashes parted in two."""
        rows: list[tuple] = []
        for b in batches:
            for doc, t, own in zip(b.doc, b.t, b.p, strict=True):
                t = t.encode(errors="surrogatepass")
                for p in own:
                    start, many = _unpacked(p["place"])
                    piece = t[start : start + many + width - 1]
                    for m, at, n in parted(p["m"], piece, many, width) if p["hot"] else [(p["m"], 0, many)]:
                        rows.append((m, doc, start + at, n, piece[at : at + n + width - 1]))
                if len(rows) >= HELD_ROWS // 10:
                    yield pd.DataFrame(rows, columns=["m", "doc", "start", "many", "piece"])
                    rows = []
        yield pd.DataFrame(rows, columns=["m", "doc", "start", "many", "piece"])

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Digests (w, v) of the pieces' windows, with the first of equal ones here; the others are spans (w null)."""
        held, size = [], 0

        def settled() -> Iterator[pd.DataFrame]:
            w, v, d, s = (np.concatenate(x) for x in zip(*held, strict=True))
            by = np.lexsort((s, d, v, w))
            w, v, d, s = w[by], v[by], d[by], s[by]
            first = np.r_[True, (w[1:] != w[:-1]) | (v[1:] != v[:-1])]
            yield pd.DataFrame({"w": pd.array(w[first], "Int64"), "v": v[first], "doc": d[first], "start": s[first], "end": s[first] + width})
            # the same window in two pieces comes next to itself
            again = first | np.r_[False, (d[1:] == d[:-1]) & (s[1:] == s[:-1])]
            d, s, e = merged(d[~again], s[~again], s[~again] + width)
            yield pd.DataFrame({"w": pd.array([None] * len(d), "Int64"), "v": 0, "doc": d, "start": s, "end": e})

        for b in batches:
            for doc, start, many, piece in zip(b.doc, b.start, b.many, b.piece, strict=True):
                at = np.arange(many)
                digest = digests(piece, at, np.full(many, width))
                held.append((digest[:, 0], digest[:, 1], np.full(many, doc), start + at))
                size += many
                if size >= HELD_ROWS:
                    yield from settled()
                    held, size = [], 0
        if held:
            yield from settled()

    fetched = written(docs.join(wanted, "doc").mapInPandas(fetch, "m long, doc long, start long, many long, piece binary"), "repeats-pieces")
    still = fetched.groupBy("m").agg(F.sum(F.length("piece")).alias("size")).filter(F.col("size") > MANY).select("m", F.lit(True).alias("hot"))
    fetched = fetched.join(still, "m", "left")

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole hashes' pieces, about SHARD bytes at a time."""

        def sort(own: pd.DataFrame) -> pd.DataFrame:
            d, s = equal_windows(own.piece.tolist(), own.doc.to_numpy(), own.start.to_numpy(), own.many.to_numpy(), width)
            d, s, e = merged(d, s, s + width)
            return pd.DataFrame({"doc": d, "start": s, "end": e})

        held, size = [], 0
        for b in batches:
            while len(b):
                sizes = np.cumsum(b.piece.map(len).to_numpy())
                if size + sizes[-1] < SHARD:
                    held.append(b)
                    size += sizes[-1]
                    break
                own = pd.concat([*held, b], ignore_index=True)
                last = own.m.to_numpy() == own.m.iloc[-1]
                cut = np.flatnonzero(np.r_[False, own.m.to_numpy()[1:] != own.m.to_numpy()[:-1]])
                where = np.cumsum(own.piece.map(len).to_numpy())
                cut = cut[where[cut - 1] >= SHARD] if len(cut) else cut
                at = cut[0] if len(cut) else (0 if last.all() else int(np.flatnonzero(last)[0]))
                held, size = [], 0
                if at == 0:  # one hash so far: at most MANY bytes
                    held, size = [own], int(where[-1])
                    break
                yield sort(own.iloc[:at])
                b = own.iloc[at:]
                if where[-1] - where[at - 1] < SHARD:
                    held, size = [b], int(where[-1] - where[at - 1])
                    break
        if held:
            yield sort(pd.concat(held, ignore_index=True))

    edges = fetched.filter("hot is null").select("m", "doc", "start", "many", "piece").repartition("m").sortWithinPartitions("m").mapInPandas(shard, "doc long, start long, end long")
    if still.isEmpty():
        return spans.unionByName(edges)
    windows = written(fetched.filter("hot").select("doc", "start", "many", "piece").mapInPandas(whole, "w long, v long, doc long, start long, end long"), "repeats-windows")
    hot = windows.filter("w is not null").select("w", "v", F.struct("doc", "start", "end").alias("at"))
    firsts = hot.groupBy("w", "v").agg(F.min("at").alias("first"))
    later = hot.join(firsts, ["w", "v"]).filter("at <> first").select("at.*").unionByName(windows.filter("w is null").select("doc", "start", "end"))
    return spans.unionByName(edges).unionByName(later)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with a distinct long: the id, or a number in order of id and text where ids repeat or are null."""
    ids = docs.select(F.col(id_col).cast("long").alias("i"))
    distinct = ids.groupBy("i").count().filter("i is null or count > 1").isEmpty()
    if distinct:
        return docs.withColumn(f"{OWN}doc", F.col(id_col).cast("long"))
    return written(docs.orderBy(F.col(id_col).cast("long").asc_nulls_last(), F.col(text_col)).withColumn(f"{OWN}doc", F.monotonically_increasing_id()), "repeats-keyed")


def remove_repeats(docs: DataFrame, width: int = 100, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans`` (removed runs of bytes, from and to), ``n_bytes``, ``n_removed`` and ``kept`` (the bytes left).

    A byte goes when a string of ``width`` bytes over it also starts earlier: in a document with a smaller id, or further
    ahead in the same one. Null texts are empty. Rows whose ids repeat come in order of their texts, rows without id after
    all others, each as a document of its own. Texts shorter than ``width`` (48 at least) stay. Columns with the new names are replaced.
    """
    if width < 2 * GRAM:
        raise ValueError(f"width must be {2 * GRAM} or more")
    docs = _keyed(docs, id_col, text_col)
    spans = repeated_spans(docs.select(F.col(f"{OWN}doc").alias("doc"), F.col(text_col).alias("t")), width)
    each = spans.groupBy(F.col("doc").alias(f"{OWN}d")).agg(F.collect_list(F.struct("start", "end")).alias(f"{OWN}s"))

    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, own in batches:
            out = []
            for t, spans in zip(texts, own, strict=True):
                raw = (t or "").encode(errors="surrogatepass")
                if spans is None or not len(spans):
                    out.append((len(raw), 0, [], [], raw))
                    continue
                at = np.array([(x["start"], x["end"]) for x in spans], np.int64)
                _, start, end = merged(np.zeros(len(at), np.int64), at[:, 0], at[:, 1])
                kept = b"".join(raw[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(raw)], strict=True))
                out.append((len(raw), len(raw) - len(kept), start.tolist(), end.tolist(), kept))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "starts", "ends", "kept"])

    kind = "n_bytes long, n_removed long, starts array<long>, ends array<long>, kept binary"
    out = docs.join(each, F.col(f"{OWN}doc") == F.col(f"{OWN}d"), "left").withColumn(f"{OWN}c", F.pandas_udf(cut, kind)(F.col(text_col), F.col(f"{OWN}s")))
    c = F.col(f"{OWN}c")
    return out.withColumns({"n_bytes": c["n_bytes"], "n_removed": c["n_removed"], "spans": F.arrays_zip(c["starts"].alias("start"), c["ends"].alias("end")), "kept": c["kept"]}).drop(f"{OWN}c", f"{OWN}s", f"{OWN}d", f"{OWN}doc")

