"""N-gram Jaccard join: T-occurrence search.

1. Keys. Linked sets (Jaccard at least ``percent`` / 100) share a key of those that either has. At high thresholds these
   are parts: a set is cut by hash in one part more than linked sets of its size can differ in, so one part is equal. At
   lower ones, where parts would be small, they are the rarest shingles: of n, linked sets of any size share one of the
   first n - ceil(n * percent / 100) + 1 in an order that all sets have in common.
2. Candidates. The documents of a key are linked with the first of them, never paired out. Around each such first
   document, a sketch tells which of the others can be linked at all: bit i is the parity of the shingles with hash i, so
   sets differ in at least as many shingles as their sketches in bits. What is left is near; texts that only share a
   passage don't meet. Their connected components are the clusters.
3. Search. In a cluster's task, sets are searched by T-occurrence with DivideSkip: the short inverted lists of the set's
   elements are merged by a heap, those found often enough are probed by binary search in the long lists, and what
   reaches the required overlap is linked.

No step loses a link. In 2 and 3 only leaders are compared with or indexed: a set near one is its member. Distances
(of sketches, and Jaccard's) obey the triangle inequality, so what a member is linked with is within twice the distance
of its leader, and such leaders' members are looked at as well. Large groups of near copies thus cost one entry each.

How rare a shingle is comes from counters of a fixed number of cells over all documents, summed in each task before they
are shuffled; shingles that share cells only come later than they could. Elements are 64-bit hashes of shingles; equal
sets are told by 128-bit digests.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import OWN, written
from .graphs import components

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Size classes; a class is this many times as wide as the one below.
RATIO = 1.5
#: Up to so many shingles in all, a cluster is searched in one task; a larger one is cut in blocks.
BLOCK_SHINGLES = 1_500_000
#: From this threshold on, keys are parts of sets.
PARTS_FROM = 85
#: Documents around a first one, and bytes of their sketches, that are told apart in one task; more are cut in blocks.
AROUND, AROUND_BYTES = 20_000, 64 << 20
#: The bits of a key that name its size class.
CLASS = np.uint64(63)
#: Counters in each of two rows, how many of them travel together, and shingles that are counted at a time.
CELLS, STRIP, COUNTED = 1 << 21, 1 << 15, 1 << 18
#: Words whose hashes a task keeps, and keys that it holds before it hands them on.
HELD_WORDS, HELD_KEYS = 200_000, 200_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxh3_64_intdigest(word)
        if len(self) >= HELD_WORDS:
            self.clear()
        if len(word) < 100:
            self[word] = h
        return h


def shingle_set(text: str | None, n: int, hashes: dict) -> np.ndarray:
    """Sorted hashes of the distinct ``n``-word shingles; of the whole text where it has fewer words."""
    words = (text or "").encode(errors="surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = min(n, len(words))
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    out = np.full(len(ids) - n + 1, np.uint64(n))
    for j in range(n):
        out = (out ^ ids[j : j + len(out)]) * MIX
        out ^= out >> np.uint64(31)
    return np.unique(out)


def classes(size: int, percent: int) -> list[int]:
    """The size classes in which a set is compared: its own, and those below where a linked set can be."""
    c = int(np.floor(np.log(size) / np.log(RATIO)))
    out = [c]
    while c > 0 and size * percent <= 100 * RATIO**c:
        c -= 1
        out.append(c)
    return out


def cells(s: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Each shingle's counter in either row of ``many``, a power of two."""
    shift = np.uint64(65 - many.bit_length())
    return (s * MIX >> shift).astype(np.int64), ((s ^ (s >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> shift).astype(np.int64)


@lru_cache(maxsize=None)
def parts_of(k: int, percent: int) -> tuple[int, int]:
    """For size class k: the number of parts, and in how many of them linked sets can differ at most."""
    low, most = RATIO**k, RATIO ** (k + 1) * 100 / percent
    differ = int(2 * most * (100 - percent) / (100 + percent))
    parts = differ + 1
    while parts > 1:  # until nearly all sets have more parts with elements than can differ
        empty = np.exp(-low / parts)
        if parts * (1 - empty) - 3 * np.sqrt(parts * empty) >= differ + 1 or parts > 3 * differ + 3:
            break
        parts += max(1, parts // 50)
    return parts, differ


def part_keys(s: np.ndarray, k: int, percent: int) -> np.ndarray:
    """Hashes of the set's parts in size class k.

    A part without elements says little and is left out, but for sets with so few other parts that all those could
    differ from a linked set's.
    """
    parts, differ = parts_of(k, percent)
    part = ((s * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    scrambled = (s ^ (s >> np.uint64(29))) * MIX
    total = np.zeros(parts, np.uint64)
    np.add.at(total, part, scrambled ^ (scrambled >> np.uint64(32)))
    key = total * MIX + np.arange(parts, dtype=np.uint64)
    full = np.bincount(part, minlength=parts) > 0
    return key[full] if full.sum() > differ else key


def rarest(s: np.ndarray, percent: int, common: np.ndarray) -> np.ndarray:
    """The set's rarest shingles, as many as linked sets must share one of."""
    first, second = cells(s, common.shape[1])
    n = len(s) - -(-percent * len(s) // 100) + 1
    return s[np.argsort(np.minimum(common[0][first], common[1][second]), kind="stable")[:n]]


def keys_of(s: np.ndarray, percent: int, common: np.ndarray | None) -> np.ndarray:
    """The set's keys in all its size classes; the lowest bits are the class."""
    out = []
    for k in classes(len(s), percent):
        key = part_keys(s, k, percent) if common is None else rarest(s, percent, common)
        key = (key ^ np.uint64((k + 2) * 0x51ED27)) * MIX
        out.append((key ^ (key >> np.uint64(30))) & ~CLASS | np.uint64(k))
    return np.concatenate(out)


def sketch_bits(k: int) -> int:
    """About two hashes for a shingle of a set of class k."""
    return 64 * -(-int(2 * RATIO ** (k + 1)) // 64)


def seats(k: int) -> int:
    """Sketches of class k that are compared in one task."""
    return max(2, min(AROUND, AROUND_BYTES * 8 // sketch_bits(k)))


def sketch(s: np.ndarray, k: int) -> bytes:
    """Parities of the numbers of shingles with each hash."""
    bits = sketch_bits(k)
    place = ((s ^ (s >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25) >> np.uint64(32)) % np.uint64(bits)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=bits) & 1).tobytes()


def near(sketches: np.ndarray, sizes: np.ndarray, percent: int, slack: int = 1) -> tuple[UnionFind, list[int]]:
    """Components of the sets whose sketches differ in at most ``slack`` times as many bits as linked ones can; and leaders."""
    uf, leaders, members = UnionFind(len(sizes)), [], []
    led, widest = np.zeros((16, sketches.shape[1]), np.uint64), int(sizes.max())
    most = lambda n, m: slack * (n + m) * (100 - percent) // (100 + percent)
    for x, own in enumerate(sketches):
        home = None
        if leaders:
            far = np.bitwise_count(led[: len(leaders)] ^ own).sum(1, dtype=np.int64)
            reach = far <= most(int(sizes[x]), sizes[leaders])
            for at in np.flatnonzero(reach).tolist():
                uf.join(x, leaders[at])
                home = at if home is None else home
            for at in np.flatnonzero(~reach & (far <= 2 * most(widest, widest))).tolist():
                if uf.find(x) != uf.find(leaders[at]) and members[at]:
                    hits = np.bitwise_count(sketches[members[at]] ^ own).sum(1, dtype=np.int64) <= most(int(sizes[x]), sizes[members[at]])
                    if hits.any():
                        uf.join(x, members[at][int(hits.argmax())])
        if home is None:
            if len(leaders) == len(led):
                led = np.concatenate([led, np.zeros_like(led)])
            led[len(leaders)] = own
            leaders.append(x)
            members.append([])
        else:
            members[home].append(x)
    return uf, leaders


class UnionFind:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def occurs(lists: list[list[int]], least: int) -> dict[int, int]:
    """DivideSkip: the numbers that are on at least ``least`` of the ascending lists, with on how many."""
    lists = sorted(lists, key=len)
    if len(lists) < least or not lists:
        return {}
    longest = min(least - 1, int(least / (0.0085 * np.log2(max(2, len(lists[-1]))) + 1)))
    short, long = lists[: len(lists) - longest], lists[len(lists) - longest :]
    found = {}
    for i, same in groupby(heapq.merge(*short)):
        n = sum(1 for _ in same)
        if n < least - len(long):
            continue
        for left, other in zip(range(len(long), 0, -1), reversed(long), strict=True):
            if n + left < least:
                break
            at = bisect_left(other, i)
            n += at < len(other) and other[at] == i
        if n >= least:
            found[i] = n
    return found


def search(sets: list[np.ndarray], percent: int) -> UnionFind:
    """Components of the links among the sets."""
    near = max(0, 2 * percent - 100)  # Jaccard with the leader of a set that one is linked to
    uf, lists, leaders = UnionFind(len(sets)), defaultdict(list), []
    members: list[list[int]] = []
    for x, s in enumerate(sets):
        if not len(s):
            continue
        found = occurs([own for t in s.tolist() if (own := lists.get(t))], max(1, -(-near * len(s) // 100)))
        home = None
        for at, shared in found.items():
            union = len(s) + len(sets[leaders[at]]) - shared
            if 100 * shared >= percent * union:
                uf.join(x, leaders[at])
                home = at if home is None else home
        for at, shared in found.items():
            union = len(s) + len(sets[leaders[at]]) - shared
            if 100 * shared >= near * union and uf.find(x) != uf.find(leaders[at]):
                for m in members[at]:
                    both = overlap(s, sets[m])
                    if 100 * both >= percent * (len(s) + len(sets[m]) - both):
                        uf.join(x, m)
                        break
        if home is None:
            for t in s.tolist():
                lists[t].append(len(leaders))
            leaders.append(x)
            members.append([])
        else:
            members[home].append(x)
    return uf


def _searched(groups: DataFrame, by: list[str], n: int, percent: int) -> DataFrame:
    """Links (a, b) of documents (``id``, ``t``) to their component's first in each group, which has about a block's text at most."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("id")
        hashes = WordHashes()
        uf = search([shingle_set(t, n, hashes) for t in own.t], percent)
        ids = own.id.to_numpy()
        root = [uf.find(i) for i in range(len(ids))]
        rows = [(ids[i], ids[r]) for i, r in enumerate(root) if i != r]
        return pd.DataFrame(rows, columns=["a", "b"]).astype("int64")

    return groups.groupBy(*by).applyInPandas(run, "a long, b long")


def commonness(rows: DataFrame, n: int) -> np.ndarray:
    """Two rows of CELLS counters of the shingles of all texts ``t``, on a logarithmic scale in one byte each."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, total, held, size = WordHashes(), np.zeros((2, CELLS), np.uint32), [], 0

        def add() -> None:
            for row, at in zip(total, cells(np.concatenate(held), CELLS), strict=True):
                row += np.bincount(at, minlength=CELLS).astype(np.uint32)

        for b in batches:
            for t in b.t:
                held.append(shingle_set(t, n, hashes))
                size += len(held[-1])
                if size >= COUNTED:
                    add()
                    held, size = [], 0
        if size:
            add()
        strips = total.reshape(-1, STRIP)
        for i in np.flatnonzero(strips.any(1)):
            # more than 65,535 in one task count as that many
            yield pd.DataFrame({"strip": [int(i)], "counts": [np.minimum(strips[i], 65_535).astype("<u2").tobytes()]})

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, counts in zip(b.strip, b.counts, strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(counts, "<u2").astype(np.int64)
        scaled = [(4 * np.log2(c + 1)).astype(np.uint8).tobytes() for c in total.values()]
        yield pd.DataFrame({"strip": list(total), "counts": scaled})

    kind = "strip int, counts binary"
    out = np.zeros((2 * CELLS // STRIP, STRIP), np.uint8)
    # at most 2 * CELLS bytes
    for r in rows.select("t").mapInPandas(count, kind).repartition("strip").mapInPandas(add_up, kind).collect():
        out[r.strip] = np.frombuffer(r.counts, np.uint8)
    return out.reshape(2, CELLS)


def near_links(candidates: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all documents ``a`` around each first ``b`` in class ``c`` whose sketches (``x``, ``k``, size ``n``, bits ``s``) are near.

    Where there are too many for a task, they are compared in blocks; the blocks' leaders, which stand for what is near
    them, are compared with as much more slack, blocks with blocks if there are too many of them still.
    """
    candidates = written(candidates, "jaccard-candidates")
    most = F.element_at(F.array(*(F.lit(float(seats(k))) for k in range(int(CLASS) + 1))), (F.col("c") + 1).cast("int"))
    counts = candidates.groupBy("b", "c").agg(F.count(F.lit(1)).alias("n")).select("b", "c", F.ceil(F.col("n") / most).cast("int").alias("blocks"))
    own = candidates.join(counts, ["b", "c"]).withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    heads = counts.withColumn("a", F.col("b")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    seated = own.select("c", "b", "block", "blocks", "a").unionByName(heads.select("c", "b", "block", "blocks", "a"))
    found = written(_near(seated, sketches, percent, 1), "jaccard-near")
    links = found.filter("not leader").select("a", "b")
    many = found.filter("leader").select("a", "b", "c")
    if many.isEmpty():
        return links
    # slack 3: a document to its leader, to the other's leader, and the link itself
    counts = many.groupBy("b", "c").agg(F.count(F.lit(1)).alias("n")).select("b", "c", F.ceil(F.col("n") / most).cast("int").alias("n"))
    own = many.join(counts, ["b", "c"]).withColumn("i", F.pmod(F.xxhash64("a"), F.col("n")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pair = F.least("i", "j") * F.col("n") + F.greatest("i", "j")
    seated = own.select("c", "b", pair.cast("int").alias("block"), F.lit(1).alias("blocks"), "a").distinct()
    return links.unionByName(_near(seated, sketches, percent, 3).filter("not leader").select("a", "b"))


def _near(seated: DataFrame, sketches: DataFrame, percent: int, slack: int) -> DataFrame:
    """Links (a, b) of near documents in each group (c, b, block), and where there are further blocks its leaders (a of b, c)."""
    rows = seated.join(sketches, (F.col("a") == F.col("x")) & (F.col("c") == F.col("k"))).select("c", "b", "block", "blocks", "a", "n", "s")
    rows = rows.repartition("c", "b", "block").sortWithinPartitions("c", "b", "block", "a")

    def told(own: pd.DataFrame) -> pd.DataFrame:
        """Whole groups of one class."""
        bits = np.frombuffer(b"".join(own.s), np.uint64).reshape(len(own), -1)
        a, b, n, blocks = (own[c].to_numpy() for c in ("a", "b", "n", "blocks"))
        new = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (own.block.to_numpy()[1:] != own.block.to_numpy()[:-1])])
        stop = np.append(new[1:], len(own))
        left, right, leaders = [], [], []
        two = new[(stop - new == 2) & (blocks[new] == 1)]
        far = np.bitwise_count(bits[two] ^ bits[two + 1]).sum(1, dtype=np.int64)
        linked = two[far <= slack * (n[two] + n[two + 1]) * (100 - percent) // (100 + percent)]
        left += a[linked + 1].tolist()
        right += a[linked].tolist()
        for at, to in zip(new.tolist(), stop.tolist(), strict=True):
            if to - at > 2 or blocks[at] > 1:
                uf, led = near(bits[at:to], n[at:to], percent, slack)
                root = [uf.find(i) for i in range(to - at)]
                left += [int(a[at + i]) for i, r in enumerate(root) if i != r]
                right += [int(a[at + r]) for i, r in enumerate(root) if i != r]
                if blocks[at] > 1:
                    leaders += [(int(a[at + i]), int(b[at]), int(own.c.iloc[0])) for i in led]
        links = pd.DataFrame({"a": left, "b": right, "c": 0, "leader": False})
        return pd.concat([links, pd.DataFrame(leaders, columns=["a", "b", "c"]).assign(leader=True)]) if leaders else links

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            own = b if held is None else pd.concat([held, b], ignore_index=True)
            if not len(own):
                continue
            last = own.iloc[-1]
            whole = ~((own.c == last.c) & (own.b == last.b) & (own.block == last.block)).to_numpy()
            held = own[~whole]
            for _, same in own[whole].groupby("c"):
                yield told(same)
        if held is not None and len(held):
            yield told(held)

    return rows.mapInPandas(run, "a long, b long, c long, leader boolean")


def repeats_ids(docs: DataFrame, id_col: str) -> bool:
    return not docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").isEmpty()


def numbered(docs: DataFrame, id_col: str) -> DataFrame:
    """``docs`` as a table with a number for each row that has an id."""
    return written(docs.withColumn(f"{OWN}n", F.when(F.col(id_col).isNotNull(), F.monotonically_increasing_id())), "jaccard-numbered")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    A text's set is its distinct ``n``-word shingles (A-Z lower-cased, words by white space); a text with fewer words is
    one shingle, a text without words has an empty set and no links. Two texts are linked when 100 * intersection >=
    ``percent`` * union. Rows with one id are linked with each other. A row without id has no component and links
    nothing. Other columns are not read. An empty table gives an empty table.

    Where an id is on several rows, rows are numbered first and compared as texts of their own; their links are joined by
    id at the end, so none is lost whichever of an id's texts has it.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    if not repeats_ids(rows, "id"):
        return _components(rows, n, percent)
    rows = numbered(rows, "id")
    by_row = _components(rows.select(F.col(f"{OWN}n").alias("id"), "t"), n, percent)
    nameless = by_row.filter("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    named = rows.select(F.col("id").alias("own"), F.col(f"{OWN}n").alias("doc_id")).join(by_row, "doc_id")
    named = written(named.select("own", "n_shingles", "component_id"), "jaccard-by-row")
    least = named.groupBy("component_id").agg(F.min("own").alias("least"))
    reach = components(named.join(least, "component_id").filter("own <> least").select(F.col("own").alias("a"), F.col("least").alias("b")).distinct())
    joined = named.join(reach, F.col("own") == F.col("node"), "left").select(F.col("own").alias("doc_id"), "n_shingles", F.coalesce("component", "own").alias("component_id"))
    return joined.unionByName(nameless)


def _components(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """``jaccard_components`` of rows (``id``, ``t``) whose ids are distinct where they aren't null."""
    common = rows.sparkSession.sparkContext.broadcast(None if percent >= PARTS_FROM else commonness(rows.filter("id is not null"), n))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Kind 0: id and size. Kind 1: key and id, once per batch. Kind 2: ids that share a key with a first of the batch, and the key. Kind 3: whole set (a, c) and id. Kind 4: id, size, class and sketch."""
        hashes = WordHashes()
        for b in batches:
            at = 0
            while at < len(b):
                ids, sizes, keys, owners, wholes, sketches, many = [], [], [], [], [], [], 0
                while at < len(b) and many < HELD_KEYS:
                    i, s = b.id.iloc[at], shingle_set(b.t.iloc[at], n, hashes)
                    at += 1
                    ids.append(i)
                    sizes.append(len(s))
                    if len(s) and not pd.isna(i):
                        own = keys_of(s, percent, common.value)
                        many += len(own)
                        keys.append(own)
                        owners.append(np.full(len(own), int(i)))
                        wholes.append((*np.frombuffer(blake2b(s.tobytes(), digest_size=16).digest(), "<i8").tolist(), int(i)))
                        sketches += [(int(i), len(s), k, sketch(s, k)) for k in classes(len(s), percent)]
                yield pd.DataFrame({"kind": 0, "a": pd.array(ids, "Int64"), "b": sizes, "c": 0, "s": None})
                if keys:
                    key, owner = np.concatenate(keys).view(np.int64), np.concatenate(owners)
                    order = np.lexsort((owner, key))
                    key, owner = key[order], owner[order]
                    first = np.r_[True, key[1:] != key[:-1]]
                    yield pd.DataFrame({"kind": 1, "a": key[first], "b": owner[first], "c": 0, "s": None})
                    head = owner[first][np.cumsum(first) - 1]
                    yield pd.DataFrame({"kind": 2, "a": owner, "b": head, "c": key, "s": None})[owner != head]
                    yield pd.DataFrame(wholes, columns=["a", "c", "b"]).assign(kind=3, s=None)[["kind", "a", "b", "c", "s"]]
                    yield pd.DataFrame(sketches, columns=["a", "b", "c", "s"]).assign(kind=4)[["kind", "a", "b", "c", "s"]]

    cuts = written(rows.mapInPandas(cut, "kind int, a long, b long, c long, s binary"), "jaccard-keys")
    sizes = cuts.filter("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("n_shingles"))
    # equal sets are linked: one of them stands for all in the search
    wholes = cuts.filter("kind = 3").select("a", "c", "b")
    firsts = wholes.groupBy("a", "c").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("a", "c", "m")
    equal = written(wholes.join(firsts, ["a", "c"]).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "jaccard-equal")
    # a key is on at most one row of a batch, so that none is hot; batches' firsts are linked with the first of all
    by_key = cuts.filter("kind = 1").select("a", "b").repartition("a").sortWithinPartitions("a", "b")

    def star(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, head = None, None
        for b in batches:
            key, owner = b.a.to_numpy(), b.b.to_numpy()
            if not len(key):
                continue
            first = np.r_[True, key[1:] != key[:-1]]
            heads = owner[first]
            heads[0] = head if key[0] == last_key else heads[0]
            last_key, head = key[-1], heads[-1]
            heads = heads[np.cumsum(first) - 1]
            yield pd.DataFrame({"a": owner, "b": heads, "c": key})[owner != heads]

    moved = written(by_key.mapInPandas(star, "a long, b long, c long"), "jaccard-firsts")
    # and so are those that share a key with a batch's first: no more of them have one first and key than are in a batch
    firsts = moved.select(F.col("a").alias("b"), "c", F.col("b").alias("first"))
    inner = cuts.filter("kind = 2").select("a", "b", "c").join(firsts, ["b", "c"], "left").select("a", F.coalesce("first", "b").alias("b"), "c")
    candidates = moved.unionByName(inner).select("a", "b", F.col("c").bitwiseAND(F.lit(int(CLASS))).alias("c")).distinct()
    to_first = equal.select(F.col("a").alias("x"), F.col("b").alias("y"))
    for end in ("a", "b"):
        candidates = candidates.join(to_first, F.col(end) == F.col("x"), "left").withColumn(end, F.coalesce("y", end)).drop("x", "y")
    sketches = cuts.filter("kind = 4").select(F.col("a").alias("x"), F.col("c").alias("k"), F.col("b").alias("n"), "s").dropDuplicates(["x", "k"])
    clusters = components(near_links(candidates.filter("a <> b").distinct(), sketches, percent))
    size = sizes.groupBy("id").agg(F.max("n_shingles").alias("n_shingles"))
    loads = clusters.join(size, F.col("node") == F.col("id")).groupBy("component").agg(F.sum("n_shingles").alias("load"), F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("load") / F.lit(float(BLOCK_SHINGLES))).cast("int")
    members = written(clusters.join(loads.select("component", blocks.alias("blocks")), "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "jaccard-clusters")
    # about a quarter of a block's shingles to a task, however many bytes they are
    tasks = 1 + int((loads.agg(F.sum("load").alias("s")).first().s or 0) * 4 // BLOCK_SHINGLES)
    texts = rows.join(members, F.col("id") == F.col("node")).select("id", "t", "component", "block").repartition(tasks, "component", "block")
    found = written(_searched(texts, ["component", "block"], n, percent), "jaccard-links").unionByName(equal)
    if not members.filter("blocks > 1").isEmpty():
        found = _across_blocks(rows, members, found, n, percent)
    reach = components(found)
    return sizes.join(reach, F.col("id") == F.col("node"), "left").select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component", "id").alias("component_id"))


def _across_blocks(rows: DataFrame, members: DataFrame, found: DataFrame, n: int, percent: int) -> DataFrame:
    """Links between the blocks of clusters that were cut.

    First the components' smallest documents are searched together, which joins the parts of a large group of near
    copies. Then all documents outside a cluster's largest component are searched against each of its blocks.
    """
    cut = members.filter("blocks > 1")

    def labelled(links: DataFrame) -> DataFrame:
        reach = components(links).withColumnRenamed("component", "root")
        return written(cut.join(reach, "node", "left").withColumn("root", F.coalesce("root", "node")), "jaccard-roots")

    now = labelled(found)
    tops = now.filter("node = root")
    share = tops.groupBy("component").agg((F.count(F.lit(1)) / F.lit(5000.0)).alias("s"))
    tops = tops.join(share, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.ceil("s")).cast("int"))
    texts = rows.join(tops, F.col("id") == F.col("node")).select("id", "t", "component", "block")
    found = written(_searched(texts, ["component", "block"], n, percent).unionByName(found), "jaccard-links")
    now = labelled(found)
    counts = now.groupBy("component", "root").count()
    largest = counts.groupBy("component").agg(F.max_by("root", F.struct("count", "root")).alias("most"))
    rest = now.join(largest, "component").filter("root <> most").drop("most", "root")
    # the rest in slices of about a block's size, each with every block
    loads = rest.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / F.lit(2000.0)).cast("int").alias("slices"))
    rest = rest.join(loads, "component").withColumn("slice", F.pmod(F.xxhash64("node", F.lit(1)), F.col("slices")).cast("int"))
    asked = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("component", "node", "block", "slice")
    there = cut.join(loads, "component").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select("component", "node", "block", "slice")
    both = asked.unionByName(there).distinct()
    texts = rows.join(both, F.col("id") == F.col("node")).select("id", "t", "component", "block", "slice")
    return written(_searched(texts, ["component", "block", "slice"], n, percent).unionByName(found), "jaccard-links")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are the first of those linked with each other: by id, then by the SHA-256 of their text; with the columns they have.

    A row goes only if its own text is linked with one that stays or with others that are linked with that; rows that
    have nothing but an id in common all stay, of equal rows one stays. Rows without id stay, as do rows with null or
    empty texts, which are linked with nothing. Columns may have any type and name. An empty table gives an empty table.
    """
    if not repeats_ids(docs, id_col):
        reach = jaccard_components(docs, n, percent, id_col=id_col, text_col=text_col)
        gone = reach.filter("component_id <> doc_id").select(F.col("doc_id").alias(f"{OWN}gone"))
        return docs.join(gone, F.col(id_col).cast("long") == F.col(f"{OWN}gone"), "left_anti")
    rows = numbered(docs, id_col)
    reach = _components(rows.select(F.col(f"{OWN}n").alias("id"), F.col(text_col).alias("t")), n, percent).filter("doc_id is not null").select("doc_id", "component_id")
    order = rows.filter(F.col(f"{OWN}n").isNotNull()).select(F.col(f"{OWN}n").alias("doc_id"), F.struct(F.col(id_col).alias("i"), F.sha2(F.col(text_col).cast("binary"), 256).alias("h"), F.col(f"{OWN}n").alias("n")).alias("o"))
    placed = written(reach.join(order, "doc_id"), "jaccard-placed")
    firsts = placed.groupBy("component_id").agg(F.min("o").alias("first"))
    gone = placed.join(firsts, "component_id").filter("first.n <> doc_id").select(F.col("doc_id").alias(f"{OWN}gone"))
    return rows.join(gone, F.col(f"{OWN}n") == F.col(f"{OWN}gone"), "left_anti").drop(f"{OWN}n")
