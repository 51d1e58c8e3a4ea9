"""Merkle manifest of a dataset: a root, a proof for each row, and the root that an altered row would fold to.

The rows' leaves are ranged by source, id and digest, so each partition holds a run of consecutive leaves. Two facts a
partition (its first and last source and their counts) tell every partition where its leaves stand, so the number of
nodes on each level is known everywhere.

A *forest* is the set of nodes whose parents can't be known yet, keyed by tree, level and index. Forests form a monoid:
the merge is the union, after which every run of siblings that is complete becomes its parent, as often as that goes. A
partition's own forest holds only what touches its edges, at most 15 nodes a level and edge; ``treeReduce`` merges the
forests to the root. Runs that were completed by a merge are kept beside them; there is at most one a level for each pair
of neighbouring partitions, and at most ``MOST_PARTS`` partitions, which bounds what the driver gets and sends out. With
these runs each partition makes the proofs of its own leaves.
"""

from __future__ import annotations

import pickle
from collections import ChainMap
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from hashlib import sha256
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, ascii_lower, checkpointed

FAN = 16
#: Partitions of leaves: one for each LEAVES_A_PART leaves, within these bounds.
LEAVES_A_PART, LEAST_PARTS, MOST_PARTS = 250_000, 16, 16_384
HEX = 64
#: The tree over the sources' roots; a source's own tree has the source's place among all as its key.
TOP = -1

Key = tuple[int, int, int]


def digest(run: str) -> str:
    """``run``: the hexadecimal digests of siblings, joined."""
    return sha256(run.encode()).hexdigest()


def without(run: str, slot: int) -> str:
    return run[: HEX * slot] + run[HEX * (slot + 1) :]


def replaced(run: str, slot: int, node: str) -> str:
    return run[: HEX * slot] + node + run[HEX * (slot + 1) :]


def field_bytes(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(doc_id: str, source: str, lang: str, n_chars: str, text: Column) -> Column:
    return F.sha2(F.concat(*(field_bytes(F.col(c)) for c in (doc_id, source, lang, n_chars)), field_bytes(text)).cast("binary"), 256)


@dataclass(frozen=True)
class Sizes:
    """Leaves of each tree that more than one partition or merge sees, and the number of sources."""

    sources: int
    shared: dict[int, int]

    def width(self, tree: int, level: int, own: dict[int, int]) -> int:
        n = self.sources if tree == TOP else own.get(tree) or self.shared[tree]
        for _ in range(level):
            n = -(-n // FAN)
        return n


@dataclass
class Forest:
    nodes: dict[Key, str] = field(default_factory=dict)
    #: Runs that a merge completed: the key of their parent, and the joined digests.
    runs: dict[Key, str] = field(default_factory=dict)


def settle(forest: Forest, sizes: Sizes, own: dict[int, int], fresh: list[Key]) -> None:
    """Turns complete runs into their parents; only runs that hold a node of ``fresh`` can have become complete."""
    while fresh:
        tree, level, index = fresh.pop()
        if (tree, level, index) not in forest.nodes:
            continue
        width = sizes.width(tree, level, own)
        if width == 1:
            if tree != TOP:  # a source's root is a leaf of the tree over the sources
                forest.nodes[(TOP, 0, tree)] = forest.nodes.pop((tree, level, 0))
                fresh.append((TOP, 0, tree))
            continue
        first = index // FAN * FAN
        keys = [(tree, level, i) for i in range(first, min(first + FAN, width))]
        if all(k in forest.nodes for k in keys):
            run = "".join(forest.nodes.pop(k) for k in keys)
            parent = (tree, level + 1, index // FAN)
            forest.runs[parent], forest.nodes[parent] = run, digest(run)
            fresh.append(parent)


def merge(a: Forest, b: Forest, sizes: Sizes) -> Forest:
    """Associative; the empty forest is neutral."""
    out = Forest(a.nodes | b.nodes, a.runs | b.runs)
    settle(out, sizes, {}, list(out.nodes))
    return out


@dataclass(frozen=True)
class Part:
    """Where a partition's leaves stand: its first source's place, the leaves of that source before, and all of the sources at its edges."""

    first_source: int
    before: int
    totals: dict[int, int]


def spans(table: pa.Table, part: Part) -> Iterator[tuple[int, int, pa.Table]]:
    """(place of the source, index of the first leaf, rows) of each source of a partition, rows in order."""
    codes = table.column("source").combine_chunks().dictionary_encode("encode").indices.to_numpy()
    cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        yield part.first_source + k, part.before if k == 0 else 0, table.slice(lo, hi - lo)


def grown(place: int, start: int, leaves: list[str], sizes: Sizes, own: dict[int, int]) -> tuple[Forest, dict[Key, str]]:
    """A span's forest and the runs completed inside it, level by level."""
    forest, runs = Forest(), {}
    level, at, nodes = 0, start, leaves
    while nodes:
        width = sizes.width(place, level, own)
        if width == 1:
            forest.nodes[(TOP, 0, place)] = nodes[0]
            break
        ups: list[str] = []
        up_at = -(-at // FAN)
        head = min(up_at * FAN - at, len(nodes))
        for i in range(head):
            forest.nodes[(place, level, at + i)] = nodes[i]
        i = head
        while i < len(nodes):
            some = nodes[i : i + FAN]
            if len(some) < FAN and at + i + len(some) < width:
                for j, x in enumerate(some):
                    forest.nodes[(place, level, at + i + j)] = x
                break
            run = runs[(place, level + 1, (at + i) // FAN)] = "".join(some)
            ups.append(digest(run))
            i += FAN
        level, at, nodes = level + 1, up_at, ups
    settle(forest, sizes, own, list(forest.nodes))
    return forest, runs | forest.runs


def part_forest(table: pa.Table, part: Part, sizes: Sizes) -> Forest:
    """What is open at a partition's edges. Its inner runs aren't kept."""
    out = Forest()
    for place, start, rows in spans(table, part):
        own = {place: part.totals.get(place) or len(rows)}
        forest, _ = grown(place, start, rows.column("leaf").to_pylist(), sizes, own)
        out.nodes |= forest.nodes
        if len(out.nodes) > 4 * FAN:
            settle(out, sizes, own, [k for k in out.nodes if k[0] == TOP])
            out.runs.clear()
    settle(out, sizes, part.totals, list(out.nodes))
    out.runs.clear()
    return out


def path(key: Key, width: Callable[[int, int], int], runs: Mapping[Key, str]) -> Iterator[tuple[int, str]]:
    """(place in its run, run) of a node and of its ancestors up to its tree's root."""
    tree, level, index = key
    while width(tree, level) > 1:
        level, slot, index = level + 1, index % FAN, index // FAN
        yield slot, runs[(tree, level, index)]


PROOF = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])
OUT = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proofs(place: int, start: int, rows: pa.Table, runs: Mapping[Key, str], sizes: Sizes, own: dict[int, int], root: str) -> Iterator[tuple]:
    width = lambda tree, level: sizes.width(tree, level, own)
    top, lone = list(path((TOP, 0, place), width, runs)), width(place, 0) == 1
    above, siblings = top, "".join(without(run, slot) for slot, run in top)
    subroot, lowest, last = root, "", None
    if top:
        slot, run = top[0]
        subroot = run[HEX * slot : HEX * (slot + 1)]
    for i, (doc_id, leaf, tampered) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("doc_id", "leaf", "tampered")))):
        node, proof, slot, parent = tampered or leaf, "", (start + i) % FAN, (start + i) // FAN
        if not lone:
            if parent != last:  # leaves of one run have all but the lowest level in common
                lowest, last = runs[(place, 1, parent)], parent
                above = [*path((place, 1, parent), width, runs), *top]
                siblings = "".join(without(run, s) for s, run in above)
            proof, node = without(lowest, slot), digest(replaced(lowest, slot, node))
        for s, run in above:
            node = digest(replaced(run, s, node))
        yield doc_id, leaf, subroot, root, digest(proof + siblings), node, node == root


def ranged_leaves(docs: DataFrame, doc_id: str, source: str, lang: str, n_chars: str, text: str) -> DataFrame:
    """(doc_id, source, leaf, tampered leaf) in order, checkpointed; digests only, no text is shuffled."""
    tampered = F.when(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, leaf_digest(doc_id, source, lang, n_chars, ascii_lower(F.col(text))))
    leaves = checkpointed(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), leaf_digest(doc_id, source, lang, n_chars, F.col(text)).alias("leaf"), tampered.alias("tampered"), F.monotonically_increasing_id().alias(f"{OWN}n")))
    # the last key is unique, so that no number of equal rows lands in one partition
    keys = [F.asc_nulls_first(c) for c in ("source", "doc_id", "leaf", f"{OWN}n")]
    parts = min(MOST_PARTS, max(LEAST_PARTS, -(-leaves.count() // LEAVES_A_PART)))
    ranged = leaves.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return checkpointed(ranged.select("doc_id", "source", "leaf", "tampered"))


def edges(ranged: DataFrame) -> list[tuple]:
    """(partition, distinct sources, first and last source, their leaves) of each partition with rows, in order."""

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, first, last, first_n, last_n = 0, None, None, 0, 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                if n == 0 or x != last:
                    n, last, last_n = n + 1, x, 0
                    first = x if n == 1 else first
                last_n += 1
                first_n += n == 1
        if n:
            at = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([n]), pa.array([first], pa.string()), pa.array([last], pa.string()), pa.array([first_n]), pa.array([last_n])], names=["at", "n", "first", "last", "first_n", "last_n"])

    found = ranged.select("source").mapInArrow(facts, "at bigint, n bigint, first string, last string, first_n bigint, last_n bigint")
    return sorted(map(tuple, found.collect()))


def placed(facts: list[tuple]) -> tuple[dict[int, Part], Sizes]:
    """Where each partition's leaves stand. ``facts``: as from ``edges``, at most MOST_PARTS rows."""
    parts, totals = {}, {}
    place, before, last = -1, 0, object()
    for at, n, first, final, first_n, last_n in facts:
        if first != last:
            place, before = place + 1, 0
        first_place = place
        totals[place] = totals.get(place, 0) + first_n
        start = before
        place += n - 1
        if n > 1:
            totals[place] = last_n
        before = last_n if n > 1 else before + first_n
        last = final
        parts[at] = (first_place, start, place)
    return {at: Part(a, start, {a: totals[a], z: totals[z]}) for at, (a, start, z) in parts.items()}, Sizes(place + 1, totals)


def build_manifest(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", text: str = "text") -> DataFrame:
    """A row for each of ``docs``: doc_id, leaf, subroot of its source, root, digest of its proof, folded root, verified.

    Null fields are ``-`` in a leaf; a null source and null ids come first; an empty text isn't a null one. Rows with
    equal ids stand in the order of their leaves, and equal rows have leaves of their own, so their proofs may differ. A
    row without id isn't tampered with. An empty table gives an empty one. Other columns play no part.
    """
    spark = docs.sparkSession
    ranged = ranged_leaves(docs, doc_id, source, lang, n_chars, text)
    facts = edges(ranged)
    if not facts:
        return spark.createDataFrame([], OUT)
    parts, sizes = placed(facts)
    sent = spark.sparkContext.broadcast((parts, sizes))

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts, sizes = sent.value
        if part := parts.get(TaskContext.get().partitionId()):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(part_forest(pa.Table.from_batches(batches), part, sizes))], pa.binary())], names=["forest"])

    whole = ranged.mapInArrow(forests, "forest binary").rdd.map(lambda r: pickle.loads(r[0])).treeReduce(lambda a, b: merge(a, b, sent.value[1]), depth=3)
    (root,) = whole.nodes.values()
    joined = spark.sparkContext.broadcast((whole.runs, root))

    def proven(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts, sizes = sent.value
        runs, root = joined.value
        if part := parts.get(TaskContext.get().partitionId()):
            yield from _proven(pa.Table.from_batches(batches), part, sizes, runs, root)

    return ranged.mapInArrow(proven, OUT)


def _proven(table: pa.Table, part: Part, sizes: Sizes, joined: dict[Key, str], root: str) -> Iterator[pa.RecordBatch]:
    runs, edge, own = {}, Forest(), dict(part.totals)
    for place, start, rows in spans(table, part):
        own[place] = part.totals.get(place) or len(rows)
        forest, inner = grown(place, start, rows.column("leaf").to_pylist(), sizes, own)
        edge.nodes |= forest.nodes
        runs |= inner
    settle(edge, sizes, own, list(edge.nodes))  # runs of sources' roots that lie in this partition
    found = ChainMap(runs, edge.runs, joined)
    for place, start, rows in spans(table, part):
        for some in batched(proofs(place, start, rows, found, sizes, own, root), 5000):
            yield _batch(some)


def _batch(rows: tuple[tuple, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PROOF)], schema=PROOF)
