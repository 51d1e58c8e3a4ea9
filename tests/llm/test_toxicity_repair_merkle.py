"""Operators 11 to 13 against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import merkle, queries, repair, toxicity
from waymark.llm.common import id_remainder

DATA = Path("/root/testdata/sf0.1")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# 11 toxicity


@pytest.mark.parametrize("block", [1, 4, 32])
def test_block_max_search_is_exact(block):
    rng = random.Random(block)
    vectors = []
    for _ in range(150):
        terms = sorted(rng.sample(range(20), rng.randint(1, 6)))
        vectors.append(toxicity.vector(tuple((t, rng.randint(1, 3)) for t in terms), np.ones(20)))
    index = toxicity.Index(vectors, 20, block)
    dense = np.zeros((150, 20))
    for k, (t, w) in enumerate(vectors):
        dense[k, t] = w
    for k in range(150):
        near, cosines = index.nearest(*vectors[k], 7, but=k)
        all_cosines = dense @ dense[k]
        all_cosines[k] = -1
        want = np.sort(all_cosines)[::-1][:7]
        assert np.allclose(cosines, want[want > 0]) and len(set(near)) == len(near) and k not in near
        assert np.allclose(all_cosines[near], cosines)


def test_blocks_are_left_out():
    """Alike examples share blocks, so that most blocks are never opened."""
    vectors = [toxicity.vector(((k // 32, 1), (31, 1)), np.array([1.0] * 31 + [0.01])) for k in range(31 * 32)]
    index = toxicity.Index(vectors, 32, 32)
    seen = []
    index.starts = type("Seen", (), {"__getitem__": lambda self, i, s=index.starts: seen.append(i // 32) or s[i]})()
    near, _ = index.nearest(*vectors[40], 5)
    assert near.tolist() == [32, 33, 34, 35, 36] and len(set(seen)) <= 2


def test_held_out_labels(spark):
    """Near all held-out labels are found, and the labels of held-out rows play no part."""
    out = queries.op11_toxicity(spark, str(DATA))
    labels = spark.read.parquet(str(DATA / "labels.parquet"))
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == spark.read.parquet(str(DATA / "documents.parquet")).count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    known = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect()]
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.99 and sum(p == y for p, y in known) / len(known) > 0.99
    taught = {r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    assert all(i in taught for r in got.values() for i in r.evidence_ids)
    docs = spark.read.parquet(str(DATA / "documents.parquet")).select("doc_id", "text")
    swapped = labels.withColumn("toxic", F.when(id_remainder("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    model = toxicity.fit_on(docs, swapped, "toxic", id_remainder("doc_id", 5) != 0)
    assert all(abs(r.score - got[r.doc_id].score) < 1e-12 for r in toxicity.score_toxicity(docs, model).select("doc_id", "score").collect())


def test_toxicity_edges(spark):
    model = toxicity.fit([("=bad", 3), ("^awfu", 2)], [(1, 1, [0], [1]), (2, 1, [0, 1], [2, 1]), (3, 1, [0, 1], [1, 1]), (4, 0, [], []), (5, 0, [], [])])
    long = "fine words " * 200_000 + "BAD"
    rows = [(1, None), (2, ""), (3, "bad"), (3, "bad"), (None, "so bad, awfully"), (4, long), (5, "   ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("mine")).withColumn("evidence_ids", F.lit("mine")).withColumn("kept", F.lit("yes"))
    out = toxicity.score_toxicity(docs, model)
    assert out.columns == ["doc_id", "text", "score", "evidence_ids", "kept", "evidence_cosines", "evidence_labels"]
    by = [(r.doc_id, r.score, list(r.evidence_ids)) for r in out.collect()]
    assert len(by) == 7 and by[2] == by[3] and by[2][1] > 0.5 > by[0][1] == by[1][1] == by[6][1] and by[0][2] == []
    assert by[4][1] > 0.5 and by[5][1] > 0.5 and by[2][2][0] == 1
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    empty = toxicity.fit_on(docs.select("doc_id", "text"), labels, "toxic", F.lit(True))
    assert {r.score for r in toxicity.score_toxicity(docs, empty).collect()} == {0.5}
    # votes of one label, and votes that say nothing, still give probabilities
    assert toxicity.curve(np.ones(5), np.ones(5, int))[0] >= 0 and toxicity.curve(np.zeros(4), np.array([0, 1, 0, 1]))[0] >= 0


# 12 conversation repair


def damage(rows):
    out = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        if kind:
            out += [(c, t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    return out


MOVES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def repaired_by_search(rows):
    """Least (cost, letters) by going forward through all states of ``(s?(ua)+)?``, with whole strings."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    def put(to, state, cost, letters, lines):
        if state is not None and (state not in to or (cost, letters) < to[state][:2]):
            to[state] = (cost, letters, lines)

    def inserted(ways):
        for _ in range(3):
            for state, (cost, letters, lines) in list(ways.items()):
                for role in ("user", "assistant"):
                    put(ways, MOVES.get((state, role[0])), cost + 5, letters + "I", (*lines, f"{role}:"))
        return ways

    ways = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults):
        following = {}
        for state, (cost, letters, lines) in inserted(ways).items():
            put(following, state, cost + 2, letters + "D", lines)
            if fault not in ("b", "d"):
                more = cost + 5 * (fault == "t")
                put(following, MOVES.get((state, role[:1])), more, letters + "K", (*lines, f"{role}:{text}"))
                for other in ("user", "assistant"):
                    put(following, MOVES.get((state, other[0])), more + 1, letters + "R", (*lines, f"{other}:{text}"))
        ways = following
    cost, letters, lines = min((w for s, w in inserted(ways).items() if s in ("", "a")), key=lambda w: w[:2])
    turns, initials = {t for t, _, _ in rows if t is not None}, [r[:1] for _, r, _ in rows]
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, letters, sha("\n".join(lines))


def repaired_rows(rows):
    after = damage(rows)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), sha(r[2]))
    return {c: repaired_by_search(sorted((r[1:] for r in after if r[0] == c), key=order)) for c in {r[0] for r in rows}}


def random_rows(rng, n, conversations, turns):
    roles, texts = ["user", "assistant", "user", "assistant", "system", None, "", "tool"], ["Hi.", "Ok", "", "   ", "Why? ", "é!\n", None]
    return [(rng.randrange(conversations) if rng.random() < 0.95 else None, rng.randrange(turns) if rng.random() < 0.95 else None, rng.choice(roles), rng.choice([*texts, f"long text {rng.randrange(5)}."])) for _ in range(n)]


CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("n, conversations, turns, limits", [(1500, 300, 8, repair.Limits()), (900, 15, 60, repair.Limits()), (500, 12, 30, repair.Limits(3, 10**6)), (400, 3, 200, repair.Limits(5, 40))])
def test_repair_against_search(spark, n, conversations, turns, limits):
    """Whole, and with limits so low that most conversations are cut in chunks."""
    rows = random_rows(random.Random(n), n, conversations, turns)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(spark.createDataFrame(rows, CONVERSATIONS), limits=limits).collect()}
    assert got == repaired_rows(rows)


def test_repair_edges(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    whole = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 > 4)
    rows = [(gone, 0, "user", "Hi."), (whole, 0, "user", "x" * 3_000_000 + ".")]
    frame = spark.createDataFrame(rows, CONVERSATIONS).withColumn("gone", F.lit(1)).withColumn("cost", F.lit("mine"))
    for limits in (repair.Limits(), repair.Limits(0, 10)):
        got = {r.conv_id: r for r in repair.repair(frame, limits=limits).collect()}
        assert tuple(got[gone])[1:] == (0, 0, 0, 0, 0, 0, "", sha(""))
        assert got[whole].audit == "D" and got[whole].cost == 2 and got[whole].repaired_sha256 == sha("")
        assert repair.repair(frame.limit(0), limits=limits).count() == 0
    fine = [("a", k, "user" if k % 2 == 0 else "assistant", f"Line {k}.") for k in range(6)]
    (r,) = repair.repair(spark.createDataFrame(fine, "conv_id string, turn int, role string, text string"), damage=False).collect()
    assert (r.conv_id, r.cost, r.audit) == ("a", 0, "KKKKKK")
    # a repeated row is a duplicate; ids beyond the whole numbers of doubles stay whole beside a null id
    big = [((1 << 60) + 1, 0, "user", "A."), ((1 << 60) + 1, 0, "user", "A."), ((1 << 60) + 1, (1 << 60) + 3, "assistant", "B."), (None, None, "user", "A."), (None, None, "assistant", "A.")]
    for limits in (repair.Limits(), repair.Limits(1, 10**6)):
        got = {r.conv_id: r for r in repair.repair(spark.createDataFrame(big, CONVERSATIONS), damage=False, limits=limits).collect()}
        assert got[(1 << 60) + 1].duplicate == 1 and got[(1 << 60) + 1].gaps == (1 << 60) + 2 and got[(1 << 60) + 1].audit == "KDK"
        assert got[None].gaps == 0 and got[None].audit == "RR"


# 13 Merkle manifest


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def manifest(rows):
    """Rows of (doc_id, source, lang, n_chars, text) by whole trees."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(part, (*r[:4], text))))
    lower = lambda t: None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda x: x[:3])
    trees = {s: tree([x[2] for x in by[s]]) for s in sources}
    top, out = tree([trees[s][-1][0] for s in sources]), []
    for k, s in enumerate(sources):
        for i, (_, _, own, r) in enumerate(by[s]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node, siblings = leaf(r, lower(r[4])) if tampered else own, ""
            for levels, j in ((trees[s], i), (top, k)):
                for level in levels[:-1]:
                    run = level[j // 16 * 16 : j // 16 * 16 + 16]
                    siblings += "".join(run[: j % 16] + run[j % 16 + 1 :])
                    run[j % 16] = node
                    node, j = sha("".join(run)), j // 16
            out.append((r[0], own, trees[s][-1][0], top[-1][0], sha(siblings), node, node == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("n, sources", [(1, 1), (17, 1), (257, 2), (700, 40), (4400, 3), (1500, 400)])
def test_manifest(spark, n, sources):
    rng = random.Random(n)
    rows = [(i if rng.random() < 0.98 else None, None if rng.random() < 0.3 else f"s{rng.randrange(sources)}é", rng.choice(["en", None]), rng.choice([None, 5]), rng.choice([None, "", f"Abc {i}", "x", "Ünï"])) for i in range(n)]
    rows += rows[:4] * 3
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("leaf", F.lit("mine")).withColumn("root", F.lit("mine"))
    assert sorted((tuple(r) for r in merkle.build_manifest(frame).collect()), key=str) == manifest(rows)


def test_forests_are_a_monoid():
    """However the leaves are parted and the parts merged, the same root and the same runs come out."""
    leaves = [sha(str(k)) for k in range(3000)]
    sizes = merkle.Sizes(1, {0: 3000})
    levels = tree(leaves)
    for seed in range(5):
        rng = random.Random(seed)
        cuts = [0, *sorted(rng.sample(range(1, 3000), 12)), 3000]
        forests = [merkle.grown(0, a, leaves[a:b], sizes, {})[0] for a, b in zip(cuts, cuts[1:])]
        assert all(len(f.nodes) <= 2 * 15 * 3 for f in forests)
        while len(forests) > 1:
            k = rng.randrange(len(forests) - 1)
            forests[k : k + 2] = [merkle.merge(forests[k], forests[k + 1], sizes)]
        assert list(forests[0].nodes.values()) == levels[-1]
        assert all(run == "".join(levels[level - 1][i * 16 : i * 16 + 16]) for (_, level, i), run in forests[0].runs.items())
    a, b, c = (merkle.grown(0, x, leaves[x : x + 1000], sizes, {})[0] for x in (0, 1000, 2000))
    left, right = merkle.merge(merkle.merge(a, b, sizes), c, sizes), merkle.merge(a, merkle.merge(b, c, sizes), sizes)
    assert left.nodes == right.nodes and merkle.merge(a, merkle.Forest(), sizes).nodes == a.nodes


def test_manifest_edges(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle.build_manifest(spark.createDataFrame([], schema)).count() == 0
    rows = [(7, "s", "en", 1, "Long Text " * 300_000)] * 40 + [(None, None, None, None, None)] * 3
    assert sorted((tuple(r) for r in merkle.build_manifest(spark.createDataFrame(rows, schema)).collect()), key=str) == manifest(rows)
