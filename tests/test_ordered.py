"""Quotas, turns and waterfalls against loops."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import quotas, waterfall


def candidates(seed):
    rng = random.Random(seed)
    return [(i, rng.choice([None, 0, 0, 0, 0, rng.randrange(25)]), rng.randrange(9)) for i in range(400)]


def by_group(rows):
    groups = {}
    for i, g, o in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[0])):
        groups.setdefault(g, []).append(i)
    return groups


@pytest.mark.parametrize("seed, per_group, total, block", [(1, 0, 0, 10_000), (2, 7, 0, 10_000), (3, 0, 90, 10_000), (4, 7, 60, 10_000), (5, 5, 77, 2), (6, 3, 1000, 3)])
def test_quotas_and_turns(spark, monkeypatch, seed, per_group, total, block):
    monkeypatch.setattr(quotas, "BLOCK", block)
    rows = candidates(seed)
    frame = spark.createDataFrame(rows, "i int, g int, o int").repartition(3)
    groups, taken = by_group(rows), []
    for own in groups.values():
        taken += own[: per_group or None][: max(0, total - len(taken)) if total else None]
    assert sorted(r.i for r in quotas.within_quotas(frame, "g", ["o", "i"], per_group, total).collect()) == sorted(taken)
    turns, k = [], 0
    while any(len(own[: per_group or None]) > k for own in groups.values()):
        turns += [own[k] for own in groups.values() if len(own[: per_group or None]) > k]
        k += 1
    got = {r.turn: r.i for r in quotas.round_robin(frame, "g", ["o", "i"], per_group, total).collect()}
    assert [got[t] for t in range(len(got))] == turns[: total or None]
    ranks = {r.i: r.rank for r in quotas.ranked(frame, ["g"], ["o", "i"]).collect()}
    assert ranks == {i: k for own in groups.values() for k, i in enumerate(own)}


def test_no_stage_gathers_all(spark):
    frame = spark.createDataFrame(candidates(9), "i int, g int, o int")
    for out in (quotas.ranked(frame, ["g"], ["o", "i"]), quotas.round_robin(frame, "g", ["o", "i"], 5, 50), quotas.first_in_order(frame, ["o", "i"], 30)):
        assert "SinglePartition" not in out._jdf.queryExecution().toString()
    first = sorted((o, i) for i, _, o in candidates(9))[:30]
    assert sorted((r.o, r.i) for r in quotas.first_in_order(frame, ["o", "i"], 30).collect()) == first
    assert quotas.first_in_order(frame.limit(0), ["o", "i"], 30).count() == 0 and quotas.within_quotas(frame.limit(0), "g", ["i"], 1, 1).count() == 0


def answers(spark, rows, read):
    frame = spark.createDataFrame(rows, "id long, ok boolean, formatted string, number string, confidence double")

    def ask(left):
        read.append(sorted(r.id for r in left.select("id").collect()))
        return frame

    return ask


def test_waterfall_reads_only_open_rows(spark):
    lines = spark.createDataFrame([(k, f"{k} Oak St") for k in range(1, 8)], "id long, line string")
    read = []
    first = [(1, True, "1 Oak St", None, 95.0), (2, True, "2 Oak St", None, 60.0), (3, True, "33 Oak St", None, 99.0), (4, False, None, None, 0.0), (5, True, "5 Oak St", None, 70.0), (6, True, "6 Oak St", None, 0.0), (6, True, "6 Oak St", None, 10.0)]
    second = [(1, True, "1 Oak St", None, 99.0), (2, True, "2 Oak Street", None, 90.0), (3, True, "Oak", "3", 20.0), (4, True, "4 Oak St", None, 50.0), (5, True, "5 Oak St", None, 70.0), (6, True, "60 Oak St", None, 99.0)]
    third = [(2, True, "2 Oak St", None, 100.0), (4, True, "4 Oak St", None, 55.0), (5, True, "5 Oak St", None, 70.0)]
    tiers = [waterfall.Tier("a", answers(spark, first, read), 85.0), waterfall.Tier("b", answers(spark, second, read), 80.0), waterfall.Tier("c", answers(spark, third, read), 1000.0)]
    got = {r.id: (r.tier, r.confidence, r.settled) for r in waterfall.waterfall(lines, tiers).collect()}
    assert got == {1: ("a", 95.0, True), 2: ("b", 90.0, True), 3: ("b", 20.0, False), 4: ("c", 55.0, False), 5: ("a", 70.0, False), 6: ("a", 10.0, False)}
    assert read == [[1, 2, 3, 4, 5, 6, 7], [2, 3, 4, 5, 6, 7], [3, 4, 5, 6, 7]]
    empty = waterfall.waterfall(lines.limit(0), [waterfall.Tier("a", answers(spark, first, []), 85.0)])
    assert empty.count() == 0


def test_final_confidence(spark):
    rows = [(1, "12 Oak St", "12", True, "12 Oak St, Austin", None, 70.0), (2, "12 Oak St", "12", True, "14 Oak St", None, 70.0), (3, "12 Oak St", "12", True, "14 Oak St", "12", 70.0), (4, "12 Oak St", "12", False, None, None, 7.0), (5, "12 Oak St", "12", True, "", None, 20.0)]
    out = waterfall.finalized(spark.createDataFrame(rows, "id int, line string, own string, ok boolean, formatted string, number string, confidence double")).orderBy("id").collect()
    assert [(r.agrees, r.confidence) for r in out] == [(True, 70.0), (False, 35.0), (True, 70.0), (False, 7.0), (False, 20.0)]
    assert out[0].match == 100 and out[1].match <= 40
