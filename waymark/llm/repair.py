"""Repair of conversations: the cheapest edits that give a legal order of roles.

A time-major dynamic programme over tensors: conversations of a batch are bucketed by length, their rows are coded in a
byte each, and all conversations of a bucket take each turn together. Backward costs are stored for every turn and state;
the edits are then traced forward, for all conversations of a bucket at once.

States: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row. 0 and 3 may end.

A conversation beyond ``Limits`` is cut in chunks, so that no task holds it. A chunk's costs between states are a
matrix; matrices are combined from the end to give each chunk the costs of what follows it, then each chunk maps its state
on entry to that on leaving. Only these matrices and maps (a row for each chunk) meet in one task. The repaired text of
such a conversation is hashed in one stream, as SHA-256 allows no other way; that task holds one chunk at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, written

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
FAR = 1 << 40
SPACE = " \t\n\x0b\x0c\r"
#: The state after a user or an assistant row, whichever may follow the state.
NEXT = np.array([2, 2, 3, 2])
#: State after keeping a row by (initial, state); 4: not allowed. Initials: 0 s, 1 u, 2 a, 3 any other.
KEPT = np.array([[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])
#: Costs of what follows the last row.
END = np.array([0, 2 * INSERT, INSERT, 0])
INITIALS = {"s": 0, "u": 1, "a": 2}
#: In a row's code, beside its initial.
MUST_GO, TRUNCATED = 4, 8


@dataclass(frozen=True)
class Limits:
    """Conversations of more rows or bytes are cut; chunks hold up to so many."""

    rows: int = 4096
    bytes: int = 8 << 20


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, gone): rows by crc32(``conv_id:turn``) % 20: 0 gone, 1 emptied, 2 without ``[.!?]``, 3 twice, 4 as user.

    Nulls count as one space in the key, the role and the text; a null turn stays null. Rows that are gone stay as marks of
    their conversation, without text.
    """
    or_space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space(F.col(conv_id)), F.lit(":"), or_space(F.col(turn))).cast("binary")) % 20
    kinded = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), or_space(F.col(role)).alias("role"), or_space(F.col(text)).alias("text"), kind.alias("kind"))
    text_after = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role_after = F.when(F.col("kind") == 0, "").when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    return kinded.select("conv_id", "turn", role_after.alias("role"), text_after.alias("text"), (F.col("kind") == 0).alias("gone"), copies).drop("copy")


def backward(codes: np.ndarray, lengths: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs [turn, state, conversation] of the cheapest way from before a turn to the end. ``codes`` [turn, conversation]; ``after`` [state, conversation]: the costs after the last row."""
    turns, n = codes.shape
    costs = np.empty((turns + 1, 4, n), np.int64)
    costs[turns] = after
    padded = np.concatenate([after, np.full((1, n), FAR)])
    which = np.arange(n)
    for t in range(turns - 1, -1, -1):
        padded[:4] = costs[t + 1]
        code, here = codes[t], costs[t]
        penalty = np.where(code & MUST_GO, FAR, np.where(code & TRUNCATED, CUT_OFF, 0))
        kept = KEPT[code & 3]
        for s in range(4):
            here[s] = np.minimum(padded[s] + DELETE, penalty + np.minimum(padded[kept[:, s], which] + KEEP, padded[NEXT[s]] + REROLE))
        here[2], here[3] = np.minimum(here[2], here[3] + INSERT), np.minimum(here[3], here[2] + INSERT)
        here[0], here[1] = np.minimum(here[0], here[2] + INSERT), np.minimum(here[1], here[2] + INSERT)
        np.minimum(here, FAR, out=here)
        here[:, t >= lengths] = after[:, t >= lengths]
    return costs


def trace(codes: np.ndarray, lengths: np.ndarray, costs: np.ndarray, states: np.ndarray, final: bool) -> tuple[np.ndarray, np.ndarray]:
    """Edits [slot, conversation] as ASCII, 0 for none, three slots a turn and two at the end; and the states on leaving.

    Of the cheapest ways that with the least string: in each place the least letter of those that keep the cost. A letter
    decides the state that follows, and no cheapest string begins another, as letters that use no row cost something.
    """
    turns, n = codes.shape
    slots, states, which = np.zeros((3 * turns + 2, n), np.uint8), states.copy(), np.arange(n)

    def insert(t: int, slot: int, wanted: np.ndarray) -> None:
        slots[slot][wanted] = ord("I")
        states[wanted] = NEXT[states[wanted]]

    for t in range(turns):
        live, code, follows = t < lengths, codes[t], costs[t + 1]
        penalty = np.where(code & MUST_GO, FAR, np.where(code & TRUNCATED, CUT_OFF, 0))
        for slot in (3 * t, 3 * t + 1):
            due = costs[t][states, which]
            insert(t, slot, live & (follows[states, which] + DELETE != due) & (costs[t][NEXT[states], which] + INSERT == due))
        due, to = costs[t][states, which], KEPT[code & 3, states]
        deleted = live & (follows[states, which] + DELETE == due)
        kept = live & ~deleted & (to < 4) & (penalty + np.where(to < 4, follows[np.minimum(to, 3), which], FAR) + KEEP == due)
        reroled = live & ~deleted & ~kept
        for chosen, letter in ((deleted, "D"), (kept, "K"), (reroled, "R")):
            slots[3 * t + 2][chosen] = ord(letter)
        states = np.where(kept, to, np.where(reroled, NEXT[states], states))
    if final:
        for slot in (3 * turns, 3 * turns + 1):
            insert(turns, slot, END[states] > 0)
    return slots, states


def buckets(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Places of conversations whose lengths have as many bits."""
    bits = np.frexp(lengths)[1]
    for b in np.unique(bits):
        yield np.flatnonzero(bits == b)


def tensor(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pieces])
    out = np.zeros((lengths.max(initial=0), len(pieces)), np.uint8)
    for k, p in enumerate(pieces):
        out[: len(p), k] = p
    return out, lengths


def edits(pieces: list[np.ndarray], after: np.ndarray, entry: np.ndarray, final: bool) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Letters, costs and states on leaving of coded rows, bucket by bucket. ``after`` [state, piece]."""
    lengths = np.array([len(p) for p in pieces])
    letters, costs, leaving = [b""] * len(pieces), np.zeros(len(pieces), np.int64), entry.copy()
    for some in buckets(lengths):
        codes, sizes = tensor([pieces[k] for k in some])
        back = backward(codes, sizes, after[:, some])
        slots, states = trace(codes, sizes, back, entry[some], final)
        costs[some], leaving[some] = back[0][entry[some], np.arange(len(some))], states
        for k, column in zip(some, slots.T):
            letters[k] = column[column > 0].tobytes()
    return letters, costs, leaving


def crossing(pieces: list[np.ndarray]) -> np.ndarray:
    """[piece, state on entry, state on leaving]: the least costs between states."""
    out = np.full((len(pieces), 4, 4), FAR)
    lengths = np.array([len(p) for p in pieces])
    for some in buckets(lengths):
        codes, sizes = tensor([pieces[k] for k in some])
        for leaving in range(4):
            after = np.full((4, len(some)), FAR)
            after[leaving] = 0
            out[some, :, leaving] = backward(codes, sizes, after)[0].T
    return out


def initial(role: str) -> int:
    return INITIALS.get(role[:1], 3)


def row_code(role: str, text: str, seen: bool) -> int:
    """A row's first fault counts: blank, duplicate (``seen``), truncated."""
    bare = text.rstrip(SPACE)
    if not bare.lstrip(SPACE) or seen:
        return initial(role) | MUST_GO
    return initial(role) | (0 if bare[-1] in ".!?" else TRUNCATED)


#: (initial, initial) of neighbours that may stand so.
LEGAL = {(0, 1), (1, 2), (2, 1)}


def repaired(roles: list[str], texts: list[str], letters: bytes, state: int) -> Iterator[str]:
    row = iter(zip(roles, texts))
    for x in letters.decode():
        role, text = ("", "") if x == "I" else next(row)
        if x == "D":
            continue
        if x == "K":
            state = int(KEPT[initial(role), state])
        else:
            state = int(NEXT[state])
            role = "user" if state == 2 else "assistant"
        yield f"{role}:{text}"


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def whole(rows: list[tuple]) -> tuple[np.ndarray, tuple]:
    """The coded rows and the counts of a whole conversation: rows of (turn, role, text) in order."""
    codes, seen, blank, duplicate = np.zeros(len(rows), np.uint8), set(), 0, 0
    for k, (_, role, text) in enumerate(rows):
        before = (role, text) in seen
        seen.add((role, text))
        codes[k] = row_code(role, text, before)
        if codes[k] & MUST_GO:
            empty = not text.strip(SPACE)
            blank, duplicate = blank + empty, duplicate + (not empty)
    first = (codes & 3).tolist()
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return codes, (gaps, blank, duplicate, int((codes & TRUNCATED > 0).sum()), sum(p not in LEGAL for p in zip(first, first[1:])))


def in_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.DataType, list[tuple[object, list[tuple]]]]]:
    """The type of ids and lists of (conv_id, rows that aren't gone) of whole conversations; the last one waits for the next batch."""
    open_id, open_rows, begun, kind = None, [], False, pa.null()
    for batch in batches:
        done, kind = [], batch.schema.field(0).type
        for conv, turn, role, text, gone in zip(*(c.to_pylist() for c in batch.columns)):
            if begun and conv != open_id:
                done.append((open_id, open_rows))
                open_rows = []
            open_id, begun = conv, True
            if not gone:
                open_rows.append((turn, role, text))
        if done:
            yield kind, done
    if begun:
        yield kind, [(open_id, open_rows)]


def repair_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for kind, conversations in in_batches(batches):
        coded = [whole(rows) for _, rows in conversations]
        n = len(coded)
        letters, costs, _ = edits([c for c, _ in coded], np.repeat(END[:, None], n, 1), np.zeros(n, np.int64), True)
        hashes = [sha256("\n".join(repaired([r for _, r, _ in rows], [t for _, _, t in rows], x, 0)).encode()).hexdigest() for (_, rows), x in zip(conversations, letters)]
        columns = [pa.array([c for c, _ in conversations], kind), *(pa.array(list(x), pa.int64()) for x in zip(*(counts for _, counts in coded))), pa.array(costs), pa.array([x.decode() for x in letters]), pa.array(hashes)]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", *COUNTS, "cost", "audit", "repaired_sha256"])


ORDER = ["conv_id", "turn", "role", f"{OWN}h"]


def ordered(columns: list[str]) -> list[Column]:
    return [F.asc_nulls_first(c) for c in columns]


def repair_cut(rows: DataFrame, conv_type: str, limits: Limits) -> DataFrame:
    """``RESULT`` by conversation for rows (conv_id, turn, role, text) of long conversations, chunk by chunk."""
    spark = rows.sparkSession
    # ids are text on this way, and so are the extreme turns: pandas makes floats of integers beside nulls
    hashed = written(rows.withColumn("conv_id", F.col("conv_id").cast("string")).withColumn(f"{OWN}h", F.unhex(F.sha2(F.col("text").cast("binary"), 256))).withColumn(f"{OWN}n", F.monotonically_increasing_id()), "repair-long")
    firsts = hashed.groupBy("conv_id", "role", f"{OWN}h").agg(F.min(F.struct("turn", f"{OWN}n")).alias("f")).select(F.col(f"f.{OWN}n").alias(f"{OWN}n"), F.lit(True).alias("first"))
    # joined by the rows' own numbers, so no frequent line is a hot key
    marked = hashed.join(firsts, f"{OWN}n", "left").withColumn("seen", F.col("first").isNull()).drop("first")
    keys = ordered([*ORDER, f"{OWN}n"])
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = marked.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text", "seen", F.spark_partition_id().alias("part"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, conv, part, size, held = 0, None, 0, 0, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (row[0] != conv or len(held) >= limits.rows or size >= limits.bytes):
                    yield chunk(conv, part, k, held)
                    k, size, held = k + 1, 0, []
                conv, part = row[0], row[5]
                size += len(row[3])
                held.append(row[1:5])
        if held:
            yield chunk(conv, part, k, held)

    def chunk(conv: object, part: int, k: int, held: list[tuple]) -> pa.RecordBatch:
        codes = np.array([row_code(role, text, seen) for _, role, text, seen in held], np.uint8)
        must = codes & MUST_GO > 0
        empty = sum(not text.strip(SPACE) for _, _, text, _ in held)
        turns = [t for t, _, _, _ in held if t is not None]
        first = (codes & 3).tolist()
        values = {
            "conv_id": pa.array([conv], pa.string()), "part": pa.array([part], pa.int32()), "k": pa.array([k], pa.int64()), "codes": pa.array([codes.tobytes()], pa.binary()),
            "roles": pa.array([[r for _, r, _, _ in held]], pa.list_(pa.string())), "texts": pa.array([[t for _, _, t, _ in held]], pa.list_(pa.string())), "matrix": pa.array([crossing([codes])[0].ravel().tolist()], pa.list_(pa.int64())),
            "low": pa.array([str(min(turns)) if turns else None], pa.string()), "high": pa.array([str(max(turns)) if turns else None], pa.string()), "turns": pa.array([len(set(turns))], pa.int64()),
            "blank": pa.array([empty], pa.int64()), "duplicate": pa.array([int(must.sum()) - empty], pa.int64()), "truncated": pa.array([int((codes & TRUNCATED > 0).sum())], pa.int64()),
            "illegal": pa.array([sum(p not in LEGAL for p in zip(first, first[1:]))], pa.int64()), "head": pa.array([first[0]], pa.int32()), "tail": pa.array([first[-1]], pa.int32()),
        }
        return pa.RecordBatch.from_arrays(list(values.values()), names=list(values))

    facts = "low string, high string, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head int, tail int"
    key = "conv_id string, part int, k bigint"
    chunks = written(ranged.mapInArrow(cut, f"{key}, codes binary, roles array<string>, texts array<string>, matrix array<bigint>, {facts}"), "repair-chunks")

    def costs_after(c: pd.DataFrame) -> pd.DataFrame:
        """The costs that follow each chunk, from the last to the first, and on the first chunk's row the conversation's counts."""
        c = c.sort_values(["part", "k"], ignore_index=True)
        after, out = END.astype(np.int64), [None] * len(c)
        for i in range(len(c) - 1, -1, -1):
            out[i] = after.tolist()
            after = np.minimum((np.array(c.matrix[i]).reshape(4, 4) + after).min(1), FAR)
        # turns ascend: a turn on both sides of a cut was counted twice
        known = [(int(a), int(b), int(n)) for a, b, n in zip(c.low, c.high, c.turns) if a is not None]
        gaps = known[-1][1] - known[0][0] + 1 - sum(n for _, _, n in known) + sum(a[1] == b[0] for a, b in zip(known, known[1:])) if known else 0
        joints = sum((a, b) not in LEGAL for a, b in zip(c["tail"][:-1], c["head"][1:]))
        counts = (gaps, int(c.blank.sum()), int(c.duplicate.sum()), int(c.truncated.sum()), int(c.illegal.sum()) + joints)
        return pd.DataFrame({"conv_id": c.conv_id, "part": c.part, "k": c.k, "after": out, "last": [i == len(c) - 1 for i in range(len(c))], **{n: [v] * len(c) for n, v in zip(COUNTS, counts)}, "cost": int(after[0])})

    totals = ", ".join(f"{c} bigint" for c in (*COUNTS, "cost"))
    followed = chunks.drop("codes", "roles", "texts").groupBy("conv_id").applyInPandas(costs_after, f"{key}, after array<bigint>, last boolean, {totals}")
    followed = written(followed, "repair-after")
    by_chunk = ["conv_id", "part", "k"]

    def same(a: DataFrame, b: DataFrame) -> Column:
        on = a["conv_id"].eqNullSafe(b["conv_id"])
        for c in by_chunk[1:]:
            on = on & (a[c] == b[c])
        return on

    def leavings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c in batches:
            pieces, after = [np.frombuffer(x, np.uint8) for x in c.codes], np.array([list(x) for x in c.after], np.int64).reshape(-1, 4).T
            by_entry = [edits(pieces, after, np.full(len(c), s), False)[2] for s in range(4)] if len(c) else [[]] * 4
            yield pd.DataFrame({x: c[x] for x in by_chunk} | {"to": [list(map(int, x)) for x in zip(*by_entry)]})

    coded = chunks.select(*by_chunk, "codes")
    maps = coded.join(followed, same(coded, followed)).select(coded["conv_id"], coded["part"], coded["k"], "codes", "after").mapInPandas(leavings, f"{key}, to array<int>")

    def entries(c: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values(["part", "k"], ignore_index=True)
        state, out = 0, []
        for to in c["to"]:
            out.append(state)
            state = int(to[state])
        return pd.DataFrame({"conv_id": c.conv_id, "part": c.part, "k": c.k, "entry": out})

    entered = written(maps.groupBy("conv_id").applyInPandas(entries, f"{key}, entry int"), "repair-entries")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c in batches:
            for r in c.itertuples(index=False):
                codes = np.frombuffer(r.codes, np.uint8)
                letters = edits([codes], np.array([list(r.after)], np.int64).T, np.array([r.entry]), bool(r.last))[0][0]
                yield pd.DataFrame({"conv_id": [r.conv_id], "part": [r.part], "k": [r.k], "audit": [letters.decode()], "text": ["".join(f"\n{x}" for x in repaired(list(r.roles), list(r.texts), letters, int(r.entry)))], **{n: [getattr(r, n)] for n in (*COUNTS, "cost")}})

    full = chunks.select(*by_chunk, "codes", "roles", "texts")
    with_after = full.join(followed, same(full, followed)).select(*(full[c] for c in full.columns), "after", "last", *COUNTS, "cost")
    both = with_after.join(entered, same(with_after, entered)).select(*(with_after[c] for c in with_after.columns), "entry")
    done = both.mapInPandas(pieces, f"{key}, audit string, text string, {totals}")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A conversation's audit and the hash of its text, from its pieces in order; the first line break is none of the text."""
        names = ["conv_id", *COUNTS, "cost", "audit", "repaired_sha256"]
        conv, counts, audit, state, begun, texted = None, (), [], sha256(), False, False

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.string()), *(pa.array([x], pa.int64()) for x in counts), pa.array(["".join(audit)]), pa.array([state.hexdigest()])], names=names)

        for batch in batches:
            for r in batch.to_pylist():
                if begun and r["conv_id"] != conv:
                    yield row()
                    audit, state, texted = [], sha256(), False
                conv, counts, begun = r["conv_id"], [r[c] for c in (*COUNTS, "cost")], True
                audit.append(r["audit"])
                state.update((r["text"] if texted else r["text"][1:]).encode())
                texted = texted or bool(r["text"])
        if begun:
            yield row()

    in_order = done.repartition("conv_id").sortWithinPartitions(*ordered(by_chunk))
    return in_order.mapInArrow(joined, f"conv_id string, {RESULT}").withColumn("conv_id", F.col("conv_id").cast(conv_type))


#: Long conversations up to this number are told apart by a broadcast of their ids, more by a shuffled join.
BROADCAST_IDS = 100_000


def repair(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", limits: Limits = Limits(), damage: bool = True) -> DataFrame:
    """A row for each conversation: its faults, the cost and letters of its cheapest repair, and the repaired text's hash.

    ``damage`` as in ``damaged``; without it, the rows are taken as they are, nulls as one space. Rows stand by turn, null
    turns first; rows of one turn by role and then by the SHA-256 of their text, so repeated rows are neighbours. A null id
    is a conversation of its own. A conversation without rows after damage has zeros, no letters, and the hash of the empty
    string. Roles that begin with none of s, u, a are never kept. An empty table gives an empty one. Other columns play no
    part. Ids are integers or strings.
    """
    rows = damaged(conversations, conv_id, turn, role, text)
    if not damage:
        or_space = lambda c: F.coalesce(F.col(c), F.lit(" "))
        rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), or_space(role).alias("role"), or_space(text).alias("text"), F.lit(False).alias("gone"))
    conv_type = dict(rows.dtypes)["conv_id"]
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
    long = written(sizes.filter((F.col("n") > limits.rows) | (F.col("b") > limits.bytes)).select(F.col("conv_id").alias(f"{OWN}c")), "repair-ids")
    n = long.count()
    short, cut = rows, None
    if n:
        ids = F.broadcast(long) if n <= BROADCAST_IDS else long
        is_long = F.col("conv_id").eqNullSafe(F.col(f"{OWN}c"))
        short, cut = rows.join(ids, is_long, "left_anti"), rows.join(ids, is_long, "left_semi")
    out_type = f"conv_id {conv_type}, {RESULT}"
    in_order = short.withColumn(f"{OWN}h", F.sha2(F.col("text").cast("binary"), 256)).repartition("conv_id").sortWithinPartitions(*ordered(ORDER))
    done = in_order.select("conv_id", "turn", "role", "text", "gone").mapInArrow(repair_whole, out_type)
    if cut is None:
        return done
    gone = cut.groupBy("conv_id").agg(F.bool_and("gone").alias("g")).filter("g")
    zeros = gone.select("conv_id", *(F.lit(0).cast("long").alias(c) for c in (*COUNTS, "cost")), F.lit("").alias("audit"), F.lit(sha256(b"").hexdigest()).alias("repaired_sha256"))
    return done.unionByName(repair_cut(cut.filter(~F.col("gone")).drop("gone"), conv_type, limits)).unionByName(zeros)
