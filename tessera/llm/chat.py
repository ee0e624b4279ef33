"""Chat formatting: minimum-cost repair of the roles of a conversation, then rendering.

Legal conversations are the words of a small automaton: perhaps one system message, then user and assistant in turn,
the assistant last.  For every turn the repair may relabel it, merge it into the message before it, or insert an empty
message before it, each at a cost (:data:`COSTS`); dynamic programming over the automaton's states finds the cheapest
repair of the whole conversation.

A turn is a 4 x 4 matrix of costs between states, and a run of turns is the product of theirs in (min, +).  So a
conversation of any length and numbering is dealt out in blocks of ``BLOCK`` turns: each block gives its matrix, the
blocks of a conversation are chained on those 16 numbers, and each block is then decided by itself, given the states it
starts and ends in.  No task holds a conversation.

Turns are ordered by (turn, hash of role and text); a null turn comes first.  Role names are matched without case or
surrounding white space; a role that is not known costs less to relabel.  A null text is empty.

Defined results: exact repeats (same conversation, turn, role and text) are one turn sent again and come back once,
counted in ``repeats``.  Rows without a conv_id form one conversation.  Ties go to the repair whose steps sort first in
``ACTIONS``.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut_lineage, shuffle_partitions

BLOCK = 1024
ROLES = ("system", "user", "assistant")
KNOWN = {"system": 0, "developer": 0, "user": 1, "human": 1, "prompter": 1, "assistant": 2, "gpt": 2, "bot": 2, "model": 2}
OTHER = 3
COSTS = {"merge": 1, "relabel": 4, "relabel_unknown": 1, "insert": 3}
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}  # the state after a role is role + 1
FAR = 1 << 40
BEGIN, END = "<|im_start|>{}\n", "<|im_end|>\n"

# (kind of role, state before) -> choices (cost, rank in ACTIONS, state after, merged, inserted role or -1), cheapest first
ACTIONS = ("keep", "merge", "relabel", "insert")


def _choices(kind: int, state: int) -> list[tuple[int, int, int, bool, int]]:
    out = []
    for role in range(3):
        relabel = 0 if role == kind else COSTS["relabel_unknown" if kind == OTHER else "relabel"]
        rank = 0 if role == kind else 2
        after = role + 1
        if after in NEXT[state]:
            out.append((relabel, rank, after, False, -1))
        elif after == state:
            out.append((relabel + COSTS["merge"], rank + 1, after, True, -1))
        out += [(relabel + COSTS["insert"], rank + 4, after, False, x - 1) for x in NEXT[state] if after in NEXT[x]]
    return sorted(out)


CHOICES = {(k, s): _choices(k, s) for k in range(4) for s in range(4)}
FINAL = {START: 0, SYSTEM: 2 * COSTS["insert"], USER: COSTS["insert"], ASSISTANT: 0}


def _matrix(kind: int) -> np.ndarray:
    m = np.full((4, 4), FAR, dtype=np.int64)
    for s in range(4):
        for cost, _, after, _, _ in CHOICES[kind, s]:
            m[s, after] = min(m[s, after], cost)
    return m


MATRIX = np.stack([_matrix(k) for k in range(4)])
_ROWS = MATRIX.tolist()


def kind_of(role: str | None) -> int:
    return KNOWN.get((role or "").strip().lower(), OTHER)


def best_path(kinds: list[int], entry: int, exit: int) -> list[tuple[int, int, int, bool, int]]:
    """The cheapest choices that lead from one state to another over these turns."""
    to_go = [[FAR] * 4 for _ in range(len(kinds) + 1)]
    to_go[-1][exit] = 0
    for i in range(len(kinds) - 1, -1, -1):  # plain numbers: numpy is slower on four at a time
        to_go[i] = [min(map(add, row, to_go[i + 1])) for row in _ROWS[kinds[i]]]
    out, state = [], entry
    for kind, rest in zip(kinds, to_go[1:], strict=True):
        choice = min(CHOICES[kind, state], key=lambda c: (c[0] + rest[c[2]], c))
        out.append(choice)
        state = choice[2]
    return out


def chain(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """The states that each block starts and ends in on the cheapest way through all blocks."""
    to_go = [np.array([FINAL[s] for s in range(4)], dtype=np.int64)]
    for m in reversed(matrices):
        to_go.append((m + to_go[-1]).min(axis=1))
    to_go.reverse()
    out, state = [], START
    for m, rest in zip(matrices, to_go[1:], strict=True):
        after = int((m[state] + rest).argmin())
        out.append((state, after))
        state = after
    return out


def _runs(batches: Iterable[pd.DataFrame], keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Whole groups of rows that come sorted by the keys: the key, and the columns of every row.

    Ids and turns come as text, since a null would turn the others in its batch into floating point.
    """
    at: tuple | None = None
    held: list[tuple] = []
    for batch in batches:
        own, rest = ([batch[c].tolist() for c in names] for names in (keys, columns))
        for key, row in zip(zip(*own, strict=True), zip(*rest, strict=True), strict=True):
            if key != at:
                if held:
                    yield at, held
                at, held = key, []
            held.append(row)
    if held:
        yield at, held


def blocked(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """Distinct turns with their block: ``conv_id, place, part, turn, tie, role, text, repeats``.

    All turns are sorted into ranges of (conversation, turn, tie), and each range is cut every ``size`` rows: ``place`` is
    the range and ``part`` the cut.  So a conversation of n turns, however they are numbered, has about n / ``size``
    blocks, and one more for each range that it lies in.
    """
    own = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    ).withColumn("tie", F.xxhash64(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))))
    once = cut_lineage(own.groupBy("conv_id", "turn", "tie", "role", "text").agg(F.count("*").alias("repeats")))
    order = ["conv_id", "turn", "tie", "role", "text"]
    at = F.monotonically_increasing_id()  # the range in the upper bits, the row's place in it in the lower 33
    placed = once.repartitionByRange(shuffle_partitions(turns.sparkSession), *order[:3]).sortWithinPartitions(*order).withColumn("at", at)
    place, part = F.shiftright("at", 33).alias("place"), F.floor(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) / size).cast("long").alias("part")
    return cut_lineage(placed.select("conv_id", place, part, "turn", "tie", "role", "text", "repeats"))


def repair(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """Repaired turns of ``(conv_id, turn, role, text)``.

    Returns, per distinct turn, ``conv_id, turn, role, repeats``, its ``new_role``, the ``action`` (keep, merge,
    relabel or relabel+merge), the roles ``inserted_before`` and ``inserted_after`` it as empty messages (or null), the
    ``cost``, and ``rendered``: joined in the order of ``turn, tie`` they are the rendered conversation.
    """
    key = ["conv_id", "place", "part"]
    placed = blocked(turns, size)

    def matrices(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for (conv, place, part), rows in _runs(batches, key, ["role"]):
            m = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)
            for (role,) in rows:
                m = np.minimum((m[:, :, None] + MATRIX[kind_of(role)][None]).min(axis=1), FAR)
            out.append((conv, place, part, m.ravel()))
            if len(out) >= 5000:
                yield pd.DataFrame(out, columns=[*key, "m"])
                out = []
        yield pd.DataFrame(out, columns=[*key, "m"])

    conv, turn = F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn")
    thin = placed.select(conv, "place", "part", "role")  # as it was sorted and written
    found = cut_lineage(thin.mapInPandas(matrices, "conv_id string, place long, part long, m array<long>"))

    def chained(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for (conv,), rows in _runs(batches, ["conv_id"], ["place", "part", "m"]):
            ends = chain([np.asarray(m).reshape(4, 4) for _, _, m in rows])
            out += [(conv, place, part, *end, i == len(ends) - 1) for i, ((place, part, _), end) in enumerate(zip(rows, ends, strict=True))]
            if len(out) >= 5000:
                yield pd.DataFrame(out, columns=[*key, "entry", "exit", "last"])
                out = []
        yield pd.DataFrame(out, columns=[*key, "entry", "exit", "last"])

    ends = found.repartition("conv_id").sortWithinPartitions(*key).mapInPandas(chained, "conv_id string, place long, part long, entry int, exit int, last boolean")
    ends = ends.select(F.col("conv_id").cast("long").alias("c"), F.col("place").alias("p"), F.col("part").alias("q"), "entry", "exit", "last")
    joined = placed.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") == F.col("p")) & (F.col("part") == F.col("q")))
    made = ["conv_id", "turn", "tie", "role", "repeats", "new_role", "action", "inserted_before", "inserted_after", "cost", "rendered"]

    def decide(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for (conv, _, _), rows in _runs(batches, key, ["turn", "tie", "role", "text", "repeats", "entry", "exit", "last"]):
            *_, state, exit, last = rows[0]
            path = best_path([kind_of(r[2]) for r in rows], state, exit)
            for i, ((cost, _, after, merged, inserted), (turn, tie, role, text, repeats, *_)) in enumerate(zip(path, rows, strict=True)):
                words = (text or "").replace("<|", "< |")  # no text can forge a marker
                action = "+".join(a for a, on in (("relabel", after - 1 != kind_of(role)), ("merge", merged)) if on) or "keep"
                if merged:
                    shown = "\n\n" + words
                else:
                    shown = (END if state != START else "") + (BEGIN.format(ROLES[inserted]) + END if inserted >= 0 else "") + BEGIN.format(ROLES[after - 1]) + words
                state, closing = after, []
                if last and i == len(path) - 1:
                    closing = {SYSTEM: ["user", "assistant"], USER: ["assistant"]}.get(state, [])
                    shown += END + "".join(BEGIN.format(r) + END for r in closing)
                    cost += FINAL[state]
                out.append((conv, turn, tie, role, repeats, ROLES[after - 1], action, ROLES[inserted] if inserted >= 0 else None, "+".join(closing) or None, cost, shown))
                size += len(shown)
                if len(out) >= 5000 or size >= 1 << 23:
                    yield pd.DataFrame(out, columns=made)
                    out, size = [], 0
        yield pd.DataFrame(out, columns=made)

    decided = (
        joined.repartition(*key)
        .sortWithinPartitions(*key, "turn", "tie")
        .select(conv, "place", "part", turn, "tie", "role", "text", "repeats", "entry", "exit", "last")
        .mapInPandas(decide, "conv_id string, turn string, tie long, role string, repeats long, new_role string, action string, inserted_before string, inserted_after string, cost long, rendered string")
    )
    return decided.withColumn("conv_id", F.col("conv_id").cast("long")).withColumn("turn", F.col("turn").cast("long"))
