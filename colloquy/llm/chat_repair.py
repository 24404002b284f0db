"""Chat formatting with minimum-cost role repair.

A legal conversation may open with one system turn, then user and assistant take turns, the user first.
Every turn of a stored conversation is placed as a turn of some role (its own, or relabelled), with
empty turns inserted before it where the automaton needs them, or merged into the turn before. A dynamic
program over the automaton's states finds the cheapest repair of the whole conversation.

One turn is a small matrix of costs from state to state, and a run of turns is the (min, +) product of
theirs. So a conversation of any length is cut into segments, each of them is multiplied out by itself,
and only one matrix per segment is put together per conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import bound_batches
from colloquy.session import materialize

ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
MERGE, RELABEL, INSERT = 1, 2, 3
#: A role that names nothing known takes any role at this cost.
UNKNOWN = 1
FAR = 1 << 40

#: Roles inserted on the way from a state to a new turn of a role; pairs that are missing are illegal.
BETWEEN = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, USER): (ASSISTANT,), (USER, ASSISTANT): (),
    (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
#: Where a conversation may end; from the others an empty user turn is inserted.
ENDS = {START: 0, SYSTEM: INSERT, USER: 0, ASSISTANT: 0}


def role_number(role: str | None) -> int:
    """1 to 3 for a known role or alias, in any case; 0 for others."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else 0


def step(own: int, before: int, after: int) -> tuple[int, bool]:
    """Cost of a turn of role `own` from one state to another, and whether it is merged."""
    label = 0 if own == after else UNKNOWN if own == 0 else RELABEL
    placed = INSERT * len(BETWEEN[before, after]) + label if (before, after) in BETWEEN else FAR
    merged = MERGE + label if before == after != START else FAR
    return (merged, True) if merged < placed else (placed, False)


COSTS = [[[step(own, s, t)[0] for t in STATES] for s in STATES] for own in range(4)]


def product(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    return [[min(min(a[s][k] + b[k][t] for k in STATES), FAR) for t in STATES] for s in STATES]


def ahead(costs: list[list[int]], rest: list[int]) -> list[int]:
    """Least cost from each state through a step (or run) and what follows it."""
    return [min(min(costs[s][t] + rest[t] for t in STATES), FAR) for s in STATES]


UNIT = [[0 if s == t else FAR for t in STATES] for s in STATES]


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Consecutive rows of equal keys, across batches."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_dict("records"):
            own = tuple(row[k] for k in keys)
            if own != key and rows:
                yield key, rows
                rows = []
            key = own
            rows.append(row)
    if rows:
        yield key, rows


def _frames(rows: Iterator[tuple], columns: list[str], size: int = 4096) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def _multiplied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One matrix per segment."""
    def run() -> Iterator[tuple]:
        for (conv, seg), rows in _groups(batches, ["conv_key", "seg"]):
            total = UNIT
            for row in rows:
                total = product(total, COSTS[row["own"]])
            yield conv, seg, [c for line in total for c in line]

    yield from _frames(run(), ["conv_key", "seg", "matrix"])


def _rests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per segment, last to first: the least cost of all that follows it, by the state it ends in."""
    def run() -> Iterator[tuple]:
        for (conv,), rows in _groups(batches, ["conv_key"]):
            rest = [ENDS[s] for s in STATES]
            out = []
            for row in rows:
                out.append((conv, row["seg"], list(rest), not out))
                flat = [int(c) for c in row["matrix"]]
                rest = ahead([flat[4 * s:4 * s + 4] for s in STATES], rest)
            yield from ((*o, rest[START]) for o in out)

    yield from _frames(run(), ["conv_key", "seg", "rest", "last_seg", "cost"])


def _paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For every turn: the state after it, for each state in which its segment may begin.

    Among equal costs the smallest state wins at every turn, wherever segments are cut.
    """
    def run() -> Iterator[tuple]:
        for (conv, seg), rows in _groups(batches, ["conv_key", "seg"]):
            rest = [int(c) for c in rows[0]["rest"]]
            rests = [rest]
            for row in reversed(rows[1:]):
                rests.append(ahead(COSTS[row["own"]], rests[-1]))
            rests.reverse()
            states = list(STATES)
            for i, row in enumerate(rows):
                costs = COSTS[row["own"]]
                after = [min(STATES, key=lambda t: (costs[s][t] + rests[i][t], t)) for s in states]
                yield row["pos"], conv, seg, row["own"], list(states), after, i == len(rows) - 1
                states = after

    yield from _frames(run(), ["pos", "conv_key", "seg", "own", "before", "after", "last_row"])


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per segment, first to last: the state in which it begins."""
    def run() -> Iterator[tuple]:
        for (conv,), rows in _groups(batches, ["conv_key"]):
            state = START
            for row in rows:
                yield conv, row["seg"], state
                state = int(row["after"][state])

    yield from _frames(run(), ["conv_key", "seg", "entry"])


def repair(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per stored turn, with its part of the rendered conversation.

    Adds pos (order), new_role, action (keep, relabel, merge), inserted (roles of empty turns before
    it), conversation_cost and fragment: the fragments of a conversation in the order of pos are its
    text. Turns are ordered by turn number (null last), then role and text; repeated rows are turns of
    their own. A null role or an unknown one takes the cheapest role; null and empty texts are empty
    turns. Rows without a conv_id form one conversation. Markers inside texts are broken up. Only
    conv_id, turn, role and text are read. An empty table gives no rows.
    """
    spark = turns.sparkSession
    bound_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_last("conv_id"), F.asc_nulls_last("turn"), F.asc("role"), F.asc("text"), F.asc("copy")]
    rows = materialize(
        turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
        .withColumn("copy", F.monotonically_increasing_id())
        .repartitionByRange(n, *order).sortWithinPartitions(*order)
        # Numbers of rows within partitions: the partition is the segment, the number the order.
        .withColumn("pos", F.monotonically_increasing_id()).drop("copy")
        .withColumn("seg", F.shiftright("pos", 33))
        .withColumn("conv_key", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("none")))
    )
    name = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    number = F.lit(0)
    for role, value in {**{r: i + 1 for i, r in enumerate(ROLES)}, **{a: ROLES.index(r) + 1 for a, r in ALIASES.items()}}.items():
        number = F.when(name == role, F.lit(value)).otherwise(number)
    narrow = rows.select("conv_key", "seg", "pos", number.alias("own"))

    def streamed(df: DataFrame, keys: list[str], *order_by) -> DataFrame:
        return df.repartition(n, *keys).sortWithinPartitions(*keys, *order_by)

    matrices = streamed(narrow, ["conv_key", "seg"], "pos").mapInPandas(
        _multiplied, "conv_key string, seg long, matrix array<long>"
    )
    rests = materialize(
        streamed(matrices, ["conv_key"], F.desc("seg")).mapInPandas(
            _rests, "conv_key string, seg long, rest array<long>, last_seg boolean, cost long"
        )
    )
    paths = materialize(
        streamed(narrow.join(rests.select("conv_key", "seg", "rest"), ["conv_key", "seg"]), ["conv_key", "seg"], "pos")
        .mapInPandas(_paths, "pos long, conv_key string, seg long, own int, before array<int>, after array<int>, last_row boolean")
    )
    entries = streamed(paths.where("last_row").select("conv_key", "seg", "after"), ["conv_key"], "seg").mapInPandas(
        _entries, "conv_key string, seg long, entry int"
    )
    at = entries.join(rests.select("conv_key", "seg", "last_seg", "cost"), ["conv_key", "seg"])
    begin, end = F.element_at("before", F.col("entry") + 1), F.element_at("after", F.col("entry") + 1)
    moves = paths.join(at, ["conv_key", "seg"]).select(
        "pos", "own", begin.alias("s"), end.alias("t"), (F.col("last_row") & F.col("last_seg")).alias("closing"),
        F.col("cost").alias("conversation_cost"),
    )
    return _rendered(rows.drop("seg", "conv_key").join(moves, "pos")).drop("own", "s", "t", "closing")


def _rendered(rows: DataFrame) -> DataFrame:
    """Names the moves and writes the fragments."""
    names = F.array(*[F.lit(r) for r in ROLES])
    merged, inserted = F.lit(False), F.array().cast("array<string>")
    for (s, t), between in BETWEEN.items():
        if between:
            # A merge that costs no more than the inserted turns was taken instead of them.
            here = (F.col("s") == s) & (F.col("t") == t)
            if s != t:
                inserted = F.when(here, F.array(*[F.lit(ROLES[b - 1]) for b in between])).otherwise(inserted)
    merged = F.col("s") == F.col("t")
    role = F.element_at(names, F.col("t"))
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"<\|(im_start|im_end)\|>", "<| $1 |>")
    opening = F.concat(F.lit("<|im_start|>"), role, F.lit("\n"))
    empties = F.array_join(F.transform("inserted", lambda r: F.concat(F.lit("<|im_start|>"), r, F.lit("\n<|im_end|>\n"))), "")
    closed = F.when(F.col("s") == START, F.lit("")).otherwise(F.lit("<|im_end|>\n"))
    end = F.when(F.col("closing"), F.when(F.col("t") == SYSTEM, F.lit("<|im_end|>\n<|im_start|>user\n<|im_end|>\n")).otherwise(F.lit("<|im_end|>\n"))).otherwise(F.lit(""))
    return (
        rows.withColumn("new_role", role)
        .withColumn("action", F.when(merged, "merge").when(F.col("own") == F.col("t"), "keep").otherwise("relabel"))
        .withColumn("inserted", inserted)
        .withColumn("fragment", F.concat(F.when(merged, F.lit("\n\n")).otherwise(F.concat(closed, empties, opening)), body, end))
    )
