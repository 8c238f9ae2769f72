"""Chat formatting with minimum-cost role repair.

Turns must follow an automaton: an optional system turn, then user and assistant in turns, from the user on. Each turn of a
conversation is kept, relabelled, merged into the turn before it, or preceded by empty turns, at the least total cost.
A run of turns is a 4 x 4 matrix of least costs between states, and such matrices compose; so long conversations are
repaired in chunks: matrices of chunks, then the states at their edges, then the turns within each chunk. Spark sorts all
turns over ranges, and chunks are runs of at most CHUNK rows of one conversation in that order, whatever their numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenta.llm.common import bounds, durable, shuffle_width, sorted_groups, table

ROLES = ("system", "user", "assistant")
#: States: nothing yet, or the role of the last turn. NEXT: the turns that may follow.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FINAL = (START, USER, ASSISTANT)
MERGE, INSERT, RELABEL, NAME = 2, 3, 4, 1  # NAME: a role that is null or unknown gets any role
#: Turns in a chunk.
CHUNK = 512
FAR = 1 << 40


def _paths() -> dict[tuple[int, int], list[int]]:
    """Shortest runs of legal turns from one state to another, the runs' states."""
    out: dict[tuple[int, int], list[int]] = {}
    for s in range(4):
        out[s, s], front = [], [s]
        while front:
            a = front.pop(0)
            for b in NEXT[a]:
                if (s, b) not in out:
                    out[s, b] = [*out[s, a], b]
                    front.append(b)
    return out


PATHS = _paths()
Step = tuple[int, str, list[int]]  # cost, operation, empty turns before it


def _steps(role: int) -> list[list[Step | None]]:
    """For a turn of a role (0: none known) the least step from each state to each state; of equal costs the first of keep, merge, relabel, insert."""
    table: list[list[Step | None]] = [[None] * 4 for _ in range(4)]
    for s in range(4):
        for t in (SYSTEM, USER, ASSISTANT):
            label = 0 if t == role else NAME if role == 0 else RELABEL
            choices: list[tuple[int, int, str, list[int]]] = []
            if s == t:
                choices.append((MERGE + label, 1, "merge", []))
            for before in range(4):
                if t in NEXT[before] and (s, before) in PATHS:
                    gap = PATHS[s, before]
                    name = "insert" if gap else "keep" if not label else "relabel"
                    choices.append((INSERT * len(gap) + label, 3 if gap else 2 if label else 0, name, gap))
            if choices:
                cost, _, name, gap = min(choices, key=lambda c: (c[0], c[1], c[3]))
                table[s][t] = (cost, name, gap)
    return table


STEPS = [_steps(r) for r in range(4)]
#: What ending in a state costs, and the empty turns that it takes.
ENDS = [min((INSERT * len(PATHS[s, f]), PATHS[s, f]) for f in FINAL if (s, f) in PATHS) for s in range(4)]


def forward(roles: list[int], start: list[int]) -> tuple[list[int], list[list[int]]]:
    """Least costs of the states after the turns, and for each turn the state before, by state after; of equal costs the first state."""
    costs, back = start, []
    for r in roles:
        new, came = [FAR] * 4, [0] * 4
        for t in range(4):
            for s in range(4):
                if (step := STEPS[r][s][t]) and costs[s] + step[0] < new[t]:
                    new[t], came[t] = costs[s] + step[0], s
        costs = new
        back.append(came)
    return costs, back


def between(roles: list[int], entry: int, leave: int) -> list[tuple[int, int]]:
    """(state before, state after) of each turn on a least path."""
    _, back = forward(roles, [0 if s == entry else FAR for s in range(4)])
    out, t = [], leave
    for came in reversed(back):
        out.append((came[t], t))
        t = came[t]
    return out[::-1]


def matrix(roles: list[int]) -> list[int]:
    return [c for s in range(4) for c in forward(roles, [0 if x == s else FAR for x in range(4)])[0]]


def edges_of(matrices: list[list[int]]) -> list[tuple[int, int]]:
    """The states before and after each chunk on a least path from the start to a legal end."""
    costs, back = [0, FAR, FAR, FAR], []
    for m in matrices:
        options = [[(costs[s] + m[4 * s + t], s) for s in range(4)] for t in range(4)]
        best = [min(x) for x in options]
        costs, came = [min(c, FAR) for c, _ in best], [s for _, s in best]
        back.append(came)
    t = min(range(4), key=lambda s: (costs[s] + ENDS[s][0], s))
    out = []
    for came in reversed(back):
        out.append((came[t], t))
        t = came[t]
    return out[::-1]


OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _turn(state: int, text: str) -> str:
    return f"{OPEN}{ROLES[state - 1]}\n{text}"


def fragment(before: int, after: int, step: Step, text: str, last: bool) -> str:
    """What a turn adds to the rendered conversation; fragments in order, joined, are the conversation."""
    _, name, gap = step
    text = text.replace("<|", "< |")  # no text may open or close a turn
    if name == "merge":
        out = f"\n{text}"
    else:
        out = CLOSE * (before != START) + "".join(_turn(s, "") + CLOSE for s in gap) + _turn(after, text)
    if last:
        out += CLOSE + "".join(_turn(s, "") + CLOSE for s in ENDS[after][1])
    return out


def _sorted(conversations: DataFrame, chunk: int) -> DataFrame:
    """Turns in order, in chunks: (chunk, conv, conv_id, turn, k, code, text, costs); k is a turn's place in its chunk, costs the chunk's matrix, on its last turn."""
    role = F.lower(F.trim("role"))
    code = F.when(role == "system", SYSTEM).when(role == "user", USER).when(role == "assistant", ASSISTANT).otherwise(0)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), code.cast("int").alias("code"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "code", "text"]
    # rows that repeat each other can stand in any order, so a range of them may be cut anywhere
    rows = rows.withColumn("salt", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(shuffle_width(conversations), *order, "salt").sortWithinPartitions(*order).select(F.spark_partition_id().cast("long").alias("part"), *order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cuts a partition's turns into chunks; the open chunk's codes are held until it ends."""
        last, codes, held, number = None, [], None, -1
        for batch in batches:
            part, conv, code = (batch.column(i).to_pylist() for i in (0, 1, 3))
            chunks, places, costs = [0] * len(conv), [0] * len(conv), [None] * len(conv)
            for i, c in enumerate(conv):
                if (c, True) != last or len(codes) == chunk:
                    if i:
                        costs[i - 1] = matrix(codes)
                    elif held is not None:
                        held = held.set_column(held.num_columns - 1, "costs", pa.array([matrix(codes)], COSTS))
                    codes, number, last = [], number + 1, (c, True)
                chunks[i], places[i] = (part[i] << 40) + number, len(codes)
                codes.append(code[i])
            if held is not None:
                yield held
            made = pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), *batch.columns[1:], pa.array(places, pa.int32()), pa.array(costs, COSTS)], names=["chunk", *order, "k", "costs"])
            yield made.slice(0, made.num_rows - 1)
            held = made.slice(made.num_rows - 1)
        if held is not None:
            yield held.set_column(held.num_columns - 1, "costs", pa.array([matrix(codes)], COSTS))

    made = rows.mapInArrow(cut, "chunk long, conv_id long, turn long, code int, text string, k int, costs array<bigint>")
    return table(made)  # ranges are drawn from a sample: they must not be drawn again


COSTS = pa.list_(pa.int64())


def repaired(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row for each turn: conv_id, turn, seq (place in its conversation), role (after repair), op, cost, n_inserted, fragment.

    Turns are ordered by turn, then role and text; null turns come first. Null and unknown roles take any role; null texts
    are empty. Rows without conv_id are one conversation. Repeated rows are turns of their own. An empty table gives none.
    In fragments, texts have a space put into each <|, so that none opens or closes a turn; that is not undone anywhere.
    """
    rows = _sorted(conversations, chunk)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in sorted_groups(batches, "conv"):
            conv, size = own["conv"].to_numpy(), own["size"].to_numpy()
            at, costs = bounds(conv), own["costs"].to_pylist()
            made = [(s, e, k == b - a - 1) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) for k, (s, e) in enumerate(edges_of(costs[a:b]))]
            before = np.cumsum(size) - size
            before -= np.repeat(before[at[:-1]], np.diff(at))  # turns of the conversation before the chunk
            yield pa.RecordBatch.from_arrays([own["chunk"].combine_chunks(), pa.array(before, pa.int64()), pa.array([x[0] for x in made], pa.int32()), pa.array([x[1] for x in made], pa.int32()), pa.array([x[2] for x in made], pa.bool_())], names=["chunk", "before", "entry", "leave", "ends"])

    # one row for each chunk, a CHUNK-th of the turns
    matrices = rows.where("costs is not null").select("chunk", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")).alias("conv"), (F.col("k") + 1).cast("long").alias("size"), "costs")
    n = shuffle_width(conversations)
    edges = durable(matrices.repartition(n, "conv").sortWithinPartitions("conv", "chunk").mapInArrow(states, "chunk long, before long, entry int, leave int, ends boolean"))

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in sorted_groups(batches, "chunk", 1 << 13):
            at = bounds(own["chunk"].to_numpy())
            code, text, entry, leave, ends, before = (own[c].to_pylist() for c in ("code", "text", "entry", "leave", "ends", "before"))
            out: list[tuple] = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                for k, (s, t) in enumerate(between(code[a:b], entry[a], leave[a])):
                    step, last = STEPS[code[a + k]][s][t], ends[a] and a + k == b - 1
                    tail = ENDS[t] if last else (0, [])
                    out.append((before[a] + k, ROLES[t - 1], step[1], step[0] + tail[0], len(step[2]) + len(tail[1]), fragment(s, t, step, text[a + k], last)))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([own["conv_id"].combine_chunks(), own["turn"].combine_chunks(), *(pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds))], names=["conv_id", "turn", "seq", "role", "op", "cost", "n_inserted", "fragment"])

    joined = rows.drop("costs").join(edges, "chunk").repartition(n, "chunk").sortWithinPartitions("chunk", "k")
    return joined.mapInArrow(turns, "conv_id long, turn long, seq long, role string, op string, cost long, n_inserted long, fragment string")


def rendered(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, cost, text: whole conversations. A conversation's text must fit a row; repaired() has no such bound."""
    own = repaired(conversations, chunk).groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.sort_array(F.collect_list(F.struct("seq", "fragment"))).alias("turns"))
    return own.select("conv_id", "cost", F.array_join(F.col("turns.fragment"), "").alias("text"))
