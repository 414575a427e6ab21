"""Chat formatting: role repair of least cost over an automaton of legal turns, then rendering."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..shipping import ship
from .common import durable, partitions_for, table

#: A conversation is an optional system turn, then user and assistant in turn, an assistant last.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant"}
#: Costs: to merge a turn into the one before, to give a turn another role, to name one without a known role, to insert an empty turn.
MERGE, RELABEL, NAME, INSERT = 1, 2, 1, 3
FAR = 1 << 40
OPEN, CLOSE = "<|im_start|>{}\n", "<|im_end|>\n"


def role_of(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else START


def _moves() -> list[list[list[tuple[int, int, int, tuple[int, ...], bool]]]]:
    """For the given role of a turn and the state before it: (cost, state after, role, roles inserted before, merged)."""
    table = []
    for given in range(4):
        rows = []
        for state in range(4):
            out = []
            for role in (SYSTEM, USER, ASSISTANT):
                cost = 0 if role == given else NAME if given == START else RELABEL
                if role == state:
                    out.append((cost + MERGE, state, role, (), True))
                if (role == SYSTEM and state == START) or (role == USER and state != USER) or (role == ASSISTANT and state == USER):
                    out.append((cost, role, role, (), False))
                if role == USER and state == USER:
                    out.append((cost + INSERT, USER, USER, (ASSISTANT,), False))
                if role == ASSISTANT and state != USER:
                    out.append((cost + INSERT, ASSISTANT, ASSISTANT, (USER,), False))
            rows.append(sorted(out))
        table.append(rows)
    return table


MOVES = _moves()
#: Roles to insert at the end of a conversation by its last state.
ENDINGS = ((), (USER, ASSISTANT), (ASSISTANT,), ())


def costs_from(state: int, roles: list[int]) -> list[int]:
    """Least cost from a state over the turns to each state."""
    now = [FAR] * 4
    now[state] = 0
    for r in roles:
        after = [FAR] * 4
        for s, c in enumerate(now):
            if c < FAR:
                for cost, to, *_ in MOVES[r][s]:
                    after[to] = min(after[to], c + cost)
        now = after
    return now


def best_moves(enter: int, leave: int, roles: list[int]):
    """The moves of least cost between two states; of equal ones the first in the order of MOVES."""
    rest = [[FAR] * 4 for _ in roles] + [[0 if s == leave else FAR for s in range(4)]]
    for i in range(len(roles) - 1, -1, -1):
        for s in range(4):
            rest[i][s] = min((m[0] + rest[i + 1][m[1]] for m in MOVES[roles[i]][s]), default=FAR)
    s, out = enter, []
    for i, r in enumerate(roles):
        move = next(m for m in MOVES[r][s] if m[0] + rest[i + 1][m[1]] == rest[i][s])
        out.append(move)
        s = move[1]
    return out


def _runs(batches, keys, columns):
    """Runs of equal keys in sorted batches, as lists of rows of ``columns``."""
    key, held = None, []
    for batch in batches:
        for k, row in zip(zip(*[batch.column(c).to_pylist() for c in keys], strict=True), zip(*[batch.column(c).to_pylist() for c in columns], strict=True), strict=True):
            if k != key and held:
                yield key, held
                held = []
            key = k
            held.append(row)
    if held:
        yield key, held


def repair(turns: DataFrame) -> DataFrame:
    """A row per turn (conv_id, turn, role, text): conv_id, turn, given, role, action, inserted, cost and segment.

    The segments of a conversation in order of (turn, role, text) are its rendering. Turns are dealt by ranges, so that
    a conversation of any length lies over many partitions. Each part gives the least costs between all pairs of
    states; those of a conversation, at most one for a partition, are put together into the states in which its parts
    begin and end; then each part finds its own moves. A null or unknown role must be named; a null text is empty; a null
    turn comes last; null conversation ids are one conversation; repeated rows are turns like others; ties between moves
    go to the first of merge or keep by role; an empty table gives no rows. Texts of any length pass whole. Ids and turns
    may be of any type that orders.
    """
    spark = turns.sparkSession
    ship(spark)
    n = partitions_for(spark)
    order = ["turn", "role", "text"]
    rows = turns.select("conv_id", "turn", "role", "text")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in rows.columns}
    arrow = {c: to_arrow_type(rows.schema[c].dataType) for c in rows.columns}
    dealt = durable(rows.repartitionByRange(n, *[F.col(c).asc_nulls_last() for c in ["conv_id", *order]]).withColumn("part", F.spark_partition_id()), "turns")
    parts = dealt.repartition(n, "part", "conv_id").sortWithinPartitions("part", "conv_id", *[F.col(c).asc_nulls_last() for c in order])

    def costs(batches):
        for (part, conv), held in _runs(batches, ["part", "conv_id"], ["role"]):
            roles = [role_of(r) for (r,) in held]
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "part": part, "costs": [c for s in range(4) for c in costs_from(s, roles)]}], schema)

    schema = pa.schema([("conv_id", arrow["conv_id"]), ("part", pa.int32()), ("costs", pa.list_(pa.int64()))])
    each = parts.select("part", "conv_id", "role").mapInArrow(costs, f"conv_id {kinds['conv_id']}, part int, costs array<bigint>")
    whole = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "costs"))).alias("parts"))
    states = pa.schema([("conv_id", arrow["conv_id"]), ("part", pa.int32()), ("enter", pa.int32()), ("leave", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_())])

    def bounds(batches):
        for batch in batches:
            out = []
            for conv, parts in zip(batch.column("conv_id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                rest = [[INSERT * len(ENDINGS[s]) for s in range(4)]]
                for p in reversed(parts):
                    rest.insert(0, [min(p["costs"][4 * s + t] + rest[0][t] for t in range(4)) for s in range(4)])
                s = START
                for i, p in enumerate(parts):
                    t = next(t for t in range(4) if p["costs"][4 * s + t] + rest[i + 1][t] == rest[i][s])
                    out.append({"conv_id": conv, "part": p["part"], "enter": s, "leave": t, "first": i == 0, "last": i == len(parts) - 1})
                    s = t
            yield pa.RecordBatch.from_pylist(out, states)

    found = whole.mapInArrow(bounds, f"conv_id {kinds['conv_id']}, part int, enter int, leave int, first boolean, last boolean")
    found = found.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "enter", "leave", "first", "last")
    joined = dealt.join(found, (dealt["part"] == found["_part"]) & dealt["conv_id"].eqNullSafe(found["_conv"])).drop("_conv", "_part")
    joined = joined.repartition(n, "part", "conv_id").sortWithinPartitions("part", "conv_id", *[F.col(c).asc_nulls_last() for c in order])
    result = pa.schema([("conv_id", arrow["conv_id"]), ("turn", arrow["turn"]), ("given", pa.string()), ("role", pa.string()), ("action", pa.string()), ("inserted", pa.string()), ("cost", pa.int64()), ("segment", pa.string())])

    def moves(batches):
        for (_, conv), held in _runs(batches, ["part", "conv_id"], ["turn", "role", "text", "enter", "leave", "first", "last"]):
            given = [role_of(h[1]) for h in held]
            out = []
            for i, (h, g, (cost, _, role, before, merged)) in enumerate(zip(held, given, best_moves(held[0][3], held[0][4], given), strict=True)):
                empty = "".join(OPEN.format(ROLES[r]) + CLOSE for r in before)
                text = h[2] or ""
                piece = "\n" + text if merged else ("" if i == 0 and h[5] else CLOSE) + empty + OPEN.format(ROLES[role]) + text
                if i == len(held) - 1 and h[6]:
                    piece += CLOSE + "".join(OPEN.format(ROLES[r]) + CLOSE for r in ENDINGS[h[4]])
                    cost += INSERT * len(ENDINGS[h[4]])
                action = "+".join([*["merge"] * merged, *["relabel"] * (role != g)]) or "keep"
                out.append({"conv_id": conv, "turn": h[0], "given": h[1], "role": ROLES[role], "action": action, "inserted": ",".join(ROLES[r] for r in before), "cost": cost, "segment": piece})
            yield pa.RecordBatch.from_pylist(out, result)

    return joined.mapInArrow(moves, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, given string, role string, action string, inserted string, cost long, segment string")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))
