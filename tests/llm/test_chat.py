"""Role repair against an enumeration of all repairs, from rules that are stated here anew."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tenderlake.llm import chat

#: What a role name means, and what each change costs.
MEANS = {"system": "s", "user": "u", "human": "u", "prompter": "u", "assistant": "a", "bot": "a", "gpt": "a", "model": "a", "ai": "a"}
PRICE = {"merge": 1, "relabel": 2, "name": 1, "empty turn": 3}
NAMES = ["system", "user", "assistant", "human", "tool", None, "gpt", " User "]


def is_legal(roles: str) -> bool:
    """An optional system turn, then one or more pairs of user and assistant."""
    return re.fullmatch("s?(ua)+", roles) is not None


def enumerated(names) -> int:
    """The least price over every new naming of the turns, every choice of turns to merge and every way to add empty turns."""
    given = [MEANS.get((n or "").strip().lower()) for n in names]
    best = None
    for roles in itertools.product("sua", repeat=len(given)):
        price = sum(0 if r == g else PRICE["name"] if g is None else PRICE["relabel"] for r, g in zip(roles, given, strict=True))
        if best is not None and price >= best:
            continue
        for joins in itertools.product((False, True), repeat=max(len(roles) - 1, 0)):
            if any(j and roles[i] != roles[i + 1] for i, j in enumerate(joins)):
                continue
            turns = [r for i, r in enumerate(roles) if i == 0 or not joins[i - 1]]
            found = added("".join(turns))
            if found is not None:
                total = price + PRICE["merge"] * sum(joins) + PRICE["empty turn"] * found
                best = total if best is None else min(best, total)
    return best


def added(turns: str):
    """The fewest empty turns that make turns legal, by trying: at every place nothing or any string of up to two turns."""
    best = None
    for extra in itertools.product(("", "u", "a", "ua", "au"), repeat=len(turns) + 1):
        size = sum(map(len, extra))
        if (best is None or size < best) and is_legal(extra[0] + "".join(t + e for t, e in zip(turns, extra[1:], strict=True))):
            best = size
    return best


def rendered_roles(text):
    return re.findall(r"<\|im_start\|>(\w+)\n", text)


def repaired(spark, rows, schema="conv_id long, turn long, role string, text string"):
    docs = spark.createDataFrame(rows, schema).withColumns({"part": F.lit(1), "enter": F.lit(2), "cost": F.lit(3)})
    return chat.repair(docs)


@pytest.fixture(scope="module")
def enumeration():
    return {names: enumerated(names) for n in range(1, 4) for names in itertools.product(["system", "user", "assistant", None], repeat=n)}


def test_every_short_conversation(spark, enumeration):
    """All conversations of up to three turns, and some of four, cost what the enumeration finds and render legally."""
    rnd = random.Random(7)
    want = enumeration | {names: enumerated(names) for names in {tuple(rnd.choice(NAMES) for _ in range(4)) for _ in range(40)}}
    convs = dict(enumerate(want))
    out = repaired(spark, [(c, i, r, f"t{i}" if i % 5 else None) for c, names in convs.items() for i, r in enumerate(names)]).collect()
    for c, names in convs.items():
        own = sorted((r for r in out if r.conv_id == c), key=lambda r: r.turn)
        assert len(own) == len(names) and sum(r.cost for r in own) == want[names], names
        text = "".join(r.segment for r in own)
        assert is_legal("".join(x[0] for x in rendered_roles(text))), names
        assert text.count("<|im_end|>") == len(rendered_roles(text))
        assert re.findall(r"t\d", text) == [f"t{i}" for i in range(len(names)) if i % 5]


def test_long_conversations_lie_over_partitions(spark):
    """A conversation over several partitions costs what the same turns cost in one."""
    rnd = random.Random(6)
    names = [rnd.choice(NAMES) for _ in range(700)]
    rows = [(1, i, r, "x" * (5000 if i == 3 else 5)) for i, r in enumerate(names)] + [(c, i, rnd.choice(NAMES), "y") for c in range(2, 60) for i in range(9)]
    out = repaired(spark, rows).collect()
    own = sorted((r for r in out if r.conv_id == 1), key=lambda r: r.turn)
    roles = [chat.role_of(r) for r in names]
    least = min(c + chat.INSERT * len(chat.ENDINGS[s]) for s, c in enumerate(chat.costs_from(chat.START, roles)))
    assert sum(r.cost for r in own) == least and len(out) == len(rows)
    assert is_legal("".join(x[0] for x in rendered_roles("".join(r.segment for r in own))))
    assert any("x" * 5000 in r.segment for r in own)


@pytest.mark.parametrize("kind", ["tinyint", "smallint", "int", "bigint", "decimal(10,0)", "string", "date"])
def test_types_of_ids_and_turns(spark, kind):
    cast = lambda c: (F.date_add(F.to_date(F.lit("2024-01-01")), F.col(c).cast("int")) if kind == "date" else F.col(c).cast(kind)).alias(c)
    rows = [(1, 1, "user", "a"), (1, 2, "assistant", "b"), (None, 1, "user", "c"), (1, None, "user", "d"), (1, 1, "user", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.repair(turns.select(cast("conv_id"), cast("turn"), "role", "text"))
    assert out.count() == len(rows) and dict(out.dtypes)["turn"] == kind
    assert chat.repair(turns.limit(0)).count() == 0
