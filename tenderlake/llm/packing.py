"""Documents as token ids packed into sequences of bounded length by bin completion."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .bpe import SPACE, byte_alphabet
from .common import durable, table

CAPACITY, END = 2048, 0
#: Nodes of the search after the first descent, and fillings tried at a node.
NODES, WIDTH = 1000, 4
#: Candidates for fillings that are held against each other, and those of one first item.
CANDIDATES, EACH = 24, 4
#: Tokens in a batch of pieces.
TOGETHER = 1 << 20


class ByteBpe:
    """The vocabulary of a byte-level tokenizers file, run by tiktoken with the same ids.

    The file's words end with a look-ahead, ``\\s+(?!\\S)``: of a run of blanks before a word all but the last are one
    piece. Texts with such runs are cut there beforehand, so that the pattern needs no look-ahead; it is twice as fast.
    """

    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"

    def __init__(self, raw: str):
        spec = json.loads(raw)
        if spec["normalizer"] or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("not a plain byte-level vocabulary")
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(byte.__getitem__, s)): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.core = tiktoken.Encoding("pieces", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.run = re.compile(f"[{SPACE}]{{2}}")
        self.before_last = re.compile(f"(?<=[{SPACE}])(?=[{SPACE}][^{SPACE}])")

    def encode(self, text: str) -> np.ndarray:
        if self.split and any(s in text for s in self.special):
            return np.concatenate([np.array([self.special[p]], np.uint32) if p in self.special else self.ordinary(p) for p in self.split.split(text)])
        return self.ordinary(text)

    def ordinary(self, text: str) -> np.ndarray:
        if self.run.search(text):
            return np.concatenate([self.core.encode_to_numpy(p, disallowed_special=()) for p in self.before_last.split(text)])
        return self.core.encode_to_numpy(text, disallowed_special=())


@lru_cache(maxsize=2)
def vocabulary(raw: str) -> ByteBpe:
    return ByteBpe(raw)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, *, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """``keep``, piece, start, length, ids_crc32, _task, _at (and ids): each text's ids with ``end`` after them.

    A document longer than ``capacity`` is cut into pieces of that length, the first of which takes what is over. ``_at``
    numbers the pieces of one length within a task. No shuffle. A null text counts as empty: its one id is ``end``.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(path or default_path(), encoding="utf-8") as f:
        raw = spark.sparkContext.broadcast(f.read())
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    fields = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + ["piece int, start long, length int, ids_crc32 long, _task int, _at long"] + (["ids array<int>"] if with_ids else []))

    def run(batches):
        bpe, task, seen = vocabulary(raw.value), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            out, ids, tokens = [], [], 0
            for i, t in enumerate(batch.column("_text")):
                doc = np.append(bpe.encode(t.as_py()), np.uint32(end)).astype("<u4")
                at, size = 0, (len(doc) - 1) % capacity + 1
                for k in range(-(-len(doc) // capacity)):
                    part = doc[at : at + size]
                    out.append((i, k, at, size, crc32(part), task, seen[size]))
                    if with_ids:
                        ids.append(part)
                    seen[size] += 1
                    at, size = at + size, capacity
                tokens += len(doc)
                if tokens >= TOGETHER:
                    yield made(batch, out, ids)
                    out, ids, tokens = [], [], 0
            if out:
                yield made(batch, out, ids)

    def made(batch, out, ids):
        row, *cols = zip(*out, strict=True)
        types = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
        arrays = [batch.column(c).take(pa.array(row)) for c in keep] + [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
        names = [*keep, "piece", "start", "length", "ids_crc32", "_task", "_at"]
        if with_ids:
            flat = pa.array(np.concatenate(ids).astype(np.int32))
            arrays.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), flat))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(run, fields)


# --- Fillings of a sequence, over counts of lengths --------------------------------------------------------------------


def least_bins(counts: np.ndarray, capacity: int) -> int:
    """A lower bound on the bins for ``counts[size]`` items: by the sum, and for each threshold k by the items above
    capacity - k, those above half, and what of the items from k on doesn't fit beside them."""
    sizes = np.arange(capacity + 1)
    number, total = np.cumsum(counts), np.cumsum(counts * sizes)
    half = capacity // 2
    k = np.arange(1, half + 1)
    above = number[capacity] - number[half]
    beside = (number[capacity - k] - number[half]) * capacity - (total[capacity - k] - total[half])
    small = total[half] - total[k - 1]
    more = np.maximum(0, -((beside - small) // capacity))
    return max(int(-(-total[capacity] // capacity)), int(above + more.max(initial=0)))


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit in decreasing order, over counts: (filling, how many bins), many equal bins at once."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    closed: list[tuple[tuple[int, ...], int]] = []

    def put(filling, room, n):
        if n:
            (open_bins.setdefault(room, []) if room else closed).append((filling, n))

    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        while left:
            room = min((r for r in open_bins if r >= size), default=None)
            if room is None:
                each = capacity // size
                put((size,) * each, capacity - each * size, left // each)
                put((size,) * (left % each), capacity - left % each * size, 1 if left % each else 0)
                break
            filling, n = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
            each = room // size  # the fit stays the best one as long as another of this size fits
            take = min(n, left // each)
            put(filling + (size,) * each, room - each * size, take)
            rest = left - take * each
            if take < n and rest:
                put(filling + (size,) * rest, room - rest * size, 1)
                rest, take = 0, take + 1
            put(filling, room, n - take)
            left = rest
    return closed + [x for held in open_bins.values() for x in held]


def dominated(small: tuple[int, ...], great: tuple[int, ...]) -> bool:
    """Whether the items of ``small`` fit into those of ``great`` as bins."""

    def fits(items, rooms):
        if not items:
            return True
        return any(r >= items[0] and fits(items[1:], rooms[:i] + (r - items[0],) + rooms[i + 1 :]) for i, r in enumerate(rooms))

    return fits(small, great)


def fillings(counts: np.ndarray, room: int) -> list[tuple[int, ...]]:
    """Undominated ways to fill ``room`` from ``counts``, the least waste first.

    Where the room holds more than three of the largest items, those go in first; the rest is filled with up to three
    items, the last of which is the best fit. A filling is dropped if its items fit into those of another one.
    """
    base: list[int] = []
    counts = counts.copy()
    while True:
        fit = np.maximum.accumulate(np.where(counts[: room + 1] > 0, np.arange(room + 1), 0))
        top = int(fit[room])
        many = min(int(counts[top]), room // top - 3) if top else 0
        if many <= 0:
            break
        base += [top] * many
        counts[top] -= many
        room -= many * top
    if not top:
        return [tuple(base)]
    found: dict[tuple[int, ...], int] = {(top,): room - top}

    def pairs(room, most, lead=()):
        """Each size up to ``most``, with the best fit for what is left, no larger than itself."""
        sizes = np.flatnonzero(counts[: min(room, most) + 1])
        if lead:
            sizes = sizes[(sizes != lead[0]) | (counts[sizes] > 1)]
        other = fit[np.minimum(room - sizes, sizes)]
        short = (other == sizes) & (counts[other] < 2 + (np.isin(other, lead) if lead else 0)) & (other > 0)
        other = np.where(short, fit[np.maximum(np.minimum(room - sizes, sizes) - 1, 0) * (short)], other)
        if lead:
            other = np.where((other == lead[0]) & (other != sizes) & (counts[other] < 2), 0, other)
        waste = room - sizes - other
        for i in np.lexsort((-sizes, waste))[:EACH].tolist():
            yield tuple(x for x in (*lead, int(sizes[i]), int(other[i])) if x), int(waste[i])

    if found[(top,)]:
        found |= dict(pairs(room, top))
        if min(found.values()):
            for a in np.flatnonzero(counts[: room + 1])[::-1][:CANDIDATES].tolist():
                found |= dict(pairs(room - a, a, (a,)))
                if not min(found.values()):
                    break
    order = sorted(found, key=lambda f: (found[f], len(f), [-x for x in f]))[:CANDIDATES]
    kept: list[tuple[int, ...]] = []
    for f in order:
        if not any(dominated(f, k) for k in kept):
            kept.append(f)
            if len(kept) == WIDTH:
                break
    return [tuple(base) + f for f in kept]


def completed(counts: np.ndarray, capacity: int, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (filling, how many): bin completion over counts of sizes, the best-fit solution being the first incumbent.

    At each node the largest size left is completed by one of its undominated fillings, for as many bins as the counts allow;
    a run of equal bins uses up a size, so that a descent has at most as many steps as there are sizes. A node is left if
    its bins and the lower bound of the rest (the sum of sizes, and so the waste) reach the incumbent. The search ends when
    the incumbent meets the bound of all items, or after ``nodes`` nodes more than there are sizes: the incumbent is then the
    best found, not proven the least.
    """
    best = best_fit(counts, capacity)
    least, fewest = least_bins(counts, capacity), sum(n for _, n in best)
    if fewest == least:
        return best
    counts, chosen, used = counts.copy(), [], 0
    stack: list = []  # of each depth: the fillings still to try, the best last
    left = nodes + int(np.count_nonzero(counts))

    def options():
        top = int(np.flatnonzero(counts)[-1])
        counts[top] -= 1
        ways = [(top, *f) for f in fillings(counts, capacity - top)]
        counts[top] += 1
        return ways[::-1]

    stack.append(options())
    while stack and left:
        if not stack[-1]:
            stack.pop()
            if chosen:
                sizes, uses, n, _ = chosen.pop()
                counts[sizes] += uses * n
                used -= n
            continue
        left -= 1
        way = stack[-1].pop()
        sizes, uses = np.unique(way, return_counts=True)
        n = int((counts[sizes] // uses).min())
        if n < 1:
            raise AssertionError("a filling that the counts don't hold")
        counts[sizes] -= uses * n
        rest = least_bins(counts, capacity)
        if used + n + rest >= fewest:
            counts[sizes] += uses * n
            continue
        chosen.append((sizes, uses, n, way))
        used += n
        if rest:
            stack.append(options())
            continue
        best, fewest = [(w, k) for _, _, k, w in chosen], used
        if fewest == least:
            break
        stack.append([])
    return best


def pack(found: DataFrame, *, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """``pieces`` with sequence_id and offset instead of _task and _at.

    Only the counts of the lengths, at most ``capacity`` of them at any input, come to the driver, where bin completion makes
    runs of equal sequences. A piece's rank among those of its length (the totals of tasks before its own, then its number
    in the task) says which sequence of which run it is in. No piece moves for that, and no task holds a length.
    """
    found = durable(found, "pieces")
    spark = found.sparkSession
    per_task = durable(found.groupBy("_task", "length").count(), "lengths")
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select(F.col("_task").alias("_t"), F.col("length").alias("_l"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("count").alias("n")).collect():
        counts[r.length] = r.n
    plan = spark.sparkContext.broadcast(_places(completed(counts, capacity, nodes)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, start, uses, first, offset = plan.value
        size, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(keys, (size << 48) | rank, "right") - 1
        k = rank - start[at]
        return pd.DataFrame({"sequence_id": first[at] + k // uses[at], "offset": offset[at] + k % uses[at] * size})

    rows = found.join(base, (found["_task"] == base["_t"]) & (found["length"] == base["_l"])).withColumn("_place", place("length", F.col("_before") + F.col("_at")))
    return rows.select(*[c for c in found.columns if c not in ("_task", "_at")], "_place.sequence_id", "_place.offset")


def _places(bins: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """By length and first rank: that rank, the pieces of the length in a sequence, the run's first sequence, the first offset."""
    rows, taken, first = [], {}, 0
    for filling, n in bins:
        offset = 0
        for size in sorted(set(filling), reverse=True):
            uses, start = filling.count(size), taken.get(size, 0)
            rows.append((size << 48 | start, start, uses, first, offset))
            taken[size] = start + uses * n
            offset += size * uses
        first += n
    return tuple(np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)) or (np.zeros(0, np.int64),) * 5


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of its pieces in order, from ``pack`` of pieces with ids. A sequence is bounded by the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls and empty texts are one piece of one id; repeated rows are packed each; an empty table gives no rows."""
    rows = pack(pieces(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
