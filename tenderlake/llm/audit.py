"""How filters of a corpus act on one another, in every order; duplicates are found in radix tries of whole texts."""

from __future__ import annotations

import json
from bisect import bisect_right
from itertools import permutations
from math import ceil, factorial
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import partitions_for, table, words_of

#: Texts of the sample that sets the ranges, and the characters of each that are looked at. Only the balance of tasks hangs on it.
SAMPLE, LOOK = 16_384, 256
#: Buckets for each shuffle partition, and bytes of text that a bucket may hold before there are more of them.
BUCKETS, BUCKET_BYTES = 8, 16 << 20
#: A first trie, before the shuffle, is emptied at so many bytes of different texts or rows.
TRIE_BYTES, TRIE_ROWS = 16 << 20, 200_000


class Node:
    __slots__ = ("label", "below", "rows")

    def __init__(self, label: bytes):
        self.label, self.below, self.rows = label, None, None


class Trie:
    """A compressed trie of whole texts. A text's terminal holds what was put under it; ``bytes`` counts the labels."""

    def __init__(self):
        self.root, self.bytes, self.count = Node(b""), 0, 0

    def put(self, text: bytes, row) -> None:
        node, at, size = self.root, 0, len(text)
        while at < size:
            below = node.below
            child = below.get(text[at]) if below else None
            if child is None:
                child = Node(text[at:])
                self.bytes += size - at
                if below is None:
                    node.below = {}
                node.below[text[at]] = child
                node, at = child, size
            elif text.startswith(child.label, at):
                at += len(child.label)
                node = child
            else:  # the edge is cut where the texts part
                k = _shared(child.label, text, at)
                upper = Node(child.label[:k])
                child.label = child.label[k:]
                upper.below = {child.label[0]: child}
                node.below[text[at]] = upper
                node, at = upper, at + k
        if node.rows is None:
            node.rows = []
        node.rows.append(row)
        self.count += 1

    def terminals(self):
        """(text, rows) of each text, in no order that matters."""
        stack = [(self.root, b"")]
        while stack:
            node, path = stack.pop()
            path += node.label
            if node.rows is not None:
                yield path, node.rows
            if node.below:
                stack += [(child, path) for child in node.below.values()]


def _shared(label: bytes, text: bytes, at: int) -> int:
    """Length of the common start of ``label`` and ``text`` from ``at``."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == text[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def prefix_ranges(texts: DataFrame, partitions: int) -> tuple[list[bytes], list[int], int]:
    """Cuts between ranges of texts, the buckets of each range, and how many there are in all.

    From the texts of the least hashes, ``SAMPLE`` of them or fewer (copies count once). A cut is the shortest prefix that
    parts two neighbours; a range that is heavier than a bucket and that ``LOOK`` characters don't part is dealt over
    several buckets by the hash of the whole text. Equal texts have one bucket in any case.
    """
    rows = texts.count()
    share = min(1.0, SAMPLE / max(rows, 1))
    h = F.xxhash64("text")
    few = texts.where(F.pmod(h, F.lit(1 << 40)) < int(share * (1 << 40))).groupBy(h.alias("h")).agg(F.first(F.substring("text", 1, LOOK)).alias("p"), F.first(F.octet_length("text")).alias("b"))
    found = sorted((r.p.encode(), r.b + 1) for r in few.select("p", "b").collect())
    whole = sum(b for _, b in found)
    wanted = max(BUCKETS * partitions, ceil(whole / share / BUCKET_BYTES))
    cuts, salts, held, before = [], [], 0, None
    for prefix, size in found:
        if held * wanted >= whole and before is not None and prefix != before and len(cuts) < SAMPLE // 4:
            cuts.append(prefix[: _shared(prefix, before, 0) + 1])
            salts.append(held)
            held = 0
        held, before = held + size, prefix
    salts = [max(1, round(x * wanted / whole)) for x in [*salts, held]] if whole else [1]
    return cuts, salts, sum(salts)


def duplicate_flags(rows: DataFrame, *, bit: int) -> DataFrame:
    """(doc_id, part, mask, n): ``rows`` of doc_id, part, mask and text (none of them null but doc_id), with ``bit`` set in the
    masks of rows whose text a smaller id has too; ``n`` equal rows are one.

    Tries stand before and after the shuffle. The first ones, of bounded size, flag the rows whose text a smaller id has
    nearby, and send each different text once with its least id. Those texts are dealt by range of their prefixes; a trie
    of each bucket then has the least id of each text. A text on any share of all rows is sent once by a first trie. Rows
    without an id have the greatest one; they are flagged if the text has an id.
    """
    spark = rows.sparkSession
    ship(spark)
    cuts, salts, buckets = prefix_ranges(rows.select("text"), partitions_for(spark))
    partitions = max(partitions_for(spark), buckets // BUCKETS)
    ranges = spark.sparkContext.broadcast((cuts, salts, [sum(salts[:k]) for k in range(len(salts))]))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["bucket", "doc_id", "part", "mask", "n", "text"]
    id_type: list = []

    def batch_of(out):
        types = (pa.int32(), id_type[0], pa.string(), pa.int64(), pa.int64(), pa.string())
        cols = list(zip(*out, strict=True)) or [()] * len(types)
        return [pa.array(c, t) for c, t in zip(cols, types, strict=True)]

    def apart(trie: Trie):
        """Each text with its rows of the least id and the rows that a smaller id precedes."""
        for text, held in trie.terminals():
            least = min((r[0] for r in held if r[0] is not None), default=None)
            yield text, [r for r in held if r[0] == least], [r for r in held if r[0] != least]

    def sent(trie, first, salt, start):
        for text, least, after in apart(trie):
            counts: dict = {}
            for i, part, mask, n in least:
                counts[i, part, mask] = counts.get((i, part, mask), 0) + n
            at = bisect_right(first, text)
            bucket, whole = start[at] + crc32(text) % salt[at], text.decode()
            yield from ((bucket, *key, n, whole) for key, n in counts.items())
            # Rows that are settled go along to any bucket.
            yield from ((crc32(repr(i).encode()) % (start[-1] + salt[-1]), i, part, mask | bit, n, None) for i, part, mask, n in after)

    def nearby(batches):
        trie = Trie()
        for batch in batches:
            id_type[:] = [batch.schema.field("doc_id").type]
            for i, part, mask, text in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "part", "mask")], batch.column("text").cast(pa.large_binary()), strict=True):
                trie.put(text.as_py(), (i, part, mask, 1))
                if trie.bytes >= TRIE_BYTES or trie.count >= TRIE_ROWS:
                    yield from pieces(sent(trie, *ranges.value))
                    trie = Trie()
        if trie.count:
            yield from pieces(sent(trie, *ranges.value))

    def pieces(found):
        out, size = [], 0
        for row in found:
            out.append(row)
            size += 64 + len(row[5] or "")
            if size >= 1 << 22:
                yield pa.RecordBatch.from_arrays(batch_of(out), names=names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays(batch_of(out), names=names)

    def settled(trie):
        for _, least, after in apart(trie):
            yield from least
            yield from ((i, part, mask | bit, n) for i, part, mask, n in after)

    def everywhere(batches):
        trie, now = Trie(), None
        for batch in batches:
            id_type[:] = [batch.schema.field("doc_id").type]
            out = []
            for bucket, i, part, mask, n, text in zip(*[batch.column(c).to_pylist() for c in names[:5]], batch.column("text").cast(pa.large_binary()), strict=True):
                if bucket != now:
                    out += settled(trie)
                    trie, now = Trie(), bucket
                if text.is_valid:
                    trie.put(text.as_py(), (i, part, mask, n))
                else:
                    out.append((i, part, mask, n))
            yield narrow(out)
        if trie.count:
            yield narrow(list(settled(trie)))

    def narrow(out):
        return pa.RecordBatch.from_arrays(batch_of([(0, *r, None) for r in out])[1:5], names=names[1:5])

    sent_rows = rows.select("doc_id", "part", "mask", "text").mapInArrow(nearby, f"bucket int, doc_id {kind}, part string, mask long, n long, text string")
    dealt = sent_rows.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(everywhere, f"doc_id {kind}, part string, mask long, n long")


def interactions(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], *, duplicates: str | None = "E", text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """What each filter does at each step of each order, by part: part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    ``filters``: a letter and the condition under which a row of ``docs`` fails (null: it doesn't); the letter ``duplicates``
    stands for rows whose whole text a smaller id has too. ``labels``: doc_id, quality, toxic, of which one is enough if an
    id has several. A row's failures are the bits of a mask; masks are counted by part, and all orders follow from the
    counts of rows that fail none of a set of filters, so that no order reads rows again.

    A null text counts as empty, a null part as the empty string. Empty texts are equal to each other. Repeated rows count
    each; rows of one id and text don't make each other duplicates; rows without an id have no label and come after all ids.
    An empty table gives no rows. Other columns of ``docs`` may have any name.
    """
    letters = [*filters, *([duplicates] if duplicates else [])]
    t = F.coalesce(F.col(text), F.lit(""))
    mask = F.lit(0).cast("long")
    for k, fails in enumerate(filters.values()):
        mask = mask + F.when(fails, F.lit(1 << k)).otherwise(F.lit(0))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), mask.alias("mask"), t.alias("text"))
    rows = duplicate_flags(rows, bit=1 << len(filters)) if duplicates else rows.select("doc_id", "part", "mask", F.lit(1).cast("long").alias("n"))
    rows = rows.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    said = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = rows.join(said, rows["doc_id"] == said["_id"], "left")
    counts = rows.groupBy("part", "mask").agg(F.sum("n").alias("all"), *[F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")])
    return _orders(counts, letters)


def _orders(counts: DataFrame, letters: list[str]) -> DataFrame:
    """Every order and step of ``letters`` from (part, mask, all, good, toxic): a row per part holds, for each set of filters,
    the rows that fail none of them."""
    k, sets = len(letters), 1 << len(letters)
    per = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "all", "good", "toxic")).alias("_m"))  # at most one for each set
    clean = lambda what: F.transform(F.sequence(F.lit(0), F.lit(sets - 1)), lambda s: F.aggregate("_m", F.lit(0).cast("long"), lambda a, m: a + F.when(m["mask"].bitwiseAND(s.cast("long")) == 0, m[what]).otherwise(0)))
    per = per.select("part", *[clean(c).alias(f"_{c}") for c in ("all", "good", "toxic")])
    at = lambda c, s: F.get(F.col(f"_{c}"), s)
    weights = [F.lit(0).cast("long")] * k
    for j in range(k):
        for s in range(sets):
            if not s >> j & 1:
                times = factorial(s.bit_count()) * factorial(k - 1 - s.bit_count())
                weights[j] = weights[j] + times * (at("all", F.lit(s)) - at("all", F.lit(s | 1 << j)))
    per = per.withColumn("_shapley", F.array(*weights))
    steps = []
    for order in permutations(range(k)):
        gone = 0
        for n, j in enumerate(order, 1):
            steps.append({"filter_order": "".join(letters[i] for i in order), "step": n, "before": gone, "after": gone | 1 << j, "bit": j})
            gone |= 1 << j
    shape = "array<struct<filter_order:string,step:int,before:int,after:int,bit:int>>"
    out = per.withColumn("_s", F.explode(F.from_json(F.lit(json.dumps(steps)), shape))).select("*", "_s.*")
    one = F.element_at(F.array(*[F.lit(1 << j) for j in range(k)]), F.col("bit") + 1)
    lost = lambda c: at(c, F.col("before")) - at(c, F.col("after"))
    return out.select(
        "part", "filter_order", "step", at("all", F.col("after")).alias("kept"), lost("all").alias("removed"),
        (at("all", F.lit(0)) - at("all", one) - lost("all")).alias("redundant"), (at("all", F.lit(sets - 1) - one) - at("all", F.lit(sets - 1))).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("_shapley", F.col("bit")).alias("shapley"),
    )


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of few words (A), repeated words (B), capitals (C) and symbols (D); a null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    words = words_of(t)
    capitals = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals.cast("long") > 2 * F.length(t).cast("long"),
        "D": t.rlike("[#$%&*|]"),
    }


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), text_filters(F.col("text")))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
             + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
             + (CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), min(doc_id) OVER (PARTITION BY t) IS NOT NULL) THEN 16 ELSE 0 END) AS mask FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x(k, letter) AS (VALUES (0, 'A'), (1, 'B'), (2, 'C'), (3, 'D'), (4, 'E')),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.k, b.k, c.k, d.k, e.k] AS ks FROM x a, x b, x c, x d, x e
      WHERE a.k NOT IN (b.k, c.k, d.k, e.k) AND b.k NOT IN (c.k, d.k, e.k) AND c.k NOT IN (d.k, e.k) AND d.k <> e.k),
s AS (SELECT filter_order, step, 1 << ks[step] AS own, list_sum(list_transform(ks[1:step], lambda j: 1 << j)) AS after FROM o, range(1, 6) r(step)),
p AS (SELECT part, filter_order, step, own,
             sum(CASE WHEN mask & after = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & own > 0 AND mask & (after - own) = 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & own > 0 AND mask & (after - own) > 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & own > 0 AND mask & (after - own) = 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & own > 0 AND mask & (after - own) = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM (SELECT part, CAST(mask AS BIGINT) AS mask, n, good, toxic FROM c), (SELECT filter_order, step, CAST(own AS BIGINT) AS own, CAST(after AS BIGINT) AS after FROM s) GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM p
"""
