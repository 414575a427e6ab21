"""Search structures: weighted terms, trigrams, vectors, live deadlines."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text, trigrams
from ..shipping import ship
from ..sources.storage import written

#: Weights of title, buyer and description.
FIELD_WEIGHTS = {"title": 1.0, "buyer_name": 0.4, "description": 0.2}


# Suffix rules, each over all words of a normal form at once: plurals, then frequent endings. Stems of one rule feed the next.
ENGLISH = ((r"([a-z]{2,})ies\b", "$1y"), (r"([a-z]{2,}[^sui ])s\b", "$1"), (r"([a-z]{3,})(?:ing|ed|ly)\b", "$1"))
FRENCH = ((r"([a-z]{2,})eaux\b", "$1eau"), (r"([a-z]{2,}[^e ])aux\b", "$1al"), (r"([a-z]{3,})[sx]\b", "$1"), (r"([a-z]{3,})(?:ation|ement|euse|trice|teur)\b", "$1"), (r"([a-z]{3,})e\b", "$1"))
PLAIN_WORDS: tuple = ((),)


def stemmed(normal: Column, rules: tuple) -> Column:
    for pattern, to in rules:
        normal = F.regexp_replace(normal, pattern, to)
    return normal


def terms(c: Column, stems: tuple = PLAIN_WORDS) -> Column:
    """Distinct words of the normal form, under each of the rule sets: a word has as many terms as it has different stems."""
    normal = F.array(normalize_text(c))  # in a lambda it is bound once
    if any(stems):  # rules don't reach beyond a word, so that a word that comes again is stemmed once
        normal = F.transform(normal, lambda x: F.array_join(F.array_distinct(F.split(x, " ")), " "))
    words = F.get(F.transform(normal, lambda x: F.concat(*[F.split(stemmed(x, rules), " ") for rules in stems])), F.lit(0))
    return F.array_distinct(F.array_remove(words, ""))


def term_lists(notices: DataFrame, stems: tuple = PLAIN_WORDS) -> DataFrame:
    """X-01. (id, postings) with postings an array of (term, weight): a term's weight is the sum of its fields' weights. An id is
    one row of ``notices``; no shuffle."""
    rows = notices.select("id", *[terms(F.col(c), stems).alias(f"_{c}") for c in FIELD_WEIGHTS])
    small, (last, light) = list(FIELD_WEIGHTS.items())[:-1], list(FIELD_WEIGHTS.items())[-1]
    few = F.array_distinct(F.concat(*[F.col(f"_{c}") for c, _ in small]))
    weight = lambda x: sum((F.when(F.array_contains(F.col(f"_{c}"), x), F.lit(w)).otherwise(F.lit(0.0)) for c, w in FIELD_WEIGHTS.items()), F.lit(0.0))
    own = F.transform(few, lambda x: F.struct(x.alias("term"), F.round(weight(x), 6).alias("weight")))
    rest = F.transform(F.array_except(F.col(f"_{last}"), few), lambda x: F.struct(x.alias("term"), F.lit(light).alias("weight")))
    return rows.select("id", F.concat(own, rest).alias("postings"))


def term_index(notices: DataFrame, stems: tuple = PLAIN_WORDS) -> DataFrame:
    """X-01. (id, term, weight) of ``term_lists``."""
    return term_lists(notices, stems).select("id", F.inline("postings"))


def top(found: DataFrame, k: int, *, by: str = "query", score: str = "score") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(score), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Queries, and terms of queries, of a block (by hash, about), and postings that are summed at once.
ASKED_QUERIES, ASKED_TERMS, SUMMED = 256, 1 << 14, 1 << 14


def _met(lists: DataFrame, asked: DataFrame, chosen: Callable, extra: str = "") -> DataFrame:
    """(query, id, score, ...): for every row of ``lists`` (id, postings) and every query of ``asked`` (query, term, adds), what its
    terms add to each other, summed over weight times ``adds``; of each query and row what ``chosen`` takes.

    Rows stay where they are: queries come to them, in blocks of bounded size, as a table of terms by queries. A block is one pass
    over the lists. ``chosen(table)`` makes a function for a task; that one gets the sums (rows by queries) and the rows' sizes,
    and gives places (row, query) and further columns.
    """
    spark = lists.sparkSession
    ship(spark)
    asked = written(asked.select("query", "term", "adds"), "asked")
    counts = asked.agg(F.count("*").alias("terms"), F.count_distinct("query").alias("queries")).first()
    n = max(1, math.ceil(counts.terms / ASKED_TERMS), math.ceil(counts.queries / ASKED_QUERIES))
    kinds = asked.schema["query"].dataType.simpleString(), lists.schema["id"].dataType.simpleString()

    def passed(block: int) -> DataFrame:
        held = asked.filter(F.pmod(F.xxhash64("query"), F.lit(n)) == block).toArrow()
        names, words = (held.column(c).combine_chunks().dictionary_encode() for c in ("query", "term"))
        sent = spark.sparkContext.broadcast((names.dictionary, words.dictionary, words.indices.to_numpy(), names.indices.to_numpy(), held.column("adds").to_numpy()))

        def run(batches):
            queries, vocabulary, row, column, adds = sent.value
            table = np.zeros((len(vocabulary), len(queries)))
            table[row, column] = adds
            take = chosen(table)
            for batch in batches:
                ids, postings = batch.column("id"), batch.column("postings")
                sizes = pc.fill_null(pc.list_value_length(postings), 0).to_numpy(zero_copy_only=False)
                flat = pc.list_flatten(postings)
                known = pc.index_in(flat.field("term"), value_set=vocabulary)
                mine = np.flatnonzero(known.is_valid().to_numpy(zero_copy_only=False))
                word, of = known.drop_null().to_numpy(), np.repeat(np.arange(len(ids)), sizes)[mine]
                weight = flat.field("weight").to_numpy(zero_copy_only=False)[mine]
                at = 0
                while at < len(mine):
                    # About so many postings, and whole rows.
                    end = len(mine) if at + SUMMED >= len(mine) else int(np.searchsorted(of, of[at + SUMMED], "left"))
                    if end <= at:
                        end = int(np.searchsorted(of, of[at], "right"))
                    rows, first = np.unique(of[at:end], return_index=True)
                    sums = np.add.reduceat(table[word[at:end]] * weight[at:end, None], first, axis=0)
                    i, j, more = take(sums, sizes[rows])
                    yield pa.RecordBatch.from_arrays([queries.take(pa.array(j)), ids.take(pa.array(rows[i])), pa.array(sums[i, j]), *map(pa.array, more)], names=["query", "id", "score", *[c.split()[0] for c in extra.split(", ") if c]])
                    at = end

        return lists.mapInArrow(run, f"query {kinds[0]}, id {kinds[1]}, score double" + (extra and f", {extra}"))

    out = passed(0)
    for block in range(1, n):
        out = out.unionByName(passed(block))
    return out


def fulltext(index: DataFrame, queries: DataFrame, n: int, k: int, stems: tuple = PLAIN_WORDS) -> DataFrame:
    """``fulltext_lists`` over an index of (id, term, weight)."""
    return fulltext_lists(index.groupBy("id").agg(F.collect_list(F.struct("term", "weight")).alias("postings")), queries, n, k, stems)


def fulltext_lists(lists: DataFrame, queries: DataFrame, n: int, k: int, stems: tuple = PLAIN_WORDS) -> DataFrame:
    """Top k by the sum of weight times log(1 + n / df), over (id, postings). Queries are (query, text). Exact.

    Only how many rows hold a term is shuffled, and what may be among the best: a task leaves out a row where it has met k rows
    of higher scores before.
    """
    lists = written(lists, "terms")
    asked = written(queries.select("query", F.explode(terms(F.col("text"), stems)).alias("term")).distinct(), "words")
    df = lists.select(F.explode("postings.term").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    adds = asked.join(df, "term").withColumn("adds", F.log(1 + F.lit(float(n)) / F.col("df")))

    def chosen(table):
        best = np.zeros((k, table.shape[1]))

        def take(sums, _):
            nonlocal best
            best = np.partition(np.concatenate([best, sums]), -k, axis=0)[-k:]
            # Scores that are equal once rounded are in order of the id.
            i, j = np.nonzero((sums > 0) & (sums >= best[0] - 1e-5))
            return i, j, ()

        return take

    return top(_met(lists, adds, chosen).select("query", "id", F.round("score", 6).alias("score")), k)


#: Titles of a block, and of a tile of the matrix that is held at once; steps of size within ``least``, block pairs that are dealt apart.
BLOCK_TITLES, TILE, SIZE_STEPS, DEALT_PAIRS = 4096, 1024, 4, 4096
#: Places of the characters of normal forms: a trigram is one of 37 ** 3 numbers.
LETTERS = np.zeros(256, np.uint32)
LETTERS[list(b" 0123456789abcdefghijklmnopqrstuvwxyz")] = np.arange(37)


def _numbers(joined: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that are trigrams side by side: the trigrams' numbers, the row of each, and how many each row has."""
    sizes = pc.binary_length(joined).to_numpy(zero_copy_only=False).astype(np.int64) // 3
    letters = LETTERS[np.frombuffer("".join(joined.to_pylist()).encode("ascii"), np.uint8)].reshape(-1, 3)
    return (letters[:, 0] * 37 + letters[:, 1]) * 37 + letters[:, 2], np.repeat(np.arange(len(sizes)), sizes), sizes


def _tiles(joined: pa.Array, dims: int):
    """Tiles of texts: first row, sizes, how many trigrams fall on each of ``dims`` places, and all trigrams as bits."""
    for first in range(0, len(joined), TILE):
        number, row, sizes = _numbers(joined.slice(first, TILE))
        place = (number * np.uint32(2654435761)) >> np.uint32(32 - dims.bit_length() + 1)
        counts = np.bincount(row * dims + place, minlength=len(sizes) * dims).reshape(-1, dims).astype(np.float32)
        bits = np.zeros((len(sizes), 37**3 // 8 + 1), np.uint8)
        np.bitwise_or.at(bits, (row, number >> 3), np.uint8(1) << (number & 7).astype(np.uint8))
        yield first, sizes, counts, bits


def _shared(held: pa.Array, asked: pa.Array, least: float, same: bool):
    """(row, row, shared trigrams) of all pairs of two blocks whose similarity can be ``least`` or is about it.

    Trigrams that fall on one place count as shared in the product of a tile, so that it is never less than what is shared; of the
    pairs that it leaves, bits give the exact number. A block meets itself above the diagonal only.
    """
    most = int(max(pc.max(pc.binary_length(x)).as_py() for x in (held, asked))) // 3
    dims = min(8192, max(512, 1 << (4 * most).bit_length()))
    others = list(_tiles(asked, dims))
    for i, m, x, p in _tiles(held, dims):
        for j, n, y, q in others:
            if same and j < i:
                continue
            need = (m[:, None] + n[None, :]) * (least / (1 + least)) - 1e-3
            row, at = np.nonzero(x @ y.T >= need)
            if same and i == j:
                row, at = row[row < at], at[row < at]
            for k in range(0, len(row), TILE):
                r, c = row[k : k + TILE], at[k : k + TILE]
                both = np.bitwise_count(p[r] & q[c]).sum(1, dtype=np.int64)
                near = both >= need[r, c]
                yield i + r[near], j + c[near], both[near]


def alike_titles(titles: DataFrame, least: float) -> DataFrame:
    """D-05. (a, b, similarity) of the pairs a < b of (id, title) whose trigram similarity is ``least`` or more.

    Trigrams are too few for a join by the rarest ones to tell titles apart: long titles share some with most others. Titles stand
    in bands of size instead, dealt into blocks by the hash of the id; blocks of bands that can be alike meet once, in a task of
    bounded memory. The work is quadratic in the titles, a few hundred to a few thousand multiplications a pair.
    """
    spark = titles.sparkSession
    ship(spark)
    step = -math.log(least) / SIZE_STEPS
    t = titles.select("id", trigrams(F.col("title")).alias("g")).filter(F.size("g") > 0)
    t = written(t.select("id", F.array_join("g", "").alias("s"), F.floor(F.log(F.size("g").cast("double")) / step).alias("band")), "grams")
    many = t.groupBy("band").agg(F.ceil(F.count("*") / BLOCK_TITLES).alias("_n"))
    blocks = t.join(F.broadcast(many), "band").groupBy("band", F.pmod(F.xxhash64("id"), F.col("_n")).alias("block")).agg(F.collect_list(F.struct("id", "s")).alias("held"))
    blocks = written(blocks, "blocks")
    key = lambda n: blocks.select(F.col("band").alias(f"{n}_band"), F.col("block").alias(f"{n}_block"))
    met = (F.col("b_band") > F.col("a_band")) & (F.col("b_band") <= F.col("a_band") + SIZE_STEPS + 1) | (F.col("b_band") == F.col("a_band")) & (F.col("a_block") <= F.col("b_block"))
    pairs = written(key("a").join(key("b"), met).withColumn("pair", F.xxhash64("a_band", "a_block", "b_band", "b_block")), "pairs")
    n = max(1, min(DEALT_PAIRS, pairs.count()))

    def dealt(side: str, name: str) -> DataFrame:
        on = [F.col("band") == F.col(f"{side}_band"), F.col("block") == F.col(f"{side}_block")]
        same = (F.struct("a_band", "a_block") == F.struct("b_band", "b_block")).alias("same")
        return blocks.join(F.broadcast(pairs), on).select("pair", F.col("held").alias(name), same).repartition(n, "pair")

    both = dealt("a", "held").join(dealt("b", "asked").drop("same"), "pair").select("held", "asked", "same")
    kind = t.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for held, asked, same in zip(batch.column("held"), batch.column("asked"), batch.column("same").to_pylist(), strict=True):
                (ids, s), (others, u) = ((x.values.field("id"), x.values.field("s")) for x in (held, asked))
                for row, at, shared in _shared(s, u, least, same):
                    sizes = [pc.divide(pc.binary_length(x.take(pa.array(i))), 3).cast(pa.int64()) for x, i in ((s, row), (u, at))]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), others.take(pa.array(at)), pa.array(shared), *sizes], names=["x", "y", "o", "m", "n"])

    found = both.mapInArrow(run, f"x {kind}, y {kind}, o long, m long, n long")
    found = found.withColumn("s", F.col("o") / (F.col("m") + F.col("n") - F.col("o"))).filter((F.col("s") >= least) & (F.col("x") != F.col("y")))
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.round("s", 6).alias("similarity"))


def trigram_search(rows: DataFrame, queries: DataFrame, k: int, least: float = 0.3) -> DataFrame:
    """X-02. Top k titles by trigram similarity: trigrams of the queries come to the titles, which count what they share."""
    pieces = lambda c: F.transform(trigrams(F.col(c)), lambda x: F.struct(x.alias("term"), F.lit(1.0).alias("weight")))
    q = written(queries.select("query", trigrams(F.col("text")).alias("qg")), "asked")
    asked = q.select("query", F.explode("qg").alias("term"), F.lit(1.0).alias("adds"))
    sizes = q.select("query", F.size("qg").cast("long").alias("qn"))

    def chosen(table):
        asked = table.sum(0)

        def take(sums, n):
            i, j = np.nonzero(sums >= (n[:, None] + asked - sums) * (least - 1e-5))
            return i, j, (n[i].astype(np.int64),)

        return take

    s = _met(rows.select("id", pieces("title").alias("postings")), asked, chosen, "n long").join(F.broadcast(sizes), "query")
    near = (F.col("n") >= F.lit(least) * F.col("qn")) & (F.col("qn") >= F.lit(least) * F.col("n"))
    o = F.col("score")
    s = s.filter(near).select("query", "id", F.round(o / (F.col("n") + F.col("qn") - o), 6).alias("score")).filter(F.col("score") >= least)
    return top(s, k)


#: Vectors, and queries, of a block; query blocks that are broadcast at most.
BLOCK_VECTORS, BLOCK_QUERIES, VECTOR_BLOCKS = 4096, 1024, 64
#: Places that a score is rounded to.
PLACES = 5


def _dealt(rows: DataFrame, id: str, vector: str, most: int, name: str) -> tuple[DataFrame, int]:
    """Rows of about ``most`` vectors each, dealt by the hash of the id, and how many such rows."""
    n = max(1, math.ceil(rows.count() / most))
    return rows.groupBy(F.pmod(F.xxhash64(id), F.lit(n)).alias(f"_b{name}")).agg(F.collect_list(F.struct(F.col(id).alias("id"), F.col(vector).alias("v"))).alias(name)), n


def _by_length(v: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of the vectors that have a direction, by length: their places and their unit vectors."""
    sizes = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == n)
        x = pc.list_flatten(v.take(pa.array(at))).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, n)
        norm = np.linalg.norm(x, axis=1)
        fine = np.isfinite(norm) & (norm > 0)
        out[n] = at[fine], x[fine] / norm[fine, None]
    return out


def _blockwise(vectors: DataFrame, queries: DataFrame, chosen: Callable) -> DataFrame:
    """(query, id, score): of each block of queries and each block of vectors what ``chosen`` takes from the matrix of their
    cosines, as places (row, column), given the order of the ids. A vector or query without a direction, and lengths that
    differ, give 0. Up to VECTOR_BLOCKS blocks of queries, which bounds their bytes, are broadcast."""
    ship(vectors.sparkSession)
    asked, n = _dealt(queries, "query", "vector", BLOCK_QUERIES, "asked")
    held, _ = _dealt(vectors, "id", "embedding", BLOCK_VECTORS, "held")
    if n <= VECTOR_BLOCKS:
        pairs = held.crossJoin(F.broadcast(asked))
    else:
        pairs = held.withColumn("_basked", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))).join(asked, "_basked")
    kinds = queries.schema["query"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for held, asked in zip(batch.column("held"), batch.column("asked"), strict=True):
                ids, of = held.values.field("id"), _by_length(held.values.field("v"))
                names, by = asked.values.field("id"), _by_length(asked.values.field("v"))
                score = np.zeros((len(names), len(ids)))
                for size in of.keys() & by.keys():
                    (i, q), (j, x) = by[size], of[size]
                    score[np.ix_(i, j)] = np.clip(q @ x.T, -1, 1)
                place = np.empty(len(ids), np.int64)
                place[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
                row, at, rounded = chosen(score, place)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(row)), ids.take(pa.array(at)), pa.array(rounded)], names=["query", "id", "score"])

    return pairs.select("held", "asked").mapInArrow(run, f"query {kinds[0]}, id {kinds[1]}, score double")


def _rounded(score: np.ndarray) -> np.ndarray:
    """Halves go away from zero."""
    return np.copysign(np.floor(np.abs(score) * 10**PLACES + 0.5) / 10**PLACES, score) + 0.0


def scored_vectors(vectors: DataFrame, queries: DataFrame, least: float = -1.0) -> DataFrame:
    """(query, id, score): the cosines of every stated query with every vector that are ``least`` or more once rounded."""

    def chosen(score, _):
        row, at = np.nonzero(score >= least - 10.0**-PLACES)
        rounded = _rounded(score[row, at])
        kept = rounded >= least
        return row[kept], at[kept], rounded[kept]

    return _blockwise(vectors, queries, chosen)


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """X-03. Exact nearest neighbours by cosine of a stated query set (query, vector); of equal scores the smallest ids. A block
    gives its own ``k`` best of each query only."""

    def chosen(score, place):
        if score.shape[1] > k:
            # Whatever may be among the k best once rounded.
            row, at = np.nonzero(score >= np.partition(score, -k, axis=1)[:, -k, None] - 1.5 * 10.0**-PLACES)
        else:
            row, at = (x.ravel() for x in np.indices(score.shape))
        rounded = _rounded(score[row, at])
        order = np.lexsort((place[at], -rounded, row))
        row, at, rounded = row[order], at[order], rounded[order]
        first = np.searchsorted(row, row)  # rows are in order: where each one starts
        best = np.arange(len(row)) - first < k
        return row[best], at[best], rounded[best]

    return top(_blockwise(vectors, queries, chosen), k)


def live(notices: DataFrame, now: Column) -> DataFrame:
    """X-04. Notices whose deadline is ahead, soonest first; the filter reaches the scan."""
    return notices.filter(F.col("deadline_at") > now).orderBy("deadline_at", "notice_id")
