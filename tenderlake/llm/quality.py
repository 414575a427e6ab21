"""Quality rules with cross-document line frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, WS, durable, table, words_of

MIN_WORDS = 20
WINDOW = 8
REPEAT_PERCENT = 30
#: A line in more than so many distinct documents of a host is boilerplate there.
MAX_DOCS = 100
#: A document that keeps fewer than this share of its words is depleted.
MIN_LEFT_PERCENT = 50


def _repeated(words, n, window: int):
    """Words covered by windows of ``window`` words that occur twice or more, in O(n log n) of one text.

    Windows are hashed; only a text with a repeated hash sorts them with their places, and the union of the places'
    intervals is summed from the gaps between neighbours.
    """
    spans = F.when(n >= window, F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(F.slice(words, i + 1, F.lit(window)))))

    def covered(hashes):
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(p):
            last = F.size(p) - 1
            twice = F.filter(p, lambda x, j: ((j > 0) & (F.get(p, j - 1)["h"] == x["h"])) | ((j < last) & (F.get(p, j + 1)["h"] == x["h"])))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        def total(at):
            gaps = F.transform(at, lambda x, j: F.coalesce(F.least(F.get(at, j + 1) - x, F.lit(window)), F.lit(window)))
            return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

        return F.get(F.transform(F.transform(F.array(pairs), places), total), F.lit(0))

    return spans, lambda hashes: F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered(hashes)).otherwise(F.lit(0))


def base_rules(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    A null or empty text has no words and fails. Rows are neither merged nor dropped; an empty table gives no rows.
    """
    d = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    d = d.withColumn("_w", words_of(F.col("_t"))).withColumn("_n", F.size("_w"))
    spans, repeated = _repeated(F.col("_w"), F.col("_n"), WINDOW)
    d = d.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)))
    d = d.select(
        *keep,
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        spans.alias("_h"),
    )
    # As generated columns, the results are computed once: no predicate on them is pushed into their expressions.
    counts = [F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")]
    repeats = F.coalesce(repeated(F.col("_h")), F.lit(0)).cast("long").alias("n_repeat_words")
    d = d.select(*keep, F.inline(F.array(F.struct(*counts, repeats))))
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def _key(host, text):
    """Two hashes of a text and its host: equal texts of a host are one document when documents are counted."""
    t = F.coalesce(text, F.lit(""))
    return F.xxhash64(host, t).alias("_k1"), F.xxhash64(t, F.lit(7), host).alias("_k2")


def _normal(line):
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), WS + "+", " "), "[0-9]", "0"))


def line_verdicts(docs: DataFrame, *, text: str = "text", host: str = "source", max_docs: int = MAX_DOCS, min_left_percent: int = MIN_LEFT_PERCENT, name_removed: bool = False) -> DataFrame:
    """A row for each distinct (host, text), by the hashes of ``_key``: line_words, removed_words and depleted; if
    ``name_removed``, also ``removed``, the hashes of the normalised lines to remove.

    Lines are normalised (lower case, runs of white space to one blank, digits to 0, ends trimmed) and hashed. A line's
    distinct documents are counted within its host; equal texts of a host are one document. Words of lines above
    ``max_docs`` are removed; a document left with less than ``min_left_percent`` of its words is depleted. A null host
    is a host of its own.
    """
    d = docs.select(*_key(F.col(host), F.col(text)), F.coalesce(F.xxhash64(F.col(host), F.lit("host")), F.lit(0)).alias("_host"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD))

    def shaped(x):
        norm = _normal(x)
        return F.struct(F.md5(norm).alias("line"), F.size(F.split(norm, " ")).alias("words"))

    d = d.select("_k1", "_k2", "_host", F.transform(lines, shaped).alias("_lines"))
    d = d.groupBy("_k1", "_k2").agg(F.min(F.struct("_host", "_lines")).alias("_d")).select("_k1", "_k2", "_d.*")
    each = d.select("_k1", "_k2", "_host", F.explode("_lines").alias("_l")).groupBy("_k1", "_k2", "_host", "_l.line").agg(F.sum("_l.words").alias("words"))
    counted = each.groupBy("_host", "line").agg(F.count("*").alias("docs"))
    common = counted.filter(F.col("docs") > max_docs).select(F.col("_host").alias("_h"), F.col("line").alias("_line"))
    # Frequent lines are the hot keys of this join: each is dealt over 32 salts.
    salted = common.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
    each = each.withColumn("_s", F.pmod(F.col("_k1"), F.lit(32)).cast("int"))
    each = each.join(salted, (each["_host"] == salted["_h"]) & (each["line"] == salted["_line"]) & (each["_s"] == salted["_salt"]), "left")
    removed = [F.collect_list("_line").alias("removed")] if name_removed else []
    out = each.groupBy("_k1", "_k2").agg(F.sum("words").alias("line_words"), F.sum(F.when(F.col("_line").isNotNull(), F.col("words")).otherwise(0)).alias("removed_words"), *removed)
    return out.withColumn("depleted", 100 * (F.col("line_words") - F.col("removed_words")) < min_left_percent * F.col("line_words"))


def quality(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text", host: str = "source", **limits) -> DataFrame:
    """Base rules of every row, line_words, removed_words and ``kept``: false if a base rule fails or lines deplete it.

    Null, empty and blank texts fail the base rule; rows with null or repeated ids each keep their own result; repeated
    rows count once among the documents of a line. A text of any length is worked on whole, as a row of its own: only
    hashes of its lines are shuffled. An empty table gives an empty one.
    """
    verdicts = line_verdicts(docs, text=text, host=host, **limits)
    rows = docs.select(*keep, *_key(F.col(host), F.col(text)), F.col(text).alias("_text"))
    rows = base_rules(rows, text="_text", keep=(*keep, "_k1", "_k2"))
    out = rows.join(verdicts, ["_k1", "_k2"], "left").drop("_k1", "_k2")
    zero = F.lit(0).cast("long")
    return out.withColumns({"line_words": F.coalesce("line_words", zero), "removed_words": F.coalesce("removed_words", zero), "kept": ~F.col("base_failed") & ~F.coalesce("depleted", F.lit(False))}).drop("depleted")


def kept_rows(docs: DataFrame, columns: tuple[str, ...], *, text: str = "text", host: str = "source", **limits) -> DataFrame:
    """``columns`` of the rows that ``quality`` keeps, the text without the lines above the limit.

    The other lines, blank ones too, stay as they are and in order. Decisions are made on keys and on whole texts; texts
    are shuffled once.
    """
    keyed = docs.select(*_key(F.col(host), F.col(text)), F.col(text).alias("_text"))
    base = base_rules(keyed, text="_text", keep=("_k1", "_k2")).join(line_verdicts(docs, text=text, host=host, name_removed=True, **limits), ["_k1", "_k2"], "left")
    kept = base.filter(~F.col("base_failed") & ~F.coalesce("depleted", F.lit(False)))
    kept = kept.groupBy("_k1", "_k2").agg(F.first("removed").alias("_removed"))
    rows = docs.select(*columns, *_key(F.col(host), F.col(text))).join(durable(kept, "kept"), ["_k1", "_k2"])
    left = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("_removed", F.md5(_normal(x))))
    cleaned = F.when(F.size("_removed") > 0, F.array_join(left, "\n")).otherwise(F.col(text)).alias(text)
    return rows.select(*[cleaned if c == text else F.col(c) for c in columns])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
win AS (SELECT rid, i, w[i:i+7] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(0, 8) AS r(k) GROUP BY rid),
ln AS (SELECT rid, source, t, unnest(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS l FROM d),
dup AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM ln GROUP BY rid),
norm AS (SELECT rid, source, t, md5(nl) AS line, len(string_split(nl, ' ')) AS words
         FROM (SELECT *, trim(regexp_replace(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g'), ' ') AS nl FROM ln)),
doc_line AS (SELECT source, t, line, sum(words) / count(DISTINCT rid) AS words FROM norm GROUP BY source, t, line),
common AS (SELECT source, line FROM norm GROUP BY source, line HAVING count(DISTINCT t) > 100),
cut AS (SELECT x.source, x.t, sum(words) AS line_words, sum(CASE WHEN c.line IS NOT NULL THEN words ELSE 0 END) AS removed_words
        FROM doc_line x LEFT JOIN common c ON x.line = c.line AND x.source IS NOT DISTINCT FROM c.source GROUP BY x.source, x.t),
base AS (
  SELECT d.rid, d.doc_id, d.source, d.t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       CAST(coalesce(line_words, 0) AS BIGINT) AS line_words, CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words,
       NOT base_failed AND NOT coalesce(100 * (line_words - removed_words) < 50 * line_words, false) AS kept
FROM v LEFT JOIN cut ON v.t = cut.t AND v.source IS NOT DISTINCT FROM cut.source
"""
