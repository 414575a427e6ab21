"""Pages, citations, extraction metrics and mined links."""

from __future__ import annotations

import html
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapsed
from ..shipping import ship

OCR_LEAST, WINDOW_CHARS, QUOTE_MOST = 40, 60_000, 120
GATES = {"requirement_recall": 0.90, "eliminatory_recall": 0.95, "requirement_precision": 0.85, "admin_exact_match": 0.95, "citation_validity": 0.98}
LINKS_MOST, URL_MOST, BODY_MOST = 25, 2048, 512 * 1024
LABEL_LEAST, LABEL_MOST = 12, 200
# Hosts and path pieces of links that belong to a mail's furniture.
SOCIAL_HOSTS = ("twitter.com", "x.com", "linkedin.com", "facebook.com", "instagram.com", "youtube.com")
BOILERPLATE = (
    "unsubscribe", "desinscri", "se-desabonner", "desabonnement", "optout", "opt-out", "preferences", "email-preferences", "manage-subscription", "gerer-abonnement", "mentions-legales",
    "politique-de-confidentialite", "privacy-policy", "/cgu", "/cgv", "view-online", "view-in-browser", "voir-en-ligne", "web-version", "webversion", "/newsletter/",
)
HREF, BARE = r"""(?i)href=["']([^"']+)["']""", r"""(?i)(https?://[^\s<>"'\]\)]+)"""
ANCHOR = r"""(?is)<a\b[^>]*\bhref=["']([^"']+)["'][^>]*>(.*?)</a>"""
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#039;": "'", "&nbsp;": " ", "&amp;": "&"}


def clean_page(c: Column) -> Column:
    """P-01. Unix line ends, single blanks, trimmed lines, at most one empty line in a row, trimmed."""
    c = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "[ \t ]+", " ")
    c = F.regexp_replace(c, "(?m)^ | $", "")
    return F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def needs_ocr(c: Column) -> Column:
    """P-02."""
    return F.length(F.regexp_replace(c, r"^\s+|\s+$", "")) < OCR_LEAST


def summaries(pages: DataFrame) -> DataFrame:
    """P-03."""
    ocr = needs_ocr(F.col("text"))
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.array_sort(F.collect_list(F.when(ocr, F.col("page")))).alias("ocr_pages"), F.round(F.count_if(~ocr) / F.count("*"), 4).alias("text_coverage"), F.bool_or(ocr).alias("needs_ocr"))


def marked_text(pages: DataFrame) -> DataFrame:
    """P-04. Each document's pages under their markers. Documents are of bounded length."""
    part = lambda x: F.concat(F.lit("[[page:"), x["page"].cast("string"), F.lit("]]\n"), F.coalesce(x["text"], F.lit("")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), part), "\n\n").alias("marked"))


def page_markers(c: Column) -> Column:
    """P-07."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\[\[page:(\d+)\]\]"), F.lit(1)), lambda x: x.cast("int"))


def page_windows(pages: DataFrame, most: int = WINDOW_CHARS) -> DataFrame:
    """P-05. (doc_id, page, window): pages packed in order; a window is begun when the next page doesn't fit.

    Where windows begin depends on all pages before, so a document's page numbers and costs are walked through in order; the
    state is the window and what is used of it, and the texts stay where they are.
    """
    if most <= 0:
        raise ValueError("most must be positive")
    ship(pages.sparkSession)
    cost = F.coalesce(F.length("text"), F.lit(0)) + F.length(F.concat(F.lit("[[page:"), F.col("page").cast("string"), F.lit("]]"))) + 2
    sized = pages.select("doc_id", "page", cost.alias("cost"))
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = sized.repartition(n, "doc_id").sortWithinPartitions("doc_id", "page")

    def pack(frames):
        last, used, window = object(), 0, 0
        for frame in frames:
            out = []
            for doc, c in zip(frame["doc_id"].tolist(), frame["cost"].tolist(), strict=True):
                if doc != last:
                    last, used, window = doc, c, 0
                elif used + c <= most:
                    used += c
                else:
                    used, window = c, window + 1
                out.append(window)
            yield frame[["doc_id", "page"]].assign(window=pd.Series(out, dtype="int32", index=frame.index))

    kinds = {f.name: f.dataType.simpleString() for f in sized.schema}
    return sorted_.mapInPandas(pack, f"doc_id {kinds['doc_id']}, page {kinds['page']}, window int")


def check_citations(quotes: DataFrame, pages: DataFrame, tolerance: int = 0) -> DataFrame:
    """P-06, E-05. (quote_id, valid) of quotes (quote_id, doc_id, page, quote): whether the quote, without regard to case and
    white space, is on its page, or at most ``tolerance`` pages away.

    A quote that is null or empty, or names no page, isn't a citation and has no row; a blank one is invalid. Pages meet
    their quotes in an equi-join of document and page number.
    """
    cited = quotes.filter((F.col("quote") != "") & F.col("page").isNotNull())
    asked = cited.select("quote_id", "doc_id", collapsed(F.col("quote")).alias("_quote"), F.explode(F.sequence(F.col("page") - tolerance, F.col("page") + tolerance)).alias("_page"))
    texts = pages.select(F.col("doc_id").alias("_doc"), F.col("page").alias("_at"), collapsed(F.col("text")).alias("_text")).filter("_at >= 1")
    found = asked.join(texts, (F.col("doc_id") == F.col("_doc")) & (F.col("_page") == F.col("_at")), "left")
    hit = (F.col("_quote") != "") & F.coalesce(F.contains(F.col("_text"), F.col("_quote")), F.lit(False))
    return found.groupBy("quote_id").agg(F.bool_or(hit).alias("valid"))


def _word_runs(c: Column, k: int, every: bool) -> Column:
    """Hashes of the runs of k whole words of a text; unless ``every``, of one: the least."""
    pairs = lambda w: F.transform(F.slice(w, F.lit(1), F.size(w) - k + 1), lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, k)]))
    # In a lambda the words are bound once, not split again for every run.
    runs = F.get(F.transform(F.array(F.split(c, " ")), lambda w: F.when(F.size(w) >= k, pairs(w))), F.lit(0))
    return F.array_distinct(runs) if every else F.array(F.array_min(runs))


def find_quotes(quotes: DataFrame, texts: DataFrame, words: int = 4) -> DataFrame:
    """P-06 without a page. (quote_id, valid, doc_id): the smallest id of a text that holds the whole quote, but for case
    and white space.

    A text that holds a quote holds the words between its first and last one. Candidates share one run of ``words`` such
    words, the one of least hash, in an equi-join; ``contains`` decides. Quotes with fewer words meet texts by their first
    three letters.
    """
    q = quotes.select("quote_id", collapsed(F.col("quote")).alias("_q")).filter("_q <> ''").distinct()
    inner = F.array_join(F.slice(F.split("_q", " "), 2, F.greatest(F.size(F.split("_q", " ")) - 2, F.lit(0))), " ")
    q = q.withColumn("_in", inner)
    long = q.filter(F.size(F.split("_in", " ")) >= words).select("quote_id", "_q", F.explode(_word_runs(F.col("_in"), words, False)).alias("_k"))
    t = texts.select(F.col("doc_id").alias("_doc"), collapsed(F.col("text")).alias("_t"))
    keyed = t.select("_doc", F.explode(_word_runs(F.col("_t"), words, True)).alias("_k")).join(long.select("_k").distinct(), "_k", "left_semi")
    pairs = keyed.join(long, "_k").select("_doc", "quote_id", "_q").distinct()
    short = q.filter(F.size(F.split("_in", " ")) < words).select("quote_id", "_q")
    if not short.isEmpty():
        pieces = lambda c: F.get(F.transform(F.array(F.split(c, "")), lambda x: F.array_distinct(F.transform(x, lambda v, i: F.concat(v, F.coalesce(F.get(x, i + 1), F.lit("")), F.coalesce(F.get(x, i + 2), F.lit("")))))), F.lit(0))
        first = short.select("quote_id", "_q", F.substring("_q", 1, 3).alias("_k"))
        near = t.select("_doc", F.explode(pieces(F.col("_t"))).alias("_k"))
        # A text's last pieces are shorter; a quote of one or two letters is the start of a piece.
        starts = near.select("_doc", F.explode(F.array_distinct(F.array("_k", F.substring("_k", 1, 2), F.substring("_k", 1, 1)))).alias("_k")).join(first.select("_k").distinct(), "_k", "left_semi").distinct()
        pairs = pairs.unionByName(starts.join(first, "_k").select("_doc", "quote_id", "_q"))
    hits = pairs.join(t, "_doc").filter(F.contains("_t", F.col("_q"))).groupBy("quote_id").agg(F.min("_doc").alias("doc_id"))
    return quotes.select("quote_id").distinct().join(hits, "quote_id", "left").select("quote_id", F.col("doc_id").isNotNull().alias("valid"), "doc_id")


def case_metrics(items: DataFrame) -> DataFrame:
    """E-03. Rows (case, metric, matched, total) from items (case, gold, predicted, gold_type, predicted_type)."""
    gold, pred = F.col("gold"), F.col("predicted")
    elim = gold & (F.col("gold_type") == "eliminatory")
    counts = items.groupBy("case").agg(F.count_if(gold & pred).alias("m"), F.count_if(gold).alias("g"), F.count_if(pred).alias("p"), F.count_if(elim).alias("e"), F.count_if(elim & pred & (F.col("predicted_type") == "eliminatory")).alias("f"))
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(a).alias("matched"), F.col(b).alias("total")) for n, a, b in (("requirement_recall", "m", "g"), ("requirement_precision", "m", "p"), ("eliminatory_recall", "f", "e"))])
    return counts.select("case", F.inline(rows))


def pooled(metrics: DataFrame) -> DataFrame:
    """E-06, E-07. Items are pooled over cases; with none, the value is 1. passed: at least the gate."""
    gate = F.coalesce(*[F.when(F.col("metric") == k, F.lit(v)) for k, v in GATES.items()], F.lit(0.0))
    out = metrics.groupBy("metric").agg(F.sum("matched").alias("matched"), F.sum("total").alias("total"))
    value = F.when(F.col("total") > 0, F.col("matched") / F.col("total")).otherwise(F.lit(1.0))
    return out.withColumns({"value": F.round(value, 6), "gate": gate}).withColumn("passed", value >= F.col("gate"))


def admin_matches(rows: DataFrame) -> DataFrame:
    """E-04. Long rows (case, field, kind, expected, actual): counts of fields that gold asserts and of those that agree."""
    same = F.when(F.col("kind") == "list", F.size(F.from_json("expected", "array<string>")) == F.size(F.from_json("actual", "array<string>"))).otherwise(collapsed(F.col("expected")) == collapsed(F.coalesce("actual", F.lit(""))))
    return rows.filter("expected is not null").groupBy("case").agg(F.count_if(same).alias("matched"), F.count("*").alias("total"))


MATCH_LEAST = 0.6


#: Cells of a table of texts by characters that is worked on at once.
CELLS = 1 << 20


def _padded(texts: list[str], fill: int) -> np.ndarray:
    out = np.full((len(texts), max(map(len, texts), default=0) + 1), fill, np.int32)
    for row, t in zip(out, texts, strict=True):
        row[: len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    return out


def matching_ratio(left: list[str], right: list[str]) -> np.ndarray:
    """Of each pair of texts: twice the characters in matching blocks over both lengths; 1 for two empty texts.

    The longest block that both have comes first (the earliest in the left text, then in the right one), then those before
    and after it. In a right text of 200 characters or more, a character of over a hundredth of it (and one) starts no
    block, but may lengthen one. All pairs of a batch go step by step together: a row per pair and open window, of which
    the lengths of common runs are carried from each left character to the next.
    """
    out = np.ones(len(left))
    order = sorted(range(len(left)), key=lambda i: (len(right[i]), len(left[i])))
    at = 0
    while at < len(order):
        many = max(1, CELLS // (max(len(right[order[min(at + CELLS // 64, len(order) - 1)]]), len(right[order[at]])) + 1))
        part = order[at : at + many]
        at += len(part)
        lengths = np.array([len(left[i]) + len(right[i]) for i in part])
        found = _matched([left[i] for i in part], [right[i] for i in part])
        out[part] = np.where(lengths > 0, 2.0 * found / np.maximum(lengths, 1), 1.0)
    return out


def _matched(left: list[str], right: list[str]) -> np.ndarray:
    """Characters in matching blocks of each pair."""
    a, b = _padded(left, -1), _padded(right, -2)
    seeds = b.copy()
    for row, t in zip(seeds, right, strict=True):
        if len(t) >= 200:
            codes, n = np.unique(row[: len(t)], return_counts=True)
            row[np.isin(row, codes[n > len(t) // 100 + 1])] = -3
    total = np.zeros(len(left), np.int64)
    pair = np.arange(len(left))
    a0, a1, b0, b1 = np.zeros(len(left), int), np.array(list(map(len, left)), int), np.zeros(len(left), int), np.array(list(map(len, right)), int)
    while True:
        open_ = (a0 < a1) & (b0 < b1)
        pair, a0, a1, b0, b1 = pair[open_], a0[open_], a1[open_], b0[open_], b1[open_]
        if not len(pair):
            return total
        columns = b0[:, None] + np.arange((b1 - b0).max())
        window = np.where(columns < b1[:, None], seeds[pair[:, None], np.minimum(columns, b.shape[1] - 1)], -2)
        runs = np.zeros_like(window)
        size, start_a, start_b, every = np.zeros(len(pair), int), a0.copy(), b0.copy(), np.arange(len(pair))
        for i in range((a1 - a0).max()):
            now = np.where(a0 + i < a1, a[pair, np.minimum(a0 + i, a.shape[1] - 1)], -1)
            longer = np.zeros_like(runs)
            longer[:, 1:] = runs[:, :-1]
            runs = np.where(window == now[:, None], longer + 1, 0)
            j = runs.argmax(1)
            k = runs[every, j]
            better = k > size
            size = np.where(better, k, size)
            start_a, start_b = np.where(better, a0 + i - k + 1, start_a), np.where(better, b0 + j - k + 1, start_b)
        while (more := (start_a > a0) & (start_b > b0) & (a[pair, start_a - 1] == b[pair, start_b - 1])).any():
            start_a, start_b, size = start_a - more, start_b - more, size + more
        while (more := (start_a + size < a1) & (start_b + size < b1) & (a[pair, np.minimum(start_a + size, a.shape[1] - 1)] == b[pair, np.minimum(start_b + size, b.shape[1] - 1)])).any():
            size = size + more
        np.add.at(total, pair, size)
        hit = size > 0
        pair, size, start_a, start_b, a0, a1, b0, b1 = (x[hit] for x in (pair, size, start_a, start_b, a0, a1, b0, b1))
        pair, a0, a1, b0, b1 = (np.concatenate(x) for x in ((pair, pair), (a0, start_a + size), (start_a, a1), (b0, start_b + size), (start_b, b1)))


@F.pandas_udf(T.DoubleType())
def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(matching_ratio(left.tolist(), right.tolist()), dtype="float64")


def text_similarity(left: str | Column, right: str | Column) -> Column:
    """E-01. Ratio of the matching blocks of two texts, but for case and white space; null counts as empty."""
    text = lambda c: collapsed(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    return _ratio(text(left), text(right))


def scored_pairs(predicted: DataFrame, gold: DataFrame, least: float = MATCH_LEAST) -> DataFrame:
    """(case, p, g, score) of predictions and gold items (case, idx, text) of a case that are alike enough.

    The ratio is at most twice the shorter over both lengths, and at most twice the characters in common, counted as a
    multiset, over both lengths. Items of a case meet by bands of length; the two bounds come before the ratio itself.
    A text that lies whole within the other matches whole, also where the ratio's rule for frequent characters of long
    texts starts its blocks elsewhere.
    """
    ship(predicted.sparkSession)
    grow = math.log((2 - least) / least)  # lengths of a pair differ by this factor at most
    size = lambda c: F.length(collapsed(F.coalesce(c, F.lit(""))))
    band = lambda c: F.floor(F.log(F.greatest(size(c), F.lit(1))) / grow).cast("int")
    letters = lambda c: F.transform(F.array(*[F.lit(x) for x in "abcdefghijklmnopqrstuvwxyz0123456789 "]), lambda x: F.length(collapsed(F.coalesce(c, F.lit("")))) - F.length(F.replace(collapsed(F.coalesce(c, F.lit(""))), x, F.lit(""))))
    a = predicted.select("case", F.col("idx").alias("p"), F.col("text").alias("_a"), size(F.col("text")).alias("_m"), letters(F.col("text")).alias("_x"), F.explode(F.array(*[band(F.col("text")) + i for i in (-1, 0, 1)])).alias("_band"))
    b = gold.select("case", F.col("idx").alias("g"), F.col("text").alias("_b"), size(F.col("text")).alias("_n"), letters(F.col("text")).alias("_y"), band(F.col("text")).alias("_band"))
    pairs = a.join(b, ["case", "_band"])
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, v: s + v)
    common = total(F.zip_with("_x", "_y", lambda x, y: F.least(x, y))) + F.least(F.col("_m") - total(F.col("_x")), F.col("_n") - total(F.col("_y")))
    both = F.col("_m") + F.col("_n")
    near = (2 * F.least("_m", "_n") >= least * both) & (2 * common >= least * both)
    whole = lambda c: collapsed(F.coalesce(c, F.lit("")))
    held = (both > 0) & (F.contains(whole(F.col("_a")), whole(F.col("_b"))) | F.contains(whole(F.col("_b")), whole(F.col("_a"))))
    score = F.greatest(text_similarity("_a", "_b"), F.when(held, F.lit(2.0) * F.least("_m", "_n") / both).otherwise(F.lit(0.0)))
    return pairs.filter(near).withColumn("score", score).filter(F.col("score") >= least).select("case", "p", "g", "score")


def two_pass_union(items: DataFrame, least: float = MATCH_LEAST) -> DataFrame:
    """E-08. Items (case, idx, text, type) of all passes: one alike an earlier kept item of its case merges into the first
    such. A merged eliminatory claim overrides, and the weaker type is kept as disputed_type. Items are numbered anew.

    Pairs that are alike come from ``scored_pairs``. In rounds an item is settled once all earlier ones like it are: it
    merges into the first of them that is kept, or is kept itself if none is.
    """
    from ..sources.storage import checkpointed

    own = items.select("case", "idx", "text", "type")
    near = checkpointed(scored_pairs(own, own, least).filter("g < p").select("case", "p", "g"))
    state = own.select("case", "idx").join(near.select("case", F.col("p").alias("idx")).distinct(), ["case", "idx"], "left_anti").withColumn("head", F.col("idx"))
    state, waiting = checkpointed(state), near
    while not waiting.isEmpty():
        known = waiting.join(state.select("case", F.col("idx").alias("g"), F.col("head").alias("_h")), ["case", "g"], "left")
        ready = known.groupBy("case", "p").agg(F.count_if(F.col("_h").isNull()).alias("_open"), F.min(F.when(F.col("_h") == F.col("g"), F.col("g"))).alias("_first"))
        settled = ready.filter("_open = 0").select("case", F.col("p").alias("idx"), F.coalesce("_first", "p").alias("head"))
        state = checkpointed(state.unionByName(settled))
        waiting = checkpointed(waiting.join(state.select("case", F.col("idx").alias("p")), ["case", "p"], "left_anti"))
    rows = own.join(state, ["case", "idx"])
    first = rows.filter("idx = head").select("case", "idx", "text", "type")
    claims = rows.filter("idx > head and type = 'eliminatory'").select("case", F.col("head").alias("idx"), F.lit(True).alias("_claimed")).distinct()
    out = first.join(claims, ["case", "idx"], "left").withColumn("disputed_type", F.when(F.col("_claimed") & (F.col("type") != "eliminatory"), F.col("type")))
    out = out.withColumn("type", F.when(F.col("disputed_type").isNotNull(), "eliminatory").otherwise(F.col("type")))
    number = F.row_number().over(Window.partitionBy("case").orderBy("idx"))
    return out.select("case", F.format_string("REQ-%03d", number).alias("ref"), "text", "type", "disputed_type")


def greedy_matches(pairs: DataFrame) -> DataFrame:
    """E-02. Best-first pairing of (case, p, g, score) in rounds: a pair that is the best of both its sides is taken, and
    the other pairs of these go; ties by the larger indices. Rounds end when no pair is left."""
    from ..sources.storage import checkpointed

    order = F.struct("score", "p", "g")
    left, done = checkpointed(pairs), None
    while not left.isEmpty():
        best_p, best_g = F.max(order).over(Window.partitionBy("case", "p")), F.max(order).over(Window.partitionBy("case", "g"))
        taken = checkpointed(left.withColumn("_a", best_p).withColumn("_b", best_g).filter("_a = _b").select("case", "p", "g", "score"))
        done = taken if done is None else done.unionByName(taken)
        left = checkpointed(left.join(taken.select("case", "p"), ["case", "p"], "left_anti").join(taken.select("case", "g"), ["case", "g"], "left_anti"))
    return pairs.limit(0) if done is None else done


@F.pandas_udf(T.StringType())
def _decoded(text: pd.Series) -> pd.Series:
    """HTML entities, numeric, hexadecimal or named, as characters."""
    return text.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def _settled(text: pd.Series) -> pd.Series:
    """Decoded, and once more if an & is left."""
    return text.map(lambda x: html.unescape(html.unescape(x)), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _all_decoded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda xs: [x if x is None else html.unescape(x) for x in xs], na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _all_settled(texts: pd.Series) -> pd.Series:
    return texts.map(lambda xs: [x if x is None else html.unescape(html.unescape(x)) for x in xs], na_action="ignore")


def _shipped() -> None:
    """Python workers import this module for the functions above."""
    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)


def unescaped(c: Column) -> Column:
    """N-19. Entities decoded. Spark has no function for the 2,000 names, so texts that hold an & go through Arrow."""
    _shipped()
    marked = F.contains(c, F.lit("&"))
    return F.coalesce(_decoded(F.when(marked, c)), c)


def clean_text(c: Column) -> Column:
    """N-19. Decoded, once more if an & is left, white space collapsed; blank gives null."""
    _shipped()
    settled = F.coalesce(_settled(F.when(F.contains(c, F.lit("&")), c)), c)
    return F.nullif(F.trim(F.regexp_replace(settled, r"(?U)\s+", " ")), F.lit(""))


def all_clean(c: Column) -> Column:
    """``clean_text`` of every element of an array."""
    _shipped()
    settled = F.coalesce(_all_settled(F.when(F.exists(c, lambda x: F.contains(x, F.lit("&"))), c)), c)
    return F.transform(settled, lambda x: F.nullif(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), F.lit("")))


def usable_url(decoded: Column) -> Column:
    """I-03. A decoded link without punctuation at its end; null unless http(s) and at most 2048 characters."""
    u = F.regexp_replace(F.regexp_replace(decoded, r"(?U)^\s+|\s+$", ""), r"""[.,;:!?)»"'>]+$""", "")
    return F.when((F.length(u) <= URL_MOST) & F.lower(u).rlike("^https?://"), u)


def clean_url(c: Column) -> Column:
    """I-03. Of a link as it stands in a mail."""
    return usable_url(unescaped(c))


def message_links(messages: DataFrame) -> DataFrame:
    """I-04. (message_id, pos, url) in order of first sight: text before html; within each, hrefs before bare links."""
    ship(messages.sparkSession)
    parts = [F.regexp_extract_all(F.coalesce(b, F.lit("")), F.lit(p), F.lit(1)) for b in ("text", "html") for p in (HREF, BARE)]
    rows = messages.select("message_id", F.concat(*parts).alias("_raw"))
    marked = F.exists("_raw", lambda x: F.contains(x, F.lit("&")))
    rows = rows.select("message_id", F.coalesce(_all_decoded(F.when(marked, F.col("_raw"))), "_raw").alias("_raw"))
    return rows.select("message_id", F.posexplode(F.array_distinct(F.array_compact(F.transform("_raw", usable_url)))).alias("pos", "url"))


def link_labels(messages: DataFrame) -> DataFrame:
    """I-05. The first usable anchor text of each link."""
    hrefs, inner = (F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(i)) for i in (1, 2))
    rows = messages.select("message_id", F.posexplode(F.arrays_zip(hrefs.alias("href"), inner.alias("inner"))).alias("pos", "x"))
    rows = rows.select("message_id", "pos", clean_url(F.col("x.href")).alias("url"), F.trim(F.regexp_replace(unescaped(F.regexp_replace("x.inner", "<[^>]+>", " ")), r"\s+", " ")).alias("label"))
    rows = rows.filter(F.col("url").isNotNull() & F.length("label").between(LABEL_LEAST, LABEL_MOST))
    return rows.groupBy("message_id", "url").agg(F.min_by("label", "pos").alias("label"))


def host(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(c, F.lit("HOST"))), r"^www\.", "")


def host_is(h: Column, domain: str) -> Column:
    """The host or a sub-domain: the boundary is a dot."""
    return (h == domain) | h.endswith(f".{domain}")


def is_boilerplate(url: Column) -> Column:
    """I-06."""
    hay = F.lower(F.concat(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("?"), F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))))
    social = F.lit(False)
    for d in SOCIAL_HOSTS:
        social = social | host_is(host(url), d)
    return F.coalesce(social, F.lit(False)) | F.exists(F.array(*[F.lit(p) for p in BOILERPLATE]), lambda p: F.contains(hay, p))


def recognised(url: Column) -> Column:
    """I-07. struct(source, external_id) of a link to a known source's notice, else null."""
    path = F.coalesce(F.try_url_decode(F.try_parse_url(url, F.lit("PATH"))), F.lit(""))
    query = lambda k: F.try_parse_url(url, F.lit("QUERY"), F.lit(k))
    some = lambda c: F.nullif(c, F.lit(""))
    ted = F.coalesce(some(F.regexp_extract(path, r"/notice/(?:-/detail/)?(\d{5,8}-\d{4})", 1)), query("publicationNumber"), query("publication-number"))
    boamp = F.coalesce(query("idweb"), query("id"), some(F.regexp_extract(path, r"/avis/(?:detail/)?([0-9]{2}-[0-9]+)", 1)))
    known = lambda s, i: F.when(i.isNotNull(), F.struct(F.lit(s).alias("source"), i.alias("external_id")))
    return F.when(host_is(host(url), "ted.europa.eu"), known("eu-ted", ted)).when(host_is(host(url), "boamp.fr"), known("fr-boamp", boamp))


def capped(links: DataFrame, most: int = LINKS_MOST) -> DataFrame:
    """I-09. Links with kept: false beyond the first ``most`` of a message that aren't boilerplate."""
    rows = links.withColumn("boilerplate", is_boilerplate(F.col("url")))
    w = Window.partitionBy("message_id", "boilerplate").orderBy("pos")
    return rows.withColumn("k", F.row_number().over(w)).withColumn("kept", ~F.col("boilerplate") & (F.col("k") <= most)).drop("k")


def linked_notices(links: DataFrame, notices: DataFrame) -> DataFrame:
    """I-10. Links with notice_id: the smallest id of a stored notice one of whose source_refs the link names, or null."""
    refs = notices.select("id", F.explode("source_refs").alias("_r")).groupBy(F.col("_r.source").alias("_source"), F.col("_r.external_id").alias("_external")).agg(F.min("id").alias("notice_id"))
    rows = links.withColumn("_known", recognised(F.col("url")))
    found = rows.join(refs, (F.col("_known.source") == F.col("_source")) & (F.col("_known.external_id") == F.col("_external")), "left")
    return found.drop("_known", "_source", "_external")


def titles(links: DataFrame, labels: DataFrame, messages: DataFrame) -> DataFrame:
    """I-08. The link's label, else the subject (numbered if there are several), else the host."""
    w = Window.partitionBy("message_id")
    rows = links.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy("pos")))
    rows = rows.join(labels, ["message_id", "url"], "left").join(messages.select("message_id", "subject"), "message_id", "left")
    base = F.coalesce(F.nullif(F.trim("subject"), F.lit("")), F.try_parse_url("url", F.lit("HOST")))
    return rows.withColumn("title", F.coalesce("label", F.when(F.col("_n") > 1, F.format_string("%s (%d/%d)", base, "_i", "_n")).otherwise(base))).drop("_n", "_i", "subject")


def org_tag(address: Column) -> Column:
    """I-01. The org of sources+{org}@domain, bare or in angle brackets, or null."""
    inner = F.trim(F.when(address.rlike("<[^>]+>"), F.regexp_extract(address, "<([^>]+)>", 1)).otherwise(address))
    return F.nullif(F.regexp_extract(inner, r"^(?i:sources)\+(org_[A-Za-z0-9_]+)@", 1), F.lit(""))


def resolved(messages: DataFrame, orgs: DataFrame) -> DataFrame:
    """I-02. org_id by exact tag, else by one that differs in case only; else a reason."""
    rows = messages.withColumn("_tag", org_tag(F.col("to")))
    exact = orgs.select(F.col("org_id").alias("_e"))
    loose = orgs.groupBy(F.lower("org_id").alias("_lower")).agg(F.min("org_id").alias("_l"))
    rows = rows.join(exact, F.col("_tag") == F.col("_e"), "left").join(loose, F.lower("_tag") == F.col("_lower"), "left")
    org = F.coalesce("_e", "_l")
    return rows.withColumns({"org_id": org, "rejected": F.when(F.col("_tag").isNull(), "unaddressable").when(org.isNull(), "unknown_org")}).drop("_tag", "_e", "_l", "_lower")


def new_candidates(found: DataFrame, existing: DataFrame) -> DataFrame:
    """I-11. One row for each (org, url) that isn't stored yet: the first by message and place."""
    w = Window.partitionBy("org_id", "url").orderBy("message_id", "pos")
    first = found.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
    return first.join(existing.select("org_id", "url"), ["org_id", "url"], "left_anti")


def once_per_message(messages: DataFrame) -> DataFrame:
    """I-12. A row for each message id (rows without one all stay), bodies cut at 512 Ki characters."""
    rows = messages.withColumns({c: F.substring(c, 1, BODY_MOST) for c in ("text", "html")})
    return rows.filter("message_id is not null").dropDuplicates(["message_id"]).unionByName(rows.filter("message_id is null"))
