"""Fill-in-the-middle: texts cut at two units and put in another order, with the cuts found in 64-bit words of UTF-8."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import table

SEED = "42"
#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of the rows that can be cut, so many in a hundred stay plain; of the rest, so many are suffix-first.
PLAIN_PERCENT, SPM_PERCENT = 50, 80
#: Texts are worked on together up to so many bytes; a longer text alone.
TOGETHER = 4 << 20

_EACH = np.uint64(0x0101010101010101)
_HIGH, _LOW = np.uint64(0x80) * _EACH, np.uint64(0x7F) * _EACH
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def blank_bytes(w: np.ndarray) -> np.ndarray:
    """Of each byte of the words the high bit, set where it is 0x20 or 0x09 to 0x0D. No carry leaves a byte."""
    low, off = w & _LOW, w ^ (np.uint64(0x20) * _EACH)
    space = ~(((off & _LOW) + _LOW) | off)
    control = (low + np.uint64(0x80 - 0x09) * _EACH) & ~(low + np.uint64(0x80 - 0x0E) * _EACH) & ~w
    return (space | control) & _HIGH


class Marks:
    """Marked bytes of a run of 64-bit words, with rank and select."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.upto = np.cumsum(np.bitwise_count(marks), dtype=np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bytes before each place are marked."""
        word, inner = at >> 3, (at & 7).astype(np.uint64) * np.uint64(8)
        before = np.where(word > 0, self.upto[word - 1], 0)
        return before + np.bitwise_count(self.marks[word] & ~(_ALL << inner))

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th marked byte, from 1: the word by its cumulative count, then the byte within it."""
        word = np.searchsorted(self.upto, k)
        left = (k - np.where(word > 0, self.upto[word - 1], 0)).astype(np.uint64)
        counts = (self.marks[word] >> np.uint64(7)) * _EACH  # in each byte: the marks up to it
        reached = ((counts | _HIGH) - left * _EACH) & _HIGH
        return word * 8 + (8 - np.bitwise_count(reached).astype(np.int64))


def unit_marks(data: np.ndarray, starts: np.ndarray) -> tuple[Marks, Marks]:
    """Of texts that lie one after another (``starts`` has one more, the end): the last bytes of units, the first bytes of code points.

    A unit is white space and the word after it, or the white space at a text's end. It ends where a word's byte has white
    space after it, and at its text's last byte.
    """
    words = np.zeros(len(data) // 8 + 2, np.uint64)
    words.view(np.uint8)[: len(data)] = data
    blank = blank_bytes(words)
    after = blank >> np.uint64(8)
    after[:-1] |= blank[1:] << np.uint64(56)
    ends = ~blank & after & _HIGH
    last = starts[1:][starts[1:] > starts[:-1]] - 1
    np.bitwise_or.at(ends, last >> 3, np.uint64(0x80) << ((last & 7).astype(np.uint64) * np.uint64(8)))
    following = words & ~(words << np.uint64(1)) & _HIGH
    return Marks(ends), Marks(~following & _HIGH)


def cut(data: np.ndarray, starts: np.ndarray, first: np.ndarray, second: np.ndarray):
    """Units of each text, the byte places of its two cuts, and the code points of prefix and middle."""
    ends, points = unit_marks(data, starts)
    base = ends.rank(starts[:-1])
    n = ends.rank(starts[1:]) - base
    a, b = first % (n + 1), second % (n + 1)
    place = lambda k: np.where(k > 0, ends.select(base + np.maximum(k, np.minimum(n, 1))) + 1, starts[:-1])
    p, m = place(np.minimum(a, b)), place(np.maximum(a, b))
    q = points.rank(p)
    return n, p, m, q - points.rank(starts[:-1]), points.rank(m) - q


def _draw(doc_id: Column, seed: str) -> list[Column]:
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", seed: str = SEED, marks=MARKS, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """A row per row of ``docs``: doc_id, n (units), form (plain, spm or psm), prefix_chars, middle_chars, output.

    All draws come from a hash of seed and id, so that a rerun agrees. A null or empty text, and a text that holds a mark,
    is plain: its output is the text, its counts of characters null. A null id counts as an empty one; repeated ids have
    equal draws; an empty table gives no rows. Texts of any length are cut whole; no shuffle.
    """
    ship(docs.sparkSession)
    t = F.coalesce(F.col(text), F.lit(""))
    h = _draw(F.col(doc_id), seed)
    held = F.lit(False)
    for m in marks:
        held = held | F.contains(t, F.lit(m))
    form = F.when((t == "") | held | (h[2] % 100 >= plain_percent), "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    rows = docs.select(F.col(doc_id).alias("doc_id"), t.alias("text"), h[0].alias("h1"), h[1].alias("h2"), form.alias("form"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    p_mark, s_mark, m_mark = (m.encode() for m in marks)

    def run(batches):
        for batch in batches:
            sizes = np.diff(_offsets(batch.column("text")))
            group = np.cumsum(sizes) // TOGETHER
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi > lo:
                    yield of(batch.slice(lo, hi - lo))

    def of(batch):
        column = batch.column("text")
        starts = _offsets(column)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
        starts = starts - starts[0]
        n, p, m, p_chars, m_chars = cut(data, starts, batch.column("h1").to_numpy(), batch.column("h2").to_numpy())
        raw, out = data.tobytes(), []
        forms = batch.column("form").to_pylist()
        for f, s, x, y, e in zip(forms, starts[:-1].tolist(), p.tolist(), m.tolist(), starts[1:].tolist(), strict=True):
            if f == "plain":
                out.append(raw[s:e])
            elif f == "psm":
                out.append(b"".join((p_mark, raw[s:x], s_mark, raw[y:e], m_mark, raw[x:y])))
            else:
                out.append(b"".join((s_mark, raw[y:e], p_mark, raw[s:x], m_mark, raw[x:y])))
        plain = np.array([f == "plain" for f in forms])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), batch.column("form"), pa.array(p_chars, pa.int64(), mask=plain), pa.array(m_chars, pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
            names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )

    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def restored(output: Column, form: Column, marks=MARKS) -> Column:
    """The text that ``output`` was made of: what lies between the marks, which no cut text holds, in the order of ``form``."""
    parts = F.split(output, "|".join(re.escape(m) for m in marks), -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
                  sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n),
s AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:n], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM s
"""
