"""BPE encoding and decoding: greedy proposals, pair checks in numpy, exact merging of the words that fail."""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache
from itertools import chain
from unicodedata import is_normalized, normalize

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import table

#: Words kept per Python worker; the cache starts anew beyond it.
CACHE_WORDS = 300_000
CHUNK = 1 << 20
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NEVER = np.int64(1) << 40


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


class WordBpe:
    """A vocabulary with word ends, read from the JSON of a tokenizers file.

    Time runs by merge rank: every merge makes a piece of a later rank than its parts, so the pieces at the two sides of
    a boundary at any moment follow from ranks alone. Two tokens are compatible if at no moment the pieces that face each
    other would merge. A sequence of tokens is the exact encoding if every neighbouring pair is compatible.
    """

    def __init__(self, raw: str):
        spec = json.loads(raw)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.size = size
        self.strings = [""] * size
        for s, i in chain(self.vocab.items(), self.special.items()):
            self.strings[i] = s
        self.numbers = [str(i) for i in range(size)]
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.merges: dict[int, tuple[int, int]] = {}
        for k, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            made = self.vocab[a + b]
            pair = self.vocab[a] * size + self.vocab[b]
            if self.rank[made] >= 0 or pair in self.merges:
                raise ValueError("a token of two merges")
            self.rank[made], self.left[made], self.right[made] = k, self.vocab[a], self.vocab[b]
            self.merges[pair] = (k, made)
        self.keys = np.array(sorted(self.merges), np.int64)
        self.key_rank = np.array([self.merges[k][0] for k in self.keys.tolist()], np.int64)
        self.bytes = byte_alphabet()
        self.longest = max(len(s.removesuffix(self.end)) for s in self.vocab)
        # Tokens that exact merging doesn't give back from their own text are never proposed.
        self.usable = {s: i for s, i in self.vocab.items() if self.rank[i] < 0 or self.exact(s.removesuffix(self.end), s.endswith(self.end)) == [i]}
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", SPACE))
        self.proposed = self.failed = 0

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each pair of tokens: whether no merge across their boundary comes before the merges that absorb its sides."""
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        end_x, end_y = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(live):
            r = self.rank_of(x, y)
            crossed = (r < end_x) & (r <= end_y) & (r < NEVER)  # of equal ranks the leftmost merges first
            ok[live[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~crossed & ((rx >= 0) | (ry >= 0))
            live, x, y, end_x, end_y, rx, ry = live[go], x[go], y[go], end_x[go], end_y[go], rx[go], ry[go]
            undo_x = rx > ry  # the later merge is undone first
            end_x, end_y = np.where(undo_x, rx, end_x), np.where(undo_x, end_y, ry)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return ok

    def exact(self, text: str, ended: bool = True) -> list[int]:
        """Merge by rank, leftmost first, with a heap over linked symbols."""
        ids = [self.vocab[c] for c in text[:-1]] + [self.vocab[text[-1] + (self.end if ended else "")]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get(ids[i] * self.size + ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.merges[a * self.size + b][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := self.merges.get(ids[i] * self.size + ids[k]):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (m := self.merges.get(ids[h] * self.size + ids[i])):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def propose(self, text: str) -> list[int]:
        """Longest usable token at each place."""
        out, i, n, usable = [], 0, len(text), self.usable
        while i < n:
            if n - i <= self.longest and (t := usable.get(text[i:] + self.end)) is not None:
                out.append(t)
                break
            for j in range(min(n - 1, i + self.longest), i, -1):
                if (t := usable.get(text[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
        return out

    def learn(self, words: set[str]) -> None:
        """Encode words that aren't known yet, all at once."""
        if len(self.known) + len(words) > CACHE_WORDS:
            self.known.clear()
        if len(self.pairs) > CACHE_WORDS:
            self.pairs.clear()
        new = list(words)
        texts = ["".join([self.bytes[b] for b in w.encode()]) for w in new]
        tries = [self.propose(t) for t in texts]
        flat = np.fromiter(chain.from_iterable(tries), np.int64)
        sizes = np.fromiter(map(len, tries), np.int64, len(tries))
        ends = np.cumsum(sizes)
        inner = np.ones(max(len(flat) - 1, 0), bool)
        inner[ends[:-1] - 1] = False
        a, b = flat[:-1][inner], flat[1:][inner]
        keys, back = np.unique(a * self.size + b, return_inverse=True)
        good = np.array([self.pairs.get(k, -1) for k in keys.tolist()], np.int64)
        if (miss := np.flatnonzero(good < 0)).size:
            good[miss] = self.compatible(keys[miss] // self.size, keys[miss] % self.size)
            self.pairs.update(zip(keys[miss].tolist(), good[miss].tolist(), strict=True))
        bad = np.zeros(len(new), bool)
        bad[np.repeat(np.arange(len(new)), sizes - 1)[good[back] == 0]] = True
        self.proposed, self.failed = self.proposed + len(new), self.failed + int(bad.sum())
        self.known.update((w, tuple(self.exact(t) if no else p)) for w, t, p, no in zip(new, texts, tries, bad.tolist(), strict=True))

    def pieces(self, text: str):
        """Lists of words, or a special token's id, in order; long texts are cut at blanks."""
        for part in self.split_special.split(text) if self.split_special and "<" in text else [text]:
            if part in self.special:
                yield self.special[part]
                continue
            at = 0
            while at < len(part):
                to = at + CHUNK
                while to < len(part) and part[to] not in " \n\t\r":
                    to += 1
                s = part[at:to]
                at = to
                if not is_normalized("NFC", s):
                    s = normalize("NFC", s)
                yield self.words.findall(s.replace("Σ", "σ").lower())

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for words in self.pieces(text):
            if isinstance(words, int):
                out.append(words)
                continue
            if new := set(words).difference(self.known):
                self.learn(new)
                if not self.known.keys() >= (rest := set(words)):  # the cache began anew
                    self.learn(rest.difference(self.known))
            out.extend(chain.from_iterable(map(self.known.__getitem__, words)))
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks: the vocabulary has no decoder that joins them otherwise."""
        return " ".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=2)
def vocabulary(raw: str) -> WordBpe:
    return WordBpe(raw)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, *, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), output: str = "ids") -> DataFrame:
    """``keep`` columns and the encoding of each text: ``ids`` (array of int) or, with output="digest", n_tokens,
    ids_sha256 of the decimal ids and decoded_sha256 of the text decoded from the ids.

    No shuffle; a row is worked on by itself, whole and of any length. A null text counts as empty (no ids); repeated rows
    have equal results; an empty table gives no rows. The vocabulary, of fixed size, is sent to the executors once.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(path or default_path(), encoding="utf-8") as f:
        raw = spark.sparkContext.broadcast(f.read())
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kept = [rows.schema[c] for c in keep]
    more = "ids array<int>" if output == "ids" else "n_tokens long, ids_sha256 string, decoded_sha256 string"
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [more])

    def run(batches):
        bpe = vocabulary(raw.value)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            own = [batch.column(c) for c in keep]
            if output == "ids":
                cols = [pa.array([bpe.encode(t.as_py()) for t in batch.column("_text")], pa.list_(pa.int32()))]
                names = ["ids"]
            else:
                counts, first, second = [], [], []
                for t in batch.column("_text"):
                    ids = bpe.encode(t.as_py())
                    counts.append(len(ids))
                    first.append(sha(" ".join(map(bpe.numbers.__getitem__, ids))))
                    second.append(sha(bpe.decode(ids)))
                cols = [pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([*own, *cols], names=[*keep, *names])

    return rows.mapInArrow(run, fields)


def decode(encoded: DataFrame, *, path: str | None = None, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the text of each array of ids (null or empty: the empty text); an empty table gives no rows."""
    spark = encoded.sparkSession
    ship(spark)
    with open(path or default_path(), encoding="utf-8") as f:
        raw = spark.sparkContext.broadcast(f.read())
    rows = encoded.select(*keep, F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("_ids"))
    fields = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + ["text string"])

    def run(batches):
        bpe = vocabulary(raw.value)
        for batch in batches:
            texts = pa.array([bpe.decode(x.as_py()) for x in batch.column("_ids")], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], texts], names=[*keep, "text"])

    return rows.mapInArrow(run, fields)


def op9_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), output="digest")
