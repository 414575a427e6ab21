"""Secret scans: fixed patterns, and automata inferred from the credentials they label."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import durable, table

KINDS = ("assign", "access", "hex", "grammar")
#: Bounds of the training samples: labelled credentials of a kind, other long tokens, and characters of a value. Longer
#: values train nothing; they are scanned and scored whole.
PER_KIND, OTHERS, LONGEST = 400, 2000, 512
#: A candidate is a run of credential characters, stripped of punctuation at its ends.
LEAST = 16
#: Nats per character by which a format must explain a candidate better than ordinary tokens do, at least.
MARGIN = 0.35
#: One value in HOLD is held out of training to set limits. A candidate must be as likely under a format as all but
#: MISSED of its held-out values, with SLACK nats per character; and gain more than all but FALSE of held-out others.
HOLD, MISSED, SLACK, FALSE = 4, 0.02, 0.6, 0.002
#: A character that so many of a state's values have next, in share and number, is a literal there; others go by class.
LITERAL_SHARE, LITERAL_LEAST = 0.5, 8
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
TOKEN = "[secret]"


def base_spans(text: str, *, group: int = 2) -> list[tuple[int, str, int]]:
    """(start, kind, end) by start, then kind as listed. For an assignment the span is its value; with ``group`` 0 the whole
    match, from its keyword on.

    Runs of hex digits, and of capitals and digits after AKIA, are maximal; a length bound inside the pattern gives the
    same spans as dropping short matches afterwards.
    """
    out = [(m.start(group), 0, m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    # The shortest match with a value is AKIA and one more; later AKIA within a match are part of it.
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, KINDS[k], b) for a, k, b in sorted(out)]


def candidates(text: str):
    """Spans of long tokens of credential characters."""
    for m in RUN.finditer(text):
        a, b = m.span()
        while a < b and text[a] in "._-=+/":
            a += 1
        while a < b and text[b - 1] in "._-":
            b -= 1
        if b - a >= LEAST:
            yield a, b


CLASSES = {**dict.fromkeys("0123456789", "digit"), **dict.fromkeys("abcdef", "hex"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "lower"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper"), **{c: c for c in "+/_.=-"}}
SIZES = Counter(CLASSES.values())


class Automaton:
    """A probabilistic automaton inferred by merging states of the samples' prefix tree (Carrasco and Oncina, 1994).

    An edge stands for a literal, where most values of a state go on with one character (a prefix such as AKIA), else for
    a class of characters, whose probability its members share. Two states are merged if, at confidence ``alpha``, the
    Hoeffding bound finds no difference between their rates of ending and of each symbol, nor between those of the
    states that follow. Rates are smoothed for unseen symbols.
    """

    def __init__(self, samples: list[str], alpha: float = 0.05, smooth: float = 0.05):
        self.n, self.ends = [], []
        self.to: list[dict[str, int]] = []
        self.times: list[dict[str, int]] = []
        self._state(samples)
        grow = [(0, 0, samples)]
        while grow:
            q, depth, own = grow.pop()
            following = Counter(v[depth] for v in own if len(v) > depth)
            fixed = {c for c, k in following.items() if k >= max(LITERAL_LEAST, LITERAL_SHARE * len(own))}
            parts: dict[str, list[str]] = defaultdict(list)
            for v in own:
                if len(v) > depth:
                    parts["=" + v[depth] if v[depth] in fixed else CLASSES.get(v[depth], "lower")].append(v)
                else:
                    self.ends[q] += 1
            for x, held in sorted(parts.items()):
                self.times[q][x] = len(held)
                self.to[q][x] = self._state(held)
                grow.append((self.to[q][x], depth + 1, held))
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        kept, live = [0], {0}
        edge = [(0, c) for c in sorted(self.to[0])]
        while edge:
            q, c = min(edge, key=lambda e: (-self.n[self.to[e[0]][e[1]]], e))
            b = self.to[q][c]
            same = next((r for r in kept if self.alike(r, b)), None)
            if same is None:
                kept.append(b)
                live.add(b)
            else:
                self.to[q][c] = same
                self.fold(same, b)
            edge = [(r, x) for r in kept for x in self.to[r] if self.to[r][x] not in live]
        at = {q: i for i, q in enumerate(kept)}
        self.states = []
        for q in kept:
            total = self.n[q] + smooth * (len(SIZES) + 1)
            edges = {x: (math.log((self.times[q][x] + smooth) / total / (1 if x[0] == "=" and len(x) == 2 else SIZES[x])), at[to]) for x, to in self.to[q].items()}
            likely = max(self.to[q], key=lambda x: (self.times[q][x], x), default=None)
            self.states.append((edges, math.log(smooth / total / 16), math.log((self.ends[q] + smooth) / total), at[self.to[q][likely]] if likely else at[q]))
        del self.n, self.ends, self.to, self.times

    def _state(self, held: list[str]) -> int:
        self.n.append(len(held))
        self.ends.append(0)
        self.to.append({})
        self.times.append(defaultdict(int))
        return len(self.n) - 1

    def differ(self, fa: int, na: int, fb: int, nb: int) -> bool:
        return abs(fa / na - fb / nb) > self.bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))

    def alike(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            na, nb = self.n[a], self.n[b]
            if not na or not nb or self.bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb)) >= 1:
                continue  # too few to tell
            if self.differ(self.ends[a], na, self.ends[b], nb):
                return False
            for c in self.to[a].keys() | self.to[b].keys():
                if self.differ(self.times[a].get(c, 0), na, self.times[b].get(c, 0), nb):
                    return False
                if c in self.to[a] and c in self.to[b]:
                    stack.append((self.to[a][c], self.to[b][c]))
        return True

    def fold(self, a: int, b: int) -> None:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.n[a] += self.n[b]
            self.ends[a] += self.ends[b]
            for c, k in self.times[b].items():
                self.times[a][c] += k
            for c, q in self.to[b].items():
                if c in self.to[a]:
                    stack.append((self.to[a][c], q))
                else:
                    self.to[a][c] = q

    def score(self, value: str) -> float:
        """Mean log-probability of a character, the end included. After an unseen one the likeliest state goes on."""
        q, total, states = 0, 0.0, self.states
        for c in value:
            edges, unseen, _, likely = states[q]
            step = edges.get("=" + c) or edges.get(CLASSES.get(c, "lower"))
            if step is None:
                total += unseen
                q = likely
            else:
                total += step[0]
                q = step[1]
        return (total + states[q][2]) / (len(value) + 1)


def _part(values: list[str]) -> tuple[list[str], list[str]]:
    """Values to train on, and held-out ones: one in HOLD by the order of their hash."""
    by_hash = sorted(values, key=lambda v: hashlib.md5(v.encode()).digest())
    held = by_hash[HOLD - 1 :: HOLD]
    return sorted(set(values).difference(held)), held


class Formats:
    """One automaton for each kind of credential and one for other tokens, with limits from held-out values."""

    def __init__(self, labelled: dict[str, list[str]], others: list[str]):
        self.kinds: dict[str, tuple[Automaton, float]] = {}
        train, held_others = _part(others)
        self.others = Automaton(train or [""])
        for k, vs in sorted(labelled.items()):
            if vs:
                train, held = _part(vs)
                made = Automaton(train)
                scores = sorted(made.score(v) for v in (held or train))
                self.kinds[k] = (made, scores[int(MISSED * len(scores))] - SLACK)
        self.margin = MARGIN
        self.seen: dict[str, float] = {}
        if held_others:
            gains = sorted(self.gain(v) for v in held_others)
            self.margin = max(MARGIN, gains[-1 - int(FALSE * len(gains))])

    def gain(self, value: str) -> float:
        """How much better, per character, the best format explains a value than ordinary tokens do; -inf if it is
        unlikely under every format."""
        got = self.seen.get(value)
        if got is None:
            scores = [x for a, least in self.kinds.values() if (x := a.score(value)) >= least]
            got = max(scores) - self.others.score(value) if scores else -math.inf
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[value] = got
        return got

    def likely(self, value: str) -> bool:
        return self.gain(value) > self.margin


def all_spans(text: str, formats: Formats, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Base spans and, as kind grammar, candidates apart from them whose format is likely."""
    out, k, reach = list(base), 0, 0
    for a, b in candidates(text):
        while k < len(base) and base[k][0] < b:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= a and formats.likely(text[a:b]):
            out.append((a, "grammar", b))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def training_sample(docs: DataFrame, *, text: str = "text", per_kind: int = PER_KIND, others: int = OTHERS) -> Formats:
    """Read all texts; the values of smallest hash of each kind, and of other long tokens, train the automata here.

    The sample is bounded by PER_KIND, OTHERS and LONGEST, whatever the input; null and empty texts give nothing, repeated
    values count once. Without labelled values, as in an empty table, no candidate is likely.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_t"))

    def run(batches):
        for batch in batches:
            found: set[tuple[str, str]] = set()
            for t in batch.column("_t"):
                t = t.as_py()
                base = base_spans(t)
                found.update((k, t[a:b]) for a, k, b in base if b - a <= LONGEST)
                k = reach = 0
                for a, b in candidates(t):
                    while k < len(base) and base[k][0] < b:
                        reach = max(reach, base[k][2])
                        k += 1
                    if reach <= a and b - a <= LONGEST:
                        found.add(("other", t[a:b]))
            kinds, values = zip(*sorted(found), strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["kind", "value"])

    seen = durable(rows.mapInArrow(run, "kind string, value string"), "labelled").distinct()
    pick = lambda kind, n: [r.value for r in seen.filter(F.col("kind") == kind).orderBy(F.md5("value")).limit(n).select("value").collect()]
    return Formats({k: pick(k, per_kind) for k in KINDS[:3]}, pick("other", others))


def scan(docs: DataFrame, formats: Formats, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), redact: bool = False, whole: bool = False) -> DataFrame:
    """``keep`` columns, counts per kind, base_sha256 and spans of each text; with ``redact`` also the text without secrets.
    With ``whole`` base_sha256 and spans give an assignment from its keyword on, not its value only; what is found is the same.

    A null text counts as empty (redacted, it stays null). Rows are worked on one by one, whole and of any length, without
    a shuffle; repeated rows have equal results, and an empty table gives no rows.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(formats)
    rows = docs.select(*keep, F.col(text).alias("_t"))
    more = "n_assign long, n_access long, n_hex long, n_grammar long, base_sha256 string, spans string" + ", redacted string" * redact
    fields = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + [more])

    def write(spans):
        return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(6 + redact)]
            for t in batch.column("_t"):
                t = t.as_py()
                base = base_spans(t or "")
                spans = all_spans(t or "", sent.value, base)
                counts = [sum(k == kind for _, k, _ in spans) for kind in KINDS]
                if whole and counts[0]:
                    base = base_spans(t, group=0)
                    found = sorted([*base, *[x for x in spans if x[1] == "grammar"]], key=lambda x: (x[0], KINDS.index(x[1]), x[2]))
                else:
                    found = spans
                row = [*counts, hashlib.sha256(write(base).encode()).hexdigest(), write(found)]
                if redact:
                    out, at = [], 0
                    for a, _, b in spans:
                        if b > at:
                            out += [t[at:a], TOKEN] if a >= at else []
                            at = b
                    row.append(t if not spans else "".join([*out, t[at:]]))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            types = [pa.int64()] * 4 + [pa.string()] * (2 + redact)
            names = [*keep, "n_assign", "n_access", "n_hex", "n_grammar", "base_sha256", "spans", *["redacted"] * redact]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(c, y) for c, y in zip(cols, types, strict=True)]], names=names)

    return rows.mapInArrow(run, fields)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans are those of the whole matches."""
    docs = table(spark, sf_dir, "documents")
    return scan(docs, training_sample(docs), whole=True)
