"""Scores of all notices with all profiles in blocks: counts of scores, and the pairs that reach a limit.

``scoring.score_all`` gives a row for each pair that no check vetoes. Where only counts or the best are asked, those rows needn't be made:
what a check or factor compares is a list of the profile (few different ones) with a notice, so that Spark's expressions work each list
out once a notice, and the pairs themselves are matrices of notices by profiles in Arrow batches, with the same arithmetic in the same order.
"""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import days_between, seconds_between
from ..functions.text import holds_any, starts_with_any, under_or_over_any
from ..shipping import ship
from . import filters, scoring

#: Different lists of a kind, and profiles, up to which pairs are matrices; beyond, ``scoring.score_all`` makes rows.
LISTS, MEMBERS = 256, 1_000_000
#: Notices that a task works on at once, pairs of them and the profiles of a class, and profiles whose counts are held by a pass.
TOGETHER, HELD, PART = 1 << 16, 1 << 20, 1 << 16
#: Pairs that are given in one batch.
GIVEN = 1 << 18
SCORES = 101
_LISTS = ("notice_types", "countries", "procedure_types", "cpv_families", "nuts_filter", "zones_nuts", "_words", "_out", "_in", "held")


class Profiles:
    """Profiles in order of their class (equal in all but revenue, org and known buyers), with the number of each of their lists."""

    def __init__(self, rows: list):
        self.lists: dict[str, list] = {k: [] for k in _LISTS}
        seen: dict[str, dict] = {k: {} for k in _LISTS}
        keyed = []
        for r in rows:
            of = []
            for k in _LISTS:
                value = tuple(r[k] or ())
                if value not in seen[k]:
                    seen[k][value] = len(self.lists[k])
                    self.lists[k].append(value)
                of.append(seen[k][value])
            number = lambda x: float("nan") if x is None else float(x)
            keyed.append(((*of, bool(r["national"]), repr(number(r["min_days_to_deadline"])), repr(number(r["amount_min"])), repr(number(r["amount_max"]))), r))
        keyed.sort(key=lambda x: x[0])
        keys = list(dict.fromkeys(k for k, _ in keyed))
        self.ids = [r["profile_id"] for _, r in keyed]
        self.orgs = [r["org_id"] for _, r in keyed]
        place = {k: i for i, k in enumerate(keys)}
        of = np.array([place[k] for k, _ in keyed], int)
        self.bounds = np.searchsorted(of, np.arange(len(keys) + 1))
        self.of = {k: np.array([key[i] for key in keys], int) for i, k in enumerate(_LISTS)}
        n = len(_LISTS)
        self.national = np.array([k[n] for k in keys], bool)
        self.days, self.least, self.most = (np.array([float(k[n + i]) for k in keys]) for i in (1, 2, 3))
        money = np.array([np.nan if r["annual_revenue"] is None else r["annual_revenue"] for _, r in keyed], float)
        self.revenue = np.where(money == 0, np.nan, money)
        known = sorted((s, m) for m, (_, r) in enumerate(keyed) for s in set(r["known_buyer_sirens"] or ()) if s is not None)
        self.sirens, self.knows = np.array([s for s, _ in known], object), np.array([m for _, m in known], int)
        self.class_of = of


def coded_profiles(profiles: DataFrame) -> Profiles | None:
    """The profiles with what is compared, or None if they or their different lists are too many, a list is null or a number isn't finite."""
    rows = scoring.with_profile_terms(profiles)
    normal = filters.with_normal_keywords(profiles).select("profile_id", F.col("keywords_exclude").alias("_out"), F.col("keywords_include").alias("_in"))
    if rows.count() > MEMBERS:
        return None
    named = rows.select("profile_id", "org_id", "notice_types", "countries", "procedure_types", "cpv_families", "nuts_filter", "zones_nuts", F.transform("words", lambda w: w["normal"]).alias("_words"), "held", "national", "min_days_to_deadline", "amount_min", "amount_max", "annual_revenue", "known_buyer_sirens")
    held = named.join(normal, "profile_id").collect()
    numbers = ("min_days_to_deadline", "amount_min", "amount_max", "annual_revenue")
    if any(r[k] is None for r in held for k in _LISTS) or any(r[k] is not None and not math.isfinite(r[k]) for r in held for k in numbers):
        return None
    got = Profiles(held)
    return got if max(map(len, got.lists.values())) <= LISTS and len(set(got.ids)) == len(got.ids) else None


def _literal(values: tuple) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def coded_notices(notices: DataFrame, p: Profiles, now: Column) -> DataFrame:
    """What each different list of the profiles makes of a notice, by the expressions of ``filters`` and ``scoring``. Amounts are null or finite."""
    rows = filters.with_search_columns(scoring.with_asked(notices), [])
    each = lambda k, f: F.array(*[f(v).cast("double") for v in p.lists[k]]).alias(k) if p.lists[k] else F.array().cast("array<double>").alias(k)
    zones = lambda v: F.array_max(F.transform(F.filter("places", lambda x: under_or_over_any(x, _literal(v))), lambda x: F.length(x)))
    geo = lambda v: F.when((F.size("places") == 0) | F.lit(not v), F.lit(0.5)).when(zones(v).isNull(), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.lit(0.7) + F.lit(0.1) * (zones(v) - 2)))
    words = lambda v: F.size(F.filter(_literal(v), lambda w: F.contains(F.col("haystack"), w)))
    lacking = lambda v: F.size(F.filter("asked", lambda c: ~F.array_contains(_literal(v), F.lower(c)))) > 0
    return rows.select(
        "notice_id", "notice_type", "country", "procedure_type", "buyer_siren", F.col("amount").cast("double").alias("amount"), F.size("codes").cast("double").alias("codes"), F.size("places").cast("double").alias("places"),
        seconds_between(F.col("deadline_at"), now).cast("double").alias("seconds"), scoring.factor_columns(now)["deadline_comfort"][0].cast("double").alias("comfort"),
        each("cpv_families", lambda v: F.size(F.filter("codes", lambda c: starts_with_any(c, _literal(v))))),
        each("nuts_filter", lambda v: F.exists("places", lambda x: under_or_over_any(x, _literal(v)))),
        each("zones_nuts", geo), each("_words", words),
        each("_out", lambda v: holds_any(F.col("haystack"), _literal(v))), each("_in", lambda v: holds_any(F.col("haystack"), _literal(v))),
        each("held", lacking),
    )


def rounded(total: np.ndarray) -> np.ndarray:
    """Half to even of the total to nine places."""
    whole = np.floor(total)
    half = np.abs(total - whole - 0.5) < 5e-10
    return np.where(half, np.rint(whole + 0.5), np.floor(total + 0.5)).astype(np.int64)


def _points_ok(terms: list[np.ndarray], score: np.ndarray) -> np.ndarray:
    """M-08 of ``scoring.breakdown_ok``; what lies at its limit is worked out in decimals, as Spark rounds."""
    off = np.abs(sum(np.round(x, 2) for x in terms) - score)
    ok = (off <= 0.53) & (score >= 0) & (score <= 100)
    for at in zip(*np.nonzero(np.abs(off - 0.53) < 0.021), strict=True):
        told = 0.0
        for x in terms:
            told += float(Decimal(repr(float(x[at]))).quantize(Decimal("0.01"), ROUND_HALF_UP))
        ok[at] = abs(told - score[at]) <= 0.53 and 0 <= score[at] <= 100
    return ok


def _scored(batch: pa.Table, p: Profiles, first: int, last: int, points: bool):
    """(class, members, rows, scores as a matrix of rows by members, whether points add up) of the classes with members from first to last."""
    n = batch.num_rows
    number = lambda c: batch.column(c).to_numpy().astype(float)
    table = lambda c: np.nan_to_num(batch.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1))
    amount, codes, places, seconds, comfort = map(number, ("amount", "codes", "places", "seconds", "comfort"))
    fams, nuts, zones, words, out, inn, lacking = map(table, ("cpv_families", "nuts_filter", "zones_nuts", "_words", "_out", "_in", "held"))
    plain = [batch.column(c).to_pylist() for c in ("notice_type", "country", "procedure_type")]
    combos: dict = {}
    combo = np.array([combos.setdefault(k, len(combos)) for k in zip(*plain, strict=True)], int)
    siren = np.array(batch.column("buyer_siren").to_pylist(), object)
    # Notices whose buyer a profile knows: rows and members, by class and then by row.
    knows = np.zeros((0, 3), int)
    if len(p.sirens):
        held = np.flatnonzero(siren != None)  # noqa: E711
        lo, hi = np.searchsorted(p.sirens, siren[held], "left"), np.searchsorted(p.sirens, siren[held], "right")
        m = p.knows[np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
        x = np.repeat(held, hi - lo)
        o = np.lexsort((x, p.class_of[m]))
        knows = np.stack([p.class_of[m], x, m], 1)[o]
    w = scoring.WEIGHTS
    some = {k: np.array([len(v) > 0 for v in p.lists[k]], bool) for k in _LISTS}
    takes = lambda k, v: np.array([not x or (v is not None and v in x) for x in p.lists[k]], bool)[p.of[k]]
    classes = np.arange(len(p.national))
    classes = classes[(p.bounds[classes + 1] > first) & (p.bounds[classes] < last)]
    for key, c in combos.items():
        allowed = takes("notice_types", key[0]) & takes("countries", key[1]) & takes("procedure_types", key[2])
        of = classes[allowed[classes]]
        rows = np.flatnonzero(combo == c)
        for k in of.tolist():
            f, z, g, h = p.of["cpv_families"][k], p.of["nuts_filter"][k], p.of["zones_nuts"][k], p.of["held"][k]
            q, o, i = p.of["_words"][k], p.of["_out"][k], p.of["_in"][k]
            ok = ~(seconds[rows] < p.days[k] * 86400) & ~(amount[rows] < p.least[k]) & ~(amount[rows] > p.most[k])
            if some["cpv_families"][f]:
                ok &= fams[rows, f] > 0
            if some["nuts_filter"][z]:
                ok &= (places[rows] == 0) | (nuts[rows, z] > 0)
            if some["_out"][o]:
                ok &= out[rows, o] == 0
            if some["_in"][i]:
                ok &= inn[rows, i] > 0
            r = rows[ok]
            if not len(r):
                continue
            ratio = np.where(codes[r] > 0, fams[r, f] / np.maximum(codes[r], 1), 0.0)
            hits = np.minimum(1.0, words[r, q] / 3.0)
            activity = np.maximum(ratio, hits)
            place = np.ones(len(r)) if p.national[k] else zones[r, g]
            cert = np.where(lacking[r, h] > 0, 0.0, 1.0)
            clip = lambda x: np.maximum(0.0, np.minimum(1.0, x))
            term = lambda x, name: clip(x) * w[name] * 100
            a, b, d, e = term(activity, "activity_fit"), term(place, "geographic_fit"), term(cert, "certification_fit"), term(comfort[r], "deadline_comfort")
            m0, m1 = max(first, int(p.bounds[k])), min(last, int(p.bounds[k + 1]))
            step = max(1, HELD // max(1, m1 - m0))
            part = knows[np.searchsorted(knows[:, 0], k, "left") : np.searchsorted(knows[:, 0], k, "right")]
            at = np.minimum(np.searchsorted(r, part[:, 1]), len(r) - 1)
            meets = (r[at] == part[:, 1]) & (part[:, 2] >= m0) & (part[:, 2] < m1)
            at, member = at[meets], part[meets, 2] - m0
            for s in range(0, len(r), step):
                t = slice(s, s + step)
                share = amount[r[t], None] / p.revenue[None, m0:m1]
                size = np.where(share > scoring.RATIO, np.maximum(0.0, 1 - share), np.minimum(1.0, 0.5 + share))
                size = term(np.where(np.isnan(share), 0.5, size), "size_fit")
                total = 0.0 + a[t, None] + b[t, None] + size + d[t, None]
                met = None
                i0, i1 = np.searchsorted(at, (s, s + step))
                if i1 > i0:
                    met = np.zeros(total.shape)
                    met[at[i0:i1] - s, member[i0:i1]] = 1.0 * w["buyer_familiarity"] * 100
                    total = total + met
                total = total + e[t, None]
                score = rounded(total)
                good = None
                if points:
                    wide = lambda x: np.broadcast_to(x[t, None], total.shape)
                    good = _points_ok([wide(a), wide(b), size, wide(d), met if met is not None else np.zeros(total.shape), wide(e)], score)
                yield k, m0, m1, r[t], score, good


def _gathered(batches):
    """Batches of some TOGETHER notices."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= TOGETHER:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _passes(p: Profiles) -> list[tuple[int, int]]:
    return [(i, min(i + PART, len(p.ids))) for i in range(0, len(p.ids), PART)]


def score_counts(coded: DataFrame, p: Profiles, *, points: bool = False) -> DataFrame:
    """(profile_id, org_id, score, n) of the pairs that no check vetoes; with ``points`` (ok, n) by ``scoring.breakdown_ok`` instead."""
    spark = coded.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(p)
    out = None
    for first, last in _passes(p):

        def run(batches, first=first, last=last):
            p = sent.value
            counts = np.zeros((last - first, SCORES), np.int64)
            oks = np.zeros(2, np.int64)
            for batch in _gathered(batches):
                for _, m0, m1, _, score, good in _scored(batch, p, first, last, points):
                    if points:
                        oks += np.bincount(good.ravel().astype(int), minlength=2)
                    else:
                        keys = score + np.arange(m1 - m0)[None, :] * SCORES
                        counts[m0 - first : m1 - first] += np.bincount(keys.ravel(), minlength=(m1 - m0) * SCORES).reshape(-1, SCORES)
            if points:
                yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([0, 0], pa.int32()), pa.array(oks)], names=["m", "score", "n"])
                return
            m, s = np.nonzero(counts)
            for i in range(0, len(m), GIVEN):
                at, score = m[i : i + GIVEN], s[i : i + GIVEN]
                yield pa.RecordBatch.from_arrays([pa.array((at + first).astype(np.int32)), pa.array(score.astype(np.int32)), pa.array(counts[at, score])], names=["m", "score", "n"])

        # A task's counts are as many as profiles have scores, whatever its notices: a task for each core.
        made = coded.repartition(spark.sparkContext.defaultParallelism, "notice_id").mapInArrow(run, "m int, score int, n long")
        out = made if out is None else out.unionByName(made)
    if out is None:
        return spark.createDataFrame([], "ok boolean, n long" if points else "profile_id string, org_id string, score int, n long")
    out = out.groupBy("m", "score").agg(F.sum("n").alias("n")).filter("n > 0")
    if points:
        return out.select((F.col("m") == 1).alias("ok"), "n")

    def named(batches):
        p = sent.value
        ids, orgs = pa.array(p.ids, pa.string()), pa.array(p.orgs, pa.string())
        for batch in batches:
            m = batch.column("m")
            yield pa.RecordBatch.from_arrays([ids.take(m), orgs.take(m), batch.column("score"), batch.column("n")], names=["profile_id", "org_id", "score", "n"])

    return out.mapInArrow(named, "profile_id string, org_id string, score int, n long")


def scored_pairs(coded: DataFrame, p: Profiles, least: dict[str, int] | int, most: int = SCORES) -> DataFrame:
    """(profile_id, org_id, notice_id, national, score) of the pairs that no check vetoes with a score of a profile's ``least`` to ``most``; a
    profile without a least has none."""
    spark = coded.sparkSession
    ship(spark)
    limit = np.array([least if isinstance(least, int) else least.get(x, SCORES + 1) for x in p.ids], np.int64)
    sent = spark.sparkContext.broadcast((p, limit))

    def run(batches):
        p, limit = sent.value
        ids, orgs = pa.array(p.ids, pa.string()), pa.array(p.orgs, pa.string())
        national = pa.array(p.national[p.class_of])
        for batch in _gathered(batches):
            names, held, n = batch.column("notice_id").combine_chunks(), [], 0

            def rows(names=names, held=held):
                m, r, score = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                m = pa.array(m)
                return pa.RecordBatch.from_arrays([ids.take(m), orgs.take(m), names.take(pa.array(r)), national.take(m), pa.array(score.astype(np.int32))], names=["profile_id", "org_id", "notice_id", "national", "score"])

            for _, m0, m1, of, score, _ in _scored(batch, p, 0, len(p.ids), False):
                r, m = np.nonzero((score >= limit[None, m0:m1]) & (score <= most))
                if len(r):
                    held.append((m + m0, of[r], score[r, m]))
                    n += len(r)
                if n >= GIVEN:
                    yield rows()
                    n = 0
            if n:
                yield rows()

    return coded.repartition(4 * spark.sparkContext.defaultParallelism, "notice_id").mapInArrow(run, "profile_id string, org_id string, notice_id string, national boolean, score int")
