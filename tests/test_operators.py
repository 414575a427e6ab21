"""Operators at inputs that the driver's tables lack, against plain Python."""

import math
import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tenderlake.functions import text
from tenderlake.operators import dedupe, documents, filters, landing, scoring, search, worklists
from tenderlake.sources import storage
from tenderlake.sources import tables as t


def test_compatibility_forms_and_fixed_point(spark):
    rows = {"ﬁnance": "finance", "sa sa sa sa sa lyon": "lyon", "sa ch": "sa", "Métropole": "metropole", "Commune de Nogent-sur-Oise": "nogent sur oise", "½ ＳＡ Ⅷ": "1 2 sa viii", None: ""}
    got = spark.createDataFrame([(k,) for k in rows], "x string").select("x", text.normalize_buyer(F.col("x")).alias("b")).collect()
    assert {r.x: r.b for r in got} == rows


def test_entities(spark):
    rows = {"5&#8364;": "5€", "l&#8217;eau": "l’eau", "&#x27;a&#x27;": "'a'", "&eacute;t&eacute;": "été", "&amp;#039;": "'", "a &nbsp; b": "a b", " & ": "&", "": None, None: None, "&bogus; &": "&bogus; &"}
    got = spark.createDataFrame([(k,) for k in rows], "x string").select("x", documents.clean_text(F.col("x")).alias("c")).collect()
    assert {r.x: r.c for r in got} == rows


def test_pairs_meet_alike_by_values_and_by_prefixes(spark, sf_dir):
    """Both ways of finding candidates pass the same pairs as trying all; blank lists take anything, unknown values nothing named."""
    own = t.profiles(spark, sf_dir)
    empty = F.array().cast("array<string>")
    free = own.limit(3).withColumns({"profile_id": F.concat(F.lit("free_"), "profile_id"), "notice_types": empty, "countries": empty, "cpv_families": empty})
    profiles = own.unionByName(free)
    notices = t.notices(spark, sf_dir).withColumn("country", F.when(F.col("notice_id").endswith("7"), None).otherwise(F.col("country")))
    every = filters.hard_filter(filters.with_search_columns(notices).crossJoin(filters.with_normal_keywords(profiles)), t.now_o())
    want = {(r.profile_id, r.outcome): r.n for r in every.groupBy("profile_id", "outcome").agg(F.count("*").alias("n")).collect()}
    for most in (20_000, 0):
        got = filters.outcome_counts(notices, profiles, t.now_o(), broadcast_most=most).collect()
        assert {(r.profile_id, r.outcome): r.n for r in got} == want


def test_index_blocks_lose_and_repeat_nothing(spark, sf_dir, monkeypatch):
    """Cells dealt into many small blocks give each passing pair once: profiles by families, by zones only and by neither,
    notices without codes, without places and with null among them."""
    own = t.profiles(spark, sf_dir)
    empty = F.array().cast("array<string>")
    zoned = own.withColumns({"profile_id": F.concat(F.lit("zoned_"), "profile_id"), "cpv_families": empty, "nuts_filter": F.array(F.lit("FR1"), F.lit(""), F.lit("BE100"), F.lit("FR10"))})
    free = own.limit(4).withColumns({"profile_id": F.concat(F.lit("free_"), "profile_id"), "cpv_families": empty, "nuts_filter": empty, "countries": empty})
    starred = own.limit(4).withColumns({"profile_id": F.concat(F.lit("star_"), "profile_id"), "cpv_families": F.array(F.lit("*"), F.lit(""), F.lit("7*"))})
    profiles = own.unionByName(zoned).unionByName(free).unionByName(starred)
    last = F.substring("notice_id", -1, 1)
    notices = t.notices(spark, sf_dir).withColumns({
        "lots": F.when(last != "3", F.col("lots")), "cpv": F.when(last == "5", F.array(F.lit(None).cast("string"), F.lit("72"))).otherwise(F.col("cpv")),
        "nuts": F.when(last == "1", empty).when(last == "2", F.array(F.lit(None).cast("string"))).otherwise(F.col("nuts")),
    })
    every = filters.with_search_columns(notices).crossJoin(filters.with_normal_keywords(profiles))
    want = sorted((r.profile_id, r.notice_id) for r in filters.hard_filter(every, t.now_o()).filter("outcome = 'pass'").select("profile_id", "notice_id").collect())
    counts = {(r.profile_id, r.outcome): r.n for r in filters.outcome_counts(notices, profiles, t.now_o()).collect()}
    monkeypatch.setattr(filters, "BLOCK_NOTICES", 40)
    monkeypatch.setattr(filters, "BLOCK_PROFILES", 3)
    for cells in (100_000, 0):
        monkeypatch.setattr(filters, "BROADCAST_CELLS", cells)
        got = filters.survivors(notices, profiles, t.now_o(), broadcast_most=0).select("profile_id", "notice_id").collect()
        assert sorted((r.profile_id, r.notice_id) for r in got) == want
    assert {(r.profile_id, r.outcome): r.n for r in filters.outcome_counts(notices, profiles, t.now_o(), broadcast_most=0).collect()} == counts


def test_profiles_that_agree_are_looked_at_once(spark, sf_dir, monkeypatch):
    """Forty profiles that differ in what is their own only: one class meets the notices, in counts and in scores, and every
    pair comes out as if looked at by itself; with members in parts, those that the three best scores reach."""
    own = t.profiles(spark, sf_dir).filter("profile_id = 'wp_1'")
    ids = spark.range(40)
    profiles = own.crossJoin(ids).withColumns({"profile_id": F.concat_ws("-", "profile_id", "id"), "org_id": F.concat(F.lit("org_"), (F.col("id") % 7).cast("string")), "annual_revenue": F.when(F.col("id") != 3, F.col("id") * 30000.0), "known_buyer_sirens": F.array(F.lpad(F.col("id").cast("string"), 9, "0"))}).drop("id")
    notices, now = t.notices(spark, sf_dir).cache(), t.now_o()
    rows = lambda df: {(r.profile_id, r.notice_id): (r.score, r.factors, r.warnings) for r in df.select("profile_id", "notice_id", "score", "factors", "warnings").collect()}
    want = rows(scoring.score(filters.survivors(scoring.with_asked(notices), scoring.with_profile_terms(profiles), now), now))
    assert len(want) > 40
    seen, survivors = [], filters.survivors
    monkeypatch.setattr(filters, "survivors", lambda n, p, *a, **k: seen.append(p.count()) or survivors(n, p, *a, **k))
    assert rows(scoring.score_all(notices, profiles, now)) == want
    counts = spark.createDataFrame([(p, s, n) for (p, s), n in Counter((p, v[0]) for (p, _), v in want.items()).items()], "profile_id string, score int, n long")
    third = {p: sorted((v[0] for (q, _), v in want.items() if q == p), reverse=True)[:3][-1] for p, _ in want}
    monkeypatch.setattr(scoring, "BROADCAST_MEMBERS", 9)
    kept = scoring.score_all(notices, profiles, now, least=scoring.least_of_best(counts, "profile_id", 3)).select("profile_id", "notice_id").collect()
    assert {(r.profile_id, r.notice_id) for r in kept} == {k for k, v in want.items() if v[0] >= third[k[0]]} and len(kept) < len(want)
    monkeypatch.setattr(filters, "_counts", lambda n, p, *a, **k: seen.append(p.count()) or p.select("profile_id", F.lit("pass").alias("outcome"), F.lit(1).alias("n")))
    assert {r.profile_id for r in filters.outcome_counts(notices, profiles, now).collect()} == {p for p, _ in want}
    assert set(seen) == {1}


def test_landed_pages(spark):
    """Ids in order of preference, empty ones passed over; addresses by template or field; empty pages and missing fields."""
    schema = "results array<struct<idweb:string,id:long,url_avis:string>>"
    pages = spark.createDataFrame([([("a", 1, "u"), ("", 2, None), (None, None, "v"), ("a", 1, "u")],), ([],), (None,)], schema)
    got = [tuple(r) for r in landing.explode_pages(pages, "BOAMP").select("source", "external_id", "url").collect()]
    assert sorted(got, key=str) == [("BOAMP", "2", None), ("BOAMP", "a", "u"), ("BOAMP", "a", "u")]
    bare = spark.createDataFrame([([("9",)],)], "results array<struct<id:string>>")
    assert [tuple(r)[1:3] for r in landing.explode_pages(bare, "BOAMP").collect()] == [("9", None)]
    ted = spark.createDataFrame([([("1-2024", "x"), (None, "y")],)], "notices array<struct<`publication-number`:string,t:string>>")
    r = landing.explode_pages(ted, "TED").first()
    assert (r.external_id, r.url, r.payload) == ("1-2024", "https://ted.europa.eu/en/notice/1-2024", '{"publication-number":"1-2024","t":"x"}')


def test_failed_sources(spark):
    sources = spark.createDataFrame([("a", "green", 1), ("b", "green", 9), ("c", "silent", None), (None, "green", None)], "source string, health string, last_run_at long")
    failures = spark.createDataFrame([("a", 3), ("a", 2), ("b", 4), ("x", 5)], "source string, at long")
    got = {r.source: (r.health, r.last_run_at) for r in landing.marked_degraded(sources, failures).collect()}
    assert got == {"a": ("degraded", 3), "b": ("degraded", 9), "c": ("silent", None), None: ("green", None)}


def test_alike_titles(spark):
    rnd = random.Random(3)
    titles = [" ".join(rnd.choice(["bolt", "ring", "gear", "works", "road", "ville"]) for _ in range(rnd.randint(0, 6))) for _ in range(150)]
    rows = list(enumerate(dict.fromkeys(titles)))

    def grams(x):
        x = f"  {x} "
        return {x[i : i + 3] for i in range(len(x) - 2)} if x.strip() else set()

    want = {(a, b) for a, x in rows for b, y in rows if a < b and (g := grams(x)) and (h := grams(y)) and len(g & h) / len(g | h) >= 0.6}
    assert {(r.a, r.b) for r in search.alike_titles(spark.createDataFrame(rows, "id long, title string"), 0.6).collect()} == want


def test_find_quotes(spark):
    rnd = random.Random(5)
    word = lambda: rnd.choice(["alpha", "beta", "gamma", "delta", "eps", "a", "of"])
    texts = [(i, "  ".join(word() for _ in range(rnd.randint(0, 40)))) for i in range(60)] + [(90, None), (91, "")]
    quotes = []
    for i in range(120):
        w = " ".join((rnd.choice(texts[:60])[1] or "").split())
        a = rnd.randint(0, max(len(w) - 1, 0))
        quotes.append((i, w[a : a + rnd.randint(0, 50)].upper() if i % 3 else " ".join(word() for _ in range(5))))
    norm = lambda x: " ".join((x or "").split()).lower()
    want = {i: min((d for d, x in texts if norm(q) and norm(q) in norm(x)), default=None) for i, q in quotes}
    got = documents.find_quotes(spark.createDataFrame(quotes, "quote_id int, quote string"), spark.createDataFrame(texts, "doc_id int, text string")).collect()
    assert {r.quote_id: r.doc_id for r in got} == want and all(r.valid == (r.doc_id is not None) for r in got)


def ratio(a, b):
    norm = lambda x: " ".join((x or "").split()).casefold()
    return SequenceMatcher(None, norm(a), norm(b)).ratio()


def items(rnd, n):
    base = ["supply of bolts and rings for the town", "maintenance of the road network", "training of staff in safety", "cleaning of public buildings", ""]
    out = []
    for i in range(n):
        w = rnd.choice(base).split()
        if w and rnd.random() < 0.7:
            w[rnd.randrange(len(w))] = rnd.choice(["lifts", "roofs", "two", "x"])
        out.append((str(i % 3), i, " ".join(w), rnd.choice(["formal", "eliminatory"])))
    return out


def test_scored_pairs_and_greedy_matching(spark):
    """All pairs of a case at or above the threshold; best first, each item once."""
    rnd = random.Random(7)
    a, b = items(rnd, 40), items(rnd, 40)
    frame = lambda rows: spark.createDataFrame(rows, "case string, idx int, text string, type string")
    pairs = documents.scored_pairs(frame(a), frame(b)).collect()
    want = {(c, i, j): ratio(x, y) for c, i, x, _ in a for d, j, y, _ in b if c == d and ratio(x, y) >= 0.6}
    assert {(r.case, r.p, r.g): r.score for r in pairs} == pytest.approx(want)
    used, taken = set(), set()
    for s, p, g, c in sorted(((s, p, g, c) for (c, p, g), s in want.items()), reverse=True):
        if ("p", c, p) not in used and ("g", c, g) not in used:
            used |= {("p", c, p), ("g", c, g)}
            taken.add((c, p, g))
    assert {(r.case, r.p, r.g) for r in documents.greedy_matches(documents.scored_pairs(frame(a), frame(b))).collect()} == taken


def test_two_pass_union(spark):
    rows = items(random.Random(9), 45)
    want = []
    for case in "012":
        kept = []
        for _, i, x, kind in (r for r in rows if r[0] == case):
            near = next((k for k in kept if ratio(x, k[0]) >= 0.6), None)
            if near is None:
                kept.append([x, kind, None])
            elif kind == "eliminatory" and near[1] != "eliminatory":
                near[1:] = ["eliminatory", near[1]]
        want += [(case, f"REQ-{n:03d}", *k) for n, k in enumerate(kept, 1)]
    got = documents.two_pass_union(spark.createDataFrame(rows, "case string, idx int, text string, type string")).collect()
    assert sorted((r.case, r.ref, r.text, r.type, r.disputed_type) for r in got) == sorted(want, key=lambda r: r[:2])


def test_stars_connect_what_all_pairs_would(spark):
    """A reference shared by many gives a row for each, and the same clusters; the vector rule joins alike vectors of a day."""
    ref = lambda *ids: [("s", i) for i in ids]
    rows = [(i, "competition", "FR", "t", None, None, None, ref(f"REF-{i // 10:03}", f"OTHER{i % 7}"), None) for i in range(40)]
    rows += [(100 + i, "result", "FR", "t", None, None, "2024-01-01 10:00:00", ref(f"X{i}"), [1.0, 0.1 * i, 0.0]) for i in range(3)]
    schema = "id long, notice_type string, country string, title string, buyer_name string, buyer_siren string, deadline_at string, source_refs array<struct<source:string,external_id:string>>, embedding array<double>"
    n = spark.createDataFrame(rows, schema).withColumn("deadline_at", F.col("deadline_at").cast("timestamp"))
    p = dedupe.prepared(n)
    pairs = dedupe.candidate_pairs(p)
    found = dedupe.verdicts(p, pairs)
    assert found.filter("b < 100").count() < 80 and {r.reason for r in found.filter("a >= 100").collect()} == {"embedding"}
    assert {(r.id, r.cluster_id) for r in dedupe.cluster(n.select("id"), found).collect()} == {(i, 0) for i in range(40)} | {(100 + i, 100) for i in range(3)}


def test_gold_needs_documents(spark):
    gold = spark.createDataFrame([("/g/a.gold.json",), ("/g/b.gold.json",)], "path string")
    files = spark.createDataFrame([("/d/a.pdf",), ("/d/c.pdf",)], "path string")
    with pytest.raises(ValueError, match="without a document"):
        landing.gold_pairs(gold, files)
    with pytest.raises(ValueError, match="no gold"):
        landing.gold_pairs(gold.limit(0), files)
    assert [r.stem for r in landing.gold_pairs(gold.filter("path like '%a.%'"), files).collect()] == ["a"]


def test_evidence_filters_are_checked(spark):
    rows = spark.createDataFrame([(1, "admin", "valid", None, None)], "evidence_id int, kind string, status string, expires_at date, created_at date")
    with pytest.raises(ValueError):
        worklists.evidence_list(rows, kind="nonsense")
    assert worklists.evidence_list(rows, kind="admin", status="valid").count() == 1


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        storage.shared_dir(Session())


def test_stems_and_pruned_search(spark):
    """The terms of some words, and the pruned search against every score; frequent words, ties and queries without an answer."""
    words = {
        "travaux": {"traval", "travaux"}, "bureaux": {"bureau", "bureaux"}, "rénovation": {"renov", "renovation"}, "fournitures": {"fournitur", "fourniture"}, "cities": {"citi", "city"},
        "cleaning": {"cleaning", "clean"}, "bus": {"bus"}, "glass": {"glas", "glass"}, "ab": {"ab"}, "": set(), None: set(),
    }
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", search.terms(F.col("w"), (search.FRENCH, search.ENGLISH)).alias("t")).collect()
    assert {r.w: set(r.t) for r in got} == words
    rnd = random.Random(8)
    vocab = [f"w{'x' * (i % 3)}{i}" for i in range(60)]
    text = lambda n: " ".join(rnd.choice(["the", "of", "and", *vocab[: rnd.randint(1, 60)]]) for _ in range(n))
    docs = [(i, text(rnd.randint(0, 5)), rnd.choice(["the town", "city", None]), text(rnd.randint(0, 40))) for i in range(300)] + [(900, None, None, None), (901, "the", "the", "the")]
    asked = [(i, text(rnd.randint(1, 8))) for i in range(40)] + [(90, "of the and"), (91, "nothing here"), (92, ""), (93, None)]
    weights = {}
    for i, *fields in docs:
        for f, w in zip(fields, (1.0, 0.4, 0.2), strict=True):
            for term in set((f or "").split()):
                weights[i, term] = weights.get((i, term), 0) + w
    df = {}
    for _, term in weights:
        df[term] = df.get(term, 0) + 1
    want = set()
    for q, x in asked:
        score = {}
        for (i, term), w in weights.items():
            if term in set((x or "").split()):
                score[i] = score.get(i, 0) + round(w, 6) * math.log(1 + len(docs) / df[term])
        want |= {(q, i, round(s, 4)) for i, s in sorted(((i, round(s, 6)) for i, s in score.items()), key=lambda z: (-z[1], z[0]))[:5]}
    notices = spark.createDataFrame(docs, "id int, title string, buyer_name string, description string")
    for first in (2000, 3):
        search.FIRST_POSTINGS = first
        found = search.fulltext(search.term_index(notices), spark.createDataFrame(asked, "query int, text string"), len(docs), 5).collect()
        assert {(r.query, r.id, round(r.score, 4)) for r in found} == want
    search.FIRST_POSTINGS = 2000


def test_suggestions_are_found_once_for_equal_families(spark, monkeypatch):
    """Many tenders of the same families, a tender in two rows, short codes: result rows come from a join, not from a grouping of them."""
    from tenderlake.operators import worklists

    refs = spark.createDataFrame([("r1", ["72110001", "48110002", "72110001"]), ("r2", ["7"]), ("r3", ["48119999"]), ("r4", None)], "reference_id string, cpv array<string>")
    tenders = spark.createDataFrame([(i, ["7211", "4811"]) for i in range(50)] + [(90, ["7211"]), (90, ["4811", "x"]), (91, ["30"]), (92, None)], "tender_id long, families array<string>")
    want = {(i, "r1", "48110002,72110001") for i in [*range(50), 90]} | {(i, "r3", "48119999") for i in [*range(50), 90]}
    for most in (1000, 1):
        monkeypatch.setattr(worklists, "BROADCAST_TENDERS", most)
        got = worklists.suggestions(refs, tenders)
        assert {tuple(r) for r in got.select("tender_id", "reference_id", "codes").collect()} == want and got.count() == 102
        assert got._jdf.queryExecution().optimizedPlan().toString().lstrip().startswith("Project")


def test_alike_titles_in_blocks(spark, monkeypatch):
    """Titles of all sizes over several blocks and tiles, long ones among them, against all pairs; each pair comes once. No step has a
    row for each two titles that share a trigram."""
    from tenderlake.functions.text import jaccard, trigrams

    monkeypatch.setattr(search, "BLOCK_TITLES", 40)
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 7))) for _ in range(60)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 3, 9, 60, 400])))) for i in range(250)] + [(900, ""), (901, None)]
    rows += [(1000 + i, t + " " + rnd.choice(words)) for i, t in rows[:150]]
    t = spark.createDataFrame(rows, "id long, title string")
    got = [tuple(r) for r in search.alike_titles(t, 0.6).collect()]
    g = t.select("id", trigrams(F.col("title")).alias("g"))
    both = g.select(F.col("id").alias("a"), F.col("g").alias("ga")).join(g.select(F.col("id").alias("b"), F.col("g").alias("gb")), F.col("a") < F.col("b"))
    want = [tuple(r) for r in both.withColumn("s", jaccard(F.col("ga"), F.col("gb"))).filter("s >= 0.6").select("a", "b", F.round("s", 6)).collect()]
    assert len(want) > 150 and sorted(got) == sorted(want)
    assert "_ranked" not in dir(search)
