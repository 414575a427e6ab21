"""Queries on landing, versions, health, duplicates and tenancy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import dedupe, landing, search, tenancy
from ..sources import tables as t
from ..sources.storage import written
from ..sources.dims import DEPARTMENTS, NAF_CPV, departments, naf_cpv


def raw_landing_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.raw(spark, sf_dir)
    stored = rows.filter(F.col("fetched_at") < F.lit("2024-01-10").cast("timestamp"))
    return landing.new_rows(rows, stored).select("event_id", "source", "external_id", "content_hash")


def raw_landing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.landing_counts(t.raw(spark, sf_dir))


def cursor_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.cursors(t.raw(spark, sf_dir), t.sources(spark))


def trailing_volume_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.volumes(t.raw(spark, sf_dir), t.now_e())


def _versions(spark, sf_dir):
    return landing.amendments(t.raw(spark, sf_dir), ["source", "external_id"], ["fetched_at", "event_id"])


def amendment_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).select("event_id", "version", "amended", "previous_hash")


def latest_notice_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.latest(_versions(spark, sf_dir), ["source", "external_id"], ["fetched_at", "event_id"]).select("source", "external_id", "event_id", "version", "created_at", F.when(F.col("version") > 1, "amended").otherwise("active").alias("status"))


def notice_id_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t.read(spark, sf_dir, "documents")
    return d.select("doc_id", ids.notice_id(F.col("source"), F.substring("text", 1, 70)).alias("notice_id"))


def source_tier_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = landing.quarantine_sources(t.sources(spark))
    rows = good.withColumn("quarantined", F.lit(False)).unionByName(bad.withColumn("quarantined", F.lit(True)))
    return t.raw(spark, sf_dir).join(F.broadcast(rows), "source").groupBy("source", "tier_rank", "quarantined").agg(F.count("*").alias("n"))


def schema_drift_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.drift(t.raw(spark, sf_dir), ["id"])


def source_health_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _health(spark, sf_dir).select("source", "verdict", "reason", "should_page", F.round("silent_hours", 3).alias("silent_hours"))


def _health(spark, sf_dir):
    return landing.health(t.sources(spark), landing.volumes(t.raw(spark, sf_dir), t.now_e()), t.now_e())


def health_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.health_summary(_health(spark, sf_dir))


def coverage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.coverage(t.sources(spark), landing.volumes(t.raw(spark, sf_dir), t.now_e()), t.now_e())


def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.read(spark, sf_dir, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("normal"))


BUYER_HEADS = ("Commune de", "Ville d'", "Métropole", "SA SA SA SA SA", "Mairie de", "CHU", "\ufb01nance", "SARL CH Région")


def buyer_name_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t.read(spark, sf_dir, "documents")
    head = F.array(*[F.lit(x) for x in BUYER_HEADS])
    name = F.concat_ws(" ", F.element_at(head, (F.col("doc_id") % len(BUYER_HEADS) + 1).cast("int")), "text", F.when(F.col("doc_id") % 5 == 0, "SAS CHU"))
    return d.select("doc_id", text.normalize_buyer(name).alias("core"))


def title_trigram_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of alike titles: first lines of the documents, each different one once, by their smallest id."""
    titles = t.publications(spark, sf_dir).groupBy("title").agg(F.min("id").alias("id"))
    return search.alike_titles(titles, dedupe.TITLE_LEAST)


def embedding_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each vector whose id is divisible by 50 all others that are near it: a stated query set against all rows."""
    v = t.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = v.filter("id % 50 = 0").select(F.col("id").alias("query"), F.col("embedding").alias("vector"))
    near = search.scored_vectors(v, asked, 0.35).filter("query <> id")
    return near.select(F.col("query").alias("a"), F.col("id").alias("b"), F.col("score").alias("cosine"))


def _publication_notices(spark, sf_dir):
    d = t.read(spark, sf_dir, "documents")
    first = F.substring_index("text", "\n", 1)
    return d.select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 == 0, "result").otherwise("competition").alias("notice_type"), F.col("lang").alias("country"), first.alias("title"), F.col("text").alias("description"),
        F.concat_ws(" ", F.slice(F.split(first, " "), 1, 4)).alias("buyer_name"), F.lit(None).cast("string").alias("buyer_siren"), F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("n_chars") % 48) * 1800).alias("deadline_at"),
        F.array(F.struct(F.col("source").alias("source"), F.concat(F.lit("N"), (F.col("doc_id") % 300).cast("string")).alias("external_id"))).alias("source_refs"), F.lit(None).cast("array<float>").alias("embedding"),
        F.array(F.col("lang")).alias("cpv"), F.array(F.upper("lang")).alias("nuts"), "source", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("published_at"), F.lit(None).cast("string").alias("procedure_type"), F.when(F.col("doc_id") % 3 == 0, F.col("n_chars").cast("double")).alias("amount"),
    )


def pair_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.all_verdicts(written(dedupe.prepared(_publication_notices(spark, sf_dir)), "prepared"), vectors=False)


def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _publication_notices(spark, sf_dir)
    p = written(dedupe.prepared(n), "prepared")
    return dedupe.cluster(n.select("id"), dedupe.links(p, vectors=False))


def cluster_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _publication_notices(spark, sf_dir).join(cluster_members(spark, sf_dir), "id")
    out = dedupe.merged(rows, F.col("id"))
    return out.select("cluster_id", "title", F.array_join("cpv", ",").alias("cpv"), "published_at", "deadline_at", "buyer_name", "amount", F.size("source_refs").alias("n_refs"), "publications")


def source_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _publication_notices(spark, sf_dir).join(cluster_members(spark, sf_dir), "id")
    return dedupe.merged(rows, F.col("id")).filter(F.size("badges") > 1).select("cluster_id", F.array_join("badges", ",").alias("badges"), "publications")


def dept_to_nuts_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t.read(spark, sf_dir, "supplier").select("s_suppkey", F.lpad((F.col("s_suppkey") % 99).cast("string"), 2, "0").alias("department"))
    return s.join(F.broadcast(departments(spark)), "department", "left")


def naf_cpv_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array(*[F.lit(k) for k in [*sorted(NAF_CPV), "0000X"]])
    s = t.read(spark, sf_dir, "supplier").select("s_suppkey", F.element_at(keys, (F.col("s_suppkey") % 8 + 1).cast("int")).alias("naf"))
    return s.join(F.broadcast(naf_cpv(spark)), "naf", "left").select("s_suppkey", "naf", F.array_join("cpv", ",").alias("cpv"))


def org_scoped_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tenancy.scoped(t.evidence(spark, sf_dir), 7).groupBy("org_id", "kind").agg(F.count("*").alias("n"))


def event_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("user_id")).alias("org_id"))
    return tenancy.scoped_events(e, None).unionByName(tenancy.scoped_events(e, 5))


def append_only_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    new = e.filter("event_id % 1000 <> 3").withColumn("value", F.when(F.col("event_id") % 1000 == 7, F.col("value") + 1).otherwise(F.col("value")))
    return tenancy.append_only_violations(e, new, "event_id")


W_RAW, W_SRC = f"WITH {t.RAW_SQL}", f"WITH {t.RAW_SQL}, {t.SOURCES_SQL}"
VERSIONS = W_RAW + ", p AS (SELECT *, lag(content_hash) OVER (PARTITION BY source, external_id ORDER BY fetched_at, event_id) AS previous_hash FROM n_raw), v AS (SELECT *, coalesce(previous_hash <> content_hash, false) AS amended FROM p), z AS (SELECT *, CAST(1 + sum(CAST(amended AS INTEGER)) OVER (PARTITION BY source, external_id ORDER BY fetched_at, event_id) AS INTEGER) AS version FROM v)"
VOLUMES = f"vol AS (SELECT source, count(*) FILTER (fetched_at > TIMESTAMP '{t.NOW_E}' - INTERVAL 7 DAY) AS last, count(*) FILTER (fetched_at > TIMESTAMP '{t.NOW_E}' - INTERVAL 14 DAY AND fetched_at <= TIMESTAMP '{t.NOW_E}' - INTERVAL 7 DAY) AS previous, max(fetched_at) AS last_success_at FROM n_raw GROUP BY source)"
HEALTH = W_SRC + f""", {VOLUMES}, hh AS (SELECT s.*, last, previous, last_success_at, (epoch_us(TIMESTAMP '{t.NOW_E}') - epoch_us(last_success_at)) / 3.6e9::DOUBLE AS silent_hours,
  CASE tier WHEN 'official_api' THEN 6 WHEN 'platform' THEN 24 ELSE 72 END AS budget FROM n_sources s LEFT JOIN vol USING (source)),
h AS (SELECT *, CASE WHEN NOT enabled THEN 'disabled' WHEN schedule IS NULL THEN 'not polled' WHEN last_success_at IS NULL THEN 'never ran' WHEN silent_hours > budget THEN 'over budget' WHEN previous >= 20 AND (previous - last) / previous::DOUBLE > 0.4 THEN 'volume drop' ELSE 'ok' END AS reason FROM hh),
g AS (SELECT *, CASE WHEN reason IN ('never ran', 'over budget') THEN 'silent' WHEN reason = 'volume drop' THEN 'degraded' ELSE 'green' END AS verdict FROM h),
f AS (SELECT *, verdict = 'silent' AND tier IN ('official_api', 'platform') AS should_page FROM g)"""
NORMAL = r"trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', ' ', 'g'))"
GRAMS = f"list_transform([{NORMAL.format('title')}], lambda x: CASE WHEN x = '' THEN CAST([] AS VARCHAR[]) ELSE list_distinct(list_transform(range(1, length(x) + 2), lambda i: substr('  ' || x || ' ', i, 3))) END)[1]"
FIRST_WORDS = "array_to_string(string_split(string_split(text, chr(10))[1], ' ')[1:4], ' ')"
PUBS = f"""pub AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'result' ELSE 'competition' END AS notice_type, string_split(text, chr(10))[1] AS title, lang, source, n_chars, {FIRST_WORDS} AS buyer_name,
  1704067200 + (n_chars % 48) * 1800 AS dl, source || ':N' || (doc_id % 300) AS pub, list_sort([source]) AS src FROM documents),
pg AS (SELECT *, {GRAMS} AS g, {NORMAL.format('buyer_name')} AS buyer, min(id) OVER (PARTITION BY pub, notice_type) AS head FROM pub),
cand AS (SELECT a.id AS a, b.id AS b, a.pub = b.pub AS same, a.head = a.id AND b.head = a.id AS star, a.buyer = b.buyer AND a.buyer <> '' AND abs(a.dl - b.dl) <= 3600 AS near, len(list_intersect(a.g, b.g)) AS o, len(a.g) AS na, len(b.g) AS nb
  FROM pg a JOIN pg b ON a.id < b.id AND a.notice_type = b.notice_type AND (a.pub = b.pub OR a.buyer = b.buyer)),
ver AS (SELECT a, b, CASE WHEN same THEN 'same_publication' ELSE 'buyer_deadline_title' END AS reason, CASE WHEN same THEN 1.0::DOUBLE ELSE round(least(1.0::DOUBLE, 0.6::DOUBLE + 0.4::DOUBLE * (o::DOUBLE / (na + nb - o)::DOUBLE - 0.6::DOUBLE) / 0.4::DOUBLE), 3) END AS confidence
  FROM cand WHERE star OR (same AND near) OR (near AND o::DOUBLE / (na + nb - o)::DOUBLE >= 0.6))"""
#: All verdicts; clusters need no more than the star of a publication.
WHOLE = PUBS.replace("WHERE star OR (same AND near) OR", "WHERE same OR")
CLUSTERS = f"WITH RECURSIVE {PUBS}, e AS (SELECT a, b FROM ver UNION ALL SELECT b, a FROM ver), r AS (SELECT id, id AS c FROM pub UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id), m AS (SELECT id, min(c) AS cluster_id FROM r GROUP BY id)"

SQL = {
    "raw_landing_idempotent": W_RAW + ", k AS (SELECT *, row_number() OVER (PARTITION BY source, external_id, content_hash ORDER BY fetched_at, event_id) AS k FROM n_raw) SELECT event_id, source, external_id, content_hash FROM k WHERE k = 1 AND fetched_at >= TIMESTAMP '2024-01-10'",
    "raw_landing_counts": W_RAW + " SELECT source, count(*) AS fetched, count(DISTINCT (external_id, content_hash)) AS stored FROM n_raw GROUP BY source",
    "cursor_watermark": W_SRC + " SELECT s.source, CASE WHEN enabled THEN max(fetched_at) END AS cursor, CAST(CASE WHEN enabled THEN 0 ELSE 1 END AS INTEGER) AS skipped_disabled FROM n_sources s LEFT JOIN n_raw r USING (source) GROUP BY s.source, enabled",
    "trailing_volume_7d": W_RAW + f", {VOLUMES} SELECT * FROM vol",
    "amendment_versions": VERSIONS + " SELECT event_id, version, amended, previous_hash FROM z",
    "latest_notice_state": VERSIONS + ", l AS (SELECT *, min(fetched_at) OVER (PARTITION BY source, external_id) AS created_at, row_number() OVER (PARTITION BY source, external_id ORDER BY fetched_at DESC, event_id DESC) AS k FROM z) SELECT source, external_id, event_id, version, created_at, CASE WHEN version > 1 THEN 'amended' ELSE 'active' END AS status FROM l WHERE k = 1",
    "notice_id_slug": r"SELECT doc_id, substr('ntc_' || regexp_replace(source || '_' || substr(text, 1, 70), '[^\p{L}\p{N}_]', '_', 'g'), 1, 60) AS notice_id FROM documents",
    "source_tier_quarantine": W_SRC + " SELECT source, CAST(CASE tier WHEN 'official_api' THEN 1 WHEN 'platform' THEN 2 WHEN 'signals' THEN 4 ELSE 3 END AS INTEGER) AS tier_rank, legal_basis NOT IN ('open-license', 'tos-reviewed', 'robots-ok') AS quarantined, count(*) AS n FROM n_raw JOIN n_sources USING (source) GROUP BY ALL",
    "schema_drift_keys": W_RAW + ", k AS (SELECT source, unnest(json_keys(payload)) AS key FROM n_raw) SELECT source, key, count(*) AS n FROM k WHERE key <> 'id' GROUP BY ALL",
    "source_health_verdicts": HEALTH + " SELECT source, verdict, reason, should_page, round(silent_hours, 3) AS silent_hours FROM f",
    "health_summary": HEALTH + " SELECT count(*) FILTER (verdict = 'green') AS green, count(*) FILTER (verdict = 'degraded') AS degraded, count(*) FILTER (verdict = 'silent') AS silent, coalesce(list_sort(list(source) FILTER (should_page)), CAST([] AS VARCHAR[])) AS paging FROM f",
    "coverage_status": HEALTH + " SELECT source, CAST(CASE tier WHEN 'official_api' THEN 1 WHEN 'platform' THEN 2 WHEN 'signals' THEN 4 ELSE 3 END AS INTEGER) AS tier_rank, round(silent_hours, 1) AS hours, round(silent_hours, 1) <= budget AS within_budget, enabled FROM f",
    "text_normalize": f"SELECT doc_id, {NORMAL.format('text')} AS normal FROM documents",
    "buyer_name_core": "WITH n AS (SELECT doc_id, " + NORMAL.format("([" + ", ".join("'" + h.replace("'", "''").replace("\ufb01", "fi") + "'" for h in BUYER_HEADS) + f"][doc_id % {len(BUYER_HEADS)} + 1] || ' ' || text || CASE WHEN doc_id % 5 = 0 THEN ' SAS CHU' ELSE '' END)") + " AS base FROM documents), one AS (SELECT doc_id, list_prepend(base, flatten(list_transform(range(0, 12), lambda i: [" + ", ".join(f"'{x}'" for x in text.BUYER_PHRASES) + "]))) AS l FROM n), lead AS (SELECT doc_id, list_reduce(l, lambda a, p: CASE WHEN a = p THEN a ELSE CASE WHEN ends_with(CASE WHEN starts_with(a, p || ' ') THEN substr(a, length(p) + 2) ELSE a END, ' ' || p) THEN substr(CASE WHEN starts_with(a, p || ' ') THEN substr(a, length(p) + 2) ELSE a END, 1, length(CASE WHEN starts_with(a, p || ' ') THEN substr(a, length(p) + 2) ELSE a END) - length(p) - 1) ELSE CASE WHEN starts_with(a, p || ' ') THEN substr(a, length(p) + 2) ELSE a END END END) AS core FROM one) SELECT * FROM lead",
    "title_trigram_pairs": f"WITH p AS (SELECT string_split(text, chr(10))[1] AS title, min(doc_id) AS id FROM documents GROUP BY 1), g AS (SELECT id, {GRAMS} AS g FROM p), e AS (SELECT id, len(g) AS n, unnest(g) AS k FROM g), s AS (SELECT a.id AS a, b.id AS b, count(*) AS o, a.n AS na, b.n AS nb FROM e a JOIN e b ON a.k = b.k AND a.id < b.id AND a.n * 0.6 <= b.n AND b.n * 0.6 <= a.n GROUP BY ALL) SELECT a, b, round(o::DOUBLE / (na + nb - o)::DOUBLE, 6) AS similarity FROM s WHERE o::DOUBLE / (na + nb - o)::DOUBLE >= 0.6",
    "embedding_cosine_pairs": "WITH s AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) SELECT * FROM s WHERE cosine >= 0.35",
    "pair_verdicts": f"WITH {WHOLE} SELECT a, b, reason, confidence FROM ver",
    "cluster_members": CLUSTERS + " SELECT id, cluster_id FROM m",
    "source_badges": CLUSTERS + " SELECT cluster_id, array_to_string(list_sort(list_distinct(list(source))), ',') AS badges, count(*) AS publications FROM m JOIN pub USING (id) GROUP BY cluster_id HAVING count(DISTINCT source) > 1",
    "dept_to_nuts_bridge": "SELECT s_suppkey, lpad(CAST(s_suppkey % 99 AS VARCHAR), 2, '0') AS department, nuts FROM supplier LEFT JOIN (VALUES " + ", ".join(f"('{d}', '{n}')" for d, n in sorted(DEPARTMENTS.items())) + ") AS t(d, nuts) ON d = lpad(CAST(s_suppkey % 99 AS VARCHAR), 2, '0')",
    "naf_cpv_suggest": "WITH s AS (SELECT s_suppkey, [" + ", ".join(f"'{k}'" for k in [*sorted(NAF_CPV), "0000X"]) + "][s_suppkey % 8 + 1] AS naf FROM supplier) SELECT s_suppkey, s.naf, cpv FROM s LEFT JOIN (VALUES " + ", ".join(f"('{k}', '{','.join(v)}')" for k, v in sorted(NAF_CPV.items())) + ") AS t(naf, cpv) ON s.naf = t.naf",
    "org_scoped_view": f"WITH {t.EVIDENCE_SQL} SELECT org_id, kind, count(*) AS n FROM n_evidence WHERE org_id = 7 GROUP BY ALL",
    "event_scope": "WITH e AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN user_id END AS org_id FROM events) SELECT * FROM e WHERE org_id IS NULL OR org_id = 5",
    "append_only_violations": "SELECT event_id, CASE WHEN event_id % 1000 = 3 THEN 'deleted' ELSE 'updated' END AS violation FROM events WHERE event_id % 1000 IN (3, 7)",
}
SQL["cluster_merge"] = CLUSTERS + """, j AS (SELECT * FROM m JOIN pub USING (id)), f AS (SELECT cluster_id, lang, min(id) AS i FROM j GROUP BY ALL), fc AS (SELECT cluster_id, string_agg(lang, ',' ORDER BY i) AS cpv FROM f GROUP BY cluster_id)
 SELECT j.cluster_id, arg_max(title, (length(title), -id)) AS title, any_value(fc.cpv) AS cpv, make_timestamp((1700000000 + min(id)) * 1000000) AS published_at, make_timestamp(arg_min(dl, id) * 1000000) AS deadline_at, arg_min(buyer_name, id) AS buyer_name,
 arg_min(CASE WHEN id % 3 = 0 THEN n_chars::DOUBLE END, CASE WHEN id % 3 = 0 THEN id END) AS amount, CAST(count(DISTINCT pub) AS INTEGER) AS n_refs, count(*) AS publications FROM j JOIN fc USING (cluster_id) GROUP BY j.cluster_id"""
QUERIES = {f.__name__: f for f in (raw_landing_idempotent, raw_landing_counts, cursor_watermark, trailing_volume_7d, amendment_versions, latest_notice_state, notice_id_slug, source_tier_quarantine, schema_drift_keys, source_health_verdicts, health_summary, coverage_status, text_normalize, buyer_name_core, title_trigram_pairs, embedding_cosine_pairs, pair_verdicts, cluster_members, cluster_merge, source_badges, dept_to_nuts_bridge, naf_cpv_suggest, org_scoped_view, event_scope, append_only_violations)}
