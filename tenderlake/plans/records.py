"""Queries on landing, windows, seeds, sinks, placement, messages and access, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import dedupe, documents, landing, normalise, placement, scoring, tenancy, worklists
from ..sources import dims
from ..sources import tables as t
from ..sources.storage import new_folder, written
from ..sources.upsert import UpsertTable
from ..streaming import jobs
from . import ingest, product


def landed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-01, L-02. Pages of both feeds, one per nation. A record per customer: every seventh has no id, every third another key
    (its first left empty), every fourth no address. A record per supplier: every fifth has no number."""
    c, s = t.read(spark, sf_dir, "customer"), t.read(spark, sf_dir, "supplier")
    k, n = F.col("c_custkey"), F.col("s_suppkey")
    own = F.when(k % 7 != 0, k.cast("string"))
    record = F.struct(F.when(k % 3 != 0, own).otherwise("").alias("idweb"), F.when(k % 3 == 0, own).alias("id"), F.when(k % 4 != 0, F.concat(F.lit("https://x/"), k.cast("string"))).alias("url_avis"), F.col("c_name").alias("objet"))
    number = F.when(n % 5 != 0, F.concat(n.cast("string"), F.lit("-2024")))
    boamp = c.groupBy("c_nationkey").agg(F.collect_list(record).alias("results"))
    ted = s.groupBy("s_nationkey").agg(F.collect_list(F.struct(number.alias("publication-number"), F.col("s_name").alias("objet"))).alias("notices"))
    rows = landing.explode_pages(boamp, "BOAMP").unionByName(landing.explode_pages(ted, "TED"))
    return rows.select("source", "external_id", "url", F.get_json_object("payload", "$.objet").alias("objet"))


def incremental_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-06."""
    n = t.notices(spark, sf_dir).select("notice_id", "published_at", F.array("country").alias("places"))
    return landing.incremental_window(n, F.lit("1998-05-20").cast("timestamp"), t.now_o(), countries=["FR", "BE"], at="published_at").select("notice_id")


def fetch_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-08."""
    e = t.read(spark, sf_dir, "events").filter("event_type = 'error'")
    rows = e.select(F.col("user_id").cast("string").alias("source"), F.repeat("props", 150).alias("error"), F.col("ts").alias("at"))
    return landing.failure_facts(rows).select("kind", "entity", F.length(F.get_json_object("payload", "$.error")).alias("n"), "at")


def failed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-08. A source per user: those with an error are degraded as of the last one, or of their last run if that is later."""
    e = t.read(spark, sf_dir, "events").withColumn("source", F.col("user_id").cast("string"))
    failures = e.filter("event_type = 'error'").select("source", F.col("ts").alias("at"))
    sources = e.groupBy("source").agg(F.max(F.when(F.col("event_type") == "click", F.col("ts"))).alias("last_run_at"), F.lit("green").alias("health"))
    return landing.marked_degraded(sources, failures).select("source", "health", "last_run_at")


def dimension_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-13."""
    s = t.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("label"), F.lit(1).alias("updated"))
    new = s.filter("code % 4 = 0").select((F.col("code") + 2).alias("code"), F.upper("label").alias("label"), F.lit(2).alias("updated"))
    return dims.upsert(s, new, ["code"], "updated").select("code", "label")


def seeded_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-11, L-15. Canonical notices written as a replay corpus, read back and seeded."""
    c = t.read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    buyer = F.struct(F.col("c_name").alias("name"), F.when(k % 2 == 0, F.lpad(k.cast("string"), 9, "0")).alias("siren"), F.when(k % 3 == 0, F.concat(F.lpad(k.cast("string"), 9, "0"), F.lit("00017"))).alias("siret"))
    notices = c.select(F.concat(F.lit("ntc_"), k.cast("string")).alias("uid"), F.col("c_mktsegment").alias("title"), buyer.alias("buyer"))
    path = new_folder(spark, "corpus")
    landing.write_replay(notices, path)
    return landing.seeded(landing.read_replay(spark, path, notices.schema)).select("uid", "title", "buyer_siren")


def gold_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-12. Gold files with their documents, by stem."""
    d = t.read(spark, sf_dir, "documents")
    gold = d.select(F.concat(F.lit("/gold/d"), F.col("doc_id").cast("string"), F.lit(".gold.json")).alias("path"), F.col("n_chars").alias("gold"))
    files = d.select(F.concat(F.lit("/docs/d"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), "text")
    return landing.gold_pairs(gold, files).select("stem", "gold", F.length("text").alias("n"))


def outbox_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-16. Notifications appended twice: the replay adds nothing."""
    n = t.notifications(spark, sf_dir).select("org_id", "tender_id", "kind")
    path = new_folder(spark, "outbox")
    landing.append_once(n.filter("tender_id % 2 = 0"), path, ["org_id", "tender_id", "kind"])
    landing.append_once(n, path, ["org_id", "tender_id", "kind"])
    return spark.read.parquet(path).select("org_id", "tender_id", "kind", F.length("row_id").alias("n"))


def health_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H-04. Every user's events as a source whose stored health is green."""
    rows = t.raw(spark, sf_dir).select(F.col("external_id").alias("source"), "fetched_at")
    sources = rows.select("source").distinct().withColumns({"tier": F.lit("official_api"), "schedule": F.lit("*"), "enabled": F.col("source").cast("int") % 10 != 0, "health": F.when(F.col("source").cast("int") % 4 == 0, "silent").otherwise("green")})
    return landing.transitions(landing.health(sources, landing.volumes(rows, t.now_e()), t.now_e())).select("source", "health", "verdict")


def placed_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-12. Documents with an odd id are new, the others stored, each its own cluster; new ones meet each other too."""
    n = ingest._publication_notices(spark, sf_dir).withColumn("source_refs", F.array(F.struct(F.lit("s").alias("source"), F.concat(F.lit("REF-"), F.floor(F.col("id") / 2).cast("string")).alias("external_id")))).withColumn("notice_type", F.lit("competition"))
    stored = n.filter("id % 2 = 0").withColumn("cluster_id", F.col("id"))
    return placement.place(n.filter("id % 2 = 1"), stored).select("id", "cluster_id", "reason", "confidence")


def cluster_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-15."""
    n = ingest._publication_notices(spark, sf_dir)
    p = written(dedupe.prepared(n), "prepared")
    members = dedupe.cluster(n.select("id"), dedupe.links(p, vectors=False))
    out = dedupe.cluster_audit(members, dedupe.absorbing(p, vectors=False))
    return out.select("cluster_id", F.array_join(F.transform("merged_from", lambda x: F.concat(x["b"].cast("string"), F.lit(":"), x["reason"])), ",").alias("merged_from"), "confidence")


def match_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-12. Suppliers' lines scored anew; matches of even suppliers exist with a state and a first profile."""
    li = t.read(spark, sf_dir, "lineitem")
    scored = li.select(F.col("l_suppkey").alias("org_id"), F.col("l_partkey").alias("notice_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("profile_id"), F.col("l_quantity").cast("int").alias("score"))
    old = scored.filter("org_id % 2 = 0").groupBy("org_id", "notice_id").agg(F.lit("pursued").alias("state"), F.lit("first").alias("profile_id"))
    return scoring.upsert_matches(scored, old).select("org_id", "notice_id", "profile_id", "score", "state")


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-35."""
    c = t.read(spark, sf_dir, "customer")
    text = F.concat(F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.when(F.col("c_custkey") % 3 == 0, " 00017").when(F.col("c_custkey") % 3 == 1, "").otherwise("x1"))
    return c.select("c_custkey", ids.identifier(text).alias("i")).select("c_custkey", "i.siren", "i.siret")


def decoded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-19. Decimal references above 255, hexadecimal and named ones, and such encoded twice, around each customer's name."""
    c = t.read(spark, sf_dir, "customer")
    return c.select("c_custkey", documents.clean_text(F.concat(F.lit("  5&#8364; l&#8217;&#x27;&eacute;t&#xE9; &amp;eacute;&nbsp; "), "c_name", F.lit(" &OElig;uvre &amp;amp; &euro;\n"))).alias("name"))


def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-09. Answers built from the events against a schema with every keyword of the subset."""
    e = t.read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    body = F.struct(F.when(F.col("event_id") % 11 != 0, k).alias("k"), F.col("event_type").alias("kind"), F.when(F.col("event_id") % 13 == 0, F.lit(1)).alias("extra"), F.array("event_type").alias("tags"))
    raw = F.when(F.col("event_id") % 17 == 0, F.lit("{oops")).when(F.col("event_id") % 19 == 0, F.lit("[1]")).otherwise(F.concat(F.lit("```json\n"), F.to_json(body), F.lit("\n```")))
    schema = {"type": "object", "required": ["k", "kind"], "additionalProperties": False, "properties": {"k": {"type": "integer", "minimum": 5, "maximum": 40}, "kind": {"type": "string", "enum": ["view", "click", "signup", "purchase"]}, "tags": {"type": "array", "minItems": 1, "items": {"type": "string", "maxLength": 6}}}}
    return normalise.against_schema(e.select("event_id", raw.alias("raw")), schema).select("event_id", F.array_join("violations", ",").alias("violations"))


def evidence_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-01."""
    e = t.read(spark, sf_dir, "lineitem")
    rows = e.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("evidence_id"), F.when(F.col("l_returnflag") == "A", "admin").when(F.col("l_returnflag") == "R", "reference").otherwise("people").alias("kind"), F.when(F.col("l_linestatus") == "F", "valid").otherwise("expiring").alias("status"), F.when(F.col("l_linenumber") != 3, F.to_date("l_shipdate")).alias("expires_at"), F.to_date("l_shipdate").alias("created_at"))
    return worklists.evidence_list(rows, kind="admin", status="valid").select("evidence_id", "expires_at")


def known_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-10. A link per page to a known source, and a stored notice for two pages in three."""
    n = F.lpad(F.col("page_id").cast("string"), 8, "0")
    p = t.read(spark, sf_dir, "pages")
    links = p.select("page_id", F.concat(F.lit("https://ted.europa.eu/en/notice/-/detail/"), n, F.lit("-2026")).alias("url"))
    stored = p.filter("page_id % 3 <> 0").select(F.col("page_id").alias("id"), F.array(F.struct(F.lit("eu-ted").alias("source"), F.concat(n, F.lit("-2026")).alias("external_id")), F.struct(F.lit("fr-boamp").alias("source"), n.alias("external_id"))).alias("source_refs"))
    return documents.linked_notices(links, stored).select("page_id", "notice_id")


def resolved_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-01, I-02."""
    k = F.col("c_custkey")
    to = F.when(k % 4 == 0, F.concat(F.lit("Veille <Sources+org_"), "c_custkey", F.lit("@in.example>"))).when(k % 4 == 1, F.concat(F.lit("sources+org_N"), "c_nationkey", F.lit("@in.example"))).when(k % 4 == 2, F.lit("info@in.example")).otherwise(F.concat(F.lit("sources+org_n"), "c_nationkey", F.lit("@in.example")))
    orgs = t.read(spark, sf_dir, "nation").select(F.concat(F.lit("org_n"), F.col("n_nationkey").cast("string")).alias("org_id"))
    return documents.resolved(t.read(spark, sf_dir, "customer").select("c_custkey", to.alias("to")), orgs).select("c_custkey", "org_id", "rejected")


def messages_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-12. Two events share a message id, every fifth has none."""
    e = t.read(spark, sf_dir, "events")
    m = e.select(F.when(F.col("event_id") % 5 != 0, F.floor(F.col("event_id") / 2)).alias("message_id"), F.col("props").alias("text"), F.repeat("props", 2).alias("html"))
    return documents.once_per_message(m).groupBy(F.col("message_id").isNull().alias("unnamed")).agg(F.count("*").alias("n"), F.count_distinct("message_id").alias("ids"))


def my_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-02."""
    c = t.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("org_id"))
    return tenancy.memberships(c, 3, 1)


def refused_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-05."""
    return tenancy.foreign_rows(t.evidence(spark, sf_dir), 7).groupBy("org_id").agg(F.count("*").alias("n"))


def _streamed(frame: DataFrame, spark: SparkSession) -> DataFrame:
    target = new_folder(spark, "streamed")
    frame.writeStream.format("parquet").option("path", target).option("checkpointLocation", new_folder(spark, "offsets")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(target)


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "events")
    t.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).repartitionByRange(4, "event_id").sortWithinPartitions("event_id").write.parquet(path)
    return jobs.read_stream(spark, path, files=100)


def stream_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-05. The windows that the watermark has closed."""
    rows = _event_stream(spark, sf_dir).select(F.col("event_type").alias("source"), F.col("ts").alias("fetched_at"))
    out = _streamed(jobs.volume_stream(rows), spark)
    return out.filter(F.col("window.end") <= F.lit("2024-01-28").cast("timestamp")).select(F.col("window.start").alias("since"), "source", "n")


def stream_messages_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-07. Two events share a message id; within the watermark it passes once."""
    rows = _event_stream(spark, sf_dir).select(F.floor(F.col("event_id") / 2).alias("message_id"), F.col("ts").alias("received_at"))
    return _streamed(jobs.messages_once(rows, "60 days"), spark).select("message_id")


def stream_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-05, H-04. Events as fetches of their users modulo 20, from the sixteenth on modulo 40: changes at every midnight."""
    source = (F.col("user_id") % F.when(F.dayofmonth("ts") < 16, 20).otherwise(40)).cast("string")
    rows = _event_stream(spark, sf_dir).select(source.alias("source"), F.col("ts").alias("fetched_at"))
    k = F.col("id")
    sources = spark.range(40).select(k.cast("string").alias("source"), F.element_at(F.array(*map(F.lit, landing.BUDGET_HOURS)), (k % 4 + 1).cast("int")).alias("tier"), F.when(k % 7 > 0, "*").alias("schedule"), (k % 11 > 0).alias("enabled"), F.lit("green").alias("health"))
    return _streamed(jobs.health_stream(rows, sources), spark).select("source", "at", "health", "verdict")


#: Tenders of a group of the alert stream, some hundred bytes each, that a task holds at once.
TENDERS_A_GROUP = 8192


def stream_deadline_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-06. Every tender is made, moved by eleven days two weeks before its deadline, and moved again; then some are submitted."""
    x = t.tenders(spark, sf_dir).filter("deadline_at is not null")
    days = lambda n: F.expr(f"interval {n} days")
    k = F.col("tender_id")
    change = lambda at, deadline, stage: F.struct(at.alias("at"), deadline.alias("deadline_at"), stage.alias("stage"))
    due, opened = F.col("deadline_at") + days(40), F.lit("analysis")
    changes = F.array(
        change(F.col("created_at"), due, opened), change(due - days(14), due + days(11), opened), change(due - days(1), due + days(5), opened),
        change(due + days(2), due + days(5), F.when(k % 3 == 0, "submitted").otherwise(opened)),
    )
    path, target = new_folder(spark, "changes"), new_folder(spark, "alerts")
    x.select("org_id", "tender_id", F.inline(changes)).repartitionByRange(4, "at").write.parquet(path)
    groups = max(jobs.GROUPS, -(-x.count() // TENDERS_A_GROUP))
    with jobs.states_on_disk(spark):
        alerts = jobs.alerts_stream(jobs.read_stream(spark, path, files=100), groups=groups)
        alerts.writeStream.format("parquet").option("path", target).option("checkpointLocation", new_folder(spark, "offsets")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("tender_id").alias("tenders"))


def notice_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-14. The raw notices in two batches that share a third, the second one twice: the table's state."""
    raw = t.raw(spark, sf_dir).select("source", "external_id", "event_id", "content_hash", "fetched_at")
    most = raw.agg(F.max("event_id")).first()[0] or 0
    table = UpsertTable(spark, new_folder(spark, "notices"), raw.schema, ("source", "external_id"))
    batches = [raw.filter(F.col("event_id") * 3 < 2 * most), raw.filter(F.col("event_id") * 3 >= most)]
    for number, rows in ((1, batches[0]), (2, batches[1]), (2, batches[1])):
        table.upsert(rows, number, F.timestamp_seconds(F.lit(1_700_000_000 + number)), F.struct("fetched_at", "event_id"))
    return table.read()


def stream_late_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-03, D-12. Notices arrive in three batches, by thirds of their ids: duplicates lie within a batch and across batches."""
    n = ingest._publication_notices(spark, sf_dir).withColumn("notice_type", F.lit("competition"))
    refs = F.array(F.struct(F.lit("s").alias("source"), F.concat(F.lit("REF-"), F.floor(F.col("id") / 2).cast("string")).alias("external_id")))
    n = n.withColumn("source_refs", refs).select("id", "notice_type", "country", "title", "buyer_name", "buyer_siren", "deadline_at", "source_refs", "embedding")
    least, most = n.agg(F.min("id"), F.max("id")).first()
    path, store = new_folder(spark, "late"), placement.Store(spark, new_folder(spark, "placed"))
    third = F.floor((F.col("id") - least) * 3 / F.lit(most - least + 1))
    offsets = new_folder(spark, "offsets")
    for k in range(3):  # the stream goes on where it ended, with all files of the batch
        n.filter(third == k).write.mode("append").parquet(path)
        jobs.late_duplicates(jobs.read_stream(spark, path, files=1_000_000), store, offsets, vectors=False).awaitTermination()
    return store.members().select("id", "cluster_id")


# Notices meet by the reference of their half number, or by buyer, deadline and title. A new (odd) one meets all, a stored
# (even) one only new ones. A cluster has the name of its smallest stored notice, else of its smallest one.
PLACED_PAIRS = f"""{ingest.PUBS}, pairs AS (SELECT a.id AS a, b.id AS b, CASE WHEN a.id // 2 = b.id // 2 THEN 'same_publication' ELSE 'buyer_deadline_title' END AS reason, CASE WHEN a.id // 2 = b.id // 2 THEN 1.0::DOUBLE ELSE round(least(1.0::DOUBLE, 0.6::DOUBLE + 0.4::DOUBLE * (s.s - 0.6::DOUBLE) / 0.4::DOUBLE), 3) END AS confidence
  FROM pg a JOIN pg b ON a.id < b.id AND (a.id // 2 = b.id // 2 OR (a.buyer = b.buyer AND a.buyer <> '' AND abs(a.dl - b.dl) <= 3600)), LATERAL (SELECT CASE WHEN len(a.g) = 0 OR len(b.g) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a.g, b.g))::DOUBLE / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))::DOUBLE END AS s) AS s WHERE a.id // 2 = b.id // 2 OR (a.buyer = b.buyer AND a.buyer <> '' AND abs(a.dl - b.dl) <= 3600 AND s.s >= 0.6))"""
COMPONENTS = "e AS (SELECT a, b, reason, confidence FROM met UNION ALL SELECT b, a, reason, confidence FROM met), r AS (SELECT id, id AS c FROM pub UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)"
PLACED = f"""RECURSIVE {PLACED_PAIRS}, met AS (SELECT * FROM pairs WHERE a % 2 = 1 OR b % 2 = 1), {COMPONENTS}, m AS (SELECT id, coalesce(min(c) FILTER (c % 2 = 0), min(c)) AS cluster_id FROM r GROUP BY id),
best AS (SELECT a, max(confidence) AS confidence, arg_min(reason, (-confidence, b)) AS reason FROM e GROUP BY a)
SELECT id, cluster_id, CASE WHEN id <> cluster_id THEN best.reason END AS reason, CASE WHEN id <> cluster_id THEN best.confidence ELSE 1.0::DOUBLE END AS confidence FROM m LEFT JOIN best ON a = id WHERE id % 2 = 1"""
PLACED_LATE = f"RECURSIVE {PLACED_PAIRS}, met AS (SELECT * FROM pairs), {COMPONENTS} SELECT id, min(c) AS cluster_id FROM r GROUP BY id"
SQL = {
    "landed_records": "SELECT 'BOAMP' AS source, CAST(c_custkey AS VARCHAR) AS external_id, CASE WHEN c_custkey % 4 <> 0 THEN 'https://x/' || c_custkey END AS url, c_name AS objet FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT 'TED', s_suppkey || '-2024', 'https://ted.europa.eu/en/notice/' || s_suppkey || '-2024', s_name FROM supplier WHERE s_suppkey % 5 <> 0",
    "failed_sources": "SELECT CAST(user_id AS VARCHAR) AS source, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'degraded' ELSE 'green' END AS health, max(ts) FILTER (event_type IN ('click', 'error')) AS last_run_at FROM events GROUP BY user_id",
    "incremental_window": f"WITH {t.NOTICES_SQL} SELECT notice_id FROM n_notices WHERE country IN ('FR', 'BE') AND published_at >= TIMESTAMP '1998-05-20'",
    "fetch_failures": "SELECT 'source.fetch_failed' AS kind, CAST(user_id AS VARCHAR) AS entity, CAST(least(150 * length(props), 1000) AS INTEGER) AS n, ts AS at FROM events WHERE event_type = 'error'",
    "dimension_upsert": "SELECT coalesce(n.code, s.s_suppkey) AS code, coalesce(n.label, s_name) AS label FROM supplier s FULL JOIN (SELECT s_suppkey + 2 AS code, upper(s_name) AS label FROM supplier WHERE s_suppkey % 4 = 0) n ON n.code = s.s_suppkey",
    "seeded_notices": "SELECT 'ntc_' || c_custkey AS uid, c_mktsegment AS title, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 0 THEN lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS buyer_siren FROM customer",
    "gold_pairs": "SELECT 'd' || doc_id AS stem, n_chars AS gold, CAST(length(text) AS INTEGER) AS n FROM documents",
    "outbox_replayed": f"WITH {t.NOTIFICATIONS_SQL} SELECT DISTINCT org_id, tender_id, kind, CAST(64 AS INTEGER) AS n FROM n_notifications",
    "health_transitions": ingest.W_RAW + f", v AS (SELECT external_id AS source, max(fetched_at) AS last_at, count(*) FILTER (fetched_at > TIMESTAMP '{t.NOW_E}' - INTERVAL 7 DAY) AS l, count(*) FILTER (fetched_at > TIMESTAMP '{t.NOW_E}' - INTERVAL 14 DAY AND fetched_at <= TIMESTAMP '{t.NOW_E}' - INTERVAL 7 DAY) AS p FROM n_raw GROUP BY 1), g AS (SELECT source, CASE WHEN CAST(source AS INTEGER) % 4 = 0 THEN 'silent' ELSE 'green' END AS health, CASE WHEN CAST(source AS INTEGER) % 10 = 0 THEN 'green' WHEN epoch_us(TIMESTAMP '{t.NOW_E}') - epoch_us(last_at) > 21600000000 THEN 'silent' WHEN p >= 20 AND (p - l) / p::DOUBLE > 0.4 THEN 'degraded' ELSE 'green' END AS verdict FROM v) SELECT * FROM g WHERE verdict <> health AND verdict <> 'green'",
    "placed_notices": "WITH " + PLACED,
    "cluster_audit": ingest.CLUSTERS + ", x AS (SELECT m.cluster_id, b, reason, confidence, row_number() OVER (PARTITION BY m.cluster_id, b ORDER BY confidence DESC, a) AS k FROM ver JOIN m ON m.id = b) SELECT cluster_id, string_agg(b || ':' || reason, ',' ORDER BY b) AS merged_from, min(confidence) AS confidence FROM x WHERE k = 1 GROUP BY cluster_id",
    "match_upsert": "WITH s AS (SELECT l_suppkey AS org_id, l_partkey AS notice_id, l_orderkey || '-' || l_linenumber AS profile_id, CAST(l_quantity AS INTEGER) AS score FROM lineitem), b AS (SELECT *, row_number() OVER (PARTITION BY org_id, notice_id ORDER BY score DESC, profile_id) AS k FROM s) SELECT org_id, notice_id, CASE WHEN org_id % 2 = 0 THEN 'first' ELSE profile_id END AS profile_id, score, CASE WHEN org_id % 2 = 0 THEN 'pursued' ELSE 'new' END AS state FROM b WHERE k = 1",
    "identifiers": "SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS siren, CASE WHEN c_custkey % 3 = 0 THEN lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '00017' END AS siret FROM customer",
    "decoded_names": "SELECT c_custkey, '5€ l’''été é ' || c_name || ' Œuvre & €' AS name FROM customer",
    "schema_violations": "SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'not json' WHEN event_id % 19 = 0 THEN 'not an object' ELSE concat_ws(',', CASE WHEN event_id % 11 = 0 THEN '$.k required' END, CASE WHEN event_id % 13 = 0 THEN '$ additionalProperties' END, CASE WHEN event_id % 11 <> 0 AND CAST(json_extract_string(props, '$.k') AS BIGINT) < 5 THEN '$.k minimum' END, CASE WHEN event_id % 11 <> 0 AND CAST(json_extract_string(props, '$.k') AS BIGINT) > 40 THEN '$.k maximum' END, CASE WHEN event_type = 'error' THEN '$.kind enum' END, CASE WHEN length(event_type) > 6 THEN '$.tags items' END) END AS violations FROM events",
    "evidence_list": "SELECT l_orderkey || '-' || l_linenumber AS evidence_id, CASE WHEN l_linenumber <> 3 THEN CAST(l_shipdate AS DATE) END AS expires_at FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' ORDER BY expires_at NULLS LAST, CAST(l_shipdate AS DATE) DESC, evidence_id LIMIT 200",
    "known_links": "SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN page_id END AS notice_id FROM pages",
    "resolved_messages": "SELECT c_custkey, CASE WHEN c_custkey % 4 IN (1, 3) THEN 'org_n' || c_nationkey END AS org_id, CASE c_custkey % 4 WHEN 0 THEN 'unknown_org' WHEN 2 THEN 'unaddressable' END AS rejected FROM customer",
    "messages_once": "WITH m AS (SELECT CASE WHEN event_id % 5 <> 0 THEN event_id // 2 END AS id FROM events) SELECT id IS NULL AS unnamed, CASE WHEN id IS NULL THEN count(*) ELSE count(DISTINCT id) END AS n, count(DISTINCT id) AS ids FROM m GROUP BY id IS NULL".replace("CASE WHEN id IS NULL THEN count(*) ELSE count(DISTINCT id) END", "CASE WHEN count(DISTINCT id) = 0 THEN count(*) ELSE count(DISTINCT id) END"),
    "my_memberships": "SELECT c_custkey AS user_id, c_nationkey AS org_id FROM customer WHERE c_nationkey = 3 OR c_custkey = 1",
    "refused_rows": f"WITH {t.EVIDENCE_SQL} SELECT org_id, count(*) AS n FROM n_evidence WHERE org_id <> 7 GROUP BY org_id",
    "stream_volumes": "WITH w AS (SELECT event_type AS source, ts, unnest(range(0, 7)) AS k FROM events), x AS (SELECT source, date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) AS since FROM w) SELECT since, source, count(*) AS n FROM x WHERE since + INTERVAL 7 DAY <= TIMESTAMP '2024-01-28' GROUP BY ALL",
    "stream_messages_once": "SELECT DISTINCT event_id // 2 AS message_id FROM events",
    "stream_health": """WITH n AS (SELECT CAST(user_id % CASE WHEN day(ts) < 16 THEN 20 ELSE 40 END AS VARCHAR) AS source, ts FROM events), s AS (SELECT CAST(k AS VARCHAR) AS source, [6, 24, 72, 72][k % 4 + 1] AS budget, k % 7 > 0 AND k % 11 > 0 AS watched FROM range(40) r(k)),
      t AS (SELECT unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts) - INTERVAL 1 DAY), INTERVAL 1 DAY)) AS tick FROM n), f AS (SELECT source, min(ts) AS since FROM n GROUP BY 1),
      v AS (SELECT t.tick, f.source, count(*) FILTER (ts > t.tick - INTERVAL 7 DAY) AS l, count(*) FILTER (ts > t.tick - INTERVAL 14 DAY AND ts <= t.tick - INTERVAL 7 DAY) AS p, max(ts) AS last_at FROM t JOIN f ON f.since <= t.tick JOIN n ON n.source = f.source AND n.ts <= t.tick GROUP BY ALL),
      g AS (SELECT tick, source, CASE WHEN NOT watched THEN 'green' WHEN epoch_us(tick) - epoch_us(last_at) > budget * 3600000000 THEN 'silent' WHEN p >= 20 AND (p - l) / p::DOUBLE > 0.4 THEN 'degraded' ELSE 'green' END AS verdict FROM v JOIN s USING (source)),
      h AS (SELECT *, lag(verdict, 1, 'green') OVER (PARTITION BY source ORDER BY tick) AS health FROM g) SELECT source, CAST(tick AS TIMESTAMP) AS at, health, verdict FROM h WHERE verdict <> health AND verdict <> 'green'""",
    "notice_upsert": ingest.W_RAW + ", m AS (SELECT *, (SELECT max(event_id) FROM n_raw) AS most FROM n_raw), b AS (SELECT *, 1 AS batch FROM m WHERE event_id * 3 < 2 * most UNION ALL SELECT *, 2 FROM m WHERE event_id * 3 >= most), l AS (SELECT *, min(batch) OVER (PARTITION BY source, external_id) AS c, max(batch) OVER (PARTITION BY source, external_id) AS u, row_number() OVER (PARTITION BY source, external_id ORDER BY batch DESC, fetched_at DESC, event_id DESC) AS k FROM b) SELECT source, external_id, event_id, content_hash, fetched_at, make_timestamp((1700000000::BIGINT + c) * 1000000) AS created_at, make_timestamp((1700000000::BIGINT + u) * 1000000) AS updated_at FROM l WHERE k = 1",
    "stream_late_duplicates": "WITH " + PLACED_LATE,
}
QUERIES = {f.__name__: f for f in (landed_records, incremental_window, fetch_failures, failed_sources, dimension_upsert, seeded_notices, gold_pairs, outbox_replayed, health_transitions, placed_notices, cluster_audit, match_upsert, identifiers, decoded_names, schema_violations, evidence_list, known_links, resolved_messages, messages_once, my_memberships, refused_rows, stream_volumes, stream_messages_once, notice_upsert, stream_health, stream_deadline_alerts, stream_late_duplicates)}
