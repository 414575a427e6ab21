"""The driver's tables, and frames of notices, profiles and so on derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dims import SECTOR_PACKS

#: Clocks of the frames over orders and over events.
NOW_O, NOW_E = "1998-06-01 00:00:00", "2024-01-31 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now_o():
    return F.lit(NOW_O).cast("timestamp")


def now_e():
    return F.lit(NOW_E).cast("timestamp")


def _pick(values: list, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A notice per order: its customer is the buyer, its lines are the lots."""
    orders, customer, lines, part = (read(spark, sf_dir, t) for t in ("orders", "customer", "lineitem", "part"))
    kind = F.create_map(*[F.lit(x) for kv in (("ECONOMY", "72"), ("SMALL", "48"), ("LARGE", "30"), ("STANDARD", "80"), ("PROMO", "50"), ("MEDIUM", "90")) for x in kv])
    code = F.concat(kind[F.col("p_type")], F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"))
    lot = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), code.alias("c"), F.col("p_name").alias("t"))
    lots = lines.join(part, lines["l_partkey"] == part["p_partkey"]).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(lot)).alias("_lots"))
    k = F.col("o_orderkey")
    n = F.col("c_nationkey")
    nuts = [["FR10"], ["FR101"], ["FRK2"], ["BE10"], [], ["LU00"]]
    empty = F.array().cast("array<string>")
    rows = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(lots, orders["o_orderkey"] == lots["l_orderkey"], "left")
    made = F.coalesce(F.transform("_lots", lambda x: F.struct(F.concat(F.lit("LOT-"), F.lpad(x["n"].cast("string"), 4, "0")).alias("lot_id"), x["t"].alias("title"), F.array(x["c"]).alias("cpv"), empty.alias("place_nuts"))), F.array().cast("array<struct<lot_id:string,title:string,cpv:array<string>,place_nuts:array<string>>>"))
    return rows.select(
        F.concat(F.lit("ntc_o_"), k.cast("string")).alias("notice_id"),
        F.when(F.col("o_orderstatus") == "O", "competition").when(F.col("o_orderstatus") == "F", "result").otherwise("planning").alias("notice_type"),
        _pick(["FR", "BE", "LU", "DE", "FR"], n % 5).alias("country"),
        F.element_at(F.array(*[F.array(*[F.lit(z) for z in zs]).cast("array<string>") for zs in nuts]), (n % 6 + 1).cast("int")).alias("nuts"),
        F.col("c_name").alias("buyer_name"),
        F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("buyer_siren"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform("_lots", lambda x: x["t"]))), " "), F.lit("")).alias("title"),
        F.lit(None).cast("string").alias("description"),
        empty.alias("cpv"),
        made.alias("lots"),
        F.when(k % 10 != 0, F.col("o_totalprice")).alias("amount"),
        F.when(k % 11 != 0, F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (k % 24) * F.lit(3_600_000_000))).alias("deadline_at"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "open").when(F.col("o_orderpriority") == "2-HIGH", "restricted").when(F.col("o_orderpriority") == "3-MEDIUM", "negotiated").when(F.col("o_orderpriority") == "5-LOW", "adapted").alias("procedure_type"),
        F.col("o_orderdate").cast("timestamp").alias("published_at"),
    )


NOTICES_SQL = """
lots_ AS (SELECT l_orderkey, list({'n': l_linenumber, 'p': l_partkey, 'c': CASE p_type WHEN 'ECONOMY' THEN '72' WHEN 'SMALL' THEN '48' WHEN 'LARGE' THEN '30' WHEN 'STANDARD' THEN '80' WHEN 'PROMO' THEN '50' ELSE '90' END
    || lpad(CAST(p_size AS VARCHAR), 2, '0') || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0'), 't': p_name} ORDER BY l_linenumber, l_partkey) AS lots FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
n_notices AS (SELECT 'ntc_o_' || o_orderkey AS notice_id, CASE o_orderstatus WHEN 'O' THEN 'competition' WHEN 'F' THEN 'result' ELSE 'planning' END AS notice_type,
    ['FR', 'BE', 'LU', 'DE', 'FR'][c_nationkey % 5 + 1] AS country, [['FR10'], ['FR101'], ['FRK2'], ['BE10'], CAST([] AS VARCHAR[]), ['LU00']][c_nationkey % 6 + 1] AS places,
    c_name AS buyer_name, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS buyer_siren,
    coalesce(array_to_string(list_sort(list_distinct(list_transform(lots, lambda x: x.t))), ' '), '') AS title,
    coalesce(list_transform(lots, lambda x: x.c), CAST([] AS VARCHAR[])) AS codes,
    CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS amount, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INTEGER)) END AS deadline_at,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'open' WHEN '2-HIGH' THEN 'restricted' WHEN '3-MEDIUM' THEN 'negotiated' WHEN '5-LOW' THEN 'adapted' END AS procedure_type,
    CAST(o_orderdate AS TIMESTAMP) AS published_at
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lots_ ON l_orderkey = o_orderkey)
"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The watch profiles: one for each sector pack, one for each supplier."""
    strings = "array<string>"
    none = F.array().cast(strings)
    k = F.col("s_suppkey")
    fams = ["72", "48", "30", "80", "50", "90"]
    when = lambda c, *vs: F.when(c, F.array(*[F.lit(v) for v in vs])).otherwise(none)
    own = read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("wp_"), k.cast("string")).alias("profile_id"), F.concat(F.lit("org_"), k.cast("string")).alias("org_id"),
        F.array(_pick(fams, k % 6), F.concat(_pick(fams, (k + 1) % 6), F.lit("*"))).alias("cpv_families"),
        F.concat(F.array(F.lit("FR")), when(k % 3 == 0, "BE")).alias("countries"),
        F.concat(when(k % 4 == 0, "FR10"), when(k % 4 == 1, "FRK2", "BE10")).alias("nuts_filter"),
        F.concat(when(k % 4 == 0, "FR10"), when(k % 4 == 1, "FRK2", "BE10"), when(k % 4 == 2, "FR1")).alias("zones_nuts"),
        (k % 5 == 0).alias("national"),
        F.when(k % 2 == 0, F.lit(7)).alias("min_days_to_deadline"),
        F.lit(20000.0).alias("amount_min"), F.when(k % 7 == 0, F.lit(300000.0)).alias("amount_max"),
        when(k % 3 == 1, "open", "restricted").alias("procedure_types"), F.array(F.lit("competition")).alias("notice_types"),
        F.array(_pick(["widget", "bolt", "ring"], k % 3), F.lit("gear")).alias("keywords"),
        when(k % 9 == 0, "anvil").alias("keywords_exclude"), when(k % 8 == 0, "widget", "gizmo").alias("keywords_include"),
        (200000 + 100 * F.abs("s_acctbal")).alias("annual_revenue"),
        when(k % 2 == 1, "ISO 9001").alias("certifications"), F.array(F.lpad((k * 3).cast("string"), 9, "0")).alias("known_buyer_sirens"),
    )
    packs = [(f"pack_{name}", f"org_{name}", list(p["cpv_families"]), ["FR"], [], [], True, 7, None, None, [], ["competition"], list(p["keywords"]), [], [], None, [], []) for name, p in SECTOR_PACKS.items()]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in own.schema])
    return own.unionByName(spark.createDataFrame(packs, schema))


def profiles_sql() -> str:
    lst = lambda v: "CAST([" + ", ".join("'" + x.replace("'", "''") + "'" for x in v) + "] AS VARCHAR[])"
    packs = " UNION ALL ".join(f"SELECT 'pack_{n}', 'org_{n}', {lst(p['cpv_families'])}, ['FR'], {lst([])}, {lst([])}, true, 7, NULL, NULL, {lst([])}, ['competition'], {lst(p['keywords'])}, {lst([])}, {lst([])}, NULL, {lst([])}, {lst([])}" for n, p in SECTOR_PACKS.items())
    none = lst([])
    return f"""
n_profiles AS (SELECT 'wp_' || s_suppkey AS profile_id, 'org_' || s_suppkey AS org_id, [['72','48','30','80','50','90'][s_suppkey % 6 + 1], ['72','48','30','80','50','90'][(s_suppkey + 1) % 6 + 1] || '*'] AS cpv_families,
    list_concat(['FR'], CASE WHEN s_suppkey % 3 = 0 THEN ['BE'] ELSE {none} END) AS countries,
    CASE s_suppkey % 4 WHEN 0 THEN ['FR10'] WHEN 1 THEN ['FRK2', 'BE10'] ELSE {none} END AS nuts_filter,
    CASE s_suppkey % 4 WHEN 0 THEN ['FR10'] WHEN 1 THEN ['FRK2', 'BE10'] WHEN 2 THEN ['FR1'] ELSE {none} END AS zones_nuts,
    s_suppkey % 5 = 0 AS national, CASE WHEN s_suppkey % 2 = 0 THEN 7 END AS min_days_to_deadline, 20000.0::DOUBLE AS amount_min, CASE WHEN s_suppkey % 7 = 0 THEN 300000.0::DOUBLE END AS amount_max,
    CASE WHEN s_suppkey % 3 = 1 THEN ['open', 'restricted'] ELSE {none} END AS procedure_types, ['competition'] AS notice_types, [['widget', 'bolt', 'ring'][s_suppkey % 3 + 1], 'gear'] AS keywords,
    CASE WHEN s_suppkey % 9 = 0 THEN ['anvil'] ELSE {none} END AS keywords_exclude, CASE WHEN s_suppkey % 8 = 0 THEN ['widget', 'gizmo'] ELSE {none} END AS keywords_include,
    200000 + 100 * abs(s_acctbal) AS annual_revenue, CASE WHEN s_suppkey % 2 = 1 THEN ['ISO 9001'] ELSE {none} END AS certifications, [lpad(CAST(s_suppkey * 3 AS VARCHAR), 9, '0')] AS known_buyer_sirens
  FROM supplier UNION ALL {packs})
"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw notice per event."""
    from ..functions.ids import content_hash

    return read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("external_id"), F.col("props").alias("payload"), content_hash(F.col("props")).alias("content_hash"), F.col("ts").cast("timestamp").alias("fetched_at"))


RAW_SQL = "n_raw AS (SELECT event_id, event_type AS source, CAST(user_id AS VARCHAR) AS external_id, props AS payload, sha256(replace(props, ' ', '')) AS content_hash, ts AS fetched_at FROM events)"


def sources(spark: SparkSession) -> DataFrame:
    """The source registry of the events: five sources."""
    rows = [("signup", "official_api", "*/15 * * * *", "open-license", True, "green"), ("purchase", "platform", "0 */6 * * *", "tos-reviewed", True, "green"), ("click", "long_tail", "0 3 * * *", "robots-ok", True, "degraded"), ("view", "signals", None, "open-license", True, "green"), ("error", "long_tail", "0 3 * * *", "unknown", False, "silent")]
    return spark.createDataFrame(rows, "source string, tier string, schedule string, legal_basis string, enabled boolean, health string")


SOURCES_SQL = "n_sources AS (SELECT * FROM (VALUES ('signup', 'official_api', '*/15 * * * *', 'open-license', true, 'green'), ('purchase', 'platform', '0 */6 * * *', 'tos-reviewed', true, 'green'), ('click', 'long_tail', '0 3 * * *', 'robots-ok', true, 'degraded'), ('view', 'signals', NULL, 'open-license', true, 'green'), ('error', 'long_tail', '0 3 * * *', 'unknown', false, 'silent')) AS t(source, tier, schedule, legal_basis, enabled, health))"


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A publication per document: the first line of its text is the title, the whole text the description."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("description"), "source", F.col("lang").alias("country"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per turn of a conversation."""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), "text")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A piece of evidence per order line."""
    return read(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("evidence_id"), F.col("l_suppkey").alias("org_id"), F.col("l_returnflag").alias("kind"), F.to_date("l_shipdate").alias("expires_at"), F.when(F.col("l_linestatus") == "F", "valid").otherwise("expiring").alias("status"))


EVIDENCE_SQL = "n_evidence AS (SELECT concat_ws('-', l_orderkey, l_linenumber) AS evidence_id, l_suppkey AS org_id, l_returnflag AS kind, CAST(l_shipdate AS DATE) AS expires_at, CASE WHEN l_linestatus = 'F' THEN 'valid' ELSE 'expiring' END AS status FROM lineitem)"


def tenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tender per order, by its customer's nation as org."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    k = F.col("o_orderkey")
    deadline = F.when(k % 11 != 0, F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (k % 24) * F.lit(3_600_000_000)))
    stage = F.when(F.col("o_orderstatus") == "O", "analysis").when(F.col("o_orderstatus") == "P", "drafting").otherwise("submitted")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(k.alias("tender_id"), F.col("c_nationkey").alias("org_id"), stage.alias("stage"), deadline.alias("deadline_at"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


TENDERS_SQL = "n_tenders AS (SELECT o_orderkey AS tender_id, c_nationkey AS org_id, CASE o_orderstatus WHEN 'O' THEN 'analysis' WHEN 'P' THEN 'drafting' ELSE 'submitted' END AS stage, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INTEGER)) END AS deadline_at, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM orders JOIN customer ON o_custkey = c_custkey)"


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A notification per event, about the tender of its number."""
    kind = F.create_map(*[F.lit(x) for kv in (("signup", "deadline.j14"), ("purchase", "deadline.j7"), ("click", "deadline.j3"), ("view", "deadline.j1"), ("error", "deadline.escalated")) for x in kv])
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("notification_id"), (F.col("user_id") % 25).cast("int").alias("org_id"), kind[F.col("event_type")].alias("kind"), (F.col("event_id") % 5000).alias("tender_id"), F.col("ts").cast("timestamp").alias("created_at"), F.when(F.col("value") >= 5, F.col("ts").cast("timestamp")).alias("sent_at"), F.when(F.col("value") >= 20, F.col("ts").cast("timestamp")).alias("acknowledged_at"))


NOTIFICATIONS_SQL = "n_notifications AS (SELECT event_id AS notification_id, CAST(user_id % 25 AS INTEGER) AS org_id, CASE event_type WHEN 'signup' THEN 'deadline.j14' WHEN 'purchase' THEN 'deadline.j7' WHEN 'click' THEN 'deadline.j3' WHEN 'view' THEN 'deadline.j1' ELSE 'deadline.escalated' END AS kind, event_id % 5000 AS tender_id, ts AS created_at, CASE WHEN value >= 5 THEN ts END AS sent_at, CASE WHEN value >= 20 THEN ts END AS acknowledged_at FROM events)"


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("org_id"), F.col("event_type").alias("feature"), F.get_json_object("props", "$.k").cast("long").alias("tokens_in"), F.floor("value").cast("long").alias("tokens_out"), F.col("ts").cast("timestamp").alias("at"))


USAGE_SQL = "n_usage AS (SELECT user_id AS org_id, event_type AS feature, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens_in, CAST(floor(value) AS BIGINT) AS tokens_out, ts AS at_ FROM events)"


def awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An award per order line."""
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    months = F.expr("nullif(cast(l_quantity as int) % 25, 0)")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("award_id"), F.col("o_custkey").alias("buyer"), F.col("l_suppkey").alias("supplier"), F.col("l_extendedprice").alias("amount"), F.to_date("l_shipdate").alias("signed_at"), months.alias("duration_months"))


AWARDS_SQL = "n_awards AS (SELECT concat_ws('-', l_orderkey, l_linenumber) AS award_id, o_custkey AS buyer, l_suppkey AS supplier, l_extendedprice AS amount, CAST(l_shipdate AS DATE) AS signed_at, nullif(CAST(l_quantity AS INTEGER) % 25, 0) AS duration_months FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
