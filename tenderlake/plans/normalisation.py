"""Normaliser queries: payloads are built from the tables, normalised, and held against SQL on the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import normalise as n
from ..sources import tables as t
from ..sources.dims import DEPARTMENTS


#: Tasks that rows of much work are dealt to, for each core.
TASKS_A_CORE = 4


def _ted_raw(spark, sf_dir):
    x = t.notices(spark, sf_dir)
    k = F.substring("notice_id", 7, 20).cast("long")
    iso3 = F.create_map(*[F.lit(v) for kv in (("FR", "FRA"), ("BE", "BEL"), ("LU", "LUX"), ("DE", "DEU")) for v in kv])
    day = F.date_format("published_at", "yyyy-MM-dd")
    body = F.struct(
        F.col("notice_id").alias("publication-number"), F.when(k % 2 == 0, F.col("notice_type")).alias("form-type"),
        F.when(F.col("notice_type") == "planning", "pin-only").when(F.col("notice_type") == "result", "can-standard").otherwise("cn-standard").alias("notice-type"),
        F.array(iso3[F.col("country")]).alias("buyer-country"), F.create_map(F.lit("eng"), F.array(F.concat(F.lit(" "), F.col("buyer_name")))).alias("buyer-name"),
        F.create_map(F.lit("deu"), F.lit("Titel"), F.lit("fra"), F.concat(F.lit("France – Services – "), F.col("title"))).alias("notice-title"),
        F.when(F.length("title") > 0, F.create_map(F.lit("fra"), F.array(F.col("title")))).alias("title-lot"),
        F.concat(F.array(iso3[F.col("country")]), F.col("nuts")).alias("place-of-performance"), F.flatten(F.transform("lots", lambda v: v["cpv"])).alias("classification-cpv"),
        F.transform("lots", lambda v: v["lot_id"]).alias("identifier-lot"), F.array(F.col("amount").cast("decimal(18,2)").cast("string")).alias("estimated-value-lot"), F.array(F.lit("EUR")).alias("estimated-value-cur-lot"),
        F.concat(day, F.lit("+02:00")).alias("publication-date"), F.array(F.concat(day, F.lit("+02:00"))).alias("deadline-receipt-tender-date-lot"),
        F.array(F.lit("16:30:00+02:00")).alias("deadline-receipt-tender-time-lot"), F.array(F.lit("open")).alias("procedure-type"), F.lit(1).alias("surprise"),
    )
    return x.select(F.lit("eu-ted").alias("source"), F.col("notice_id").alias("external_id"), F.concat(F.lit("https://ted.europa.eu/en/notice/"), "notice_id").alias("url"), "published_at", F.to_json(body).alias("payload"))


def ted_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = n.ted(_ted_raw(spark, sf_dir))
    return out.select("external_id", "notice_type", "country", "language", "buyer_name", "title", F.array_join("nuts", ",").alias("nuts"), F.size("cpv").alias("n_cpv"), F.size("lots").alias("n_lots"), "amount", "currency", "procedure_type", "published_at", "deadline_at", "version", F.array_join("unmapped_fields", ",").alias("unmapped"))


def _boamp_raw(spark, sf_dir):
    """Two versions of a notice per supplier: eForms, archive or broken data inside, with k % 4 lots, the third without an id."""
    # A small file is one task, and a notice takes milliseconds: suppliers are dealt to all cores first.
    dealt = t.read(spark, sf_dir, "supplier").repartition(TASKS_A_CORE * spark.sparkContext.defaultParallelism, "s_suppkey")
    s = dealt.withColumn("v", F.explode(F.array(F.lit(1), F.lit(2))))
    k, v = F.col("s_suppkey"), F.col("v")
    pick = lambda vs: F.element_at(F.array(*[F.lit(x) for x in vs]), (k % len(vs) + 1).cast("int"))
    code = lambda x, name: F.struct(F.lit(name).alias("@listName"), x.alias("#text"))
    digits = lambda n: F.lpad(k.cast("string"), n, "0")

    def lot(i):
        project = F.struct(
            F.create_map(F.lit("eng"), F.lit("Lot"), F.lit("fra"), F.concat(F.lit("Lot &eacute;gal "), i.cast("string"))).alias("cbc:Name"),
            F.struct(F.array(code(F.concat(F.lit("45"), digits(5), i.cast("string")), "cpv"), code(F.lit("12345678"), "other")).alias("cbc:ItemClassificationCode")).alias("cac:MainCommodityClassification"),
            F.struct(F.struct(code(F.concat(F.lit("fr"), i.cast("string")), "nuts").alias("cbc:CountrySubentityCode")).alias("cac:Address")).alias("cac:RealizedLocation"),
        )
        return F.struct(F.when(i != 3, F.struct(F.concat(F.lit("LOT-000"), i.cast("string")).alias("#text"))).alias("cbc:ID"), project.alias("cac:ProcurementProject"))

    party = F.struct(
        F.struct(F.struct(F.lit("FRA").alias("@other"), F.lit("ignored").alias("x")).alias("cbc:Note"), F.concat(F.lit("Syndicat "), "s_name").alias("cbc:Name")).alias("cac:PartyName"),
        F.struct(F.lit("1 rue").alias("cbc:StreetName"), F.lit("69001").alias("cbc:PostalZone"), F.concat(F.lit("Ville "), k.cast("string")).alias("cbc:CityName"), F.struct(F.lit("FRA").alias("cbc:IdentificationCode")).alias("cac:Country")).alias("cac:PostalAddress"),
        F.struct(F.lit("999999999").alias("cbc:CompanyID")).alias("cac:PartyTaxScheme"), F.array(F.struct(F.concat(digits(9), v.cast("string")).alias("cbc:CompanyID")), F.struct(F.concat_ws(" ", F.substring(digits(9), 1, 3), F.substring(digits(9), 4, 6)).alias("cbc:CompanyID"))).alias("cac:PartyLegalEntity"),
        F.struct(F.concat(F.lit("a@"), k.cast("string")).alias("cbc:ElectronicMail")).alias("cac:Contact"),
    )
    notice = F.struct(
        F.struct(party.alias("cac:Party")).alias("cac:ContractingParty"),
        F.struct(F.struct(F.concat(F.lit("Projet "), k.cast("string")).alias("#text"), F.lit("FRA").alias("@languageID")).alias("cbc:Name"), F.concat(F.lit("D&#233;crit "), v.cast("string")).alias("cbc:Description"), F.array(code(F.concat(F.lit("72"), digits(5), v.cast("string")), "cpv")).alias("cbc:ItemClassificationCode")).alias("cac:ProcurementProject"),
        F.when(k % 4 > 0, F.transform(F.sequence(F.lit(1), F.greatest(k % 4, F.lit(1)).cast("int")), lot)).alias("cac:ProcurementProjectLot"),
        F.struct(F.struct(F.lit("EUR").alias("@currencyID"), F.format_string("%.2f", F.abs("s_acctbal")).alias("#text")).alias("cbc:TotalAmount")).alias("cac:Deep"),
    )
    deep = F.to_json(F.struct(F.struct(notice.alias("ContractNotice"), F.struct(F.lit("11111111").alias("cbc:ItemClassificationCode")).alias("SecondNotice")).alias("EFORMS")))
    archive = F.to_json(F.struct(F.struct(F.concat(F.lit("Mairie "), k.cast("string")).alias("DENOMINATION"), F.lit("Lille").alias("VILLE"), F.lit("m@x").alias("MEL"), F.lit("59000").alias("CP")).alias("IDENTITE")))
    body = F.struct(
        F.concat(F.lit("26-"), k.cast("string")).alias("idweb"), F.when(k % 7 > 0, F.concat(F.lit("Travaux &amp;#039;"), F.col("s_name"), F.lit("&#039;  du&nbsp;pont"))).alias("objet"), F.when(k % 2 == 0, F.lit("Communaut&#233; d&#039;Agglo")).alias("nomacheteur"),
        pick(["Avis de marché", "Résultat de marché", "inconnu"]).alias("nature_libelle"), pick(["Ouvert", "Procédure adaptée ouverte", "x"]).alias("procedure_libelle"), F.when(k % 4 == 3, F.array(F.lit("ACME"))).alias("titulaire"),
        F.array((k % 99).cast("string")).alias("code_departement"), F.lit("2026-08-11").alias("dateparution"), F.lit("2026-09-01T12:00:00+02:00").alias("datelimitereponse"), F.array(F.lit("mot"), F.lit("cle")).alias("descripteur_libelle"),
        F.when(k % 5 == 0, "{broken").when(k % 5 == 1, archive).otherwise(deep).alias("donnees"), F.lit("u").alias("inattendu"),
    )
    return s.select(F.lit("fr-boamp").alias("source"), F.concat(F.lit("26-"), k.cast("string")).alias("external_id"), F.lit(None).cast("string").alias("url"), F.to_json(body).alias("payload"))


def boamp_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = n.boamp(_boamp_raw(spark, sf_dir))
    lots = F.array_join(F.transform("lots", lambda x: F.concat_ws(":", x["lot_id"], x["title"], F.array_join(x["cpv"], "+"), F.array_join(x["place_nuts"], "+"))), ",")
    return out.select(
        "external_id", "notice_type", "buyer_name", "title", "description", "siren", "siret", F.col("buyer_address.city").alias("city"), F.col("buyer_address.country").alias("buyer_country"), F.col("buyer_contact.email").alias("email"), lots.alias("lots"),
        F.array_join("cpv", ",").alias("cpv"), F.array_join("nuts", ",").alias("nuts"), "procedure_type", "amount", "currency", "published_at", "deadline_at", F.col("award.supplier_name").alias("supplier"), F.array_join("unmapped_fields", ",").alias("unmapped"),
    )


def _contract(spark, sf_dir):
    x = t.notices(spark, sf_dir)
    k = F.substring("notice_id", 7, 20).cast("long")
    return x.select("notice_id", F.when(k % 13 == 0, "winner").otherwise(F.col("notice_type")).alias("notice_type"), F.when(k % 17 == 0, "FRA").otherwise(F.lower("country")).alias("country"), "title", F.concat_ws(" ", F.substring("buyer_siren", 1, 3), F.substring("buyer_siren", 4, 6)).alias("siren"), F.lit("123").alias("siret"), F.flatten(F.transform("lots", lambda v: F.transform(v["cpv"], lambda c: F.concat(c, F.lit("-1"))))).alias("cpv"), F.array_append("nuts", F.lit("FRA")).alias("nuts"), F.array(F.lit("x")).alias("source_refs"))


def canonical_clean_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = n.quarantine(_contract(spark, sf_dir))
    return good.select("notice_id", "siren_effective", "siret", "country", F.size("cpv").alias("n_cpv"), F.array_join("nuts", ",").alias("nuts"))


def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = n.quarantine(_contract(spark, sf_dir))
    return bad.select("notice_id", F.array_join("violations", ",").alias("violations"))


def offset_date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t.read(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat(day, F.lit("+02:00"))).when(F.col("o_orderkey") % 4 == 1, F.concat(day, F.lit("T09:30:00Z"))).when(F.col("o_orderkey") % 4 == 2, day).otherwise(F.concat(F.lit("le "), day))
    return o.select("o_orderkey", dates.offset_date(text).alias("at"))


def company_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t.read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    body = F.struct(F.lpad(k.cast("string"), 9, "0").alias("siren"), F.col("c_name").alias("nom_complet"), F.lit("62.02a").alias("activite_principale"), F.when(k % 2 == 0, "12").otherwise("99").alias("tranche_effectif_salarie"), F.struct(F.lit("75113").alias("commune"), F.when(k % 3 == 0, "PARIS").alias("libelle_commune"), F.lpad((k % 99).cast("string"), 2, "0").alias("departement")).alias("siege"), F.array(F.struct(F.lit("").alias("nom"), F.lit("x").alias("qualite")), F.struct(F.col("c_mktsegment").alias("nom"), F.lit("y").alias("qualite"))).alias("dirigeants"))
    out = n.company(c.select(F.to_json(body).alias("payload"), F.lit(None).cast("string").alias("requested_siret")))
    return out.select("siren", "legal_name", "naf", "least", "most", "city", "nuts", F.size("executives").alias("n_executives"))


def json_contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 9 == 1, "{oops").otherwise(F.col("props")).alias("raw"))
    out = n.validated(e, "k int", {"k": F.col("parsed.k").between(0, 49)})
    return out.select("event_id", F.array_join("violations", ",").alias("violations"))


W = f"WITH {t.NOTICES_SQL}, x AS (SELECT *, CAST(substr(notice_id, 7) AS BIGINT) AS k, strftime(published_at, '%Y-%m-%d') AS day FROM n_notices)"
SQL = {
    "ted_normalize": W + """ SELECT notice_id AS external_id, notice_type, country, CASE WHEN length(title) > 0 THEN 'fr' END AS language, buyer_name,
      CASE WHEN length(title) BETWEEN 25 AND 180 THEN title WHEN length(title) > 0 THEN title WHEN true THEN 'France – Services –' END AS title, array_to_string(places, ',') AS nuts, CAST(len(list_distinct(codes)) AS INTEGER) AS n_cpv,
      CAST(coalesce(nl, 0) AS INTEGER) AS n_lots, amount, 'EUR' AS currency, 'open' AS procedure_type, CAST(day AS TIMESTAMP) - INTERVAL 2 HOUR AS published_at, CAST(day AS TIMESTAMP) + INTERVAL 14 HOUR + INTERVAL 30 MINUTE AS deadline_at, CAST(1 AS INTEGER) AS version, 'surprise' AS unmapped
      FROM x LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber) AS nl FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey) ON l_orderkey = k""",
    "boamp_normalize": """WITH s AS (SELECT *, s_suppkey AS k, v, s_suppkey % 5 > 1 AS deep, s_suppkey % 5 = 1 AS archive, lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS k5, lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS k9 FROM supplier, range(1, 3) r(v)),
      l AS (SELECT *, CASE WHEN deep THEN list_filter(range(1, k % 4 + 1), lambda i: true) ELSE CAST([] AS BIGINT[]) END AS ks FROM s)
      SELECT '26-' || k AS external_id, CASE k % 3 WHEN 0 THEN 'competition' WHEN 1 THEN 'result' ELSE CASE WHEN k % 4 = 3 THEN 'result' ELSE 'competition' END END AS notice_type,
        CASE WHEN k % 2 = 0 THEN 'Communauté d''Agglo' WHEN deep THEN 'Syndicat ' || s_name WHEN archive THEN 'Mairie ' || k END AS buyer_name,
        CASE WHEN k % 7 > 0 THEN 'Travaux ' || chr(39) || s_name || chr(39) || ' du pont' WHEN deep THEN 'Projet ' || k ELSE 'BOAMP 26-' || k END AS title, CASE WHEN deep THEN 'Décrit ' || v ELSE 'mot, cle' END AS description,
        CASE WHEN deep THEN k9 END AS siren, CAST(NULL AS VARCHAR) AS siret, CASE WHEN deep THEN 'Ville ' || k WHEN archive THEN 'Lille' END AS city, CASE WHEN deep THEN 'FRA' END AS buyer_country, CASE WHEN deep THEN 'a@' || k WHEN archive THEN 'm@x' END AS email,
        coalesce(array_to_string(list_transform(list_filter(ks, lambda i: i <> 3), lambda i: 'LOT-000' || i || ':Lot égal ' || i || ':45' || k5 || i || ':FR' || i), ','), '') AS lots,
        coalesce(array_to_string(list_concat(CASE WHEN deep THEN ['72' || k5 || v] ELSE CAST([] AS VARCHAR[]) END, list_transform(ks, lambda i: '45' || k5 || i)), ','), '') AS cpv,
        coalesce(array_to_string(list_concat(list_transform(ks, lambda i: 'FR' || i), CASE WHEN d.n IS NULL THEN CAST([] AS VARCHAR[]) ELSE [d.n] END), ','), '') AS nuts,
        CASE k % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'open' END AS procedure_type, CASE WHEN deep THEN abs(s_acctbal) END AS amount, CASE WHEN deep THEN 'EUR' END AS currency, TIMESTAMP '2026-08-11' AS published_at, TIMESTAMP '2026-09-01 10:00:00' AS deadline_at,
        CASE WHEN k % 4 = 3 AND k % 3 <> 0 THEN 'ACME' END AS supplier, 'inattendu' AS unmapped FROM l LEFT JOIN (VALUES """
    + ", ".join(f"('{a}', '{b}')" for a, b in sorted(DEPARTMENTS.items()))
    + ") AS d(c, n) ON d.c = CASE WHEN k % 99 < 10 THEN lpad(CAST(k % 99 AS VARCHAR), 2, '0') ELSE CAST(k % 99 AS VARCHAR) END",
    "canonical_clean_ids": W + " SELECT notice_id, buyer_siren AS siren_effective, CAST(NULL AS VARCHAR) AS siret, country, CAST(len(list_distinct(codes)) AS INTEGER) AS n_cpv, array_to_string(places, ',') AS nuts FROM x WHERE k % 13 <> 0 AND k % 17 <> 0 AND length(title) > 0",
    "contract_violations": W + " SELECT notice_id, concat_ws(',', CASE WHEN k % 17 = 0 THEN 'country' END, CASE WHEN k % 13 = 0 THEN 'notice_type' END, CASE WHEN length(title) = 0 THEN 'title' END) AS violations FROM x WHERE k % 13 = 0 OR k % 17 = 0 OR length(title) = 0",
    "offset_date_parse": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS TIMESTAMP) - INTERVAL 2 HOUR WHEN 1 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 570 MINUTE WHEN 2 THEN CAST(o_orderdate AS TIMESTAMP) END AS at FROM orders",
    "company_identity": "SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS siren, c_name AS legal_name, '6202A' AS naf, CAST(CASE WHEN c_custkey % 2 = 0 THEN 20 END AS INTEGER) AS least, CAST(CASE WHEN c_custkey % 2 = 0 THEN 49 END AS INTEGER) AS most, CASE WHEN c_custkey % 3 = 0 THEN 'PARIS' END AS city, d.n AS nuts, CAST(1 AS INTEGER) AS n_executives FROM customer LEFT JOIN (VALUES "
    + ", ".join(f"('{a}', '{b}')" for a, b in sorted(DEPARTMENTS.items()))
    + ") AS d(c, n) ON d.c = lpad(CAST(c_custkey % 99 AS VARCHAR), 2, '0')",
    "json_contract_check": "SELECT event_id, CASE WHEN event_id % 9 = 1 THEN 'not json' WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) NOT BETWEEN 0 AND 49 THEN 'k' ELSE '' END AS violations FROM events",
}
QUERIES = {f.__name__: f for f in (ted_normalize, boamp_normalize, canonical_clean_ids, contract_violations, offset_date_parse, company_identity, json_contract_check)}
