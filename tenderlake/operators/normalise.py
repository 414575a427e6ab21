"""Raw payloads to canonical records: two notice feeds and a company registry."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import offset_date, plain_instant, split_deadline
from ..functions.ids import content_hash
from ..sources.dims import COUNTRIES, DEPARTMENTS, EMPLOYEE_BANDS, LANGUAGES, map_column
from . import nodes as nd
from .documents import all_clean, clean_text

STRINGS = "array<string>"
# Field names and codes of the two feeds.
TED_FIELDS = (
    "publication-number", "notice-title", "buyer-name", "buyer-country", "organisation-name-buyer", "organisation-country-buyer", "publication-date", "deadline-receipt-request",
    "deadline-receipt-tender-date-lot", "deadline-receipt-tender-time-lot", "classification-cpv", "place-of-performance", "notice-type", "procedure-type", "contract-nature",
    "estimated-value-lot", "estimated-value-cur-lot", "description-lot", "description-proc", "title-lot", "identifier-lot", "notice-identifier", "notice-version", "form-type",
    "official-language", "links",
)
TED_FORMS = {"planning": "planning", "competition": "competition", "result": "result", "dir-awa-pre": "result", "cont-modif": "result"}
TED_PREFIXES = (("pin", "planning"), ("cn", "competition"), ("can", "result"), ("veat", "result"))
TED_PROCEDURES = {"open": "open", "restricted": "restricted", "neg-w-call": "negotiated", "neg-wo-call": "negotiated", "negotiated": "negotiated", "comp-dial": "competitive-dialogue", "innovation": "innovation-partnership", "oth-single": "other", "oth-mult": "other"}
BOAMP_TYPES = {
    "avis de marché": "competition", "avis de marche": "competition", "avis d'attribution": "result", "avis d attribution": "result", "résultat de marché": "result", "resultat de marche": "result",
    "avis de pré-information": "planning", "avis de pre-information": "planning", "avis de préinformation": "planning", "programme prévisionnel": "planning",
}
BOAMP_PROCEDURES = {
    "ouvert": "open", "appel d'offres ouvert": "open", "restreint": "restricted", "appel d'offres restreint": "restricted", "négocié": "negotiated", "procédure négociée": "negotiated",
    "concurrentielle avec négociation": "negotiated", "dialogue compétitif": "competitive-dialogue", "procédure adaptée": "adapted", "adapté": "adapted", "mapa": "adapted",
}
BOAMP_FIELDS = (
    "idweb", "objet", "nomacheteur", "datelimitereponse", "dateparution", "datefindiffusion", "code_departement", "code_departement_prestation", "descripteur_code", "descripteur_libelle",
    "famille", "famille_libelle", "nature", "nature_libelle", "nature_categorise", "nature_categorise_libelle", "procedure_libelle", "procedure_categorise", "type_procedure",
    "soustype_procedure", "sousnature", "sousnature_libelle", "type_avis", "type_marche", "type_marche_facette", "url_avis", "titulaire", "donnees", "dc", "id", "etat", "filename",
    "gestion", "perimetre", "source_schema", "annonce_lie", "annonces_anterieures", "contractfolderid", "criteres", "marche_public_simplifie", "marche_public_simplifie_label",
)
LANGUAGE_ORDER = ("fra", "eng", "nld", "deu")
TITLE_LEAST, TITLE_MOST = 25, 180


def field(payload: Column, key: str) -> Column:
    return F.get_json_object(payload, f"$['{key}']")


def blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first(c: Column) -> Column:
    """N-03. The first of a list, or the scalar itself; an empty list is null."""
    return F.when(c.startswith("["), F.get(F.from_json(c, STRINGS), F.lit(0))).otherwise(c)


def strings(c: Column) -> Column:
    """N-04. Trimmed, blanks dropped, distinct in order; a scalar is a list of one, null an empty one."""
    listed = F.when(c.startswith("["), F.from_json(c, STRINGS)).when(c.isNotNull(), F.array(c)).otherwise(F.array().cast(STRINGS))
    return F.array_distinct(F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False))))


def country2(c: Column) -> Column:
    """N-06."""
    u = F.upper(F.trim(c))
    return F.when(u.rlike("^[A-Z]{2}$"), u).otherwise(map_column(COUNTRIES)[u])


def lang2(c: Column) -> Column:
    """N-06."""
    low = F.lower(F.trim(c))
    return F.when(F.length(low) == 2, low).otherwise(map_column(LANGUAGES)[low])


def by_language(c: Column) -> Column:
    """A map by language, if the text is one. Computed as a column of its own, it is parsed once for all lookups."""
    return F.from_json(F.when(c.startswith("{"), c), "map<string,string>")


def pick_lang(c: Column, prefer: Column, by_lang: Column | None = None) -> Column:
    """N-05. Text of a string, list or map by language: the preferred one by either code, then the fixed order, then any."""
    text = lambda x: F.when(x.startswith("["), F.get(F.filter(F.transform(F.from_json(x, STRINGS), lambda y: F.trim(y)), lambda y: F.coalesce(y != "", F.lit(False))), F.lit(0))).otherwise(blank(x))
    m = by_language(c) if by_lang is None else by_lang
    wide = F.map_keys(F.map_filter(map_column(LANGUAGES), lambda _, v: v == prefer))
    keys = [prefer, F.get(wide, F.lit(0)), F.get(wide, F.lit(1)), *map(F.lit, LANGUAGE_ORDER)]
    others = F.get(F.filter(F.transform(F.map_values(m), text), lambda x: x.isNotNull()), F.lit(0))
    return F.when(m.isNotNull(), F.coalesce(*[text(m[k]) for k in keys], others)).otherwise(text(c))


def amount(c: Column) -> Column:
    """N-13. A number of the first value; booleans and other text are null."""
    return first(c).try_cast("double")


def ted(raw: DataFrame, *, default_country: str | None = None) -> DataFrame:
    """N-01. Canonical notices of TED payloads: rows of source, external_id, url, fetched_at, payload."""
    p = F.col("payload")
    f = lambda k: F.col("_fields")[k]
    keys = lambda k: F.map_keys(F.col(f"_by {k}"))
    only = lambda k: F.when(F.size(keys(k)) == 1, lang2(F.get(keys(k), F.lit(0))))
    picked = lambda k: pick_lang(f(k), F.col("language"), F.col(f"_by {k}"))
    # The payload is parsed once, and so is each field that may be a map by language.
    rows = raw.withColumn("_fields", F.from_json(p, "map<string,string>"))
    rows = rows.withColumns({f"_by {k}": by_language(f(k)) for k in ("title-lot", "notice-title", "buyer-name", "organisation-name-buyer", "description-lot", "description-proc")})
    rows = rows.withColumn("language", F.coalesce(lang2(first(f("official-language"))), only("title-lot"), only("description-lot")))
    rows = rows.withColumns({"_places": strings(f("place-of-performance")), "_lot": picked("title-lot"), "_title": picked("notice-title")})
    three = F.filter("_places", lambda x: x.rlike("^[A-Za-z]{3}$"))
    prefix = F.filter("_places", lambda x: x.rlike("^[A-Za-z]{2}"))
    # The first three-letter place decides, known or not.
    placed = F.when(F.size(three) > 0, map_column(COUNTRIES)[F.upper(F.get(three, F.lit(0)))]).otherwise(F.upper(F.substring(F.get(prefix, F.lit(0)), 1, 2)))
    parts = F.split("_title", " – ")
    stripped = F.when(F.size(parts) >= 3, blank(F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), " – ")))
    title = F.when(F.length("_lot").between(TITLE_LEAST, TITLE_MOST), F.col("_lot")).otherwise(F.coalesce(stripped, "_title", "_lot", F.concat(F.lit("TED "), F.col("external_id"))))
    kind = F.lower(F.coalesce(first(f("notice-type")), F.lit("")))
    by_prefix = F.coalesce(*[F.when(kind.startswith(a), b) for a, b in TED_PREFIXES], F.lit("competition"))
    ids = F.array_distinct(F.filter(F.from_json(f("identifier-lot"), STRINGS), lambda x: x.isNotNull()))
    values, currencies = F.from_json(f("estimated-value-lot"), STRINGS), F.from_json(f("estimated-value-cur-lot"), STRINGS)
    lots = F.transform(F.coalesce(ids, F.array().cast(STRINGS)), lambda x, i: F.struct(x.alias("lot_id"), F.col("_lot").alias("title"), F.get(values, i).try_cast("double").alias("amount_est"), F.get(currencies, i).alias("currency")))
    xml = F.map_values(F.from_json(F.get_json_object(f("links"), "$.xml"), "map<string,string>"))
    known = F.array(*[F.lit(k) for k in TED_FIELDS])
    return rows.select(
        "source", "external_id", F.coalesce(map_column(TED_FORMS)[F.lower(first(f("form-type")))], by_prefix).alias("notice_type"),
        F.coalesce(country2(first(f("buyer-country"))), country2(first(f("organisation-country-buyer"))), placed, F.lit(default_country)).alias("country"), "language",
        F.coalesce(picked("buyer-name"), picked("organisation-name-buyer")).alias("buyer_name"), title.alias("title"),
        F.coalesce(picked("description-lot"), picked("description-proc")).alias("description"),
        strings(f("classification-cpv")).alias("cpv"), F.filter("_places", lambda x: ~x.rlike("^[A-Za-z]{3}$")).alias("nuts"),
        map_column(TED_PROCEDURES)[first(f("procedure-type"))].alias("procedure_type"), F.filter(strings(f("contract-nature")), lambda x: x.isin("works", "supplies", "services")).alias("contract_nature"),
        lots.alias("lots"), amount(f("estimated-value-lot")).alias("amount"), first(f("estimated-value-cur-lot")).alias("currency"), offset_date(first(f("publication-date"))).alias("published_at"),
        F.coalesce(split_deadline(first(f("deadline-receipt-tender-date-lot")), first(f("deadline-receipt-tender-time-lot"))), offset_date(first(f("deadline-receipt-request")))).alias("deadline_at"),
        F.col("url").alias("notice_url"), F.get(xml, F.lit(0)).alias("documents_url"), F.coalesce(first(f("notice-version")).try_cast("int"), F.lit(1)).alias("version"),
        content_hash(p).alias("content_hash"), F.array_sort(F.array_except(F.map_keys("_fields"), known)).alias("unmapped_fields"), F.lit("ted@1.1.0").alias("adapter"),
    )


def department_nuts(c: Column) -> Column:
    """N-20."""
    code = F.upper(F.trim(c))
    return map_column(DEPARTMENTS)[F.when(code.rlike("^[0-9]$"), F.lpad(code, 2, "0")).otherwise(code)]


def _picked(nodes: Column) -> Column:
    """The first text of names or descriptions, in French if there is a choice."""
    return F.get(F.filter(F.transform(nodes, lambda x: pick_lang(x["value"], F.lit("fr"))), lambda v: v.isNotNull()), F.lit(0))


def _lots(nodes: Column) -> Column:
    """N-29. Lots that have an id, in document order; codes and places are those of the lot's own projects."""

    def lot(x):
        projects = nd.children(nodes, x["ord"], nd.PROJECT)
        inside = nd.within(nodes, projects)
        text = lambda key: _picked(nd.children(nodes, F.get(projects, F.lit(0))["ord"], key))
        return F.struct(nd.text_at(nodes, x["ord"], "cbc:ID").alias("lot_id"), text("cbc:Name").alias("title"), text("cbc:Description").alias("description"), nd.cpv_codes(inside).alias("cpv"), nd.nuts_codes(inside).alias("place_nuts"))

    return F.filter(F.transform(nd.swept(nodes, nd.LOT), lot), lambda x: x["lot_id"].isNotNull())


def boamp(raw: DataFrame) -> DataFrame:
    """N-02. Canonical notices of BOAMP payloads; the embedded eForms text may be missing or broken, flat fields then stand
    alone. Every row is worked on by itself: versions of a notice are rows of their own, and nothing is shuffled."""
    p = F.col("payload")
    f = lambda k: F.col("_fields")[k]
    n, donnees = F.col("_nodes"), f("donnees")
    legacy = lambda k: F.get_json_object(donnees, f"$.IDENTITE.{k}")
    rows = raw.withColumn("_fields", F.from_json(p, "map<string,string>")).withColumn("_nodes", nd.nodes(donnees))
    rows = rows.withColumns({"_project": nd.child(n, F.lit(0), nd.PROJECT), "_party": nd.child(n, F.get(nd.swept(n, nd.PARTY), F.lit(0))["ord"], "cac:Party"), "_ids": nd.company_ids(n), "_lots": _lots(n)})
    rows = rows.withColumns({"_postal": nd.child(n, F.col("_party"), "cac:PostalAddress"), "_contact": nd.child(n, F.col("_party"), "cac:Contact"), "_archive": F.coalesce(F.get_json_object(donnees, "$.IDENTITE").startswith("{"), F.lit(False))})
    at = lambda place, *keys: nd.text_at(n, F.col(place), *keys)
    contact = {"email": at("_contact", "cbc:ElectronicMail"), "phone": at("_contact", "cbc:Telephone"), "website": F.when(F.col("_contact").isNotNull(), at("_party", "cbc:WebsiteURI"))}
    address = {"street": at("_postal", "cbc:StreetName"), "postcode": at("_postal", "cbc:PostalZone"), "city": at("_postal", "cbc:CityName"), "nuts": at("_postal", nd.PLACE), "country": at("_postal", "cac:Country", "cbc:IdentificationCode")}
    # An archive record's own mail and address stand in where there are none.
    by_mail, by_place = F.col("_archive") & contact["email"].isNull() & (legacy("MEL") != ""), F.col("_archive") & address["city"].isNull()
    old_contact, old_address = {"email": legacy("MEL"), "phone": F.coalesce(F.nullif(legacy("TEL"), F.lit("")), contact["phone"])}, {"street": legacy("ADRESSE"), "postcode": legacy("CP"), "city": legacy("VILLE")}
    merged = lambda cond, old, new: F.struct(*[F.when(cond, old.get(k)).otherwise(v).alias(k) if k in old else F.when(~F.coalesce(cond, F.lit(False)), v).alias(k) for k, v in new.items()])
    labels = [F.lower(F.trim(f(k))) for k in ("nature_libelle", "nature_categorise_libelle", "sousnature_libelle")]
    holder = f("titulaire")
    named = F.coalesce(holder != "", F.lit(False)) & F.coalesce(~holder.isin("[]", "null"), F.lit(False))
    kind = F.coalesce(*[map_column(BOAMP_TYPES)[c] for c in labels], F.when(named, "result"), F.lit("competition"))

    def procedure(c):
        low = F.lower(F.trim(c))
        return F.coalesce(map_column(BOAMP_PROCEDURES)[low], *[F.when(F.contains(low, F.lit(k)), v) for k, v in BOAMP_PROCEDURES.items()])

    depts = F.when(F.size(strings(f("code_departement_prestation"))) > 0, strings(f("code_departement_prestation"))).otherwise(strings(f("code_departement")))
    nuts = F.array_union(nd.nuts_codes(n), F.array_compact(F.transform(depts, department_nuts)))
    one = first(holder)
    supplier = F.when(one.startswith("{"), F.coalesce(F.get_json_object(one, "$.denomination"), F.get_json_object(one, "$.nom"), F.get_json_object(one, "$.DENOMINATION"))).otherwise(one)
    siret = F.regexp_replace(F.coalesce(F.get_json_object(one, "$.siret"), F.get_json_object(one, "$.SIRET")), "[^0-9]", "")
    url = F.coalesce("url", f("url_avis"))
    known = F.array(*[F.lit(k) for k in BOAMP_FIELDS])
    project = lambda key: _picked(nd.children(n, F.col("_project"), key))
    name = F.coalesce(F.nullif(f("nomacheteur"), F.lit("")), _picked(nd.children(n, nd.child(n, F.col("_party"), "cac:PartyName"), "cbc:Name")), legacy("DENOMINATION"))
    lot_texts = lambda k: all_clean(F.transform("_lots", lambda x: x[k]))
    rows = rows.withColumns({"_titles": lot_texts("title"), "_texts": lot_texts("description"), "_contacts": merged(by_mail, old_contact, contact), "_address": merged(by_place, old_address, address)})
    lots = F.transform("_lots", lambda x, i: F.struct(x["lot_id"].alias("lot_id"), F.get("_titles", i).alias("title"), F.get("_texts", i).alias("description"), x["cpv"].alias("cpv"), x["place_nuts"].alias("place_nuts")))
    return rows.select(
        "source", "external_id", kind.alias("notice_type"), F.lit("FR").alias("country"), F.lit("fr").alias("language"),
        clean_text(name).alias("buyer_name"), nd.first_of_length(F.col("_ids"), 9).alias("siren"), nd.first_of_length(F.col("_ids"), 14).alias("siret"),
        F.col("_address.city").alias("buyer_city"), F.col("_address").alias("buyer_address"), F.col("_contacts").alias("buyer_contact"),
        F.coalesce(clean_text(f("objet")), clean_text(project("cbc:Name")), F.concat(F.lit("BOAMP "), F.col("external_id"))).alias("title"),
        F.coalesce(clean_text(project("cbc:Description")), F.nullif(F.array_join(strings(f("descripteur_libelle")), ", "), F.lit(""))).alias("description"),
        nd.cpv_codes(n).alias("cpv"), nuts.alias("nuts"), lots.alias("lots"),
        F.coalesce(procedure(f("procedure_libelle")), procedure(f("type_procedure")), procedure(f("soustype_procedure"))).alias("procedure_type"), nd.first_amount(n).alias("amount"), nd.first_currency(n).alias("currency"),
        plain_instant(f("dateparution")).alias("published_at"), plain_instant(f("datelimitereponse")).alias("deadline_at"), F.lit("Europe/Paris").alias("tz"),
        F.when(f("url_avis").isNotNull(), F.array(F.struct(F.lit("other").alias("kind"), F.lit("Avis BOAMP").alias("title"), f("url_avis").alias("url")))).otherwise(F.array().cast("array<struct<kind:string,title:string,url:string>>")).alias("documents"),
        F.when((kind == "result") & named, F.struct(clean_text(supplier).alias("supplier_name"), F.when(F.length(siret) >= 9, F.substring(siret, 1, 9)).alias("supplier_siren"))).alias("award"),
        url.alias("notice_url"), content_hash(p).alias("content_hash"), F.array_sort(F.array_except(F.map_keys("_fields"), known)).alias("unmapped_fields"), F.lit("boamp@1.0.0").alias("adapter"),
    )


def cleaned(rows: DataFrame) -> DataFrame:
    """N-32. Identifiers, codes and places in canonical form, and violations (N-33) of what can't be."""
    digits = lambda c: F.regexp_replace(F.col(c), "[^0-9]", "")
    fixed = lambda c, n: F.when(F.length(digits(c)) == n, digits(c))
    cpv = F.array_distinct(F.filter(F.transform("cpv", lambda c: F.substring(F.regexp_replace(c, "[^0-9]", ""), 1, 8)), lambda c: F.length(c) == 8))
    nuts = F.array_distinct(F.filter(F.transform("nuts", lambda c: F.upper(F.trim(c))), lambda c: c.rlike("^[A-Z]{2}[A-Z0-9]{0,3}$") & ~c.rlike("^[A-Z]{3}$")))
    out = rows.withColumns({"siren": fixed("siren", 9), "siret": fixed("siret", 14), "cpv": cpv, "nuts": nuts, "country": F.upper(F.trim("country")), "title": F.trim("title")})
    out = out.withColumn("siren_effective", F.coalesce("siren", F.substring("siret", 1, 9)))
    rules = {
        "country": ~F.coalesce(F.col("country").rlike("^[A-Z]{2}$"), F.lit(False)),
        "notice_type": ~F.coalesce(F.col("notice_type").isin("planning", "competition", "result"), F.lit(False)),
        "title": F.coalesce(F.length("title"), F.lit(0)) < 1,
        "source_refs": F.coalesce(F.size("source_refs"), F.lit(0)) < 1,
    }
    return out.withColumn("violations", F.array_compact(F.array(*[F.when(bad, F.lit(k)) for k, bad in rules.items()])))


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """N-33. Rows that meet the contract, and those that don't with their violations."""
    out = cleaned(rows)
    return out.filter(F.size("violations") == 0).drop("violations"), out.filter(F.size("violations") > 0)


def company(results: DataFrame) -> DataFrame:
    """N-36. Identities from registry results (payload, requested_siret): the establishment asked for, else the seat."""
    p = F.col("payload")
    g = lambda path: F.get_json_object(p, path)
    place = "struct<siret:string,adresse:string,code_postal:string,commune:string,libelle_commune:string,departement:string>"
    asked = F.get(F.filter(F.from_json(g("$.matching_etablissements"), f"array<{place}>"), lambda e: e["siret"] == F.col("requested_siret")), F.lit(0))
    rows = results.withColumn("_e", F.coalesce(asked, F.from_json(g("$.siege"), place)))
    people = F.from_json(g("$.dirigeants"), "array<struct<denomination:string,prenoms:string,nom:string,qualite:string>>")
    names = F.transform(people, lambda x: F.struct(F.coalesce(blank(x["denomination"]), F.trim(F.concat_ws(" ", blank(x["prenoms"]), blank(x["nom"])))).alias("name"), x["qualite"].alias("role")))
    band = g("$.tranche_effectif_salarie")
    low, high = (map_column({k: str(v[i]) for k, v in EMPLOYEE_BANDS.items() if v[i] is not None})[band].cast("int") for i in (0, 1))
    code = F.coalesce(F.trim("_e.commune").rlike(r"^(\d{5}|2[AB]\d{3})$"), F.lit(False))
    siren = F.regexp_replace(g("$.siren"), "[^0-9]", "")
    return rows.select(
        siren.alias("siren"), F.coalesce("requested_siret", "_e.siret").alias("siret"), F.coalesce(blank(g("$.nom_complet")), blank(g("$.nom_raison_sociale")), siren).alias("legal_name"),
        F.nullif(F.trim(F.upper(F.replace(g("$.activite_principale"), F.lit("."), F.lit("")))), F.lit("")).alias("naf"), band.alias("band"), low.alias("least"), high.alias("most"),
        F.coalesce("_e.libelle_commune", F.when(~code, F.col("_e.commune"))).alias("city"), F.col("_e.departement").alias("department"), department_nuts(F.col("_e.departement")).alias("nuts"),
        F.slice(F.filter(names, lambda x: F.length(x["name"]) > 0), 1, 10).alias("executives"),
    )


#: Keywords of the schema subset; any other is refused when the rules are made, so that none is passed over in silence.
KEYWORDS = {"type", "required", "properties", "items", "enum", "additionalProperties", "minimum", "maximum", "minLength", "maxLength", "minItems", "maxItems", "pattern", "nullable", "description", "title", "$schema"}
_VARIANT_TYPES = {"string": "STRING", "object": "OBJECT", "array": "ARRAY", "boolean": "BOOLEAN", "number": "BIGINT|DOUBLE|DECIMAL", "integer": "BIGINT"}


def schema_rules(schema: dict, v: Column, path: str = "$") -> list[tuple[str, Column, Column]]:
    """Rules (name, where it applies, what must hold there) of a JSON schema subset over a variant column.

    Objects and scalars are checked to any depth that the schema states; of arrays, their size and each item's type, enum,
    bounds, lengths and pattern. A nullable null meets all rules of its place.
    """
    if unknown := set(schema) - KEYWORDS:
        raise ValueError(f"keywords at {path} that aren't supported: {sorted(unknown)}")
    kind = F.schema_of_variant(v)
    present = v.isNotNull() & ~(F.is_variant_null(v) if schema.get("nullable") else F.lit(False))
    out: list[tuple[str, Column, Column]] = []
    if expected := schema.get("type"):
        out.append((f"{path} type", present, kind.rlike(f"^({_VARIANT_TYPES[expected]})")))
    number, text = F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string")
    is_number, is_text = present & kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), present & (kind == "STRING")
    if "enum" in schema:
        allowed = [x if isinstance(x, str) else json.dumps(x) for x in schema["enum"]]
        out.append((f"{path} enum", present, F.coalesce(text.isin(allowed), F.lit(False))))
    for key, where, test in (
        ("minimum", is_number, lambda x: number >= x), ("maximum", is_number, lambda x: number <= x), ("minLength", is_text, lambda x: F.length(text) >= x),
        ("maxLength", is_text, lambda x: F.length(text) <= x), ("pattern", is_text, lambda x: text.rlike(x)),
    ):
        if key in schema:
            out.append((f"{path} {key}", where, test(schema[key])))
    items = F.try_variant_get(v, "$", "array<variant>")
    is_array = present & kind.startswith("ARRAY")
    for key, test in (("minItems", lambda x: F.size(items) >= x), ("maxItems", lambda x: F.size(items) <= x)):
        if key in schema:
            out.append((f"{path} {key}", is_array, test(schema[key])))
    if "items" in schema:
        met = lambda x: F.forall(F.array(*[~where | F.coalesce(ok, F.lit(False)) for _, where, ok in schema_rules(schema["items"], x, f"{path}[]")] or [F.lit(True)]), lambda b: b)
        out.append((f"{path} items", is_array, F.forall(items, met)))
    is_object = present & kind.startswith("OBJECT")
    fields = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    for name in schema.get("required", []):
        out.append((f"{path}.{name} required", is_object, F.array_contains(fields, name)))
    properties = schema.get("properties", {})
    if schema.get("additionalProperties") is False:
        out.append((f"{path} additionalProperties", is_object, F.size(F.array_except(fields, F.array(*map(F.lit, properties)).cast(STRINGS))) == 0))
    for name, below in properties.items():
        out += schema_rules(below, F.try_variant_get(v, f"$['{name}']", "variant"), f"{path}.{name}")
    return out


def _unfenced(raw: str) -> Column:
    return F.regexp_replace(F.trim(raw), r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1")


def against_schema(answers: DataFrame, schema: dict, raw: str = "raw") -> DataFrame:
    """E-09. ``violations`` of structured answers against a JSON schema subset: one code fence is stripped, nothing is
    repaired. An answer that isn't JSON, or whose top level isn't an object, has that one violation."""
    out = answers.withColumn("_v", F.try_parse_json(_unfenced(raw)))
    top = F.schema_of_variant("_v").startswith("OBJECT")
    rules = schema_rules(schema, F.col("_v"))
    found = [F.when(where & ~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, where, ok in rules]
    broken = F.when(F.col("_v").isNull(), F.array(F.lit("not json"))).when(~top, F.array(F.lit("not an object")))
    return out.withColumn("violations", F.coalesce(broken, F.array_compact(F.array(*found)))).drop("_v")


def validated(answers: DataFrame, schema: str, rules: dict[str, Column], raw: str = "raw") -> DataFrame:
    """E-09. ``parsed`` and ``violations`` of structured answers: one code fence is stripped, nothing is repaired.

    ``rules``: name -> condition over ``parsed`` that a valid answer meets.
    """
    out = answers.withColumn("_v", F.try_parse_json(_unfenced(raw))).withColumn("parsed", F.from_json(F.to_json("_v"), schema))
    unread = F.col("_v").isNull()
    checks = [F.when(unread, "not json")] + [F.when(~unread & ~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in rules.items()]
    return out.withColumn("violations", F.array_compact(F.array(*checks))).drop("_v")
