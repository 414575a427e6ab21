"""Nodes of embedded notices as an array column: every element with its place, so that lots, parties and projects are read by subtree."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

# The elements that are read.
PROJECT, LOT, ENTITY, PARTY = "cac:ProcurementProject", "cac:ProcurementProjectLot", "cac:PartyLegalEntity", "cac:ContractingParty"
CODE, PLACE = "cbc:ItemClassificationCode", "cbc:CountrySubentityCode"
AMOUNTS = ("cbc:EstimatedOverallContractAmount", "cbc:TotalAmount", "cbc:PayableAmount")
TEXTS = ("cbc:Name", "cbc:Description")
KEPT = {
    PROJECT, LOT, ENTITY, PARTY, CODE, PLACE, *AMOUNTS, *TEXTS, "cbc:ID", "cbc:CompanyID", "cac:Party", "cac:PartyName", "cac:PostalAddress", "cbc:StreetName", "cbc:PostalZone", "cbc:CityName",
    "cac:Country", "cbc:IdentificationCode", "cac:Contact", "cbc:ElectronicMail", "cbc:Telephone", "cbc:WebsiteURI",
}

_NODE = pa.struct([("ord", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("nth", pa.int32()), ("outer", pa.bool_()), ("key", pa.string()), ("value", pa.string()), ("list", pa.string()), ("currency", pa.string())])
NODES = T.ArrayType(T.StructType([T.StructField(f.name, {pa.int32(): T.IntegerType(), pa.bool_(): T.BooleanType()}.get(f.type, T.StringType())) for f in _NODE]))


def _notice(text: str | None):
    """The notice of an embedded text: the first object under EFORMS; None if the text is broken or has none."""
    try:
        top = json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None
    block = top.get("EFORMS") if isinstance(top, dict) else None
    for x in block.values() if isinstance(block, dict) else ():
        if isinstance(x, list) and x:
            x = x[0]
        if isinstance(x, dict):
            return x
    return None


def _listed(text: str | None) -> list[dict]:
    out: list[dict] = []
    count = 0

    def value(key, x):
        if key in TEXTS:
            return json.dumps(x, ensure_ascii=False) if isinstance(x, dict) else x if isinstance(x, str) else None
        x = x.get("#text") if isinstance(x, dict) else x
        return None if x is None or isinstance(x, list) else str(x).strip() or None

    def named(x, key):
        return x[key] if isinstance(x, dict) and isinstance(x.get(key), str) else None

    def walk(node, parent, above):
        nonlocal count
        for key, found in node.items():
            for nth, x in enumerate(found if isinstance(found, list) else [found]):
                count += 1
                own = {"ord": count, "parent": parent, "nth": nth, "outer": key not in above, "key": key, "value": value(key, x), "list": named(x, "@listName"), "currency": named(x, "@currencyID")}
                if key in KEPT:
                    out.append(own)
                for y in x if isinstance(x, list) else [x]:
                    if isinstance(y, dict):
                        walk(y, own["ord"], above | {key})
                own["last"] = count

    notice = _notice(text)
    try:
        walk(notice or {}, 0, frozenset())
    except RecursionError:
        return []
    return out


@F.arrow_udf(NODES)
def _nodes(texts: pa.Array) -> pa.Array:
    return pa.array([_listed(t) for t in texts.to_pylist()], pa.list_(_NODE))


def nodes(text: Column) -> Column:
    """N-23. The nodes of an embedded eForms text in document order: ``ord``; ``last``, the last node within it; ``parent``,
    the ord of the one around it (0: the notice); ``nth`` of its list; ``outer``, not within one of its own key; ``value``.

    A repeated element has a node for each item. Names and descriptions that are objects keep their JSON, to be picked by
    language. A null or broken text, or one without a notice, has no nodes. Rows stay where they are: each has its own nodes.
    """
    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)
    return _nodes(text)


def children(nodes: Column, parent: Column, key: str) -> Column:
    return F.filter(nodes, lambda x: (x["parent"] == parent) & (x["key"] == key))


def child(nodes: Column, parent: Column, *keys: str) -> Column:
    """The ord at the end of a path of first items; null if one is missing."""
    for key in keys:
        parent = F.get(children(nodes, parent, key), F.lit(0))["ord"]
    return parent


def swept(nodes: Column, *keys: str) -> Column:
    """The outermost nodes of a key at any depth."""
    return F.filter(nodes, lambda x: x["key"].isin(*keys) & x["outer"])


def within(nodes: Column, tops: Column) -> Column:
    """The nodes inside any of ``tops``."""
    return F.filter(nodes, lambda x: F.exists(tops, lambda t: (x["ord"] > t["ord"]) & (x["ord"] <= t["last"])))


def first_value(nodes: Column) -> Column:
    return F.get(F.filter(F.transform(nodes, lambda x: x["value"]), lambda v: v.isNotNull()), F.lit(0))


def text_at(nodes: Column, parent: Column, *keys: str) -> Column:
    """The first text under a path of first items."""
    return first_value(children(nodes, child(nodes, parent, *keys[:-1]), keys[-1]))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def cpv_codes(nodes: Column) -> Column:
    """N-24. Eight digits of each classification code of the list cpv or of none, once each."""
    named = F.filter(swept(nodes, CODE), lambda x: F.coalesce(x["list"], F.lit("cpv")) == "cpv")
    return F.array_distinct(F.filter(F.transform(named, lambda x: F.substring(_digits(x["value"]), 1, 8)), lambda c: F.coalesce(F.length(c) == 8, F.lit(False))))


def nuts_codes(nodes: Column) -> Column:
    """N-25. Upper-case codes of the list nuts or of none, once each."""
    named = F.filter(swept(nodes, PLACE), lambda x: (F.coalesce(x["list"], F.lit("nuts")) == "nuts") & x["value"].isNotNull())
    return F.array_distinct(F.transform(named, lambda x: F.upper(x["value"])))


def company_ids(nodes: Column) -> Column:
    """N-26. Digits of the CompanyID of each legal entity; ids of tax schemes and the like aren't meant."""
    ids = F.transform(swept(nodes, ENTITY), lambda e: _digits(first_value(children(nodes, e["ord"], "cbc:CompanyID"))))
    return F.array_distinct(F.filter(ids, lambda d: F.coalesce(d != "", F.lit(False))))


def first_of_length(ids: Column, n: int) -> Column:
    return F.get(F.filter(ids, lambda d: F.length(d) == n), F.lit(0))


def first_amount(nodes: Column) -> Column:
    """The first number, by key in the order of ``AMOUNTS``."""
    found = F.concat(*[F.transform(swept(nodes, k), lambda x: x["value"].try_cast("double")) for k in AMOUNTS])
    return F.get(F.filter(found, lambda v: v.isNotNull()), F.lit(0))


def first_currency(nodes: Column) -> Column:
    found = F.concat(*[F.filter(swept(nodes, k), lambda x: F.length(x["currency"]) == 3) for k in AMOUNTS])
    return F.upper(F.get(found, F.lit(0))["currency"])
