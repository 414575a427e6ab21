"""Deterministic identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(payload: Column) -> Column:
    """L-03. SHA-256 of a JSON text with sorted keys: key order never looks like a change. Broken JSON gives null."""
    return F.sha2(F.to_json(F.try_parse_json(payload)), 256)


def notice_id(source: Column, external_id: Column) -> Column:
    """L-09. ntc_ and the source and id with all but letters and digits as _, 60 characters at most."""
    return F.substring(F.concat(F.lit("ntc_"), F.regexp_replace(F.concat_ws("_", source, external_id), r"[^\p{L}\p{N}_]", "_")), 1, 60)


def identifier(c: Column) -> Column:
    """N-35. Nine digits are a siren, fourteen a siret with its siren; else null."""
    d = F.regexp_replace(c, "[^0-9]", "")
    n = F.length(d)
    return F.when(n.isin(9, 14), F.struct(F.substring(d, 1, 9).alias("siren"), F.when(n == 14, d).alias("siret")))


def request_key(ref: Column, system: Column, user: Column, model: Column) -> Column:
    """U-02. Equal requests have equal keys."""
    return F.concat(F.sha2(F.concat_ws("\0", ref, system, user), 256), F.lit(":"), model)
