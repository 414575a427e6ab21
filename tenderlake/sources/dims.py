"""Reference dimensions. Fixed values of public registers and of the product's presets; small, so they broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SECTOR_PACKS = {
    "it": {"cpv_families": ["72", "48", "302", "79511"], "keywords": ["infogérance", "développement", "informatique", "logiciel", "numérique", "hébergement"]},
    "training": {"cpv_families": ["805", "79632", "80533"], "keywords": ["formation", "qualiopi", "apprentissage", "certification professionnelle"]},
    "maintenance": {"cpv_families": ["50", "45259", "90910", "71314"], "keywords": ["maintenance", "entretien", "nettoyage", "multitechnique", "exploitation"]},
}
#: NUTS 2021 regions of level 2 with their départements.
NUTS2_DEPARTMENTS = {
    "FR10": ("75", "77", "78", "91", "92", "93", "94", "95"),
    "FRB0": ("18", "28", "36", "37", "41", "45"),
    "FRC1": ("21", "58", "71", "89"),
    "FRC2": ("25", "39", "70", "90"),
    "FRD1": ("14", "50", "61"),
    "FRD2": ("27", "76"),
    "FRE1": ("59", "62"),
    "FRE2": ("02", "60", "80"),
    "FRF1": ("67", "68"),
    "FRF2": ("08", "10", "51", "52"),
    "FRF3": ("54", "55", "57", "88"),
    "FRG0": ("44", "49", "53", "72", "85"),
    "FRH0": ("22", "29", "35", "56"),
    "FRI1": ("24", "33", "40", "47", "64"),
    "FRI2": ("19", "23", "87"),
    "FRI3": ("16", "17", "79", "86"),
    "FRJ1": ("11", "30", "34", "48", "66"),
    "FRJ2": ("09", "12", "31", "32", "46", "65", "81", "82"),
    "FRK1": ("03", "15", "43", "63"),
    "FRK2": ("01", "07", "26", "38", "42", "69", "73", "74"),
    "FRL0": ("04", "05", "06", "13", "83", "84"),
    "FRM0": ("2A", "2B", "20"),
    "FRY1": ("971",),
    "FRY2": ("972",),
    "FRY3": ("973",),
    "FRY4": ("974",),
    "FRY5": ("976",),
}
DEPARTMENTS = {d: nuts for nuts, ds in NUTS2_DEPARTMENTS.items() for d in ds}
NAF_CPV = {"6202A": ["72", "48"], "6201Z": ["72", "48"], "6203Z": ["72"], "8559A": ["805"], "8559B": ["805", "79632"], "8110Z": ["50", "90910", "79713"], "4321A": ["45259", "50"]}
LANGUAGES = {"fra": "fr", "eng": "en", "nld": "nl", "deu": "de", "ger": "de", "ita": "it", "spa": "es", "por": "pt", "dan": "da", "swe": "sv", "fin": "fi", "pol": "pl", "ces": "cs", "slk": "sk", "slv": "sl", "hun": "hu", "ron": "ro", "bul": "bg", "ell": "el", "hrv": "hr", "est": "et", "lav": "lv", "lit": "lt", "mlt": "mt", "gle": "ga", "nor": "no"}
COUNTRIES = {"FRA": "FR", "BEL": "BE", "LUX": "LU", "NLD": "NL", "DEU": "DE", "ITA": "IT", "ESP": "ES", "PRT": "PT", "IRL": "IE", "AUT": "AT", "POL": "PL", "DNK": "DK", "SWE": "SE", "FIN": "FI", "CZE": "CZ", "SVK": "SK", "SVN": "SI", "HUN": "HU", "ROU": "RO", "BGR": "BG", "GRC": "GR", "HRV": "HR", "EST": "EE", "LVA": "LV", "LTU": "LT", "MLT": "MT", "CYP": "CY", "GBR": "GB", "NOR": "NO", "CHE": "CH"}
#: INSEE bands of employees: least and most (None: and above).
EMPLOYEE_BANDS = {"NN": (0, 0), "00": (0, 0), "01": (1, 2), "02": (3, 5), "03": (6, 9), "11": (10, 19), "12": (20, 49), "21": (50, 99), "22": (100, 199), "31": (200, 249), "32": (250, 499), "41": (500, 999), "42": (1000, 1999), "51": (2000, 4999), "52": (5000, 9999), "53": (10000, None)}
THRESHOLDS = [("eu-works", "EU", 5538000, "2024-01-01"), ("eu-supplies-central", "EU", 143000, "2024-01-01"), ("eu-supplies-subcentral", "EU", 221000, "2024-01-01"), ("eu-utilities", "EU", 443000, "2024-01-01"), ("fr-no-publicity", "FR", 40000, "2024-01-01"), ("fr-adapted-publicity", "FR", 90000, "2024-01-01")]
LEAD_TIMES = [("attestation-fiscale", 0, 365), ("attestation-urssaf", 3, 180), ("kbis", 0, 90), ("assurance-rc-pro", 5, 365), ("qualiopi", 120, 1095), ("iso-9001", 180, 1095), ("iso-27001", 240, 1095)]


def map_column(values: dict[str, str]):
    """A literal map for lookups inside expressions."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def departments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(DEPARTMENTS.items()), "department string, nuts string")


def naf_cpv(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(NAF_CPV.items()), "naf string, cpv array<string>")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """L-13. Rows of both by key; of several the last by ``order`` stays."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order))
    return existing.unionByName(new).withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
