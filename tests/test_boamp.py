"""BOAMP payloads whose parts repeat, miss or nest, against records written by hand."""

import json

from tenderlake.operators import normalise


def records(spark, *payloads):
    rows = [("fr-boamp", i, None, p if isinstance(p, str) else json.dumps(p, ensure_ascii=False)) for i, p in payloads]
    return normalise.boamp(spark.createDataFrame(rows, "source string, external_id string, url string, payload string")).collect()


def deep(notice, kind="ContractNotice"):
    return json.dumps({"EFORMS": {kind: notice}}, ensure_ascii=False)


CODE, PLACE = "cbc:ItemClassificationCode", "cbc:CountrySubentityCode"


def test_versions_of_a_notice_keep_their_own_codes(spark):
    notice = lambda code, ident: deep({"x": {CODE: code}, "cac:PartyLegalEntity": {"cbc:CompanyID": ident}})
    got = records(spark, ("26-1", {"donnees": notice("11111111", "123 456 789 00017")}), ("26-1", {"donnees": notice("22222222", "987654321")}))
    assert sorted((r.cpv, r.siret, r.siren) for r in got) == sorted([(["11111111"], "12345678900017", None), (["22222222"], None, "987654321")], key=repr)


def test_buyer_project_and_lots(spark):
    party = {
        "cac:PartyName": [{"cbc:Name": {"eng": "Town", "fra": ["", "Ville &amp; Métropole"]}}, {"cbc:Name": "second"}],
        "cac:PostalAddress": {"cbc:CityName": {"#text": " Lyon "}, PLACE: {"@listName": "nuts", "#text": "FRK26"}, "cac:Country": {"cbc:IdentificationCode": "FRA"}},
        "cac:PartyTaxScheme": {"cbc:CompanyID": "999999999"},
        "cac:PartyLegalEntity": [{"cbc:CompanyID": {"@schemeID": "x", "#text": "111 111 111"}}, {"cbc:Other": 1}, {"cbc:CompanyID": "22222222200011"}],
        "cac:Contact": {"cbc:ElectronicMail": "a@b.fr", "cbc:Telephone": 33},
        "cbc:WebsiteURI": "https://b.fr",
    }
    lot = lambda i, *projects: {"cbc:ID": {"@schemeName": "Lot", "#text": i}, "cac:ProcurementProject": list(projects)}
    notice = {
        "cac:ContractingParty": [{"cac:Party": party}, {"cac:Party": {"cac:Contact": {"cbc:ElectronicMail": "no@no"}}}],
        "cac:ProcurementProject": {"cbc:Name": "Projet", "cbc:Description": "Route &eacute;troite", CODE: [{"@listName": "cpv", "#text": "45233140-2"}, {"@listName": "nature", "#text": "99999999"}, "4523"]},
        "cac:ProcurementProjectLot": [
            lot("LOT-0001", {"cbc:Name": "Un", "deep": [{CODE: "71000000"}, {PLACE: "fr101"}]}, {"cbc:Name": "no", CODE: "72000000"}),
            {"cac:ProcurementProject": {"cbc:Name": "without id", CODE: "73000000"}},
            lot("LOT-0003"),
        ],
        "cac:Money": {"cbc:PayableAmount": {"@currencyID": "usd", "#text": "3"}, "cbc:TotalAmount": [{"@currencyID": "euro", "#text": "many"}, {"@currencyID": "eur", "#text": "1500.5"}]},
    }
    (r,) = records(spark, ("26-1", {"donnees": deep(notice)}))
    assert (r.title, r.description, r.buyer_name) == ("Projet", "Route étroite", "Ville & Métropole")
    assert (r.siren, r.siret) == ("111111111", "22222222200011")
    assert r.buyer_address.asDict() == {"street": None, "postcode": None, "city": "Lyon", "nuts": "FRK26", "country": "FRA"}
    assert r.buyer_contact.asDict() == {"email": "a@b.fr", "phone": "33", "website": "https://b.fr"}
    assert r.cpv == ["45233140", "71000000", "72000000", "73000000"] and r.nuts == ["FRK26", "FR101"]
    assert [tuple(x) for x in r.lots] == [("LOT-0001", "Un", None, ["71000000", "72000000"], ["FR101"]), ("LOT-0003", None, None, [], [])]
    assert (r.amount, r.currency) == (1500.5, "EUR")


def test_archive_broken_and_other_shapes(spark):
    old = json.dumps({"IDENTITE": {"DENOMINATION": "Mairie", "MEL": "m@x", "TEL": "01", "VILLE": "Lille", "CP": "59000"}})
    cases = [
        ("a", {"donnees": old}), ("b", {"donnees": "{broken", "nomacheteur": "B", "descripteur_libelle": ["x", "y"]}), ("c", {"donnees": json.loads(deep({CODE: "11111111"}))}),
        ("d", {"donnees": json.dumps({"EFORMS": {"n": None, "List": [{CODE: "22222222"}, {CODE: "33333333"}], "Other": {CODE: "44444444"}}})}), ("e", {"donnees": "[1]"}), ("f", {"donnees": deep({"a": [[{CODE: "55555555"}]]})}), ("g", {}),
    ]
    got = {r.external_id: r for r in records(spark, *cases)}
    assert (got["a"].buyer_name, got["a"].buyer_city, got["a"].buyer_address.postcode, got["a"].buyer_contact.email, got["a"].buyer_contact.phone) == ("Mairie", "Lille", "59000", "m@x", "01")
    assert (got["b"].buyer_name, got["b"].description, got["b"].title, got["b"].lots) == ("B", "x, y", "BOAMP b", [])
    assert {k: r.cpv for k, r in got.items()} == {"a": [], "b": [], "c": ["11111111"], "d": ["22222222"], "e": [], "f": ["55555555"], "g": []}
    assert got["g"].buyer_contact.asDict() == {"email": None, "phone": None, "website": None}


def test_a_small_table_is_dealt_to_all_cores(spark, sf_dir):
    from tenderlake.plans import normalisation

    assert normalisation.boamp_normalize(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
