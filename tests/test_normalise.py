"""Attribute normalisation: quirks that must be kept (strict/general name rules)."""

import pytest

from matchfold.functions import normalise as N

NAMES = [
    # input, general, strict
    ("foo company", "foocompany", "foocompany"),
    ("foo co", "fooco", "fooco"),
    ("foo co. bar", "foobar", "foobar"),
    ("Unlimited", "un", "un"),
    ("Boltd", "bo", "bo"),
    ("abc12345xyz", "ab", "abc12345xyz"),
    ("A-B Ltd", "ab", "a-b"),
    ("Start/All", "star", "start/all"),
    ("12345 Ltd", "12345 ltd", "12345"),
    ("ltd", "ltd", "ltd"),
    ("...", "...", "..."),
    ("foo ltd\n", "fooltd", "fooltd"),
    ("corp ltd", "corp", "corp"),
    ("corp limited", "corp", "corp"),
    ("O'Brien; Co", "obrienco", "obrienco"),
    ("ACME - duplicate", "acme", "acme-duplicate"),
]


def test_name_rules(spark):
    df = spark.createDataFrame([(n,) for n, _, _ in NAMES], "company_name string")
    got = df.select(N.norm_name_general().alias("g"), N.norm_name_ch().alias("s")).collect()
    assert [(r.g, r.s) for r in got] == [(g, s) for _, g, s in NAMES]


@pytest.mark.parametrize(
    "source,expected", [("dit.datahub", "ab"), (None, "ab"), ("companies_house.companies", "a-b"), ("ditx", "a-b")]
)
def test_source_selects_rule(spark, source, expected):
    df = spark.createDataFrame([("A-B Ltd", source)], "company_name string, source string")
    assert df.select(N.norm_company_name()).first()[0] == expected


def test_scalar_attributes(spark):
    rows = [
        ("NotRegis", "D1", "john@Domain.COM", "ORG-10052267", "SW1A 1AA"),
        ("not reg", "d2", "a@b@c.d", "abc", " "),
        ("", None, "nodomain", None, None),
        ("AB123456", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "companies_house_id string, duns_number string, contact_email string, cdms_ref string, postcode string")
    got = df.select(
        N.norm_companies_house_id(), N.norm_duns_number(), N.norm_contact_email(), N.norm_cdms_ref(), N.norm_postcode()
    ).collect()
    assert [tuple(r) for r in got] == [
        (None, "D1", "domain.com", "10052267", "sw1a1aa"),
        (None, "d2", "b", "", ""),
        (None, None, "", None, None),
        ("ab123456", None, None, None, None),
    ]


def test_normalise_descriptions_keeps_passthrough(spark):
    df = spark.createDataFrame([("1", "dit.x", "Foo Ltd", "extra")], "id string, source string, company_name string, junk string")
    out = N.normalise_descriptions(df)
    assert out.columns[:3] == ["id", "source", "datetime"]
    assert "junk" not in out.columns
    assert out.first().company_name == "foo"


def test_starts_exclude_no_match(spark):
    """Each rule gives what its plain patterns give, on names put together from all that they look for."""
    import random

    from pyspark.sql import functions as F

    from matchfold.functions import patterns as P

    rnd = random.Random(3)
    bits = [
        "the ", "The\t", " ", "  ", ":", "[", ")", "'", "*x*", "&", ",", ";", '"', "ltd", "Ltd.", "LIMITED", " llp", " PLC.", " llc", " and ", " co.", " co|", " company ",
        "/", "-", " - ", "duplic", "_Duplicate", " dupilcat", " dupicat", " dissolved", "DO NOT ", "do not use", "in liquidation", "*in liquid", " liquidator", " ceased trading",
        " trading as ", "t/a", " acquired by", " please ", "use12345", "x123456", "1234", ".", "\n", "é", "ſ", "K", "İ", "ı", " ", "\x0b", "\u0085", "abc",
    ]
    df = spark.createDataFrame([("".join(rnd.choice(bits) for _ in range(rnd.randint(0, 8))),) for _ in range(4000)], "n string")

    def plain(*steps):
        c = F.col("n")
        for pattern, by in steps:
            c = F.regexp_replace(c, F.lit(P.JAVA_FLAGS + pattern), F.lit(by))
        return N._fallback_lower(c, F.col("n"))

    strict = plain((P.NAME_LEGAL, " "), (P.NAME_SQUEEZE, ""))
    general = plain((P.NAME_LEGAL_GENERAL, " "), (P.NAME_NOISE, ""), (P.NAME_SQUEEZE, ""))
    wrong = df.where(~N.norm_name_ch("n").eqNullSafe(strict) | ~N.norm_name_general("n").eqNullSafe(general))
    assert wrong.count() == 0
    # the tests of the first characters are there: without them every alternative is tried at every position
    text = df.select(N.norm_name_general("n"))._jdf.queryExecution().analyzed().toString()
    assert N._LEGAL_START in text and N._NOISE_START in text
