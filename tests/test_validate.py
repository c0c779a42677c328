"""Validation rules and messages (match / update modes)."""

import pytest

from matchfold.operators.validate import ValidationError, assert_valid, split_valid, validate_descriptions

COLS = "id string, source string, datetime timestamp_ntz, companies_house_id string, duns_number string, company_name string, contact_email string, cdms_ref string, postcode string"


def row(id="1", source="dit.datahub", dt=True, ch=None, duns=None, name=None, email=None, cdms=None, pc=None):
    import datetime

    return (id, source, datetime.datetime(2010, 1, 1) if dt else None, ch, duns, name, email, cdms, pc)


CASES = [
    ("match", row(id=None, name="a"), "'id' is a required property"),
    ("match", row(), "'company_name' is a required property"),
    ("match", row(email="invalid"), "'invalid' does not match '[^@]+@[^@]+\\\\.[^@]+'"),
    ("update", row(email="invalid"), "'invalid' does not match '[^@]+@[^@]+\\\\.[^@]+'"),
    ("match", row(ch="1234567"), "'1234567' is too short"),
    ("update", row(ch="123456789"), "'123456789' is too long"),
    ("update", row(dt=False, ch="11111111"), "'datetime' is a required property"),
    ("update", row(source=None, ch="11111111"), "'source' is a required property"),
    ("update", row(), "'company_name' is a required property"),
    ("update", row(name=""), "'' is too short"),
    ("update", row(ch="a'b"), '"a\'b" is too short'),
    ("update", row(ch='a"\'b'), "'a\"\\'b' is too short"),
    ("update", row(email="x\ty"), "'x\\ty' does not match '[^@]+@[^@]+\\\\.[^@]+'"),
]


@pytest.mark.parametrize("mode,r,message", CASES)
def test_first_error_message(spark, mode, r, message):
    df = spark.createDataFrame([r], COLS)
    with pytest.raises(ValidationError) as e:
        assert_valid(df, mode)
    assert str(e.value) == message


def test_valid_rows_pass_and_paths(spark):
    df = spark.createDataFrame([row(ch="11111111", email="a@b.co"), row(id="2", ch="1")], COLS)
    valid, rejected = split_valid(df, "update")
    assert [r.id for r in valid.collect()] == ["1"]
    errs = validate_descriptions(df, "update", index_col="id").where("id = '2'").first().errors
    assert [(e.path, e.message) for e in errs] == [("/descriptions/2/companies_house_id", "'1' is too short")]


def test_match_mode_needs_no_source_or_datetime(spark):
    df = spark.createDataFrame([row(source=None, dt=False, name="x")], COLS)
    assert assert_valid(df, "match") is df


def test_unknown_mode(spark):
    df = spark.createDataFrame([row(name="x")], COLS)
    with pytest.raises(ValueError):
        validate_descriptions(df, "both")
