"""JSON payload source (parse, expand, type check) and the JSON match sink."""

from matchfold.sources.payload import PAYLOAD_ERROR, expand_payloads, match_json, matches_to_json, parse_payload_text


def test_parse_and_expand(spark):
    docs = spark.createDataFrame(
        [
            (1, '{"descriptions": [{"id": "1", "datetime": "2019-01-01 00:00:00", "source": "dit.x", "companies_house_id": "AB000001", "extra": 3}, {"id": 2, "company_name": "x"}]}'),
            (2, "not json"),
            (3, '{"other": []}'),
        ],
        "pid int, value string",
    )
    parsed = {r.pid: r.payload_error for r in parse_payload_text(docs).collect()}
    assert parsed[1] is None
    assert parsed[2] == PAYLOAD_ERROR
    assert parsed[3] == "'descriptions' is a required property"
    rows = expand_payloads(docs, key_col="pid").orderBy("pid", "_pos").collect()
    assert [(r.pid, r._pos, r.id) for r in rows] == [(1, 0, "1"), (1, 1, "2"), (2, None, None), (3, None, None)]
    assert [r.payload_error for r in rows] == [None, None, PAYLOAD_ERROR, "'descriptions' is a required property"]
    assert str(rows[0].datetime) == "2019-01-01 00:00:00"
    assert rows[0].companies_house_id == "AB000001"
    assert [e.message for e in rows[1].type_errors] == ["2 is not of type 'string'"]
    assert rows[0].type_errors == []


def test_match_json_keeps_nulls(spark):
    df = spark.createDataFrame([("1", None, "000000"), ("2", 5, "100000")], "id string, match_id long, similarity string")
    got = sorted(r.json for r in match_json(df).collect())
    assert got == ['{"id":"1","match_id":null,"similarity":"000000"}', '{"id":"2","match_id":5,"similarity":"100000"}']


def test_matches_document_per_request(spark):
    df = spark.createDataFrame(
        [("r1", "2", 1, "1"), ("r1", "1", None, "0"), ("r2", "9", 3, "1")],
        "req string, id string, match_id long, similarity string",
    )
    docs = {r.req: r.json for r in matches_to_json(df, "req").collect()}
    assert docs["r1"] == '{"matches":[{"id":"1","match_id":null,"similarity":"0"},{"id":"2","match_id":1,"similarity":"1"}]}'
