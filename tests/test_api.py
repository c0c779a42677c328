"""The request-level API: mode flags and update/match combinations."""

import pytest

from matchfold.operators.state import empty_state
from matchfold.operators.validate import ValidationError
from matchfold.plans.api import check_mode, resolve
from tests.described import about, descriptions


def test_mode_flags():
    for m in ("none", "match", "dnb"):
        assert check_mode(m) == m
    with pytest.raises(ValueError):
        check_mode("both")


def test_update_then_match_and_match_only(spark):
    raw = descriptions(spark, [about(0, register="AB000001", dnb="dun1", name="x"), about(1, register="AB000002", name="y")])
    state, out = resolve(empty_state(spark), raw, update=True, mode="dnb")
    assert sorted(tuple(r) for r in out.collect()) == [("1", "dun1", "111000"), ("2", None, "101000")]
    same, out2 = resolve(state, raw, update=False, mode="match")
    assert same is state
    assert sorted(tuple(r) for r in out2.collect()) == [("1", 1, "111000"), ("2", 2, "101000")]
    _, none = resolve(state, raw, update=False, mode="none")
    assert none is None


def test_invalid_request(spark):
    raw = descriptions(spark, [about(0, register="short")])
    with pytest.raises(ValidationError):
        resolve(empty_state(spark), raw)
    _, out = resolve(empty_state(spark), raw, on_invalid="drop")
    assert out.count() == 0


def test_one_broken_request_rejects_no_other(spark):
    import json

    from matchfold import empty_state, resolve_requests

    one = {"id": "1", "source": "s", "datetime": "2020-01-01 00:00:00", "duns_number": "d1"}
    docs = {
        "a": json.dumps({"descriptions": [{**one, "id": "10"}, {**one, "id": "2", "duns_number": "d2"}]}),
        "b": json.dumps({"descriptions": [one, {**one, "id": None}, {"source": 5}]}),
        "c": json.dumps({"descriptions": [one, 5]}),
        "d": "{",
        "e": "[]",
        "f": json.dumps({"descriptions": []}),
        "g": json.dumps({"descriptions": [{**one, "duns_number": "d1"}]}),
        "h": json.dumps({"descriptions": [{**one, "id": None}]}),
        "i": json.dumps({"descriptions": [{"id": "1", "source": "s", "datetime": "2020-01-01 00:00:00"}]}),
    }
    payloads = spark.createDataFrame(list(docs.items()), "request string, value string")
    state, answers, rejects = resolve_requests(empty_state(spark), payloads, update=True)
    match = lambda i, c, s="010000": {"id": i, "match_id": c, "similarity": s}
    assert {r.request: json.loads(r.json)["matches"] for r in answers.collect()} == {
        "a": [match("10", 1), match("2", 2)],
        "f": [],
        "g": [match("1", 1)],
    }
    assert {r.request: (r.path, r.message) for r in rejects.collect()} == {
        "b": ("/descriptions/2", "'id' is a required property"),
        "c": ("/descriptions/1", "5 is not of type 'object'"),
        "d": ("", "Unable to read JSON payload"),
        "e": ("", "[] is not of type 'object'"),
        "h": ("/descriptions/0/id", "None is not of type 'string'"),
        "i": ("/descriptions/0", "'company_name' is a required property"),
    }
    # ids count within a request
    _, dnb, _ = resolve_requests(state, payloads.where("request in ('g', 'a')"), mode="dnb")
    assert {r.request: json.loads(r.json)["matches"] for r in dnb.collect()} == {
        "a": [match("10", "d1"), match("2", "d2")],
        "g": [match("1", "d1")],
    }
