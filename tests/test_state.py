"""Versioned store, replay behaviour, seeded-state matching and invariants."""

import datetime as dt

from pyspark.sql import functions as F

from matchfold import StateStore, match, normalise_descriptions
from matchfold.operators.seed import insert_if_absent
from matchfold.operators.state import MappingState
from matchfold.schema import ATTRIBUTES, DESCRIPTION_SCHEMA, MAPPING_SCHEMA
from matchfold.session import scratch_path
from tests.described import FIELDS, about, descriptions
from tests.rowmodel import Claim, Model


def _norm(spark, tuples):
    return normalise_descriptions(descriptions(spark, tuples))


def _counts(state):
    return {r.attribute: r["count"] for r in state.long().groupBy("attribute").count().collect()}


def _frame(spark, claims):
    return spark.createDataFrame([c.row() for c in claims], DESCRIPTION_SCHEMA)


def _claim(number, month, **known):
    return Claim(f"q{number}", "register", dt.datetime(2017, month, 1), tuple(known.items()))


#: Two bakeries that used one name, and a supplier known by its D&B number only.
BAKERIES = [
    _claim(1, 3, companies_house_id="ni550001", company_name="crustandcrumb", postcode="bt11zz"),
    _claim(2, 7, companies_house_id="ni550002", company_name="crustandcrumb", contact_email="crust.example"),
    _claim(3, 5, duns_number="660000017", postcode="bt11zz"),
    _claim(4, 9, companies_house_id="ni550002", duns_number="660000025"),
]


def _table_rows(state):
    return sorted((r.attribute, r.value, r.prev_match_id, r.match_id, r.source, r.datetime) for r in state.long().collect())


def _model(*batches):
    out = Model()
    for b in batches:
        out.update(b)
    return out


def test_replayed_and_resent_batches(spark):
    store, model = StateStore(spark, scratch_path(spark, "t-store")), _model(BAKERIES)
    assert not store.exists()
    store.create()
    batch = _frame(spark, BAKERIES)
    first = store.update(batch, batch_id=0)
    assert _table_rows(first) == model.rows()
    # the same micro-batch again is skipped
    assert store.update(batch, batch_id=0).version == first.version
    # sent again as another batch it is folded: a version of its own
    second = store.update(batch, batch_id=1)
    model.update(BAKERIES)
    assert second.version == first.version + 1 and _table_rows(second) == model.rows()
    assert sorted(tuple(r) for r in match(second, batch).collect()) == [model.match(c) for c in BAKERIES]
    assert sorted(tuple(r) for r in match(second, batch, dnb=True).collect()) == [model.dnb(c) for c in BAKERIES]
    # older versions stay readable
    assert _table_rows(store.load(first.version)) == _model(BAKERIES).rows()


def _given(spark, model):
    """The model's state as tables that no update has written."""
    tables = {
        a: spark.createDataFrame([(v, e.was, e.now, e.source, e.datetime) for v, e in model.tables[a].items()], MAPPING_SCHEMA)
        for a in ATTRIBUTES
    }
    return MappingState(tables, model.last_id, 0)


def test_match_on_a_given_state(spark):
    model = _model(BAKERIES)
    state = _given(spark, model)
    probes = BAKERIES + [
        _claim(5, 1, companies_house_id="ni559999", company_name="crustandcrumb"),
        _claim(6, 1, contact_email="crust.example", postcode="bt99zz"),
        _claim(7, 1, cdms_ref="31", postcode="bt99zz"),
        _claim(8, 1),
    ]
    batch = _frame(spark, probes)
    got = sorted(tuple(r) for r in match(state, batch).collect())
    assert got == [model.match(c) for c in probes]
    assert [r[1] for r in got[-2:]] == [None, None] and got[5][1] == got[1][1]
    assert sorted(tuple(r) for r in match(state, batch, dnb=True).collect()) == [model.dnb(c) for c in probes]


def test_insert_if_absent(spark):
    held = _given(spark, _model(BAKERIES)).tables["duns_number"]
    later = dt.datetime(2023, 1, 1)
    seeds = spark.createDataFrame([("660000017", 90, 90, "x", later), ("660000033", 30, 30, "x", later)], MAPPING_SCHEMA)
    out = {r.value: (r.match_id, r.created) for r in insert_if_absent(held, seeds).collect()}
    assert {v: c for v, (_, c) in out.items() if v != "660000025"} == {"660000017": False, "660000033": True}
    assert out["660000033"][0] == 30 and out["660000017"][0] != 90


def test_match_invariants(spark):
    """match_id is NULL iff similarity is all zeros; the first '1' marks the
    attribute whose cluster was chosen; matching never changes the state."""
    store = StateStore(spark, scratch_path(spark, "t-inv"))
    tuples = [about(0, register="ch1", dnb="dun1", name="name1"), about(1, dnb="dun1", name="name2", email="a@x.org"), about(2, register="ch2", dnb="dun1", name="name1"),
              about(3, crm="77", postcode="sw1 1aa"), about(4, register="n/a")]
    s = store.update(_norm(spark, tuples), batch_id=0)
    before = sorted(tuple(r) for r in s.long().collect())
    probe = _norm(spark, tuples + [about(0, register="ch9", dnb="dun1", name="name2"), about(1, name="zzz")])
    rows = match(s, probe).collect()
    for r in rows:
        assert (r.match_id is None) == (r.similarity == "000000")
    assert sorted(tuple(r) for r in store.load().long().collect()) == before
    detail = F.col("similarity")
    assert match(s, probe).where(detail.rlike("^[01]{6}$")).count() == len(rows)


def test_reset_keeps_id_high_water_mark(spark):
    store = StateStore(spark, scratch_path(spark, "t-reset"))
    store.create()
    s = store.update(_norm(spark, [about(0, register="AB000001"), about(1, register="AB000002")]), batch_id=0)
    assert s.last_id == 2
    fresh = store.create(reset=True)
    assert fresh.long().count() == 0 and fresh.last_id == 2 and store.exists()
    s2 = store.update(_norm(spark, [about(0, register="AB000003")]), batch_id=1)
    assert [r.match_id for r in s2.long().collect()] == [3]


def _files(spark, store):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{store.root}/data/*/*")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return {"/".join(f.getPath().toString().split("/")[-2:]) for f in found or []}


def test_an_update_writes_only_what_it_changes(spark):
    store = StateStore(spark, scratch_path(spark, "t-layers"), buckets=2)
    store.update(_norm(spark, [about(i, register=f"AB{i:06d}", dnb=f"dun{i}", name=f"name{i}") for i in range(20)]), batch_id=0)
    before = _files(spark, store)
    s = store.update(_norm(spark, [about("2020-01-01", dnb="dun3", name="name77")]), batch_id=1)
    names = {f.split("/")[1] for f in _files(spark, store) - before}
    assert names == {"company_name", "index", "arrivals"}
    assert s.tables["company_name"].where("value = 'name77'").first().match_id == 4
    assert s.tables["company_name"].count() == 21 and s.tables["duns_number"].count() == 20
    # a batch that changes nothing commits a version that points to the same layers
    before = _files(spark, store)
    store.update(_norm(spark, [about("2020-01-01", dnb="dun3", name="name77")]), batch_id=2)
    assert {f.split("/")[1] for f in _files(spark, store) - before} == {"arrivals"}


def test_two_updates_from_one_base_lose_nothing(spark):
    root = scratch_path(spark, "t-two")
    one, two = StateStore(spark, root, buckets=2), StateStore(spark, root, buckets=2)
    one.create()
    real, hurried = one._commit, []

    def late(commit):
        if not hurried:  # the other update commits first
            hurried.append(two.update(_norm(spark, [about(0, register="AB000002", dnb="dun2", name="name")]), batch_id=8).version)
        real(commit)

    one._commit = late
    s = one.update(_norm(spark, [about(0, register="AB000001", dnb="dun1", name="name")]), batch_id=7)
    assert hurried == [1] and s.version == 2 and one.versions() == [0, 1, 2]
    assert sorted((r.value, r.match_id) for r in s.tables["companies_house_id"].collect()) == [("ab000001", 2), ("ab000002", 1)]
    assert one.update(_norm(spark, [about(0, register="AB000009")]), batch_id=8).version == 2  # folded by the other


def test_seeding_a_stored_state(spark):
    store = StateStore(spark, scratch_path(spark, "t-seed"), buckets=2)
    store.update(_norm(spark, [about(0, register="AB000001", dnb="dun1")]), batch_id=0)
    t = dt.datetime(2020, 1, 1)
    rows = [("dun1", 9, 9, "x", t), ("dun2", 5, 5, "x", t), ("dun2", 6, 7, "x", dt.datetime(2021, 1, 1))]
    s = store.seed({"duns_number": spark.createDataFrame(rows, MAPPING_SCHEMA)})
    assert {(r.value, r.prev_match_id, r.match_id) for r in s.tables["duns_number"].collect()} == {("dun1", 1, 1), ("dun2", 6, 7)}
    assert s.last_id == 7 and s.sizes["duns_number"] == 2
    # what was seeded is matched, moved and re-decided like any other row
    s = store.update(_norm(spark, [about("2022-01-01", register="AB000001", dnb="dun2")]), batch_id=1)
    assert {(r.value, r.match_id) for r in s.tables["duns_number"].collect()} == {("dun1", 1), ("dun2", 1)}


def test_sweep_keeps_what_kept_versions_need(spark):
    store = StateStore(spark, scratch_path(spark, "t-sweep"), buckets=2, max_layers=2)
    kept = []
    for i in range(4):
        s = store.update(_norm(spark, [about(0, register=f"AB{i:06d}", dnb=f"dun{i % 2}", name=f"n{i}")]), batch_id=i)
        kept.append(sorted(tuple(r) for r in s.long().collect()))
    assert store.sweep(keep=2) == 0  # all folders are young
    assert store.versions() == [3, 4]
    assert store.sweep(keep=2, grace_seconds=0) > 0
    for version, rows in zip((3, 4), kept[2:]):
        assert sorted(tuple(r) for r in store.load(version).long().collect()) == rows
    assert store.update(_norm(spark, [about(0, register="AB000000")]), batch_id=0).version == 4  # the ledger is kept


def test_index_follows_the_tables(spark):
    """What the index says of every cluster is what the tables say, whatever layers they are in."""
    import random

    rng = random.Random(8)
    store = StateStore(spark, scratch_path(spark, "t-index"), buckets=2, max_layers=3)
    for i in range(4):
        rows = []
        for _ in range(6):
            known = {f: f"{v}{rng.randint(0, 4)}" for f, v in zip(FIELDS, ("AB00000", "d", "n", "x@m", "7", "p")) if rng.random() < 0.5}
            rows.append(about(f"20{rng.randint(10, 20)}-01-01", **known))
        s = store.update(_norm(spark, rows), batch_id=i)
    got = sorted((r.key, ATTRIBUTES[r.attribute], r.value, r.now, r.was, r.match_id, r.prev_match_id) for r in s.index.whole().collect())
    want = {}
    for r in s.long().collect():
        for key in {r.match_id, r.prev_match_id}:
            want[key, r.attribute, r.value] = (key, r.attribute, r.value, key == r.match_id, key == r.prev_match_id, r.match_id, r.prev_match_id)
    assert got == sorted(want.values()) and got
