"""Structured Streaming updates equal the same batches applied one by one."""

import json

from matchfold import StateStore, match, normalise_descriptions
from matchfold.session import scratch_path
from matchfold.streaming import stream_updates
from tests.described import about, descriptions


def _lines(spark, tuples):
    df = descriptions(spark, tuples)
    return [
        json.dumps({k: (str(v) if k == "datetime" else v) for k, v in r.asDict().items() if v is not None})
        for r in df.collect()
    ]


def test_stream_equals_sequence(spark, tmp_path):
    # Streamed rows are validated, so companies house ids have 8 characters here.
    steps = [[about(0, dnb="dun1", name="name1")], [about(24, register="CH000001", dnb="dun1")], [about(48, register="CH00000x")]]
    src = tmp_path / "src"
    src.mkdir()
    store = StateStore(spark, scratch_path(spark, "t-stream"))
    ckpt = str(tmp_path / "ckpt")
    for i, step in enumerate(steps):
        (src / f"batch={i}").mkdir()
        (src / f"batch={i}" / "part.json").write_text("\n".join(_lines(spark, step)) + "\n")
        stream_updates(spark, str(src), store, ckpt)
    state = store.load()
    assert state.meta["batch_id"] == 2  # the invalid third row was rejected, the batch still committed
    probe = normalise_descriptions(descriptions(spark, [about(48, name="name1")]))
    assert [tuple(r) for r in match(state, probe).collect()] == [("1", 2, "001000")]


def test_new_stream_on_existing_store_is_applied(spark, tmp_path):
    """A second stream (own checkpoint, batch ids from 0 again) is not a replay."""
    store = StateStore(spark, scratch_path(spark, "t-stream2"))
    for n, (step, name) in enumerate([([about(0, register="CH000001")], "a"), ([about(24, register="CH000002")], "b")]):
        src = tmp_path / f"src-{name}"
        (src / "batch=0").mkdir(parents=True)
        (src / "batch=0" / "part.json").write_text("\n".join(_lines(spark, step)) + "\n")
        stream_updates(spark, str(src), store, str(tmp_path / f"ckpt-{name}"))
    state = store.load()
    assert sorted(r.value for r in state.tables["companies_house_id"].collect()) == ["ch000001", "ch000002"]


def test_result_does_not_follow_the_number_of_files(spark, tmp_path):
    rows = [about(24 * (i % 3), register=f"CH{i % 7:06d}", dnb=f"dun{i % 5}", name=f"name{i % 4}") for i in range(24)]
    states = []
    for files in (1, 12):
        src = tmp_path / f"src-{files}"
        for b in (0, 1):
            (src / f"batch={b}").mkdir(parents=True)
            lines = _lines(spark, rows[b * 12 : b * 12 + 12])
            for k in range(files):
                (src / f"batch={b}" / f"part-{k}.json").write_text("\n".join(lines[k::files]) + "\n")
        store = StateStore(spark, scratch_path(spark, f"t-files-{files}"))
        stream_updates(spark, str(src), store, str(tmp_path / f"ckpt-{files}"))
        states.append(sorted(tuple(r) for r in store.load().long().collect()))
    assert states[0] == states[1] and len(states[0]) > 0


def test_values_that_are_no_text_are_rejected(spark, tmp_path):
    src = tmp_path / "src"
    (src / "batch=0").mkdir(parents=True)
    good = {"id": "1", "source": "s", "datetime": "2020-01-01 00:00:00", "duns_number": "d1"}
    bad = [{**good, "duns_number": 5}, {**good, "company_name": True}, {**good, "postcode": None}]
    (src / "batch=0" / "part.json").write_text("\n".join(map(json.dumps, [good, *bad])) + "\n")
    store = StateStore(spark, scratch_path(spark, "t-types"))
    rejects = str(tmp_path / "rejects")
    stream_updates(spark, str(src), store, str(tmp_path / "ckpt"), rejects_dir=rejects)
    assert [r.value for r in store.load().long().collect()] == ["d1"]
    found = {e.message for r in spark.read.parquet(rejects).collect() for e in r.errors}
    assert found == {"5 is not of type 'string'", "True is not of type 'string'", "None is not of type 'string'"}


def test_replays_are_known_by_stream(spark):
    store = StateStore(spark, scratch_path(spark, "t-marks"))
    batch = normalise_descriptions(descriptions(spark, [about(0, register="CH000001", dnb="dun1")]))
    versions = [store.update(batch, batch_id=0, stream=s).version for s in "ABA"]
    assert versions == [1, 2, 2]


def _file(src, batch, name, lines):
    (src / f"batch={batch}").mkdir(parents=True, exist_ok=True)
    (src / f"batch={batch}" / name).write_text("\n".join(lines) + "\n")


def _duns(store):
    return sorted(r.value for r in store.load().tables["duns_number"].collect())


def test_late_files_and_late_batches_are_folded(spark, tmp_path):
    """A second file of a folded batch, and a batch of a lower number, come late: nothing is lost, nothing is folded twice."""
    src, ckpt = tmp_path / "src", str(tmp_path / "ckpt")
    store = StateStore(spark, scratch_path(spark, "t-late"))
    _file(src, 1, "a.json", _lines(spark, [about(0, dnb="d0")]))
    stream_updates(spark, str(src), store, ckpt)
    _file(src, 1, "b.json", _lines(spark, [about(24, dnb="d1")]))
    _file(src, 0, "a.json", _lines(spark, [about(48, dnb="d2")]))
    stream_updates(spark, str(src), store, ckpt)
    assert _duns(store) == ["d0", "d1", "d2"]
    version = store.load().version
    # a new checkpoint over the same folder brings every file again
    stream_updates(spark, str(src), store, str(tmp_path / "ckpt-2"))
    assert store.load().version == version and _duns(store) == ["d0", "d1", "d2"]


def test_a_folder_read_half_written(spark, tmp_path):
    """A new checkpoint sees one file folded before and one that is new, in one folder."""
    src = tmp_path / "src"
    store = StateStore(spark, scratch_path(spark, "t-half"))
    rejects = str(tmp_path / "rejects")
    _file(src, 0, "a.json", _lines(spark, [about(0, register="CH000001", dnb="d0"), about(0, register="short")]))
    stream_updates(spark, str(src), store, str(tmp_path / "ckpt"), rejects_dir=rejects)
    _file(src, 0, "b.json", _lines(spark, [about(24, register="CH000002", dnb="d1")]))
    stream_updates(spark, str(src), store, str(tmp_path / "ckpt-2"), rejects_dir=rejects)
    assert _duns(store) == ["d0", "d1"] and store.load().version == 2
    assert spark.read.option("recursiveFileLookup", "true").parquet(rejects).count() == 1
