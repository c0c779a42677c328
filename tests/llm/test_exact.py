import hashlib
from collections import defaultdict

from matchfold.llm import exact
from tests.llm.data import awkward, docs


def test_groups_against_brute_force(spark):
    rows = awkward()
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(-1 if r[0] is None else r[0])
    for digest_all in (False, True):
        out = exact.exact_duplicates(docs(spark), digest_all=digest_all).collect()
        assert len(out) == len(rows)
        by_hash = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
        kept = 0
        for r in out:
            if r["text_sha256"] is not None:
                g = by_hash[r["text_sha256"]]
                assert r["group_size"] == len(g) and (-1 if r["keep_id"] is None else r["keep_id"]) == max(g)
            else:
                assert not digest_all and r["group_size"] == 1 and r["kept"]
            kept += r["kept"]
        assert kept == len(groups)


def test_prefix_twins_that_differ_later(spark):
    rows = [(i, "p" * 400 + x, None, None, None, None, None, None, None) for i, x in enumerate("aabc")]
    out = {r["doc_id"]: r for r in exact.exact_duplicates(docs(spark, rows)).collect()}
    assert [out[i]["group_size"] for i in range(4)] == [2, 2, 1, 1]
    assert [out[i]["keep_id"] for i in range(4)] == [1, 1, 2, 3]


def test_dropping_keeps_one_row_of_each_text_and_all_columns(spark):
    d = docs(spark)
    out = exact.drop_exact_duplicates(d)
    assert out.columns == d.columns
    texts = [r["text"] or "" for r in out.collect()]
    assert sorted(texts) == sorted({r[1] or "" for r in awkward()})


def test_empty_table(spark):
    assert exact.exact_duplicates(docs(spark, [])).count() == 0
    assert exact.drop_exact_duplicates(docs(spark, [])).count() == 0
