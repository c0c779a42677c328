"""Hot keys: single values holding a third of all rows, checked against the
literal-form DuckDB oracle on the same fixture (two batches, then match)."""

import datetime as dt

import duckdb
import pandas as pd

from matchfold import StateStore, match, normalise_descriptions
from matchfold.plans.duckdb_sql import Fold, normalised_sql
from matchfold.schema import DESCRIPTION_SCHEMA
from matchfold.session import scratch_path

N = 60


def _rows():
    base = dt.datetime(2020, 1, 1)
    out = []
    for i in range(N):
        out.append(
            (
                str(i + 1),
                "dit.datahub" if i % 2 else "companies_house.companies",
                base + dt.timedelta(minutes=(i * 37) % N),  # arrival order differs from time order
                f"CH{i % 7:06d}" if i % 4 else None,
                "HOT" if i % 3 == 0 else f"D{i % 5}",
                "Hot Corp Ltd" if i % 3 == 1 else (f"Name {i % 4}" if i % 2 else None),
                "x@hot.example" if i % 3 == 2 else None,
                None if i % 5 else "ORG-1",
                "   " if i % 3 == 0 else f"SW{i % 2} 1AA",
            )
        )
    return out


def test_hot_keys_match_literal_oracle(spark):
    rows = _rows()
    raw = spark.createDataFrame(rows, DESCRIPTION_SCHEMA)
    store = StateStore(spark, scratch_path(spark, "t-skew"), buckets=2)
    store.update(normalise_descriptions(raw.where("CAST(id AS INT) <= 30")), batch_id=0)
    state = store.update(normalise_descriptions(raw.where("CAST(id AS INT) > 30")), batch_id=1)
    got_state = sorted(tuple(str(v) for v in r) for r in state.long().collect())
    got_match = sorted(tuple(r) for r in match(state, normalise_descriptions(raw)).collect())

    con = duckdb.connect()
    pdf = pd.DataFrame(rows, columns=[f.name for f in DESCRIPTION_SCHEMA.fields])
    con.register("hot_pdf", pdf)
    con.execute("CREATE TABLE hot_raw AS SELECT * FROM hot_pdf")
    f = Fold()
    b1 = f.add("hb1", normalised_sql("(SELECT * FROM hot_raw WHERE CAST(id AS INT) <= 30)"))
    b2 = f.add("hb2", normalised_sql("(SELECT * FROM hot_raw WHERE CAST(id AS INT) > 30)"))
    ball = f.add("hball", normalised_sql("hot_raw"))
    t0, s0 = f.empty_state("e")
    t1, s1 = f.fold("u1", b1, t0, s0)
    t2, _ = f.fold("u2", b2, t1, s1)
    want_state = sorted(tuple(str(v) for v in r) for r in con.sql(f.sql(Fold.state_long(t2))).fetchall())
    f2 = Fold()
    f2.ctes = list(f.ctes)
    detail = f2.match_rel("md", ball, t2)
    want_match = sorted(
        tuple(r) for r in con.sql(f2.sql(f"SELECT id, aggr_match_id, similarity FROM {detail}")).fetchall()
    )
    assert got_state == want_state
    assert got_match == want_match
    # the hot values really are hot, and all of them landed in one cluster each
    hot = [r for r in got_state if r[1] in ("HOT", "hotcorp", "hot.example", "")]
    assert {r[0] for r in hot} == {"duns_number", "company_name", "contact_email", "postcode"}
