"""DuckDB oracle SQL per registered query key (see ``matchfold.plans.queries``)."""

from __future__ import annotations

from matchfold.plans import duckdb_sql as D
from matchfold.plans.duckdb_sql import Fold, _q, mapping
from matchfold.schema import ATTRIBUTES
from matchfold.sources.fixtures import JSON_MARKS, MARKED_COLUMNS

ATTR_LIST = ", ".join(ATTRIBUTES)


def _desc() -> str:
    return f"({D.descriptions_sql()}) d"


def _norm(raw: str, expr: str) -> str:
    return f"SELECT id, {raw} AS raw, {expr} AS value FROM {_desc()}"


def _two() -> tuple[Fold, str, str, str, str]:
    f = Fold()
    b1 = f.batch("b1", 1)
    b2 = f.batch("b2", 2)
    t0, s0 = f.empty_state("e")
    t1, s1 = f.fold("u1", b1, t0, s0)
    t2, s2 = f.fold("u2", b2, t1, s1)
    return f, t1, t2, s1, s2


def _single() -> tuple[Fold, str]:
    f = Fold()
    b = f.batch("ball", None)
    t0, s0 = f.empty_state("e")
    t, _ = f.fold("u", b, t0, s0)
    return f, t


def _best(f: Fold, table: str, keys: str, name: str) -> str:
    return f.add(
        name,
        f"SELECT DISTINCT ON (prev_match_id) prev_match_id, datetime AS h_datetime, match_id AS h_match_id\n"
        f"FROM {table} WHERE prev_match_id IN (SELECT key FROM {keys})\n"
        "ORDER BY prev_match_id, datetime DESC, match_id DESC",
    )


def _match_batch(f: Fold) -> str:
    return f.batch("bm", None, mode="match")


def _match(tables_of) -> str:
    f, tables = tables_of()
    detail = f.match_rel("md", _match_batch(f), tables)
    return f.sql(f"SELECT id, aggr_match_id AS match_id, similarity FROM {detail}")


def _dnb(tables_of) -> str:
    f, tables = tables_of()
    detail = f.match_rel("md", _match_batch(f), tables)
    out = f.dnb_rel("dnb", detail, tables)
    return f.sql(f"SELECT id, match_id, similarity FROM {out}")


def _state1():
    f, t1, _, _, _ = _two()
    return f, t1


def _state2():
    f, _, t2, _, _ = _two()
    return f, t2


def _errors_flag(cond: str) -> str:
    return f"SELECT n, coalesce({cond}, false) AS violates FROM ({D.flawed_sql()})"


def _json_struct() -> str:
    fields = ", ".join(
        f"'{c}': strftime(datetime, '%Y-%m-%d %H:%M:%S.%f')" if c == "datetime" else f"'{c}': {c}"
        for c in ("id", "source", "datetime", *ATTRIBUTES)
    )
    return "{" + fields + "}"


def _shapes(size: int) -> str:
    """What is wrong with each payload of so many orders (see ``BROKEN_PAYLOADS``)."""
    key = f"CAST(floor(o_orderkey / {size}) AS BIGINT)"
    said = ["Unable to read JSON payload", "[] is not of type 'object'", "{} is not of type 'array'", "'descriptions' is a required property", "None is not of type 'array'"]
    return f"SELECT DISTINCT {key} AS payload_id, [{', '.join(map(_q, said))}][1 + {key} % 7] AS error FROM orders"


def _stages_sql() -> dict[str, str]:
    """The operators of the fold in all six stages of the second batch."""
    q = {}
    higher = range(len(ATTRIBUTES) - 1)
    every = list(enumerate(ATTRIBUTES))

    def union(f: Fold, parts) -> str:
        return f.sql("\nUNION ALL\n".join(parts))

    def cols(k: int, **named) -> str:
        return "".join(
            f", {e.format(j=j) if j < k else f'CAST(NULL AS {t})'} AS h{j}_{n}" for j in higher for n, (e, t) in named.items()
        )

    f, t1, t2, _, _ = _two()
    q["lookup_left_join"] = union(f, [
        f"SELECT id, max(value) FILTER (rank = {k}) AS value, max(prev_match_id) FILTER (rank = {k}) AS f_prev, "
        f"max(match_id) FILTER (rank = {k}) AS f_mid"
        + cols(k, prev=("max(prev_match_id) FILTER (rank = {j})", "BIGINT"), mid=("max(match_id) FILTER (rank = {j})", "BIGINT"))
        + f", '{a}' AS attribute FROM b2 LEFT JOIN u2_known{k} USING (id) GROUP BY id"
        for k, a in every
    ])
    f, t1, t2, _, _ = _two()
    q["impacted_existing"] = union(f, [
        f"SELECT {D.MAP_COLS}, '{a}' AS attribute FROM {mapping(t1, a)} WHERE match_id IN (SELECT cluster FROM u2_touched{k})"
        for k, a in every[1:]
    ])

    def bests(f: Fold, t2: str, k: int) -> list[str]:
        return [_best(f, mapping(t2, ATTRIBUTES[j]), f"(SELECT cluster AS key FROM u2_touched{k})", f"best{k}_{j}") for j in range(k)]

    f, t1, t2, _, _ = _two()
    q["impacted_dependents"] = union(f, [
        f"SELECT prev_match_id, '{ATTRIBUTES[j]}' AS higher, h_datetime, h_match_id, '{a}' AS attribute FROM {b}"
        for k, a in every[1:] for j, b in enumerate(bests(f, t2, k))
    ])
    f, t1, t2, _, _ = _two()
    parts = []
    for k, a in every:
        parts.append(
            "SELECT own.value, own.match_id AS f_mid, own.datetime AS f_dt, own.source AS f_src"
            + cols(k, dt=("max(other.datetime) FILTER (other.rank = {j})", "TIMESTAMP"), mid=("max(other.match_id) FILTER (other.rank = {j})", "BIGINT"))
            + f", '{a}' AS attribute FROM u2_known{k} own JOIN u2_known{k} other USING (rid) WHERE own.rank = {k} "
            # rows that agree in all attributes are one candidate, the newest
            f"AND own.id IN (SELECT arg_max(id, {{'at': datetime, 'source': source}}) FROM b2 GROUP BY {ATTR_LIST}) "
            "GROUP BY rid, own.value, own.match_id, own.datetime, own.source"
        )
        if k:
            parts.append(
                "SELECT o.value, o.match_id AS f_mid, o.datetime AS f_dt, o.source AS f_src"
                + cols(k, dt=("x{j}.h_datetime", "TIMESTAMP"), mid=("x{j}.h_match_id", "BIGINT"))
                + f", '{a}' AS attribute FROM {mapping(t1, a)} o "
                + " ".join(f"LEFT JOIN {b} x{j} ON x{j}.prev_match_id = o.match_id" for j, b in enumerate(bests(f, t2, k)))
                + f" WHERE o.match_id IN (SELECT cluster FROM u2_touched{k})"
            )
    q["union_candidates"] = union(f, parts)
    f, *_ = _two()
    q["latest_per_value"] = union(f, [
        f"SELECT value, newest.at AS datetime, newest.source AS source, '{a}' AS attribute FROM u2_seen{k}" for k, a in every
    ])
    f, *_ = _two()
    q["first_value_priority"] = union(f, [
        "SELECT value" + cols(k, match_id=("max(t.match_id) FILTER (by_rank = {j})", "BIGINT"))
        + f", '{a}' AS attribute FROM u2_seen{k} LEFT JOIN u2_told{k} t USING (value) GROUP BY value"
        for k, a in every
    ])
    f, t1, t2, _, _ = _two()
    q["upsert_mapping"] = union(f, [f"SELECT {D.MAP_COLS}, '{a}' AS attribute FROM {mapping(t2, a)}" for a in ATTRIBUTES])
    f, t1, t2, _, _ = _two()
    parts = []
    for k, a in every:
        seeds = f.add(
            f"seeds{k}",
            f"SELECT DISTINCT ON ({a}) {a} AS value, CAST(0 AS BIGINT) AS prev_match_id, "
            f"CAST(0 AS BIGINT) AS match_id, source, datetime FROM b2 WHERE {a} IS NOT NULL ORDER BY {a}, datetime DESC, source DESC",
        )
        t = mapping(t1, a)
        parts += [
            f"SELECT {D.MAP_COLS}, false AS created, '{a}' AS attribute FROM {t}",
            f"SELECT {D.MAP_COLS}, true AS created, '{a}' AS attribute FROM {seeds} s WHERE NOT EXISTS (SELECT 1 FROM {t} o WHERE o.value = s.value)",
        ]
    q["seed_insert_if_absent"] = union(f, parts)
    return q


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["norm_companies_house_id"] = _norm("companies_house_id", D.norm_ch_sql())
    q["norm_duns_number"] = _norm("duns_number", "duns_number")
    q["norm_name_ch"] = _norm("company_name", D.norm_name_ch_sql())
    q["norm_name_general"] = _norm("company_name", D.norm_name_general_sql())
    q["norm_company_name"] = _norm("company_name", D.norm_company_name_sql())
    q["norm_contact_email"] = _norm("contact_email", D.norm_email_sql())
    q["norm_cdms_ref"] = _norm("cdms_ref", D.norm_cdms_sql())
    q["norm_postcode"] = _norm("postcode", D.norm_postcode_sql())
    q["normalise_descriptions"] = D.normalised_sql(_desc())

    q["val_payload_shape"] = f"SELECT *, error IS NULL AS ok FROM ({_shapes(100)})"
    q["val_required_match"] = _errors_flag("id IS NULL")
    q["val_required_update"] = _errors_flag("id IS NULL OR datetime IS NULL OR source IS NULL")
    q["val_any_attribute"] = _errors_flag(f"coalesce({ATTR_LIST}) IS NULL")
    text = f"CAST(json_merge_patch('{{}}', to_json({_json_struct()})) AS VARCHAR)"
    for mark, value in JSON_MARKS.items():
        text = f"replace({text}, '\"{mark}\"', '{value}')"
    words = "CASE {0} WHEN 'null' THEN 'None' WHEN 'true' THEN 'True' ELSE {0} END || ' is not of type ''string'''"
    found = ", ".join(
        f"CASE WHEN json_type(j, '$.{c}') <> 'VARCHAR' THEN {words.format(f'CAST(json_extract(j, {_q(chr(36) + chr(46) + c)}) AS VARCHAR)')} END"
        for c in ("id", *ATTRIBUTES)
    )
    marked = ", ".join(f"{e} AS {c}" for c, e in MARKED_COLUMNS.items())
    q["val_types"] = (
        "SELECT CAST(floor(n / 100) AS BIGINT) AS payload_id, "
        "CAST(row_number() OVER (PARTITION BY CAST(floor(n / 100) AS BIGINT) ORDER BY n) - 1 AS INTEGER) AS pos, "
        "len(m) > 0 AS violates, array_to_string(m, ' | ') AS messages "
        f"FROM (SELECT n, list_filter([{found}], lambda x: x IS NOT NULL) AS m "
        f"FROM (SELECT n, CAST({text} AS JSON) AS j FROM (SELECT * REPLACE ({marked}) FROM ({D.flawed_sql()}))))"
    )
    q["val_min_length"] = _errors_flag(
        " OR ".join(f"length({c}) < 1" for c in ("id", "company_name", "duns_number", "postcode", "cdms_ref"))
    )
    q["val_ch_length"] = _errors_flag("length(companies_house_id) <> 8")
    q["val_email"] = _errors_flag(f"NOT regexp_matches(contact_email, {_q(D.P.EMAIL_PATTERN)})")
    errs = D.errors_sql("update", "n")
    q["val_error_report"] = (
        f"SELECT n, CAST(len(e) AS INTEGER) AS n_errors, "
        "array_to_string(list_transform(e, lambda x: x.path || ': ' || x.message), ' | ') AS report "
        f"FROM (SELECT n, {errs} AS e FROM ({D.flawed_sql()}))"
    )

    q["src_json_descriptions"] = f"SELECT id, source, datetime, {ATTR_LIST} FROM {_desc()}"
    nulls = ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in ATTRIBUTES)
    q["src_expand_records"] = (
        "SELECT payload_id, CAST(row_number() OVER (PARTITION BY payload_id ORDER BY k) - 1 AS INTEGER) AS pos, "
        f"id, source, datetime, {ATTR_LIST}, CAST(0 AS INTEGER) AS n_type_errors, CAST(NULL AS VARCHAR) AS error FROM "
        f"(SELECT *, CAST(id AS BIGINT) AS k, CAST(floor(CAST(id AS BIGINT) / 100) AS BIGINT) AS payload_id FROM {_desc()}) "
        f"WHERE payload_id % 7 > 4 UNION ALL SELECT payload_id, NULL, NULL, NULL, NULL, {nulls}, 0, error FROM ({_shapes(100)}) WHERE error IS NOT NULL"
    )
    f, t1, *_ = _two()
    detail = f.match_rel("md", _match_batch(f), t1)
    bad = f"SELECT DISTINCT CAST(floor(CAST(id AS BIGINT) / 10) AS BIGINT) FROM {_desc()} WHERE NOT ({D.valid_predicate('match')})"
    q["request_matches_json"] = f.sql(
        "SELECT payload_id, to_json({'matches': list({'id': id, 'match_id': aggr_match_id, 'similarity': similarity} ORDER BY id)}) AS json "
        f"FROM (SELECT *, CAST(floor(CAST(id AS BIGINT) / 10) AS BIGINT) AS payload_id FROM {detail}) "
        f"WHERE payload_id % 7 > 4 AND payload_id NOT IN ({bad}) GROUP BY payload_id"
    )
    row = D.errors_sql("match", "pos")
    weak = _q("'company_name' is a required property")
    q["request_rejects"] = (
        "WITH r AS (SELECT *, CAST(floor(n / 10) AS BIGINT) AS payload_id, row_number() OVER (PARTITION BY CAST(floor(n / 10) AS BIGINT) ORDER BY n) - 1 AS pos "
        f"FROM ({D.flawed_sql()})), l AS (SELECT payload_id, pos, {row} AS es FROM r WHERE payload_id % 7 > 4), "
        "e AS (SELECT payload_id, pos, unnest(es) AS e, generate_subscripts(es, 1) AS rule FROM l) "
        "SELECT payload_id, f.path AS path, f.message AS message FROM (SELECT payload_id, min({'depth': len(e.path) - len(replace(e.path, '/', '')), "
        f"'weak': e.message = {weak}, 'pos': pos, 'rule': rule, 'path': e.path, 'message': e.message}}) AS f FROM e GROUP BY payload_id) "
        f"UNION ALL SELECT payload_id, '', error FROM ({_shapes(10)}) WHERE error IS NOT NULL"
    )
    f, t = _single()
    detail = f.match_rel("md", _match_batch(f), t)
    q["sink_matches_json"] = f.sql(
        f"SELECT to_json({{'id': id, 'match_id': aggr_match_id, 'similarity': similarity}}) AS json FROM {detail}"
    )

    f, *_ = _two()
    q["assign_new_ids"] = f.sql(
        "\nUNION ALL ".join(
            f"SELECT value, match_id, '{a}' AS attribute FROM u2_fresh{i}"
            for i, a in enumerate(ATTRIBUTES)
        )
    )
    f, *_ = _two()
    q["delta_changed_only"] = f.sql(
        "\nUNION ALL ".join(f"SELECT {D.MAP_COLS}, '{a}' AS attribute FROM u2_delta{i}" for i, a in enumerate(ATTRIBUTES))
    )
    q.update(_stages_sql())

    f, t1, t2, _, _ = _two()
    q["state_scan"] = f.sql(Fold.state_long(t1))
    for i, a in enumerate(ATTRIBUTES):
        f, t1, t2, _, _ = _two()
        q[f"update_{a}"] = f.sql(f"SELECT {D.MAP_COLS} FROM {mapping(t2, a)}")
    f, t = _single()
    q["update_mappings"] = f.sql(Fold.state_long(t))
    f, t1, t2, _, _ = _two()
    q["update_two_batches"] = f.sql(Fold.state_long(t2))
    f, t1, t2, _, _ = _two()
    q["state_counts"] = f.sql(
        f"SELECT attribute, count(*) AS n_rows FROM ({Fold.state_long(t2)}) GROUP BY attribute"
    )
    f, t1, t2, _, _ = _two()
    prio = "CASE attribute " + " ".join(f"WHEN '{a}' THEN {i + 1}" for i, a in enumerate(ATTRIBUTES)) + " END"
    q["cluster_members"] = f.sql(
        f"SELECT match_id, CAST({prio} AS INTEGER) AS priority, attribute, value, datetime FROM ({Fold.state_long(t2)})"
    )
    q["match_ids"] = _match(_state1)
    q["dnb_match"] = _dnb(_state1)
    q["update_then_match"] = _match(_single)
    q["update_then_dnb_match"] = _dnb(_single)
    f, t2 = _state2()
    detail = f.match_rel("md", _match_batch(f), t2)
    q["priority_coalesce"] = f.sql(f"SELECT id, aggr_match_id AS match_id FROM {detail}")
    f, t2 = _state2()
    detail = f.match_rel("md", _match_batch(f), t2)
    q["similarity_string"] = f.sql(f"SELECT id, similarity FROM {detail}")
    f, t2 = _state2()
    q["latest_duns_per_match"] = f.sql(
        f"SELECT DISTINCT ON (match_id) match_id, value AS duns_number, datetime FROM {mapping(t2, 'duns_number')} "
        "ORDER BY match_id, datetime DESC, value"
    )
    q["stream_update"] = q["update_two_batches"]
    return q
