"""DuckDB statements of the operators whose SQL is long."""


def crc32(text: str) -> str:
    """The unsigned crc32 of the UTF-8 bytes of a text column, bit by bit."""
    parts = f"list_transform(range(1, 2 * strlen({text}) + 1, 2), lambda i: ('0x' || substr(hex({text}), i, 2))::BIGINT)"
    bit = "lambda r, z: xor(r >> 1, 3988292384 * (r & 1))"
    step = f"lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], {bit})"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {parts}), {step}))"


def _row_ways() -> str:
    """(code, p, q, price, word): every way over inserts and the edit of a row, by the row's code."""
    follows = "(VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)) AS f(p, x, q)"
    return f"""
        inserts AS (
            SELECT p, n, q FROM (VALUES (0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (0, 1, 2), (1, 1, 2), (2, 1, 3), (3, 1, 2),
                                        (0, 2, 3), (1, 2, 3), (2, 2, 2), (3, 2, 3)) AS v(p, n, q)
        ), codes AS (
            SELECT x, more, forced FROM (VALUES ('s'), ('u'), ('a'), ('')) AS i(x), (VALUES (0), (1)) AS m(more), (VALUES (false), (true)) AS d(forced)
        ), edits AS (
            SELECT x, more, forced, p, p AS q, 3 AS price, 'D' AS letter FROM codes, range(4) AS s(p)
            UNION ALL
            SELECT c.x, more, forced, f.p, f.q, more, 'K' FROM codes c JOIN {follows} ON f.x = c.x WHERE NOT forced
            UNION ALL
            SELECT c.x, more, forced, f.p, f.q, 2 + more, 'R' FROM codes c, {follows} WHERE f.x <> 's' AND NOT forced
        ), ways AS (
            SELECT x, more, forced, i.p, e.q, 2 * n + price AS price, repeat('I', n) || letter AS word
            FROM inserts i JOIN edits e ON i.q = e.p
        )"""


CONVERSATION_REPAIR = rf"""
    WITH RECURSIVE {_row_ways()}, damage AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
        FROM conversations
    ), hashed AS (
        SELECT *, {crc32('k')} % 20 AS kind FROM damage
    ), rows AS (
        SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM hashed, range(2) AS c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM rows)
    ), marked AS (
        SELECT *, substr(role, 1, 1) AS x, lead(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS next_x,
               CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again > 1 THEN 'duplicate'
                    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
        FROM placed
    ), coded AS (
        SELECT *, CASE WHEN x IN ('s', 'u', 'a') THEN x ELSE '' END AS cls, CAST(fault = 'truncated' AS INT) AS more,
               fault IN ('blank', 'duplicate') AS forced, count(*) OVER (PARTITION BY conv_id) AS n
        FROM marked
    ), best AS (
        SELECT conv_id, n AS i, s.p, CASE s.p WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END AS price,
               CASE s.p WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit
        FROM (SELECT DISTINCT conv_id, n FROM coded), range(4) AS s(p)
        UNION ALL
        SELECT conv_id, i, p, b.price, b.audit FROM (
            SELECT c.conv_id, c.i - 1 AS i, w.p, min({{'price': w.price + t.price, 'audit': w.word || t.audit}}) AS b
            FROM best t JOIN coded c ON c.conv_id IS NOT DISTINCT FROM t.conv_id AND c.i = t.i
            JOIN ways w ON w.x = c.cls AND w.more = c.more AND w.forced = c.forced AND w.q = t.p
            GROUP BY ALL
        )
    ), audits AS (
        SELECT conv_id, price AS cost, audit, regexp_extract_all(audit, 'I*[DKR]') AS words FROM best WHERE i = 0 AND p = 0
    ), edited AS (
        SELECT c.*, a.audit, a.words[c.i] AS word,
               len(replace(array_to_string(a.words[:c.i - 1], ''), 'D', '')) AS before
        FROM coded c JOIN audits a ON c.conv_id IS NOT DISTINCT FROM a.conv_id
    ), starts AS (
        -- a system row can only be the first that is left
        SELECT conv_id, max(CASE WHEN x = 's' AND word = 'K' AND before = 0 THEN 1 ELSE 0 END) AS lead_s FROM edited GROUP BY conv_id
    ), lines AS (
        SELECT e.conv_id, e.i, j, substr(word, j, 1) AS letter, before + j - 1 - lead_s AS parity, role, text
        FROM edited e JOIN starts s ON e.conv_id IS NOT DISTINCT FROM s.conv_id, range(1, 4) AS r(j) WHERE j <= len(word) AND substr(word, j, 1) <> 'D'
        UNION ALL
        SELECT a.conv_id, 1000000000, j, 'I', len(replace(array_to_string(a.words, ''), 'D', '')) + j - 1 - lead_s, '', ''
        FROM audits a JOIN starts s ON a.conv_id IS NOT DISTINCT FROM s.conv_id, range(1, 4) AS r(j) WHERE j <= len(regexp_extract(a.audit, 'I*$'))
    ), repaired AS (
        SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role || ':' || text
                                        ELSE CASE WHEN parity % 2 = 0 THEN 'user:' ELSE 'assistant:' END || CASE letter WHEN 'R' THEN text ELSE '' END END,
                                   chr(10) ORDER BY i, j) AS text
        FROM lines GROUP BY conv_id
    ), counts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
               count(*) FILTER (next_x IS NOT NULL AND x || next_x NOT IN ('su', 'ua', 'au')) AS illegal
        FROM coded GROUP BY conv_id
    ), ids AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
           coalesce(audit, '') AS audit, sha256(coalesce(r.text, '')) AS repaired_sha256
    FROM ids LEFT JOIN counts c ON ids.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN audits a ON ids.conv_id IS NOT DISTINCT FROM a.conv_id
    LEFT JOIN repaired r ON ids.conv_id IS NOT DISTINCT FROM r.conv_id
"""


# words that differ by one letter share what is left when each loses one, at the same place (replaced),
# or one is what is left of the other (inserted)
SPELLING_VARIANTS = f"""
    WITH RECURSIVE runs AS (
        SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')),
                                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
        FROM documents
    ), counted AS (
        SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS k, count(*) AS n FROM runs GROUP BY ALL
    ), hashed AS (
        SELECT run, n, {crc32('k')} AS h FROM counted
    ), words AS (
        SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % len(run) AS INT)) || substr(run, CAST(h % len(run) AS INT) + 2) ELSE run END AS word,
               CAST(sum(n) AS BIGINT) AS n
        FROM hashed GROUP BY 1 HAVING len(word) >= 5 AND sum(n) >= 3
    ), holes AS (
        SELECT word, n, i, substr(word, 1, CAST(i - 1 AS INT)) AS a, substr(word, CAST(i + 1 AS INT)) AS b FROM words, range(1, 5000) AS r(i) WHERE i <= len(word)
    ), near AS (
        SELECT x.word, y.word AS other, y.n AS other_n FROM holes x JOIN holes y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
        UNION
        SELECT w.word, h.word, h.n FROM words w JOIN holes h ON w.word = h.a || h.b
        UNION
        SELECT h.word, w.word, w.n FROM words w JOIN holes h ON w.word = h.a || h.b
    ), best AS (
        SELECT word, count(*) AS n_near, min({{'n': -other_n, 'w': other}}) AS b FROM near GROUP BY word
    ), forms AS (
        SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.b.n >= 2 * w.n THEN b.b.w END AS form, CASE WHEN -b.b.n >= 2 * w.n THEN -b.b.n END AS form_n
        FROM words w LEFT JOIN best b ON w.word = b.word
    ), walk AS (
        SELECT word, word AS root FROM forms
        UNION ALL
        SELECT walk.word, forms.form FROM walk JOIN forms ON walk.root = forms.word WHERE forms.form IS NOT NULL
    ), ends AS (
        SELECT walk.word, walk.root FROM walk JOIN forms ON walk.root = forms.word WHERE forms.form IS NULL
    )
    SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN ends ON f.word = ends.word
"""
