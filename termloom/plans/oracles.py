"""The same answers in DuckDB SQL, computed from the numbers and never through rendered text."""

from __future__ import annotations

ORBITALS = """orb AS (SELECT l_orderkey, l_linenumber,
 [2,4,6,2,4,2,6][l_linenumber] AS g,
 (sum(l_quantity)::BIGINT % ([2,4,6,2,4,2,6][l_linenumber] + 1))::INT AS n,
 (sum(l_suppkey) % 12)::INT AS q, (sum(l_partkey) % 12)::INT AS j0
 FROM lineitem GROUP BY 1, 2),
lastl AS (SELECT l_orderkey, max(l_linenumber) AS ml FROM orb GROUP BY 1),
trip AS (SELECT o.l_orderkey, o.l_linenumber, g, n, CASE WHEN n = 0 THEN 0 ELSE q END AS q,
 CASE WHEN n = 0 THEN 0 WHEN l_linenumber = ml THEN j0 WHEN j0 = 0 THEN q ELSE j0 END AS j
 FROM orb o JOIN lastl l ON o.l_orderkey = l.l_orderkey)"""

CAPS = (2, 4, 6, 2, 4, 2, 6)


def _raw() -> str:
    cells = [f"coalesce(max(CASE WHEN l_linenumber = {k // 3 + 1} THEN {'nqj'[k % 3]} END), 0)::INT AS col_{k}" for k in range(21)]
    return f"WITH {ORBITALS} SELECT l_orderkey AS idx, {', '.join(cells)} FROM trip GROUP BY 1"


def _normalized() -> str:
    cells = []
    for i in range(7):
        for f in range(3):
            cells.append(f"coalesce(max(CASE WHEN l_linenumber = {i + 1} THEN {('c0', 'c1', 'c2')[f]} END), 0)::FLOAT AS col_{3 * i + f}")
    return f"""WITH {ORBITALS},
tj AS (SELECT l_orderkey, coalesce(arg_max(j, l_linenumber) FILTER (n > 0), 0) AS t FROM trip GROUP BY 1),
u AS (SELECT p.*, t, n * (g - n) AS u FROM trip p JOIN tj ON p.l_orderkey = tj.l_orderkey),
w AS (SELECT *, sum(u) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) AS pre,
 sum(u) OVER (PARTITION BY l_orderkey) AS tot FROM u),
c AS (SELECT l_orderkey, l_linenumber, n::DOUBLE / g AS c0, CASE WHEN u = 0 THEN 0 ELSE q::DOUBLE / u END AS c1,
 CASE WHEN least(pre, t + tot - pre) = 0 THEN 0 ELSE j::DOUBLE / least(pre, t + tot - pre)::DOUBLE END AS c2 FROM w)
SELECT l_orderkey AS idx, {", ".join(cells)} FROM c GROUP BY 1"""


_EMB = ", ".join(f"embedding[{k + 1}]::DOUBLE AS col_{k}" for k in range(64))
_ROUND = ", ".join(
    (f"CASE WHEN vec_id % 7 = {k % 7} THEN floor(embedding[{k + 1}]::DOUBLE * 8) / 8 ELSE embedding[{k + 1}]::DOUBLE END AS n_{k}" if k % 3 else f"embedding[{k + 1}]::DOUBLE AS n_{k}")
    for k in range(64)
)
_LINES = "WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS v FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, unnest(v[6:]) AS value FROM d)"
_TOKENS = "array_to_string(list_filter(regexp_split_to_array(trim({0}, ' \t\r'), '\\s+'), lambda t: regexp_full_match(t, '[\\pL\\pN+_-]+') AND regexp_matches(t, '\\pL')), '|')"
_ITEMS = "VALUES ('s ', 2, -1), ('p-', 2, 1), ('p ', 4, -2), ('d-', 4, 2), ('d ', 6, -3), ('f-', 6, 3), ('f ', 8, -4), ('g-', 8, 4), ('g ', 10, -5), ('h-', 10, 5), ('h ', 12, -6), ('i-', 12, 6), ('i ', 14, -7)"

ORACLES: dict[str, str] = {
    "normalized_order_descriptors": _normalized(),
    "full_pipeline_roundtrip": _normalized(),
    "column_engine_descriptors": _normalized(),
    "raw_order_descriptors": _raw(),
    "target_two_j": f"WITH {ORBITALS} SELECT l_orderkey AS idx, coalesce(arg_max(j, l_linenumber) FILTER (n > 0), 0)::INT AS two_j FROM trip GROUP BY 1",
    "prefix_suffix_bounds": f"""WITH {ORBITALS} SELECT l_orderkey, l_linenumber, (n * (g - n))::BIGINT AS u,
 (sum(n * (g - n)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING))::BIGINT AS prefix_bound,
 coalesce(sum(n * (g - n)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)::BIGINT AS suffix_bound FROM orb""",
    "two_j_parse": "SELECT p_partkey, (CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 1 THEN 2 * p_size WHEN 2 THEN 2 * p_size WHEN 4 THEN 2 * p_size END)::INT AS two_j FROM part",
    "subshell_metadata": f"""WITH m(angular, g, kappa) AS ({_ITEMS}), p AS (SELECT p_partkey, p_size, ['s ', 'p-', 'p ', 'd-', 'd ', 'f-', 'f ', 'g-', 'g ', 'h-', 'h ', 'i-', 'i ', 'xyz'][p_size % 14 + 1] AS a FROM part)
SELECT p_partkey, a AS angular, g::INT AS g, (kappa * kappa)::INT AS kappa_squared, (p_size::DOUBLE / g)::FLOAT AS fraction FROM p LEFT JOIN m ON p.a = m.angular""",
    "subshell_limits": "SELECT angular, g::INT AS g, kappa::INT AS kappa FROM subshell_meta",
    "line_records": """WITH d AS (SELECT doc_id, string_split(text, chr(10))[6:] AS v FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, v, unnest(range(0, len(v) // 3)) AS rec FROM d)
SELECT doc_id, rec::BIGINT AS rec, v[3 * rec + 1] AS line1, v[3 * rec + 2] AS line2, v[3 * rec + 3] AS line3 FROM r""",
    "conversion_counts": """WITH d AS (SELECT doc_id, string_split(text, chr(10))[6:] AS v FROM documents WHERE strlen(text) = length(text))
SELECT doc_id, len(v)::BIGINT AS total_lines, (len(v) // 3)::BIGINT AS csf_count,
 len(list_filter(v[1:3 * (len(v) // 3)], lambda x: length(x) > 256))::BIGINT AS truncated_count FROM d""",
    "truncated_lines": f"{_LINES} SELECT doc_id, sum((length(value) > 40)::INT)::BIGINT AS cut, max(least(length(value), 40))::BIGINT AS longest FROM l GROUP BY 1",
    "ascii_guard": f"{_LINES} SELECT doc_id, sum((strlen(value) = length(value))::INT)::BIGINT AS ascii_lines, count(*)::BIGINT AS n_lines FROM l GROUP BY 1",
    "peel_tokens": f"WITH d AS (SELECT doc_id, string_split(text, chr(10))[4] AS x FROM documents WHERE text IS NOT NULL) SELECT doc_id, {_TOKENS.format('x')} AS tokens FROM d WHERE x IS NOT NULL AND strlen(x) = length(x)",
    "conversion_peel": f"SELECT run_id, {_TOKENS.format('header_lines[4]')} AS peel FROM conversion_stats",
    "array_to_columns": "SELECT vec_id, " + ", ".join(f"embedding[{k + 1}] AS col_{k}" for k in range(64)) + " FROM embeddings",
    "last_nonzero_triplet": """WITH e AS (SELECT vec_id, list_transform(embedding[1:63], lambda x: floor(x::DOUBLE * 4)::INT) AS d FROM embeddings),
t AS (SELECT vec_id, d, list_filter(range(0, 21), lambda i: d[3 * i + 1] > 0) AS hit FROM e)
SELECT vec_id, coalesce(d[3 * hit[len(hit)] + 3], 0)::INT AS two_j FROM t""",
    "descriptor_range_report": f"""WITH e AS (SELECT {_EMB} FROM embeddings)
SELECT min(least({", ".join(f"col_{k}" for k in range(64))})) AS min_value, max(greatest({", ".join(f"col_{k}" for k in range(64))})) AS max_value,
 sum({" + ".join(f"(col_{k} > 1.000001)::INT" for k in range(64))})::BIGINT AS cells_above, sum({" + ".join(f"(col_{k} < -0.000001)::INT" for k in range(64))})::BIGINT AS cells_below FROM e""",
    "descriptor_diff_columns": f"""WITH e AS (SELECT {_EMB}, {_ROUND} FROM embeddings), m AS (SELECT {", ".join(f"max(abs(col_{k} - n_{k})) AS col_{k}" for k in range(64))} FROM e),
u AS (UNPIVOT m ON COLUMNS(*) INTO NAME "column" VALUE max_abs_diff)
SELECT "column", 'orbital' || (substr("column", 5)::INT // 3) AS subshell, ['electron_count', 'middle_j', 'coupling_j'][substr("column", 5)::INT % 3 + 1] AS field, max_abs_diff FROM u WHERE max_abs_diff > 1e-6""",
    "descriptor_diff_rows": f"""WITH e AS (SELECT vec_id, {_EMB}, {_ROUND} FROM embeddings)
SELECT vec_id AS idx FROM e WHERE greatest({", ".join(f"abs(col_{k} - n_{k})" for k in range(64))}) > 1e-6""",
    "unknown_subshell_counts": f"WITH {ORBITALS} SELECT ['5s', '4d-', '4d', '5p-', '5p', '6s', '4f-'][l_linenumber] AS subshell, count(*)::BIGINT AS n_blocks FROM orb WHERE l_linenumber IN (5, 7) GROUP BY 1",
    "parquet_info": "SELECT (SELECT count(*) FROM lineitem)::BIGINT AS num_rows, (SELECT count(*) FROM (DESCRIBE lineitem))::BIGINT AS num_columns",
}


def _csf_raw_cells() -> str:
    """Parse of csf_table with list functions: a second reading of the record rules, for records in the clean grid."""
    j = "CASE WHEN regexp_full_match({0}, '[+-]?[0-9]+/.*') THEN try_cast(split_part({0}, '/', 1) AS INT) WHEN regexp_full_match(rtrim(rtrim({0}, '-'), '+'), '[+-]?[0-9]+') THEN 2 * try_cast(rtrim(rtrim({0}, '-'), '+') AS INT) END"
    two = lambda x: j.format(f"trim({x})")
    cells = ", ".join(
        f"coalesce(max(CASE WHEN name = (SELECT subshell FROM peel WHERE pos = {k // 3}) THEN {'nqj'[k % 3]} END), 0)::INT AS col_{k}" for k in range(87)
    )
    return f"""WITH t AS (SELECT row_number() OVER () AS rn, idx, run_id, rtrim(line1) AS a, rtrim(line2) AS b, rtrim(line3) AS c FROM csf_table),
f AS (SELECT *, CASE WHEN length(c) >= 9 THEN substr(c, 5, length(c) - 9) ELSE c END AS core,
 {two("substr(c, greatest(length(c) - 5, 0) + 1, greatest(length(c) - 1, 0) - greatest(length(c) - 5, 0))")} AS fin,
 ((length(a) + 8) // 9)::INT AS nb FROM t),
s AS (SELECT *, unnest(range(0, nb)) AS i FROM f WHERE fin IS NOT NULL AND strlen(a || b || c) = length(a || b || c)),
p AS (SELECT rn, i, nb, fin, substr(a, 9 * i::INT + 1, 9) AS b1, trim(substr(b, 9 * i::INT + 1, 9)) AS b2, trim(substr(core, 9 * i::INT + 1, 9)) AS b3 FROM s),
m AS (SELECT *, CASE WHEN length(b1) >= 5 THEN trim(substr(b1, 1, 5)) ELSE '' END AS name,
 CASE WHEN length(b1) >= 8 THEN coalesce(try_cast(trim(substr(b1, 7, 2)) AS INT), 0) ELSE 0 END AS n,
 coalesce({two("CASE WHEN b2 LIKE '%;%' THEN split_part(b2, ';', 2) ELSE b2 END")}, 0) AS mid, coalesce({two("b3")}, 0) AS cj FROM p),
o AS (SELECT rn, name, i, n, CASE WHEN n = 0 THEN 0 ELSE mid END AS q,
 CASE WHEN n = 0 THEN 0 WHEN i = nb - 1 THEN fin WHEN b3 <> '' THEN cj ELSE mid END AS j FROM m),
w AS (SELECT rn, {cells} FROM o GROUP BY rn)
SELECT t.idx, t.run_id, {", ".join(f"coalesce(col_{k}, 0)::INT AS col_{k}" for k in range(87))} FROM t LEFT JOIN w ON t.rn = w.rn"""


ORACLES["csf_descriptors"] = _csf_raw_cells()


def _csf_normalized_cells() -> str:
    """The normalization over lists of the raw cells; a row whose electrons or target are out of range is zeros."""
    lists = ", ".join(f"[{', '.join(f'col_{3 * i + f}' for i in range(29))}] AS {'nqj'[f]}" for f in range(3))
    cells = []
    for i in range(1, 30):
        cells += [f"n[{i}]::DOUBLE / g[{i}]", f"CASE WHEN u[{i}] = 0 THEN 0 ELSE q[{i}]::DOUBLE / u[{i}] END", f"CASE WHEN least(p[{i}], t + tot - p[{i}]) = 0 THEN 0 ELSE j[{i}]::DOUBLE / least(p[{i}], t + tot - p[{i}]) END"]
    return f"""WITH raw AS ({_csf_raw_cells()}),
caps AS (SELECT list(m.g ORDER BY p.pos) AS g FROM peel p JOIN subshell_meta m ON rpad(ltrim(p.subshell, '0123456789'), 2, ' ') = m.angular),
a AS (SELECT idx, run_id, {lists}, g FROM raw, caps),
b AS (SELECT *, list_transform(range(1, 30), lambda i: n[i] * (g[i] - n[i])) AS u, coalesce(j[list_max(list_filter(range(1, 30), lambda i: n[i] > 0))], 0) AS t,
 len(list_filter(range(1, 30), lambda i: n[i] < 0 OR n[i] > g[i])) = 0 AS ok FROM a),
c AS (SELECT *, list_transform(range(1, 30), lambda i: list_sum(u[1:i])::BIGINT) AS p, list_sum(u)::BIGINT AS tot FROM b)
SELECT idx, run_id, {", ".join(f"(CASE WHEN ok AND t >= 0 THEN {x} ELSE 0 END)::FLOAT AS col_{k}" for k, x in enumerate(cells))} FROM c"""


ORACLES["csf_descriptors_normalized"] = _csf_normalized_cells()
_EVERY = ", ".join(f"col_{k}" for k in range(87))
ORACLES["csf_descriptor_range"] = f"""WITH d AS ({_csf_normalized_cells()}) SELECT min(least({_EVERY})) AS min_value, max(greatest({_EVERY})) AS max_value,
 sum({" + ".join(f"(col_{k} > 1.000001)::INT" for k in range(87))})::BIGINT AS cells_above, sum({" + ".join(f"(col_{k} < -0.000001)::INT" for k in range(87))})::BIGINT AS cells_below FROM d"""
ORACLES["described_in_order"] = f"SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, * EXCLUDE (idx) FROM ({_normalized()})"
# blocks of 9 characters; line3 is two longer than the others, so five blocks pass 40 characters in all three lines
ORACLES["converted_counts"] = f"""WITH {ORBITALS}, b AS (SELECT l_orderkey, count(*) AS nb FROM orb GROUP BY 1)
SELECT count(*)::BIGINT AS csf_count, (3 * count(*))::BIGINT AS total_lines, (3 * count(*) FILTER (nb >= 5))::BIGINT AS truncated_count FROM b"""
_CHANGED = [k for k in range(64) if k % 3]
_DIFFERS = f"greatest({', '.join(f'abs(col_{k} - n_{k})' for k in range(64))})"
ORACLES["descriptor_samples"] = f"""WITH e AS (SELECT vec_id, {_EMB}, {_ROUND} FROM embeddings)
SELECT vec_id AS idx, {", ".join(f"col_{k} AS o_col_{k}, n_{k} AS n_col_{k}" for k in _CHANGED[:8])} FROM e WHERE {_DIFFERS} > 1e-6 ORDER BY vec_id LIMIT 10"""
ORACLES["descriptor_rows_unequal"] = f"""WITH e AS (SELECT {_EMB}, {_ROUND} FROM embeddings), n AS (SELECT count(*)::BIGINT AS n FROM e WHERE {_DIFFERS} > 0)
SELECT side, n FROM n, (VALUES ('old'), ('new')) s(side) WHERE n > 0"""
ORACLES["descriptor_overall_max"] = f"WITH e AS (SELECT {_EMB}, {_ROUND} FROM embeddings) SELECT max({_DIFFERS}) AS max_abs_diff FROM e"

CELLS = [f"col_{k}" for k in range(87)]
_J = "(?:[0-9]*[13579]/2|[0-9]+)"
_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_SPLIT = f"""cut AS (SELECT raw_id, CASE WHEN raw_text LIKE '%' || chr(13) THEN raw_text[:-2] ELSE raw_text END AS t FROM csf_raw),
parts AS (SELECT raw_id, t, regexp_full_match(t, '(?s){_FIELD}(?:,{_FIELD}){{4}}') AS shaped,
 regexp_extract(t, '(?s)^({_FIELD}),({_FIELD}),({_FIELD}),({_FIELD}),({_FIELD})$', ['a', 'b', 'c', 'd', 'e']) AS f FROM cut),
plain AS (SELECT raw_id, coalesce(shaped, false) AS shaped, {", ".join(f"CASE WHEN f.{k} LIKE '{chr(34)}%' THEN replace(f.{k}[2:-2], '{chr(34) * 2}', '{chr(34)}') ELSE f.{k} END AS {n}" for k, n in zip("abcde", ("idx", "l1", "l2", "l3", "note")))} FROM parts),
allowed AS (SELECT '(?:' || string_agg(k, '|') || ')+' AS pattern FROM (
 SELECT lpad(rtrim(subshell, '-'), 4, ' ') || CASE WHEN subshell LIKE '%-' THEN '-' ELSE ' ' END || '\\((?:' ||
  (SELECT string_agg(lpad(i::VARCHAR, 2, ' '), '|') FROM range(1, m.g::BIGINT + 1) r(i)) || ')\\)' AS k
 FROM peel p JOIN subshell_meta m ON rpad(ltrim(p.subshell, '0123456789'), 2, ' ') = m.angular)),
judged AS (SELECT *, shaped AND regexp_full_match(idx, '[0-9]+') AND strlen(l1 || l2 || l3) = length(l1 || l2 || l3) AND NOT contains(l1 || l2 || l3, chr(9))
 AND regexp_full_match(l1, pattern) AND length(l2) <= length(l1)
 AND len(list_filter(range(0, (length(l2) + 8) // 9), lambda i: NOT regexp_full_match(trim(substr(l2, 9 * i::INT + 1, 9), ' '), '|{_J}|[0-9]+; *{_J}'))) = 0
 AND length(l3) = length(l1) + 2 AND regexp_full_match(l3[-1:], '[+-]') AND regexp_full_match(trim(l3[-5:-2], ' '), '{_J}')
 AND len(list_filter(range(0, (greatest(length(l3) - 9, 0) + 8) // 9), lambda i: NOT regexp_full_match(trim(substr(substr(l3, 5, greatest(length(l3) - 9, 0)), 9 * i::INT + 1, 9), ' '), '|{_J}'))) = 0 AS valid
 FROM plain, allowed)"""

ORACLES["p1_found"] = f"WITH {_SPLIT} SELECT raw_id FROM judged WHERE NOT coalesce(valid, false)"
ORACLES["p1_loaded"] = f"""WITH {_SPLIT} SELECT j.raw_id, r.file_id, r.received_at, try_cast(idx AS BIGINT) AS idx, l1 AS line1, l2 AS line2, l3 AS line3, note
FROM judged j JOIN csf_raw r USING (raw_id) WHERE valid"""
_REASONS = {
    "NOT regexp_full_match(idx, '[0-9]+')": "idx is not a number of digits",
    **{f"strlen({c}) <> length({c})": f"line{c[1]} is not ASCII" for c in ("l1", "l2", "l3")},
    **{f"contains({c}, chr(9))": f"line{c[1]} holds a tab" for c in ("l1", "l2", "l3")},
    "NOT regexp_full_match(l1, pattern)": "line1 has an invalid block",
    "length(l2) > length(l1)": "line2 is longer than line1",
    f"len(list_filter(range(0, (length(l2) + 8) // 9), lambda i: NOT regexp_full_match(trim(substr(l2, 9 * i::INT + 1, 9), ' '), '|{_J}|[0-9]+; *{_J}'))) > 0": "line2 has an invalid block",
    "length(l3) <> length(l1) + 2": "line3 has the wrong length",
    "NOT regexp_full_match(l3[-1:], '[+-]')": "line3 has no parity",
    f"NOT regexp_full_match(trim(l3[-5:-2], ' '), '{_J}')": "line3 has no final J",
    f"len(list_filter(range(0, (greatest(length(l3) - 9, 0) + 8) // 9), lambda i: NOT regexp_full_match(trim(substr(substr(l3, 5, greatest(length(l3) - 9, 0)), 9 * i::INT + 1, 9), ' '), '|{_J}'))) > 0": "line3 has an invalid block",
}
ORACLES["p1_reasons"] = f"""WITH {_SPLIT}, quoting AS (SELECT raw_id, t, regexp_full_match(t, '(?s){_FIELD}(?:,{_FIELD})*') AS q,
 length(regexp_replace(regexp_replace(t, '(?s)"(?:[^"]|"")*"', '', 'g'), '[^,]', '', 'g')) + 1 AS n FROM cut),
why AS (SELECT q.raw_id, CASE WHEN q.t IS NULL THEN ['record is null'] WHEN NOT q THEN ['broken quotes'] WHEN n < 5 THEN ['missing columns'] WHEN n > 5 THEN ['too many columns']
 ELSE list_filter([{", ".join(f"CASE WHEN {test} THEN '{reason}' END" for test, reason in _REASONS.items())}], lambda x: x IS NOT NULL) END AS reasons FROM quoting q JOIN judged j USING (raw_id))
SELECT file_id, reason, count(*)::BIGINT AS n_records FROM (SELECT raw_id, unnest(reasons) AS reason FROM why) JOIN csf_raw USING (raw_id) GROUP BY 1, 2"""
_P4 = f"""WITH a AS (SELECT DISTINCT idx, {", ".join(CELLS)} FROM descriptor_raw), b AS (SELECT DISTINCT idx, {", ".join(CELLS)} FROM descriptor_copy),
j AS (SELECT a.idx AS ia, b.idx AS ib, {", ".join(f"a.{c} IS DISTINCT FROM b.{c} AS {c}" for c in CELLS)} FROM a FULL JOIN b ON a.idx = b.idx),
found AS (SELECT ia AS idx, 'only_raw' AS field FROM j WHERE ib IS NULL UNION ALL SELECT ib, 'only_copy' FROM j WHERE ia IS NULL
 UNION ALL SELECT ia, field FROM (UNPIVOT (SELECT * FROM j WHERE ia IS NOT NULL AND ib IS NOT NULL) ON {", ".join(CELLS)} INTO NAME field VALUE d) WHERE d)"""
ORACLES["p4_found"] = _P4 + " SELECT idx, field FROM found"
ORACLES["p4_summary"] = _P4 + " SELECT field, count(*)::BIGINT AS n_idx FROM found GROUP BY 1"
_G = "(SELECT p.pos, m.g FROM peel p JOIN subshell_meta m ON rpad(ltrim(p.subshell, '0123456789'), 2, ' ') = m.angular)"
_LONG = f"""long AS (SELECT load_id, field, value FROM (SELECT load_id, {", ".join(CELLS)} FROM descriptor_raw) UNPIVOT INCLUDE NULLS (value FOR field IN ({", ".join(CELLS)}))),
lim AS (SELECT 'col_' || (3 * pos + k) AS field, (3 * pos + k) AS k, CASE WHEN k = 0 THEN g ELSE 80 END AS high FROM {_G}, (VALUES (0), (1), (2)) o(k))"""
_RULES = f"""{_LONG},
r AS (SELECT load_id, l.field, k, value, value BETWEEN 0 AND high AS ok FROM long l JOIN lim ON l.field = lim.field),
m AS (SELECT load_id, field, k, avg((value IS NULL)::INT) AS nulls, max((value IS NOT NULL AND NOT ok)::INT) AS bad, avg(value) FILTER (ok) AS mean FROM r GROUP BY 1, 2, 3),
t AS (SELECT field, median(mean) AS typical FROM m GROUP BY 1), d AS (SELECT field, stddev_pop(value) FILTER (ok) AS sd FROM r GROUP BY 1),
odd AS ({" UNION ALL ".join(f"SELECT load_id, 'col_{3 * i + 1}' AS field, count(*) AS odd_parity FROM descriptor_raw WHERE col_{3 * i} BETWEEN 0 AND (SELECT g FROM {_G} WHERE pos = {i}) AND col_{3 * i + 1} BETWEEN 0 AND 80 AND col_{3 * i} % 2 <> col_{3 * i + 1} % 2 GROUP BY 1" for i in range(29))}),
why AS (SELECT load_id, field, coalesce(odd_parity, 0)::BIGINT AS odd_parity, array_to_string(list_filter([CASE WHEN nulls > 0.05 THEN 'nulls' END, CASE WHEN bad = 1 THEN 'out of range' END,
 CASE WHEN odd_parity > 0 THEN 'parity of n and 2Q differs' END, CASE WHEN k < 30 AND abs(mean - typical) > 0.5 * sd THEN 'shifted mean' END], lambda x: x IS NOT NULL), ', ') AS spoiled
 FROM m JOIN t USING (field) JOIN d USING (field) LEFT JOIN odd USING (load_id, field))"""
ORACLES["p5_found"] = f"WITH {_RULES} SELECT load_id, field FROM why WHERE spoiled <> ''"
ORACLES["p5_profile"] = f"""WITH {_RULES},
c AS (SELECT load_id, l.field, value, high, count(*) AS n FROM long l JOIN lim ON l.field = lim.field GROUP BY ALL),
s AS (SELECT *, sum(n) FILTER (value IS NOT NULL) OVER (PARTITION BY load_id, field) AS tot FROM c),
p AS (SELECT load_id, field, sum(n)::BIGINT AS rows, coalesce(sum(n) FILTER (value IS NULL), 0)::BIGINT AS nulls, count(value)::BIGINT AS distinct_values, min(value)::BIGINT AS min_value, max(value)::BIGINT AS max_value,
 coalesce(sum(n) FILTER (value < 0 OR value > high), 0)::BIGINT AS out_of_range, round(-sum(CASE WHEN value IS NOT NULL THEN n / tot * log2(n / tot) END), 6) + 0.0 AS entropy FROM s GROUP BY 1, 2)
SELECT p.*, odd_parity, nullif(spoiled, '') AS spoiled FROM p JOIN why USING (load_id, field)"""
