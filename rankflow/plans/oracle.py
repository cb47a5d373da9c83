"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

The driver's tables are views with their own names.  The iterative loops
are one recursive CTE each: working rows (i, id, r, delta, dfix), anchor
i = 0 with rank 1.0, the recursive part computes one update and attaches
the deltas of that update to every row; a row only recurses while the stop
rule says to continue.
"""

from __future__ import annotations

SQL: dict[str, str] = {}

# ------------------------------------------------------------ input graphs

CO_PURCHASE = """
SELECT src, dst FROM (
  SELECT l_partkey AS src,
         lead(l_partkey) OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS dst
  FROM lineitem) WHERE dst IS NOT NULL"""

SUPPLY = """
SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS src, 'P' || CAST(l_partkey AS VARCHAR) AS dst
FROM lineitem"""

PAGE_LINKS = """
SELECT 'p' || CAST(page_id AS VARCHAR) AS src,
       unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst
FROM pages"""

GRAPHS = {"co_purchase": CO_PURCHASE, "supply": SUPPLY, "page_links": PAGE_LINKS}

EDGE_TEXT = """
SELECT CASE
  WHEN nxt IS NULL AND l_orderkey % 2 = 0 THEN '# order ' || CAST(l_orderkey AS VARCHAR)
  WHEN nxt IS NULL THEN CAST(l_partkey AS VARCHAR)
  WHEN (l_partkey + nxt) % 4 = 0 THEN CAST(l_partkey AS VARCHAR) || chr(9) || CAST(nxt AS VARCHAR)
  WHEN (l_partkey + nxt) % 4 = 1 THEN CAST(l_partkey AS VARCHAR) || ' ' || CAST(nxt AS VARCHAR)
                                     || ' ' || CAST(l_linenumber AS VARCHAR)
  WHEN (l_partkey + nxt) % 4 = 2 THEN ' ' || chr(9) || CAST(l_partkey AS VARCHAR) || '  '
                                     || CAST(nxt AS VARCHAR)
  ELSE CAST(l_partkey AS VARCHAR) || chr(9) || chr(9) || CAST(nxt AS VARCHAR) || chr(9)
END AS value FROM (
  SELECT l_orderkey, l_partkey, l_linenumber,
         lead(l_partkey) OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS nxt
  FROM lineitem)"""


def _adjacency(edges: str) -> str:
    return f"""
  SELECT v.id, coalesce(a.nbrs, []) AS nbrs FROM
    (SELECT src AS id FROM ({edges}) UNION SELECT dst FROM ({edges})) v
    LEFT JOIN (SELECT src, list_sort(list(dst)) AS nbrs FROM ({edges}) GROUP BY src) a
    ON v.id = a.src"""


def _joined(col: str) -> str:
    return f"array_to_string(list_transform({col}, lambda x: CAST(x AS VARCHAR)), ',')"


TSV_GOOD = f"""
SELECT concat_ws(chr(9), CAST(id AS VARCHAR), '1.0', {_joined('nbrs')}) AS value
FROM ({_adjacency(SUPPLY)})"""

TSV_LINES = f"""
{TSV_GOOD}
UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR) FROM supplier
UNION ALL SELECT 'X' || CAST(s_suppkey AS VARCHAR) || chr(9) || 'x' || chr(9)
                 || CAST(s_suppkey AS VARCHAR) FROM supplier"""

JSON_LINES = f"""
SELECT '[' || CAST(id AS VARCHAR) || ',1.0,['
       || array_to_string(list_transform(nbrs, lambda x: '[' || CAST(x AS VARCHAR) || ',0]'), ',')
       || ']]' AS value
FROM ({_adjacency(CO_PURCHASE)})"""

# Java-style trim (all chars <= U+0020) + split on whitespace runs.
_TOKENS = ("string_split_regex(regexp_replace(regexp_replace(value, '^[\\x00-\\x20]+', ''),"
           " '[\\x00-\\x20]+$', ''), '\\s+')")

SQL["parse_edges"] = f"""
SELECT t[1] AS src, t[2] AS dst FROM (
  SELECT {_TOKENS} AS t FROM ({EDGE_TEXT}) WHERE NOT starts_with(value, '#'))
WHERE len(t) >= 2"""

SQL["edges_to_tsv"] = TSV_GOOD

SQL["parse_tsv"] = f"""
SELECT p[1] AS id, TRY_CAST(nullif(p[2], '') AS DOUBLE) AS rank,
       CAST(CASE WHEN coalesce(p[3], '') = '' THEN 0
            ELSE len(string_split(regexp_replace(p[3], ',+$', ''), ',')) END AS INTEGER) AS n_nbrs,
       CASE WHEN coalesce(p[3], '') = '' THEN ''
            ELSE regexp_replace(p[3], ',+$', '') END AS nbrs
FROM (SELECT string_split(regexp_replace(value, chr(9) || '+$', ''), chr(9)) AS p
      FROM ({TSV_LINES}))
WHERE len(p) >= 2"""

SQL["edges_to_json"] = JSON_LINES
SQL["edges_to_json_python"] = f"""
SELECT '[' || CAST(id AS VARCHAR) || ', 1.0, ['
       || array_to_string(list_transform(nbrs, lambda x: '[' || CAST(x AS VARCHAR) || ', 0]'), ', ')
       || ']]' AS value
FROM ({_adjacency(CO_PURCHASE)})"""

SQL["parse_json"] = f"""
SELECT CAST(json_extract(value, '$[0]') AS BIGINT) AS id,
       CAST(json_extract(value, '$[1]') AS DOUBLE) AS value,
       CAST(json_array_length(value, '$[2]') AS INTEGER) AS n_edges,
       coalesce(array_to_string(list_transform(
           CAST(json_extract(value, '$[2]') AS DOUBLE[][]),
           lambda x: CAST(CAST(x[1] AS BIGINT) AS VARCHAR)), ','), '') AS dsts,
       coalesce(list_sum(list_transform(CAST(json_extract(value, '$[2]') AS DOUBLE[][]),
           lambda x: x[2])), 0.0) AS weight_sum
FROM ({JSON_LINES})"""

# ------------------------------------------------------------------ graph

SQL["vertex_set"] = f"SELECT src AS id FROM ({CO_PURCHASE}) UNION SELECT dst FROM ({CO_PURCHASE})"
SQL["vertex_count"] = f"SELECT CAST(count(*) AS BIGINT) AS vertex_count FROM ({SQL['vertex_set']})"


def _out_degree(edges: str) -> str:
    return f"""
SELECT v.id, CAST(coalesce(d.n, 0) AS BIGINT) AS out_degree FROM
  (SELECT src AS id FROM ({edges}) UNION SELECT dst FROM ({edges})) v
  LEFT JOIN (SELECT src, count(*) AS n FROM ({edges}) GROUP BY src) d ON v.id = d.src"""


SQL["out_degree"] = _out_degree(CO_PURCHASE)
SQL["out_degree_sinks"] = _out_degree(PAGE_LINKS)
SQL["adjacency_sorted"] = f"""
SELECT id, CAST(len(nbrs) AS INTEGER) AS n_nbrs, {_joined('nbrs')} AS nbrs
FROM ({_adjacency(CO_PURCHASE)})"""
SQL["adjacency_parts"] = f"""
SELECT src AS id, true AS bounded, row_number() OVER (PARTITION BY src ORDER BY dst) AS place, dst AS nbr
FROM ({CO_PURCHASE})
UNION ALL SELECT id, true, NULL, NULL FROM ({SQL['vertex_set']})
WHERE id NOT IN (SELECT src FROM ({CO_PURCHASE}))"""
SQL["explode_adjacency"] = f"SELECT src, dst FROM ({SUPPLY})"
SQL["init_ranks"] = f"SELECT id, 1.0::DOUBLE AS rank FROM ({SQL['vertex_set']})"

# ------------------------------------------------------------- one update


def _exact(x: str, over: str = "") -> str:
    """Order-free sum of doubles: whole parts and two bins of 31 binary
    places, summed as integers."""
    first = f"(({x}) - floor({x})) * 2147483648::DOUBLE"
    second = f"({first} - floor({first})) * 2147483648::DOUBLE"
    whole, a, b = (f"CAST(sum(CAST(floor({c}) AS BIGINT)){over} AS DOUBLE)" for c in (x, first, second))
    return f"({whole} + ({a} / 2147483648::DOUBLE + {b} / 4611686018427387904::DOUBLE))"


def _step_one(edges: str) -> str:
    return f"""
WITH e AS ({edges}),
od AS (SELECT src, count(*) AS outdeg FROM e GROUP BY src),
v AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
s AS (SELECT dst, {_exact('x')} AS s FROM (
  SELECT e.dst, 1::DOUBLE / od.outdeg * count(*) AS x FROM e JOIN od USING (src)
  GROUP BY e.src, e.dst, od.outdeg) GROUP BY dst)
SELECT v.id, 0.15::DOUBLE + 0.85::DOUBLE * coalesce(s.s, 0) AS rank, 1.0::DOUBLE AS prev
FROM v LEFT JOIN s ON v.id = s.dst"""


SQL["contributions"] = f"""
WITH e AS ({CO_PURCHASE}), od AS (SELECT src, count(*) AS outdeg FROM e GROUP BY src)
SELECT e.dst, round(1.0 / od.outdeg, 6) AS vote FROM e JOIN od USING (src)"""
SQL["rank_step"] = f"SELECT id, round(rank, 6) AS rank, round(prev, 6) AS prev FROM ({_step_one(CO_PURCHASE)})"
SQL["rank_step_sinks"] = f"SELECT id, round(rank, 6) AS rank, round(prev, 6) AS prev FROM ({_step_one(SUPPLY)})"
SQL["l1_delta"] = f"SELECT round(coalesce(sum(abs(rank - prev)), 0), 6) AS delta FROM ({_step_one(CO_PURCHASE)})"
SQL["fixed_point_delta"] = f"""
SELECT round(coalesce(sum(trunc(abs(rank - prev) * 100000)), 0) / 100000.0, 6) AS delta_fixed
FROM ({_step_one(CO_PURCHASE)})"""

# ------------------------------------------------------------------ loops


def rank_loop(edges: str, max_iter: int = 500, tol: float | None = 1e-4,
              delta: str = "l1", min_updates: int | None = None, vertices: str | None = None) -> str:
    """Recursive CTE ``pr(i, id, r, delta, dfix)`` over all updates, with
    order-free sums.  ``vertices``: SQL for all vertices with their start
    values (id, start)."""
    v = vertices or "SELECT id, 1.0::DOUBLE AS start FROM (SELECT src AS id FROM e UNION SELECT dst FROM e)"
    vote, change = _exact("x"), _exact("abs(nr - r)", " OVER ()")
    if min_updates is None:
        min_updates = 1 if delta == "l1" else 2
    col = "p.delta" if delta == "l1" else "p.dfix"
    if tol is None:
        cont = "TRUE"
    else:
        cont = f"({col} >= {tol!r} OR p.i < {min_updates})"
    return f"""
WITH RECURSIVE e AS ({edges}),
v AS ({v}),
od AS (SELECT src, count(*) AS outdeg FROM e GROUP BY src),
ew AS (SELECT e.src, e.dst, od.outdeg, count(*) AS mult FROM e JOIN od USING (src) GROUP BY ALL),
pr(i, id, r, delta, dfix) AS (
  SELECT 0, id, start, 1e300::DOUBLE, 1e300::DOUBLE FROM v
  UNION ALL
  SELECT i + 1, id, nr, {change},
         sum(trunc(abs(nr - r) * 100000)) OVER () / 100000.0
  FROM (
    SELECT p.i, p.id, p.r, 0.15::DOUBLE + 0.85::DOUBLE * coalesce(s.s, 0) AS nr
    FROM pr p LEFT JOIN (
      SELECT dst, {vote} AS s FROM (
        SELECT ew.dst, q.r / ew.outdeg * ew.mult AS x FROM ew JOIN pr q ON ew.src = q.id)
      GROUP BY dst) s ON p.id = s.dst
    WHERE p.i < {max_iter} AND {cont}))"""


def _final_ranks(loop: str) -> str:
    return f"""{loop}
SELECT id, round(r, 6) AS rank FROM pr WHERE i = (SELECT max(i) FROM pr)"""


def _final_status(loop: str, tol: float, delta: str = "l1",
                  min_updates: int | None = None, places: int | None = 10) -> str:
    if min_updates is None:
        min_updates = 1 if delta == "l1" else 2
    col = "delta" if delta == "l1" else "dfix"
    return f"""{loop}
SELECT CASE WHEN i >= {min_updates} AND {col} < {tol!r} THEN 'converged'
            ELSE 'max_iterations' END AS status,
       CAST(i AS INTEGER) AS iterations, {f'round({col}, {places})' if places else col} AS final_delta
FROM (SELECT DISTINCT i, delta, dfix FROM pr WHERE i = (SELECT max(i) FROM pr))"""


def _lag1(edges: str, loop: str) -> str:
    return f"""{loop},
fin AS (SELECT id, r FROM pr WHERE i = (SELECT max(i) FROM pr)),
s AS (SELECT dst, {_exact('x')} AS s FROM (
  SELECT ew.dst, f.r / ew.outdeg * ew.mult AS x FROM ew JOIN fin f ON ew.src = f.id) GROUP BY dst)
SELECT fin.id, round(0.15::DOUBLE + 0.85::DOUBLE * coalesce(s.s, 0), 6) AS rank
FROM fin LEFT JOIN s ON fin.id = s.dst"""


SQL["rank_fixed_10"] = _final_ranks(rank_loop(CO_PURCHASE, 10, None))
SQL["rank_fixed_30"] = _final_ranks(rank_loop(CO_PURCHASE, 30, None))
SQL["rank_until_l1"] = _final_ranks(rank_loop(CO_PURCHASE))
SQL["rank_until_lag1"] = _lag1(CO_PURCHASE, rank_loop(CO_PURCHASE))
SQL["rank_until_fixed_point"] = _final_ranks(rank_loop(CO_PURCHASE, delta="fixed_point"))
SQL["rank_status"] = _final_status(rank_loop(CO_PURCHASE), 1e-4)
SQL["rank_status_fixed_point"] = _final_status(
    rank_loop(CO_PURCHASE, delta="fixed_point"), 1e-4, "fixed_point")
SQL["convergence_history"] = f"""{rank_loop(CO_PURCHASE)}
SELECT DISTINCT CAST(i AS INTEGER) AS iter, round(delta, 6) AS delta,
       round(dfix, 6) AS delta_fixed FROM pr WHERE i > 0"""
SQL["rank_capped"] = _final_status(rank_loop(CO_PURCHASE, 5), 1e-4)
SQL["rank_until_sinks"] = _final_ranks(rank_loop(SUPPLY))
SQL["rank_until_page_links"] = _final_ranks(rank_loop(PAGE_LINKS))
SQL["rank_until_salted"] = SQL["rank_until_l1"]
SQL["rank_lines"] = (SQL["rank_until_l1"].replace(
    "SELECT id, round(r, 6) AS rank FROM pr",
    "SELECT CAST(id AS VARCHAR) || chr(9) || CAST(round(r, 6) AS VARCHAR) AS value FROM pr"))
SQL["rank_tagged_union"] = SQL["rank_fixed_10"]
SQL["vertex_program_rank"] = SQL["rank_until_l1"]
SQL["snapshot_resume"] = SQL["rank_until_l1"]
SQL["rank_from_saved_graph"] = SQL["rank_until_l1"]
SQL["vertex_program_from_json"] = SQL["rank_until_l1"]
SQL["vertex_program_vertex_halt"] = SQL["rank_until_lag1"]

# adjacency state: every seventh part is a target only (start 0), customers have no edge
_ADJ_EDGES = f"""SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst
FROM ({CO_PURCHASE}) WHERE src % 7 <> 0"""
_ADJ_VERTICES = f"""
SELECT id, coalesce(max(start), 0.0)::DOUBLE AS start FROM (
  SELECT CAST(id AS VARCHAR) AS id, id % 5 + 1.0 AS start FROM ({SQL['vertex_set']}) WHERE id % 7 <> 0
  UNION ALL SELECT 'C' || CAST(c_custkey AS VARCHAR), c_custkey % 3 + 0.5 FROM customer
  UNION ALL SELECT dst, NULL FROM e) GROUP BY id"""
SQL["rank_from_adjacency"] = _final_ranks(
    rank_loop(_ADJ_EDGES, delta="fixed_point", vertices=_ADJ_VERTICES))
SQL["rank_status_from_adjacency"] = _final_status(
    rank_loop(_ADJ_EDGES, delta="fixed_point", vertices=_ADJ_VERTICES), 1e-4, "fixed_point")
SQL["rank_fixed_from_adjacency"] = _final_ranks(rank_loop(_ADJ_EDGES, 10, None, vertices=_ADJ_VERTICES))
SQL["rank_until_exact"] = f"""{rank_loop(CO_PURCHASE)}
SELECT id, r AS rank FROM pr WHERE i = (SELECT max(i) FROM pr)"""
SQL["rank_status_exact"] = _final_status(rank_loop(CO_PURCHASE), 1e-4, places=None)

SQL["parse_rejects"] = f"""
SELECT 'edges' AS format, value, 'too few fields' AS reason FROM ({EDGE_TEXT})
WHERE NOT starts_with(value, '#') AND len({_TOKENS}) < 2
UNION ALL SELECT 'tsv', 'S' || CAST(s_suppkey AS VARCHAR), 'too few fields' FROM supplier
UNION ALL SELECT 'tsv', 'X' || CAST(s_suppkey AS VARCHAR) || chr(9) || 'x' || chr(9) || CAST(s_suppkey AS VARCHAR),
                 'rank is not a number' FROM supplier
UNION ALL SELECT 'json', replace(b.line, '%s', CAST(s_suppkey AS VARCHAR)), b.reason
FROM supplier, (VALUES ('[%s,1.0', 'too few fields'), ('["a%s",1.0,[]]', 'vertex id is not a number'),
  ('[%s,"z",[]]', 'vertex value is not a number'), ('[%s,1.0,[[%s]]]', 'edge is not a pair of numbers'),
  ('[%s,1.0,[[%s,0],["b",1]]]', 'edge is not a pair of numbers')) b(line, reason)"""

# ------------------------------------------------------- vertex programs

SQL["vertex_program_two_fields"] = f"""
WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({CO_PURCHASE})),
v AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
r(i, id, hops, parent, far) AS (
  SELECT 0, id, CASE WHEN id = (SELECT min(src) FROM e) THEN 0 END::BIGINT, NULL::BIGINT, 0::BIGINT FROM v
  UNION ALL
  SELECT i + 1, id, nh, np, max(nh) OVER () FROM (
    SELECT p.i, p.id, coalesce(p.hops, CASE WHEN n.parent IS NOT NULL THEN p.i + 1 END) AS nh,
           CASE WHEN p.hops IS NULL THEN n.parent ELSE p.parent END AS np
    FROM r p LEFT JOIN (
      SELECT e.dst, min(q.id) AS parent FROM e JOIN r q ON e.src = q.id WHERE q.hops = q.i GROUP BY e.dst
    ) n ON p.id = n.dst
    WHERE p.far = p.i))
SELECT id, hops, parent FROM r WHERE i = (SELECT max(i) FROM r)"""

SQL["vertex_program_labels"] = f"""
WITH RECURSIVE e AS ({CO_PURCHASE}),
r(i, id, label) AS (
  SELECT 0, id, id FROM (SELECT src AS id FROM e UNION SELECT dst FROM e)
  UNION ALL
  SELECT p.i + 1, p.id, coalesce(n.label, p.label)
  FROM r p LEFT JOIN (
    SELECT dst, label FROM (
      SELECT dst, label, row_number() OVER (PARTITION BY dst ORDER BY n DESC, label) AS k FROM (
        SELECT e.dst, q.label, count(*) AS n FROM e JOIN r q ON e.src = q.id GROUP BY e.dst, q.label))
    WHERE k = 1) n ON p.id = n.dst
  WHERE p.i < 5)
SELECT id, label FROM r WHERE i = 5"""

SQL["vertex_program_weighted"] = f"""
WITH RECURSIVE e AS (SELECT src, dst, (dst % 4 + 1) / 4.0::DOUBLE AS w FROM ({CO_PURCHASE})),
ew AS (SELECT e.src, e.dst, e.w, t.total, count(*) AS mult
  FROM e JOIN (SELECT src, sum(w) AS total FROM e GROUP BY src) t USING (src) GROUP BY ALL),
r(i, id, v, delta) AS (
  SELECT 0, id, 1.0::DOUBLE, 1e300::DOUBLE FROM (SELECT src AS id FROM e UNION SELECT dst FROM e)
  UNION ALL
  SELECT i + 1, id, nv, {_exact('abs(nv - v)', ' OVER ()')} FROM (
    SELECT p.i, p.id, p.v, 0.15::DOUBLE + 0.85::DOUBLE * coalesce(s.s, 0) AS nv
    FROM r p LEFT JOIN (
      SELECT dst, {_exact('x')} AS s FROM (
        SELECT ew.dst, q.v / ew.total * ew.w * ew.mult AS x FROM ew JOIN r q ON ew.src = q.id) GROUP BY dst
    ) s ON p.id = s.dst
    WHERE p.i < 500 AND p.delta >= 0.0001))
SELECT id, round(v, 6) AS rank FROM r WHERE i = (SELECT max(i) FROM r)"""

# --------------------------------------------------------------- telemetry


def _fmt2(c: str) -> str:
    return f"(CAST(({c}) // 100 AS VARCHAR) || '.' || lpad(CAST(({c}) % 100 AS VARCHAR), 2, '0'))"


EV = """
SELECT *, algo || '_' || dataset || '_u' || CAST(user_id AS VARCHAR) AS job_id FROM (
  SELECT event_id, event_type, user_id,
         CASE WHEN user_id % 2 = 0 THEN 'giraph' ELSE 'mapreduce' END AS algo,
         CASE user_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END AS dataset,
         CAST(round(value * 100) AS BIGINT) AS c, event_id % 4 AS sub
  FROM events)"""

JOB_LOG = f"""
SELECT job_id, algo, event_id AS pos, CASE
  WHEN event_type = 'view' AND sub = 0 THEN 'finishSuperstep: Superstep ' || CAST(c % 50 - 1 AS VARCHAR) || ' done'
  WHEN event_type = 'view' AND sub = 1 THEN 'INFO superstep ' || CAST(c % 50 AS VARCHAR) || ' completed in ' || CAST(c AS VARCHAR) || ' ms'
  WHEN event_type = 'view' AND sub = 2 THEN 'Superstep ' || CAST(c % 50 AS VARCHAR) || ' started'
  WHEN event_type = 'view' THEN 'Bytes sent ' || CAST(c * 1000 AS VARCHAR) || ' bytes'
  WHEN event_type = 'click' AND sub = 2 THEN 'Job Run time: ' || CAST(c * 10 AS VARCHAR) || ' ms'
  WHEN event_type = 'click' THEN 'Iteration ' || CAST(c % 100 AS VARCHAR) || ' Diff: ' || CAST(c AS VARCHAR) || 'E-5'
  WHEN event_type = 'signup' AND sub <= 1 THEN 'Job job_' || CAST(event_id AS VARCHAR) || ' completed successfully'
  WHEN event_type = 'signup' AND sub = 2 THEN '  Map input records=' || CAST(c AS VARCHAR)
  WHEN event_type = 'signup' THEN 'Memory Used: ' || CAST(c AS VARCHAR) || ' MB'
  WHEN event_type = 'purchase' AND sub <= 1 THEN 'Superstep=' || CAST(c % 40 AS VARCHAR) || ' completed, Total Diff: ' || CAST(c AS VARCHAR) || 'E-6'
  WHEN event_type = 'purchase' AND sub = 2 THEN 'INFO Total execution time: ' || CAST(c % 997 AS VARCHAR) || ' s'
  WHEN event_type = 'purchase' THEN '  Reduce input records=' || CAST(c AS VARCHAR)
  WHEN sub = 0 THEN 'Final Diff: ' || CAST(c AS VARCHAR) || 'E-7'
  WHEN sub = 1 THEN 'Final Diff: n/a'
  WHEN sub = 2 THEN 'Global Diff: ' || CAST(c AS VARCHAR)
  ELSE 'Reduce task attempt_' || CAST(event_id AS VARCHAR) || ' SUCCEEDED'
END AS value FROM ({EV})"""

SQL["log_files_round_trip"] = f"""
SELECT job_id, value, lead(value) OVER (PARTITION BY job_id ORDER BY pos) AS next_value
FROM (SELECT regexp_extract(job_id, '^([^_]+_[^_]+)_', 1) AS job_id, pos, value FROM ({JOB_LOG}))"""

RUNS = f"""
SELECT job_id, algo AS algorithm, dataset, sum(c) / 100.0 AS total_time
FROM ({EV}) GROUP BY job_id, algo, dataset"""


def _num(label: str) -> str:
    return (f"TRY_CAST(nullif(regexp_extract(value, '{label}\\s*([0-9\\.E-]+)', 1), '') "
            "AS DOUBLE)")


PARSED = f"""
SELECT job_id, algo, pos, value, final_diff, total_diff, any_diff,
       CASE WHEN algo = 'giraph' THEN total_diff ELSE coalesce(any_diff, total_diff) END AS cand_diff,
       CASE WHEN algo = 'giraph' AND contains(lower(value), 'superstep')
                 AND (contains(lower(value), 'finish') OR contains(lower(value), 'completed'))
            THEN TRY_CAST(nullif(regexp_extract(lower(value), 'superstep\\s*[:=]?\\s*(-?\\d+)', 1), '') AS INTEGER)
       END AS superstep,
       contains(value, 'completed successfully') AS success
FROM (SELECT *,
        CASE WHEN contains(value, 'Final Diff:') THEN {_num('Final Diff:')} END AS final_diff,
        CASE WHEN NOT contains(value, 'Final Diff:') AND contains(value, 'Total Diff:')
             THEN {_num('Total Diff:')} END AS total_diff,
        CASE WHEN contains(value, 'Diff:') THEN {_num('Diff:')} END AS any_diff
      FROM ({JOB_LOG}))"""


def _row(*parts: str) -> str:
    return "concat_ws('     ', clk, " + ", ".join(parts) + ")"


_Z = "'0.00'"
_CPU_HDR = _row("'CPU'", "'%user'", "'%nice'", "'%system'", "'%iowait'", "'%steal'", "'%idle'")
_CPU_ROW = _row("'all'", _fmt2("c % 5000"), _Z, _fmt2("c % 700"), _fmt2("c % 300"), _Z,
                _fmt2("(c * 7) % 4000"))
_MEM_HDR = _row(*[f"'{x}'" for x in ("kbmemfree", "kbavail", "kbmemused", "%memused",
                                     "kbbuffers", "kbcached", "kbcommit", "%commit",
                                     "kbactive", "kbinact", "kbdirty")])
_MEM_ROW = _row("CAST(c * 10 AS VARCHAR)", "CAST(c * 11 AS VARCHAR)", "CAST(c * 1000 AS VARCHAR)",
                _fmt2("c % 10000"), "CAST((c * 3) % 200000 AS VARCHAR)", "CAST(c * 5 AS VARCHAR)",
                "CAST(c * 6 AS VARCHAR)", _Z, "CAST(c AS VARCHAR)", "CAST(c AS VARCHAR)",
                "CAST(c % 90 AS VARCHAR)")
_IF_HDR = _row(*[f"'{x}'" for x in ("IFACE", "rxpck/s", "txpck/s", "rxkB/s", "txkB/s",
                                    "rxcmp/s", "txcmp/s", "rxmcst/s", "%ifutil")])
_LO_ROW = _row("'lo'", _fmt2("c % 900"), _fmt2("c % 900"), _fmt2("c"), _fmt2("c"), _Z, _Z, _Z, _Z)
_ETH_ROW = _row("'eth0'", _fmt2("c % 300"), _fmt2("c % 200"), _fmt2("(c * 3) % 50000"),
                _fmt2("(c * 2) % 30000"), _Z, _Z, _Z, _Z)

MONITOR = f"""
SELECT job_id, event_id * 10 + k AS pos, lines[k] AS value FROM (
  SELECT job_id, event_id, lines, unnest(range(1, len(lines) + 1)) AS k FROM (
    SELECT job_id, event_id,
      CASE WHEN event_type IN ('view', 'click') THEN ['', {_CPU_HDR}, {_CPU_ROW}]
           WHEN event_type IN ('signup', 'purchase') THEN ['', {_MEM_HDR}, {_MEM_ROW}]
           ELSE ['', {_IF_HDR}, {_LO_ROW}, {_ETH_ROW}] END AS lines
    FROM (SELECT *, CASE WHEN event_id % 2 = 1 THEN '12:00:01 AM' ELSE '00:00:01' END AS clk
          FROM ({EV}))))
UNION ALL
SELECT job_id, min(event_id) * 10 AS pos,
       'Linux 5.4.0 (' || job_id || ') ' || chr(9) || '01/02/2025 ' || chr(9) || '_x86_64_' || chr(9) || '(4 CPU)' AS value
FROM ({EV}) GROUP BY job_id"""

_SAR_TOK = f"""
SELECT job_id, pos, value AS line, {_TOKENS} AS p FROM ({MONITOR})
WHERE NOT (regexp_replace(value, '[\\x00-\\x20]', '', 'g') = '' OR contains(value, 'Linux')
           OR contains(value, 'Average') OR contains(value, 'IFACE'))"""

SAMPLES = f"""
SELECT job_id, pos,
  CASE WHEN ai >= 0 THEN 'cpu' WHEN is_iface THEN 'iface' WHEN mem_ok THEN 'mem' ELSE 'other' END AS kind,
  CASE WHEN cpu_ok AND u IS NOT NULL AND sy IS NOT NULL THEN u END AS cpu_user,
  CASE WHEN cpu_ok AND u IS NOT NULL AND sy IS NOT NULL THEN sy END AS cpu_system,
  CASE WHEN mem_ok THEN TRY_CAST(nullif(p[v + 3], '') AS DOUBLE) END AS kbmemused,
  CASE WHEN is_iface THEN p[v + 1] END AS iface,
  CASE WHEN is_iface THEN a END AS rx_kb_s, CASE WHEN is_iface THEN b END AS tx_kb_s,
  CASE WHEN net_ok AND a IS NOT NULL AND b IS NOT NULL THEN a END AS compat_a,
  CASE WHEN net_ok AND a IS NOT NULL AND b IS NOT NULL THEN b END AS compat_b
FROM (
  SELECT *, ai >= 0 AND len(p) > ai + 3 AS cpu_ok,
         TRY_CAST(nullif(p[ai + 2], '') AS DOUBLE) AS u,
         TRY_CAST(nullif(p[ai + 4], '') AS DOUBLE) AS sy,
         ai < 0 AND NOT contains(line, 'CPU') AND len(p) > v + 2 AS mem_ok,
         NOT contains(line, 'CPU') AND len(p) > v + 5 AND p[v + 1] IS DISTINCT FROM 'lo' AS net_ok,
         TRY_CAST(nullif(p[v + 4], '') AS DOUBLE) AS a,
         TRY_CAST(nullif(p[v + 5], '') AS DOUBLE) AS b,
         ai < 0 AND NOT contains(line, 'CPU') AND len(p) > v + 5
           AND TRY_CAST(nullif(p[v + 1], '') AS DOUBLE) IS NULL AS is_iface
  FROM (
    SELECT *, CASE WHEN len(p) > 1 AND p[2] IN ('AM', 'PM') THEN 2 ELSE 1 END AS v,
           CASE WHEN coalesce(list_position(list_reverse(p), 'all'), 0) > 0
                THEN len(p) - list_position(list_reverse(p), 'all') ELSE -1 END AS ai
    FROM ({_SAR_TOK})))"""


def _r6(c: str, name: str | None = None) -> str:
    return f"round({c}, 6) AS {name or c}"


SQL["job_log_parsed"] = f"""
SELECT job_id, pos, {_r6('final_diff')}, {_r6('total_diff')}, {_r6('any_diff')},
       {_r6('cand_diff')}, superstep, success FROM ({PARSED})"""

SQL["sar_samples"] = f"""
SELECT job_id, pos, kind, iface, {_r6('cpu_user')}, {_r6('cpu_system')}, {_r6('kbmemused')},
       {_r6('rx_kb_s')}, {_r6('tx_kb_s')}, {_r6('compat_a')}, {_r6('compat_b')}
FROM ({SAMPLES})"""

LOG_SUMMARY = f"""
SELECT job_id,
  CAST(greatest(CASE WHEN bool_or(algo = 'giraph') THEN coalesce(max(superstep), 0)
                     ELSE count(*) FILTER (WHERE success) END, 1) AS INTEGER) AS iterations_to_converge,
  coalesce(arg_max(final_diff, pos) FILTER (WHERE final_diff IS NOT NULL),
           arg_max(cand_diff, pos) FILTER (WHERE cand_diff IS NOT NULL), 0.0) AS final_diff
FROM ({PARSED}) GROUP BY job_id"""

MONITOR_SUMMARY = f"""
SELECT job_id, avg(CAST(cpu_user + cpu_system AS DECIMAL(38, 10))) AS cpu_utilization,
       max(CASE WHEN kbmemused > 1024 THEN kbmemused END) / (1024.0 * 1024.0) AS peak_memory_usage,
       avg(CAST(CASE WHEN kind = 'iface' AND iface <> 'lo' THEN rx_kb_s + tx_kb_s END
                AS DECIMAL(38, 10))) AS iface_rate,
       avg(CAST(compat_a + compat_b AS DECIMAL(38, 10))) AS compat_rate
FROM ({SAMPLES}) GROUP BY job_id"""

SQL["job_iterations"] = f"SELECT job_id, iterations_to_converge FROM ({LOG_SUMMARY})"
SQL["final_diff"] = f"SELECT job_id, {_r6('final_diff')} FROM ({LOG_SUMMARY})"
SQL["cpu_util"] = f"SELECT job_id, round(coalesce(cpu_utilization, 0.0), 6) AS cpu_utilization FROM ({MONITOR_SUMMARY})"
SQL["peak_mem"] = f"SELECT job_id, round(coalesce(peak_memory_usage, 0.0), 6) AS peak_memory_usage FROM ({MONITOR_SUMMARY})"
SQL["network_mb"] = f"""
SELECT r.job_id, round(coalesce(m.iface_rate, 0.0) * r.total_time / 1024.0, 6) AS network_communication
FROM ({RUNS}) r LEFT JOIN ({MONITOR_SUMMARY}) m USING (job_id)"""
SQL["network_mb_compat"] = f"""
SELECT r.job_id, round(coalesce(m.compat_rate, 0.0) * r.total_time / 1024.0, 6) AS network_communication
FROM ({RUNS}) r LEFT JOIN ({MONITOR_SUMMARY}) m USING (job_id)"""


def job_metrics_sql(rate: str = "iface_rate") -> str:
    return f"""
SELECT r.algorithm, r.dataset, r.job_id, r.total_time AS total_execution_time,
       r.total_time / coalesce(l.iterations_to_converge, 1) AS avg_iteration_time,
       coalesce(m.{rate}, 0.0) * r.total_time / 1024.0 AS network_communication,
       coalesce(m.peak_memory_usage, 0.0) AS peak_memory_usage,
       CAST(coalesce(l.iterations_to_converge, 1) AS INTEGER) AS iterations_to_converge,
       coalesce(l.final_diff, 0.0) AS final_diff,
       coalesce(m.cpu_utilization, 0.0) AS cpu_utilization
FROM ({RUNS}) r LEFT JOIN ({LOG_SUMMARY}) l USING (job_id)
LEFT JOIN ({MONITOR_SUMMARY}) m USING (job_id)"""


SQL["job_metrics"] = f"""
SELECT algorithm, dataset, job_id, iterations_to_converge,
       {_r6('total_execution_time')}, {_r6('avg_iteration_time')}, {_r6('network_communication')},
       {_r6('peak_memory_usage')}, {_r6('final_diff')}, {_r6('cpu_utilization')}
FROM ({job_metrics_sql()})"""


def _jfmt(c: str, d: int) -> str:
    """Java's %.<d>f (HALF_UP on the shortest decimal digits of the double).

    It differs from C printf (exact binary value) only when the double is the
    nearest one to a decimal with d+1 places ending in 5: round that one up.
    """
    m = f"{10 ** (d + 1)}.0"
    k = f"round(({c}) * {m})"
    tie = f"({k} / {m} = ({c}) AND CAST(abs({k}) AS BIGINT) % 10 = 5)"
    return (f"printf('%.{d}f', CASE WHEN {tie} THEN ({k} + 5 * sign({c})) / {m} "
            f"ELSE ({c}) END)")


SQL["metrics_csv"] = f"""
SELECT algorithm || ',' || dataset || ',' || job_id || ',' || {_jfmt('total_execution_time', 2)} || 's,'
       || {_jfmt('avg_iteration_time', 2)} || 's,' || {_jfmt('network_communication', 2)} || 'MB,'
       || {_jfmt('peak_memory_usage', 2)} || 'GB,' || CAST(iterations_to_converge AS VARCHAR) || ','
       || {_jfmt('final_diff', 6)} || ',' || {_jfmt('cpu_utilization', 2)} || '%' AS value
FROM ({job_metrics_sql('compat_rate')})"""

SQL["convergence_rate"] = f"""
SELECT job_id, round(100.0 * (1.0 - final_diff) / nullif(iterations_to_converge * 1.0, 0.0), 6)
       AS convergence_rate,
       round(100.0 * (1.0 - 0.0001) / nullif(iterations_to_converge * 1.0, 0.0), 6)
       AS convergence_rate_script FROM ({LOG_SUMMARY})"""


def _tok(i: int) -> str:
    return f"TRY_CAST(nullif(({_TOKENS})[{i}], '') AS DOUBLE)"


SQL["bytes_sent"] = f"""
SELECT job_id, round(coalesce(sum(CASE WHEN contains(value, 'Bytes sent') THEN coalesce({_tok(3)}, 0.0) END), 0.0)
       / 1048576.0, 6) AS bytes_sent_mb FROM ({JOB_LOG}) GROUP BY job_id"""

SQL["shuffle_estimate"] = f"""
SELECT job_id, round(sum(
  coalesce(TRY_CAST(nullif(regexp_extract(value, 'Map input records\\s*[=:]?\\s*(\\d+)', 1), '') AS DOUBLE), 0.0)
  + coalesce(TRY_CAST(nullif(regexp_extract(value, 'Reduce input records\\s*[=:]?\\s*(\\d+)', 1), '') AS DOUBLE), 0.0))
  * 100.0 / 1048576.0, 6) AS shuffle_mb FROM ({JOB_LOG}) GROUP BY job_id"""

SQL["max_memory"] = f"""
SELECT job_id, round(coalesce(max(CASE WHEN contains(value, 'Memory Used') THEN coalesce({_tok(3)}, 0.0) END)
       / 1024.0, 0.0), 6) AS max_memory_gb FROM ({JOB_LOG}) GROUP BY job_id"""


def _log_value(label: str, field: int, scale: float, name: str) -> str:
    return f"""
SELECT job_id, round(coalesce(arg_max(v, pos) FILTER (WHERE v IS NOT NULL) / {scale!r}, 0.0), 6) AS {name}
FROM (SELECT job_id, pos, CASE WHEN contains(value, '{label}') THEN coalesce({_tok(field)}, 0.0) END AS v
      FROM ({JOB_LOG})) GROUP BY job_id"""


SQL["log_value"] = f"""
SELECT a.job_id, a.exec_time, b.run_time
FROM ({_log_value('Total execution time', 5, 1.0, 'exec_time')}) a
JOIN ({_log_value('Run time', 4, 1000.0, 'run_time')}) b USING (job_id)"""

SQL["count_lines"] = f"""
SELECT job_id,
       CAST(count(*) FILTER (WHERE contains(value, 'Superstep')) AS BIGINT) AS superstep_lines,
       CAST(count(*) FILTER (WHERE contains(value, 'Reduce') AND contains(value, 'SUCCEEDED')) AS BIGINT)
         AS reduce_succeeded
FROM ({JOB_LOG}) GROUP BY job_id"""

# -------------------------------------------------------- benchmark stats

METRICS_LINES = f"""
SELECT concat_ws(',', algo, ds, algo || '_' || ds || '_' || CAST(o_orderkey AS VARCHAR),
  {_fmt2('c')} || 's', {_fmt2('c // 40')} || 's', {_fmt2('(c * 3) % 100000')} || 'MB',
  {_fmt2('c % 500')} || 'GB', CAST(c % 100 + 1 AS VARCHAR), '0.0000' || CAST(c % 90 + 10 AS VARCHAR),
  {_fmt2('c % 10000')} || '%') AS value
FROM (SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS c,
        CASE o_orderstatus WHEN 'F' THEN 'giraph' WHEN 'O' THEN 'mapreduce' ELSE 'spark' END AS algo,
        replace(lower(string_split(o_orderpriority, '-')[-1]), ' ', '_') AS ds
      FROM orders)"""

_RAW_COLS = ("algorithm", "dataset", "job_id", "total_execution_time", "avg_iteration_time",
             "network_communication", "peak_memory_usage", "iterations_to_converge",
             "final_diff", "cpu_utilization")

METRICS_RAW = "SELECT " + ", ".join(f"f[{i + 1}] AS {c}" for i, c in enumerate(_RAW_COLS)) + \
    f" FROM (SELECT string_split(value, ',') AS f FROM ({METRICS_LINES}))"


def _strip(c: str) -> str:
    return f"coalesce(TRY_CAST(nullif(regexp_replace({c}, '[^0-9.]', '', 'g'), '') AS DOUBLE), 0.0)"


_UNIT = ("total_execution_time", "avg_iteration_time", "network_communication",
         "peak_memory_usage", "cpu_utilization")
_AVG4 = ("total_execution_time", "avg_iteration_time", "network_communication",
         "peak_memory_usage")

TYPED = ("SELECT algorithm, dataset, job_id, "
         + ", ".join(f"{_strip(c)} AS {c}" for c in _UNIT)
         + ", TRY_CAST(iterations_to_converge AS INTEGER) AS iterations_to_converge"
         + ", TRY_CAST(nullif(final_diff, '') AS DOUBLE) AS final_diff"
         + f" FROM ({METRICS_RAW})")

AVG = ("SELECT dataset, algorithm, CAST(count(*) AS BIGINT) AS runs, "
       + ", ".join(f"avg({c}) AS {c}" for c in _AVG4)
       + f" FROM ({TYPED}) GROUP BY dataset, algorithm")

DIM = """
SELECT dataset, ord, dataset || '.txt' AS file, edges FROM (
  SELECT replace(lower(string_split(o_orderpriority, '-')[-1]), ' ', '_') AS dataset,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS ord,
         CAST(count(*) * 1000 AS BIGINT) AS edges
  FROM orders GROUP BY 1, 2)"""

SQL["metrics_raw"] = METRICS_RAW
SQL["strip_units"] = ("SELECT algorithm, dataset, job_id, iterations_to_converge, "
                      + ", ".join(_r6(c) for c in _UNIT) + ", " + _r6("final_diff")
                      + f" FROM ({TYPED})")
SQL["dataset_dim"] = DIM
SQL["average_metrics"] = ("SELECT dataset, algorithm, runs, " + ", ".join(_r6(c) for c in _AVG4)
                          + f" FROM ({AVG})")
SQL["normalized_iter_time"] = f"""
SELECT a.dataset, a.algorithm, d.edges, round(a.avg_iteration_time, 6) AS avg_iteration_time,
       round(a.avg_iteration_time / (d.edges / 1e6), 6) AS time_per_m_edges
FROM ({AVG}) a JOIN ({DIM}) d USING (dataset)"""


def _div(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN NULL ELSE {a} / {b} END"


SIDE = f"""
SELECT n.dataset,
  n.total_execution_time AS n_t, d.total_execution_time AS d_t,
  n.avg_iteration_time AS n_i, d.avg_iteration_time AS d_i,
  n.network_communication AS n_n, d.network_communication AS d_n,
  n.peak_memory_usage AS n_m, d.peak_memory_usage AS d_m
FROM (SELECT * FROM ({AVG}) WHERE algorithm = '{{num}}') n
JOIN (SELECT * FROM ({AVG}) WHERE algorithm = '{{den}}') d USING (dataset)"""

SQL["metric_ratios"] = f"""
SELECT dataset, round({_div('n_t', 'd_t')}, 6) AS time_ratio, round({_div('n_i', 'd_i')}, 6) AS iter_ratio,
       round(CASE WHEN d_n > 0 THEN n_n / d_n ELSE 0.0 END, 6) AS network_ratio,
       round({_div('n_m', 'd_m')}, 6) AS memory_ratio
FROM ({SIDE.format(num='mapreduce', den='giraph')})"""

SQL["memory_speedup"] = f"""
SELECT dataset, round({_div('n_m', 'd_m')}, 6) AS mem_ratio, round({_div('d_t', 'n_t')}, 6) AS speedup
FROM ({SIDE.format(num='giraph', den='mapreduce')})"""

SQL["scaling_exponent"] = f"""
SELECT algorithm, dataset, ord, edges, round(time, 6) AS time,
       round(CASE WHEN pe IS NOT NULL AND ln(edges) - ln(pe) <> 0
                  THEN (ln(time) - ln(pt)) / (ln(edges) - ln(pe)) END, 6) AS slope
FROM (SELECT a.algorithm, a.dataset, d.ord, d.edges, a.total_execution_time AS time,
             lag(d.edges) OVER (PARTITION BY a.algorithm ORDER BY d.ord) AS pe,
             lag(a.total_execution_time) OVER (PARTITION BY a.algorithm ORDER BY d.ord) AS pt
      FROM ({AVG}) a JOIN ({DIM}) d USING (dataset))"""

METRICS_FILES = f"""
SELECT CASE WHEN o_orderstatus = 'P' THEN 'old' ELSE 'new' END AS variant,
  concat_ws(',', algo, ds, algo || '_' || ds || '_' || CAST(o_orderkey AS VARCHAR),
    {_fmt2('c')} || 's', {_fmt2('c // 40')} || 's', {_fmt2('(c * 3) % 100000')} || 'MB',
    {_fmt2('c % 500')} || 'GB', CAST(c % 100 + 1 AS VARCHAR),
    CASE WHEN o_orderstatus = 'P' THEN {_fmt2('c % 10000')} || '%'
         ELSE '0.0000' || CAST(c % 90 + 10 AS VARCHAR) END,
    {_fmt2('(c * 7) % 10000')} || '%') AS value
FROM (SELECT o_orderkey, o_orderstatus, CAST(round(o_totalprice) AS BIGINT) AS c,
        CASE o_orderstatus WHEN 'F' THEN 'giraph' WHEN 'O' THEN 'mapreduce' ELSE 'spark' END AS algo,
        replace(lower(string_split(o_orderpriority, '-')[-1]), ' ', '_') AS ds
      FROM orders)"""

SQL["metrics_header_variants"] = f"""
SELECT f[1] AS algorithm, f[2] AS dataset, f[3] AS job_id,
  TRY_CAST(f[8] AS INTEGER) AS iterations_to_converge,
  """ + ", ".join(f"round({_strip(f'f[{i}]')}, 6) AS {c}"
                  for i, c in ((4, "total_execution_time"), (5, "avg_iteration_time"),
                               (6, "network_communication"), (7, "peak_memory_usage"),
                               (10, "cpu_utilization"))) + f""",
  CASE WHEN variant = 'new' THEN round(TRY_CAST(nullif(f[9], '') AS DOUBLE), 6) END AS final_diff,
  CASE WHEN variant = 'old' THEN round({_strip('f[9]')}, 6) END AS convergence_rate
FROM (SELECT variant, string_split(value, ',') AS f FROM ({METRICS_FILES}))"""


# ---------------------------------------------------------- exact ids, order

_BIG = 2 ** 53 + 1
_BIG_EDGES = f"SELECT src + {_BIG} AS src, dst + {_BIG} AS dst FROM ({CO_PURCHASE})"
SQL["parse_json_big_ids"] = f"""
SELECT id, CAST(len(nbrs) AS INTEGER) AS n_edges, {_joined('nbrs')} AS dsts
FROM ({_adjacency(_BIG_EDGES)})"""
SQL["vertex_program_big_ids"] = f"SELECT id + {_BIG} AS id, rank FROM ({SQL['rank_until_l1']})"

SQL["adjacency_input_order"] = f"""
WITH e AS (SELECT * FROM (
  SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS dst,
         l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_extendedprice
  FROM lineitem) WHERE dst IS NOT NULL),
a AS (SELECT src, list(dst ORDER BY l_orderkey, l_linenumber, src, l_suppkey, l_shipdate, l_extendedprice) AS nbrs
      FROM e GROUP BY src)
SELECT v.id, CAST(len(coalesce(nbrs, [])) AS INTEGER) AS n_nbrs, {_joined('coalesce(nbrs, [])')} AS nbrs
FROM (SELECT src AS id FROM e UNION SELECT dst FROM e) v LEFT JOIN a ON v.id = a.src"""

SQL["next_in_hot_group"] = f"""
SELECT grp, l_orderkey, l_linenumber, price, val, lead(val) OVER (PARTITION BY grp
  ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS next_val
FROM (SELECT *, CAST(CASE WHEN l_orderkey % 3 = 0 THEN 7 WHEN l_orderkey % 11 = 0 THEN NULL
                          ELSE l_orderkey + 100 END AS BIGINT) AS grp,
        CAST(CASE WHEN l_partkey % 17 <> 0 THEN l_partkey * 2 + {_BIG} END AS BIGINT) AS val,
        l_extendedprice AS price FROM lineitem)"""

# ------------------------------------------------- metrics rows, presentation

SQL["metrics_append_round_trip"] = "SELECT " + ", ".join(
    f"f[{i + 1}] AS {c}" for i, c in enumerate(
        ("algorithm", "dataset", "job_id", "total_execution_time", "avg_iteration_time",
         "network_communication", "peak_memory_usage", "iterations_to_converge", "final_diff",
         "cpu_utilization"))) + f" FROM (SELECT string_split(value, ',') AS f FROM ({SQL['metrics_csv']}))"

SQL["presentation_order"] = f"""
SELECT d.ord, a.dataset, a.algorithm, a.runs FROM ({AVG}) a LEFT JOIN ({DIM}) d USING (dataset)"""
SQL["dataset_dim_rows"] = SQL["dataset_dim"]


def _rec(label: str) -> str:
    return (f"coalesce(TRY_CAST(nullif(regexp_extract(value, '{label}\\s*[=:]?\\s*(\\d+)', 1), '') "
            "AS DOUBLE), 0.0)")


SQL["collected_metrics"] = f"""
WITH l AS (SELECT *, ({_TOKENS}) AS t FROM ({JOB_LOG})),
g AS (SELECT job_id, bool_or(algo = 'giraph') AS bsp,
  arg_max(coalesce({{n5}}, 0.0), pos) FILTER (WHERE contains(value, 'Total execution time')) AS bsp_s,
  arg_max(coalesce({{n4}}, 0.0), pos) FILTER (WHERE contains(value, 'Run time')) / 1000 AS batch_s,
  count(*) FILTER (WHERE contains(value, 'Superstep')) AS steps,
  count(*) FILTER (WHERE contains(value, 'Reduce') AND contains(value, 'SUCCEEDED')) AS reduces,
  sum(CASE WHEN contains(value, 'Bytes sent') THEN coalesce({{n3}}, 0.0) ELSE 0.0 END) AS sent,
  sum({_rec('Map input records')} + {_rec('Reduce input records')}) * 100.0 AS records,
  max(coalesce({{n3}}, 0.0)) FILTER (WHERE contains(value, 'Memory Used')) AS memory,
  avg(coalesce({{n5}}, 0.0)) FILTER (WHERE contains(value, 'Superstep')) AS superstep_time
  FROM l GROUP BY job_id),
h AS (SELECT *, CASE WHEN bsp THEN steps ELSE reduces END AS n,
        coalesce(CASE WHEN bsp THEN bsp_s ELSE batch_s END, 0.0) AS secs FROM g)
SELECT CASE WHEN bsp THEN 'giraph' ELSE 'mapreduce' END AS algorithm, job_id,
  CAST(n AS BIGINT) AS iterations_to_converge, round(secs, 6) AS total_execution_time,
  round(CASE WHEN n <> 0 THEN secs / n END, 6) AS avg_iteration_time,
  round((CASE WHEN bsp THEN sent ELSE records END) / 1048576.0, 6) AS network_communication,
  round(coalesce(memory, 0.0) / 1024, 6) AS peak_memory_usage,
  round(100.0 * (1.0 - 0.0001) / nullif(n * 1.0, 0.0), 6) AS convergence_rate,
  round(CASE WHEN bsp THEN superstep_time END, 6) AS mean_superstep_time
FROM h""".replace("{n3}", "TRY_CAST(nullif(t[3], '') AS DOUBLE)").replace(
    "{n4}", "TRY_CAST(nullif(t[4], '') AS DOUBLE)").replace("{n5}", "TRY_CAST(nullif(t[5], '') AS DOUBLE)")
