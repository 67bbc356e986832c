"""The registered queries as DuckDB SQL, written apart from the operators."""

from __future__ import annotations

PART = """v AS (SELECT p_partkey AS id FROM part),
g AS (SELECT src, dst, weight FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst, CAST(l_quantity AS BIGINT) AS weight FROM lineitem) WHERE dst IS NOT NULL)"""
SUPPLY = """v AS (SELECT p_partkey AS id FROM part UNION ALL SELECT s_suppkey + (SELECT count(*) FROM part) FROM supplier),
g AS (SELECT DISTINCT l_partkey AS src, l_suppkey + (SELECT count(*) FROM part) AS dst, CAST(1 AS BIGINT) AS weight FROM lineitem)"""
GEO = """g AS (SELECT CAST(n_regionkey AS BIGINT) AS src, CAST(n_nationkey + 5 AS BIGINT) AS dst FROM nation
  UNION ALL SELECT CAST(c_nationkey + 5 AS BIGINT), c_custkey + 30 FROM customer),
v AS (SELECT CAST(r_regionkey AS BIGINT) AS id FROM region UNION ALL SELECT CAST(n_nationkey + 5 AS BIGINT) FROM nation UNION ALL SELECT c_custkey + 30 FROM customer)"""
USER = """ev AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS nth, user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events),
st AS (SELECT nth, src, dst FROM ev WHERE dst IS NOT NULL),
inc AS (SELECT CAST(nth * 10 // (SELECT count(*) FROM st) + 1 AS BIGINT) AS increment, src, dst FROM st)"""
PAIRS = """p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM st WHERE src <> dst),
e AS (SELECT a AS s, b AS t FROM p UNION ALL SELECT b, a FROM p), u AS (SELECT DISTINCT s AS id FROM e)"""
CELL = "((id - 0 + (SELECT count(*) FROM v)) % (SELECT count(*) FROM v) + 136) % 256"
DEG = "d AS (SELECT id, (SELECT count(*) FROM g WHERE src = id) AS out_degree, (SELECT count(*) FROM g WHERE dst = id) AS in_degree FROM v)"


def bfs(root: int, hops: int = 40, name: str = "b") -> str:
    return f"""{name}0 AS (SELECT CAST({root} AS BIGINT) AS id, CAST(0 AS BIGINT) AS level UNION SELECT g.dst, level + 1 FROM {name}0 JOIN g ON g.src = {name}0.id WHERE level < {hops}),
{name} AS (SELECT id, min(level) AS level FROM {name}0 GROUP BY 1)"""


def relax(root: int, rounds: int) -> str:
    """Distances over at most so many edges, unrolled; the last table is d<rounds>."""
    out = [f"d0 AS (SELECT CAST({root} AS BIGINT) AS id, CAST(0 AS BIGINT) AS distance)"]
    for k in range(1, rounds + 1):
        out.append(f"d{k} AS (SELECT id, min(distance) AS distance FROM (SELECT * FROM d{k - 1} UNION ALL SELECT g.dst, distance + weight FROM d{k - 1} JOIN g ON g.src = d{k - 1}.id) GROUP BY 1)")
    return ", ".join(out)


def rank(iterations: int, start: str = "1.0::DOUBLE / (SELECT count(*) FROM v)", uniform: bool = False) -> str:
    out = ["o AS (SELECT src, count(*) AS n FROM g GROUP BY 1)", f"r0 AS (SELECT id, {start} AS score FROM v)"]
    for k in range(1, iterations + 1):
        lost = f" + (SELECT coalesce(sum(score), 0) FROM r{k - 1} WHERE id NOT IN (SELECT src FROM o)) / (SELECT count(*) FROM v)" if uniform else ""
        out.append(
            f"s{k} AS (SELECT g.dst AS id, sum(r.score / o.n) AS s FROM g JOIN r{k - 1} r ON r.id = g.src JOIN o ON o.src = g.src GROUP BY 1),"
            f"r{k} AS (SELECT v.id, 0.15::DOUBLE / (SELECT count(*) FROM v) + 0.85::DOUBLE * (coalesce(s, 0){lost}) AS score FROM v LEFT JOIN s{k} USING (id))"
        )
    return ", ".join(out)


_ALL = "SELECT v.id, coalesce({c}, 999999) AS {c} FROM v LEFT JOIN {t} USING (id)"
_BFS = f"WITH RECURSIVE {PART}, {bfs(0)} " + _ALL.format(c="level", t="b")
_SSSP = f"WITH {PART}, {relax(0, 25)} " + _ALL.format(c="distance", t="d25")
_RANK5 = f"WITH {PART}, {rank(5)} SELECT id, round(score, 8) AS score FROM r5"
_DYNAMIC = f"""WITH RECURSIVE {USER}, k AS (SELECT unnest(range(1, 11)) AS increment), root AS (SELECT src FROM st WHERE nth = 0),
b AS (SELECT CAST(k.increment AS BIGINT) AS increment, root.src AS id, CAST(0 AS BIGINT) AS level FROM k, root
  UNION SELECT b.increment, inc.dst, b.level + 1 FROM b JOIN inc ON inc.src = b.id AND inc.increment <= b.increment WHERE b.level < 40)
SELECT increment, id, min(level) AS level FROM b GROUP BY 1, 2"""
_LABEL = f"""WITH RECURSIVE {GEO}, e AS (SELECT src AS s, dst AS t FROM g UNION SELECT dst, src FROM g),
c0 AS (SELECT id, id AS c FROM v UNION SELECT e.t, c0.c FROM c0 JOIN e ON e.s = c0.id WHERE c0.c < e.t), c AS (SELECT id, min(c) AS component FROM c0 GROUP BY 1)"""
_MULTI = f"""WITH RECURSIVE {USER}, {PAIRS},
m0 AS (SELECT id AS source, id, 0 AS level FROM u WHERE {{where}} UNION SELECT m0.source, e.t, level + 1 FROM m0 JOIN e ON e.s = m0.id WHERE level < 6),
m AS (SELECT source, id, min(level) AS level FROM m0 GROUP BY 1, 2)"""
_RHIZOME = "z AS (SELECT src, dst, weight, CAST((row_number() OVER (PARTITION BY dst ORDER BY src, weight) - 1) // {cutoff} % {size} AS INTEGER) AS rhizome FROM g)"
_CELLS = f"""cell AS (SELECT id, {CELL} AS cc FROM v),
m AS (SELECT DISTINCT g.src, g.dst, x.cc % 16 AS x1, x.cc // 16 AS y1, y.cc % 16 AS x2, y.cc // 16 AS y2 FROM g JOIN cell x ON x.id = g.src JOIN cell y ON y.id = g.dst)"""


def _way(a: str, b: str) -> str:
    """Sign of the shorter way from a to b around 16 places."""
    return f"CASE WHEN abs({b} - {a}) <= 16 - abs({b} - {a}) THEN sign({b} - {a}) ELSE -sign({b} - {a}) END"


def _first(dy: str, dx: str) -> str:
    return f"CASE WHEN {dy} < 0 THEN 1 WHEN {dy} > 0 THEN 3 WHEN {dx} < 0 THEN 0 WHEN {dx} > 0 THEN 2 END"


def _cost(network: str) -> str:
    mesh = 256 * ((5 * 2 + 4) * 12 + 2 * 8 + 2 * 24 + 32)
    ruche = 256 * ((5 * 2 + 4) * 12 + 4 * 12 + 2 * 16 + 2 * 40 + 48 + 2 * 8)
    router = {"MESH": mesh, "TORUS": 1.5 * mesh, "RUCHE": ruche, "RUCHE_TORUS": ruche + 0.5 * mesh}[network]
    area = f"(2097152 / (29.2e6::DOUBLE / 8 / 1e-6::DOUBLE) + {router}::DOUBLE / 91e12::DOUBLE + 1e5::DOUBLE / 91e12::DOUBLE)"
    # over Ruche links: a third of the operons, each three cells far; the others as without Ruche links
    plain = f"(62.0::DOUBLE * sqrt({area}) / 32)" if network.endswith("TORUS") else f"sqrt({area})"
    way = f"(((l_partkey + 1) - (l_partkey + 1) // 3) * {plain} + ((l_partkey + 1) // 3) * 3 * sqrt({area}))" if network.startswith("RUCHE") else f"((l_partkey + 1) * {plain})"
    energy = (
        f"{way} * 256 * (8e-12::DOUBLE / 32 / 1e-3::DOUBLE) + (l_suppkey + 1) * 0.5::DOUBLE * 5.8e-12::DOUBLE + l_quantity * 0.5::DOUBLE * 9.12e-12::DOUBLE"
        " + 1024 * 2097152::DOUBLE * (16.9e-6::DOUBLE / 32768) * ((l_orderkey + 1) / 1e9::DOUBLE)"
    )
    # created is l_suppkey + 1, performed l_quantity, operons l_partkey + 1, cycles l_orderkey + 1
    return f"SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_quantity, round(1024 * {area} * 1e6, 6) AS area, round(({energy}) * 1e6, 6) AS energy_uj, round((l_orderkey + 1)::DOUBLE, 3) AS time_ns FROM lineitem"


_ACTIVITY = ["idle", "communicating", "computing", "both", *[f"communicating, congested {k}" for k in (1, 2, 3, 4)], *[f"both, congested {k}" for k in (1, 2, 3, 4)]]
_PROBABILITIES = [0.1, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 0.95, 0.98, 0.99]
_LEVEL = "CASE WHEN in_degree >= 60 THEN 3 WHEN in_degree >= 30 THEN 2 WHEN in_degree >= 15 THEN 1 ELSE 0 END"

ORACLE: dict[str, str] = {
    "gq01_bfs": _BFS,
    "gq01_bfs_unreached": f"WITH RECURSIVE {GEO}, {bfs(0)} " + _ALL.format(c="level", t="b"),
    "gq02_sssp": _SSSP,
    "gq03_pagerank": _RANK5,
    "gq03_pagerank_leaking": f"WITH {SUPPLY}, {rank(3)} SELECT id, round(score, 8) AS score FROM r3",
    "gq04_bfs_salted": _BFS,
    "gq05_sssp_salted": _SSSP,
    "gq06_pagerank_two_phase": _RANK5,
    "gq07_bfs_bounded": f"WITH RECURSIVE {PART}, {bfs(0, 2)} " + _ALL.format(c="level", t="b"),
    "gq07_deepening": f"WITH RECURSIVE {PART}, {bfs(0, 3)} SELECT CAST(k AS INTEGER) AS depth, CAST(sum(CAST(level <= k AS BIGINT)) AS BIGINT) AS reached FROM b, (SELECT unnest([1, 2, 3]) AS k) GROUP BY 1",
    "gq08_sssp_bounded": f"WITH {PART}, {relax(0, 3)} " + _ALL.format(c="distance", t="d3"),
    "gq09_pagerank_nested": f"WITH {PART}, {rank(4)} SELECT id, round(score, 8) AS score FROM r4",
    "gq10_pagerank_given_start": f"WITH {PART}, {rank(2, '1.0::DOUBLE')} SELECT id, round(score, 8) AS score FROM r2",
    "gq11_dynamic_bfs": _DYNAMIC,
    "gq12_streaming_bfs": _DYNAMIC,
    "str07_deferred_bfs": f"SELECT id, level FROM ({_DYNAMIC}) WHERE increment = 10",
    "str06_ingest_only": f"WITH {USER} SELECT a.increment, count(*) AS edges FROM (SELECT DISTINCT increment FROM inc) a JOIN inc ON inc.increment <= a.increment GROUP BY 1",
    "gq13_bfs_reached_only": f"WITH RECURSIVE {GEO}, {bfs(1)} SELECT id, level FROM b",
    "gq14_sssp_reached_only": f"WITH {SUPPLY}, {relax(0, 3)} SELECT id, distance FROM d3",
    "gq15_pagerank_dangling": f"WITH {SUPPLY}, {rank(3, uniform=True)} SELECT id, round(score, 8) AS score FROM r3",
    "gq16_components": f"{_LABEL} SELECT id, component FROM c",
    "agg15_component_sizes": f"{_LABEL} SELECT component, count(*) AS size, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM v), 6) AS percent FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "gq17_diameter": f"""{_MULTI.format(where="true")}, c AS (SELECT id, min(source) AS component FROM m GROUP BY 1), s AS (SELECT component, count(*) AS size FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5),
x AS (SELECT component, size, CAST(max(level) AS BIGINT) AS diameter FROM m JOIN c ON c.id = m.source JOIN s USING (component) GROUP BY 1, 2) SELECT *, round((SELECT avg(diameter) FROM x), 8) AS average FROM x""",
    "gq18_clustering": f"""WITH {USER}, {PAIRS}, dg AS (SELECT s AS id, count(*) AS d FROM e GROUP BY 1),
t AS (SELECT x.a, x.b, y.b AS c FROM p x JOIN p y ON x.b = y.a JOIN p z ON z.a = x.a AND z.b = y.b),
n AS (SELECT id, count(*) AS t FROM (SELECT a AS id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY 1)
SELECT id, coalesce(t, 0) AS triangles, round(CASE WHEN d > 1 THEN 2.0::DOUBLE * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END, 8) AS coefficient FROM dg LEFT JOIN n USING (id)""",
    "gq19_average_path": _MULTI.format(where="true") + " SELECT round(avg(level), 8) AS average, count(*) AS pairs FROM m WHERE source <> id",
    "gq20_path_distribution": f"""{_MULTI.format(where="true")}, c AS (SELECT id, min(source) AS component FROM m GROUP BY 1), s AS (SELECT component FROM c GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
k AS (SELECT id, row_number() OVER (ORDER BY id) AS k, count(*) OVER () AS n FROM c JOIN s USING (component)) SELECT CAST(level AS BIGINT) AS level, count(*) AS pairs FROM m JOIN k ON k.id = m.source WHERE source <> m.id AND (k <= 50 OR k > n - 50) GROUP BY 1""",
    "jn01_frontier_edges": f"WITH RECURSIVE {PART}, {bfs(0, 1)} SELECT src, dst, weight, level + 1 AS level FROM g JOIN b ON b.id = g.src WHERE level = 1",
    "jn02_message_improves": f"WITH {PART}, {relax(0, 2)} SELECT d2.id, d2.distance, d1.distance AS old FROM d2 LEFT JOIN d1 USING (id) WHERE d1.distance IS NULL OR d2.distance < d1.distance",
    "jn03_not_visited": f"WITH RECURSIVE {PART}, {bfs(0, 1)} SELECT id FROM v WHERE id NOT IN (SELECT id FROM b)",
    "jn04_chunk_relay": f"WITH {PART} SELECT src AS id, CAST((count(*) + 9) // 10 AS BIGINT) AS chunks, count(*) AS edges FROM g GROUP BY 1",
    "jn05_sibling_replicas": f"WITH {PART}, {_RHIZOME.format(size=3, cutoff=5)}, q AS (SELECT dst AS id, count(DISTINCT rhizome) AS k FROM z GROUP BY 1) SELECT id, k * (k - 1) AS relays FROM q WHERE k > 1",
    "jn06_continuations": f"WITH RECURSIVE {USER}, b AS (SELECT src AS id, CAST(0 AS BIGINT) AS level FROM st WHERE nth = 0 UNION SELECT inc.dst, level + 1 FROM b JOIN inc ON inc.src = b.id AND increment = 1 WHERE level < 40), c AS (SELECT id, min(level) AS level FROM b GROUP BY 1) SELECT dst AS id, min(level) + 1 AS value, count(*) AS messages FROM inc JOIN c ON c.id = inc.src WHERE increment = 2 GROUP BY 1",
    "jn07_address_lookup": f"WITH {PART} SELECT {CELL} AS cc_id, count(*) AS messages FROM g JOIN v ON v.id = g.dst GROUP BY 1",
    "jn08_verify": f"WITH RECURSIVE {PART}, {bfs(0)}, {bfs(0, 2, 'x')} SELECT v.id, coalesce(b.level, 999999) AS computed, x.level AS golden, CASE WHEN x.level IS NULL THEN 'extra' WHEN x.level = b.level THEN 'ok' ELSE 'wrong' END AS status FROM v LEFT JOIN b USING (id) LEFT JOIN x USING (id)",
    "jn09_baseline": "WITH m AS (SELECT l_returnflag, l_linestatus, min(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1, 2), o AS (SELECT l_extendedprice AS base FROM m WHERE l_returnflag = 'A' AND l_linestatus = 'F') SELECT m.*, base, round(base / l_extendedprice, 8) AS speedup FROM m, o",
    "jn10_sums_or_zero": f"WITH {SUPPLY} SELECT id, CAST(coalesce(sum(weight), 0) AS BIGINT) AS total FROM v LEFT JOIN g ON g.dst = v.id GROUP BY 1",
    "flt01_zero_in": f"WITH {SUPPLY} SELECT id FROM v WHERE id NOT IN (SELECT dst FROM g)",
    "flt02_zero_out": f"WITH {SUPPLY} SELECT id FROM v WHERE id NOT IN (SELECT src FROM g)",
    "flt03_predicate": f"WITH RECURSIVE {PART}, {bfs(0)} SELECT src, dst, weight FROM g JOIN b x ON x.id = src JOIN b y ON y.id = dst WHERE y.level = x.level + 1",
    "flt04_combined_messages": f"WITH {PART} SELECT dst, min(weight) AS least, count(*) - 1 AS pruned FROM g GROUP BY 1",
    "flt05_max_depth": f"WITH RECURSIVE {PART}, {bfs(5, 1)} SELECT id, level FROM b",
    "flt06_defined_level": f"WITH RECURSIVE {GEO}, {bfs(0)} SELECT id, level FROM b",
    "flt07_run_filter": "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity >= 40",
    "flt08_comment_lines": "SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l, ' ') <> '' AND NOT contains(l, '|') GROUP BY 1",
    "scl01_zero_based": f"WITH {PART} SELECT src, dst FROM g",
    "scl02_cell_coordinates": f"WITH {PART} SELECT id, id % 16 AS x, id // 16 AS y, id AS back FROM v",
    "scl03_next_hop": f"WITH {PART}, {_CELLS} SELECT src, dst, {_first('y2 - y1', 'x2 - x1')} AS mesh, {_first(_way('y1', 'y2'), _way('x1', 'x2'))} AS torus FROM m",
    "scl04_hops": f"WITH {PART}, {_CELLS} SELECT src, dst, abs(x1 - x2) + abs(y1 - y2) AS mesh, least(abs(x1 - x2), 16 - abs(x1 - x2)) + least(abs(y1 - y2), 16 - abs(y1 - y2)) AS torus FROM m",
    "scl05_in_box": f"WITH {PART}, {_CELLS} SELECT src, dst, abs(x1 - x2) <= 4 AND abs(y1 - y2) <= 4 AS near FROM m",
    "scl06_use_mesh": f"WITH {PART}, {_CELLS}, s AS (SELECT *, least(0.45::DOUBLE + 0.007::DOUBLE * sqrt((x1 - 7.5::DOUBLE) ** 2 + (y1 - 7.5::DOUBLE) ** 2), 0.95::DOUBLE) AS share FROM m) SELECT src, dst, abs(x1 - x2) <= floor(share * 16) AND abs(y1 - y2) <= floor(share * 16) AS mesh FROM s",
    "scl07_congestion": f"WITH {PART}, {DEG} SELECT id, {_LEVEL} AS level FROM d",
    "scl08_activity_code": f"WITH {PART}, {DEG} SELECT id, CASE WHEN out_degree % 2 = 0 AND in_degree % 3 <> 0 THEN CASE WHEN in_degree >= 20 THEN 8 + {_LEVEL} ELSE 3 END WHEN out_degree % 2 = 0 THEN 2 WHEN in_degree % 3 <> 0 THEN CASE WHEN in_degree >= 20 THEN 4 + {_LEVEL} ELSE 1 END ELSE 0 END AS code FROM d",
    "scl09_activity_class": f"WITH {PART} SELECT {_ACTIVITY!r}[id % 12 + 1] AS class, count(*) AS n FROM v GROUP BY 1",
    "scl10_percentages": "SELECT o_orderpriority, round(100.0::DOUBLE * sum(CAST(o_orderstatus = 'F' AS BIGINT)) / count(*), 8) AS percent FROM orders GROUP BY 1",
    "scl11_comparison": "WITH m AS (SELECT l_returnflag, l_linenumber, min(l_extendedprice) FILTER (l_linestatus = 'O') AS a, min(l_extendedprice) FILTER (l_linestatus = 'F') AS b FROM lineitem GROUP BY 1, 2) SELECT *, round((a - b) * 100 / a, 8) AS decrease, round((b - a) * 100 / b, 8) AS increase FROM m WHERE a IS NOT NULL AND b IS NOT NULL",
    "scl12_cost_mesh": _cost("MESH"),
    "scl12_cost_torus": _cost("TORUS"),
    "scl13_cost_ruche": _cost("RUCHE"),
    "scl13_cost_ruche_torus": _cost("RUCHE_TORUS"),
    "scl14_throttle": "SELECT p_partkey, CAST(floor(sqrt(p_size * p_size + (p_size + 3) * (p_size + 3)) / CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS period FROM part",
    "scl15_chip_dim": "SELECT p_partkey, CAST(p_size * 2 ** (p_partkey % 4) AS BIGINT) AS dim FROM part",
    "scl16_names": "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'ON' ELSE 'OFF' END AS throttle, CASE p_size % 2 WHEN 0 THEN 'MESH' ELSE 'TORUS' END AS network FROM part",
    "scl17_queue_full": "SELECT p_partkey, p_size * 2 > 60 AS full FROM part",
    "scl18_instruction_cost": f"WITH {PART}, {DEG} SELECT id, CAST(in_degree + 6 * out_degree + 30 AS BIGINT) AS cycles FROM d",
    "scl19_text": "SELECT p_partkey, CASE WHEN len(string_split(concat_ws('_', p_brand, p_type, p_size), '_')) >= 3 THEN string_split(concat_ws('_', p_brand, p_type, p_size), '_')[3] END AS third, printf('%.2f', p_retailprice) AS price, concat_ws('_', 'run', p_brand, p_size) AS name FROM part",
    "scl20_slices": f"WITH {PART}, q AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst, weight) AS k FROM g) SELECT src AS id, CAST(count(*) FILTER (k BETWEEN 2 AND 4) AS INTEGER) AS n, CAST(coalesce(sum(dst) FILTER (k BETWEEN 2 AND 4), 0) AS BIGINT) AS total FROM q GROUP BY 1",
    "agg01_min_messages": f"WITH {PART} SELECT dst AS id, min(weight) AS value FROM g GROUP BY 1",
    "agg02_sum_and_count": f"WITH {PART} SELECT dst AS id, CAST(sum(weight) AS BIGINT) AS total, count(*) AS messages FROM g GROUP BY 1",
    "agg03_two_level_sum": f"WITH {PART}, {_RHIZOME.format(size=4, cutoff=3)} SELECT dst AS id, CAST(sum(weight) AS BIGINT) AS total, count(DISTINCT rhizome) AS replicas FROM z GROUP BY 1",
    "agg04_degrees": f"WITH {SUPPLY}, {DEG} SELECT * FROM d",
    "agg05_degree_describe": f"WITH {PART}, {DEG} SELECT count(*) AS n, round(avg(out_degree), 6) AS mean, round(stddev_samp(out_degree), 6) AS std, min(out_degree) AS least, max(out_degree) AS most, "
    + ", ".join(f"round(quantile_cont(out_degree, {p}), 6) AS p{round(p * 100):02d}" for p in _PROBABILITIES)
    + " FROM d",
    "agg06_top_degree": f"WITH {PART}, {DEG} SELECT id, out_degree FROM d ORDER BY 2 DESC, 1 LIMIT 1",
    "agg07_cell_totals": "SELECT CAST(sum(o_custkey) AS BIGINT) AS created, max(o_custkey % 7) AS queue FROM orders",
    "agg08_averages": f"WITH {PART}, c AS (SELECT {CELL} AS cc, count(*) AS n FROM v GROUP BY 1) SELECT round(avg(n), 8) AS average FROM c",
    "agg09_running_maximum": "SELECT user_id, round(max(value), 4) AS most, round(sum(value), 4) AS total FROM events GROUP BY 1",
    "agg10_active_cells": "SELECT event_id % 50 AS cycle, CAST(sum(CAST(event_id % 3 > 0 AS BIGINT)) AS BIGINT) AS active, round(sum(CAST(event_id % 3 > 0 AS BIGINT)) * 100.0::DOUBLE / 256, 8) AS percent FROM events GROUP BY 1",
    "agg11_best_rows": "SELECT o_orderpriority, o_orderstatus, o_totalprice, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_totalprice, o_orderkey) = 1",
    "agg12_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "agg13_histogram": "WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT CAST(least(floor((l_extendedprice - lo) * 40 / (hi - lo)), 39) AS BIGINT) AS bin, count(*) AS n FROM lineitem, m GROUP BY 1",
    "agg14_series": "SELECT event_id % 20 AS cycle, CAST(sum(CAST(event_id % 4 > 0 AS BIGINT)) AS BIGINT) AS active FROM events GROUP BY 1",
    "agg16_verification": f"WITH {PART}, {rank(2)} SELECT count(*) AS n, CAST(sum(CAST(abs(r2.score - r1.score) > 1e-5::DOUBLE AS BIGINT)) AS BIGINT) AS errors, round(max(abs(r2.score - r1.score)), 10) AS largest FROM r2 JOIN r1 USING (id)",
    "agg17_trials": "SELECT l_partkey, count(*) AS trials, round(avg(l_quantity), 8) AS mean, min(l_quantity) AS least FROM lineitem GROUP BY 1",
    "win01_rhizome": f"WITH {PART}, {_RHIZOME.format(size=3, cutoff=5)} SELECT dst, rhizome, count(*) AS edges FROM z GROUP BY 1, 2",
    "win02_offsets": f"WITH {PART}, {DEG} SELECT id, CAST(coalesce(sum(out_degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM d",
    "win03_positions": f"WITH {PART}, q AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst, weight) - 1 AS pos FROM g) SELECT src, max(pos) AS last, CAST(sum(pos * dst) AS BIGINT) AS mixed FROM q GROUP BY 1",
    "win04_deltas": f"WITH {USER}, c AS (SELECT increment, CAST(sum(count(*)) OVER (ORDER BY increment) AS BIGINT) AS edges FROM inc GROUP BY 1) SELECT increment, edges, edges - coalesce(lag(edges) OVER (ORDER BY increment), 0) AS delta FROM c",
    "win05_best_row": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = 1",
    "srt01_sorted": f"WITH RECURSIVE {PART}, {bfs(3)} SELECT id, level FROM b ORDER BY id",
    "srt02_top": f"WITH {PART}, {DEG} SELECT id, in_degree FROM d ORDER BY 2 DESC, 1 LIMIT 1",
    "srt03_top_components": f"{_LABEL} SELECT component, count(*) AS size FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "srt04_lists_equal": f"WITH {PART} SELECT DISTINCT src AS id, src % 7 <> 0 AS equal FROM g",
    "srt05_root_first": "SELECT p_partkey AS id, (p_partkey - 7 + (SELECT count(*) FROM part)) % (SELECT count(*) FROM part) AS position FROM part",
    "srt06_shuffled": "SELECT count(*) AS ids, count(*) AS positions, count(*) - 1 AS last, CAST(7 AS BIGINT) AS first, true AS moved FROM part",
    "srt07_sample": "SELECT p_partkey AS id FROM part WHERE p_partkey < 50 OR p_partkey >= (SELECT count(*) FROM part) - 50",
    "set01_union": f"WITH {USER} SELECT DISTINCT src, dst FROM inc",
    "set02_symmetrized": f"WITH {PART}, s AS (SELECT src, dst, weight FROM g UNION ALL SELECT dst, src, weight FROM g) SELECT src, dst, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weight FROM s GROUP BY 1, 2",
    "set03_missing": f"WITH RECURSIVE {PART}, {bfs(0, 1)} SELECT x AS id FROM (SELECT unnest(range(0, (SELECT count(*) FROM part))) AS x) WHERE x NOT IN (SELECT id FROM b)",
    "set04_edge_differences": f"WITH {PART} SELECT src, dst, weight, 'left' AS side, count(*) AS n FROM g WHERE weight >= 50 GROUP BY 1, 2, 3",
    "trf01_adjacency": f"WITH {PART} SELECT src AS id, CAST(count(*) AS INTEGER) AS n, min(dst) AS first, max(dst) AS last FROM g GROUP BY 1",
    "trf05_csr": f"WITH {PART} SELECT row_number() OVER (ORDER BY src, dst, weight) - 1 AS place, dst, weight FROM g",
    "trf06_germinate": f"WITH {GEO} SELECT id FROM v WHERE id NOT IN (SELECT dst FROM g) OR id = 40",
    "trf07_verify": f"""WITH {PART}, {relax(0, 25)}, c AS (SELECT v.id, coalesce(distance, 999999) AS x FROM v LEFT JOIN d25 USING (id)),
q AS (SELECT CASE id % 10 WHEN 4 THEN 'extra' WHEN 3 THEN 'wrong' ELSE 'ok' END AS status, CASE id % 10 WHEN 4 THEN NULL WHEN 3 THEN 2 ELSE 0 END AS far FROM c UNION ALL SELECT 'missing', NULL FROM v WHERE id % 10 = 5)
SELECT status, count(*) AS n, CAST(max(far) AS BIGINT) AS largest FROM q GROUP BY 1""",
    "trf08_validate": f"WITH {PART} SELECT side, weight, count(*) AS differences FROM (SELECT 'left' AS side, weight FROM g WHERE weight >= 49 UNION ALL SELECT 'right', CAST(60 AS BIGINT) FROM g WHERE weight = 49) GROUP BY 1, 2",
    "lay01_chunks": f"WITH {PART}, q AS (SELECT src, (row_number() OVER (PARTITION BY src ORDER BY dst, weight) - 1) // 8 AS chunk FROM g) SELECT src AS id, chunk, CAST(count(*) AS INTEGER) AS n FROM q GROUP BY 1, 2",
    "lay02_replicas": f"WITH {PART}, {_RHIZOME.format(size=4, cutoff=6)} SELECT dst AS id, count(DISTINCT rhizome) AS replicas FROM z GROUP BY 1",
    "lay03_cyclic": f"WITH {PART} SELECT id, {CELL} AS cc_id, {CELL} % 16 AS x, {CELL} // 16 AS y FROM v",
    "lay05_channels": "WITH q AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS k, count(*) OVER () AS n FROM events) SELECT CAST(least(k // (n // 32), 31) AS INTEGER) AS channel, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM q GROUP BY 1",
    "lay06_memory": f"WITH {PART}, {DEG} SELECT {CELL} AS cc_id, CAST(sum(32 + 16 * out_degree) AS BIGINT) AS used, sum(32 + 16 * out_degree) > 4000 AS over FROM d GROUP BY 1",
    "acc01_messages": f"WITH RECURSIVE {PART}, {bfs(0)}, s AS (SELECT level + 1 AS round, count(*) AS created FROM g JOIN b ON b.id = g.src GROUP BY 1), n AS (SELECT level AS round, count(*) AS k FROM b WHERE level > 0 GROUP BY 1) SELECT round, created, coalesce(k, 0) AS performed, created - coalesce(k, 0) AS false_on_predicate, coalesce(k, 0) AS diffusions FROM s LEFT JOIN n USING (round)",
    "acc04_hops": f"WITH {PART}, cell AS (SELECT id, {CELL} AS cc FROM v), m AS (SELECT x.cc % 16 AS x1, x.cc // 16 AS y1, y.cc % 16 AS x2, y.cc // 16 AS y2 FROM g JOIN cell x ON x.id = src JOIN cell y ON y.id = dst) SELECT count(*) AS messages, CAST(sum(least(abs(x1 - x2), 16 - abs(x1 - x2)) + least(abs(y1 - y2), 16 - abs(y1 - y2))) AS BIGINT) AS hops FROM m",
    "src01_edge_list": f"WITH {PART} SELECT src, dst, weight FROM g",
    "src02_header": "SELECT p_partkey AS id FROM part",
    "src03_increment": f"WITH {PART} SELECT src, dst, weight FROM g",
    "src05_golden": f"WITH RECURSIVE {GEO}, {bfs(0)}, m AS (SELECT max(id) AS top FROM b) SELECT x AS id, coalesce(level, 999999) AS level FROM (SELECT unnest(range(0, (SELECT top FROM m) + 1)) AS x) LEFT JOIN b ON b.id = x",
    "src06_scores": f"WITH {PART}, {rank(1)} SELECT id, round(score, 8) AS score FROM r1",
    "src12_frames": "SELECT p_partkey % 5 AS cycle, p_partkey // 5 // 8 AS row, p_partkey // 5 % 8 AS col, CAST(p_partkey % 12 AS INTEGER) AS code FROM part",
    "acc03_diffusions": f"""WITH {PART}, {relax(0, 25)}, """
    + ", ".join(f"a{k} AS (SELECT CAST({k} AS BIGINT) AS round, count(*) AS created, CAST(sum(CAST(o.id IS NOT NULL AS BIGINT)) AS BIGINT) AS pruned FROM d{k} n LEFT JOIN d{k - 1} o USING (id) WHERE o.id IS NULL OR n.distance < o.distance)" for k in range(1, 26))
    + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT * FROM a{k}" for k in range(1, 26)) + ") WHERE created > 0",
    "snk07_csr_text": f"""WITH {PART}, {DEG}, t AS (SELECT 0 AS s, 0 AS a, 0 AS b, 0 AS c, 'WeightedAdjacencyGraph' AS value UNION ALL SELECT 1, 0, 0, 0, CAST((SELECT count(*) FROM v) AS VARCHAR) UNION ALL SELECT 2, 0, 0, 0, CAST((SELECT count(*) FROM g) AS VARCHAR)
  UNION ALL SELECT 3, id, 0, 0, CAST(CAST(coalesce(sum(out_degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS VARCHAR) FROM d
  UNION ALL SELECT 4, src, dst, weight, CAST(dst AS VARCHAR) FROM g UNION ALL SELECT 5, src, dst, weight, CAST(weight AS VARCHAR) FROM g) SELECT row_number() OVER (ORDER BY s, a, b, c) - 1 AS nth, value FROM t""",
    "lay04_vicinity": "SELECT count(*) AS n, CAST(2 AS BIGINT) AS dx, CAST(2 AS BIGINT) AS dy, CAST(0 AS BIGINT) AS own, CAST(0 AS BIGINT) AS off FROM part",
    "gen04_random_graph": "SELECT CAST(224 AS BIGINT) AS edges, CAST(224 AS BIGINT) AS different, CAST(0 AS BIGINT) AS loops, CAST(0 AS BIGINT) AS off, CAST(0 AS BIGINT) AS weights_off, CAST(1 AS BIGINT) AS components",
    "gen04_undirected": "SELECT CAST(4096 AS BIGINT) AS edges, CAST(4096 AS BIGINT) AS different, CAST(0 AS BIGINT) AS loops, CAST(0 AS BIGINT) AS off, CAST(0 AS BIGINT) AS weights_off, CAST(0 AS BIGINT) AS one_way, CAST(1 AS BIGINT) AS components",
    "gen05_rmat": "SELECT CAST(1024 AS BIGINT) AS edges, CAST(0 AS BIGINT) AS off, CAST(0 AS BIGINT) AS weights_off",
    "gen01_preferential_closing": "SELECT CAST(2016 AS BIGINT) AS edges, CAST(2016 AS BIGINT) AS different, CAST(0 AS BIGINT) AS loops, CAST(0 AS BIGINT) AS off, CAST(0 AS BIGINT) AS weights_off, CAST(0 AS BIGINT) AS one_way, CAST(1 AS BIGINT) AS components",
    "gen02_preferential": "SELECT CAST(2016 AS BIGINT) AS edges, CAST(2016 AS BIGINT) AS different, CAST(0 AS BIGINT) AS loops, CAST(0 AS BIGINT) AS off, CAST(0 AS BIGINT) AS weights_off, CAST(0 AS BIGINT) AS one_way, CAST(1 AS BIGINT) AS components",
    "gen03_small_world": "SELECT CAST(0 AS BIGINT) AS loops, CAST(0 AS BIGINT) AS off, CAST(0 AS BIGINT) AS one_way, CAST(0 AS BIGINT) AS weights_off, CAST(1 AS BIGINT) AS components, true AS simple",
    "udf03_program_bfs": f"""WITH RECURSIVE {PART}, {bfs(0)}, p AS (SELECT y.id, min(x.id) AS parent FROM b y JOIN g ON g.dst = y.id JOIN b x ON x.id = g.src AND x.level = y.level - 1 GROUP BY 1)
SELECT v.id, level, CASE WHEN v.id = 0 THEN -1 ELSE parent END AS parent FROM v LEFT JOIN b USING (id) LEFT JOIN p USING (id)""",
    "udf06_gated_pagerank": f"""WITH v AS (SELECT p_partkey AS id FROM part), g0 AS (SELECT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst FROM lineitem) WHERE dst IS NOT NULL), g AS (SELECT DISTINCT * FROM g0), {rank(3)} SELECT id, round(score, 8) AS score FROM r3""",
    "udf01_registered": f"WITH {PART} SELECT dst AS id, count(DISTINCT src) AS told, 5 AS number FROM g WHERE src % 5 = 0 GROUP BY 1 HAVING count(DISTINCT src) >= 3",
    "udf08_on_insert": f"""WITH RECURSIVE {USER}, root AS (SELECT src FROM st WHERE nth = 0), a1 AS (SELECT src, dst FROM inc WHERE increment = 1), a2 AS (SELECT src, dst FROM inc WHERE increment = 2),
s1 AS (SELECT src AS id, CAST(0 AS BIGINT) AS level FROM root UNION SELECT dst, CAST(10 AS BIGINT) FROM a1 WHERE src = (SELECT src FROM root)),
w1 AS (SELECT id, level FROM s1 UNION SELECT a1.dst, level + 1 FROM w1 JOIN a1 ON a1.src = w1.id WHERE level BETWEEN 10 AND 40), l1 AS (SELECT id, min(level) AS level FROM w1 GROUP BY 1),
s2 AS (SELECT id, min(level) AS level FROM (SELECT * FROM l1 UNION ALL SELECT a2.dst, l1.level + 10 FROM l1 JOIN a2 ON a2.src = l1.id) GROUP BY 1),
f2 AS (SELECT s2.id, s2.level FROM s2 LEFT JOIN l1 USING (id) WHERE l1.level IS NULL OR s2.level < l1.level),
w2 AS (SELECT id, level FROM f2 UNION SELECT e.dst, level + 1 FROM w2 JOIN (SELECT * FROM a1 UNION SELECT * FROM a2) e ON e.src = w2.id WHERE level < 40)
SELECT id, min(level) AS level FROM (SELECT * FROM s2 UNION ALL SELECT * FROM w2) GROUP BY 1""",
    "src07_matrix": f"WITH {PART} SELECT src, dst, count(*) AS n, CAST(0 AS BIGINT) AS off FROM g GROUP BY 1, 2",
    "src09_digraph": f"WITH {PART} SELECT src, dst, CAST(max(CAST(weight AS VARCHAR)) AS DOUBLE) AS weight FROM g GROUP BY 1, 2",
    "trf02_matrix_to_edges": f"WITH {PART} SELECT src, dst, count(*) AS n, (SELECT count(*) FROM v) AS vertices FROM g GROUP BY 1, 2",
    "src08_parmat": f"WITH {PART} SELECT src, dst, count(*) AS n FROM g GROUP BY 1, 2",
    "trf03_parmat_to_edges": f"WITH {PART} SELECT src, dst, count(*) AS n FROM g GROUP BY 1, 2",
    "src10_cumulative": f"WITH {USER} SELECT DISTINCT src, dst FROM inc",
    "trf04_cumulative_goldens": f"""WITH q AS ({_DYNAMIC}), n AS (WITH {USER} SELECT CAST(k AS BIGINT) AS increment, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM inc WHERE increment <= k)) AS edges FROM (SELECT unnest(range(1, 4)) AS k))
SELECT CAST(q.increment AS INTEGER) AS increment, id, level, edges FROM q JOIN n USING (increment)""",
    "src04_stream_channels": f"""WITH {USER}, r AS (SELECT increment - 1 AS batch, src, dst, row_number() OVER (PARTITION BY increment ORDER BY src, dst) - 1 AS k, count(*) OVER (PARTITION BY increment) AS n FROM inc WHERE increment <= 2)
SELECT batch, CAST(least(k // (n // 8), 7) AS INTEGER) AS channel, count(*) AS edges, CAST(sum(src) AS BIGINT) AS src, CAST(sum(dst) AS BIGINT) AS dst FROM r GROUP BY 1, 2""",
    "trf09_consolidate": f"""SELECT CAST(500 + n_nationkey AS BIGINT) AS edges, CAST(n_nationkey % 3 AS BIGINT) AS trail, CASE WHEN n_nationkey % 2 = 1 THEN 'TORUS' ELSE 'MESH' END AS network, CASE WHEN n_nationkey % 2 = 1 THEN 'ON' ELSE 'OFF' END AS throttle,
CAST(1000 + 10 * n_nationkey AS BIGINT) AS total_cycles, CAST(600 + n_nationkey AS BIGINT) AS actions_performed, CAST(9000 + n_nationkey AS BIGINT) AS operons_moved, CAST(4096 AS BIGINT) AS memory_cc, CAST(2 AS BIGINT) AS rpvo_max, 'ON' AS pruning,
'G' || n_regionkey AS graph_file, 'bfs' AS app, round(256 * (4096 / (29.2e6::DOUBLE / 8 / 1e-6::DOUBLE) + CASE WHEN n_nationkey % 2 = 1 THEN 1.5::DOUBLE ELSE 1 END * 256 * ((5 * 2 + 4) * 12 + 2 * 8 + 2 * 24 + 32) / 91e12::DOUBLE + 1e5::DOUBLE / 91e12::DOUBLE) * 1e6 * 1e3, 6) AS area,
round((1000 + 10 * n_nationkey)::DOUBLE, 6) AS time_ns FROM nation""",
    "src11_statistics": "SELECT CAST(500 + n_nationkey AS BIGINT) AS edges, CAST(3 AS BIGINT) AS cycles, 31.5::DOUBLE AS active, CAST(6 + 4 * n_nationkey AS BIGINT) AS objects FROM nation",
    "src15_name_fields": "SELECT 'G' || n_regionkey AS graph, CAST(500 + n_nationkey AS VARCHAR) AS edges, CAST(n_nationkey % 3 AS VARCHAR) AS trail, '1' AS throttle, CASE WHEN n_nationkey % 2 = 1 THEN 'TORUS' ELSE 'MESH' END AS network, 'ON' AS pruning FROM nation",
    "src16_partition_labels": "SELECT p_partkey AS id, CAST(p_partkey % 8 AS INTEGER) AS block FROM part",
    "snk08_text_report": f"""WITH {PART}, {DEG}, x AS (SELECT 'out_degree' AS k, count(*) AS n, round(avg(out_degree), 4) AS mean, min(out_degree) AS least, max(out_degree) AS most FROM d UNION ALL SELECT 'in_degree', count(*), round(avg(in_degree), 4), min(in_degree), max(in_degree) FROM d)
SELECT unnest(['degrees: ' || k, 'n' || chr(9) || n, 'mean' || chr(9) || mean, 'least' || chr(9) || least, 'most' || chr(9) || most]) AS line FROM x""",
    "trf10_frame_grid": f"""WITH q AS (SELECT p_partkey % 3 AS cycle, CAST(p_partkey // 3 // 8 AS INTEGER) AS row, p_partkey // 3 % 8 AS col, {_ACTIVITY!r}[p_partkey % 12 + 1] AS c FROM part) SELECT cycle, row, string_agg(c, '|' ORDER BY col) AS classes FROM q GROUP BY 1, 2""",
}
