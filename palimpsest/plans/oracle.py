"""DuckDB SQL with the rows of the registered queries."""

from __future__ import annotations

TRADE = """
    trade_s AS (SELECT snapshot_id, CAST(row_number() OVER (ORDER BY snapshot_id) - 1 AS INTEGER) AS seq
        FROM (SELECT DISTINCT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS snapshot_id FROM orders)),
    trade_l AS MATERIALIZED (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS snapshot_id, s_nationkey AS src, c_nationkey AS dst
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey),
    trade AS MATERIALIZED (SELECT seq, src, dst, a.n_regionkey AS sl, (src + dst) % 3 AS el, b.n_regionkey AS dl
        FROM (SELECT DISTINCT snapshot_id, least(src, dst) AS src, greatest(src, dst) AS dst FROM trade_l WHERE src <> dst)
        JOIN trade_s USING (snapshot_id) JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst),
    trade_v AS (SELECT DISTINCT seq, src AS vid, sl AS vlabel FROM trade UNION SELECT DISTINCT seq, dst, dl FROM trade)"""

SUPPLY = """
    supply_l AS (SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS snapshot_id, l_linenumber AS elabel, l_orderkey AS pos,
        CAST(least(2 * l_suppkey, 2 * l_partkey + 1) AS INTEGER) AS src, CAST(greatest(2 * l_suppkey, 2 * l_partkey + 1) AS INTEGER) AS dst FROM lineitem),
    supply_s AS (SELECT snapshot_id, CAST(row_number() OVER (ORDER BY snapshot_id) - 1 AS INTEGER) AS seq FROM (SELECT DISTINCT snapshot_id FROM supply_l)),
    supply_e AS MATERIALIZED (SELECT seq, src, dst, min(elabel) AS elabel FROM supply_l JOIN supply_s USING (snapshot_id) GROUP BY ALL),
    supply_n AS (SELECT CAST(2 * s_suppkey AS INTEGER) AS vid, s_nationkey AS vlabel FROM supplier UNION ALL SELECT CAST(2 * p_partkey + 1 AS INTEGER), 100 + p_size % 10 FROM part),
    supply AS MATERIALIZED (SELECT seq, src, dst, a.vlabel AS sl, elabel AS el, b.vlabel AS dl FROM supply_e JOIN supply_n a ON a.vid = src JOIN supply_n b ON b.vid = dst),
    supply_v AS MATERIALIZED (SELECT seq, src AS vid, sl AS vlabel FROM supply UNION SELECT seq, dst, dl FROM supply)"""

INTERACTIONS = """
    m AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey AS o, l_linenumber AS line, 'c' || o_custkey AS sender, 's' || l_suppkey AS recipient
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""

TYPES = """
    days AS (SELECT day, CAST(row_number() OVER (ORDER BY day) - 1 AS INTEGER) AS seq FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)),
    ranks AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS vlabel FROM (SELECT DISTINCT event_type FROM events)),
    types AS (SELECT CAST(user_id AS INTEGER) AS vid, seq, vlabel FROM
        (SELECT user_id, CAST(ts AS DATE) AS day, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY ALL) JOIN days USING (day) JOIN ranks USING (event_type)),
    changes AS (SELECT vid, seq, vlabel FROM (SELECT *, lag(vlabel) OVER (PARTITION BY vid ORDER BY seq) AS l FROM types) WHERE l IS NULL OR l <> vlabel)"""


def _runs(name: str, source: str, key: str) -> str:
    return f"""
    {name} AS MATERIALIZED (SELECT {key}, min(seq) AS "start", max(seq) AS "end" FROM
        (SELECT *, seq - row_number() OVER (PARTITION BY {key} ORDER BY seq) AS island FROM (SELECT DISTINCT {key}, seq FROM {source})) GROUP BY {key}, island)"""


_KEY = "src, dst, sl, el, dl"
TRADE_RUNS = _runs("runs", "trade", _KEY)
#: Greedy clusters of trade at 0.7 over the matrix of similarities; needs TRADE and TRADE_RUNS before it.
CLUSTERS = """
    sizes AS (SELECT seq, count(*) AS e FROM trade GROUP BY seq),
    sim AS MATERIALIZED (SELECT a.seq AS i, b.seq AS j, (SELECT count(*) FROM runs WHERE "start" <= a.seq AND "end" >= b.seq) AS common,
            (SELECT sum(e) FROM sizes WHERE sizes.seq BETWEEN a.seq AND b.seq) AS total
        FROM trade_s a JOIN trade_s b ON a.seq <= b.seq),
    simil AS MATERIALIZED (SELECT i, j, CAST(common AS BIGINT) AS common, CASE WHEN total > 0 THEN (j - i + 1) * common / CAST(total AS DOUBLE) END AS similarity FROM sim),
    cut AS (SELECT 0 AS j, 0 AS first_seq WHERE EXISTS (FROM trade_s)
        UNION ALL SELECT cut.j + 1, CASE WHEN s.similarity >= 0.7::DOUBLE THEN cut.first_seq ELSE cut.j + 1 END
        FROM cut JOIN simil s ON s.i = cut.first_seq AND s.j = cut.j + 1),
    clusters AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY first_seq) - 1 AS INTEGER) AS cluster_id, first_seq, max(j) AS last_seq, CAST(count(*) AS INTEGER) AS n FROM cut GROUP BY first_seq),
    members AS (SELECT seq, cluster_id FROM trade_s JOIN clusters ON seq BETWEEN first_seq AND last_seq),
    inter AS MATERIALIZED (SELECT cluster_id, src, dst, sl, el, dl FROM clusters JOIN runs ON "start" <= first_seq AND "end" >= last_seq)""" + "," + _runs("vruns", "trade_v", "vid, vlabel") + """,
    vinter AS MATERIALIZED (SELECT cluster_id, vid, vlabel FROM clusters JOIN vruns ON "start" <= first_seq AND "end" >= last_seq),
    delta AS MATERIALIZED (SELECT cluster_id, seq, src, dst, sl, el, dl FROM trade JOIN members USING (seq) ANTI JOIN inter USING (cluster_id, src, dst, sl, el, dl))"""
_CLUSTERED = f"WITH RECURSIVE {TRADE}, {TRADE_RUNS}, {CLUSTERS}"

#: Both readings of edges; patterns of one edge by snapshot; needs TRADE.
DIRECTED = """
    directed AS MATERIALIZED (SELECT * FROM trade UNION ALL SELECT seq, dst, src, dl, el, sl FROM trade),
    occ0 AS (SELECT DISTINCT vlabel, seq FROM trade_v),
    occ1 AS MATERIALIZED (SELECT DISTINCT format('(0,1,{},{},{})', sl, el, dl) AS code, seq FROM directed WHERE sl <= dl),
    two AS (SELECT a.seq, a.sl AS lc, a.el AS e1, a.dl AS l1, b.el AS e2, b.dl AS l2 FROM directed a JOIN directed b ON a.seq = b.seq AND a.src = b.src AND a.dst < b.dst),
    two_d AS (SELECT DISTINCT * FROM two),
    occ2 AS MATERIALIZED (SELECT DISTINCT format('(0,1,{},{},{})({},2,{},{},{})', k[2], k[3], k[4], -k[5], k[6], k[7], k[8]) AS code, seq FROM (
        SELECT seq, least([0, l1, e1, lc, -1, lc, e2, l2], [0, l2, e2, lc, -1, lc, e1, l1], [0, lc, e1, l1, 0, lc, e2, l2], [0, lc, e2, l2, 0, lc, e1, l1]) AS k FROM two_d))"""
_OCC = """
    occ AS (SELECT 0 AS n_edges, '' AS code, vlabel, seq FROM occ0 UNION ALL SELECT 1, code, NULL, seq FROM occ1 UNION ALL SELECT 2, code, NULL, seq FROM occ2)"""


def _patterns(most: int, sup: float) -> str:
    return f"""patterns AS (SELECT n_edges, code, vlabel, count(*) AS support FROM occ WHERE n_edges <= {most} GROUP BY n_edges, code, vlabel
        HAVING count(*) >= ceil((SELECT count(*) FROM trade_s) * {sup}::DOUBLE))"""


_MINED = f"WITH {TRADE}, {DIRECTED}, {_OCC}"
_GROWN = f"""WITH {TRADE}, {TRADE_RUNS},
    druns AS MATERIALIZED (SELECT * FROM runs UNION ALL SELECT dst, src, dl, el, sl, "start", "end" FROM runs),
    one AS (SELECT src AS a, dst AS b, sl, el, dl, "start", "end" FROM druns WHERE sl <= dl),
    grown AS MATERIALIZED (
        SELECT format('(0,1,{{}},{{}},{{}})({{}},2,{{}},{{}},{{}})', one.sl, one.el, one.dl, CASE WHEN r.src = one.b THEN 1 ELSE 0 END, r.sl, r.el, r.dl) AS code,
            one.a, one.b, r.dst AS c, greatest(one."start", r."start") AS "start", least(one."end", r."end") AS "end"
        FROM one JOIN druns r ON (r.src = one.a OR r.src = one.b) AND r.dst <> one.a AND r.dst <> one.b AND r."start" <= one."end" AND one."start" <= r."end"
        WHERE least([r.sl, r.el, r.dl], [r.dl, r.el, r.sl]) >= [one.sl, one.el, one.dl])"""
_WIN = """
    win AS (SELECT CAST(w.win AS INTEGER) AS win, seq FROM (SELECT unnest(range((SELECT count(*) FROM {s}))) AS win) w JOIN {s} ON seq >= w.win * 3 AND seq < w.win * 3 + {w}
        WHERE w.win * 3 + {w} <= (SELECT count(*) FROM {s}))"""


def _supply_windows(w: int, name: str) -> str:
    win = _WIN.format(s="supply_s", w=w).replace("win AS (", f"win_{name} AS (", 1)
    return f"""{win},
    found_{name} AS (SELECT win, n_edges, code, vlabel, count(*) AS support FROM occ_s JOIN win_{name} USING (seq) GROUP BY ALL HAVING count(*) >= ceil({w} * 0.5::DOUBLE))"""


_SUPPLY_OCC = """
    occ_s AS MATERIALIZED (SELECT DISTINCT 0 AS n_edges, '' AS code, vlabel, seq FROM supply_v UNION ALL
        SELECT DISTINCT 1, format('(0,1,{},{},{})', least(sl, dl), el, greatest(sl, dl)), NULL, seq FROM supply)"""
_MAIL = """
    o AS (SELECT '<' || o_orderkey || '>' AS msg_id, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) + 13 * 3600 + 300 + 7 * 3600 AS ts,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'c' || o_custkey || '@' || CASE WHEN o_custkey % 3 = 0 THEN 'in' ELSE 'out' END || '.example' END AS sender,
        CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 's' || (o_orderkey % 7) || '@in.example;s' || (o_orderkey % 5) || '@out.example' END AS recipients FROM orders)"""

ORACLE_SQL: dict[str, str] = {
    "frequent_small_patterns": f"{_MINED}, {_patterns(1, 0.5)} SELECT * FROM patterns",
    "graph_text_roundtrip": f"WITH {TRADE} SELECT seq, src, dst, sl, el, dl FROM trade",
    "first_snapshots": f"WITH {SUPPLY} SELECT seq, src, dst, elabel FROM supply_e WHERE seq < 5",
    "edge_list_snapshots": f"WITH {SUPPLY} SELECT seq, src, dst FROM supply_e",
    "mail_parse": f"WITH {_MAIL} SELECT msg_id, ts, sender, recipients FROM o",
    "mail_filter": f"WITH {_MAIL} SELECT msg_id, ts, sender, recipients FROM o WHERE ts >= epoch(TIMESTAMP '1998-01-01') AND sender IS NOT NULL AND (sender LIKE '%@in.example' OR recipients <> '')",
    "undirected_edges": f"WITH {TRADE}, e AS (SELECT DISTINCT snapshot_id, least(src, dst) AS src, greatest(src, dst) AS dst FROM trade_l WHERE src <> dst) SELECT * FROM e UNION ALL SELECT snapshot_id, dst, src FROM e",
    "dedupe_edges": f"WITH {SUPPLY} SELECT snapshot_id, src, dst, arg_max(elabel, (pos, elabel)) AS elabel FROM supply_l GROUP BY ALL",
    "self_loops": f"WITH {TRADE} SELECT snapshot_id, count(*) AS n FROM trade_l WHERE src <> dst GROUP BY ALL",
    "vertices_from_edges": f"WITH {SUPPLY} SELECT snapshot_id, src AS vid FROM supply_l UNION SELECT snapshot_id, dst FROM supply_l",
    "dangling_edges": f"WITH {SUPPLY} SELECT DISTINCT CAST(2 * l_suppkey AS INTEGER) AS vid FROM lineitem WHERE l_suppkey % 7 = 0 OR l_suppkey NOT IN (SELECT s_suppkey FROM supplier)",
    "remove_hubs": f"""WITH {SUPPLY}, deg AS (SELECT seq, vid FROM (SELECT seq, src AS vid FROM supply_e UNION ALL SELECT seq, dst FROM supply_e) GROUP BY ALL HAVING count(*) > 8)
        SELECT seq, src, dst, elabel FROM supply_e e WHERE NOT EXISTS (FROM deg WHERE deg.seq = e.seq AND deg.vid IN (e.src, e.dst))""",
    "entity_ids": f"""WITH {INTERACTIONS}, a AS (SELECT name, min((o, line, side)) AS seen FROM (SELECT o, line, 0 AS side, sender AS name FROM m UNION ALL SELECT o, line, 1, recipient FROM m) GROUP BY name)
        SELECT name, row_number() OVER (ORDER BY seen, name) - 1 AS id FROM a""",
    "stable_labels": f"""WITH {SUPPLY} SELECT seq, src, dst, CAST((src::BIGINT * 7919 + 13) % 100 AS INTEGER) AS sl, CAST((src::BIGINT * 7919 + dst::BIGINT * 104729) % 100 AS INTEGER) AS el,
        CAST((dst::BIGINT * 7919 + 13) % 100 AS INTEGER) AS dl FROM supply_e""",
    "activity_label": f"""WITH {INTERACTIONS}, a AS (SELECT day, o, line, 0 AS kind, sender AS name FROM m UNION ALL SELECT day, o, line, 1, recipient FROM m)
        SELECT strftime(day, '%Y-%m-%d') AS day, name, count(*) - arg_min(kind, (o, line, kind)) AS label FROM a GROUP BY ALL""",
    "interaction_count": f"WITH {INTERACTIONS} SELECT strftime(day, '%Y-%m-%d') AS day, least(sender, recipient) AS a, greatest(sender, recipient) AS b, count(*) AS n FROM m WHERE sender <> recipient GROUP BY ALL",
    "daily_snapshots": f"""WITH {INTERACTIONS}, d AS (SELECT DISTINCT day FROM m WHERE sender <> recipient)
        SELECT CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS snapshot_id, strftime(day, '%Y-%m-%d') AS day FROM d""",
    "snapshot_stats": f"""WITH {SUPPLY}, deg AS (SELECT seq, vid, count(*) AS n FROM (SELECT seq, src AS vid FROM supply_e UNION ALL SELECT seq, dst FROM supply_e) GROUP BY ALL)
        SELECT seq, count(*) AS n_vertices, CAST(sum(n) / 2 AS BIGINT) AS n_edges, min(n) AS min_degree, max(n) AS max_degree, count(*) FILTER (n >= 8) AS n_large FROM deg GROUP BY seq""",
    "sequence_stats": f"""WITH {SUPPLY}, deg AS (SELECT seq, vid, count(*) AS n FROM (SELECT seq, src AS vid FROM supply_e UNION ALL SELECT seq, dst FROM supply_e) GROUP BY ALL),
        st AS (SELECT seq, count(*) AS v, CAST(sum(n) / 2 AS BIGINT) AS e, max(n) AS d FROM deg GROUP BY seq)
        SELECT arg_min(seq, (v, seq)) AS smallest, arg_min(e, (v, seq)) AS smallest_edges, arg_max(seq, (v, -seq)) AS largest, arg_max(e, (v, -seq)) AS largest_edges, max(d) AS max_degree, avg(e) AS mean_edges FROM st""",
    "connected_snapshots": f"""WITH RECURSIVE {SUPPLY}, near AS MATERIALIZED (SELECT seq, src AS a, dst AS b FROM supply_e UNION ALL SELECT seq, dst, src FROM supply_e),
        lab AS (SELECT seq, vid, vid AS c FROM supply_v UNION SELECT l.seq, n.b, l.c FROM lab l JOIN near n ON n.seq = l.seq AND n.a = l.vid WHERE l.c < n.b),
        least AS (SELECT seq, vid, min(c) AS c FROM lab GROUP BY ALL)
        SELECT seq, count(DISTINCT c) AS n_components, count(DISTINCT c) = 1 AS connected FROM least GROUP BY seq""",
    "label_changes": f"WITH {TYPES} SELECT vid, seq, vlabel FROM changes",
    "label_as_of": f"""WITH {TYPES}, t AS (SELECT vid, CAST(s AS INTEGER) AS seq FROM (SELECT DISTINCT vid FROM types), (SELECT unnest(range(0, (SELECT max(seq) FROM types) + 1, 4)) AS s))
        SELECT t.vid, t.seq, c.vlabel FROM t ASOF LEFT JOIN changes c ON t.vid = c.vid AND t.seq >= c.seq""",
    "history_union": f"WITH {SUPPLY} SELECT src, dst, sl, el, dl, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM supply GROUP BY ALL",
    "edge_runs": f"WITH {SUPPLY}, {_runs('r', 'supply', _KEY)} SELECT * FROM r",
    "vertex_runs": f"WITH {SUPPLY}, {_runs('r', 'supply_v', 'vid, vlabel')} SELECT * FROM r",
    "run_similarity": f"{_CLUSTERED} SELECT i, j, common, similarity FROM simil",
    "cluster_partition": f"{_CLUSTERED} SELECT * FROM clusters",
    "cluster_intersection": f"{_CLUSTERED} SELECT * FROM inter",
    "cluster_delta": f"{_CLUSTERED} SELECT * FROM delta",
    "cluster_delta_vertices": f"""{_CLUSTERED}, own AS (SELECT cluster_id, seq, vid, vlabel FROM trade_v JOIN members USING (seq)),
        ends AS (SELECT cluster_id, seq, src AS vid FROM delta UNION SELECT cluster_id, seq, dst FROM delta)
        SELECT * FROM own ANTI JOIN vinter USING (cluster_id, vid, vlabel) UNION SELECT * FROM own SEMI JOIN ends USING (cluster_id, seq, vid)""",
    "cluster_border": f"""{_CLUSTERED}, both_ AS (SELECT cluster_id, seq, src, dst, el FROM delta UNION ALL SELECT cluster_id, seq, dst, src, el FROM delta)
        SELECT b.* FROM both_ b WHERE EXISTS (FROM vinter v WHERE v.cluster_id = b.cluster_id AND v.vid = b.src)""",
    "cluster_stats": f"{_CLUSTERED} SELECT count(*) AS n_clusters, avg(n) AS mean_size, max(n) AS largest, count(*) FILTER (n = 1) AS singles FROM clusters",
    "cluster_members": f"{_CLUSTERED} SELECT * FROM members",
    "cluster_retire": f"{_CLUSTERED} SELECT cluster_id, min(seq) AS first_seq, max(seq) AS last_seq, CAST(count(*) AS INTEGER) AS n FROM members WHERE seq >= 10 GROUP BY cluster_id",
    "frequent_points": f"WITH {SUPPLY} SELECT vlabel, count(DISTINCT seq) AS support FROM supply_v GROUP BY vlabel HAVING count(DISTINCT seq) >= ceil((SELECT count(*) FROM supply_s) * 0.5::DOUBLE)",
    "frequent_edges": f"""WITH {TRADE} SELECT least(sl, dl) AS sl, el, greatest(sl, dl) AS dl, count(DISTINCT seq) AS support FROM trade GROUP BY ALL
        HAVING count(DISTINCT seq) >= ceil((SELECT count(*) FROM trade_s) * 0.5::DOUBLE)""",
    "grow_two_edge": f'{_GROWN} SELECT code, count(*) AS stored, CAST(sum("end" - "start" + 1) AS BIGINT) AS expanded FROM grown GROUP BY code',
    "grow_triangle": f"""{_GROWN}
        SELECT g.code || format('(2,0,{{}},{{}},{{}})', r.sl, r.el, r.dl) AS code, CAST(sum(least(g."end", r."end") - greatest(g."start", r."start") + 1) AS BIGINT) AS expanded
        FROM grown g JOIN druns r ON r.src = g.c AND r.dst = g.a AND r."start" <= g."end" AND g."start" <= r."end"
        WHERE g.code LIKE '%)(1,2,%' AND least([r.sl, r.el, r.dl], [r.dl, r.el, r.sl]) >= list_transform(regexp_extract_all(g.code, '[0-9]+'), lambda x: CAST(x AS INTEGER))[3:5]
        GROUP BY ALL""",
    "grow_all_triangles": f"""{_GROWN}
        SELECT g.code || format('(2,0,{{}},{{}},{{}})', r.sl, r.el, r.dl) AS code, CAST(sum(least(g."end", r."end") - greatest(g."start", r."start") + 1) AS BIGINT) AS expanded
        FROM grown g JOIN druns r ON r.src = g.c AND r.dst = g.a AND r."start" <= g."end" AND g."start" <= r."end"
        WHERE g.code LIKE '%)(1,2,%' AND least([r.sl, r.el, r.dl], [r.dl, r.el, r.sl]) >= list_transform(regexp_extract_all(g.code, '[0-9]+'), lambda x: CAST(x AS INTEGER))[3:5]
        GROUP BY ALL""",
    "support_by_intervals": f"WITH {SUPPLY} SELECT format('(0,1,{{}},{{}},{{}})', least(sl, dl), el, greatest(sl, dl)) AS code, count(DISTINCT seq) AS support FROM supply GROUP BY ALL",
    "min_code_check": f"""{_GROWN}, p AS (SELECT DISTINCT code, list_transform(regexp_extract_all(code, '[0-9]+'), lambda x: CAST(x AS INTEGER)) AS n FROM grown),
        q AS (SELECT code, CASE WHEN n[6] = 1 THEN [n[5], n[3], n[4], n[9], n[10]] ELSE [n[3], n[5], n[4], n[9], n[10]] END AS g FROM p)
        SELECT q.code, q.code = (SELECT format('(0,1,{{}},{{}},{{}})({{}},2,{{}},{{}},{{}})', k[2], k[3], k[4], -k[5], k[6], k[7], k[8]) FROM (SELECT least([0, g[2], g[3], g[1], -1, g[1], g[4], g[5]], [0, g[5], g[4], g[1], -1, g[1], g[3], g[2]],
            [0, g[1], g[3], g[2], 0, g[1], g[4], g[5]], [0, g[1], g[4], g[5], 0, g[1], g[3], g[2]]) AS k)) AS is_min FROM q""",
    "mine_patterns": f"{_MINED}, {_patterns(2, 0.5)} SELECT * FROM patterns",
    "pattern_occurrences": f"{_MINED}, {_patterns(1, 0.5)} SELECT o.* FROM occ o JOIN patterns p ON o.code = p.code AND o.vlabel IS NOT DISTINCT FROM p.vlabel",
    "embedding_counts": f"""WITH {TRADE}, {TRADE_RUNS}, {DIRECTED}, {_OCC}, {_patterns(1, 0.5)}, d AS (SELECT * FROM runs UNION ALL SELECT dst, src, dl, el, sl, "start", "end" FROM runs),
        e AS (SELECT format('(0,1,{{}},{{}},{{}})', sl, el, dl) AS code, "start", "end" FROM d WHERE sl <= dl)
        SELECT code, count(*) AS stored, CAST(sum("end" - "start" + 1) AS BIGINT) AS expanded FROM e WHERE code IN (SELECT code FROM patterns) GROUP BY code""",
    "match_path": f"""WITH {TRADE}, {DIRECTED} SELECT a.seq, a.src AS v0, a.dst AS v1, b.dst AS v2 FROM directed a JOIN directed b ON a.seq = b.seq AND a.dst = b.src AND b.dst <> a.src
        WHERE (a.sl, a.el, a.dl) = (0, 1, 1) AND (b.sl, b.el, b.dl) = (1, 2, 2)""",
    "match_triangle": f"""WITH {TRADE}, {DIRECTED} SELECT a.seq, a.src AS v0, a.dst AS v1, b.dst AS v2 FROM directed a JOIN directed b ON a.seq = b.seq AND a.dst = b.src AND b.dst <> a.src
        JOIN directed c ON c.seq = a.seq AND c.src = b.dst AND c.dst = a.src WHERE (a.sl, a.el, a.dl) = (0, 1, 1) AND (b.sl, b.el, b.dl) = (1, 0, 2) AND (c.sl, c.el, c.dl) = (2, 2, 0)""",
    "embedding_contained": f"""{_CLUSTERED}, {DIRECTED}, di AS (SELECT cluster_id, src, dst, sl, el, dl FROM inter UNION ALL SELECT cluster_id, dst, src, dl, el, sl FROM inter)
        SELECT DISTINCT a.cluster_id, a.src AS v0, a.dst AS v1, b.dst AS v2 FROM di a JOIN di b ON a.cluster_id = b.cluster_id AND a.dst = b.src AND b.dst <> a.src
        WHERE (a.sl, a.el, a.dl) = (0, 1, 1) AND (b.sl, b.el, b.dl) = (1, 2, 2)""",
    "code_parse": f"{_GROWN} SELECT DISTINCT code, code AS again, 2 AS n_edges, 3 AS n_nodes FROM grown",
    "pattern_graph": f"""{_GROWN}, p AS (SELECT DISTINCT code, list_transform(regexp_extract_all(code, '[0-9]+'), lambda x: CAST(x AS INTEGER)) AS n FROM grown)
        SELECT code, 'v' AS kind, 0 AS a, NULL AS b, n[3] AS label FROM p UNION ALL SELECT code, 'v', 1, NULL, n[5] FROM p UNION ALL SELECT code, 'v', 2, NULL, n[10] FROM p
        UNION ALL SELECT code, 'e', 0, 1, n[4] FROM p UNION ALL SELECT code, 'e', n[6], 2, n[9] FROM p""",
    "pattern_summary": f"{_MINED}, {_patterns(2, 0.5)} SELECT n_edges, count(*) AS n FROM patterns GROUP BY n_edges",
    "pattern_text": f"""{_MINED}, {_patterns(1, 0.5)}, p AS (SELECT *, list_transform(regexp_extract_all(code, '[0-9]+'), lambda x: CAST(x AS INTEGER)) AS x FROM patterns),
        q AS (SELECT *, row_number() OVER (ORDER BY n_edges, vlabel, x) - 1 AS n FROM p)
        SELECT n, format('t # {{}} * {{}}', n, support) || chr(10) || CASE WHEN n_edges = 0 THEN format('v 0 {{}}', vlabel)
            ELSE format('v 0 {{}}', x[3]) || chr(10) || format('v 1 {{}}', x[5]) || chr(10) || format('e 0 1 {{}}', x[4]) END || chr(10) AS value FROM q""",
    "pattern_state": f"""{_CLUSTERED}, {DIRECTED}, {_OCC}, {_patterns(1, 0.5)}
        SELECT o.n_edges, o.code, o.vlabel, count(*) AS support, count(DISTINCT cluster_id) AS n_clusters, min(o.seq) AS first_seq, max(o.seq) AS last_seq
        FROM occ o JOIN patterns p ON o.code = p.code AND o.vlabel IS NOT DISTINCT FROM p.vlabel JOIN members USING (seq) GROUP BY ALL""",
    "window_assign": f"WITH {TRADE}, {_WIN.format(s='trade_s', w=12)} SELECT win, seq FROM win",
    "window_delta": f"""WITH {TRADE}, {_WIN.format(s='trade_s', w=12)}
        SELECT win, seq, 'added' AS change FROM win a WHERE win > 0 AND NOT EXISTS (FROM win b WHERE b.win = a.win - 1 AND b.seq = a.seq)
        UNION ALL SELECT win + 1, seq, 'removed' FROM win a WHERE win + 1 IN (SELECT win FROM win) AND NOT EXISTS (FROM win b WHERE b.win = a.win + 1 AND b.seq = a.seq)""",
    "window_mine": f"""{_MINED}, {_WIN.format(s='trade_s', w=12)}
        SELECT win, n_edges, code, vlabel, count(*) AS support, format('WIN{{:03d}}', win) AS name FROM occ JOIN win USING (seq) GROUP BY ALL HAVING count(*) >= ceil(12 * 0.8::DOUBLE)""",
    "window_changes": f"""WITH {SUPPLY}, {_SUPPLY_OCC}, {_supply_windows(12, 'a')},
        k AS (SELECT win, n_edges, code, vlabel FROM found_a)
        SELECT a.win, a.n_edges, a.code, a.vlabel, 'gained' AS change FROM k a WHERE win > 0 AND NOT EXISTS (FROM k b WHERE b.win = a.win - 1 AND b.code = a.code AND b.vlabel IS NOT DISTINCT FROM a.vlabel)
        UNION ALL SELECT a.win + 1, a.n_edges, a.code, a.vlabel, 'lost' FROM k a WHERE win < (SELECT max(win) FROM k)
            AND NOT EXISTS (FROM k b WHERE b.win = a.win + 1 AND b.code = a.code AND b.vlabel IS NOT DISTINCT FROM a.vlabel)""",
    "compare_results": f"""WITH {SUPPLY}, {_SUPPLY_OCC}, {_supply_windows(12, 'a')}, {_supply_windows(15, 'b')}
        SELECT *, 'a' AS side FROM (FROM found_a EXCEPT ALL FROM found_b) UNION ALL SELECT *, 'b' FROM (FROM found_b EXCEPT ALL FROM found_a)""",
    "stream_window_edges": f"""WITH {TRADE}, {_WIN.format(s='trade_s', w=12)}
        SELECT win, least(sl, dl) AS sl, el, greatest(sl, dl) AS dl, count(DISTINCT seq) AS support FROM trade JOIN win USING (seq) GROUP BY ALL HAVING count(DISTINCT seq) >= ceil(12 * 0.8::DOUBLE)""",
}

_LAST = "(SELECT max(win) FROM win)"
ORACLE_SQL |= {
    "embedding_clusters": f"""{_CLUSTERED}, {DIRECTED}, {_OCC}, {_patterns(1, 0.5)}, d AS (SELECT * FROM runs UNION ALL SELECT dst, src, dl, el, sl, "start", "end" FROM runs),
        e AS (SELECT row_number() OVER () AS i, format('(0,1,{{}},{{}},{{}})', sl, el, dl) AS code, "start", "end" FROM d WHERE sl <= dl),
        k AS (SELECT * FROM e WHERE code IN (SELECT code FROM patterns)),
        h AS (SELECT i, code, "end" - "start" + 1 AS len, count(c.n) AS spans, coalesce(sum(c.n), 0) AS covered FROM k LEFT JOIN clusters c ON "start" <= first_seq AND "end" >= last_seq GROUP BY ALL)
        SELECT code, count(*) AS stored, CAST(sum(spans) AS BIGINT) AS inter, CAST(sum(len - covered) AS BIGINT) AS other, CAST(sum(len) AS BIGINT) AS expanded FROM h GROUP BY code""",
    "window_mine_incremental": f"""{_MINED}, {_WIN.format(s="trade_s", w=12).replace("* 3", "* 6")}
        SELECT win, n_edges, code, vlabel, count(*) AS support FROM occ JOIN win USING (seq) GROUP BY ALL HAVING count(*) >= ceil(12 * 0.8::DOUBLE)""",
    "pattern_state_lists": f"""{_MINED}, {_WIN.format(s="trade_s", w=12).replace("* 3", "* 12")},
        o AS MATERIALIZED (SELECT occ.* FROM occ JOIN win USING (seq) WHERE win = {_LAST}),
        c AS MATERIALIZED (SELECT n_edges, code, vlabel, count(*) >= ceil(12 * 0.8::DOUBLE) AS frequent FROM o GROUP BY ALL)
        SELECT o.*, CAST(seq // 12 AS INTEGER) AS chunk, frequent FROM o JOIN c ON c.code = o.code AND c.n_edges = o.n_edges AND c.vlabel IS NOT DISTINCT FROM o.vlabel
        WHERE o.n_edges < 2 OR regexp_extract(o.code, '^[^)]*[)]') IN (SELECT code FROM c WHERE n_edges = 1 AND frequent)""",
    "pattern_text_sink": f"SELECT unnest(string_split(value, chr(10))) AS value FROM ({ORACLE_SQL['pattern_text']})",
}
#: What a sink wrote and read back is what it was given; other ways to the same patterns.
ORACLE_SQL |= {"dictionary_sink": ORACLE_SQL["entity_ids"], "window_sink": ORACLE_SQL["window_mine"], "mine_by_first_edge": ORACLE_SQL["mine_patterns"], "stream_patterns": ORACLE_SQL["window_mine_incremental"]}
