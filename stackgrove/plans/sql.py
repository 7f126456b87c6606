"""DuckDB SQL for the registered queries; contexts come from a recursive query, not from the windows Spark uses."""

from __future__ import annotations

_W = "(PARTITION BY tid ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)"
CONTEXTS = f"""WITH RECURSIVE ev AS (
  SELECT user_id AS tid, event_id AS seq, ts, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS tick,
    CASE WHEN event_type IN ('error', 'purchase') THEN -1 ELSE 1 END AS d,
    event_type || '@' || (coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) % 4) AS frame
  FROM events),
run AS (SELECT *, sum(d) OVER {_W} AS s FROM ev),
dep AS (SELECT *, CAST(s - least(0, min(s) OVER {_W}) AS BIGINT) AS depth, row_number() OVER {_W} AS rn FROM run),
ent AS (SELECT * FROM dep WHERE d = 1),
par AS (SELECT e.*, p.rn AS prn FROM ent e ASOF LEFT JOIN ent p ON e.tid = p.tid AND e.depth - 1 = p.depth AND e.rn > p.rn),
enters AS (
  SELECT tid, seq, ts, tick, rn, depth, frame, frame AS path FROM par WHERE depth = 1
  UNION ALL
  SELECT c.tid, c.seq, c.ts, c.tick, c.rn, c.depth, c.frame, q.path || '/' || c.frame FROM par c JOIN enters q ON c.tid = q.tid AND c.prn = q.rn WHERE c.depth > 1),
nodes AS (SELECT path, min(depth) AS depth, count(*) AS counter FROM enters GROUP BY path),
tot AS (SELECT CAST(sum(counter) AS BIGINT) AS n, max(counter) AS hottest FROM nodes),
up AS (SELECT path, counter, depth, array_to_string((string_split(path, '/'))[1:k], '/') AS prefix FROM (SELECT path, counter, depth, unnest(range(1, depth + 1)) AS k FROM nodes)),
fam AS (SELECT path, counter, depth, CASE WHEN depth = 1 THEN '' ELSE array_to_string((string_split(path, '/'))[1:depth - 1], '/') END AS parent, (string_split(path, '/'))[depth] AS frame FROM nodes),
clk AS (SELECT *, tick - (SELECT min(tick) FROM enters) AS t FROM enters),
cyc AS (SELECT *, CAST(floor((t - 1) / 24.0) AS BIGINT) AS c FROM clk WHERE t > 0),
smp AS (SELECT *, row_number() OVER (PARTITION BY tid, c ORDER BY ts, seq) = 1 AS start FROM (SELECT *, min(t) OVER (PARTITION BY tid, c) AS m FROM cyc) WHERE t <= ceil(m / 6.0) * 6),
bup AS (SELECT *, array_to_string((string_split(path, '/'))[1:k], '/') AS prefix FROM (SELECT *, unnest(range(1, depth)) AS k FROM smp WHERE start)),
walk AS (SELECT path, CAST(sum(n) AS BIGINT) AS counter FROM (SELECT path, count(*) AS n FROM smp GROUP BY path UNION ALL SELECT prefix, count(*) FROM bup GROUP BY prefix) GROUP BY path),
thr AS (SELECT CAST(floor(n / 1000) AS BIGINT) AS thr, n FROM tot),
adj AS (SELECT (SELECT n FROM tot) / CAST(sum(counter) AS DOUBLE) AS f FROM walk)
"""


def _q(body: str) -> str:
    return CONTEXTS + body


_SEEN = "(SELECT n.path, n.depth, n.counter, w.counter AS est FROM nodes n LEFT JOIN walk w USING (path))"
#: The gate is on in the last quarter of each day from the first enter on.
_GATED = """, gev AS (SELECT tid, seq, ts, d, ((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM enters)) * 1000) % 86400000000000 >= 64800000000000 AS g FROM ev),
gst AS (SELECT *, last_value(CASE WHEN NOT g THEN 0 WHEN d = 1 THEN 1 END IGNORE NULLS) OVER (PARTITION BY tid ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st FROM gev),
wsm AS (SELECT n.tid, n.seq, n.ts, n.path, n.depth, coalesce(gst.st, 1) = 0 AS start FROM gst JOIN enters n USING (tid, seq) WHERE gst.g AND gst.d = 1)
"""
ORACLE = {
    "chunked_cct": _q("SELECT path, CAST(depth AS INTEGER) AS depth, counter FROM nodes"),
    "exact_cct": _q("SELECT path, CAST(depth AS INTEGER) AS depth, counter FROM nodes"),
    "cct_by_thread": _q("SELECT tid, path, CAST(min(depth) AS INTEGER) AS depth, count(*) AS counter FROM enters GROUP BY tid, path"),
    "merge_threads": _q("SELECT path, CAST(min(depth) AS INTEGER) AS depth, count(*) AS counter, count(DISTINCT tid) AS threads FROM enters GROUP BY path"),
    "underflow_exits": _q("SELECT CAST(sum(CASE WHEN d = -1 AND low < before THEN 1 ELSE 0 END) AS BIGINT) AS underflow_exits FROM (SELECT d, low, coalesce(lag(low) OVER (PARTITION BY tid ORDER BY ts, seq), 0) AS before FROM (SELECT *, least(0, min(s) OVER " + _W + ") AS low FROM run))"),
    "hot_strict": _q("SELECT path, counter FROM nodes, thr WHERE counter > thr"),
    "hot_inclusive": _q("SELECT path, counter FROM nodes, thr WHERE counter >= thr"),
    "hcct_offline": _q("SELECT n.path, CAST(n.depth AS INTEGER) AS depth, n.counter, n.counter > thr AS hot FROM nodes n, thr WHERE n.path IN (SELECT prefix FROM up, thr WHERE counter > thr)"),
    "hcct_trace": _q("SELECT n.path, CAST(n.depth AS INTEGER) AS depth, n.counter, n.counter >= thr AS hot FROM nodes n, thr WHERE n.path IN (SELECT prefix FROM up, thr WHERE counter >= thr)"),
    "prune_depth": _q("SELECT path, CAST(depth AS INTEGER) AS depth, counter FROM nodes WHERE depth <= 3"),
    "tree_stats": _q("SELECT count(*) + 1 AS nodes, CAST(sum(counter) + 1 AS BIGINT) AS sum_counters, greatest(max(counter), 1) AS hottest FROM nodes"),
    "subtree_sums": _q("SELECT prefix AS path, CAST(sum(counter) AS BIGINT) AS inclusive FROM up GROUP BY prefix"),
    "subtree_weights": _q("SELECT prefix AS path, CAST(sum(CASE WHEN prefix = path THEN 0 ELSE counter END) AS BIGINT) AS exclusive FROM up GROUP BY prefix"),
    "degree_stats": _q("SELECT round(CAST(sum(n) AS DOUBLE) / count(*), 6) AS avg_degree, max(n) AS max_degree FROM (SELECT parent, count(*) AS n FROM fam GROUP BY parent)"),
    "distinct_routines": _q("SELECT count(DISTINCT split_part(frame, '@', 1)) AS n_routines, count(DISTINCT frame) AS n_call_sites FROM fam"),
    "distinct_routines_trace": _q("SELECT count(DISTINCT split_part(frame, '@', 1)) + 1 AS n_routines, count(DISTINCT frame) + 1 AS n_call_sites FROM fam"),
    "tau_count": _q("SELECT 10 AS tau, count(*) FILTER (counter * 10 >= hottest) + any_value(CASE WHEN 10 >= hottest THEN 1 ELSE 0 END) AS nodes FROM nodes, tot"),
    "max_phi_table": _q(
        """, run2 AS (SELECT counter, row_number() OVER w - 1 AS i, sum(counter) OVER w AS p FROM nodes WINDOW w AS (ORDER BY counter DESC, path ROWS UNBOUNDED PRECEDING)),
lev AS (SELECT k AS level, 100 - 100 / pow(1.25, k) AS overlap FROM (SELECT unnest(range(0, 30)) AS k))
SELECT CAST(level AS INTEGER) AS level, round(overlap, 6) AS overlap, hot_nodes, min_counter FROM (
SELECT level, overlap, min(i) AS hot_nodes, max(counter) AS min_counter FROM lev, tot, run2 WHERE p >= n * overlap / 100 GROUP BY level, overlap
UNION ALL SELECT 30, 100.0, (SELECT count(*) FROM nodes), (SELECT min(counter) FROM nodes))"""
    ),
    "hot_per_phi": _q(
        """, ph AS (SELECT phi, CAST(floor(n / phi) AS BIGINT) AS threshold FROM tot, (SELECT unnest([100, 1000, 5000]) AS phi))
SELECT CAST(phi AS BIGINT) AS phi_reciprocal, threshold, (SELECT count(DISTINCT prefix) FROM up WHERE counter >= threshold) + 1 AS nodes, (SELECT count(*) FROM nodes WHERE counter >= threshold) AS hot_nodes FROM ph"""
    ),
    "sibling_rank": _q("SELECT path, counter, row_number() OVER (PARTITION BY parent ORDER BY counter DESC, path) AS rank FROM fam"),
    "growth_curve": _q(
        """, f AS (SELECT path, min(CAST(ts AS DATE)) AS day FROM enters GROUP BY path),
g AS (SELECT day, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b FROM (SELECT day, count(*) AS a, 0 AS b FROM f GROUP BY day UNION ALL SELECT CAST(ts AS DATE), 0, count(*) FROM enters GROUP BY 1) GROUP BY day)
SELECT day, CAST(sum(a) OVER (ORDER BY day) AS BIGINT) AS nodes, CAST(sum(b) OVER (ORDER BY day) AS BIGINT) AS events FROM g"""
    ),
    "static_burst_walk": _q("SELECT path, counter FROM walk"),
    "static_burst_create": _q(
        """, own AS (SELECT tid, path, count(*) AS n, min(struct_pack(ts := ts, seq := seq)) AS at FROM smp GROUP BY tid, path),
abv AS (SELECT tid, prefix AS path, min(struct_pack(ts := ts, seq := seq)) AS at FROM bup GROUP BY tid, prefix)
SELECT path, CAST(sum(coalesce(o.n, 0) + CASE WHEN a.at IS NOT NULL AND (o.at IS NULL OR a.at < o.at) THEN 1 ELSE 0 END) AS BIGINT) AS counter FROM own o FULL JOIN abv a USING (tid, path) GROUP BY path"""
    ),
    "burst_stats": _q("SELECT (SELECT count(*) FROM enters) AS enters, count(*) AS sampled, CAST(sum(CASE WHEN start THEN 1 ELSE 0 END) AS BIGINT) AS bursts, round(count(*) * 100.0 / (SELECT count(*) FROM enters), 6) AS percent FROM smp"),
    "wall_clock_bursts": _q(_GATED + "SELECT path, count(*) AS counter, CAST(sum(CASE WHEN start THEN 1 ELSE 0 END) AS BIGINT) AS bursts FROM wsm GROUP BY path"),
    "wall_clock_tree": _q(
        _GATED
        + """, wup AS (SELECT tid, ts, seq, array_to_string((string_split(path, '/'))[1:k], '/') AS prefix FROM (SELECT *, unnest(range(1, depth)) AS k FROM wsm WHERE start)),
own AS (SELECT tid, path, count(*) AS n, min(struct_pack(ts := ts, seq := seq)) AS at FROM wsm GROUP BY tid, path),
abv AS (SELECT tid, prefix AS path, min(struct_pack(ts := ts, seq := seq)) AS at FROM wup GROUP BY tid, prefix)
SELECT path, CAST(sum(coalesce(o.n, 0) + CASE WHEN a.at IS NOT NULL AND (o.at IS NULL OR a.at < o.at) THEN 1 ELSE 0 END) AS BIGINT) AS counter FROM own o FULL JOIN abv a USING (tid, path) GROUP BY path"""
    ),
    "elapsed_ticks": _q("SELECT tid, CAST(sum(e) AS BIGINT) AS elapsed FROM (SELECT tid, tick - lag(tick) OVER (PARTITION BY tid ORDER BY ts, seq) AS e FROM ev) GROUP BY tid"),
    "time_cct": _q(
        """, st AS (SELECT tid, rn, tick - lag(tick) OVER v AS e, lag(depth) OVER v AS lv FROM dep WINDOW v AS (PARTITION BY tid ORDER BY ts, seq)),
ch AS (SELECT q.path, s.e FROM (SELECT * FROM st WHERE lv > 0) s ASOF JOIN enters q ON s.tid = q.tid AND s.lv = q.depth AND s.rn > q.rn),
cs AS (SELECT path, sum(e) AS n FROM ch GROUP BY path),
ca AS (SELECT path, n, len(string_split(path, '/')) AS depth FROM cs),
al AS (SELECT DISTINCT array_to_string((string_split(path, '/'))[1:k], '/') AS path FROM (SELECT path, unnest(range(1, depth + 1)) AS k FROM ca))
SELECT a.path, CAST(len(string_split(a.path, '/')) AS INTEGER) AS depth, CAST(coalesce(c.n, 0) AS BIGINT) AS counter FROM al a LEFT JOIN cs c USING (path)"""
    ),
    "uncovered": _q(f"SELECT count(*) AS uncovered, CAST(coalesce(sum(counter), 0) AS BIGINT) AS sum, round(avg(counter), 6) AS avg, coalesce(max(counter), 0) AS max FROM {_SEEN} WHERE est IS NULL"),
    "degree_overlap": _q(f"SELECT round(CAST(sum(CASE WHEN est IS NOT NULL THEN counter ELSE 0 END) AS DOUBLE) * 100 / sum(counter), 6) AS overlap FROM {_SEEN}"),
    "counter_error": _q(f"SELECT count(*) AS hot, round(max(abs(counter - est * f) * 100 / counter), 6) AS max_error, round(avg(abs(counter - est * f) * 100 / counter), 6) AS avg_error FROM {_SEEN}, adj, thr WHERE est IS NOT NULL AND counter >= thr"),
    "false_positives": _q(f"SELECT count(*) AS false_positives FROM {_SEEN}, thr WHERE est IS NOT NULL AND counter < thr AND est >= thr // 4"),
    "hot_coverage_tau": _q(
        f"""SELECT CAST(step AS INTEGER) AS step, count(*) FILTER (counter * step * 10 >= hottest) AS nodes, count(*) FILTER (counter * step * 10 >= hottest AND est IS NOT NULL) AS covered,
round(count(*) FILTER (counter * step * 10 >= hottest AND est IS NOT NULL) * 100.0 / count(*) FILTER (counter * step * 10 >= hottest), 6) AS coverage FROM {_SEEN}, tot, (SELECT unnest([1, 2, 4, 6, 8, 10]) AS step) GROUP BY step"""
    ),
    "hot_coverage_factors": _q(
        f""", fa AS (SELECT factor, CAST(ceil(CAST(thr + 1 AS DOUBLE) / hottest / factor * hottest) AS BIGINT) AS threshold FROM thr, tot, (SELECT unnest([0.01, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.4, 1.5]::DOUBLE[]) AS factor))
SELECT factor, threshold, count(*) FILTER (counter >= threshold) AS nodes, count(*) FILTER (counter >= threshold AND est IS NOT NULL) AS matched,
coalesce(round(count(*) FILTER (counter >= threshold AND est IS NOT NULL) * 100.0 / nullif(count(*) FILTER (counter >= threshold), 0), 6), 100.0) AS coverage FROM {_SEEN}, fa GROUP BY factor, threshold"""
    ),
    "node_partition": _q(
        f"""SELECT (SELECT count(*) FROM {_SEEN}, thr WHERE est IS NOT NULL AND counter > thr) AS hot, (SELECT count(*) FROM {_SEEN}, thr WHERE est IS NOT NULL AND counter <= thr) AS cold, CAST(0 AS BIGINT) AS false_positives,
(SELECT count(*) FROM {_SEEN}, thr WHERE est IS NULL AND counter > thr) AS false_negatives"""
    ),
    "counter_accuracy": _q(
        f"""SELECT count(*) AS matched, round(max(least(e, 1.0)), 6) AS max_error, round(avg(least(e, 1.0)), 6) AS avg_error, count(*) FILTER (e > 1) AS over_100
FROM (SELECT abs(floor(est * f) - counter) / counter AS e FROM {_SEEN}, adj, thr WHERE est IS NOT NULL AND counter > thr)"""
    ),
    "adjust_factor": _q("SELECT round(f, 6) AS factor FROM adj"),
    "sampling_ratios": _q("SELECT round(CAST((SELECT count(*) FROM smp) AS DOUBLE) / n, 6) AS sampled_of_second, round(CAST((SELECT sum(counter) FROM walk) AS DOUBLE) / n, 6) AS sampled_of_first, CAST(1 AS DOUBLE) AS second_of_first FROM tot"),
    "summary_report": _q(
        """SELECT 12 + CAST(ceil((count(*) + 1) / 1024.0) AS BIGINT) * 20484 AS bytes, count(*) + 1 AS nodes, CAST(sum(counter) AS BIGINT) AS stream, count(*) FILTER (counter > (SELECT thr FROM thr)) AS hot_nodes, CAST(sum(counter) + 1 AS BIGINT) AS sum_counters, max(counter) AS hottest,
count(*) FILTER (counter * 10 >= (SELECT hottest FROM tot)) + (SELECT CASE WHEN 10 >= hottest THEN 1 ELSE 0 END FROM tot) AS near_hottest, count(DISTINCT split_part(frame, '@', 1)) AS routines, count(DISTINCT frame) AS call_sites FROM fam"""
    ),
    "region_join": "SELECT p.p_partkey AS address, min(r.lo) AS start_addr, min_by(r.name, r.lo) AS pathname FROM part p LEFT JOIN (SELECT s_suppkey * 20 AS lo, s_suppkey * 20 + 30 AS hi, s_name AS name FROM supplier) r ON p.p_partkey BETWEEN r.lo AND r.hi GROUP BY p.p_partkey",
    "symbol_join": "SELECT l_partkey + 1 AS address, p_name AS name, p_brand AS image, count(*) AS n FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3",
    "child_similarity": _q(
        """, wf AS (SELECT path, counter, CASE WHEN d = 1 THEN '' ELSE array_to_string((string_split(path, '/'))[1:d - 1], '/') END AS parent, (string_split(path, '/'))[d] AS frame FROM (SELECT *, len(string_split(path, '/')) AS d FROM walk)),
pr AS (SELECT a.path AS first_path, b.path AS second_path, a.counter AS c1, b.counter AS c2, split_part(a.frame, '@', 1) = split_part(b.frame, '@', 1) AS r, a.frame = b.frame AS s FROM fam a JOIN wf b ON a.parent = b.parent)
SELECT first_path, second_path, round((10 + CASE WHEN r THEN 30 ELSE 0 END + 10 + CASE WHEN s THEN 30 ELSE 0 END) / 100.0 + CASE WHEN floor(abs(c1 - f * c2)) / c1 < 1 THEN 0.20 * (1 - floor(abs(c1 - f * c2)) / c1) ELSE 0 END, 6) AS score FROM pr, adj"""
    ),
    "graphviz_lines": _q("SELECT path, '\"' || path || '\" [label=\"' || split_part(frame, '@', 1) || '\"]; \"' || CASE WHEN parent = '' THEN 'root' ELSE parent END || '\" -> \"' || path || '\" [label=\"calls: ' || counter || '\"];' AS line FROM fam"),
    "tree_dump_lines": _q("SELECT path, 'v ' || md5(path)[1:16] || ' ' || md5(parent)[1:16] || ' ' || counter || ' ' || split_part(frame, '@', 1) || ' ' || split_part(frame, '@', 2) AS line FROM fam"),
    "growth_log": _q(", fst AS (SELECT path, min(struct_pack(ts := ts, tid := tid, seq := seq)) AS sight FROM enters GROUP BY path) SELECT nodes, ts FROM (SELECT row_number() OVER (ORDER BY sight) AS nodes, sight.ts AS ts FROM fst) WHERE nodes % 100 = 0"),
    "trace_round_trip": _q("SELECT replace(replace(replace(path, 'signup', '1'), 'view', '2'), 'click', '3') AS path, counter FROM nodes"),
    "dump_round_trip": _q("SELECT replace(replace(replace(path, 'signup', '1'), 'view', '2'), 'click', '3') AS path, CAST(depth AS INTEGER) AS depth, counter FROM nodes"),
    "console_tree": _q("SELECT path, repeat('=', depth) || ' ' || frame || ' ' || counter AS line FROM fam"),
    "json_tree": _q(
        """, dfs AS (SELECT (string_split(path, '/'))[1] AS name, frame, depth, list_transform(string_split(path, '/'), lambda x: x || '"') AS o FROM fam),
nxt AS (SELECT *, lead(depth) OVER (PARTITION BY name ORDER BY o) AS "then" FROM dfs)
SELECT name, string_agg('{"name":"' || frame || '","children":[' || repeat(']}', CAST(depth - coalesce(nxt."then", 1) + 1 AS INTEGER)) || CASE WHEN nxt."then" <= depth THEN ',' ELSE '' END, '' ORDER BY o) AS json FROM nxt GROUP BY name"""
    ),
    "lss_large": _q("SELECT path, count(*) AS counter FROM enters GROUP BY path"),
    "bss_large": _q("SELECT path, count(*) AS counter FROM enters GROUP BY path"),
    "lc_large": _q("SELECT path, count(*) AS counter FROM enters GROUP BY path"),
    "shallow_tree": """SELECT path, CAST(len(string_split(path, '/')) AS INTEGER) AS depth, CAST(sum(n) AS BIGINT) AS counter FROM (
SELECT unnest([r_name, r_name || '/' || n_name, r_name || '/' || n_name || '/' || c_mktsegment, r_name || '/' || n_name || '/' || c_mktsegment || '/' || o_orderpriority]) AS path, n FROM (
SELECT r_name, n_name, c_mktsegment, o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)) GROUP BY path""",
    "windowed_calls": "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type AS routine_id, count(*) AS enters FROM events WHERE event_type NOT IN ('error', 'purchase') GROUP BY 1, 2",
}
