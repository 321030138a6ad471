"""The engine's registered queries over the driver's tables, each with DuckDB SQL.

Q maps a name to (dialect text, DuckDB text or None).  Streams: events and, as plain
streams in key order, the other tables; lookups: customer, nation, part, supplier.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookql.session import Engine

ORDER = {"events": ("event_id",), "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber"), "documents": ("doc_id",), "embeddings": ("vec_id",), "customer": ("c_custkey",), "nation": ("n_nationkey",), "region": ("r_regionkey",), "part": ("p_partkey",), "supplier": ("s_suppkey",), "conversations": ("conv_id", "turn"), "pages": ("page_id",), "labels": ("doc_id",), "benchmark": ("item_id",)}
TABLES = ("customer", "nation", "region", "part", "supplier")


class _Lazy(dict):
    """Opens a table of the folder when a statement first names it."""

    def __init__(self, engine: Engine, folder: str) -> None:
        super().__init__()
        self.engine, self.folder = engine, folder

    def __missing__(self, name: str):
        if name not in ORDER:
            raise KeyError(name)
        df = self.engine.spark.read.parquet(f"{self.folder}/{name}.parquet")
        options = {"timestamp": "ts"} if name == "events" else {}
        return self.engine.register(name, df, ORDER[name], name in TABLES, **options)

    def __contains__(self, name) -> bool:
        return name in ORDER or super().__contains__(name)


def engine(spark: SparkSession, folder: str, **options) -> Engine:
    """An engine whose sources are the tables of a folder."""
    e = Engine(spark, **options)
    e.catalog.sources = _Lazy(e, folder)
    return e


EV = "(SELECT *, epoch_us(ts) // 1000 AS t FROM events)"
HOUR, MINUTE = 3_600_000, 60_000
W = "OVER (PARTITION BY user_id ORDER BY t, event_id)"
UP = "OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)"
BEFORE = "OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

Q: dict[str, tuple[str, str | None]] = {}


def q(name: str, text: str, duck: str | None) -> None:
    Q[name] = (text, duck)


# -- projections and filters ------------------------------------------------------
q("filter_project", "SELECT event_id, value * 1.8 + 32 AS v FROM events WHERE value > 20.0", "SELECT event_id, value * 1.8 + 32 AS v FROM events WHERE value > 20.0")
q("select_star_except_replace", "SELECT * EXCEPT (props, ts) REPLACE (value * 2 AS value) FROM events", "SELECT event_id, user_id, event_type, value * 2 AS value FROM events")
q("arithmetic_integer", "SELECT event_id, user_id + event_id * 3 - 7 AS a, event_id % 7 AS m, abs(event_id / 7) AS d, event_id / 8 AS f, -user_id AS n FROM events", "SELECT event_id, user_id + event_id * 3 - 7 AS a, event_id % 7 AS m, event_id // 7 AS d, event_id / 8 AS f, -user_id AS n FROM events")
q("bitwise_operators", "SELECT event_id, event_id & 12 AS a, event_id | 3 AS o, event_id ^ 5 AS x FROM events", "SELECT event_id, event_id & 12 AS a, event_id | 3 AS o, xor(event_id, 5) AS x FROM events")
q("predicates_null_logic", "SELECT event_id, value > NULL AS a, NOT (value = NULL) AS b, (value > 0 OR NULL) AS c, value IS NULL AS d, user_id NOT IN (1, 2, 3) AS e FROM events", "SELECT event_id, false AS a, true AS b, false AS c, value IS NULL AS d, user_id NOT IN (1, 2, 3) AS e FROM events")
q("predicates_like_between_in", "SELECT event_id FROM events WHERE event_type LIKE '%i%' AND value BETWEEN 5 AND 50 AND event_type IN ('click', 'view', 'signup') AND user_id NOT BETWEEN 10 AND 20", "SELECT event_id FROM events WHERE event_type LIKE '%i%' AND value BETWEEN 5 AND 50 AND event_type IN ('click', 'view', 'signup') AND user_id NOT BETWEEN 10 AND 20")
q("case_expressions", "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS s, CASE WHEN value > 100 THEN 'high' WHEN value > 10 THEN 'mid' ELSE 'low' END AS c FROM events", "SELECT event_id, CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS BIGINT) AS s, CASE WHEN value > 100 THEN 'high' WHEN value > 10 THEN 'mid' ELSE 'low' END AS c FROM events")
q("error_rows_dropped", "SELECT event_id, 100 / (user_id % 5) AS x FROM events", "SELECT event_id, 100 // (user_id % 5) AS x FROM events WHERE user_id % 5 <> 0")
q("literals_and_indexes", "SELECT event_id, [1, 2, 3][-1] AS l, to_json([10, 20, 30, 40][1:3]) AS s, {a: event_id, b: user_id}.a AS a FROM events", "SELECT event_id, CAST(3 AS BIGINT) AS l, '[20,30]' AS s, event_id AS a FROM events")
q("order_limit", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
q("union_all", "SELECT event_id, event_type FROM events WHERE value > 100 UNION ALL SELECT event_id, event_type FROM events WHERE value > 200", "SELECT event_id, event_type FROM events WHERE value > 100 UNION ALL SELECT event_id, event_type FROM events WHERE value > 200")
q("union_distinct", "SELECT event_type, user_id FROM events WHERE value > 50 UNION SELECT event_type, user_id FROM events WHERE value < 5", "SELECT event_type, user_id FROM events WHERE value > 50 UNION SELECT event_type, user_id FROM events WHERE value < 5")
q("unnest_rows", "SELECT event_id, unnest(split(event_type, 'i')) AS piece FROM events", "SELECT event_id, unnest(string_split(event_type, 'i')) AS piece FROM events")
q("stateless_aggregates", "SELECT event_id, count(*) AS c, sum(value) AS s, avg(user_id) AS a, max(value) AS m FROM events", "SELECT event_id, 1::BIGINT AS c, value AS s, user_id::DOUBLE AS a, value AS m FROM events")

# -- windows ----------------------------------------------------------------------
q("tumbling_by_key", "SELECT user_id, window_start() AS ws, window_end() AS we, count(*) AS c, avg(value) AS a, max(value) AS m, min(value) AS n, sum(value) AS s FROM events GROUP BY user_id, TUMBLINGWINDOW(hh, 1)", f"SELECT user_id, t - t % {HOUR} AS ws, t - t % {HOUR} + {HOUR} AS we, count(*) AS c, avg(value) AS a, max(value) AS m, min(value) AS n, sum(value) AS s FROM {EV} GROUP BY user_id, t - t % {HOUR}")
q("tumbling_global", "SELECT window_start() AS ws, count(*) AS c, stddev(value) AS sp, stddevs(value) AS ss, round(var(value), 3) AS vp, round(vars(value), 3) AS vs, median(value) AS md, percentile(value, 0.9) AS p FROM events GROUP BY TUMBLINGWINDOW(hh, 6)", f"SELECT t - t % {6 * HOUR} AS ws, count(*) AS c, stddev_pop(value) AS sp, stddev_samp(value) AS ss, round(var_pop(value), 3) AS vp, round(var_samp(value), 3) AS vs, median(value) AS md, quantile_cont(value, 0.9) AS p FROM {EV} GROUP BY ALL")
q("tumbling_having_filter", "SELECT event_type, window_end() AS we, count(*) AS c FROM events GROUP BY event_type, TUMBLINGWINDOW(hh, 2) FILTER (WHERE value > 10) HAVING count(*) > 3", f"SELECT event_type, t - t % {2 * HOUR} + {2 * HOUR} AS we, count(*) AS c FROM {EV} WHERE value > 10 GROUP BY event_type, t - t % {2 * HOUR} HAVING count(*) > 3")
q("tumbling_top_k", "SELECT user_id, window_start() AS ws, sum(value) AS s FROM events GROUP BY user_id, TUMBLINGWINDOW(dd, 1) ORDER BY s DESC LIMIT 3", f"SELECT user_id, ws, s FROM (SELECT user_id, t - t % {24 * HOUR} AS ws, sum(value) AS s, row_number() OVER (PARTITION BY t - t % {24 * HOUR} ORDER BY sum(value) DESC, min((t, event_id))) AS n FROM {EV} GROUP BY user_id, t - t % {24 * HOUR}) WHERE n <= 3")
q("first_row_columns", "SELECT user_id, event_id, event_type, count(*) AS c FROM events GROUP BY user_id, TUMBLINGWINDOW(dd, 1)", f"SELECT user_id, arg_min(event_id, (t, event_id)) AS event_id, arg_min(event_type, (t, event_id)) AS event_type, count(*) AS c FROM {EV} GROUP BY user_id, t - t % {24 * HOUR}")
q("window_rows_without_aggregate", "SELECT event_id, window_start() AS ws FROM events WHERE value > 100 GROUP BY TUMBLINGWINDOW(mi, 30)", f"SELECT event_id, t - t % {30 * MINUTE} AS ws FROM {EV} WHERE value > 100")
q("hopping_by_type", "SELECT event_type, window_end() AS we, count(*) AS c, sum(value) AS s FROM events GROUP BY event_type, HOPPINGWINDOW(hh, 2, 1)", f"SELECT event_type, we, count(*) AS c, sum(value) AS s FROM (SELECT *, unnest([t - t % {HOUR} + {HOUR}, t - t % {HOUR} + {2 * HOUR}]) AS we FROM {EV}) GROUP BY event_type, we")
q("hopping_sparse", "SELECT window_start() AS ws, count(*) AS c FROM events GROUP BY HOPPINGWINDOW(hh, 1, 4)", f"SELECT t - t % {4 * HOUR} + {3 * HOUR} AS ws, count(*) AS c FROM {EV} WHERE t % {4 * HOUR} >= {3 * HOUR} GROUP BY ALL")
q("sliding_counts", "SELECT window_end() AS we, count(*) AS c, sum(value) AS s, max(event_id) AS e FROM events GROUP BY SLIDINGWINDOW(mi, 20)", f"SELECT a.t AS we, count(*) AS c, sum(b.value) AS s, max(b.event_id) AS e FROM {EV} a JOIN {EV} b ON b.t BETWEEN a.t - {20 * MINUTE} AND a.t AND (b.t, b.event_id) <= (a.t, a.event_id) GROUP BY a.t, a.event_id")
q("sliding_when_by_key", "SELECT event_type, window_end() AS we, count(*) AS c FROM events GROUP BY event_type, SLIDINGWINDOW(mi, 30) OVER (WHEN event_type = 'error')", f"SELECT b.event_type, a.t AS we, count(*) AS c FROM {EV} a JOIN {EV} b ON b.t BETWEEN a.t - {30 * MINUTE} AND a.t AND (b.t, b.event_id) <= (a.t, a.event_id) WHERE a.event_type = 'error' GROUP BY a.t, a.event_id, b.event_type")
q("count_window", "SELECT count(*) AS c, sum(value) AS s, min(event_id) AS e FROM events GROUP BY COUNTWINDOW(50)", f"SELECT count(*) AS c, sum(value) AS s, min(event_id) AS e FROM (SELECT *, (row_number() OVER (ORDER BY t, event_id) - 1) // 50 AS w FROM {EV}) GROUP BY w HAVING count(*) = 50")
q("count_window_overlapping", "SELECT count(*) AS c, max(event_id) AS e, sum(value) AS s FROM events GROUP BY COUNTWINDOW(10, 4)", f"SELECT count(*) AS c, max(event_id) AS e, sum(value) AS s FROM (SELECT *, row_number() OVER (ORDER BY t, event_id) - 1 AS i FROM {EV}) x JOIN (SELECT unnest(range(0, 100000)) AS w) y ON x.i >= 4 * w AND x.i < 4 * w + 10 GROUP BY w HAVING count(*) = 10")
q("session_window", "SELECT window_start() AS ws, window_end() AS we, count(*) AS c, max(value) AS m FROM events GROUP BY SESSIONWINDOW(mi, 100000, 6)", f"SELECT min(t) AS ws, max(t) + {6 * MINUTE} AS we, count(*) AS c, max(value) AS m FROM (SELECT *, sum(f) OVER (ORDER BY t, event_id) AS g FROM (SELECT *, CASE WHEN t - lag(t) OVER (ORDER BY t, event_id) > {6 * MINUTE} THEN 1 ELSE 0 END AS f FROM {EV})) GROUP BY g")
q("session_window_longest", "SELECT window_start() AS ws, count(*) AS c FROM events GROUP BY SESSIONWINDOW(mi, 30, 10)", f"""WITH RECURSIVE o AS (SELECT t, row_number() OVER (ORDER BY t, event_id) AS n FROM {EV}),
r AS (SELECT n, t, t AS ws FROM o WHERE n = 1 UNION ALL
SELECT o.n, o.t, CASE WHEN o.t - r.t > {10 * MINUTE} OR o.t - r.ws >= {30 * MINUTE} THEN o.t ELSE r.ws END FROM r JOIN o ON o.n = r.n + 1)
SELECT ws, count(*) AS c FROM r GROUP BY ws""")
q("state_window_one", "SELECT min(event_id) AS e, count(*) AS c, window_start() AS ws FROM events GROUP BY STATEWINDOW(event_type = 'signup')", f"SELECT min(event_id) AS e, count(*) AS c, min(t) AS ws FROM (SELECT *, count(*) FILTER (WHERE event_type = 'signup') OVER (ORDER BY t, event_id) AS g FROM {EV}) WHERE g > 0 GROUP BY g")
q("state_window_two_by_key", "SELECT user_id, count(*) AS c, window_start() AS ws FROM events GROUP BY user_id, STATEWINDOW(event_type = 'view', event_type = 'purchase') OVER (PARTITION BY user_id)", f"""WITH s AS (SELECT *, sum(CASE WHEN event_type IN ('view', 'purchase') THEN 1 ELSE 0 END) {UP} AS k FROM {EV}),
a AS (SELECT *, first_value(event_type) OVER (PARTITION BY user_id, k ORDER BY t, event_id) = 'view' AND k > 0 AS after FROM s),
b AS (SELECT *, coalesce(lag(after) {W}, false) AS before FROM a),
c AS (SELECT *, sum(CASE WHEN after AND NOT before THEN 1 ELSE 0 END) {UP} AS n FROM b)
SELECT user_id, count(*) AS c, min(t) AS ws FROM c WHERE after OR before GROUP BY user_id, n""")

# -- aggregates -------------------------------------------------------------------
q("aggregates_ordered", "SELECT user_id, to_json(collect(event_id)) AS l, last_value(event_type) AS lv, latest(value) AS lt, lead(event_id, 1) AS ld, percentile_disc(value, 0.5) AS pd, window_start() AS ws FROM events GROUP BY user_id, TUMBLINGWINDOW(dd, 5)", f"SELECT user_id, CAST(to_json(list(event_id ORDER BY t, event_id)) AS VARCHAR) AS l, arg_max(event_type, (t, event_id)) AS lv, arg_max(value, (t, event_id)) AS lt, list(event_id ORDER BY t, event_id)[2] AS ld, quantile_disc(value, 0.5) AS pd, t - t % {120 * HOUR} AS ws FROM {EV} GROUP BY user_id, t - t % {120 * HOUR}")
q("aggregates_in_expressions", "SELECT event_type, round(avg(value) + 1, 3) AS a, CASE WHEN count(*) > 20 THEN 'many' ELSE 'few' END AS k, sum(value * user_id) / count(*) AS w FROM events GROUP BY event_type, TUMBLINGWINDOW(dd, 1)", f"SELECT event_type, round(avg(value) + 1, 3) AS a, CASE WHEN count(*) > 20 THEN 'many' ELSE 'few' END AS k, sum(value * user_id) / count(*) AS w FROM {EV} GROUP BY event_type, t - t % {24 * HOUR}")
q("having_had_changed", "SELECT event_type, window_end() AS we, count(*) AS c FROM events GROUP BY event_type, TUMBLINGWINDOW(hh, 3) HAVING had_changed(count(*))", f"SELECT event_type, we, c FROM (SELECT *, lag(c) OVER (PARTITION BY event_type ORDER BY we) AS p FROM (SELECT event_type, t - t % {3 * HOUR} + {3 * HOUR} AS we, count(*) AS c FROM {EV} GROUP BY ALL)) WHERE p IS NULL OR p <> c")
q("agg_hit_counters", "SELECT window_end() AS we, count(*) AS c, last_agg_hit_count() AS n, last_agg_hit_time() AS p FROM events GROUP BY TUMBLINGWINDOW(hh, 12)", f"SELECT we, c, row_number() OVER (ORDER BY we) - 1 AS n, coalesce(lag(we) OVER (ORDER BY we), 0) AS p FROM (SELECT t - t % {12 * HOUR} + {12 * HOUR} AS we, count(*) AS c FROM {EV} GROUP BY ALL)")
q("lineitem_pricing", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, sum(l_extendedprice * (1 - l_discount)) AS r, avg(l_discount) AS d, count(*) AS c FROM lineitem GROUP BY l_returnflag, l_linestatus, TUMBLINGWINDOW(dd, 1)", "SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS q, CAST(sum(l_extendedprice * (1 - l_discount)) AS DOUBLE) AS r, CAST(avg(l_discount) AS DOUBLE) AS d, count(*) AS c FROM lineitem GROUP BY ALL")

# -- analytic ---------------------------------------------------------------------
q("analytic_running", "SELECT event_id, acc_count(value) OVER (PARTITION BY user_id) AS c, round(acc_sum(value) OVER (PARTITION BY user_id), 4) AS s, round(acc_avg(value) OVER (PARTITION BY user_id) * acc_count(value) OVER (PARTITION BY user_id), 2) AS a, acc_min(value) OVER (PARTITION BY user_id) AS n, acc_max(value) OVER (PARTITION BY user_id) AS m, row_number() OVER (PARTITION BY user_id) AS r FROM events", f"SELECT event_id, count(value) {UP} AS c, round(sum(value) {UP}, 4) AS s, round(sum(value) {UP}, 2) AS a, min(value) {UP} AS n, max(value) {UP} AS m, row_number() {W} AS r FROM {EV}")
q("analytic_before_where", "SELECT event_id, lag(value) OVER (PARTITION BY user_id) AS l, acc_count(*) OVER (PARTITION BY user_id) AS c FROM events WHERE value > 50", f"SELECT event_id, l, c FROM (SELECT event_id, value, lag(value) {W} AS l, count(*) {UP} AS c FROM {EV}) WHERE value > 50")
q("analytic_when", "SELECT event_id, acc_sum(value) OVER (PARTITION BY user_id WHEN event_type = 'click') AS s, lag(event_id, 1, -1) OVER (PARTITION BY user_id WHEN value > 20) AS l FROM events", f"SELECT event_id, sum(CASE WHEN event_type = 'click' THEN value END) {UP} AS s, coalesce(last_value(CASE WHEN value > 20 THEN event_id END IGNORE NULLS) {BEFORE}, -1) AS l FROM {EV}")
q("analytic_lag_offsets", "SELECT event_id, lag(value, 3, 0) OVER (PARTITION BY event_type) AS a, lag(event_id, 2) OVER (PARTITION BY event_type) AS b FROM events", f"SELECT event_id, lag(value, 3, 0) OVER (PARTITION BY event_type ORDER BY t, event_id) AS a, lag(event_id, 2) OVER (PARTITION BY event_type ORDER BY t, event_id) AS b FROM {EV}")
q("analytic_changes", "SELECT event_id, had_changed(event_type) OVER (PARTITION BY user_id) AS h, changed_col(event_type) OVER (PARTITION BY user_id) AS c FROM events", f"SELECT event_id, p IS NULL OR p <> event_type AS h, CASE WHEN p IS NULL OR p <> event_type THEN event_type END AS c FROM (SELECT *, lag(event_type) {W} AS p FROM {EV})")
q("analytic_changed_cols", "SELECT event_id, changed_cols('x_', true, event_type) FROM events", f"SELECT event_id, CASE WHEN p IS NULL OR p <> event_type THEN event_type END AS x_event_type FROM (SELECT *, lag(event_type) OVER (ORDER BY t, event_id) AS p FROM {EV})")
q("analytic_extremes", "SELECT event_id, acc_max_by(event_id, value) OVER (PARTITION BY user_id) AS x, acc_min_by(event_type, value) OVER (PARTITION BY user_id) AS n FROM events", f"SELECT event_id, arg_max(event_id, (value, t, event_id)) {UP} AS x, (SELECT event_type FROM events z WHERE z.event_id = arg_min) AS n FROM (SELECT *, arg_min(event_id, (value, -t, -event_id)) {UP} AS arg_min FROM {EV})")
q("analytic_collect", "SELECT event_id, array_join(acc_collect(event_type) OVER (PARTITION BY user_id)) AS c, array_join(acc_distinct_collect(event_type) OVER (PARTITION BY user_id)) AS d FROM events", f"""SELECT a.event_id, a.c, string_agg(b.event_type, ',' ORDER BY b.t, b.event_id) AS d FROM (SELECT *, string_agg(event_type, ',') {UP} AS c FROM {EV}) a
JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS n FROM {EV}) WHERE n = 1) b ON a.user_id = b.user_id AND (b.t, b.event_id) <= (a.t, a.event_id) GROUP BY a.event_id, a.c""")
q("analytic_hits", "SELECT event_id, last_hit_count() AS n FROM events", f"SELECT event_id, row_number() OVER (ORDER BY t, event_id) - 1 AS n FROM {EV}")
q("analytic_whole_stream", "SELECT event_id, row_number() OVER () AS r, acc_count(value) OVER () AS c, round(acc_sum(value) OVER (WHEN event_type = 'view'), 2) AS s, acc_min(value) OVER () AS n, acc_max(value) OVER (WHEN user_id > 20) AS m, lag(event_id) OVER () AS l, had_changed(event_type) OVER () AS h, changed_col(user_id) OVER () AS u FROM events WHERE value > 5", f"SELECT event_id, r, c, s, n, m, l, p IS NULL OR p <> event_type AS h, CASE WHEN q IS NULL OR q <> user_id THEN user_id END AS u FROM (SELECT *, row_number() OVER (ORDER BY t, event_id) AS r, count(value) OVER (ORDER BY t, event_id) AS c, round(sum(CASE WHEN event_type = 'view' THEN value END) OVER (ORDER BY t, event_id), 2) AS s, min(value) OVER (ORDER BY t, event_id) AS n, max(CASE WHEN user_id > 20 THEN value END) OVER (ORDER BY t, event_id) AS m, lag(event_id) OVER (ORDER BY t, event_id) AS l, lag(event_type) OVER (ORDER BY t, event_id) AS p, lag(user_id) OVER (ORDER BY t, event_id) AS q FROM {EV}) WHERE value > 5")
q("pattern_match", "SELECT event_id, sequence_match(36000000, event_type = 'view', event_type = 'click', event_type = 'purchase') OVER (PARTITION BY user_id) AS hit, sequence_count(0, event_type = 'view', event_type = 'click') OVER (PARTITION BY user_id) AS n FROM events", f"""WITH RECURSIVE o AS (SELECT *, row_number() {W} AS n, event_type = 'view' AS a, event_type = 'click' AS b, event_type = 'purchase' AS c FROM {EV}),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS n, -1::BIGINT AS event_id, 0 AS s, 0::BIGINT AS st, false AS hit, 0 AS s2, 0::BIGINT AS done FROM o
UNION ALL
SELECT user_id, n, event_id, s1 % 3, CASE WHEN s1 = 1 AND a AND (s0 <> 1 OR NOT b) THEN t ELSE st END, s1 = 3,
CASE WHEN s2 = 0 THEN CAST(a AS INTEGER) WHEN b THEN 0 ELSE 1 END, CASE WHEN s2 = 1 AND b THEN done + 1 ELSE done END
FROM (SELECT *, CASE s0 WHEN 0 THEN CAST(a AS INTEGER) WHEN 1 THEN CASE WHEN b THEN 2 ELSE 1 END ELSE CASE WHEN c THEN 3 WHEN a THEN 1 ELSE 2 END END AS s1
FROM (SELECT o.user_id, o.n, o.event_id, o.t, o.a, o.b, o.c, r.st, r.s2, r.done, CASE WHEN r.s > 0 AND o.t - r.st > 36000000 THEN 0 ELSE r.s END AS s0 FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)))
SELECT event_id, hit, done AS n FROM r WHERE n > 0""")

# -- joins ------------------------------------------------------------------------
q("lookup_join", "SELECT o.o_orderkey, c.c_name, n.n_name FROM orders AS o INNER JOIN customer AS c ON o.o_custkey = c.c_custkey LEFT JOIN nation AS n ON c.c_nationkey = n.n_nationkey", "SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey")
q("lookup_join_first_match", "SELECT c.event_id, t.s_suppkey FROM events AS c LEFT JOIN supplier AS t ON c.user_id = t.s_nationkey", "SELECT c.event_id, t.s_suppkey FROM events c LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY s_nationkey) t ON c.user_id = t.s_nationkey")
_PAIR = f"(SELECT *, t - t % {30 * MINUTE} AS w FROM {EV})"
for _kind, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):
    q(f"window_join_{_kind}", f"SELECT a.event_id AS x, b.event_id AS y FROM events AS a {_kind.upper()} JOIN events AS b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' GROUP BY TUMBLINGWINDOW(mi, 30)", f"SELECT a.event_id AS x, b.event_id AS y FROM {_PAIR} a {_sql} {_PAIR} b ON a.w = b.w AND a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click'")
q("window_join_cross", "SELECT count(*) AS c, window_start() AS ws FROM events AS a CROSS JOIN events AS b GROUP BY TUMBLINGWINDOW(mi, 10)", f"SELECT count(*) * count(*) AS c, t - t % {10 * MINUTE} AS ws FROM {EV} GROUP BY t - t % {10 * MINUTE}")
q("window_join_grouped", "SELECT a.event_type, count(*) AS c, sum(b.value) AS s FROM events AS a INNER JOIN events AS b ON a.event_type = b.event_type GROUP BY a.event_type, TUMBLINGWINDOW(hh, 1)", f"SELECT a.event_type, count(*) AS c, sum(b.value) AS s FROM {EV} a JOIN {EV} b ON a.event_type = b.event_type AND a.t - a.t % {HOUR} = b.t - b.t % {HOUR} GROUP BY a.event_type, a.t - a.t % {HOUR}")
q("asof_join", "SELECT a.event_id AS x, b.event_id AS y FROM events AS a ASOF JOIN events AS b ON a.user_id = b.user_id", f"SELECT a.event_id AS x, (SELECT arg_max(b.event_id, (b.t, b.event_id)) FROM {EV} b WHERE b.user_id = a.user_id AND b.t <= a.t) AS y FROM {EV} a")


# -- functions --------------------------------------------------------------------
q("fn_math_rounding", "SELECT event_id, abs(value - 50) AS a, ceil(value) AS c, ceiling(value) AS c2, floor(value) AS f, round(value) AS r, sign(value - 50) AS s, mod(event_id, 7) AS m, trunc(value, 1) AS t, trunc(value) AS t0 FROM events", "SELECT event_id, abs(value - 50) AS a, ceil(value) AS c, ceil(value) AS c2, floor(value) AS f, round(value) AS r, CAST(sign(value - 50) AS BIGINT) AS s, event_id % 7 AS m, floor(value * 10) / 10 AS t, CAST(floor(value) AS BIGINT) AS t0 FROM events")
q("fn_math_powers", "SELECT event_id, sqrt(value + 1) AS s, power(value, 2) AS p, pow(user_id, 2) AS p2, exp(value / 100) AS e, ln(value + 1) AS n, log(value + 1) AS l, log(2, value + 1) AS lb, log2(value + 1) AS l2, log10(value + 1) AS l10 FROM events", "SELECT event_id, sqrt(value + 1) AS s, pow(value, 2) AS p, CAST(user_id * user_id AS BIGINT) AS p2, exp(value / 100) AS e, ln(value + 1) AS n, log10(value + 1) AS l, ln(value + 1) / ln(2) AS lb, log2(value + 1) AS l2, log10(value + 1) AS l10 FROM events")
q("fn_math_trigonometry", "SELECT event_id, sin(value) AS s, cos(value) AS c, tan(value) AS t, asin(value / 1000) AS a, acos(value / 1000) AS b, atan(value) AS d, atan2(value, 3) AS e, sinh(value / 100) AS f, cosh(value / 100) AS g, tanh(value / 100) AS h, cot(value + 0.5) AS i, radians(value) AS j, degrees(value) AS k, pi() AS p FROM events", "SELECT event_id, sin(value) AS s, cos(value) AS c, tan(value) AS t, asin(value / 1000) AS a, acos(value / 1000) AS b, atan(value) AS d, atan2(value, 3) AS e, sinh(value / 100) AS f, cosh(value / 100) AS g, tanh(value / 100) AS h, cot(value + 0.5) AS i, radians(value) AS j, degrees(value) AS k, pi() AS p FROM events")
q("fn_math_bits", "SELECT event_id, bitand(event_id, 12) AS a, bitor(event_id, 3) AS o, bitxor(event_id, 5) AS x, bitnot(event_id) AS n, conv(event_id, 10, 16) AS h, hex2dec('0xff') AS d, dec2hex(event_id) AS e FROM events", "SELECT event_id, event_id & 12 AS a, event_id | 3 AS o, xor(event_id, 5) AS x, ~event_id AS n, lower(to_hex(event_id)) AS h, 255::BIGINT AS d, '0x' || lower(to_hex(event_id)) AS e FROM events")
q("fn_string_basic", "SELECT c_custkey, concat(c_name, '/', c_nationkey) AS c, lower(c_name) AS l, upper(c_name) AS u, length(c_name) AS n, reverse(c_name) AS r, replace(c_name, 'Customer', 'C') AS p, substr(c_name, 3, 4) AS s, substring(c_name, 0) AS s0, numbytes(c_name) AS b, indexof(c_name, '#') AS i, startswith(c_name, 'Cust') AS w, endswith(c_name, '1') AS e FROM customer", "SELECT c_custkey, c_name || '/' || c_nationkey AS c, lower(c_name) AS l, upper(c_name) AS u, length(c_name) AS n, reverse(c_name) AS r, replace(c_name, 'Customer', 'C') AS p, substr(c_name, 3, 4) AS s, c_name AS s0, strlen(c_name) AS b, strpos(c_name, '#') - 1 AS i, starts_with(c_name, 'Cust') AS w, ends_with(c_name, '1') AS e FROM customer")
q("fn_string_padding", "SELECT event_id, lpad(event_type, 10, '*') AS a, rpad(event_type, 3, '*') AS b, lpad(event_type, 2) AS c, trim(concat('  ', event_type, ' ')) AS d, ltrim(concat('  ', event_type)) AS e, rtrim(concat(event_type, '  ')) AS f, format(value, 1) AS g, split_value(event_type, 'i', 0) AS h, array_join(split(event_type, 'i'), '+') AS k FROM events", "SELECT event_id, lpad(event_type, 10, '*') AS a, event_type AS b, '  ' || event_type AS c, event_type AS d, event_type AS e, event_type AS f, printf('%.1f', value) AS g, split_part(event_type, 'i', 1) AS h, array_to_string(string_split(event_type, 'i'), '+') AS k FROM events")
q("fn_regexp", "SELECT doc_id, regexp_matches(text, '[A-Z]{4,}') AS m, regexp_substr(text, '([a-z]+)\\.') AS s, regexp_replace(text, '[aeiou]', '_') AS r FROM documents", "SELECT doc_id, regexp_matches(text, '[A-Z]{4,}') AS m, nullif(regexp_extract(text, '([a-z]+)\\.', 1), '') AS s, regexp_replace(text, '[aeiou]', '_', 'g') AS r FROM documents")
q("fn_hashes", "SELECT doc_id, md5(text) AS m, sha1(text) AS s1, sha256(text) AS s2, base64_encode(source) AS b, base64_decode(base64_encode(source)) AS d, encode(source, 'base64') AS e, decode(encode(source, 'base64'), 'base64') AS f, chr(65 + doc_id % 26) AS c FROM documents", "SELECT doc_id, md5(text) AS m, sha1(text) AS s1, sha256(text) AS s2, to_base64(encode(source)) AS b, source AS d, to_base64(encode(source)) AS e, source AS f, chr(CAST(65 + doc_id % 26 AS INTEGER)) AS c FROM documents")
q("fn_hashes_wide", "SELECT doc_id, length(sha384(text)) AS a, length(sha512(text)) AS b, crc32('') AS c, crc32('123456789') AS d FROM documents", "SELECT doc_id, 96::BIGINT AS a, 128::BIGINT AS b, '0' AS c, 'cbf43926' AS d FROM documents")
q("fn_compression", "SELECT doc_id, decompress(compress(text, 'gzip'), 'gzip') AS g, decompress(compress(text, 'zlib'), 'zlib') AS z, decompress(compress(text, 'zstd'), 'zstd') AS s FROM documents", "SELECT doc_id, text AS g, text AS z, text AS s FROM documents")
q("fn_datetime_parts", "SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, day_of_month(ts) AS d2, hour(ts) AS h, minute(ts) AS i, second(ts) AS s, day_of_week(ts) AS w, day_of_year(ts) AS j, day_name(ts) AS dn, month_name(ts) AS mn, last_day(ts) AS ld, to_seconds(ts) AS es FROM events", "SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, day(ts) AS d2, hour(ts) AS h, minute(ts) AS i, second(ts) AS s, dayofweek(ts) + 1 AS w, dayofyear(ts) AS j, dayname(ts) AS dn, monthname(ts) AS mn, strftime(last_day(ts), '%Y-%m-%d') AS ld, epoch_us(ts) // 1000000 AS es FROM events")
q("fn_datetime_format", "SELECT event_id, format_date(ts, 'yyyy-MM-dd') AS a, format_time(ts, 'HH:mm:ss') AS b, from_unix_time(ts) AS c, convert_tz(ts, 'Asia/Tokyo') AS d, date_parse('2024-03-01', '%Y-%m-%d') AS e, from_days(366) AS f, microsecond(ts) AS g FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS a, strftime(ts, '%H:%M:%S') AS b, strftime(ts, '%Y-%m-%d %H:%M:%S') AS c, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS d, 1709251200000 AS e, '0001-01-01' AS f, (epoch_us(ts) // 1000 % 1000) * 1000 AS g FROM events")
q("fn_datetime_arithmetic", "SELECT event_id, date_add('hh', 5, ts) AS a, date_diff('hh', ts, date_add('dd', 2, ts)) AS b, date_diff(date_add('hh', 49, ts), ts) AS c, date_calc(ts, '1h30m') AS d, date_calc(ts, '-500ms') AS e FROM events", f"SELECT event_id, t + 18000000 AS a, 48::BIGINT AS b, -2::BIGINT AS c, t + 5400000 AS d, t - 500 AS e FROM {EV}")
q("fn_arrays_numbers", "SELECT vec_id, array_max(embedding) AS a, array_min(embedding) AS b, round(array_avg(embedding), 6) AS c FROM embeddings", "SELECT vec_id, list_max(embedding) AS a, list_min(embedding) AS b, round(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS c FROM embeddings")
q("fn_objects", "SELECT event_id, to_json(array_sort(keys({a: 1, b: event_id}))) AS a, to_json(values({a: event_id, b: 2})) AS b, to_json(object(['x', 'y'], [event_id, 2])) AS c, to_json(object_pick({a: 1, b: event_id}, 'b')) AS d, to_json(erase({a: 1, b: event_id}, 'a')) AS e, to_json(object_concat({a: 1}, {a: event_id})) AS f, to_json(object_construct('k', event_id, 'z', null)) AS g, to_json(obj_to_kvpair_array({a: event_id})) AS h, {a: event_id}['a'] AS i FROM events", "SELECT event_id, '[\"a\",\"b\"]' AS a, '[' || event_id || ',2]' AS b, '{\"x\":' || event_id || ',\"y\":2}' AS c, '{\"b\":' || event_id || '}' AS d, '{\"b\":' || event_id || '}' AS e, '{\"a\":' || event_id || '}' AS f, '{\"k\":' || event_id || '}' AS g, '[{\"key\":\"a\",\"value\":' || event_id || '}]' AS h, event_id AS i FROM events")
q("fn_json", "SELECT event_id, cast(json_path_query(props, '$.k'), 'bigint') AS a, json_path_exists(props, '$.k') AS b, json_path_exists(props, '$.z') AS c, cast(parse_json(props).k, 'bigint') AS d, cast(json_path_query_first('{\"a\":[{\"b\":1},{\"b\":2}]}', '$.a[*].b'), 'bigint') AS e, to_json(json_path_query(props, '/k')) AS f FROM events", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS a, true AS b, false AS c, CAST(props->>'$.k' AS BIGINT) AS d, 1::BIGINT AS e, props->>'$.k' AS f FROM events")
q("fn_conversion", "SELECT event_id, cast(value, 'bigint') AS a, cast(event_id, 'string') AS b, cast('1.5', 'float') AS c, cast('true', 'boolean') AS d, isnull(value) AS e, isnumeric('x1') AS f, isnan(value) AS g, coalesce(null, event_type) AS h, nvl(null, user_id) AS i, delay(1, user_id) AS j FROM events", "SELECT event_id, CAST(trunc(value) AS BIGINT) AS a, CAST(event_id AS VARCHAR) AS b, 1.5::DOUBLE AS c, true AS d, false AS e, false AS f, false AS g, event_type AS h, user_id AS i, user_id AS j FROM events")
q("fn_system", "SELECT event_id, event_time() AS t, rule_id() AS r, get_keyed_state('k', 'bigint', 7) AS k FROM events", f"SELECT event_id, t, '' AS r, 7::BIGINT AS k FROM {EV}")
q("fn_volatile", "SELECT event_id, rand() < 1 AS a, length(uuid()) AS b, length(newuuid()) AS c, tstamp() > 0 AS d, length(now()) AS e, length(current_date()) AS f, length(current_time()) AS g, length(array_shuffle([1, 2])) AS h FROM events", "SELECT event_id, true AS a, 36::BIGINT AS b, 36::BIGINT AS c, true AS d, 19::BIGINT AS e, 10::BIGINT AS f, 8::BIGINT AS g, 2::BIGINT AS h FROM events")

_A, _B = "[event_id % 4, user_id % 4, 2, event_id % 4]", "[event_id % 5, 2]"
_JSON = "CAST(to_json({}) AS VARCHAR)"
q("fn_arrays_search", f"SELECT event_id, array_position({_A}, 2) AS a, array_last_position({_A}, event_id % 6) AS b, to_json(array_positions({_A}, user_id % 4)) AS c, array_contains({_A}, event_id % 6) AS d, array_length({_A}) AS e, cardinality({_B}) AS f, array_cardinality({_A}) AS f2, cardinality(null) AS f3, element_at({_A}, -1) AS g, array_contains_any({_A}, {_B}) AS h FROM events",
  f"SELECT event_id, list_position(a, 2) - 1 AS a, CASE WHEN list_contains(a, event_id % 6) THEN 4 - list_position(list_reverse(a), event_id % 6) ELSE -1 END AS b, {_JSON.format('list_filter(range(0, 4), lambda i: a[i + 1] = user_id % 4)')} AS c, list_contains(a, event_id % 6) AS d, 4::BIGINT AS e, 2::BIGINT AS f, 4::BIGINT AS f2, 0::BIGINT AS f3, a[4] AS g, list_has_any(a, b) AS h FROM (SELECT *, {_A} AS a, {_B} AS b FROM events)")
_SETS = {"a": ("array_slice({a}, 2, 3)", "a[2:3]"), "b": ("array_concat({a}, {b})", "a || b"), "c": ("array_distinct({a})", "list_filter(a, lambda x, i: list_position(a, x) = i)"), "c2": ("deduplicate({a})", "list_filter(a, lambda x, i: list_position(a, x) = i)"), "d": ("array_remove({a}, 2)", "list_filter(a, lambda x: x <> 2)"),
    "e": ("array_intersect({a}, {b})", "list_filter(a, lambda x, i: list_position(a, x) = i AND list_contains(b, x))"), "f": ("array_union({a}, {b})", "list_filter(a || b, lambda x, i: list_position(a || b, x) = i)"), "g": ("array_except({a}, {b})", "list_filter(a, lambda x: NOT list_contains(b, x))"),
    "h": ("array_flatten([{a}, {b}])", "a || b"), "i": ("array_sort({a})", "list_sort(a)"), "j": ("repeat(event_id, 3)", "[event_id, event_id, event_id]"), "k": ("sequence(user_id, user_id + event_id % 4, 1)", "range(user_id, user_id + event_id % 4 + 1)"), "l": ("array_map('abs', [-user_id, event_id % 3])", "[user_id, event_id % 3]"), "n": ("array_create(user_id, event_id)", "[user_id, event_id]")}
q("fn_arrays_shape", "SELECT event_id, " + ", ".join(f"to_json({e.format(a=_A, b=_B)}) AS {n}" for n, (e, _) in _SETS.items()) + ", array_join([event_type, 'y'], '-') AS m FROM events", "SELECT event_id, " + ", ".join(f"{_JSON.format(d)} AS {n}" for n, (_, d) in _SETS.items()) + f", event_type || '-y' AS m FROM (SELECT *, {_A} AS a, {_B} AS b FROM events)")
q("fn_objects_named", "SELECT event_id, to_json(zip([[event_type, 'v'], ['z', event_type]])) AS a, to_json(items({a: event_type})) AS b, to_json(object_erase({a: user_id, b: event_id}, 'a')) AS c, to_json(object_to_kvpair_array({a: event_id})) AS d, tojson([event_id, user_id]) AS e, cast(parsejson(props).k, 'bigint') AS f, cast(json_parse(props).k, 'bigint') AS g, to_json(json_map('k', event_id, 'z', user_id)) AS h, {a: user_id}->a AS i FROM events",
  """SELECT event_id, '{"' || event_type || '":"v","z":"' || event_type || '"}' AS a, '[["a","' || event_type || '"]]' AS b, '{"b":' || event_id || '}' AS c, '[{"key":"a","value":' || event_id || '}]' AS d, '[' || event_id || ',' || user_id || ']' AS e, CAST(props->>'$.k' AS BIGINT) AS f, CAST(props->>'$.k' AS BIGINT) AS g, '{"k":' || event_id || ',"z":' || user_id || '}' AS h, user_id AS i FROM events""")
_LAGS = "lag(embedding) OVER (PARTITION BY label)", "lag(embedding, 2) OVER (PARTITION BY label)"
_VECTORS = "(SELECT *, lag(e) OVER w AS p, lag(e, 2) OVER w AS q FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) WINDOW w AS (PARTITION BY label ORDER BY vec_id))"
q("fn_vectors", f"SELECT vec_id, round(cosine_similarity(embedding, {_LAGS[0]}), 5) AS c, round(vector_l2(embedding, {_LAGS[0]}), 5) AS l, round(vector_dot(embedding, {_LAGS[0]}), 4) AS d FROM embeddings", f"SELECT vec_id, round(list_cosine_similarity(e, p), 5) AS c, round(list_distance(e, p), 5) AS l, round(list_dot_product(e, p), 4) AS d FROM {_VECTORS}")
q("fn_vector_match", f"SELECT vec_id, vector_match(embedding, [{_LAGS[0]}, {_LAGS[1]}], 1)[0].index AS i, size FROM embeddings".replace(", size", ""), f"SELECT vec_id, CASE WHEN p IS NULL THEN NULL WHEN q IS NULL OR list_cosine_similarity(e, p) >= list_cosine_similarity(e, q) THEN 0 ELSE 1 END AS i FROM {_VECTORS}")
q("fn_format_locales", "SELECT event_id, format(value * 12345, 2, 'de_DE') AS de, format(-value * 12345, 1, 'fr_FR') AS fr, format(value * 12345, 2, 'es_ES') AS es, format(value * 12345, 0, 'en_US') AS en, format(value * 12345, 3) AS p FROM events", "SELECT event_id, translate(format('{:,.2f}', value * 12345), ',.', '.,') AS de, translate(format('{:,.1f}', -value * 12345), ',.', '.,') AS fr, format('{:,.2f}', value * 12345) AS es, format('{:,.0f}', value * 12345) AS en, format('{:.3f}', value * 12345) AS p FROM events")
q("fn_dates_of_columns", "SELECT event_id, date_parse(format_date(ts, 'yyyy-MM-dd'), '%Y-%m-%d') AS a, from_days(event_id % 700 + 730000) AS b, now() > format_date(ts, 'yyyy-MM-dd HH:mm:ss') AS c, cur_date() = current_date() AS d, cur_time() = current_time() AS e, local_time() = current_time() AS f, local_timestamp() = current_timestamp() AS g, tstamp() > ts AS h FROM events", f"SELECT event_id, t - t % {24 * HOUR} AS a, strftime(DATE '0001-01-01' + CAST(event_id % 700 + 730000 - 366 AS INTEGER), '%Y-%m-%d') AS b, true AS c, true AS d, true AS e, true AS f, true AS g, true AS h FROM {EV}")
q("fn_values_of_columns", """SELECT event_id, hex2dec(dec2hex(event_id)) AS a, isnumeric(event_type) AS b, isnumeric(cast(event_id, 'string')) AS c, isnan(value) AS d, cast(json_path_query_first(concat('{"a":[', user_id, ',', event_id, ']}'), '$.a[*]'), 'bigint') AS e, json_path_exists(concat('{"', event_type, '":1}'), '$.click') AS f, get_keyed_state(event_type, 'bigint', user_id) AS g, rule_start() > ts AS h FROM events""", "SELECT event_id, event_id AS a, false AS b, true AS c, isnan(value) AS d, user_id AS e, event_type = 'click' AS f, user_id AS g, true AS h FROM events")
q("fn_regexp_named", "SELECT doc_id, regexp_substring(text, '([a-z]+)\\.') AS s FROM documents", "SELECT doc_id, nullif(regexp_extract(text, '([a-z]+)\\.', 1), '') AS s FROM documents")
# DuckDB has no functions for these; the tests compare them with Python's
q("fn_hashes_of_texts", "SELECT doc_id, sha384(text) AS a, sha512(text) AS b, crc32(text) AS c, compress(text, 'zlib') AS z FROM documents", None)

# -- operators at their edges -----------------------------------------------------
q("select_star", "SELECT * FROM labels", "SELECT * FROM labels")
q("select_qualified_star", "SELECT c.*, o.o_orderkey FROM orders AS o INNER JOIN customer AS c ON o.o_custkey = c.c_custkey", "SELECT c.*, o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
q("predicates_not_like", "SELECT event_id, event_type NOT LIKE '%ic%' AS a, NOT (event_type LIKE 'v_ew') AS b, value BETWEEN user_id AND event_id AS c, event_type NOT IN ('view', 'click') AS d, value > 50 OR user_id < 10 AND NOT (event_type = 'view') AS e, value IS NOT NULL AS f FROM events", "SELECT event_id, event_type NOT LIKE '%ic%' AS a, event_type NOT LIKE 'v_ew' AS b, value BETWEEN user_id AND event_id AS c, event_type NOT IN ('view', 'click') AS d, value > 50 OR user_id < 10 AND NOT (event_type = 'view') AS e, value IS NOT NULL AS f FROM events")
q("star_beside_aggregates", "SELECT *, count(*) AS c FROM labels GROUP BY quality, TUMBLINGWINDOW(dd, 1)", "SELECT arg_min(doc_id, doc_id) AS doc_id, quality, arg_min(toxic, doc_id) AS toxic, count(*) AS c FROM labels GROUP BY quality")
q("sliding_extremes", "SELECT window_start() AS ws, count(*) AS c, min(value) AS n, max(event_type) AS m, round(avg(user_id), 6) AS a FROM events WHERE value > 5 GROUP BY SLIDINGWINDOW(mi, 45) FILTER (WHERE user_id > 10) OVER (WHEN event_type = 'purchase') HAVING count(*) > 2", f"WITH s AS (SELECT * FROM {EV} WHERE value > 5 AND user_id > 10) SELECT a.t - {45 * MINUTE} AS ws, count(*) AS c, min(b.value) AS n, max(b.event_type) AS m, round(avg(b.user_id), 6) AS a FROM s a JOIN s b ON b.t BETWEEN a.t - {45 * MINUTE} AND a.t AND (b.t, b.event_id) <= (a.t, a.event_id) WHERE a.event_type = 'purchase' GROUP BY a.t, a.event_id HAVING count(*) > 2")
q("analytic_lag_when_offsets", "SELECT event_id, lag(event_id, 3, -1) OVER (PARTITION BY user_id WHEN value > 40) AS a, lag(value, 2) OVER (PARTITION BY event_type WHEN user_id > 20) AS b FROM events", f"SELECT e.event_id, coalesce((SELECT x.event_id FROM {EV} x WHERE x.user_id = e.user_id AND x.value > 40 AND (x.t, x.event_id) < (e.t, e.event_id) ORDER BY x.t DESC, x.event_id DESC LIMIT 1 OFFSET 2), -1) AS a, (SELECT x.value FROM {EV} x WHERE x.event_type = e.event_type AND x.user_id > 20 AND (x.t, x.event_id) < (e.t, e.event_id) ORDER BY x.t DESC, x.event_id DESC LIMIT 1 OFFSET 1) AS b FROM {EV} e")
q("percentile_cont", "SELECT event_type, percentile_cont(value, 0.25) AS p, percentile_disc(value, 0.75) AS d, median(value) AS m FROM events GROUP BY event_type, TUMBLINGWINDOW(dd, 2)", f"SELECT event_type, quantile_cont(value, 0.25) AS p, quantile_disc(value, 0.75) AS d, median(value) AS m FROM {EV} GROUP BY event_type, t - t % {48 * HOUR}")
q("lookup_without_condition", "SELECT e.event_id, t.s_name FROM events AS e INNER JOIN supplier AS t", "SELECT e.event_id, (SELECT s_name FROM supplier ORDER BY s_suppkey LIMIT 1) AS s_name FROM events e")
q("lookup_theta", "SELECT e.event_id, t.s_suppkey FROM events AS e INNER JOIN supplier AS t ON t.s_suppkey > e.user_id AND t.s_acctbal > 0", "SELECT event_id, s_suppkey FROM (SELECT event_id, (SELECT min(s_suppkey) FROM supplier WHERE s_suppkey > user_id AND s_acctbal > 0) AS s_suppkey FROM events) WHERE s_suppkey IS NOT NULL")
q("lookup_theta_left", "SELECT e.event_id, t.s_suppkey FROM events AS e LEFT JOIN supplier AS t ON t.s_nationkey = e.user_id AND t.s_acctbal > e.value", "SELECT event_id, (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = user_id AND s_acctbal > value) AS s_suppkey FROM events")
q("lookup_full", "SELECT e.event_id, t.s_name FROM events AS e FULL JOIN supplier AS t ON e.user_id = t.s_suppkey", "SELECT e.event_id, t.s_name FROM events e JOIN supplier t ON e.user_id = t.s_suppkey")
q("lookup_conflicting_names", "SELECT event_id, value, t.value AS other FROM events AS e INNER JOIN last_value AS t ON e.event_id = t.event_id", "SELECT event_id, value, -value AS other FROM events")
q("window_join_with_table", "SELECT a.event_id AS x, s.s_name AS n FROM events AS a INNER JOIN events AS b ON a.event_id = b.event_id INNER JOIN supplier AS s ON a.user_id = s.s_suppkey GROUP BY TUMBLINGWINDOW(mi, 30)", "SELECT e.event_id AS x, s.s_name AS n FROM events e JOIN supplier s ON e.user_id = s.s_suppkey")
q("changes_ignore_when", "SELECT event_id, had_changed(event_type) OVER (PARTITION BY user_id WHEN value > 50) AS h, had_changed(event_type) OVER (PARTITION BY user_id WHEN value > 50) AS same FROM events", f"SELECT event_id, coalesce(lag(event_type) {W} <> event_type, true) AS h, coalesce(lag(event_type) {W} <> event_type, true) AS same FROM {EV}")
q("analytic_distinct_and_times", "SELECT event_id, array_join(distinct_acc(event_type) OVER (PARTITION BY user_id)) AS d, last_hit_time() AS p FROM events", f"SELECT a.event_id, string_agg(b.event_type, ',' ORDER BY b.t, b.event_id) AS d, any_value(a.p) AS p FROM (SELECT *, coalesce(lag(t) OVER (ORDER BY t, event_id), 0) AS p FROM {EV}) a JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS n FROM {EV}) WHERE n = 1) b ON a.user_id = b.user_id AND (b.t, b.event_id) <= (a.t, a.event_id) GROUP BY a.event_id")
q("pattern_ties_and_null_times", "SELECT event_id, sequence_count(0, event_type = 'view', event_type = 'click') OVER (PARTITION BY user_id) AS n, sequence_match(0, event_type = 'view', event_type = 'click') OVER (PARTITION BY user_id) AS hit FROM coarse", """WITH RECURSIVE o AS (SELECT event_id, user_id, event_type = 'view' AS a, event_type = 'click' AS b, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 5 > 0 THEN date_trunc('hour', ts) END NULLS FIRST, event_id) AS n FROM events),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS n, -1::BIGINT AS event_id, 0 AS s, 0::BIGINT AS done, false AS hit FROM o
UNION ALL SELECT o.user_id, o.n, o.event_id, CASE WHEN s = 0 THEN CAST(a AS INTEGER) WHEN b THEN 0 ELSE 1 END, CASE WHEN s = 1 AND b THEN done + 1 ELSE done END, s = 1 AND b FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT event_id, done AS n, hit FROM r WHERE n > 0""")


# -- further operators ------------------------------------------------------------
q("count_window_sampled", "SELECT count(*) AS c, min(event_id) AS e, sum(value) AS s FROM events GROUP BY COUNTWINDOW(5, 20)", f"SELECT count(*) AS c, min(event_id) AS e, sum(value) AS s FROM (SELECT *, row_number() OVER (ORDER BY t, event_id) - 1 AS i FROM {EV}) WHERE i % 20 >= 15 GROUP BY i // 20 HAVING count(*) = 5")
q("sliding_with_delay", "SELECT window_start() AS ws, count(*) AS c FROM events GROUP BY SLIDINGWINDOW(mi, 10, 5) OVER (WHEN event_type = 'purchase')", f"SELECT a.t - {10 * MINUTE} AS ws, count(*) AS c FROM {EV} a JOIN {EV} b ON b.t BETWEEN a.t - {10 * MINUTE} AND a.t + {5 * MINUTE} WHERE a.event_type = 'purchase' GROUP BY a.t, a.event_id")
q("left_asof_join", "SELECT a.event_id AS x, b.value AS y FROM events AS a LEFT ASOF JOIN clicks_at AS b ON a.user_id = b.user_id", f"SELECT a.event_id AS x, (SELECT arg_max(b.value, (b.t, b.event_id)) FROM {EV} b WHERE b.event_type = 'click' AND b.user_id = a.user_id AND b.t <= a.t) AS y FROM {EV} a")
q("merge_and_extract", "SELECT user_id, window_start() AS ws, to_json(merge_agg({a: event_type, b: value})) AS m FROM events GROUP BY user_id, TUMBLINGWINDOW(dd, 1)", f"""SELECT user_id, t - t % {24 * HOUR} AS ws, '{{"a":"' || arg_max(event_type, (t, event_id)) || '","b":' || CAST(arg_max(value, (t, event_id)) AS VARCHAR) || '}}' AS m FROM {EV} GROUP BY user_id, t - t % {24 * HOUR}""")
q("extract_object", "SELECT event_id, extract({u: user_id, k: event_type}) FROM events", "SELECT event_id, user_id AS u, event_type AS k FROM events")
q("acc_map", "SELECT event_id, array_join(array_sort(keys(kvpair_array_to_obj(acc_map_agg(event_type, value) OVER (PARTITION BY user_id))))) AS k, element_at(kvpair_array_to_obj(acc_map_agg(event_type, value) OVER (PARTITION BY user_id)), event_type) AS v FROM events", f"SELECT a.event_id, string_agg(DISTINCT b.event_type, ',' ORDER BY b.event_type) AS k, a.value AS v FROM {EV} a JOIN {EV} b ON a.user_id = b.user_id AND (b.t, b.event_id) <= (a.t, a.event_id) GROUP BY a.event_id, a.value")
q("union_missing_columns", "SELECT event_id AS id, value FROM events UNION ALL SELECT event_id AS id, event_type FROM events", "SELECT event_id AS id, value, NULL AS event_type FROM events UNION ALL SELECT event_id, NULL, event_type FROM events")
q("event_time_in_groups", "SELECT event_type, max(hour(ts)) AS h, count(*) AS c FROM events WHERE day_name(ts) = 'Monday' GROUP BY event_type, TUMBLINGWINDOW(dd, 1)", f"SELECT event_type, max(hour(ts)) AS h, count(*) AS c FROM {EV} WHERE dayname(ts) = 'Monday' GROUP BY event_type, t - t % {24 * HOUR}")
q("pages_urls", "SELECT page_id, split_value(url, '/', 2) AS host, length(url) AS n FROM pages WHERE url LIKE 'https%'", "SELECT page_id, split_part(url, '/', 3) AS host, length(url) AS n FROM pages WHERE url LIKE 'https%'")
q("conversation_turns", "SELECT conv_id, count(*) AS c, array_join(collect(role)) AS r FROM conversations GROUP BY conv_id, TUMBLINGWINDOW(dd, 1)", "SELECT conv_id, count(*) AS c, string_agg(role, ',' ORDER BY turn) AS r FROM conversations GROUP BY conv_id")
q("declared_schema", "SELECT event_id, value, user_id, flag FROM declared WHERE value > 3", "SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(trunc(value) AS BIGINT) AS value, CAST(user_id AS DOUBLE) AS user_id, 'none' AS flag FROM events WHERE trunc(value) > 3")
q("keyed_table", "SELECT c.c_custkey, o.o_orderkey FROM customer AS c INNER JOIN last_order AS o ON c.c_custkey = o.o_custkey", "SELECT o_custkey AS c_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
q("retained_table", "SELECT e.event_id, t.s_name FROM events AS e INNER JOIN last_suppliers AS t ON e.event_id = t.s_suppkey", "SELECT e.event_id, s_name FROM events e JOIN (SELECT * FROM supplier ORDER BY s_suppkey DESC LIMIT 5) ON event_id = s_suppkey")


def _declared(e: Engine) -> None:
    """Sources that a statement needs beside the plain tables."""
    read = lambda t: e.spark.read.parquet(f"{e.catalog.sources.folder}/{t}.parquet")
    e.define("CREATE STREAM declared (event_id TEXT, value BIGINT, user_id FLOAT, flag TEXT DEFAULT 'none')", read("events").select("event_id", "value", "user_id"), order=("event_id",))
    e.define('CREATE TABLE last_order () WITH (KEY="o_custkey")', read("orders"), order=("o_orderkey",))
    e.define('CREATE TABLE last_suppliers () WITH (RETAIN_SIZE="5")', read("supplier"), order=("s_suppkey",))
    e.define("CREATE TABLE last_value ()", read("events").selectExpr("event_id", "-value as value"), order=("event_id",))
    e.define('CREATE STREAM coarse () WITH (TIMESTAMP="ts")', read("events").withColumn("ts", F.expr("if(event_id % 5 > 0, date_trunc('hour', ts), null)")), order=("event_id",))
    e.define('CREATE STREAM clicks_at () WITH (TIMESTAMP="ts")', read("events").where("event_type = 'click'"), order=("event_id",))


DECLARED = ("declared", "last_order", "last_suppliers", "last_value", "coarse", "clicks_at")


#: Computed floating-point columns.  Engines add in different orders and differ in a function's last bit,
#: so both sides round these to nine places.
ROUNDED = {
    "filter_project": "v", "tumbling_by_key": "a s", "tumbling_global": "sp ss md p", "tumbling_top_k": "s", "hopping_by_type": "s", "sliding_counts": "s",
    "count_window": "s", "count_window_overlapping": "s", "count_window_sampled": "s", "aggregates_in_expressions": "w", "lineitem_pricing": "q r d", "analytic_when": "s", "window_join_grouped": "s",
    "fn_math_powers": "s p e n l lb l2 l10", "fn_math_trigonometry": "s c t a b d e f g h i j k p", "arithmetic_integer": "f", "select_star_except_replace": "value", "fn_arrays_numbers": "a b c", "stream_filter": "v", "percentile_cont": "p d m", "stream_count": "s", "stream_top_k": "s",
}


def rounded(name: str, df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in ROUNDED.get(name, "").split()}) if name in ROUNDED else df


def rounded_sql(name: str, sql: str) -> str:
    if name not in ROUNDED:
        return sql
    return f"SELECT * REPLACE ({', '.join(f'round({c}, 9) AS {c}' for c in ROUNDED[name].split())}) FROM ({sql})"


def _run(name: str, text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        if any(n in text for n in DECLARED):
            _declared(e)
        return rounded(name, e.sql(text))

    run.__name__ = name
    return run


def _stream(name: str, text: str):
    """The statement over the events file as a stream, delivered by a file sink and read back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from brookql.streaming.runner import stream

        conf = spark.sparkContext.getConf()
        shared = (conf.get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
        folder = f"{shared}/{name}-{uuid.uuid4().hex}"
        schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
        live = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        e = Engine(spark)
        e.register("events", live, ORDER["events"], timestamp="ts")
        writer = stream(e, text).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return rounded(name, spark.read.parquet(f"{folder}/out"))

    run.__name__ = name
    return run


def graph_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule given as a graph: filter, then pick."""
    from brookql.rules import Rule

    op = lambda kind, **props: {"type": "operator", "nodeType": kind, "props": props}
    graph = {
        "nodes": {"in": {"type": "source", "nodeType": "memory", "props": {"sourceName": "events"}}, "hot": op("filter", expr="value > 30"), "cols": op("pick", fields=["event_id", "value"]), "f": op("function", expr="upper(event_type) AS kind")},
        "topo": {"sources": ["in"], "edges": {"in": ["hot"], "hot": ["cols"], "cols": ["f"]}},
    }
    return Rule("graph", graph=graph).plan(engine(spark, sf_dir)).rows


def _carried(name: str, text: str):
    """The statement over the events file by micro-batches with carried rows, delivered to files and read back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from brookql.streaming.runner import start

        conf = spark.sparkContext.getConf()
        shared = (conf.get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
        folder = f"{shared}/{name}-{uuid.uuid4().hex}"
        schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
        e = Engine(spark)
        e.register("events", spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir), ORDER["events"], timestamp="ts")
        query = start(e, text, f"{folder}/checkpoint", [{"file": {"path": f"{folder}/out", "fileType": "parquet"}}])
        query.awaitTermination()
        return rounded(name, spark.read.parquet(f"{folder}/out"))

    run.__name__ = name
    return run


_RIPE = f"(SELECT * FROM {EV} WHERE t < (SELECT max(t) FROM {EV}))"
#: Windows that the watermark, the newest event time, has not passed stay open.
CARRIED = {
    "stream_session": ("SELECT window_start() AS ws, window_end() AS we, count(*) AS c, max(value) AS m FROM events GROUP BY SESSIONWINDOW(mi, 100000, 6)", f"SELECT * FROM ({Q['session_window'][1].replace(EV, _RIPE)}) WHERE we < (SELECT max(t) FROM {EV})"),
    "stream_sliding": (Q["sliding_when_by_key"][0], Q["sliding_when_by_key"][1].replace("WHERE a", f"WHERE a.t < (SELECT max(t) FROM {EV}) AND a")),
    "stream_count": (Q["count_window"][0], Q["count_window"][1].replace(EV, _RIPE)),
    "stream_state_window": (Q["state_window_two_by_key"][0], Q["state_window_two_by_key"][1].replace(EV, _RIPE) + " HAVING arg_max(event_type, (t, event_id)) = 'purchase'"),
    "stream_join": ("SELECT a.event_id AS x, b.event_id AS y, window_end() AS we FROM events AS a INNER JOIN events AS b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' GROUP BY TUMBLINGWINDOW(mi, 30)", f"SELECT a.event_id AS x, b.event_id AS y, a.w + {30 * MINUTE} AS we FROM {_PAIR} a JOIN {_PAIR} b ON a.w = b.w AND a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' WHERE a.w + {30 * MINUTE} <= (SELECT max(t) FROM {EV})"),
    "stream_top_k": (Q["tumbling_top_k"][0], Q["tumbling_top_k"][1] + f" AND ws + {24 * HOUR} <= (SELECT max(t) FROM {EV})"),
}

STREAMS = {
    "stream_filter": ("SELECT event_id, value * 2 AS v FROM events WHERE event_type = 'view'", "SELECT event_id, value * 2 AS v FROM events WHERE event_type = 'view'"),
    # windows that the watermark has not passed stay open
    "stream_tumbling": ("SELECT event_type, window_start() AS ws, count(*) AS c, max(value) AS m FROM events GROUP BY event_type, TUMBLINGWINDOW(hh, 1)", f"SELECT event_type, t - t % {HOUR} AS ws, count(*) AS c, max(value) AS m FROM {EV} GROUP BY event_type, t - t % {HOUR} HAVING t - t % {HOUR} + {HOUR} <= (SELECT max(t) FROM {EV})"),
    "stream_union": ("SELECT event_id, event_type FROM events WHERE value > 50 UNION SELECT event_id, event_type FROM events WHERE user_id < 20", "SELECT event_id, event_type FROM events WHERE value > 50 OR user_id < 20"),
    "stream_state": ("SELECT event_id, acc_count(value) OVER (PARTITION BY user_id) AS c, lag(event_id) OVER (PARTITION BY user_id) AS l, had_changed(event_type) OVER (PARTITION BY user_id) AS h FROM events", f"SELECT event_id, count(value) {UP} AS c, lag(event_id) {W} AS l, coalesce(lag(event_type) {W} <> event_type, true) AS h FROM {EV}"),
}

QUERIES = {name: _run(name, text) for name, (text, _) in Q.items()}
QUERIES |= {name: _stream(name, text) for name, (text, _) in STREAMS.items()}
QUERIES |= {name: _carried(name, text) for name, (text, _) in CARRIED.items()}
QUERIES["graph_filter"] = graph_filter
ORACLE_SQL = {name: rounded_sql(name, duck) for name, (_, duck) in (Q | STREAMS | CARRIED).items() if duck}
ORACLE_SQL["graph_filter"] = "SELECT event_id, value, upper(event_type) AS kind FROM events WHERE value > 30"
