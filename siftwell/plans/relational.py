"""Registered queries: filters, lists, joins, aggregates and windows on the order and event tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.operators.fetching import scheduled
from siftwell.operators.digest import completed_changes, digest_order, due_deliveries, grouped_changes, mark_digested, pending, run_pairs, run_states
from siftwell.operators.events import due, latest_runs, matching, quorum, ranked, refresh_queue, sections, source_health

AS_OF, ORDERS_AS_OF = dt.datetime(2024, 1, 31), dt.datetime(2001, 8, 2)


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def order_events(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as events."""
    o, c = read(spark, sf, "orders"), read(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("event_type"), F.col("c_mktsegment").alias("organizer"),
        F.col("c_name").alias("title"), F.concat_ws(" ", "c_mktsegment", "o_orderpriority").alias("description"), F.col("o_orderdate").alias("starts_at"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate") + F.expr("interval 2 days")).alias("ends_at"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("score"),
        F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderdate")).alias("registration_opened_at"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderdate")).alias("first_observed_open_at"),
        F.array("c_mktsegment").alias("topics"),
    )


EVENTS_SQL = """ev AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS event_type, c_mktsegment AS organizer, c_name AS title,
  c_mktsegment || ' ' || o_orderpriority AS description, o_orderdate AS starts_at,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 2 DAY END AS ends_at, CAST(floor(o_totalprice / 1000) AS BIGINT) AS score,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate END AS registration_opened_at, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate END AS first_observed_open_at
  FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey)"""
SHOWN = ("id", "status", "title", "score")


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Stream events as runs of sources."""
    e = read(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_name"), F.col("ts").alias("started_at"), F.get_json_object("props", "$.k").cast("long").alias("fetched_count"), F.when(F.col("event_type") == "error", "failed").alias("error"))


RUNS_SQL = "runs AS (SELECT event_id AS id, 'u' || CAST(user_id AS VARCHAR) AS source_name, ts AS started_at, CAST(json_extract_string(props, '$.k') AS BIGINT) AS fetched_count, CASE WHEN event_type = 'error' THEN 'failed' END AS error FROM events AS e)"
LATEST_SQL = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY started_at DESC, id DESC) AS no FROM runs AS r) AS x WHERE no = 1)"


def cadences(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer")
    return c.select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("source_name"), ((F.col("c_custkey") % 3 + 1) * 12).alias("cadence_hours"))


CADENCE_SQL = "src AS (SELECT 'u' || CAST(c_custkey AS VARCHAR) AS source_name, (c_custkey % 3 + 1) * 12 AS cadence_hours FROM customer AS c)"


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """Stream events as changes of the customers' events."""
    e = read(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("event_id"), F.col("event_type").alias("change_type"), F.col("ts").alias("observed_at"), F.when(F.col("value") > 50, F.col("ts")).alias("digested_at"))


CHANGES_SQL = "ch AS (SELECT event_id AS id, user_id AS event_id, event_type AS change_type, ts AS observed_at, CASE WHEN value > 50 THEN ts END AS digested_at FROM events AS e)"


def customers(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("event_id"), F.col("c_name").alias("title"), F.floor("c_acctbal").cast("long").alias("score"), (F.col("c_custkey") % 2 == 0).alias("local"), F.when(F.col("c_custkey") % 7 != 0, F.lit(AS_OF) + F.make_dt_interval((F.col("c_custkey") % 15).cast("int") - 2)).cast("timestamp_ntz").alias("starts_at"), F.when(F.col("c_nationkey") < 20, "eligible").otherwise("rejected").alias("status"))


CUSTOMERS_SQL = """cu AS (SELECT c_custkey AS event_id, c_name AS title, CAST(floor(c_acctbal) AS BIGINT) AS score, c_custkey % 2 = 0 AS local,
  CASE WHEN c_custkey % 7 <> 0 THEN TIMESTAMP '2024-01-31' + to_days(CAST(c_custkey % 15 - 2 AS INTEGER)) END AS starts_at,
  CASE WHEN c_nationkey < 20 THEN 'eligible' ELSE 'rejected' END AS status FROM customer AS c)"""

QUERIES, ORACLE = {}, {}


def add(name: str, make, sql: str | None = None) -> None:
    QUERIES[name] = make
    if sql:
        ORACLE[name] = sql


def _filter(name: str, where: str, **how) -> None:
    add(name, lambda spark, sf: matching(order_events(spark, sf), **({"status": None} | how)).select(*SHOWN), f"WITH {EVENTS_SQL} SELECT id, status, title, score FROM ev AS x WHERE {where}")


add(
    "list_events", lambda spark, sf: ranked(matching(order_events(spark, sf), status="O", event_types=["1-URGENT", "2-HIGH"], text="build", as_of=dt.datetime(1998, 1, 1))).select(*SHOWN, "starts_at"),
    f"WITH {EVENTS_SQL} SELECT id, status, title, score, starts_at FROM ev AS x WHERE status = 'O' AND event_type IN ('1-URGENT', '2-HIGH') AND (title ILIKE '%build%' OR description ILIKE '%build%') AND (coalesce(ends_at, starts_at) IS NULL OR coalesce(ends_at, starts_at) >= TIMESTAMP '1998-01-01') ORDER BY score DESC, starts_at ASC NULLS LAST, id LIMIT 100",
)
_filter("filter_eq", "status = 'F' AND event_type = '5-LOW'", status="F", event_type="5-LOW")
_filter("filter_in", "event_type IN ('1-URGENT', '3-MEDIUM')", event_types=["1-URGENT", "3-MEDIUM"])
_filter("filter_text", "title ILIKE '%urgent%' OR description ILIKE '%urgent%'", text="urgent")
_filter("filter_substr", "organizer ILIKE '%mach%'", organizer="mach")
_filter("filter_range", "starts_at >= TIMESTAMP '1997-01-01' AND starts_at < TIMESTAMP '1998-01-01'", start_after=dt.datetime(1997, 1, 1), start_before=dt.datetime(1998, 1, 1), before_exclusive=True)
_filter("filter_or_null", "registration_opened_at >= TIMESTAMP '1999-01-01' OR first_observed_open_at >= TIMESTAMP '1999-01-01'", opened_after=dt.datetime(1999, 1, 1))
_filter("filter_visible", "coalesce(ends_at, starts_at) IS NULL OR coalesce(ends_at, starts_at) >= TIMESTAMP '2001-07-01'", as_of=dt.datetime(2001, 7, 1))
add(
    "filter_alias_any", lambda spark, sf: matching(order_events(spark, sf).withColumns({"city": F.col("title"), "venue": F.when(F.col("id") % 9 == 0, "Old Bangalore Hall")}), status=None, city_only=True).select(*SHOWN),
    f"WITH {EVENTS_SQL} SELECT id, status, title, score FROM ev AS x WHERE title ILIKE '%blr%' OR title ILIKE '%bengaluru%' OR id % 9 = 0",
)


def section_query(spark: SparkSession, sf: str) -> DataFrame:
    kinds = {"urgent": {"event_type": "1-URGENT"}, "high": {"event_types": ["1-URGENT", "2-HIGH"]}, "open": {"status": "O"}, "recent": {"start_after": dt.datetime(2001, 1, 1)}, "opened": {"opened_after": dt.datetime(2001, 1, 1)}, "cars": {"organizer": "auto"}}
    return sections(order_events(spark, sf), {name: {"status": None} | how for name, how in kinds.items()}, 10).select("section", "id", "score")


_SECTION_SQL = {"urgent": "event_type = '1-URGENT'", "high": "event_type IN ('1-URGENT', '2-HIGH')", "open": "status = 'O'", "recent": "starts_at >= TIMESTAMP '2001-01-01'", "opened": "registration_opened_at >= TIMESTAMP '2001-01-01' OR first_observed_open_at >= TIMESTAMP '2001-01-01'", "cars": "organizer ILIKE '%auto%'"}
add("sections", section_query, f"WITH {EVENTS_SQL} " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{n}' AS section, id, score FROM ev AS x WHERE {w} ORDER BY score DESC, starts_at ASC NULLS LAST, id LIMIT 10) AS s_{n}" for n, w in _SECTION_SQL.items()))
add("refresh_queue", lambda spark, sf: refresh_queue(order_events(spark, sf).withColumn("status", F.when(F.col("status") == "O", "eligible").otherwise("rejected"))).select("id", "starts_at"), f"WITH {EVENTS_SQL} SELECT id, starts_at FROM ev AS x WHERE status = 'O' ORDER BY starts_at ASC NULLS FIRST, id LIMIT 50")
add("source_health", lambda spark, sf: source_health(runs(spark, sf)), f"WITH {RUNS_SQL}, {LATEST_SQL} SELECT source_name, started_at, fetched_count, CASE WHEN error IS NOT NULL THEN 'error' WHEN coalesce(fetched_count, 0) = 0 THEN 'degraded' ELSE 'ok' END AS state FROM latest AS l")
add("health_quorum", lambda spark, sf: quorum(cadences(spark, sf), runs(spark, sf), F.lit(AS_OF)), f"WITH {RUNS_SQL}, {LATEST_SQL}, {CADENCE_SQL}, t AS (SELECT count(*) AS total, count(*) FILTER (WHERE l.started_at IS NOT NULL AND l.error IS NULL AND TIMESTAMP '2024-01-31' - l.started_at <= to_hours(s.cadence_hours * 2)) AS fresh FROM src AS s LEFT JOIN latest AS l ON s.source_name = l.source_name) SELECT total, fresh, greatest(1, CAST(ceil(total / 2.0) AS BIGINT)) AS needed, fresh >= greatest(1, CAST(ceil(total / 2.0) AS BIGINT)) AS healthy FROM t AS q")
add("cadence_due", lambda spark, sf: due(cadences(spark, sf), runs(spark, sf), F.lit(AS_OF)).select("source_name", "due"), f"WITH {RUNS_SQL}, {CADENCE_SQL}, last AS (SELECT source_name, max(started_at) AS at FROM runs AS r GROUP BY source_name) SELECT s.source_name, l.at IS NULL OR TIMESTAMP '2024-01-31' - l.at >= to_hours(s.cadence_hours) AS due FROM src AS s LEFT JOIN last AS l ON s.source_name = l.source_name")
add("run_counters", lambda spark, sf: read(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("accepted"), F.count_if(F.col("event_type").isin("view", "click")).alias("review"), F.count_if(F.col("event_type") == "signup").alias("rejected"), F.count_if(F.col("event_type") == "error").alias("errors")), "SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS accepted, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS review, count(*) FILTER (WHERE event_type = 'signup') AS rejected, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events AS e GROUP BY user_id")
add("totals", lambda spark, sf: runs(spark, sf).agg(F.count("*").alias("runs"), F.sum("fetched_count").alias("fetched"), F.count("error").alias("errors")), f"WITH {RUNS_SQL} SELECT count(*) AS runs, CAST(sum(fetched_count) AS BIGINT) AS fetched, count(error) AS errors FROM runs AS r")


def count_render(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    said = F.concat(F.col("n").cast("string"), F.lit(" "), "event_type", F.when(F.col("n") == 1, "").otherwise("s"))
    return n.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_type", said.alias("s")))), lambda x: x["s"]), "; ").alias("summary"))


add("count_render", count_render, "SELECT user_id, string_agg(CAST(n AS VARCHAR) || ' ' || event_type || CASE WHEN n = 1 THEN '' ELSE 's' END, '; ' ORDER BY event_type) AS summary FROM (SELECT user_id, event_type, count(*) AS n FROM events AS e GROUP BY 1, 2) AS t GROUP BY user_id")
add("semi_join_source", lambda spark, sf: read(spark, sf, "orders").join(read(spark, sf, "lineitem").join(read(spark, sf, "supplier").filter(F.col("s_name").ilike("%00001%")), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders AS o WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem AS l JOIN supplier AS s ON l.l_suppkey = s.s_suppkey WHERE s_name ILIKE '%00001%')")
def pending_query(spark: SparkSession, sf: str) -> DataFrame:
    """Events end a day after they begin; every fourth has been cancelled."""
    e = customers(spark, sf).withColumns({"ends_at": F.col("starts_at") + F.make_dt_interval(F.lit(1)), "registration_state": F.when(F.col("event_id") % 4 == 0, "cancelled").otherwise("open")})
    return pending(changes(spark, sf), e, F.lit(AS_OF)).select("id", "event_id", "change_type", "title")


add("pending_changes", pending_query, f"WITH {CHANGES_SQL}, {CUSTOMERS_SQL} SELECT c.id, c.event_id, c.change_type, u.title FROM ch AS c JOIN cu AS u ON c.event_id = u.event_id WHERE c.digested_at IS NULL AND ((u.status = 'eligible' AND (u.starts_at IS NULL OR u.starts_at + INTERVAL 1 DAY >= TIMESTAMP '2024-01-31')) OR (u.event_id % 4 = 0 AND c.change_type IN ('registration_state', 'lifecycle')))")
add("digest_group", lambda spark, sf: grouped_changes(changes(spark, sf)).select("event_id", F.array_join(F.transform("changes", lambda x: x["id"].cast("string")), ",").alias("ids")), f"WITH {CHANGES_SQL} SELECT event_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY observed_at, id) AS ids FROM ch AS c GROUP BY event_id")
add("distinct_join", lambda spark, sf: changes(spark, sf).groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("change_type")), lambda x: F.replace(x, F.lit("_"), F.lit(" "))), ", ").alias("kinds")), f"WITH {CHANGES_SQL} SELECT event_id, string_agg(DISTINCT change_type, ', ' ORDER BY change_type) AS kinds FROM ch AS c GROUP BY event_id")
add("count_distinct", lambda spark, sf: changes(spark, sf).agg(F.count_distinct("event_id").alias("n_events"), F.count_distinct("change_type").alias("n_types")), f"WITH {CHANGES_SQL} SELECT count(DISTINCT event_id) AS n_events, count(DISTINCT change_type) AS n_types FROM ch AS c")
add("digest_rank", lambda spark, sf: digest_order(customers(spark, sf), F.lit(AS_OF), 10).select("event_id", "urgency", "score"), f"WITH {CUSTOMERS_SQL}, k AS (SELECT *, CASE WHEN starts_at IS NULL OR starts_at < TIMESTAMP '2024-01-31' THEN 0 WHEN starts_at <= TIMESTAMP '2024-02-02' THEN 4 WHEN starts_at <= TIMESTAMP '2024-02-07' THEN 2 ELSE 0 END AS urgency FROM cu AS u) SELECT event_id, urgency, score FROM k AS x ORDER BY urgency DESC, local DESC, score DESC, starts_at ASC NULLS LAST, lower(title), event_id LIMIT 10")


def order_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as runs with the lines' parts as ids of changes."""
    lines = read(spark, sf, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("run_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: x["l_partkey"]).alias("event_change_ids"))


add("run_pairs", lambda spark, sf: run_pairs(order_runs(spark, sf), read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("event_id")), read(spark, sf, "supplier").select(F.col("s_suppkey").alias("event_id"), "s_name")).select("run_id", F.col("pos").cast("long").alias("pos"), "id", "s_name"), "WITH x AS (SELECT l_orderkey AS run_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, l_partkey AS id FROM lineitem AS l) SELECT x.run_id, x.pos, x.id, s.s_name FROM x JOIN part AS p ON x.id = p.p_partkey JOIN supplier AS s ON s.s_suppkey = p.p_size")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as chunks of runs."""
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("chunk_index"), F.array("l_partkey", "l_suppkey").alias("event_change_ids"), F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("sent_at"), F.floor("l_quantity").cast("int").alias("attempt_count"))


add("completed_changes", lambda spark, sf: completed_changes(chunks(spark, sf)).select("run_id", "id"), "SELECT run_id, id FROM (SELECT l_orderkey AS run_id, unnest([l_partkey, l_suppkey]) AS id, l_linestatus = 'F' AS ok FROM lineitem AS l) AS t GROUP BY run_id, id HAVING bool_and(ok)")
add("carry_exclude", lambda spark, sf: changes(spark, sf).join(chunks(spark, sf).filter("sent_at IS NULL").select(F.explode("event_change_ids").alias("id")).distinct(), "id", "left_anti").select("id", "event_id"), f"WITH {CHANGES_SQL}, carry AS (SELECT DISTINCT unnest([l_partkey, l_suppkey]) AS id FROM lineitem AS l WHERE l_linestatus <> 'F') SELECT id, event_id FROM ch AS c WHERE NOT EXISTS (SELECT 1 FROM carry AS k WHERE k.id = c.id)")
add("delivery_due", lambda spark, sf: due_deliveries(read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("sent_at"), (F.floor("l_quantity").cast("int") % 5).alias("attempt_count"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_shipdate")).alias("next_attempt_at")), F.lit(dt.datetime(1997, 1, 1)).cast("timestamp_ntz")).groupBy("run_id").agg(F.count("*").alias("due_chunks")), "SELECT l_orderkey AS run_id, count(*) AS due_chunks FROM lineitem AS l WHERE l_linestatus <> 'F' AND CAST(floor(l_quantity) AS INTEGER) % 5 < 3 AND (l_linenumber % 2 <> 0 OR l_shipdate <= TIMESTAMP '1997-01-01') GROUP BY 1")
add("delivery_state", lambda spark, sf: run_states(chunks(spark, sf).withColumn("attempt_count", F.col("attempt_count") % 4)).withColumnRenamed("status", "state"), "SELECT l_orderkey AS run_id, CASE WHEN bool_and(l_linestatus = 'F') THEN 'sent' WHEN bool_or(l_linestatus <> 'F' AND CAST(floor(l_quantity) AS INTEGER) % 4 < 3) THEN 'partial' ELSE 'failed' END AS state FROM lineitem AS l GROUP BY 1")
add("oldest_unfinished", lambda spark, sf: read(spark, sf, "orders").filter("o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").limit(1).select("o_orderkey", "o_orderdate"), "SELECT o_orderkey, o_orderdate FROM orders AS o WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 1")
add("failed_carry", lambda spark, sf: read(spark, sf, "lineitem").filter("l_linestatus <> 'F'").join(read(spark, sf, "orders").filter("o_orderstatus = 'F' OR o_orderstatus = 'O'").join(read(spark, sf, "lineitem").filter("l_linestatus <> 'F'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").filter("o_orderdate < TIMESTAMP_NTZ '2000-01-01'").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber"), "WITH run AS (SELECT o_orderkey FROM orders AS o WHERE o_orderstatus IN ('F', 'O') AND o_orderdate < TIMESTAMP '2000-01-01' AND EXISTS (SELECT 1 FROM lineitem AS l WHERE l.l_orderkey = o.o_orderkey AND l_linestatus <> 'F') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) SELECT l_orderkey, l_linenumber FROM lineitem AS m JOIN run AS r ON m.l_orderkey = r.o_orderkey WHERE l_linestatus <> 'F'")
add("carry_concat", lambda spark, sf: chunks(spark, sf).select("run_id", (F.row_number().over(Window.partitionBy("run_id").orderBy(F.col("sent_at").isNotNull(), "chunk_index")) - 1).cast("long").alias("position"), F.col("chunk_index").cast("long").alias("chunk_index")), "SELECT l_orderkey AS run_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linestatus = 'F', l_linenumber) - 1 AS position, CAST(l_linenumber AS BIGINT) AS chunk_index FROM lineitem AS l")
add("mark_digested", lambda spark, sf: mark_digested(changes(spark, sf), changes(spark, sf).join(customers(spark, sf).filter("status = 'eligible'"), "event_id", "left_semi"), F.lit(AS_OF).cast("timestamp_ntz")).select("id", "digested_at"), f"WITH {CHANGES_SQL}, {CUSTOMERS_SQL} SELECT c.id, coalesce(c.digested_at, CASE WHEN u.event_id IS NOT NULL THEN TIMESTAMP '2024-01-31' END) AS digested_at FROM ch AS c LEFT JOIN cu AS u ON c.event_id = u.event_id AND u.status = 'eligible'")
add("backoff", lambda spark, sf: chunks(spark, sf).select(F.least(F.lit(60), F.pow(F.lit(2), F.col("attempt_count") % 9)).cast("long").alias("minutes")).groupBy("minutes").agg(F.count("*").alias("n")), "SELECT CAST(least(60, power(2, CAST(floor(l_quantity) AS INTEGER) % 9)) AS BIGINT) AS minutes, count(*) AS n FROM lineitem AS l GROUP BY 1")
add("latest_per_key", lambda spark, sf: latest_runs(runs(spark, sf)).select("source_name", "id"), f"WITH {RUNS_SQL}, {LATEST_SQL} SELECT source_name, id FROM latest AS l")
add("anti_profiles", lambda spark, sf: read(spark, sf, "customer").join(read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey"), "SELECT c_custkey FROM customer AS c WHERE NOT EXISTS (SELECT 1 FROM orders AS o WHERE o.o_custkey = c.c_custkey)")
add("set_union", lambda spark, sf: read(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(read(spark, sf, "supplier").select("s_nationkey")).distinct(), "SELECT c_nationkey AS k FROM customer AS c UNION SELECT s_nationkey FROM supplier AS s")
add("set_diff", lambda spark, sf: read(spark, sf, "part").select("p_partkey").join(read(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").distinct(), "SELECT p_partkey FROM part AS p EXCEPT SELECT l_partkey FROM lineitem AS l")
add("dup_detect", lambda spark, sf: read(spark, sf, "part").groupBy("p_name").agg(F.count("*").alias("n")).filter("n > 1"), "SELECT p_name, count(*) AS n FROM part AS p GROUP BY p_name HAVING count(*) > 1")
add("any_paid", lambda spark, sf: read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_discount") > 0).alias("any_paid")), "SELECT l_orderkey, bool_or(l_discount > 0) AS any_paid FROM lineitem AS l GROUP BY l_orderkey")
add("array_union_sorted", lambda spark, sf: read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.array_union(F.collect_set("l_partkey"), F.collect_set("l_suppkey"))), lambda x: x.cast("string")), ",").alias("ids")), "SELECT l_orderkey, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM (SELECT l_orderkey, l_partkey AS id FROM lineitem AS a UNION SELECT l_orderkey, l_suppkey FROM lineitem AS b) AS t GROUP BY l_orderkey")
add("array_union_ordered", lambda spark, sf: read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])), ",").alias("roles")), "SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(struct_pack(t := turn, r := role)) AS first FROM conversations AS c GROUP BY 1, 2) AS t GROUP BY conv_id")
def rate_query(spark: SparkSession, sf: str) -> DataFrame:
    """Events as requests of their users, a million seconds apart at least."""
    e = read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("host"), F.col("ts").alias("at"))
    return scheduled(e, F.lit(10**12)).select(F.col("id").alias("event_id"), "wait_us")


add("rate_limit_gaps", rate_query, "WITH n AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM events AS e) SELECT event_id, CAST(max(t - no * 1000000000000) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) + no * 1000000000000 - t AS BIGINT) AS wait_us FROM n AS x")
add("open_transition", lambda spark, sf: read(spark, sf, "events").withColumn("prev", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).filter("event_type = 'purchase' AND prev IN ('view', 'error')").groupBy("user_id").agg(F.min("ts").alias("first_open")), "SELECT user_id, min(ts) AS first_open FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events AS e) AS t WHERE event_type = 'purchase' AND prev IN ('view', 'error') GROUP BY user_id")
add("revert_format", lambda spark, sf: read(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("oldest"), F.max_by("event_type", F.struct("ts", "event_id")).alias("current")).filter("oldest = current").select("user_id", "current"), "SELECT user_id, cur AS current FROM (SELECT user_id, first(event_type ORDER BY ts, event_id) AS old, last(event_type ORDER BY ts, event_id) AS cur FROM events AS e GROUP BY user_id) AS t WHERE old = cur")
add("schedule_balance", lambda spark, sf: (lambda e: e.select("user_id", F.explode(F.array(F.struct(F.col("prev").alias("value"), F.lit(-1).alias("n")), F.struct(F.col("event_type").alias("value"), F.lit(1).alias("n")))).alias("x")).groupBy("user_id", "x.value").agg(F.sum("x.n").alias("balance")))(read(spark, sf, "events").withColumn("prev", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).filter("prev IS NOT NULL")), "WITH t AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events AS e) SELECT user_id, value, CAST(sum(n) AS BIGINT) AS balance FROM (SELECT user_id, prev AS value, -1 AS n FROM t AS a WHERE prev IS NOT NULL UNION ALL SELECT user_id, event_type, 1 FROM t AS b WHERE prev IS NOT NULL) AS u GROUP BY 1, 2")
add("severity_max", lambda spark, sf: read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_returnflag", F.struct(F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("s"))).alias("state")), "SELECT l_orderkey, CASE max(CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) WHEN 0 THEN 'N' WHEN 1 THEN 'A' ELSE 'R' END AS state FROM lineitem AS l GROUP BY 1")
add("earliest", lambda spark, sf: read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min(F.when(F.col("l_returnflag") != "N", F.col("l_shipdate"))).alias("earliest")), "SELECT l_orderkey, min(CASE WHEN l_returnflag <> 'N' THEN l_shipdate END) AS earliest FROM lineitem AS l GROUP BY 1")
add("survivor", lambda spark, sf: read(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct((F.col("o_orderstatus") == "O").alias("a"), F.floor(F.col("o_totalprice") / 1000).alias("b"), (-F.col("o_orderkey")).alias("c"))).alias("survivor")), "SELECT o_custkey, o_orderkey AS survivor FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'O' DESC, floor(o_totalprice / 1000) DESC, o_orderkey) AS no FROM orders AS o) AS t WHERE no = 1")
add("fact_count", lambda spark, sf: order_events(spark, sf).select("id", sum((F.col(c).isNotNull().cast("int") for c in ("ends_at", "registration_opened_at", "first_observed_open_at", "organizer", "title")), F.lit(0)).cast("long").alias("facts")), f"WITH {EVENTS_SQL} SELECT id, CAST((ends_at IS NOT NULL)::INT + (registration_opened_at IS NOT NULL)::INT + (first_observed_open_at IS NOT NULL)::INT + (organizer IS NOT NULL)::INT + (title IS NOT NULL)::INT AS BIGINT) AS facts FROM ev AS x")
add("running_offsets", lambda spark, sf: read(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text") + 2).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("offset_chars")), "SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_chars FROM conversations AS c")
add("size_cap", lambda spark, sf: read(spark, sf, "pages").filter(F.octet_length("html") <= 2000).select("page_id"), "SELECT page_id FROM pages AS p WHERE strlen(html) <= 2000")
add("expire_past", lambda spark, sf: order_events(spark, sf).select("id", F.when((F.col("status") == "O") & (F.coalesce("ends_at", "starts_at") < F.lit(dt.datetime(2000, 1, 1))), "expired").otherwise(F.col("status")).alias("status")), f"WITH {EVENTS_SQL} SELECT id, CASE WHEN status = 'O' AND coalesce(ends_at, starts_at) < TIMESTAMP '2000-01-01' THEN 'expired' ELSE status END AS status FROM ev AS x")
add("cdc_diff", lambda spark, sf: (lambda e: e.select("user_id", "event_id", F.explode(F.filter(F.array(F.struct(F.lit("state").alias("field"), F.col("p").alias("old_value"), F.col("event_type").alias("new_value")), F.struct(F.lit("high").alias("field"), F.col("q").alias("old_value"), (F.col("value") > 50).cast("string").alias("new_value"))), lambda x: ~x["old_value"].eqNullSafe(x["new_value"]))).alias("d")).select("user_id", "event_id", "d.*"))(read(spark, sf, "events").withColumn("p", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).withColumn("q", F.lag((F.col("value") > 50).cast("string")).over(Window.partitionBy("user_id").orderBy("ts", "event_id")))), "WITH t AS (SELECT user_id, event_id, event_type, CASE WHEN value > 50 THEN 'true' WHEN value <= 50 THEN 'false' END AS high, lag(event_type) OVER w AS p, lag(CASE WHEN value > 50 THEN 'true' WHEN value <= 50 THEN 'false' END) OVER w AS q FROM events AS e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id, 'state' AS field, p AS old_value, event_type AS new_value FROM t AS a WHERE p IS DISTINCT FROM event_type UNION ALL SELECT user_id, event_id, 'high', q, high FROM t AS b WHERE q IS DISTINCT FROM high")
