"""The experiment database on the star schema, and strings, dates and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import maps, text, vec
from ..operators import relational as op
from ..operators.sampling import running_total
from ..sources import catalog, logs
from .tables import events, frames, rounded, table


def exp_join_rollup(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    return rounded(op.join_rollup(o, [(c, "o_custkey", "c_custkey"), (n, "c_nationkey", "n_nationkey"), (r, "n_regionkey", "r_regionkey")], ["r_name", "o_orderstatus"], "o_totalprice"), 2)


def nested_agg_stdev(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(op.nested_stdev(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_returnflag"], "l_quantity"), 4)


def like_in_filter(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    kept = p.where(F.col("p_name").like("%a%") & (F.col("p_brand").like("%1") | F.col("p_size").isin(1, 5, 9)))
    return rounded(kept.groupBy("p_brand").agg(F.count("*").alias("n"), F.max("p_retailprice").alias("most")))


def distinct_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct().orderBy("l_returnflag", "l_linestatus")


def topk_orders(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice"))


def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    kept = table(spark, sf, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return rounded(kept.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.sum(price).alias("revenue"), F.avg("l_discount").alias("discount"), F.count("*").alias("n")), 2)


def back_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Every line, resolved to its order and that order's customer; the line's place is carried along."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    sample = li.select("l_orderkey", "l_linenumber", "l_quantity")
    return rounded(sample.join(o, sample.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", "l_quantity", "o_custkey"))


def back_projection_files(spark: SparkSession, sf: str) -> DataFrame:
    """What all lines ask of the orders, by file of a thousand: distinct orders, and the first and last of them."""
    asked = catalog.by_file(table(spark, sf, "lineitem").select("l_orderkey"), "l_orderkey", 1000)
    return rounded(asked.select("file_idx", "n", F.size("frames").alias("frames"), F.array_min("frames").alias("first"), F.array_max("frames").alias("last")))


def array_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as 4 by 4 by 4 arrays: the diagonal of each."""
    packed = catalog.packed(F.col("x"), 4, 4, 4)
    return rounded(frames(spark, sf).withColumn("a", packed).select("vec_id", *(catalog.cell(F.col("a"), k, k, k).alias(f"d{k}") for k in range(4))))


def map_tallies(spark: SparkSession, sf: str) -> DataFrame:
    """Event types of each user as maps, of even and odd events, merged: the number of each, and the commonest."""
    e = events(spark, sf)
    halves = [e.where(F.col("event_id") % 2 == k).groupBy("user_id").agg(maps.tally(F.collect_list("event_type")).alias(f"m{k}")) for k in (0, 1)]
    merged = halves[0].join(halves[1], "user_id", "full").select("user_id", maps.merge(F.col("m0"), F.col("m1")).alias("m"))
    return rounded(merged.select("user_id", maps.top_key(F.col("m")).alias("top"), maps.lookup(F.col("m"), F.lit("click"), F.lit(0)).alias("clicks"), F.explode("m").alias("event_type", "n")))


def log_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Users' events as the lines of their logs: how many lines of each type follow each signup."""
    lines = events(spark, sf).select(F.col("user_id").alias("file"), "event_id", F.concat("event_type", F.lit(" "), "event_id").alias("line"))
    return rounded(logs.sections(lines, "event_id", r"^signup \d+$").groupBy("file", "section").agg(F.count("*").alias("n")))


def job_accounts(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' names as logs of ``key: value`` lines, joined by number to the account balances."""
    c = table(spark, sf, "customer")
    texts = F.array(F.concat(F.lit("job: "), "c_custkey"), F.concat(F.lit("segment: "), "c_mktsegment"), F.lit("no pair"), F.concat(F.lit("job : "), F.col("c_custkey") + 1))
    lines = c.select(F.col("c_name").alias("file"), F.posexplode(texts).alias("at", "line"))
    accounts = c.select(F.col("c_custkey").alias("job"), "c_acctbal")
    return rounded(logs.job_rows(lines, "at", "job", accounts).select("file", "job", F.try_element_at("values", F.lit("segment")).alias("segment"), "c_acctbal"), 2)


def grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    out = li.groupingSets([["l_returnflag", "l_linestatus"], ["l_returnflag"], []], "l_returnflag", "l_linestatus")
    return rounded(out.agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n")), 2)


def cube_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n")).select("c_mktsegment", F.col("c_nationkey").cast("long").alias("c_nationkey"), "n")


def set_ops(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with orders of status F and O but not P."""
    o = table(spark, sf, "orders")
    by = {s: o.where(F.col("o_orderstatus") == s).select("o_custkey") for s in "FOP"}
    return by["F"].intersect(by["O"]).exceptAll(by["P"].distinct()).distinct()


def semi_anti(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("with_orders")).join(c.join(o, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("without")), "c_mktsegment", "full").select("c_mktsegment", F.coalesce("with_orders", F.lit(0)).alias("with_orders"), F.coalesce("without", F.lit(0)).alias("without"))


def outer_join(spark: SparkSession, sf: str) -> DataFrame:
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    return n.join(s, s.s_nationkey == n.n_nationkey, "left").groupBy("n_name").agg(F.count("s_suppkey").alias("suppliers"))


def rank_functions(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(op.ranks(table(spark, sf, "customer").select("c_mktsegment", "c_custkey", "c_nationkey"), "c_mktsegment", ["c_nationkey"], "c_custkey"))


def pivot_status(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey")).na.fill(0)


def count_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


def grouped_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of each nation in order of their keys."""
    s = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_suppkey")).alias("keys"))
    return rounded(s.select("s_nationkey", F.array_join("keys", ",").alias("keys"), F.size("keys").alias("n")))


def upsert_rows(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    changes = o.where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("X"))
    return op.upsert(o, changes, ["o_orderkey"])


def list_delta(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).select("event_id", "event_type")
    return catalog.delta(e, e.where("event_id % 3 <> 0"), ["event_id"])


def removed_positions(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).select("event_id", "user_id")
    return catalog.without_positions(e, e.where("user_id % 2 = 0"), "event_id")


def head_slice(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.head(events(spark, sf).select("event_id", "event_type"), "event_id", 50)[0]


def matrix_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Cells (supplier nation, month) of two increments, added up."""
    li, s = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    cells = li.join(s, li.l_suppkey == s.s_suppkey).select(F.col("s_nationkey").alias("i"), F.month("l_shipdate").alias("j"), F.col("l_quantity").alias("v"), "l_linenumber")
    parts = [catalog.merge_cells(cells.where(F.col("l_linenumber") % 2 == k)) for k in (0, 1)]
    return rounded(catalog.merge_cells(parts[0].unionByName(parts[1])), 2)


def frame_reference(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.frame_reference(table(spark, sf, "orders").select((F.col("o_orderkey") * 37).alias("idx")), "idx", 1000)


def symmetric_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """A square matrix of the part counts of supplier pairs of consecutive lines, from its upper triangle."""
    e = events(spark, sf).select((F.col("user_id") % 10).alias("i"), (F.col("event_id") % 10).alias("j")).where("i <= j")
    return catalog.square(e.groupBy("i", "j").agg(F.count("*").alias("v")))


def inferred_types(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of the parts of event properties and addresses as texts."""
    words = table(spark, sf, "pages").select(F.explode(F.split(F.regexp_replace("url", "[^0-9A-Za-z.]+", " "), " ")).alias("w")).where("w <> ''")
    return words.groupBy(catalog.infer_value(F.col("w")).alias("kind")).agg(F.count("*").alias("n"))


def duration_parse(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    written = F.format_string("%d-%02d:%02d:%02d", F.col("o_orderkey") % 3, F.col("o_orderkey") % 24, F.col("o_custkey") % 60, F.col("o_orderkey") % 60)
    return o.select("o_orderkey", text.duration_seconds(written).alias("seconds"))


def date_differences(spark: SparkSession, sf: str) -> DataFrame:
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    pairs = li.join(o, li.l_orderkey == o.o_orderkey)
    return rounded(pairs.groupBy("o_orderpriority").agg(F.avg(text.seconds_between(F.col("l_shipdate"), F.col("o_orderdate"))).alias("seconds"), F.count("*").alias("n")), 2)


def key_strip(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    wrapped = text.wrap_key("basin", F.concat(F.col("event_type"), F.lit("_"), F.col("user_id").cast("string")))
    return e.select("event_id", text.unwrap_key(wrapped).alias("key"), text.strip_braces("props").alias("stripped"))


def natural_sort(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.when(F.col("s_suppkey") % 2 == 0, "even_").otherwise("odd_"), F.col("s_suppkey").cast("string")).alias("name"))
    return rounded(running_total(s, [text.natural_key(F.col("name")), F.col("s_suppkey")], F.lit(1), "place").select("s_suppkey", "place"))


def json_extract(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return rounded(e.groupBy("event_type").agg(F.avg("k").alias("mean"), F.max("k").alias("most"), F.count("k").alias("n")))


def json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors written as JSON and read back: the largest difference of each."""
    f = frames(spark, sf).select("vec_id", "x", F.from_json(F.to_json(F.struct("x")), "x array<double>")["x"].alias("y"))
    return rounded(f.select("vec_id", vec.distance(F.col("x"), F.col("y")).alias("d")))


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Event log lines written from the events, parsed as contact events, and counted by kind."""
    e = events(spark, sf)
    line = F.concat_ws(" ", F.when(F.col("event_type") == "signup", "+++").when(F.col("event_type") == "error", "---").otherwise("..."), "event_id", F.col("user_id").cast("string"), (F.col("user_id") + 7).cast("string"))
    found = logs.contact_events(e.select(F.lit("log").alias("file"), line.alias("line")))
    return rounded(found.groupBy("kind").agg(F.count("*").alias("n"), F.min("r1").alias("lowest"), F.max("r2").alias("highest"), F.max("step").alias("last")))


def document_words(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("lang", F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("w")).where("length(w) >= 3")
    return d.groupBy("lang").agg(F.count("*").alias("words"), F.count_distinct("w").alias("vocabulary"))


def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select(F.regexp_extract("url", r"^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", r"://[^/]*\.([a-z]+)[/?#]", 1).alias("top"))
    return p.groupBy("scheme", "top").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (exp_join_rollup, nested_agg_stdev, like_in_filter, distinct_sorted, topk_orders, pricing_summary, back_projection, back_projection_files, array_cells, map_tallies, log_sections, job_accounts, grouping_sets, cube_counts, set_ops, semi_anti, outer_join, rank_functions, pivot_status, count_distinct, grouped_lists, upsert_rows, list_delta, removed_positions, head_slice, matrix_merge, frame_reference, symmetric_matrix, inferred_types, duration_parse, date_differences, key_strip, natural_sort, json_extract, json_round_trip, log_lines, document_words, url_parts)}

ORACLE_SQL = {
    "exp_join_rollup": "SELECT r_name, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 2) AS mean, round(max(o_totalprice), 2) AS most, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "nested_agg_stdev": "WITH g AS (SELECT l_returnflag, l_orderkey, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem GROUP BY ALL) SELECT l_returnflag, round(avg(m), 4) AS mean, round(avg(s), 4) AS deviation, count(*) AS groups, count(s) AS with_deviation FROM g GROUP BY 1",
    "like_in_filter": "SELECT p_brand, count(*) AS n, round(max(p_retailprice), 6) AS most FROM part WHERE p_name LIKE '%a%' AND (p_brand LIKE '%1' OR p_size IN (1, 5, 9)) GROUP BY 1",
    "distinct_sorted": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem ORDER BY ALL",
    "topk_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 2) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "back_projection": "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "back_projection_files": "SELECT l_orderkey // 1000 AS file_idx, count(*) AS n, count(DISTINCT l_orderkey) AS frames, min(l_orderkey % 1000) AS first, max(l_orderkey % 1000) AS last FROM lineitem GROUP BY 1",
    "array_cells": "SELECT vec_id, " + ", ".join(f"round(embedding[{21 * k + 1}]::DOUBLE, 6) AS d{k}" for k in range(4)) + " FROM embeddings",
    "map_tallies": "WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT user_id, arg_min(event_type, (-n, event_type)) AS top, coalesce(max(n) FILTER (event_type = 'click'), 0) AS clicks FROM n GROUP BY 1) SELECT user_id, top, clicks, event_type, n FROM n JOIN t USING (user_id)",
    "log_sections": "WITH s AS (SELECT user_id AS file, 'signup ' || max(event_id) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY event_id) AS section FROM events) SELECT file, section, count(*) AS n FROM s GROUP BY ALL",
    "job_accounts": "SELECT a.c_name AS file, a.c_custkey + 1 AS job, a.c_mktsegment AS segment, round(b.c_acctbal, 2) AS c_acctbal FROM customer a LEFT JOIN customer b ON b.c_custkey = a.c_custkey + 1",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "cube_counts": "SELECT c_mktsegment, c_nationkey::BIGINT AS c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)",
    "set_ops": "(SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "semi_anti": "SELECT c_mktsegment, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS with_orders, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders)) AS without FROM customer GROUP BY 1",
    "outer_join": "SELECT n_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1",
    "rank_functions": "SELECT c_mktsegment, c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey DESC) AS rank, dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey DESC) AS dense, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey DESC, c_custkey) AS quartile FROM customer",
    "pivot_status": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1",
    "count_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1",
    "grouped_lists": "SELECT s_nationkey::BIGINT AS s_nationkey, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) AS keys, count(*) AS n FROM supplier GROUP BY ALL",
    "upsert_rows": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders",
    "list_delta": "SELECT event_id, event_type FROM events WHERE event_id % 3 = 0",
    "removed_positions": "SELECT event_id, user_id FROM events WHERE user_id % 2 <> 0",
    "head_slice": "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 50",
    "matrix_merge": "SELECT s_nationkey::BIGINT AS i, month(l_shipdate) AS j, round(sum(l_quantity), 2) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL",
    "frame_reference": "SELECT o_orderkey * 37 AS idx, o_orderkey * 37 // 1000 AS file_idx, o_orderkey * 37 % 1000 AS frame FROM orders",
    "symmetric_matrix": "WITH t AS (SELECT user_id % 10 AS i, event_id % 10 AS j, count(*) AS v FROM events WHERE user_id % 10 <= event_id % 10 GROUP BY ALL) SELECT i, j, v FROM t UNION ALL SELECT j, i, v FROM t WHERE i <> j",
    "inferred_types": "WITH w AS (SELECT unnest(string_split(regexp_replace(url, '[^0-9A-Za-z.]+', ' ', 'g'), ' ')) AS w FROM pages) SELECT CASE WHEN regexp_full_match(w, '[0-9]+') THEN 'int' WHEN try_cast(w AS DOUBLE) IS NOT NULL THEN 'float' ELSE 'str' END AS kind, count(*) AS n FROM w WHERE w <> '' GROUP BY 1",
    "duration_parse": "SELECT o_orderkey, (o_orderkey % 3) * 86400 + (o_orderkey % 24) * 3600 + (o_custkey % 60) * 60 + o_orderkey % 60 AS seconds FROM orders",
    "date_differences": "SELECT o_orderpriority, round(avg(abs(epoch(l_shipdate)::BIGINT - epoch(o_orderdate)::BIGINT)), 2) AS seconds, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "key_strip": "SELECT event_id, event_type || '_' || user_id AS key, translate(props, '()[]{},', '') AS stripped FROM events",
    "natural_sort": "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey % 2, s_suppkey) AS place FROM supplier",
    "json_extract": "WITH k AS (SELECT event_type, json_extract(props, '$.k')::BIGINT AS k FROM events) SELECT event_type, round(avg(k), 6) AS mean, max(k) AS most, count(k) AS n FROM k GROUP BY 1",
    "json_round_trip": "SELECT vec_id, 0.0::DOUBLE AS d FROM embeddings",
    "log_lines": "SELECT CASE event_type WHEN 'signup' THEN '+++' ELSE '---' END AS kind, count(*) AS n, min(user_id) - 1 AS lowest, max(user_id) + 6 AS highest, max(event_id) AS last FROM events WHERE event_type IN ('signup', 'error') GROUP BY 1",
    "document_words": "WITH w AS (SELECT lang, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents) SELECT lang, count(*) AS words, count(DISTINCT w) AS vocabulary FROM w WHERE length(w) >= 3 GROUP BY 1",
    "url_parts": "SELECT regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://[^/]*\\.([a-z]+)[/?#]', 1) AS top, count(*) AS n FROM pages GROUP BY ALL",
}
