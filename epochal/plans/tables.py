"""Queries of ordinary SQL over the supplied tables: searches, joins, groupings, frames and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars, search, statements
from ..operators import ordering, snapshot
from .history import read
from .registry import query

TERMS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')"


@query(f"WITH w AS (SELECT doc_id, unnest({TERMS}) AS t FROM documents), g AS (SELECT doc_id AS id, t, count(*) AS n FROM w WHERE t IN ('the', 'that') GROUP BY ALL) SELECT id, sum(n)::BIGINT AS hits FROM g GROUP BY id HAVING count(*) = 2")
def s21_full_text(spark, d):
    return search.matching(search.postings(read(spark, d, "documents"), "doc_id", "text"), "The", "that")


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_extendedprice BETWEEN 10000 AND 20000")
def s21_boxes(spark, d):
    return read(spark, d, "lineitem").where(search.within(l_quantity=(10, 20), l_extendedprice=(10_000, 20_000))).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


@query("SELECT i, i * i % 97 AS square FROM (SELECT unnest(range(1, (SELECT count(*) + 1 FROM orders))) AS i)")
def s23_generated_rows(spark, d):
    return snapshot.generated(spark, 1, read(spark, d, "orders").count(), square=F.col("i") * F.col("i") % 97)


@query("SELECT r_name, n_name FROM region, nation")
def j11_cross_join(spark, d):
    return read(spark, d, "region").select("r_name").crossJoin(read(spark, d, "nation").select("n_name"))


@query("""WITH c AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0), o AS (SELECT o_custkey AS k FROM orders WHERE o_orderkey % 5 = 0)
  SELECT 'inner' AS how, count(*) AS n FROM c JOIN o USING (k) UNION ALL SELECT 'left', count(*) FROM c LEFT JOIN o USING (k) UNION ALL SELECT 'right', count(*) FROM c RIGHT JOIN o USING (k) UNION ALL SELECT 'full', count(*) FROM c FULL JOIN o USING (k)
  UNION ALL SELECT 'left_semi', count(*) FROM c WHERE k IN (SELECT k FROM o) UNION ALL SELECT 'left_anti', count(*) FROM c WHERE k NOT IN (SELECT k FROM o)""")
def j14_join_types(spark, d):
    c = read(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"))
    o = read(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("k"))
    out = None
    for how in ("inner", "left", "right", "full", "left_semi", "left_anti"):
        one = c.join(o, "k", how).agg(F.lit(how).alias("how"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT c_mktsegment, c_nationkey::BIGINT AS c_nationkey, count(*) AS n, grouping(c_mktsegment)::BIGINT AS over FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def a17_cube(spark, d):
    return read(spark, d, "customer").select("c_mktsegment", F.col("c_nationkey").cast("long").alias("c_nationkey")).cube("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.grouping("c_mktsegment").cast("long").alias("over"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def a17_grouping_sets(spark, d):
    o = read(spark, d, "orders")
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return o.groupingSets([[s], [p], []], s, p).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, TRUE AS near FROM lineitem GROUP BY 1")
def a17_approximate_distinct(spark, d):
    # The two are counted apart: in one aggregate each flag and order would hold a sketch of its own.
    l = read(spark, d, "lineitem").select("l_returnflag", "l_orderkey")
    exact = l.distinct().groupBy("l_returnflag").agg(F.count("l_orderkey").alias("n"))
    about = l.groupBy(F.col("l_returnflag").alias("flag")).agg(F.approx_count_distinct("l_orderkey", 0.02).alias("about"))
    near = (F.abs(F.col("about") - F.col("n")) <= 0.1 * F.col("n")).alias("near")
    return exact.join(about, F.col("l_returnflag").eqNullSafe(F.col("flag"))).select("l_returnflag", near)


@query("SELECT o_orderkey, sum(o_orderkey) OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW)::BIGINT AS in_range, sum(o_orderkey) OVER (PARTITION BY o_custkey % 50 ORDER BY o_custkey GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW)::BIGINT AS in_groups FROM orders")
def w11_frames(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 50).alias("p"))
    ranged = o.withColumn("in_range", F.sum("o_orderkey").over(Window.partitionBy("p").orderBy("o_orderkey").rangeBetween(-1000, 0)))
    return ordering.group_frame_sum(ranged, ["p"], "o_custkey", "o_orderkey", 1, "in_groups").select("o_orderkey", "in_range", "in_groups")


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place FROM lineitem")
def o1_total_order(spark, d):
    l = read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_suppkey", "l_extendedprice")
    return ordering.global_row_number(l, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], F.expr("l_orderkey div 500"), "place").select("l_orderkey", "l_linenumber", "place")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def o5_offset(spark, d):
    return read(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(25)


@query("SELECT o_orderkey FROM orders WHERE (o_totalprice BETWEEN 1000 AND 200000 AND o_orderpriority IN ('1-URGENT', '3-MEDIUM') OR NULLIF(o_orderstatus, 'O') IS NULL) AND (o_orderkey << 2) % 3 <> 1 AND o_orderpriority ILIKE '%u%'")
def p19_predicates(spark, d):
    o = read(spark, d, "orders")
    either = (F.col("o_totalprice").between(1000, 200_000) & F.col("o_orderpriority").isin("1-URGENT", "3-MEDIUM")) | F.nullif(F.col("o_orderstatus"), F.lit("O")).isNull()
    return o.where(either & (F.shiftleft("o_orderkey", 2) % 3 != 1) & F.col("o_orderpriority").ilike("%u%")).select("o_orderkey")


PRAGMAS = [("PRAGMA journal_mode = WAL;", "journal_mode", "WAL"), (" /* x */ pragma main.synchronous(full)", "synchronous", "full"), ("PRAGMA auto_vacuum", "auto_vacuum", None), ("UPDATE t SET a = 1", None, None), ("PRAGMA auto_vacuum='incremental'", "auto_vacuum", "incremental"), ("PRAGMA auto_vacuum=2", "auto_vacuum", "2")]


@query("WITH p AS (SELECT o_orderkey, o_orderkey % 6 AS i FROM orders) SELECT o_orderkey, CASE " + " ".join(f"WHEN i = {i} THEN '{n}'" for i, (_, n, _) in enumerate(PRAGMAS) if n) + " END AS name, CASE " + " ".join(f"WHEN i = {i} THEN '{v}'" for i, (_, _, v) in enumerate(PRAGMAS) if v) + " END AS value, CASE WHEN i NOT IN (2, 3) THEN i = 0 END AS none FROM p")
def p17_pragmas(spark, d):
    texts = F.array(*[F.lit(t) for t, _, _ in PRAGMAS])
    said = statements.pragma(F.get(texts, (F.col("o_orderkey") % 6).cast("int")))
    rows = read(spark, d, "orders").select("o_orderkey", said.alias("p"))
    return rows.select("o_orderkey", "p.name", "p.value", statements.no_auto_vacuum(F.col("p.value")).alias("none"))


@query(f"SELECT o_orderkey, '{scalars.version()}' AS version, {scalars.version_number()} AS number, CASE WHEN o_orderkey > 0 THEN 100.0::DOUBLE * o_custkey / o_orderkey ELSE 0 END AS percent FROM orders")
def api10_registered_functions(spark, d):
    scalars.register(spark)
    return spark.sql("SELECT o_orderkey, epochal_version() AS version, epochal_version_number() AS number, epochal_percent(o_custkey, o_orderkey) AS percent FROM {o}", o=read(spark, d, "orders"))


@query(f"SELECT '{scalars.version()}' AS version, 2000 AS number, count(*) AS orders FROM orders")
def f1_version(spark, d):
    return read(spark, d, "orders").agg(F.lit(scalars.version()).alias("version"), F.lit(scalars.version_number()).alias("number"), F.count("*").alias("orders"))


@query("""WITH a AS (SELECT o_orderkey, (o_orderkey + 1)::HUGEINT AS x FROM orders), b AS (SELECT o_orderkey, xor(x, x * 8192 % 18446744073709551616) AS x FROM a), c AS (SELECT o_orderkey, xor(x, x // 128) AS x FROM b), e AS (SELECT o_orderkey, xor(x, x * 131072 % 18446744073709551616) AS x FROM c)
  SELECT o_orderkey, (CASE WHEN x >= 9223372036854775808 THEN x - 18446744073709551616 ELSE x END)::BIGINT AS shifted, (o_orderkey * 1103515245 + 12345) & 2147483647 AS linear, round(-20.0::DOUBLE * ln((o_orderkey % 1000 + 1) / 1001.0::DOUBLE), 6) AS draw FROM e""")
def f11_random_numbers(spark, d):
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", scalars.xorshift(k + 1).alias("shifted"), scalars.linear_congruential(k).alias("linear"), F.round(scalars.exponential((k % 1000 + 1) / 1001.0, 20.0), 6).alias("draw"))


@query("SELECT p_partkey, replace(replace(replace(p_name || '?' || p_brand || '%' || p_partkey, '%', '%25'), '?', '%3F'), '#', '%23') AS uri FROM part")
def f14_uri_escape(spark, d):
    return read(spark, d, "part").select("p_partkey", scalars.uri_escaped(F.concat("p_name", F.lit("?"), "p_brand", F.lit("%"), F.col("p_partkey").cast("string"))).alias("uri"))


@query("SELECT p_partkey, length(p_name) AS n, hex(p_name) AS bytes, replace(p_name, 'widget', 'w') AS short, lpad(p_partkey::VARCHAR, 6, '0') AS padded, repeat('00', (p_partkey % 4)::INT) AS zeros, p_name ILIKE 'C%' AS c FROM part")
def f16_strings(spark, d):
    p = read(spark, d, "part")
    return p.select("p_partkey", F.length("p_name").cast("long").alias("n"), F.hex("p_name").alias("bytes"), F.replace("p_name", F.lit("widget"), F.lit("w")).alias("short"), F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("padded"), F.repeat(F.lit("00"), (F.col("p_partkey") % 4).cast("int")).alias("zeros"), F.col("p_name").ilike("C%").alias("c"))


@query("SELECT o_orderkey, trunc((o_custkey - 50) / 7)::BIGINT AS quotient, (o_orderstatus = 'F' AND o_custkey > 20)::INT AS truth, coalesce(nullif(o_orderstatus, 'O'), 'open') AS status, greatest(o_custkey, o_orderkey) AS larger, CASE WHEN o_orderkey % 3 = 0 THEN 'integer' WHEN o_orderkey % 3 = 1 THEN 'real' ELSE 'null' END AS kind FROM orders")
def f17_scalars(spark, d):
    from ..operators.diff import tagged

    o = read(spark, d, "orders").withColumn("a", F.col("o_custkey") - 50).withColumn("seven", F.lit(7))
    value = F.when(F.col("o_orderkey") % 3 == 0, tagged(F.col("o_custkey"), "int")).when(F.col("o_orderkey") % 3 == 1, tagged(F.col("o_totalprice"), "real")).otherwise(tagged(F.lit(None).cast("string"), "text"))
    return o.select("o_orderkey", scalars.whole_quotient("a", "seven").alias("quotient"), scalars.as_number((F.col("o_orderstatus") == "F") & (F.col("o_custkey") > 20)).alias("truth"), F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("O")), F.lit("open")).alias("status"), F.greatest("o_custkey", "o_orderkey").alias("larger"), scalars.type_name(value).alias("kind"))


@query("SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS suppliers, count(*) FILTER (l_returnflag = 'R') AS returned, list_contains(list(l_linenumber), 2) AS has_second, list_max(list(l_partkey)) AS last_part FROM lineitem GROUP BY 1")
def f18_arrays_and_maps(spark, d):
    counts = read(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"), F.collect_set("l_suppkey").alias("s"), F.collect_set("l_linenumber").alias("lines"), F.max("l_partkey").alias("p"))
    whole = counts.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("m"), F.array_distinct(F.flatten(F.collect_list("s"))).alias("s"), F.flatten(F.collect_list("lines")).alias("lines"), F.collect_list("p").alias("p"))
    return whole.select("l_orderkey", F.array_join(F.sort_array("s"), ",").alias("suppliers"), F.coalesce(F.try_element_at("m", F.lit("R")), F.lit(0)).alias("returned"), F.array_contains("lines", 2).alias("has_second"), F.array_max("p").alias("last_part"))


@query("SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY ALL")
def st1_sliding_windows(spark, d):
    e = read(spark, d, "events").groupBy(F.window("ts", "2 hours", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.col("window.start").alias("start"), "event_type", "n")


@query("WITH g AS (SELECT user_id, ts, (coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts), INTERVAL 1 DAY) >= INTERVAL 40 MINUTE)::INT AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s")
def st1_sessions(spark, d):
    e = read(spark, d, "events").groupBy("user_id", F.session_window("ts", "40 minutes")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("session_window.start").alias("start"), "n")
