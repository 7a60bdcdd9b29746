"""Queries of how transactions begin, commit, are merged and are counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import packing
from ..history import History
from ..model import Catalog, ForeignKey, Options, TableSpec
from ..operators import audit, ordering, rebase, recovery, schema, snapshot, stats, structure, validate
from ..sources import commit_log
from ..sources.scratch import shared_dir
from .history import SQL as H
from .history import derived, read
from .queries import EDGES, SEGMENTS, TABLES, log_of, sized, tree, writers
from .registry import query

# --- the way of a commit

#: Every transaction's conflict and outcome, by the rules as they are written down.
LADDER = """w AS (SELECT * FROM t WHERE kind <> 'view'), x AS (SELECT commit_epoch AS e FROM t WHERE tx_id % 500 = 3),
  o AS (SELECT a.*, greatest(snapshot_epoch, coalesce((SELECT max(b.commit_epoch) FROM w b WHERE b.writer_id = a.writer_id AND b.page = a.rpage AND b.commit_epoch < a.commit_epoch), 0)) AS own_read,
    greatest(snapshot_epoch, coalesce((SELECT max(b.commit_epoch) FROM w b WHERE b.writer_id = a.writer_id AND b.k = a.k AND b.commit_epoch < a.commit_epoch), 0)) AS own_row,
    greatest(snapshot_epoch, coalesce((SELECT max(b.commit_epoch) FROM w b WHERE b.writer_id = a.writer_id AND b.page = a.page AND b.commit_epoch < a.commit_epoch), 0)) AS own_page FROM t a),
  v AS (SELECT o.*, kind <> 'view' AND rpage <> page AND EXISTS (SELECT 1 FROM w b WHERE b.page = o.rpage AND b.commit_epoch > o.own_read AND b.commit_epoch < o.commit_epoch) AS r,
    kind <> 'view' AND EXISTS (SELECT 1 FROM w b WHERE b.k = o.k AND b.commit_epoch > o.own_row AND b.commit_epoch < o.commit_epoch) AS u,
    kind <> 'view' AND EXISTS (SELECT 1 FROM w b WHERE b.page = o.page AND b.commit_epoch > o.own_page AND b.commit_epoch < o.commit_epoch) AS p,
    EXISTS (SELECT 1 FROM x WHERE x.e > o.snapshot_epoch AND x.e < o.commit_epoch) AS s FROM o),
  c AS (SELECT *, CASE WHEN kind = 'view' THEN NULL WHEN r AND {read_check} THEN 'read' WHEN p THEN 'page' WHEN s THEN 'schema' END AS conflict FROM v),
  l AS (SELECT *, CASE WHEN conflict IS NULL THEN 'committed' WHEN conflict = 'page' AND tx_id % 10 = 1 AND {relocation} THEN 'relocated'
    WHEN conflict IN ('read', 'page') AND tx_id % 7 <> 0 AND tx_id % 5 <> 0 AND NOT u AND NOT s THEN 'rebased' ELSE 'refused' END AS outcome FROM c)"""
WHOLE = LADDER.format(read_check="rpage % 3 <> 0", relocation="TRUE")


def told(spark, d) -> DataFrame:
    """The history with what the ladder asks for besides."""
    t = derived(spark, d).withColumns({"rebase_on": F.lit(True), "first_commit": F.col("tx_id") % 7 != 0, "in_backoff": F.lit(False), "has_ddl": F.lit(False), "header_changed": F.lit(False), "catalog_reason": F.lit(None).cast("string")})
    return rebase.eligible(t).withColumns({"growth_only": F.col("tx_id") % 10 == 1, "dependent": F.col("tx_id") % 5 == 0, "attempts": F.col("tx_id") % 4 + 1})


def ddl_of(spark, d) -> DataFrame:
    return derived(spark, d).where("tx_id % 500 = 3").select("commit_epoch")


def forgiven(spark, d) -> DataFrame:
    return derived(spark, d).where("rpage % 3 = 0").select("tx_id")


def history(spark, d, options: Options = Options()) -> History:
    log = sized(spark, d).select("epoch", "bytes", (F.col("tx_id") % 40 == 7).alias("synced"))
    return History(told(spark, d), log, ddl_of(spark, d), options, base_epoch=500)


@query(f"WITH {H}, {WHOLE} SELECT tx_id, conflict, outcome FROM l")
def v12_commit_ladder(spark, d):
    return validate.ladder(told(spark, d), ddl_of(spark, d), forgiven(spark, d))


@query(f"WITH {H}, {LADDER.format(read_check='FALSE', relocation='FALSE')} SELECT tx_id, conflict, outcome FROM l")
def api2_options_obeyed(spark, d):
    return history(spark, d, Options.parse({"read_check": "off", "relocation": "no"})).outcomes()


@query(f"WITH {H}, {LADDER.format(read_check='TRUE', relocation='TRUE')} SELECT tx_id, writer_id, snapshot_epoch, CASE WHEN kind <> 'view' AND outcome <> 'refused' THEN commit_epoch ELSE 0 END AS commit_epoch, CASE WHEN kind <> 'view' AND outcome = 'refused' THEN 'ABORTED' ELSE 'COMMITTED' END AS state, kind <> 'view' AS is_writer, (kind <> 'view')::INT AS ws_pages FROM l")
def api1_tx_info(spark, d):
    return history(spark, d).tx_info()


@query(f"WITH {H} SELECT tx_id, page FROM h WHERE kind <> 'view'")
def api1_write_set(spark, d):
    return history(spark, d).write_set()


@query(f"WITH {H}, v AS (SELECT page, commit_epoch, lead(commit_epoch) OVER (PARTITION BY page ORDER BY commit_epoch) AS next_epoch FROM h WHERE kind <> 'view') SELECT * FROM v WHERE next_epoch <= 300 OR next_epoch IS NULL AND commit_epoch <= 300")
def g1s_reclaimable_after_compaction(spark, d):
    return snapshot.reclaimable(writers(spark, d).select("page", "commit_epoch"), "page", 300, 500)


@query(f"""WITH RECURSIVE {H}, {WHOLE}, {SEGMENTS.format(limit=4_194_304)},
  lived AS (SELECT page, commit_epoch, lead(commit_epoch) OVER (PARTITION BY page ORDER BY commit_epoch) AS nx FROM w),
  a AS (SELECT count(*) FILTER (outcome <> 'refused' AND kind <> 'view') AS commits, count(*) FILTER (outcome = 'refused') AS aborts, count(*) FILTER (kind = 'view') AS read_only,
    count(*) FILTER (conflict = 'schema') AS schema_conflicts, count(*) FILTER (conflict = 'read') AS read_conflicts, count(*) FILTER (conflict = 'page') AS page_conflicts,
    count(*) FILTER (kind <> 'view' AND conflict IS NULL) AS fast_commits, count(*) FILTER (outcome = 'relocated') AS relocations, count(*) FILTER (outcome = 'rebased') AS rebases,
    coalesce(sum(tx_id % 4) FILTER (outcome = 'rebased'), 0)::BIGINT AS rebase_retries, count(*) FILTER (outcome = 'refused') AS unrebasable, count(*) FILTER (rpage % 3 = 0) AS reads_saved,
    count(*) FILTER (outcome = 'rebased' AND tx_id % 4 = 0) AS rebases_grouped, coalesce(max(tx_id % 4 + 1) FILTER (outcome = 'rebased'), 0) AS rebase_max_attempts,
    count(*) FILTER (tx_id % 500 = 3) AS schema_generation, coalesce(max(commit_epoch) FILTER (tx_id % 500 = 3), 0) AS last_schema_epoch, count(*) FILTER (tx_id % 500 = 3) AS ddl_barriers,
    count(*) FILTER (snapshot_epoch >= 400) AS snapshot_count, min(snapshot_epoch) FILTER (snapshot_epoch >= 400) AS oldest_active_snapshot FROM l),
  z AS (SELECT max(commit_epoch) AS epoch, count(*) AS versions_allocated, count(*) FILTER (nx <= 400) AS versions_reclaimed, count(DISTINCT page) FILTER (commit_epoch <= 500) AS compacted_pages FROM lived)
  SELECT a.*, z.*, versions_allocated - versions_reclaimed AS page_versions, versions_allocated AS pages_published, (versions_allocated - versions_reclaimed) * 4096 AS bytes_retained, 500::BIGINT AS base_epoch, greatest(epoch - 500, 0) AS compaction_backlog,
    (SELECT sum(bytes)::BIGINT FROM b WHERE b.epoch > 500) AS log_bytes, (SELECT count(*) FROM h WHERE tx_id % 40 = 7) AS log_syncs, (SELECT max(segment) FROM s) AS compactions FROM a, z""")
def api7_db_stats(spark, d):
    return history(spark, d).db_stats(400, forgiven(spark, d))


@query(f"WITH {H}, p AS (SELECT commit_epoch, commit_epoch * 10 + 25 AS at FROM h WHERE kind <> 'view'), q AS (SELECT tx_id, commit_epoch * 10 AS at FROM h WHERE kind = 'view') SELECT q.tx_id, q.at, coalesce(p.commit_epoch, 1) AS snapshot_epoch FROM q ASOF LEFT JOIN p ON q.at >= p.at")
def v1_snapshot_begin(spark, d):
    t = derived(spark, d)
    published = t.where("kind <> 'view'").select("commit_epoch", (F.col("commit_epoch") * 10 + 25).alias("visible_at"))
    return validate.begun(t.where("kind = 'view'").select("tx_id", (F.col("commit_epoch") * 10).alias("at")), published, width=1000)


@query(f"WITH {H} SELECT page, commit_epoch, tx_id FROM h WHERE kind <> 'view' AND commit_epoch <= 4500 AND (commit_epoch > 3500 OR tx_id % 5 <> 0)")
def v9_installed_versions(spark, d):
    w = writers(spark, d).select("page", "commit_epoch", "tx_id")
    chains = w.where("commit_epoch <= 4000 and (tx_id % 5 <> 0 or commit_epoch > 3900)")
    return snapshot.installed(chains, w.where("commit_epoch > 3500 and commit_epoch <= 4500"), "page")


@query(f"WITH {H}, x AS (SELECT commit_epoch AS e FROM h WHERE tx_id % 500 = 3) SELECT tx_id, kind <> 'view' AND EXISTS (SELECT 1 FROM x WHERE x.e > t.snapshot_epoch AND x.e < t.commit_epoch) AS stale FROM t")
def v15_stale_schema(spark, d):
    return validate.stale(derived(spark, d), ddl_of(spark, d), width=500).select("tx_id", "stale")


@query(f"WITH {H}, f AS (SELECT min(commit_epoch) FILTER (tx_id % 640 = 639) AS first, max(commit_epoch) AS last FROM h) SELECT commit_epoch AS epoch, CASE WHEN first IS NULL OR commit_epoch < first THEN 'installed' WHEN first = last THEN 'undone' ELSE 'lost' END AS state FROM h, f")
def v17_after_failed_append(spark, d):
    return recovery.after_failures(derived(spark, d).select(F.col("commit_epoch").alias("epoch"), (F.col("tx_id") % 640 == 639).alias("failed"))).select("epoch", "state")


@query(f"""WITH {H}, o AS (SELECT writer_id * 1000000 + commit_epoch // 200 AS g, commit_epoch AS seq, kind FROM h), m AS (SELECT r.g, r.seq, max(p.seq) AS mark FROM o r JOIN o p ON p.g = r.g AND p.kind = 'signup' AND p.seq < r.seq WHERE r.kind = 'error' GROUP BY 1, 2)
  SELECT g AS tx_id, seq FROM o WHERE kind NOT IN ('signup', 'error') AND NOT EXISTS (SELECT 1 FROM m WHERE m.g = o.g AND m.mark < o.seq AND o.seq < m.seq)""")
def v18_savepoints(spark, d):
    op = F.when(F.col("kind") == "signup", "savepoint").when(F.col("kind") == "error", "rollback").otherwise("change")
    t = derived(spark, d)
    return validate.kept_operations(t.select((F.col("writer_id") * 1_000_000 + F.expr("commit_epoch div 200")).alias("tx_id"), F.col("commit_epoch").alias("seq"), op.alias("op"), F.lit("s").alias("name")))


@query(f"WITH {H}, w AS (SELECT page, commit_epoch, tx_id FROM h WHERE kind <> 'view') SELECT a.tx_id, a.rpage AS page, a.snapshot_epoch, coalesce(w.tx_id, CASE WHEN a.rpage <> 5 THEN -a.rpage END) AS image, coalesce(w.commit_epoch, CASE WHEN a.rpage <> 5 THEN 0 END) AS read_epoch FROM t a ASOF LEFT JOIN w ON w.page = a.rpage AND a.snapshot_epoch >= w.commit_epoch")
def s1_page_reads(spark, d):
    t = derived(spark, d)
    base = t.select(F.col("rpage").alias("page")).distinct().where("page <> 5").withColumn("image", -F.col("page"))
    versions = t.where("kind <> 'view'").select("page", "commit_epoch", F.col("tx_id").alias("image"))
    return snapshot.read_pages(t.select("tx_id", F.col("rpage").alias("page"), "snapshot_epoch"), base, versions, "page", "image", width=900)


@query(f"WITH {H} SELECT k, commit_epoch, cents FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY commit_epoch DESC) AS r FROM h WHERE kind <> 'view' AND commit_epoch <= 5000) WHERE r = 1 AND kind <> 'error'")
def s22_copy_of_a_snapshot(spark, d):
    import uuid

    w = writers(spark, d).select("k", "commit_epoch", "kind", "cents")
    return snapshot.copied(w, ["k"], 5000, F.col("kind") == "error", f"{shared_dir(spark)}/copy-{uuid.uuid4().hex}").drop("kind")


@query(f"WITH {H}, l AS (SELECT commit_epoch, tx_id, min((tx_id % 997 <> 500)::INT) OVER (ORDER BY commit_epoch) AS ok FROM h WHERE commit_epoch > 100) SELECT commit_epoch AS epoch, tx_id FROM l WHERE ok = 1")
def s9_log_written_twice(spark, d):
    import uuid

    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    commit_log.write_manifest(spark, path, 100)
    log = recovery.segments(sized(spark, d), 40_000_000)
    for batch, part in (("a", "epoch % 2 = 0"), ("b", "epoch % 2 = 1"), ("a", "epoch % 2 = 0")):
        commit_log.append(log.where(part), path, batch)
    return commit_log.read(spark, path).select("epoch", "tx_id")


@query("SELECT o_custkey AS n, o_orderpriority AS variant, count(*) AS lines, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders GROUP BY 1, 2")
def s16_reports(spark, d):
    import uuid

    from ..sources import reports

    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("n"), F.col("o_orderpriority").alias("variant")).agg(F.count("*").alias("lines"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    reports.write_csv(o, path)
    return spark.read.schema("n long, variant string, lines long, cents long").option("header", True).csv(path)


FAULTS = {"none": None, "torn": 699, "missing": 699, "short": 699, "repeated": None, "flipped": 699}


@query(f"WITH {H} " + " UNION ALL ".join(f"SELECT '{f}' AS fault, {f'{e}::BIGINT' if e else '(SELECT max(commit_epoch) FROM h)'} AS recovered_epoch" for f, e in FAULTS.items()))
def api6_faults(spark, d):
    log = log_of(spark, d, torn=False)
    each = [recovery.recovered_epoch(recovery.valid_records(recovery.with_fault(log, f, 700)), 1).select(F.lit(f).alias("fault"), "recovered_epoch") for f in recovery.FAULTS]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


# --- merging


@query(f"WITH {H}, k AS (SELECT tx_id, ['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem'][k % 7 + 1] AS tbl FROM h WHERE kind <> 'view') SELECT tx_id, tbl, CASE WHEN tbl = 'part' THEN 'refers to itself' WHEN tbl IN ('nation', 'supplier') THEN 'circle of keys' END AS catalog_reason FROM k")
def b2_catalog_reasons(spark, d):
    keys = [ForeignKey(c, "x", p, "y") for c, p in [*EDGES, ("part", "part"), ("nation", "supplier")]]
    catalog = Catalog([TableSpec.of(t, read(spark, d, t).schema, (read(spark, d, t).columns[0],)) for t in TABLES], keys)
    names = F.array(*[F.lit(t) for t in TABLES])
    return writers(spark, d).select("tx_id", F.get(names, (F.col("k") % 7).cast("int")).alias("tbl")).join(F.broadcast(catalog.reasons(spark)), "tbl").select("tx_id", "tbl", "catalog_reason")


@query("""WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3), o AS (SELECT o_orderkey, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM c) THEN o_custkey END AS o_custkey FROM orders WHERE o_orderkey % 50 <> 0),
  l AS (SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 = 0)), s AS (SELECT s_suppkey FROM supplier WHERE s_nationkey = 4)
  SELECT 'customer' AS tbl, count(*) AS n, 0::BIGINT AS nulls FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 'orders', count(*), count(*) - count(o_custkey) FROM o UNION ALL SELECT 'lineitem', count(*), 0 FROM l
  UNION ALL SELECT 'supplier', count(*), 0 FROM supplier WHERE s_nationkey <> 4 UNION ALL SELECT 'refused', count(*), 0 FROM l WHERE l_suppkey IN (SELECT s_suppkey FROM s)""")
def b14_keys_act_in_replay(spark, d):
    lines = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("l_id"), "l_orderkey", "l_suppkey")
    tables = {"customer": read(spark, d, "customer").select("c_custkey", "c_nationkey"), "orders": read(spark, d, "orders").select("o_orderkey", "o_custkey"), "lineitem": lines, "supplier": read(spark, d, "supplier").select("s_suppkey", "s_nationkey")}
    own = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_id", "supplier": "s_suppkey"}
    keys = [ForeignKey("orders", "o_custkey", "customer", "c_custkey", "set null"), ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey", "cascade"), ForeignKey("lineitem", "l_suppkey", "supplier", "s_suppkey", "no action")]
    gone = {"customer": tables["customer"].where("c_nationkey = 3").select("c_custkey"), "orders": tables["orders"].where("o_orderkey % 50 = 0").select("o_orderkey"), "supplier": tables["supplier"].where("s_nationkey = 4").select("s_suppkey")}
    left, refused = schema.after_deletes(tables, keys, own, gone)
    out = refused.agg(F.lit("refused").alias("tbl"), F.count("*").alias("n"), F.lit(0).cast("long").alias("nulls"))
    for t, rows in left.items():
        nulls = F.count("*") - F.count("o_custkey") if t == "orders" else F.lit(0).cast("long")
        out = out.unionByName(rows.agg(F.lit(t).alias("tbl"), F.count("*").alias("n"), nulls.alias("nulls")))
    return out


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_orderkey % 9 = 0 OR l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0) AS ok FROM lineitem")
def b14_written_children(spark, d):
    changes = read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.when(F.col("l_orderkey") % 9 != 0, F.col("l_orderkey")).alias("parent"))
    return schema.orphans(changes, "parent", read(spark, d, "orders").where("o_orderkey % 7 <> 0"), "o_orderkey").select("l_orderkey", "l_linenumber", "ok")


POLICIES = """WITH i AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 2 * (o_orderkey + 1) ELSE 2 * o_orderkey + 1 END AS u, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS n FROM orders WHERE o_orderkey % 7 = 0),
  c AS (SELECT o_orderkey AS k, 2 * o_orderkey AS u FROM orders WHERE o_orderkey % 3 <> 0),
  j AS (SELECT i.*, EXISTS (SELECT 1 FROM c WHERE c.k = i.k) OR EXISTS (SELECT 1 FROM c WHERE c.u = i.u) AS taken, EXISTS (SELECT 1 FROM c WHERE c.k = i.k AND c.k % 11 = 0) OR EXISTS (SELECT 1 FROM c WHERE c.u = i.u AND c.k % 11 = 0) AS touched FROM i)"""


@query(f"""{POLICIES} SELECT 'replace' AS policy, k, u, coalesce(n, 'D') AS n, CASE WHEN taken AND touched THEN 'refused' WHEN taken THEN 'replaced' ELSE 'inserted' END AS outcome FROM j
  UNION ALL SELECT 'ignore', k, u, n, CASE WHEN n IS NULL OR taken THEN 'ignored' ELSE 'inserted' END FROM j UNION ALL SELECT 'abort', k, u, n, CASE WHEN n IS NULL OR taken THEN 'refused' ELSE 'inserted' END FROM j""")
def b17_conflict_clauses(spark, d):
    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    inserts = o.where("o_orderkey % 7 = 0").select(k.alias("k"), F.when(k % 2 == 0, 2 * (k + 1)).otherwise(2 * k + 1).alias("u"), F.when(k % 4 != 0, F.col("o_orderstatus")).alias("n"))
    current = o.where("o_orderkey % 3 <> 0").select(k.alias("k"), (2 * k).alias("u"))
    out = None
    for policy in ("replace", "ignore", "abort"):
        one = rebase.with_policy(inserts, current, "k", ["u", "n"], "u", policy, "n", "D", current.where("k % 11 = 0")).withColumn("policy", F.lit(policy))
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH cur AS (SELECT o_orderkey AS k, o_orderkey AS u, CASE WHEN o_orderkey % 9 = 2 THEN 'Z' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 9 <> 1 UNION ALL SELECT o_orderkey + 10000000, o_orderkey + 40000000, 'N' FROM orders WHERE o_orderkey % 9 = 3),
  ch AS (SELECT o_orderkey AS k, 2 AS kind, o_orderkey AS u, o_orderkey AS old_u, o_orderstatus AS old_s FROM orders WHERE o_orderkey % 4 = 0
    UNION ALL SELECT o_orderkey + 10000000, 1, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey - 1 WHEN o_orderkey % 5 = 1 THEN 30000000 + o_orderkey // 100 ELSE 20000000 + o_orderkey END, NULL, NULL FROM orders WHERE o_orderkey % 4 = 1),
  a AS (SELECT ch.*, CASE WHEN kind = 1 THEN m.k IS NULL ELSE m.k IS NOT NULL AND m.u = old_u AND m.s = old_s END AND (h.k IS NULL OR h.k = ch.k) AS fits FROM ch LEFT JOIN cur m ON m.k = ch.k LEFT JOIN cur h ON h.u = ch.u),
  f AS (SELECT u, min(k) AS first FROM a WHERE fits GROUP BY u) SELECT a.k, kind::BIGINT AS kind, fits AND (first IS NULL OR first = a.k) AS ok FROM a LEFT JOIN f ON f.u = a.u""")
def b15_conflict_matrix(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    k = F.col("k")
    now = o.where("k % 9 <> 1").select("k", k.alias("u"), F.when(k % 9 == 2, "Z").otherwise(F.col("s")).alias("s")).unionByName(o.where("k % 9 = 3").select((k + 10_000_000).alias("k"), (k + 40_000_000).alias("u"), F.lit("N").alias("s")))
    row = lambda u, s: F.struct(u.alias("u"), s.alias("s"))
    updates = o.where("k % 4 = 0").select("k", F.lit(2).alias("kind"), row(k, F.col("s")).alias("old"), row(k, F.lit("Q")).alias("new"))
    u = F.when(k % 5 == 0, k - 1).when(k % 5 == 1, F.expr("30000000 + k div 100")).otherwise(k + 20_000_000)
    inserts = o.where("k % 4 = 1").select((k + 10_000_000).alias("k"), F.lit(1).alias("kind"), F.lit(None).cast("struct<u:bigint,s:string>").alias("old"), row(u, F.lit("I")).alias("new"))
    return rebase.replayable(updates.unionByName(inserts), now, ["k"], ["u", "s"], ["u"]).select("k", F.col("kind").cast("long").alias("kind"), "ok")


@query(f"""WITH {H}, z AS (SELECT tx_id, (tx_id % 17 = 0)::INT AS own, 100 + snapshot_epoch % 50 AS a, 100 + snapshot_epoch % 50 + cents % 4 AS b, cents % 4 + (tx_id % 13 = 0)::INT AS nn, 100 + snapshot_epoch % 50 + writer_id % 3 - (tx_id % 41 = 0)::INT AS hs FROM t)
  SELECT tx_id, CASE WHEN own <> 0 OR b <= a THEN 1 WHEN tx_id % 19 = 0 OR nn <> b - a THEN 2 WHEN tx_id % 23 = 0 THEN 3 WHEN tx_id % 29 = 0 THEN 4 WHEN tx_id % 31 = 0 THEN 5 WHEN tx_id % 37 = 0 OR hs < a THEN 6 WHEN hs = a THEN 7 WHEN tx_id % 43 = 0 THEN 9
    WHEN a < 130 AND b >= 130 OR hs < 130 AND hs + b - a >= 130 THEN 8 END AS reason FROM z""")
def x1c_relocation_reasons(spark, d):
    n = F.col("tx_id")
    before = 100 + F.col("snapshot_epoch") % 50
    t = derived(spark, d).select("tx_id", (n % 17 == 0).cast("int").alias("own_commits"), before.alias("size_before"), (before + F.col("cents") % 4).alias("size_after"), (F.col("cents") % 4 + (n % 13 == 0).cast("int")).alias("new_pages"), (n % 19 != 0).alias("writes_first"), (n % 23 != 0).alias("first_read"), (n % 29 == 0).alias("first_differs"), (n % 31 != 0).alias("head_read"), (n % 37 != 0).alias("head_sound"), (before + F.col("writer_id") % 3 - (n % 41 == 0).cast("int")).alias("head_size"), (n % 43 == 0).alias("real_conflict"))
    return structure.relocation_reason(t, 130).select("tx_id", "reason")


@query("""WITH b AS (SELECT o_orderkey // 50 AS page, o_orderkey AS child, CASE WHEN o_orderkey % 50 <> 49 THEN o_orderkey * 10 END AS upper FROM orders), n AS (SELECT page, child, CASE WHEN child % 33 = 0 THEN upper + 1 ELSE upper END AS upper FROM b WHERE child % 71 <> 5),
  x AS (SELECT page, child, upper, lag(upper) OVER (PARTITION BY page ORDER BY upper NULLS LAST) AS lower FROM b), y AS (SELECT page, child, upper, lag(upper) OVER (PARTITION BY page ORDER BY upper NULLS LAST) AS lower FROM n),
  s AS (SELECT x.child // 7 AS tx_id, y.child IS NOT NULL AND x.upper IS NOT DISTINCT FROM y.upper AND x.lower IS NOT DISTINCT FROM y.lower AS same FROM x LEFT JOIN y USING (page, child)) SELECT tx_id FROM s GROUP BY 1 HAVING bool_and(same)""")
def x2_forgiven_reads(spark, d):
    old = tree(spark, d)
    new = old.where("child % 71 <> 5").withColumn("upper", F.when(F.col("child") % 33 == 0, F.col("upper") + 1).otherwise(F.col("upper")))
    return structure.forgiven_reads(old.select(F.expr("child div 7").alias("tx_id"), "page", "child"), old, new)


# --- audits


@query(f"WITH {H}, i AS (SELECT *, coalesce(sum((kind = 'error')::INT) OVER (PARTITION BY k ORDER BY commit_epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS inc FROM h) SELECT tx_id, coalesce(sum(CASE WHEN kind = 'purchase' THEN cents ELSE 0 END) OVER (PARTITION BY k, inc ORDER BY commit_epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM i QUALIFY tx_id % 77 = 0")
def q1_unexplained_reads(spark, d):
    delta = F.when(F.col("kind") == "purchase", F.col("cents")).otherwise(0)
    t = derived(spark, d)
    seen = audit.value_before(t, "k", ["commit_epoch"], F.col("kind") == "error", delta).withColumn("seen", F.col("before") + (F.col("tx_id") % 77 == 0).cast("int")).drop("inc", "before")
    return audit.unexplained(seen, "k", ["commit_epoch"], F.col("kind") == "error", delta, "seen").select("tx_id", "before")


@query(f"WITH {H}, d AS (SELECT tx_id, snapshot_epoch, commit_epoch + 20 AS upto, commit_epoch FROM t WHERE tx_id % 37 = 0) SELECT g.commit_epoch AS epoch, list_sort(list(d.tx_id))::VARCHAR AS candidates FROM d g JOIN d ON g.commit_epoch > d.snapshot_epoch AND g.commit_epoch <= d.upto GROUP BY 1")
def q4_candidates(spark, d):
    t = derived(spark, d).where("tx_id % 37 = 0")
    found = audit.placements(t.select(F.col("commit_epoch").alias("epoch")), t.select("tx_id", "snapshot_epoch", (F.col("commit_epoch") + 20).alias("upto")), width=500)
    return found.select("epoch", F.concat(F.lit("["), F.array_join("candidates", ", "), F.lit("]")).alias("candidates"))


@query(f"WITH {H} SELECT p.tx_id AS point, t.tx_id FROM h p JOIN t ON p.commit_epoch BETWEEN t.snapshot_epoch AND t.commit_epoch WHERE p.tx_id % 50 = 3")
def j13_interval_join(spark, d):
    t = derived(spark, d)
    points = t.where("tx_id % 50 = 3").select(F.col("tx_id").alias("point"), F.col("commit_epoch").alias("at"))
    return ordering.interval_join(points, t.select("tx_id", "snapshot_epoch", "commit_epoch"), "at", "snapshot_epoch", "commit_epoch", width=100).select("point", "tx_id")


@query(f"WITH {H} SELECT writer_id, round(100.0::DOUBLE * sum((kind = 'purchase')::INT) / count(*), 6) AS merged_percent, CASE WHEN sum((kind = 'purchase')::INT) > 0 THEN round(sum(cents % 3)::DOUBLE / sum((kind = 'purchase')::INT), 6) END AS lost_per_merge FROM h GROUP BY 1")
def a4_merged_share(spark, d):
    runs = derived(spark, d).select("writer_id", F.lit(1).alias("transactions"), (F.col("kind") == "purchase").cast("int").alias("merged"), (F.col("cents") % 3).alias("lost"))
    return stats.merged_share(runs, ["writer_id"])


# --- the schema


@query("""SELECT * FROM (SELECT 'not null status' AS "constraint", count(*) FILTER (o_orderkey % 30 = 0) AS n FROM orders UNION ALL SELECT 'check price', count(*) FILTER (o_totalprice <= 2000) FROM orders UNION ALL SELECT 'primary key', count(*) - count(DISTINCT o_orderkey // 3) FROM orders
  UNION ALL SELECT 'unique cust', count(c) - count(DISTINCT c) FROM (SELECT CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS c FROM orders)) WHERE n > 0""")
def h5_constraints(spark, d):
    o = read(spark, d, "orders").select(F.expr("o_orderkey div 3").alias("key"), F.when(F.col("o_orderkey") % 30 != 0, F.col("o_orderstatus")).alias("status"), F.col("o_totalprice").alias("price"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("cust"))
    return schema.violations(o, ["key"], ["status"], {"price": F.col("price") > 2000}, ["cust"])


@query(f"WITH {H} SELECT tx_id, (SELECT count(*) FROM h b WHERE b.tx_id % 500 IN (3, 5) AND b.commit_epoch <= t.snapshot_epoch) AS schema_gen FROM t")
def h7_schema_generations(spark, d):
    t = derived(spark, d)
    n = F.col("tx_id") % 500
    sql = F.when(n == 3, "ALTER TABLE t ADD COLUMN c").when(n == 4, "CREATE TEMP TABLE x (a)").when(n == 5, "VACUUM").otherwise("UPDATE t SET a = 1")
    made = schema.generations(t.select("commit_epoch", sql.alias("sql")), width=500)
    return schema.generation_at(t.select("tx_id", "snapshot_epoch"), made, width=500).select("tx_id", "schema_gen")
