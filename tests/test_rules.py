"""Operators against brute-force versions of their rules, on small and on awkward inputs."""

import random

import pytest
from pyspark.sql import functions as F

from epochal.functions import packing, scalars, statements
from epochal.history import History
from epochal.model import Catalog, ForeignKey, Options, TableSpec
from epochal.operators import audit, diff, ordering, rebase, recovery, schema, snapshot, structure, validate
from epochal.operators.graph import connected_components
from epochal.sources import commit_log
from epochal.streaming import tail


def history_of(spark, n, seed, pages=3):
    rng = random.Random(seed)
    rows = []
    for e in range(2, n + 2):
        rows.append((e * 10, rng.choice(["click", "view", "purchase"]), rng.randrange(4), rng.randrange(pages), rng.randrange(pages), rng.randrange(8), max(1, e - 1 - rng.randrange(6)), e, rng.random() < 0.3, None if rng.random() < 0.7 else "off", rng.random() < 0.3))
    return rows, spark.createDataFrame(rows, "tx_id long, kind string, writer_id long, page long, rpage long, k long, snapshot_epoch long, commit_epoch long, growth_only boolean, reason string, dependent boolean")


def test_long_blanks_and_comments(spark):
    rows = [(" " * 1_000_000 + "select 1", True, False), ("/*" + "*" * 500_000 + "*/" + "-- x\n" * 100_000 + "(select 1)", True, False), ("\n" * 300_000 + "update t set a = 1 where id = 3", False, True), ("/* never closed " + "x" * 500_000, False, False)]
    got = spark.createDataFrame([(q,) for q, _, _ in rows], "q string").select(statements.is_read(F.col("q")), statements.is_point(F.col("q"), F.lit("id"))).collect()
    assert [tuple(r) for r in got] == [(a, b) for _, a, b in rows]


def test_blanks_inside_take_their_length_once(spark):
    import time

    gap = " " * 300_000
    rows = [(f"UPDATE t SET a = 1 WHERE id = 5{gap};{gap}", True), (f"UPDATE t SET a = 1 WHERE id = 5{gap}x", False), (f"UPDATE t SET a = 1 WHERE id = 5{gap}AND{gap}b = 1", False)]
    q = spark.createDataFrame(rows, "q string, want boolean")
    at = time.time()
    got = q.select("want", statements.is_point(F.col("q"), F.lit("id")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    assert time.time() - at < 20


def test_integer_width_of_every_class(spark):
    want = {0: 0, 1: 0, 2: 1, -128: 1, 128: 2, 1 << 15: 3, 1 << 23: 4, (1 << 31) - 1: 4, 1 << 31: 6, -(1 << 47): 6, 1 << 47: 8}
    got = spark.createDataFrame([(v,) for v in want], "v long").select("v", packing.integer_width(F.col("v")).alias("w")).collect()
    assert {r["v"]: r["w"] for r in got} == want


def test_spaces_at_the_front_go_in_runs(spark):
    import time

    tails = ["", "x", "\n x", "\u00a0x ", "-- " + " " * 70]
    rows = [(" " * n + t,) for n in (0, 1, 63, 64, 65, 127, 128, 4095, (1 << 19) - 1, 1 << 19, (1 << 20) + 65, 3 << 20) for t in tails] + [(None,)]
    got = spark.createDataFrame(rows, "q string").select(statements.unspaced(F.col("q")).alias("a"), F.ltrim("q").alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] == [q if q is None else q.lstrip(" ") for q, in rows]

    def took(strip):
        at = time.time()
        spark.range(0, 1500, 1, 2).select(F.max(F.octet_length(strip(F.lpad(F.col("id").cast("string"), 900_000, " " * 1024))))).collect()
        return time.time() - at

    assert min(took(statements.unspaced) for _ in range(3)) < min(took(F.ltrim) for _ in range(3))


def test_statement_kinds_of_any_customer_in_many_tasks(spark, tmp_path):
    import duckdb

    from epochal.plans import queries

    customers = [None, -3, 0, 1, 64, 899_999, (1 << 19) + 63]
    rows = [(i, customers[i % len(customers)]) for i in range(14 * len(customers) * 2)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = queries.QUERIES["p8_statement_kinds"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert sorted(tuple(r) for r in got.collect()) == sorted(duck.execute(queries.ORACLE_SQL["p8_statement_kinds"]).fetchall())
    # The file's orders are the work of many tasks, whatever their customers' numbers.
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_points_by_whole_keys(spark):
    rows = [("UPDATE t SET v = 1 WHERE k1 = 1 AND k2 = 'a'", True), ("DELETE FROM t WHERE K2='a' and k1=1;", True), ("UPDATE t SET v = 1 WHERE k1 = 1", False), ("UPDATE t SET v = 1 WHERE k1 = 1 AND k2 > 'a'", False), ("UPDATE t SET v = 1 WHERE k1 = 1 OR k2 = 'a'", False), ("UPDATE t SET v = 1 WHERE k1 = 1 AND k2 = 'a' AND v = 2", False), (None, None)]
    got = spark.createDataFrame([(q,) for q, _ in rows], "q string").select(statements.is_point(F.col("q"), F.lit("k1"), F.lit("k2"))).collect()
    assert [r[0] for r in got] == [w for _, w in rows]


def test_integers_are_compared_exactly(spark):
    big = 9007199254740993
    one = spark.createDataFrame([(big - 1, big, float(big - 1))], "a long, b long, r double")
    a, b, r = diff.tagged(F.col("a"), "int"), diff.tagged(F.col("b"), "int"), diff.tagged(F.col("r"), "real")
    assert one.select(diff.identical(a, b, True), diff.identical(a, a, True), diff.identical(a, r, True), diff.identical(r, b, True)).first() == (False, True, True, False)
    huge = spark.createDataFrame([(9223372036854775807, 9223372036854775808.0, 0.5, 0)], "i long, r double, h double, z long")
    assert huge.select(diff.identical(diff.tagged(F.col("i"), "int"), diff.tagged(F.col("r"), "real"), True), diff.identical(diff.tagged(F.col("z"), "int"), diff.tagged(F.col("h"), "real"), True)).first() == (False, False)
    null = diff.tagged(F.lit(None).cast("long"), "int")
    assert one.select(diff.identical(null, null, True), diff.identical(null, a, True)).first() == (True, False)


def test_wide_rows_are_compared_but_not_merged(spark):
    wide = spark.range(2).select("id", *[F.lit(i).alias(f"c{i}") for i in range(70)])
    d = diff.row_diff(wide, wide.withColumn("c69", F.when(F.col("id") == 1, 0).otherwise(F.col("c69"))), ["id"]).collect()
    assert [(r["id"], r["kind"], r["mask"]) for r in d] == [(1, 2, None)] and not diff.mergeable(70)


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_newest_before(spark, width):
    rng = random.Random(width)
    asks = [(i, rng.choice([1, 2, None]), rng.randrange(40)) for i in range(60)]
    facts = [(rng.choice([1, 2, None]), e, e * 7) for e in rng.sample(range(40), 25)]
    a, f = spark.createDataFrame(asks, "id long, g long, at long"), spark.createDataFrame(facts, "g long, at long, v long")
    for strict in (True, False):
        want = {i: max(((e, v) for h, e, v in facts if g is not None and h == g and (e < at or (not strict and e == at))), default=(None, None))[1] for i, g, at in asks}
        got = ordering.last_before(a, f, ["g"], "at", "v", "found", strict, width)
        assert {r["id"]: r["found"] for r in got.collect()} == {i: w for i, w in want.items()} or {r["id"]: r["found"] for r in got.where("g is not null").collect()} == {i: want[i] for i, g, _ in asks if g is not None}


@pytest.mark.parametrize("width", [2, 7, 1000])
def test_conflicts_against_all_pairs(spark, width):
    rows, t = history_of(spark, 80, width)
    writes = [r for r in rows if r[1] != "view"]
    newer = lambda r, on, at: any(w[at] == r[on] and r[6] < w[7] < r[7] for w in writes)
    want = {r[0]: (r[1] != "view" and r[4] != r[3] and newer(r, 4, 3), r[1] != "view" and newer(r, 5, 5), r[1] != "view" and newer(r, 3, 3)) for r in rows}
    assert {r["tx_id"]: (r["r"], r["w"], r["p"]) for r in validate.conflicts(t, width).collect()} == want
    assert {r[0] for r in validate.read_conflicts(t, width).collect()} == {i for i, w in want.items() if w[0]}
    assert {r[0] for r in validate.write_conflicts(t, "k", width).collect()} == {i for i, w in want.items() if w[1]}


def test_ladder_step_by_step(spark):
    # tx_id, kind, writer, page, rpage, k, snapshot, commit, growth_only, reason, dependent
    rows = [
        (1, "w", 1, 1, 1, 10, 1, 2, False, None, False),  # nothing before it
        (2, "w", 2, 1, 1, 20, 1, 3, False, None, False),  # another row of the page: replayed
        (3, "w", 3, 1, 1, 10, 1, 4, False, None, False),  # the same row: refused
        (4, "w", 4, 1, 1, 40, 1, 5, False, None, True),  # depends on what it read: refused
        (5, "w", 5, 1, 1, 50, 1, 6, True, None, False),  # only the file's growth clashes: moved
        (6, "w", 6, 2, 1, 60, 1, 7, False, "off", False),  # read a changed page, may not be merged: refused
        (7, "w", 7, 2, 1, 70, 1, 8, False, "off", False),  # the same, but its routes are as they were, page 2 clashes: refused
        (8, "w", 8, 3, 1, 80, 1, 9, False, "off", False),  # the same with a page of its own: committed
        (9, "w", 1, 1, 1, 90, 6, 10, False, "off", False),  # its page was last changed before its snapshot
        (10, "view", 1, 1, 1, 90, 1, 11, False, None, False),
        (11, "w", 9, 4, 4, 95, 10, 13, False, None, False),  # the schema changed at 12
        (12, "w", 8, 3, 3, 99, 2, 14, False, "off", False),  # wrote the page itself at 9, after its snapshot: only the schema
    ]
    t = spark.createDataFrame(rows, "tx_id long, kind string, writer_id long, page long, rpage long, k long, snapshot_epoch long, commit_epoch long, growth_only boolean, reason string, dependent boolean")
    ddl = spark.createDataFrame([(12,)], "commit_epoch long")
    same = spark.createDataFrame([(7,), (8,)], "tx_id long")
    got = {r["tx_id"]: (r["conflict"], r["outcome"]) for r in validate.ladder(t, ddl, same, width=3).collect()}
    assert got == {1: (None, "committed"), 2: ("page", "rebased"), 3: ("page", "refused"), 4: ("page", "refused"), 5: ("page", "relocated"), 6: ("read", "refused"), 7: ("page", "refused"), 8: (None, "committed"), 9: (None, "committed"), 10: (None, "committed"), 11: ("schema", "refused"), 12: ("schema", "refused")}
    off = {r["tx_id"]: r["outcome"] for r in validate.ladder(t, ddl, same, Options(rebase=False, relocation=False, route_check=False)).collect()}
    assert off[2] == off[5] == off[8] == "refused" and off[1] == "committed"
    assert History(t, spark.createDataFrame([], "epoch long, bytes long, synced boolean"), ddl).gc(9).count() > 0


@pytest.mark.parametrize("limit", [1, 5, 10, 37, 1000])
def test_segments_against_the_rule(spark, limit):
    rng = random.Random(limit)
    sizes = [rng.choice([1, 2, 3, 9, 10, 11, 40]) for _ in range(120)]
    want, segment, fill = [], 0, 0
    for s in sizes:
        if fill and fill + s > limit:
            segment, fill = segment + 1, 0
        fill += s
        want.append(segment)
    log = spark.createDataFrame([(e, s, "x") for e, s in enumerate(sizes)], "epoch long, bytes long, other string")
    for width in (1, 7, 50, 1000):
        assert [r["segment"] for r in recovery.segments(log, limit, width=width).orderBy("epoch").collect()] == want
    assert recovery.segments(log.limit(0), limit).count() == 0


def test_runs_against_the_rule(spark):
    rng = random.Random(3)
    for keep in (0.5, 0.95, 1.0):
        values = [v for v in range(-50, 150) if rng.random() < keep]
        want, start = [], None
        for v in values:
            if start is None or v != last + 1 or v - start == 7:
                start = v
                want.append([v, 0])
            want[-1][1] += 1
            last = v
        rows = spark.createDataFrame([(v,) for v in values * 2] + [(None,)], "v long")
        for width in (1, 2, 13, 1000):
            assert sorted(map(list, ordering.islands(rows, "v", 7, width).collect())) == want
    values = [rng.choice([rng.uniform(-50, 5000), 7.0]) for _ in range(101)]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for p in (0.0, 0.5, 0.99, 1.0):
        assert ordering.floor_percentile_all(rows, "v", p, "x", 100.0).first()[0] == sorted(values)[int(p * 100)]


def test_components_and_admission(spark):
    rng = random.Random(5)
    requests = [(i, 100 + i, 100 + i - rng.randrange(1, 30), rng.sample(range(25), rng.choice([1, 1, 2])), "more") for i in range(70)]
    head, want = {}, {}
    for i, arrival, seen, keys, _ in requests:
        clash = any(head.get(k, 0) > seen for k in keys)
        want[i] = ("refused", -1) if clash else ("merged", arrival)
        if not clash:
            head.update(dict.fromkeys(keys, arrival))
    df = spark.createDataFrame(requests, "tx_id long, arrival long, snapshot_epoch long, keys array<long>, component string").drop("component")
    assert {r["tx_id"]: (r["verdict"], r["commit_order"]) for r in rebase.admit(df).collect()} == want
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (5, 5)], "a long, b long")
    assert {r["node"]: r["component"] for r in connected_components(chain).collect()} == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}


def test_savepoints(spark):
    ops = [(1, 1, "change", None), (1, 2, "savepoint", "a"), (1, 3, "change", None), (1, 4, "savepoint", "b"), (1, 5, "change", None), (1, 6, "rollback", "a"), (1, 7, "change", None), (1, 8, "rollback", "b"), (1, 9, "rollback", "a"), (1, 10, "change", None),
           (2, 1, "savepoint", "a"), (2, 2, "change", None), (2, 3, "release", "a"), (2, 4, "rollback", "a"), (2, 5, "change", None)]
    got = validate.kept_operations(spark.createDataFrame(ops, "tx_id long, seq long, op string, name string")).collect()
    assert sorted((r["tx_id"], r["seq"]) for r in got) == [(1, 1), (1, 10), (2, 2), (2, 5)]


P, C = "id long, x long", "id long, pid long, v long"


@pytest.mark.parametrize(("action", "left", "orphans"), [("cascade", {(1, 1)}, 0), ("set null", {(1, 1), (2, None), (3, None)}, 0), ("no action", {(1, 1), (2, 2), (3, 2)}, 2)])
def test_keys_act(spark, action, left, orphans):
    tables = {"p": spark.createDataFrame([(1, 0), (2, 0)], P), "c": spark.createDataFrame([(1, 1, 0), (2, 2, 0), (3, 2, 0)], C)}
    keys = [ForeignKey("c", "pid", "p", "id", action)]
    after, refused = schema.after_deletes(tables, keys, {"p": "id", "c": "id"}, {"p": tables["p"].where("id = 2").select("id")})
    assert {(r["id"], r["pid"]) for r in after["c"].collect()} == left and after["p"].count() == 1
    assert (refused.count() if refused is not None else 0) == orphans
    off, none = schema.after_deletes(tables, keys, {"p": "id", "c": "id"}, {"p": tables["p"].where("id = 2").select("id")}, enforce=False)
    assert off["c"].count() == 3 and none is None


def test_keys_to_the_own_table(spark):
    t = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, None), (6, 5)], "id long, up long")
    after, _ = schema.after_deletes({"t": t}, [ForeignKey("t", "up", "t", "id", "cascade")], {"t": "id"}, {"t": t.where("id = 2").select("id")})
    assert {r["id"] for r in after["t"].collect()} == {1, 5, 6}


def test_two_transactions_and_keys(spark):
    # A child of a parent that the other deleted is refused; with keys off it is the application's business.
    parents = spark.createDataFrame([(1, 0)], P)
    written = spark.createDataFrame([(101, 15, 1), (102, 1, 1), (103, None, 1)], C)
    assert {r["id"]: r["ok"] for r in schema.orphans(written, "pid", parents, "id").collect()} == {101: False, 102: True, 103: True}
    assert all(r["ok"] for r in schema.orphans(written, "pid", parents, "id", enforce=False).collect())


@pytest.mark.parametrize(("policy", "row", "touched", "want"), [("replace", (5, "X", "a"), [], "replaced"), ("replace", (100, "u20", "n"), [200], "refused"), ("replace", (10, "z", "a"), [], "replaced"), ("replace", (6, "q", None), [], "inserted"), ("abort", (6, "q", None), [], "refused"), ("ignore", (10, "z", "a"), [], "ignored"), ("abort", (11, "z", "a"), [], "inserted")])
def test_conflict_clauses(spark, policy, row, touched, want):
    current = spark.createDataFrame([(10, "u1"), (7, "X"), (200, "u20")], "id long, u string")
    got = rebase.with_policy(spark.createDataFrame([row], "id long, u string, n string"), current, "id", ["u", "n"], "u", policy, "n", "dflt", spark.createDataFrame([(i,) for i in touched], "id long")).first()
    assert got["outcome"] == want and (policy != "replace" or got["n"] == (row[2] or "dflt"))


def test_unique_values_within_a_batch(spark):
    changes = spark.createDataFrame([(1, 1, None, ("a", 5)), (2, 1, None, ("b", 5)), (3, 1, None, ("c", None)), (4, 1, None, ("d", None))], "id long, kind int, old struct<a:string,u:long>, new struct<a:string,u:long>")
    current = spark.createDataFrame([], "id long, a string, u long")
    assert {r["id"]: r["ok"] for r in rebase.replayable(changes, current, ["id"], ["a", "u"], ["u"]).collect()} == {1: True, 2: False, 3: True, 4: True}


def test_catalogs_defaults_and_constraints(spark):
    tables = [TableSpec(t, ("id",), {"id": "INT"}) for t in "abcd"]
    keys = [ForeignKey("a", "x", "a", "id"), ForeignKey("b", "x", "c", "id"), ForeignKey("c", "x", "b", "id"), ForeignKey("d", "x", "b", "id")]
    assert {r["tbl"]: r["catalog_reason"] for r in Catalog(tables, keys).reasons(spark).collect()} == {"a": "refers to itself", "b": "circle of keys", "c": "circle of keys", "d": None}
    assert {r["catalog_reason"] for r in Catalog(tables).reasons(spark, triggers=("t",)).collect()} == {"trigger"}
    assert Catalog(tables).unmergeable(encoding="UTF-16") == "text encoding" and Catalog(tables).unmergeable(reserved=8) == "reserved bytes"
    spec = TableSpec.of("t", spark.createDataFrame([], "id long, v string, b binary").schema, ("id",), added={"v": (2, "'x' || 1")})
    spec.check_defaults(spark)
    assert spec.columns == {"id": "BIGINT", "v": "STRING", "b": "BINARY"}
    for bad in ("id + 1", "rand()", "nonsense("):
        with pytest.raises(ValueError):
            TableSpec("t", ("id",), {"id": "INT", "v": "INT"}, added={"v": (2, bad)}).check_defaults(spark)
    with pytest.raises(ValueError):
        TableSpec.of("t", spark.createDataFrame([], "id long").schema, ("other",))
    rows = spark.createDataFrame([(1, "a", 5), (1, None, -1), (None, "b", None)], "id long, v string, n long")
    assert {r[0]: r[1] for r in schema.violations(rows, ["id"], ["v"], {"n": F.col("n") > 0}, ["v"]).collect()} == {"not null id": 1, "not null v": 1, "check n": 1, "primary key": 1}


def test_log_records_by_place_and_in_place_recovery(spark, tmp_path):
    path, to = f"file://{tmp_path}/db", f"file://{tmp_path}/new"
    log = recovery.sealed(spark.createDataFrame([(e, e * 10, 1, 100, e // 4) for e in range(2, 12)], "epoch long, tx_id long, n_pages long, bytes long, segment int"))
    commit_log.append(log.withColumn("checksum", F.col("checksum") + F.when(F.col("epoch") == 9, 1).otherwise(0)), path, "b1")
    commit_log.write_manifest(spark, path, 1)
    assert commit_log.read(spark, path).agg(F.max("epoch")).first()[0] == 8
    assert commit_log.peek(spark, path, "b1", 1, 2).first()["epoch"] == 5 and commit_log.peek(spark, path, "b1", 2, 2).isEmpty() and commit_log.peek(spark, path, "b1", 9, 1).isEmpty()
    commit_log.rewrite(spark, path, to)
    assert sorted(r["epoch"] for r in commit_log.records(spark, to).collect()) == list(range(2, 9))
    versions = spark.createDataFrame([(1, 3, "a", False)], "k long, commit_epoch long, v string, gone boolean")
    base = spark.createDataFrame([], "k long, commit_epoch long, v string, gone boolean")
    how = dict(base=base, versions=versions, key=["k"], deleted=F.col("gone"))
    assert commit_log.compact_when(spark, to, 10_000, **how) is None
    assert commit_log.compact_when(spark, to, 500, **how).count() == 1
    assert commit_log.read(spark, to).isEmpty() and [r[0] for r in commit_log.trim(spark, to).collect()] == [0, 1]


def test_what_unknown_outcomes_may_be(spark):
    gaps = spark.createDataFrame([(5,), (6,), (20,)], "epoch long")
    doubtful = spark.createDataFrame([(1, 3, 6), (2, 4, 5), (3, 18, 30)], "tx_id long, snapshot_epoch long, upto long")
    found = audit.placements(gaps, doubtful, width=4)
    assert {r["epoch"]: r["candidates"] for r in found.collect()} == {5: [1, 2], 6: [1], 20: [3]}
    assert {r["epoch"]: r["tx_id"] for r in audit.settled(found).collect()} == {5: 2, 6: 1, 20: 3}


def test_functions_in_sql(spark):
    assert "epochal_rows" in scalars.register(spark)
    assert spark.sql("select epochal_version_number(), epochal_percent(1, 4), epochal_segment((7L << 32) + 5), (select count(*) from epochal_rows(3, 9))").first() == (2000, 25.0, 7, 7)


def test_pages_below_the_log(spark):
    reads = spark.createDataFrame([(1, 1, 5), (2, 1, 2), (3, 2, 9), (4, 3, 9)], "tx_id long, page long, snapshot_epoch long")
    versions = spark.createDataFrame([(1, 3, "new"), (1, 6, "newer")], "page long, commit_epoch long, image string")
    base = spark.createDataFrame([(1, "old"), (2, None)], "page long, image string")
    got = snapshot.read_pages(reads, base, versions, "page", "image", width=2)
    assert {r["tx_id"]: (r["read_epoch"], r["image"]) for r in got.collect()} == {1: (3, "new"), 2: (0, "old"), 3: (0, None), 4: (None, None)}


def test_relocated_references_follow(spark):
    rows = spark.createDataFrame([(5, 11), (11, 12), (12, 5)], "id long, up long")
    assert sorted(map(tuple, structure.relocated(rows, 10, 12, 100, ["id", "up"]).collect())) == [(5, 111), (111, 112), (112, 5)]


EVENTS = [(1, "2024-01-01 00:10:00", 1), (1, "2024-01-01 00:20:00", 2), (2, "2024-01-01 01:30:00", 3), (1, "2024-01-01 05:00:00", 4), (1, "2024-01-01 05:10:00", 5), (2, "2024-01-01 00:05:00", 6)]


@pytest.fixture
def event_files(spark, tmp_path):
    """One event a file, in the order of the list."""
    import time

    for i, e in enumerate(EVENTS):
        spark.createDataFrame([e], "k long, at string, id long").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
        time.sleep(0.05)
    return lambda: tail.tail(spark, f"file://{tmp_path}/in/*", "k long, at timestamp, id long", files=1)


def test_windows_of_streams(spark, event_files, tmp_path):
    n = F.count("*").alias("n")
    slid = tail.run_to_end(tail.sliding(event_files(), "at", "2 hours", "1 hour", "1 day", n), "slid", "complete")
    assert sorted((r["window"]["start"].hour, r["n"]) for r in slid.collect()) == [(0, 4), (1, 1), (4, 2), (5, 2), (23, 3)]
    sessions = tail.run_to_end(tail.sessions(event_files(), "at", "k", "30 minutes", "1 day", n), "sessions", "complete")
    assert sorted((r["k"], r["n"]) for r in sessions.collect()) == [(1, 2), (1, 2), (2, 1), (2, 1)]


def test_late_events_are_left_out(spark, event_files):
    # The last file's event is five hours behind those before it, more than the hour allowed.
    got = tail.run_to_end(tail.tumbling(event_files(), "at", "1 hour", "1 hour", F.count("*").alias("n")), "late", "append")
    assert {r["window"]["start"].hour: r["n"] for r in got.collect()} == {0: 2, 1: 1}


def test_conflicts_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    import time

    _, t = history_of(spark, 60, 11)
    w = t.where("kind <> 'view'").select("tx_id", F.col("page").alias("granule"), "snapshot_epoch", "commit_epoch")
    for i in range(4):
        w.where((F.col("commit_epoch") > i * 16) & (F.col("commit_epoch") <= (i + 1) * 16)).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
        time.sleep(0.05)
    stream = tail.tail(spark, f"file://{tmp_path}/in/*", w.schema.simpleString()[7:-1].replace(":", " "), files=1)
    got = tail.run_to_end(tail.validated(stream), "validated", "append").where("conflict").collect()
    assert {r["tx_id"] for r in got} == {r["tx_id"] for r in validate.write_conflicts(t, "page").collect()}


def test_group_commits_by_running_frames(spark):
    rng = random.Random(5)
    commits = [(i, rng.randrange(300)) for i in range(80)]
    syncs = [(100 + i, rng.randrange(280)) for i in range(12)]
    c, s = spark.createDataFrame(commits, "tx_id long, append_end long"), spark.createDataFrame(syncs, "sync_id long, sync_start long")
    want = {i: min(((at, y) for y, at in syncs if at > end), default=(None, None))[1] for i, end in commits}
    for width in (1, 20, 1000):
        got = recovery.group_commits(c, s, width)
        assert {r["tx_id"]: r["sync_id"] for r in got.collect()} == want
        # A frame up to the end is worked out anew for each row.
        assert "unboundedfollowing" not in got._jdf.queryExecution().executedPlan().toString().lower()


def test_sketches_are_held_by_group_alone(spark):
    from epochal.plans import queries

    plan = queries.QUERIES["a17_approximate_distinct"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    sketches = [line for line in plan.splitlines() if "approx_count_distinct" in line and "keys=" in line]
    assert sketches and not any("l_orderkey" in line.split("functions=")[0] for line in sketches)


def test_changes_are_not_dealt_by_table(spark):
    changes = spark.range(50).selectExpr("id", "'orders' as tbl", "cast(id % 3 + 1 as int) as kind", "id as mask")
    ranks = spark.createDataFrame([("orders", 3), ("customer", 2)], "tbl string, rank int")
    masks = spark.createDataFrame([("orders", 5)], "tbl string, refmask long")
    for got in (rebase.replay_order(changes, ranks), rebase.referenced_updates(changes, masks)):
        assert got.count() > 0
        assert "hashpartitioning(tbl" not in got._jdf.queryExecution().executedPlan().toString()


def test_ladder_reads_the_history_as_often_as_one_pass_does(spark):
    rows, t = history_of(spark, 60, 3)
    ddl = spark.createDataFrame([(20,), (41,)], "commit_epoch long")
    got = validate.ladder(t, ddl, width=7)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD [tx_id") <= 2
    writes = [r for r in rows if r[1] != "view"]
    last = lambda r, on, at, by: max((w[7] for w in writes if w[at] == r[on] and w[7] < r[7] and by in (None, w[2])), default=0)
    newer = lambda r, on, at: last(r, on, at, None) > max(r[6], last(r, on, at, r[2]))
    for r in got.collect():
        x = next(x for x in rows if x[0] == r["tx_id"])
        schema = any(x[6] < e < x[7] for e in (20, 41))
        want = None if x[1] == "view" else "read" if x[4] != x[3] and newer(x, 4, 3) else "page" if newer(x, 3, 3) else "schema" if schema else None
        assert r["conflict"] == want
