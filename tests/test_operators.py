"""Golden cases of two transactions, of crashes, and of the pieces around them."""

import pytest
from pyspark.sql import functions as F

from epochal.functions import statements
from epochal.model import Catalog, Options, TableSpec, no_affinity
from epochal.operators import audit, diff, ordering, rebase, recovery, schema, snapshot, validate
from epochal.sources import commit_log, reports
from epochal.streaming import tail


def test_affinity_and_options():
    assert [no_affinity(t) for t in ("", "BLOB", "ANY", "TEXT", "BLOBINT", "INTEGER", "NUMERIC")] == [True, True, True, False, False, False, False]
    assert Options.parse({"rebase": "off", "log_max_mb": "7"}) == Options(rebase=False, log_max_mb=7)
    for bad in ({"rebase": "maybe"}, {"unknown": "1"}, {"journal_mode": "delete"}, {"auto_vacuum": "full"}):
        with pytest.raises(ValueError):
            Options.parse(bad)
    spec = TableSpec("T", ("id",), {"id": "INT", "a": "TEXT", "g": "INT"}, derived=("g",))
    assert Catalog([spec])["t"].writable() == ["a"]


MERGES = [
    # name, change (id, kind, old, new), what the other transaction left: (id, a, u) rows; merged?
    ("other row", (3, 2, ("x", 3), ("y", 3)), [(3, "x", 3), (30, "z", 30)], True),
    ("other cell of the row", (5, 2, ("x", 5), ("y", 5)), [(5, "x", 55)], False),
    ("deleted row", (7, 2, ("x", 7), ("y", 7)), [(8, "x", 8)], False),
    ("deleted by both", (8, 3, ("x", 8), None), [(9, "x", 9)], False),
    ("new keys", (101, 1, None, ("n", 101)), [(102, "n", 102)], True),
    ("same new key", (103, 1, None, ("n", 103)), [(103, "m", 104)], False),
    ("unique value taken", (104, 1, None, ("n", 555)), [(105, "n", 555)], False),
    ("null where null was", (10, 2, (None, 10), ("y", 10)), [(10, None, 10)], True),
    ("letter case differs", (5, 2, ("abc", 5), ("y", 5)), [(5, "ABC", 5)], False),
]


@pytest.mark.parametrize("case", MERGES, ids=[m[0] for m in MERGES])
def test_merges(spark, case):
    _, change, rows, merged = case
    changes = spark.createDataFrame([change], "id long, kind int, old struct<a:string,u:long>, new struct<a:string,u:long>")
    current = spark.createDataFrame(rows, "id long, a string, u long")
    assert rebase.replayable(changes, current, ["id"], ["a", "u"], ["u"]).select(F.min("ok")).first()[0] is merged


def test_row_diff_roundtrip(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 2.0), (3, "c", 3.0)], "id long, a string, r double")
    new = spark.createDataFrame([(1, "a", None), (2, "b", 2.5), (4, "d", 4.0)], "id long, a string, r double")
    d = diff.row_diff(old, new, ["id"])
    assert sorted((r["id"], r["kind"], r["mask"]) for r in d.collect()) == [(2, 2, 2), (3, 3, 0), (4, 1, 0)]
    assert sorted(diff.apply_diff(old, d, ["id"]).collect()) == sorted(new.collect())


def test_typed_equality(spark):
    one = spark.range(1)
    a, b = diff.tagged(F.lit(1), "int"), diff.tagged(F.lit(1.0), "real")
    assert one.select(diff.identical(a, b, True), diff.identical(a, b, False)).first() == (True, False)


def test_short_rows_keep_nulls(spark):
    spec = TableSpec("t", ("id",), {"id": "INT", "z": "INT"}, added={"z": (2, "9")})
    rows = spark.createDataFrame([(1, 1, None), (2, 2, None), (3, 2, 5)], "id int, schema_gen int, z int")
    assert [r[0] for r in rows.orderBy("id").select(spec.completed("z")).collect()] == [9, None, 5]


@pytest.mark.parametrize(
    ("epochs", "torn", "base", "want"),
    [([2, 3, 4], [], 1, 4), ([2, 3, 4], [4], 1, 3), ([2, 3, 5], [], 1, 3), ([2, 3, 4], [2], 2, 4), ([5], [], 1, 1), ([], [], 7, 7)],
    ids=["whole", "torn tail", "gap", "old records skipped", "first missing", "empty"],
)
def test_recovery(spark, epochs, torn, base, want):
    log = spark.createDataFrame([(e, 1, e not in torn) for e in epochs], "epoch long, n_pages long, complete boolean")
    assert recovery.recovered_epoch(recovery.valid_records(log), base).first()[0] == want


def test_log_on_disk(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    records = spark.createDataFrame([(e, 1, True, e // 3) for e in range(2, 9)], "epoch long, n_pages long, complete boolean, segment int")
    assert commit_log.append(records, path, "one")
    assert not commit_log.append(records, path, "one")
    commit_log.write_manifest(spark, path, 1)
    assert commit_log.read(spark, path).count() == 7
    versions = spark.createDataFrame([(1, 3, "a", False), (1, 5, "b", False), (2, 6, "c", True)], "k long, commit_epoch long, v string, gone boolean")
    base = spark.createDataFrame([(2, 1, "old", False)], "k long, commit_epoch long, v string, gone boolean")
    assert {(r["k"], r["v"]) for r in commit_log.compact(spark, path, base, versions, ["k"], 5, F.col("gone")).collect()} == {(1, "b"), (2, "old")}
    assert [r[0] for r in commit_log.trim(spark, path).collect()] == [0, 1] or sorted(r[0] for r in commit_log.trim(spark, path).collect()) == [0, 1]
    commit_log.write_manifest(spark, path, 99, features=("unknown",))
    with pytest.raises(ValueError):
        commit_log.read(spark, path)


def test_admission_folds_in_order(spark):
    requests = spark.createDataFrame([(1, 10, 5, [1], 0), (2, 11, 5, [1], 0), (3, 12, 11, [1], 0), (4, 13, 5, [2], 0)], "tx_id long, arrival long, snapshot_epoch long, keys array<long>, component long")
    assert {r["tx_id"]: r["verdict"] for r in rebase.admit(requests).collect()} == {1: "merged", 2: "refused", 3: "merged", 4: "merged"}


def test_write_skew_is_refused(spark):
    t = spark.createDataFrame([(1, "click", 1, 10, 5, 2), (2, "click", 2, 11, 5, 1)], "tx_id long, kind string, page long, commit_epoch long, snapshot_epoch long, rpage long").withColumn("k", F.col("page"))
    assert [r[0] for r in validate.read_conflicts(t).collect()] == [2]
    assert {r["tx_id"]: r["verdict"] for r in validate.verdicts(t, read_check=False).collect()} == {1: "clean", 2: "clean"}


def test_row_numbers_and_runs(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    got = ordering.global_row_number(rows, ["v"], F.expr("v div 37"), "n").collect()
    assert all(r["n"] == r["v"] + 1 for r in got) and len(got) == 1000
    holes = spark.createDataFrame([(v,) for v in (1, 2, 3, 5, 6, 9, 10, 11, 12)], "v long")
    for width in (2, 5, 1000):
        assert sorted(map(tuple, ordering.islands(holes, "v", 3, width).collect())) == [(1, 3), (5, 2), (9, 3), (12, 1)]


def test_keys_in_a_circle_are_refused(spark):
    with pytest.raises(ValueError):
        schema.fk_ranks(spark, ["a", "b"], [("a", "b"), ("b", "a")])


def test_statements(spark):
    s = spark.createDataFrame([("/* c */ ( select 1",), ("INSERT INTO s SELECT 1",), ("insert into t values (1) on conflict do nothing",), ("",)], "q string")
    got = s.select(statements.is_read(F.col("q")), statements.is_point(F.col("q"), F.lit("id"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (False, False), (False, False)]


def test_empty_history(spark):
    t = spark.createDataFrame([], "tx_id long, kind string, page long, commit_epoch long, snapshot_epoch long, rpage long, k long")
    assert validate.verdicts(t).count() == 0
    assert snapshot.snapshot(t, ["k"], 5, F.col("kind") == "error").count() == 0
    assert audit.epoch_gaps(t).count() == 0


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(4, "a", 1, 10.0), (4, "a", 2, 11.0), (16, "a", 1, 12.0)], "n long, variant string, line long, tx_s double")
    reports.write_json(rows, f"file://{tmp_path}/r")
    assert {(r["n"], r["tx_s"]) for r in reports.read_results(spark, f"file://{tmp_path}/r", ["n", "variant"], "line").collect()} == {(4, 11.0), (16, 12.0)}
    reports.write_csv(rows, f"file://{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/c").count() == 3


def test_streams_give_what_batches_give(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, "2024-01-01 00:10:00"), (1, 3, "2024-01-01 00:20:00"), (2, 4, "2024-01-01 01:30:00")], "k long, epoch long, at string").withColumn("at", F.col("at").cast("timestamp"))
    rows.repartition(3).write.parquet(f"file://{tmp_path}/log")
    stream = tail.tail(spark, f"file://{tmp_path}/log", "k long, epoch long, at timestamp", files=1)
    newest = tail.run_to_end(tail.newest_by_key(stream, "k"), "newest", "complete")
    assert {(r["k"], r["epoch"]) for r in newest.collect()} == {(1, 3), (2, 4)}
    windows = tail.run_to_end(tail.tumbling(stream, "at", "1 hour", "1 day", F.count("*").alias("n")), "windows", "complete")
    assert sorted(r["n"] for r in windows.collect()) == [1, 2]
