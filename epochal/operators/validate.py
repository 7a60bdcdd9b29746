"""Which transactions a validator refuses, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Options
from .ordering import BEFORE, last_before

WIDTH = 100_000


def newer_write(tx: DataFrame, writes: DataFrame, on: str, target: str, basis: str = "snapshot_epoch", width: int = WIDTH) -> DataFrame:
    """Ids of the transactions on whose ``on`` another commit lies after their basis and before their own commit. Of
    all commits on a granule only the last one before a transaction's own matters."""
    asks = tx.select("tx_id", F.col(on).alias("granule"), F.col("commit_epoch").alias("at"), F.col(basis).alias("basis"))
    facts = writes.select(F.col(target).alias("granule"), F.col("commit_epoch").alias("at"), F.col("commit_epoch").alias("epoch"))
    return last_before(asks, facts, ["granule"], "at", "epoch", "last", width=width).where("last > basis").select("tx_id").distinct()


def read_conflicts(t: DataFrame, width: int = WIDTH) -> DataFrame:
    """Writers that read a page they didn't write which has a newer version than their snapshot."""
    writers = t.where("kind <> 'view'")
    return newer_write(writers.where("rpage <> page"), writers, "rpage", "page", width=width)


def write_conflicts(t: DataFrame, granule: str, width: int = WIDTH) -> DataFrame:
    writers = t.where("kind <> 'view'")
    return newer_write(writers, writers, granule, granule, width=width)


def last_schema_epoch(tx: DataFrame, ddl: DataFrame, width: int = WIDTH) -> DataFrame:
    """Adds schema_epoch: that of the last schema change before a transaction's commit."""
    asks = tx.withColumn("__all", F.lit(0))
    return last_before(asks, ddl.select(F.lit(0).alias("__all"), F.col("commit_epoch"), F.col("commit_epoch").alias("__e")), ["__all"], "commit_epoch", "__e", "schema_epoch", width=width).drop("__all")


def schema_conflicts(tx: DataFrame, ddl: DataFrame, width: int = WIDTH) -> DataFrame:
    """Writers whose snapshot is older than a schema change that was committed before them."""
    return last_schema_epoch(tx, ddl, width).where("schema_epoch > snapshot_epoch").select("tx_id").distinct()


def stale(tx: DataFrame, ddl: DataFrame, width: int = WIDTH) -> DataFrame:
    """Adds stale: whether a writer's first write is refused at once, as the schema has changed since its snapshot.
    Readers keep the schema of their snapshot."""
    known = last_schema_epoch(tx, ddl, width)
    return known.withColumn("stale", (F.col("kind") != "view") & F.coalesce(F.col("snapshot_epoch") < F.col("schema_epoch"), F.lit(False))).drop("schema_epoch")


def conflicts(t: DataFrame, width: int = WIDTH, writer: str | None = None, ddl: DataFrame | None = None, flags: tuple[str, ...] = ()) -> DataFrame:
    """tx_id, view (it is a reader), the flags (boolean columns) and whether a newer version conflicts with what the
    transaction read (r), with the row (w) and with the page (p) that it wrote, in one pass: a transaction gives a row
    for each granule it touches, the rows are dealt by granule and ranges of epochs, and one aggregate by transaction
    puts the answers together. ``writer``: a column of who wrote; a granule whose newest version is the writer's own
    is no conflict. ``ddl``: adds s, whether the schema has changed since the snapshot. Commit epochs are distinct."""
    writes = F.col("kind") != "view"
    item = lambda space, granule, tag, fact: F.struct(F.lit(space).alias("space"), granule.cast("string").alias("granule"), F.lit(tag).alias("tag"), F.lit(fact).alias("fact"))
    items = [F.when(writes & (F.col("rpage") != F.col("page")), item("page", F.col("rpage"), "r", False)), F.when(writes, item("row", F.col("k"), "w", True)), F.when(writes, item("page", F.col("page"), "p", True))]
    if ddl is not None:
        items.append(item("schema", F.lit("all"), "s", False))
    own = F.col(writer) if writer else F.lit(None).cast("long")
    each = t.select("tx_id", (~writes).alias("view"), F.col("commit_epoch").alias("at"), F.col("snapshot_epoch").alias("basis"), own.alias("by"), *flags, F.explode_outer(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("x")).select("*", "x.*").drop("x")
    if ddl is not None:
        each = each.unionByName(ddl.select(F.col("commit_epoch").alias("at"), item("schema", F.lit("all"), "ddl", True).alias("x")).select("at", "x.*"), allowMissingColumns=True)
    each = each.withColumn("range", F.floor(F.col("at") / width))
    key, fact = ["space", "granule", "range"], F.when(F.col("fact"), F.struct("at", "by"))
    here = each.withColumn("here", F.max(fact).over(Window.partitionBy(*key).orderBy("at").rangeBetween(*BEFORE)))
    # The newest commit of each granule before a range: one row a granule and range.
    lasts = each.groupBy(*key).agg(F.max(fact).alias("m"))
    before = lasts.select(*key, F.max("m").over(Window.partitionBy("space", "granule").orderBy("range").rowsBetween(*BEFORE)).alias("m"))
    last = F.coalesce("here", "m")
    newer = (last["at"] > F.col("basis")) & ~F.coalesce(last["by"] == F.col("by"), F.lit(False))
    hit = lambda tag: F.coalesce(F.max((F.col("tag") == tag) & newer), F.lit(False)).alias(tag)
    asks = here.where("tag is null or tag <> 'ddl'").join(before, key, "left")
    return asks.groupBy("tx_id").agg(*[F.max(c).alias(c) for c in ("view", *flags)], *[hit(tag) for tag in ("rwp" if ddl is None else "rwps")])


def verdicts(t: DataFrame, read_check: bool = True, width: int = WIDTH) -> DataFrame:
    """tx_id and verdict: the first failure decides, reads before rows before pages. tx_id is a key."""
    verdict = F.when(F.col("view"), "read only").when(F.col("r") & F.lit(read_check), "read conflict").when(F.col("w"), "row conflict").when(F.col("p"), "mergeable").otherwise("clean")
    return conflicts(t, width).select("tx_id", verdict.alias("verdict"))


def own_basis(writes: DataFrame, own: DataFrame) -> DataFrame:
    """Each write's basis: the epoch at which its snapshot itself last committed the page, else the snapshot's."""
    last = own.groupBy("snapshot_id", "page").agg(F.max("own_epoch").alias("own_epoch"))
    return writes.join(last, ["snapshot_id", "page"], "left").withColumn("basis", F.coalesce("own_epoch", "snapshot_epoch")).drop("own_epoch")


def poisoned(commits: DataFrame, merged: Column) -> DataFrame:
    """Commits of a snapshot after one that was merged or relocated: refused."""
    w = Window.partitionBy("snapshot_id").orderBy("seq").rowsBetween(*BEFORE)
    return commits.withColumn("poisoned", F.coalesce(F.max(merged.cast("int")).over(w), F.lit(0)) == 1)


def ladder(t: DataFrame, ddl: DataFrame, forgiven: DataFrame | None = None, options: Options = Options(), width: int = WIDTH) -> DataFrame:
    """tx_id, conflict and outcome of every transaction from begin to end.

    The first failure decides: reads, then pages, then the schema. A page's basis is the epoch at which the writer
    itself last committed it, if that is after its snapshot. ``forgiven`` (tx_id): readers whose routes through a
    changed page are what they were (see ``structure.same_routes``). Then the steps are tried in turn: a plain commit,
    a relocation where all that clashes is the file's growth (growth_only), a replay of the row changes where the
    transaction may be merged (reason is null, not dependent) and no other commit touched its row, else it is
    refused. A schema change is never merged with."""
    t = t.withColumn("eligible", F.col("reason").isNull())
    found = conflicts(t, width, "writer_id", ddl, ("growth_only", "eligible", "dependent"))
    found = found.join(forgiven.select("tx_id").distinct().withColumn("__same", F.lit(True)), "tx_id", "left") if forgiven is not None and options.route_check else found.withColumn("__same", F.lit(None).cast("boolean"))
    reads = F.col("r") & F.col("__same").isNull() & F.lit(options.read_check)
    conflict = F.when(F.col("view"), None).when(reads, "read").when(F.col("p"), "page").when(F.col("s"), "schema")
    found = found.withColumn("conflict", conflict)
    moved = (F.col("conflict") == "page") & F.col("growth_only") & F.lit(options.relocation)
    merged = F.col("conflict").isin("read", "page") & F.col("eligible") & ~F.col("dependent") & ~F.col("w") & ~F.col("s") & F.lit(options.rebase)
    outcome = F.when(F.col("conflict").isNull(), "committed").when(moved, "relocated").when(merged, "rebased").otherwise("refused")
    return found.select("tx_id", "conflict", outcome.alias("outcome"))


def begun(requests: DataFrame, published: DataFrame, base_epoch: int = 1, width: int = WIDTH) -> DataFrame:
    """Adds snapshot_epoch to requests (tx_id, at): the newest epoch that was visible then. ``published``: commit_epoch
    and visible_at, which rises with the epochs."""
    asks = requests.withColumn("__all", F.lit(0))
    facts = published.select(F.lit(0).alias("__all"), F.col("visible_at").alias("at"), "commit_epoch")
    got = last_before(asks, facts, ["__all"], "at", "commit_epoch", "snapshot_epoch", strict=False, width=width)
    return got.drop("__all").withColumn("snapshot_epoch", F.coalesce("snapshot_epoch", F.lit(base_epoch).cast("long")))


def ended(tx: DataFrame) -> DataFrame:
    """Adds state from commit_epoch (0 or null: none), ended and is_writer: a reader that ends has committed, a writer
    that ends without a commit has aborted."""
    committed = F.coalesce("commit_epoch", F.lit(0)) > 0
    return tx.withColumn("state", F.when(committed, "COMMITTED").when(~F.col("ended"), "ACTIVE").when(F.col("is_writer"), "ABORTED").otherwise("COMMITTED"))


def read_only_pages(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Pages a transaction read and didn't write; page 1 counts for no one."""
    seen = reads.where("page <> 1").select("tx_id", "page").dropDuplicates()
    return seen.join(writes.select("tx_id", "page"), ["tx_id", "page"], "left_anti")


def read_set(reads: DataFrame, room: int) -> tuple[DataFrame, DataFrame]:
    """The distinct pages that each transaction read, page 1 left out, and the transactions (tx_id, pages, overflow)
    with whether their set outgrew its room: such a commit fails."""
    seen = reads.where("page <> 1").select("tx_id", "page").dropDuplicates()
    return seen, seen.groupBy("tx_id").agg(F.count("*").alias("pages")).withColumn("overflow", F.col("pages") > room)


def write_set(frames: DataFrame) -> DataFrame:
    """The last frame of each page of a transaction."""
    rest = [c for c in frames.columns if c not in ("tx_id", "page")]
    last = frames.groupBy("tx_id", "page").agg(F.max_by(F.struct(*rest), "frame").alias("v"))
    return last.select("tx_id", "page", "v.*")


def used_pages(t: DataFrame) -> DataFrame:
    """tx_id and each page that a transaction read or wrote, once."""
    return t.select("tx_id", "page").unionByName(t.select("tx_id", F.col("rpage").alias("page"))).distinct()


def own_commits(*parts: DataFrame) -> DataFrame:
    """writer_id, page, own_epoch: the pages that a writer committed itself, from several lists of commits."""
    both = parts[0].select("writer_id", "page", "commit_epoch")
    for p in parts[1:]:
        both = both.unionByName(p.select("writer_id", "page", "commit_epoch"))
    return both.groupBy("writer_id", "page").agg(F.max("commit_epoch").alias("own_epoch"))


def first_violations(violations: DataFrame, group: str, order: str, keep: int) -> DataFrame:
    """The first few violations of each group: a report's limit."""
    w = Window.partitionBy(group).orderBy(order)
    return violations.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= keep).drop("__r")


def kept_operations(ops: DataFrame) -> DataFrame:
    """tx_id and seq of the changes that are left of transactions with savepoints. Columns tx_id, seq, op (change,
    savepoint, rollback, release) and name. A rollback takes away what came after the newest mark of its name and
    keeps the mark; a release takes the mark and those after it; one without a mark does nothing here."""
    row = F.array_sort(F.collect_list(F.struct("seq", "op", "name")))
    start = F.struct(F.array().cast("array<bigint>").alias("kept"), F.array().cast("array<struct<name:string,n:int>>").alias("marks"))

    def step(state: Column, x: Column) -> Column:
        kept, marks = state["kept"], state["marks"]
        # The place of the newest mark of the name, 0 if there is none.
        at = F.greatest(F.lit(0), F.size(marks) + 1 - F.array_position(F.reverse(F.transform(marks, lambda m: m["name"])), x["name"]).cast("int"))
        at = F.when(F.exists(marks, lambda m: m["name"] == x["name"]), at).otherwise(0)
        size = F.coalesce(F.get(marks, at - 1)["n"], F.size(kept))
        new_kept = F.when(x["op"] == "change", F.concat(kept, F.array(x["seq"].cast("bigint")))).when((x["op"] == "rollback") & (at > 0), F.slice(kept, F.lit(1), size)).otherwise(kept)
        mark = F.array(F.struct(x["name"].alias("name"), F.size(kept).alias("n")))
        new_marks = F.when(x["op"] == "savepoint", F.concat(marks, mark)).when((x["op"] == "rollback") & (at > 0), F.slice(marks, F.lit(1), at)).when((x["op"] == "release") & (at > 0), F.slice(marks, F.lit(1), at - 1)).otherwise(marks)
        return F.struct(new_kept.alias("kept"), new_marks.alias("marks"))

    folded = ops.groupBy("tx_id").agg(row.alias("ops")).select("tx_id", F.aggregate("ops", start, step)["kept"].alias("kept"))
    return folded.select("tx_id", F.explode("kept").alias("seq"))
