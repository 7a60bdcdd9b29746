"""SpotSigs fingerprints in DataFrame functions alone.

Common words are anchors: each of them, with the next two content words behind it, is a spot signature, and a text's
fingerprint is the set of their hashes. A text without any such chain takes the pairs of its neighbouring words, one
of a single word that word, one without words its characters as they are, so that no two texts are alike for want of
anchors alone.

Likeness is the Jaccard similarity of two sets. For near-duplicates over a corpus, sets are dealt by the hashes that
a prefix filter needs and by ranges of set length: sets whose lengths differ more than the threshold allows never
meet, and those that do are compared exactly.

Null texts count as empty. Repeated rows each get their result, in the order of their id, then their text. A null id
comes first. Columns other than those named aren't looked at; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import materialize

# Frequent words of four languages, which serve as anchors.
ANCHORS = (
    "the of and to in is that it for on as with was at by be this are or an from which a "
    "le la les de des et en un une du que qui dans pour par sur est au aux avec ou "
    "der die das und ist den dem ein eine nicht von mit auf im sich auch zu für "
    "el los las y una por con para se su lo del al como más es"
).split()


def with_spots(rows: DataFrame, name: str, text: Column, chain: int = 2) -> DataFrame:
    """Adds the set of hashes of a text's spot signatures, sorted. The steps are columns of their own, since what a
    lambda refers to is computed anew for each element unless it is one."""
    t = {k: f"__{name}_{k}" for k in ("words", "runs", "last", "chains")}
    plain = F.regexp_replace(F.lower(text), r"[^\pL\pN]+", " ")
    rows = rows.withColumn(t["words"], F.filter(F.split(plain, " "), lambda w: w != ""))
    # One stretch for each content word: the anchors before it, and itself. (A pattern with a repeated group would
    # overflow the matcher's stack on a long run of anchors.)
    ended = F.array_join(F.transform(t["words"], lambda w: F.when(w.isin(sorted(set(ANCHORS))), w).otherwise(F.concat(w, F.lit("|")))), " ")
    rows = rows.withColumn(t["runs"], F.split(ended, "[|]"))
    rows = rows.withColumn(t["runs"], F.transform(F.slice(t["runs"], 1, F.size(t["runs"]) - 1), lambda r: F.split(F.ltrim(r), " ")))
    rows = rows.withColumn(t["last"], F.transform(t["runs"], lambda r: F.element_at(r, -1)))
    last = F.col(t["last"])

    def signed(run: Column, i: Column) -> Column:
        return F.transform(F.slice(run, 1, F.size(run) - 1), lambda a: F.xxhash64(F.concat(F.lit("!"), a), *[F.get(last, i + j) for j in range(chain)]))

    rows = rows.withColumn(t["chains"], F.flatten(F.transform(F.slice(t["runs"], 1, F.greatest(F.size(t["runs"]) - (chain - 1), F.lit(0))), signed)))
    words = F.col(t["words"])
    pairs = F.transform(F.slice(words, 1, F.size(words) - 1), lambda w, i: F.xxhash64(w, F.get(words, i + 1)))
    alone = F.array(F.when(F.size(words) == 1, F.xxhash64(F.get(words, F.lit(0)))).otherwise(F.xxhash64(text)))
    chosen = F.when(F.size(t["chains"]) > 0, F.col(t["chains"])).when(F.size(words) > 1, pairs).otherwise(alone)
    return rows.withColumn(name, F.array_sort(F.array_distinct(chosen))).drop(*t.values())


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard similarity of two sets that aren't empty."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def spelled(prints: Column) -> Column:
    """A set of hashes as a string."""
    return F.array_join(F.transform(prints, lambda h: F.lower(F.hex(h))), ",")


def neighbours(docs: DataFrame, block: int) -> DataFrame:
    """Every document and its fingerprint with those of the next one by ascending id (after the last, the first), dealt
    by ranges of ids; only each range's first document is needed elsewhere."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("block", F.expr(f"coalesce(doc_id div {block}, -9223372036854775807)"))
    order = [F.asc_nulls_first("doc_id"), F.asc("text")]
    least = F.struct(F.col("doc_id").isNotNull().alias("n"), F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("text").alias("text"))
    firsts = rows.groupBy("block").agg(F.min(least).alias("first")).select(F.col("block").alias("next"), F.col("first.text").alias("after"))
    # Which range comes next is found by the ranges' numbers alone; its first text is then looked up.
    ranges = Window.orderBy("block")
    whole = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbers = rows.select("block").distinct().select("block", F.coalesce(F.lead("block").over(ranges), F.first("block").over(whole)).alias("next"))
    after = numbers.join(firsts, "next").select("block", "after")
    within = Window.partitionBy("block").orderBy(*order)
    # The window and the join need the same partitions, so texts are dealt out once, and fingerprints, which are taken
    # after that, not at all.
    dealt = with_spots(rows.repartition("block"), "a", F.col("text"))
    here = dealt.withColumn("following", F.lead("text").over(within)).withColumn("c", F.lead("a").over(within))
    there = here.join(with_spots(after, "z", F.col("after")), "block")
    return there.select("doc_id", "text", "a", F.coalesce("following", "after").alias("following"), F.coalesce("c", "z").alias("c"))


def report(docs: DataFrame, block: int = 500) -> DataFrame:
    """The fingerprints of every text, of its edited form and the likeness of both and of the next document's."""
    rows = neighbours(docs, block)
    cut = F.expr("length(text) div 4")
    edited = F.concat(F.expr("left(text, length(text) - length(text) div 4)"), F.substring(F.col("following"), F.lit(1), cut))
    rows = with_spots(rows.withColumn("edited", edited), "b", F.col("edited"))
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"), spelled(F.col("a")).alias("fingerprint"), spelled(F.col("b")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id: the smallest id that chains of sets at least ``threshold`` alike reach. Equal sets are
    one node. A pair as alike as that shares one of the first hashes of both sets, in the order of their rarity, and
    their lengths lie in the same or neighbouring ranges; so sets are dealt by those two."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    prints = materialize(with_spots(rows, "set", F.col("text")).select("doc_id", "set"))
    nodes = materialize(prints.groupBy("set").agg(F.min("doc_id").alias("node")).where("node is not null"))
    rarity = nodes.select(F.explode("set").alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    ranked = nodes.select("node", F.size("set").alias("n"), F.explode("set").alias("h")).join(rarity, "h")
    ranked = ranked.groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("hs"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold))).cast("int")
    prefix = F.slice("hs", 1, (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int"))
    keys = materialize(ranked.select("node", "n", band.alias("band"), F.explode(F.transform(prefix, lambda x: x["h"])).alias("h")))
    left = keys.select(F.col("node").alias("a"), F.col("n").alias("na"), "h", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    pairs = left.join(keys, ["h", "band"]).where((F.col("a") != F.col("node")) & (F.least("na", "n") >= threshold * F.greatest("na", "n"))).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    sets = nodes.select("node", "set")
    sure = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b").where(likeness(F.col("x"), F.col("y")) >= threshold)
    parts = connected_components(sure.select("a", "b"))
    named = nodes.join(parts, "node", "left").select("set", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "set", "left").select("doc_id", "component_id")
