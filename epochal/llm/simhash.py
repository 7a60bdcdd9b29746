"""SimHash near-duplicates over shard BK-trees.

A document's fingerprint holds, bit by bit, the majority over the hashes of its word shingles. Fingerprints link
when at most ``radius`` bits differ, and links chain. Equal fingerprints are one node, so copies cost nothing.

Candidates are found without comparing all with all: the 64 bits are cut into blocks, and two fingerprints within
the radius agree in all but ``radius`` of them, so each fingerprint goes to one shard for every choice of blocks
that agree. The more fingerprints there are, the more blocks are taken, so that shards of random fingerprints stay
small. A shard's fingerprints form a BK-tree: a child hangs on the edge numbered with its Hamming distance to its
parent, and a search follows only the edges within the radius of its own distance. The trees are shards of a
shuffle and aren't broadcast: together they grow with the corpus, and no bound of their size could be proven.

Within a shard only a spanning forest of the links is kept, so a shard of n fingerprints gives at most n - 1 links.
A shard above ``limit`` fingerprints is searched in blocks by tasks of their own.

Null texts count as empty; a text without words has fingerprint zero and is linked like any other. Repeated rows
are rows of one component; extra columns aren't looked at; an empty table gives an empty table. A null id is kept
and never the smallest of a component unless no other is there.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import map_arrow, materialize, texts_of, unused

SEED = 42


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words, repeats included; of fewer words, of all of them."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, "u8")
    whole = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, n: a + 1 + n))
    first = max(0, len(words) - size) + 1
    starts = [0, *(e + 1 for e in ends[: first - 1])]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[s:e], SEED) for s, e in zip(starts, ends[min(size, len(words)) - 1 :], strict=True)), "u8", first)


def fingerprint(text: str, size: int) -> int:
    """A bit is 1 if it is set in more than half of the hashes."""
    h = shingle_hashes(text, size)
    count = np.zeros(64, "i8")
    for at in range(0, len(h), 65_536):
        count += np.unpackbits(h[at : at + 65_536].astype(">u8").view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype="i8")
    return int.from_bytes(np.packbits(2 * count > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its fingerprint as a signed long."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            prints = np.array([fingerprint(t, size) for t in texts_of(batch, "text")], "u8").view("i8")
            return pa.record_batch([batch.column(0), pa.array(prints)], ["doc_id", "fp"])

        return f

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), make, "doc_id long, fp long")


class Forest:
    """Disjoint sets of the numbers below n."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True


class BKTree:
    """Fingerprints by their Hamming distances to their parents."""

    def __init__(self, radius: int):
        self.radius, self.values, self.children = radius, [], []

    def near(self, value: int) -> list[int]:
        """The places of all values within the radius."""
        found, todo, r = [], [0] if self.values else [], self.radius
        while todo:
            i = todo.pop()
            d = (self.values[i] ^ value).bit_count()
            if d <= r:
                found.append(i)
            todo += [j for edge, j in self.children[i].items() if d - r <= edge <= d + r]
        return found

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        at, new = 0, len(self.values) - 1
        while new:
            edge = (self.values[at] ^ value).bit_count()
            at, last = self.children[at].setdefault(edge, new), at
            if self.children[last][edge] == new:
                break


def linked(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that span each group of values which chain within the radius."""
    tree, forest, out = BKTree(radius), Forest(len(values)), []
    for i, v in enumerate(values.tolist()):
        out += [(i, j) for j in tree.near(v) if forest.join(i, j)]
        tree.add(v)
    return out


def linked_blocks(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning links between two blocks of a large shard, by comparing them row by row."""
    forest, out, n = Forest(len(left) + len(right)), [], len(left)
    for i, v in enumerate(left):
        out += [(i, int(j)) for j in np.flatnonzero(np.bitwise_count(right ^ v) <= radius) if forest.join(i, n + int(j))]
    return out


def masks(n: int, radius: int, target: int) -> list[int]:
    """The bits that a shard's fingerprints agree in, for each choice of blocks: as few choices as leave about
    ``target`` random fingerprints of n to a shard."""
    for blocks in range(radius + 1, radius + 4):
        edges = [64 * i // blocks for i in range(blocks + 1)]
        parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
        choices = [sum(c) for c in itertools.combinations(parts, blocks - radius)]
        if n >> min(c.bit_count() for c in choices) <= target:
            break
    return choices


def links(prints: DataFrame, radius: int = 4, target: int = 64, limit: int = 4096) -> DataFrame:
    """Links (a, b: node numbers) that connect all distinct fingerprints within the radius. ``prints``: node, fp."""
    n = prints.count()
    shards = masks(n, radius, target)
    key = lambda m: F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))
    each = prints.select("node", "fp", F.posexplode(F.array(*[key(m) for m in shards])).alias("choice", "bits"))
    # Shards are dealt in groups: a task searches all shards whose keys hash to its group.
    sizes = materialize(each.groupBy("choice", "bits").agg(F.count("*").alias("n")).where("n > 1"))
    small = each.join(sizes.where(F.col("n") <= limit).select("choice", "bits"), ["choice", "bits"]).repartition("choice", "bits").sortWithinPartitions("choice", "bits")

    def search(batches):
        for node, fp in runs(batches, ["choice", "bits"], ["node", "fp"]):
            pairs = linked(fp.view("u8"), radius)
            if pairs:
                i, j = np.array(pairs).T
                yield pa.record_batch([pa.array(node[i]), pa.array(node[j])], ["a", "b"])

    found = small.mapInArrow(search, "a long, b long")
    big = sizes.where(F.col("n") > limit).withColumn("blocks", F.ceil(F.col("n") / limit).cast("int"))
    if big.isEmpty():
        return found
    # A large shard: its fingerprints are dealt into blocks, and each pair of blocks is a task's work.
    dealt = each.join(big, ["choice", "bits"]).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("choice", "bits", "node", "fp", F.col("block").alias("own"), F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        p, q = g["p"].iloc[0], g["q"].iloc[0]
        left, right = (g if p == q else g[g["own"] == p]), (g if p == q else g[g["own"] == q])
        pairs = linked_blocks(left["fp"].to_numpy().view("u8"), right["fp"].to_numpy().view("u8"), radius)
        a, b = left["node"].to_numpy(), right["node"].to_numpy()
        return pd.DataFrame({"a": [a[i] for i, _ in pairs], "b": [b[j] for _, j in pairs]}, dtype="i8")

    return found.unionByName(pairs.groupBy("choice", "bits", "p", "q").applyInPandas(compare, "a long, b long"))


def runs(batches, keys: list[str], values: list[str], rows: int = 50_000):
    """The value columns of each run of equal keys in batches that are sorted by them; ``rows`` are read at once."""
    rest: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            rest.append(batch)
            if sum(b.num_rows for b in rest) < rows:
                continue
        if not rest:
            return
        got = pa.Table.from_batches(rest).combine_chunks()
        cols = [got[k].to_numpy() for k in keys]
        new = np.zeros(max(0, got.num_rows - 1), bool)
        for c in cols:
            new |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
        last = got.num_rows if batch is None else cuts[-1]
        data = [got[v].to_numpy() for v in values]
        for s, e in itertools.pairwise([*cuts, got.num_rows] if batch is None else cuts):
            yield [d[s:e] for d in data]
        rest = [] if batch is None else got.slice(last).to_batches()


def near_duplicates(docs: DataFrame, radius: int = 4, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id: the smallest doc_id that links reach, its own included."""
    prints = materialize(fingerprints(docs, size, id_col, text_col))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.xxhash64(F.first("fp")).alias("__h")).select("fp", "least"))
    # A node is named by the smallest doc_id of its fingerprint, so a component's smallest node is its name. A
    # fingerprint that only rows without an id have takes no part in the graph.
    nodes = distinct.where("least is not null").select(F.col("least").alias("node"), "fp")
    parts = materialize(connected_components(materialize(links(nodes, radius))))
    named = distinct.join(parts, distinct["least"] == parts["node"], "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    return prints.join(materialize(named), "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame, radius: int = 4, size: int = 5, **columns: str) -> DataFrame:
    return near_duplicates(docs, radius, size, **columns).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by similarity. A fingerprint of majorities can't tell a similarity of 0.8 from chance for every kind of
# copy: a fifth of new words at the end moves more bits than as many changes in place would. The least hashes of the
# shingles agree with a probability that is the similarity itself, whatever the kind. Pairs that agree in a band of
# them are then compared exactly on the shingles.
BAND, MISS = 3, 1e-5


def factors(similarity: float) -> np.ndarray:
    """Multipliers of the hashes, ``BAND`` for each band: as many bands as let a pair of the similarity agree in none
    of them with a probability of ``MISS``."""
    bands = max(1, int(np.ceil(np.log(MISS) / np.log1p(-(min(similarity, 0.999) ** BAND)))))
    return np.random.default_rng(SEED).integers(0, 1 << 63, bands * BAND, dtype="u8") * np.uint64(2) + np.uint64(1)


def bands(hashes: np.ndarray, by: np.ndarray) -> list[int]:
    """The bands of a set of shingles as signed longs; a set without shingles has those of its own."""
    least = np.zeros(len(by), "u8")
    if len(hashes):
        least[:] = np.iinfo("u8").max
        for at in range(0, len(hashes), 8192):
            least = np.minimum(least, (by[:, None] * hashes[None, at : at + 8192]).min(axis=1))
    data = least.reshape(-1, BAND)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(data)]


def alike_links(sets: list[np.ndarray], parts: np.ndarray, similarity: float):
    """Pairs of places whose sets are ``similarity`` alike, enough to join all parts that such pairs join. A pair
    joins only after the test on the sets. Of each pair of two parts, one is not in the largest part, so only those
    ask."""
    m = len(sets)
    sizes = np.array([len(x) for x in sets], "i8")
    _, part = np.unique(parts, return_inverse=True)
    counts = np.bincount(part)
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), sizes)[np.argsort(at, kind="stable")]
    many = np.bincount(at)
    first, begin = np.cumsum(many) - many, np.concatenate([[0], np.cumsum(sizes)])
    forest = Forest(len(counts))
    for i in np.flatnonzero(part != counts.argmax()).tolist():
        mine = at[begin[i] : begin[i + 1]]
        n = many[mine]
        both = np.bincount(owner[np.repeat(first[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=m)
        for j in np.flatnonzero(both >= similarity * (sizes[i] + sizes - both)).tolist():
            if forest.join(int(part[i]), int(part[j])):
                yield i, j


def near_copies(docs: DataFrame, similarity: float = 0.8, size: int = 5, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (of the text) and group: texts whose shingles are ``similarity`` alike, in chains, share a group.
    Equal texts are one node. Shards are bands of the least hashes of the shingles: a pair at the similarity shares
    none with a probability of ``MISS``, a more alike one with less. Links are only such pairs as have passed the exact test, and every pair of a shard that they don't connect has
    been tested. Copies of a text cost links in proportion to their number."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))

    by = factors(similarity)

    def to_bands():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [bands(shingle_set(t, size), by) for t in texts_of(batch, "text")]
            return pa.record_batch([*batch.columns[:2], pa.array(found, pa.list_(pa.int64()))], ["doc_id", "key", "bands"])

        return f

    prints = materialize(map_arrow(rows, to_bands, "doc_id long, key long, bands array<long>"))
    each = materialize(prints.groupBy("key").agg(F.first("bands").alias("bands")).select(F.col("key").alias("node"), F.explode("bands").alias("shard")))
    # Shards of the same nodes are one. First each node is compared with the least of its shard.
    of = each.groupBy("shard").agg(F.count("*").alias("m"), F.min("node").alias("least"), F.max("node").alias("most"), F.bit_xor(F.xxhash64("node")).alias("all"))
    sizes = materialize(of.where("m > 1").groupBy("m", "least", "most", "all").agg(F.min("shard").alias("shard")).select("shard", "m", "least"))
    held = materialize(each.join(sizes, "shard"))
    edges = materialize(held.where("least <> node").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct())
    ends = edges.select(F.col("a").alias("key")).unionByName(edges.select(F.col("b").alias("key"))).distinct()

    def sets_of():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch([batch.column(0), pa.array([shingle_set(t, size).tobytes() for t in texts_of(batch, "text")], pa.binary())], ["key", "set"])

        return f

    # One text a key: its copies are told apart by their ids, so that a group of copies is no one task's work.
    held_by = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("held_by")
    one = prints.select("key", held_by).groupBy("key").agg(F.min("held_by").alias("held_by")).join(ends, "key", "left_semi")
    sets = map_arrow(rows.select("key", "text", held_by).join(one, ["key", "held_by"], "left_semi").select("key", "text"), sets_of, "key long, set binary")
    sets = materialize(sets.groupBy("key").agg(F.first("set").alias("set")))

    def check():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "u8"), np.frombuffer(y, "u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            return batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

        return f

    both = edges.join(sets.select(F.col("key").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("set").alias("y")), "b")
    true = materialize(map_arrow(both.select("a", "b", "x", "y"), check, "a long, b long"))
    # Then shards that are still of several parts get the sets themselves, and all pairs of two parts are compared.
    parts = materialize(connected_components(true)).withColumnRenamed("component", "part")
    parted = materialize(held.where("m > 2").join(parts, "node", "left").select("shard", "node", "m", F.coalesce("part", "node").alias("part")))
    mixed = parted.groupBy("shard").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("shard")
    asked = materialize(parted.join(mixed, "shard"))
    if not asked.isEmpty():
        full = asked.join(sets.withColumnRenamed("key", "node"), "node")

        def links_of(node, part, packed):
            pairs = list(alike_links([np.frombuffer(x, "u8") for x in packed], part, similarity))
            return [int(node[i]) for i, _ in pairs], [int(node[j]) for _, j in pairs]

        def search(batches):
            for columns in runs(batches, ["shard"], ["node", "part", "set"], 1000):
                a, b = links_of(*columns)
                if a:
                    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        found = full.where(F.col("m") <= limit).select("shard", "node", "part", "set").repartition("shard").sortWithinPartitions("shard").mapInArrow(search, "a long, b long")
        if not asked.where(F.col("m") > limit).isEmpty():
            # A large shard is dealt into blocks, and each two of them are a task's work.
            dealt = full.where(F.col("m") > limit).withColumn("blocks", F.ceil(2 * F.col("m") / limit).cast("int"))
            dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("own <> other")
            pairs = pairs.select("shard", "node", "part", "set", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))

            def compare(g: pd.DataFrame) -> pd.DataFrame:
                a, b = links_of(g["node"].to_numpy(), g["part"].to_numpy(), g["set"])
                return pd.DataFrame({"a": a, "b": b}, dtype="i8")

            found = found.unionByName(pairs.groupBy("shard", "p", "q").applyInPandas(compare, "a long, b long"))
        true = materialize(true.unionByName(found))
    parts = connected_components(true)
    return prints.join(materialize(parts), prints["key"] == F.col("node"), "left").select("doc_id", prints["key"], F.coalesce("component", prints["key"]).alias("group"))


def shingle_set(text: str, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def joined_groups(groups: DataFrame, prints: DataFrame) -> DataFrame:
    """The groups (doc_id, key, group) with those made one that components (doc_id: a key; component_id) connect."""
    links = groups.select(F.col("key").alias("a"), F.col("group").alias("b")).unionByName(prints.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))
    parts = materialize(connected_components(materialize(links.where("a <> b").distinct())))
    return groups.join(parts, groups["key"] == F.col("node"), "left").select("doc_id", "key", F.coalesce("component", "group").alias("group"))


def keep_one(docs: DataFrame, similarity: float = 0.8, size: int = 5, radius: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each group of near copies: the one of the smallest id, null ids last; of rows that
    are equal in id and text, any one. Texts are linked by their fingerprints, through the shards' BK-trees, and by
    the similarity of their shingles, which finds copies that move more bits; links of both kinds chain."""
    found = near_copies(docs, similarity, size, id_col=id_col, text_col=text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    prints = near_duplicates(docs.select(F.xxhash64(text).alias("doc_id"), text.alias("text")), radius, words)
    groups = materialize(joined_groups(materialize(found), prints))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("x")
    id_name, key_name = unused("__id", docs.columns), unused("__key", docs.columns)
    kept = groups.groupBy("group").agg(first).select(F.col("x.doc_id").alias(id_name), F.col("x.key").alias(key_name))
    one = docs.join(kept, docs[id_col].cast("long").eqNullSafe(F.col(id_name)) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == F.col(key_name)), "left_semi")
    again = groups.groupBy("doc_id", "key").count().where("count > 1")
    return one if again.isEmpty() else one.dropDuplicates([id_col, text_col])
