"""Best-fit packing of token sequences, bulk-synchronously.

Documents longer than half a sequence open one each. A superstep then sorts the shorter ones and the gaps into ranges
of descending size, gaps before documents of the same size, and sweeps over them: a document takes the last gap before
it that is still free, which is the smallest that holds it (its successor). Each range is swept alone; what is left of
it, free gaps and documents that found none, is matched with the other ranges' by their numbers alone, and ranks say
which document takes which gap. A gap much larger than the longest document stands for as many as it surely holds.
Then the gaps are updated and the superstep is repeated. Where no gap holds any of the documents left, the longest of
them, as many as sequences are needed for sure, open sequences. The number of supersteps hangs on the lengths and not
on how many documents there are; sequences are as few as best fit one by one gives, to some hundredths of a percent.

Every superstep's tables are written to the shared folder. The driver sees one row a range: how many are left.

Null texts count as empty: a document of only the end id. Equal rows are packed each for itself; other columns
are not looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import map_arrow, materialize, texts_of, tokenizer_path

#: How byte-level vocabularies split a text before merging (a fixed value of their published tokenizers).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space on which regular-expression libraries differ, the special string, and runs of white space that would
#: exhaust the stack of the faster one: such texts take the slower library.
ODD = re.compile(r"[\x1c-\x1f\x85]|<\|endoftext\|>|\s{10000}")


class ByteEncoder:
    """Ids as the tokenizers library gives them for a byte-level vocabulary. Its merges are applied by tiktoken,
    which gives the same ids several times faster; texts on which the two may differ go to the library itself."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # Byte-level vocabularies write a printable byte as itself and the others as the letters from U+0100 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(byte[c] for c in token): i for token, i in self.library.get_vocab(with_added_tokens=False).items()}
        self.fast = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if ODD.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text).astype("<u4")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def cut(docs: DataFrame, width: int = 1024, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, keep: str = "ids", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length and their ids (array<int>) or, with
    ``keep="crc32"``, only the checksum of these. The first piece of a document may be shorter than ``width``."""
    path = tokenizer_path(tokenizer)
    end = np.array([end_id], "<u4")

    def make():
        enc = encoder(path)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            doc, piece, start, length, kept = [], [], [], [], []
            for d, text in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), strict=True):
                ids = np.append(enc.encode(text), end)
                at, n = 0, len(ids)
                size = n % width or min(n, width)
                for k in range(-(-n // width)):
                    doc.append(d)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    part = ids[at : at + size]
                    kept.append(zlib.crc32(part.tobytes()) if keep == "crc32" else part.astype("i4"))
                    at, size = at + size, width
            last = pa.array(kept, pa.int64() if keep == "crc32" else pa.list_(pa.int32()))
            return pa.record_batch([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), last], ["doc_id", "piece", "start", "length", "kept"])

        return f

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kind, name = ("long", "ids_crc32") if keep == "crc32" else ("array<int>", "ids")
    return map_arrow(rows, make, f"doc_id long, piece int, start long, length long, kept {kind}").withColumnRenamed("kept", name)


def swept(size: np.ndarray, is_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gaps and documents in descending order of size, matched like brackets: places of matched gaps, of the documents
    that take them, of documents left and of gaps left, the last free one at the end."""
    depth = np.cumsum(np.where(is_doc, -1, 1))
    low = np.minimum.accumulate(np.minimum(depth, 0))
    left = is_doc & (low < np.concatenate([[0], low[:-1]]))
    level, at = np.where(is_doc, depth + 1, depth), np.flatnonzero(~left)
    order = at[np.lexsort((at, level[at]))]
    # Within a level gaps and documents take turns.
    pair = np.flatnonzero((level[order[:-1]] == level[order[1:]]) & ~is_doc[order[:-1]] & is_doc[order[1:]])
    gaps = order[pair]
    free = ~is_doc
    free[gaps] = False
    return gaps, order[pair + 1], np.flatnonzero(left), np.flatnonzero(free)


def across(ranges: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """What documents that found no gap in their range take of the gaps left in the ranges before, the nearest and
    last first. ``ranges``: number, documents left, gaps left, in order. Rows of (document's range, first rank, gap's
    range, the last gap's rank, how many); ranks of gaps go down as those of documents go up."""
    free: list[list[int]] = []
    out = []
    for number, docs, gaps in ranges:
        rank = 0
        while rank < docs and free:
            n = min(docs - rank, free[-1][1])
            out.append((number, rank, free[-1][0], free[-1][1] - 1, n))
            rank += n
            free[-1][1] -= n
            if not free[-1][1]:
                free.pop()
        if gaps:
            free.append([number, gaps])
    return out


STATE = "kind string, pid long, length int, seq long, gap int, range int, rank long"


def superstep(docs: DataFrame, gaps: DataFrame, widest: int, rows: int, per_range: int) -> DataFrame:
    """One sweep of documents (pid, length of at most ``widest``) over gaps (seq, gap): rows of kind match, or doc and
    gap for what is left of each range, with ranks within it."""
    slots = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.col("gap") / widest).cast("int")))).alias("slot")
    free = gaps.select(F.col("gap").alias("size"), F.lit(False).alias("is_doc"), F.col("seq").alias("id"), slots)
    wanted = docs.select(F.col("length").alias("size"), F.lit(True).alias("is_doc"), F.col("pid").alias("id"), F.lit(0).alias("slot"))
    # Equal sizes are spread over ranges by a hash, so a very common length is no one task's work.
    order = [F.desc("size"), F.asc("is_doc"), F.xxhash64("id", "slot")]
    both = free.unionByName(wanted).repartitionByRange(max(4, rows // per_range + 1), *order).sortWithinPartitions(*order)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [b for b in batches if b.num_rows]
        if not read:
            return
        t = pa.Table.from_batches(read)  # a range has about ``per_range`` rows
        size, is_doc, ids = t["size"].to_numpy(), t["is_doc"].to_numpy(), t["id"].to_numpy()
        here = TaskContext.get().partitionId()
        g, d, docs_left, gaps_left = swept(size, is_doc)

        def table(kind: str, n: int, **columns) -> pa.RecordBatch:
            zero = np.zeros(n, "i8")
            get = lambda c, t: pa.array(columns.get(c, zero).astype(t))
            return pa.record_batch([pa.array([kind] * n, pa.string()), get("pid", "i8"), get("length", "i4"), get("seq", "i8"), get("gap", "i4"), pa.array(np.full(n, here, "i4")), get("rank", "i8")], ["kind", "pid", "length", "seq", "gap", "range", "rank"])

        yield table("match", len(g), pid=ids[d], length=size[d], seq=ids[g], gap=size[g])
        yield table("doc", len(docs_left), pid=ids[docs_left], length=size[docs_left], rank=np.arange(len(docs_left)))
        yield table("gap", len(gaps_left), seq=ids[gaps_left], gap=size[gaps_left], rank=np.arange(len(gaps_left)))

    return both.mapInArrow(sweep, STATE)


def met(left: DataFrame, moves: list[tuple[int, int, int, int, int]]) -> tuple[DataFrame, DataFrame]:
    """The documents that take a gap of another range (pid, length, seq), and those that found none."""
    m = np.array(moves, "i8").reshape(-1, 5)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_doc, by_gap = np.lexsort((m[:, 1], m[:, 0])), np.lexsort((m[:, 3], m[:, 2]))
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            doc, part, rank = col("kind") == "doc", col("range").astype("i8"), col("rank")
            far = np.int64(1) << 40
            k = np.searchsorted(m[by_doc, 0] * far + m[by_doc, 1], part * far + rank, "right") - 1
            i = by_doc[np.maximum(k, 0)]
            at = np.where((k >= 0) & (m[i, 0] == part) & (rank < m[i, 1] + m[i, 4]), rank - m[i, 1], -1)
            k = np.minimum(np.searchsorted(m[by_gap, 2] * far + m[by_gap, 3], part * far + rank, "left"), len(m) - 1)
            j = by_gap[k]
            down = np.where((m[j, 2] == part) & (rank <= m[j, 3]) & (rank > m[j, 3] - m[j, 4]), m[j, 3] - rank, -1)
            move, step = np.where(doc, i, j), np.where(doc, at, down)
            yield batch.append_column("move", pa.array(move)).append_column("step", pa.array(step))

    tagged = left.mapInArrow(tag, f"{STATE}, move long, step long")
    taken = tagged.where("kind = 'doc' and step >= 0").select("move", "step", "pid", "length")
    given = tagged.where("kind = 'gap' and step >= 0").select("move", "step", "seq")
    return taken.join(given, ["move", "step"]).select("pid", "length", "seq"), tagged.where("kind = 'doc' and step < 0").select("pid", "length", "range", "rank")


def place(pieces: DataFrame, width: int = 1024, per_range: int = 500_000) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces with a column length between 1 and ``width``. A sequence has
    the number of the piece that opened it."""
    names, half = pieces.columns, width // 2
    rows = materialize(pieces.withColumn("__pid", F.monotonically_increasing_id()))
    items = rows.select(F.col("__pid").alias("pid"), F.col("length").cast("int").alias("length"))
    many = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most ``width`` rows
    opened = lambda docs: docs.select(F.col("pid").alias("seq"), (F.lit(width) - F.col("length")).alias("gap"))
    gaps, docs = opened(items.where((F.col("length") > half) & (F.col("length") < width))), items.where(F.col("length") <= half)
    n_gaps, n = sum(c for m, c in many.items() if half < m < width), sum(c for m, c in many.items() if m <= half)
    least, most = min(many, default=0), max((m for m in many if m <= half), default=0)
    # A sequence's pieces lie in the order in which they came: the one that opened it, then those of each superstep.
    placed = [items.where(F.col("length") > half).select("pid", "length", F.col("pid").alias("seq"), F.lit(-1).alias("step"))]
    while n:
        state = materialize(superstep(docs, gaps.where(F.col("gap") >= least), most, n + n_gaps, per_range))
        of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
        room = F.greatest(F.max(of("gap", "gap")), F.max(of("match", "gap") - F.col("length")))
        told = sorted(state.groupBy("range").agg(*[F.count(of(k, "rank")).alias(k) for k in ("doc", "gap", "match")], F.sum(of("doc", "length")).alias("tokens"), F.min(of("doc", "length")).alias("least"), F.max(of("doc", "length")).alias("most"), room.alias("room")).collect(), key=lambda r: r["range"])
        moves = across([(r["range"], r["doc"], r["gap"]) for r in told])
        matched, docs = state.where("kind = 'match'").select("pid", "length", "seq"), state.where("kind = 'doc'").select("pid", "length", "range", "rank")
        if moves:
            more, docs = met(state.where("kind <> 'match'"), moves)
            matched = matched.unionByName(materialize(more))
        n -= sum(r["match"] for r in told) + sum(m[4] for m in moves)
        placed.append(matched.withColumn("step", F.lit(len(placed))))
        if not n:
            break
        changes = gaps.unionByName(matched.select("seq", (-F.col("length")).alias("gap")))
        least, most = (f(r[c] for r in told if r["doc"]) for f, c in ((min, "least"), (max, "most")))
        if not moves and max((r["room"] or 0 for r in told), default=0) < least:
            # No gap holds any: the longest open as many sequences as their tokens need at least.
            new, at, first = min(n, -(-sum(r["tokens"] or 0 for r in told) // width)), 0, []
            for r in told:
                first += [F.lit(r["range"]), F.lit(at)]
                at += r["doc"]
            docs = docs.withColumn("opens", F.create_map(*first)[F.col("range")] + F.col("rank") < new)
            opens, docs = docs.where("opens"), docs.where("not opens")
            placed.append(opens.select("pid", "length", F.col("pid").alias("seq"), F.lit(len(placed)).alias("step")))
            changes = changes.unionByName(opened(opens))
            n, n_gaps = n - new, n_gaps + new
        docs = docs.select("pid", "length")
        gaps = materialize(changes.groupBy("seq").agg(F.sum("gap").cast("int").alias("gap")).where("gap > 0"))
    before = Window.partitionBy("seq").orderBy("step", F.desc("length"), "pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = functools.reduce(DataFrame.unionByName, placed).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    return rows.join(offsets.select("pid", "seq", "offset"), F.col("__pid") == F.col("pid")).select(*names, F.col("seq").alias("sequence_id"), "offset")


def pack(docs: DataFrame, width: int = 1024, keep: str = "ids", **options) -> DataFrame:
    """Every document's pieces with their sequence and their offset in it."""
    return place(cut(docs, width, keep=keep, **options), width)
