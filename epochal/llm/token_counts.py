"""Token counts without encoding: a finite-state transducer whose transitions carry emitted-token counts.

The piece vocabulary is compiled, as characters are met, into a deterministic transducer (piece_automaton). Texts
longer than ``chunk`` code points are cut into chunks; each chunk's map from the state before it to its count and
the state after it is computed alone, and the maps compose by a parallel prefix scan: neighbours in blocks of
``fan`` first, then the blocks, until one map a text is left. Composition is associative, so the cuts are free.

Null texts count as empty; an empty text has no token. Repeated rows stay, each with its count. Other columns
are not looked at, so clashing names don't matter. An empty table gives an empty table.
"""

from __future__ import annotations

import functools

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .piece_automaton import PieceAutomaton
from .shared import chunked, map_arrow, texts_of, tokenizer_path

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


@functools.lru_cache(maxsize=2)
def automaton(path: str) -> PieceAutomaton:
    """One automaton a Python worker: what one task has compiled serves the next."""
    return PieceAutomaton(path)


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", chunk: int = 65_536, fan: int = 64) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every whole text."""
    path = tokenizer_path(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def count_whole():
        a = automaton(path)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch, "text")
            return pa.record_batch([batch.column(0), pa.array([a.count_text(t) for t in texts], pa.int64())], ["doc_id", "n_tokens"]).append_column("n_bytes", pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())).select(["doc_id", "n_bytes", "n_tokens"])

        return f

    def map_chunks():
        a = automaton(path)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            maps = [a.chunk_map(t) for t in texts_of(batch, "piece")]
            cols = [pa.array(list(x), t) for x, t in zip(zip(*maps, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)]
            n = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts_of(batch, "piece")], pa.int64())
            return pa.record_batch([*batch.columns[:3], n, *cols], ["row", "doc_id", "chunk", "n_bytes", "head", "n", "tail"])

        return f

    def compose(group: pd.DataFrame) -> pd.DataFrame:
        a = automaton(path)
        group = group.sort_values("chunk")
        maps = [(h, int(n), t if isinstance(t, str) else None) for h, n, t in zip(group["head"], group["n"], group["tail"], strict=True)]
        while len(maps) > 1:
            maps = [a.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return pd.DataFrame({"row": group["row"].iloc[:1], "doc_id": group["doc_id"].iloc[:1], "chunk": group["chunk"].iloc[:1] // fan, "n_bytes": [group["n_bytes"].sum()], "head": [maps[0][0]], "n": [maps[0][1]], "tail": pd.Series([maps[0][2]], dtype=object).to_numpy(), "total": [a.finish(maps[0])]})

    short = map_arrow(rows.where(F.length("text") <= chunk), count_whole, "doc_id long, n_bytes long, n_tokens long")
    long = rows.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id())
    # A long text's chunks are dealt over the cluster, so that one huge text isn't one task's work.
    pieces = chunked(long, ["row", "doc_id"], "text", chunk).repartition("row", "chunk")
    maps = map_arrow(pieces, map_chunks, "row long, doc_id long, chunk int, n_bytes long, head string, n long, tail string")
    out = "row long, doc_id long, chunk int, n_bytes long, head string, n long, tail string, total long"
    blocks = maps.groupBy("row", F.expr(f"chunk div {fan}").alias("block")).applyInPandas(lambda g: compose(g.drop(columns=["block"], errors="ignore")), out)
    scanned = blocks.groupBy("row").applyInPandas(compose, out).select("doc_id", "n_bytes", F.col("total").alias("n_tokens"))
    return short.unionByName(scanned).withColumn("over_limit", F.col("n_tokens") > limit)
