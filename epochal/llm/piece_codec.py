"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The pass keeps one surviving piece for each position of a window bounded by the longest piece, with back pointers,
and commits ids as soon as the paths of all survivors converge on one boundary, so a text of any length needs
bounded memory. The vocabulary here is one of pair merges, for which the best-scored path is not what the library
returns; so an edge of the lattice survives only if the piece is compatible with the one before it. Exactly one
path then survives, and its ids are the library's. A batch's words make the pass together, each different word
once (piece_lanes).

Null texts count as empty and give no ids. Repeated rows stay; columns other than the two named aren't looked at;
an empty table gives an empty table.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .piece_lanes import PieceLanes
from .shared import map_arrow, tokenizer_path
from .token_counts import automaton


@functools.lru_cache(maxsize=2)
def lanes(path: str) -> PieceLanes:
    """One set of tables a Python worker."""
    return PieceLanes(automaton(path))


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every whole text."""
    path = tokenizer_path(model)

    def make():
        a = lanes(path)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch([batch.column(0), a.batch(batch.column(1))[0]], ["doc_id", "ids"])

        return f

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), make, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row of ids; null ids give an empty text."""
    path = tokenizer_path(model)

    def make():
        a = automaton(path)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch([batch.column(0), pa.array([a.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

        return f

    return map_arrow(encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")), make, "doc_id long, text string")


def roundtrip(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_ids and whether decoding the ids gives the text back, in one pass over the texts."""
    path = tokenizer_path(model)

    def make():
        a = lanes(path)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, same = a.batch(batch.column(1), decodes=True)
            return pa.record_batch([batch.column(0), ids, ids.value_lengths().cast(pa.int64()), pa.array(same)], ["doc_id", "ids", "n_ids", "decodes"])

        return f

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), make, "doc_id long, ids array<int>, n_ids long, decodes boolean")
