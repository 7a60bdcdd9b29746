"""Stupid-backoff language-model scores against the rest of the corpus.

The documents of a task are cut into batches. Each batch explodes its texts into n-grams of every order and sends
each distinct n-gram with its count to the partition of the n-gram's hash. There the counts of all batches add up to the count
table's rows, which are joined back to the batches that asked; a batch then sums the scores of its documents. A
batch asks for an n-gram once, however often it holds it, so a frequent n-gram is no one task's work, and what is
gathered is every n-gram of the corpus.

A document is scored by the counts of all others: its own are taken off. The score of a word is the count of the
longest n-gram ending in it that others hold over that of its context, times ``alpha`` for each order given up; a
word that no other document holds counts as alpha over the others' words and one.

Words are split at ASCII white space, A-Z in lower case. Null texts count as empty: no words, score 0. Repeated rows
are documents of their own, each counted for the others. N-grams are told apart by 64-bit hashes. Columns other than
the two named aren't looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

SCHEMA = "doc_id long, n_words long, log_score double, mean_score double"


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words and the number of words of each text."""
    known: dict[bytes, int] = {}
    digest, parts, sizes = xxhash.xxh64_intdigest, [], np.zeros(len(texts), "i8")
    for i, t in enumerate(texts):
        words = t.encode("utf-8", "surrogatepass").lower().split()
        for w in set(words):
            if w not in known:
                known[w] = digest(w)
        parts.append(np.fromiter(map(known.__getitem__, words), "u8", len(words)))
        sizes[i] = len(words)
    return np.concatenate(parts) if parts else np.empty(0, "u8"), sizes


def ngrams(words: np.ndarray, sizes: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, the hash of the n-gram that ends at each word, and whether there is one within its text."""
    at = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    mix, out, h = np.uint64(0x9E3779B97F4A7C15), [], words
    for n in range(1, order + 1):
        if n > 1:
            before = np.concatenate([np.zeros(1, "u8"), h[:-1]])
            h = (before * mix) ^ (words + np.uint64(n) * np.uint64(0xD6E8FEB86659FD93))
            h = (h ^ (h >> np.uint64(32))) * mix
            h ^= h >> np.uint64(29)
        out.append((h, at >= n - 1))
    return out


def asked(grams: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a batch, sorted, and their counts."""
    return np.unique(np.concatenate([h[ok] for h, ok in grams]), return_counts=True)


def squeezed(keys: np.ndarray) -> bytes:
    """Sorted hashes as their differences, byte by byte of all, so that the high bytes, mostly zeros, take no room."""
    return np.diff(keys, prepend=np.zeros(1, "u8")).view("u1").reshape(-1, 8).T.tobytes()


def unsqueezed(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, "u1").reshape(8, -1).T.copy().view("u8").ravel(), dtype="u8")


def scores(docs: DataFrame, order: int = 2, alpha: float = 0.4, batch_chars: int = 6_000_000, bucket_ngrams: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_score (the sum of natural logarithms) and mean_score of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spaces = r"[\x09-\x0D\x20]+"
    words_in = F.size(F.filter(F.split("text", spaces), lambda w: w != ""))
    chars, everything = (x or 0 for x in rows.agg(F.sum(F.length("text")), F.sum(words_in)).first())
    buckets = int(chars * order // 5 // bucket_ngrams) + 1
    # Sorted hashes are cut into ranges of equal width, one for each bucket.
    cuts = np.array([(i << 64) // buckets for i in range(1, buckets)], "u8")

    def cut(batches):
        """Batches of texts, compressed, numbered within their task: the same ones whenever the task runs."""
        part, n = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def done():
            coded = [t.encode("utf-8", "surrogatepass") for t in texts]
            blob, ends = zstandard.compress(b"".join(coded), 3), np.cumsum([len(t) for t in coded], dtype="i8")
            return pa.record_batch([pa.array([part << 32 | n], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([blob], pa.binary())], ["batch", "ids", "ends", "blob"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= batch_chars or len(ids) >= 50_000:
                    yield done()
                    ids, texts, size, n = [], [], 0, n + 1
        if ids:
            yield done()

    def opened(ends, blob) -> list[str]:
        whole = zstandard.decompress(blob)
        return [whole[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *ends[:-1]], ends, strict=True)] if len(ends) else []

    # Written down, so that both who ask and who score see the same batches whatever the input's plan is.
    dealt = materialize(rows.mapInArrow(cut, "batch long, ids array<long>, ends array<long>, blob binary"))

    def ask(batches):
        for group in batches:
            for batch, ends, blob in zip(*(group[c].to_pylist() for c in ("batch", "ends", "blob")), strict=True):
                words, sizes = word_hashes(opened(ends, blob))
                keys, counts = asked(ngrams(words, sizes, order))
                at = [0, *np.searchsorted(keys, cuts).tolist(), len(keys)]
                parts = [(squeezed(keys[s:e]), counts[s:e].astype("u4").view("u1").reshape(-1, 4).T.tobytes()) for s, e in zip(at, at[1:], strict=False)]
                # Only buckets of which the batch holds something: rows are no more than its n-grams, however many buckets.
                held = [(i, k, c) for i, (k, c) in enumerate(parts) if k]
                yield pa.record_batch([pa.array([batch] * len(held), pa.int64()), pa.array([i for i, _, _ in held], pa.int32()), pa.array([k for _, k, _ in held], pa.binary()), pa.array([c for _, _, c in held], pa.binary())], ["batch", "bucket", "keys", "counts"])

    def add_up(group: pa.Table) -> pa.Table:
        keys = [unsqueezed(k) for k in group["keys"].to_pylist()]
        counts = [np.frombuffer(c, "u1").reshape(4, -1).T.copy().view("u4").ravel() for c in group["counts"].to_pylist()]
        distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, np.concatenate(counts), len(distinct)).astype("u8")[where]
        ends = np.cumsum([len(k) for k in keys])
        out = [t.astype("u1" if len(t) == 0 or t.max() < 1 << 8 else "u4" if t.max() < 1 << 32 else "u8") for t in np.split(total, ends[:-1])]
        return pa.table({"batch": group["batch"], "bucket": group["bucket"], "wide": pa.array([t.dtype.itemsize for t in out], pa.int32()), "totals": pa.array([t.tobytes() for t in out], pa.binary())})

    requests = dealt.mapInArrow(ask, "batch long, bucket int, keys binary, counts binary")
    answers = requests.groupBy("bucket").applyInArrow(add_up, "batch long, bucket int, wide int, totals binary")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = pa.array(left["ids"][0].as_py(), pa.int64())
        words, sizes = word_hashes(opened(left["ends"][0].as_py(), left["blob"][0].as_py()))
        grams = ngrams(words, sizes, order)
        keys, _ = asked(grams)
        got = sorted(zip(right["bucket"].to_pylist(), right["wide"].to_pylist(), right["totals"].to_pylist(), strict=True))
        total = np.concatenate([np.frombuffer(t, f"u{w}").astype("f8") for _, w, t in got]) if got else np.empty(0)
        text_of = np.repeat(np.arange(len(sizes)), sizes)
        others = []
        for h, ok in grams:
            place = np.searchsorted(keys, h[ok])
            pair = text_of[ok] * len(keys) + place
            _, where, own = np.unique(pair, return_inverse=True, return_counts=True)
            found = np.zeros(len(words))
            found[ok] = total[place] - own[where]
            others.append(found)
        rest = everything - sizes[text_of]
        value = np.where(others[0] > 0, others[0] / np.maximum(rest, 1), alpha / (rest + 1.0))
        for n in range(1, order):
            context = np.concatenate([np.zeros(1), others[n - 1][:-1]])
            value = np.where(others[n] > 0, others[n] / np.maximum(context, 1), np.where(grams[n][1], alpha, 1.0) * value)
        log = np.bincount(text_of, np.log(value), len(sizes)) if len(words) else np.zeros(len(sizes))
        return pa.table({"doc_id": ids, "n_words": pa.array(sizes), "log_score": pa.array(log), "mean_score": pa.array(log / np.maximum(sizes, 1))})

    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, SCHEMA)


#: The same scores in SQL, for order 2 and alpha 0.4, rounded.
SQL = r"""
WITH tokens AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS ws FROM documents
), words AS (
  SELECT doc_id, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM tokens)
), one AS (SELECT w, count(*) AS c FROM words GROUP BY w
), two AS (SELECT p, w, count(*) AS c FROM words WHERE p IS NOT NULL GROUP BY p, w
), own1 AS (SELECT doc_id, w, count(*) AS c FROM words GROUP BY doc_id, w
), own2 AS (SELECT doc_id, p, w, count(*) AS c FROM words WHERE p IS NOT NULL GROUP BY doc_id, p, w
), own_context AS (SELECT doc_id, w, c FROM own1
), n AS (SELECT doc_id, len(ws) AS n_words, sum(len(ws)) OVER () AS everything FROM tokens
), each AS (
  SELECT words.doc_id, words.p, one.c - own1.c AS c1, two.c - own2.c AS c2, context.c - oc.c AS cc, everything - n_words AS rest
  FROM words JOIN n USING (doc_id) JOIN one USING (w) JOIN own1 ON own1.doc_id = words.doc_id AND own1.w = words.w
  LEFT JOIN two ON two.p = words.p AND two.w = words.w LEFT JOIN own2 ON own2.doc_id = words.doc_id AND own2.p = words.p AND own2.w = words.w
  LEFT JOIN one AS context ON context.w = words.p LEFT JOIN own_context AS oc ON oc.doc_id = words.doc_id AND oc.w = words.p
), scored AS (
  SELECT doc_id, sum(ln(CASE WHEN p IS NOT NULL AND c2 > 0 THEN c2::DOUBLE / cc
    ELSE (CASE WHEN p IS NULL THEN 1.0 ELSE 0.4 END)::DOUBLE * (CASE WHEN c1 > 0 THEN c1::DOUBLE / rest ELSE 0.4::DOUBLE / (rest + 1) END) END)) AS s FROM each GROUP BY doc_id
)
SELECT doc_id, n_words::BIGINT AS n_words, round(coalesce(s, 0), 6) AS log_score, round(coalesce(s, 0) / greatest(n_words, 1), 6) AS mean_score
FROM n LEFT JOIN scored USING (doc_id)
"""
