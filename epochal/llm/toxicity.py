"""Toxicity by compression distance: two zstandard dictionaries, one of ordinary and one of toxic text.

A text is cut into short windows of whole words. Each window is compressed with either dictionary; how many bytes
the toxic one saves over the ordinary one says how much of the window is known from toxic text alone. Both hold
the same ordinary text at the same distance, so a window without toxic text costs the same under both. Every window
is led by a fixed phrase that both hold: it is then always coded as matches, and no saving is lost in fixed costs.

The dictionaries' content is learned on a bounded sample of labelled rows, ``sample`` a class, those of the smallest
hashes: words and their fragments that many toxic texts and hardly any ordinary text hold make the toxic part;
ordinary windows are the ordinary part, and those that the toxic part wrongly helps to compress join it, round by
round. A logistic curve over the savings is calibrated on the same rows and gives the score.

Null and empty texts have one empty window that saves nothing; their score is that of a clean text. Repeated rows
each get their score; labels that are null or of no document are left out; columns other than those named aren't
looked at; an empty table gives an empty table. Without labels of both classes every score is 0.
"""

from __future__ import annotations

import dataclasses
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, own, texts_of, unused

WORD = re.compile(r"[^\W\d_]+")
WINDOW = 64
GRAM = 5
#: The phrase that leads each window, and what stands in the ordinary dictionary where the toxic one has its own part.
LEAD, FILL = bytes(range(128, 160)), b"\x01"
SHAPE = {"strategy": zstandard.STRATEGY_LAZY2, "min_match": 5, "window_log": 18, "hash_log": 17, "chain_log": 18, "search_log": 7, "write_content_size": False, "write_checksum": False, "write_dict_id": False}


def words(text: str) -> list[bytes]:
    return [w.encode() for w in WORD.findall(text.lower())]


def windows(text: str) -> list[bytes]:
    """Whole words in lower case with a space on either side, up to WINDOW bytes; longer words are cut."""
    out, now, size = [], [], 1
    for w in words(text):
        for w in [w] if len(w) <= WINDOW - 2 else [w[i : i + WINDOW - 2] for i in range(0, len(w), WINDOW - 2)]:
            if size + len(w) + 1 > WINDOW:
                out.append(b" " + b" ".join(now) + b" ")
                now, size = [], 1
            now.append(w)
            size += len(w) + 1
    return [*out, b" " + b" ".join(now) + b" "]


@dataclasses.dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]

    def compressors(self) -> tuple:
        make = lambda data: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=zstandard.ZstdCompressionParameters(**SHAPE)).compress
        return make(self.ordinary + FILL * len(self.toxic) + LEAD), make(self.ordinary + self.toxic + LEAD)


def savings(text: str, plain, toxic) -> list[int]:
    return [len(plain(LEAD + w)) - len(toxic(LEAD + w)) for w in windows(text)]


def features(saved: list[int]) -> list[float]:
    """The largest saving, how many windows save much, by several marks, and the number of windows."""
    found = [np.log1p(sum(x >= mark for x in saved)) for mark in (2, 3, 4, 6)]
    return [1.0, min(max(saved), 10), *found, np.log1p(len(saved))]


def distinctive(toxic: list[str], ordinary: list[str], least: float, ratio: float, most: int) -> list[bytes]:
    """Fragments and words that many toxic texts hold and hardly any ordinary one, at most ``most`` of them, the most
    frequent last."""

    def held(text: str) -> set[bytes]:
        found = {b" " + w + b" " for w in words(text)}
        return found | {w[i : i + n] for w in found for n in range(GRAM, 2 * GRAM) for i in range(len(w) - n)}

    here, there = Counter(), Counter()
    for t in toxic:
        here.update(held(t))
    need = max(4, least * len(toxic))
    here = {g: c for g, c in here.items() if c >= need}
    for t in ordinary:
        there.update(here.keys() & held(t))
    good = {g: c for g, c in here.items() if c / len(toxic) > ratio * (there[g] + 0.5) / (len(ordinary) + 1)}
    kept: list[bytes] = []
    for g in sorted(good, key=lambda g: (-len(g), g)):
        # A shorter one adds nothing to a longer one that about as many texts hold.
        if not any(g in k and good[k] >= 0.6 * good[g] for k in kept):
            kept.append(g)
    return sorted(kept, key=lambda g: (good[g], g))[-most:]


def fit(toxic: list[str], ordinary: list[str], least: float = 0.01, ratio: float = 30.0, size: int = 16_384, fragments: int = 2000, rounds: int = 4, seed: int = 1) -> Model:
    """The dictionaries and the curve: ``fragments`` bounds the toxic part, ``size`` the bytes of ordinary windows that
    each round puts into the ordinary one."""
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    if not toxic or not ordinary:
        return Model(b"", b"", ())
    rng = np.random.default_rng(seed)
    bad = b"\n".join(distinctive(toxic, ordinary, least, ratio, fragments))
    pool = [w for t in ordinary for w in windows(t)]
    plain = b"".join(pool[i] for i in rng.permutation(len(pool))[: size // WINDOW])
    for _ in range(rounds):
        model = Model(bad, plain, ())
        pair = model.compressors()
        wrong = Counter(w for t in ordinary for w, s in zip(windows(t), savings(t, *pair), strict=True) if s >= 2)
        if not wrong:
            break
        plain = b"".join(w for w, _ in wrong.most_common(size // WINDOW)) + plain
    pair = Model(bad, plain, ()).compressors()
    x = np.array([features(savings(t, *pair)) for t in [*toxic, *ordinary]])
    y = np.array([1.0] * len(toxic) + [0.0] * len(ordinary))
    return Model(bad, plain, tuple(logistic(x, y)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights by Newton's method, shrunk a little."""
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(x.shape[1])
    keep[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = 2000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from at most ``sample`` toxic and twice as many ordinary labelled rows, none of them held out."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and id is not null")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in ((1, sample), (0, 2 * sample))]
    # Bounded by ``sample``: the ids, and then their texts.
    chosen = F.broadcast(picked[0].unionByName(picked[1]))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(chosen, "id").groupBy("id", "y").agg(F.min("text").alias("text")).orderBy("id").collect()
    return fit([r["text"] for r in rows if r["y"] == 1], [r["text"] for r in rows if r["y"] == 0])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scorer(model: Model):
    if not model.weights:
        return lambda text: 0.0
    pair, w = model.compressors(), np.array(model.weights)

    def score(text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(features(savings(text, *pair)), w), -30, 30))))

    return score


def with_score(docs: DataFrame, model: Model, name: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Some columns of the documents and the score of their texts. The model, some tens of KB, goes with the tasks."""
    keep = docs.columns if keep is None else keep

    def make():
        score = scorer(model)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.select(keep).append_column(name, pa.array([score(t) for t in texts_of(batch, text_col)], pa.float64()))

        return f

    types = dict(docs.dtypes)
    return map_arrow(docs, make, ", ".join(f"`{c}` {types[c]}" for c in keep) + f", `{name}` double")


def report(docs: DataFrame, labels: DataFrame, sample: int = 2000) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = with_score(rows, train(docs, labels, sample), "score", keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, sample: int = 2000) -> DataFrame:
    """The documents without the toxic ones."""
    name = unused("__score", docs.columns)
    return with_score(docs, train(docs, labels, sample), name).where(F.col(name) < 0.5).select(own(docs))
