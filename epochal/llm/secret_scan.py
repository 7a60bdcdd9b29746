"""Secret scans with corpus-wide ownership frequency.

Patterns find candidates in every whole text. The hash of each candidate's value is counted over the corpus by
distinct repositories and distinct owners: a value that many owners have is a widely copied example, one that few
have looks live. Values that only look random (long, of mixed characters) count as secrets when they aren't shared.

Null texts count as empty: no spans. Repeated rows each get their result. A null owner or repository counts as one
of its own. Columns other than those named aren't looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, materialize, texts_of, unused

# The patterns and least lengths of the base kinds, in the order that ties take.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST = 6
WORDS = ("passw", "secret", "token", "api")

RANDOM = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])")
BITS = 3.5


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place in KINDS, end, value) in order; the kind random only outside of the others."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    more = [(m.start(), 3, m.end(), m[0]) for m in RANDOM.finditer(text) if entropy(m[0]) >= BITS]
    return sorted(found + [x for x in more if not any(x[0] < y[2] and y[0] < x[2] for y in found)])


def spelled(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """One row per document: its key, counts, digest and candidates."""

    def make():
        item = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("hash", pa.string())])

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [candidates(t) for t in texts_of(batch, "text")]
            base = [[x[:3] for x in xs if x[1] < 3] for xs in found]
            n = [pa.array([sum(x[1] == k for x in xs) for xs in base], pa.int64()) for k in range(3)]
            sums = pa.array([hashlib.sha256(spelled(xs).encode()).hexdigest() for xs in base])
            cands = pa.array([[{"start": s, "kind": k, "end": e, "hash": hashlib.sha256(v.encode()).hexdigest()[:32]} for s, k, e, v in xs] for xs in found], pa.list_(item))
            return pa.record_batch([*batch.columns[:4], *n, sums, cands], ["doc_id", "key", "owner", "repo", "n_assign", "n_access", "n_hex", "base_sha256", "found"])

        return f

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key(id_col, text_col, owner_col, repo_col).alias("key"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), text.alias("text"))
    return map_arrow(rows, make, "doc_id long, key long, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start:long,kind:int,end:long,hash:string>>")


def key(*columns: str):
    """What tells rows apart: equal rows have equal spans, so they may share a key."""
    return F.xxhash64(*[F.col(c) for c in columns])


def scan(docs: DataFrame, shared_owners: int = 3, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """Per document: key, counts of the base kinds, base_sha256 and spans (array of start, kind, end, live), where
    live says that fewer than ``shared_owners`` owners have the value; random values that aren't live are left out."""
    found = materialize(find(docs, id_col, text_col, owner_col, repo_col))
    each = found.where(F.size("found") > 0).select("key", "owner", "repo", F.explode("found").alias("x")).select("key", "owner", "repo", "x.*")
    # Equal values are summed up before they are dealt out, so that a value in a third of all rows is no one task's work.
    repos = each.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    owners = repos.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    frequency = materialize(owners.groupBy("hash").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners")))
    judged = each.select("key", "start", "kind", "end", "hash").distinct().join(frequency, "hash").withColumn("live", F.col("owners") < shared_owners).where((F.col("kind") < 3) | F.col("live"))
    spans = judged.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "live", "owners", "repositories"))).alias("spans"))
    return found.drop("found", "owner", "repo").join(spans, "key", "left")


def report(docs: DataFrame, **options) -> DataFrame:
    """The scan with its spans spelled kind:start:end, and how many of them look live or are widely shared."""
    names = F.array(*[F.lit(k) for k in KINDS])
    said = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")
    total = F.coalesce(F.size("spans"), F.lit(0)).cast("long")
    live = F.coalesce(F.size(F.filter("spans", lambda x: x["live"])), F.lit(0)).cast("long")
    return scan(docs, **options).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(said, F.lit("")).alias("spans"), live.alias("n_live"), (total - live).alias("n_shared"))


def covered(text: str, spans: list, mask: str) -> str:
    """The text with every span, overlapping ones as one, replaced."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, mask: str = "[SECRET]", n_chars_col: str | None = "n_chars", text_col: str = "text", id_col: str = "doc_id", owner_col: str = "source", repo_col: str = "doc_id", **options) -> DataFrame:
    """The documents with their live-looking secrets replaced; widely shared examples stay."""
    columns, names = (id_col, text_col, owner_col, repo_col), docs.columns
    spans = scan(docs, id_col=id_col, text_col=text_col, owner_col=owner_col, repo_col=repo_col, **options)
    live = spans.select("key", F.filter("spans", lambda x: x["live"]).alias("spans")).where(F.size("spans") > 0)
    live = live.groupBy("key").agg(F.first("spans").alias("spans"))
    key_name, spans_name = unused("__key", names), unused("__spans", names)
    live = live.select(F.col("key").alias(key_name), F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(spans_name))

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, spans_at = batch.schema.get_field_index(text_col), batch.schema.get_field_index(spans_name)
            texts = [t if s is None else covered(t, [(x["start"], x["end"]) for x in s], mask) for t, s in zip(batch.column(at).to_pylist(), batch.column(spans_at).to_pylist(), strict=True)]
            return batch.set_column(at, text_col, pa.array(texts, pa.string())).select(names)

        return f

    marked = docs.withColumn(key_name, key(*columns)).join(live, key_name, "left").drop(key_name)
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    out = map_arrow(marked, make, schema)
    return out.withColumn(n_chars_col, F.length(text_col).cast(docs.schema[n_chars_col].dataType)) if n_chars_col and n_chars_col in docs.columns else out
