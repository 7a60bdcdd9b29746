"""What the library knows of a table besides its rows, and the options it takes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def no_affinity(declared: str) -> bool:
    """Whether a declared type leaves values as they are: it is empty, or has BLOB and no INT, CHAR, CLOB or TEXT."""
    t = declared.upper()
    return not t or t == "ANY" or ("BLOB" in t and not any(x in t for x in ("INT", "CHAR", "CLOB", "TEXT")))


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    to: str
    on_delete: str = "no action"


@dataclass(frozen=True)
class TableSpec:
    """A table's key, its columns with their declared types, defaults of columns added later with the schema
    generation of their addition, derived columns, and unique columns."""

    name: str
    key: tuple[str, ...]
    columns: dict[str, str]
    added: dict[str, tuple[int, str]] = field(default_factory=dict)
    derived: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()

    def writable(self) -> list[str]:
        """The columns that a change can write, in order: neither keys nor derived ones."""
        return [c for c in self.columns if c not in self.key and c not in self.derived]

    @classmethod
    def of(cls, name: str, schema: StructType, key: tuple[str, ...], **more) -> TableSpec:
        """A table's description from its rows' schema: the declared types are the schema's, in its order."""
        lacking = [c for c in key if c not in schema.names]
        if lacking:
            raise ValueError(f"{name} has no column {lacking[0]}")
        return cls(name, key, {f.name: f.dataType.simpleString().upper() for f in schema.fields}, **more)

    def without_affinity(self) -> list[str]:
        """The columns whose values are kept and compared by type."""
        return [c for c, t in self.columns.items() if no_affinity(t)]

    def check_defaults(self, spark: SparkSession) -> None:
        """Refuses defaults that aren't constants: those that refer to a column or differ from row to row."""
        row = spark.range(1).select(F.lit(0).alias("__none"))
        for column, (_, default) in self.added.items():
            try:
                row.select(F.expr(default)).schema
            except (AnalysisException, ParseException) as e:
                raise ValueError(f"the default of {column} is no constant: {default}") from e
            if any(w in default.lower() for w in ("rand(", "randn(", "uuid(", "current_", "now(")):
                raise ValueError(f"the default of {column} is no constant: {default}")

    def completed(self, column: str, generation: str = "schema_gen") -> Column:
        """A column of rows of any generation: the default where the row is older than the column. A null that a
        newer row holds stays a null."""
        if column not in self.added:
            return F.col(column)
        since, default = self.added[column]
        return F.when(F.col(generation) < since, F.expr(default)).otherwise(F.col(column))


class Catalog:
    """Tables by name, in any case."""

    def __init__(self, tables: list[TableSpec], keys: list[ForeignKey] = ()):
        self.tables = {t.name.lower(): t for t in tables}
        self.keys = list(keys)

    def __getitem__(self, name: str) -> TableSpec:
        return self.tables[name.lower()]

    def unmergeable(self, triggers: tuple[str, ...] = (), virtual: tuple[str, ...] = (), encoding: str = "UTF-8", reserved: int = 0) -> str | None:
        """Why no transaction of this database can be merged row by row; null if they can."""
        if encoding.upper() != "UTF-8":
            return "text encoding"
        if reserved:
            return "reserved bytes"
        if triggers:
            return "trigger"
        if virtual:
            return "virtual table"
        return None

    def reasons(self, spark: SparkSession, **database) -> DataFrame:
        """tbl, catalog_reason: why changes of a table can't be merged: what holds for the whole database, a foreign
        key to itself, or a circle of keys that the table is in; null if they can. The graph is one of a schema's
        tables."""
        whole = self.unmergeable(**database)
        parents = {t: {k.parent.lower() for k in self.keys if k.child.lower() == t} for t in self.tables}

        def reach(t: str) -> set[str]:
            found, todo = set(), list(parents[t])
            while todo:
                p = todo.pop()
                if p not in found:
                    found.add(p)
                    todo += parents.get(p, ())
            return found

        why = {t: whole or ("refers to itself" if t in parents[t] else "circle of keys" if t in reach(t) else None) for t in self.tables}
        return spark.createDataFrame([(self.tables[t].name, why[t]) for t in self.tables], "tbl string, catalog_reason string")


@dataclass(frozen=True)
class Options:
    """How conflicts are judged and the log is kept; unknown names and values are refused."""

    rebase: bool = True
    read_check: bool = True
    route_check: bool = True
    relocation: bool = True
    rebase_backoff: bool = True
    log_max_mb: int = 64
    compact_ms: int = 0
    journal_mode: str = "wal"
    auto_vacuum: str = "none"

    WORDS = {"1": True, "true": True, "on": True, "yes": True, "0": False, "false": False, "off": False, "no": False}

    @classmethod
    def parse(cls, given: dict[str, str]) -> Options:
        known = {f: type(getattr(cls(), f)) for f in cls.__dataclass_fields__}
        out = {}
        for name, value in given.items():
            if name not in known:
                raise ValueError(f"no option {name!r}")
            text = str(value).strip().lower()
            if known[name] is bool:
                if text not in cls.WORDS:
                    raise ValueError(f"{name}: {value!r} is neither on nor off")
                out[name] = cls.WORDS[text]
            else:
                out[name] = int(text) if known[name] is int else text
        made = cls(**out)
        if made.journal_mode != "wal":
            raise ValueError("only journal_mode wal is supported")
        if made.auto_vacuum not in ("none", "0"):
            raise ValueError("auto_vacuum is not supported")
        return made
