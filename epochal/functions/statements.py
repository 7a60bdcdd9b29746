"""What a SQL statement's text says about it, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Possessive throughout: the matcher then walks in a loop, where a group that may give back would take a stack frame a
#: turn and overflow on some thousand blanks. A comment that isn't closed goes to the end.
COMMENT = r"^(?:\s++|--[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/|$))*+"


#: Lengths of runs of spaces that are compared whole, each half of the one before.
RUNS = [1 << k for k in range(19, 5, -1)]


def unspaced(sql: Column) -> Column:
    """Without spaces at the front, for texts with long runs of them: runs go whole, and only what is left (less than
    the shortest run, or what is beyond twice the longest) goes byte by byte, which takes several times as long."""
    runs = F.array(*[F.repeat(F.lit(" "), F.lit(n)).cast("binary") for n in RUNS])
    rest = F.aggregate(runs, sql.cast("binary"), lambda text, run: F.when(F.startswith(text, run), F.substring(text, F.octet_length(run) + 1, F.octet_length(text))).otherwise(text))
    return F.ltrim(rest.cast("string"))


def stripped(sql: Column) -> Column:
    """Without blanks at the front. Spaces go first, byte by byte and before the text is decoded for a pattern: long
    runs of them would take most of the time of every pattern."""
    return F.regexp_replace(F.ltrim(sql), r"^\s++", "")


def bare(sql: Column) -> Column:
    """Without blanks and comments at the front."""
    return F.regexp_replace(F.ltrim(sql), COMMENT, "")


def starts_with(sql: Column, *words: str) -> Column:
    return bare(sql).rlike(rf"(?i)^(?:{'|'.join(words)})(?![A-Za-z0-9_])")


def is_read(sql: Column) -> Column:
    """Begins with a query, perhaps in brackets."""
    return bare(sql).rlike(r"(?i)^[(\s]*+(?:SELECT|WITH|VALUES)(?![A-Za-z0-9_])")


def is_dml(sql: Column) -> Column:
    return starts_with(sql, "INSERT", "REPLACE", "UPDATE", "DELETE")


def has_word(sql: Column, word: str) -> Column:
    return sql.rlike(rf"(?i)(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])")


def is_multi_row(sql: Column) -> Column:
    """Several rows of values; a string that looks so counts too, which only refuses more."""
    return sql.rlike(r"\)\s*,\s*\(")


def has_policy(sql: Column) -> Column:
    """An insert or update that says what to do on a conflict."""
    return bare(sql).rlike(r"(?i)^(?:INSERT|UPDATE)\s+OR\s") | sql.rlike(r"(?i)(?<![A-Za-z0-9_])ON\s+CONFLICT(?![A-Za-z0-9_])")


def is_ddl(sql: Column) -> Column:
    """Changes the schema, and not only of temporary objects."""
    temp = bare(sql).rlike(r"(?i)^(?:CREATE|DROP|ALTER)\s+(?:TEMP|TEMPORARY)(?![A-Za-z0-9_])")
    return starts_with(sql, "CREATE", "DROP", "ALTER", "REINDEX", "VACUUM") & ~temp


def is_point(sql: Column, *key: Column) -> Column:
    """Addresses one row: an insert of one row, or a change whose condition is an equality of every column of the
    key, joined by AND, without a subquery and without a conflict policy."""
    sql = stripped(sql)
    one = starts_with(sql, "INSERT") & ~is_multi_row(sql) & ~has_word(sql, "SELECT")
    condition = F.regexp_replace(F.regexp_extract(sql, r"(?is)\bWHERE\s++(.*+)$", 1), r"(?<![\s;])[\s;]++$", "")
    # Runs of blanks are looked at from their first on: from each of their blanks it would take their length squared.
    parts = F.split(condition, r"(?i)(?<!\s)\s++AND\s++")
    equal = r"^([A-Za-z_][A-Za-z0-9_]*+)\s*+==?\s*+(?:'[^']*+'|[^=<>\s']++)$"
    named = F.array_sort(F.transform(parts, lambda p: F.lower(F.regexp_extract(p, equal, 1))))
    keyed = starts_with(sql, "UPDATE", "DELETE") & (condition != "") & named.eqNullSafe(F.array_sort(F.array(*[F.lower(k) for k in key]))) & ~has_word(sql, "SELECT")
    return (one | keyed) & ~has_policy(sql)


def pragma(sql: Column) -> Column:
    """The name (lower case) and value of a setting that a statement reads or sets; nulls if it is another one."""
    pattern = r"(?is)^PRAGMA\s++(?:[A-Za-z_]\w*+\s*+\.\s*+)?([A-Za-z_]\w*+)\s*+(?:=\s*+([^;]*+)|\(\s*+([^)]*+)\))?[\s;]*+$"
    part = lambda i: F.regexp_extract(bare(sql), pattern, i)
    value = F.trim(F.regexp_replace(F.concat(part(2), part(3)), r"^['\"]|['\"]$", ""))
    return F.struct(F.when(part(1) != "", F.lower(part(1))).alias("name"), F.when(value != "", value).alias("value"))


def no_auto_vacuum(value: Column) -> Column:
    """Whether a setting of auto_vacuum means none: neither of its two words nor their numbers."""
    v = F.lower(F.trim(value))
    return ~(v.isin("full", "incremental") | (v.rlike(r"^[+-]?[0-9]{1,18}$") & v.cast("bigint").isin(1, 2)))


def sync_level(value: Column) -> Column:
    """A synchronous setting as a level: off, normal, full, extra, or a number's lowest bits, with one added under a
    mask of three bits and taken off again."""
    v = F.lower(F.trim(value))
    words = F.when(v.isin("off", "no", "false"), 0).when(v.isin("on", "yes", "true", "normal"), 1).when(v == "full", 2).when(v == "extra", 3)
    number = F.when(v.rlike("^[0-9]{1,18}$"), v.cast("bigint")).when(v.rlike("^0x[0-9a-f]{1,15}$"), F.conv(F.substring(v, 3, 20), 16, 10).cast("bigint"))
    level = F.coalesce(words.cast("bigint"), number, F.lit(1).cast("bigint"))
    masked = (level + 1).bitwiseAND(7)
    return F.least(F.greatest(masked - 1, F.lit(0)), F.lit(3)).cast("int")
