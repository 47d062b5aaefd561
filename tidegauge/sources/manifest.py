"""The manifest of a datapool: the columns of every protocol and window tag, and how files keep them.

Every write adds what is new in it to a small log in the pool's folder, so a pool is read
with a known schema and no file is opened to find it. Writers need not agree on types: a
column that comes with another type than before is kept under a name of its own in the
files, and reading puts the parts together again in a type for all of them. Nothing
that has been written is converted, rewritten or lost. There is one writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from tidegauge.functions.numeric import to_number
from tidegauge.session import any_path

PARTITIONS = ["protocol", "ws", "day"]
PARTITION_FIELDS = "protocol string, ws string, day date"
#: Where a landed row comes from: its member of an archive and the line in it.
PROVENANCE = "_member string, _line bigint"
ENTRY = "protocol string, ws string, name string, type string, stored string"
#: Name of a column's metadata that lists the groups which have it.
GROUPS = "groups"

# Types by what they hold.
WHOLE = {"tinyint", "smallint", "int", "bigint"}
NUMBERS = WHOLE | {"float", "double"}
TIMES = {"date", "timestamp", "timestamp_ntz"}

Entry = tuple[str, str, str, str, str]


def _path(pool: str) -> str:
    return f"{pool.rstrip('/')}/_manifest"


def _there(spark: SparkSession, pool: str) -> bool:
    return any_path(spark, f"{_path(pool)}/part-*")


def read_manifest(spark: SparkSession, pool: str) -> list[Entry]:
    """``(protocol, ws, name, type, stored)`` of the pool; one without a manifest is looked at once."""
    if _there(spark, pool):
        return [tuple(r) for r in spark.read.schema(ENTRY).json(_path(pool)).distinct().collect()]  # a row per column of a group
    if not any_path(spark, f"{pool.rstrip('/')}/protocol=*"):
        return []
    found = spark.read.option("mergeSchema", True).parquet(pool)
    groups = found.select("protocol", "ws").distinct().collect()
    return [(p, ws, f.name, f.dataType.simpleString(), f.name) for p, ws in groups for f in found.schema if f.name not in PARTITIONS and f.name[0] != "_"]


def is_kind(kind: str, among: set[str]) -> bool:
    return kind in among or among is NUMBERS and kind.startswith("decimal")


def common_type(kinds: Iterable[str]) -> str:
    """Type that a column is read in; text beside numbers is read as the numbers it has."""
    kinds = set(kinds)
    if len(kinds) == 1:
        return kinds.pop()
    if kinds <= WHOLE:
        return "bigint"
    if all(is_kind(k, NUMBERS) or k == "string" for k in kinds):
        return "double"
    return "timestamp_ntz" if kinds <= TIMES | {"string"} else "string"


def _converted(column: Column, kind: str, wanted: str) -> Column:
    if kind == wanted:
        return column
    if kind == "string":
        return to_number(column) if wanted == "double" else column.try_cast(wanted)
    return column.cast(wanted)


def stored_names(entries: Iterable[Entry], columns: dict[str, DataType]) -> dict[str, str]:
    """Name in the files for each column: its own for the first type it comes in."""
    names = {(name, kind): stored for _, _, name, kind, stored in entries}
    taken = set(names.values())
    out = {}
    for name, data_type in columns.items():
        kind = data_type.simpleString()
        own = names.get((name, kind))
        if own is None:
            own = name if name not in taken else f"{name}__{kind}"
        out[name] = own
    if len(set(out.values())) < len(out):
        raise ValueError(f"column names clash in the datapool's files: {sorted(out.values())}")
    return out


def add_entries(spark: SparkSession, pool: str, known: list[Entry], added: Iterable[Entry]) -> None:
    """Write what is new to the manifest, and all of it if there is none yet."""
    there = known if _there(spark, pool) else []
    new = sorted(set(known).union(added) - set(there))
    if new:
        spark.createDataFrame(new, ENTRY).coalesce(1).write.mode("append").json(_path(pool))


def stored_schema(entries: Iterable[Entry]) -> StructType:
    """Schema of the pool's files: every stored column, where landed rows come from, and the partitions."""
    columns = sorted({(stored, kind) for _, _, _, kind, stored in entries})
    return StructType.fromDDL(", ".join([*(f"`{stored}` {kind}" for stored, kind in columns), PROVENANCE, PARTITION_FIELDS]))


def logical(stored: DataFrame, entries: list[Entry]) -> DataFrame:
    """The pool's columns under their own names, each with the groups that have it as metadata."""
    kept: dict[str, dict[str, str]] = {}
    groups: dict[str, set[str]] = {}
    for protocol, ws, name, kind, own in entries:
        kept.setdefault(name, {})[own] = kind
        groups.setdefault(name, set()).add(f"{protocol}/{ws}")
    shown = []
    for name, parts in sorted(kept.items()):
        wanted = common_type(parts.values())
        columns = [_converted(F.col(f"`{own}`"), kind, wanted) for own, kind in sorted(parts.items())]
        shown.append((columns[0] if len(columns) == 1 else F.coalesce(*columns)).alias(name, metadata={GROUPS: sorted(groups[name])}))
    return stored.select(*shown, *PARTITIONS)


def lacking(pool: DataFrame, protocols: Iterable[str], ws: str, columns: Iterable[str]) -> dict[str, list[str]] | None:
    """Columns that protocols of the pool don't have; None if the frame doesn't know its groups."""
    by_column = {f.name: set(f.metadata.get(GROUPS, [])) for f in pool.schema}
    known = set().union(*by_column.values()) if by_column else set()
    if not known:
        return None
    if protocols is None:
        there = sorted(g.removesuffix(f"/{ws}") for g in known if g.endswith(f"/{ws}"))
        missing = [c for c in columns if c not in by_column]
        return {", ".join(there): missing} if there and missing else {}
    wanted = {p: [c for c in columns if f"{p}/{ws}" not in by_column.get(c, set())] for p in protocols if f"{p}/{ws}" in known}
    return {p: missing for p, missing in wanted.items() if missing}
