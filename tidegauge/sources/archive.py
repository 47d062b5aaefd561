"""Landing zip archives of daily TSV files in the datapool.

Archives hold members ``<protocol>/<YYYY>/<MM>/<DD>/<window tag>.tsv``. Only
paths travel through Spark; every task opens the archive itself, so the folder
must be on a file system all executors see.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator, Sequence
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.session import materialise, path_exists, qualified
from tidegauge.sources.datapool import WINDOW_KEYS, place_partitions, read_stored
from tidegauge.sources.manifest import PARTITION_FIELDS, PARTITIONS, PROVENANCE, add_entries, read_manifest, stored_names
from tidegauge.sources.stores import locate

# Fixed value: path of a member inside an archive.
MEMBER = re.compile(r"([^/]+)/(\d{4})/(\d{2})/(\d{2})/(w.+?-s.+?)\.tsv")
CHUNK_ROWS = 50_000
MAX_TASKS = 20_000
#: Up to so many members, what is known of each of them is broadcast.
BROADCAST_MEMBERS = 100_000


def list_archives(spark: SparkSession, root: str, depth: int | None = 1) -> DataFrame:
    """Paths of the zip files under ``root``, at most ``depth`` folders down.

    Only file names are listed: the content column of the reader is never used.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.[zZ][iI][pP]")
        .option("recursiveFileLookup", True)
        .load(root)
        .select(F.col("path").alias("archive"))
    )
    if depth is None:
        return listed
    levels = qualified(spark, root).count("/") + depth + 1
    return listed.where(F.regexp_count("archive", F.lit("/")) <= levels)


MEMBERS = "archive string, member string, crc long, size long, columns array<string>, " + PARTITION_FIELDS
#: What has landed: the member, what it held and in which landing it came.
LANDED = "key string, crc long, size long, landing long"


def list_members(archives: DataFrame) -> DataFrame:
    """One row per datapool member of the archives, with its checksum and header.

    Only the archive's index and the first line of each member are read.
    """

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["archive"]:
                fs, inner = locate(path)
                with fs.open_input_file(inner) as handle, zipfile.ZipFile(handle) as archive:
                    for info in archive.infolist():
                        found = MEMBER.match(info.filename)
                        if found:
                            with archive.open(info) as text:
                                header = text.readline().decode("utf-8").rstrip("\r\n").split("\t")
                            protocol, year, month, day, tag = found.groups()
                            rows.append((path, info.filename, info.CRC, info.file_size, header, protocol, tag, date(int(year), int(month), int(day))))
            yield pd.DataFrame(rows, columns=["archive", "member", "crc", "size", "columns", *PARTITIONS])

    return archives.mapInPandas(members, MEMBERS)


def read_members(members: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of the listed members as strings, one task per member at a time.

    ``columns`` is the union of features over all protocols; those a member
    lacks are NULL. Every row carries its member's key and its line. Members are
    read in chunks, never whole.
    """
    wanted = [*WINDOW_KEYS, *columns]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for entry in batch.itertuples(index=False):
                fs, inner = locate(entry.archive)
                line = 0
                with fs.open_input_file(inner) as handle, zipfile.ZipFile(handle) as archive:
                    with archive.open(entry.member) as text:
                        for chunk in pd.read_csv(
                            text, sep="\t", dtype=str, keep_default_na=False, na_values=[],
                            usecols=lambda c: c in wanted, chunksize=CHUNK_ROWS,
                        ):
                            chunk = chunk.reindex(columns=wanted).astype(object)
                            chunk = chunk.where(chunk.notna(), None)
                            lines = range(line, line + len(chunk))
                            line += len(chunk)
                            yield chunk.assign(_member=entry.key, _line=lines, protocol=entry.protocol, ws=entry.ws, day=entry.day)

    schema = ", ".join([f"`{c}` string" for c in wanted] + [PROVENANCE, PARTITION_FIELDS])
    return members.select("archive", "member", "key", *PARTITIONS).mapInPandas(rows, schema)


def _landed_path(pool_path: str) -> str:
    """Table of landed members; readers of the pool skip names with an underscore."""
    return f"{pool_path.rstrip('/')}/_landed_members"


def land_archives(
    spark: SparkSession,
    root: str,
    pool_path: str,
    columns: Sequence[str] | None = None,
    depth: int | None = 1,
) -> None:
    """Bring the members of all archives that the datapool does not have as they are into it.

    Members bring all their rows, equal ones as often as they come, and all their
    columns; ``columns`` only limits these on request. A member is known by its archive's
    place under ``root`` and its own name, and every row by its member and line: a
    partition (protocol, tag, day) with members to land is written again from theirs and
    from what it holds of other members. So several archives may share a day, a member
    whose content has changed is replaced as a whole, and a repeated or interrupted
    landing gives the same pool. Cells stay text, beside numbers that others have
    written: the manifest keeps both. Task counts are explicit because AQE would merge
    tasks whose input is only a few paths.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    below = len(qualified(spark, root)) + 2
    key = F.concat(F.expr(f"substring(archive, {below})"), F.lit("!"), F.col("member"))
    members = materialise(list_members(list_archives(spark, root, depth).repartition(tasks, "archive")).withColumn("key", key), "members")
    waiting, landing = members, 0
    if path_exists(spark, f"{_landed_path(pool_path)}/_SUCCESS"):
        landed = spark.read.schema(LANDED).parquet(_landed_path(pool_path))
        landing = landed.agg(F.max("landing")).head()[0] + 1
        now = landed.groupBy("key").agg(F.max_by(F.struct("crc", "size"), "landing").alias("held"))
        as_they_are = now.select("key", "held.crc", "held.size")
        waiting = members.join(as_they_are, ["key", "crc", "size"], "left_anti")
    todo = materialise(waiting, "members")
    count = todo.count()
    if count == 0:
        return
    headers = todo.select("protocol", "ws", F.explode("columns").alias("name")).distinct().collect()  # a row per column of a protocol and tag
    if columns is None:
        columns = sorted({r["name"] for r in headers} - set(WINDOW_KEYS))
    spread = todo.repartition(min(count, MAX_TASKS), "archive", "member")
    rows = read_members(spread, columns).withColumns({k: F.col(k).cast("timestamp_ntz") for k in WINDOW_KEYS})
    entries = read_manifest(spark, pool_path)
    types = {f.name: f.dataType for f in rows.schema if f.name in (*WINDOW_KEYS, *columns)}
    names = stored_names(entries, types)
    # Stored once: placing rows samples them first, which would read every member twice.
    new = materialise(rows.withColumnsRenamed(names), "landing")
    if entries:
        small = F.broadcast if count <= BROADCAST_MEMBERS else (lambda df: df)
        touched = small(todo.select(*PARTITIONS).distinct())
        replaced = small(todo.select(F.col("key").alias("_member")))
        held = read_stored(spark, pool_path, entries).join(touched, PARTITIONS, "left_semi").join(replaced, "_member", "left_anti")
        new = materialise(held.unionByName(new, allowMissingColumns=True), "landing")
    owned = {(r["protocol"], r["ws"], r["name"]) for r in headers if r["name"] in types}
    owned |= {(r["protocol"], r["ws"], k) for r in headers for k in WINDOW_KEYS}
    add_entries(spark, pool_path, entries, [(p, ws, c, types[c].simpleString(), names[c]) for p, ws, c in owned])
    place_partitions(new, pool_path)
    todo.select("key", "crc", "size", F.lit(landing).cast("long").alias("landing")).write.mode("append").parquet(_landed_path(pool_path))
