"""Compaction of the epoch folders that streams write.

A table grows by one folder for every writer and epoch. `compact` rewrites the epochs
that are final (those before the one at work) as one segment, and `fan` segments of
one level as one of the next, so n epochs leave about fan * log(n) folders and a row is
rewritten log(n) times. Segments are partitioned by a column of the rows, by which
readers leave out what they do not need.

What is live is stated by a manifest: a small file of each writer whose next version
is renamed into place. A reader sees the folders before a compaction or after it,
never both or neither. What a version replaced is deleted by the next one, when no
reader of the version before it is left; a compaction that fails leaves a segment
that no manifest names, and the next one deletes it. A writer is compacted by its own
stream alone.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

FAN = 16
_MANIFESTS, _SEGMENTS = "_manifest", "_segments"


@dataclass(frozen=True)
class Segment:
    """Rows of the epochs up to `epoch` that the segments before it do not hold."""

    level: int
    epoch: int
    part: str

    def path(self, folder: str, writer: str) -> str:
        return f"{folder}/{_SEGMENTS}/writer={writer}/epoch={self.epoch}/part={self.part}"


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    through: int = -1  # epochs up to this one are in segments
    segments: tuple[Segment, ...] = ()


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, target = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def _delete(spark: SparkSession, path: str) -> None:
    fs, target = _files(spark, path)
    fs.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _files(spark, path)
    return fs.exists(target)


def _versions(spark: SparkSession, folder: str, writer: str) -> list[str]:
    return [n for n in _names(spark, f"{folder}/{_MANIFESTS}/{writer}") if n.startswith("v")]


def manifest(spark: SparkSession, folder: str, writer: str) -> Manifest:
    """The newest manifest of a writer."""
    versions = _versions(spark, folder, writer)
    if not versions:
        return Manifest()
    fs, target = _files(spark, f"{folder}/{_MANIFESTS}/{writer}/{versions[-1]}")
    stream = fs.open(target)
    try:
        stated = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Manifest(stated["version"], stated["through"], tuple(Segment(**s) for s in stated["segments"]))


def manifests(spark: SparkSession, folder: str) -> dict[str, Manifest]:
    return {writer: manifest(spark, folder, writer) for writer in _names(spark, f"{folder}/{_MANIFESTS}")}


def _publish(spark: SparkSession, folder: str, writer: str, stated: Manifest) -> None:
    home = f"{folder}/{_MANIFESTS}/{writer}"
    fs, draft = _files(spark, f"{home}/draft-{uuid.uuid4().hex}")
    _, place = _files(spark, f"{home}/v{stated.version:010d}.json")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(asdict(stated)).encode()))
    out.close()
    if fs.exists(place) or not fs.rename(draft, place):
        raise RuntimeError(f"version {stated.version} of {home} is there already: two streams compact one writer")


def write_segment(rows: DataFrame, folder: str, writer: str, level: int, epoch: int, by: str) -> Segment:
    made = Segment(level, epoch, uuid.uuid4().hex)
    rows.drop("writer", "epoch", "part").hint("rebalance", by).write.partitionBy(by).parquet(made.path(folder, writer))
    return made


def _read_segments(spark: SparkSession, folder: str, parts: list[str], schema: StructType) -> DataFrame:
    whole = StructType([*schema.fields, StructField("part", StringType())])
    return spark.read.schema(whole).option("basePath", f"{folder}/{_SEGMENTS}").parquet(*parts).select(*schema.names)


def seed(rows: DataFrame, folder: str, writer: str, by: str) -> None:
    """Rows that no epoch wrote, as the first segment of a writer."""
    made = write_segment(rows, folder, writer, 0, 0, by)
    _publish(rows.sparkSession, folder, writer, Manifest(1, 0, (made,)))


def _epochs_read(spark: SparkSession, folder: str, paths: list[str]) -> DataFrame | None:
    """Rows of epoch folders, None if none of them has any."""
    try:
        return spark.read.option("basePath", folder).parquet(*paths)
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return None


def compact(spark: SparkSession, folder: str, writer: str, before: int, by: str = "day", fan: int = FAN) -> Manifest:
    """Rewrite the epochs of a writer that lie before `before`, once there are `fan` of them."""
    folder = folder.rstrip("/")
    now = manifest(spark, folder, writer)
    home = f"{folder}/writer={writer}"
    epochs = sorted(int(n.removeprefix("epoch=")) for n in _names(spark, home) if n.startswith("epoch="))
    ready = [e for e in epochs if now.through < e < before]
    if len(ready) < fan:
        return now
    segments = list(now.segments)
    fresh = _epochs_read(spark, folder, [f"{home}/epoch={e}" for e in ready])
    if fresh is not None:
        segments.append(write_segment(fresh, folder, writer, 0, ready[-1], by))
        level = 0
        while len(full := [s for s in segments if s.level == level]) >= fan:
            rows = _read_segments(spark, folder, [s.path(folder, writer) for s in full], fresh.schema)
            merged = write_segment(rows, folder, writer, level + 1, max(s.epoch for s in full), by)
            segments = [s for s in segments if s.level != level] + [merged]
            level += 1
    new = Manifest(now.version + 1, ready[-1], tuple(segments))
    _publish(spark, folder, writer, new)

    # readers may still hold the manifest before this one, but none before that
    for epoch in epochs:
        if epoch <= now.through:
            _delete(spark, f"{home}/epoch={epoch}")
    live = {s.path("", "") for s in (*now.segments, *new.segments)}
    kept = f"{folder}/{_SEGMENTS}/writer={writer}"
    for epoch in _names(spark, kept):
        parts = _names(spark, f"{kept}/{epoch}")
        gone = [p for p in parts if Segment(0, int(epoch.removeprefix("epoch=")), p.removeprefix("part=")).path("", "") not in live]
        for part in gone:
            _delete(spark, f"{kept}/{epoch}/{part}")
        if len(gone) == len(parts):
            _delete(spark, f"{kept}/{epoch}")
    for version in _versions(spark, folder, writer)[:-2]:
        _delete(spark, f"{folder}/{_MANIFESTS}/{writer}/{version}")
    return new


def live(found: DataFrame, folder: str) -> DataFrame:
    """Rows of a table's epoch folders (`found`) that no segment holds, and those of the live segments."""
    spark, folder = found.sparkSession, folder.rstrip("/")
    stated = manifests(spark, folder)
    parts = [s.path(folder, writer) for writer, m in stated.items() for s in m.segments]
    if not parts:
        return found
    held = [(F.col("writer") == writer) & (F.col("epoch") <= m.through) for writer, m in stated.items()]
    recent = found.filter(~reduce(lambda a, b: a | b, held))
    return recent.unionByName(_read_segments(spark, folder, parts, found.schema))
