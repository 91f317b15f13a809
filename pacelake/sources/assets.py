"""Discovery of export files, with bounded and validated expansion of archives."""

from __future__ import annotations

import hashlib
import io
import os
import re
import stat
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pacelake.sources import families

SCHEMA = "kind string, source_path string, member_path string, provenance_path string, size_bytes long, sha256 string, data binary"


class IntakeError(ValueError):
    """An input that must not be read."""


@dataclass(frozen=True)
class Limits:
    members: int = 100_000
    member_bytes: int = 128 << 20
    total_bytes: int = 2 << 30
    ratio: int = 200


def member_problem(info: zipfile.ZipInfo, limits: Limits) -> str | None:
    """Why an archive member must not be read; None if nothing speaks against it."""
    name = info.filename
    parts = name.replace("\\", "/").split("/")
    rules = [
        ("nul_in_name", "\0" in name),
        ("absolute_path", name.startswith(("/", "\\")) or re.match(r"^[A-Za-z]:", name) is not None),
        ("path_traversal", ".." in parts),
        ("encrypted", bool(info.flag_bits & 1)),
        ("symlink", stat.S_ISLNK(info.external_attr >> 16)),
        ("member_too_large", info.file_size > limits.member_bytes),
        ("compression_ratio", info.compress_size > 0 and info.file_size > limits.ratio * info.compress_size),
    ]
    return next((name for name, holds in rules if holds), None)


def _is_junk(name: str) -> bool:
    parts = name.split("/")
    return "__MACOSX" in parts or parts[-1].startswith("._") or parts[-1] == ".DS_Store"


def expand(data: bytes, limits: Limits) -> Iterator[tuple[str, bytes]]:
    """Members of an archive that are JSON or binary activity files, by name; anything unsafe raises."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise IntakeError("malformed_archive") from e
    infos = [i for i in archive.infolist() if not i.is_dir()]
    if len(infos) > limits.members:
        raise IntakeError("too_many_members")
    for info in infos:
        if problem := member_problem(info, limits):
            raise IntakeError(f"{problem}: {info.filename}")
    if sum(i.file_size for i in infos) > limits.total_bytes:
        raise IntakeError("archive_too_large")
    for info in sorted(infos, key=lambda i: i.filename):
        if not _is_junk(info.filename) and info.filename.lower().endswith((".json", ".fit")):
            with archive.open(info) as f:
                content = f.read(limits.member_bytes + 1)
            if len(content) != info.file_size:
                raise IntakeError(f"size_mismatch: {info.filename}")
            yield info.filename, content


def check_local_root(root: str) -> None:
    """For folders of the driver's own file system: they must exist and hold no symbolic link."""
    if os.path.islink(root):
        raise IntakeError("INPUT_SYMLINK")
    if not os.path.isdir(root):
        raise IntakeError("INPUT_NOT_DIRECTORY")
    for folder, dirs, files in os.walk(root):
        for name in (*dirs, *files):
            if os.path.islink(os.path.join(folder, name)):
                raise IntakeError("INPUT_SYMLINK")


def assets_of(files: DataFrame, limits: Limits | None = None) -> DataFrame:
    """JSON and binary activity files among rows of ``source_path, size_bytes, data``, those within archives too, with their family.

    Archives are expanded one level, each in one task within the limits. Nothing is ordered here.
    """
    bounds = limits or Limits()
    rows = files.withColumn("suffix", F.lower(F.regexp_extract("source_path", r"\.([A-Za-z]+)$", 1)))
    rows = rows.where(~F.regexp_extract("source_path", r"([^/]*)$", 1).rlike(r"^(\._|\.DS_Store)")).where(F.col("suffix").isin("json", "fit", "zip"))
    size = F.when(F.col("size_bytes") <= bounds.member_bytes, F.col("size_bytes")).otherwise(F.raise_error(F.concat(F.lit("file_too_large: "), "source_path")).cast("long"))
    plain = rows.where("suffix <> 'zip'").withColumn("size_bytes", size).select(F.col("suffix").alias("kind"), "source_path", F.lit(None).cast("string").alias("member_path"), F.col("source_path").alias("provenance_path"), "size_bytes", F.sha2("data", 256).alias("sha256"), "data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["source_path"], batch["data"], strict=True):
                for name, content in expand(data, bounds):
                    yield pd.DataFrame([(name.rsplit(".", 1)[1].lower(), path, name, f"{path}!{name}", len(content), hashlib.sha256(content).hexdigest(), content)], columns=["kind", "source_path", "member_path", "provenance_path", "size_bytes", "sha256", "data"])

    inside = rows.where("suffix = 'zip'").select("source_path", "data").mapInPandas(run, SCHEMA)
    found = plain.unionByName(inside)
    return found.withColumn("family", families.classify(F.coalesce("member_path", "source_path"), F.col("kind")))


def read_assets(spark: SparkSession, root: str, limits: Limits | None = None) -> DataFrame:
    """The assets of all files below ``root``. A folder of the driver's own file system must exist and hold no symbolic link."""
    if root.startswith("file:") or "://" not in root:
        check_local_root(re.sub("^file:(//)?", "", root))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    relative = F.regexp_replace(F.url_decode("path"), "^.*?" + re.escape(base) + "/", "")
    return assets_of(files.select(relative.alias("source_path"), F.col("length").alias("size_bytes"), F.col("content").alias("data")), limits)


def same_inventory(before: DataFrame, after: DataFrame) -> bool:
    """Whether two inventories hold the same files with the same content."""
    a, b = before.select("provenance_path", "sha256"), after.select("provenance_path", "sha256")
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


# --- scanning in parallel, archives included --------------------------------------------------

#: Bytes of files or of archive members that one task of a scan reads, about.
RANGE_BYTES = 64 << 20

INVENTORY = "object_kind string, relative_path string, container_relative_path string, extension string, size_bytes long, sha256 string"


@dataclass(frozen=True)
class FileState:
    path: str
    relative: str
    size: int
    changed_ns: int


class ScanRange(InputPartition):
    """Some files, or some members of one archive."""

    def __init__(self, files: list[FileState], members: list[str] | None = None):
        super().__init__((files, members))
        self.files, self.members = files, members


def _state(path: str, relative: str) -> FileState:
    if os.path.islink(path):
        raise IntakeError(f"INPUT_SYMLINK: {relative}")
    found = os.stat(path)
    return FileState(path, relative, found.st_size, found.st_mtime_ns)


def _unchanged(file: FileState) -> None:
    if _state(file.path, file.relative) != file:
        raise IntakeError(f"changed_during_scan: {file.relative}")


def _in_ranges(sized: list[tuple[object, int]], limit: int) -> Iterator[list]:
    """Neighbours together as long as they stay within the limit."""
    held, total = [], 0
    for item, size in sized:
        if held and total + size > limit:
            yield held
            held, total = [], 0
        held.append(item)
        total += size
    if held:
        yield held


class Scan(DataSource):
    """``spark.read.format("export_scan").load(folder)``: every file below a folder and every member of every archive, with its hash and, if ``content`` is true, its bytes.

    The folder must be mounted alike on the driver and the executors. The driver lists names and reads the directories of archives only; an archive is read by as many tasks as
    its size asks for. Each task compares size and time of change of what it has read with those of the listing, before and after; a difference fails the job.
    Options: ``content``, ``rangeBytes``.
    """

    @classmethod
    def name(cls) -> str:
        return "export_scan"

    def schema(self) -> str:
        return INVENTORY + (", data binary" if self._content() else "")

    def _content(self) -> bool:
        return str(self.options.get("content", "false")).lower() == "true"

    def reader(self, schema) -> DataSourceReader:
        return ScanReader(self.options["path"], int(self.options.get("rangebytes", self.options.get("rangeBytes", RANGE_BYTES))), self._content(), Limits())


class ScanReader(DataSourceReader):
    def __init__(self, root: str, limit: int, content: bool, bounds: Limits):
        self.root, self.limit, self.content, self.bounds = re.sub("^file:(//)?", "", root), limit, content, bounds

    def partitions(self) -> list[ScanRange]:
        check_local_root(self.root)
        found = []
        for folder, _, names in os.walk(self.root):
            for name in names:
                relative = os.path.relpath(os.path.join(folder, name), self.root).replace(os.sep, "/")
                if not _is_junk(relative):
                    found.append(_state(os.path.join(folder, name), relative))
        found.sort(key=lambda f: f.relative)
        if not found:
            raise IntakeError("INPUT_EMPTY")
        # an archive is hashed as a file as well
        out = [ScanRange(files) for files in _in_ranges([(f, f.size) for f in found], self.limit)]
        for f in found:
            if f.relative.lower().endswith(".zip"):
                out += [ScanRange([f], names) for names in _in_ranges([(i.filename, i.file_size) for i in self._members(f)], self.limit)]
        return out

    def _members(self, file: FileState) -> list[zipfile.ZipInfo]:
        try:
            with zipfile.ZipFile(file.path) as archive:
                infos = [i for i in archive.infolist() if not i.is_dir()]
        except zipfile.BadZipFile as e:
            raise IntakeError("malformed_archive") from e
        if len(infos) > self.bounds.members:
            raise IntakeError("too_many_members")
        for info in infos:
            if problem := member_problem(info, self.bounds):
                raise IntakeError(f"{problem}: {info.filename}")
        if sum(i.file_size for i in infos) > self.bounds.total_bytes:
            raise IntakeError("archive_too_large")
        return sorted((i for i in infos if not _is_junk(i.filename)), key=lambda i: i.filename)

    def read(self, partition: ScanRange) -> Iterator[tuple]:
        for file in partition.files:
            _unchanged(file)
            if partition.members is None:
                yield self._row("file", file.relative, None, file.path)
            else:
                with zipfile.ZipFile(file.path) as archive:
                    for name in partition.members:
                        with archive.open(name) as member:
                            data = member.read(self.bounds.member_bytes + 1)
                        if len(data) != archive.getinfo(name).file_size:
                            raise IntakeError(f"size_mismatch: {name}")
                        yield self._row("archive_member", f"{file.relative}!{name}", file.relative, data)
            _unchanged(file)

    def _row(self, kind: str, relative: str, container: str | None, source: str | bytes) -> tuple:
        extension = os.path.splitext(relative)[1].lower()
        if isinstance(source, bytes):
            size, sha, data = len(source), hashlib.sha256(source).hexdigest(), source
        else:
            digest, size = hashlib.sha256(), 0
            with open(source, "rb") as f:
                while chunk := f.read(1 << 20):
                    digest.update(chunk)
                    size += len(chunk)
            sha, data = digest.hexdigest(), None
            if self.content and extension != ".zip":  # of an archive only its members are content
                with open(source, "rb") as f:
                    data = f.read()
        return (kind, relative, container, extension, size, sha, *([data] if self.content else []))


def scan(spark: SparkSession, root: str, content: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The inventory of a folder, members of archives included; see ``Scan``."""
    spark.dataSource.register(Scan)
    return spark.read.format(Scan.name()).option("content", str(content).lower()).option("rangeBytes", str(range_bytes)).load(root)


def assets_of_scan(found: DataFrame) -> DataFrame:
    """The assets of a scan with content: JSON and binary activity files, with their family."""
    member = F.col("object_kind") == "archive_member"
    rows = found.where(F.col("extension").isin(".json", ".fit")).withColumn("member_path", F.when(member, F.expr("substring(relative_path, length(container_relative_path) + 2)")))
    rows = rows.select(F.substring("extension", 2, 4).alias("kind"), F.coalesce("container_relative_path", "relative_path").alias("source_path"), "member_path", F.col("relative_path").alias("provenance_path"), "size_bytes", "sha256", "data")
    return rows.withColumn("family", families.classify(F.coalesce("member_path", "source_path"), F.col("kind")))
