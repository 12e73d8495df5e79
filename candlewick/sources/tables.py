"""Tables that are replaced while they are read (S20-S25): versions in folders of their own, made current by one entry in a log.

    path/data/<unique>/<table>/...      the rows of one version of one table
    path/log/000000000000000007.json    what version 7 consists of: {"tables": {name: folder}, "note": ...}

A writer first writes its folders, then adds the log entry by a rename that fails if the entry is there.  Readers take the last
entry, so they see whole versions only: a writer killed before the entry leaves the old version current, and one that lost a race
gets Conflict and can start anew from what is current now.  A table may be its own input: nothing it reads is touched.  vacuum()
removes what no kept version names.
"""

from __future__ import annotations

import atexit
import contextlib
import json
import re
import tempfile
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer made a version current in the meantime."""


@dataclass(frozen=True)
class Version:
    number: int
    folders: dict[str, str]
    note: dict


class Files:
    """The few calls of the Hadoop file system that are needed: it is the one that Spark's readers and writers use."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path(path).getFileSystem(self.conf)

    def path(self, text: str):
        return self.jvm.org.apache.hadoop.fs.Path(text)

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(folder))] if self.exists(folder) else []

    def folders(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(folder)) if s.isDirectory()] if self.exists(folder) else []

    def exists(self, text: str) -> bool:
        return self.fs.exists(self.path(text))

    def read(self, text: str) -> str:
        stream = self.fs.open(self.path(text))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, text: str, content: str) -> None:
        stream = self.fs.create(self.path(text), False)
        stream.write(content.encode())
        stream.close()

    def delete(self, text: str) -> None:
        self.fs.delete(self.path(text), True)

    def move(self, old: str, new: str) -> bool:
        """False if there is something in the new place."""
        self.fs.mkdirs(self.path(new).getParent())
        return not self.exists(new) and self.fs.rename(self.path(old), self.path(new))


class Store:
    """A set of tables that change together, under one path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.root, self.files = spark, path.rstrip("/"), Files(spark, path)

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(f"{self.root}/log") if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version:
        """The current version, or an earlier one that vacuum() left; number 0 is the empty store."""
        numbers = self.numbers()
        number = numbers[-1] if number is None and numbers else number or 0
        if not number:
            return Version(0, {}, {})
        entry = json.loads(self.files.read(self._entry(number)))
        return Version(number, entry["tables"], entry["note"])

    def _entry(self, number: int) -> str:
        return f"{self.root}/log/{number:018d}.json"

    def read(self, table: str, version: Version | None = None) -> DataFrame:
        """The rows of a table in a version (default: the current one).  A plan keeps reading the version it was made for."""
        folders = (version or self.version()).folders
        if table not in folders:
            raise KeyError(f"{self.root} has no table {table}")
        return self.spark.read.parquet(f"{self.root}/data/{folders[table]}")

    def read_parts(self, table: str, values: list[str] | None = None, version: Version | None = None) -> DataFrame | None:
        """The rows of the named parts (default: all) of a table that publish_parts() wrote; None if there are none."""
        folders = (version or self.version()).folders
        names = [n for n in folders if n.startswith(f"{table}/")] if values is None else [n for v in values if (n := f"{table}/{v}") in folders]
        return self.spark.read.parquet(*(f"{self.root}/data/{folders[n]}" for n in names)) if names else None

    def publish_parts(self, table: str, rows: DataFrame, column: str, note: dict | None = None, base: Version | None = None) -> Version:
        """Replaces the parts of a table that rows have, one for each value of `column` (not null, fit for a folder's name, such as a
        day); all other parts stay.  One job writes them."""
        base = base or self.version()
        unique = uuid.uuid4().hex
        rows.withColumn("_part", F.col(column).cast("string")).write.partitionBy("_part").parquet(f"{self.root}/data/{unique}/{table}")
        parts = {n.partition("=")[2]: f"{unique}/{table}/{n}" for n in self.files.folders(f"{self.root}/data/{unique}/{table}")}
        return self._commit(base, base.folders | {f"{table}/{v}": f for v, f in parts.items()}, note, unique)

    def publish(self, tables: dict[str, DataFrame], note: dict | None = None, base: Version | None = None, partitions: dict[str, list[str]] | None = None) -> Version:
        """Writes the tables and makes them current together; tables that are not named stay as they are in `base`, the version
        that the new rows were made from (default: the current one).  Raises Conflict if base is not current any more."""
        base = base or self.version()
        unique = uuid.uuid4().hex
        folders = dict(base.folders)
        for name, rows in tables.items():
            folders[name] = f"{unique}/{name}"
            rows.write.partitionBy(*(partitions or {}).get(name, [])).parquet(f"{self.root}/data/{folders[name]}")
        return self._commit(base, folders, note, unique)

    def _commit(self, base: Version, folders: dict[str, str], note: dict | None, unique: str) -> Version:
        draft = f"{self.root}/log/draft-{unique}"
        self.files.write(draft, json.dumps({"tables": folders, "note": note or {}, "at": time.time()}))
        if self.version().number != base.number or not self.files.move(draft, self._entry(base.number + 1)):
            self.files.delete(draft)
            self.files.delete(f"{self.root}/data/{unique}")
            raise Conflict(f"{self.root}: version {base.number} is not current any more")
        return Version(base.number + 1, folders, note or {})

    def update(self, table: str, change: Callable[[DataFrame], DataFrame], note: dict | None = None, tries: int = 3) -> Version:
        """Publishes change(current rows), again from what is current then if another writer was quicker."""
        for left in reversed(range(tries)):
            base = self.version()
            try:
                return self.publish({table: change(self.read(table, base))}, note, base)
            except Conflict:
                if not left:
                    raise
        raise AssertionError("unreachable")

    def vacuum(self, keep: int = 2, age: float = 3600.0) -> list[str]:
        """Removes log entries but the last `keep`, and folders older than `age` seconds that none of these names (a younger one may
        be a version on its way).  Returns the folders removed."""
        numbers = self.numbers()
        named = {f.split("/")[0] for n in numbers[-keep:] for f in self.version(n).folders.values()}
        for n in numbers[:-keep]:
            self.files.delete(self._entry(n))
        gone = []
        now = time.time() * 1000
        for name in self.files.names(f"{self.root}/data"):
            folder = f"{self.root}/data/{name}"
            if name not in named and now - self.files.fs.getFileStatus(self.files.path(folder)).getModificationTime() >= age * 1000:
                self.files.delete(folder)
                gone.append(name)
        return gone


def replace(df: DataFrame, path: str, partitions: tuple[str, ...] = (), form: str = "parquet") -> None:
    """Writes df beside a plain folder, then puts it in place: the whole folder, or with partitions those that df has.  df may read
    the folder.  A writer killed before the renames leaves the folder as it was; between two renames the old rows are beside it, under
    `.old-...`.  Where readers must never see that gap, use a Store."""
    files, unique = Files(df.sparkSession, path), uuid.uuid4().hex
    path = path.rstrip("/")
    parent, _, name = path.rpartition("/")
    fresh, old = f"{parent}/.new-{name}-{unique}", f"{parent}/.old-{name}-{unique}"
    try:
        df.write.format(form).option("header", True).partitionBy(*partitions).save(fresh)
        for leaf in _leaves(files, fresh, len(partitions)) if partitions else [""]:
            place = f"{path}{leaf}"
            if files.exists(place):
                files.move(place, f"{old}{leaf}")
            if not files.move(f"{fresh}{leaf}", place):
                files.move(f"{old}{leaf}", place)
                raise Conflict(f"{place} was written by another")
        files.delete(old)
    finally:
        files.delete(fresh)


def _leaves(files: Files, folder: str, depth: int) -> list[str]:
    if not depth:
        return [""]
    return [f"/{name}{leaf}" for name in files.folders(folder) if "=" in name for leaf in _leaves(files, f"{folder}/{name}", depth - 1)]


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that driver and executors share; an own one where it is unset and all run in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="candlewick-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows written once in the shared folder, until exit, and read again."""
    store = scratch_store(df.sparkSession)
    return store.read(name, store.publish({name: df}))


def scratch_store(spark: SparkSession) -> Store:
    """A store in the shared folder that goes at exit."""
    store = Store(spark, f"{shared_dir(spark)}/candlewick/store-{uuid.uuid4().hex}")

    def remove() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone; the folder is the cluster's scratch space
            store.files.delete(store.root)

    atexit.register(remove)
    return store
