"""Versioned sets of tables over plain files: whole commits, restore, backups and retention.

A set lies under one root. ``data/<id>/<table>`` holds what a writer wrote,
``pointers/<number>.json`` names the tables of a version, and ``tags/<name>`` the
version that a backup keeps. A commit writes all its tables under a new id and
then puts one pointer in place, by a rename that fails if the number is taken:
readers see all of a version or none of it, a writer that fails leaves the set
as it was, and of two that started from one version the later one is told so.
Tables that a commit doesn't name are carried over by reference, and restoring
is a pointer to what is there already, so neither copies a row.

Readers resolve the pointer once and read just the files it names. All paths go
through Spark's file systems; only names and schemas pass the driver.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Seconds for which data that no pointer names may belong to a writer at work.
GRACE_S = 24 * 3600


class Conflict(Exception):
    """Another writer committed first."""


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; in a local session without one, a local folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        master = spark.sparkContext.master
        if known.isDefined():
            at = known.get()
        elif master.startswith("local") and not master.startswith("local-cluster"):
            at = os.path.join(tempfile.gettempdir(), "checkpoints")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{at}/{name}-{uuid.uuid4().hex}"
    Files(spark, path).fs.deleteOnExit(Files(spark, path).at(path))
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written into the shared folder and read again, so that it is made once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """The few file operations that a set needs, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.at(root).getFileSystem(self.conf)

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> dict[str, int]:
        """Names in a folder with the times of their last change; none if there is no such folder."""
        at = self.at(folder)
        return {s.getPath().getName(): s.getModificationTime() for s in self.fs.listStatus(at)} if self.fs.exists(at) else {}

    def read(self, path: str) -> str:
        stream = self.fs.open(self.at(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str, overwrite: bool = False) -> bool:
        """Puts a whole file in place at once; False if there is one and it isn't to be overwritten."""
        folder, _, name = path.rpartition("/")
        draft = self.at(f"{folder}/.{name}-{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options[0] = rename.OVERWRITE if overwrite else rename.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(self.fs.makeQualified(draft), self.fs.makeQualified(self.at(path)), options)
        except Exception as e:
            self.fs.delete(draft, False)
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def drop(self, path: str) -> None:
        self.fs.delete(self.at(path), True)


def _checked(name: str) -> str:
    if not re.fullmatch(r"[a-zA-Z0-9_]+", name):
        raise ValueError(f"a name is letters, digits and underscores: {name}")
    return name


class TableSet:
    """A set of tables under ``root``, in versions numbered from 1; 0 is the empty set before the first."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root, Files(spark, root)

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(f"{self.root}/pointers") if re.fullmatch(r"\d+\.json", n))

    def current(self) -> int:
        return max(self.versions(), default=0)

    def tables(self, version: int | None = None) -> dict[str, dict]:
        """Path (under the root) and schema of each table of a version, by default the current one."""
        version = self.current() if version is None else version
        return json.loads(self.files.read(self._pointer(version)))["tables"] if version else {}

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        """All tables of one version: what is committed meanwhile doesn't show."""
        found = self.tables(version)
        return {n: self.spark.read.schema(StructType.fromJson(t["schema"])).parquet(f"{self.root}/{t['path']}") for n, t in found.items()}

    def commit(self, tables: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]], base: int | None = None, by: dict[str, str] | None = None) -> int:
        """The number of a new version: ``base`` (by default the current one) with these tables new.

        A table may be a function of those that this commit wrote before it, which
        are read and not made again. ``by``: a column of a table by which it is laid in folders. Raises `Conflict` if another version followed ``base`` meanwhile, and what
        a table's job raises; either way the set is as it was.
        """
        base = self.current() if base is None else base
        found, own, made = self.tables(base), uuid.uuid4().hex, {}
        for name, df in tables.items():
            df = df(made) if callable(df) else df
            path = f"data/{own}/{_checked(name)}"
            writer = df.write.partitionBy(by[name]) if by and name in by else df.write
            writer.parquet(f"{self.root}/{path}")
            found[name] = {"path": path, "schema": df.schema.jsonValue()}
            made[name] = self.spark.read.schema(df.schema).parquet(f"{self.root}/{path}")
        return self._point(base, found)

    def restore(self, version: int | str) -> int:
        """A new version with the tables of an earlier one, or of a backup."""
        number = self.backups()[version] if isinstance(version, str) else version
        return self._point(self.current(), self.tables(number))

    def backup(self, name: str) -> int:
        """Keeps the current version under ``name``; one of that name gives way."""
        version = self.current()
        self.files.write(f"{self.root}/tags/{_checked(name)}", str(version), overwrite=True)
        return version

    def backups(self) -> dict[str, int]:
        names = [n for n in self.files.names(f"{self.root}/tags") if re.fullmatch(r"[a-zA-Z0-9_]+", n)]
        return {n: int(self.files.read(f"{self.root}/tags/{n}")) for n in names}

    def drop_backups_except(self, name: str) -> list[str]:
        gone = sorted(self.backups().keys() - {_checked(name)})
        for n in gone:
            self.files.drop(f"{self.root}/tags/{n}")
        return gone

    def retain(self, last: int = 1, grace_s: int = GRACE_S) -> list[int]:
        """Drops all but the ``last`` versions and those with a backup, with the data that none of the rest names.

        Data of writers at work is told by its age. Returns the dropped versions.
        """
        known = self.versions()
        kept = {*known[len(known) - max(last, 1) :], *self.backups().values()}
        gone = [v for v in known if v not in kept]
        for v in gone:
            self.files.drop(self._pointer(v))
        named = {t["path"].split("/")[1] for v in self.versions() for t in self.tables(v).values()}
        now = self.spark.sparkContext._jvm.java.lang.System.currentTimeMillis()
        for own, changed in self.files.names(f"{self.root}/data").items():
            if own not in named and changed <= now - 1000 * grace_s:
                self.files.drop(f"{self.root}/data/{own}")
        return gone

    def _pointer(self, version: int) -> str:
        return f"{self.root}/pointers/{version:08d}.json"

    def _point(self, base: int, tables: dict[str, dict]) -> int:
        if self.current() != base or not self.files.write(self._pointer(base + 1), json.dumps({"base": base, "tables": tables})):
            raise Conflict(f"version {base} is no longer the current one")
        return base + 1


def failed(error: Exception) -> str:
    """The message of what made a commit fail, in one line."""
    text = error.getMessage() if isinstance(error, PySparkException) else str(error)
    return (text or str(error)).strip().split("\n")[0]
