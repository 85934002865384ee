"""Where results go: CSV, JSON, append-only logs, and tables published all at once."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class LockBusy(RuntimeError):
    pass


def write_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """CSV with a header; with ``bom`` each file begins with the mark that spreadsheets look for."""
    name = df.columns[0]
    out = df.withColumnRenamed(name, "﻿" + name) if bom else df
    out.write.mode("overwrite").option("header", True).csv(path)


def write_json(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def append_audit(df: DataFrame, path: str) -> None:
    """Insert-only: nothing is read back or rewritten."""
    df.withColumn("registrado_en", F.current_timestamp()).write.mode("append").json(path)


class Published:
    """Versions of a set of tables in a folder; readers follow a pointer that is replaced at once.

    A version is a manifest: for each table the folders that make it up. A write replaces
    tables by new folders or appends a folder to those of the version before, so a load
    costs what it brings and not what there is. It ends by moving the pointer: readers see
    all of a version or none of it, and a failed write leaves no trace but its folder.

    One writer at a time holds the lock, from before it reads until it has published. The
    lock is a file that only one can create; it names its holder and is renewed at every
    step. A writer may take over a lock that was not renewed for longer than it allows; the
    one that lost it can't publish any more.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _fs(self):
        return self._at().getFileSystem(self._conf)

    def _text(self, *parts: str) -> str | None:
        if not self._fs().exists(self._at(*parts)):
            return None
        return "\n".join(r[0] for r in self.spark.read.text(self._at(*parts).toString()).collect())

    def _put(self, text: str, *parts: str, overwrite: bool = True) -> None:
        out = self._fs().create(self._at(*parts), overwrite)
        out.write(bytearray(text.encode()))
        out.close()

    def _move(self, a: str, b: str) -> None:
        """Renames a file at once, over another one if there is one."""
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at().toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(context.makeQualified(self._at(a)), context.makeQualified(self._at(b)), options)

    def current(self) -> str | None:
        return self._text("CURRENT")

    def folders(self, version: str | None) -> dict[str, list[str]]:
        text = None if version is None else self._text(version, "MANIFEST")
        return {} if text is None else json.loads(text)

    def read(self, name: str, version: str | None = None) -> DataFrame | None:
        """The table as of a version, or of the one current now; it stays readable when the pointer moves on."""
        found = self.folders(version or self.current()).get(name)
        return None if found is None else self.spark.read.parquet(*[f"{self.path}/{x}" for x in found])

    @contextmanager
    def writing(self, stale_after_s: float | None = None) -> Iterator[Write]:
        """Holds the lock; raises LockBusy at once if another does, unless its lock was not renewed for so long."""
        fs, me = self._fs(), uuid.uuid4().hex
        fs.mkdirs(self._at())
        if stale_after_s is not None and fs.exists(self._at("LOCK")) and self.lock_age_s() > stale_after_s:
            try:
                self._move("LOCK", f"LOCK-taken-{me}")
            except Exception as x:  # another one was faster
                raise LockBusy(self.path) from x
        try:
            self._put(me, "LOCK", overwrite=False)
        except Exception as x:
            raise LockBusy(self.path) from x
        try:
            yield Write(self, me)
        finally:
            if self._text("LOCK") == me:
                fs.delete(self._at("LOCK"), False)

    def lock_age_s(self) -> float:
        """Seconds since the lock was last renewed."""
        return time.time() - self._fs().getFileStatus(self._at("LOCK")).getModificationTime() / 1000

    def publish(self, tables: dict[str, DataFrame], check: Callable[[dict[str, DataFrame]], list[str]] = lambda t: []) -> str:
        """A write of its own that replaces the tables."""
        with self.writing() as write:
            return write.publish(tables, check=check)


class Write:
    """What the holder of the lock may do: read the version it started from, and publish the next one."""

    def __init__(self, star: Published, holder: str):
        self.star, self.holder = star, holder
        self.base = star.current()

    def read(self, name: str) -> DataFrame | None:
        return None if self.base is None else self.star.read(name, self.base)

    def renew(self) -> None:
        """Raises LockBusy if the lock was taken over."""
        star = self.star
        if star._text("LOCK") != self.holder:
            raise LockBusy(f"{star.path}: the lock was taken over")
        now = int(time.time() * 1000)
        star._fs().setTimes(star._at("LOCK"), now, now)

    def publish(self, replace: dict[str, DataFrame], append: dict[str, DataFrame] | None = None, check: Callable[[dict[str, DataFrame]], list[str]] = lambda t: []) -> str:
        """Stages the tables, checks them as written, and makes them current; raises if the check finds faults.

        Tables not named stay as they are.
        """
        star = self.star
        version = f"v{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        folders = star.folders(self.base)
        for name, df in replace.items():
            self.renew()
            df.write.parquet(f"{star.path}/{version}/{name}")
            folders[name] = [f"{version}/{name}"]
        for name, df in (append or {}).items():
            self.renew()
            df.write.parquet(f"{star.path}/{version}/{name}")
            folders[name] = [*folders.get(name, []), f"{version}/{name}"]
        staged = {name: star.spark.read.parquet(*[f"{star.path}/{x}" for x in own]) for name, own in folders.items()}
        if faults := check(staged):
            raise ValueError("not published: " + "; ".join(faults))
        star._put(json.dumps(folders), version, "MANIFEST")
        star._put(version, f"{version}.pointer")
        self.renew()
        if star.current() != self.base:
            raise LockBusy(f"{star.path}: another version was published meanwhile")
        star._move(f"{version}.pointer", "CURRENT")
        self.base = version
        return version

    def compact(self, name: str, files: int) -> str:
        """Rewrites a table of many appended folders as one folder of so many files."""
        return self.publish({name: self.read(name).repartition(files)})
