"""Tables with versions: staged files that one atomic rename of a manifest makes visible, and derived tables that are kept.

A versioned table is a folder with ``data`` (Parquet, a folder for each commit and in
it one for each bucket of the key) and ``versions`` (a manifest for each version: which
folders hold which bucket).  A writer stages files first and then creates the next
manifest under a name that must not exist yet; so of two writers that start from the
same version one fails with :class:`Stale`, a killed writer leaves nothing that a reader
sees, and a commit that carries the id of one that went through adds nothing.  An
upsert reads and rewrites only the buckets that its keys fall in.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
_own_dir: str | None = None


class Stale(Exception):
    """The table has moved on from the version that a commit expected."""


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset, a temporary one if Spark runs in one process (tests), else an error."""
    global _own_dir
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="evidora-kept-")
    return _own_dir


class Files:
    """The few file operations that a commit needs, on whatever file system a path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def facts(self, folder: str) -> list[tuple]:
        """Path, length and time of change of the files of a folder, or of one file."""
        p = self.path(folder)
        return sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def publish(self, staged: str, name: str) -> bool:
        """Give a staged file its name in one step; false if there is one of that name."""
        if self.fs.getUri().getScheme() == "file":  # where a rename would replace it
            local = lambda n: self.path(n).toUri().getPath()
            try:
                os.link(local(staged), local(name))
            except FileExistsError:
                return False
            finally:
                self.delete(staged)
            return True
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        none = self.jvm.java.lang.reflect.Array.newInstance(options.NONE.getClass(), 0)
        try:
            context.rename(self.path(staged), self.path(name), none)
        except Exception:
            if not self.exists(name):
                raise
            self.delete(staged)
            return False
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class VersionedTable:
    """A table by its folder and key columns; version 0 is the empty table before its first commit."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets
        self.files = Files(spark, root)

    def version(self) -> int:
        return max((int(n.split(".")[0]) for n in self.files.names(f"{self.root}/versions") if n.endswith(".json") and not n.startswith(".")), default=0)

    def manifest(self, version: int) -> dict:
        return json.loads(self.files.read(f"{self.root}/versions/{version:010d}.json")) if version else {"buckets": {}, "schema": None, "done": {}, "count": self.buckets}

    def read(self, version: int | None = None) -> DataFrame:
        found = self.manifest(self.version() if version is None else version)
        if found["schema"] is None:
            raise ValueError(f"{self.root} has no version yet")
        return self._of(found, [x for folders in found["buckets"].values() for x in folders])

    def _of(self, manifest: dict, folders: list[str]) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/data/{x}" for x in folders))

    def _stage(self, rows: DataFrame, count: int) -> tuple[str, list[str]]:
        """Write rows by bucket; the commit's folder and the buckets that have rows."""
        name = uuid.uuid4().hex
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(count))
        rows.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/data/{name}")
        return name, [n.split("=")[1] for n in self.files.names(f"{self.root}/data/{name}") if n.startswith("_bucket=")]

    def _commit(self, expected: int, made: dict, txn: str | None) -> int:
        next_version = expected + 1
        if txn:
            made["done"] = made["done"] | {txn: next_version}
        staged = f"{self.root}/versions/.{uuid.uuid4().hex}"
        self.files.write(staged, json.dumps(made))
        if not self.files.publish(staged, f"{self.root}/versions/{next_version:010d}.json"):
            raise Stale(f"version {next_version} of {self.root} exists")
        return next_version

    def _start(self, expected: int | None, txn: str | None) -> tuple[int, dict, int | None]:
        """The version to start from, its manifest, and the version a repeated commit already made."""
        now = self.version()
        current = self.manifest(now)
        if txn and txn in current["done"]:
            return now, current, current["done"][txn]
        if expected is not None and expected != now:
            raise Stale(f"{self.root} is at version {now}, not {expected}")
        return now, current, None

    def replace(self, rows: DataFrame, expected: int | None = None, txn: str | None = None) -> int:
        """A version that holds these rows only."""
        now, current, done = self._start(expected, txn)
        if done:
            return done
        name, held = self._stage(rows, current["count"])
        return self._commit(now, current | {"schema": rows.schema.jsonValue(), "buckets": {b: [f"{name}/_bucket={b}"] for b in held}}, txn)

    def append(self, rows: DataFrame, expected: int | None = None, txn: str | None = None) -> int:
        """A version with these rows besides all others."""
        now, current, done = self._start(expected, txn)
        if done:
            return done
        name, held = self._stage(rows, current["count"])
        buckets = {b: list(f) for b, f in current["buckets"].items()}
        for b in held:
            buckets.setdefault(b, []).append(f"{name}/_bucket={b}")
        return self._commit(now, current | {"schema": current["schema"] or rows.schema.jsonValue(), "buckets": buckets}, txn)

    def upsert(self, rows: DataFrame, expected: int | None = None, txn: str | None = None, gone: str | None = None) -> int:
        """A version in which these rows (one a key) stand in place of those with their keys.

        Rows for which the expression ``gone`` holds are only taken away.  Buckets without a changed key are neither read nor written.
        """
        now, current, done = self._start(expected, txn)
        if done:
            return done
        if current["schema"] is None:
            return self.replace(rows.where(~F.coalesce(F.expr(gone), F.lit(False))) if gone else rows, expected, txn)
        schema = StructType.fromJson(current["schema"])
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(current["count"]))
        touched = sorted(str(r[0]) for r in rows.select(bucket).distinct().collect())  # at most the number of buckets
        old = self._of(current, [x for b in touched for x in current["buckets"].get(b, [])])
        new = (rows.where(~F.coalesce(F.expr(gone), F.lit(False))) if gone else rows).select(*schema.names)
        name, held = self._stage(old.join(rows.select(*self.keys), self.keys, "left_anti").unionByName(new), current["count"])
        buckets = {b: f for b, f in current["buckets"].items() if b not in touched} | {b: [f"{name}/_bucket={b}"] for b in held}
        return self._commit(now, current | {"buckets": buckets}, txn)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete the folders that none of the last ``keep`` versions names, and older manifests; no writer may be at work."""
        now = self.version()
        used = {x.split("/")[0] for v in range(max(now - keep + 1, 1), now + 1) for folders in self.manifest(v)["buckets"].values() for x in folders}
        gone = [n for n in self.files.names(f"{self.root}/data") if n not in used]
        for n in gone:
            self.files.delete(f"{self.root}/data/{n}")
        for v in range(1, now - keep + 1):
            self.files.delete(f"{self.root}/versions/{v:010d}.json")
        return gone


def _kept_target(spark: SparkSession, name: str, sf_dir: str, tables: tuple[str, ...]) -> tuple[Files, str, str]:
    files, source = Files(spark, shared_dir(spark)), Files(spark, sf_dir)
    tag = uuid.uuid5(uuid.NAMESPACE_OID, json.dumps([name, [source.facts(f"{sf_dir}/{t}.parquet") for t in tables]])).hex
    home = f"{shared_dir(spark)}/kept"
    return files, home, f"{home}/{name}-{tag}"


def kept_folder(spark: SparkSession, name: str, sf_dir: str, tables: tuple[str, ...], build) -> str:
    """A folder of things derived from tables, made once by ``build(folder)`` and used until a file of theirs changes.

    The folder's name is a digest of the files that it comes from, and it gets that name only when it is complete, so a lost
    or a second builder does no harm.
    """
    files, home, target = _kept_target(spark, name, sf_dir, tables)
    if not files.exists(target):
        staged = f"{home}/.{name}-{uuid.uuid4().hex}"
        build(staged)
        if files.exists(target) or not files.fs.rename(files.path(staged), files.path(target)):
            files.delete(staged)
    return target


def kept_already(spark: SparkSession, name: str, sf_dir: str, tables: tuple[str, ...]) -> DataFrame | None:
    """The table that :func:`kept` has made of these files, none if it has not."""
    files, _, target = _kept_target(spark, name, sf_dir, tables)
    return spark.read.parquet(target) if files.exists(target) else None


def kept(spark: SparkSession, name: str, sf_dir: str, tables: tuple[str, ...], build, write=None) -> DataFrame:
    """A table that ``build()`` derives from others, kept as :func:`kept_folder` says; ``write`` may sort or partition it."""

    def make(folder):
        rows = build()
        (write(rows) if write else rows.write).parquet(folder)

    return spark.read.parquet(kept_folder(spark, name, sf_dir, tables, make))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs nothing before it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
