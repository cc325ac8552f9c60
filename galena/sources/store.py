"""The index as versioned Parquet snapshots: a new folder for each version and one pointer that is renamed into place."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SCHEMA_VERSION, TABLES
from ..session import small_side

POINTER = "_CURRENT"
SIDE_VERSION = "1"


def merged(old: DataFrame, new: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """old without the rows of changed keys, and new."""
    return old.join(small_side(changed.select(key).distinct()), key, "left_anti").select(old.columns).unionByName(new)


def pruned(tables: dict[str, DataFrame], live: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rows of files that aren't live (path), and edges only between nodes that are left."""
    live = live.select("path").distinct()
    out = {}
    for name, df in tables.items():
        key = "path" if name == "files" else "file_path" if "file_path" in df.columns else None
        out[name] = df.join(small_side(live.withColumnRenamed("path", key)), key, "left_semi").select(df.columns) if key else df
    if "edges" in out and "nodes" in out:
        ids = out["nodes"].select("id")
        for end in ("source", "target"):
            out["edges"] = out["edges"].join(ids.withColumnRenamed("id", end), end, "left_semi").select(tables["edges"].columns)
    return out


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and state (unchanged, changed, added, removed) by path and blob hash."""
    both = old.select("path", F.col("git_blob_hash").alias("before")).join(new.select("path", F.col("git_blob_hash").alias("after")), "path", "full_outer")
    state = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "unchanged").otherwise("changed")
    return both.select("path", state.alias("state"))


class Store:
    """Reads the current snapshot of a folder, of any file system that Spark knows, and writes the next one."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def version(self) -> str | None:
        fs, at = self._fs(f"{self.folder}/{POINTER}")
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode().strip()
        finally:
            stream.close()

    def exists(self) -> bool:
        return self.version() is not None

    def read(self, name: str) -> DataFrame:
        """A table of the current snapshot; without one an error, as reading never makes an index."""
        version = self.version()
        if version is None:
            raise FileNotFoundError(f"no index in {self.folder}")
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{version}/{name}") if name in TABLES else self.spark.read.parquet(f"{self.folder}/{version}/{name}")

    def tables(self) -> dict[str, DataFrame]:
        return {n: self.read(n) for n in TABLES}

    def has(self, name: str) -> bool:
        fs, at = self._fs(f"{self.folder}/{self.version()}/{name}")
        return self.exists() and fs.exists(at)

    def meta(self) -> dict:
        return {r.key: json.loads(r.value) for r in self.read("meta").collect()}

    def write(self, tables: dict[str, DataFrame], meta: dict | None = None) -> str:
        """Write all tables as a new snapshot, move the pointer to it, and delete the one before the last."""
        before = self.version()
        version = f"v-{uuid.uuid4().hex}"
        meta = {"schema_version": SCHEMA_VERSION} | (meta or {})
        tables = tables | {"meta": self.spark.createDataFrame([(k, json.dumps(v)) for k, v in meta.items()], TABLES["meta"])}
        for name, df in tables.items():
            kept = df.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in TABLES[name].split(", "))) if name in TABLES else df
            kept.write.parquet(f"{self.folder}/{version}/{name}")
        self._point(self.folder, version)
        self._forget({version, before})
        return version

    def _point(self, folder: str, to: str) -> None:
        """Write a new pointer beside the old one and rename it into place."""
        fs, at = self._fs(f"{folder}/{POINTER}-{uuid.uuid4().hex}")
        stream = fs.create(at, True)
        stream.write(bytearray(to.encode()))
        stream.close()
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        jarray = self.spark.sparkContext._gateway.new_array(options, 1)
        jarray[0] = options.OVERWRITE
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(at), fs.makeQualified(self._fs(f"{folder}/{POINTER}")[1]), jarray)

    def _forget(self, keep: set) -> None:
        """Snapshots but the current one and the one before, which readers may still hold."""
        fs, at = self._fs(self.folder)
        for status in fs.listStatus(at):
            name = status.getPath().getName()
            if name.startswith("v-") and name not in keep:
                fs.delete(status.getPath(), True)

    # sidecars: tables beside the snapshots, each in a folder of its own with a pointer to the newest

    def _side(self, name: str) -> str | None:
        fs, at = self._fs(f"{self.folder}/side/{name}/{POINTER}")
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            version, _, made = bytes(stream.readAllBytes()).decode().strip().partition(" ")
        except (Py4JJavaError, UnicodeDecodeError):  # damaged
            return None
        finally:
            stream.close()
        return f"{self.folder}/side/{name}/{made}" if version == SIDE_VERSION and made else None

    def side(self, name: str) -> DataFrame | None:
        """A sidecar; None if there is none, or one that is damaged or of another version."""
        try:
            at = self._side(name)
            return None if at is None else self.spark.read.parquet(f"{at}/rows")
        except AnalysisException:
            return None

    def side_meta(self, name: str) -> dict:
        at = self._side(name)
        return json.loads(self.spark.read.text(f"{at}/meta").first().value) if at else {}

    def write_side(self, name: str, rows: DataFrame, meta: dict | None = None) -> None:
        """Write a sidecar and move its pointer once it is whole. What was there before stays for its readers until the next."""
        before, made = self._side(name), f"s-{uuid.uuid4().hex}"
        at = f"{self.folder}/side/{name}"
        rows.write.parquet(f"{at}/{made}/rows")
        self.spark.createDataFrame([(json.dumps(meta or {}),)], "value string").coalesce(1).write.text(f"{at}/{made}/meta")
        self._point(at, f"{SIDE_VERSION} {made}")
        fs, folder = self._fs(at)
        for status in fs.listStatus(folder):
            found = status.getPath().getName()
            if found.startswith("s-") and found not in (made, (before or "").rpartition("/")[2]):
                fs.delete(status.getPath(), True)

    def size(self) -> int:
        """Bytes of the current snapshot."""
        fs, at = self._fs(f"{self.folder}/{self.version()}")
        return fs.getContentSummary(at).getLength()
