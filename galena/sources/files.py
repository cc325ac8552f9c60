"""Source trees and raw files as DataFrames."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import extension, glob_regex, is_valid
from ..schema import MAX_FILE_BYTES

DEFAULT_IGNORE = ("node_modules/", ".git/", ".galena/", "dist/", "build/", "out/", ".next/", "coverage/", "*.min.js", "*.map", "*.lock", "pnpm-lock.yaml", "package-lock.json", "yarn.lock")
IGNORE_FILES = (".gitignore", ".ignore", ".galenaignore")
BINARY = tuple("png jpg jpeg gif bmp ico webp avif tiff psd pdf zip gz tgz bz2 xz zst 7z rar tar jar war class o a so dylib dll exe bin wasm pyc pyo mp3 mp4 m4a avi mov mkv webm wav flac ogg ttf otf woff woff2 eot db sqlite sqlite3 parquet orc avro npy npz pkl onnx pt h5 doc docx xls xlsx ppt pptx".split())
BOMS = (b"\xef\xbb\xbf", b"\x00\x00\xfe\xff", b"\xff\xfe\x00\x00", b"\x84\x31\x95\x33", b"\xfe\xff", b"\xff\xfe")
LEGACY = ("gb18030", "shift_jis", "euc-kr", "cp1252")


def ignore_rules(content: str) -> list[tuple[re.Pattern, bool, bool]]:
    """Pattern, whether it takes back, and whether it is for folders only, of each line that says something."""
    rules = []
    for line in content.splitlines():
        line = line.rstrip() if not line.endswith("\\ ") else line
        if not line or line.startswith("#"):
            continue
        back = line.startswith("!")
        line = line[1:] if back else line
        folder = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        rules.append((re.compile(f"^{'' if anchored else '(?:.*/)?'}{glob_regex(line.lstrip('/'))}$"), back, folder))
    return rules


class Ignore:
    """The ignore files from the root to a folder; the last rule that matches decides."""

    def __init__(self, levels: list[tuple[str, list]] | None = None) -> None:
        self.levels = levels or []

    def below(self, folder: str, at: Path, names: tuple[str, ...]) -> Ignore:
        rules = [r for n in names if (at / n).is_file() for r in ignore_rules((at / n).read_text(errors="replace"))]
        return Ignore([*self.levels, (folder, rules)]) if rules else self

    def __call__(self, path: str, folder: bool) -> bool:
        said = False
        for base, rules in self.levels:
            rest = path[len(base) :].lstrip("/")
            for pattern, back, only_folders in rules:
                if (folder or not only_folders) and pattern.match(rest):
                    said = not back
        return said


def walk(root: str, include: list[str] | None = None, exclude: list[str] | None = None, gitignore: bool = True, defaults: bool = True) -> list[str]:
    """The paths of the files below a local root that aren't ignored, hidden ones too; links aren't followed."""
    top = Path(root)
    if not top.is_dir():
        raise NotADirectoryError(root)
    base = list(DEFAULT_IGNORE if defaults else ())
    if gitignore and (top / ".git/info/exclude").is_file():
        base += (top / ".git/info/exclude").read_text(errors="replace").splitlines()
    first = Ignore([("", ignore_rules("\n".join(base)))])
    unwanted = [re.compile(f"^{glob_regex(g)}$") for g in exclude or []]
    wanted = [re.compile(f"^{glob_regex(g)}$") for g in include or []]
    out, todo = [], [("", first)]
    while todo:
        folder, rules = todo.pop()
        rules = rules.below(folder, top / folder, IGNORE_FILES if gitignore else IGNORE_FILES[1:])
        with os.scandir(top / folder) as entries:
            for e in entries:
                path = f"{folder}/{e.name}" if folder else e.name
                is_folder = e.is_dir(follow_symlinks=False)
                if e.is_symlink() or rules(path, is_folder) or any(p.match(path) or p.match(path + "/") for p in unwanted):
                    continue
                if is_folder:
                    todo.append((path, rules))
                elif e.is_file(follow_symlinks=False) and (not wanted or any(p.match(path) for p in wanted)):
                    out.append(path)
    return sorted(out)


def read_tree(spark: SparkSession, root: str, max_bytes: int = MAX_FILE_BYTES, **options) -> DataFrame:
    """path, size and bytes of the files below a root. The bytes are read by the tasks, not of binary or too large files."""
    paths = walk(root, **options)
    frame = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths) // 64 + 1, 4096)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column("path").to_pylist():
                try:
                    size = os.path.getsize(os.path.join(root, p))
                    skip = size > max_bytes or p.rpartition(".")[2].lower() in BINARY
                    data = None if skip else Path(root, p).read_bytes()
                except OSError:
                    size, data = 0, None
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([size], pa.int64()), pa.array([data], pa.binary())], ["path", "size", "bytes"])

    return frame.mapInArrow(run, "path string, size bigint, bytes binary")


@F.pandas_udf(T.StringType())
def legacy_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Text of other encodings than UTF-8: by its mark, else the first of some that fits; null if none does."""

    def one(data: bytes | None) -> str | None:
        if data is None:
            return None
        for mark, name in ((BOMS[1], "utf-32"), (BOMS[2], "utf-32"), (BOMS[4], "utf-16"), (BOMS[5], "utf-16"), (BOMS[3], "gb18030")):
            if data.startswith(mark):
                try:
                    return data.decode(name).lstrip("﻿")
                except UnicodeError:
                    return None
        for name in LEGACY:
            try:
                return data.decode(name)
            except UnicodeError:
                continue
        return None

    for batch in batches:
        yield batch.map(one, na_action="ignore")


def decoded(raw: DataFrame, max_bytes: int = MAX_FILE_BYTES, validate: bool = True) -> DataFrame:
    """raw (path, bytes and perhaps size) with size, content and reason, why a file is skipped or null.

    In this order: binary-extension, size-limit, binary-content (a zero byte without a byte order mark), encoding-error,
    invalid-file. Only bytes that aren't UTF-8 go through Python.
    """
    data = F.col("bytes")
    size = F.col("size") if "size" in raw.columns else F.length(data).cast("bigint")
    marked = F.lit(False)
    for b in BOMS:
        marked = marked | F.startswith(data, F.lit(bytearray(b)))
    early = F.when(extension(F.col("path")).isin(*BINARY), "binary-extension").when(size > max_bytes, "size-limit").when(data.isNull(), "encoding-error").when(F.contains(data, F.lit(bytearray(b"\x00"))) & ~marked, "binary-content")
    step = raw.withColumns({"size": size, "reason": early})
    as_text = data.cast("string")
    utf8 = F.is_valid_utf8(as_text)
    step = step.withColumn("legacy", legacy_text(F.when(F.col("reason").isNull() & ~utf8, data)))
    content = F.when(F.col("reason").isNull(), F.when(utf8, F.regexp_replace(as_text, "^﻿", "")).otherwise(F.col("legacy")))
    step = step.withColumn("content", content)
    bad = F.col("reason").isNull() & (F.col("content").isNull() | F.contains("content", F.lit("�")))
    reason = F.when(bad, "encoding-error").otherwise(F.col("reason"))
    if validate:
        reason = F.coalesce(reason, F.when(~is_valid(F.col("content"), F.col("path")), "invalid-file"))
    step = step.withColumn("reason", reason)
    return step.withColumn("content", F.when(F.col("reason").isNull(), F.col("content"))).drop("bytes", "legacy")


def skip_reason() -> Column:
    return F.col("reason")


def ingest(spark: SparkSession, root: str, max_bytes: int = MAX_FILE_BYTES, validate: bool = True, **options) -> tuple[DataFrame, DataFrame]:
    """The files (path, size, content) and those skipped (path, reason) below a root."""
    every = decoded(read_tree(spark, root, max_bytes, **options), max_bytes, validate)
    return every.where("reason is null").drop("reason"), every.where("reason is not null").select("path", "reason")


def changed_files(root: str, since: str | None = None) -> list[str] | None:
    """Paths that differ from HEAD or ``since``, or aren't tracked; None outside a repository or for an unknown ref."""

    def git(*args: str) -> list[str] | None:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True)
        return [x for x in done.stdout.split("\0") if x] if done.returncode == 0 else None

    if git("rev-parse", "--git-dir") is None:
        return None
    if since is not None and (since.startswith("-") or git("rev-parse", "--verify", "--quiet", since + "^{commit}") is None):
        return None
    tracked = git("diff", "--name-only", "-z", since or "HEAD")
    if tracked is None:
        tracked = git("diff", "--name-only", "-z") or []
    return sorted({*tracked, *(git("ls-files", "-z", "--others", "--exclude-standard") or [])})
