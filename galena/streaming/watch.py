"""Watching a source tree: changes go to a log, and a stream over the log indexes the tree anew after each burst.

A file source doesn't tell of files that are written again, so a poll compares the tree with what it was and appends the
changed paths to a folder of JSON lines, which Structured Streaming reads. Its micro-batches are one after another, so
changes during a run make exactly one more. Several logs, from several trees or hosts, may be read as one stream.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import walk

if TYPE_CHECKING:
    from pyspark.sql.streaming import StreamingQuery

    from ..engine import Engine

STATE = ".galena"
UNWATCHED = (".git", "node_modules")
CHANGES = "ts timestamp, path string"


def is_watched(path: Column) -> Column:
    """Whether a change of a path counts: not in the state's folder, and in no folder of versions or packages."""
    plain = F.translate(path, "\\", "/")
    inside = (plain == STATE) | F.startswith(plain, F.lit(f"{STATE}/"))
    return ~(inside | F.arrays_overlap(F.split(plain, "/"), F.array(*map(F.lit, UNWATCHED))))


class Poll:
    """Compares a local tree with what it was at the last call, by time and size."""

    def __init__(self, root: str, log: str) -> None:
        self.root, self.log = root, Path(log)
        self.log.mkdir(parents=True, exist_ok=True)
        self.known = self._now()

    def _now(self) -> dict[str, tuple[int, int]]:
        found = {}
        for path in walk(self.root):
            try:
                s = os.stat(os.path.join(self.root, path))
            except OSError:
                continue
            found[path] = (s.st_mtime_ns, s.st_size)
        return found

    def __call__(self) -> list[str]:
        """The paths that were added, changed or removed since, appended to the log as one file that appears whole."""
        now = self._now()
        changed = sorted(p for p in {*now, *self.known} if now.get(p) != self.known.get(p))
        self.known = now
        if changed:
            stamp = time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime())
            made = self.log / f".{uuid.uuid4().hex}"
            made.write_text("".join(json.dumps({"ts": stamp, "path": p}) + "\n" for p in changed))
            made.rename(self.log / f"{time.time_ns()}.json")
        return changed


def changes(spark: SparkSession, log: str) -> DataFrame:
    """The stream of changes (ts, path) that count."""
    return spark.readStream.schema(CHANGES).json(log).where(is_watched(F.col("path")))


def watch(engine: Engine, log: str, checkpoint: str, debounce_ms: int = 300, rank: bool = True, on_reindex: Callable[[dict], None] | None = None, on_error: Callable[[Exception], None] | None = None, once: bool = False) -> StreamingQuery:
    """Index (and rank) anew for each burst of changes in the log; stop the returned query to end.

    What comes within ``debounce_ms`` is one burst. An error goes to ``on_error`` and doesn't end the stream. With ``once``
    what is there is taken and the query ends."""

    def batch(rows: DataFrame, _: int) -> None:
        paths = [r.path for r in rows.select("path").distinct().orderBy("path").toLocalIterator()]
        if not paths:
            return
        began = time.monotonic()
        try:
            engine.index()
            if rank:
                engine.rank()
            if on_reindex:
                on_reindex({"changed_paths": paths, "duration_ms": int(1000 * (time.monotonic() - began))})
        except Exception as e:  # noqa: BLE001  the loop survives whatever an index run raises
            if on_error:
                on_error(e)

    writer = changes(engine.spark, log).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{debounce_ms} milliseconds")).start()
