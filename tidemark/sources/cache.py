"""Scans that are made once: a table of what a file or folder held, kept until its listing changes or its time is over.

The key of a source is its listing: whether it exists, and path, size and time of change of each file.  Looking at it reads
no data.  What a reader gives is written to a versioned store under the source's name; several readers and drivers share it.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .versions import VersionedStore

Clock = Callable[[], float]


def signature(spark: SparkSession, path: str) -> str:
    """A digest of the listing; files that Spark passes over (hidden ones and _SUCCESS) don't count."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return "missing"
    files, found = fs.listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        if not f.getPath().getName().startswith(("_", ".")):
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(found)).encode()).hexdigest()


class ScanCache:
    def __init__(self, spark: SparkSession, path: str, ttl: float = 90.0, clock: Clock = time.time):
        self.spark, self.store, self.ttl, self.clock, self.scans = spark, VersionedStore(spark, path), ttl, clock, 0

    def read(self, source: str, reader: Callable[[str], DataFrame]) -> DataFrame:
        """What reader(source) gives, read again only if the source has changed or the table is older than ttl seconds.

        `scans` counts how often a source was read.  Tables of different readers need caches of their own.
        """
        name, now = hashlib.sha256(source.encode()).hexdigest()[:16], signature(self.spark, source)
        note = f"{name}_note"
        tables = self.store.manifest()["tables"]
        if name in tables:
            kept = self.store.read(note).first()
            if kept.signature == now and 0 <= self.clock() - kept.made < self.ttl:
                return self.store.read(name)
        self.scans += 1
        made = self.spark.createDataFrame([(now, float(self.clock()))], "signature string, made double")
        self.store.commit(f"scan of {source}", {name: reader(source), note: made}, {t: set(tables[t]["files"]) for t in (name, note) if t in tables})
        return self.store.read(name)
