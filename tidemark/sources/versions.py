"""A store of tables in immutable Parquet files.  A version is a manifest that lists the files of every table.

A change writes new files first and then one manifest, whose name is the number of the version, by a rename that fails if
there is such a file: readers see all of a commit, over several tables, or nothing, and of two writers one has to go on from
the other's version.  Rows of a file change by copying the file (only files that hold such rows are read and written), old
versions stay readable until `vacuum`, and a rollback is a new version with the files of an old one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another commit has replaced files that this one would replace."""


class VersionedStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # files

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("data").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(), self._at(folder)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _publish(self, name: str, body: str) -> bool:
        """A file with this text, or False if there is one of this name."""
        jvm, fs = self.spark._jvm, self._fs()
        temp, final = self._at(f"manifests/.{uuid.uuid4().hex}"), self._at(name)
        out = fs.create(temp)
        out.write(bytearray(body.encode()))
        out.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("data").toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(temp), fs.makeQualified(final), self.spark._sc._gateway.new_array(rename, 0))
        except Exception as failure:
            fs.delete(temp, False)
            if "FileAlreadyExists" in str(failure):
                return False
            raise
        return True

    # versions

    def version(self) -> int:
        """The last version; 0 for an empty store."""
        return max((int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json") and not n.startswith(".")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "operation": "none", "tables": {}}
        lines = self.spark.read.text(f"{self.path}/manifests/{version:08d}.json", wholetext=True).first()
        return json.loads(lines[0])

    def history(self) -> DataFrame:
        """(version, operation, table, files) of every version that is kept."""
        rows = [(m["version"], m["operation"], name, len(t["files"])) for m in map(self.manifest, range(1, self.version() + 1)) for name, t in m["tables"].items()]
        return self.spark.createDataFrame(rows, "version int, operation string, table string, files int")

    def tables(self, version: int | None = None) -> list[str]:
        return sorted(self.manifest(version)["tables"])

    def _frame(self, schema: T.StructType, files: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{f}" for f in files)) if files else self.spark.createDataFrame([], schema)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The table's rows as of a version, the last one if none is given."""
        t = self.manifest(version)["tables"][table]
        return self._frame(T.StructType.fromJson(t["schema"]), t["files"])

    def write(self, table: str, df: DataFrame) -> list[str]:
        """New files of a table that belong to no version yet."""
        folder = f"{table}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/data/{folder}")
        return [f"{folder}/{n}" for n in sorted(self._names(f"data/{folder}")) if n.startswith("part-")]

    def commit(self, operation: str, add: dict[str, DataFrame], remove: dict[str, set[str]] | None = None) -> int:
        """One version in which tables have new rows and lose files.  A table's first rows give its schema."""
        remove = remove or {}
        written = {name: (df.schema, self.write(name, df)) for name, df in add.items()}
        while True:
            last = self.manifest()
            tables = {name: {"schema": t["schema"], "files": list(t["files"])} for name, t in last["tables"].items()}
            for name, gone in remove.items():
                if not gone <= set(tables[name]["files"]):
                    raise Conflict(f"files of {name} have been replaced since they were read")
                tables[name]["files"] = [f for f in tables[name]["files"] if f not in gone]
            for name, (schema, files) in written.items():
                tables.setdefault(name, {"schema": schema.jsonValue(), "files": []})["files"] += files
            number = last["version"] + 1
            if self._publish(f"manifests/{number:08d}.json", json.dumps({"version": number, "operation": operation, "tables": tables})):
                return number

    # changes

    def holding(self, table: str, rows: Callable[[DataFrame], DataFrame]) -> set[str]:
        """Files of the last version with rows that the function keeps (their names only come to the driver)."""
        kept = rows(self.read(table).withColumn("_file", F.col("_metadata.file_path"))).select("_file").distinct()
        return {r[0].split("/data/", 1)[1] for r in kept.collect()} if self.manifest()["tables"][table]["files"] else set()

    def of_files(self, table: str, files: set[str]) -> DataFrame:
        return self._frame(T.StructType.fromJson(self.manifest()["tables"][table]["schema"]), sorted(files))

    def _rewrite(self, operation: str, table: str, condition: Column, change: Callable[[DataFrame], DataFrame]) -> int:
        touched = self.holding(table, lambda df: df.where(condition))
        return self.commit(operation, {table: change(self.of_files(table, touched))}, {table: touched}) if touched else self.version()

    def append(self, table: str, df: DataFrame, operation: str = "append") -> int:
        return self.commit(operation, {table: df})

    def overwrite(self, table: str, df: DataFrame, operation: str = "overwrite") -> int:
        old = set(self.manifest()["tables"].get(table, {"files": []})["files"])
        return self.commit(operation, {table: df}, {table: old} if old else None)

    def update(self, table: str, condition: Column, values: dict[str, Column], operation: str = "update") -> int:
        """Set columns where the condition is true; a null condition is not true."""
        hit = F.coalesce(condition, F.lit(False))
        new = {c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}
        return self._rewrite(operation, table, condition, lambda df: df.withColumns(new))

    def delete(self, table: str, condition: Column, operation: str = "delete") -> int:
        return self._rewrite(operation, table, condition, lambda df: df.where(~F.coalesce(condition, F.lit(False))))

    def upsert(self, table: str, df: DataFrame, key: str, operation: str = "upsert") -> int:
        """Rows of df in place of those with their key, which df must have once; others are added."""
        touched = self.holding(table, lambda old: old.join(df.select(key), key, "left_semi"))
        kept = self.of_files(table, touched).join(df.select(key), key, "left_anti")
        return self.commit(operation, {table: kept.select(df.columns).unionByName(df)}, {table: touched})

    def dry_run(self, table: str, key: str, condition: Column, values: dict[str, Column]) -> DataFrame:
        """(key, field, old, new) as JSON of what update() would change; nothing is written."""
        rows = self.read(table).where(condition)
        each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.to_json(F.struct(F.col(c).alias("v"))).alias("old"), F.to_json(F.struct(v.alias("v"))).alias("new")) for c, v in values.items()))).alias("x")
        return rows.select(F.col(key), each).select(key, "x.*").where("old <> new")

    def rollback(self, version: int) -> int:
        """A new version with the tables of an old one."""
        old = self.manifest(version)
        while True:
            number = self.version() + 1
            if self._publish(f"manifests/{number:08d}.json", json.dumps({"version": number, "operation": f"rollback to {version}", "tables": old["tables"]})):
                return number

    def vacuum(self, keep: int) -> int:
        """Delete files that none of the last `keep` versions lists; returns how many.  Older manifests go, too."""
        last = self.version()
        used = {f for v in range(max(1, last - keep + 1), last + 1) for t in self.manifest(v)["tables"].values() for f in t["files"]}
        gone, fs = set(), self._fs()
        for v in range(1, last - keep + 1):
            try:
                gone |= {f for t in self.manifest(v)["tables"].values() for f in t["files"]} - used
            except PySparkException:
                continue  # gone before
            fs.delete(self._at(f"manifests/{v:08d}.json"), False)
        for f in gone:
            fs.delete(self._at(f"data/{f}"), False)
        return len(gone)
