"""The shared store as tables in a folder that change together, one version after the other.

A version is a small file that names the folder of every bucket of every table. An upsert reads the buckets that the wanted
keys fall into, writes those with a change to a new folder, and then names them in the file of the next version, which appears by
one rename that fails if another writer was first; that one's version is then taken as the base, and the upsert done again. So

- readers see whole versions, of all tables together, and one that has begun to read goes on, as folders are never changed;
- a writer that dies before the rename has changed nothing, and running it again is safe;
- wanted rows that the store has already make no version, and rewrite nothing;
- a stream's batch is told by its number, and a batch that comes again after its version was made is skipped.

The folder must be on a file system whose rename is atomic.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsplit.operators.store import upsert


@dataclass(frozen=True)
class Table:
    """A table's columns as DDL, and its key; buckets are a fixed number of hash ranges of the key."""

    schema: str
    keys: tuple[str, ...]
    buckets: int = 16

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")


class Overtaken(Exception):
    """Another writer made the version that was to be made."""


class Store:
    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table]) -> None:
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def at(self, *parts: str):
        return self.hadoop.Path("/".join([self.path, *parts]))

    def files(self):
        return self.at().getFileSystem(self.conf)

    def versions(self) -> list[int]:
        folder = self.at("versions")
        if not self.files().exists(folder):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in self.files().listStatus(folder) if f.getPath().getName().endswith(".json"))

    def version(self, number: int | None = None) -> dict:
        """number, tables (name to bucket to folder) and done (writer to its last batch) of a version, else of the last one."""
        made = self.versions()
        if number is None and not made:
            return {"number": 0, "tables": {}, "done": {}}
        return json.loads(self.spark.read.text(f"{self.path}/versions/{made[-1] if number is None else number:010d}.json", wholetext=True).first()[0])

    def read(self, name: str, version: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table as of a version, else of the last one; whole, or some of its buckets."""
        held = (version or self.version())["tables"].get(name, {})
        folders = [f"{self.path}/{folder}" for bucket, folder in sorted(held.items()) if buckets is None or int(bucket) in buckets]
        schema = self.tables[name].schema
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def snapshot(self) -> dict[str, DataFrame]:
        """All tables of the last version."""
        version = self.version()
        return {name: self.read(name, version) for name in self.tables}

    def stage(self, base: dict, wanted: dict[str, DataFrame]) -> dict[str, dict[str, str]]:
        """Write the buckets that wanted rows change to new folders, as table to bucket to folder. No reader sees them yet."""
        staged = {}
        for name, rows in wanted.items():
            table = self.tables[name]
            touched = [r[0] for r in rows.select(table.bucket()).distinct().collect()]
            old = self.read(name, base, touched)
            cells = [c for c in old.columns if c not in table.keys]
            merged = upsert(old.withColumn("row_no", F.lit(0)), rows, list(table.keys), cells).withColumn("_bucket", table.bucket())
            changed = [r[0] for r in merged.where("action IN ('append', 'update')").select("_bucket").distinct().collect()]
            if changed:
                folder = f"data/{uuid.uuid4().hex}"
                merged.where(F.col("_bucket").isin(changed)).select(*old.columns, "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
                staged[name] = {str(b): f"{folder}/_bucket={b}" for b in changed}
        return staged

    def commit(self, base: dict, staged: dict[str, dict[str, str]], done: dict[str, int]) -> int:
        """Make the version after base with the staged folders; Overtaken if there is one by now."""
        tables = {name: {**base["tables"].get(name, {}), **staged.get(name, {})} for name in {*base["tables"], *staged}}
        told = {"number": base["number"] + 1, "tables": tables, "done": {**base["done"], **done}}
        new, target = self.at("versions", f".{uuid.uuid4().hex}"), self.at("versions", f"{told['number']:010d}.json")
        out = self.files().create(new)
        out.write(json.dumps(told).encode())
        out.close()
        gateway = self.spark.sparkContext._gateway
        plain = gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0)
        try:
            self.hadoop.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else self.files().getUri(), self.conf).rename(new, target, plain)
        except Py4JJavaError as error:
            self.files().delete(new, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise Overtaken from error
            raise
        return told["number"]

    def upsert(self, wanted: dict[str, DataFrame], writer: str = "", batch: int | None = None, tries: int = 5) -> int:
        """The number of the version that holds the wanted rows, by table; each key of a table comes once among them.

        A writer's batches are numbered upwards; one that a version holds already is skipped.
        """
        for _ in range(tries):
            base = self.version()
            if batch is not None and base["done"].get(writer, -1) >= batch:
                return base["number"]
            staged = self.stage(base, wanted)
            if not staged and batch is None:
                return base["number"]
            try:
                return self.commit(base, staged, {} if batch is None else {writer: batch})
            except Overtaken:
                continue
        raise Overtaken(f"{tries} other writers came first")

    def clean(self, keep: int = 2) -> None:
        """Delete the versions before the last few, and folders that none of those left names: run it when no writer is at work."""
        made = self.versions()
        kept = {folder.split("/")[1] for n in made[-keep:] for held in self.version(n)["tables"].values() for folder in held.values()}
        for n in made[:-keep]:
            self.files().delete(self.at("versions", f"{n:010d}.json"), False)
        if self.files().exists(self.at("data")):
            for f in self.files().listStatus(self.at("data")):
                if f.getPath().getName() not in kept:
                    self.files().delete(f.getPath(), True)
