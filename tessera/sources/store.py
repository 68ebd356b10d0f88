"""A store of keyed tables in versions: copy on write by bucket, and one file that appears at once as the commit.

Rows of a table lie in buckets of a hash of their key. A transaction writes anew only those buckets that hold a key it touches, into folders of its own,
and then puts the next snapshot: a file that lists the folders of every bucket of every table, with the schemas and the properties of the store. Snapshots are
never changed. The last one is the store, so that a stop before it is put leaves the old version and a stop after it the new one, for all tables at once;
folders that no snapshot lists are left over, and ``vacuum`` removes them. Of two writers that began at the same version the second fails and is to be run again.

The driver holds one path for each bucket of a table, and collects which of the buckets are touched: both are bounded by the number of buckets.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 256
_BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer has put the version that was to be put."""


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; below a temporary one where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Files:
    """The few file operations that a commit needs, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        where = self.path(root)
        self.fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder))) if self.fs.exists(self.path(folder)) else []

    def read(self, name: str) -> str:
        found = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8")
        finally:
            found.close()

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self.path(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def put(self, source: str, target: str) -> bool:
        """Renames a file unless there is one of that name."""
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            self.context.rename(self.path(source), self.path(target), options)
        except Exception as failed:
            if "FileAlreadyExistsException" in str(failed):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row of each key: the greatest by the columns ``order``, and by its values as text among equal ones. Partial maxima go before the shuffle."""
    names = rows.columns
    value = F.struct(*(F.col(f"`{c}`") for c in names))
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order, F.to_json(value))).alias("_v")).select(*(F.col(f"_v.`{c}`").alias(c) for c in names))


class Store:
    """The tables under ``root``. ``after`` is called with a name after every step that leaves something behind (for tests)."""

    def __init__(self, spark: SparkSession, root: str, after: Callable[[str], None] = lambda step: None):
        self.spark, self.root, self.after = spark, root.rstrip("/"), after
        self.files = Files(spark, self.root)

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names(f"{self.root}/snapshots") if n.endswith(".json")]

    def snapshot(self, version: int | None = None) -> dict:
        """The snapshot of a version, by default the last; an empty one where there is none."""
        found = self.versions()
        if version is None and not found:
            return {"version": 0, "tables": {}, "properties": {}}
        return json.loads(self.files.read(self._snapshot_file(found[-1] if version is None else version)))

    def _snapshot_file(self, version: int) -> str:
        return f"{self.root}/snapshots/{version:012d}.json"

    def properties(self) -> dict:
        return self.snapshot()["properties"]

    def read(self, table: str, schema: StructType | str | None = None, version: int | None = None) -> DataFrame:
        """A table's rows; where the store has no such table, none, of the given schema."""
        return self._rows(self.snapshot(version), table, schema)

    def _rows(self, snapshot: dict, table: str, schema: StructType | str | None = None, buckets: set[int] | None = None) -> DataFrame:
        known = snapshot["tables"].get(table)
        if known is None:
            if schema is None:
                raise KeyError(table)
            return self.spark.createDataFrame([], schema)
        kind = StructType.fromJson(known["schema"])
        folders = [f for b, f in known["folders"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(kind).parquet(*(f"{self.root}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], kind)

    def transaction(self) -> Transaction:
        return Transaction(self)

    def vacuum(self, keep: int = 1) -> None:
        """Removes all but the last ``keep`` snapshots and the folders that only others list. Not to be run beside a writer."""
        old = self.versions()[:-keep]
        for v in old:
            self.files.delete(self._snapshot_file(v))
        used = {f.split("/")[1] for v in self.versions() for t in self.snapshot(v)["tables"].values() for f in t["folders"].values()}
        for name in set(self.files.names(f"{self.root}/data")) - used:
            self.files.delete(f"{self.root}/data/{name}")


class Transaction:
    """Changes of tables that appear together with ``commit``, or not at all. Each table is changed once."""

    def __init__(self, store: Store):
        self.store = store
        self.before = store.snapshot()
        self.tables = dict(self.before["tables"])
        self.changed: set[str] = set()

    def read(self, table: str, schema: StructType | str | None = None) -> DataFrame:
        """The table as it was when the transaction began."""
        return self.store._rows(self.before, table, schema)

    def _number(self, table: str, key: str) -> Column:
        return F.pmod(F.xxhash64(f"`{key}`"), F.lit(self.tables.get(table, {}).get("buckets", BUCKETS))).cast("int")

    def _old(self, table: str, schema: StructType, buckets: set[int]) -> DataFrame:
        return self.store._rows(self.before, table, schema, buckets)

    def _touched(self, table: str, key: str, *keys: DataFrame) -> set[int]:
        all_ = keys[0].select(key)
        for k in keys[1:]:
            all_ = all_.unionByName(k.select(key))
        return {r[0] for r in all_.select(self._number(table, key)).distinct().collect()}

    def _write(self, table: str, key: str, rows: DataFrame, touched: set[int]) -> None:
        if table in self.changed:
            raise ValueError(f"{table} is changed twice")
        self.changed.add(table)
        known = self.tables.get(table) or {"key": key, "buckets": BUCKETS, "folders": {}}
        if known["key"] != key:
            raise ValueError(f"the key of {table} is {known['key']}")
        if not touched:
            self.tables[table] = {"schema": rows.schema.jsonValue(), **known}
            return
        folder = f"data/{uuid.uuid4().hex}"
        # Small buckets share a task, large ones are split over several.
        rows.withColumn(_BUCKET, self._number(table, key)).hint("rebalance", F.col(_BUCKET)).write.partitionBy(_BUCKET).parquet(f"{self.store.root}/{folder}")
        self.store.after(f"data of {table}")
        there = {int(n.split("=")[1]) for n in self.store.files.names(f"{self.store.root}/{folder}") if n.startswith(f"{_BUCKET}=")}
        folders = {b: f for b, f in known["folders"].items() if int(b) not in touched} | {str(b): f"{folder}/{_BUCKET}={b}" for b in there}
        self.tables[table] = {**known, "schema": rows.schema.jsonValue(), "folders": folders}

    def replace(self, table: str, key: str, rows: DataFrame, touched: DataFrame | None = None) -> Transaction:
        """All rows of the keys in ``rows`` and ``touched`` go, ``rows`` come: a key may have many rows. Without rows a touched key is only deleted."""
        keys = rows.select(key) if touched is None else rows.select(key).unionByName(touched.select(key))
        buckets = self._touched(table, key, keys)
        kept = self._old(table, rows.schema, buckets).join(keys.distinct(), key, "left_anti").select(*rows.columns)
        self._write(table, key, kept.unionByName(rows), buckets)
        return self

    def upsert(self, table: str, key: str, rows: DataFrame, order: list[str], keep: list[str] = (), gone: Column | None = None) -> Transaction:
        """One row of a key: of several in ``rows`` the ``latest`` by ``order`` counts. It takes the place of the old row, whose values stay in the columns
        ``keep`` where the new one is null; a row for which ``gone`` holds removes its key. Rows without a key are left out."""
        new = latest(rows.filter(F.col(key).isNotNull()), key, order)
        buckets = self._touched(table, key, new)
        old = self._old(table, rows.schema, buckets).select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_o"))
        taken = new.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_n"), F.coalesce(gone, F.lit(False)).alias("_gone") if gone is not None else F.lit(False).alias("_gone"))
        both = old.join(taken, F.col(f"_o.`{key}`") == F.col(f"_n.`{key}`"), "full_outer").filter("_gone is null or not _gone")
        value = lambda c: F.when(F.col("_n").isNull(), F.col(f"_o.`{c}`")).otherwise(F.coalesce(F.col(f"_n.`{c}`"), F.col(f"_o.`{c}`")) if c in keep else F.col(f"_n.`{c}`"))
        self._write(table, key, both.select(*(value(c).alias(c) for c in rows.columns)), buckets)
        return self

    def commit(self, properties: dict | None = None) -> int:
        """Puts the next snapshot; returns its version."""
        store, version = self.store, self.before["version"] + 1
        text = json.dumps({"version": version, "tables": self.tables, "properties": self.before["properties"] | (properties or {})})
        own = f"{store.root}/snapshots/.{uuid.uuid4().hex}"
        store.files.write(own, text)
        store.after("snapshot written")
        if not store.files.put(own, store._snapshot_file(version)):
            store.files.delete(own)
            raise Conflict(f"version {version} is there already")
        store.after("snapshot put")
        return version
