"""Tables in versions: keyed upserts, tombstones and appends as small folders, committed one after the other.

A version is a list of folders under ``data`` (``version=<number>-<name>``), each laid out by ``cell``. Writing adds a
folder and then a manifest with the next number; the manifest is moved into place only if no other writer has taken
that number, else ``Conflict`` is raised and nothing has changed. A row is in the table if it is the newest of its key
and no tombstone, so neither an upsert nor a delete rewrites what is stored. Readers keep the version they began with.

An application that numbers its batches is told apart by name: a batch that was committed is not added again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GONE = "__gone"


class Conflict(RuntimeError):
    """Another writer has committed since the snapshot was taken."""


@dataclass
class Snapshot:
    version: int = -1
    folders: list[str] = field(default_factory=list)
    #: The last batch of each application.
    batches: dict[str, int] = field(default_factory=dict)
    #: Whatever else a writer keeps with the table, such as the last id it gave.
    facts: dict[str, int] = field(default_factory=dict)


@dataclass
class VersionedTable:
    """``keys`` empty: a log, whose rows are only added. ``cell`` names the folder of a row; all rows of a key share one."""

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: list[str] = field(default_factory=list)
    cell: Column | None = None

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    # ------------------------------------------------------------ snapshots

    def snapshot(self) -> Snapshot:
        """The newest version; version -1 has no rows."""
        fs = self._fs()
        if not fs.exists(self._path("_log")):
            return Snapshot()
        names = [s.getPath().getName() for s in fs.listStatus(self._path("_log"))]
        last = max((n for n in names if n.endswith(".json") and not n.startswith(".")), default=None)
        if last is None:
            return Snapshot()
        text = "".join(r["value"] for r in self.spark.read.text(f"{self.path}/_log/{last}").collect())  # a manifest: a line
        return Snapshot(**json.loads(text))

    def _commit(self, base: Snapshot, new: Snapshot) -> Snapshot:
        """Put the manifest at its number, or fail if that is taken."""
        fs, jvm = self._fs(), self.spark._jvm
        staged, place = self._path(f"_log/.{uuid.uuid4().hex}"), self._path(f"_log/{new.version:012d}.json")
        out = fs.create(staged)
        out.write(bytearray(json.dumps(new.__dict__).encode()))
        out.close()
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        plain[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE  # a move that replaces nothing
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(staged), fs.makeQualified(place), plain)
        except Py4JJavaError as e:
            fs.delete(staged, False)
            for name in set(new.folders) - set(base.folders):
                fs.delete(self._path(f"data/{name}"), True)
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise Conflict(f"version {new.version} of {self.path} was written by another") from e
            raise
        return new

    # ------------------------------------------------------------ reading

    def _stored(self, folders: list[str], cells: list[str] | None, columns: list[str] | None = None) -> DataFrame:
        kept = T.StructType([*self.schema.fields, T.StructField(GONE, T.BooleanType()), T.StructField("version", T.StringType()), T.StructField("cell", T.StringType())])
        if not folders:
            rows = self.spark.createDataFrame([], kept)
        else:
            rows = self.spark.read.schema(kept).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/{n}" for n in folders])
        if cells is not None:
            rows = rows.where(F.col("cell").isin(cells))
        return rows.select(*(columns or self.schema.names), GONE, "version") if self.keys else rows.select(*(columns or self.schema.names))

    def read(self, at: Snapshot | None = None, cells: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
        """The rows of a version, of some cells and with some columns (the keys among them): others' bytes are not read.

        A single folder is a plain scan. Folders that hold tombstones alone are joined out; only where rows were
        upserted after others is the newest of each key sought.
        """
        at = at or self.snapshot()
        if not self.keys:
            return self._stored(at.folders, cells, columns)
        gone = [n for n in at.folders if n.endswith("-gone")]
        data = [n for n in at.folders if not n.endswith("-gone")]
        rows = self._stored(data, cells, columns)
        if len(data) > 1:
            names = [c for c in rows.columns if c != "version"]
            newest = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in self.keys]).agg(F.max_by(F.struct(*names, "version"), "version").alias("row"))
            rows = newest.select("row.*")
        if gone:
            later = self._stored(gone, cells, self.keys).groupBy(*self.keys).agg(F.max("version").alias("__at"))
            rows = rows.join(later, self.keys, "left").where(F.col("__at").isNull() | (F.col("__at") < F.col("version"))).drop("__at")
        return rows.drop(GONE, "version").select(*(columns or self.schema.names))

    # ------------------------------------------------------------ writing

    def cells_of(self, rows: DataFrame) -> list[str]:
        """The cells that a batch touches: a name a cell of the batch, whatever the table's size."""
        return sorted(r["cell"] for r in rows.select(self._cell().alias("cell")).distinct().collect())

    def _cell(self) -> Column:
        return (self.cell if self.cell is not None else F.lit("all")).cast("string")

    def _write(self, base: Snapshot, rows: DataFrame, gone: bool) -> str:
        name = f"version={base.version + 1:012d}-{uuid.uuid4().hex[:8]}" + "-gone" * gone
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        rows.select(*columns, F.lit(gone).alias(GONE), self._cell().alias("cell")).write.partitionBy("cell").parquet(f"{self.path}/data/{name}")
        return name

    def _seen(self, base: Snapshot, app: str | None, batch: int | None) -> bool:
        return app is not None and base.batches.get(app, -1) >= (batch or 0)

    def _next(self, base: Snapshot, folders: list[str], app: str | None = None, batch: int | None = None, facts: dict[str, int] | None = None) -> Snapshot:
        batches = {**base.batches, **({app: batch or 0} if app is not None else {})}
        return self._commit(base, Snapshot(base.version + 1, folders, batches, {**base.facts, **(facts or {})}))

    def add(self, rows: DataFrame, base: Snapshot | None = None, app: str | None = None, batch: int | None = None, facts: dict[str, int] | None = None) -> Snapshot:
        """Upsert ``rows`` (keys unique among them), or append them to a log. A batch seen before changes nothing."""
        base = base or self.snapshot()
        if self._seen(base, app, batch):
            return base
        return self._next(base, [*base.folders, self._write(base, rows, False)], app, batch, facts)

    def remove(self, keys: DataFrame, base: Snapshot | None = None, app: str | None = None, batch: int | None = None) -> Snapshot:
        """Delete by tombstones: writes the keys of ``keys`` alone."""
        if not self.keys:
            raise ValueError("a log has no keys to delete")
        base = base or self.snapshot()
        if self._seen(base, app, batch):
            return base
        return self._next(base, [*base.folders, self._write(base, keys.select(*self.keys).distinct(), True)], app, batch)

    def compact(self, base: Snapshot | None = None) -> Snapshot:
        """One folder with the rows that are left. Earlier versions stay readable until ``clean``."""
        base = base or self.snapshot()
        if len(base.folders) < 2:
            return base
        return self._next(base, [self._write(base, self.read(base), False)])

    def clean(self) -> int:
        """Remove the folders that the newest version does not use; the number removed."""
        fs, used, n = self._fs(), set(self.snapshot().folders), 0
        if not fs.exists(self._path("data")):
            return 0
        for s in fs.listStatus(self._path("data")):
            if s.getPath().getName() not in used:
                n += fs.delete(s.getPath(), True)
        return n
