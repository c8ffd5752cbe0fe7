"""A stored layer of aggregates that is kept up to date by partitions.

Raw rows are reduced once to mergeable partial aggregates (sums, maxima), and tables derived from these are stored beside them.
Everything is laid out by (state, month). New or late files change only the partitions their rows fall into: their
partials are added to the stored ones of these partitions, the derived tables of these partitions are made again, and the
rest stays as it is. A manifest, written last, names for each partition the version that holds it, so readers see either the
old or the new state, and it names the source files that are in, so a file is never counted twice. If a source file was changed or
removed, its share cannot be taken out of the sums, and the layer is built anew.

A partition keeps the time it was written, which is what reading with a time to live goes by.

One writer at a time: threads of one driver wait for each other in ``refresh``; another driver that writes at the same time
finds the version folder there and fails, having changed nothing.
"""

from __future__ import annotations

import datetime
import json
import threading
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterhour.sources.stage import children, shared

PART = ("state", "month")
PARTIALS = "partials"
Part = tuple[str | None, str | None]


def month_of(date: str = "date") -> Column:
    return F.date_format(date, "yyyy-MM")


def source_files(spark: SparkSession, path: str) -> dict[str, tuple[int, int]]:
    """Data files below a path with their size and time of change, as a scan of that path would list them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    found, left = {}, root.getFileSystem(conf).listFiles(root, True)
    while left.hasNext():
        f = left.next()
        if not f.getPath().getName().startswith(("_", ".")):
            found[f.getPath().toString()] = (f.getLen(), f.getModificationTime())
    return found


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    parts: dict[Part, tuple[int, float]] = field(default_factory=dict)  # version that holds it, and when it was written
    files: dict[str, tuple[int, int]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)  # of the tables, as Spark writes them in JSON

    def stale(self, ttl: float, now: float) -> set[Part]:
        return {p for p, (_, written) in self.parts.items() if now - written > ttl}


#: The manifest last read or written of each layer; a newer one in the folder is seen by its number.
_KNOWN: dict[tuple[str, str], Manifest] = {}
_REFRESHING = threading.RLock()


class Layer:
    """``keys``: columns of a partial, state and date among them. ``sums`` and ``maxima``: its aggregates.

    ``tables``: derived tables, each a function of partials whose groups lie within one state and date.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], sums: Sequence[str], maxima: Sequence[str] = (), tables: dict[str, Callable[[DataFrame], DataFrame]] | None = None, files_per_part: int = 1):
        self.spark, self.path, self.keys, self.sums, self.maxima = spark, path, list(keys), list(sums), list(maxima)
        self.tables, self.files_per_part = tables or {}, files_per_part

    # --- manifest

    def manifest(self) -> Manifest:
        numbers = [int(n) for n in children(self.spark, f"{self.path}/manifest") if n.isdigit() and "_SUCCESS" in children(self.spark, f"{self.path}/manifest/{n}")]
        if not numbers:
            return Manifest()
        key = (self.spark.sparkContext.applicationId, self.path)
        if key not in _KNOWN or _KNOWN[key].version != max(numbers):
            row = self.spark.read.schema("body string").json(f"{self.path}/manifest/{max(numbers)}").head()
            body = json.loads(row.body)
            _KNOWN[key] = Manifest(max(numbers), {(s, m): (v, w) for s, m, v, w in body["parts"]}, {f: (size, at) for f, size, at in body["files"]}, body["schemas"])
        return _KNOWN[key]

    def _commit(self, new: Manifest) -> None:
        body = json.dumps({"parts": [[*p, *v] for p, v in new.parts.items()], "files": [[f, *v] for f, v in new.files.items()], "schemas": new.schemas})
        self.spark.createDataFrame([(body,)], "body string").coalesce(1).write.mode("error").json(f"{self.path}/manifest/{new.version}")
        _KNOWN[self.spark.sparkContext.applicationId, self.path] = new

    # --- writing

    def aggregated(self, rows: DataFrame) -> DataFrame:
        """Partials of raw rows, or of partials."""
        return rows.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in self.sums], *[F.max(c).alias(c) for c in self.maxima])

    def _write(self, partials: DataFrame, version: int) -> tuple[set[Part], dict[str, str]]:
        """Store the partials and the derived tables of a version; returns the partitions it holds and the tables' schemas."""
        schemas = {}
        for name, derive in {PARTIALS: lambda p: p, **self.tables}.items():
            out = derive(partials).withColumn("month", month_of())
            spread = F.pmod(F.dayofmonth("date"), F.lit(self.files_per_part))
            out.repartition(*PART, spread).write.mode("error").partitionBy(*PART).parquet(f"{self.path}/{name}/version={version}")
            schemas[name] = out.schema.json()
        return {(r.state, r.month) for r in partials.select("state", month_of().alias("month")).distinct().collect()}, schemas

    def replace(self, rows: DataFrame, written_at: float | None = None, files: dict[str, tuple[int, int]] | None = None, whole: bool = False) -> Manifest:
        """Store rows as the new content of the partitions they fall into (of the layer, with ``whole``)."""
        old = self.manifest()
        partials = shared(self.aggregated(rows))
        version, at = old.version + 1, datetime.datetime.now().timestamp() if written_at is None else written_at
        held, schemas = self._write(partials, version)
        written = dict.fromkeys(held, (version, at))
        new = Manifest(version, written if whole else old.parts | written, old.files if files is None else files, schemas)
        self._commit(new)
        return new

    def add(self, rows: DataFrame, written_at: float | None = None, files: dict[str, tuple[int, int]] | None = None) -> Manifest:
        """Add rows to the partitions they fall into; only these are read and written."""
        fresh = shared(self.aggregated(rows))
        touched = {(r.state, r.month) for r in fresh.select("state", month_of().alias("month")).distinct().collect()}
        stored = self.read(PARTIALS, parts=touched).select(*fresh.columns) if touched & self.manifest().parts.keys() else None
        return self.replace(fresh if stored is None else fresh.unionByName(stored), written_at, files)

    def refresh(self, source: str, to_rows: Callable[[DataFrame], DataFrame]) -> Manifest:
        """Bring the layer up to the Parquet files at ``source``. ``to_rows`` makes raw rows: keys, sums and maxima."""
        with _REFRESHING:
            known, now = self.manifest(), source_files(self.spark, source)
            if known.version and known.files == now:
                return known
            table = self.spark.read.parquet(source)
            if not known.version or any(now.get(f) != v for f, v in known.files.items()):
                return self.replace(to_rows(table), files=now, whole=True)
            fresh = [f for f in now if f not in known.files]
            return self.add(to_rows(self.spark.read.schema(table.schema).parquet(*fresh)), files=now)

    # --- reading

    def read(self, table: str, parts: set[Part] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        """Rows of the current versions. Partitions (by name, or by the months of two dates) are chosen before files are read."""
        m = self.manifest()
        chosen = {p: v for p, (v, _) in m.parts.items() if (parts is None or p in parts) and (not start or (p[1] or "") >= start[:7]) and (not end or (p[1] or "") <= end[:7])}
        stored = T.StructType.fromJson(json.loads(m.schemas[table]))
        schema = T.StructType([f for f in stored.fields if f.name not in PART] + [T.StructField(c, k) for c, k in (("version", T.IntegerType()), ("state", T.StringType()), ("month", T.StringType()))])
        if not chosen:
            return self.spark.createDataFrame([], schema).drop("version", "month")
        base = f"{self.path}/{table}"
        rows = self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/version={v}" for v in sorted(set(chosen.values()))])
        name = F.concat_ws("/", F.col("version").cast("string"), F.coalesce("state", F.lit("")), F.coalesce("month", F.lit("")))
        rows = rows.where(name.isin([f"{v}/{p[0] or ''}/{p[1] or ''}" for p, v in sorted(chosen.items(), key=repr)]))
        rows = rows.where(F.col("date") >= F.lit(start).cast("date")) if start else rows
        rows = rows.where(F.col("date") <= F.lit(end).cast("date")) if end else rows
        return rows.drop("version", "month")

    def read_fresh(self, table: str, ttl: float, fetch: Callable[[set[Part]], DataFrame], now: float, wanted: set[Part] | None = None) -> DataFrame:
        """Read with a time to live: partitions older than ``ttl`` seconds, or not there yet, are fetched again and stored.

        ``fetch`` gives the raw rows of the partitions it is asked for. One that it has no rows for any more is dropped.
        """
        m = self.manifest()
        wanted = set(m.parts) if wanted is None else wanted
        again = {p for p in wanted if p not in m.parts} | (m.stale(ttl, now) & wanted)
        if again:
            m = self.replace(fetch(again), now)
            empty = {p for p in again if m.parts.get(p, (0, 0.0))[0] != m.version}
            if empty & m.parts.keys():
                self._commit(Manifest(m.version + 1, {p: v for p, v in m.parts.items() if p not in empty}, m.files, m.schemas))
        return self.read(table, parts=wanted)
