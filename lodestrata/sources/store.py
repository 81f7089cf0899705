"""Versioned tables, operation logs and export formats.

A version is a set of directories that are written whole and never changed, listed in a manifest.  Numbered pointer files name the
versions in order; the highest complete one is current.  A pointer is created, never replaced or removed, so that a crash at any moment
leaves the last version readable, and of two writers that saw the same version only one can go on from it.
Readers pin a version or follow the pointer, so that a running query never sees a half-written table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Operation log: one JSON object a line.
OPERATION_LOG = "operation_id string, project string, kind string, severity string, message string, at timestamp"
#: Parts into which a keyed table is cut.
KEY_BUCKETS = 16
_BUCKET = "__bucket"


class SnapshotStore:
    """Versions of one table below ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):  # noqa: ANN202
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):  # noqa: ANN202
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _text(self, name: str) -> str:
        stream = self._fs().open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode().strip()
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> bool:
        """Creates a small file; False if it exists."""
        try:
            out = self._fs().create(self._path(name), False)
        except Exception:
            if self._fs().exists(self._path(name)):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _pointers(self) -> list[str]:
        fs, root = self._fs(), self._path("")
        return sorted((n for n in (f.getPath().getName() for f in fs.listStatus(root)) if n.startswith("CURRENT-")), reverse=True) if fs.exists(root) else []

    def _latest(self) -> tuple[int, str | None]:
        """(number, version) of the highest pointer that was written to its end."""
        for name in self._pointers():
            version = self._text(name)
            if version.endswith(";"):
                return int(name.split("-")[1]), version[:-1]
        return 0, None

    def current(self) -> str | None:
        """The version that the pointer names."""
        return self._latest()[1]

    def _point(self, version: str) -> bool:
        """Makes a version current, unless another writer came first since it was begun."""
        taken = int(self._pointers()[0].split("-")[1]) if self._pointers() else 0
        return self._create(f"CURRENT-{taken + 1:09d}", version + ";")

    def versions(self) -> list[str]:
        fs, root = self._fs(), self._path("")
        if not fs.exists(root):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory())

    def manifest(self, version: str | None = None) -> dict:
        """``parts`` (bucket to directory), ``keys``, ``schema``, ``revision`` and ``stale`` of a version."""
        name = version or self.current()
        if name is None:
            raise FileNotFoundError(f"no version below {self.root}")
        return json.loads(self._text(f"{name}.json"))

    def revision(self) -> int:
        """The number of the last change set that the current version holds; 0 without one."""
        return self.manifest()["revision"] if self.current() else 0

    def _write(self, df: DataFrame, version: str, keys: list[str] | None, partition_by: list[str] | None = None) -> dict[str, str]:
        path = f"{self.root}/{version}"
        if not keys:
            (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
            return {"": version}
        df.withColumn(_BUCKET, _bucket(keys)).repartition(KEY_BUCKETS, _BUCKET).write.partitionBy(_BUCKET).parquet(path)
        found = [s.getPath().getName() for s in self._fs().listStatus(self._path(version)) if s.isDirectory()]
        return {n.split("=")[1]: f"{version}/{n}" for n in found}

    def _commit(self, version: str, parts: dict[str, str], keys: list[str] | None, schema: StructType, revision: int) -> bool:
        self._create(f"{version}.json", json.dumps({"parts": parts, "keys": keys, "schema": schema.json(), "revision": revision, "stale": None}))
        return self._point(version)

    def _fresh(self) -> str:
        return f"v{self._latest()[0] + 1:09d}-{uuid.uuid4().hex[:8]}"

    def replace(self, df: DataFrame, partition_by: list[str] | None = None, keys: list[str] | None = None, revision: int = 0) -> str:
        """Writes a whole new version, cut by ``keys`` if given, then moves the pointer; of several writers the last holds."""
        version = self._fresh()
        parts = self._write(df, version, keys, partition_by)
        self._create(f"{version}.json", json.dumps({"parts": parts, "keys": keys, "schema": df.schema.json(), "revision": revision, "stale": None}))
        while not self._point(version):
            pass
        return version

    def replace_keys(self, df: DataFrame, keys: list[str], deleted: DataFrame | None = None, revision: int | None = None, retries: int = 10) -> str:
        """A new version in which the rows of the given keys are replaced, and those of ``deleted`` are gone.

        Only the buckets of these keys are read and written; the others go over as they are.  If another writer came first, the change is
        made again on top of that version.
        """
        gone = df.select(*keys).distinct()
        if deleted is not None:
            gone = gone.unionByName(deleted.select(*keys)).distinct()
        for _ in range(retries):
            number, base = self._latest()
            if base is None:
                return self.replace(df, keys=keys, revision=revision or 0)
            before, version = self.manifest(base), self._fresh()
            next_revision = before["revision"] if revision is None else revision
            if before["keys"] == keys:
                # at most KEY_BUCKETS numbers come to the driver
                touched = {str(r[0]) for r in gone.select(_bucket(keys).alias("b")).distinct().collect()}
                kept = {b: p for b, p in before["parts"].items() if b not in touched}
                rows = self._read_parts([p for b, p in before["parts"].items() if b in touched], before)
            else:
                kept, rows = {}, self.read(base)
            fresh = df if rows is None else rows.join(gone, keys, "left_anti").select(*df.columns).unionByName(df)
            parts = {**kept, **self._write(fresh, version, keys)}
            if self._latest()[0] == number and self._commit(version, parts, keys, df.schema, next_revision):
                return version
            self._fs().delete(self._path(version), True)
        raise RuntimeError(f"{self.root} was changed by others {retries} times")

    def mark_stale(self, reason: str) -> None:
        """Says of the current version that its sources have changed; the next version is fresh again."""
        self._create(f"{self.current()}.stale", reason)

    def stale(self) -> str | None:
        """Why the current version is stale, or None."""
        name = f"{self.current()}.stale"
        return self._text(name) if self.current() and self._fs().exists(self._path(name)) else None

    def _read_parts(self, parts: list[str], manifest: dict) -> DataFrame | None:
        if not parts:
            return None
        return self.spark.read.schema(StructType.fromJson(json.loads(manifest["schema"]))).parquet(*(f"{self.root}/{p}" for p in parts))

    def read(self, version: str | None = None, schema: StructType | str | None = None) -> DataFrame:
        """The pinned version, or the current one."""
        manifest = self.manifest(version)
        stored = StructType.fromJson(json.loads(manifest["schema"]))
        reader = self.spark.read.schema(schema or stored)
        if not manifest["parts"]:
            return self.spark.createDataFrame([], schema or stored)
        return reader.parquet(*(f"{self.root}/{p}" for p in manifest["parts"].values()))

    def stable_read(self, use, restarts: int = 3):  # noqa: ANN001, ANN201
        """Runs ``use`` on the current version, again if the pointer moved meanwhile; the last try is kept."""
        for attempt in range(restarts + 1):
            version = self.current()
            result = use(self.read(version))
            if self.current() == version or attempt == restarts:
                return result
        raise AssertionError("unreachable")


def _bucket(keys: list[str]):  # noqa: ANN202
    return F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS)).cast("int")


def read_operations(spark: SparkSession, path: str, project: str | None = None, kind: str | None = None, severity: str | None = None, since: str | None = None, limit: int = 50) -> DataFrame:
    """The newest operations of a JSON-lines log that fit the given options; broken lines are skipped."""
    df = spark.read.schema(OPERATION_LOG).option("mode", "DROPMALFORMED").json(path)
    for name, value in (("project", project), ("kind", kind), ("severity", severity)):
        if value is not None:
            df = df.filter(F.col(name) == value)
    if since is not None:
        df = df.filter(F.col("at") >= F.lit(since).cast("timestamp"))
    return df.orderBy(F.col("at").desc(), F.col("operation_id").desc()).limit(limit)


def append_operations(df: DataFrame, path: str) -> None:
    df.select(*(c.split()[0] for c in OPERATION_LOG.split(", "))).write.mode("append").json(path)


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, in as many files as partitions."""
    df.write.mode("overwrite").json(path)


def sarif_results(findings: DataFrame) -> DataFrame:
    """``result``: one SARIF result object a finding, from ``rule, severity, path, line_no, excerpt, fingerprint``."""
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warning").otherwise("note")
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.col("line_no"), F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    return findings.select(F.to_json(F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("excerpt").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"))).alias("result"))


def sarif_document(findings: DataFrame, path: str, tool: str = "lodestrata") -> None:
    """A SARIF file set: a header line, one result a line and a closing line in order, ready to be concatenated.

    The results stay distributed: parts are written in parallel and sorted by name.
    """
    rows = sarif_results(findings).select(F.concat("result", F.lit(",")).alias("value"))
    spark = findings.sparkSession
    head = spark.createDataFrame([('{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"%s"}},"results":[' % tool,)], "value string")
    tail = spark.createDataFrame([("null]}]}",)], "value string")
    head.coalesce(1).write.mode("overwrite").text(f"{path}/part-0-head")
    rows.write.mode("overwrite").text(f"{path}/part-1-results")
    tail.coalesce(1).write.mode("overwrite").text(f"{path}/part-2-tail")


def sarif_file(findings: DataFrame, path: str, tool: str = "lodestrata") -> None:
    """One valid SARIF file: the parts are written in parallel and then copied one after another, never held whole."""
    spark, parts = findings.sparkSession, f"{path}.parts"
    sarif_document(findings, parts, tool)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(parts)
    fs = folder.getFileSystem(conf)
    names = sorted(str(f.getPath()) for d in fs.listStatus(folder) for f in fs.listStatus(d.getPath()) if f.getPath().getName().startswith("part-"))
    out = fs.create(jvm.org.apache.hadoop.fs.Path(path), True)
    for name in names:
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(name))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
        stream.close()
    out.close()
    fs.delete(folder, True)


def read_catalog(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, tasks: int = 8, **options: str) -> DataFrame:
    """A table of a live database, read only, in parallel ranges of a numeric key if one is given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(tasks))
    return reader.load()
