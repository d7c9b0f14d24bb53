"""Tables in the folder that driver and executors share, and versioned commits."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BUCKET = "__bucket"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset a local master, as in tests, gets a folder below the warehouse; a
    cluster, whose machines may not share that, gets an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tidelog"


def settle(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class VersionedTable:
    """Target rows and their checkpoint, made visible together.

    Rows are dealt into buckets by the hash of ``key``, and a manifest names the folder of each bucket. A commit
    writes the buckets it changes to ``v=<n>-<token>`` and takes the others over from the last manifest, so its cost
    is that of the buckets that changes touch; ``buckets`` is set by the first commit. The manifest, which
    also holds the checkpoint, is then renamed into place through the Hadoop file system: a reader sees both
    or neither, and a failed commit leaves only an unnamed folder. Manifests are numbered; the largest
    rules. The last ``keep`` of them stay readable; older ones and folders that none of these names, and that no
    commit may still be writing, are removed. Without ``key`` the table is one bucket.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str] | tuple[str, ...] = (), buckets: int = 256, keep: int = 3):
        self.spark, self.path, self.key, self.keep = spark, path.rstrip("/"), list(key), keep
        self._first_buckets = buckets if key else 1
        self._jvm = spark._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _names(self, *folder: str) -> list[str]:
        at = self._at(*folder)
        return [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit())

    def _load(self, number: int) -> dict:
        stream = self._fs.open(self._at("manifests", f"{number}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self) -> dict | None:
        """The newest manifest: version, schema, folders of buckets and checkpoint; None before the first commit."""
        numbers = self._numbers()
        return self._load(numbers[-1]) if numbers else None

    def bucket(self, manifest: dict | None) -> Column:
        """The bucket of a row."""
        n = manifest["buckets"] if manifest else self._first_buckets
        return F.pmod(F.xxhash64(*self.key), F.lit(n)).cast("int") if self.key else F.lit(0)

    def read(self, only: set[int] | None = None) -> DataFrame | None:
        """The rows, of some buckets or of all."""
        m = self.manifest()
        if m is None:
            return None
        schema = T.StructType.fromJson(m["schema"])
        paths = [f"{self.path}/{folder}/{_BUCKET}={b}" for b, folder in m["folders"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, rows: DataFrame, checkpoint: dict, expected: int | None, touched: set[int] | None = None) -> int:
        """Publishes rows and checkpoint as the version after ``expected`` (None: the first). With ``touched`` rows are
        those of these buckets alone. Raises ``target_apply.checkpoint_conflict`` if another writer was first."""
        version, token = (0 if expected is None else expected + 1), uuid.uuid4().hex
        before, folder = self.manifest(), f"v={version}-{token}"
        dealt = rows.withColumn(_BUCKET, self.bucket(before))
        # One file for each bucket and task is enough: rows of a bucket meet before they are written.
        dealt.repartition(F.col(_BUCKET)).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        kept = {b: f for b, f in before["folders"].items() if touched is not None and int(b) not in touched} if before else {}
        made = {n.split("=")[1]: folder for n in self._names(folder) if n.startswith(f"{_BUCKET}=")}
        out = {"version": version, "token": token, "checkpoint": checkpoint, "buckets": before["buckets"] if before else self._first_buckets, "folders": kept | made, "schema": rows.schema.jsonValue()}
        self._fs.mkdirs(self._at("manifests"))
        draft, final = self._at("manifests", f".{token}"), self._at("manifests", f"{version}.json")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(out, sort_keys=True).encode()))
        stream.close()
        current = self.manifest()
        if (current["version"] if current else None) != expected or self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            self._fs.delete(self._at(folder), True)
            raise RuntimeError("target_apply.checkpoint_conflict")
        self._clean(version)
        return version

    def _clean(self, version: int) -> None:
        """Removes manifests beyond the last ``keep`` and folders that only they or failed commits made."""
        numbers = self._numbers()
        rest = numbers[-self.keep :]
        named = {f for n in rest for f in self._load(n)["folders"].values()}
        for name in self._names():
            if name.startswith("v=") and name not in named and int(name[2:].split("-")[0]) <= version - self.keep:
                self._fs.delete(self._at(name), True)
        for n in numbers[: -self.keep]:
            self._fs.delete(self._at("manifests", f"{n}.json"), False)


def resolve_commit(checkpoint: dict | None, transaction_id: str, cursor: str, after: bool) -> str:
    """What became of a commit whose answer was lost: APPLIED, NOT_APPLIED or UNPROVABLE.
    ``after`` says whether the checkpoint's cursor lies behind the transaction's."""
    if checkpoint is None or after:
        return "NOT_APPLIED"
    if checkpoint.get("last_transaction_id") == transaction_id and checkpoint.get("cursor") == cursor:
        return "APPLIED"
    return "UNPROVABLE"


def task_log(df: DataFrame, path: str) -> None:
    """Appends events to a task log without row values: id, time, code and digests only."""
    keep = [c for c in ("event_id", "at", "route", "code", "transaction_id", "digest", "phase") if c in df.columns]
    df.select(*keep).write.mode("append").parquet(path)


def page(log: DataFrame, after: int, lines: int = 256) -> DataFrame:
    """The next events of a log after a cursor."""
    return log.filter(F.col("event_id") > after).orderBy("event_id").limit(lines)
