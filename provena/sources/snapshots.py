"""Tables that change by document and are always read whole.

A change writes the buckets it touches into a new folder and then names a new version: a small file that says for every
bucket which folder holds it. The file appears in one rename, so a reader sees the version before or the version after, a
failed write leaves nothing that anyone reads, and of two writers that start from one version only one comes through.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATTEMPTS = 10
# A bucket is written by up to so many tasks.
SPREAD = 16


class ConflictError(RuntimeError):
    """Other writers committed again and again while this one was at work."""


class Versions:
    """Numbered descriptions of what is current at ``path``: each is one small file that appears in one rename, and a number is taken once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_package = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._hadoop(self.path).getFileSystem(self._conf)

    def _hadoop(self, path: str):
        return self._fs_package.Path(path)

    def numbers(self) -> list[int]:
        folder = self._hadoop(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def get(self, number: int) -> dict:
        stream = self._fs.open(self._hadoop(f"{self.path}/versions/{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def put(self, number: int, what: dict) -> bool:
        """Describe version ``number``; False if another writer has taken the number."""
        draft = self._hadoop(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(what).encode()))
        out.close()
        context = self._fs_package.FileContext.getFileContext(draft.toUri(), self._conf)
        rename = getattr(self._fs_package, "Options$Rename")
        options = self.spark._sc._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(draft, self._hadoop(f"{self.path}/versions/{number:012d}.json"), options)
            return True
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise

    def forget(self, number: int) -> None:
        self._fs.delete(self._hadoop(f"{self.path}/versions/{number:012d}.json"), False)

    def folders(self, below: str) -> list[str]:
        at = self._hadoop(f"{self.path}/{below}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def delete(self, below: str) -> None:
        self._fs.delete(self._hadoop(f"{self.path}/{below}"), True)


class SnapshotTable:
    """A table of ``schema`` whose rows are replaced by ``key``: all rows of a key together."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, key: str = "doc_id", buckets: int = 256):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._versions = Versions(spark, self.path)

    # ---- versions ----------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return self._versions.numbers()

    def snapshot(self, version: int | None = None) -> dict:
        """What a version consists of: ``folders`` by bucket, and the last batch of every stream that writes here."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        elif version not in known:
            raise ValueError(f"no version {version} of {self.path}")
        if version == 0:
            return {"version": 0, "folders": {}, "batches": {}, "note": {}}
        return self._versions.get(version)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the current one by default; later changes do not show in the result."""
        return self._rows(self.snapshot(version)["folders"])

    def _rows(self, folders: dict[str, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}/bucket={b}" for b, f in sorted(folders.items())])

    # ---- changes -----------------------------------------------------------------------------------------

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def replace(self, new: DataFrame, keys: DataFrame | None = None, writer: str | None = None, batch: int | None = None, note: dict | None = None) -> int:
        """Put ``new`` in place of all rows of its keys, or of ``keys`` if given: a key without new rows is removed. Returns the version.

        Only the buckets of those keys are read and written. A ``batch`` that ``writer`` has committed before changes nothing. If
        another writer commits first, the change is made again on top of it.
        """
        new = self._conform(new)
        keys = (new if keys is None else keys).select(self.key).distinct()
        for _ in range(ATTEMPTS):
            base = self.snapshot()
            if batch is not None and base["batches"].get(writer, -1) >= batch:
                return base["version"]
            touched = {str(r[0]) for r in keys.select(self.bucket().alias("b")).distinct().collect()}  # at most ``buckets`` numbers
            old = self._rows({b: f for b, f in base["folders"].items() if b in touched})
            kept = old.join(keys, self.key, "left_anti").select(*new.columns)
            rest = {b: f for b, f in base["folders"].items() if b not in touched}
            done = self._commit(base, rest, kept.unionByName(new) if touched else None, writer, batch, note)
            if done is not None:
                return done
        raise ConflictError(f"{ATTEMPTS} other writers came first at {self.path}")

    def overwrite(self, df: DataFrame, note: dict | None = None) -> int:
        """Put ``df`` in place of the whole table. Returns the version."""
        for _ in range(ATTEMPTS):
            done = self._commit(self.snapshot(), {}, self._conform(df), None, None, note)
            if done is not None:
                return done
        raise ConflictError(f"{ATTEMPTS} other writers came first at {self.path}")

    def _conform(self, df: DataFrame) -> DataFrame:
        """Columns and types of the table: a column that is not given is null."""
        have = set(df.columns)
        return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields])

    def _commit(self, base: dict, folders: dict[str, str], rows: DataFrame | None, writer: str | None, batch: int | None, note: dict | None) -> int | None:
        folders = dict(folders)
        if rows is not None:
            name = uuid.uuid4().hex
            folder = f"{self.path}/data/{name}"
            dealt = rows.withColumn("bucket", self.bucket()).repartition("bucket", F.pmod(F.xxhash64(self.key, F.lit(1)), F.lit(SPREAD)))
            dealt.write.partitionBy("bucket").parquet(folder)
            for at in self._versions.folders(f"data/{name}"):
                if at.startswith("bucket="):
                    folders[at.removeprefix("bucket=")] = name
        batches = dict(base["batches"]) | ({writer: batch} if batch is not None else {})
        version = base["version"] + 1
        made = {"version": version, "folders": folders, "batches": batches, "note": base.get("note", {}) | (note or {})}
        return version if self._claim(version, made) else None

    def _claim(self, version: int, made: dict) -> bool:
        return self._versions.put(version, made)

    def expire(self, keep: int = 2) -> Sequence[str]:
        """Forget all but the last ``keep`` versions and delete the folders that none of these names. Returns the deleted folders.

        Readers of forgotten versions and writers at work lose their files: keep as many versions as the longest of them may span.
        """
        known = self.versions()
        keep_from = known[-keep:]
        used = {f for v in keep_from for f in self.snapshot(v)["folders"].values()}
        for v in known[:-keep]:
            self._versions.forget(v)
        gone = [name for name in self._versions.folders("data") if name not in used]
        for name in gone:
            self._versions.delete(f"data/{name}")
        return gone
