"""Tables that outlive a run: Parquet in buckets of a key's hash, changed by publishing versions.

A version is a small file that lists, for each bucket, the folders that hold its rows. Writers put
new folders beside the old ones and then publish the next version in one step, so readers see
either the old table or the new one, and a writer that dies leaves nothing but unused folders. A
version is published only if no other writer took its number: appends then try again on top of
it, other changes raise. A change rewrites only the buckets that hold its keys; the folders of all
others keep their names. What was written under a stream's name carries its batch number, so a
batch that is repeated changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .stages import discard, written


class Conflict(RuntimeError):
    """Another writer published a version first."""


@dataclass
class Version:
    number: int = 0
    #: Folders of each bucket, oldest first.
    folders: dict[str, list[str]] = field(default_factory=dict)
    #: The last batch of every stream that writes here.
    batches: dict[str, int] = field(default_factory=dict)

    def has(self, batch: tuple[str, int] | None) -> bool:
        return batch is not None and self.batches.get(batch[0], -1) >= batch[1]

    def next(self, folders: dict[str, list[str]], batch: tuple[str, int] | None) -> Version:
        return Version(self.number + 1, folders, self.batches | ({batch[0]: batch[1]} if batch else {}))


class StoredTable:
    """Rows of a schema at a path, in buckets by key. The number of buckets is that of the first version's writer."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, list(key), buckets

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self) -> Version:
        at, fs = self._fs(f"{self.path}/versions")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        numbers = [int(n) for n in names if n.isdigit()]
        if not numbers:
            return Version()
        text = self.spark.read.text(f"{self.path}/versions/{max(numbers):09d}", wholetext=True).first()[0]
        held = json.loads(text)
        if held["buckets"] != self.buckets:
            raise ValueError(f"the table at {self.path} has {held['buckets']} buckets, not {self.buckets}")
        return Version(max(numbers), held["folders"], held["batches"])

    def _publish(self, version: Version) -> None:
        text = json.dumps({"buckets": self.buckets, "folders": version.folders, "batches": version.batches})
        draft, fs = self._fs(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at, _ = self._fs(f"{self.path}/versions/{version.number:09d}")
        fs.mkdirs(at.getParent())
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(fs.makeQualified(draft), fs.makeQualified(at), none)  # fails where the number is taken
        except Exception as e:
            fs.delete(draft, False)
            raise Conflict(f"version {version.number} of {self.path} exists") from e

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        shaped = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        return shaped.withColumn("_bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def _write(self, bucketed: DataFrame) -> dict[str, str]:
        """Rows with their buckets as files of a new folder; the folder of each bucket."""
        out = f"data/{uuid.uuid4().hex}"
        # Rows of one bucket lie together, those of a large one in several tasks.
        bucketed.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{out}")
        at, fs = self._fs(f"{self.path}/{out}")
        names = [f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()]
        return {n.partition("=")[2]: f"{out}/{n}" for n in names if n.startswith("_bucket=")}

    def _rows(self, folders: Sequence[str]) -> DataFrame:
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, version: Version | None = None) -> DataFrame:
        """All rows of the newest version, or of one that current gave."""
        v = version or self.current()
        return self._rows([f for own in v.folders.values() for f in own])

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """More rows, beside those of their keys that are there. batch: a stream's name and the number of its batch."""
        if self.current().has(batch):
            return
        new = self._write(self._bucketed(rows))
        while True:
            v = self.current()
            if v.has(batch):
                return
            try:
                return self._publish(v.next({b: [*v.folders.get(b, []), *([new[b]] if b in new else [])] for b in {*v.folders, *new}}, batch))
            except Conflict:
                continue

    def _replace(self, v: Version, buckets: Sequence[str], rows: DataFrame, batch: tuple[str, int] | None) -> None:
        new = self._write(self._bucketed(rows))
        kept = {b: own for b, own in v.folders.items() if b not in buckets}
        self._publish(v.next(kept | {b: [f] for b, f in new.items()}, batch))

    def merge(self, changes: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame], batch: tuple[str, int] | None = None) -> None:
        """Rewrite the buckets that hold keys of changes: fold(their rows, changes) gives their rows from now on."""
        v = self.current()
        if v.has(batch):
            return
        held = written(self._bucketed(changes), "store-changes")
        touched = [str(r["_bucket"]) for r in held.select("_bucket").distinct().collect()]  # at most as many as buckets
        old = self._rows([f for b in touched for f in v.folders.get(b, [])])
        self._replace(v, touched, fold(old, held.drop("_bucket")), batch)
        discard(held)

    def compact(self, fold: Callable[[DataFrame], DataFrame]) -> None:
        """Rewrite every bucket by fold, which keeps, drops or combines rows of one key."""
        v = self.current()
        self._replace(v, list(v.folders), fold(self.read(v)), None)

    def vacuum(self, keep: int = 2) -> None:
        """Delete versions before the last ``keep``, and folders that only those name. Not while writers are at work."""
        at, fs = self._fs(f"{self.path}/versions")
        numbers = sorted(int(f.getPath().getName()) for f in fs.listStatus(at)) if fs.exists(at) else []
        used: set[str] = set()
        for n in numbers[-keep:]:
            held = json.loads(self.spark.read.text(f"{self.path}/versions/{n:09d}", wholetext=True).first()[0])
            used |= {f.split("/")[1] for own in held["folders"].values() for f in own}
        for n in numbers[:-keep]:
            fs.delete(self._fs(f"{self.path}/versions/{n:09d}")[0], False)
        data, _ = self._fs(f"{self.path}/data")
        for f in fs.listStatus(data) if fs.exists(data) else []:
            if f.getPath().getName() not in used:
                fs.delete(f.getPath(), True)
