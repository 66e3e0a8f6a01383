"""Keyed tables on disk that are changed in place of their keys, bucket by bucket.

A table is `buckets` folders by a hash of the key. A change writes the touched buckets anew into folders of its own
version and then a manifest that names, for every bucket, its folder, its number of rows and a checksum of them.
Readers take the newest manifest, so they see a change whole or not at all: what was written without its manifest is
never read. Folders are never written twice. A change carries a number that grows (of a micro-batch, say); one that
has been applied is not applied again.

A bucket is damaged if a file of it can't be read or its rows don't sum up to the manifest's. Damaged buckets are found
by one pass over the table and rebuilt alone, from rows that the caller makes for their keys.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "__bucket"


def _only_unreadable(error: Exception) -> None:
    """Raise the error unless it says that a file can't be read or is gone."""
    if not any(x in str(error) for x in ("FAILED_READ_FILE", "PATH_NOT_FOUND")):
        raise error


@dataclass
class KeyedTable:
    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    buckets: int = 64

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), where

    def manifest(self) -> dict:
        """version, applied (number of the last change), buckets: folder, rows and checksum by bucket."""
        fs, where = self._fs(f"{self.path}/_manifests")
        names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]
        if not numbers:
            return {"version": 0, "applied": -1, "buckets": {}}
        text = self.spark.read.text(f"{self.path}/_manifests/{max(numbers):012d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _flip(self, manifest: dict) -> None:
        """The manifest appears by one rename."""
        fs, draft = self._fs(f"{self.path}/_drafts/{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        final = self._fs(f"{self.path}/_manifests/{manifest['version']:012d}.json")[1]
        fs.mkdirs(final.getParent())
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"another writer has made version {manifest['version']} of {self.path}")

    def _folders(self, manifest: dict, only: list[int] | None = None) -> list[str]:
        return sorted(b["folder"] for k, b in manifest["buckets"].items() if only is None or int(k) in only)

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self) -> DataFrame:
        return self._rows(self._folders(self.manifest()))

    def checksum(self) -> Column:
        """Of a group of rows, in any order."""
        return F.sum(F.xxhash64(*[c.split(" ")[0] for c in self._columns()]).cast("decimal(38,0)")).cast("string")

    def _columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def _write(self, rows: DataFrame, touched: list[int], manifest: dict, number: int) -> None:
        """rows take the place of the touched buckets."""
        version = manifest["version"] + 1
        folder = f"v{version:012d}-{uuid.uuid4().hex[:8]}"
        columns = self._columns()
        bucketed = rows.select(*columns, self.bucket_of().alias(BUCKET))
        bucketed.repartition(min(self.buckets, max(1, len(touched))), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        counted = {}
        if len(self._files(folder)):
            written = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/{folder}").parquet(f"{self.path}/{folder}")
            sums = written.groupBy(self.bucket_of().alias(BUCKET)).agg(F.count(F.lit(1)).alias("rows"), self.checksum().alias("sum"))
            counted = {r[BUCKET]: r for r in sums.collect()}  # a row a bucket
        after = {k: v for k, v in manifest["buckets"].items() if int(k) not in touched}
        after |= {str(k): {"folder": f"{folder}/{BUCKET}={k}", "rows": r["rows"], "sum": r["sum"]} for k, r in counted.items()}
        self._flip({"version": version, "applied": number, "buckets": after})

    def _files(self, folder: str) -> list[str]:
        fs, where = self._fs(f"{self.path}/{folder}")
        return [f.getPath().getName() for f in fs.listStatus(where) if f.getPath().getName().startswith(BUCKET)]

    def upsert(self, changes: DataFrame, number: int | None = None, delete: Column | None = None) -> bool:
        """Rows of changes (one a key) take the place of those of their keys; where `delete` holds the key goes. Only
        touched buckets are read and written. False if the change of this number was there already."""
        manifest = self.manifest()
        if number is not None and number <= manifest["applied"]:
            return False
        number = manifest["applied"] + 1 if number is None else number
        keyed = changes.withColumn(BUCKET, self.bucket_of())
        touched = sorted(r[0] for r in keyed.select(BUCKET).distinct().collect())  # `buckets` at most
        if not touched:
            return True
        old = self._rows(self._folders(manifest, touched))
        kept = old.join(changes.select(*self.keys), list(self.keys), "left_anti")
        new = changes if delete is None else changes.filter(~F.coalesce(delete, F.lit(False)))
        self._write(kept.select(*self._columns()).unionByName(new.select(*self._columns())), touched, manifest, number)
        return True

    def damaged(self) -> list[int]:
        """Buckets whose files can't be read or whose rows aren't the manifest's."""
        manifest = self.manifest()
        try:
            return self._unlike(manifest, sorted(map(int, manifest["buckets"])))
        except (PySparkException, Py4JJavaError) as error:
            _only_unreadable(error)  # each bucket by itself then
            return [k for k in sorted(map(int, manifest["buckets"])) if self._broken(manifest, k)]

    def _broken(self, manifest: dict, bucket: int) -> bool:
        try:
            return bool(self._unlike(manifest, [bucket]))
        except (PySparkException, Py4JJavaError) as error:
            _only_unreadable(error)
            return True

    def _unlike(self, manifest: dict, buckets: list[int]) -> list[int]:
        rows = self._rows(self._folders(manifest, buckets))
        sums = {r[BUCKET]: (r["rows"], r["sum"]) for r in rows.groupBy(self.bucket_of().alias(BUCKET)).agg(F.count(F.lit(1)).alias("rows"), self.checksum().alias("sum")).collect()}
        return [k for k in buckets if sums.get(k) != (manifest["buckets"][str(k)]["rows"], manifest["buckets"][str(k)]["sum"])]

    def rebuild(self, made: Callable[[list[int]], DataFrame]) -> list[int]:
        """Damaged buckets are left aside and written anew from `made(buckets)`, all rows of these buckets."""
        bad = self.damaged()
        if bad:
            manifest = self.manifest()
            rows = made(bad)
            self._write(rows.filter(self.bucket_of().isin(bad)), bad, manifest, manifest["applied"])
        return bad
