"""Tables of contributions by document, replaced by document in one commit.

A store is a folder of Parquet data and of versions.  A version's manifest names,
for each table and each bucket of document ids, the folder that holds its rows.
A commit writes the touched buckets anew (the old rows of other documents and the
new rows) and then publishes the next version by renaming one folder into place:
all tables change together or not at all.  If another writer was first, the
commit is made again on what that writer left.  A reader keeps the version that
it began with, as data are never changed in place; ``expire`` deletes what no kept
version names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Other writers were first, as often as the commit was tried."""


@dataclass
class Store:
    spark: SparkSession
    folder: str
    key: str = "doc_id"
    buckets: int = 16
    tries: int = 10
    _seen: dict[int, dict] = field(default_factory=dict)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, name: str) -> list[str]:
        fs, path = self._files(), self._path(name)
        return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []

    def version(self) -> int:
        """The newest version, 0 for an empty store."""
        return max((int(n[1:]) for n in self._names("versions") if n.startswith("v")), default=0)

    def manifest(self, version: int) -> dict:
        if version == 0:
            return {"tables": {}, "schemas": {}}
        if version not in self._seen:
            stream = self._files().open(self._path(f"versions/v{version:08d}/manifest.json"))
            try:
                self._seen[version] = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        return self._seen[version]

    def _publish(self, version: int, manifest: dict) -> bool:
        """Renames the manifest's folder into place; false if the version is another writer's."""
        fs, mark = self._files(), uuid.uuid4().hex
        made = self._path(f"pending/{mark}")
        fs.mkdirs(made)
        fs.mkdirs(self._path("versions"))
        out = fs.create(self._path(f"pending/{mark}/manifest.json"))
        out.write(bytearray(json.dumps(manifest | {"mark": mark}).encode()))
        out.close()
        final = self._path(f"versions/v{version:08d}")
        won = not fs.exists(final) and fs.rename(made, final)
        # Some file systems move a folder into one that is there already: what counts is whose manifest stands.
        won = won and self.manifest(version)["mark"] == mark
        if not won:
            self._seen.pop(version, None)
            fs.delete(made, True)
        return won

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _rows(self, manifest: dict, name: str, of: list[int] | None = None) -> DataFrame | None:
        held = manifest["tables"].get(name)
        if held is None:
            return None
        schema = StructType.fromJson(manifest["schemas"][name])
        paths = [f"{self.folder}/{p}" for b, p in held.items() if of is None or int(b) in of]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table at a version, the newest if none is given."""
        rows = self._rows(self.manifest(self.version() if version is None else version), name)
        if rows is None:
            raise KeyError(name)
        return rows

    def commit(self, changes: dict[str, DataFrame], ids: DataFrame, expect: int | None = None) -> int:
        """Replaces, in every table of the store, the rows of the documents in ``ids`` by those in ``changes`` (none for a document that is only to go).  Returns the new version.  With ``expect``, raises Conflict unless that is the version before it."""
        ids = ids.select(self.key).distinct()
        touched = sorted(r[0] for r in ids.select(self.bucket().alias("b")).distinct().collect())
        for _ in range(1 if expect is not None else self.tries):
            version = self.version()
            if expect is not None and version != expect:
                raise Conflict(f"version {version}, not {expect}")
            base = self.manifest(version)
            made = {"tables": {n: dict(b) for n, b in base["tables"].items()}, "schemas": dict(base["schemas"])}
            for name in sorted({*made["tables"], *changes}):
                old, new = self._rows(base, name, touched), changes.get(name)
                rows = new if old is None else old.join(ids, self.key, "left_anti").select(*old.columns)
                if old is not None and new is not None:
                    rows = rows.unionByName(new)
                place = f"data/{name}-{uuid.uuid4().hex}"
                spread = rows.withColumn("bucket", self.bucket()).repartition("bucket", F.pmod(F.xxhash64(self.key, F.lit(1)), F.lit(8)))
                spread.write.partitionBy("bucket").parquet(f"{self.folder}/{place}")
                there = {int(n[7:]): f"{place}/{n}" for n in self._names(place) if n.startswith("bucket=")}
                kept = {b: p for b, p in made["tables"].get(name, {}).items() if int(b) not in touched}
                made["tables"][name] = kept | {str(b): p for b, p in there.items()}
                made["schemas"][name] = json.loads(rows.schema.json())
            if self._publish(version + 1, made):
                return version + 1
        raise Conflict(f"other writers were first in {self.folder}")

    @contextmanager
    def staged(self, rows: DataFrame) -> Iterator[DataFrame]:
        """The rows as a table in the store's folder that no version names, deleted at the end."""
        place = f"staged/{uuid.uuid4().hex}"
        try:
            rows.write.parquet(f"{self.folder}/{place}")
            yield self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{place}")
        finally:
            self._files().delete(self._path(place), True)

    def expire(self, keep: int = 2) -> None:
        """Deletes older versions and the data that only they name; no writer may be at work, as what it has written is named by no version yet."""
        fs, newest = self._files(), self.version()
        for name in self._names("versions"):
            if int(name[1:]) <= newest - keep:
                fs.delete(self._path(f"versions/{name}"), True)
        used = {p for v in range(max(1, newest - keep + 1), newest + 1) for b in self.manifest(v)["tables"].values() for p in b.values()}
        for place in self._names("data"):
            for part in self._names(f"data/{place}"):
                if part.startswith("bucket=") and f"data/{place}/{part}" not in used:
                    fs.delete(self._path(f"data/{place}/{part}"), True)
