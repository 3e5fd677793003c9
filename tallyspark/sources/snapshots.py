"""A store kept as snapshots: data in folders that are never changed, and numbered manifests that name them.

A writer puts its rows into a new folder and then commits a manifest, a small file that
appears under its number at once or not at all; readers take the highest number. So a
failed write leaves the old snapshot as it was, a reader of an older one isn't disturbed,
and going back is one more manifest. Two writers of one number: the second fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> dict[int, str]:
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return {}
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return {int(n[:-5]): n for n in names if n.endswith(".json") and n[:-5].isdigit()}

    def manifest(self, number: int | None = None) -> dict:
        """What a snapshot holds: its number, its folders, and what made it; the latest one by default."""
        found = self._manifests()
        number = max(found, default=0) if number is None else number
        if number not in found:
            if number == 0:
                return {"number": 0, "parts": [], "made_by": "nothing"}
            raise ValueError(f"no snapshot {number}")
        (row,) = self.spark.read.text(f"{self.path}/manifests/{found[number]}", wholetext=True).collect()
        return json.loads(row.value)

    def _commit(self, parts: list[str], made_by: str, after: int) -> int:
        name = self._path(f"{self.path}/manifests/{after + 1:010}.json")
        draft = self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"number": after + 1, "parts": parts, "made_by": made_by}).encode()))
        out.close()
        if self._fs.exists(name) or not self._fs.rename(draft, name):
            self._fs.delete(draft, False)
            raise RuntimeError(f"snapshot {after + 1} was made by another writer")
        return after + 1

    def _written(self, rows: DataFrame) -> str:
        part = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{part}")
        return part

    def read(self, number: int | None = None) -> DataFrame | None:
        """A snapshot's rows; None while the store is empty."""
        parts = self.manifest(number)["parts"]
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/{p}" for p in parts]) if parts else None

    def append(self, rows: DataFrame) -> int:
        """Adds rows; returns the new snapshot's number."""
        now = self.manifest()
        return self._commit([*now["parts"], self._written(rows)], "append", now["number"])

    def append_new(self, rows: DataFrame, key: str = "id") -> int:
        """Adds the rows whose key the latest snapshot doesn't have, one a key."""
        held = self.read()
        fresh = rows.dropDuplicates([key])
        return self.append(fresh if held is None else fresh.join(held.select(key), key, "left_anti"))

    def rewrite(self, change) -> int:
        """Replaces all rows by what ``change`` makes of them."""
        now = self.manifest()
        held = self.read()
        return self._commit([self._written(change(held))] if held is not None else [], "rewrite", now["number"])

    def roll_back(self, to: int) -> int:
        """The store as it was at snapshot ``to``, as a new snapshot; no rows are copied."""
        return self._commit(self.manifest(to)["parts"], f"roll back to {to}", self.manifest()["number"])

    def history(self) -> DataFrame:
        """(number, made_by, n_parts) of all snapshots."""
        made = [self.manifest(k) for k in sorted(self._manifests())]
        rows = [F.struct(F.lit(m["number"]).alias("number"), F.lit(m["made_by"]).alias("made_by"), F.lit(len(m["parts"])).alias("n_parts")) for m in made]
        kind = "array<struct<number: int, made_by: string, n_parts: int>>"
        return self.spark.range(1).select(F.inline(F.array(*rows).cast(kind)))

    def vacuum(self, keep: int = 1) -> int:
        """Forgets all but the ``keep`` latest snapshots and removes the folders that none of these names; returns how many folders went."""
        found = self._manifests()
        stay = sorted(found)[-max(keep, 1) :]
        used = {p for k in stay for p in self.manifest(k)["parts"]}
        for k in found.keys() - set(stay):
            self._fs.delete(self._path(f"{self.path}/manifests/{found[k]}"), False)
        folder = self._path(f"{self.path}/data")
        parts = [f"data/{s.getPath().getName()}" for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        for p in set(parts) - used:
            self._fs.delete(self._path(f"{self.path}/{p}"), True)
        return len(set(parts) - used)
