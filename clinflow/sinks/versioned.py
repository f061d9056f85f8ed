"""A Parquet table in versions: a commit names the folders of every part, so a write that dies leaves the table as it was.

Below the table's path, `data/` holds what writers have written and `commits/` a small JSON file for each version. A
merge rewrites the parts that its changes touch and commits a new version that shares all other folders with the one before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 16
ATTEMPTS = 5


class Conflict(Exception):
    """Another writer has committed this version."""


class VersionedTable:
    """Rows with a unique `key`, spread over `parts` folders by its hash, or by the text of `part`."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], parts: int = PARTS, part: Column | None = None):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.part = F.pmod(F.xxhash64(*key), F.lit(parts)).cast("string") if part is None else part.cast("string")
        self.jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.files = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        folder = self._at("commits")
        if not self.files.exists(folder):
            return []
        names = [status.getPath().getName() for status in self.files.listStatus(folder)]
        return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json") and not name.startswith("."))

    def commit_of(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/commits/{version:010d}.json", wholetext=True).first().value)

    def current(self) -> tuple[int, dict]:
        """The newest version and its commit; version 0 has no rows."""
        versions = self.versions()
        return (versions[-1], self.commit_of(versions[-1])) if versions else (0, {"schema": None, "folders": {}})

    def _rows(self, commit: dict, parts: list[str] | None = None) -> DataFrame | None:
        folders = [folder for part, folder in sorted(commit["folders"].items()) if parts is None or part in parts]
        if not commit["schema"]:
            return None
        schema = self.spark.createDataFrame([], commit["schema"]).schema
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest; later writes don't change what was read."""
        commit = self.current()[1] if version is None else self.commit_of(version)
        rows = self._rows(commit)
        if rows is None:
            raise ValueError(f"{self.path} has no version")
        return rows

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Rows written by part below a new folder: the folder of each part that has rows."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_part", self.part).repartition("_part").write.partitionBy("_part").parquet(f"{self.path}/{folder}")
        names = [status.getPath().getName() for status in self.files.listStatus(self._at(folder))]
        unescaped = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        return {unescaped(name.split("=", 1)[1]): f"{folder}/{name}" for name in names if name.startswith("_part=")}

    def _commit(self, version: int, commit: dict) -> None:
        """Makes the version visible at once, unless another writer has made it."""
        draft, final = self._at(f"commits/.{uuid.uuid4().hex}"), self._at(f"commits/{version:010d}.json")
        out = self.files.create(draft)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        context = self.jvm.FileContext.getFileContext(self.files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self.jvm, "Options$Rename"), 1)
        none[0] = getattr(self.jvm, "Options$Rename").NONE
        try:
            context.rename(draft, final, none)
        except Py4JJavaError as error:
            self.files.delete(draft, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise Conflict(f"version {version} of {self.path}") from error
            raise

    def write(self, rows: DataFrame) -> int:
        """A version with these rows alone."""
        version = self.current()[0] + 1
        self._commit(version, {"schema": rows.schema.simpleString().removeprefix("struct<").removesuffix(">"), "folders": self._write(rows)})
        return version

    def merge(self, changes: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """A version in which the parts that hold keys of `changes` are `combine(rows of the parts, changes)`.

        `combine` must leave the keys of rows in their part, and give the table's columns in any order. If another writer commits first, the merge is
        done again on top of its version. Changes without rows make no version.
        """
        for _ in range(ATTEMPTS):
            version, commit = self.current()
            touched = [row[0] for row in changes.select(self.part.alias("p")).distinct().collect()]
            touched = ["__HIVE_DEFAULT_PARTITION__" if part in (None, "") else part for part in touched]
            if not touched:
                return version
            held = self._rows(commit, touched)
            merged = combine(changes.limit(0) if held is None else held, changes)
            if held is not None:
                merged = merged.select(*held.columns)
            schema = merged.schema.simpleString().removeprefix("struct<").removesuffix(">") if held is None else commit["schema"]
            kept = {part: folder for part, folder in commit["folders"].items() if part not in touched}
            try:
                self._commit(version + 1, {"schema": schema, "folders": kept | self._write(merged)})
            except Conflict:
                continue
            return version + 1
        raise Conflict(f"{self.path} changed {ATTEMPTS} times during a merge")

    def vacuum(self, keep: int = 10) -> int:
        """Deletes the commits before the newest `keep` ones, and the folders that only they name; the number of folders deleted.

        Folders without a commit are left, as a writer may be at work on them.
        """
        versions = self.versions()
        commits = {version: self.commit_of(version) for version in versions}
        held = {folder for version in versions[-keep:] for folder in commits[version]["folders"].values()}
        gone = {folder for version in versions[:-keep] for folder in commits[version]["folders"].values()} - held
        for version in versions[:-keep]:
            self.files.delete(self._at(f"commits/{version:010d}.json"), False)
        for folder in gone:
            self.files.delete(self._at(folder), True)
        return len(gone)
