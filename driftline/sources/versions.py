"""A table in folders by id prefix with versions: a writer never touches files that a reader may be reading.

A version is a manifest: which data folder holds each prefix. An upsert writes new folders for the prefixes it touches, then
a manifest that names them beside the untouched folders of the version before, and moves it to its numbered place in one
rename that fails if the number is taken. The highest number is the current version, and there is no other pointer. A writer
that dies before the rename leaves folders that no manifest names; one that is overtaken is told so and can begin again from
the newer version. Manifests and the list of versions are bounded by the number of prefixes and of upserts.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.operators.clean import insert_ignore, upsert


class Overtaken(RuntimeError):
    """Another writer made this version first."""


@dataclass(frozen=True)
class VersionedTable:
    spark: SparkSession
    path: str
    prefix_col: str = "hex_prefix"

    # ---- manifests ----

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        fs, folder = self._fs(), self._path("_versions")
        if not fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json") and not s.getPath().getName().startswith((".", "_")))

    def manifest(self, version: int) -> dict:
        text = self.spark.read.text(f"{self.path}/_versions/{version:012d}.json", wholetext=True)
        return json.loads(text.first()[0])

    def _swap(self, version: int, manifest: dict) -> None:
        """Make ``manifest`` the given version, whole or not at all."""
        fs, jvm = self._fs(), self.spark._jvm
        beside = self._path(f"_versions/.{uuid.uuid4().hex}")
        out = fs.create(beside)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        never_replace = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never_replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            files.rename(beside, self._path(f"_versions/{version:012d}.json"), never_replace)
        except Py4JJavaError as e:
            fs.delete(beside, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Overtaken(f"version {version} of {self.path} is there already") from None
            raise

    # ---- reading ----

    def read(self, version: int | None = None) -> DataFrame:
        """The table at a version, the current one if none is named; other versions' files are not listed."""
        known = self.versions()
        if not known:
            raise ValueError(f"{self.path} has no version")
        m = self.manifest(known[-1] if version is None else version)
        schema = T.StructType.fromJson(m["schema"])
        if not m["folders"]:
            return self.spark.createDataFrame([], schema)
        parts = [f"{self.path}/data/{folder}/{self.prefix_col}={p}" for p, folder in sorted(m["folders"].items())]
        read = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("_write", T.StringType())]))
        return read.option("basePath", f"{self.path}/data").parquet(*parts).select(*schema.names)

    # ---- writing ----

    def _write(self, rows: DataFrame, keys: list[str]) -> dict[str, str]:
        """Write rows below a new data folder; returns where each prefix is."""
        folder = f"_write={uuid.uuid4().hex}"
        (rows.repartitionByRange(self.prefix_col, *keys).sortWithinPartitions(self.prefix_col, *keys)
         .write.partitionBy(self.prefix_col).parquet(f"{self.path}/data/{folder}"))
        made = [s.getPath().getName() for s in self._fs().listStatus(self._path(f"data/{folder}")) if s.isDirectory()]
        return {name.split("=", 1)[1]: folder for name in made}

    def create(self, rows: DataFrame, keys: list[str]) -> int:
        columns = [c for c in rows.columns if c != self.prefix_col] + [self.prefix_col]
        rows = rows.select(*columns)
        self._swap(0, {"schema": rows.schema.jsonValue(), "folders": self._write(rows, keys), "before": None})
        return 0

    def _merge(self, incoming: DataFrame, keys: list[str], merge, swap: bool) -> int:
        before = self.versions()[-1]
        m = self.manifest(before)
        schema = T.StructType.fromJson(m["schema"])
        incoming = incoming.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        touched = [r[0] for r in incoming.select(self.prefix_col).distinct().collect()]  # at most one a folder
        old = self.read(before).where(F.col(self.prefix_col).isin(touched))
        folders = self._write(merge(old, incoming), [self.prefix_col, *keys])
        if swap:
            self._swap(before + 1, {"schema": m["schema"], "folders": {**m["folders"], **folders}, "before": before})
        return before + 1

    def upsert(self, incoming: DataFrame, keys: list[str], order: list[str], swap: bool = True) -> int:
        """Incoming rows replace stored ones of the same key, the last one in ``order`` wins; returns the new version.

        Without ``swap`` it ends as a writer that dies just before the swap does.
        """
        return self._merge(incoming, keys, lambda old, new: upsert(old, new, keys, order), swap)

    def insert(self, incoming: DataFrame, keys: list[str], order: list[str], swap: bool = True) -> int:
        """Incoming rows enter where their key is new, the first one in ``order``; returns the new version."""
        return self._merge(incoming, keys, lambda old, new: insert_ignore(old, new, keys, order), swap)
