"""Tables with a key that are upserted by epoch, kept as versions.

A table set is a folder of Parquet parts and of manifests. Rows lie in buckets by
the hash of their key. An epoch writes only its own rows, as one more part of the
buckets it touches; the manifest of the new version names the parts of every bucket
and the epochs already taken in, and becomes visible by one rename. So several
tables change together, a reader sees whole versions only, and an epoch that is
replayed changes nothing. Reading takes the newest row of each key; a bucket with
many parts is rewritten as one. ``vacuum`` deletes parts that no kept version names.

One writer at a time, as one streaming query is. A manifest has one entry per
bucket and part, whatever the number of rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION, BUCKET = "_version", "_bucket"
EMPTY = {"version": 0, "epochs": {}, "tables": {}}


class KeyedTables:
    def __init__(self, spark: SparkSession, path: str, keys: Mapping[str, Sequence[str]], *,
                 buckets: int = 16, max_parts: int = 8):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), {t: list(k) for t, k in keys.items()}
        self.buckets, self.max_parts = buckets, max_parts
        self._jpath = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- manifests -----------------------------------------------------------------

    def _names(self, folder: str) -> list[str]:
        where = self._jpath(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or that of a version that is still kept."""
        kept = self.versions()
        if version is None:
            if not kept:
                return EMPTY
            version = kept[-1]
        if version not in kept:
            raise ValueError(f"version {version} is not kept; kept are {kept}")
        stream = self._fs.open(self._jpath(f"{self.path}/manifests/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        draft = self._jpath(f"{self.path}/manifests/{uuid.uuid4().hex}.draft")
        final = self._jpath(f"{self.path}/manifests/{manifest['version']:012d}.json")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest), "utf-8"))
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"version {manifest['version']} was written by someone else")

    # ---- writing -------------------------------------------------------------------

    def upsert(self, epoch: int, stream: str = "stream", **rows: DataFrame) -> int:
        """Take in one epoch's rows, at most one per key and table; returns the version that holds them.

        An epoch of this stream that was taken in before is left out.
        """
        now = self.manifest()
        if now["epochs"].get(stream, -1) >= epoch:
            return now["version"]
        following = {"version": now["version"] + 1, "epochs": {**now["epochs"], stream: epoch}, "tables": dict(now["tables"])}
        for name, df in rows.items():
            old = following["tables"].get(name, {"schema": df.schema.jsonValue(), "parts": {}})
            if old["schema"] != df.schema.jsonValue():
                raise ValueError(f"columns of {name} differ from those of earlier epochs")
            parts = {b: list(p) for b, p in old["parts"].items()}
            for b, folder in self._write(name, df, following["version"]).items():
                parts.setdefault(b, []).append(folder)
            full = [b for b, p in parts.items() if len(p) > self.max_parts]
            if full:
                merged = self._newest(name, {"schema": old["schema"], "parts": {b: parts[b] for b in full}})
                for b in full:
                    parts[b] = []
                for b, folder in self._write(name, merged, following["version"]).items():
                    parts[b] = [folder]
            following["tables"][name] = {"schema": old["schema"], "parts": parts}
        self._publish(following)
        return following["version"]

    def _write(self, name: str, df: DataFrame, version: int) -> dict[str, str]:
        folder = f"parts/{name}-{version:012d}-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(*self.keys[name]), F.lit(self.buckets)).cast("int")
        (df.withColumns({VERSION: F.lit(version).cast("long"), BUCKET: bucket}).repartition(F.col(BUCKET))
         .write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}"))
        found = [n for n in self._names(folder) if n.startswith(f"{BUCKET}=")]
        return {n.split("=")[1]: f"{folder}/{n}" for n in found}

    # ---- reading -------------------------------------------------------------------

    def _rows(self, schema: T.StructType, folders: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(T.StructType([*schema.fields, T.StructField(VERSION, T.LongType())])).parquet(
            *[f"{self.path}/{f}" for f in folders])

    def _newest(self, name: str, table: dict) -> DataFrame:
        schema = T.StructType.fromJson(table["schema"])
        single = [p[0] for p in table["parts"].values() if len(p) == 1]
        several = [f for p in table["parts"].values() if len(p) > 1 for f in p]
        found = []
        if single:
            found.append(self._rows(schema, single).drop(VERSION))
        if several:
            key = self.keys[name]
            rest = [c for c in schema.names if c not in key]
            found.append(self._rows(schema, several).groupBy(*key).agg(
                F.max_by(F.struct(F.lit(0).alias("_"), *rest), VERSION).alias("r")).select(
                *[F.col(c) if c in key else F.col(f"r.{c}") for c in schema.names]))
        if not found:
            return self.spark.createDataFrame([], schema)
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The newest row of every key, as of the newest or a named version."""
        return self._newest(name, self.manifest(version)["tables"][name])

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the newest ``keep`` versions and the parts that none of these names."""
        kept = self.versions()[-keep:]
        if not kept:
            return
        named = {f.split("/")[1] for v in kept for t in self.manifest(v)["tables"].values() for p in t["parts"].values() for f in p}
        for folder in self._names("parts"):
            if folder not in named:
                self._fs.delete(self._jpath(f"{self.path}/parts/{folder}"), True)
        for n in self._names("manifests"):
            if n.endswith(".draft") or int(n.removesuffix(".json")) not in kept:
                self._fs.delete(self._jpath(f"{self.path}/manifests/{n}"), False)
