"""Atomic commits without a table format: write a generation's folder, then publish its manifest under a new name.

Readers follow the highest manifest alone, so a writer that dies leaves folders that nobody reads. A commit carries an
identity; committing the last one again changes nothing. Identities that are to be known for good (``lasting``) are kept
in the manifest, beside the folders, with the generation that they made.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Store:
    """Tables of one folder in any store that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        at = self._path(f"{self.root}/manifests")
        if not self.fs.exists(at):
            return []
        return sorted(int(f.getPath().getName()) for f in self.fs.listStatus(at) if f.getPath().getName().isdigit())

    def manifest(self) -> dict:
        """The last published one: generation, identity, and the folders of each table."""
        found = self._manifests()
        if not found:
            return {"generation": 0, "identity": None, "tables": {}, "meta": {}, "identities": {}}
        stream = self.fs.open(self._path(f"{self.root}/manifests/{found[-1]:020d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def generation_of(self, identity: str) -> int | None:
        """The generation that a lasting identity made, at any time; None if it wasn't committed."""
        return self.manifest().get("identities", {}).get(identity)

    def read(self, name: str, schema: T.StructType, generation: int | None = None) -> DataFrame:
        """All committed rows of a table, or those of one generation; none before its first commit."""
        folders = [f"{self.root}/{x}" for x in self.manifest()["tables"].get(name, []) if generation is None or x.endswith(f"-{generation:012d}")]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def commit(self, identity: str, append: dict[str, DataFrame], replace: dict[str, DataFrame] | None = None, meta: dict | None = None, lasting: bool = False) -> bool:
        """Add and replace rows of tables, and small metadata, at once; False if ``identity`` is the last commit's, or a
        lasting one that was committed before."""
        now = self.manifest()
        if now["identity"] == identity or lasting and identity in now.get("identities", {}):
            return False
        n, tables = now["generation"] + 1, {k: list(v) for k, v in now["tables"].items()}
        for name, df in {**append, **(replace or {})}.items():
            folder = f"{name}/generation-{n:012d}"
            df.write.mode("overwrite").parquet(f"{self.root}/{folder}")
            tables[name] = [folder] if name in (replace or {}) else [*tables.get(name, []), folder]
        draft, final = self._path(f"{self.root}/drafts/{n:020d}"), self._path(f"{self.root}/manifests/{n:020d}")
        self.fs.mkdirs(final.getParent())
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps({"generation": n, "identity": identity, "tables": tables, "meta": now.get("meta", {}) | (meta or {}), "identities": now.get("identities", {}) | ({identity: n} if lasting else {})}).encode()))
        out.close()
        if not self.fs.rename(draft, final):
            raise RuntimeError(f"generation {n} was published by another writer")
        return True

    def orphans(self) -> list[str]:
        """Folders of generations that the last manifest doesn't name."""
        kept, found = {x for v in self.manifest()["tables"].values() for x in v}, []
        for table in self.fs.listStatus(self._path(self.root)) if self.fs.exists(self._path(self.root)) else []:
            name = table.getPath().getName()
            if name not in ("manifests", "drafts"):
                found += [f"{name}/{x.getPath().getName()}" for x in self.fs.listStatus(table.getPath())]
        return sorted(x for x in found if x not in kept)
