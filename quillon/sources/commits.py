"""Several tables under one commit: write, audit, publish.

Tables are written to folders that no reader looks at; the audit reads them there;
one manifest, which names the folders of all tables, is renamed into place. Readers
take the tables of the newest manifest, so they see all of a commit or nothing of
it. A manifest's number can be taken once only: of two writers that began on the
same manifest one is refused. A commit with a key that a manifest on the way has
already is passed over, so a batch that is run again after a crash changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


class AuditError(ValueError):
    pass


class CommitError(RuntimeError):
    pass


class Tables:
    """Tables below ``root`` as their manifests name them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest manifest's number, 0 for none."""
        at = self._path(f"{self.root}/manifests")
        if not self._fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return max([int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()], default=0)

    def manifest(self, version: int | None = None) -> dict:
        """tables (name: folders) and keys (of the commits on the way)."""
        n = self.version() if version is None else version
        if not n:
            return {"version": 0, "tables": {}, "keys": []}
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.root}/manifests/{n:010d}.json").collect()))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A published table."""
        folders = self.manifest(version)["tables"].get(table)
        if not folders:
            raise CommitError(f"no table {table} is published")
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in folders])

    def commit(self, tables: dict[str, DataFrame], audit: Callable[[dict[str, DataFrame]], str | None] | None = None, key: str | None = None, replace: bool = False) -> int:
        """Adds rows to every one of ``tables`` (or replaces them) under one
        manifest, whose number is returned. ``audit`` sees what was written; what
        it says against it is raised, and nothing is published."""
        before = self.manifest()
        if key is not None and key in before["keys"]:
            return before["version"]
        own = uuid.uuid4().hex
        staged = {name: f"data/{name}/{own}" for name in tables}
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{staged[name]}")
        if audit is not None:
            said = audit({name: self.spark.read.parquet(f"{self.root}/{at}") for name, at in staged.items()})
            if said:
                raise AuditError(said)
        after = {name: ([] if replace and name in staged else list(at)) for name, at in before["tables"].items()}
        for name, at in staged.items():
            after.setdefault(name, []).append(at)
        return self._publish(before["version"] + 1, {"version": before["version"] + 1, "tables": after, "keys": [*before["keys"], *([key] if key is not None else [])]})

    def _publish(self, n: int, manifest: dict) -> int:
        held = self._path(f"{self.root}/staged/{uuid.uuid4().hex}.json")
        out = self._fs.create(held, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode("utf-8")))
        out.close()
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        to = self._path(f"{self.root}/manifests/{n:010d}.json")
        if self._fs.exists(to) or not self._fs.rename(held, to):
            self._fs.delete(held, False)
            raise CommitError(f"manifest {n} was taken meanwhile")
        return n

    def clean(self) -> int:
        """Deletes folders that no manifest names; only when no commit is on its way."""
        named = {at for n in range(1, self.version() + 1) for own in self.manifest(n)["tables"].values() for at in own}
        gone = 0
        for name in self._folders("data"):
            for own in self._folders(f"data/{name}"):
                if f"data/{name}/{own}" not in named:
                    gone += self._fs.delete(self._path(f"{self.root}/data/{name}/{own}"), True)
        return gone

    def _folders(self, at: str) -> list[str]:
        path = self._path(f"{self.root}/{at}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []


def same_keys(key: str) -> Callable[[dict[str, DataFrame]], str | None]:
    """An audit: every table speaks of the same keys."""

    def audit(tables: dict[str, DataFrame]) -> str | None:
        marked = [df.select(key).distinct() for df in tables.values()]
        union = reduce(DataFrame.unionByName, marked)
        odd = union.groupBy(key).count().where(f"count < {len(tables)}").count()
        return f"{odd} keys are not in every table" if odd else None

    return audit


def commit_batches(tables: Tables, split: Callable[[DataFrame], dict[str, DataFrame]], audit=None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the tables of a batch under one commit, once."""

    def put(df: DataFrame, number: int) -> None:
        tables.commit(split(df), audit, key=f"batch-{number}")

    return put
