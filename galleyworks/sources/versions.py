"""Versions of a table that writers commit by compare and swap, and the link registry upon them."""

from __future__ import annotations

import contextlib
import json
import os
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galleyworks.operators.order import numbered


class Conflict(Exception):
    """Another writer committed the version first, as often as was tried."""


class Versions:
    """Numbered manifests below a path. A version exists once its manifest does, and a manifest is made once, whole, by one writer.

    Data lie in folders of their own names, so writers never touch each other's. What a writer leaves behind that fails
    before its manifest (a data folder, a manifest under a temporary name) is seen by nobody; `vacuum` removes it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm.org.apache.hadoop.fs
        self._hadoop, self._at = jvm, lambda p: jvm.Path(p)
        self.fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[tuple[str, int]]:
        """(name, time of change in ms) of what is in a folder below the path."""
        at = self._at(f"{self.path}/{folder}")
        return [(f.getPath().getName(), f.getModificationTime()) for f in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n, _ in self._names("versions") if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        """The newest version, 0 for none."""
        return max(self.versions(), default=0)

    def manifest(self, version: int) -> dict:
        """What the writer of a version said of it; of version 0, nothing."""
        if not version:
            return {}
        stream = self.fs.open(self._at(f"{self.path}/versions/{version:020d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def commit(self, version: int, manifest: dict) -> bool:
        """Make `version`, unless another writer has: then false. The manifest is written under a temporary name, and gets its own by a step that fails where the name is taken."""
        target, temporary = f"{self.path}/versions/{version:020d}.json", f"{self.path}/versions/{uuid.uuid4().hex}.tmp"
        out = self.fs.create(self._at(temporary), False)
        out.write(json.dumps(manifest).encode())
        out.close()
        try:
            if self.fs.getScheme() == "file":  # a rename would replace the other's; a link does not
                local = lambda p: self._hadoop.Path(p).toUri().getPath()
                os.link(local(temporary), local(target))
            else:
                context = self._hadoop.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
                none = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
                context.rename(self._at(temporary), self._at(target), none)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()):
                raise
            return False
        finally:
            self.fs.delete(self._at(temporary), False)

    def new_folder(self) -> str:
        return f"data/{uuid.uuid4().hex}"

    def remove(self, folder: str) -> None:
        self.fs.delete(self._at(f"{self.path}/{folder}"), True)

    def vacuum(self, keep: int = 10, older: float = 86_400) -> list[str]:
        """Remove the manifests before the newest `keep`, and data folders and temporary files that no manifest left names and that are older than `older` seconds, which must be longer than a write takes; what was removed."""
        old = self.versions()[:-keep]
        left = {f for v in self.versions()[-keep:] for f in self.manifest(v).get("folders", {})}
        before = (time.time() - older) * 1000
        gone = [f"versions/{v:020d}.json" for v in old]
        gone += [f"versions/{n}" for n, t in self._names("versions") if n.endswith(".tmp") and t < before]
        gone += [f"data/{n}" for n, t in self._names("data") if f"data/{n}" not in left and t < before]
        for f in gone:
            self.remove(f)
        return gone


class Registry(Versions):
    """A registry of links (url, created_at, source, ord: its place from 0), to which writers append.

    A manifest has the data folders with their rows, and the last batch of each stream that was added. An addition writes its new links alone; after
    MOST_FOLDERS of them the next one writes all links anew.
    """

    SCHEMA = "url string, created_at string, source string, ord long"
    MOST_FOLDERS = 64

    def read(self, version: int | None = None) -> DataFrame:
        """The links of a version, the newest if none is given."""
        return self._of(self.manifest(self.version() if version is None else version))

    def _of(self, manifest: dict) -> DataFrame:
        folders = [f"{self.path}/{f}" for f in manifest.get("folders", {})]
        return self.spark.read.schema(self.SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], self.SCHEMA)

    def add(self, links: DataFrame, created_at: str, source: str = "submit_page", attempts: int = 3, batch: tuple[str, int] | None = None) -> int:
        """Append those of links (ord, url) that are new, in their order; how many. A conflict begins anew on the then newest version; after `attempts` of them it is a Conflict.

        Urls are trimmed, empty and null ones go, of equal ones the first counts. batch: a stream's name and the number of its batch; one that was added before adds nothing.
        """
        given = links.select(F.trim("url").alias("url"), F.col("ord").cast("long").alias("ord")).filter(F.coalesce("url", F.lit("")) != "").groupBy("url").agg(F.min("ord").alias("ord"))
        for _ in range(attempts):
            version = self.version()
            manifest = self.manifest(version)
            folders, batches = manifest.get("folders", {}), manifest.get("batches", {})
            if batch and batches.get(batch[0], -1) >= batch[1]:
                return 0
            old, total = self._of(manifest), sum(folders.values())
            new = numbered(given.join(old.select("url"), "url", "left_anti"), "ord", "url", name="_nth")
            new = new.select("url", F.lit(created_at).alias("created_at"), F.lit(source).alias("source"), (F.col("_nth") + total).alias("ord"))
            folder = self.new_folder()
            if len(folders) >= self.MOST_FOLDERS:
                new, folders = old.unionByName(new), {}
            new.write.parquet(f"{self.path}/{folder}")
            rows = self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/{folder}").count()
            added = rows + sum(folders.values()) - total
            if not added and not batch:
                self.remove(folder)
                return 0
            told = {"folders": folders | {folder: rows}, "batches": batches | ({batch[0]: batch[1]} if batch else {}), "created_at": created_at}
            if self.commit(version + 1, told):
                return added
            with contextlib.suppress(Py4JJavaError):
                self.remove(folder)
        raise Conflict(f"{self.path}: {attempts} attempts, each time another writer was first")
