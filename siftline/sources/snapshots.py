"""A chunk table kept as immutable snapshots with a pointer to the current one, written by one writer at a time."""

from __future__ import annotations

import json
import os
import socket
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.registry import Documents

#: Fixed values, in seconds: age at which an unreadable lock is taken over, and at which one from another host is.
UNREADABLE, LEASE = 10, 3600


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return True


class Locked(FileExistsError):
    """Another writer holds the table."""


class SnapshotTable:
    """folder/<snapshot>/… Parquet, folder/CURRENT.json the pointer; readers never see half a write. The folder may be in any
    file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.documents = spark, folder.rstrip("/"), Documents(spark, folder)

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        found = self.documents.read("CURRENT")
        return found.get("snapshot") if isinstance(found, dict) else None

    def read(self) -> DataFrame:
        if (name := self.current()) is None:
            raise FileNotFoundError(f"no snapshot in {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _abandoned(self) -> bool:
        """Whether the lock's writer is dead: its process is gone, its lock unreadable for a while, or its lease over."""
        path, files = self._path("LOCK")
        if not files.exists(path):
            return True
        age = time.time() - files.getFileStatus(path).getModificationTime() / 1000
        stream = files.open(path)
        try:
            held = json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
        except ValueError:
            held = None
        finally:
            stream.close()
        if not isinstance(held, dict) or "pid" not in held:
            return age > UNREADABLE
        return not _alive(held["pid"]) if held.get("host") == socket.gethostname() else age > LEASE

    def _lock(self) -> None:
        path, files = self._path("LOCK")
        for _ in range(3):
            try:
                stream = files.create(path, False)
            except Exception:  # the file is there
                if not self._abandoned():
                    raise Locked(f"another writer holds {self.folder}") from None
                files.delete(path, False)
                continue
            stream.write(bytearray(json.dumps({"host": socket.gethostname(), "pid": os.getpid(), "at": time.time()}).encode()))
            stream.close()
            return
        raise Locked(f"could not lock {self.folder}")

    def commit(self, rows: DataFrame, partition_by: str | None = None, keep: int = 2) -> str:
        """Write rows as the new snapshot, then move the pointer; a second writer is refused meanwhile, a dead one's lock is
        taken over. The last `keep` snapshots stay, for readers that still hold them."""
        self._lock()
        try:
            name = f"s-{time.time_ns():020d}-{uuid.uuid4().hex}"
            writer = rows.write.option("compression", "zstd")
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{self.folder}/{name}")
            self.documents.write("CURRENT", {"snapshot": name})
            top, files = self._path("")
            old = sorted(s.getPath().getName() for s in files.listStatus(top) if s.getPath().getName().startswith("s-"))
            for gone in old[: max(0, len(old) - keep)]:
                files.delete(self._path(gone)[0], True)
            return name
        finally:
            path, files = self._path("LOCK")
            files.delete(path, False)

    def compact(self, files: int, sort_by: str = "file_path") -> str:
        """Rewrite the current snapshot as so many files, sorted, so that scans by path skip most of them."""
        return self.commit(self.read().repartitionByRange(files, sort_by).sortWithinPartitions(sort_by))
