"""A lease on a folder: one holder at a time, by files that can be created once only."""

from __future__ import annotations

import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Fixed: a lease that wasn't renewed for so long is no longer held.
HOURS = 12


class LeaseHeldError(RuntimeError):
    """Somebody else holds the lease, or has taken it over."""


class Lease:
    """The lease of ``owner`` on ``folder``, in any file system whose creation of a file fails where it exists (HDFS, local disks).

    The n-th holder's file is ``_lease-n``. Where the last one has been given back or is too old, whoever creates the next has the
    lease: of several that try, the file system lets one. Its number only rises, so a holder that was replaced finds a larger one
    and stops. An owner that comes back, after a crash, takes its own lease over.
    """

    def __init__(self, spark: SparkSession, folder: str, owner: str, hours: float = HOURS):
        self.jvm, self.owner, self.hours, self.number = spark._jvm, owner, hours, None
        self.folder = self.jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, number: int, end: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(self.folder, f"_lease-{number:08d}{end}")

    def _last(self) -> int:
        names = [s.getPath().getName() for s in self.fs.listStatus(self.folder)] if self.fs.exists(self.folder) else []
        return max((int(n[7:15]) for n in names if n.startswith("_lease-")), default=0)

    def _create(self, path, text: str) -> bool:
        try:
            out = self.fs.create(path, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName() or self.fs.exists(path):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _read(self, path) -> str:
        data = self.fs.open(path)
        text = self.jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8")
        data.close()
        return text

    def acquire(self) -> Lease:
        self.fs.mkdirs(self.folder)
        last = self._last()
        if last and not self.fs.exists(self._path(last, ".free")):
            age = time.time() - self.fs.getFileStatus(self._path(last)).getModificationTime() / 1000
            if age < self.hours * 3600 and self._read(self._path(last)) != self.owner:
                raise LeaseHeldError(f"{self.folder} is held by {self._read(self._path(last)) or 'a new holder'}")
        if not self._create(self._path(last + 1), self.owner):
            raise LeaseHeldError(f"{self.folder} was taken at the same time")
        self.number = last + 1
        for old in range(max(1, last - 2), last):  # the last ones stay
            for end in ("", ".free"):
                self.fs.delete(self._path(old, end), False)
        return self

    def renew(self) -> None:
        """Make the lease young again; an error where it was taken over."""
        if self.number is None or self._last() != self.number:
            raise LeaseHeldError(f"{self.folder} was taken over")
        now = int(time.time() * 1000)
        self.fs.setTimes(self._path(self.number), now, -1)

    def release(self) -> None:
        if self.number is not None:
            self._create(self._path(self.number, ".free"), "")
            self.number = None
