"""Bridges: what a broker sends becomes Parquet files in a shared folder.

A stream reads the folder, so its plan is distributed and a lost executor, driver or query
reads the same rows again. A message is confirmed to its sender only once its file is
in place; where the protocol can repeat (MQTT with QoS 1, posts), none is lost.
A file holds what came within `linger` seconds: topic, value, and place, which grows with
every message of a folder.
"""

from __future__ import annotations

import hashlib
import logging
import threading
import time
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession

from brookql.functions.values import CompileError
from brookql.sources.brokers import receiver

LOG = logging.getLogger("brookql.bridge")
SCHEMA = "topic string, value binary, place bigint"
#: Running bridges by folder.
_RUNNING: dict[str, "Bridge"] = {}


class Folder:
    """Writes files of messages through Spark's file systems: first hidden, then renamed."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(self.path))
        self.place = 0

    def _path(self, text: str):
        return self.jvm.org.apache.hadoop.fs.Path(text)

    def write(self, messages: list[tuple[str, bytes]]) -> None:
        sink, first = pa.BufferOutputStream(), max(self.place + 1, time.time_ns())
        self.place = first + len(messages) - 1
        columns = {"topic": pa.array([t for t, _ in messages], pa.string()), "value": pa.array([v for _, v in messages], pa.binary()), "place": pa.array(range(first, first + len(messages)), pa.int64())}
        pq.write_table(pa.table(columns), sink)
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.parquet"
        hidden = self._path(f"{self.path}/.{name}")
        out = self.fs.create(hidden)
        out.write(bytearray(sink.getvalue().to_pybytes()))
        out.close()
        if not self.fs.rename(hidden, self._path(f"{self.path}/{name}")):
            raise OSError(f"{name} could not be put in place")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class Bridge:
    """A thread that lands a source's messages until it is stopped; it connects anew when the connection fails."""

    def __init__(self, spark: SparkSession, kind: str, options: dict, path: str, linger: float = 1.0) -> None:
        # a session under a client id of its own keeps what is not confirmed
        options = {"CLIENTID": f"brook-{hashlib.sha256(path.encode()).hexdigest()[:12]}"} | options
        self.folder, self.kind, self.options, self.linger = Folder(spark, path), kind, options, linger
        self.stopped, self.receiver, self.landed = threading.Event(), receiver(kind, options), 0
        if self.receiver is None:
            raise CompileError(f"there is no bridge for {kind}")
        self.thread = threading.Thread(target=self._run, daemon=True, name=f"bridge {path}")
        self.thread.start()

    def _run(self) -> None:
        wait = 0.1
        while not self.stopped.is_set():
            try:
                if self.receiver is None:
                    self.receiver = receiver(self.kind, self.options)
                if got := self.receiver.poll(self.linger):
                    self.folder.write(got)
                    self.receiver.done()
                    self.landed += len(got)
                wait = 0.1
            except Exception as e:  # noqa: BLE001  whatever fails, what was not confirmed comes again
                if self.stopped.is_set():
                    break
                LOG.warning("%s: %s; again in %.1f s", self.thread.name, e, wait)
                self._close()
                self.stopped.wait(wait)
                wait = min(wait * 2, 30.0)
        self._close()

    def _close(self) -> None:
        last, self.receiver = self.receiver, None
        if last is not None:
            try:
                last.close()
            except OSError:
                pass

    def stop(self) -> None:
        self.stopped.set()
        self.thread.join(60)


def bridge(spark: SparkSession, kind: str, options: dict, path: str) -> Bridge:
    """The running bridge into the folder, started if there is none."""
    if path not in _RUNNING or not _RUNNING[path].thread.is_alive():
        _RUNNING[path] = Bridge(spark, kind, options, path, float(options.get("LINGER", "1000")) / 1000)
    return _RUNNING[path]


def stop(path: str | None = None) -> None:
    """End the bridge into a folder, or all."""
    for p in [path] if path else list(_RUNNING):
        if (b := _RUNNING.pop(p, None)) is not None:
            b.stop()
