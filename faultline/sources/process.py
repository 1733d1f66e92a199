"""A child process as a source: its arguments, its output as a stream of chunks, the tail of its stderr.

``register(spark)`` makes ``spark.readStream.format("faultline_process")`` available.  The reader runs on the
driver next to the process, hands out chunks of at most 8 KiB with their sequence numbers, and holds a bounded
number of them, so a slow query slows the child down.
"""

from __future__ import annotations

import json
import os
import queue
import signal
import subprocess
import threading
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

CHUNK, QUEUED, STDERR, GRACE_SECS = 8 << 10, 16, 64 << 10, 2.0
#: The tail command's program and fixed words (fixed values).
PROGRAM, WORDS, LOG = "aio", ("cloudmanager", "tail-log"), "aemerror"


def tail_log_args(environment_id: str, service: str, program_id: str, ims_context: str | None = None) -> list[str]:
    """The tail command's arguments; no shell takes part."""
    args = [*WORDS, environment_id, service, LOG, "--programId", program_id]
    return args + ["--imsContextName", ims_context] if ims_context else args


class StderrTail:
    """The last 64 KiB written, and whether there was more."""

    def __init__(self, limit: int = STDERR) -> None:
        self.limit, self.data, self.truncated = limit, b"", False

    def add(self, block: bytes) -> None:
        self.data += block
        if len(self.data) > self.limit:
            self.data, self.truncated = self.data[-self.limit :], True

    def text(self) -> str:
        return self.data.decode("utf-8", "replace")


class Child:
    """A process in its own group with its output drained by threads."""

    def __init__(self, argv: list[str]) -> None:
        self.process = subprocess.Popen(argv, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.PIPE, start_new_session=True)
        self.chunks: queue.Queue[bytes | None] = queue.Queue(QUEUED)
        self.stderr = StderrTail()
        self._threads = [threading.Thread(target=f, daemon=True) for f in (self._read, self._drain)]
        for t in self._threads:
            t.start()

    def _read(self) -> None:
        while block := os.read(self.process.stdout.fileno(), CHUNK):
            self.chunks.put(block)
        self.chunks.put(None)

    def _drain(self) -> None:
        while block := os.read(self.process.stderr.fileno(), CHUNK):
            self.stderr.add(block)

    def stop(self) -> int | None:
        """Ask, wait two seconds, insist; never signals the caller's own group."""
        if self.process.poll() is None and (group := os.getpgid(self.process.pid)) != os.getpgrp():
            os.killpg(group, signal.SIGTERM)
            try:
                self.process.wait(GRACE_SECS)
            except subprocess.TimeoutExpired:
                os.killpg(group, signal.SIGKILL)
        while self.process.poll() is None:
            try:
                self.chunks.get(timeout=0.1)  # a reader blocked on a full queue
            except queue.Empty:
                pass
        return self.process.wait()


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.source_id, self.argv, self.child = options.get("source", "process"), json.loads(options["argv"]), None
        self.kept: dict[int, bytes] = {}
        self.ended = False

    def initialOffset(self) -> dict:
        return {"chunk": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.child is None:
            self.child = Child(self.argv)
        at, until = start["chunk"], time.monotonic() + 0.2
        self.kept = {k: v for k, v in self.kept.items() if k >= at}
        end = max(self.kept, default=at - 1) + 1
        while not self.ended and time.monotonic() < until:
            try:
                block = self.child.chunks.get(timeout=0.05)
            except queue.Empty:
                continue
            self.kept[end] = block or b""  # the last chunk has no bytes: it ends the source
            end += 1
            self.ended = block is None
        return iter([(self.source_id, k, self.kept[k]) for k in range(at, end)]), {"chunk": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        wanted = range(start["chunk"], end["chunk"])
        if lost := [k for k in wanted if k not in self.kept]:  # a child's output can't be read twice
            raise RuntimeError(f"chunks {lost[0]} to {lost[-1]} are gone with the process that wrote them")
        return iter([(self.source_id, k, self.kept[k]) for k in wanted])

    def commit(self, end: dict) -> None:
        self.kept = {k: v for k, v in self.kept.items() if k >= end["chunk"]}

    def stop(self) -> None:
        if self.child is not None:
            self.child.stop()


class ProcessSource(DataSource):
    """Options: argv (a JSON array) and source (a name)."""

    @classmethod
    def name(cls) -> str:
        return "faultline_process"

    def schema(self) -> str:
        return "source_id string, chunk_seq long, bytes binary"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ProcessSource)
