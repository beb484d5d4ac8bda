"""What Python workers hold."""

from __future__ import annotations

import ctypes
import os

import pyarrow as pa

#: Rows with texts that a Python worker gets at a time.
BATCH = 1024
#: Resident bytes of a Python worker from which freed memory goes back within a task too.
KEEP = 256 << 20


def small_batches(spark) -> None:
    """Arrow batches hold BATCH rows at most: they stand in the JVM, between the processes and in the worker. A setting of the session, which is lowered and never raised."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, BATCH)


def give_back() -> None:
    """Freed memory goes back to the system, where its allocators allow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def resident() -> int:
    """Bytes of this process in memory; 0 where the system does not say."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    except OSError:
        return 0
