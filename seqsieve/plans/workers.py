"""Helpers for code inside Python workers."""

from __future__ import annotations

import ctypes


def release_memory() -> None:
    """Give memory that is free in the allocators back to the system; a worker lives on after its task."""
    try:
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError, ImportError):
        pass  # another C library: nothing to give back
