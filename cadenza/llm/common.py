"""Column helpers of the operators, and the scratch tables that they cut their lineage with."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.shared import Scratch

__all__ = ["Scratch", "give_back", "id_remainder", "lean", "text_or_empty", "utf8_size"]

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # not glibc
    _trim = None


def give_back() -> None:
    """Memory that the allocators of Arrow and of the C library hold on to goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over Arrow batches or arrays, with what it freed given back at its end.

    Spark keeps a worker for later tasks and plans; what the batches of texts took would otherwise lie idle in it beside what those need.
    """

    @functools.wraps(run)
    def trimmed(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return trimmed


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def utf8_size(name: str = "text") -> Column:
    """Bytes of the text in UTF-8; null counts as empty."""
    return F.coalesce(F.octet_length(F.col(name)), F.lit(0)).cast("long")


def id_remainder(name: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text (remainder 0)."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % modulus
