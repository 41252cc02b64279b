"""Blocks of ordered rows, fetched from the cluster as they are asked for."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class BlockIterator:
    """Blocks of at most ``size`` rows of an ordered frame.

    Nothing is planned or read before the first block is asked for.  The iterator
    closes itself at the end and on failure; :meth:`close` may be called any number
    of times and cancels what still runs.  It is also a context manager.
    """

    def __init__(self, frame: Callable[[], DataFrame], size: int, assemble: Callable[[list], Any], spark: SparkSession, public: Callable[[BaseException], BaseException]):
        self._frame, self._size, self._assemble, self._spark, self._public = frame, size, assemble, spark, public
        self._tag = f"blocks-{uuid.uuid4().hex}"
        self._rows: Any = None
        self.closed = False

    def __iter__(self) -> BlockIterator:
        return self

    def __enter__(self) -> BlockIterator:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def __next__(self) -> Any:
        if self.closed:
            raise StopIteration
        try:
            self._spark.addTag(self._tag)
            try:
                if self._rows is None:
                    self._rows = self._frame().toLocalIterator(prefetchPartitions=True)
                rows = list(islice(self._rows, self._size))
            finally:
                self._spark.removeTag(self._tag)
            block = self._assemble(rows) if rows else None
        except Exception as error:
            self.close()
            known = self._public(error)
            if known is error:
                raise
            raise known from error
        if not rows:
            self.close()
            raise StopIteration
        return block

    def close(self) -> None:
        if not self.closed:
            self.closed = True
            started, self._rows = self._rows is not None, None
            if started:
                self._spark.interruptTag(self._tag)
