"""Scans fed by a stream: each micro-batch of file rows is one more location of a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from twinframe.operators.session import Session


def feed(session: Session, files: DataFrame, checkpoint: str, root: Callable[[int], str] = lambda n: f"batch{n}", trigger: dict | None = None) -> StreamingQuery:
    """Scan each batch of the streaming relation ``files`` (path, size, content or checksum) into ``session``.

    One writer a batch keeps numbers gapless: a file that makes an earlier size collide releases that earlier file, which
    takes the next id. A batch that is delivered again is the location it was, hence skipped. Contents are hashed as they
    come, since a batch cannot be read again; a batch works on its own files and on those it releases.
    """

    def add(batch: DataFrame, n: int) -> None:
        if not batch.isEmpty():
            session.scan(batch, root=root(n), hash_all=True)

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
