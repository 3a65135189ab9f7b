"""Structured Streaming into a session: each micro-batch is an epoch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rulespan.operators.signed import DIFF
from rulespan.streaming.session import Session


def feed(session: Session, relation: str, stream: DataFrame, on_epoch: Callable[[dict[str, DataFrame], int], None] | None = None, **options) -> StreamingQuery:
    """Rows of a streaming DataFrame are inserted, or removed where a column ``__diff`` is negative; then the session steps.
    on_epoch gets the changed relations with their ``__diff``. A batch that is delivered again is passed over.

    A session lives as long as its driver, and so does what it knows of delivered batches: after a restart of the driver begin with a new
    session and a new ``checkpointLocation``, so that the stream is read from its beginning."""
    done = {"epoch": -1}

    def run(batch: DataFrame, epoch: int):
        if epoch <= done["epoch"]:
            return
        names = [c for c in batch.columns if c != DIFF]
        if DIFF in batch.columns:
            session.remove(relation, batch.filter(F.col(DIFF) < 0).select(*names))
            batch = batch.filter(F.col(DIFF) > 0)
        session.insert(relation, batch.select(*names))
        changes = session.step_frame()
        if on_epoch:
            on_epoch(changes, epoch)
        done["epoch"] = epoch

    writer = stream.writeStream.foreachBatch(run)
    for k, v in options.items():
        writer = writer.option(k, v)
    return writer.start()
