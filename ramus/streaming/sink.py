"""A stream as a sequence of commits on a branch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ramus.operators.store import BranchStore


def upsert_stream(store: BranchStore, stream: DataFrame, branch: str, table: str, checkpoint: str, order: str | None = None):
    """A writer that upserts every micro-batch into a branch; of equal keys in a batch the last
    by `order` counts. The catalog keeps the number of the last batch of each stream (named by its checkpoint
    folder) with the rows, so a replayed batch is left out, whatever others wrote since."""
    name = f"{checkpoint}|{branch}|{table}"

    def write(batch: DataFrame, number: int) -> None:
        session = store.checkout(branch)

        def work() -> int:
            if session.catalog.streams.get(name, -1) >= number:
                return 0
            session.catalog.streams[name] = number
            return session.upsert(table, batch, order)

        session.retried(work)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
