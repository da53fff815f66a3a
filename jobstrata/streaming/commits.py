"""Several tables that change together, one micro-batch at a time, and survive a stop between any two steps."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobstrata.session import delete_path, folder_names, touch


class CommitLog:
    """Tables below one folder, a folder `batch_id=N` of each for every micro-batch.

    A commit is: begin marker, every table in the order given, finish marker. Readers see a batch only once it is
    finished. `recover` takes back what an unfinished commit left; a finished batch that is delivered again is not
    written again. `states` are tables that hold one row per key and are replaced by every batch: only their last
    finished version is read, and versions before the last two go.

    The batches of one stream come one after the other, so the log has one writer: one folder for each checkpoint."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, str], states: tuple[str, ...] = ()):
        self.spark, self.root, self.tables, self.states = spark, root.rstrip("/"), tables, states

    def _marked(self, kind: str) -> set[int]:
        return {int(n.split("-")[1]) for n in folder_names(self.spark, f"{self.root}/commits") if n.startswith(f"{kind}-")}

    def last(self) -> int:
        """The last finished batch, -1 before the first."""
        return max(self._marked("finish"), default=-1)

    def pending(self) -> list[int]:
        return sorted(self._marked("begin") - self._marked("finish"))

    def _folder(self, name: str, batch_id: int) -> str:
        return f"{self.root}/{name}/batch_id={batch_id}"

    def read(self, name: str) -> DataFrame:
        """Rows of all finished batches with their `batch_id`; of a state its last version without it."""
        last = self.last()
        if last < 0:
            return self.spark.createDataFrame([], self.tables[name] + ("" if name in self.states else ", batch_id long"))
        if name in self.states:
            return self.spark.read.schema(self.tables[name]).parquet(self._folder(name, last))
        return self.spark.read.schema(self.tables[name] + ", batch_id long").parquet(f"{self.root}/{name}").where(F.col("batch_id") <= last)

    def recover(self) -> list[tuple[int, str, int]]:
        """Takes back unfinished commits: (batch, table, rows removed). States stay at their last finished version."""
        removed = []
        for batch_id in self.pending():
            for name, schema in self.tables.items():
                if f"batch_id={batch_id}" in folder_names(self.spark, f"{self.root}/{name}"):
                    removed.append((batch_id, name, self.spark.read.schema(schema).parquet(self._folder(name, batch_id)).count()))
                    delete_path(self.spark, self._folder(name, batch_id))
            delete_path(self.spark, f"{self.root}/commits/begin-{batch_id}")
        return removed

    def commit(self, batch_id: int, rows: dict[str, DataFrame], after: Callable[[str], None] = lambda step: None) -> None:
        """Writes one batch of every table; `after` is told of each step done."""
        if batch_id <= self.last():
            return
        self.recover()
        touch(self.spark, f"{self.root}/commits/begin-{batch_id}")
        after("begin")
        for name, schema in self.tables.items():
            columns = self.spark.createDataFrame([], schema).schema
            rows[name].select(*[F.col(f.name).cast(f.dataType) for f in columns]).write.mode("overwrite").parquet(self._folder(name, batch_id))
            after(name)
        touch(self.spark, f"{self.root}/commits/finish-{batch_id}")
        after("finish")
        for name in self.states:
            delete_path(self.spark, self._folder(name, batch_id - 2))


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Gives everything available to `write`, going on from the checkpoint."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def deliver(parts: list[DataFrame], write: Callable[[DataFrame, int], None], root: str) -> None:
    """Each part is one delivery to a file stream that goes on from its checkpoint, so it is one micro-batch."""
    for i, part in enumerate(parts):
        part.write.parquet(f"{root}/in/{i:03d}")
        run_batches(part.sparkSession.readStream.schema(part.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in"), write, f"{root}/state")
