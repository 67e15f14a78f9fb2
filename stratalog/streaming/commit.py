"""Structured Streaming façade: a stream of operations becomes blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Store


def stream_into_store(ops: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Commit the blocks of a stream of engine operations; a block's operations come in one micro-batch.

    A batch that is delivered again finds its blocks published and changes nothing; a block below the committed height is
    refused, since positions in the log only grow.
    """

    def commit(batch: DataFrame, _: int) -> None:
        held = batch.persist()
        for (height,) in sorted(tuple(r) for r in held.select("height").distinct().collect()):
            if height > store.meta().height:
                store.commit_block(held.where(F.col("height") == height), height)
        held.unpersist()

    return ops.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Batches after which the folders of a streamed state are merged into one.
MERGE_EVERY = 16


def stream_current_state(ops: DataFrame, path: str, checkpoint: str, merge_every: int = MERGE_EVERY) -> StreamingQuery:
    """Keep the latest operation of each key under ``path``; read it with :func:`streamed_state`.

    A batch writes the latest operation of its own keys only (``delta/batch=n``). Every ``merge_every`` batches all are merged
    into ``base/batch=n``, and what lies before the base is deleted, so the whole state is written once in that many batches.
    A batch that is delivered again writes the same folder again.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        _latest(batch.select("key", "height", "seq", "op", "value")).write.mode("overwrite").parquet(f"{path}/delta/batch={batch_id}")
        if (batch_id + 1) % merge_every == 0:
            _merged(batch.sparkSession, path, batch_id).write.mode("overwrite").parquet(f"{path}/base/batch={batch_id}")
            for kind, last in (("delta", batch_id), ("base", batch_id - 1)):
                for old in _batches(batch.sparkSession, f"{path}/{kind}"):
                    if old <= last:
                        folder, files = _folder(batch.sparkSession, f"{path}/{kind}/batch={old}")
                        files.delete(folder, True)

    return ops.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_state(spark: SparkSession, path: str) -> DataFrame:
    """Latest operation ``(key, height, seq, op, value)`` of each key that a stream has seen."""
    return _merged(spark, path, max([*_batches(spark, f"{path}/delta"), *_batches(spark, f"{path}/base")]))


def _latest(rows: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct("height", "seq", "op", "value"), F.struct("height", "seq"))
    return rows.groupBy("key").agg(newest.alias("w")).select("key", "w.*")


def _merged(spark: SparkSession, path: str, upto: int) -> DataFrame:
    """The newest base that is finished, and the batches after it."""
    base = max((b for b in _batches(spark, f"{path}/base") if b <= upto), default=None)
    folders = [f"{path}/delta/batch={b}" for b in _batches(spark, f"{path}/delta") if b <= upto and (base is None or b > base)]
    return _latest(spark.read.parquet(*folders, *([f"{path}/base/batch={base}"] if base is not None else [])))


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that were written whole."""
    folder, files = _folder(spark, path)
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    done = [n for n in names if n.startswith("batch=") and files.exists(_folder(spark, f"{path}/{n}/_SUCCESS")[0])]
    return sorted(int(n.split("=")[1]) for n in done)
