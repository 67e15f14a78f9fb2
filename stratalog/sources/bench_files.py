"""Files of the transfer and key-value benches: transactions, key samples, index lists and address maps.

A transaction file holds epochs of 4096 transactions of 32 bytes, each epoch followed by eight bytes of checksum, which are
kept as they are and not verified (their hash function is not available here). An index list is little-endian 32-bit
numbers. A sample file has lines ``SAMPLE <base64 key> <base64 value>``. An address map is one JSON object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import accounts as A

TX_IN_EPOCH = 4096
EPOCH_BYTES = TX_IN_EPOCH * A.TX_SIZE + 8
ACCOUNTS_IN_BLOCK = 20_000
EPOCHS_IN_BLOCK = 32


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    """``(block, epoch, idx, from_num, to_num, amount, coin_id, checksum)`` of a transaction file.

    The file is read as fixed-length records of one epoch, so it is split over tasks; a tail shorter than an epoch is left.
    """
    sc = spark.sparkContext
    records = sc.binaryRecords(path, EPOCH_BYTES).zipWithIndex().map(lambda x: (x[1], bytearray(x[0])))
    epochs = spark.createDataFrame(records, "epoch long, bytes binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for epoch, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = np.frombuffer(data[:-8], np.uint8).reshape(TX_IN_EPOCH, A.TX_SIZE)
                texts = [x.tobytes().hex() for x in raw]
                cols = [np.full(TX_IN_EPOCH, epoch, np.int64), np.arange(TX_IN_EPOCH, dtype=np.int64), texts, [data[-8:].hex()] * TX_IN_EPOCH]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["epoch", "idx", "tx", "checksum"])

    rows = epochs.mapInArrow(cut, "epoch long, idx long, tx string, checksum string").withColumn("tx", A.parse_tx(F.col("tx")))
    return rows.select(F.floor(F.col("epoch") / EPOCHS_IN_BLOCK).alias("block"), "epoch", "idx", "tx.*", "checksum")


def epoch_bytes(transactions: list[bytes], checksum: bytes = bytes(8)) -> bytes:
    """One epoch of a transaction file."""
    if len(transactions) != TX_IN_EPOCH or any(len(x) != A.TX_SIZE for x in transactions):
        raise ValueError(f"an epoch has {TX_IN_EPOCH} transactions of {A.TX_SIZE} bytes")
    return b"".join(transactions) + checksum


def read_index_list(spark: SparkSession, path: str) -> DataFrame:
    """``(at, sn)`` of a list of little-endian 32-bit numbers."""
    records = spark.sparkContext.binaryRecords(path, 4).zipWithIndex().map(lambda x: (x[1], int.from_bytes(x[0], "little")))
    return spark.createDataFrame(records, "at long, sn long")


def shuffled_accounts(spark: SparkSession, count: int, seed: str = "accounts") -> DataFrame:
    """``(at, block, sn)``: all account numbers in a seeded order, in blocks of :data:`ACCOUNTS_IN_BLOCK`."""
    from ..operators.ordered import with_rank

    rows = spark.range(count).select(F.col("id").alias("sn"), F.sha2(F.concat(F.lit(seed + ":"), F.col("id").cast("string")).cast("binary"), 256).alias("draw"))
    ranked = with_rank(rows, "rank", key="draw").withColumn("at", F.col("rank") - 1)
    return ranked.select("at", F.floor(F.col("at") / ACCOUNTS_IN_BLOCK).alias("block"), "sn")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """``(key, value)`` of a sample file; a line of another form is an error."""
    parts = F.split("value", " ")
    fine = (F.size(parts) == 3) & (F.get(parts, F.lit(0)) == "SAMPLE")
    cut = lambda k: F.unbase64(F.when(fine, F.get(parts, F.lit(k))).otherwise(F.raise_error(F.concat(F.lit("invalid line: "), F.col("value")))))
    return spark.read.text(path).select(cut(1).alias("key"), cut(2).alias("value"))


def write_samples(pairs: DataFrame, path: str) -> None:
    pairs.select(F.concat_ws(" ", F.lit("SAMPLE"), F.base64("key"), F.base64("value")).alias("value")).write.mode("overwrite").text(path)


def read_address_map(spark: SparkSession, path: str) -> DataFrame:
    """``(address, num)`` of a JSON object of numbers by name."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string, bigint>")).alias("address", "num"))
