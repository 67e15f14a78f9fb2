"""The transactional transfer workload: accounts, coins, epochs and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import accounts as A
from ..functions.keys import hexed, little_endian, sha256

GAS = 10
MAX_COINS = 8


def coin_id(coin_type: Column) -> Column:
    """Eight bytes named by ``coin<type>``."""
    return F.substring(sha256(F.concat(F.lit("coin"), coin_type.cast("string"))), 1, 8)


def address(sn: Column) -> Column:
    """Twenty bytes named by ``address<sn>``."""
    return F.substring(sha256(F.concat(F.lit("address"), sn.cast("string"))), 1, 20)


def drawn_coins(sn: Column, kinds: int = 100, most: int = MAX_COINS) -> Column:
    """Coin types that an account's number draws from the bytes of the digest of ``listofcoins<sn>``, repeats included."""
    digest = F.hex(sha256(F.concat(F.lit("listofcoins"), sn.cast("string"))))
    byte = lambda i: F.conv(F.substr(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    return F.transform(F.sequence(F.lit(1), 1 + byte(F.lit(0)) % most), lambda i: byte(i) % kinds)


def coins_of(sn: Column, kinds: int = 100, most: int = MAX_COINS) -> Column:
    """Sorted distinct coin types that an account holds."""
    return F.array_sort(F.array_distinct(drawn_coins(sn, kinds, most)))


def accounts_of(sns: DataFrame, amounts: bool = True, seed: str = "amounts") -> DataFrame:
    """``(sn, address, account)`` of account numbers: the serialised account that a number stands for.

    It holds the coins that its number draws, repeats included, and the sequence ``sn << 32``. Amounts are seeded 32-bit draws,
    shifted by 128 bits (or zero).
    """
    draw = lambda what: F.concat(F.lit("0" * 24), F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col("sn").cast("string"), what.cast("string")).cast("binary"), 256), 1, 8), F.lit("0" * 32)) if amounts else F.lit(A.ZERO)
    coins = F.transform(drawn_coins(F.col("sn")), lambda k, i: F.struct(hexed(coin_id(k)).alias("id"), draw(i).alias("amount")))
    own = hexed(address(F.col("sn")))
    return sns.select("sn", own.alias("address"), A.account_hex(own, F.shiftleft(F.col("sn").cast("long"), 32), draw(F.lit(-1)), coins).alias("account"))


def compare_accounts(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(sn, problem)`` of accounts ``(sn, account)`` that differ in presence, address, number or kind of coins; amounts may differ."""
    a, b = (df.select("sn", A.parse_account(F.col("account")).alias(name)) for df, name in ((left, "a"), (right, "b")))
    ids = lambda name: F.transform(F.col(f"{name}.coins"), lambda c: c["id"])
    problem = (
        F.when(F.col("a").isNull() | F.col("b").isNull(), "missing").when(F.col("a.address") != F.col("b.address"), "address")
        .when(F.size("a.coins") != F.size("b.coins"), "coin count").when(ids("a") != ids("b"), "coin type")
    )
    return a.join(b, "sn", "full_outer").select("sn", problem.alias("problem")).where("problem is not null")


def execute_transactions(accounts: DataFrame, tx: DataFrame, credit: bool = True) -> DataFrame:
    """Verdict and new serialised accounts of an epoch's transactions: ``(epoch, idx, status, from_account, to_account)``.

    Accounts are ``(num, account)`` by their short number (hex), transactions ``(epoch, idx, from_num, to_num, amount,
    coin_id)``; a negative amount counts as its absolute value. Amounts have 256 bits. ``credit`` False leaves the receiver's
    balance as it was, as the measured workload does.
    """
    a = accounts.select(F.col("num").alias("from_num"), A.parse_account(F.col("account")).alias("a"))
    b = accounts.select(F.col("num").alias("to_num"), A.parse_account(F.col("account")).alias("b"))
    rows = tx.join(a, "from_num", "left").join(b, "to_num", "left")
    rows = rows.withColumn("i", A.find_coin(F.col("a.coins"), F.col("coin_id"))).withColumn("j", A.find_coin(F.col("b.coins"), F.col("coin_id")))
    held = lambda side, at: F.get(F.col(f"{side}.coins"), F.col(at))["amount"]
    moved, gas = A.u256(F.abs("amount")), F.lit(f"{GAS:064x}")
    rows = rows.withColumn("left_over", A.u256_sub(held("a", "i"), moved)).withColumn("got", A.u256_add(held("b", "j"), moved)).withColumn("native", A.u256_sub(F.col("a.native"), gas))
    status = (
        F.when(F.col("a").isNull(), "no from-account").when(F.col("b").isNull(), "no to-account")
        .when(F.col("i") < 0, "coin not in from-account").when(F.col("j") < 0, "coin not in to-account")
        .when(F.col("left_over").isNull(), "not enough coins").when(F.col("got").isNull(), "overflow").when(F.col("native").isNull(), "not enough for gas").otherwise("done")
    )
    rows = rows.withColumn("status", status)

    def changed(side: str, at: str, amount: str) -> Column:
        """The account's coins with another amount in one place; they stay in order."""
        return F.array_join(F.transform(F.col(f"{side}.coins"), lambda c, i: F.concat(c["id"], F.when(i == F.col(at), F.col(amount)).otherwise(c["amount"]))), "")

    whole = lambda side, sequence, native, coins: F.concat(F.col(f"{side}.address"), little_endian(sequence, 8), native, coins)
    sender = whole("a", F.col("a.sequence") + 1, F.col("native"), changed("a", "i", "left_over"))
    if not credit:
        rows = rows.withColumn("got", held("b", "j"))
    receiver = whole("b", F.col("b.sequence"), F.col("b.native"), changed("b", "j", "got"))
    done = F.col("status") == "done"
    return rows.select("epoch", "idx", "status", F.when(done, sender).alias("from_account"), F.when(done, receiver).alias("to_account"))


def epoch_conflicts(tx: DataFrame) -> DataFrame:
    """Accounts that take part more than once in an epoch: ``(epoch, account, touches)``."""
    touched = tx.select("epoch", F.explode(F.array("from_account", "to_account")).alias("account"))
    return touched.groupBy("epoch", "account").agg(F.count("*").alias("touches")).where("touches > 1")


def independent_transactions(tx: DataFrame) -> DataFrame:
    """Transactions of which neither account is touched by an earlier one that was kept in the epoch (greedy, in order).

    The greedy choice is sequential within an epoch, and an epoch is bounded (4,096 transactions in the workload).
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        used: set = set()
        keep = []
        for at, (a, b) in enumerate(zip(pdf["from_account"].tolist(), pdf["to_account"].tolist(), strict=True)):
            if a != b and a not in used and b not in used:
                used.update((a, b))
                keep.append(at)
        return pdf.iloc[keep]

    return tx.groupBy("epoch").applyInPandas(run, tx.schema)


def apply_transfers(accounts: DataFrame, tx: DataFrame, credit: bool = True) -> DataFrame:
    """Verdict and new balances of each transaction: ``(epoch, idx, status, from_after, to_after, native_after, seq_after)``.

    Accounts are ``(account, seq, native, coin, amount)``, one row a coin. Accounts are disjoint within an epoch, so both
    sides are equi-joins. ``credit`` False leaves the receiver's balance as it was, as the measured workload does.
    """
    a = accounts.select(F.col("account").alias("from_account"), F.col("coin"), F.col("amount").alias("from_amount"), "native", "seq")
    b = accounts.select(F.col("account").alias("to_account"), F.col("coin"), F.col("amount").alias("to_amount"))
    known = accounts.select("account").distinct()
    joined = (
        tx.join(a, ["from_account", "coin"], "left")
        .join(b, ["to_account", "coin"], "left")
        .join(known.select(F.col("account").alias("from_account"), F.lit(True).alias("from_known")), "from_account", "left")
        .join(known.select(F.col("account").alias("to_account"), F.lit(True).alias("to_known")), "to_account", "left")
    )
    status = (
        F.when(F.col("from_known").isNull(), "no from-account")
        .when(F.col("to_known").isNull(), "no to-account")
        .when(F.col("from_amount").isNull(), "coin not in from-account")
        .when(F.col("to_amount").isNull(), "coin not in to-account")
        .when(F.col("from_amount") < F.col("transfer"), "not enough coins")
        .when(F.col("native") < GAS, "not enough for gas")
        .otherwise("done")
    )
    done = F.col("status") == "done"
    received = F.col("to_amount") + F.col("transfer") if credit else F.col("to_amount")
    return joined.withColumn("status", status).select(
        "epoch", "idx", "status", F.when(done, F.col("from_amount") - F.col("transfer")).alias("from_after"), F.when(done, received).alias("to_after"),
        F.when(done, F.col("native") - GAS).alias("native_after"), F.when(done, F.col("seq") + 1).alias("seq_after"),
    )


def shared_coins(pairs: DataFrame) -> DataFrame:
    """Coins that both sides of ``(left, right)`` arrays hold."""
    return pairs.withColumn("common", F.array_sort(F.array_intersect("left_coins", "right_coins"))).withColumn("overlaps", F.arrays_overlap("left_coins", "right_coins"))
