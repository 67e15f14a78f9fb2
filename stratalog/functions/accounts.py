"""Accounts, transactions and 256-bit amounts as JVM expressions over hex text.

An account is ``address(20) sequence(8, little-endian) native(32, big-endian)`` and up to eight coins ``id(8) amount(32)``, in
order of their ids. A transaction is ``from(8) to(8) amount(8, little-endian) coin id(8)``. Amounts of 256 bits are 64 hex
digits, so they compare as text; sums and differences carry over eight limbs of 32 bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codec import read_le
from .keys import little_endian

MAX_COINS = 8
HEAD = 60
COIN = 40
TX_SIZE = 32
ZERO = "0" * 64
_LIMBS = 8


def u256(value: Column) -> Column:
    """64 hex digits of a non-negative integer column."""
    return F.lower(F.lpad(F.hex(value.cast("long")), 64, "0"))


def _limb(text: Column, k: int) -> Column:
    return F.conv(F.substring(text, 8 * k + 1, 8), 16, 10).cast("long")


def _joined(limbs: list[Column]) -> Column:
    return F.concat(*(F.lower(F.lpad(F.hex(x), 8, "0")) for x in limbs))


def u256_add(a: Column, b: Column) -> Column:
    """Sum; null where it needs more than 256 bits."""
    carry, limbs = F.lit(0).cast("long"), []
    for k in range(_LIMBS - 1, -1, -1):
        total = _limb(a, k) + _limb(b, k) + carry
        limbs.append(total.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
        carry = F.shiftright(total, 32)
    return F.when(carry == 0, _joined(limbs[::-1]))


def u256_sub(a: Column, b: Column) -> Column:
    """Difference; null where it is below zero."""
    borrow, limbs = F.lit(0).cast("long"), []
    for k in range(_LIMBS - 1, -1, -1):
        rest = _limb(a, k) - _limb(b, k) - borrow
        limbs.append(rest.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
        borrow = (rest < 0).cast("long")
    return F.when(borrow == 0, _joined(limbs[::-1]))


def account_hex(address: Column, sequence: Column, native: Column, coins: Column) -> Column:
    """Serialised account; ``address`` is hex, ``coins`` an array of struct<id, amount> of hex, in any order."""
    ordered = F.array_sort(coins)
    return F.concat(address, little_endian(sequence, 8), native, F.array_join(F.transform(ordered, lambda c: F.concat(c["id"], c["amount"])), ""))


def parse_account(text: Column) -> Column:
    """Struct of a serialised account; null where the length does not fit or there are too many coins."""
    rest = F.length(text) - 2 * HEAD
    count = (rest / (2 * COIN)).cast("int")
    coin = lambda i: F.struct(
        F.substr(text, 2 * HEAD + 1 + 2 * COIN * i, F.lit(16)).alias("id"), F.substr(text, 2 * HEAD + 17 + 2 * COIN * i, F.lit(64)).alias("amount")
    )
    coins = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), coin)).otherwise(F.array().cast("array<struct<id:string,amount:string>>"))
    parsed = F.struct(
        F.substring(text, 1, 40).alias("address"), read_le(F.substring(text, 41, 16), F.lit(0), 8).alias("sequence"), F.substring(text, 57, 64).alias("native"), coins.alias("coins")
    )
    return F.when((rest >= 0) & (rest % (2 * COIN) == 0) & (count <= MAX_COINS), parsed)


def find_coin(coins: Column, coin_id: Column) -> Column:
    """Place (from 0) of a coin in an account's coins, -1 where it has none."""
    return (F.array_position(F.transform(coins, lambda c: c["id"]), coin_id) - 1).cast("int")


def tx_hex(from_num: Column, to_num: Column, amount: Column, coin_id: Column) -> Column:
    """Serialised transaction; all but the amount are hex."""
    return F.concat(from_num, to_num, little_endian(amount, 8), coin_id)


def parse_tx(text: Column) -> Column:
    part = lambda k: F.substring(text, 16 * k + 1, 16)
    return F.struct(part(0).alias("from_num"), part(1).alias("to_num"), read_le(part(2), F.lit(0), 8).alias("amount"), part(3).alias("coin_id"))
