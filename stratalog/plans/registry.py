"""Queries offered to the driver, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Store
from ..functions import keys as K
from ..lineage import checkpoint_root, shared
from ..operators import lifecycle, merkle, ordered, overlay, proofs, rabbit, state, transfers, twigfile, versions
from ..sources import feeds
from ..streaming.commit import stream_current_state, streamed_state
from . import oracles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its oracle if it has one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


hexed = K.hexed


def order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.order_ops(spark, sf_dir).select(F.col("seq").alias("orderkey"), feeds.engine_key(F.col("key")).alias("key"), "value")


def event_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user that exists, and as many that don't."""
    users = feeds.table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(F.explode(F.array(F.concat(F.lit("user:"), "user_id"), F.concat(F.lit("ghost:"), "user_id"))).alias("key"))


# --- key space -----------------------------------------------------------------------------------------------------


@query(oracles.SHORT_KEY)
def kv_short_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_keys(spark, sf_dir).select("orderkey", hexed(F.col("key")).alias("short_key"), K.shard_id(F.col("key")).cast("long").alias("shard"))


def _histogram(spark: SparkSession, sf_dir: str, name: str, value: Column) -> DataFrame:
    return order_keys(spark, sf_dir).groupBy(value.cast("long").alias(name)).agg(F.count("*").alias("n"))


@query(oracles.histogram("shard", "b7 // 32"))
def kv_shard_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(spark, sf_dir, "shard", K.shard_id(F.col("key")))


@query(oracles.histogram("bucket", "b0 // 4"))
def kv_bucket_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(spark, sf_dir, "bucket", K.order_bucket(F.col("key")))


@query(oracles.histogram("channel", "CASE WHEN b0 < 64 THEN 0 WHEN b0 >= 192 THEN 9 ELSE 1 + (b0 - 64) // 16 END"))
def kv_index_channel_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(spark, sf_dir, "channel", K.index_channel(K.byte_at(F.col("key"), 0)))


@query(oracles.RABBIT_HOPS)
def kv_rabbit_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = feeds.order_ops(spark, sf_dir).select("key")
    return rabbit.short_hops(keys, 4).select("key", F.col("hop").cast("long").alias("hop"), hexed(F.col("short")).alias("short_key"))


#: Keys of a space of two-byte addresses: an eighth of the addresses.
SPACE_KEYS = 4096


@query(oracles.RABBIT_GET)
def kv_rabbit_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event feed through short keys of two bytes, where chains collide; reads must give the plain state. The 32,768 addresses
    of two bytes hold but so many keys, so the users are dealt into spaces of about :data:`SPACE_KEYS` (one, if they are fewer)."""
    ops = feeds.event_ops(spark, sf_dir).select(
        (F.col("height") * 1_000_000_000 + F.col("seq")).alias("seq"), F.col("key").cast("binary").alias("key"), "op", F.col("value").cast("binary").alias("value")
    )
    checkpoint_root(spark)
    spaces = -(-ops.select("key").distinct().count() // SPACE_KEYS) or 1
    holes = shared(rabbit.write_batch(ops, size=2, hops=6, spaces=spaces))
    asked = event_probes(spark, sf_dir).select(F.col("key").cast("binary").alias("key"))
    found = rabbit.read_batch(holes, asked, size=2, spaces=spaces)
    return found.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


# --- current and historical state ----------------------------------------------------------------------------------


@query(oracles.LAST_WRITER)
def kv_block_last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.last_writer(feeds.event_ops(spark, sf_dir)).select("height", "key", "op", "value", "seq")


@query(oracles.CURRENT)
def kv_current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.current_state(feeds.event_ops(spark, sf_dir)).orderBy("key")


@query(oracles.GET_BATCH)
def kv_get_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.get_batch(feeds.event_ops(spark, sf_dir), event_probes(spark, sf_dir))


@query(oracles.HAS)
def kv_has(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.has(feeds.event_ops(spark, sf_dir), event_probes(spark, sf_dir))


@query(oracles.MISSING)
def kv_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.missing(feeds.event_ops(spark, sf_dir), event_probes(spark, sf_dir))


@query(oracles.ACTIVE_COUNT)
def kv_active_count_by_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.active_count_by_height(feeds.event_ops(spark, sf_dir))


@query(oracles.ASOF_GET)
def kv_asof_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = feeds.event_ops(spark, sf_dir)
    parts = [state.current_state(ops, h).select(F.lit(h).cast("long").alias("at"), "key", "value", "height") for h in (0, 7, 14, 29)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(oracles.ASOF_JOIN)
def kv_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order asks for its customer's state a month before it."""
    ops = feeds.customer_ops(spark, sf_dir)
    probes = ops.select("key", (F.col("height") - 1).alias("at")).distinct()
    return state.asof_join(probes, ops)


@query(oracles.ASOF_EVENTS)
def kv_asof_join_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user asked at every fifth block, deletions among the versions."""
    ops = feeds.event_ops(spark, sf_dir)
    probes = ops.select("key").distinct().withColumn("at", F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(29).cast("long"), F.lit(5).cast("long"))))
    return state.asof_join(probes, ops)


@query(oracles.HISTORY)
def kv_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.history(feeds.event_ops(spark, sf_dir))


@query(oracles.TOMBSTONES)
def kv_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.tombstones(feeds.event_ops(spark, sf_dir))


@query(oracles.VERSIONS_PER_KEY)
def kv_versions_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state.last_writer(feeds.event_ops(spark, sf_dir))
    return rows.groupBy("key").agg(F.count("*").alias("versions"), F.sum((F.col("op") == "D").cast("long")).alias("deletions"), F.max("height").alias("last_height"))


@query(oracles.PUT_OLD)
def kv_put_and_get_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.put_and_get_old(feeds.customer_ops(spark, sf_dir))


@query(oracles.RETAINED)
def kv_retained_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state.last_writer(feeds.event_ops(spark, sf_dir)).select("key", "height", "op", "value")
    return lifecycle.retain_versions(rows, 15)


# --- ordered access ------------------------------------------------------------------------------------------------

LOW, HIGH = bytes([80]) + bytes(7), bytes([120]) + bytes(7)


@query(oracles.RANGE_SCAN)
def kv_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state.range_scan(order_keys(spark, sf_dir), bytearray(LOW), bytearray(HIGH))
    return rows.select(hexed(F.col("key")).alias("key"), "value")


@query(oracles.REVERSE_TOPK)
def kv_reverse_scan_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state.range_scan(order_keys(spark, sf_dir), bytearray(LOW), bytearray(HIGH), reverse=True).limit(50)
    return rows.select(hexed(F.col("key")).alias("key"), "value")


@query(oracles.SCAN_ALL)
def kv_scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_keys(spark, sf_dir).orderBy(F.col("key").desc()).select(hexed(F.col("key")).alias("key"), "value")


@query(oracles.neighbour("lag", "previous_key"))
def kv_predecessor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordered.with_previous(order_keys(spark, sf_dir).select("key"), "before")
    return rows.select(hexed(F.col("key")).alias("key"), hexed(F.col("before")).alias("previous_key"))


@query(oracles.neighbour("lead", "next_key"))
def kv_successor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordered.with_next(order_keys(spark, sf_dir).select("key"), "after")
    return rows.select(hexed(F.col("key")).alias("key"), hexed(F.col("after")).alias("next_key"))


@query(oracles.RANK)
def kv_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordered.with_rank(order_keys(spark, sf_dir).select("key"), "rank")
    return rows.select(hexed(F.col("key")).alias("key"), F.col("rank").cast("long").alias("rank"))


# --- version log and its audits -------------------------------------------------------------------------------------


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.version_log(feeds.to_engine(feeds.event_ops(spark, sf_dir)))


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.version_log(feeds.to_engine(feeds.order_ops(spark, sf_dir)))


def _log_columns(log: DataFrame) -> DataFrame:
    return log.select(
        "block", F.col("shard").cast("long").alias("shard"), "sn", hexed(F.col("key")).alias("key"), hexed(F.col("next_key")).alias("next_key"), "height", "last_height",
        F.array_join(F.col("deactivated").cast("array<string>"), ",").alias("deactivated"),
    )


@query(oracles.VERSION_LOG)
def kv_version_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log_columns(event_log(spark, sf_dir))


@query(oracles.NEXT_KEY_CHAIN)
def kv_next_key_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = versions.with_active(order_log(spark, sf_dir)).where("active")
    return live.select(hexed(F.col("key")).alias("key"), hexed(F.col("next_key")).alias("next_key"), F.col("shard").cast("long").alias("shard"), "sn")


@query(oracles.CONSISTENCY)
def kv_check_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.consistency(shared(event_log(spark, sf_dir)))


# --- overlay --------------------------------------------------------------------------------------------------------


def _overlay_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ops = feeds.event_ops(spark, sf_dir)
    base = state.current_state(ops, 14).select("key", "value")
    top = state.latest(ops.where("height > 14")).select("key", "op", "value")
    return base, overlay.buffered(top)


@query(oracles.OVERLAY_GET)
def kv_overlay_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.overlay_get(*_overlay_sides(spark, sf_dir))


@query(oracles.OVERLAY_DIFF)
def kv_overlay_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = feeds.event_ops(spark, sf_dir)
    return overlay.overlay_diff(state.current_state(ops, 14), state.current_state(ops))


@query(oracles.TOUCHED)
def kv_touched_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.touched_in_range(feeds.event_ops(spark, sf_dir), event_probes(spark, sf_dir), 10, 11)


@query(oracles.FIRST_CHANGE)
def kv_first_change_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.first_change_before(feeds.event_ops(spark, sf_dir), 20)


# --- Merkle trees and proofs ----------------------------------------------------------------------------------------


@query(oracles.LEAF_BYTES)
def mt_leaf_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.leaf_bytes(order_log(spark, sf_dir)).select(F.col("shard").cast("long").alias("shard"), "sn", "entry")


@query(oracles.LEAF_HASH)
def mt_leaf_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.leaf_hashes(order_log(spark, sf_dir)).select(F.col("shard").cast("long").alias("shard"), "sn", "leaf")


def full_order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.genesis(spark).unionByName(order_log(spark, sf_dir))


def order_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.twigs(merkle.leaf_hashes(shared(full_order_log(spark, sf_dir))))


@query(oracles.BITMAP)
def mt_active_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_trees(spark, sf_dir).select(F.col("shard").cast("long").alias("shard"), "twig", "bitmap")


@query(oracles.LEFT_ROOT)
def mt_twig_left_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_trees(spark, sf_dir).select(F.col("shard").cast("long").alias("shard"), "twig", "left_root")


@query(oracles.TWIG_ROOT)
def mt_twig_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_trees(spark, sf_dir).select(F.col("shard").cast("long").alias("shard"), "twig", "twig_root")


@query(oracles.SHARD_ROOT)
def mt_shard_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = shared(order_trees(spark, sf_dir).select("shard", "twig", "twig_root"))
    return merkle.shard_roots(merkle.upper_nodes(trees)).select(F.col("shard").cast("long").alias("shard"), "root")


@query(oracles.GLOBAL_ROOT)
def mt_global_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = shared(order_trees(spark, sf_dir).select("shard", "twig", "twig_root"))
    return merkle.global_root(merkle.shard_roots(merkle.upper_nodes(trees)))


@query(oracles.EVENT_ROOT)
def mt_event_shard_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard roots after thirty blocks with deletions and filler rows."""
    log = versions.genesis(spark).unionByName(event_log(spark, sf_dir))
    trees = shared(merkle.twigs(merkle.leaf_hashes(shared(log))).select("shard", "twig", "twig_root"))
    return merkle.shard_roots(merkle.upper_nodes(trees)).select(F.col("shard").cast("long").alias("shard"), "root")


def _order_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of every order's row."""
    log = shared(full_order_log(spark, sf_dir))
    trees = shared(merkle.twigs(merkle.leaf_hashes(log)))
    nodes = shared(merkle.upper_nodes(trees.select("shard", "twig", "twig_root")))
    return proofs.proof_paths(log.where("not is_dummy").select("shard", "sn"), trees, nodes)


@query(oracles.PROOF_PATH)
def mt_proof_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _order_proofs(spark, sf_dir)
    return paths.select(F.col("shard").cast("long").alias("shard"), "sn", F.sha2(F.unhex(proofs.proof_hex(paths)), 256).alias("proof_sha256"))


@query(oracles.PROOF_VERIFY)
def mt_proof_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = proofs.verify(_order_proofs(spark, sf_dir))
    return checked.groupBy(F.col("shard").cast("long").alias("shard")).agg(
        F.count("*").alias("proofs"), F.sum(F.col("valid").cast("long")).alias("valid"), F.sum(F.col("is_active").cast("long")).alias("active")
    )


@query(oracles.NONEXISTENCE)
def mt_nonexistence_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live row whose span covers each key of orders that don't exist."""
    live = versions.with_active(order_log(spark, sf_dir)).where("active").select("key", "next_key", "shard", "sn")
    ghosts = feeds.order_ops(spark, sf_dir).select(feeds.engine_key(F.concat(F.lit("ghost:"), "seq")).alias("key"))
    found = proofs.absence_witness(shared(live), ghosts)
    return found.select(hexed(F.col("key")).alias("key"), hexed(F.col("before")).alias("before_key"), hexed(F.col("after")).alias("after_key"), F.col("shard").cast("long").alias("shard"), "sn")


# --- life cycle -----------------------------------------------------------------------------------------------------


@query(oracles.TWIG_HEIGHTS)
def mt_twig_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = versions.genesis(spark).unionByName(event_log(spark, sf_dir))
    return lifecycle.twig_heights(log).select(F.col("shard").cast("long").alias("shard"), "twig", "start_height")


@query(oracles.KEPT)
def mt_kept_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.kept_entries(event_log(spark, sf_dir)).select(F.col("shard").cast("long").alias("shard"), "next_sn", "kept")


def _per_shard(spark: SparkSession, name: str, value: int) -> DataFrame:
    return spark.range(K.SHARDS).select(F.col("id").cast("int").alias("shard"), F.lit(value).cast("long").alias(name))


@query(oracles.COMPACTION)
def mt_compaction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live rows of each shard's second twig, with the serial numbers under which they would be appended again."""
    rows = lifecycle.compaction_rows(event_log(spark, sf_dir), _per_shard(spark, "oldest_active_twig", 1), min_kept=0)
    return rows.select(F.col("shard").cast("long").alias("shard"), "old_sn", "sn", hexed(F.col("key")).alias("key"))


@query(oracles.PRUNE)
def mt_prune_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twigs of each shard that a prune before block 20 drops, if all but the youngest twig have been emptied by compaction."""
    log = shared(versions.genesis(spark).unionByName(event_log(spark, sf_dir)))
    oldest = lifecycle.kept_entries(log).select("shard", K.twig_of(F.col("next_sn")).alias("oldest_active_twig"))
    found = lifecycle.prune_ranges(log, 20, _per_shard(spark, "last_pruned_twig", -1), oldest, least=0)
    return found.select(F.col("shard").cast("long").alias("shard"), F.col("start").alias("first_twig"), F.col("end").alias("end_twig"))


@query(oracles.POSITIONS)
def mt_entry_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each row of the log stands in its shard's file."""
    placed = twigfile.entry_positions(merkle.leaf_bytes(order_log(spark, sf_dir)))
    return placed.select(F.col("shard").cast("long").alias("shard"), "sn", "pos", "next_pos")


@query(oracles.TWIG_RECORDS)
def mt_twig_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the full twigs: position of the first row, nodes and leaves."""
    log = shared(full_order_log(spark, sf_dir))
    positions = shared(twigfile.entry_positions(merkle.leaf_bytes(log)))
    records = twigfile.twig_records(merkle.twigs(merkle.leaf_hashes(log)), positions)
    digest = F.sha2(F.unhex(twigfile.record_hex(F.col("first_pos"), F.col("top"), F.col("leaves"))), 256)
    return records.select(F.col("shard").cast("long").alias("shard"), "twig", "first_pos", digest.alias("record_sha256"))


# --- store ----------------------------------------------------------------------------------------------------------

_STORES: dict[tuple, Store] = {}


def order_store(spark: SparkSession, sf_dir: str, compacting: bool) -> Store:
    """A store with the four blocks of the orders, built once a session; ``compacting`` appends rows of old twigs again and
    prunes what is older than block 2."""
    name = spark.sparkContext.applicationId, sf_dir, compacting
    if name not in _STORES:
        options = {"compact_at": 1, "compact_ratio": 1, "min_kept": 1} if compacting else {}
        store = Store.create(spark, f"{checkpoint_root(spark)}/store-{uuid.uuid4().hex}", bits=4, **options)
        ops = feeds.to_engine(feeds.order_blocks(spark, sf_dir))
        for height in range(4):
            store.commit_block(ops.where(F.col("height") == height).drop("height"), height)
        if compacting:
            store.prune_before(1)
        _STORES[name] = store
    return _STORES[name]


@query(oracles.STORE_ROOTS)
def mt_store_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard roots that the store kept up block by block."""
    roots = order_store(spark, sf_dir, False).meta().roots
    return spark.createDataFrame([(k, r) for k, r in enumerate(roots)], "shard long, root string")


@query(oracles.STORE_STATE)
def kv_store_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live rows of the store after compaction and pruning, which change neither values nor heights."""
    rows = order_store(spark, sf_dir, True).state()
    return rows.select(hexed(F.col("key")).alias("key"), hexed(F.col("value")).alias("value"), hexed(F.col("next_key")).alias("next_key"), "height", "last_height")


@query(oracles.STORE_ASOF)
def kv_store_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State as of block 2, read from the log and the history of a pruned store."""
    rows = order_store(spark, sf_dir, True).state(2)
    return rows.select(hexed(F.col("key")).alias("key"), hexed(F.col("value")).alias("value"))


@query(oracles.STORE_AUDIT)
def mt_store_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compacted and pruned store against its own log: roots recomputed with the edge nodes, and every kept twig."""
    store = order_store(spark, sf_dir, True)
    meta = store.meta()
    shards = store.recover().agg(F.count("*").alias("bad_shards"))
    twigs = store.check_tree().agg(F.count("*").alias("bad_twigs"))
    live = store.state(guards=True).agg(F.count("*").alias("live"))
    one = live.join(shards, F.lit(True)).join(twigs, F.lit(True))  # one row each
    again = store.log().where("not is_dummy and height < block").limit(1).count() > 0
    return one.select("live", "bad_shards", "bad_twigs", F.lit(again or max(meta.oldest) > 0).alias("compacted"), F.lit(meta.prune_height == 1).alias("pruned"))


# --- transfers ------------------------------------------------------------------------------------------------------


def transfer_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transfers: from the customer to the one numbered half the order's key, in epochs of 64."""
    orders = feeds.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return orders.select(
        F.expr("o_orderkey div 64").alias("epoch"), key.alias("idx"), F.col("o_custkey").alias("from_account"), F.expr("o_orderkey div 2").alias("to_account"),
        (key % 3 + 1).alias("coin"), (key % 1000).alias("transfer"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with two of four coins each."""
    key = F.col("c_custkey")
    coins = F.array(*(F.struct((key % 3 + k).cast("long").alias("coin"), (key % 700 + 100 * k).alias("amount")) for k in (1, 2)))
    rows = feeds.table(spark, sf_dir, "customer").select(key.alias("account"), (key % 50).alias("seq"), (key % 40).alias("native"), F.explode(coins).alias("c"))
    return rows.select("account", "seq", "native", "c.coin", "c.amount")


@query(oracles.TX_CONFLICTS)
def tx_epoch_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfers.epoch_conflicts(transfer_feed(spark, sf_dir))


@query(oracles.TX_APPLY)
def tx_transfer_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfers.apply_transfers(accounts(spark, sf_dir), transfer_feed(spark, sf_dir))


@query(oracles.TX_COINS)
def tx_coin_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = feeds.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("account"), transfers.coins_of(F.col("c_custkey")).alias("left_coins"), transfers.coins_of(F.col("c_custkey") + 1).alias("right_coins")
    )
    found = transfers.shared_coins(pairs)
    return found.select("account", F.array_join(F.col("common").cast("array<string>"), ",").alias("common"), "overlaps")


@query(oracles.TX_ADDRESS)
def tx_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return feeds.table(spark, sf_dir, "customer").select(key.alias("account"), hexed(transfers.address(key)).alias("address"), hexed(transfers.coin_id(key % 100)).alias("coin_id"))


@query(oracles.ZERO_ACCOUNTS)
def tx_zero_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serialised accounts of all customers, without amounts."""
    rows = transfers.accounts_of(feeds.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sn")), amounts=False)
    return rows.select(F.col("sn").alias("account"), F.col("account").alias("entry"))


@query(oracles.ACCOUNTS_CHECK)
def tx_accounts_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts with amounts against those drawn anew without: addresses and kinds of coins agree."""
    sns = feeds.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sn"))
    wrong = transfers.compare_accounts(transfers.accounts_of(sns), transfers.accounts_of(sns, amounts=False)).agg(F.count("*").alias("problems"))
    return sns.agg(F.count("*").alias("accounts")).join(wrong, F.lit(True))  # one row each


@query(oracles.TX_INDEPENDENT)
def tx_independent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy conflict-free transactions of each epoch."""
    return transfers.independent_transactions(transfer_feed(spark, sf_dir))


# --- streaming ------------------------------------------------------------------------------------------------------


@query(oracles.CURRENT)
def st_block_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current state kept by a stream over the events."""
    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    static = feeds.table(spark, sf_dir, "events")
    events = spark.readStream.schema(static.schema).parquet(f"{sf_dir}/events.parquet*")
    ops = events.select(
        F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("height"), F.col("event_id").alias("seq"),
        F.concat(F.lit("user:"), F.col("user_id")).alias("key"), F.when(F.col("event_type") == "error", F.lit("D")).otherwise(F.lit("S")).alias("op"),
        F.concat("event_type", F.lit(":"), F.col("event_id")).alias("value"),
    )
    stream = stream_current_state(ops, f"{root}/state", f"{root}/progress")
    stream.awaitTermination()
    return streamed_state(spark, f"{root}/state").where("op = 'S'").select("key", "value", "height", "seq")
