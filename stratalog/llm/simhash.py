"""SimHash near-duplicates over a Gray-order hierarchical index.

Each text gives a fingerprint of 64 bits a lane. Equal fingerprints are one node; distinct ones meet in buckets
(tables of shared bit blocks), are sorted there by Gray rank and searched with the index of :mod:`.gray`. A bucket
emits a spanning forest of its links, never all pairs, and the forests of all buckets are contracted to components.

Two ways to choose the tables:

* *exact* (``max_diff`` small against the bits): the 64 bits are cut into m blocks, and any pair within ``max_diff``
  agrees on at least ``m - max_diff`` of them, so each choice of that many blocks is a table and no link is lost. m
  follows the number of distinct fingerprints, so buckets stay small at any size.
* *sampled* (long fingerprints, wide limits): each table takes a few of the fingerprint's bytes as its key, more of them
  for more fingerprints. Used for candidates only, beside MinHash bands.

A bucket of over :data:`BUCKET` distinct fingerprints is set aside as it streams by and searched in chunks, so no task
ever gathers it (see :func:`chunked_links`). Defined results: a null or blank text has fingerprint zero and
links like any other; repeated rows are repeated in the result; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gray
from .common import bound_arrow_batches, checkpointed, connected_components, fresh_name, salted_join, sized

BUCKET = 2048
#: Members of a chunked group that every chunk sees.
LEADERS = 64
#: Shingles that one chunk of texts holds.
CHUNK_SHINGLES = 2_000_000
#: A pair of Jaccard 0.8 misses all bands with chance (1 - 0.8^8)^64 = 8e-6.
BANDS, BAND_ROWS = 64, 8
SEED = 42
_PIECE = 65536
_FLUSH = 1 << 18
_LUT = (((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint64) << (8 * np.arange(8)).astype(np.uint64)).sum(
    axis=1, dtype=np.uint64
)


def shingle_hashes(words: list[bytes], k: int) -> list[int]:
    """XXH64 of each run of k words, repeats included; the whole sequence where there are fewer."""
    digest = xxhash.xxh64_intdigest
    if len(words) < k:
        return [digest(b" ".join(words), SEED)] if words else []
    return [digest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(k)), strict=False)]


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    if lane == 0:
        return h
    x = h + np.uint64(lane * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(texts: list[str | None], k: int = 3, lanes: int = 1) -> np.ndarray:
    """``(len(texts), lanes)`` uint64; bit b is 1 where over half of the shingle hashes have it set."""
    ones = np.zeros((len(texts), lanes * 64), dtype=np.int64)
    total = np.zeros(len(texts), dtype=np.int64)
    held: list[np.ndarray] = []
    owner: list[int] = []

    def flush() -> None:
        if not held:
            return
        flat, size = np.concatenate(held), np.array([len(x) for x in held])
        first = np.cumsum(size) - size
        cuts = np.concatenate([np.arange(f, f + n, 255) for f, n in zip(first, size, strict=True)])
        per = np.searchsorted(cuts, first)
        who = np.array(owner)
        for lane in range(lanes):
            spread = _LUT[_mixed(flat, lane).view(np.uint8).reshape(-1, 8)]
            part = np.add.reduceat(spread, cuts, axis=0).view(np.uint8).astype(np.int64)
            np.add.at(ones[:, lane * 64 : lane * 64 + 64], who, np.add.reduceat(part, per, axis=0))
        held.clear()
        owner.clear()

    waiting = 0
    for row, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        for at in range(0, max(1, len(words) - k + 1), _PIECE):
            h = shingle_hashes(words[at : at + _PIECE + k - 1], k)
            if h:
                held.append(np.array(h, dtype=np.uint64))
                owner.append(row)
                total[row] += len(h)
                waiting += len(h)
            if waiting >= _FLUSH:
                flush()
                waiting = 0
    flush()
    bits = (2 * ones > total[:, None]).reshape(len(texts), lanes * 8, 8)
    return np.packbits(bits, axis=2, bitorder="little").reshape(len(texts), lanes * 8).view(np.uint64)


def lane_names(lanes: int) -> list[str]:
    return [f"f{k}" for k in range(lanes)]


def fingerprint_rows(docs: DataFrame, *, words: int = 3, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, f0, f1, ...)``: the fingerprint of every row as signed 64-bit lanes."""
    bound_arrow_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    names = lane_names(lanes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints(batch.column(1).to_pylist(), words, lanes).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(fp[:, k]) for k in range(lanes))], names=["id", *names])

    kind = dict(slim.dtypes)["id"]
    return slim.mapInArrow(run, ", ".join([f"id {kind}", *(f"{n} long" for n in names)]))


def exact_tables(distinct: int, max_diff: int, most: int = 60) -> list[tuple[int, int]]:
    """Masks over 64 bits, as (mask, bits): each pair within max_diff agrees on at least one whole mask."""
    m = max_diff + 1
    while comb(m + 1, m + 1 - max_diff) <= most and 64 * (m - max_diff) / m < log2(max(2, distinct)) - 3:
        m += 1
    edges = [round(64 * k / m) for k in range(m + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(block[i] for i in pick) for pick in combinations(range(m), m - max_diff)]


def key_bytes(distinct: int) -> int:
    """Bytes of a sampled table's key, so that some 16 unrelated fingerprints share a bucket at most."""
    return max(2, ceil((log2(max(2, distinct)) - 4) / 8))


def sampled_tables(lanes: int, tables: int, width: int = 2) -> list[tuple[int, ...]]:
    """Byte positions of each table's key: distinct choices of ``width`` bytes, dealt evenly over all bytes."""
    rng, n, seen = np.random.default_rng(7), lanes * 8, []
    while len(seen) < tables:
        order = rng.permutation(n)
        for at in range(0, n - width + 1, width):
            pick = tuple(sorted(int(x) for x in order[at : at + width]))
            if pick not in seen and len(seen) < tables:
                seen.append(pick)
    return seen


def _keys(fp: np.ndarray, tables: list) -> np.ndarray:
    """``(tables, n)`` uint64 bucket keys."""
    if isinstance(tables[0], int):
        return np.stack([fp[:, 0] & np.uint64(m) for m in tables])
    raw = np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), -1).astype(np.uint64)
    return np.stack([sum(raw[:, p] << np.uint64(8 * k) for k, p in enumerate(pick)) for pick in tables])


def _schema(lanes: int) -> str:
    names = lane_names(lanes)
    return ", ".join(["kind int", "tbl int", "key long", *(f"{n} long" for n in names), *(f"to_{n} long" for n in names)])


def _search(limit: int, lanes: int, most: int | None):
    """Kernel over rows (tbl, key, [c0, c1], lanes...) that arrive bucket by bucket.

    Yields forest links as kind 0, and the rows of buckets beyond ``most`` as kind 1.
    """
    names = lane_names(lanes)
    out_names = ["kind", "tbl", "key", *names, *(f"to_{n}" for n in names)]

    def emit(kind: int, tbl, key, left, right) -> pa.RecordBatch:
        cols = [np.full(len(left), kind, np.int32), np.asarray(tbl, np.int32), np.asarray(key, np.int64)]
        cols += [left[:, k].view(np.int64) for k in range(lanes)] + [right[:, k].view(np.int64) for k in range(lanes)]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=out_names)

    def solve(ids: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        order = gray.gray_order(fp, *ids.T)
        ids, fp = ids[order], fp[order]
        bucket = np.cumsum(np.r_[False, (ids[1:] != ids[:-1]).any(axis=1)]) if len(ids) else np.empty(0, np.int64)
        label = gray.forest(len(fp), *gray.near_pairs(fp, bucket, limit))
        moved = np.flatnonzero(label != np.arange(len(fp)))
        moved = moved[(fp[moved] != fp[label[moved]]).any(axis=1)]
        return emit(0, ids[moved, 0], ids[moved, 1], fp[moved], fp[label[moved]]) if len(moved) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        count, spilling = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            width = batch.num_columns - lanes
            ids = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(width)], axis=1)
            fp = np.stack([batch.column(width + k).to_numpy().view(np.uint64) for k in range(lanes)], axis=1)
            if spilling is not None:  # the rest of a bucket that was found too large
                same = int(np.argmin((ids == spilling).all(axis=1))) if not (ids == spilling).all() else len(ids)
                if same:
                    yield emit(1, ids[:same, 0], ids[:same, 1], fp[:same], fp[:same])
                ids, fp = ids[same:], fp[same:]
                if not len(ids):
                    continue
                spilling = None
            kept.append((ids, fp))
            count += len(ids)
            if count < 40_000:
                continue
            ids, fp = np.concatenate([x for x, _ in kept]), np.concatenate([x for _, x in kept])
            new = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            last = int(new[-1]) if len(new) else 0
            yield from whole(ids[:last], fp[:last])
            ids, fp = ids[last:], fp[last:]
            if most is not None and len(ids) > most:
                spilling = ids[0]
                yield emit(1, ids[:, 0], ids[:, 1], fp, fp)
                ids, fp = ids[:0], fp[:0]
            kept, count = ([(ids, fp)], len(ids)) if len(ids) else ([], 0)
        if kept:
            yield from whole(np.concatenate([x for x, _ in kept]), np.concatenate([x for _, x in kept]))

    def whole(ids: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(ids):
            return
        if most is not None:
            start = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)])
            size = np.diff(np.r_[start, len(ids)])
            over = np.repeat(size > most, size)
            if over.any():
                yield emit(1, ids[over, 0], ids[over, 1], fp[over], fp[over])
                ids, fp = ids[~over], fp[~over]
        if (found := solve(ids, fp)) is not None:
            yield found

    return run


def near_links(distinct: DataFrame, *, lanes: int, max_diff: int, tables: list, bucket: int = BUCKET, settle: bool = True) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints (structs of lanes) whose transitive closure joins all near pairs of a bucket.

    Without ``settle`` a bucket that was set aside is searched in chunks that share leaders and no further, which suits
    candidates that have another way to meet.
    """
    names = lane_names(lanes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.stack([batch.column(k).to_numpy().view(np.uint64) for k in range(lanes)], axis=1)
            for t, key in enumerate(_keys(fp, tables)):
                cols = [pa.array(np.full(len(fp), t, np.int32)), pa.array(key.view(np.int64))]
                yield pa.RecordBatch.from_arrays([*cols, *batch.columns], names=["tbl", "key", *names])

    lanes_sql = ", ".join(f"{n} long" for n in names)
    rows = distinct.select(*names).mapInArrow(deal, f"tbl int, key long, {lanes_sql}")
    first = checkpointed(
        rows.repartition("tbl", "key").sortWithinPartitions("tbl", "key").mapInArrow(_search(max_diff, lanes, bucket), _schema(lanes))
    )
    links = first.where("kind = 0")
    links = links.select(F.struct(*names).alias("a"), F.struct(*(F.col(f"to_{n}").alias(n) for n in names)).alias("b"))
    late = first.where("kind = 1")
    if late.isEmpty():
        return links
    members = late.select("tbl", "key", *names, F.lit(1).alias("weight"), F.struct(*names).alias("node"))

    def search(dealt: DataFrame) -> DataFrame:
        by = ["tbl", "key", "c0", "c1"]
        found = dealt.select(*by, *names).repartition(*by).sortWithinPartitions(*by).mapInArrow(_search(max_diff, lanes, None), _schema(lanes))
        return found.select(F.struct(*names).alias("a"), F.struct(*(F.col(f"to_{n}").alias(n) for n in names)).alias("b"))

    return chunked_links(members, ["tbl", "key"], search, links, most=bucket, heaviest=bucket, settle=settle)[0]


def chunked_links(members: DataFrame, by: list[str], search: Callable[[DataFrame], DataFrame], links: DataFrame | None, *, most: int, heaviest: int, settle: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Links within groups of any size, and the components ``(node, component)`` of all links (None without ``settle``).

    ``members`` has the columns ``by``, ``node`` and ``weight`` (and what ``search`` reads); a group is dealt by hash into
    chunks of about ``most`` members and ``heaviest`` weight. ``search`` links the rows that share ``(*by, c0, c1)`` to a
    spanning forest of their near pairs. First every chunk is searched by itself, together with the group's leaders. What
    is then in the group's largest component need not be compared any more; the rest (usually nothing, or a few rows) is
    compared with every chunk. So no near pair is left unlinked, and the rows dealt grow with the group, not with its
    square, unless the group falls into many parts. Without ``settle`` the second step is left out.
    """
    sizes = members.groupBy(*by).agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    chunks = F.greatest(F.ceil(F.col("n") / F.lit(most)), F.ceil(F.col("w") / F.lit(heaviest))).cast("int")
    sizes = sizes.withColumn("chunks", F.greatest(chunks, F.lit(1))).withColumn("one_of", F.ceil(F.col("n") / F.lit(LEADERS)).cast("int"))
    large = checkpointed(sizes.where("chunks > 1").select(*by, "chunks", "one_of"))
    if large.isEmpty():
        placed = members.withColumn("chunks", F.lit(1)).withColumn("one_of", F.lit(None).cast("int"))
    else:
        placed = salted_join(members, large, by, F.col("node"), "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node", F.lit("chunk")), F.col("chunks")).cast("int"))
    alone = F.array(F.col("own"))
    leads = F.coalesce(F.pmod(F.xxhash64("node", F.lit("leader")), F.col("one_of")) == 0, F.lit(False))
    everywhere = F.sequence(F.lit(0), F.col("chunks") - 1)
    found = search(placed.withColumn("c0", F.explode(F.when(leads, everywhere).otherwise(alone))).withColumn("c1", F.lit(-1)))
    found = found if links is None else links.unionByName(found)
    if not settle:
        return found, None
    found = checkpointed(found)
    classes = connected_components(found, "a", "b")
    if large.isEmpty():
        return found, classes
    split = checkpointed(placed.where("chunks > 1").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node")))
    parts = split.groupBy(*by, "component").agg(F.count("*").alias("n"))
    top = parts.groupBy(*by).agg(F.max(F.struct("n", "component"))["component"].alias("top"), F.sum("n").alias("all"), F.max("n").alias("held"))
    top = checkpointed(top.where(F.col("all") > F.col("held")).withColumn("rests", F.ceil((F.col("all") - F.col("held")) / F.lit(most)).cast("int")).drop("all", "held"))
    if top.isEmpty():
        return found, classes
    split = salted_join(split, top, by, F.col("node"))
    rest_of = F.pmod(F.xxhash64("node", F.lit("rest")), F.col("rests")).cast("int")
    whole = split.withColumn("c1", F.col("own")).withColumn("c0", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)))
    rest = split.where("component != top").withColumn("c0", rest_of).withColumn("c1", F.explode(everywhere)).where("c1 != own")
    found = checkpointed(found.unionByName(search(whole.unionByName(rest))))
    return found, connected_components(found, "a", "b")


def near_duplicate_classes(
    docs: DataFrame,
    *,
    words: int = 3,
    lanes: int = 1,
    max_diff: int = 3,
    tables: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id, fp, component_id)`` for every row: ``component_id`` is the smallest id reachable over links.

    ``tables`` None asks for the exact tables (one lane only), else that many sampled ones.
    """
    names = lane_names(lanes)
    rows = checkpointed(fingerprint_rows(docs, words=words, lanes=lanes, id_col=id_col, text_col=text_col))
    distinct = checkpointed(rows.groupBy(*names).agg(F.min("id").alias("least_id")))
    picked = exact_tables(distinct.count(), max_diff) if tables is None else sampled_tables(lanes, tables)
    links = near_links(distinct, lanes=lanes, max_diff=max_diff, tables=picked)
    members = connected_components(links, "a", "b")
    nodes = distinct.select(F.struct(*names).alias("node"), "least_id")
    linked = checkpointed(nodes.join(members, "node"))
    least = linked.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = salted_join(linked, least, ["component"], F.col("node")).select("node", "component_id")
    single = nodes.join(members, "node", "left_anti").select("node", F.col("least_id").alias("component_id"))
    return rows.select("id", F.struct(*names).alias("fp")).join(
        named.unionByName(single).withColumnRenamed("node", "fp"), "fp"
    ).select("id", "fp", "component_id")


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _vertex(words: list[bytes]) -> int:
    """Number of a text in the candidate search (texts that share one by chance are but candidates)."""
    return xxhash.xxh64_intdigest(b" ".join(words), 7) - (1 << 63)


def shingle_set(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's words."""
    return np.unique(np.array(shingle_hashes(words, k), dtype=np.uint64))


def text_digest(text: Column) -> Column:
    """MD5 of a text (null counts as empty) as 16 bytes."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band: two sets of Jaccard J agree in a band with chance ``J ** BAND_ROWS``."""
    rng = np.random.default_rng(11)
    factor = rng.integers(0, 2**32, BANDS * BAND_ROWS, dtype=np.uint32) | np.uint32(1)
    mix = rng.integers(0, 2**63, (BANDS, BAND_ROWS), dtype=np.uint64) | np.uint64(1)
    least = np.full(BANDS * BAND_ROWS, 0xFFFFFFFF, np.uint32)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), 2048):
        np.minimum(least, np.multiply.outer(factor, high[at : at + 2048]).min(axis=1), out=least)
    key = (least.reshape(BANDS, BAND_ROWS).astype(np.uint64) * mix).sum(axis=1, dtype=np.uint64)
    return key ^ (key >> np.uint64(31))


def jaccard_forest(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Label of each set: the first one that it is joined to by links of at least ``similarity``, each decided exactly."""
    label = np.arange(len(sets))
    size = np.array([len(x) for x in sets], np.int64)
    flat, ids = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    cut = np.cumsum(size) - size
    mark = np.zeros(len(flat), bool)
    left = np.arange(len(sets))
    packed, entries, ends = left, ids, np.r_[0, np.cumsum(size)]
    while len(left):
        root, left = left[0], left[1:]
        waiting = [root]
        while waiting and len(left):
            if 2 * len(left) < len(packed):
                packed = left
                entries = np.concatenate([ids[cut[x] : cut[x] + size[x]] for x in left])
                ends = np.r_[0, np.cumsum(size[left])]
            one = waiting.pop()
            own = ids[cut[one] : cut[one] + size[one]]
            mark[own] = True
            common = np.diff(np.r_[0, np.cumsum(mark[entries])][ends])[np.searchsorted(packed, left)]
            mark[own] = False
            near = common * (1 + similarity) >= similarity * (size[left] + size[one]) - 1e-9
            label[left[near]] = root
            waiting.extend(left[near])
            left = left[~near]
    return label


def verified_classes(docs: DataFrame, *, words: int, lanes: int, max_diff: int, tables: int, similarity: float, id_col: str, text_col: str, bucket: int = BUCKET) -> DataFrame:
    """``(id, text_key, component_id, kept)`` of every row; texts are linked if the Jaccard similarity of their shingles is
    ``similarity`` or more.

    Hits of the SimHash tables and of MinHash bands are candidates only. Their closure gives groups of texts, and the texts
    of a group are compared exactly (by 64-bit hashes of the shingles), so a link is never wrong, and a near pair is lost
    only if it has neither a band, nor a table, nor a chain of candidates in common. ``text_key`` is the text's MD5; the row
    with the smallest id (null last) and key of a class is the one that is ``kept``, ids that repeat included.
    """
    bound_arrow_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).alias("id"), text_digest(text).alias("text_key"), text.alias("t"))
    names = lane_names(lanes)
    kind = dict(slim.dtypes)["id"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            fp = fingerprints(texts, words, lanes).view(np.int64)
            split = [_words(t) for t in texts]
            cols = [pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in split], pa.binary()), pa.array([_vertex(w) for w in split], pa.int64())]
            cols += [*(pa.array(fp[:, k]) for k in range(lanes)), pa.array([max(1, len(w)) for w in split], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *cols], names=["id", "text_key", "node", "v", *names, "weight"])

    signed = f"id {kind}, text_key binary, node binary, v long, {', '.join(f'{n} long' for n in names)}, weight long"
    rows = checkpointed(slim.mapInArrow(sign, signed))
    own = F.struct(F.col("id").isNull().alias("none"), "id", "text_key")
    nodes = checkpointed(rows.groupBy("node", "v", *names, "weight").agg(F.min(own).alias("least")))
    groups = _candidate_groups(slim, nodes, words, lanes, max_diff, tables)
    # a node stands under its least row, which no other node has; so a component is named by the row to keep
    members = checkpointed(nodes.select(F.col("least").alias("node"), "weight", "v").join(groups, "v").select("grp", "node", "weight"))
    # one row a text that is in a group: equal ones are combined before the shuffle
    wanted = sized(checkpointed(members.select("node.text_key")))
    texts = slim.join(wanted, "text_key", "left_semi").groupBy("text_key").agg(F.first("t").alias("t"))
    point = f"struct<none: boolean, id: {kind}, text_key: binary>"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, sets, point_type = None, [], [], None

        def links() -> pa.RecordBatch:
            label = jaccard_forest(sets, similarity)
            moved = [k for k in range(len(held)) if label[k] != k]
            ends = [[held[k] for k in moved], [held[label[k]] for k in moved]]
            return pa.RecordBatch.from_arrays([pa.array(e, point_type) for e in ends], names=["a", "b"])

        for batch in batches:
            point_type = batch.column(3).type
            for g, c0, c1, node, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, c0, c1) != at:
                    if len(held) > 1:
                        yield links()
                    at, held, sets = (g, c0, c1), [], []
                held.append(node)
                sets.append(shingle_set(_words(t), words))
        if len(held) > 1:
            yield links()

    def search(dealt: DataFrame) -> DataFrame:
        by = ["grp", "c0", "c1"]
        with_text = dealt.select(*by, "node", F.col("node.text_key").alias("text_key")).join(texts, "text_key").select(*by, "node", "t")
        return with_text.repartition(*by).sortWithinPartitions(*by, "node").mapInArrow(compare, f"a {point}, b {point}")

    _, classes = chunked_links(members, ["grp"], search, None, most=bucket, heaviest=CHUNK_SHINGLES)
    known = nodes.select("node", "least").join(classes.withColumnsRenamed({"node": "least", "component": "chosen"}), "least", "left")
    known = known.select("node", F.coalesce("chosen", "least").alias("chosen"))
    kept = F.col("id").eqNullSafe(F.col("chosen.id")) & (F.col("text_key") == F.col("chosen.text_key"))
    return rows.select("id", "text_key", "node").join(known, "node").select("id", "text_key", F.col("chosen.id").alias("component_id"), kept.alias("kept"))


def key_links(keyed: DataFrame, apart: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Links ``(a, b)`` from each vertex to the least vertex with the same key, for rows of ``(key long, v long)``.

    Rows stream by in order of key, so no group is held; the least vertex leads, so groups of the same vertices give the same
    links. ``apart`` tells for two successive vertices of a key whether the group falls into two between them.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # key, vertex and lead of the last row
        for batch in batches:
            if not batch.num_rows:
                continue
            key, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if held is not None:
                key, v = np.r_[held[0], key], np.r_[held[1], v]
            new = key[1:] != key[:-1]
            if apart is not None:
                new |= apart(v[:-1], v[1:])
            first = np.maximum.accumulate(np.where(np.r_[True, new], np.arange(len(key)), 0))
            lead = v[first]
            if held is not None:
                lead[first == 0] = held[2]
            moved = np.flatnonzero(v != lead)
            yield pa.RecordBatch.from_arrays([pa.array(v[moved]), pa.array(lead[moved])], names=["a", "b"])
            held = key[-1], v[-1], lead[-1]

    return keyed.select("key", "v").repartition("key").sortWithinPartitions("key", "v").mapInArrow(runs, "a long, b long")


def grouped(links: DataFrame) -> DataFrame:
    """``(v, grp)`` of the vertices of links ``(a, b)`` from a vertex to leads of its groups (one a key at most).

    All leads of a vertex are linked to the least of them, which leaves about one edge a vertex to contract.
    """
    ends = links.groupBy("a").agg(F.collect_set("b").alias("ends")).withColumn("top", F.array_min("ends"))
    edges = ends.select("top", F.explode(F.concat(F.array("a"), "ends")).alias("b")).where("top != b")
    return connected_components(edges, "top", "b").withColumnsRenamed({"node": "v", "component": "grp"})


def _candidate_groups(slim: DataFrame, nodes: DataFrame, words: int, lanes: int, max_diff: int, tables: int) -> DataFrame:
    """``(v, grp)`` of the nodes that share a fingerprint, a near fingerprint or a MinHash band with another one."""
    names = lane_names(lanes)

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_words(t) for t in batch.column(0).to_pylist()]
            keys = np.concatenate([band_keys(shingle_set(w, words)) for w in texts] or [np.empty(0, np.uint64)])
            v = np.repeat(np.array([_vertex(w) for w in texts], np.int64), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(v)], names=["key", "v"])

    prints = checkpointed(nodes.groupBy(*names).agg(F.min("v").alias("lead")))
    same = nodes.join(prints, names).select(F.col("v").alias("a"), F.col("lead").alias("b")).where("a != b")
    picked = sampled_tables(lanes, tables, key_bytes(prints.count()))
    hits = near_links(prints, lanes=lanes, max_diff=max_diff, tables=picked, settle=False)
    named = prints.select(F.struct(*names).alias("fp"), "lead")
    tabled = hits.join(named.withColumnsRenamed({"fp": "a", "lead": "va"}), "a").join(named.withColumnsRenamed({"fp": "b", "lead": "vb"}), "b").select(F.col("va").alias("a"), F.col("vb").alias("b"))
    return grouped(same.unionByName(tabled).unionByName(key_links(slim.select("t").mapInArrow(band, "key long, v long"))))


def drop_near_duplicates(docs: DataFrame, *, words: int = 5, lanes: int = 4, max_diff: int = 48, tables: int = 48, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep one row (the smallest id, null last) of each class of near-duplicates; the columns are those of ``docs``.

    Near-duplicates are texts whose five-word shingles have a Jaccard similarity of 0.8 or more, verified for every link.
    Rows are told apart by id and text, so rows of one id with different texts are judged each for itself; rows equal in
    both are reduced to one.
    """
    classes = verified_classes(docs, words=words, lanes=lanes, max_diff=max_diff, tables=tables, similarity=similarity, id_col=id_col, text_col=text_col)
    classes = checkpointed(classes)
    key, text_key = fresh_name(docs, "near_id"), fresh_name(docs, "near_text")
    row = [F.col("id").alias(key), F.col("text_key").alias(text_key)]
    own = text_digest(F.col(text_col).cast("string"))
    gone = sized(checkpointed(classes.where("not kept").select(*row).distinct()))
    repeated = classes.where("kept").groupBy("id", "text_key").count().where("count > 1").select(*row)
    fits = lambda left: left[id_col].eqNullSafe(F.col(key)) & (own == F.col(text_key))
    kept = docs.join(gone, fits(docs), "left_anti")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, fits(kept), "left_anti")
    again = kept.join(repeated, fits(kept), "left_semi").dropDuplicates([id_col, text_col])
    return once.unionByName(again)
