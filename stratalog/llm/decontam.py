"""Benchmark decontamination: size-partitioned MinHash containment search for short test items inside long documents.

Items are partitioned by size (words of a shingle, and the power of two of their number of distinct shingles). An item of n
shingles that a document must hold to the share t has a bottom-k MinHash sketch with k = n - ceil(t n) + 1: such a document
misses k - 1 of its shingles at most, so it holds at least one of the sketch. A partition's threshold is the greatest hash
in its items' sketches; a document's sketch for that partition is all of its shingle hashes up to the threshold (a scaled
MinHash, whose size follows the document's), so the two sketches have a hash in common wherever an item is contained and no
match is lost, however much longer the document is. A document is sketched only for partitions whose smallest item it has
words for.

Sketches of items and documents meet by equi-join; nothing of the items is gathered but one threshold a partition and two
Bloom filters of at most :data:`BLOOM_BITS` bits, by which the documents' sketches drop hashes that no item has before they
are shuffled. A candidate is verified by counting the item's distinct shingles, compared as bytes, in the document. A text
is read once.

Shingles are runs of five words (lower-cased A-Z, split at white space); an item of fewer words is one shingle of all of
them.

Defined results: null or blank texts match nothing, on either side; repeated rows are repeated; an empty side gives an
empty result; extra columns are not read, and :func:`drop_contaminated` passes them on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow_batches, checkpointed, fresh_name, salted_join, sized

WIDTH = 5
THRESHOLD = 0.8
#: Most bits of a Bloom filter (16 MB); beyond the hashes that fill it, more of the documents' sketches are shuffled.
BLOOM_BITS = 1 << 27
_PROBES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
#: Words of documents that are hashed at once.
_GROUP = 400_000


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(x) for x in zip(*(words[i:] for i in range(width)), strict=False)}


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, from the words' hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = (h ^ words[k : k + n]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def size_class(shingles: int, width: int) -> int:
    return width * 64 + shingles.bit_length()


@dataclass(frozen=True)
class Bloom:
    bits: np.ndarray  # uint64 words

    @staticmethod
    def places(h: np.ndarray, salt: int, bits: int) -> list[np.ndarray]:
        """Bit positions of hashes; ``salt`` tells partitions apart."""
        x = h ^ np.uint64(salt * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)
        return [(x * np.uint64(p) >> np.uint64(37)) & np.uint64(bits - 1) for p in _PROBES]

    def holds(self, h: np.ndarray, salt: int) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in self.places(h, salt, len(self.bits) * 64):
            out &= (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def _item_rows(items: DataFrame, item_id: str, item_text: str, threshold: float, width: int) -> DataFrame:
    """``(item, item_id, n, need, width, cls, sketch, shingles, hashes)`` of the items that have words."""
    slim = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("t"))
    kind = dict(slim.dtypes)["item_id"]
    names = ["item", "item_id", "n", "need", "width", "cls", "sketch", "shingles", "hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kept = [], []
            for at, text in enumerate(batch.column(2).to_pylist()):
                words = tokens(text)
                if not words:
                    continue
                w = min(width, len(words))
                shingles = sorted(shingle_set(words, w))
                own = [int(shingle_hashes(word_hashes(s.split()), w)[0]) for s in shingles]
                n = len(shingles)
                need = max(1, ceil(threshold * n - 1e-9))
                signed = np.array(own, np.uint64).view(np.int64).tolist()
                sketch = np.sort(np.array(own, np.uint64))[: n - need + 1].view(np.int64).tolist()
                kept.append(at)
                rows.append((n, need, w, size_class(n, w), sketch, shingles, signed))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64())]
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(kept, pa.int64())) for k in (0, 1)), *cols], names=names)

    return slim.mapInArrow(run, f"item long, item_id {kind}, n long, need long, width int, cls int, sketch array<long>, shingles array<binary>, hashes array<long>")


def _bloom(hashes: DataFrame, count: int) -> Bloom:
    """Filter over rows of ``(h, salt)``; the words of the filter are combined on the executors."""
    bits = 1 << 10
    while bits < min(BLOOM_BITS, 16 * count):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, salt = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            at = np.concatenate([p for s in np.unique(salt) for p in Bloom.places(h[salt == s], int(s), bits)] or [np.empty(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["place", "bit"])

    table = hashes.mapInArrow(run, "place int, bit long").groupBy("place").agg(F.bit_or("bit").alias("word")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[table["place"].to_numpy()] = table["word"].to_numpy().view(np.uint64)
    return Bloom(out)


def _contained(slim: DataFrame, items: DataFrame, threshold: float, width: int, item_id: str, item_text: str) -> DataFrame | None:
    """``(row, <columns of slim but the last>, item_id, shingles, item_shingles)``; the last column of ``slim`` is the text."""
    spark = slim.sparkSession
    bound_arrow_batches(spark)
    known = checkpointed(_item_rows(items, item_id, item_text, threshold, width))
    partitions = (
        known.groupBy("cls", "width")  # at most 64 sizes a width
        .agg(F.min(F.col("need") + F.col("width") - 1).alias("fewest"), F.max(F.array_max(F.transform("sketch", _unsigned))).alias("limit"),
             F.sum(F.size("sketch")).alias("sketched"), F.sum(F.size("hashes")).alias("hashed"))
        .collect()
    )
    if not partitions:
        return None
    sketches = _bloom(known.select(F.explode("sketch").alias("h"), F.col("cls").alias("salt")), sum(p["sketched"] for p in partitions))
    shingles = _bloom(known.select(F.explode("hashes").alias("h"), F.col("width").alias("salt")), sum(p["hashed"] for p in partitions))
    plan = sorted((p["width"], p["cls"], p["fewest"], (p["limit"] + (1 << 63)) & 0xFFFFFFFFFFFFFFFF) for p in partitions)
    shared = spark.sparkContext.broadcast((plan, sketches, shingles))
    *keep, text = slim.columns
    names = ["row", *keep, "sketch", "held"]
    sketch_kind = pa.list_(pa.struct([("cls", pa.int32()), ("h", pa.int64())]))
    held_kind = pa.list_(pa.struct([("width", pa.int32()), ("s", pa.binary())]))

    def search(texts: list[list[bytes]]) -> dict[int, tuple[list, list]]:
        """Sketch hashes and item shingles of the documents that hold any, by place in the group."""
        plan, sketches, shingles = shared.value
        size = np.array([len(w) for w in texts], np.int64)
        of = np.repeat(np.arange(len(texts)), size)
        words = [w for text in texts for w in text]
        flat = word_hashes(words)
        hashes = {w: shingle_hashes(flat, w) for w in {p[0] for p in plan}}
        inside = {w: of[: len(h)] == of[w - 1 : w - 1 + len(h)] for w, h in hashes.items()}
        found: dict[int, tuple[list, list]] = {}
        for w, cls, fewest, limit in plan:
            at = np.flatnonzero((hashes[w] <= np.uint64(limit)) & inside[w])
            at = at[size[of[at]] >= fewest]
            at = at[sketches.holds(hashes[w][at], cls)]
            for doc, h in set(zip(of[at].tolist(), hashes[w][at].view(np.int64).tolist(), strict=True)):
                found.setdefault(doc, ([], []))[0].append({"cls": cls, "h": h})
        if found:
            wanted = np.isin(of, list(found))
            for w, h in hashes.items():
                at = np.flatnonzero(inside[w] & wanted[: len(h)])
                at = at[shingles.holds(h[at], w)]
                for doc, s in {(d, b" ".join(words[k : k + w])) for d, k in zip(of[at].tolist(), at.tolist(), strict=True)}:
                    found[doc][1].append({"width": w, "s": s})
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, group, first, count = [], [], 0, 0
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for at, text in enumerate(texts):
                group.append(tokens(text))
                count += len(group[-1])
                if count >= _GROUP or at == len(texts) - 1:
                    rows += [(first + k, *x) for k, x in sorted(search(group).items())]
                    group, first, count = [], at + 1, 0
            take = pa.array([r[0] for r in rows], pa.int64())
            cols = [batch.column(k).take(take) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([r[1] for r in rows], sketch_kind), pa.array([r[2] for r in rows], held_kind)], names=names)

    kinds = dict(slim.dtypes)
    schema = ", ".join(["row long", *(f"{c} {kinds[c]}" for c in keep), "sketch array<struct<cls: int, h: long>>", "held array<struct<width: int, s: binary>>"])
    numbered = slim.where(F.col(text).isNotNull()).select(F.monotonically_increasing_id().alias("row"), *keep, text)
    hits = checkpointed(numbered.mapInArrow(run, schema))
    # a hash or shingle that a third of the documents hold is dealt over several tasks; the items' side is the small one
    of_sketch = known.select("item", "cls", F.explode("sketch").alias("h"))
    candidates = salted_join(hits.select("row", F.explode("sketch").alias("x")).select("row", "x.*"), of_sketch, ["cls", "h"], F.col("row")).select("row", "item").distinct()
    of_item = known.select("item", "width", F.explode("shingles").alias("s"))
    held = hits.select("row", F.explode("held").alias("x")).select("row", "x.*")
    counted = (
        salted_join(held, of_item, ["width", "s"], F.col("row")).join(candidates, ["row", "item"], "left_semi")
        .groupBy("row", "item").agg(F.count("*").alias("shingles"))
    )
    verified = salted_join(counted, known.select("item", "item_id", "n", "need"), ["item"], F.col("row")).where("shingles >= need")
    return verified.select("row", "item_id", "shingles", F.col("n").alias("item_shingles")).join(hits.select("row", *keep), "row")


def _unsigned(h: Column) -> Column:
    """Order of unsigned hashes as signed longs."""
    return h.bitwiseXOR(F.lit(-(1 << 63)))


def contaminated_pairs(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """``(doc_id, item_id, shingles, item_shingles, containment)`` of every document that holds an item."""
    slim = docs.select(F.col(doc_id).alias("doc"), F.col(text_col).cast("string").alias("t"))
    found = _contained(slim, items, threshold, width, item_id, item_text)
    if found is None:
        kinds = dict(slim.dtypes)["doc"], dict(items.dtypes)[item_id]
        return docs.sparkSession.createDataFrame([], f"doc_id {kinds[0]}, item_id {kinds[1]}, shingles long, item_shingles long, containment double")
    return found.select(F.col("doc").alias("doc_id"), "item_id", "shingles", "item_shingles", (F.col("shingles") / F.col("item_shingles")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """Rows that hold no item; the columns are those of ``docs``. Texts that hold one are told by their MD5."""
    own = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    found = _contained(docs.select(own.alias("text_key"), F.col(text_col).cast("string").alias("t")), items, threshold, width, item_id, item_text)
    if found is None:
        return docs
    key = fresh_name(docs, "hit_text")
    return docs.join(sized(checkpointed(found.select(F.col("text_key").alias(key)).distinct())), own == F.col(key), "left_anti")


DECONTAM_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
bs AS (
  SELECT DISTINCT item_id, least(5, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) AS s
  FROM bw WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
ks AS (SELECT DISTINCT k FROM bs),
ds AS (
  SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM dw, ks WHERE len(w) >= k)
SELECT doc_id, item_id, count(*)::BIGINT AS shingles, n.n::BIGINT AS item_shingles, count(*)::DOUBLE / n.n AS containment
FROM ds JOIN bs USING (k, s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n.n HAVING count(*) >= ceil(0.8 * n.n - 1e-9)
"""
