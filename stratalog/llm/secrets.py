"""Secret scan with corpus-wide ownership frequency.

Three base kinds are found by pattern in the whole text. Their values, and further credential-shaped strings that stand
without a keyword, are candidates; hashes of the candidates are aggregated over the corpus by distinct repository and
owner. A value seen under few owners, and in few repositories of theirs, is owner-specific and looks live; one that many
owners share, or that stands in many repositories (an owner's template or vendored copy), is a copied example.
The method adds the spans of credential-shaped strings that are owner-specific (kind ``owned``); base spans stay whatever
their frequency, with a verdict of their own.

A repository is the ``source`` column; its owner is the part before the first ``/``, the whole where there is none. A
null source is one repository of an unnamed owner.

Defined results: a null text is empty and gives no span; repeated rows are repeated and count as one repository; an empty
table gives an empty result; extra columns are not read. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow_batches, checkpointed, salted_join

KINDS = ("assign", "access", "hex")
OWNED = "owned"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_HINT = re.compile(rb"(?:passw|secret|token|api)", re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A value under at most this many owners is owner-specific.
MAX_OWNERS = 2
#: ... and in at most this many repositories.
MAX_REPOSITORIES = 5
_IS_HEX = np.zeros(256, dtype=bool)
_IS_HEX[[*b"0123456789abcdef"]] = True
_IS_SHAPED = np.zeros(256, dtype=bool)
_IS_SHAPED[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True


def _runs(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of True of at least that length."""
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    edge = np.r_[0, edge, len(mask)] if len(mask) else np.zeros(1, np.int64)
    start, end = edge[:-1], edge[1:]
    keep = (end - start >= least) & mask[start] if len(start) else np.zeros(0, bool)
    return list(zip(start[keep].tolist(), end[keep].tolist(), strict=True))


def looks_random(value: str) -> bool:
    """Letters and digits mixed as in a generated credential: several digits, several letters, few repeats."""
    digits = sum(c.isdigit() for c in value)
    letters = sum(c.isalpha() for c in value)
    return digits >= 4 and letters >= 4 and len(set(value)) >= 10


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, str, int]]:
    """``(start, kind number, value, end)`` of the base kinds by start and kind; ``raw`` is the text in UTF-8."""
    found = []
    if ASSIGN_HINT.search(raw):
        found += [(m.start(), 0, m[2], m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m[0], m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    codes = np.frombuffer(raw, np.uint8)
    for a, b in _runs(_IS_HEX[codes], 24):
        start = a if len(raw) == len(text) else len(raw[:a].decode("utf-8", "surrogatepass"))
        found.append((start, 2, text[start : start + b - a], start + b - a))
    return sorted(found)


def shaped_spans(text: str, raw: bytes, taken: list[tuple[int, int]]) -> list[tuple[int, str, int]]:
    """Credential-shaped strings that overlap no base span."""
    out = []
    for a, b in _runs(_IS_SHAPED[np.frombuffer(raw, np.uint8)], 20):
        start = a if len(raw) == len(text) else len(raw[:a].decode("utf-8", "surrogatepass"))
        end = start + b - a
        value = text[start:end]
        if looks_random(value) and not any(s < end and start < e for s, e in taken):
            out.append((start, value, end))
    return out


SPAN = "start: int, end: int, kind: string, value_hash: bigint"


def candidate_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(row, id, repository, owner, spans)`` for every row; spans by start and kind, values only as hashes."""
    bound_arrow_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("repository"), F.col(text_col).cast("string").alias("t"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value_hash", pa.int64())]))

    def hashed(value: str) -> int:
        return xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass"), 0) - (1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                text = text or ""
                raw = text.encode("utf-8", "surrogatepass")
                base = base_spans(text, raw)
                spans = [{"start": s, "end": e, "kind": KINDS[k], "value_hash": hashed(v)} for s, k, v, e in base]
                more = shaped_spans(text, raw, [(s, e) for s, _, _, e in base])
                rows.append(spans + [{"start": s, "end": e, "kind": OWNED, "value_hash": hashed(v)} for s, v, e in more])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, kind)], names=["id", "repository", "spans"])

    id_kind = dict(slim.dtypes)["id"]
    return slim.mapInArrow(run, f"id {id_kind}, repository string, spans array<struct<{SPAN}>>")


def ownership(rows: DataFrame) -> DataFrame:
    """``(value_hash, owners, repositories, spans)`` of every candidate; distinct pairs are combined before the shuffle."""
    owner = F.coalesce(F.substring_index("repository", "/", 1), F.lit(""))
    pairs = rows.select(F.explode("spans").alias("s"), F.coalesce("repository", F.lit("")).alias("repository"), owner.alias("owner"))
    return (
        pairs.groupBy(F.col("s.value_hash").alias("value_hash"), "repository", "owner").agg(F.count("*").alias("n"))
        .groupBy("value_hash")
        .agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repository").alias("repositories"), F.sum("n").alias("spans"))
    )


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """``(id, spans)`` for every row: base and owned spans in order, each ``(start, end, kind, verdict, owners, repositories)``.

    ``verdict`` is live where the value is owner-specific, else example. Only rows with candidates are joined, and a value
    that a third of all rows hold is dealt over several tasks.
    """
    rows = checkpointed(candidate_spans(docs, id_col=id_col, text_col=text_col, source_col=source_col).withColumn("row", F.monotonically_increasing_id()))
    # a value of one span has one owner: only the others are joined
    counted = ownership(rows).where("spans > 1").drop("spans")
    held = rows.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    known = salted_join(held, counted, ["value_hash"], F.col("row"), "left")
    known = known.withColumn("owners", F.coalesce("owners", F.lit(1).cast("long"))).withColumn("repositories", F.coalesce("repositories", F.lit(1).cast("long")))
    example = (F.col("owners") > max_owners) | (F.col("repositories") > max_repositories)
    spans = known.withColumn("verdict", F.when(example, F.lit("example")).otherwise(F.lit("live"))).where((F.col("kind") != OWNED) | (F.col("verdict") == "live"))
    rank = F.array_position(F.array(*(F.lit(k) for k in (*KINDS, OWNED))), F.col("kind"))
    listed = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind", "verdict", "owners", "repositories"))).alias("found"))
    return rows.select("row", "id").join(listed, "row", "left").select("id", F.coalesce("found", F.array()).alias("spans"))
