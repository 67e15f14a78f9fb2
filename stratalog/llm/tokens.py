"""Token counts with offset-mapped attribution.

A document is encoded once, as a whole. The bytes of its tokens give each token's span of characters, and an interval join
inside the document (by binary search over sorted starts) hands the tokens to the sections of the text. A token that
crosses a boundary is allocated by an explicit rule:

* ``start``: to the section that holds its first character;
* ``most``: to the section that holds most of its characters, the earlier one of equals;
* ``split``: to each section by the share of its characters (counts are then fractions).

Tokens outside all sections are counted in the section named null. A byte-level token may end inside a character; that
character belongs to the token that holds its first byte, and a token without any first byte to the character it continues.

Defined results: a null or empty text has one section, of no characters and no tokens, if sections are derived from lines;
repeated rows are repeated; an empty table gives an empty result; extra columns are not read. Special tokens' strings are
ordinary text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow_batches, process_cache

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "most", "split")
#: White space as the pattern's ``\\s`` has it, in runs that are too long for the pattern's backtracking.
LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{100000,}")


class Encoder:
    """Byte-level BPE whose tokens know their length in bytes."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values(), default=0) + 1, dtype=np.int64)
        self.length[list(ranks.values())] = [len(k) for k in ranks]

    def _encode(self, text: str) -> np.ndarray:
        """Token numbers of the text.

        The pattern always cuts where a run of white space begins and before its last character if something follows, so a
        long run is taken out there and merged as the one piece that it is.
        """
        parts, at = [], 0
        for run in LONG_BLANK.finditer(text):
            end = run.end() - (run.end() < len(text))
            parts.append(self.encoding.encode_to_numpy(text[at : run.start()], disallowed_special=()))
            parts.append(np.array(self.encoding._core_bpe.encode_single_piece(text[run.start() : end].encode()), np.uint32))
            at = end
        parts.append(self.encoding.encode_to_numpy(text[at:], disallowed_special=()))
        return np.concatenate(parts).astype(np.int64)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and end character of each token of the text."""
        text = text.encode("utf-8", "replace").decode("utf-8")
        ids = self._encode(text)
        ends = np.cumsum(self.length[ids])
        starts = ends - self.length[ids]
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        if len(raw) == len(text):
            return starts, ends
        first = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]  # first bytes before each byte
        start, end = first[starts], first[ends]
        return np.where(start == end, np.maximum(start - 1, 0), start), end


def shared_encoder(vocabulary: bytes) -> Encoder:
    """One encoder a process and vocabulary."""
    cache = process_cache()
    key = "encoder", hash(vocabulary)
    if key not in cache:
        cache[key] = Encoder(vocabulary)
    return cache[key]


def allocate(token_start: np.ndarray, token_end: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens of each section, tokens that cross a boundary of it, and tokens outside all.

    Sections are sorted and don't overlap; both sides are intervals of characters, ends exclusive.
    """
    counts, crossing = np.zeros(len(start)), np.zeros(len(start), dtype=np.int64)
    if not len(start):
        return counts, crossing, float(len(token_start))
    low = np.searchsorted(end, token_start, "right")  # first section that ends after the token begins
    high = np.searchsorted(start, np.maximum(token_end, token_start + 1), "left")  # sections that begin before it ends
    inside = (high - low == 1) & (start[np.minimum(low, len(start) - 1)] <= token_start) & (token_end <= end[np.minimum(low, len(start) - 1)])
    counts += np.bincount(low[inside], minlength=len(start))
    outside = float((high <= low).sum())
    for t in np.flatnonzero(~inside & (high > low)):
        a, b = int(token_start[t]), max(int(token_end[t]), int(token_start[t]) + 1)
        share = [(min(b, int(end[s])) - max(a, int(start[s])), s) for s in range(int(low[t]), int(high[t]))]
        for _, s in share:
            crossing[s] += 1
        if rule == "start":
            s = int(low[t])
            if start[s] <= a:
                counts[s] += 1
            else:
                outside += 1
        elif rule == "most":
            free = b - a - sum(n for n, _ in share)
            n, s = max(share, key=lambda x: (x[0], -x[1]))
            if n >= free:
                counts[s] += 1
            else:
                outside += 1
        else:
            for n, s in share:
                counts[s] += n / (b - a)
            outside += (b - a - sum(n for n, _ in share)) / (b - a)
    return counts, crossing, outside


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines with their line feeds: they cover the text without gaps."""
    ends = np.array([m.end() for m in re.finditer("\n", text)], dtype=np.int64)
    if not len(ends) or ends[-1] != len(text):
        ends = np.r_[ends, len(text)]
    return np.r_[0, ends[:-1]], ends


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, rule: str = "start", vocabulary_path: str = VOCABULARY) -> DataFrame:
    """``(id, section, name, char_start, char_end, tokens, crossing, document_tokens)``, one row a section.

    Sections are the column ``sections_col`` (array of struct<name, start, end>, in characters; sorted here, and they must
    not overlap), else the lines. Tokens outside all given sections are a row with a null section.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    bound_arrow_batches(docs.sparkSession)
    with open(vocabulary_path, "rb") as f:  # a vocabulary of fixed size, read where the query is built
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    cols = [F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")]
    if sections_col:
        cols.append(F.to_json(sections_col).alias("s"))
    slim = docs.select(*cols)
    id_kind = dict(slim.dtypes)["id"]
    names = ["id", "section", "name", "char_start", "char_end", "tokens", "crossing", "document_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        encoder = shared_encoder(shared.value)
        for batch in batches:
            row, section, label, start, end, tokens, crossing, whole = ([] for _ in range(8))
            given = batch.column(2).to_pylist() if sections_col else [None] * batch.num_rows
            for i, (text, own) in enumerate(zip(batch.column(1).to_pylist(), given, strict=True)):
                text = text or ""
                a, b = encoder.spans(text)
                if sections_col:
                    parts = sorted((x["start"], x["end"], x.get("name")) for x in json.loads(own or "[]"))
                    s, e = np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64)
                    titles = [p[2] for p in parts]
                else:
                    s, e = line_sections(text)
                    titles = [None] * len(s)
                counts, crossed, outside = allocate(a, b, s, e, rule)
                n = len(s)
                row += [i] * n
                section += range(n)
                label += titles
                start += s.tolist()
                end += e.tolist()
                tokens += counts.tolist()
                crossing += crossed.tolist()
                whole += [len(a)] * n
                if sections_col and outside:
                    row.append(i)
                    section.append(None)
                    label.append(None)
                    start.append(None)
                    end.append(None)
                    tokens.append(outside)
                    crossing.append(0)
                    whole.append(len(a))
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            arrays = [pa.array(x, k) for x, k in zip((section, label, start, end, tokens, crossing, whole), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *arrays], names=names)

    return slim.mapInArrow(run, f"id {id_kind}, section int, name string, char_start long, char_end long, tokens double, crossing long, document_tokens long")
