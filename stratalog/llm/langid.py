"""Language identification of mixed-language text.

Words are maximal runs of letters. The script of a word's letters (Unicode ranges) narrows the candidate languages to
those that training text wrote in that script; each candidate scores the word by hashed character n-grams, and a
Viterbi pass over the words of the whole text, with a penalty for each switch, labels spans of one language. The
document's language is the one whose spans hold most letters.

The model is fitted on a bounded sample of labelled rows: at most about ``sample_per_lang`` distinct texts a language
(chosen by a hash of the text; everything where a language has fewer). Prediction reads the whole text of every row.

Defined results: a null text and one without any letter give ``und`` with score 0; with no labelled rows at all, so
does every text. Ties go to the language first in code point order. Repeated rows are repeated; an empty table gives an
empty result; extra columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow_batches, process_cache

UNDETERMINED = "und"
BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
#: First code point of each script range; letters between two starts belong to the earlier one.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "lao"),
    (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"),
)
SCRIPT_NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))
_PIECE = 400_000
_GROUP = 8_000_000


@dataclass(frozen=True)
class LanguageModel:
    """Languages in code point order, log-probabilities of n-gram buckets, and which scripts each language writes."""

    languages: tuple[str, ...]
    weights: np.ndarray  # (BUCKETS + 1, languages) float32; the last row is zero
    allowed: np.ndarray  # (scripts, languages) bool
    switch_penalty: float = 8.0


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over all code points: is it a letter, its lower case, its script."""
    cache = process_cache()
    if "letters" not in cache:
        chars = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000)]
        letter = np.fromiter((c.isalpha() for c in chars), bool, len(chars))
        low = np.arange(len(chars), dtype=np.uint32)
        for c in np.flatnonzero(letter):
            x = chars[c].lower()
            if len(x) == 1:
                low[c] = ord(x)
        starts = np.array([s for s, _ in SCRIPTS])
        ids = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS], dtype=np.uint8)
        cache["letters"] = letter, low, ids[np.searchsorted(starts, np.arange(len(chars)), "right") - 1]
    return cache["letters"]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class _Words:
    """Letters of a text with a 0 before, between and after words, and the n-grams over them."""

    def __init__(self, codes: np.ndarray) -> None:
        letter, low, script = _tables()
        codes = np.minimum(codes, 0x10FFFF)
        is_letter = letter[codes]
        begin = is_letter & ~np.r_[False, is_letter[:-1]]
        at = np.flatnonzero(is_letter)
        self.word = np.cumsum(begin)[at] - 1
        self.count = int(begin.sum())
        self.start = np.flatnonzero(begin)
        self.letters = np.bincount(self.word, minlength=self.count)
        padded = np.zeros(len(at) + self.count + 1, dtype=np.uint64)
        self.place = np.arange(len(at)) + self.word + 1
        padded[self.place] = low[codes[at]]
        self.padded = padded
        self.script = script[codes[at]]

    def grams(self) -> Iterator[np.ndarray]:
        """Bucket of the n-gram around each place of ``padded``, ``BUCKETS`` where there is none.

        A word's edges count as characters. An n-gram stands at its second place, which is a letter of its word
        (n = 2: at its first, which may be the edge before the word).
        """
        filled = self.padded != 0
        h = self.padded
        for n in range(2, max(ORDERS) + 1):
            m = len(self.padded) - n + 1
            if m <= 0:
                h = h[:0]
            else:
                h = h[:m] * np.uint64(0x100000001B3) + self.padded[n - 1 :]
            if n not in ORDERS:
                continue
            out = np.full(len(self.padded), BUCKETS, dtype=np.int32)
            if m > 0:
                ok = filled[:m] | filled[1 : m + 1] if n == 2 else filled[1 : m + 1].copy()
                for k in range(2, n - 1):
                    ok &= filled[k : k + m]
                at = 0 if n == 2 else 1
                np.copyto(out[at : at + m], (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int32), where=ok)
            yield out


def _pieces(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """A long text in parts that end between words where there is such a place."""
    letter, _, _ = _tables()
    at = 0
    while at < len(codes):
        end = min(at + _PIECE, len(codes))
        if end < len(codes):
            gaps = np.flatnonzero(~letter[np.minimum(codes[at:end], 0x10FFFF)])
            end = at + int(gaps[-1]) + 1 if len(gaps) else end
        yield at, codes[at:end]
        at = end


def _row_max(x: np.ndarray) -> np.ndarray:
    """Greatest of each row; by columns, which is faster than a reduction for few of them."""
    return reduce(np.maximum, x.T) if x.shape[1] else np.zeros(len(x), x.dtype)


def word_scores(model: LanguageModel, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word: its first character, its letters, and its score for each language."""
    starts, letters, scores = [], [], []
    for base, codes in _pieces(_codes(text)):
        w = _Words(codes)
        if not w.count:
            continue
        total = sum(np.take(model.weights, bucket, axis=0) for bucket in w.grams())
        # an edge's place belongs to the word after it; the last edge starts no word
        total = np.add.reduceat(total[:-1], w.place[np.r_[True, w.word[1:] != w.word[:-1]]] - 1, axis=0)
        script = np.zeros((w.count, len(SCRIPT_NAMES)), dtype=np.float32)
        script[w.word, w.script] = 1
        candidate = script @ model.allowed.astype(np.float32) > 0
        known = _row_max(candidate)
        total -= _row_max(total)[:, None]
        np.maximum(total, -30.0, out=total)
        total[~candidate] = -60.0
        total[~known] = 0
        starts.append(w.start + base)
        letters.append(w.letters)
        scores.append(total.astype(np.float32))
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, len(model.languages)), np.float32)
    return np.concatenate(starts), np.concatenate(letters), np.concatenate(scores)


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best label of each word of each text: sum of scores less a penalty for each switch; all texts step together.

    Ties stay in the same language, then go to the first one.
    """
    size = np.array([len(s) for s in scores], dtype=np.int64)
    order = np.argsort(-size, kind="stable")
    live = [int(k) for k in order if size[k]]
    out = [np.empty(0, np.int64)] * len(scores)
    if not live:
        return out
    n = size[live]
    steps = np.arange(int(n[0]))
    active = np.searchsorted(-n, -steps, "left")  # texts that have a word at each step; they are the first ones
    begin = np.cumsum(active) - active
    where = [begin[: n[i]] + i for i in range(len(live))]  # words by step, then by text
    score = np.empty((int(n.sum()), scores[live[0]].shape[1]), np.float32)
    for i, k in enumerate(live):
        score[where[i]] = scores[k]
    best = score[: active[0]]
    floor = np.float32(-penalty)
    for at, k in zip(begin[1:].tolist(), active[1:].tolist(), strict=True):
        best = best[:k]
        row = score[at : at + k]
        row += np.maximum(best - best.max(axis=1, keepdims=True), floor)
        best = row
    top = score.argmax(axis=1)
    stay = score >= (_row_max(score) + floor)[:, None]
    label = np.empty(len(score), np.int64)
    now = np.empty(len(live), np.int64)
    held = 0
    for at, k in zip(begin[::-1].tolist(), active[::-1].tolist(), strict=True):
        ends = top[at : at + k].copy()
        if held:
            ends[:held] = np.where(stay[at : at + held][np.arange(held), now[:held]], now[:held], ends[:held])
        now[:k] = label[at : at + k] = ends
        held = k
    for i, k in enumerate(live):
        out[k] = label[where[i]]
    return out


def label_texts(model: LanguageModel, texts: list[str | None]) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
    """For each text: language, score, and spans (first character of the first word, of the next span or the end, language)."""
    if not model.languages:
        yield from ((UNDETERMINED, 0.0, []) for _ in texts)
        return
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and (not group or size < _GROUP):
            text = texts[at] or ""
            group.append((text, *word_scores(model, text)))
            size += len(text)
            at += 1
        for (text, start, letters, _), label in zip(group, viterbi([g[3] for g in group], model.switch_penalty), strict=True):
            if not len(label):
                yield UNDETERMINED, 0.0, []
                continue
            held = np.bincount(label, letters, len(model.languages))
            top = int(held.argmax())
            cuts = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
            ends = [*start[cuts[1:]].tolist(), len(text)]
            spans = [(int(s), int(e), model.languages[v]) for s, e, v in zip(start[cuts], ends, label[cuts], strict=True)]
            yield model.languages[top], float(held[top] / letters.sum()), spans


def train(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    where: Column | None = None,
    sample_per_lang: int = 1500,
    switch_penalty: float = 8.0,
) -> LanguageModel:
    """Fit on at most about ``sample_per_lang`` distinct labelled texts of each language among rows that satisfy ``where``.

    The counts of n-gram buckets are summed on the executors; the driver gets ``BUCKETS`` counts a language at most.
    """
    bound_arrow_batches(docs.sparkSession)
    rows = docs if where is None else docs.where(where)
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("l"), F.col(text_col).cast("string").alias("t"))
    own = F.xxhash64("t", F.lit("langid"))
    distinct = rows.select("l", own.alias("h")).distinct()
    sizes = {r["l"]: r["n"] for r in distinct.groupBy("l").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return LanguageModel((), np.zeros((BUCKETS + 1, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool), switch_penalty)
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, sample_per_lang / sizes[k])))])
    drawn = F.pmod(own, F.lit(1 << 40)) < share[F.col("l")] * (1 << 40)
    sample = rows.where(drawn).dropDuplicates(["l", "t"])
    index = {k: i for i, k in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(languages), BUCKETS + len(SCRIPT_NAMES)), dtype=np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = grams[index[lang]]
                for _, codes in _pieces(_codes(text)):
                    w = _Words(codes)
                    for bucket in w.grams():
                        np.add.at(row, bucket[bucket < BUCKETS], 1)
                    row[BUCKETS:] += np.bincount(w.script, minlength=len(SCRIPT_NAMES))
        lang, at = np.nonzero(grams)
        for k in range(0, len(at), 50_000):
            a, b = lang[k : k + 50_000], at[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(grams[a, b])], names=["lang", "at", "n"])

    counted = sample.mapInArrow(count, "lang int, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    grams = np.zeros((len(languages), BUCKETS + len(SCRIPT_NAMES)))
    grams[counted["lang"], counted["at"]] = counted["n"]
    text, script = grams[:, :BUCKETS], grams[:, BUCKETS:]
    weights = np.log(text + 0.5) - np.log(text.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    allowed = script > 0.001 * np.maximum(1, script.sum(axis=1, keepdims=True))
    return LanguageModel(languages, np.r_[weights.T / len(ORDERS), np.zeros((1, len(languages)))].astype(np.float32), np.ascontiguousarray(allowed.T), switch_penalty)


SPANS = "array<struct<start: int, end: int, lang: string>>"


def identify(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", keep: list[str] | None = None, spans: bool = True) -> DataFrame:
    """The columns ``keep`` with ``lang_pred``, ``lang_score`` and, if asked for, ``lang_spans`` of every row."""
    bound_arrow_batches(docs.sparkSession)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # languages x 2^16 floats
    keep = ["doc_id"] if keep is None else keep
    slim = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text_col).cast("string").alias("t"))
    names = [*keep, "lang_pred", "lang_score", *["lang_spans"] * spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for batch in batches:
            found = list(label_texts(shared.value, batch.column(len(keep)).to_pylist()))
            cols = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            if spans:
                cols.append(pa.array([[{"start": a, "end": b, "lang": c} for a, b, c in x[2]] for x in found], kind))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *cols], names=names)

    kinds = dict(slim.dtypes)
    fields = [f"`{c}` {kinds[f'k{i}']}" for i, c in enumerate(keep)] + ["lang_pred string", "lang_score double", *[f"lang_spans {SPANS}"] * spans]
    return slim.mapInArrow(run, ", ".join(fields))


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def keep_identified(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """Rows whose language was found with at least ``min_score`` of their letters; the columns are those of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bound_arrow_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lang != UNDETERMINED and score >= min_score for lang, score, _ in label_texts(shared.value, batch.column(at).to_pylist())]
            yield batch.filter(pa.array(found, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
