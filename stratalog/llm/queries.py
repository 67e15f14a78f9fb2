"""Registered queries of the training-data operators: thin layers that fix production parameters and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, editembed, langid, linededup, mixing, secrets, sharding, tokens, urlfilter
from .common import checkpointed, read_table, release, sized
from .simhash import near_duplicate_classes


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    classes = near_duplicate_classes(read_table(spark, sf_dir, "documents"), words=3, lanes=1, max_diff=3)
    return classes.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp.f0"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url by rule, or by the blocked aliases of its component."""
    return urlfilter.judge(read_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item whose five-word shingles it holds to 80 % or more."""
    return decontam.contaminated_pairs(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the labelled rows outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents")
    model = langid.train(docs, where=~langid.held_out(F.col("doc_id")))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id",
        langid.held_out(F.col("doc_id")).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.size("lang_spans").cast("long").alias("n_spans"),
    )


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix of sources takes of every document."""
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken")
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, encoded as a whole; a crossing token goes where it starts."""
    counted = tokens.count_tokens(read_table(spark, sf_dir, "documents"), rule="start")
    return counted.select(
        F.col("id").alias("doc_id"), "section", "char_start", "char_end", F.col("tokens").cast("long").alias("tokens"), "crossing", "document_tokens"
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with what their spread over owners says of them."""
    found = secrets.scan(read_table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != secrets.OWNED)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        *(count(k).alias(f"n_{k}") for k in secrets.KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["verdict"] == "live")).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: s["verdict"] == "example")).cast("long").alias("n_example"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand on many sites."""
    return linededup.remove_spread_lines(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_stratified_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; each of the 24 shards matches the mixture of sources."""
    dealt = sharding.interleave(read_table(spark, sf_dir, "documents"), shards=24)
    return dealt.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document, its likeness to an edited copy and to the next document, and its class of near texts."""
    docs = read_table(spark, sf_dir, "documents")
    near = sized(checkpointed(editembed.near_classes(docs)))
    release(spark)  # what the search has shuffled, before all texts are
    rows = editembed.compare_with_next(docs).withColumnRenamed("id", "doc_id")
    return rows.join(near, "text_key", "left").withColumn("component_id", F.coalesce("component_id", "doc_id")).drop("text_key")


QUERIES = {
    "op3_token_counts": op3_token_counts,
    "op7_secret_scan": op7_secret_scan,
    "op8_line_dedup": op8_line_dedup,
    "op10_edit_embedding": op10_edit_embedding,
    "op1_url_filter": op1_url_filter,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op4_language_id": op4_language_id,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_source_mixing": op6_source_mixing,
    "op9_stratified_sharding": op9_stratified_sharding,
}

ORACLES: dict[str, str] = {
    "op8_line_dedup": linededup.LINE_SQL,
    "op1_url_filter": urlfilter.URL_SQL,
    "op2_benchmark_decontamination": decontam.DECONTAM_SQL,
    "op6_source_mixing": mixing.MIX_SQL,
}
