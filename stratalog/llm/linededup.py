"""Removal of boilerplate lines by distinct-site spread (DataFrame operations only).

Every line gets a HyperLogLog sketch of the sites it stands on; sketches merge by aggregation, so a line that stands in a
third of all documents costs one sketch a task. Lines whose estimate is clear of the threshold are decided by it; lines
within the sketch's error of the threshold get an exact distinct count. Removed are lines of at least ``min_chars``
characters (outer blanks stripped) on ``min_sites`` sites or more; shorter lines (brackets, rules, single words) stay, since
they say too little to be told from ordinary text. ``min_chars=1`` judges every line that is not blank.

Defined results: a null text has no lines and stays null; a null site is a site of its own; a document of boilerplate alone
becomes an empty text; repeated rows are repeated and count once a site; an empty table gives an empty result; extra columns
are not read. Lines are told apart by 128 bits of hash.
"""

from __future__ import annotations

from math import ceil, floor, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, salted_join

MIN_SITES = 10
MIN_CHARS = 20
LG_K = 12


def _hash(line: Column) -> list[Column]:
    return [F.xxhash64(line), F.xxhash64(F.lit("second"), line)]  # the first value seeds the hash of the second one


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def spread_lines(docs: DataFrame, *, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, lg_k: int = LG_K) -> DataFrame:
    """``(h1, h2)`` of the lines on at least ``min_sites`` sites."""
    line = F.trim(F.col("line"))
    site = F.coalesce(F.concat(F.lit("="), F.col("site")), F.lit(""))
    lines = (
        docs.select(F.col(site_col).cast("string").alias("site"), F.explode(_lines(F.col(text_col).cast("string"))).alias("line"))
        .where(F.length(line) >= min_chars)
        .select(_hash(line)[0].alias("h1"), _hash(line)[1].alias("h2"), site.alias("site"))
    )
    error = 4 * 1.04 / sqrt(1 << lg_k)
    low, high = floor(min_sites * (1 - error)), max(min_sites + 1, ceil(min_sites * (1 + error)))
    low = min(low, min_sites - 1)
    sketched = checkpointed(
        lines.groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
        .where(F.col("n") >= min_sites)
        .select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= low)
    )
    near = sketched.where(F.col("sites") < high).select("h1", "h2")
    exact = (
        lines.join(near, ["h1", "h2"], "left_semi").distinct().groupBy("h1", "h2").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    )
    return sketched.where(F.col("sites") >= high).select("h1", "h2").unionByName(exact.select("h1", "h2"))


def remove_spread_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(id, n_lines, n_removed, text)`` of every row, the text without its boilerplate lines."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(site_col).alias("site"))
    gone = checkpointed(spread_lines(slim, text_col="text", site_col="site", min_sites=min_sites, min_chars=min_chars))
    key = F.xxhash64("id", "text", F.length("text"))
    line = F.trim(F.col("line"))
    hits = (
        slim.select("id", key.alias("key"), F.explode(F.array_distinct(_lines(F.col("text")))).alias("line"))
        .where(F.length(line) >= min_chars)
        .select("id", "key", _hash(line)[0].alias("h1"), _hash(line)[1].alias("h2"))
    )
    # few lines are spread and one of them may stand in a third of all documents
    hits = (
        salted_join(hits, gone, ["h1", "h2"], F.col("key"))
        .groupBy("id", "key")
        .agg(F.collect_set(F.struct("h1", "h2")).alias("drop"))
        .withColumnRenamed("id", "of")
    )
    rows = slim.select("id", "text", key.alias("own_key"))
    both = rows.join(hits, F.col("of").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")), "left")
    kept = F.filter(
        _lines(F.col("text")),
        lambda x: (F.length(F.trim(x)) < min_chars) | ~F.array_contains(F.col("drop"), F.struct(_hash(F.trim(x))[0].alias("h1"), _hash(F.trim(x))[1].alias("h2"))),
    )
    kept = F.when(F.col("drop").isNull(), _lines(F.col("text"))).otherwise(kept)
    n_lines = F.coalesce(F.size(_lines(F.col("text"))), F.lit(0))
    return (
        both.withColumn("kept", kept)
        .withColumn("n_lines", F.when(F.col("text").isNull(), F.lit(0)).otherwise(n_lines).cast("long"))
        .select(
            "id", "n_lines",
            (F.col("n_lines") - F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("kept"))).cast("long").alias("n_removed"),
            F.array_join("kept", "\n").alias("text"),
        )
    )


LINE_SQL = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
gone AS (SELECT trim(line) AS t FROM l WHERE length(trim(line)) >= 20 GROUP BY 1 HAVING count(DISTINCT source) >= 10),
k AS (SELECT l.doc_id, l.pos, l.line, gone.t IS NOT NULL AS hit FROM l LEFT JOIN gone ON trim(l.line) = gone.t)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (hit)::BIGINT AS n_removed,
       COALESCE(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT hit), '') AS text
FROM k GROUP BY doc_id
"""
