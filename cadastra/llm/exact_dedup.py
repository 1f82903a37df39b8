"""Exact deduplication: 128-bit content hash, one survivor per group, byte comparison inside the groups.

Main path: DataFrame functions only. Texts are grouped by (md5, text), so the aggregation's own key
comparison is the byte comparison, and copies within a task merge before the shuffle; a group that holds a
third of all rows reaches the reducers as one row per task. Only groups of two or more are kept, written,
and joined back by hash; that join's left side holds ids and digests, never texts, and both of its sides
are plain exchanges, which adaptive execution splits where one hash is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.common import ascii_lower, stage, table, text_or_empty


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", content: Column | None = None
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    keep: "min" keeps the smallest id of a group, "max" the largest. content: what is compared (text by default;
    null is empty). Rows that repeat an id with the same text share its fate. A null id never wins over another;
    in a group of null ids only, keep_id is null and the rows are kept. Other columns are ignored; an empty
    table gives an empty result.
    """
    content = text_or_empty(text_col) if content is None else content
    best = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("__id"), content.alias("__text"))
    rows = rows.select("__id", "__text", F.unhex(F.md5(F.col("__text").cast("binary"))).alias("__h"))
    texts = rows.groupBy("__h", "__text").agg(best("__id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # more than one text under a hash is a collision; its texts stay apart by their bytes
    groups = texts.groupBy("__h").agg(
        F.count(F.lit(1)).alias("__texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    groups = stage(groups.where("group_size > 1"), "exact-groups")
    digests = rows.select("__id", "__h", F.sha2(F.col("__text").cast("binary"), 256).alias("text_sha256"))
    single = groups.where("__texts = 1").select("__h", "keep_id", "group_size")
    collided = groups.where("__texts > 1").select("__h")
    if collided.isEmpty():
        joined = digests.join(single.hint("merge"), "__h", "left")
    else:
        apart = rows.join(collided, "__h", "left_semi")
        exact = apart.join(texts.join(collided, "__h", "left_semi"), ["__h", "__text"]).select(
            "__h", "__id", F.sha2(F.col("__text").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size"
        )
        rest = digests.join(collided, "__h", "left_anti").join(single.hint("merge"), "__h", "left")
        joined = rest.unionByName(exact)
    size = F.coalesce(F.col("group_size"), F.lit(1).cast("long"))
    keep_id = F.when(F.col("group_size").isNull(), F.col("__id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("__id").alias(id_col),
        keep_id.alias("keep_id"),
        size.alias("group_size"),
        F.col("__id").eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; texts equal after lower-casing A-Z only; the largest doc_id of a group stays."""
    docs = table(spark, sf_dir, "documents")
    return exact_dedup(docs, keep="max", content=ascii_lower(text_or_empty()))


SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""

QUERIES = {"op10_exact_dedup": op10_exact_dedup}
ORACLES = {"op10_exact_dedup": SQL}
