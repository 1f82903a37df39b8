"""Mixing sources to target weights as a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1], piecewise linear between knots. Its
integral is the source's cumulative share of tokens; inverting it assigns each copy of a document the moment at
which the mix has consumed that much of the source. Documents are then range-sorted by that position.

Main path: DataFrame functions only. The order of documents inside a source is that of an md5 of the id. A
running sum over a whole source would put a hot source in one task, so documents are first dealt into blocks
of about BLOCK_ROWS by that hash, blocks are summed, block starts are a running sum over the far smaller
table of blocks, and only the rows of a block meet in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadastra.llm.common import stage, table, text_or_empty

BLOCK_ROWS = 2000
CAP = 3
#: Relative weight at the start and at the end of training, by the source's rank modulo 3.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))

WORDS = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORDS)).cast("long")


def source_targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """Water-filling: (source, weight, source_size) -> target.

    Shares follow the weights, no target passes cap times its source's size, and the excess is reshared by
    weight. The capped sources are a prefix of the order by cap * size / weight, so running sums give the
    answer without iteration: the level is (total - capped sizes) / (weights left) for the first prefix
    whose next source stays below its cap. One row per source; a single window holds them.
    """
    order = W.orderBy((F.col("source_size") * cap / F.col("weight")).asc(), F.col("rank").asc())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    sizes = (
        sizes.withColumn("__total", F.sum("source_size").over(everything))
        .withColumn("__weights", F.sum("weight").over(everything))
        .withColumn("__capped", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap)
        .withColumn("__gone", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("__k", F.row_number().over(order))
    )
    left, free = F.col("__total") - F.col("__capped"), F.col("__weights") - F.col("__gone")
    fits = left * F.col("weight") <= F.col("source_size") * cap * free
    # the first prefix that fits: its level holds for every source after it
    first = F.min(F.when(fits, F.struct("__k", left.alias("left"), free.alias("free")))).over(everything)
    sizes = sizes.withColumn("__first", first)
    inside = F.col("__first").isNull() | (F.col("__k") < F.col("__first.__k"))
    share = (F.col("__first.left") * F.col("weight")).cast("double") / F.col("__first.free").cast("double")
    target = F.when(inside, (F.col("source_size") * cap).cast("double")).otherwise(share)
    return sizes.withColumn("target", target).drop("__total", "__weights", "__capped", "__gone", "__k", "__first")


def invert_demand(share: Column, start: Column, end: Column) -> Column:
    """The t at which a linear weight from start to end has delivered this share of its integral.

    The integral start*t + (end-start)*t*t/2 is divided by its value at 1, (start+end)/2; the quadratic is
    solved in the form that needs no division by end-start.
    """
    total = (start + end) / 2
    need = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * total
    root = F.sqrt(F.greatest(F.lit(0.0), start * start + 2 * (end - start) * need))
    return F.when(start + root > 0, 2 * need / (start + root)).otherwise(F.lit(0.0))


def copy_position(copy: Column) -> Column:
    """When the mix reaches a copy (0 is the first) of a document of `places`: each pass over the source follows the one before."""
    middle = (F.col("__offset") + copy * F.col("source_size") + F.col("size") / 2) / F.when(F.col("target") > 0, F.col("target"))
    return invert_demand(middle, F.col("__start"), F.col("__end"))


def places(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    cap: int = CAP,
    schedules: tuple[tuple[float, float], ...] = SCHEDULES,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document, in no order: __id, size, source_size, target, taken, copies, __offset in the source, __start and __end of its weight, __c_ columns of keep."""
    carried = [F.col(c).alias(f"__c_{c}") for c in keep]
    rows = docs.select(
        F.col(id_col).alias("__id"),
        F.col(source_col).alias("__source"),
        word_count(text_or_empty(text_col)).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("__hash"),
        *carried,
    )
    lean = rows.select("__id", "__source", "size", "__hash")
    sizes = lean.groupBy("__source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__rows"))
    named = W.orderBy(F.col("__source").asc_nulls_last())
    sizes = sizes.withColumn("rank", F.row_number().over(named) - 1)
    sizes = sizes.withColumn("weight", F.col("rank") % 3 + 1)
    kind = F.col("rank") % len(schedules)
    start, end = F.lit(float(schedules[0][0])), F.lit(float(schedules[0][1]))
    for k, (a, b) in enumerate(schedules):
        start, end = F.when(kind == k, F.lit(float(a))).otherwise(start), F.when(kind == k, F.lit(float(b))).otherwise(end)
    sources = source_targets(sizes, cap).select(
        F.struct(F.col("__source")).alias("__key"),
        "source_size",
        "target",
        start.alias("__start"),
        end.alias("__end"),
        F.greatest(F.lit(1), F.ceil(F.col("__rows") / BLOCK_ROWS)).cast("long").alias("__blocks"),
    )
    sources = stage(sources, "mix-sources")  # one row per source; Spark broadcasts it only below its size limit
    block = F.shiftrightunsigned(F.conv(F.substring("__hash", 1, 8), 16, 10).cast("long") * F.col("__blocks"), 32)

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("__key", F.struct(F.col("__source"))).join(sources, "__key").withColumn("__block", block)

    totals = placed(lean).groupBy("__key", "__block").agg(F.sum("size").alias("__words"))
    up_to = W.partitionBy("__key").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("__key", "__block", F.coalesce(F.sum("__words").over(up_to), F.lit(0)).alias("__base"))
    inside = W.partitionBy("__key", "__block").orderBy("__hash", "__id", "size").rowsBetween(W.unboundedPreceding, -1)
    out = placed(rows).withColumn("__in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = out.join(starts, ["__key", "__block"])
    offset = F.col("__base") + F.col("__in")
    goal = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long")
    more = goal - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), more - offset)).cast("long")
    taken = F.col("size") * whole + part
    copies = whole + F.when((F.col("size") > 0) & (part * 2 >= F.col("size")), 1).otherwise(0)
    return out.select(
        "__id",
        "size",
        "source_size",
        "target",
        taken.cast("long").alias("taken"),
        copies.cast("long").alias("copies"),
        offset.alias("__offset"),
        "__start",
        "__end",
        *[f"__c_{c}" for c in keep],
    )


def curriculum(docs: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = (), **options) -> DataFrame:
    """One row per document, range-sorted by position: id, size, source_size, target, taken, copies, position.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating. taken counts words: every document is
    taken floor(target / source_size) times, and in the order of the hash once more until the target is
    reached; the last of these is taken in part. copies is that in whole documents (the cut one counts from a
    half). position in [0, 1] is that of the first copy; documents that are not taken have null and sort last.
    keep: input columns to carry along. Null text has size 0; empty documents are never cut and take part
    with 0 words; repeated rows are documents of their own. An empty table gives an empty result.
    """
    out = places(docs, id_col, keep=keep, **options)
    return out.select(
        F.col("__id").alias(id_col),
        "size",
        "source_size",
        "target",
        "taken",
        "copies",
        F.when(F.col("taken") > 0, copy_position(F.lit(0))).alias("position"),
        *[F.col(f"__c_{c}").alias(c) for c in keep if c != id_col],
    ).orderBy(F.col("position").asc_nulls_last(), F.col(id_col))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix in training order: repeated as often as copies says, each copy at its own position, with the columns of docs."""
    plan = places(docs.withColumn("__row", F.struct(*[F.col(c) for c in docs.columns])), keep=("__row",), **options)
    plan = plan.where("copies > 0").withColumn("__copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    plan = plan.select(copy_position(F.col("__copy")).alias("__position"), "__id", "__copy", F.col("__c___row").alias("__row"))
    return plan.orderBy("__position", "__id", "__copy").select("__row.*")


def op8_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the six contract columns and copies."""
    plan = curriculum(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies", "position")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS z, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM d GROUP BY source
), w AS (SELECT source, z, rank, rank % 3 + 1 AS weight FROM s),
o AS (
  SELECT *, row_number() OVER (ORDER BY z * 3 / weight, rank) AS k,
         sum(z) OVER ()::BIGINT AS total, sum(weight) OVER ()::BIGINT AS weights,
         coalesce(sum(z) OVER (ORDER BY z * 3 / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * 3 AS capped,
         coalesce(sum(weight) OVER (ORDER BY z * 3 / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS gone
  FROM w
), f AS (SELECT k AS fk, total - capped AS lft, weights - gone AS fre FROM o
         WHERE (total - capped) * weight <= z * 3 * (weights - gone) ORDER BY k LIMIT 1),
t AS (
  SELECT o.source, o.z, o.rank,
         CASE WHEN fk IS NULL OR k < fk THEN (z * 3)::DOUBLE ELSE (lft * weight)::DOUBLE / fre::DOUBLE END AS target,
         CASE rank % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS a,
         CASE rank % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS b
  FROM o LEFT JOIN f ON true
), p AS (
  SELECT d.doc_id, d.size, t.z, t.target, t.a, t.b,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off,
         CASE WHEN t.z > 0 THEN (floor(t.target)::BIGINT // t.z) ELSE 0 END AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, greatest(0, least(size, floor(target)::BIGINT - whole * z - off)) AS part,
         greatest(0.0::DOUBLE, least(1.0::DOUBLE, (off + size::DOUBLE / 2) / target)) * ((a + b) / 2) AS need
  FROM p
)
SELECT doc_id, size, z AS source_size, target, (size * whole + part)::BIGINT AS taken,
       (whole + CASE WHEN size > 0 AND part * 2 >= size THEN 1 ELSE 0 END)::BIGINT AS copies,
       CASE WHEN size * whole + part > 0 THEN 2 * need / (a + sqrt(greatest(0.0::DOUBLE, a * a + 2 * (b - a) * need))) END AS position
FROM q
"""

QUERIES = {"op8_curriculum": op8_curriculum}
ORACLES = {"op8_curriculum": SQL}
