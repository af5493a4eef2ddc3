"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every source gets a share of all words. The expected copies of a document are
``target / source words``, the same for each document of a source. Documents
of a source are put in order of (size, id); the running sum of expected copies
plus one offset per source is cut at the integers, and a document is emitted
once per integer that its stretch of the sum passes. Because neighbours in the
order are of like size, the taken words miss the target by less than the
largest document of the source.

Running sums never gather a source in one task: rows are dealt by range of
(source, size, id), each range numbers its own rows, and the totals of the
ranges before it (one row per range and source) are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stay_analytics.session import cut_lineage

from .common import free_name, partitions_for, word_count

WEIGHT_CYCLE = (1, 2, 3)
MOST_COPIES = 3


def source_targets(sources: DataFrame, weight_cycle=WEIGHT_CYCLE, most_copies: int = MOST_COPIES) -> DataFrame:
    """Targets of (source, source_size) rows: one row per source with ``weight``, ``target``.

    Sources by code point, null last, weigh ``weight_cycle`` in turn. All
    words are shared by weight; a target above ``most_copies`` times the
    source's size stops there and the excess is shared again by weight. With
    sources in order of size / weight, those that stop are a prefix: source k
    stops if its cap is at most its share of what the caps before it leave.
    The windows here run over one row per source.
    """
    cycle = F.array(*[F.lit(w) for w in weight_cycle])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weight_cycle) + 1).cast("int")).cast("long")) \
        .withColumn("cap", F.col("source_size") * most_copies)
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = w.withColumn("left_words", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) \
        .withColumn("left_weight", F.sum("weight").over(after)) \
        .withColumn("level", F.col("left_words") / F.col("left_weight"))
    stops = F.col("cap") <= F.col("level") * F.col("weight")
    level = F.min(F.when(~stops, F.struct("at", "level"))).over(whole)["level"]
    return left.withColumn("at", F.row_number().over(order)).withColumn("stops", stops).withColumn("common", level) \
        .withColumn("target", F.when(F.col("stops") | F.col("common").isNull(), F.col("cap").cast("double"))
                    .otherwise(F.least(F.col("cap").cast("double"), F.col("common") * F.col("weight")))) \
        .select("source", "source_size", "weight", "target")


def offset_of(source, seed: str = "mix"):
    """The random offset of a source in [0, 1): 20 bits of the md5 of the seed and its name."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("-"))))
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))


def mix_copies(docs: DataFrame, seed: str = "mix", weight_cycle=WEIGHT_CYCLE, most_copies: int = MOST_COPIES) -> DataFrame:
    """Copies of each document in the mix: one row per row of ``docs``.

    Reads ``doc_id``, ``text`` and ``source``; other columns are ignored.
    Returns doc_id, source, size, source_size, target, copies, taken. A null
    text has size 0; a null source is a source of its own; rows that are equal
    in (source, size, doc_id) are taken in any order, which leaves the result
    the same; null ids come first; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    n = partitions_for(docs)
    # The ranges must be the same for the totals and for the rows, so they are written once (ids and sizes only).
    dealt = cut_lineage(sized.repartitionByRange(n, F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id"))
                        .withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy("source", "part").agg(F.sum("size").alias("words"), F.count("*").alias("n_docs"))
    # A few rows per source: a source spans a run of ranges.
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("docs_before", F.coalesce(F.sum("n_docs").over(ahead), F.lit(0)))
    targets = source_targets(totals.groupBy("source").agg(F.sum("words").alias("source_size")), weight_cycle, most_copies)
    about = totals.select("source", "part", "docs_before").alias("a").join(
        targets.alias("t"), F.col("a.source").eqNullSafe(F.col("t.source"))) \
        .select(F.col("a.source").alias("of_source"), F.col("a.part").alias("of_part"), "docs_before", "source_size", "target")
    inside = Window.partitionBy("part", "source").orderBy("size", "doc_id")
    ranked = dealt.withColumn("at", F.row_number().over(inside).cast("long"))
    joined = ranked.join(about, (F.col("part") == F.col("of_part")) & F.col("source").eqNullSafe(F.col("of_source")))
    each = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most_copies)))).otherwise(F.lit(0.0))
    rank = F.col("docs_before") + F.col("at")
    u = offset_of(F.col("source"), seed)
    copies = F.floor(each * rank + u) - F.floor(each * (rank - 1) + u)
    return joined.withColumn("copies", F.least(copies, F.lit(most_copies)).cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The documents of the mix, each repeated as often as it was emitted; columns of ``docs`` stay.

    Rows of ``docs`` that share a ``doc_id`` are told apart by their place
    among equal ids only, so ids should be unique here; a null id matches nulls.
    """
    of_doc, times = free_name(docs, "of_doc"), free_name(docs, "copies")
    copies = mix_copies(docs, seed).where("copies > 0").groupBy(F.col("doc_id").alias(of_doc)).agg(F.max("copies").cast("int").alias(times))
    return docs.join(copies, F.col("doc_id").eqNullSafe(F.col(of_doc))) \
        .withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight, source_size * 3 AS cap FROM s),
l AS (SELECT *, row_number() OVER o AS place,
        (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
          / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
      FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight ASC, source ASC NULLS LAST)),
c AS (SELECT arg_min(level, place) AS common FROM l WHERE cap > level * weight),
t AS (SELECT source, source_size, CASE WHEN cap <= level * weight OR common IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, common * weight) END AS target,
        CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS name FROM l, c),
r AS (SELECT doc_id, size, source_size, target, least(target / nullif(source_size, 0), 3.0) AS each_doc,
        row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) AS rank,
        ('0x' || substr(md5('mix:' || name), 1, 5))::BIGINT / 1048576.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(least(coalesce(floor(each_doc * rank + u) - floor(each_doc * (rank - 1) + u), 0), 3) * size AS BIGINT) AS taken FROM r
"""
