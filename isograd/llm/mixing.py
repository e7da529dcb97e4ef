"""Mixing of sources to target weights along a curriculum.

Each source's weight changes over training time; its integral is the source's demand of words up to a
time. A document's place in its source is a number of words, and inverting the demand turns that into
a training position. Documents are then range-sorted by position. Only DataFrame expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Slope of a weight over training time from 0 to 1: weight(t) = weight * (1 + slope * (2 t - 1)).
SLOPES = (0.5, 0.0, -0.5)
#: Words of the mix by words of the corpus, and of a source's target by words of the source.
SHARE, MOST = 1.5, 2.0
#: Rows that one ordered window should hold.
WINDOW_ROWS = 20_000


def _pick(rank: Column, values: tuple) -> Column:
    """The value of a rank from 0, repeating."""
    return F.element_at(F.array(*map(F.lit, values)), (rank % len(values)).cast("int") + 1)


def targets(sources: DataFrame) -> DataFrame:
    """_key, _total, _target, _slope from one row per source (_key, _source, _total).

    A target is the source's weight times a common level, at most twice its words. The level follows
    from the sources in the order of the level at which they are full: those before are full.
    """
    every = Window.orderBy(F.col("_source").asc_nulls_last())
    ranked = sources.withColumn("_rank", F.row_number().over(every) - 1)
    ranked = (ranked.withColumn("_weight", _pick(F.col("_rank"), WEIGHTS).cast("double"))
              .withColumn("_slope", _pick(F.col("_rank"), SLOPES))
              .withColumn("_full", MOST * F.col("_total")))
    before = (Window.orderBy(F.col("_full") / F.col("_weight"), "_rank")
              .rowsBetween(Window.unboundedPreceding, -1))
    whole = Window.partitionBy()
    ranked = (ranked
              .withColumn("_left", SHARE * F.sum("_total").over(whole)
                          - F.coalesce(F.sum("_full").over(before), F.lit(0.0)))
              .withColumn("_among", F.sum("_weight").over(whole)
                          - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))))
    open_ = F.col("_full") * F.col("_among") >= F.col("_left") * F.col("_weight")
    level = F.min(F.when(open_, F.struct((F.col("_full") / F.col("_weight")).alias("at"), "_rank",
                                         "_left", "_among"))).over(whole)
    return (ranked.withColumn("_level", level)
            .select("_key", "_total", "_slope",
                    F.least(F.col("_full"), F.col("_level._left") * F.col("_weight")
                            / F.col("_level._among")).alias("_target")))


def mixture(docs: DataFrame) -> DataFrame:
    """The rows of docs with _size, _total, _target, _taken and _positions.

    _size counts words (null: 0); _total is the words of the row's source; _target its words in the mix.
    A source's documents stand in the order of a hash of their id. The mix takes all of them as often
    as the target holds them, then goes on to the target: the document there is taken in part, so that
    a source's taken words are its target rounded down. _positions holds the training position, 0 to 1,
    of each time the document is taken. Rows with equal ids are documents of their own; a null source
    is a source; without words every number is 0 and nothing is taken. Needs the columns doc_id,
    text and source, and keeps all columns; names with a leading underscore are the operator's.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = max(4 * partitions, docs.count() // WINDOW_ROWS)
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = (docs.withColumn("_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
                            .cast("long"))
            .withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
            .withColumn("_order", order)
            .withColumn("_piece", F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long")
                                          * pieces / 2 ** 32).cast("long")))
    parts = (rows.groupBy("_key", "_piece")
             .agg(F.sum("_size").alias("_words"), F.first("source").alias("_source")))
    along = Window.partitionBy("_key").orderBy("_piece")
    parts = (parts.withColumn("_before", F.sum("_words").over(along) - F.col("_words")))
    goals = targets(parts.groupBy("_key").agg(F.first("_source").alias("_source"),
                                              F.sum("_words").alias("_total")))
    parts = (parts.select("_key", "_piece", "_before").join(goals, "_key")
             .withColumnsRenamed({"_key": "_key2", "_piece": "_piece2"}))
    inside = (Window.partitionBy("_key", "_piece").orderBy("_order", "doc_id", "_size")
              .rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_upto", F.sum("_size").over(inside))
    rows = rows.join(parts, (F.col("_key") == F.col("_key2"))
                     & (F.col("_piece") == F.col("_piece2")))
    start = F.col("_before") + F.col("_upto") - F.col("_size")
    goal = F.floor("_target")
    turns = F.when(F.col("_total") > 0, F.floor(goal / F.col("_total"))).otherwise(0)
    rest = F.col("_goal") - F.col("_turns") * F.col("_total")
    rows = (rows.withColumn("_start", start).withColumn("_goal", goal).withColumn("_turns", turns)
            .withColumn("_part", F.greatest(F.lit(0), F.least(F.col("_size"), rest - F.col("_start"))))
            .withColumn("_taken", F.col("_turns") * F.col("_size") + F.col("_part")))

    def position(turn: Column) -> Column:
        x = (turn * F.col("_total") + F.col("_start")) / F.col("_goal")
        flat = 1 - F.col("_slope")
        return 2 * x / (flat + F.sqrt(flat * flat + 4 * F.col("_slope") * x))

    times = F.col("_turns") + F.when(F.col("_part") > 0, 1).otherwise(0)
    place = [F.when((F.col("_size") > 0) & (times > k), position(F.lit(k)))
             for k in range(int(MOST) + 1)]
    return (rows.withColumn("_positions", F.array_compact(F.array(*place)))
            .select(*(F.col(f"`{c}`") for c in docs.columns),
                    "_size", "_total", "_target", "_taken", "_positions"))


def ranged(rows: DataFrame, column: str) -> DataFrame:
    """Rows in ranges of the column, then of doc_id, which splits ties; sorted inside, nulls last."""
    order = F.col(column).asc_nulls_last(), F.col("doc_id")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """One row per document, in training order: doc_id, size, source_size, target, taken, position.

    position is that of the document's first turn, null if it is not taken.
    """
    rows = mixture(docs.select("doc_id", "text", "source"))
    return ranged(rows.select(
        "doc_id", F.col("_size").alias("size"), F.col("_total").alias("source_size"),
        F.col("_target").alias("target"), F.col("_taken").alias("taken"),
        F.get("_positions", F.lit(0)).alias("position")), "position")


def curriculum(docs: DataFrame) -> DataFrame:
    """The mix itself: the columns of docs, once per turn of a document, with turn and position.

    Rows are range-sorted by position. Existing columns of these two names are replaced.
    """
    docs = docs.drop("turn", "position")
    rows = mixture(docs)
    rows = rows.select(*(F.col(f"`{c}`") for c in docs.columns),
                       F.posexplode("_positions").alias("turn", "position"))
    return ranged(rows, "position")


SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS o
  FROM documents),
s AS (
  SELECT source, total, rank, [5.0, 2.0, 1.0][rank % 3 + 1]::DOUBLE AS weight,
         [0.5, 0.0, -0.5][rank % 3 + 1]::DOUBLE AS slope, 2.0::DOUBLE * total AS cap
  FROM (SELECT source, sum(size)::BIGINT AS total,
               row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
        FROM d GROUP BY source)),
f AS (
  SELECT *, 1.5::DOUBLE * (sum(total) OVER ())::DOUBLE - coalesce(sum(cap) OVER before, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS among
  FROM s
  WINDOW before AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT rest, among FROM f WHERE cap * among >= rest * weight
      ORDER BY cap / weight, rank LIMIT 1),
t AS (SELECT f.source, f.total, f.slope, least(f.cap, l.rest * f.weight / l.among) AS target FROM f, l),
p AS (
  SELECT d.*, t.total, t.target, t.slope, floor(t.target)::BIGINT AS goal,
         (sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT *, CASE WHEN total > 0 THEN goal // total ELSE 0 END AS turns FROM p),
h AS (SELECT *, greatest(0, least(size, goal - turns * total - start)) AS part FROM g)
SELECT doc_id, size, total AS source_size, target, (turns * size + part)::BIGINT AS taken,
       CASE WHEN size > 0 AND (turns > 0 OR part > 0) THEN
         2 * (start / goal) / ((1 - slope)
             + sqrt((1 - slope) * (1 - slope) + 4 * slope * (start / goal))) END AS position
FROM h
"""
