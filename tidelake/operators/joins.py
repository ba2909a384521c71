"""Joins on time, lateral joins, counts of pairs, NOT IN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions.time import interval_micros, micros
from tidelake.operators.select import top_k_per_group


def asof_join(left: DataFrame, right: DataFrame, by: list[str], ts: str, right_ts: str, prefix: str = "r_", strict: bool = False) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time (none: nulls); strict: before it.

    Both sides go through one shuffle by key and one running last value; no pair is made.
    """
    cols = [c for c in right.columns if c not in by]
    mine = 0 if strict else 1  # place of left rows among equal times
    own = F.struct(*[F.col(c) for c in left.columns]).alias("_l")
    a = left.select(*by, F.col(ts).alias("_t"), F.lit(mine).alias("_side"), own, F.lit(None).cast(right.select(F.struct(*cols)).schema[0].dataType).alias("_r"))
    b = right.select(*by, F.col(right_ts).alias("_t"), F.lit(1 - mine).alias("_side"), F.lit(None).cast(left.select(own).schema[0].dataType).alias("_l"), F.struct(*cols).alias("_r"))
    at = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("_r", F.last("_r", ignorenulls=True).over(at)).filter(F.col("_side") == mine)
    return out.select("_l.*", *[F.col(f"_r.{c}").alias(f"{prefix}{c}") for c in cols])


def range_join(points: DataFrame, ranges: DataFrame, by: list[str], at: str, start: str, end: str, how: str = "inner", width: str | None = None) -> DataFrame:
    """Points in [start, end) of a range with equal keys: an equi join with the range as its condition.

    width: an interval such as ``'6 hours'``.  Both sides are then also joined on bins of time, a range
    standing in each bin it touches, so a busy key is no single task and far pairs are never made.  A width
    near the usual range is best; ``how`` must not keep rows of ranges then.
    """
    x, y, bins = points, ranges, ["_bin_p", "_bin_q"]
    if width:
        if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
            raise ValueError(f"{how!r} keeps ranges, which stand in several bins")
        while set(bins) & {*points.columns, *ranges.columns}:
            bins = [f"_{b}" for b in bins]
        w = F.lit(interval_micros(width)).cast("long")
        floor = lambda m: m - F.pmod(m, w)
        x = points.withColumn(bins[0], floor(micros(at)))
        y = ranges.filter(F.col(start) < F.col(end)).withColumn(bins[1], F.explode(F.sequence(floor(micros(start)), floor(micros(end) - 1), w)))
    x, y = x.alias("p"), y.alias("q")
    on = (F.col(f"p.{at}") >= F.col(f"q.{start}")) & (F.col(f"p.{at}") < F.col(f"q.{end}"))
    for k in by:
        on = on & (F.col(f"p.{k}") == F.col(f"q.{k}"))
    return x.join(y, on & (F.col(bins[0]) == F.col(bins[1])), how).drop(*bins) if width else x.join(y, on, how)


def lateral_top_k(left: DataFrame, right: DataFrame, key: str, right_key: str, k: int, *order: Column, how: str = "inner") -> DataFrame:
    """``left JOIN LATERAL (SELECT .. FROM right WHERE right_key = key ORDER BY .. LIMIT k)``; ``how``: inner or left.

    Spark's own lateral LIMIT sorts the whole table and then numbers the rows of each key in whatever order they
    come from the next shuffle; here each key is ranked in the order itself, and a map task sends k rows a key.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"{how!r}: a lateral join is inner or left")
    best = top_k_per_group(right.filter(F.col(right_key).isNotNull()), [right_key], k, *order)
    return left.join(best, F.col(key) == F.col(right_key), how)


def pair_counts(left: DataFrame, right: DataFrame, by: list[str], alias: str) -> DataFrame:
    """Rows of an inner join on equal keys, counted per key.

    They are the product of both sides' counts: a join of one row per key, no pair is made.  A null key has no pairs.
    """
    a, b = (side.groupBy(*by).agg(F.count(F.lit(1)).alias(n)) for side, n in ((left, "_a"), (right, "_b")))
    return a.join(b, by).select(*by, (F.col("_a") * F.col("_b")).alias(alias))


def not_in(left: DataFrame, key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Rows of ``left`` whose key is NOT IN ``right``, as SQL has it with nulls, by a plain anti join.

    An empty ``right`` keeps every row; a null in it keeps none; a null key stays only beside an empty
    ``right``.  Nothing has to be broadcast but the one row that tells these cases apart.
    """
    keys = right.select(F.col(right_key).alias("k"))
    case = keys.agg(F.when(F.count(F.lit(1)) == 0, "empty").when(F.count("k") < F.count(F.lit(1)), "null").otherwise("plain")).scalar()
    rows = left.alias("l").join(keys.alias("r"), F.col(f"l.{key}") == F.col("r.k"), "left_anti")
    return rows.filter((case == "empty") | ((case == "plain") & F.col(key).isNotNull()))
