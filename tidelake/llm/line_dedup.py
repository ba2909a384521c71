"""Line de-duplication over overlapping three-line windows, all in built-in expressions.

Each document's windows of three consecutive lines are hashed (128 bits); windows that
occur again anywhere are found by one grouped count.  The lines covered by a later
occurrence, in the order of (doc_id, line), are merged into runs and removed; only lines
that the first occurrence of the same window covers too (it overlaps itself) are spared.
So each removed line stands in an earlier place as well, and its earliest one remains.

Defined cases: null has no lines; a text of fewer than three lines has no windows;
windows of blank lines only are not counted; a null doc_id comes first; repeated rows
of one id and text count as one document and get the same result; an empty table
gives no rows; other columns are carried along by ``line_dedup``, whatever their names;
very long texts are read whole, in time linear in their lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelake.llm.common import in_slots, materialize, quoted, row_key, table

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def removed_runs(docs: DataFrame, window: int = WINDOW, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Documents that lose lines: doc_id, h (of the text), runs (first and last line of each), n_removed."""

    def windows(lines: Column) -> Column:
        n = F.size(lines)
        at = F.when(n >= window, F.sequence(F.lit(0), n - window)).otherwise(F.array().cast("array<int>"))

        def hashed(i: Column) -> Column:
            own = [F.get(lines, i + k) for k in range(window)]
            blank = F.lit(True)
            for line in own:
                blank = blank & (F.trim(line) == "")
            return F.struct(i.alias("pos"), F.xxhash64(*own).alias("a"), F.xxhash64(F.lit(17), *reversed(own)).alias("b"), blank.alias("blank"))

        return F.transform(at, hashed)

    # bound in an array of one, so that the lines are split once and not in every lambda call
    rows = F.explode_outer(F.get(F.transform(F.array(_lines(quoted(text).cast("string"))), windows), F.lit(0)))
    rows = docs.select(*row_key(docs, text, id_col), rows.alias("w")).filter("not w.blank")
    rows = materialize(rows.select("doc_id", "h", F.col("w.pos").alias("pos"), F.col("w.a").alias("a"), F.col("w.b").alias("b")).distinct(), "windows")
    again = rows.groupBy("a", "b").agg(F.min(F.struct("doc_id", "h", "pos")).alias("first"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    mine = rows.join(again.hint("shuffle_merge"), ["a", "b"])
    later = mine.filter(~F.struct("doc_id", "h", "pos").eqNullSafe(F.col("first")))
    same = F.struct("doc_id", "h").eqNullSafe(F.struct("first.doc_id", "first.h"))
    begin = F.when(same, F.greatest("pos", F.col("first.pos") + window)).otherwise(F.col("pos"))
    lines = later.select("doc_id", "h", F.explode(F.sequence(begin, F.col("pos") + window - 1)).alias("line")).distinct()
    order = Window.partitionBy("doc_id", "h").orderBy("line")
    runs = lines.withColumn("run", F.col("line") - F.row_number().over(order)).groupBy("doc_id", "h", "run").agg(F.min("line").alias("lo"), F.max("line").alias("hi"))
    return runs.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("runs"), F.sum(F.col("hi") - F.col("lo") + 1).cast("long").alias("n_removed"))


def _without(text: Column, runs: Column) -> Column:
    """The text without the lines of its runs (in order): what is between them, put together."""
    n = F.size(runs)

    def between(lines: Column) -> Column:
        def part(i: Column) -> Column:
            begin = F.when(i == 0, F.lit(0)).otherwise(F.get(runs, i - 1)["hi"] + 1)
            end = F.when(i == n, F.size(lines)).otherwise(F.get(runs, i)["lo"])
            return F.slice(lines, begin + 1, end - begin)

        return F.flatten(F.transform(F.sequence(F.lit(0), n), part))

    kept = F.get(F.transform(F.array(_lines(text)), between), F.lit(0))
    return F.when(runs.isNull(), text).otherwise(F.array_join(kept, "\n"))


def _with_runs(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """row (a struct of all columns), text, kept (what remains of it) and n_removed (null: nothing) of every row.

    Only rows that lose lines, and the few that share a slot with them, are shuffled.
    """
    runs = materialize(removed_runs(docs, text=text, id_col=id_col), "runs")
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), *row_key(docs, text, id_col), quoted(text).cast("string").alias("text"))
    some, stay = in_slots(rows, runs, ["doc_id", "h"])
    x, y = some.alias("x"), runs.hint("shuffle_merge").alias("y")
    some = x.join(y, F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.h") == F.col("y.h")), "left")
    some = some.select("x.row", "x.text", _without(F.col("x.text"), F.col("y.runs")).alias("kept"), "y.n_removed")
    return stay.select("row", "text", F.col("text").alias("kept"), F.lit(None).cast("long").alias("n_removed")).unionByName(some)


def line_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with later occurrences of repeated lines taken out of their texts; all columns as given, whatever their names."""
    done = _with_runs(docs, text, id_col)
    return done.select(*[F.col("kept").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, kept_sha256 (of the remaining lines)."""
    done = _with_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")
    return done.select(
        F.col("row.doc_id").cast("long").alias("doc_id"), F.size(_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"),
    )


ORACLE = r"""
with d as (select doc_id, text, case when text is null then [] else string_split(text, chr(10)) end as l from documents),
w as (select doc_id, p, l[p] || chr(10) || l[p + 1] || chr(10) || l[p + 2] as win
      from (select doc_id, l, unnest(range(1, len(l) - 1)) as p from d)
      where trim(l[p], ' ') <> '' or trim(l[p + 1], ' ') <> '' or trim(l[p + 2], ' ') <> ''),
r as (select *, row_number() over o as k, first_value(doc_id) over o as d0, first_value(p) over o as p0
      from w window o as (partition by win order by doc_id, p)),
c as (select distinct doc_id, unnest(range(case when doc_id = d0 then greatest(p, p0 + 3) else p end, p + 3)) as line from r where k > 1),
x as (select doc_id, list(line) as gone from c group by doc_id)
select d.doc_id, cast(len(l) as bigint) as n_lines, cast(coalesce(len(gone), 0) as bigint) as n_removed,
       sha256(coalesce(array_to_string(list_filter(l, lambda v, i: not list_contains(coalesce(gone, []), i)), chr(10)), '')) as kept_sha256
from d left join x using (doc_id)
"""
