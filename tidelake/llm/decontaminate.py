"""Benchmark decontamination: a prefix-filtered set join, all in built-in expressions.

A benchmark window (8 consecutive words of an item, or a shorter item as a whole) is a
set of word shingles at fixed offsets; a document contains the window only if it
contains all of them.  For full containment the necessary prefix is one shingle, so
each window is joined on its rarest one (by the number of documents that hold it).
An occurrence at position p of a shingle at offset o proposes a window at p - o; the
length and position bounds drop those that stick out of the document, and the rest are
verified shingle by shingle over the whole window.  Shingles are compared as strings,
so results are exact.

Words: A-Z lower-cased, runs of digits, a-z and everything beyond ASCII.
Defined cases: null and empty texts have no words and are never hit; items without
words are ignored; an item without id hits words but is not counted as an item; a
repeated row of documents gets the same result as its twin; an empty table gives no rows;
other columns are ignored by the report and carried along by ``decontaminate``, whatever
their names; texts of any length are cut into words whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.common import lower_ascii, materialize, quoted, scratch, table, without_rows

WINDOW, SHINGLE, LEAST_ITEMS = 8, 3, 2
#: Most benchmark shingles that are broadcast (some 100 MB); more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), _NO_WORD), "")


def n_words_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def _once(value: Column, of) -> Column:
    """``of(value)`` with value computed once: the optimizer would copy it into every lambda call."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _shingles(words: Column, size: int) -> Column:
    """Shingles of ``size`` words, in order: off, n (words of the text), token."""

    def of(w: Column) -> Column:
        n = F.size(w)
        at = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(i.alias("off"), n.alias("n"), F.concat_ws(" ", *[F.get(w, i + k) for k in range(size)]).alias("token")))

    return _once(words, of)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, text: str = "text", id_col: str = "item_id") -> DataFrame:
    """item (string), wid (the window's words), len, size (of its shingles)."""

    def windows(w: Column) -> Column:
        n = F.least(F.lit(window), F.size(w))
        at = F.when(n > 0, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(n.alias("len"), F.array_join(F.slice(w, i, n), " ").alias("wid")))

    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.explode_outer(_once(words_of(F.col(text)), windows)).alias("x"))
    items = items.filter("x is not null").select("item", "x.len", "x.wid")
    return items.withColumn("size", F.least(F.lit(SHINGLE), "len")).distinct()


def window_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Occurrences (doc_id, h, start, wid, len) of benchmark windows, and the windows of each item."""
    items = materialize(benchmark_windows(benchmark, window), "windows")
    windows = items.select("wid", "len", "size").distinct()
    sizes = [r["size"] for r in windows.select("size").distinct().collect()]  # at most SHINGLE of them
    words = F.split("wid", " ")
    tokens = None
    for size in sizes:
        own = windows.filter(F.col("size") == size).select("wid", "len", "size", F.explode_outer(_shingles(words, size)).alias("x")).select("wid", "len", "size", "x.off", "x.token")
        tokens = own if tokens is None else tokens.unionByName(own)
    if tokens is None:
        tokens = windows.select("wid", "len", "size", F.lit(0).alias("off"), F.lit("").alias("token"))
        sizes = [SHINGLE]
    tokens = materialize(tokens, "tokens")

    wanted = tokens.select("token").distinct()
    if wanted.count() <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    found = None
    for size in sizes:
        own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.explode_outer(_shingles(words_of(F.col(text)), size)).alias("x"))
        own = own.select("doc_id", "h", F.col("x.n").alias("n"), F.col("x.off").alias("pos"), F.col("x.token").alias("token")).join(wanted, "token", "left_semi")
        found = own if found is None else found.unionByName(own)
    found = materialize(found, "found").distinct()

    rarity = found.groupBy("token").agg(F.count_distinct("doc_id", "h").alias("df"))
    ranked = tokens.join(rarity, "token", "left").fillna(0, ["df"])
    prefix = ranked.groupBy("wid", "len", "size").agg(F.min(F.struct("df", "token", "off")).alias("p")).filter("p.df > 0")
    prefix = prefix.select("wid", "len", "size", F.col("p.token").alias("token"), F.col("p.off").alias("off"))

    proposed = found.join(prefix, "token").select("doc_id", "h", "n", (F.col("pos") - F.col("off")).alias("start"), "wid", "len", "size")
    proposed = proposed.filter((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n")))
    parts = proposed.join(tokens.select("wid", "off", "token"), "wid").withColumn("pos", F.col("start") + F.col("off"))
    x, y = parts.alias("x"), found.alias("y")
    same = F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.h") == F.col("y.h")) & (F.col("x.pos") == F.col("y.pos")) & (F.col("x.token") == F.col("y.token"))
    checked = x.join(y, same, "left_semi")
    whole = checked.groupBy("doc_id", "h", "start", "wid", "len", "size").agg(F.count_distinct("off").alias("m"))
    hits = whole.filter(F.col("m") == F.col("len") - F.col("size") + 1).select("doc_id", "h", "start", "wid", "len")
    return materialize(hits, "hits"), items


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Documents with hits only: doc_id, h, n_hit, n_items, item_ids (sorted strings)."""
    hits, items = window_hits(docs, benchmark, window, text, id_col)
    at = hits.select("doc_id", "h", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("p")).distinct()
    covered = at.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n_hit"))
    owners = hits.select("doc_id", "h", "wid").distinct().join(items.select("wid", "item"), "wid").select("doc_id", "h", "item").distinct()
    owners = owners.groupBy("doc_id", "h").agg(F.count("item").alias("n_items"), F.sort_array(F.collect_list("item")).alias("item_ids"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h") == F.col("b.h"))
    return covered.alias("a").join(owners.alias("b"), same).select("a.doc_id", "a.h", "n_hit", "n_items", "item_ids")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(docs, benchmark).alias("f")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), n_words_of(F.col("text")).alias("n_words")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.h") == F.col("f.h"))
    n_items = F.coalesce("n_items", F.lit(0).cast("long"))
    return rows.join(found, same, "left").select(
        "d.doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), n_items.alias("n_items"),
        F.sha2(F.array_join(F.coalesce("item_ids", F.array().cast("array<string>")), ","), 256).alias("items_sha256"),
        (n_items >= LEAST_ITEMS).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, least_items: int = LEAST_ITEMS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without those that hold windows of ``least_items`` benchmark items or more; all columns as given, whatever their names."""
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text).cast("string").alias("text"))
    with scratch() as keep:
        bad = keep(contamination(rows, benchmark).filter(F.col("n_items") >= least_items).select("doc_id", "h"), "contaminated")
    return without_rows(docs, bad, None, text, id_col)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = rf"""
with i as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
iw as (select distinct item, least(8, len(w)) as l, w[s : s + least(8, len(w)) - 1] as win
       from (select item, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) as s from i where len(w) > 0)),
d as (select doc_id, {_WORDS} as w from documents),
dw as (select doc_id, s, l, w[s : s + l - 1] as win
       from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) as s from d, (select distinct l from iw))),
hit as (select dw.doc_id, dw.s, dw.l, iw.item from dw join iw on dw.win = iw.win and dw.l = iw.l),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + l)) as p from hit) group by doc_id),
own as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hit group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from d left join pos using (doc_id) left join own using (doc_id)
"""
