"""Tables through their life, with a fixed clock."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelake.plans.metadata import fast_count, pushed
from tidelake.sources import find, read_text, to_timestamp_by_magnitude, unescape
from tidelake.storage import ReadOnlyError, Store
from tidelake.streaming import stream_into

NOW = datetime(2025, 1, 15, 12)
SCHEMA = "ts timestamp_ntz, id int, device int, bucket string, val int"


def rows(spark, moments):
    return spark.createDataFrame([(t, i, i % 3, "abc"[i % 3], i * 10) for i, t in enumerate(moments)], SCHEMA)


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/tables")
    s.create_table("m", SCHEMA, "ts", now=NOW)
    s.set_layout("m", ["device"], ["ts", "id"], 5)
    return s


def day(d, **more):
    return datetime(2025, 1, d) + timedelta(**more)


EDGES = [day(14), day(14, microseconds=1), day(15) - timedelta(microseconds=1), day(15), day(16, hours=3), day(17), day(10), day(25), day(18, hours=23)]


def test_creation(store):
    names = [s.name for s in store.catalog.load("m").ranged()]
    assert names == [f"m_p202501{d}" for d in (14, 15, 16, 17, 18)]
    assert "already" in store.create_table("m", SCHEMA, "ts")
    with pytest.raises(ValueError):
        store.create_table("x", SCHEMA, "val")
    with pytest.raises(ValueError):
        store.create_table("x", SCHEMA, "ts", "1 month")


def test_sub_day_names(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/t")
    s.create_table("h", SCHEMA, "ts", "6 hours", 1, now=NOW)
    assert [x.name for x in s.catalog.load("h").ranged()] == ["h_p20250115_0600", "h_p20250115_1200", "h_p20250115_1800"]


def test_routing_and_boundaries(spark, store):
    store.append("m", rows(spark, EDGES))
    t = store.catalog.load("m")
    got = {s.name: spark.read.parquet(*s.paths).count() for s in t.slices if s.paths}
    assert got == {"m_p20250114": 3, "m_p20250115": 1, "m_p20250116": 1, "m_p20250117": 1, "m_p20250118": 1, "_default": 2}
    assert store.read("m").count() == 9
    assert store.read("m", day(15), day(17)).count() == 2
    assert store.read("m", day(14), day(14, microseconds=1)).count() == 1


def test_layouts_agree(spark, store):
    store.append("m", rows(spark, EDGES * 3))
    before = sorted(map(tuple, store.read("m").collect()))
    assert store.seal_closed("m", day(17)) == ["m_p20250114", "m_p20250115", "m_p20250116"]
    assert sorted(map(tuple, store.read("m").collect())) == before
    assert not store.seal("m", "m_p20250114")
    assert store.unseal("m", "m_p20250114")
    assert sorted(map(tuple, store.read("m").collect())) == before


def test_pruning(spark, store):
    store.append("m", rows(spark, EDGES))
    store.seal_closed("m", day(18))
    found = store.slices_between("m", day(15), day(16))
    assert {s.name for s in found} == {"m_p20250115", "_default"}
    plan = store.read("m", day(15), day(16))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts)" in plan or "GreaterThanOrEqual(ts" in plan


def test_sealed_is_read_only(spark, store):
    store.append("m", rows(spark, EDGES))
    store.seal("m", "m_p20250114")
    with pytest.raises(ReadOnlyError):
        store.append("m", rows(spark, [day(14, hours=2)]))
    with pytest.raises(ReadOnlyError):
        store.delete_where("m", "id = 1")
    assert store.read("m").count() == 9


def test_delete_in_open_slices(spark, store):
    store.append("m", rows(spark, EDGES))
    store.delete_where("m", "id < 2")
    assert store.read("m").count() == 7


def test_statistics_answer(spark, store):
    store.append("m", rows(spark, EDGES))
    store.seal_closed("m", day(18))
    for lo, hi in ((None, None), (day(14), day(16)), (day(14, microseconds=1), day(18, hours=23)), (day(2), day(3))):
        df = store.read("m", lo, hi)
        want = df.agg(F.count("*"), F.count("val"), F.min("val"), F.max("val"), F.sum("val")).first()
        got = store.aggregate("m", "val", lo, hi).first()
        assert tuple(None if x is None else int(x) for x in got) == tuple(want), (lo, hi)
    assert tuple(store.aggregate("m", "ts").first())[2:4] == (day(10), day(25))
    assert [r["id"] for r in store.newest("m", 3).collect()] == [7, 8, 5]


def test_drain_and_premake(spark, store):
    store.append("m", rows(spark, EDGES))
    assert store.drain_default("m") == 2
    t = store.catalog.load("m")
    assert not t.default.paths and t.find("m_p20250110").paths and t.find("m_p20250125").paths
    assert store.drain_default("m") == 0
    assert store.read("m").count() == 9


def test_before_1970(spark, store):
    store.append("m", rows(spark, [datetime(1969, 12, 31, 23)]), make_slices=True)
    assert store.catalog.load("m").find("m_p19691231").paths


def test_retention(spark, store):
    store.append("m", rows(spark, EDGES))
    store.set_retention("m", "3 days")
    # the slice of the 14th ends exactly at the edge and stays
    assert store.drop_expired("m", day(18)) == []
    assert store.drop_expired("m", day(18, seconds=1)) == ["m_p20250114"]
    assert store.read("m").count() == 6
    store.set_retention("m", "1 month")
    store.remove_retention("m")
    assert store.drop_expired("m", day(30)) == []


def test_maintain(spark, store):
    store.append("m", rows(spark, EDGES))
    store.set_compression_policy("m", "1 day")
    store.set_retention("m", "4 days")
    done = store.maintain("m", day(16, hours=12))
    assert done == {"drained": 2, "sealed": ["m_p20250110", "m_p20250114"], "dropped": ["m_p20250110"]}
    assert store.catalog.load("m").find("m_p20250119")


def test_columns(spark, store):
    store.append("m", rows(spark, EDGES[:4]))
    store.seal("m", "m_p20250114")
    store.add_column("m", "tag", "string", "'x'")
    extra = rows(spark, [day(16)]).withColumn("tag", F.lit(None).cast("string"))
    store.append("m", extra)
    assert sorted(r["tag"] or "" for r in store.read("m").collect()) == ["", "x", "x", "x", "x"]
    with pytest.raises(ValueError):
        store.add_column("m", "tag", "string")
    with pytest.raises(ValueError):
        store.add_column("m", "r", "double", "rand()")
    with pytest.raises(ValueError):
        store.add_column("m", "n", "int", None, not_null=True)
    with pytest.raises(ReadOnlyError):
        store.rename_column("m", "val", "value")
    with pytest.raises(ValueError):
        store.drop_column("m", "device")
    store.drop_column("m", "val")
    store.add_column("m", "val", "int", "5")
    assert {r["val"] for r in store.read("m").collect()} == {5}
    with pytest.raises(ValueError):
        store.alter_column("m", "id", "long")


def test_rename_open(spark, store):
    store.append("m", rows(spark, EDGES))
    store.rename_column("m", "val", "value")
    assert store.read("m").agg(F.sum("value")).first()[0] == 360


def test_information(spark, store):
    store.append("m", rows(spark, EDGES))
    store.seal("m", "m_p20250114")
    assert store.slice_info("m").filter("sealed").count() == 1
    assert store.table_info().first()["slices"] == 6
    s = store.compression_stats("m").filter("sealed").first()
    assert s["rows"] == 3 and s["bytes"] > 0
    assert store.table_size("m") > 0
    store.analyze("m")


def test_missing_and_extra_columns(spark, store):
    df = rows(spark, EDGES).withColumnRenamed("val", "VAL").withColumn("extra", F.lit(1))
    store.append("m", df.drop("device"))  # a segment_by column may be missing
    assert store.read("m").agg(F.sum("val"), F.count("device")).first() == (360, 0)
    with pytest.raises(ValueError):
        store.append("m", df.drop("bucket"))


def test_text_escapes(spark, tmp_path):
    (tmp_path / "a.txt").write_text("k\tv\n1\ta\\tb\\\\c\n2\t\\N\n3\t\\x41\\102\\n\\q\n4\tx\\\ty\n")
    df = read_text(spark, f"file://{tmp_path}/a*.txt", "k int, v string", header="match")
    assert [tuple(r) for r in df.orderBy("k").collect()] == [(1, "a\tb\\c"), (2, None), (3, "AB\nq"), (4, "x\ty")]
    with pytest.raises(ValueError):
        read_text(spark, f"file://{tmp_path}/a.txt", "k int, w string", header="match")
    with pytest.raises(FileNotFoundError):
        find(spark, f"file://{tmp_path}/none*.txt")
    assert spark.range(1).select(unescape(F.lit("plain"))).first()[0] == "plain"


@pytest.mark.parametrize("scale", [1, 1_000, 1_000_000, 1_000_000_000])
def test_time_units(spark, scale):
    df = spark.createDataFrame([(None,), (1_700_000_000 * scale,)], "t long")
    got = to_timestamp_by_magnitude(df, "t").filter("t is not null").first()[0]
    assert got == datetime(2023, 11, 14, 22, 13, 20)


def test_stream(spark, store, tmp_path):
    rows(spark, EDGES).write.parquet(f"file://{tmp_path}/feed")
    store.append("m", rows(spark, [day(14, hours=1)]))
    store.seal("m", "m_p20250114")
    feed = spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/feed")
    for _ in range(2):  # the second run finds nothing new
        stream_into(store, "m", feed, f"file://{tmp_path}/progress").awaitTermination()
    assert store.read("m").count() == 10
    assert spark.read.parquet(*store.catalog.load("m").default.paths).count() == 3


def test_footer_aggregates(spark, tmp_path):
    spark.range(1000).write.parquet(f"file://{tmp_path}/p")
    spark.conf.set("spark.sql.sources.useV1SourceList", "")
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    try:
        df = fast_count(spark.read.parquet(f"file://{tmp_path}/p"))
        assert pushed(df) == ["COUNT(*)"] and df.first()[0] == 1000
    finally:
        spark.conf.unset("spark.sql.sources.useV1SourceList")
        spark.conf.unset("spark.sql.parquet.aggregatePushdown")


@pytest.mark.parametrize("name", ["text", "csv", "parquet"])
def test_loads_take_the_whole_table(spark, name):
    from tidelake.queries import lifecycle

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert events.filter("event_id >= 500").count() > 0
    got = getattr(lifecycle, f"{name}_loaded")(spark, events).select(*events.columns)
    assert got.exceptAll(events).isEmpty() and events.exceptAll(got).isEmpty()


@pytest.mark.parametrize("v1", ["text", ""])
def test_text_headers_go_by_position(spark, tmp_path, v1):
    files = {"a": ["k\tv", "1\tx", "k\tv", "2\ty"], "b": ["K\tV", "3\tz"], "c": ["k\tv"], "d": []}
    for name, lines in files.items():
        (tmp_path / f"{name}.txt").write_text("".join(f"{line}\n" for line in lines))
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    spark.conf.set("spark.sql.sources.useV1SourceList", v1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9")
    try:
        got = read_text(spark, f"{tmp_path}/*.txt", "k string, v string", header=True).collect()
        with pytest.raises(ValueError, match="does not match"):
            read_text(spark, f"{tmp_path}/*.txt", "k string, v string", header="match")
    finally:
        spark.conf.set("spark.sql.sources.useV1SourceList", before)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(tuple, got)) == [("1", "x"), ("2", "y"), ("3", "z"), ("k", "v")]


def test_text_splits_after_any_number_of_backslashes(spark, tmp_path):
    pair = "\\" * 2
    lines = [pair * 100 + "\tx", pair * 100 + "\\\ty\tz", "\t", "a\t\\\t"]
    (tmp_path / "a.txt").write_text("".join(f"{line}\n" for line in lines))
    got = read_text(spark, f"{tmp_path}/a.txt", "k string, v string").collect()
    assert sorted(map(tuple, got)) == sorted([("\\" * 100, "x"), ("\\" * 100 + "\ty", "z"), ("", ""), ("a", "\t")])
