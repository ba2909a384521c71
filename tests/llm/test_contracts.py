"""The registered queries on small tables, column by column, against SQL, the libraries or brute force."""

import collections
import hashlib
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_text_ops import PAGE, SCHEMA, fixture_rows, prose, shingles
from tidelake.llm import bpe, decontaminate, exact_dedup, html_extract, lang_id, line_dedup, near_dedup, registry, substring_dedup, token_counts, token_shards
from tidelake.llm.common import packaged
from tidelake.llm.shingles import shingle_sets

UP = {c: c - 32 for c in range(97, 123)}
ITEMS = [(0, " ".join(prose(150, 1).split()[10:30])), (1, " ".join(prose(150, 1).split()[40:48]).translate(UP)), (2, "two words"), (3, None), (4, "...")]
PAGES = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>just &eacute; text"), (5, "u", "<a href='" * 300), (1, "u", PAGE)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rows = [*fixture_rows(), (50, prose(1500, 60), "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


@pytest.fixture(scope="module")
def rows(spark, folder):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def counted(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("name, module", [("op1_decontaminate", decontaminate), ("op4_line_dedup", line_dedup), ("op5_exact_dedup", exact_dedup)])
def test_by_sql(spark, folder, rows, name, module):
    # a document of the contract is one row; repeated rows of one id are left to the tests of the operators
    once = spark.createDataFrame(list({i: (i, t) for i, t in rows if i is not None}.values()), "doc_id long, text string")
    at = f"{folder}/{name}"
    once.write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{at}/benchmark.parquet")
    got = registry.queries()[name](spark, at)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from read_parquet('{at}/{t}.parquet/*.parquet')")
    want = con.sql(module.ORACLE)
    assert counted(got, *want.columns) == collections.Counter(want.fetchall())
    if name == "op1_decontaminate":
        assert got.filter("contaminated").count() > 0


def test_op2(spark, folder):
    got = html_extract.op2_html_extract(spark, folder)
    w = html_extract.learn()
    want = collections.Counter((i, u, t := w.extract(h), len(t)) for i, u, h in PAGES)
    assert counted(got, "page_id", "url", "text", "n_chars") == want
    assert ("u", "just é text", 11) in {x[1:] for x in want}


@pytest.mark.parametrize("page", ["<div>" * 200_000, "<a href='" * 110_000, "<a href='" * 110_000 + "'>", "<div>" * 100_000 + "</section>" * 50_000, "<div>" * 60_000 + "<head><body>" * 50_000, "<script " * 120_000])
def test_hostile_pages_take_linear_time(page):
    w = html_extract.Weights({}, {}, 1)

    def seconds(x):
        began = time.process_time()
        w.extract(x)
        return time.process_time() - began

    # four times the page: far from sixteen times the time
    assert seconds(page) < 9 * max(seconds(page[: len(page) // 4]), 0.1)


def test_op3(spark, folder, rows):
    c = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        c.update(b[k : k + 200] for k in range(len(b) - 199))
    want = collections.Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 199):
            if c[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[(i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    assert counted(substring_dedup.op3_substring_dedup(spark, folder), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def by_brute_force(rows, threshold):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                root[find(a)] = find(b)
    return [find(k) for k in range(len(sets))]


def test_op6(spark, folder, rows):
    group = by_brute_force(rows, 85)
    low = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in group}
    want = collections.Counter((i, len(shingles(t)), low[group[k]], i == low[group[k]]) for k, (i, t) in enumerate(rows))
    assert counted(near_dedup.op6_near_dedup(spark, folder), "doc_id", "n_shingles", "component_id", "kept") == want


def test_long_regular_words_differ():
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    x, y = shingle_sets(pa.array([word, other]))
    assert len(x) == len(y) == 1 and x[0] != y[0]


def test_op7_op10(spark, folder, rows):
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(packaged(token_counts.VOCABULARY)), Tokenizer.from_file(packaged(bpe.VOCABULARY))
    n = [len(a.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    want = collections.Counter((i, len((t or "").encode()), k, k > 1024) for (i, t), k in zip(rows, n, strict=True))
    assert counted(token_counts.op7_token_counts(spark, folder), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert {x[3] for x in want} == {True, False}
    want = collections.Counter()
    for i, t in rows:
        ids = b.encode(t or "", add_special_tokens=False).ids
        text = b.decode(ids, skip_special_tokens=False)
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert counted(bpe.op10_bpe(spark, folder), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_op8(spark, folder, rows):
    got = lang_id.op8_language_id(spark, folder).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t in rows}
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, text[r["doc_id"]] or "")))


def test_language_sample(spark):
    """Whole texts, never held-out rows, bounded by rows a language, the same however the rows are dealt."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id"), F.lit(" end" * 300)).alias("text"), F.when(F.col("id") % 10 == 0, "rare").otherwise("often").alias("lang"))
    again = docs.unionByName(docs.filter("doc_id = 6").crossJoin(spark.range(3000)).select(docs.columns))
    got = lang_id._sample(docs.repartition(5), 60, "text", "doc_id", "lang")
    assert collections.Counter(k for k, _ in got) == {"rare": 60, "often": 60}
    assert all(t.endswith(" end" * 300) and zlib.crc32(t.split()[1].encode()) % 3 != 1 for _, t in got)
    assert got == lang_id._sample(again.repartition(2), 60, "text", "doc_id", "lang")


def test_op9(spark, folder, rows):
    got = sorted(token_shards.op9_token_shards(spark, folder).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in got] == list(range(len(got)))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packaged(token_shards.VOCABULARY))
    want = collections.Counter((i, len(t.encode(x or "", add_special_tokens=False).ids) + 1) for i, x in rows if i not in (3, None))
    n = collections.Counter()
    for r in got:
        if r["doc_id"] not in (3, None):
            n[r["doc_id"]] += r["n_tokens"]
    assert collections.Counter(n.items()) == want


CLASHING = ["_d_id", "_d_sha", "_own_id", "_own_sha", "_stay", "_m", "_bad_id", "_bad_h", "_runs", "_kept", "_slot", "row", "h", "stays", "slot", "found", "_doc", "_text", "lang_pred", "score", "comp", "size", "n", "a.b"]


@pytest.mark.parametrize("stage", ["language", "exact", "near", "benchmark", "lines"])
def test_clashing_columns_are_carried_along(spark, folder, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    run = {"language": lang_id.keep_identified, "exact": exact_dedup.exact_dedup, "near": near_dedup.near_dedup, "benchmark": lambda d: decontaminate.decontaminate(d, items, 1), "lines": line_dedup.line_dedup}[stage]
    plain = counted(run(docs), "doc_id", "text", "source")
    more = docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASHING})
    got = run(more)
    assert got.columns == more.columns
    found = got.collect()
    assert collections.Counter((r["doc_id"], r["text"], r["source"]) for r in found) == plain
    assert all(r[c] == f"{c}:{'-' if r['doc_id'] is None else r['doc_id']}" for r in found for c in CLASHING)
    assert run(more.limit(0)).count() == 0


def test_rows_of_one_id_are_told_apart(spark):
    a, b = prose(40, 70), prose(40, 71)
    df = spark.createDataFrame([(1, a), (3, b), (3, a), (3, b), (4, a.translate(UP)), (5, ""), (5, ""), (6, None)], "doc_id long, text string")
    assert counted(near_dedup.near_dedup(df), "doc_id", "text") == collections.Counter([(1, a), (3, b), (5, ""), (6, None)])
    assert counted(exact_dedup.exact_dedup(df), "doc_id", "text") == collections.Counter([(4, a.translate(UP)), (3, b), (6, None)])
    both = spark.createDataFrame([(7, a), (7, a.translate(UP)), (2, a)], "doc_id long, text string")
    left = exact_dedup.exact_dedup(both).collect()
    assert len(left) == 1 and left[0]["doc_id"] == 7


def test_full_filters_change_nothing(spark, folder, monkeypatch):
    """With one slot every row may be gone, and with a full bitmap every hash is possibly repeated."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = [counted(f(docs), "doc_id", "text") for f in (exact_dedup.exact_dedup, line_dedup.line_dedup)]
    from tidelake.llm import common

    monkeypatch.setattr(common, "SLOTS", 1)
    monkeypatch.setattr(exact_dedup, "MAX_BITS", 1)
    assert [counted(f(docs), "doc_id", "text") for f in (exact_dedup.exact_dedup, line_dedup.line_dedup)] == want


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage's rules, done one by one, with nulls, repeated rows and planted passages: the same rows, no more, no fewer."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    folder, sf = str(tmp_path), "/root/testdata/sf0.001"
    real = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(120).collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in real]
    long = [r for r in rows if r[1] and len(r[1].split()) > 120]
    rows += [(9001, f"{' '.join(reversed(long[0][1].split()))} {items[0][1]}", long[0][2], "x", 1), (9002, None, None, None, None), (9003, "", "en", "x", 0), (9004, "12 34 !", None, "x", 1)]
    rows += [(9005, long[1][1].upper(), long[1][2], "x", 1), (None, prose(60, 80), None, None, None), (9006, long[2][1] + " more words", long[2][2], "x", 1), rows[3], rows[3]]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    got = collections.Counter(tuple(r) for r in corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())

    model = lang_id.fit(spark.read.parquet(f"{folder}/documents.parquet"))
    from tidelake.llm.shingles import text_bytes

    left = []
    for i, t, *_ in rows:
        if any(map(str.isalpha, t or "")) and model.pooled(*text_bytes(pa.array([t]))).max() >= lang_id.LEAST_SCORE:
            left.append((i, t))
    low = {c: c + 32 for c in range(65, 91)}
    last = {}
    for i, t in left:
        k = t.translate(low)
        last[k] = max(last.get(k, (-1, "")), (-1 if i is None else i, t))
    left = sorted({(i, t) for i, t in left if last[t.translate(low)] == (-1 if i is None else i, t)}, key=str)
    group = by_brute_force(left, 80)
    first = {}
    for k, (i, t) in enumerate(left):
        first[group[k]] = min(first.get(group[k], (1 << 63, "")), (1 << 62 if i is None else i, t))
    left = [(i, t) for k, (i, t) in enumerate(left) if first[group[k]] == (1 << 62 if i is None else i, t)]

    def words(t):
        return [w for w in __import__("re").findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))]

    windows = collections.defaultdict(set)
    for _, t in items:
        w = words(t)
        n = min(8, len(w))
        windows[n] |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1) if n}
    clean = []
    for i, t in left:
        w = words(t)
        if not any(tuple(w[k : k + n]) in own for n, own in windows.items() for k in range(len(w) - n + 1)):
            clean.append((i, t))
    assert 9001 in {i for i, _ in left} and 9001 not in {i for i, _ in clean} and len(clean) > 60
    b = Tokenizer.from_file(packaged(bpe.VOCABULARY))
    want = collections.Counter()
    for i, t in clean:
        ids = b.encode(t, add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(b.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert got == want


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
