"""WARC archives, periodic runs and ranked search against plain versions, SQL and round trips."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pressline.llm import periodic_runs, queries, ranked_search, warc

from . import brute

# ---------------------------------------------------------------- archives

PAGES = [
    (1, "http://www.a.example:8080/x?q=1#top", "hi\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"),
    (2, "http://a.example/x", ""),
    (3, None, None),
    (None, "bad url\n\r", "hi\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"),
    (None, None, "only"),
    (None, None, "only"),
    (1, "http://www.a.example:8080/x?q=1#top", "hi\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"),
    (-5, "http://[bad", "é日\x00\U0001f600" * 10),
    (9, "http://b.example/", "x" * 400_000),
    (8, "http://b.example/", "x" * 400_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    """Rows with further columns named like the operator's own."""
    rows = [(*p, k, "y", "z", 7) for k, p in enumerate(PAGES)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, position int, record_type string, segment string, first int").repartition(3)


@pytest.mark.parametrize("size", [300, 16 << 20])
def test_archives_round_trip(spark, pages, tmp_path, monkeypatch, size):
    monkeypatch.setattr(warc, "SEGMENT_BYTES", size)
    folder = str(tmp_path / "archives")
    index = warc.captures(pages, folder=folder).toPandas().sort_values("position").reset_index(drop=True)
    assert list(index.position) == list(range(len(PAGES)))
    keys = [(r.url_key, r.captured, -math.inf if pd.isna(r.page_id) else r.page_id) for r in index.itertuples()]
    assert keys == sorted(keys)
    want = Counter((i, t or "") for i, _, t in PAGES)
    got = Counter((r.page_id, r.html) for r in warc.payloads(spark, folder).collect())
    assert got == want
    for r in index.itertuples():
        text = next(t or "" for i, _, t in PAGES if (pd.isna(r.page_id) and i is None and warc.payload_digest((t or "").encode()) == r.payload_digest) or i == r.page_id)
        assert r.payload_bytes == len(text.encode()) and r.payload_digest == warc.payload_digest(text.encode())
    kinds = sorted((None if pd.isna(r.page_id) else int(r.page_id), r.record_type, None if pd.isna(r.refers_to) else int(r.refers_to)) for r in index.itertuples() if not pd.isna(r.page_id))
    assert kinds == [(-5, "response", None), (1, "response", None), (1, "response", None), (2, "response", None), (3, "revisit", 2), (8, "response", None), (9, "revisit", 8)]
    # segments are bounded, but for a record that is longer than one
    assert all(len(gzip.decompress(r.content)) <= max(2 * size, 401_000) for r in warc.segments(spark, folder).collect())


def test_archives_of_an_empty_table(pages):
    assert warc.captures(pages.limit(0)).count() == 0


def test_hot_url_is_cut_into_ranges(spark):
    same = spark.range(5000).selectExpr("id as page_id", "'http://a.example/' as url", "concat('p', id % 1700) as html").repartition(4)
    out = warc.captures(same).toPandas().sort_values("position")
    assert list(out.page_id) == list(range(5000)) and (out.record_type == "response").sum() == 1700


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16, 33])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(50),) for _ in range(rng.randrange(20))) for _ in range(k)]
    assert list(warc.LoserTree(runs, key=lambda e: e)) == sorted(e for r in runs for e in r)


def test_damaged_payload_is_an_error():
    text = warc.record(1, "http://a.example/", 1, "abc", warc.payload_digest(b"abd"), None) + warc.RECORD_END
    (found,) = warc.parse(text.encode())
    with pytest.raises(ValueError, match="damaged payload"):
        warc._entry("f", *found)


# ---------------------------------------------------------------- periodic runs


def plain_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted((a, b, q) for (a, b), q in out.items())


def plain_query(doc, text):
    w = brute.WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc).encode())
    if doc is not None and n and h % 10 == 0:
        a, p = (h // 10) % n, 0
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    drop = {i for a, b, q in runs for i in range(a + q, b)}
    best = max(((b - a, -a, -q) for a, b, q in runs), default=None)
    top = (-best[1], best[0], -best[2], 1000 * best[0] // -best[2]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{a},{b - a},{q}\n" for a, b, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return (doc, len(runs), *top, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_transform_is_exact():
    rng = np.random.default_rng(2)
    for size in (2, 16, 256):
        plan = periodic_runs.Transform(size)
        a = rng.integers(0, periodic_runs.PRIME, (3, size)).astype(np.uint64)
        b = rng.integers(0, periodic_runs.PRIME, (3, size)).astype(np.uint64)
        product = plan.inverse(periodic_runs._mod(plan.forward(a.copy()) * plan.forward(b.copy())))
        want = [[sum(int(x[i]) * int(y[(d - i) % size]) for i in range(size)) % periodic_runs.PRIME for d in range(size)] for x, y in zip(a, b, strict=True)]
        assert product.tolist() == want


@pytest.mark.parametrize("most", [4, 1 << 20])
def test_runs_equal_plain_search(monkeypatch, most):
    monkeypatch.setattr(periodic_runs, "MOST_BLOCK", most)  # windows in several pieces
    rng = random.Random(most)
    for _ in range(250):
        docs = []
        for _ in range(rng.randint(1, 5)):
            n, k = rng.choice([0, 1, 11, 12, 13, 30, 90, 260]), rng.choice([1, 2, 2, 3, 5, 30])
            w = [rng.randrange(k) for _ in range(n)]
            if n > 20 and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + rng.randrange(max(1, (n - a) // 2))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            if n > 20 and rng.random() < 0.3:
                w[rng.randrange(n)] = 99
            docs.append(w)
        bounds = np.cumsum([0] + [len(d) for d in docs])
        want = sorted((a + o, b + o, q) for d, o in zip(docs, bounds[:-1], strict=True) for a, b, q in plain_runs(d))
        assert periodic_runs.find_runs(np.array(sum(docs, []), np.int64), bounds) == want


def test_periodic_query_on_nasty_rows(spark, docs, texts, sf_dir):
    got = sorted((tuple(r) for r in queries.op12_periodic_runs(spark, sf_dir).collect()), key=str)
    small = [(i, t) for i, t, _ in texts if len(t or "") < 20_000]
    want = sorted((plain_query(i, t) for i, t in small), key=str)
    assert [r for r in got if r[0] not in (11, 12, 14)] == [r for r in want if r[0] not in (11, 12, 14)]
    long = {r[0]: r for r in got}
    assert long[11][1:5] == (1, 0, 20_000, 5) and long[12][1:5] == (1, 0, 20_000, 5) and long[14][1] == 0
    assert periodic_runs.periodic_runs(docs).count() == len(texts)


def test_periodic_query_on_a_table(spark, sf):
    table = pd.read_parquet(f"{sf}/documents.parquet")
    short = {int(i): t for i, t in zip(table.doc_id, table.text, strict=True) if len(t or "") < 4000}
    got = {r[0]: tuple(r) for r in queries.op12_periodic_runs(spark, sf).collect()}
    assert len(got) == len(table)
    for i, t in short.items():
        assert got[i] == plain_query(i, t)
    assert sum(r[1] > 0 for r in got.values()) > 10


def test_a_period_in_a_text_of_very_many_words():
    w = np.arange(300_000) % 70_001
    w[-5:] = -np.arange(5) + 500_000
    assert periodic_runs.find_runs(w, np.array([0, len(w)])) == [(0, 299_995, 70_001)]
    ones = np.zeros(200_000, np.int64)
    assert periodic_runs.find_runs(ones, np.array([0, 3, len(ones)])) == [(3, 200_000, 1)]


def test_periodic_runs_of_an_empty_table(empty):
    assert periodic_runs.periodic_runs(empty).count() == 0


# ---------------------------------------------------------------- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(rows, items, k=20):
    terms = [(d, Counter(TERM.findall(brute.lower(t)))) for d, t in rows]
    terms = [(d, c) for d, c in terms if c]
    total, tokens = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in terms:
            m = 75 + 25 * sum(c.values()) * total // tokens
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in TERM.findall(brute.lower(text)) if c[t])
            if s > 0 and d is not None:
                scores.append((-s, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(docs, items, **more):
    return sorted((tuple(r) for r in ranked_search.search(docs, items, **more).select("item_id", "rank", "doc_id", "score").collect()), key=str)


ITEMS = [(1, "alpha3 BETA3 word4; part4 item4 word4"), (2, "one two"), (3, None), (4, ""), (5, "lorem ipsum Ünïcödé 日本語 never"), (None, "two three"), (2, "one two"), (6, "nowhere")]


@pytest.mark.parametrize("k", [1, 3, 20])
def test_search_on_nasty_rows(spark, docs, texts, k):
    items = spark.createDataFrame([(*i, 1, 2.0) for i in ITEMS], "item_id long, text string, rank int, score double")
    assert found(docs, items, k=k) == plain_search([(i, t) for i, t, _ in texts], ITEMS, k)


def test_search_with_small_trees_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "CHUNK_DOCUMENTS", 64)
    monkeypatch.setattr(ranked_search, "LEAF_DOCUMENTS", 1)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(30)], k=rng.choice([1, 3, 8, 40])))) for i in rng.sample(range(5000), 700)]
    rows += [(9000 + i, "w3 w9 w20") for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 10, 40])))) for i in range(25)] + [(99, "w3 w9 w20")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(docs, spark.createDataFrame(items, "item_id long, text string")) == plain_search(rows, items)


def test_tree_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    tf = rng.poisson(0.4, (9, 4000)).astype(np.int64)
    m = rng.integers(76, 900, 4000)
    tree = ranked_search.Tree(rng.integers(1, 9000, 9), tf, m, rng.permutation(4000))
    exact = tree.score(tree.tf, tree.m)
    cuts = np.arange(0, 4000, 37)
    bounds, least = tree.nodes(0, cuts, 4000)
    for a, b, top, low in zip(cuts, [*cuts[1:], 4000], bounds, least, strict=True):
        assert exact[a:b].max() <= top and tree.doc[a:b].min() == low
    best = ranked_search.Best(20)
    visited = tree.search(best)
    order = np.lexsort((tree.doc, -exact))[:20]
    assert best.doc.tolist() == tree.doc[order].tolist() and visited < 600


def test_search_in_blocks_of_items(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_CHARS", 30)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert found(docs, items) == plain_search([(i, t) for i, t, _ in texts], ITEMS)


def test_search_of_empty_tables(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert found(empty, items) == [] and found(docs, items.limit(0)) == []


# ---------------------------------------------------------------- SQL


@pytest.mark.parametrize("name", ["op11_warc", "op13_ranked_search"])
def test_queries_match_their_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, sf).toPandas()[list(want.columns)]
    keys = list(want.columns[:2])
    pd.testing.assert_frame_equal(*(d.sort_values(keys).reset_index(drop=True) for d in (got, want)), check_dtype=False)


def test_words_and_terms_are_split_like_the_expressions():
    rng = random.Random(6)
    alphabet = list("aZ9 \t\n\x0b\x0c\r\x00-_'é日 \u0085 ") + ["\x7f", "\U0001f600"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(30))) for _ in range(500)]
    offsets, flat = periodic_runs.split(pa.array(texts))
    codes, cuts, dictionary = ranked_search.split_terms(pa.array(texts))
    for i, t in enumerate(texts):
        assert flat[offsets[i] : offsets[i + 1]].to_pylist() == brute.WORD.findall(t)
        assert dictionary.take(pa.array(codes[cuts[i] : cuts[i + 1]])).to_pylist() == TERM.findall(brute.lower(t))


def test_every_result_keeps_all_rows(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    out = periodic_runs.periodic_runs(spark.read.parquet(f"{sf}/documents.parquet").withColumn("runs", F.lit(1)))
    assert out.count() == n
