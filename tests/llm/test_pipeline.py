"""The pipeline against its stages done plainly, and the package's place in the library."""

import re
from collections import defaultdict
from pathlib import Path

import pandas as pd
import pytest

import corpus_pipeline
from pressline.llm import decontaminate, exact_dedup, ngram_join, queries

from . import brute

ROOT = Path(__file__).resolve().parents[2]


def plain(rows, items):
    """Ids that each stage keeps, without the rows that have no id."""
    kept = [(d, t) for d, t in rows if re.search(r"[^\W\d_]", t or "")]
    out = [[d for d, _ in kept]]
    groups = defaultdict(list)
    for d, t in kept:
        groups[brute.lower(t)].append(d)
    best = {max(v, key=lambda d: -1 if d is None else d) for v in groups.values()}
    kept = [(d, t) for d, t in kept if d is None or d in best]
    kept = [row for k, row in enumerate(kept) if row[0] is None or row not in kept[:k]]  # one of full repeats
    out.append([d for d, _ in kept])
    component = {d: c for d, _, c in brute.components(kept)}
    kept = [(d, t) for d, t in kept if d is None or component[d] == d]
    out.append([d for d, _ in kept])
    bad = {d for d, _, _ in brute.contained(kept, items)}
    kept = [(d, t) for d, t in kept if d not in bad]
    out.append([d for d, _ in kept])
    return out


@pytest.mark.parametrize("which", ["fixture", "table"])
def test_stages_keep_what_plain_versions_keep(spark, sf_dir, sf, tmp_path, which):
    folder = sf_dir if which == "fixture" else sf
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    key = lambda d: -1 if d is None else d
    for k, ((name, stage), want) in enumerate(zip(corpus_pipeline.STAGES[:-1], plain(rows, items), strict=True)):
        out = stage(spark, docs, folder)
        assert out.columns == columns, name
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert sorted((r.doc_id for r in docs.select("doc_id").collect()), key=key) == sorted(want, key=key), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).toPandas()
    assert sorted(map(key, packed[packed.start == 0].doc_id.astype(object).where(packed.doc_id.notna(), None))) == sorted(map(key, want))


def test_empty_documents(spark, sf_dir, empty):
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0, name


def test_decisions_are_by_row(spark):
    rows = [(1, "a b"), (2, "A b"), (1, "c d"), (3, "e f"), (3, "e f"), (None, "a b"), (None, "a b")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _key int").repartition(3)
    out = exact_dedup.drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, [(2, "A b"), (1, "c d"), (3, "e f"), *rows[5:]]))

    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(1, long), (2, long + " more"), (2, "another text"), (1, long + " end"), (1, "alone here"), (1, None), (5, "x y z"), (None, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in ngram_join.drop_near_duplicates(docs).collect()]
    assert sorted(map(str, (r for r in kept if r not in (rows[0], rows[3])))) == sorted(map(str, [rows[2], *rows[4:]]))
    assert (rows[0] in kept) != (rows[3] in kept)  # both have the group's smallest id

    docs = spark.createDataFrame([(1, "zz alpha beta gamma"), (1, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    assert [(r.doc_id, r.text) for r in decontaminate.drop_contaminated(docs, items).collect()] == [(1, "clean")]


def test_nothing_learned_rejects_only_texts_without_letters(spark):
    docs = spark.createDataFrame([(1, "some words", None), (1, "12 34", None), (2, None, None)], "doc_id long, text string, lang string")
    assert [(r.doc_id, r.text) for r in corpus_pipeline.language(spark, docs, "").collect()] == [(1, "some words")]


def test_queries_are_registered(sf):
    import __spark_entry__ as contract

    assert set(queries.QUERIES) | {"pipeline"} <= set(contract.queries())
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in queries.QUERIES}


def test_nothing_else_imports_the_package():
    for path in [*ROOT.glob("pressline/**/*.py"), ROOT / "bench.py"]:
        if path.parent.name != "llm":
            assert not re.search(r"\bllm\b", path.read_text()), path


def test_dedup_query_matches_its_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    for name in ["op4_exact_dedup"]:
        want = con.execute(queries.ORACLES[name]).df()
        got = queries.QUERIES[name](spark, sf).toPandas()[list(want.columns)]
        pd.testing.assert_frame_equal(*(d.sort_values("doc_id").reset_index(drop=True) for d in (got, want)), check_dtype=False)
