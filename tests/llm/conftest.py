import pyarrow as pa
import pyarrow.parquet as pq
import pytest

#: Nulls, empty and very long texts, ties, repeats and odd characters; columns as in ``documents``.
LONG = "lorem ipsum dolor sit amet " * 4000
BASE = [f"word{i} part{i % 7} item{i % 11} alpha{i} beta{i % 5}" for i in range(40)]
TEXTS = [
    (1, None, None),
    (2, "", "en"),
    (3, " \t\n", "en"),
    (4, "One two three four five six seven.", "en"),
    (5, "one TWO three four five six seven.", "en"),
    (6, "one two", "en"),
    (7, "one two", None),
    (7, "one two", "en"),
    (8, " ".join(BASE), "en"),
    (9, " ".join(BASE[:39]) + " changed", "en"),
    (10, " ".join(BASE[1:]), "en"),
    (11, LONG, "de"),
    (12, LONG + "end", "de"),
    (13, "1234 5678 !!! ---", "fr"),
    (14, "x" * 50_000, "fr"),
    (15, "Ünïcödé ß Straße İstanbul ΣΑΣ 日本語 " * 5, "de"),
    (16, "mail a.b@c-d.example, ip 10.0.0.255 and 10.0.0.256, card 4111 1111 1111 1111, call +1 (017) 555-7713", "en"),
    (17, "<|endoftext|> it's we're 'll 12 <|startoftext|> dońt", "en"),
    (None, "a text without an id at all here", "en"),
]


@pytest.fixture(scope="session")
def texts():
    return TEXTS


@pytest.fixture(scope="session")
def docs(spark):
    """The rows with further columns whose names an operator might use itself."""
    rows = [(i, t, lang, f"src{k % 3}", k, k, "x", "y", b"z") for k, (i, t, lang) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, sig string, kept string, digest binary").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def sf_dir(tmp_path_factory, texts):
    """A folder of tables as the queries read them."""
    folder = tmp_path_factory.mktemp("tables")
    kept = [(i, t, lang) for i, t, lang in texts]
    table = pa.table({"doc_id": [r[0] for r in kept], "text": [r[1] for r in kept], "lang": [r[2] for r in kept], "source": ["s"] * len(kept), "n_chars": [len(r[1] or "") for r in kept]})
    pq.write_table(table, folder / "documents.parquet")
    items = [(1, "alpha3 beta3 word4 part4 item4 alpha4 beta4 word5 part5 item5"), (2, "one two"), (3, None), (4, ""), (5, "never seen words of an item here")]
    pq.write_table(pa.table({"item_id": [i for i, _ in items], "text": [t for _, t in items]}), folder / "benchmark.parquet")
    pq.write_table(pa.table({"doc_id": [4, 5, 6, 8], "quality": [1, 1, 0, 1], "toxic": [0, 0, 1, 0]}), folder / "labels.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
