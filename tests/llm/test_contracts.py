"""Every contract's columns against plain versions: nasty rows and the smallest tables."""

import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from pressline.llm import decontaminate, exact_dedup, html_template, katz, lang_id, ngram_join, packing, pii, queries, secrets, toxicity

from . import brute


def both(texts, sf):
    table = pd.read_parquet(f"{sf}/documents.parquet")
    return [(i, t) for i, t, _ in texts] + [(int(i) + 1000, t) for i, t in zip(table.doc_id, table.text, strict=True)]


@pytest.fixture(scope="module")
def rows(texts, sf):
    return both(texts, sf)


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()


def test_exact_groups(frame, rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[brute.lower(t)].append(d)
    keep = {t: max((d for d in v if d is not None), default=None) for t, v in groups.items()}
    import hashlib

    want = sorted(((d, keep[brute.lower(t)], len(groups[brute.lower(t)]), d is not None and d == keep[brute.lower(t)], hashlib.sha256(brute.lower(t).encode()).hexdigest()) for d, t in rows), key=str)
    assert sorted((tuple(r) for r in exact_dedup.exact_duplicates(frame).collect()), key=str) == want


def test_one_text_in_all_rows(spark):
    same = spark.range(3000).selectExpr("id as doc_id", "'Same TEXT' as text")
    out = exact_dedup.exact_duplicates(same).collect()
    assert len(out) == 3000 and {(r.keep_id, r.group_size) for r in out} == {(2999, 3000)} and sum(r.kept for r in out) == 1


def test_jaccard_groups(frame, rows):
    assert sorted((tuple(r) for r in ngram_join.jaccard_groups(frame).collect()), key=str) == brute.components(rows)


def test_jaccard_of_many_near_copies(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for j in rng.choice(60, rng.integers(0, 3), replace=False):
            w[j] = f"x{i}_{j}"
        rows.append((i, " ".join(w)))
    # a chain: each is near the next one only, and texts that share a passage without being near
    rows += [(200 + i, " ".join(f"c{j}" for j in range(5 * i, 5 * i + 60))) for i in range(8)]
    rows += [(300 + i, " ".join(base[:30] + [f"y{i}_{j}" for j in range(40)])) for i in range(40)]
    out = ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((tuple(r) for r in out), key=str) == brute.components(rows)


def test_salted_columns_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COLUMN_ROWS", 5)
    rows = [(i, " ".join([f"w{j}" for j in range(80)] + [f"z{i}"])) for i in range(60)]
    out = ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in out} == {0}


def _edited_copies(count, seed):
    rng = random.Random(seed)
    base = [f"common{i}" for i in range(80)]
    rows = [(0, " ".join(base))]
    for i in range(1, count):
        words = list(base)
        for at in rng.sample(range(80), rng.choice([1, 2, 3, 3, 4, 5])):
            words[at] = f"own{i}x{at}" if rng.random() < 0.8 else f"swap{at}"
        rows.append((i, " ".join(words)))
    # a passage of most of their shingles, which is not enough to link them
    rows += [(1000 + i, " ".join(f"passage{j}" for j in range(19)) + "".join(f" rest{i}x{j}" for j in range(5))) for i in range(60)]
    return rows


@pytest.mark.parametrize("column_rows, rounds, whole", [(20_000, 2, True), (7, 2, False), (7, 0, True)])
def test_jaccard_of_edited_copies_around_a_text(spark, monkeypatch, column_rows, rounds, whole):
    monkeypatch.setattr(ngram_join, "COLUMN_ROWS", column_rows)
    monkeypatch.setattr(ngram_join, "NEIGHBOUR_ROUNDS", rounds)
    rows = _edited_copies(150, column_rows + rounds)
    if not whole:
        rows = rows[1:]  # no text in the middle: only the last pass can find some of the links
    out = ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((tuple(r) for r in out), key=str) == brute.components(rows)


def test_personal_data(spark, frame, rows):
    odd = [(5000, "1.2.3.4.5 +1--2 +49 (0) 30-123456 4111-1111-1111-1111 a@b a@b.c..d x@@y.z 00000000000000"), (5001, "9" * 30_000), (5002, "a" * 30_000 + "@"), (5003, "999.1.1.1 255.255.255.255.1")]
    more = frame.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = queries._digests(pii.personal_data(more), pii.BASE_KINDS).collect()
    want = defaultdict(list)
    for d, t in rows + odd:
        spans = brute.personal(t)
        want[d].append((*(sum(s[0] == k for s in spans) for k in pii.BASE_KINDS), brute.digest(spans)))
    found = defaultdict(list)
    for r in got:
        found[r.doc_id].append((r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}


def test_further_personal_data():
    kinds = lambda t: [s.kind for s in pii.find(t)]
    assert "iban" in kinds("transfer to DE89 3704 0044 0532 0130 00 today")
    assert "iban" not in kinds("transfer to DE88 3704 0044 0532 0130 00 today")
    assert "national" in kinds("her ssn 123-45-6789") and "national" not in kinds("part 123-45-6789")
    assert pii.find("")== []


def test_secrets(spark, frame, rows):
    odd = [(6000, 'TOKEN: "abcdef" ſecret=abcdef Password = abc api_key=1234567 AKIA' + "A" * 16 + " " + "f" * 24), (6001, "token" + " " * 20_000 + "="), (6002, "a" * 100_000)]
    got = queries._digests(secrets.secrets(frame.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))), secrets.BASE_KINDS).collect()
    want, found = defaultdict(list), defaultdict(list)
    for d, t in rows + odd:
        spans = brute.credentials(t)
        want[d].append((*(sum(s[0] == k for s in spans) for k in secrets.BASE_KINDS), brute.digest(spans)))
    for r in got:
        found[r.doc_id].append((r.n_assign, r.n_access, r.n_hex, r.base_sha256))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}


def test_linked_credentials():
    weak = "Zx81kQ07bmRt55Wq"
    kinds = lambda t: [s.kind for s in secrets.find(t)]
    assert "linked" in kinds(f"login: jane {weak} at https://db.example.com/x")
    assert "linked" not in kinds(f"only {weak} here")
    assert "linked" not in kinds(f"login: jane {weak}")
    assert "linked" not in kinds(f"login: jane at https://db.example.com/x\n\n{weak}")
    assert kinds("") == []


def test_linked_credentials_of_any_length_and_distance():
    linked = lambda t: [(t[s.start : s.end], s.score) for s in secrets.find(t) if s.kind == "linked"]
    key, session = "AKIA" + "Q7" * 8, "FwoGZXIvYXdzEJr9/x+4" * 20
    assert linked(f"{key} {session}") == [(session, secrets.HALF / (secrets.HALF + 1))]
    config = "\n".join(f"option{i} on" for i in range(100))
    far = linked(f"https://db.example.com/x\n{config}\nlogin: jane\nZx81kQ07bmRt55Wq")
    assert [w for w, _ in far] == ["Zx81kQ07bmRt55Wq"] and 0 < far[0][1] < 0.5
    assert linked(f"https://db.example.com/x\nlogin: jane\n{config}\n\nZx81kQ07bmRt55Wq") == []


def test_scopes_end_at_empty_lines_of_any_kind():
    parts = ["username: alice_example", "https://host.example/login", "Zk3rT9xQ2mV7bN4cL8"]
    linked = lambda sep: any(s.kind == "linked" for s in secrets.find(sep.join(parts)))
    assert linked("\n") and linked("\r\n") and not linked("\n\n") and not linked("\r\n\r\n")
    long = secrets.find("username: " + "a1" * 60 + " at https://host.example/" + "b2" * 400)
    assert not [s for s in long if s.kind == "linked"]


def test_packing_round_trip(frame, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.WORDS)
    ids = defaultdict(list)
    for d, t in rows:
        ids[d].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    out = queries.packed(frame).toPandas()
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    for doc, own in out.groupby("doc_id", dropna=False):
        texts = ids[None if pd.isna(doc) else doc]
        for t in {tuple(x) for x in texts}:
            n = sum(tuple(x) == t for x in texts)
            mine = [r for r in own.itertuples() if r.doc_tokens == len(t)]
            assert sorted((r.start, r.length, crc(t[r.start : r.start + r.length])) for r in mine)[::n] == sorted((r.start, r.length, r.ids_crc32) for r in mine)[::n]
            assert sum(r.length for r in mine) == n * len(t)
    for _, own in out.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert list(own.offset) == list(np.cumsum(own.length) - own.length) and own.length.sum() <= packing.CAPACITY
        assert (own.sequence_tokens == own.length.sum()).all()


def test_differencing():
    assert sorted(map(sum, ([[8, 7, 6, 5, 4][i] for i in s] for s in packing.differencing([8, 7, 6, 5, 4], 2)))) in ([14, 16], [15, 15])
    rng = np.random.default_rng(0)
    for _ in range(30):
        sizes = rng.integers(1, 1025, rng.integers(1, 300)).tolist()
        sets = packing.windows(sizes)
        assert sorted(i for s in sets for i in s) == list(range(len(sizes)))
        sums = [sum(sizes[i] for i in s) for s in sets]
        assert max(sums) <= packing.CAPACITY
    assert packing.windows([]) == []


def test_katz(frame, rows):
    train = frame.where(queries.remainder("doc_id", 7) != 2)
    model = katz.fit(train)
    out = katz.score(frame, model).collect()
    want, found = defaultdict(list), defaultdict(list)
    for d, *x in brute.base_scores(rows):
        want[d].append([*x[:3], round(x[3], 6)])
    for r in out:
        found[r.doc_id].append([r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)])
        assert np.isfinite(r.score) and r.score < 0
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    held = [r for r in out if r.held_out]
    assert held and all(brute.crc(r.doc_id, 7) == 2 for r in held)


def test_katz_is_normalised_and_recursive(spark):
    texts = [(1, "a b a b a c"), (2, "a b c a b"), (3, "b a b c c a b"), (4, "d a b")]
    model = katz.fit(spark.createDataFrame(texts, "doc_id long, text string"))
    words = {r.w: r for r in model.words.collect()}
    assert abs(sum(10**r.log_p for r in words.values()) + 10**model.log_unknown - 1) < 1e-9
    gains = {(r.h, r.w): r.gain for r in model.bigrams.collect()}
    for h in {h for h, _ in gains}:
        log_a = words[h].log_a if h in words else model.log_begin
        total = sum(10 ** (w.log_p + log_a + gains.get((h, k), 0.0)) for k, w in words.items()) + 10 ** (model.log_unknown + log_a)
        assert abs(total - 1) < 1e-9
    # a probe over two words sums to one over all continuations only if it is scored by the same recursion
    h = katz.word_hashes(__import__("pyarrow").array(["a", "b"])).astype(np.int64)
    score = katz.score(spark.createDataFrame([(9, "a b zzz")], "doc_id long, text string"), model).first().score
    key = lambda x, y: words[y].log_p + (words[x].log_a if x in words else model.log_begin) + gains.get((x, y), 0.0)
    expect = key(2, h[0]) + key(h[0], h[1]) + words[h[1]].log_a + model.log_unknown + words[1].log_p
    assert abs(score - expect) < 1e-9


def test_katz_keeps_bigrams_seen_once(spark):
    model = katz.fit(spark.createDataFrame([(1, "a b a b a c"), (2, "d e a b")], "doc_id long, text string"))
    pairs = {("", "a"), ("a", "b"), ("b", "a"), ("a", "c"), ("c", None), ("", "d"), ("d", "e"), ("e", "a"), ("b", None)}
    words = dict(zip("abcde", katz.word_hashes(__import__("pyarrow").array(list("abcde"))).astype(np.int64).tolist(), strict=True)) | {"": 2, None: 1}
    assert {(r.h, r.w) for r in model.bigrams.collect()} == {(words[h], words[w]) for h, w in pairs}
    by_text = {r.doc_id: r.score for r in katz.score(spark.createDataFrame([(1, "d e"), (2, "e d")], "doc_id long, text string"), model).collect()}
    assert by_text[1] > by_text[2]


def test_katz_deals_each_bucket_to_a_task_of_its_own(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(200))) for i in range(50)], "doc_id long, text string")
    monkeypatch.setattr(katz, "COUNT_KEYS", 200)
    characters = sum(len(r.text) + 6 for r in docs.collect())
    model = katz.fit(docs)
    # a task with rows writes one file
    assert len(model.counts.inputFiles()) == len(model.known.inputFiles()) == -(-characters * 7 // (10 * 6 * 200)) > 30


def test_katz_bounds_the_batches_of_its_tasks(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(0, 4000, 1, 1).selectExpr("id", "repeat(cast(id % 10 as string), 10000) as text")
    size = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    sizes = [r.n for r in katz._staged(docs.mapInArrow(size, "n long"), "sizes").collect()]
    assert len(sizes) > 2 and max(sizes) < katz.BATCH_BYTES * 1.1 and sum(sizes) >= 40_000_000
    assert spark.conf.get(key) == before


def test_katz_looks_up_a_large_batch_in_pieces():
    big = katz._rows(katz.BLOCKS, [{"bucket": 0, "model": False, "kind": katz.DOCUMENTS, "slice": i, "gain": bytes(1 << 20)} for i in range(48)])
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in katz._look_up(None)(iter([big]))) == 48
        assert tracemalloc.get_traced_memory()[1] < 16 << 20
    finally:
        tracemalloc.stop()


def test_page_templates_decide_beside_tags(spark):
    notice = "<p>Subscribe to our weekly letter now</p>"
    body = lambda i: f"<p>Story number{i} tells of thing{i}</p>{notice}<p>By author{i}</p>"
    page = lambda i: f"<html><body><nav>home</nav><article><h1>Title{i}</h1>{body(i)}</article><div><span>extra{i} words{i}</span></div></body></html>"
    rows = [(i, "http://a.example/x", page(i)) for i in range(6)] + [(9, "http://b.example/x", page(9)), (10, None, None)]
    out = {r.page_id: r.text for r in html_template.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert "Subscribe" not in out[i] and f"number{i}" in out[i] and f"extra{i} words{i}" in out[i] and f"author{i}" in out[i] and "home" not in out[i]
    assert "Subscribe" in out[9] and "extra9" not in out[9] and out[10] == ""


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "▁a", "ab", "▁ab", "ba"]
    model = lang_id.PieceModel.start(pieces, ["x"], np.zeros(1))

    def all_ways(s):
        if not s:
            return 1.0
        return sum(p * all_ways(s[len(q) :]) for q in {*pieces, s[0]} if s.startswith(q) for p in [1 / 7 if q in pieces else lang_id.UNKNOWN])

    for w in ["a", "ab", "aba", "abc", "bbab"]:
        assert abs(np.exp(model.log_prob([w])[0, 0]) / all_ways("▁" + w) - 1) < 1e-9
    used = model.expected(["ab"], np.array([[2.0]]))
    assert abs((used[model.rows.argsort() * 0 + np.arange(len(model.rows))].sum()) - used.sum()) < 1e-12 and used.sum() > 0


def test_words_of_any_length_are_summed_whole(monkeypatch):
    rng = np.random.default_rng(3)
    pieces = ["▁", "a", "b", "ab", "ba", "aab", "▁a", "abba", "c"]
    model = lang_id.PieceModel.start(pieces, ["x", "y"], np.zeros(2))
    model.prob = np.r_[rng.dirichlet(np.ones(len(pieces)), 2).T, np.zeros((1, 2))]
    words = ["".join(rng.choice(list("abcd"), n)) for n in (1, 5, 31, 32, 17)]
    counts = rng.random((len(words), 2))
    want, uses = model.log_prob(words), model.expected(words, counts)
    monkeypatch.setattr(lang_id, "TOGETHER_CHARS", 4)
    monkeypatch.setattr(lang_id, "LOOK_UP", 7)
    np.testing.assert_allclose(model.log_prob(words), want)
    np.testing.assert_allclose(model.expected(words, counts), uses)
    assert np.isfinite(model.log_prob(["ab" * 3000])).all()
    import pyarrow as pa

    assert len(lang_id.letter_runs(pa.array(["x" * 5000]))[2]) == 1


def test_language_and_rejects(spark, docs, empty, texts):
    pieces = lang_id.public_pieces(queries.PIECES)
    model = lang_id.fit(docs, pieces)
    out = {(r.doc_id): r for r in lang_id.predict(docs, model).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (1, 2, 3, 13))
    assert out[12].lang_pred == "de" and all(0 <= r.score <= 1 for r in out.values())
    none = lang_id.fit(empty, pieces)
    assert {r.lang_pred for r in lang_id.predict(docs, none).collect()} == {"und"}


def test_held_out_accuracy(spark, sf):
    out = queries.op10_language(spark, sf.replace("0.001", "0.01")).toPandas()
    table = pd.read_parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    both = out.merge(table, on="doc_id")
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95


def test_toxicity(spark, docs, empty, sf):
    folder = sf.replace("0.001", "0.01")
    out = queries.op2_toxicity(spark, folder).toPandas().merge(pd.read_parquet(f"{folder}/labels.parquet"), on="doc_id")
    assert out.score.between(0, 1).all() and ((out.score >= 0.7) == (out.predicted == 1)).all()
    held = out[out.held_out]
    ranks = held.score.rank()
    n1 = (held.toxic == 1).sum()
    auc = (ranks[held.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(held) - n1))
    assert auc > 0.8
    flat = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs, flat).collect()} == {0.5}


def test_grammar_reads_scopes():
    import pyarrow as pa

    model = toxicity.ToxicModel({"fool": 2.0})
    x = lambda t: toxicity.features(pa.array([t]), model)[0]
    assert x("you fool.")[0] > x("a fool.")[0] > 0
    assert x("you are not a fool.")[0] == 0 and x("you are not a fool.")[1] > 0
    assert x("someone said a fool came.")[2] > 0 and x("He said. A fool came.")[2] == 0
    assert x("she wrote: you fool")[2] > 0 and x("she wrote : you fool")[2] > 0 and x("then: you fool")[0] > 0
    assert x("i will kill you")[6] > 0
    assert x("i will never kill you")[6] == 0 and x("i will never kill you")[7] > 0
    assert x("he said he would kill you")[6] == 0 and x("he said he would kill you")[8] > 0
    assert not x("").any()


def test_short_items_are_never_hidden(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    items = [(i, " ".join(word() for _ in range(3 + i % 5))) for i in range(400)]
    docs = [(i, f"{t} {' '.join(word() for _ in range(30))}" if i % 2 else f"{' '.join(word() for _ in range(20))} {t} {word()}") for i, t in items]
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(i, i) for i in range(400)}


def test_leaks(spark, sf_dir, texts):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = sorted(((r.doc_id, r.item_id, r.shared) for r in queries.op1_decontamination(spark, sf_dir).collect()), key=str)
    assert got == brute.contained([(i, t) for i, t, _ in texts], items) and got


def test_leaks_on_a_table(spark, sf):
    read = lambda n: pd.read_parquet(f"{sf}/{n}.parquet")
    docs, bench = read("documents"), read("benchmark")
    got = sorted(((r.doc_id, r.item_id, r.shared) for r in queries.op1_decontamination(spark, sf).collect()), key=str)
    assert got == brute.contained(list(zip(docs.doc_id, docs.text, strict=True)), list(zip(bench.item_id, bench.text, strict=True)))


def test_empty_tables(spark, empty):
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert ngram_join.jaccard_groups(empty).count() == 0
    assert pii.personal_data(empty).count() == secrets.secrets(empty).count() == queries.packed(empty).count() == 0
    assert katz.score(empty, katz.fit(empty)).count() == 0
    assert toxicity.score(empty, toxicity.ToxicModel()).count() == 0


def test_clashing_columns(docs):
    """Operators ignore further columns; filters keep all columns."""
    assert exact_dedup.drop_exact_duplicates(docs).columns == docs.columns
    assert ngram_join.drop_near_duplicates(docs).columns == docs.columns
    assert katz.score(docs, katz.fit(docs)).count() == docs.count()
