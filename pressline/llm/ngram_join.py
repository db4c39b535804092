"""N-gram Jaccard join as a blocked sparse matrix product.

The matrix has a row per class of documents with the same shingle set and a
column per shingle. Its columns are dealt in blocks of hash ranges; a block
counts the classes of each shingle and drops shingles of one class, which add to
no product. The rest is transposed into rows again, ordered from rare to
frequent shingles. Bounds that follow from the sizes say how many of a row's
rarest shingles any partner must share one of, and how many that remain; pairs
below them are dropped before overlaps are accumulated.

Groups of near copies are never expanded into all pairs. Each class of a column
is first compared with the class that has the fewest shingles of its own, the
likeliest to link with all others, and with neighbours; later rounds only look
at pairs whose classes no chain of links joins yet, and compare the classes
outside of a column's largest component with the rest of the column. What stays
quadratic is a column of many classes that pass all bounds and link with none.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bucket_cuts, by_bucket, components, dealt, id_text, runs, shingle_sets, slices, staged, text_hash, without

SHINGLE_WORDS = 5
#: Similarity in hundredths, so that bounds are exact.
PERCENT = 75
#: Shingle entries of a column block, on average.
BLOCK_ENTRIES = 1_500_000
#: Rows of a column that one window task sorts; longer columns are salted.
COLUMN_ROWS = 20_000

#: Passes over neighbours before all pairs that are left are taken.
NEIGHBOUR_ROUNDS = 2

BLOCK = "bucket int, sig binary, n binary, size binary, gram binary"
ROWS = "bucket int, sig binary, n binary, size binary, gram binary, df binary"


def signature(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes())


def _sets(batches):
    for batch in slices(batches):
        n, sig = [], []
        for grams in shingle_sets(batch.column("text"), SHINGLE_WORDS):
            n.append(len(grams))
            sig.append(np.uint64(signature(grams)).astype(np.int64) if len(grams) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(sig, pa.int64())], ["doc_id", "text_hash", "n", "sig"])


def document_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, sig): size of the shingle set and its class; no class where the set is empty."""
    return id_text(docs).withColumn("text_hash", text_hash("text")).mapInArrow(_sets, "doc_id long, text_hash long, n long, sig long")


def _batch(rows: list[tuple], schema: str):
    names = [c.split()[0] for c in schema.split(", ")]
    columns = [pa.array([r[i] for r in rows], pa.int32() if c.endswith(" int") else pa.binary()) for i, c in enumerate(schema.split(", "))]
    return pa.RecordBatch.from_arrays(columns, names)


def _column_blocks(buckets: int):
    def run(batches):
        for batch in slices(batches):
            classes = {}
            for grams in shingle_sets(batch.column("text"), SHINGLE_WORDS):
                if len(grams):
                    classes.setdefault(signature(grams), grams)
            if not classes:
                continue
            sig = np.fromiter(classes, np.uint64, len(classes))
            n = np.fromiter(map(len, classes.values()), np.uint32, len(classes))
            grams, row = np.concatenate(list(classes.values())), np.repeat(np.arange(len(n)), n)
            order = np.argsort(grams, kind="stable")
            grams, row = grams[order], row[order]
            cuts = bucket_cuts(grams, buckets)
            out = []
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if a == b:
                    continue
                own = np.argsort(row[a:b], kind="stable")
                r = row[a:b][own]
                first = runs(r)
                size = np.diff(np.append(first, len(r))).astype(np.uint32)
                out.append((k, sig[r[first]].tobytes(), n[r[first]].tobytes(), size.tobytes(), grams[a:b][own].tobytes()))
            yield _batch(out, BLOCK)

    return run


def _unpack(rows: list[dict]):
    """Entries of blocks: class, set size, shingle; and the blocks' row sizes."""
    part = lambda name, kind: np.frombuffer(b"".join(r[name] for r in rows), kind)
    size = part("size", np.uint32)
    return np.repeat(part("sig", np.uint64), size), np.repeat(part("n", np.uint32), size), part("gram", np.uint64)


def _count_columns(buckets: int):
    """Number of classes of each shingle of a block; shingles of one class are dropped, rows packed by class."""

    def count(rows):
        sig, n, gram = _unpack(rows)
        order = np.argsort(gram, kind="stable")
        sig, n, gram = sig[order], n[order], gram[order]
        first = runs(gram)
        size = np.diff(np.append(first, len(gram)))
        again = np.repeat(size > 1, size)
        sig, n, gram = sig[again], n[again], gram[again]
        order = np.lexsort((sig, gram))
        sig, n, gram = sig[order], n[order], gram[order]
        if len(sig):
            new = np.r_[True, (gram[1:] != gram[:-1]) | (sig[1:] != sig[:-1])]
            sig, n, gram = sig[new], n[new], gram[new]
        first = runs(gram)
        size = np.diff(np.append(first, len(gram)))
        df = np.repeat(size, size).astype(np.uint32)
        keep = df > 1
        order = np.argsort(sig[keep], kind="stable")
        sig, n, gram, df = (x[keep][order] for x in (sig, n, gram, df))
        cuts = bucket_cuts(sig, buckets)
        out = []
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                first = a + runs(sig[a:b])
                size = np.diff(np.append(first, b)).astype(np.uint32)
                out.append((k, sig[first].tobytes(), n[first].tobytes(), size.tobytes(), gram[a:b].tobytes(), df[a:b].tobytes()))
        if out:
            yield _batch(out, ROWS)

    return lambda batches: by_bucket(batches, count)


VECTOR = "sig long, n long, skipped long, prefix long, grams array<long>, heads array<int>"


def _rows_again(batches):
    """A row per class that can have a partner: its shared shingles from rare to frequent."""

    def gather(rows):
        sig, n, gram = _unpack(rows)
        df = np.frombuffer(b"".join(r["df"] for r in rows), np.uint32)
        order = np.lexsort((gram, df, sig))
        sig, n, gram, df = sig[order], n[order].astype(np.int64), gram[order], df[order]
        first = runs(sig)
        size = np.diff(np.append(first, len(sig)))
        total = n[first]
        least = -(-PERCENT * total // 100)
        fit = size >= least  # a partner shares at least that many, none of them dropped
        prefix = size - least + 1
        for a in range(0, int(fit.sum()), 2000):
            at = np.flatnonzero(fit)[a : a + 2000]
            grams = [gram[first[i] : first[i] + size[i]].astype(np.int64) for i in at]
            heads = [df[first[i] : first[i] + prefix[i]].astype(np.int32) for i in at]
            lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(size[at])].astype(np.int32), np.concatenate(grams))
            heads = pa.ListArray.from_arrays(np.r_[0, np.cumsum(prefix[at])].astype(np.int32), np.concatenate(heads))
            yield pa.RecordBatch.from_arrays(
                [pa.array(sig[first[at]].astype(np.int64)), pa.array(total[at]), pa.array((total - size)[at]), pa.array(prefix[at]), lists, heads],
                ["sig", "n", "skipped", "prefix", "grams", "heads"],
            )

    return by_bucket(batches, gather)


def _possible(a: str, b: str) -> Column:
    """Bounds on two classes by set size, and by the places of a shared shingle in both orders."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    left = F.least(n - F.col(f"{a}.place"), m - F.col(f"{b}.place"))
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & ((100 + PERCENT) * left >= PERCENT * (n + m))


ENTRY = ["sig", "n", "place"]


def _pairs(found: DataFrame) -> DataFrame:
    """Distinct pairs of classes from columns x and y of entries."""
    found = found.where("x.sig <> y.sig").where(_possible("x", "y"))
    return found.select(F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b")).distinct()


def _neighbours(entries: DataFrame, order: list[Column], differ: Column) -> DataFrame:
    """Pairs of each entry with the one before it and the first one of its column; long columns in salted parts."""
    parts = F.ceil(F.col("df") / F.lit(COLUMN_ROWS))
    salted = entries.withColumn("salt", F.when(parts > 1, F.pmod(F.xxhash64("sig"), parts)).otherwise(F.lit(0)))
    w = Window.partitionBy("gram", "salt").orderBy(*order)
    entry = F.struct(*ENTRY, "class")
    near = salted.select("gram", "salt", "df", entry.alias("x"), F.lag(entry).over(w).alias("before"), F.first(entry).over(w).alias("head"))
    # a salted column's parts meet through their heads: as many rows as parts
    heads = near.where((F.col("df") > COLUMN_ROWS) & F.col("before").isNull()).select("gram", "salt", "x")
    across = heads.select("x", F.lag("x").over(Window.partitionBy("gram").orderBy("salt")).alias("y")).where("y is not null")
    inside = near.where("before is not null").select("x", F.explode(F.array("before", "head")).alias("y"))
    return _pairs(inside.unionByName(across).where(differ))


def _linked(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, linked): whether the accumulated overlap of each pair reaches the threshold."""
    side = vectors.select("sig", "n", "grams")
    both = pairs.join(side.toDF("a", "n_a", "grams_a"), "a").join(side.toDF("b", "n_b", "grams_b"), "b")
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    return both.select("a", "b", (100 * shared >= PERCENT * (F.col("n_a") + F.col("n_b") - shared)).alias("linked"))


def link_classes(docs: DataFrame, sets: DataFrame) -> DataFrame | None:
    """(node, component) of classes that are linked with another one; None where there are no shingles."""
    entries = sets.agg(F.sum("n")).first()[0] or 0
    if not entries:
        return None
    buckets = max(4, math.ceil(entries / BLOCK_ENTRIES))
    blocks = id_text(docs).mapInArrow(_column_blocks(buckets), BLOCK)
    rows = dealt(blocks, buckets).mapInArrow(_count_columns(buckets), ROWS)
    vectors = staged(dealt(rows, buckets).mapInArrow(_rows_again, VECTOR), "shingle-rows")
    columns = vectors.select("sig", "n", "skipped", F.posexplode(F.arrays_zip(F.slice("grams", F.lit(1), F.col("prefix")).alias("gram"), F.col("heads").alias("df"))))
    columns = columns.select("sig", "n", "skipped", (F.col("skipped") + F.col("pos")).alias("place"), F.col("col.gram").alias("gram"), F.col("col.df").alias("df"))

    plain = columns.withColumn("class", F.col("sig"))
    central = [F.col("skipped"), F.col("n"), F.col("sig")]
    tested = [staged(_linked(_neighbours(plain, central, F.lit(True)), vectors), "links")]
    classes = staged(components(tested[0].where("linked")), "components")
    for _ in range(NEIGHBOUR_ROUNDS):
        # neighbours again, in another order, where chains of links have not settled a column
        done = reduce(DataFrame.unionByName, tested).select("a", "b")
        known = _open(columns, classes)
        mixed = F.xxhash64("sig", F.lit(len(tested)))
        order = [F.col("skipped") if len(tested) % 2 else F.col("class"), mixed]
        near = _neighbours(known, order, F.col("x.class") != F.col("y.class")).join(done, ["a", "b"], "left_anti")
        fresh = staged(_linked(near, vectors), "links")
        tested.append(fresh)
        classes = _merged(classes, fresh)
    # every pair that is left, whatever the rounds have found; in the first column that both share
    known = _open(columns, classes)
    done = reduce(DataFrame.unionByName, tested).select("a", "b")
    earlier = F.slice("grams", F.lit(1), (F.col("place") - F.col("skipped")).cast("int"))
    side = known.join(vectors.select("sig", "grams"), "sig").withColumn("before", earlier)
    side = side.select("gram", "main", F.ceil(F.col("df") / F.lit(COLUMN_ROWS)).alias("parts"), F.struct(*ENTRY, "class", "before").alias("entry"))
    # of two components at least one is not the column's largest; long columns are split on that side
    x = side.where("entry.class <> main").select("gram", "main", F.pmod(F.xxhash64("entry.sig"), "parts").alias("part"), F.col("entry").alias("x"))
    y = side.select("gram", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.col("entry").alias("y"))
    fresh = "x.class <> y.class and (y.class = main or x.sig < y.sig) and not arrays_overlap(x.before, y.before)"
    rest = x.join(y, ["gram", "part"]).where(_possible("x", "y")).where(fresh)
    rest = rest.select(F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b"))
    last = staged(_linked(rest.join(done, ["a", "b"], "left_anti"), vectors), "links")
    return _merged(classes, last)


def _open(columns: DataFrame, classes: DataFrame) -> DataFrame:
    """Entries of the columns that hold more than one component, with their component and the column's largest (main).

    Entries that are too far from the column's smallest set to reach any partner go.
    """
    known = columns.join(classes.withColumnRenamed("node", "sig"), "sig", "left").withColumn("class", F.coalesce("component", "sig")).drop("component")
    held = known.groupBy("gram", "class").agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least"))
    largest = F.max(F.struct("rows", "class"))["class"].alias("main")
    mixed = held.groupBy("gram").agg(largest, F.count(F.lit(1)).alias("kinds"), F.min("least").alias("least")).where("kinds > 1")
    near = (100 + PERCENT) * (F.col("n") - F.col("place")) >= PERCENT * (F.col("n") + F.col("least"))
    return staged(known.join(mixed.drop("kinds"), "gram").where(near).drop("least"), "open-columns")


def _merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: the links between components are contracted first."""
    of = lambda name: classes.select(F.col("node").alias(name), F.col("component").alias(f"of_{name}"))
    edges = links.where("linked").join(of("a"), "a", "left").join(of("b"), "b", "left")
    edges = edges.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = staged(components(edges), "components")
    moved = classes.join(joined.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    single = joined.join(classes, "node", "left_anti")
    return staged(moved.unionByName(single), "components")


def _grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, component): the last one tells components with one smallest id apart."""
    sets = staged(document_sets(docs), "shingle-sets")
    classes = link_classes(docs, sets)
    least = sets.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"))
    if classes is not None:
        least = least.join(classes.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
        roots = least.groupBy("component").agg(F.min("least").alias("component_id"))
        least = least.join(roots, "component").select(F.col("sig").alias("of"), "component_id", "component")
    else:
        least = least.select(F.col("sig").alias("of"), F.col("least").alias("component_id"), F.col("sig").alias("component"))
    joined = sets.join(least, F.col("sig") == F.col("of"), "left")
    return joined.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "component")


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Documents link when 100 * intersection >= 75 * union of their shingle sets;
    component_id is the smallest doc_id that links reach, the document's own
    included. Null, empty and wordless texts have no shingles and link with
    nothing: their component is their own id. Fewer than five words are one
    shingle. Repeated rows are equal documents. Null ids are never a component's
    id unless it has no other. An empty table gives no rows; other columns are
    ignored.
    """
    return _grouped(docs).select("doc_id", "n_shingles", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with the document of the smallest id of each group; all its columns.

    Where texts of one group share that id, one of them stays; rows that repeat
    both id and text share their fate. A row without an id can not be named by a
    result and stays.
    """
    groups = staged(_grouped(docs), "near-groups")
    roots = groups.where("doc_id = component_id and component is not null")
    shared = roots.groupBy("component").agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("most")).where("least <> most")
    more = roots.join(shared, "component").where("text_hash <> least")
    return without(docs, groups.where("doc_id <> component_id").unionByName(more.select(*groups.columns)))
