"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens, each told apart by its path of elements: the
elements themselves, the words of a path, and the whole texts of its blocks.
Tokens of a host's pages with equal occurrence vectors form an equivalence class.
Classes that are frequent and large enough are valid and make the template; they
nest by their paths. A word is only a role of the template where its places in
its blocks are the same on every page. What lies between, outside of boilerplate
elements, are the slots: their text is extracted block by block.

Occurrence vectors are never gathered: sums of page-wise hashes, added up where
the pages are read, identify them. Only tokens that can be frequent are summed: one
that is on half of a host's pages is on half of them in some slice of the table, so
a first pass lists what is frequent in slices, and no frequent token is lost.
"""

from __future__ import annotations

import functools
import html
import json
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import MULTIPLIERS, mix, runs, slices, split_words, staged, word_hashes

#: A valid class is on this share of a host's pages, and on this number of them, at least.
SUPPORT, LEAST_PAGES = 0.5, 3
#: Elements and words of a valid class.
SIZE = 3

#: Elements by role, as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea select title".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
DROPPED = frozenset("head nav footer aside form button menu dialog fieldset".split()) | RAW
#: Words of names for what is not the article, words that follow them in such names, and words that name a state of a page.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer masthead menu modal nav navbar navigation newsletter notice notices popup promo related share sidebar social sponsor sponsored subscribe toolbar topbar widget".split()
)
PARTS = frozenset("area articles bar block body box button buttons content container form group holder icons inner item items left links list main panel placeholder posts primary right row section slot thread top bottom unit wrap wrapper".split())
STATES = frozenset("has is no not with without".split())
KEPT = frozenset("html body main article".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.IGNORECASE)


@functools.lru_cache(maxsize=1 << 16)
def named(value: str) -> bool:
    """Whether a class, id or role names a part beside the article.

    One of its names ends in such a word, or has one and ends in a word for a
    part: ``cookie-notice``, ``share-buttons``, but not ``has-sidebar``,
    ``nav-open`` or ``share-price``.
    """
    for name in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower().split():
        words = [w for w in re.split(r"[_-]+", name) if w]
        while len(words) > 1 and words[-1].isdigit():
            words.pop()
        if words and words[0] not in STATES and (words[-1] in MARKS or words[-1] in PARTS and MARKS.intersection(words)):
            return True
    return False


@dataclass
class Block:
    path: str
    dropped: bool
    parts: list[str] = field(default_factory=list)

    @property
    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def parse(page: str) -> tuple[list[Block], dict[str, int]]:
    """Text blocks in page order and how often each path is opened. Ill-nested markup closes what it must."""
    blocks: list[Block] = []
    opened: dict[str, int] = {}
    # name, path, dropped, dropped by a tag, dropped by a name
    stack: list[tuple[str, str, bool, bool, bool]] = [("", "", False, False, False)]
    current, article = Block("", False), False

    def flush():
        nonlocal current
        if current.parts:
            blocks.append(current)
        name, path, dropped, *_ = next((x for x in reversed(stack) if x[0] not in INLINE), stack[0])
        current = Block(path, dropped)

    at = 0
    while True:
        m = TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text and not stack[-1][3]:
            current.parts.append(text)
        if m is None:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name == "br":
            current.parts.append(" ")
            continue
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if depth:
                block = any(x[0] not in INLINE for x in stack[depth:])
                del stack[depth:]
                if block or stack[-1][2] != current.dropped:
                    flush()
            continue
        if name not in INLINE:  # a block ends an open paragraph; an item or cell ends the one before
            ends = ("p",) if name not in ("li", "dt", "dd", "tr", "td", "th", "option") else ("p", name)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ends:
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE:
                    break
        attributes = [next(filter(None, x), "") for x in ATTRIBUTE.findall(m[3] or "")]
        label = name + "".join(f".{a.split()[0].lower()}" for a in attributes[:1] if a.split())
        inside = any(x[0] in ("article", "main") for x in stack)
        # names speak for block elements only, and not for what holds the page's first article
        by_tag = stack[-1][3] or name in DROPPED or (name == "header" and not inside)
        first = name in ("article", "main") and not article
        article |= first
        by_name = not first and (stack[-1][4] or name not in INLINE and name not in KEPT and any(map(named, attributes)))
        drop = by_tag or by_name
        path = f"{stack[-1][1]}/{label}"
        opened[path] = opened.get(path, 0) + 1
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID or (m[3] or "").endswith("/"):
            if name not in INLINE:
                flush()
            continue
        stack.append((name, path, drop, by_tag, by_name))
        if name not in INLINE or drop != current.dropped:
            flush()
    flush()
    kept = [b for b in blocks if not b.dropped and b.text]
    # a page of which names leave nothing has them on what holds its text
    return kept or [b for b in blocks if b.text], opened


@dataclass
class Text:
    """A block of a page that is read back."""

    path: str
    text: str


def dump(page: str) -> str:
    """Blocks and paths of a page as JSON, so that a page is parsed once."""
    blocks, opened = parse(page)
    return json.dumps([[[b.path, b.text] for b in blocks], opened], ensure_ascii=False)


def load(parsed: str) -> tuple[list[Text], dict[str, int]]:
    blocks, opened = json.loads(parsed)
    return [Text(*b) for b in blocks], opened


CANDIDATES = "host string, token long, excess long, pages long"
STATS = "host string, all_pages long, token long, kind int, size int, pages long, uses long, vector long, start_low int, start_high int, end_low int, end_high int"
#: Kinds of tokens.
ELEMENT, TEXT, WORD = range(3)
MASK = np.uint64((1 << 31) - 1)


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts))


@dataclass
class Tokens:
    """Tokens of a slice: arrays of hash, page and kind; words lie after the rest, in page order, with their places."""

    blocks: list[list[Text]]
    elements: tuple[np.ndarray, np.ndarray, np.ndarray]  # token, page, uses
    texts: tuple[np.ndarray, np.ndarray, np.ndarray]  # token, page, words
    words: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # token, page, place from start, from end
    block_of: np.ndarray  # of each word


def _tokens(hosts: list[str], pages: list[str]) -> Tokens:
    all_blocks, elements, texts, at = [], [], [], []
    for i, (host, page) in enumerate(zip(hosts, pages, strict=True)):
        blocks, opened = load(page)
        all_blocks.append(blocks)
        elements += [(_hash(host, path), i, n) for path, n in opened.items()]
        for b in blocks:
            text = b.text
            at.append((_hash(host, b.path, "words"), i))
            texts.append((_hash(host, b.path, "text", text), text))
    codes, offsets, dictionary = split_words(pa.array([t for _, t in texts], pa.string()))
    n = np.diff(offsets)
    block_of = np.repeat(np.arange(len(n)), n)
    path, page = (np.array([x[k] for x in at], t) for k, t in ((0, np.uint64), (1, np.int64)))
    place = np.arange(len(codes)) - np.repeat(offsets[:-1], n)
    word = word_hashes(dictionary)[codes] if len(codes) else np.zeros(0, np.uint64)
    own = tuple(np.array([x[k] for x in elements], t) for k, t in ((0, np.uint64), (1, np.int64), (2, np.int64)))
    token = mix(path[block_of] * np.uint64(MULTIPLIERS[0]) + word)
    return Tokens(all_blocks, own, (np.array([t for t, _ in texts], np.uint64), page, n), (token, page[block_of], place, np.repeat(n, n) - place), block_of)


def _sums(kind: int, keys: np.ndarray, token: np.ndarray, page: np.ndarray, uses: np.ndarray, size: np.ndarray, start: np.ndarray, end: np.ndarray):
    """A row per token of one slice; the tokens of a page are next to each other once sorted by token."""
    order = np.argsort(token, kind="stable")
    token, page, uses, size, start, end = (x[order] for x in (token, page, uses, size, start, end))
    if not len(token):
        return None
    first = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (page[1:] != page[:-1])]))
    uses, start, end = (np.add.reduceat(x, first) for x in (uses, start, end))
    token, page, size = token[first], page[first], size[first]
    vector = mix(keys[page] + uses.astype(np.uint64) * np.uint64(MULTIPLIERS[1])) & MASK
    heads = runs(token)
    start, end = ((mix(x) & MASK).astype(np.int32) for x in (start, end))
    places = [f.reduceat(x, heads) for x in (start, end) for f in (np.minimum, np.maximum)]
    return (page[heads], token[heads].astype(np.int64), np.full(len(heads), kind, np.int32), size[heads].astype(np.int32), np.diff(np.append(heads, len(token))), np.add.reduceat(uses, heads), np.add.reduceat(vector, heads).astype(np.int64), *places)


def _slice_rows(batch: pa.RecordBatch, hosts: list[str]):
    """Per kind: page that names the host, then token, kind, size, pages, uses, vector and places of a slice's tokens."""
    keys = np.array([xxhash.xxh64_intdigest(k) for k in batch.column("page").to_pylist()], np.uint64)
    t = _tokens(hosts, batch.column("parsed").to_pylist())
    none = lambda x: np.zeros(len(x), np.uint64)
    ones = lambda x: np.ones(len(x), np.int64)
    token, page, start, end = t.words
    places = [mix(x.astype(np.uint64) + np.uint64(1)) for x in (start, end)]
    parts = (
        _sums(ELEMENT, keys, *t.elements, ones(t.elements[0]), none(t.elements[0]), none(t.elements[0])),
        _sums(TEXT, keys, *t.texts[:2], ones(t.texts[0]), t.texts[2], none(t.texts[0]), none(t.texts[0])),
        _sums(WORD, keys, token, page, ones(token), ones(token), *places),
    )
    return [p for p in parts if p]


def _candidate_rows(batches):
    """Tokens frequent in a slice, with the pages beyond what an infrequent one can have there; and, without token, that number and the pages of each host."""
    names = [c.split()[0] for c in CANDIDATES.split(", ")]
    for batch in slices(batches, "parsed"):
        hosts = [host_of(u) for u in batch.column("url").to_pylist()]
        of, at = np.unique(np.array(hosts, object), return_inverse=True)
        n = np.bincount(at)
        most = np.ceil(SUPPORT * n).astype(np.int64) - 1
        yield pa.RecordBatch.from_arrays([pa.array(of.tolist(), pa.string()), pa.nulls(len(of), pa.int64()), pa.array(most), pa.array(n)], names)
        for page, token, kind, _, pages, _, _, *places in _slice_rows(batch, hosts):
            fixed = (kind != WORD) | (places[0] == places[1]) | (places[2] == places[3])
            keep = (pages > most[at[page]]) & fixed
            page, token, pages = page[keep], token[keep], pages[keep]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()).take(pa.array(page)), *map(pa.array, (token, pages - most[at[page]], pages))], names)


def _known(batch: pa.RecordBatch, hosts: list[str], known: dict) -> None:
    """Remember the tokens of the batch's hosts, None where a host has none."""
    if len(known) > 10_000:
        known.clear()
    tokens = batch.column("tokens")
    for i, name in enumerate(hosts):
        if name not in known:
            known[name] = np.array(tokens[i].as_py(), np.int64) if tokens[i].is_valid else None


def _of(hosts: list[str], known: dict) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.int64), *(known[h] for h in {*hosts} if known.get(h) is not None)]))


def _token_rows(batches):
    """Per host and candidate: pages, uses, sum of page-wise hashes, least and largest hash of its places."""
    known: dict[str, np.ndarray | None] = {}
    for batch in slices(batches, "parsed"):
        hosts = batch.column("host").to_pylist()
        _known(batch, hosts, known)
        wanted = _of(hosts, known)
        for part in _slice_rows(batch, hosts):
            page, *part = (x[np.isin(part[1], wanted)] for x in part)
            where = pa.array(page)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()).take(where), batch.column("all_pages").take(where), *map(pa.array, part)], [c.split()[0] for c in STATS.split(", ")])


def _host():
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _with_tokens(pages: DataFrame, tokens: DataFrame, how: str) -> DataFrame:
    return pages.withColumn("host", _host()).join(tokens.withColumnRenamed("host", "of"), F.col("host") == F.col("of"), how).drop("of")


def candidates(pages: DataFrame) -> DataFrame:
    """(host, all_pages, tokens): the tokens that can be on enough of each host's pages."""
    rows = pages.mapInArrow(_candidate_rows, CANDIDATES).groupBy("host", "token").agg(F.sum("excess").alias("excess"), F.sum("pages").alias("pages"))
    rows = staged(rows, "slice-tokens")
    hosts = rows.where("token is null").select(F.col("host").alias("of"), F.col("excess").alias("rest"), F.col("pages").alias("all_pages"))
    hosts = hosts.where(F.col("all_pages") >= LEAST_PAGES)
    able = rows.where("token is not null").join(hosts, F.col("host") == F.col("of")).where(F.col("excess") + F.col("rest") >= SUPPORT * F.col("all_pages"))
    return able.groupBy("host", "all_pages").agg(F.collect_list("token").alias("tokens"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, tokens): the tokens of each host's valid classes. Hosts without a valid class have no row."""
    sums = [F.sum(c).alias(c) for c in ("pages", "uses", "vector")]
    places = [f(f"{c}_{n}").alias(f"{c}_{n}") for c in ("start", "end") for n, f in (("low", F.min), ("high", F.max))]
    able = _with_tokens(pages, staged(candidates(pages), "page-candidates"), "inner").select("page", "host", "parsed", "all_pages", "tokens")
    rows = able.mapInArrow(_token_rows, STATS).groupBy("host", "all_pages", "token", "kind", "size").agg(*sums, *places)
    fixed = (F.col("start_low") == F.col("start_high")) | (F.col("end_low") == F.col("end_high"))
    least = F.greatest(F.lit(LEAST_PAGES), SUPPORT * F.col("all_pages"))
    frequent = rows.where((F.col("pages") >= least) & ((F.col("kind") != WORD) | fixed))
    # a class: equal occurrence vectors
    classes = frequent.groupBy("host", "pages", "uses", "vector").agg(F.sum("size").alias("size"), F.collect_list("token").alias("tokens"))
    return classes.where(F.col("size") >= SIZE).groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))


def _within(path: str, container: str) -> bool:
    return path == container or path.startswith(container + "/")


def _upto(path: str, names: tuple[str, ...]) -> str:
    parts = path.split("/")
    i = next((i for i, p in enumerate(parts) if p.split(".")[0] in names), 0)
    return "/".join(parts[: i + 1]) if i else ""


def by_tags(blocks: list[Text]) -> list[str]:
    """Texts of the page's first article or main element; of all blocks without one."""
    container = next((p for p in map(lambda b: _upto(b.path, ("article", "main")), blocks) if p), "")
    return [b.text for b in blocks if _within(b.path, container)] if container else [b.text for b in blocks]


def extract(hosts: list[str], pages: list[str], known: dict[str, np.ndarray | None]) -> list[str]:
    """Text of each page's slots: blocks without the template's texts and words.

    ``known`` has the template of each host that has one. Other pages, and pages
    without any element of their host's template, are judged by their tags.
    """
    t = _tokens(hosts, pages)
    template = _of(hosts, known)
    own = lambda x: np.isin(x.astype(np.int64), template)
    like = np.zeros(len(pages), bool)
    like[t.elements[1][own(t.elements[0])]] = True
    whole, word = own(t.texts[0]), own(t.words[0])
    some = np.bincount(t.block_of[word], minlength=len(whole)) > 0
    edges = np.append(0, np.cumsum(t.texts[2]))
    out, k = [], 0
    for i, blocks in enumerate(t.blocks):
        if not like[i]:
            out.append("\n\n".join(by_tags(blocks)))
            k += len(blocks)
            continue
        texts = []
        for b in blocks:
            if not whole[k]:
                text = b.text
                if some[k]:
                    text = " ".join(w for w, of in zip(re.split(r"[\t-\r ]+", text), word[edges[k] : edges[k + 1]], strict=True) if not of)
                texts += [text] if text else []
            k += 1
        out.append("\n\n".join(texts))
    return out


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page.

    Null and empty html give an empty text; pages with a null or odd url form
    the host "". A host with fewer than ``LEAST_PAGES`` pages, or a page unlike its
    host's template, is judged by its own elements. Repeated rows give repeated
    results; an empty table gives none; other columns are ignored.
    """
    source = pages.select(F.col("page_id").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    kind = source.schema["page_id"].dataType.simpleString()

    def parsing(batches):
        for batch in slices(batches, "html"):
            parsed = pa.array([dump(page) for page in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), parsed], ["page_id", "url", "parsed"])

    source = staged(source.mapInArrow(parsing, f"page_id {kind}, url string, parsed string"), "parsed-pages")
    keyed = source.select(F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page"), "url", "parsed")
    found = staged(templates(keyed), "page-templates")
    joined = _with_tokens(source, found, "left")

    def run(batches):
        known: dict[str, np.ndarray | None] = {}
        for batch in slices(batches, "parsed"):
            hosts = batch.column("host").to_pylist()
            _known(batch, hosts, known)
            texts = extract(hosts, batch.column("parsed").to_pylist(), known)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.select("page_id", "url", "host", "parsed", "tokens").mapInArrow(run, f"page_id {kind}, url string, text string")
