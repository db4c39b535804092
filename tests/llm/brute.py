"""Plain single-process versions of the operators' results."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

CAPS = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return (text or "").translate(CAPS)


def words(text):
    return WORD.findall(lower(text))


def shingles(text, n=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def components(rows):
    """(doc_id, n_shingles, component_id) of rows (doc_id, text), by comparing all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    having = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            having[g].append(i)
    pairs = {(a, b) for v in having.values() for a in v for b in v if a < b}
    for a, b in pairs:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
            root[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def crc(doc, modulus):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % modulus


def base_scores(rows):
    """(doc_id, n_tokens, n_known, N, base) by add-one unigrams over training rows."""
    count = Counter(t for d, x in rows if crc(d, 7) != 2 for t in [*words(x), None])
    total, types = sum(count.values()), len(count)
    out = []
    for d, x in rows:
        t = [*words(x), None]
        out.append((d, len(t), sum(w in count for w in t), total, sum(math.log10((count[w] + 1) / (total + types + 1)) for w in t)))
    return out


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def luhn(d):
    s = [int(c) for c in d[::-1]]
    return (sum(s[::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0


def personal(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return out


def credentials(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def contained(docs, items, threshold=0.75, n=5):
    """(doc_id, item_id, shared) over runs of letters and digits."""
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = []
    for item, text in items:
        w = tokens(text)
        k = min(n, len(w))
        own = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for doc, body in docs:
            v = tokens(body) if own else []
            shared = len(own & {tuple(v[i : i + k]) for i in range(len(v) - k + 1)})
            if own and shared >= threshold * len(own):
                out.append((doc, item, shared))
    return sorted(out, key=str)
