"""Plain Python versions of the operators, and tables of hard cases."""

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def sentence(n, seed=0):
    """n invented words, the same for the same seed."""
    return [hashlib.md5(f"{seed}-{i}".encode()).hexdigest()[:3 + (i + seed) % 5] for i in range(n)]


def hard_docs():
    """Nulls in every column, empty, blank and very long texts, ties, shared passages and copies."""
    passage = " ".join(sentence(60, 1))
    line = "  A line that Stands in many Documents, over forty characters \t"
    texts = ["", None, "   \t\n ", "one", "Two Words", "Zwölf Ümlaute ÄÖ x　y\x1cz", passage, "x " + passage,
             passage + " y", passage + "\n" + passage, " ".join(sentence(49, 2)), " ".join(sentence(50, 2)),
             "\n".join([line, "short", line.strip().upper(), ""]), line, line.lower(), line + "\nmore", "a\r\n" + line,
             "tail\n" + line.strip(), " ".join(["same"] * 300), " ".join(["same"] * 301), "\n\n\n",
             " ".join(sentence(20000, 3)), " ".join(sentence(4000, 3)), "w" * 5000]
    rows = [(i * 3, t, "en" if i % 4 else None, ["a", "b", None, "Z", "é"][i % 5], None if t is None else len(t))
            for i, t in enumerate(texts)]
    near = sentence(200, 4)
    for k in range(6):
        near[k * 7] = f"edit{k}"
        rows.append((1000 + k, " ".join(near), "en", "a", None))
    return rows


def substring(rows, window=50):
    """{doc_id: (n_words, n_removed, sha)}; ids must be unique."""
    first = {}
    for d, text in rows:
        w = words(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < d:
                gone.update(range(i, i + window))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def line_dedup(rows, min_docs=5, min_chars=40):
    """{doc_id: (n_lines, n_dropped, kept text)}; ids must be unique."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    docs = {}
    for d, text in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= min_chars:
                docs.setdefault(key(x), set()).add(d)
    out = {}
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(docs.get(key(x), ())) < min_docs or max(docs[key(x)]) == d]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def fingerprint(text, shingle=3):
    w = words((text or "").translate(LOWER))
    parts = [" ".join(w[i:i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, linked):
    """{id: smallest id reachable}."""
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def simhash(rows, bits=3):
    """{doc_id: (fingerprint, component)}; ids must be unique."""
    prints = {d: fingerprint(t) for d, t in rows}
    ids = sorted(prints)
    near = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:] if (prints[a] ^ prints[b]).bit_count() <= bits]
    of = components(ids, near)
    return {d: (f"{prints[d]:016x}", of[d]) for d in ids}


def shingles(text, k=5):
    w = words((text or "").translate(LOWER))
    return lambda n: {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}, min(k, len(w))


def contaminated(docs, items, share=0.8):
    """{(doc_id, item_id): (n_shingles, n_shared)}."""
    out = {}
    for item_id, item in items:
        of_item, k = shingles(item)
        if not k:
            continue
        want = of_item(k)
        for d, text in docs:
            hit = len(want & shingles(text)[0](k))
            if hit >= share * len(want) - 1e-9:
                out[d, item_id] = (len(want), hit)
    return out
