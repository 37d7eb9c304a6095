"""The contracts again, by the plainest Python."""

import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def near_duplicates(rows):
    """``{doc_id: (n, component, kept)}`` by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def leaks(docs, items):
    """``{doc_id: (n_words, n_hit, ids)}``."""
    windows = []
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        if w:
            k = min(10, len(w))
            windows.append((str(item), {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}, k))
    out = {}
    for doc, text in docs:
        w = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        grams = {}
        for item, wanted, k in windows:
            if k not in grams:
                grams[k] = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
            for i, g in enumerate(grams[k]):
                if g in wanted:
                    hit.update(range(i, i + k))
                    found.add(item)
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def secrets(text):
    """The base spans ``(start, kind, end)``."""
    text = text or ""
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


KINDS = ("assign", "access", "hex", "random")


def listed(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
