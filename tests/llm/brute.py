"""Plain restatements of what the operators must return, for small inputs."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered),
            len(words) < 20 or 100 * len(covered) > 30 * len(words))


def base_secrets(text):
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    spans = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m.group(2)) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    counts = [sum(s[1] == k for s in spans) for k in range(3)]
    text = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))
    return (*counts, hashlib.sha256(text.encode()).hexdigest())


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def jaccard_components(docs):
    """{doc_id: (set size, smallest reachable id)} by comparing every pair."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def removed_bytes(docs, length=100):
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256); docs as (id, text), null ids after all others."""
    key = lambda i: (1 << 63) - 1 if i is None else i
    first = {}
    bodies = [(key(i), i, (t or "").encode()) for i, t in docs]
    for k, _, b in bodies:
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            first[w] = min(first.get(w, (k, s)), (k, s))
    out = []
    for k, i, b in bodies:
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if first[b[s:s + length]] < (k, s):
                gone[s:s + length] = [True] * length
        runs = sum(g and not (n and gone[n - 1]) for n, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)
