"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def removed(rows, length=50):
    """(doc_id, text) -> Counter of (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    raw = [(i if i is not None else -(2**63), (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in raw:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            least[w] = min(i, least.get(w, i))
    out = []
    for (i, b), (shown, _) in zip(raw, rows):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((shown, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return Counter(out)


def shingles(text, width=4):
    words = WORD.findall(lower(text or ""))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def reach(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(x) for x in range(n)]


def joined(rows, width=4, percent=85):
    """(doc_id, text) -> Counter of (doc_id, n_shingles, component_id)."""
    sets = [shingles(t, width) for _, t in rows]
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = reach(len(rows), links)
    ids = [i if i is not None else -(2**63) for i, _ in rows]
    least = {}
    for k, r in enumerate(root):
        least[r] = min(ids[k], least.get(r, ids[k]))
    return Counter((rows[k][0], len(sets[k]), None if least[root[k]] == -(2**63) else least[root[k]]) for k in range(len(rows)))


def base_scores(rows, folds=7, held=2):
    """(doc_id, text) -> list of (doc_id, held_out, n_tokens, n_known, N, base_score)."""
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % folds == held
    tokens = [[*WORD.findall(lower(t or "")), None] for _, t in rows]
    c = Counter(w for (i, _), x in zip(rows, tokens) if not out(i) for w in x)
    n, v = sum(c.values()), len(c)
    return [(i, out(i), len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x)) for (i, _), x in zip(rows, tokens)]


def bigram_scores(rows, folds=7, held=2, discount=0.75):
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % folds == held
    tokens = [[*WORD.findall(lower(t or "")), None] for _, t in rows]
    c, pairs, total, kinds = Counter(), Counter(), Counter(), Counter()
    for (i, _), x in zip(rows, tokens):
        if not out(i):
            c.update(x)
            pairs.update(zip(["", *x], x))
    for (a, _), k in pairs.items():
        total[a] += k
        kinds[a] += 1
    n, v = sum(c.values()), len(c)
    result = []
    for _, x in zip(rows, tokens):
        s = 0.0
        for a, w in zip(["", *x], x):
            p = (c[w] + 1) / (n + v + 1)
            if total[a]:
                p = max(pairs[a, w] - discount, 0) / total[a] + discount * kinds[a] / total[a] * p
            s += math.log10(p)
        result.append(s)
    return result
