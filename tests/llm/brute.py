"""Plain Python versions of the query contracts, row by row, for small tables."""

import hashlib
import re
from collections import defaultdict


def plain_words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())


def lower(raw):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in raw)


def ngram_join(rows, k=3, num=90, den=100):
    sets = []
    for _, text in rows:
        ws = [lower(x) for x in plain_words(text)]
        sets.append({tuple(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    index = defaultdict(list)
    for i, s in enumerate(sets):
        hit = defaultdict(int)
        for x in s:
            for j in index[x]:
                hit[j] += 1
            index[x].append(i)
        for j, both in hit.items():
            if den * both >= num * (len(s) + len(sets[j]) - both) and rows[i][0] is not None and rows[j][0] is not None:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((doc, len(sets[i]), least[find(i)] if doc is not None else None) for i, (doc, _) in enumerate(rows) if doc is not None)


def bench_words(text):
    return re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower((text or "").encode()))


def decontaminate(rows, items, n=10):
    found = defaultdict(set)
    for item, text in items:
        ws = bench_words(text)
        for i in range(max(1, len(ws) - n + 1) if ws else 0):
            found[tuple(ws[i:i + n])].add(str(item))
    sizes = {len(x) for x in found}
    out = []
    for doc, text in rows:
        ws, hit, own = bench_words(text), set(), set()
        for size in sizes:
            for i in range(len(ws) - size + 1):
                if (x := found.get(tuple(ws[i:i + size]))):
                    own |= x
                    hit.update(range(i, i + size))
        out.append((doc, len(ws), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def substring_dedup(rows, k=13):
    first = {}
    for doc, text in rows:
        ws = plain_words(text)
        if doc is not None:
            for i in range(len(ws) - k + 1):
                x = tuple(ws[i:i + k])
                first[x] = min(doc, first.get(x, doc))
    out = []
    for doc, text in rows:
        ws = plain_words(text)
        gone = set()
        if doc is not None:
            for i in range(len(ws) - k + 1):
                if first[tuple(ws[i:i + k])] < doc:
                    gone.update(range(i, i + k))
        kept = b" ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((doc, len(ws), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)
