"""Plain Python versions of the operators, for small tables."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(rows, k=2, percent=80):
    """{doc_id: (n_shingles, component_id)} by comparing all pairs."""
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            x, y = sets[i], sets[j]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) * percent / 80 and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def substrings(rows, window=50):
    """{doc_id: (n_words, n_removed, kept_sha256)}."""
    words = {i: WORD.findall(t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        w = words[i]
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        left = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(left.encode()).hexdigest())
    return out


def lines(rows, least=20):
    """{doc_id: (n_lines, n_removed, text)}: every run that occurs before, from its shortest counting length on."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        ls = (text or "").split("\n")
        gone = set()
        for a in range(len(ls)):
            size = 0
            for b in range(a, len(ls)):
                size += len(ls[b])
                if size >= least:
                    run = tuple(ls[a : b + 1])
                    if run in seen:
                        gone.update(range(a, b + 1))
                    seen.add(run)
                    break
        out[i] = (len(ls), len(gone), "\n".join(x for j, x in enumerate(ls) if j not in gone))
    return out
