"""Plain versions of operators, for small inputs."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or frozenset([tuple(w)])


def classes(sets, percent):
    """Component of every index by links at percent/100 Jaccard; -1 for empty sets."""
    inv = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            inv[x].append(i)
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in inv[x]:
                if j < i:
                    common[j] += 1
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) if sets[i] else -1 for i in range(len(sets))]


def components(rows, width, percent):
    """rows: (doc_id, text), ids unique -> {doc_id: (n_shingles, component_id)}"""
    rows = sorted(rows)
    sets = [shingles(t, width) for _, t in rows]
    return {rows[i][0]: (len(sets[i]), rows[c if c >= 0 else i][0]) for i, c in enumerate(classes(sets, percent))}
