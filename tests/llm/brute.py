"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, n):
    w = words(text)
    return frozenset(zip(*[w[k:] for k in range(n)])) if len(w) >= n else frozenset([tuple(w)] if w else [])


def near_duplicates(rows, n=3, share=(85, 100)):
    """{position: (n_shingles, component_id, kept)} of (doc_id, text) rows, by comparing all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and share[1] * len(a & b) >= share[0] * len(a | b):
                parent[top(i)] = top(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        component = (min(ids) if ids else None) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), component, doc_id == component))
    return out


def greedy_pieces(word, first, rest):
    """Number of longest-match pieces, 0 if the word has none."""
    at, n = 0, 0
    while at < len(word):
        known = rest if at else first
        end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
        if end is None:
            return 0
        at, n = end, n + 1
    return n


def substring_distance(item, text):
    """Least edit distance of item to a substring of text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        now = [i]
        for j, y in enumerate(text, 1):
            now.append(min(row[j - 1] + (x != y), row[j] + 1, now[-1] + 1))
        row = now
    return min(row)


def characters(text):
    """The characters of a text as the quality model counts them: white space is one blank, none in front, three blanks before."""
    out = []
    for c in text or "":
        blank = c in " \t\n\x0b\x0c\r"
        if not blank or (out and out[-1] != " "):
            out.append(" " if blank else c)
    return "   " + "".join(out)


def kneser_ney(texts, order=4):
    """A function of context and character: interpolated modified Kneser-Ney probability, by plain recursion."""
    counts = {order: {}}
    for text in texts:
        line = characters(text)
        for i in range(order - 1, len(line)):
            g = line[i - order + 1: i + 1]
            counts[order][g] = counts[order].get(g, 0) + 1
    for k in range(order - 1, 0, -1):
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
    steps, contexts = {}, {}
    for k, c in counts.items():
        n1, n2, n3, n4 = (sum(v == x for v in c.values()) for x in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 0.9]
        steps[k] = [min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1)]
        contexts[k] = {}
        for g, v in c.items():
            contexts[k].setdefault(g[:-1], []).append(v)

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(counts[1]) + 1)
        held = contexts[k].get(g[:-1])
        if held is None:
            return p(g[1:])
        off = lambda v: steps[k][min(v, 3) - 1]
        own = counts[k].get(g, 0)
        return ((own - off(own)) / sum(held) if own else 0) + sum(map(off, held)) / sum(held) * p(g[1:])

    return p


def perplexity(p, text, order=4):
    line = characters(text)
    logs = [math.log(p(line[i - order + 1: i + 1])) for i in range(order - 1, len(line))]
    return math.exp(-sum(logs) / len(logs)) if logs else None
