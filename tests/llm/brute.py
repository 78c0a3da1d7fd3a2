"""Plain Python versions of what the operators compute."""

from __future__ import annotations

import re
import string
from collections import Counter, defaultdict
from math import log

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def low(text):
    return (text or "").translate(_LOW)


def words(text):
    return WORD.findall(low(text))


def backoff(texts, order, alpha, keep):
    """(words, words at full order, log score) of each text."""
    split = [words(t) for t in texts]
    counts = [Counter() for _ in range(order + 1)]
    for w in split:
        for n in range(1, order + 1):
            counts[n].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total, out = sum(counts[1].values()), []
    for w in split:
        score, full = 0.0, 0
        for i in range(len(w)):
            for n in range(min(order, i + 1), 0, -1):
                gram = tuple(w[i - n + 1 : i + 1])
                if n == 1 or counts[n][gram] >= keep:
                    full += n == order
                    score += log(counts[n][gram] / (total if n == 1 else counts[n - 1][gram[:-1]]))
                    break
                score += log(alpha)
        out.append((len(w), full, score))
    return out


def gram_set(text, n=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def near_duplicates(rows, threshold=0.8):
    """doc_id -> (class_id, copy_id, n_copies, n_links) by comparing all sets."""
    members = defaultdict(list)
    for doc_id, text in rows:
        members[gram_set(text)].append(doc_id)
    empty = members.pop(frozenset(), [])
    sets = list(members)
    parent, links = list(range(len(sets))), [0] * len(sets)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared >= threshold * (len(sets[i]) + len(sets[j]) - shared) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    classes = defaultdict(list)
    for i, s in enumerate(sets):
        classes[find(i)] += members[s]
    out = {d: (d, d, 1, 0) for d in empty}
    for i, s in enumerate(sets):
        for d in members[s]:
            out[d] = (min(classes[find(i)]), min(members[s]), len(members[s]), links[i])
    return out
