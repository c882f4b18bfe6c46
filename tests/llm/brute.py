"""Plain brute-force versions of the operators, for the tests."""

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def simhash(text, k=3):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def hamming_links(fps, max_bits=3):
    ids = list(fps)
    v = np.array([fps[i] for i in ids], dtype=np.uint64)
    out = []
    for k in range(len(ids)):
        near = np.flatnonzero(np.bitwise_count(v[k + 1:] ^ v[k]) <= max_bits) + k + 1
        out += [(ids[k], ids[j]) for j in near]
    return out
