"""Slow and plain versions of the operators, over lists of (doc_id, text) and the like."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def edited(docs):
    """{doc_id: edited text} for distinct ids."""
    order = sorted(docs)
    out = {}
    for k, (doc_id, text) in enumerate(order):
        quarter = len(text) // 4
        out[doc_id] = text[: len(text) - quarter] + order[(k + 1) % len(order)][1][:quarter]
    return out


def luhn(digits):
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def personal(text):
    """Base spans as a string, by kind, then start."""
    email = re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)
    ip = [m for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) < 256 for p in m[0].split("."))]
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    card = [m for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    phone = [m for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    kinds = (("email", email), ("ip", ip), ("card", card), ("phone", phone))
    return ",".join(f"{kind}:{m.start()}:{m.end()}" for kind, found in kinds for m in found)


def simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()))
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fingerprints, budget=3):
    """Smallest reachable place for each place in the list."""
    parent = list(range(len(fingerprints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array(fingerprints, np.uint64)
    for a in range(len(values)):
        for b in np.flatnonzero(np.bitwise_count(values ^ values[a]) <= budget):
            x, y = find(a), find(int(b))
            parent[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(values))]


def near_groups(texts, similarity=0.8):
    """Smallest reachable place: links of 3 bits or of a 5-word similarity."""
    roots = groups([simhash(t) for t in texts])

    def shingles(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()))
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} - {()}

    sets, holders = [shingles(t) for t in texts], collections.defaultdict(list)
    for k, found in enumerate(sets):
        for shingle in found:
            holders[shingle].append(k)
    both = collections.Counter((a, b) for held in holders.values() for b in held for a in held if a < b)
    for (a, b), n in both.items():
        if 1000 * n >= round(1000 * similarity) * (len(sets[a]) + len(sets[b]) - n):
            old, new = max(roots[a], roots[b]), min(roots[a], roots[b])
            roots = [new if r == old else r for r in roots]
    return roots


def quality(text):
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def secrets(text):
    """Base spans as a string, by start, then kind."""
    assign = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[kind]}:{a}:{b}" for a, kind, b in sorted(found))


def water_levels(sizes, weights, share=1.5, epochs=2):
    """Targets by sharing out again and again."""
    total, fixed = share * sum(sizes), {}
    while True:
        left = [k for k in range(len(sizes)) if k not in fixed]
        rest = total - sum(fixed.values())
        level = {k: rest * weights[k] / sum(weights[j] for j in left) for k in left}
        over = [k for k in left if level[k] > epochs * sizes[k]]
        if not over:
            return [fixed.get(k, level.get(k)) for k in range(len(sizes))]
        fixed |= {k: float(epochs * sizes[k]) for k in over}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
