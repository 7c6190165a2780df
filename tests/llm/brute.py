"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import xxhash

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return [w for w in SPACE.split(text or "") if w]


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def fingerprint(text: str | None) -> int:
    w = words(lower(text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(keys: list, linked) -> dict:
    """Least key reachable of each key; ``linked`` tells whether two are linked."""
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if linked(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in keys}


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def long_hash(x: int, seed: int) -> int:
    return xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), seed)


def line_chunks(text: str | None) -> list[list[str]]:
    lines = (text or "").split("\n")
    h = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in lines]
    out, begin = [], 0
    for i in range(len(lines)):
        if i == len(lines) - 1 or 1 <= i < len(lines) - 2 and h[i] > h[i - 1] and h[i] > h[i + 1]:
            while i + 1 - begin >= 4:
                out.append(lines[begin : begin + 2])
                begin += 2
            out.append(lines[begin : i + 1])
            begin = i + 1
    return out


def repeated_lines(docs: list[tuple], n: int) -> dict:
    """{id: [whether the line lies in a run of n lines that a document before has]} of documents (id, text) in their order."""
    seen, out = set(), {}
    for i, text in docs:
        lines = (text or "").split("\n")
        runs = [tuple(lines[p : p + n]) for p in range(len(lines) - n + 1)]
        out[i] = [any(runs[p] in seen for p in range(max(0, k - n + 1), min(k + 1, len(runs)))) for k in range(len(lines))]
        seen.update(runs)
    return out


def dedup_lines(docs: list[tuple]) -> dict:
    """{(id, text): (new text, chunks, removed chunks, removed lines)} of documents (id, text)."""
    distinct = {}
    for i, text in docs:
        order = (i is not None, i, signed(xxhash.xxh64_intdigest(text.encode(), 42) if text is not None else 42), text or "")
        distinct[i, text] = order
    ordered = sorted(distinct, key=lambda k: (distinct[k][0], distinct[k][1] or 0, distinct[k][2], distinct[k][3]))
    seen, out = set(), {}
    for key in ordered:
        chunks, kept, gone = line_chunks(key[1]), [], []
        for c in chunks:
            body = "\n".join(c)
            if len(c) > 1 and body in seen:
                gone.append(c)
            else:
                kept.append(body)
                if len(c) > 1:
                    seen.add(body)
        out[key] = ("\n".join(kept) if gone else key[1], len(chunks), len(gone), sum(map(len, gone)))
    return out


def grams(text: str) -> Counter:
    cleaned = "".join(c if c.isalpha() else " " for c in text.lower())
    out: Counter = Counter()
    parts = cleaned.split()
    joined = f" {' '.join(parts)} " if parts else ""
    for n in (1, 2, 3):
        for i in range(len(joined) - n + 1):
            g = joined[i : i + n]
            if g == " " or n == 3 and g[1] == " ":
                continue
            out[g] += 1
    return out


def profile(counts: Counter, top: int) -> list[str]:
    def code(g: str) -> int:
        n = 0
        for c in g:
            n = n << 21 | ord(c)
        return n

    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:top]


def out_of_place(own: list[str], other: list[str], top: int) -> int:
    rank = {g: i for i, g in enumerate(other)}
    return sum(abs(rank[g] - i) if g in rank else top for i, g in enumerate(own))


def shared_runs(docs: list[tuple], n: int = 50) -> dict[tuple, set]:
    """Runs of n words (A-Z as a-z) that two documents or more have, with their ids."""
    found = defaultdict(set)
    for i, text in docs:
        w = words(lower(text or ""))
        for p in range(len(w) - n + 1):
            found[tuple(w[p : p + n])].add(i)
    return {k: v for k, v in found.items() if len(v) > 1}


def targets(sizes: dict, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict:
    """Targets of sources by raising a common level until all is shared or all sources are full."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_ and left > 1e-9:
        per = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if out[s] + per * weight[s] >= most * sizes[s]}
        if not full:
            for s in open_:
                out[s] += per * weight[s]
            break
        for s in full:
            left -= most * sizes[s] - out[s]
            out[s] = most * sizes[s]
        open_ -= full
    return out
