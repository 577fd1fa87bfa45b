"""Plain one-machine versions of the operators."""

import re
import zlib

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def components(docs, percent):
    """doc_id -> smallest doc_id reachable, over all pairs that share a shingle."""
    sets = [(i, shingles(t)) for i, t in docs if i is not None]
    by = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(k)
    root = {i: i for i, _ in docs if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, s) in enumerate(sets):
        for j in {j for x in s for j in by[x] if j > k}:
            other = sets[j][1]
            if 100 * len(s & other) >= percent * len(s | other):
                a, b = sorted((find(i), find(sets[j][0])))
                root[b] = a
    return {i: find(i) for i in root}


def repeated_bytes(docs, size=100):
    """doc_id -> flags of the bytes of strings that start earlier, for distinct ids."""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        data = (text or "").encode()
        cover = bytearray(len(data))
        for k in range(len(data) - size + 1):
            gram = data[k : k + size]
            if gram in seen:
                cover[k : k + size] = b"\1" * size
            seen.add(gram)
        out[i] = cover
    return out


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
