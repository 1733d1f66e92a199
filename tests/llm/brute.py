"""Plain-Python statements of the queries' contracts."""

import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")
ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    count, hit = Counter(windows), set()
    for k, w in enumerate(windows):
        if count[w] > 1:
            hit.update(range(k, k + 8))
    lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n


def fingerprint(text):
    w = WORD.findall(lower(text))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if bits[b] * 2 > len(shingles))


def union_find(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def simhash(rows):
    prints = [fingerprint(t) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    root, least = union_find(len(rows), pairs), {}
    for k, r in enumerate(root):
        least[r] = min(least.get(r, rows[k][0]), rows[k][0])
    return sorted((i, f"{prints[k]:016x}", least[root[k]]) for k, (i, _) in enumerate(rows))


def substring(rows, width=20):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda x: x[0]):
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if key in seen:
                gone.update(range(k, k + width))
            seen.add(key)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def contaminated(rows, items):
    windows = defaultdict(set)
    for i, t in items:
        w = ITEM_WORD.findall(lower(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    out = []
    for i, t in rows:
        w, hit, own = ITEM_WORD.findall(lower(t)), set(), set()
        for m in range(1, 11):
            for k in range(len(w) - m + 1):
                if (x := tuple(w[k : k + m])) in windows:
                    hit.update(range(k, k + m))
                    own |= windows[x]
        out.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def token_rows(rows, tokenizer):
    out, start = [], 0
    for i, t in sorted(rows):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    return out


def warc(rows):
    first, out = {}, []
    for i, t in sorted(rows):
        data = (t or "").encode()
        d = hashlib.sha256(data).hexdigest()
        f = first.setdefault(d, i) if len(data) >= 100 else i
        out.append((i, len(data), d, "response" if f == i else "revisit", None if f == i else f))
    return out


def canon(x):
    return json.dumps(x, sort_keys=True)


def similar_lines(rows):
    """Quadratic over distinct sets: a line goes if an earlier one has Jaccard similarity 0.8 or more."""
    earlier, out = {}, []
    for i, t in sorted(rows, key=lambda x: x[0]):
        kept, n, gone = [], 0, 0
        for line in (t or "").split("\n"):
            words = frozenset(WORD.findall(line))
            if not words:
                kept.append(line)
                continue
            n += 1
            if words in earlier or any(9 * len(words & o) >= 4 * (len(words) + len(o)) for o in earlier):
                gone += 1
            else:
                kept.append(line)
            earlier.setdefault(words, None)
        out.append((i, n, gone, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out
