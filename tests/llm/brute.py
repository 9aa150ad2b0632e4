"""Plain versions of the operators' contracts, in Python, for small tables."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


class Union:
    def __init__(self):
        self.parent = {}

    def root(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def linked_vectors(rows, cosine=0.95):
    """{vec_id: (n_links, component_id, kept)}; ids are distinct."""
    good = {}
    for i, v in rows:
        x = np.array([np.nan if c is None else c for c in v], float) if v is not None else np.zeros(0)
        if len(x) and np.isfinite(x).all() and x.any():
            good[i] = x / np.sqrt((x * x).sum())
    union, n, ids = Union(), Counter(), sorted(good)
    for i in ids:
        for j in ids:
            if i < j and len(good[i]) == len(good[j]) and good[i] @ good[j] >= cosine:
                n[i] += 1
                n[j] += 1
                union.join(i, j)
    return {i: (n[i], union.root(i), union.root(i) == i) for i, _ in rows}


def encoded(rows, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    out = {}
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out[i] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    return out


def base_scores(rows):
    """{doc_id: (n_tokens, n_known, train_tokens, base_score)}"""
    import math

    counts = Counter()
    for i, text in rows:
        if fold(i) != 1:
            counts.update([*words(text), 0])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, text in rows:
        tokens = [*words(text), 0]
        out[i] = (len(tokens), sum(counts[t] > 0 for t in tokens), n, sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens))
    return out


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def counts(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in match.split(".")), "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def personal_data(text):
    """Base spans (start, kind number, kind, end)."""
    return sorted((m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(KINDS.items()) for m in re.finditer(p, text or "") if counts(kind, m[0]))


def listed(spans):
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)


def shingles(text, size=4):
    w = words(text)
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def near_copies(rows, size=4, percent=85):
    """{doc_id: (n_shingles, component_id)}; ids are distinct. Pairs are found by shared shingles, all of them."""
    sets = {i: shingles(t, size) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    union = Union()
    for i, s in sets.items():
        shared = Counter(j for x in s for j in holders[x] if j > i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                union.join(i, j)
    return {i: (len(s), union.root(i)) for i, s in sets.items()}


def piece_count(word, pieces, longest):
    """Greedy longest match over the bytes of a word; single bytes always match."""
    data, at, n = "▁".encode() + word, 0, 0
    while at < len(data):
        size = next((k for k in range(min(longest, len(data) - at), 1, -1) if data[at : at + k] in pieces), 1)
        at, n = at + size, n + 1
    return n


def smallest(text, samples, settings, segment, narrow):
    """(language, score, rejected) by compressing each segment with each language's text before it."""
    import zstandard

    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0, True
    data, sizes = text.lower().encode(), []
    for language, sample in samples.items():
        total = 0
        for a in range(0, len(data), segment):
            content = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            total += len(zstandard.ZstdCompressor(dict_data=content, compression_params=settings).compress(data[a : a + segment]))
        sizes.append((total, language))
    best, second = sorted(sizes)[:2]
    return best[1], (second[0] - best[0]) / second[0], second[0] - best[0] < narrow * best[0]
