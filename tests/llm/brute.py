"""Plain versions of the operators, for small fixtures."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import xxhash

WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"


def fingerprint(text: str | None, width: int = 3) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(ids: list, fps: list[int], radius: int = 3) -> list:
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least: dict[int, int | None] = {}
    for i, d in enumerate(ids):
        r = find(i)
        known = [x for x in (least.get(r), d) if x is not None]
        least[r] = min(known) if known else None
    return [least[find(i)] for i in range(len(fps))]


def repeats(rows: list[tuple], length: int = 100) -> dict:
    """(doc_id, text) in order, ids distinct -> doc_id: (n_bytes, n_removed, n_spans, sha256)."""
    seen: set[bytes] = set()
    out = {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (text or "").encode()
        gone = np.zeros(len(body) + 1, bool)
        for p in range(len(body) - length + 1):
            window = body[p : p + length]
            if window in seen:
                gone[p : p + length] = True
            seen.add(window)
        kept = bytes(b for b, g in zip(body, gone, strict=False) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[doc_id] = (len(body), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def language_grams(text: str | None):
    """Counts of 1 to 3 letters in a row, an edge of a word being 0, as packed numbers."""
    from collections import Counter

    counts, word = Counter(), []
    for c in (text or "") + "\n":
        if c.isalpha():
            lower = c.lower()
            word.append(ord(lower) if len(lower) == 1 else ord(c))
            continue
        padded = [0, *word, 0]
        for a, b, e in zip(padded, padded[1:], padded[2:]):
            counts[a << 42 | b << 21 | e] += 1
            counts[-1 - (a << 21 | b)] += 1
            counts[-(1 << 60) - b] += 1
            if not e:
                counts[-1 - (b << 21)] += 1
        word = []
    return counts


def language_profiles(rows: list[tuple], size: int = 400) -> dict:
    from collections import Counter

    counts: dict = {}
    for text, lang in rows:
        counts.setdefault(lang, Counter()).update(language_grams(text))
    return {
        lang: {g: i for i, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:size])}
        for lang, c in sorted(counts.items()) if c
    }


def language(text: str | None, profiles: dict, size: int = 400) -> tuple[str, float]:
    own = sorted(language_grams(text).items(), key=lambda x: (-x[1], x[0]))[:size]
    if not own or not profiles:
        return "und", 0.0
    far = {
        lang: sum(abs(p[g] - i) if g in p else size for i, (g, _) in enumerate(own))
        for lang, p in profiles.items()
    }
    best = min(profiles, key=lambda lang: (far[lang], lang))
    return best, 1 - far[best] / (size * len(own))


def quality(rows: list[tuple], labels: list[tuple]) -> dict:
    """doc_id -> score: ridge by least squares over all rows of features at once, its folds' predictions in
    bins, the bins' isotonic means by the max-min formula."""
    from tablewright.llm.quality import BINS, FOLDS, Features, statistics

    def crc32(text) -> int:
        return zlib.crc32(text.encode())

    table = {r[0]: statistics((r[1] or "").encode()) for r in rows}
    train = [(d, q) for d, q, *_ in labels if d in table and crc32(str(d)) % 4 != 2]
    x, y = np.array([table[d] for d, _ in train]), np.array([float(q) for _, q in train])
    fold = np.array([crc32(f"fold{d}") % FOLDS for d, _ in train])
    features = Features(x.mean(axis=0), x.std(axis=0), 256, 7, 6.0)

    def solve(keep):
        a = features(x[keep])
        hold = np.sqrt(np.append(np.ones(a.shape[1] - 1), 1e-9))
        return np.linalg.lstsq(np.vstack((a, np.diag(hold))), np.append(y[keep], 0 * hold), rcond=None)[0]

    raw = np.zeros(len(x))
    for f in set(fold.tolist()):
        raw[fold == f] = features(x[fold == f]) @ solve(fold != f)
    cell = np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(int)
    used = sorted(set(cell.tolist()))
    n = [int((cell == c).sum()) for c in used]
    t = [float(y[cell == c].sum()) for c in used]
    level = [
        max(min(sum(t[a:b]) / sum(n[a:b]) for b in range(i + 1, len(used) + 1)) for a in range(i + 1))
        for i in range(len(used))
    ]
    middle = (np.array(used) + 0.5) / BINS * 2 - 0.5
    final = solve(np.ones(len(x), bool))
    return {d: float(np.interp(features(s[None]) @ final, middle, level)[0]) for d, s in table.items()}


def crc(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def nearest(ids: list, codes: list[int | None], k: int, every: int) -> dict:
    """query id: [(distance, id), ...] of the k nearest others."""
    out = {}
    for q, c in zip(ids, codes, strict=True):
        if c is None or q is None or q % every:
            continue
        others = [
            ((c ^ o).bit_count(), i is None, i)
            for i, o in zip(ids, codes, strict=True)
            if o is not None and i != q
        ]
        out[q] = [(d, i) for d, _, i in sorted(others, key=lambda x: (x[0], x[1], x[2] or 0))[:k]]
    return out


def backoff(rows: list[tuple], least: int = 2, alpha: float = 0.4) -> list[tuple]:
    """(doc_id, text) -> (doc_id, words, pairs found, log score)."""
    from collections import Counter
    from math import log

    split = [(d, (t or "").encode().lower().split()) for d, t in rows]
    word = Counter(w for _, ws in split for w in ws)
    pair = Counter(p for _, ws in split for p in zip(ws, ws[1:], strict=False))
    total = sum(word.values())
    out = []
    for d, ws in split:
        score = log(word[ws[0]] / total) if ws else 0.0
        found = 0
        for a, b in zip(ws, ws[1:], strict=False):
            if pair[a, b] >= least:
                found += 1
                score += log(pair[a, b] / word[a])
            else:
                score += log(alpha * word[b] / total)
        out.append((d, len(ws), found, score))
    return out
