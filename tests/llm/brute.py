"""Plain single-machine versions of the operators, for comparison."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash

UPPER = bytes(range(65, 91))
LOWERED = bytes.maketrans(UPPER, UPPER.lower())


def low(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").translate(LOWERED).decode("utf-8", "surrogatepass")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def lines(docs: list[tuple[int, str | None]], least: int = 40, min_docs: int = 5) -> dict[int, tuple[int, int, str]]:
    keys = {d: [low(x).strip(" \t\n\v\f\r") for x in (t or "").split("\n")] for d, t in docs}
    where: dict[str, set[int]] = {}
    for d, own in keys.items():
        for k in own:
            where.setdefault(k, set()).add(d)
    out = {}
    for d, t in docs:
        kept = [x for x, k in zip((t or "").split("\n"), keys[d], strict=True) if len(k) < least or len(where[k]) < min_docs or d == max(where[k])]
        out[d] = (len(keys[d]), len(keys[d]) - len(kept), "\n".join(kept))
    return out


def simhash(text: str | None, n: int = 4) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(docs: list[tuple[int, str | None]], bits: int = 4) -> dict[int, tuple[str, int]]:
    fps = {d: simhash(t) for d, t in docs}
    at = {d: d for d in fps}

    def root(d: int) -> int:
        while at[d] != d:
            at[d] = at[at[d]]
            d = at[d]
        return d

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = sorted((root(a), root(b)))
                at[y] = x
    return {d: (f"{fps[d]:016x}", root(d)) for d in ids}


def repeats(docs: list[tuple[int, str | None]], length: int) -> dict[int, tuple[int, int, int, str]]:
    seen: dict[bytes, int] = {}
    texts = {d: (t or "").encode() for d, t in docs}
    digest = lambda b: xxhash.xxh3_128_digest(b)
    for t in texts.values():
        for i in range(len(t) - length + 1):
            k = digest(t[i : i + length])
            seen[k] = seen.get(k, 0) + 1
    out = {}
    for d, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[digest(t[i : i + length])] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out[d] = (len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept))
    return out


def shared(docs: list[tuple[int, str | None]], n: int) -> dict[int, tuple[int, int]]:
    """Words, and number, of passages of n words or more that another document holds too."""
    words = {d: (t or "").encode().split() for d, t in docs}
    holders: dict[tuple[bytes, ...], set[int]] = {}
    for d, own in words.items():
        for i in range(len(own) - n + 1):
            holders.setdefault(tuple(own[i : i + n]), set()).add(d)
    out = {}
    for d, own in words.items():
        found = bytearray(len(own))
        for i in range(len(own) - n + 1):
            if len(holders[tuple(own[i : i + n])]) > 1:
                found[i : i + n] = b"\1" * n
        out[d] = (sum(found), len(re.findall(b"\1+", bytes(found))))
    return out


def contaminated(docs: list[tuple[int, str | None]], items: list[tuple[object, str | None]], n: int = 10) -> dict[int, tuple[int, int, int, str, bool]]:
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
    windows: dict[tuple[str, ...], set[str]] = {}
    for name, t in items:
        own = words(t)
        for i in range(max(1, len(own) - n + 1) if own else 0):
            windows.setdefault(tuple(own[i : i + n]), set()).add(str(name))
    sizes = {len(w) for w in windows}
    out = {}
    for d, t in docs:
        own, hit, found = words(t), set(), set()
        for i in range(len(own)):
            for m in sizes:
                if i + m <= len(own) and (w := tuple(own[i : i + m])) in windows:
                    hit |= set(range(i, i + m))
                    found |= windows[w]
        out[d] = (len(own), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def personal(text: str | None) -> dict[str, list[tuple[int, int]]]:
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d: str) -> bool:
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0

    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15],
    }


def nearest(rows: list[tuple[int, list[float]]], k: int = 20, every: int = 20) -> list[tuple[int, int, int, float]]:
    """(query_id, rank, vec_id, score) by sums in order of the components, each row but the query's own a candidate."""
    vectors, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    out = []
    for at, (query_id, _) in enumerate(rows):
        if query_id % every == 0:
            s = np.zeros(len(rows))
            for c in range(vectors.shape[1]):
                s += vectors[:, c] * vectors[at, c]
            order = [j for j in np.lexsort((ids, -s)).tolist() if j != at][:k]
            out += [(query_id, rank, int(ids[j]), float(s[j])) for rank, j in enumerate(order, 1)]
    return out
