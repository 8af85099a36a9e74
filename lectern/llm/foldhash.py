"""Skip-and-fold table over code points, rolling polynomial hashes of what it lets through, and a
two-pointer comparison under the same table. No canonical string is ever built.

Skipped: white space, punctuation, control, format and other invisible characters. Folded: letter case
(full case folding) and canonical composition; diacritics count.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from itertools import zip_longest

import numpy as np

# The moduli are primes below 2**31, so a product with a code point stays below 2**63.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (911382323, 972663749, 1000003931, 835218079)
#: Code points hashed at a time; longer texts carry their hash over.
BLOCK = 1 << 20
#: Above this every code point stands for itself but for tags and variation selectors.
TOP = 0x30000
# Invisible characters that the general categories don't tell, and a slash that is a symbol.
EXTRA_SKIP = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x2044, 0x2800, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)}


def _fold(cp: int) -> str:
    ch = chr(cp)
    kind = unicodedata.category(ch)
    if kind[0] in "ZP" or kind in ("Cc", "Cf") or cp in EXTRA_SKIP:
        return ""
    if kind == "Cs":
        return ch
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", ch).casefold())


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, length by code point into flat; combining class by code point."""
    start, length, flat = np.zeros(TOP, np.int64), np.zeros(TOP, np.int64), []
    classes = np.zeros(TOP, np.uint8)
    for cp in range(TOP):
        out = _fold(cp) if cp < 0x20000 or cp >= 0x2F800 else chr(cp)
        start[cp], length[cp] = len(flat), len(out)
        flat.extend(map(ord, out))
        if cp < 0x20000:
            classes[cp] = unicodedata.combining(chr(cp))
    return start, length, np.array(flat, np.int64), classes


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = min(len(text), at + BLOCK)
        while end < len(text) and (unicodedata.combining(text[end]) or not _fold(ord(text[end]))):
            end += 1
        yield text[at:end]
        at = end


def folded(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points after the table, in canonical order of marks, and the row of each."""
    start, length, flat, classes = tables()
    low = codes < TOP
    at = np.where(low, codes, 0)
    n = np.where(low, length[at], ~((codes >= 0xE0000) & (codes < 0xE0200)))
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    inner = np.arange(total) - np.repeat(ends - n, n)
    source = np.repeat(np.arange(len(codes)), n)
    out = np.where(low[source], flat[np.minimum(start[at][source] + inner, len(flat) - 1)], codes[source])
    own = rows[source]
    kind = classes[np.minimum(out, TOP - 1)] if total else np.zeros(0, np.uint8)
    while total > 1:
        wrong = np.flatnonzero((kind[:-1] > kind[1:]) & (kind[1:] > 0) & (own[:-1] == own[1:]))
        if not len(wrong):
            break
        wrong = wrong[np.r_[True, np.diff(wrong) > 1]]
        for x in (out, kind):
            x[wrong], x[wrong + 1] = x[wrong + 1].copy(), x[wrong].copy()
    return out, own


@functools.lru_cache(8)
def _powers(n: int, which: int) -> np.ndarray:
    p, out = PRIMES[which], np.ones(1, np.int64)
    step = BASES[which] % p
    while len(out) < n:  # doubling: the next half is the first half times base**len
        out = np.concatenate([out, out * np.int64(step) % p])
        step = step * step % p
    return out


def hash_texts(texts: list[str]) -> np.ndarray:
    """uint64 array (len(texts), 2): two 62-bit polynomial hashes of each text; 0 for what is empty under the table."""
    state = np.zeros((len(texts), 4), np.int64)
    done = np.zeros(len(texts), np.int64)

    def block(parts: list[str], owner: list[int]) -> None:
        own = np.array(owner)
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        out, rows = folded(codes, np.repeat(np.arange(len(parts)), [len(p) for p in parts]))
        if not len(out):
            return
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        counts = np.diff(np.r_[first, len(rows)])
        index = np.arange(len(out)) - np.repeat(first, counts)
        to = own[rows[first]]
        size = 1 << int(index.max() + 1).bit_length()
        for i, p in enumerate(PRIMES):
            sums = np.add.reduceat((out + 1) * _powers(size, i)[index] % p, first) % p
            carry = np.array([pow(BASES[i], int(d), p) for d in done[to]], np.int64) if done[to].any() else 1
            state[to, i] = (state[to, i] + sums * carry) % p
        done[to] += counts

    parts, owner, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in _pieces(text) if len(text) > BLOCK else (text,) if text else ():
            if size + len(piece) > BLOCK and parts or owner and owner[-1] == i:
                block(parts, owner)
                parts, owner, size = [], [], 0
            parts.append(piece)
            owner.append(i)
            size += len(piece)
    if parts:
        block(parts, owner)
    s = state.astype(np.uint64)
    return np.stack([s[:, 0] << np.uint64(31) | s[:, 1], s[:, 2] << np.uint64(31) | s[:, 3]], 1)


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """64-bit finaliser, so that sums of parts don't cancel."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


@functools.cache
def _fold_char(ch: str) -> str:
    cp = ord(ch)
    return "" if 0xE0000 <= cp < 0xE0200 else _fold(cp)


def stream(text: str) -> Iterator[str]:
    """Folded code points one by one; only a run of combining marks is held back to be ordered."""
    marks: list[str] = []
    for ch in text:
        for x in _fold_char(ch):
            if unicodedata.combining(x):
                marks.append(x)
            else:
                if marks:
                    yield from sorted(marks, key=unicodedata.combining)
                    marks.clear()
                yield x
    yield from sorted(marks, key=unicodedata.combining)


def same(a: str, b: str) -> bool:
    """Two pointers run over both texts, each skipping what the table skips."""
    return a == b or all(x == y for x, y in zip_longest(stream(a), stream(b)))
