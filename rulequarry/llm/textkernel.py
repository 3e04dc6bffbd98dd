"""Array kernels over the bytes of many texts: words, their hashes, shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from rulequarry.llm.common import BLOCK_BYTES, blocks, mix64

#: Longer texts are hashed in pieces that are cut between words.
PIECE_BYTES = 4 << 20
# The bytes that separate words (space, \x09 to \x0D), and A-Z made a-z.
SPACES = b"\x09\x0a\x0b\x0c\x0d\x20"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACES)] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))
_POWERS = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        n = max(n, BLOCK_BYTES + 64)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            x = np.full(n, base, dtype=np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def _pieces(data: bytes) -> Iterator[bytes]:
    while len(data) > PIECE_BYTES:
        cut = max(data.rfind(bytes([s]), 0, PIECE_BYTES) for s in SPACES)
        if cut <= 0:
            cut = min((x for s in SPACES if (x := data.find(bytes([s]), PIECE_BYTES)) > 0), default=len(data))
        yield data[:cut]
        data = data[cut:]
    yield data


def word_hashes(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets by item): words are maximal runs of bytes that separate nothing."""
    out, counts = [], np.zeros(len(items), dtype=np.int64)
    for a, b in blocks(items):
        for group in [[x for x in items[a:b]]] if b - a > 1 or len(items[a]) <= PIECE_BYTES else [[p] for p in _pieces(items[a])]:
            data = b" " + b" ".join(group) + b" "
            buf = np.frombuffer(data, dtype=np.uint8)
            space = _SPACE[buf]
            edge = np.flatnonzero(space[1:] != space[:-1]) + 1
            start, end = edge[::2], edge[1::2]
            up, down = _powers(len(buf) + 1)
            total = np.zeros(len(buf) + 1, dtype=np.uint64)
            np.cumsum(_BYTES[buf] * up[: len(buf)], out=total[1:])
            out.append(mix64((total[end] - total[start]) * down[start]))
            base = np.concatenate(([0], np.cumsum([len(x) + 1 for x in group]))) + 1
            per = np.diff(np.searchsorted(start, base))
            if b - a == 1:
                counts[a] += len(start)
            else:
                counts[a:b] = per
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)), np.concatenate(([0], np.cumsum(counts)))


def shingle_sets(texts: list[str], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): for each text its sorted distinct shingles of `size` words, of all words if they are fewer."""
    words, at = word_hashes([t.encode("utf-8", "surrogatepass").translate(LOWER) for t in texts])
    n = np.diff(at)
    rolled = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
    for k in range(size):
        rolled = mix64(rolled * _BASE + words[k : k + len(rolled)]) if k == size - 1 else rolled * _BASE + words[k : k + len(rolled)]
    parts, counts = [], np.zeros(len(texts), dtype=np.int64)
    for i, (a, w) in enumerate(zip(at[:-1].tolist(), n.tolist(), strict=True)):
        if w >= size:
            x = np.sort(rolled[a : a + w - size + 1])
            x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif w:
            h = np.array([w], dtype=np.uint64)
            for k in range(a, a + w):
                h = h * _BASE + words[k : k + 1]
            x = mix64(h)
        else:
            continue
        parts.append(x)
        counts[i] = len(x)
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)), np.concatenate(([0], np.cumsum(counts)))
