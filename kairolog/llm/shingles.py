"""Word shingles of whole texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Bytes hashed at a time; a part ends at white space, or is as long as its longest word.
PART = 1 << 18
BASE = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: every bit depends on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i below n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(max(n, PART + 1), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: np.ndarray) -> np.ndarray:
    """One for each word of the bytes, A-Z lower-cased; words are runs of other bytes than space and 0x09 to 0x0D."""
    inside = ~_space[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    begin, end = edges[::2], edges[1::2]
    up, down = powers(len(data) + 1)
    upper = (data >= 65) & (data <= 90)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + (upper * np.uint8(32)) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def _parts(text: bytes) -> list[bytes]:
    out, at = [], 0
    while len(text) - at > PART:
        cut = max(text.rfind(b" ", at, at + PART), text.rfind(b"\n", at, at + PART))
        if cut <= at:
            cuts = [c for c in (text.find(b" ", at + PART), text.find(b"\n", at + PART)) if c >= 0]
            cut = min(cuts, default=len(text))
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def _shingled(words: np.ndarray) -> np.ndarray:
    n = max(1, len(words) - WORDS + 1)
    h = np.full(n if len(words) else 0, min(len(words), WORDS), np.uint64)
    for j in range(min(WORDS, len(words))):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    return mix(h)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """For each text its distinct shingles, ascending: runs of 5 words; the whole text if it has fewer; none without."""
    out: list[np.ndarray] = []
    some: list[bytes] = []
    size = 0

    def flush() -> None:
        data = np.frombuffer(b"\n".join(some), np.uint8)
        hashes = word_hashes(data)
        starts = np.flatnonzero(np.diff(np.concatenate(([False], ~_space[data])).view(np.int8)) == 1)
        at = 0
        offset = 0
        for raw in some:
            offset += len(raw) + 1
            stop = int(np.searchsorted(starts, offset - 1))
            out.append(np.unique(_shingled(hashes[at:stop])))
            at = stop
        some.clear()

    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if len(raw) > PART:
            if some:
                flush()
            size = 0
            out.append(np.unique(_shingled(np.concatenate([word_hashes(np.frombuffer(p, np.uint8)) for p in _parts(raw)]))))
            continue
        if size + len(raw) + 1 > PART and some:
            flush()
            size = 0
        some.append(raw)
        size += len(raw) + 1
    if some:
        flush()
    return out
