"""Shingle sets and HyperMinHash registers in numpy."""

from __future__ import annotations

import functools

import numpy as np

from formline.llm.decontaminate import mix, range_hashes

SHINGLE, REGISTERS, MANTISSA = 5, 128, 10
ROWS, BANDS = 5, 25  # of registers
EMPTY = np.uint16(0xFFFF)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles; words are runs without ASCII white space, A-Z in lower case."""
    raw = [t.encode() for t in texts]
    code = np.frombuffer(b"".join(r + b"\n" for r in raw), dtype=np.uint8)
    begin = np.cumsum([0] + [len(r) + 1 for r in raw])
    space = (code == 32) | ((code >= 9) & (code <= 13))
    before = np.concatenate([[True], space[:-1]])
    start, end = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    word = range_hashes(np.where((code >= 65) & (code <= 90), code + 32, code), start, end)
    first = np.searchsorted(start, begin)
    m = max(len(word) - SHINGLE + 1, 0)
    grams = np.zeros(m, dtype=np.uint64)
    for j in range(SHINGLE):
        grams = (grams + word[j:m + j]) * np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(32)
    grams = mix(grams)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a:b - SHINGLE + 1]))
        elif b > a:  # the whole sequence as one shingle
            h = np.uint64(b - a)
            for w in word[a:b]:
                h = mix(np.array([h ^ w], dtype=np.uint64))[0]
            out.append(np.array([h], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    return int(mix(s).sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), initial=np.uint64(0)).view(np.int64))


@functools.cache
def _edges() -> np.ndarray:
    return np.arange(REGISTERS + 1, dtype=np.uint64)[:-1] << np.uint64(57)


def registers(s: np.ndarray) -> np.ndarray:
    """Of each bucket (7 bits of the hash) the smallest value of the other 57 bits, as its leading zeros and the MANTISSA bits
    behind the leading one. An empty bucket takes the register of a full one that its number and the attempt choose."""
    at = np.searchsorted(s, _edges())
    full = np.append(at[1:], len(s)) > at
    value = np.where(full, s[np.minimum(at, len(s) - 1)] & np.uint64((1 << 57) - 1), np.uint64(1))
    value = np.maximum(value, np.uint64(1))
    bits = np.frexp(value.astype(np.float64))[1].astype(np.int64)  # bit length
    shift = bits - 1 - MANTISSA
    mantissa = np.where(shift >= 0, value >> np.maximum(shift, 0).astype(np.uint64), value << np.maximum(-shift, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    out = ((57 - bits).clip(0, 62).astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    empty = np.flatnonzero(~full)
    attempt = 0
    todo = empty
    while len(todo):
        pick = (mix(todo.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(attempt)) >> np.uint64(57)).astype(np.int64)
        hit = full[pick]
        out[todo[hit]] = out[pick[hit]]
        todo = todo[~hit]
        attempt += 1
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """By (set, band): a hash of the band's number and registers."""
    part = regs[:, :ROWS * BANDS].reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), part.shape[:2]).copy()
    for j in range(ROWS):
        h = (h + part[:, :, j]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return mix(h).view(np.int64)


def chance_match(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that the registers of two disjoint sets of sizes n and m agree."""
    zeros = np.arange(57)
    total = np.zeros(len(n))
    for z in zeros:
        p = [(1 - 2.0 ** -(z + 1)) ** (k / REGISTERS) for k in (n, m)]
        q = [(1 - 2.0 ** -z) ** (k / REGISTERS) if z else np.zeros(len(k)) for k in (n, m)]
        total += (p[0] - q[0]) * (p[1] - q[1])
    return np.minimum(total / (1 << MANTISSA), 0.5)


def estimated(regs: np.ndarray, left: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Jaccard estimates of pairs, corrected for registers that agree by chance."""
    share = np.empty(len(left))
    for at in range(0, len(left), 1 << 15):
        share[at:at + (1 << 15)] = (regs[left[at:at + (1 << 15)]] == regs[right[at:at + (1 << 15)]]).mean(axis=1)
    by_chance = chance_match(sizes[left].astype(float), sizes[right].astype(float))
    return (share - by_chance) / (1 - by_chance)
