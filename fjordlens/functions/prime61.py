"""Arithmetic in the field of p = 2^61 - 1: vectors (numpy uint64) and polynomials (lists of ints, lowest power first)."""

from __future__ import annotations

import random

import numpy as np

P = (1 << 61) - 1
_P, _31, _30 = np.uint64(P), np.uint64(31), np.uint64(30)
_M31, _M30, _61, _1 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1), np.uint64(61), np.uint64(1)


def vmul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b mod p for uint64 arrays of values below p; no intermediate passes 2^64."""
    a1, a0, b1, b0 = a >> _31, a & _M31, b >> _31, b & _M31
    mid = a1 * b0 + a0 * b1
    s = ((a1 * b1) << _1) + (mid >> _30) + ((mid & _M30) << _31) + a0 * b0
    s = (s & _P) + (s >> _61)
    return np.where(s >= _P, s - _P, s)


def vsub(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a >= b, a - b, a + _P - b)


def segment_products(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Row-wise product of each run of rows of ``values`` (n x k); ``starts`` has the first row of each run, ascending."""
    n = len(values)
    lengths = np.diff(np.append(starts, n))
    run = np.repeat(np.arange(len(starts)), lengths)
    pos = np.arange(n) - np.repeat(starts, lengths)
    while len(values) > len(starts):
        paired = np.zeros(len(values), bool)
        paired[:-1] = (pos[:-1] % 2 == 0) & (run[:-1] == run[1:])
        first = np.flatnonzero(paired)
        values[first] = vmul(values[first], values[first + 1])
        keep = pos % 2 == 0
        values, run, pos = values[keep], run[keep], pos[keep] // 2
    return values


def trim(f: list[int]) -> list[int]:
    while f and f[-1] == 0:
        f.pop()
    return f


def mul(f: list[int], g: list[int]) -> list[int]:
    if not f or not g:
        return []
    out = [0] * (len(f) + len(g) - 1)
    for i, a in enumerate(f):
        if a:
            for j, b in enumerate(g):
                out[i + j] += a * b
    return trim([x % P for x in out])


def divide(f: list[int], g: list[int]) -> tuple[list[int], list[int]]:
    f, inv, n = f[:], pow(g[-1], -1, P), len(g)
    q = [0] * max(0, len(f) - n + 1)
    for i in range(len(f) - n, -1, -1):
        c = f[i + n - 1] * inv % P
        q[i] = c
        if c:
            for j in range(n):
                f[i + j] = (f[i + j] - c * g[j]) % P
    return trim(q), trim(f[: n - 1] if len(f) >= n else f)


def monic(f: list[int]) -> list[int]:
    inv = pow(f[-1], -1, P)
    return [x * inv % P for x in f]


def gcd(f: list[int], g: list[int]) -> list[int]:
    while g:
        f, g = g, divide(f, g)[1]
    return monic(f) if f else f


def value(f: list[int], x: int) -> int:
    out = 0
    for c in reversed(f):
        out = (out * x + c) % P
    return out


class Modulus:
    """Multiplication modulo a monic f, on polynomials packed into one int, 17 bytes a coefficient: room for sums of 2^14 products."""

    def __init__(self, f: list[int]):
        self.d = len(f) - 1
        row = [-c % P for c in f[:-1]]
        self.rows = []  # x^d, x^(d+1), ... mod f, packed
        for _ in range(self.d):
            self.rows.append(pack(row))
            top = row[-1]
            low = [0, *row[:-1]]
            row = [(a - top * c) % P for a, c in zip(low, f)]

    def square(self, g: list[int]) -> list[int]:
        wide = unpack((x := pack(g)) * x, 2 * self.d)
        out = pack(wide[: self.d])
        for c, r in zip(wide[self.d :], self.rows):
            if c:
                out += c * r
        return unpack(out, self.d)

    def shifted(self, g: list[int], r: int) -> list[int]:
        """g * (x + r)."""
        out = pack([0, *g[:-1]]) + r * pack(g) + g[-1] * self.rows[0]
        return unpack(out, self.d)

    def power(self, r: int, e: int) -> list[int]:
        """(x + r)^e, without leading zeros."""
        out = [r % P, 1] + [0] * (self.d - 2)
        for bit in bin(e)[3:]:
            out = self.square(out)
            if bit == "1":
                out = self.shifted(out, r)
        return trim(out)


def pack(f: list[int]) -> int:
    return int.from_bytes(b"".join([c.to_bytes(17, "little") for c in f]), "little")


def unpack(x: int, n: int) -> list[int]:
    b = x.to_bytes(17 * n + 17, "little")
    return [int.from_bytes(b[i : i + 17], "little") % P for i in range(0, 17 * n, 17)]


def roots(f: list[int]) -> list[int]:
    """The distinct roots of f in the field, deterministic for a given f; may lack some if f has other factors."""
    f = monic(f)
    slope = trim([i * c % P for i, c in enumerate(f)][1:])
    twice = gcd(f, slope) if slope else [1]
    if len(twice) > 1:
        f = monic(divide(f, twice)[0])
    out, todo, rng = [], [(f, 0)], random.Random(f[0])
    while todo:
        g, tries = todo.pop()
        if len(g) == 2:
            out.append(-g[0] % P)
        elif len(g) == 3:
            out += _quadratic(g)
        elif len(g) > 3 and tries < 40:
            h = Modulus(g).power(rng.randrange(P), (P - 1) // 2) or [0]
            h[0] = (h[0] - 1) % P
            part = gcd(g, h) if trim(h) else g
            todo += [(part, 0), (monic(divide(g, part)[0]), 0)] if 1 < len(part) < len(g) else [(g, tries + 1)]
    return sorted(out)


def _quadratic(f: list[int]) -> list[int]:
    c, b, _ = f
    half = b * pow(2, -1, P) % P
    d = (half * half - c) % P
    s = pow(d, (P + 1) // 4, P)
    if s * s % P != d:
        return []
    return sorted({(s - half) % P, (-s - half) % P})


class Points:
    """Fixed sample points with what interpolation at the first ``k`` of them needs."""

    def __init__(self, k: int, first: int):
        self.at = [first + 1 + i for i in range(k)]
        whole = [1]
        for z in self.at:
            whole = mul(whole, [-z % P, 1])
        self.whole, self.basis = whole, []
        for z in self.at:
            part = divide(whole, [-z % P, 1])[0]
            inv = pow(value(part, z), -1, P)
            self.basis.append([c * inv % P for c in part])

    def rational(self, values: list[int], top: int, bottom: int) -> tuple[list[int], list[int]] | None:
        """(numerator, denominator) of degrees up to ``top`` and ``bottom`` through the points; top + bottom < k."""
        k = len(self.at)
        g = trim([sum(v * b[i] for v, b in zip(values, self.basis)) % P for i in range(k)])
        r0, r1, t0, t1 = self.whole, g, [], [1]
        while len(r1) - 1 > top:
            q, r = divide(r0, r1)
            qt = mul(q, t1)
            n = max(len(t0), len(qt))
            t = trim([((t0[i] if i < len(t0) else 0) - (qt[i] if i < len(qt) else 0)) % P for i in range(n)])
            r0, r1, t0, t1 = r1, r, t1, t
        return (r1, t1) if r1 and t1 and len(t1) - 1 <= bottom else None
