"""The published generator (MT19937) from any place of its stream.

A word of the stream is a linear function, over the field of two elements, of the state
before it. So the state n steps ahead is x**n, modulo the characteristic polynomial of one
step, applied to the state: the sum of those of the next 19,937 states whose coefficient
is one. Polynomials are whole numbers, a bit for each coefficient. So a task begins at its
own place of a stream that is otherwise generated in order.
"""

from __future__ import annotations

import functools

import numpy as np

# The generator's published constants.
N, M, R, A = 624, 397, 31, 0x9908B0DF
UPPER, LOWER = 0x80000000, 0x7FFFFFFF
DEGREE = 32 * N - R


def times(a: int, b: int) -> int:
    """Product of two polynomials; ``b`` should be the sparser one."""
    out = 0
    while b:
        low = b & -b
        out ^= a << (low.bit_length() - 1)
        b ^= low
    return out


@functools.cache
def characteristic() -> int:
    """The characteristic polynomial, as its authors give it: with p = t**N + t**M and
    q = t**(N-1) + t**(M-1), p**(32-R) q**R plus, for the bits of A from the lowest, first
    those of p**(32-R) with falling powers of q, then those of falling powers of p."""
    p, q = 1 << N | 1 << M, 1 << (N - 1) | 1 << (M - 1)

    def power(x: int, n: int) -> int:
        out = 1
        for _ in range(n):
            out = times(out, x)
        return out

    head, tail = power(p, 32 - R), 0
    out = times(head, power(q, R))
    for i in range(32):
        if A >> i & 1:
            tail ^= times(head, power(q, R - 1 - i)) if i < R else power(p, 31 - i)
    return out ^ tail


def _exponents(poly: int) -> list[int]:
    return [i for i in range(poly.bit_length() - 1) if poly >> i & 1]


@functools.cache
def _fold() -> tuple[int, ...]:
    return tuple(_exponents(characteristic()))


_SPREAD = np.array([sum((b >> i & 1) << 2 * i for i in range(8)) for b in range(256)], "<u2")


def _reduced(x: int) -> int:
    """``x`` modulo the characteristic polynomial, which has few terms."""
    mask = (1 << DEGREE) - 1
    while x >> DEGREE:
        high, x = x >> DEGREE, x & mask
        for e in _fold():
            x ^= high << e
    return x


def power_of_x(n: int) -> int:
    """x**n modulo the characteristic polynomial."""
    out = 1
    for bit in bin(n)[2:]:
        size = (out.bit_length() + 7) // 8
        out = int.from_bytes(_SPREAD[np.frombuffer(out.to_bytes(size, "little"), np.uint8)].tobytes(), "little")
        out = _reduced(out << 1 if bit == "1" else out)
    return out


def seeded(seed: int) -> np.ndarray:
    """The first state of a whole number, as Python's generator has it."""
    import random

    return np.array(random.Random(seed).getstate()[1][:N], np.uint32)


def _next(old: np.ndarray) -> np.ndarray:
    """The N state words after ``old``."""
    out = np.empty(N, np.uint32)
    mag = lambda y: (y >> np.uint32(1)) ^ np.where(y & np.uint32(1), np.uint32(A), np.uint32(0))
    y = (old[:-1] & np.uint32(UPPER)) | (old[1:] & np.uint32(LOWER))
    a = N - M
    out[:a] = old[M:] ^ mag(y[:a])
    out[a : 2 * a] = out[:a] ^ mag(y[a : 2 * a])
    out[2 * a : N - 1] = out[a : N - 1 - a] ^ mag(y[2 * a :])
    last = (old[-1] & np.uint32(UPPER)) | (out[0] & np.uint32(LOWER))
    out[N - 1] = out[M - 1] ^ mag(last[None])[0]
    return out


def jumped(state: np.ndarray, n: int) -> np.ndarray:
    """The N state words n words ahead."""
    if n < 4 * DEGREE:  # nearer than what a jump has to generate
        for _ in range(n // N):
            state = _next(state)
        return np.concatenate([state, _next(state)])[n % N :][:N]
    # of the first word only the highest bit is state, so the sum begins a word later
    poly, run = power_of_x(n - 1), [state]
    for _ in range(DEGREE // N + 1):
        run.append(_next(run[-1]))
    words, out = np.concatenate(run), np.zeros(N, np.uint32)
    bits = np.unpackbits(np.frombuffer(poly.to_bytes(DEGREE // 8 + 1, "little"), np.uint8), bitorder="little")
    for i in np.flatnonzero(bits).tolist():
        out ^= words[i + 1 : i + 1 + N]
    return out


def _tempered(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(11))
    x = x ^ ((x << np.uint32(7)) & np.uint32(0x9D2C5680))
    x = x ^ ((x << np.uint32(15)) & np.uint32(0xEFC60000))
    return x ^ (x >> np.uint32(18))


class Stream:
    """32-bit words of ``random.Random(seed)``, from word ``start`` on."""

    def __init__(self, seed: int, start: int = 0):
        # the first words come from the state after the seeded one
        self.state, self.at = jumped(seeded(seed), start + N), 0

    def words(self, n: int) -> np.ndarray:
        out, have = [], 0
        while have < n:
            if self.at == N:
                self.state, self.at = _next(self.state), 0
            some = self.state[self.at : self.at + n - have]
            out.append(some)
            self.at += len(some)
            have += len(some)
        return _tempered(np.concatenate(out)) if out else np.zeros(0, np.uint32)

    def uniforms(self, n: int) -> np.ndarray:
        """The next n results of ``random()``: two words each."""
        w = self.words(2 * n).astype(np.uint64)
        return ((w[::2] >> np.uint64(5)) * np.uint64(1 << 26) + (w[1::2] >> np.uint64(6))) / float(1 << 53)


class Uniforms:
    """``random()`` by its number, for ascending numbers: goes on where they are near and
    jumps where they are not."""

    FAR = 1 << 21

    def __init__(self, seed: int):
        self.seed, self.stream, self.at = seed, None, 0

    def take(self, index: np.ndarray) -> np.ndarray:
        out, i = np.empty(len(index)), 0
        while i < len(index):
            first = int(index[i])
            if self.stream is None or first < self.at or first - self.at > self.FAR:
                self.stream, self.at = Stream(self.seed, 2 * first), first
            j = int(np.searchsorted(index, self.at + self.FAR, "left"))
            j = max(j, i + 1)
            n = int(index[j - 1]) + 1 - self.at
            out[i:j] = self.stream.uniforms(n)[index[i:j] - self.at]
            self.at += n
            i = j
        return out
