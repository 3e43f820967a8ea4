"""A two-level n-gram trie in Elias-Fano form, kept in a memory-mapped file."""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

SAMPLE = 512  # elements between stored positions of the upper bits
LEVELS = 65533
RANGE = 12.0  # log10 probabilities from -RANGE to 0
BLOCK = 1 << 16


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes 1.. of probabilities above 0, in equal steps of the logarithm. 0 stands for absent."""
    return (1 + np.rint(np.clip(-np.log10(p) / RANGE, 0, 1) * LEVELS)).astype(np.uint16)


def restore(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** (-(code.astype(float) - 1) / LEVELS * RANGE), 0.0)


class Monotone:
    """A non-decreasing sequence: low bytes plain, the rest in unary, positions sampled."""

    def __init__(self, values: np.ndarray, keep):
        n = len(values)
        top = int(values[-1]) if n else 0
        self.n = n
        self.low_bytes = max(0, -(-((top // max(1, n)).bit_length()) // 8))
        shift = np.uint64(8 * self.low_bytes)
        planes = values.astype("<u8").view(np.uint8).reshape(n, 8)[:, : self.low_bytes]
        self.low = keep(np.ascontiguousarray(planes))
        high = (values >> shift).astype(np.int64) if self.low_bytes < 8 else np.zeros(n, np.int64)
        places = high + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        bits[places] = 1
        self.upper = keep(np.packbits(bits))
        self.samples = keep(places[::SAMPLE].astype(np.int64))

    def decode(self, start: int, stop: int) -> np.ndarray:
        """Elements start..stop-1, reading only their part of the file."""
        if stop <= start:
            return np.zeros(0, np.uint64)
        first = start // SAMPLE
        last = stop // SAMPLE + 1
        begin = int(self.samples[first]) // 8
        end = int(self.samples[last]) // 8 + 1 if last < len(self.samples) else len(self.upper)
        places = np.flatnonzero(np.unpackbits(np.asarray(self.upper[begin:end]))) + begin * 8
        places = places[places >= self.samples[first]][start - first * SAMPLE :][: stop - start]
        value = (places - np.arange(start, stop)).astype(np.uint64)
        for k in range(self.low_bytes - 1, -1, -1):
            value = (value << np.uint64(8)) | np.asarray(self.low[start:stop, k]).astype(np.uint64)
        return value


class Trie:
    """Contexts, pointers to their successors, successors relative to their context, and quantised probabilities.

    Successors are stored as one monotone sequence: within a context the word is added to the last value of
    the context before, so a search for a word is a search for its context's base plus the word.
    """

    def __init__(self, codes: np.ndarray, probability: np.ndarray):
        """``codes``: sorted distinct context << 32 | word; ``probability`` above 0 for each."""
        self.file = tempfile.TemporaryFile()  # no name, so nothing is left behind
        self.parts: list[tuple[int, np.dtype, tuple]] = []
        context, word = codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF)
        new = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(codes) else np.zeros(0, int)
        pointers = np.append(new, len(codes)).astype(np.uint64)
        last = word[pointers[1:].astype(np.int64) - 1] + np.uint64(1) if len(codes) else np.zeros(0, np.uint64)
        base = np.cumsum(last) - last
        relative = word + np.repeat(base, np.diff(pointers.astype(np.int64)))
        self.contexts = Monotone(context[new], self._keep)
        self.pointers = Monotone(pointers, self._keep)
        self.successors = Monotone(relative, self._keep)
        self.codes = self._keep(quantise(probability))
        self.file.flush()
        self.map = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ) if self.file.tell() else b""
        for owner in (self.contexts, self.pointers, self.successors):
            owner.low, owner.upper, owner.samples = (self._mapped(p) for p in (owner.low, owner.upper, owner.samples))
        self.codes = self._mapped(self.codes)

    def _keep(self, array: np.ndarray) -> int:
        self.file.seek(0, 2)
        self.file.write(b"\0" * (-self.file.tell() % 8))
        self.parts.append((self.file.tell(), array.dtype, array.shape))
        self.file.write(array.tobytes())
        return len(self.parts) - 1

    def _mapped(self, part: int) -> np.ndarray:
        at, dtype, shape = self.parts[part]
        count = int(np.prod(shape))
        return np.frombuffer(self.map, dtype, count, at).reshape(shape) if count else np.zeros(shape, dtype)

    def look_up(self, codes: np.ndarray) -> np.ndarray:
        """Quantised probabilities of sorted context << 32 | word codes; 0 where there is no such n-gram."""
        out = np.zeros(len(codes), np.uint16)
        context, word = codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF)
        n = self.contexts.n
        for at in range(0, n, BLOCK):  # contexts of one block at a time
            known = self.contexts.decode(at, min(n, at + BLOCK))
            lo, hi = np.searchsorted(context, known[0]), np.searchsorted(context, known[-1], "right")
            if lo == hi:
                continue
            pointers = self.pointers.decode(at, min(n, at + BLOCK) + 1).astype(np.int64)
            which = np.searchsorted(known, context[lo:hi])
            found = np.flatnonzero(known[which] == context[lo:hi])
            which, query = which[found], np.arange(lo, hi)[found]
            for s in range(int(pointers[0]), int(pointers[-1]), BLOCK):  # successors of one block at a time
                stop = min(int(pointers[-1]), s + BLOCK)
                left, right = np.searchsorted(pointers, s, "right") - 1, np.searchsorted(pointers, stop)
                a, b = np.searchsorted(which, [left, right])
                if a == b:
                    continue
                begin = max(0, s - 1)
                values = self.successors.decode(begin, stop)
                # the base of a context is one more than the last value of the context before
                first = pointers[which[a:b]]
                inside = first >= s
                base = np.zeros(b - a, np.uint64)
                ahead = inside & (first > 0)
                base[ahead] = values[first[ahead] - 1 - begin] + np.uint64(1)
                for k in np.unique(first[~inside]):  # a context that began in an earlier block
                    if k > 0:
                        base[first == k] = self.successors.decode(k - 1, k)[0] + np.uint64(1)
                target = base + word[query[a:b]]
                place = np.searchsorted(values, target)
                place[place == len(values)] = 0
                end = pointers[which[a:b] + 1]
                here = begin + place
                hit = (values[place] == target) & (here >= first) & (here < end) & (here >= s)
                out[query[a:b][hit]] = np.asarray(self.codes[here[hit]])
        return out
