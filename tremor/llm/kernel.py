"""Vectorised word and shingle hashing over batches of texts.

A word is a maximal run of bytes outside space and U+0009..U+000D.  Those separators
are single bytes in UTF-8, so words are found on the encoded text.  Each word gets a
64-bit hash from one running sum over the buffer (a polynomial in an odd base, whose
powers are invertible modulo 2**64), then a finaliser.  Work goes in chunks of about a
quarter of a megabyte, so memory does not follow the size of an Arrow batch; one text beyond
that is hashed in segments, a word cut by a border included, so what is kept of it is its
bytes and, for each word, a hash and two positions.
"""

import ctypes
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
SEGMENT = 1 << 19
SHINGLE_WORDS = 5

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5
_STEP = 0xD6E8FEB86659FD93


def worker_store():
    """A namespace that lives as long as the Python worker does."""
    return sys.modules.setdefault("_tremor_worker_store", types.ModuleType("_tremor_worker_store")).__dict__


def lean(run):
    """``run`` over a task's batches; then the worker's free memory goes back to the system, as idle workers stay beside the executor."""

    def lean_run(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:  # glibc
            trim(0)

    return lean_run


def mix64(x):
    """Finaliser of a 64-bit hash (a bijection on uint64 arrays)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _tables():
    """Byte values with and without A-Z folded, which bytes part words, powers of the base and their inverses."""
    store = worker_store()
    if "tables" not in store:
        plain = mix64(np.arange(1, 257, dtype=np.uint64) * _U(_STEP))
        folded = plain.copy()
        folded[65:91] = plain[97:123]
        gap = np.zeros(256, dtype=bool)
        gap[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(SEGMENT + 1, base, dtype=np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        store["tables"] = plain, folded, gap, *made
    return store["tables"]


def sums_before(x):
    """Running sums modulo 2**64, from 0: one more than ``x`` has."""
    out = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(x, out=out[1:])
    return out


def chunks(sizes, limit=CHUNK_BYTES):
    """Ranges (lo, hi) over texts of these sizes, each of about ``limit`` or of one text."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


class Words:
    """The words of some texts: ``hashes`` in order, text i owning bounds[i]:bounds[i+1].

    ``data`` is the texts' UTF-8 with one space between, ``starts``/``ends`` the byte range
    of each word, ``offsets`` where each text starts.
    """

    def __init__(self, encoded, fold=True):
        self.texts = encoded
        self.data = np.frombuffer(b" ".join(encoded), dtype=np.uint8)
        sizes = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
        self.offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
        plain, folded, gap, powers, inverse = _tables()
        values, small = folded if fold else plain, np.int32 if len(self.data) < 1 << 31 else np.int64
        self.gap = gap[self.data]
        starts, ends, hashes = [], [], []
        open_word = None  # (hash so far, bytes so far) of a word that began in an earlier segment
        for lo in range(0, len(self.data), SEGMENT):
            here = self.gap[lo : lo + SEGMENT]
            before = np.concatenate(([open_word is None], here[:-1]))
            start, end = np.flatnonzero(before & ~here), np.flatnonzero(~before & here)
            total = sums_before(values[self.data[lo : lo + SEGMENT]] * powers[: len(here)])
            if open_word is not None and len(end):  # it ends here
                value = open_word[0] + int(total[end[0]]) * pow(_BASE, open_word[1], 1 << 64)
                hashes.append(np.array([value % (1 << 64)], dtype=np.uint64))
                open_word = None
                starts.append((start + lo).astype(small))
                ends.append((end + lo).astype(small))
                end = end[1:]
            else:
                starts.append((start + lo).astype(small))
                ends.append((end + lo).astype(small))
            whole = start[: len(end)]
            hashes.append((total[end] - total[whole]) * inverse[whole])
            if len(start) > len(end):
                last = int(start[-1])
                open_word = int((total[-1:] - total[last : last + 1])[0]) * pow(_BASE, -last, 1 << 64) % (1 << 64), len(here) - last
            elif open_word is not None:
                open_word = (open_word[0] + int(total[-1]) * pow(_BASE, open_word[1], 1 << 64)) % (1 << 64), open_word[1] + len(here)
        if open_word is not None:
            hashes.append(np.array([open_word[0]], dtype=np.uint64))
            ends.append(np.array([len(self.data)], dtype=small))
        joined = lambda parts, kind: np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros(0, dtype=kind)
        self.starts, self.ends = joined(starts, small), joined(ends, small)
        self.hashes = joined(hashes, np.uint64)
        for lo in range(0, len(self.hashes), SEGMENT):
            self.hashes[lo : lo + SEGMENT] = mix64(self.hashes[lo : lo + SEGMENT])
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def windows(self, n):
        """Hashes of all runs of n words; run j starts at word j (runs over texts' ends included)."""
        h, m = self.hashes, max(0, len(self.hashes) - n + 1)
        _, _, _, powers, inverse = _tables()
        out = np.zeros(m, dtype=np.uint64)
        for lo in range(0, m, CHUNK_BYTES):
            part = h[lo : min(lo + CHUNK_BYTES, m) + n - 1]
            total = sums_before(part * powers[: len(part)])
            out[lo : lo + CHUNK_BYTES] = mix64((total[n:] - total[:-n]) * inverse[: len(part) - n + 1])
        return out

    def whole(self, i, n):
        """Hash of all words of text i, when they are fewer than n."""
        h = self.hashes[self.bounds[i] : self.bounds[i + 1]]
        total = np.full(1, len(h), dtype=np.uint64)
        for k in range(len(h)):
            total += h[k : k + 1] * _U(pow(_STEP, k + 1 + n, 1 << 64))
        return mix64(total)

    def shingle_sets(self, n=SHINGLE_WORDS):
        """Per text its distinct n-word shingles, ascending; fewer words: one shingle; none: empty."""
        every = self.windows(n)
        sets = []
        for i in range(len(self.bounds) - 1):
            lo, hi = self.bounds[i], self.bounds[i + 1]
            if hi - lo >= n:
                s = np.sort(every[lo : hi - n + 1])
                if len(s) > 1:
                    s = s[np.concatenate(([True], s[1:] != s[:-1]))]
                sets.append(s)
            else:
                sets.append(self.whole(i, n) if hi > lo else np.zeros(0, dtype=np.uint64))
        return sets


def encoded(column):
    """Texts of an Arrow string column as UTF-8 bytes; null counts as empty."""
    return [b"" if x is None else x.encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def word_chunks(texts, fold=True):
    """(lo, hi, Words) over the texts (bytes, or an Arrow string column), chunk by chunk."""
    listed = isinstance(texts, list)
    sizes = [len(t) for t in texts] if listed else pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for lo, hi in chunks(sizes):
        yield lo, hi, Words(texts[lo:hi] if listed else encoded(texts.slice(lo, hi - lo)), fold)


def set_digest(s):
    """Order-free 64-bit digest of a set of hashes, as a signed integer."""
    if not len(s):
        return 0
    x = mix64(s ^ _U(0xA0761D6478BD642F)).sum(dtype=np.uint64, keepdims=True) + np.array([len(s) * _STEP % (1 << 64)], dtype=np.uint64)
    return int(mix64(x).view(np.int64)[0])
