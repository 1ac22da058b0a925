"""Words of whole texts as numpy arrays over their UTF-8 bytes, for use inside Arrow tasks.

All patterns here are sets of bytes: white space and ASCII signs never occur inside a longer UTF-8 sequence, so a class of
bytes finds the same words as the pattern over characters.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTES_AT_ONCE = 3 << 20

_all = np.arange(256)
#: [^\x20\x09-\x0D]+
NOT_SPACE = ~((_all == 0x20) | ((_all >= 0x09) & (_all <= 0x0D)))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (digits, small letters and all beyond ASCII)
ALNUM = (_all >= 0x80) | ((_all >= 0x30) & (_all <= 0x39)) | ((_all >= 0x61) & (_all <= 0x7A))
LOWER = np.where((_all >= 65) & (_all <= 90), _all + 32, _all).astype(np.uint8)

_random = np.random.default_rng(20240229)
_OF_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP, _NEXT = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to n - 1, modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) < n:
        p = np.full(max(n, 4096), base, np.uint64)
        p[0] = 1
        _powers[base] = np.cumprod(p, dtype=np.uint64)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parts(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about `most` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, done = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, done + most, "right")))
            yield batch.slice(at, to - at)
            at, done = to, int(sizes[to - 1])


class Words:
    """Words of some texts: byte ranges start to end in data; first[d] is the first word of text d, first[d + 1] its end."""

    def __init__(self, column: pa.Array, of: np.ndarray = NOT_SPACE, lower: bool = False):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.data = LOWER[data] if lower else data
        inside = of[self.data]
        self.inside = inside
        n = len(data)
        cuts = np.zeros(n + 1, bool)
        cuts[self.offsets] = True
        begins, ends = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1] | cuts[1:n]
            ends[:-1] &= ~inside[1:] | cuts[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.length = self.end - self.start
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """64 bits of each word."""
        if not len(self):
            return np.zeros(0, np.uint64)
        at = np.cumsum(self.length) - self.length
        place = np.arange(int(self.length.sum())) - np.repeat(at, self.length)
        return mix(np.add.reduceat(_OF_BYTE[self.data[self.inside]] * powers(_STEP | 1, int(self.length.max()) + 1)[place], at))

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The words with one space after each, and where each begins and ends in that."""
        at = np.cumsum(self.length + 1) - self.length - 1
        out = np.full(int((self.length + 1).sum()), 0x20, np.uint8)
        out[np.arange(int(self.length.sum())) + np.repeat(np.arange(len(self)), self.length)] = self.data[self.inside]
        return out.tobytes(), at, at + self.length

    def left(self) -> np.ndarray:
        """How many words of its text are left from each word on, itself included."""
        return self.first[self.doc + 1] - np.arange(len(self))


def runs_hash(words: np.ndarray, start: np.ndarray, length: np.ndarray | int, seed: int = 0) -> np.ndarray:
    """64 bits of the words start to start + length - 1."""
    base = (_NEXT + 2 * seed * 0x2545F4914F6CDD1D) % (1 << 64) | 1
    n = len(words)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((words ^ np.uint64(seed * 0x5851F42D4C957F2D % (1 << 64))) * powers(base, n), out=total[1:])
    back = powers(pow(base, -1, 1 << 64), n + 1)
    return mix((total[start + length] - total[start]) * back[start] + np.asarray(length).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def first_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each i with a whole window: the first index of the least of values[i : i + width]."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, span = np.arange(len(values)), 1
    while 2 * span <= width:
        a, b = best[: len(best) - span], best[span:]
        best = np.where(values[b] < values[a], b, a)
        span *= 2
    a, b = best[:n], best[width - span : width - span + n]
    return np.where(values[b] < values[a], b, a)


def lists(values: list | np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


def distinct(starts: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """For byte strings that lie one after another in data, string i from starts[i] to starts[i + 1]: the place of each among
    the different ones, and those. Bytes are compared, not hashes of them."""
    rows = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(np.ascontiguousarray(starts, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = rows.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[i] to starts[i] + counts[i] - 1 of all i, one after another."""
    return np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
