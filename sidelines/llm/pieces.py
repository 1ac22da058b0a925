"""SentencePiece encoding and decoding as a weighted transducer: composed with each text, its shortest path is the encoding."""

import re
import struct
from collections.abc import Iterator
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidelines.llm.text import parts

#: Fields of the public model format: pieces, trainer, normaliser; kinds of pieces; the mark that stands for a space.
PIECE, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARK = "▁"
#: Chunks that a task remembers, and the longest in bytes.
REMEMBER, LONGEST = 400_000, 48


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        elif tag & 7 == 5:
            yield tag >> 3, struct.unpack("<f", raw[at : at + 4])[0]
            at += 4
        elif tag & 7 == 1:
            yield tag >> 3, raw[at : at + 8]
            at += 8
        else:
            size = number()
            yield tag >> 3, raw[at : at + size]
            at += size


class Normalizer:
    """The model's normaliser, a transducer of three steps: the longest string of its map that begins at a place is replaced,
    spaces are joined and cut off the ends if the model says so, and one comes before the first. Marks are spaces."""

    def __init__(self, rule: dict):
        self.prefix, self.joins = bool(rule.get(3, 1)), bool(rule.get(4, 1))
        if not rule.get(5, 1):
            raise ValueError("only models that mark spaces are supported")
        self.units, self.strings = None, b""
        if charsmap := rule.get(2):
            size = struct.unpack("<I", charsmap[:4])[0]
            self.units, self.strings = np.frombuffer(charsmap[4 : 4 + size], "<u4").tolist(), charsmap[4 + size :]

    def _longest(self, raw: bytes, at: int) -> tuple[int, bytes]:
        """How many bytes the longest string of the map takes from a place on, and what it becomes; 0 if none begins there.
        The map is a double array: a unit holds its label, whether a string ends there, and where its arcs begin."""
        found, units = (0, b""), self.units
        place = units[0] >> 10 << ((units[0] & 512) >> 6)
        for end in range(at, len(raw)):
            place ^= raw[end]
            if place >= len(units) or units[place] & 0x800000FF != raw[end]:
                break
            unit = units[place]
            place ^= unit >> 10 << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                begin = units[place] & 0x7FFFFFFF
                found = (end + 1 - at, self.strings[begin : self.strings.index(b"\0", begin)])
        return found

    def __call__(self, text: str) -> str:
        """Without the space before the first, which `prefix` asks for."""
        if self.units:
            raw, out, at = text.encode(), [], 0
            while at < len(raw):
                n, new = self._longest(raw, at)
                if not n:
                    n = 1 if raw[at] < 0xC0 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                    new = raw[at : at + n]
                out.append(new)
                at += n
            text = b"".join(out).decode()
        text = text.replace(MARK, " ")
        return re.sub(" +", " ", text).strip(" ") if self.joins else text


class Transducer:
    """Normaliser, pieces and byte fallback of a merge model, compiled once.

    States are (place in the text, last piece). An arc reads a piece and writes its id, reads a character that is no
    piece and writes its bytes' ids, or reads a whole run of marks and writes that run's ids. Arcs weigh one for each id;
    there is no arc (its weight in the tropical semiring is infinite) between two pieces that the model's merges would
    not keep apart. Scores of merges differ but for those of marks alone, so a sequence of pieces is what the merges give
    if and only if all its neighbours stay apart; runs of marks, whose ties their places decide, are arcs of their own.
    The shortest path is thus the model's encoding. No arc crosses two bytes that are neighbours in no piece, so a text is
    composed chunk by chunk between such places.
    """

    def __init__(self, raw: bytes):
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [-1] * 256
        self.unknown, rule = 0, {}
        for field, value in _fields(raw):
            if field == PIECE:
                piece = dict(_fields(value))
                text, kind, at = piece[1].decode(), piece.get(3, NORMAL), len(self.bytes_of)
                if kind == BYTE:
                    self.byte_ids[int(text[1:-1], 16)] = at
                    self.bytes_of.append(bytes([int(text[1:-1], 16)]))
                elif kind in (NORMAL, USER, UNUSED):
                    self.ids[text] = at
                    self.scores[text] = piece.get(2, 0.0)
                    self.bytes_of.append(text.replace(MARK, " ").encode())
                else:
                    self.unknown = at if kind == UNKNOWN else self.unknown
                    self.bytes_of.append(b"")
            elif field == NORMALIZER:
                rule |= dict(_fields(value))
            elif field == TRAINER:
                trainer = dict(_fields(value))
                if trainer.get(3, 1) != 2 or trainer.get(24, 0):
                    raise ValueError("only merge models whose spaces begin pieces are supported")
        self.normalizer = Normalizer(rule)
        if any(MARK in text.lstrip(MARK) for text in self.ids):
            raise ValueError("a piece holds a space after another character")
        merged = sorted(score for text, score in self.scores.items() if len(text) > 1 and text.strip(MARK))
        if any(a == b for a, b in pairwise(merged)):
            raise ValueError("two merges have one score")
        self.longest_run = max((len(text) for text in self.ids if not text.strip(MARK)), default=1)
        self.runs = [self.merged(MARK * n) for n in range(4 * self.longest_run + 1)]
        if any(self.runs[n] != [MARK * self.longest_run, *self.runs[n - self.longest_run]] for n in range(2 * self.longest_run, len(self.runs))):
            raise ValueError("runs of spaces don't repeat")
        self.trie: dict[str, list] = {}
        for text in self.ids:
            node = self.trie
            for char in text[:-1]:
                node = node.setdefault(char, [{}, None])[0]
            node.setdefault(text[-1], [{}, None])[1] = text
        self.joined = np.zeros((256, 256), bool)
        for text in self.bytes_of:
            raw = np.frombuffer(text, np.uint8)
            self.joined[raw[:-1], raw[1:]] = True
        self.joined[:, 0x80:0xC0] = True
        self.apart: dict[str, dict[str, bool]] = {}
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        sizes = np.array([len(x) for x in self.bytes_of])
        self.sizes, self.starts, self.flat = sizes, np.cumsum(sizes) - sizes, np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def merged(self, text: str) -> list[str]:
        """What merging the best pair again and again, the first on ties, makes of a text."""
        out, score, none = list(text), self.scores.get, -np.inf
        pairs = [score(a + b, none) for a, b in pairwise(out)]
        while pairs and (best := max(pairs)) > none:
            i = pairs.index(best)
            out[i : i + 2] = [out[i] + out[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score(out[i - 1] + out[i], none)
            if i < len(pairs):
                pairs[i] = score(out[i] + out[i + 1], none)
        return out

    def stay_apart(self, last: str, piece: str) -> bool:
        return self.merged(last + piece) == ([last, piece] if last else [piece])

    def run(self, n: int) -> list[str]:
        """Pieces of n marks."""
        over = max(0, n // self.longest_run - 2)
        return [MARK * self.longest_run] * over + self.runs[n - over * self.longest_run]

    def path(self, chunk: str) -> list[str]:
        """Pieces on the shortest path through one chunk.

        states[at] holds (last piece, least sum of weights, place before, number of the state there) for each last piece
        with which the place is reached."""
        n, marks = len(chunk), len(chunk) - len(chunk.lstrip(MARK))
        states: list[list[tuple[str, int, int, int]]] = [[] for _ in range(n + 1)]
        states[0].append(("", 0, 0, 0))
        for k in (marks - 1, marks):
            if k > 0:
                run = self.run(k)
                states[k].append((run[-1], len(run), 0, 0))
        trie, apart, chars = self.trie, self.apart, list(chunk)
        for at in range(max(0, marks - 1), n) if marks > 1 else range(n):
            here = states[at]
            if len(here) > 1:
                least: dict[str, tuple[str, int, int, int]] = {}
                for state in here:
                    if state[0] not in least or state[1] < least[state[0]][1]:
                        least[state[0]] = state
                here = states[at] = list(least.values())
            for k, (last, cost, _, _) in enumerate(here):
                near = apart.get(last)
                if near is None:
                    near = apart[last] = {}
                node, end = trie, at
                while end < n and (found := node.get(chars[end])):
                    end += 1
                    node, piece = found
                    if piece is not None:
                        fits = near.get(piece)
                        if fits is None:
                            fits = near[piece] = self.stay_apart(last, piece)
                        if fits:
                            states[end].append((piece, cost + 1, at, k))
                if chars[at] not in self.ids:
                    states[at + 1].append((chars[at], cost + len(self.written(chars[at])), at, k))
        out, at, k = [], n, min(range(len(states[n])), key=lambda i: states[n][i][1])
        while at:
            piece, _, before, k = states[at][k]
            out += self.run(at)[::-1] if before == 0 and at <= marks else [piece]
            at = before
        return out[::-1]

    def written(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        found = [self.byte_ids[b] for b in piece.encode()]
        return found if min(found) >= 0 else [self.unknown]

    def chunk(self, raw: bytes) -> bytes:
        """Ids (little-endian, 4 bytes each) of a chunk, whose spaces stand for marks."""
        found = self.known.get(raw)
        if found is None:
            found = self.older.get(raw)
            if found is None:
                numbers = [i for piece in self.path(raw.decode().replace(" ", MARK)) for i in self.written(piece)]
                found = struct.pack(f"<{len(numbers)}i", *numbers)
            if len(raw) <= LONGEST:
                if len(self.known) >= REMEMBER:
                    self.older, self.known = self.known, {}
                    if sum(map(len, self.apart.values())) > 4 * REMEMBER:
                        self.apart = {}
                self.known[raw] = found
        return found

    def normalized(self, texts: pa.Array) -> pa.Array:
        if self.normalizer.units or self.normalizer.joins:
            return pa.array([self.normalizer(x) for x in texts.to_pylist()], pa.large_string())
        return pc.replace_substring(texts, MARK, " ")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each has, whether they decode to the text)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        plain = self.normalized(texts)
        offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
        data = plain.buffers()[2]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        some = np.flatnonzero(np.diff(offsets))
        if self.normalizer.prefix:
            data = np.insert(data, offsets[some], 0x20)
            offsets = offsets + np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
        begins = np.ones(len(data), bool)
        begins[1:] = ~self.joined[data[:-1], data[1:]]
        begins[offsets[some]] = True
        begin = np.flatnonzero(begins)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(data)).astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).dictionary_encode()
        of, chunk = chunks.indices.to_numpy(), self.chunk
        written = [chunk(x) for x in chunks.dictionary.to_pylist()]
        n = np.array([len(x) // 4 for x in written], np.int64)
        ids = _gather(np.frombuffer(b"".join(written), "<i4"), np.cumsum(n) - n, n, of)
        counts = np.zeros(len(texts), np.int64)
        size = np.zeros(len(texts), np.int64)
        if len(begin):
            bytes_of = np.add.reduceat(self.sizes[ids], np.cumsum(n[of]) - n[of])
            first = np.searchsorted(begin, offsets[some])
            counts[some], size[some] = np.add.reduceat(n[of], first), np.add.reduceat(bytes_of, first)
        exact = (size == np.diff(offsets)) & pc.equal(plain, texts).to_numpy(zero_copy_only=False)
        out = _gather(self.flat, self.starts, self.sizes, ids)
        if len(out) != len(data) or not np.array_equal(out, data):
            ends = np.concatenate([[0], np.cumsum(size)])
            for i in np.flatnonzero(exact):
                exact[i] = np.array_equal(out[ends[i] : ends[i + 1]], data[offsets[i] : offsets[i + 1]])
        return ids, counts, exact

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes that the pieces stand for, without the space that the normaliser put before them."""
        out = _gather(self.flat, self.starts, self.sizes, ids).tobytes()
        return out[1:] if self.normalizer.prefix and out[:1] == b" " else out


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The parts of flat that `of` names, one after the other."""
    n = size[of]
    return flat[np.arange(int(n.sum())) + np.repeat(start[of] - np.cumsum(n) + n, n)]


_loaded: dict[bytes, Transducer] = {}


def transducer(raw: bytes) -> Transducer:
    """Compiled once in each worker."""
    if raw not in _loaded:
        _loaded[raw] = Transducer(raw)
    return _loaded[raw]


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """docs(doc_id, text) with token_ids array<int>, n_tokens long and exact boolean: whether decoding gives the text back.

    model is the path of a model file, which the driver reads and ships. Null and empty texts have no tokens and are
    exact. A text that the normaliser changes (one that holds the mark for spaces itself) decodes to its changed form, so
    it isn't exact; all others are. Null doc_ids and repeated rows give a row each; other columns are left out.
    """
    raw = Path(model).read_bytes()
    Transducer(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(raw)
        for batch in parts(batches):
            ids, counts, exact = t.encode(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(counts), pa.array(exact)], ["doc_id", "token_ids", "n_tokens", "exact"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, token_ids array<int>, n_tokens long, exact boolean")


def decoded(tokens: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of encoded(): the text that token_ids stand for; null ids give the empty text. Bytes that are no
    UTF-8 become the replacement character."""
    raw = Path(model).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(raw)
        for batch in batches:
            texts = [t.decode(np.array(x if x is not None else [], np.int64)).decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")
