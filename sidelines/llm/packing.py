"""Best-fit packing: a plan over the lengths of the whole corpus, and each piece's place in it."""

import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from tokenizers import Tokenizer

from sidelines.llm.common import cut
from sidelines.llm.text import distinct, parts, ragged
from sidelines.llm.token_counts import PATTERN

#: Chunks that a task remembers.
REMEMBER = 400_000
#: Bytes that send a chunk through the model itself: those beyond U+00FF or below U+00C0 of the Latin-1 half, and `<`.
_SLOW = re.compile(rb"[<\x80-\xC2\xC4-\xFF](?<!\xC3[\x80-\xBF])")
_all = np.arange(256)
_SPACE = (_all == 0x20) | ((_all >= 0x09) & (_all <= 0x0D))
_SIGN = (_all > 0x20) & (_all < 0x7F)
_ALNUM = np.array([chr(c).isalnum() and c < 128 for c in range(256)])
#: Signs before which a run of letters or digits may be cut: `|` is left out, as special tokens hold it after letters.
_STOP = _SIGN & ~_ALNUM & (_all != ord("|"))


def _cuts(data: np.ndarray) -> np.ndarray:
    """Places in valid UTF-8 where a pre-token of the public byte-level patterns begins whatever stands around them: before
    white space after a visible character, before a sign after a letter or digit, and after a single line break.

    The patterns look ahead from white space alone, and no chunk between such places ends in white space that others follow.
    Beyond ASCII, characters of two bytes from U+00C0 on and of three bytes in the ideographs and Hangul are known to be visible, and
    letters are known from U+00C0 to U+00FF."""
    if len(data) < 2:
        return np.zeros(0, np.int64)
    back = lambda n: np.concatenate([np.zeros(n, np.uint8), data[:-n]]) if len(data) > n else np.zeros(len(data), np.uint8)
    one, two, three, four = back(1), back(2), back(3), back(4)
    inside = (one >= 0x80) & (one < 0xC0)
    latin = inside & (two == 0xC3) & (one != 0x97) & (one != 0xB7)
    visible = _SIGN[one] | inside & ((two >= 0xC3) & (two <= 0xDF) | (three >= 0xE4) & (three <= 0xED) | (four >= 0xF0))
    before_space = _SPACE[data] & visible
    before_sign = _STOP[data] & (_ALNUM[one] | latin)
    after_break = (one == 0x0A) & _SIGN[data] & np.concatenate([[False], before_space[:-1]])
    return np.flatnonzero(before_space | before_sign | after_break)


def _byte_signs() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters for themselves, the
    others in order from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


def _ranks(model: str) -> dict[bytes, int] | None:
    """Ids of a byte-level model as ranks of merges; None for a model whose merges are not in order of their ids, or that does
    more than split by the public pattern and merge."""
    parts = json.loads(model)
    kind, split = parts["model"], parts.get("pre_tokenizer") or {}
    plain = kind.get("type") == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    if not plain or parts.get("normalizer") or kind.get("dropout") or kind.get("continuing_subword_prefix") or kind.get("end_of_word_suffix"):
        return None
    merged = [kind["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in kind["merges"]]
    sign, special = _byte_signs(), {t["content"] for t in parts.get("added_tokens") or []}
    if any(b <= a for a, b in zip(merged, merged[1:])):
        return None
    return {bytes(sign[c] for c in token): i for token, i in kind["vocab"].items() if token not in special}


class Encoder:
    """Ids of many texts: the different chunks of a batch are encoded once and remembered.

    A text is cut at places where a pre-token begins in any case (`_cuts`), so the chunks' ids are those of the whole text.
    Chunks of ASCII and U+00C0 to U+00FF, on whose classes of characters all libraries agree, go through the quicker merger of
    the model's ranks where it has such; all others, and any with a special token's sign `<`, through the model itself."""

    def __init__(self, model: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(model)
        ranks = _ranks(model)
        self.quick = ranks and tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = end
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.store, self.starts, self.counts = np.array([self.end], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)

    def _learn(self, chunks: list[bytes]) -> None:
        texts = [c.decode(errors="replace") for c in chunks]
        quick = [bool(self.quick) and not _SLOW.search(c) for c in chunks]
        slow = iter(self.tokenizer.encode_batch_fast([t for t, q in zip(texts, quick, strict=True) if not q], add_special_tokens=False))
        ids = [self.quick.encode_ordinary(t) if q else next(slow).ids for t, q in zip(texts, quick, strict=True)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts = np.concatenate([self.starts, len(self.store) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.store = np.concatenate([self.store, np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum()))])

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with the end's id after each, where each text's ids begin and the last one's end)."""
        if len(self.known) > REMEMBER:
            self.clear()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        begin = np.zeros(len(data) + 5, bool)
        begin[_cuts(data)] = True
        for k in range(5):  # what stands in the text before says nothing
            begin[np.minimum(offsets + k, len(data) + 4)] = False
        begin[offsets] = True
        begins = np.flatnonzero(begin[: len(data)])
        place, chunks = distinct(np.append(begins, len(data)), data)
        chunks = chunks.to_pylist()
        new = [c for c in chunks if c not in self.known]
        self.known |= zip(new, range(len(self.starts), len(self.starts) + len(new)), strict=True)
        self._learn(new)
        own = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))[place]
        ends = np.searchsorted(begins, offsets[1:])
        which = np.insert(own, ends, 0)
        counts = self.counts[which]
        ids = self.store[ragged(self.starts[which], counts)]
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.concatenate([[0], total[ends + np.arange(1, len(ends) + 1)]])


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids) of docs(doc_id, text): each text's ids with the end's id, cut into pieces of
    `capacity` where they are more; the first piece is the shorter one. ids: little-endian unsigned 32-bit ids.

    tokenizer is the path of a byte-level model, which the driver reads and ships; strings of its special tokens in a text
    become those. Null texts are empty and have the end's id alone; null doc_ids and repeated rows give pieces of their
    own; other columns are left out.
    """
    model = Path(tokenizer).read_text()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, end)
        for batch in parts(batches):
            ids, first = encoder(batch.column(1))
            n = np.diff(first)
            pieces = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            short = n - capacity * (pieces - 1)
            start = np.where(piece == 0, 0, short[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, short[doc], capacity)
            places = np.append((first[doc] + start) * 4, len(ids) * 4).astype(np.int64)
            data = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
            columns = [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)), data.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def plan(counts: np.ndarray) -> np.ndarray:
    """Best-fit-decreasing bins for counts[s] pieces of each length s up to the capacity, len(counts) - 1.

    Rows (size, first, per_bin, sequence, offset) in order of size and first: the pieces of a size from rank `first` on lie
    per_bin to a bin, in bins numbered from `sequence`, from `offset` on. Lengths over a third of the capacity are matched
    in pairs at most, the largest with the largest that fits; smaller ones go where the least gap is left that takes them.
    Bins with equal contents are one group with a count, so that time and rows depend on the lengths, not on the pieces.
    """
    counts = [int(c) for c in counts]
    capacity = len(counts) - 1
    groups: list[list] = []  # [bins, gap, [(size, how many in a bin)]]
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(bins: int, contents: list[tuple[int, int]]) -> None:
        gap = capacity - sum(s * k for s, k in contents)
        if bins:
            by_gap[gap].append(len(groups))
            groups.append([bins, gap, contents])

    third = capacity // 3
    for a in range(capacity, third, -1):
        b = min(a, capacity - a)
        while counts[a]:
            while b > third and not counts[b]:
                b -= 1
            if b <= third:
                add(counts[a], [(a, 1)])
                counts[a] = 0
            elif b == a:
                add(counts[a] // 2, [(a, 2)])
                counts[a] %= 2
                b -= 1
            else:
                n = min(counts[a], counts[b])
                add(n, [(a, 1), (b, 1)])
                counts[a] -= n
                counts[b] -= n
    for s in range(third, 0, -1):
        n = counts[s]
        for gap in range(s, capacity + 1):
            while n and by_gap[gap]:
                group = groups[i := by_gap[gap].pop()]
                k = min(n, gap // s)
                bins = min(group[0], n // k)
                n -= bins * k
                left = group[0] - bins
                group[0], group[1] = bins, gap - k * s
                by_gap[group[1]].append(i)
                if left:
                    by_gap[gap].append(len(groups))
                    groups.append([left, gap, list(group[2])])
                group[2] = [*group[2], (s, k)]
            if not n:
                break
        k = capacity // s
        add(n // k, [(s, k)])
        add(int(n % k > 0), [(s, n % k)])
    used, sequence, out = [0] * (capacity + 1), 0, []
    for bins, _, contents in groups:
        offset = 0
        for s, k in contents:
            out.append((s, used[s], k, sequence, offset))
            used[s] += bins * k
            offset += s * k
        sequence += bins
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def best_fit(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """pieces(length, ...) with sequence_id and offset: rows packed into as few sequences of `capacity` as best fit decreasing
    finds. Rows of a length that is null, below 1 or over the capacity belong to no sequence (null).

    The driver plans over the count of each length alone, of which there are `capacity` at most. A row's place in the plan
    is its rank among the rows of its length: its number in its task, written with it, and the sum of the tasks before.
    """
    fields = [*pieces.schema.fields, StructField("_task", IntegerType()), StructField("_number", LongType())]
    at = pieces.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            sizes = pc.fill_null(batch.column(at), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.where((sizes < 1) | (sizes > capacity), 0, sizes)
            order = np.argsort(sizes, kind="stable")
            found = np.bincount(sizes, minlength=capacity + 1)
            number = np.zeros(len(sizes), np.int64)
            number[order] = ragged(seen, found)
            seen += found
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(sizes), task, np.int32)), pa.array(number)], [f.name for f in fields])

    numbered = cut(pieces.mapInArrow(run, StructType(fields)), "pieces")
    known = numbered.where(F.col("length").between(1, capacity)).groupBy("length", "_task").agg(F.count("*").alias("_rows"))
    known = cut(known, "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in known.groupBy("length").agg(F.sum("_rows")).collect():
        counts[length] = n
    slots = plan(counts)
    keys = slots[:, 0] << 44 | slots[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(), rank.to_numpy()
        fine = ~(np.isnan(length.astype(float)) | np.isnan(rank.astype(float)))
        size, rank = np.where(fine, length, 0).astype(np.int64), np.where(fine, rank, 0).astype(np.int64)
        slot = slots[np.maximum(np.searchsorted(keys, size << 44 | rank, "right") - 1, 0)] if len(slots) else np.ones((len(size), 5), np.int64)
        inside = rank - slot[:, 1]
        per = np.maximum(slot[:, 2], 1)
        out = pd.DataFrame({"sequence_id": slot[:, 3] + inside // per, "offset": slot[:, 4] + inside % per * size})
        out = out.astype("Int64")
        out.loc[~fine] = pd.NA
        return out

    before = F.sum("_rows").over(Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    starts = known.select("length", "_task", F.coalesce(before, F.lit(0)).alias("_before"))
    rows = numbered.join(starts, ["length", "_task"], "left").withColumn("_place", place(F.col("length").cast("long"), F.col("_before") + F.col("_number")))
    return rows.select(*pieces.columns, "_place.sequence_id", "_place.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, lengths) of packed(sequence_id, offset, length, ids): each sequence's ids, little-endian unsigned
    32-bit, and its pieces' lengths in order. Rows of no sequence are left out."""
    rows = packed.where("sequence_id is not null").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    return rows.select("sequence_id", F.expr("aggregate(p.ids, cast('' as binary), (a, x) -> concat(a, x))").alias("ids"), F.col("p.length").alias("lengths"))
