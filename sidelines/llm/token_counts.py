"""Token counts that follow edits: a tree of sums over each text's pre-tokens, updated where an edit touches it."""

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidelines.llm.text import BYTES_AT_ONCE, parts

#: The public pattern that splits a text into pre-tokens before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_pre = regex.compile(PATTERN)
#: Pre-tokens in a leaf; pre-tokens that a task remembers.
LEAF, REMEMBER = 64, 1_000_000
#: Pre-tokens before an edit that are split anew with it: one may grow into it, and one ends by what follows it.
CONTEXT = 3


class Counter:
    """Tokens of a pre-token, remembered."""

    def __init__(self, raw: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        self.encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def __call__(self, pre: str) -> int:
        n = self.known.get(pre)
        if n is None:
            if len(self.known) >= REMEMBER:
                self.known.clear()
            n = self.known[pre] = len(self.encoding._encode_single_piece(pre.encode()))
        return n

    def of(self, pres: list[str]) -> list[int]:
        known = self.known
        return [known.get(p) or self(p) for p in pres]


class Tree:
    """A text's pre-tokens in leaves, with sums of characters and tokens over ever two nodes below."""

    def __init__(self, text: str, counter: Counter):
        self.counter = counter
        self.recounted = 0
        self._build(_pre.findall(text))

    @classmethod
    def load(cls, stored: list[dict], counter: Counter) -> "Tree":
        """The tree that dump() wrote; nothing is split or counted again."""
        tree = cls("", counter)
        tree.leaves = []
        for leaf in stored:
            ends = np.cumsum(leaf["lengths"]).tolist()
            tree.leaves.append(([leaf["text"][a:b] for a, b in zip([0, *ends], ends, strict=False)], list(leaf["counts"])))
        tree._sum()
        return tree

    def dump(self) -> list[dict]:
        return [{"text": "".join(pres), "lengths": [len(p) for p in pres], "counts": counts} for pres, counts in self.leaves if pres]

    def _build(self, pres: list[str]) -> None:
        counts = self.counter.of(pres)
        self.leaves = [(pres[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(pres), LEAF)]
        self._sum()

    def _sum(self) -> None:
        self.leaves = self.leaves or [([], [])]
        self.base = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = np.zeros((2 * self.base, 2), np.int64)
        for i, (p, c) in enumerate(self.leaves):
            self.sums[self.base + i] = sum(map(len, p)), sum(c)
        for at in range(self.base - 1, 0, -1):
            self.sums[at] = self.sums[2 * at] + self.sums[2 * at + 1]

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def characters(self) -> int:
        return int(self.sums[1, 0])

    def _find(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at a place, and where that leaf begins."""
        at, begin = 1, 0
        while at < self.base:
            at *= 2
            if place - begin >= self.sums[at, 0] and self.sums[at + 1, 0]:
                begin += int(self.sums[at, 0])
                at += 1
        return at - self.base, begin

    def _put(self, leaf: int, pres: list[str], counts: list[int]) -> None:
        self.leaves[leaf] = (pres, counts)
        at = self.base + leaf
        self.sums[at] = sum(map(len, pres)), sum(counts)
        while at > 1:
            at //= 2
            self.sums[at] = self.sums[2 * at] + self.sums[2 * at + 1]

    def edit(self, place: int, length: int, text: str = "") -> None:
        """Puts text in place of `length` characters. The pre-tokens it touches and CONTEXT before them are split again,
        and those after until a boundary falls where one was: from there on nothing changes."""
        place = min(max(place, 0), self.characters)
        stop = min(place + max(length, 0), self.characters)
        leaf, begin = self._find(max(place - 1, 0))
        pres = self.leaves[leaf][0]
        k, at = 0, begin
        while k < len(pres) and at + len(pres[k]) < place:
            at += len(pres[k])
            k += 1
        for _ in range(CONTEXT):
            if not k and leaf:
                leaf -= 1
                while leaf and not self.leaves[leaf][0]:
                    leaf -= 1
                k = len(self.leaves[leaf][0])
            if k:
                k -= 1
                at -= len(self.leaves[leaf][0][k])
        first, first_k, old_from = leaf, k, at
        gone: list[str] = []
        end = at
        ahead = 2
        while True:
            need = 0
            while (end < stop or need < ahead) and leaf < len(self.leaves):
                if k >= len(self.leaves[leaf][0]):
                    leaf, k = leaf + 1, 0
                    continue
                gone.append(self.leaves[leaf][0][k])
                need += end >= stop
                end += len(gone[-1])
                k += 1
            old = "".join(gone)
            new_text = old[: place - old_from] + text + old[stop - old_from :]
            new = _pre.findall(new_text)
            last = leaf >= len(self.leaves) or all(not x[0] for x in self.leaves[leaf + 1 :]) and k >= len(self.leaves[leaf][0])
            if last:
                break
            ends_old, total = {}, 0
            for i, p in enumerate(gone):
                total += len(p)
                if old_from + total >= stop:
                    ends_old[total - (stop - place) + len(text)] = i
            total, found = 0, None
            for j, p in enumerate(new[:-2]):
                total += len(p)
                if total in ends_old and old_from + total >= place + len(text):
                    found = (j, ends_old[total])
                    break
            if found:
                drop = len(gone) - found[1] - 1
                new = new[: found[0] + 1]
                for _ in range(drop):
                    while not k:
                        leaf -= 1
                        k = len(self.leaves[leaf][0])
                    k -= 1
                break
            ahead *= 2
        self.recounted += len(new)
        last_leaf = min(leaf, len(self.leaves) - 1)
        tail, tail_counts = ([], []) if leaf >= len(self.leaves) else (self.leaves[leaf][0][k:], self.leaves[leaf][1][k:])
        head, head_counts = self.leaves[first][0][:first_k], self.leaves[first][1][:first_k]
        counts = self.counter.of(new)
        if first == last_leaf:
            merged = (head + new + tail, head_counts + counts + tail_counts)
            self._put(first, *merged)
        else:
            self._put(first, head + new, head_counts + counts)
            for i in range(first + 1, last_leaf):
                self._put(i, [], [])
            self._put(last_leaf, tail, tail_counts)
        if len(self.leaves[first][0]) > 8 * LEAF:
            self._build([p for x in self.leaves for p in x[0]])

    def make(self, edits: list[dict | None] | None) -> None:
        for e in edits or []:
            if e is not None:
                self.edit(e["at"] or 0, e["length"] or 0, e["text"] or "")

    def text(self) -> str:
        return "".join(p for x in self.leaves for p in x[0])


_loaded: dict[bytes, Counter] = {}


def counter(raw: bytes) -> Counter:
    if raw not in _loaded:
        _loaded[raw] = Counter(raw)
    return _loaded[raw]


EDITS = "array<struct<at: int, length: int, text: string>>"


def repeated_line_edits(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with edits that take out each line with a word that equals an earlier one, last line first. Null and
    empty texts have none; null doc_ids and repeated rows give a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            edits = []
            for text in batch.column(1).to_pylist():
                seen, at, found = set(), 0, []
                for line in (text or "").split("\n"):
                    if line in seen:
                        found.append({"at": at, "length": len(line) + 1, "text": ""})
                    elif line.strip("\x20\x09\x0a\x0b\x0c\x0d"):
                        seen.add(line)
                    at += len(line) + 1
                edits.append(found[::-1])
            kind = pa.list_(pa.struct([("at", pa.int32()), ("length", pa.int32()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(edits, kind)], ["doc_id", "text", "edits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, text string, edits {EDITS}")


TREE = "array<struct<text: string, lengths: array<int>, counts: array<int>>>"
_TREE = pa.list_(pa.struct([("text", pa.string()), ("lengths", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]))


def counted_trees(docs: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, n_tokens, tree) of each row of docs(doc_id, text), to be kept in a table between rounds of edits: a tree's
    leaves hold their text, and characters and tokens of each pre-token. Null and empty texts have no leaf; null doc_ids
    and repeated rows give a row each; other columns are left out."""
    raw = Path(ranks).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(raw)
        for batch in parts(batches):
            trees = [Tree(text or "", count) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.tokens for t in trees], pa.int64()), pa.array([t.dump() for t in trees], _TREE)], ["doc_id", "n_tokens", "tree"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_tokens long, tree {TREE}")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about BYTES_AT_ONCE, as their batch's mean row has it."""
    for batch in batches:
        rows = max(1, batch.num_rows * BYTES_AT_ONCE // max(batch.nbytes, 1))
        yield from (batch.slice(a, rows) for a in range(0, batch.num_rows, rows))


def edited_trees(trees: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, n_tokens, n_recounted, tree) of each row of trees(doc_id, tree, edits) after its edits, which are as in
    token_counts(): only what they touch is split and counted again. Null trees are empty texts, null edits none."""
    raw = Path(ranks).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(raw)
        for batch in slices(batches):
            done = []
            for stored, edits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                done.append(Tree.load(stored or [], count))
                done[-1].make(edits)
            columns = [pa.array([t.tokens for t in done], pa.int64()), pa.array([t.recounted for t in done], pa.int64()), pa.array([t.dump() for t in done], _TREE)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "n_recounted", "tree"])

    rows = trees.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("tree").cast(TREE).alias("tree"), F.col("edits").cast(EDITS).alias("edits"))
    return rows.mapInArrow(run, f"doc_id long, n_tokens long, n_recounted long, tree {TREE}")


def token_counts(docs: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_edited, n_recounted) of each row of docs(doc_id, text, edits).

    ranks is the path of a rank file, which the driver reads and ships. Edits (at, length, text; characters of the text
    as it then is) are made one after another; places outside a text move to its ends, null places and lengths are 0, null texts
    empty and null edits nothing. n_recounted: pre-tokens that were split and counted again. Null texts are empty, null edits none; null
    doc_ids and repeated rows give a row each; other columns are left out.
    """
    raw = Path(ranks).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(raw)
        for batch in parts(batches):
            out: list[list[int]] = [[], [], [], []]
            for text, edits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tree = Tree(text or "", count)
                before = tree.tokens
                tree.make(edits)
                for column, value in zip(out, (before, len(edits or []), tree.tokens, tree.recounted), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out)], ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_recounted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("edits").cast(EDITS).alias("edits"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_recounted long")
