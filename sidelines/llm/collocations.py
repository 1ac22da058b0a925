"""Phrase collocations: phrases counted in HAT-tries, level by level, and scored by their worst cut."""

from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sidelines.llm.common import cut
from sidelines.llm.text import BYTES_AT_ONCE, Words, distinct, mix, parts, runs_hash

_all = np.arange(256)
_SPLIT = np.isin(_all, [ord(c) for c in ".,;:!?"]) | ((_all >= 0x0A) & (_all <= 0x0D))
_WORD = ~(_SPLIT | (_all == 0x20) | (_all == 0x09))
#: Bits of a word id within a task, and of those that tell apart the first words of one container.
ID_BITS, GROUP_BITS = 19, 6
#: Entries of a container before it bursts; entries of a task's trie before subtrees are spilled; those that a container costs.
BURST, MOST_ENTRIES, CONTAINER = 4096, 400_000, 4
#: Slots of the table that tells which phrases can't be frequent: 2 ** 27 bits, 16 MiB at any size of the corpus.
SLOT_BITS = 27
ROWS_AT_ONCE = 1 << 16
#: Phrases of a slice that are counted at once: their words fit into the ids.
WORDS_AT_ONCE = 1 << 18
COUNTED = "lang string, phrase string, n long"


class Node(dict):
    """A burst container: the next field of the key -> container or node below."""


class HatTrie:
    """Counts of phrases of `length` word ids. First words lead, 2 ** GROUP_BITS to one, to a container: a hash table from a
    key, in which what tells those words apart and the ids of the words after it are packed, to a count. A container of over
    `burst` entries bursts into a node, first by first word and then by the words after it."""

    def __init__(self, length: int, bits: int = ID_BITS, burst: int = BURST):
        self.bits, self.burst = bits, burst
        #: What is left of a key below a node of each depth, in bits.
        self.below = [bits * n for n in range(length - 1, 0, -1)]
        self.roots: dict[int, dict] = {}
        self.entries = 0

    def add(self, first: np.ndarray, rest: np.ndarray, counts: np.ndarray) -> None:
        """Phrases, each once: the first word's id, the others' packed ids, and how often."""
        root = first >> GROUP_BITS
        order = np.argsort(root, kind="stable")
        root, counts = root[order], counts[order].tolist()
        keys = ((first & (1 << GROUP_BITS) - 1) << self.below[0] | rest)[order].tolist()
        starts = np.flatnonzero(np.diff(root, prepend=-1)).tolist()
        for at, a, b in zip(root[starts].tolist(), starts, [*starts[1:], len(keys)], strict=True):
            box = self.roots.get(at)
            if box is None:
                box = self._new(self.roots, at)
            if self._put(box, keys[a:b], counts[a:b], 0):
                self.roots[at] = self._burst(box, 0)

    def _new(self, parent: dict, at: int) -> dict:
        self.entries += CONTAINER
        box = parent[at] = {}
        return box

    def _put(self, at: dict, keys: list[int], counts: list[int], depth: int) -> bool:
        """Whether the container is now to burst."""
        if type(at) is not Node:
            before = len(at)
            for key, n in zip(keys, counts, strict=True):
                at[key] = at.get(key, 0) + n
            self.entries += len(at) - before
            return len(at) > self.burst and depth < len(self.below)
        low = self.below[depth]
        for key, n in zip(keys, counts, strict=True):
            field = key >> low
            box = at.get(field)
            if box is None:
                box = self._new(at, field)
            if self._put(box, [key & ((1 << low) - 1)], [n], depth + 1):
                at[field] = self._burst(box, depth + 1)
        return False

    def _burst(self, box: dict, depth: int) -> Node:
        low, node = self.below[depth], Node()
        for key, n in box.items():
            node.setdefault(key >> low, {})[key & ((1 << low) - 1)] = n
        self.entries += CONTAINER * len(node)
        return node

    def _containers(self, at: dict, depth: int, before: int = 0) -> Iterator[tuple[int, dict]]:
        if type(at) is not Node:
            yield before, at
            return
        for field, box in at.items():
            yield from self._containers(box, depth + 1, before | field << self.below[depth])

    def _size(self, at: dict) -> int:
        return CONTAINER + (sum(map(self._size, at.values())) if type(at) is Node else len(at))

    def spill(self, down_to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes out whole subtrees, the largest first, until at most `down_to` entries are left: first words, packed ids of the
        others, counts."""
        out: list[tuple[int, int, dict]] = []
        for size, root in sorted(((self._size(at), root) for root, at in self.roots.items()), reverse=True):
            if self.entries <= down_to:
                break
            out += [(root, before, box) for before, box in self._containers(self.roots.pop(root), 0)]
            self.entries -= size
        lengths = [len(box) for _, _, box in out]
        root, before = (np.repeat(np.array([x[i] for x in out], np.int64), lengths) for i in (0, 1))
        keys, counts = (np.fromiter(chain.from_iterable(part), np.int64, sum(lengths)) for part in ((box for _, _, box in out), (box.values() for _, _, box in out)))
        keys |= before
        low = self.below[0]
        return root << GROUP_BITS | keys >> low, keys & (1 << low) - 1, counts


class Vocabulary:
    """Ids of a task's words, one for each language that a word stands in."""

    def __init__(self):
        self.ids: dict[str, dict[bytes, int]] = {}
        self.words: list[bytes] = []
        self.langs: list[str] = []

    def of(self, lang: str, words: list[bytes]) -> list[int]:
        ids, out = self.ids.setdefault(lang, {}), []
        for word in words:
            at = ids.get(word)
            if at is None:
                at = ids[word] = len(self.words)
                self.words.append(word)
                self.langs.append(lang)
            out.append(at)
        return out


class Batch:
    """The words of some texts with their languages, and which follow each other in one piece."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        self.w = w = Words(texts, _WORD, lower=True)
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        self.lang = coded.indices.to_numpy().astype(np.int64)[w.doc] if len(w) else np.zeros(0, np.int64)
        breaks = np.concatenate([[0], np.cumsum(_SPLIT[w.data], dtype=np.int64)])
        follows = (breaks[w.start[1:]] == breaks[w.end[:-1]]) & (w.doc[1:] == w.doc[:-1])
        #: How many words follow in the same piece, the word itself included, up to four.
        self.left = np.ones(len(w), np.int64)
        for k in range(1, 4):
            whole = np.zeros(len(w), bool)
            whole[: max(0, len(w) - k)] = np.logical_and.reduce([follows[j : len(follows) - k + 1 + j] for j in range(k)]) if len(w) > k else False
            self.left += whole

    def hashes(self) -> np.ndarray:
        own = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs] or [0], np.uint64)
        return mix(self.w.hashes() ^ own[self.lang])

    def ids(self, needed: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """(code of each needed word in this batch, id of each code)."""
        place, words = distinct(np.concatenate([[0], np.cumsum(self.w.length)]), self.w.data[self.w.inside])
        both = place * len(self.langs) + self.lang
        there = np.zeros(len(words) * len(self.langs), bool)
        there[both[needed]] = True
        found = np.flatnonzero(there)
        code = np.zeros(len(there), np.int64)
        code[found] = np.arange(len(found))
        ids = np.zeros(len(found), np.int64)
        for k, lang in enumerate(self.langs):
            mine = np.flatnonzero(found % len(self.langs) == k)
            ids[mine] = vocabulary.of(lang, words.take(pa.array(found[mine] // len(self.langs))).to_pylist())
        return code[both], ids


def _slot(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams >> np.uint64(64 - bits)).astype(np.int64)


def _marked(table: np.ndarray, grams: np.ndarray) -> np.ndarray:
    slot = _slot(grams, len(table).bit_length() + 5)
    return (table[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1


def slots(phrases: DataFrame, length: int) -> np.ndarray:
    """The table of slots of phrases(lang, phrase) of `length` words: a bit for each slot that one of them has."""
    size = SLOT_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = Batch(batch.column(0), batch.column(1))
            slot = _slot(runs_hash(b.hashes(), b.w.first[:-1], length), size)
            yield pa.RecordBatch.from_arrays([pa.array((slot >> 6).astype(np.int32)), pa.array((np.uint64(1) << (slot & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])

    marked = phrases.select("lang", "phrase").mapInArrow(run, "word int, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    table = np.zeros(1 << (size - 6), np.uint64)
    table[marked.column("word").to_numpy()] = marked.column("bits").to_numpy().view(np.uint64)
    return table


def _phrases(code: np.ndarray, at: np.ndarray, length: int, n_codes: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the phrases that begin at the given words: where each different one first stands, and how often it does."""
    key, span = code[at].astype(np.uint64), n_codes
    for j in range(1, length):
        if span * n_codes > 1 << 64:
            key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
            span = len(key)
        key, span = key * np.uint64(n_codes) + code[at + j].astype(np.uint64), span * n_codes
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    return at[first], counts


def count_phrases(docs: DataFrame, length: int, table: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, n) of docs(lang, text): how often each phrase of `length` words stands in a piece of text. With
    `table` only phrases count whose two parts of length - 1 words have a slot there.

    A task counts in a HAT-trie over its words' ids and spills whole subtrees as sorted runs when the trie or the
    vocabulary is full; the runs are merged by phrase. A prefix may be hot, so its runs are spread by whole phrases.
    """
    bits, burst, most, at_once = ID_BITS, BURST, MOST_ENTRIES, WORDS_AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, trie, single = Vocabulary(), HatTrie(max(length, 2), bits, burst), np.zeros(0, np.int64)

        def rows(first: np.ndarray, rest: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            """A sorted run, word by word."""
            raw, langs = pa.array(vocabulary.words, pa.binary()), pa.array(vocabulary.langs, pa.string())
            words = pa.StringArray.from_buffers(len(raw), *raw.buffers()[1:])
            rank = np.zeros(len(words), np.int64)
            rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
            ids = [first, *(rest >> bits * j & (1 << bits) - 1 for j in range(length - 2, -1, -1))]
            order = np.lexsort([rank[x] for x in reversed(ids)])
            for a in range(0, len(order), ROWS_AT_ONCE):
                part = order[a : a + ROWS_AT_ONCE]
                phrases = pc.binary_join_element_wise(*(words.take(pa.array(x[part])) for x in ids), " ")
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(first[part])), phrases, pa.array(counts[part])], ["lang", "phrase", "n"])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal vocabulary, trie, single
            found = np.flatnonzero(single)
            yield from rows(found, np.zeros(len(found), np.int64), single[found]) if length == 1 else rows(*trie.spill(0))
            vocabulary, trie, single = Vocabulary(), HatTrie(max(length, 2), bits, burst), np.zeros(0, np.int64)

        for batch in parts(batches, most=BYTES_AT_ONCE // 3):
            b = Batch(batch.column(0), batch.column(1))
            at = np.flatnonzero(b.left >= length)
            if table is not None and len(at):
                part = np.flatnonzero(b.left >= length - 1)
                fine = np.zeros(len(b.w) + 1, bool)
                fine[part] = _marked(table, runs_hash(b.hashes(), part, length - 1))
                at = at[fine[at] & fine[at + 1]]
            for part in np.split(at, range(at_once, len(at), at_once)):
                if not len(part):
                    continue
                if len(vocabulary.words) + len(part) + length > 1 << bits:
                    yield from flush()
                needed = np.zeros(len(b.w), bool)
                for j in range(length):
                    needed[part + j] = True
                code, ids = b.ids(np.flatnonzero(needed), vocabulary)
                if length == 1:
                    single = np.concatenate([single, np.zeros(len(vocabulary.words) - len(single), np.int64)])
                    single[ids] += np.bincount(code[part], minlength=len(ids))
                    continue
                first, counts = _phrases(code, part, length, len(ids))
                rest = np.zeros(len(first), np.int64)
                for j in range(1, length):
                    rest = rest << bits | ids[code[first + j]]
                trie.add(ids[code[first]], rest, counts)
                if trie.entries > most:
                    yield from rows(*trie.spill(most // 4))
        yield from flush()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, COUNTED).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _cuts(phrases: DataFrame, length: int) -> DataFrame:
    """A row for each cut of each phrase, with both parts."""
    words = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    each = [F.struct(F.lit(k).alias("k"), part(1, k).alias("left"), part(k + 1, length - k).alias("right")) for k in range(1, length)]
    return phrases.withColumn("c", F.explode(F.array(*each))).select("lang", "phrase", "a", "c.*")


def _inner(phrases: DataFrame, length: int) -> DataFrame:
    """(lang, phrase, longer): a row for each shorter phrase inside each."""
    words = F.split("phrase", " ")
    each = [F.array_join(F.slice(words, i, n), " ") for n in range(2, length) for i in range(1, length - n + 2)]
    return phrases.select("lang", F.explode(F.array(*each)).alias("phrase"), F.col("a").alias("longer"))


def collocations(docs: DataFrame, least: int = 30, most: int = 2000, longest: int = 4, covered_pct: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of docs(lang, text): each language's first `most` phrases of 2 to `longest`
    words that stand at least `least` times, by score, count and phrase.

    Only A-Z are lower-cased; texts fall into pieces at .,;:!? and line breaks, pieces into words at spaces and tabs. n is
    the number of the language's words. A phrase cut in two of counts l and r scores floor(2000000 * a / (l + r)), by its
    worst cut, of equal ones the first. Phrases inside a longer one that stands at least covered_pct % as often go.

    Phrases are counted length by length, as a frequent one has frequent parts only: a table of slots of the last length's
    frequent phrases, of a fixed size, keeps out those that can't be frequent; what it lets through wrongly is counted and
    then falls to `least`. Each length is written once and cuts lineage. Null languages are `und`, null texts empty;
    repeated rows count again, doc_id and other columns are left out; empty tables give no rows.
    """
    counted = cut(count_phrases(docs, 1), "words")
    total = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    levels = [counted.where(F.col("n") >= least).select("lang", "phrase", F.col("n").alias("a"))]
    for length in range(2, longest + 1):
        found = count_phrases(docs, length, slots(levels[-1], length - 1)).where(F.col("n") >= least)
        levels.append(cut(found.select("lang", "phrase", F.col("n").alias("a")), f"phrases{length}"))
    known, cuts, inner, listed = levels[0], None, None, None
    for length, level in enumerate(levels[1:], 2):
        known = known.unionByName(level) if length < longest else known
        listed = level if listed is None else listed.unionByName(level)
        cuts = _cuts(level, length) if cuts is None else cuts.unionByName(_cuts(level, length))
        if length > 2:
            inner = _inner(level, length) if inner is None else inner.unionByName(_inner(level, length))
    if inner is not None:
        over = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        listed = listed.join(over, ["lang", "phrase"], "left").where(f"longer is null or longer * 100 < a * {int(covered_pct)}")
    side = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    scored = cuts.join(listed.select("lang", "phrase"), ["lang", "phrase"], "left_semi").join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    scored = scored.withColumn("score", F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + r)"))
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("c")).select("lang", "phrase", "c.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    spread = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    first = worst.withColumn("place", F.row_number().over(spread)).where(F.col("place") <= most)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return first.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
