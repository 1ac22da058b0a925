"""Repeated passages: an FM-index over the passages of each shard, searched backward for windows of many words."""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidelines.llm.common import cut, text_key
from sidelines.llm.text import Words, first_least, mix, parts, runs_hash

#: Words in one index, at most about, and different passages around one anchor beyond which they are cut.
SHARD_WORDS, MOST = 1 << 16, 1000
#: Bytes of text that a task takes at once: small slices keep a worker's arrays small.
SLICE = 1 << 20
#: Slots in which a task looks up anchors with too many passages; a power of two.
SLOTS = 1 << 22


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of s in order, by prefix doubling."""
    rank, span = s.astype(np.int64), 1
    while True:
        after = np.zeros(len(s), np.int64)
        after[: len(s) - span] = rank[span:] + 1
        key = rank * (int(after.max()) + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(len(s), np.int64)
        new[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
        rank, span = new, 2 * span
        if rank.max() == len(s) - 1 or span >= len(s):
            return order


class FMIndex:
    """Sequences of symbols 1 and up, each with a 0 after it: their Burrows-Wheeler transform in a wavelet matrix of packed
    bits with counts per 64, and how many symbols are below each. Neither the text nor suffix positions are kept."""

    def __init__(self, text: np.ndarray):
        row = text[suffix_array(text) - 1]
        symbols = int(text.max()) + 1 if len(text) else 1
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.levels = []
        for k in range(max(1, (symbols - 1).bit_length()) - 1, -1, -1):
            bits = (row >> k & 1).astype(bool)
            packed = np.zeros((len(row) // 64 + 1) * 8, np.uint8)
            packed[: (len(row) + 7) // 8] = np.packbits(bits, bitorder="little")
            packed = packed.view("<u8")
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int32))]).astype(np.int32)
            self.levels.append((k, packed, ones, int(len(row) - bits.sum())))
            row = np.concatenate([row[~bits], row[bits]])
        self.base = self._descend(np.arange(symbols), np.zeros(symbols, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, packed, ones, zeros in self.levels:
            one = ones[at >> 6] + np.bitwise_count(packed[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> k & 1, zeros + one, at - one)
        return at

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of suffixes that begin with symbol and go on as those in lo to hi."""
        both = self._descend(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])).astype(np.int64)
        shift = self.below[symbol] - self.base[symbol]
        return both[: len(lo)] + shift, both[len(lo) :] + shift

    def matches(self, text: np.ndarray, end: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of a text that is in the index itself: for each position of `end` the length, `most` at most,
        of the longest match that ends there and occurs more than once, and where the interval of that match begins."""
        length, first = np.zeros(len(end), np.int64), np.zeros(len(end), np.int64)
        live = np.arange(len(end))
        lo, hi = self.below[text[end]], self.below[text[end] + 1]
        for step in range(1, most + 1):
            some = hi - lo > 1
            live, lo, hi = live[some], lo[some], hi[some]
            length[live], first[live] = step, lo
            if step == most or not len(live):
                break
            symbol = text[end[live] - step]
            inside = symbol > 0
            live, lo, hi = live[inside], lo[inside], hi[inside]
            lo, hi = self.extend(symbol[inside], lo, hi)
        return length, first


def _cores(words: np.ndarray, least: np.ndarray, at: np.ndarray, n: np.ndarray, level: int, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(run, begin, length, anchor) of the windows of runs (n windows from word `at` on, with one least gram at least[at])
    in runs as long or shorter.

    The places that the least gram can have in a window are cut into 2 ** level ranges. All windows with the gram in one
    range share a core of words around it, which is their anchor: the gram alone at level 0, the whole window where a
    range is one place. Equal windows have equal cores."""
    places = window - gram + 1
    row = np.repeat(np.arange(len(n)), n)
    each = at[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    place = least[each] - each
    part = (place << level) // places
    new = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (row[1:] != row[:-1])])) if len(row) else row
    row, each, place, part, length = row[new], each[new], place[new], part[new], np.diff(np.append(new, len(row)))
    low, high = -(-part * places >> level), -(-(part + 1) * places >> level) - 1
    core = runs_hash(words, each + place - low, window - (high - low), seed=3)
    return row, each, length, mix(core + part.astype(np.uint64))


def passages(docs: DataFrame, window: int = 50, gram: int = 8, cuts: tuple[tuple[int, np.ndarray], ...] = ()) -> DataFrame:
    """Windows of each document, in runs: consecutive windows whose least gram is the same one and whose anchor is too.

    Equal windows have equal anchors at equal places, wherever they stand; unit names a run's words. docs(doc_id, key, text).
    cuts are pairs (level, slots): runs whose anchor has its slot set go on to that level, the others are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, most=SLICE):
            w = Words(batch.column(2))
            whole = np.flatnonzero(w.left() >= window)
            if not len(whole):
                continue
            words = w.hashes()
            least = first_least(runs_hash(words, np.arange(len(words) - gram + 1), gram), window - gram + 1)
            best = least[whole]
            new = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (whole[1:] != whole[:-1] + 1)]))
            at, n = whole[new], np.diff(np.append(new, len(whole)))
            _, at, n, anchor = _cores(words, least, at, n, 0, window, gram)
            for level, slots in cuts:
                hot = slots[(anchor & np.uint64(SLOTS - 1)).astype(np.int64)]
                _, at, n, anchor = _cores(words, least, at[hot], n[hot], level, window, gram)
            unit = runs_hash(words, at, n + window - 1, seed=1)
            doc = w.doc[at]
            ids = [batch.column(i).to_numpy()[doc] for i in range(2)]
            columns = (anchor.view(np.int64), unit.view(np.int64), *ids, (at - w.first[doc]).astype(np.int32), n.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor", "unit", "doc_id", "key", "start", "n"])

    return docs.mapInArrow(run, "anchor long, unit long, doc_id long, key long, start int, n int")


def _slots(anchors: DataFrame) -> np.ndarray | None:
    """Which slots the anchors have, however many there are; none without any. An anchor that shares a slot with one of
    these only has its windows searched twice."""
    taken = anchors.select(F.col("anchor").bitwiseAND(SLOTS - 1).cast("int").alias("slot")).distinct().toPandas()["slot"].to_numpy()
    out = np.zeros(SLOTS, bool)
    out[taken] = True
    return out if len(taken) else None


def _fetch(docs: DataFrame, units: DataFrame, window: int) -> DataFrame:
    """The words of each unit, read from its first document."""
    need = units.groupBy("doc_id", "key").agg(F.collect_list(F.struct("anchor", "unit", "start", "n")).alias("units"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, most=SLICE):
            w = Words(batch.column(1))
            text, begin, end = w.joined()
            listed = batch.column(2)
            flat = listed.flatten()
            doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(listed).to_numpy())
            start, n = (flat.field(i).to_numpy() for i in (2, 3))
            at = w.first[doc] + start
            words = [text[a:b] for a, b in zip(begin[at].tolist(), end[at + n + window - 2].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([flat.field(0), flat.field(1), pa.array(batch.column(0).to_numpy()[doc]), pa.array(words, pa.binary())], ["anchor", "unit", "doc_id", "words"])

    return docs.join(need, ["doc_id", "key"]).select("doc_id", "text", "units").mapInArrow(run, "anchor long, unit long, doc_id long, words binary")


def _numbered(passages: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of passages as numbers from 1 on, one 0 after each passage, and where each begins. Equal numbers are
    equal words: they are places in a dictionary of the words themselves."""
    w = Words(pa.array(passages, pa.binary()))
    ends = np.concatenate([[0], np.cumsum(w.length)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(w), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(w.data[w.inside].tobytes())])
    bounds = w.first + np.arange(len(passages) + 1)
    text = np.zeros(bounds[-1], np.int64)
    text[np.arange(len(w)) + w.doc] = words.dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    return text, bounds


def _search(units: DataFrame, window: int) -> DataFrame:
    """For each unit, the least doc_id of each of its windows among all units of its anchor. Rows come ordered by anchor;
    a shard is a run of anchors with about SHARD_WORDS words, whose passages are streamed through its index: windows that
    reach the threshold and have one interval are the same words."""

    def answer(rows: list[tuple]) -> pa.RecordBatch:
        anchor, unit, doc = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        text, bounds = _numbered([r[3] for r in rows])
        n = np.diff(bounds) - window
        row = np.repeat(np.arange(len(rows)), n)
        end = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + bounds[row] + window - 1
        length, interval = FMIndex(text).matches(text, end, window)
        shared = length >= window
        least = np.full(len(text), np.iinfo(np.int64).max)
        np.minimum.at(least, interval[shared], doc[row[shared]])
        first = np.where(shared, least[interval], doc[row])
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(unit), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(first))], ["anchor", "unit", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held >= SHARD_WORDS and rows[-1][0] != row[0]:
                    yield answer(rows)
                    rows, held = [], 0
                if not rows or rows[-1][:2] != row[:2]:
                    rows.append(row)
                    held += row[3].count(b" ") + 1
        if rows:
            yield answer(rows)

    return units.repartition("anchor").sortWithinPartitions("anchor", "unit").mapInArrow(run, "anchor long, unit long, least array<long>")


def remove_repeats(docs: DataFrame, window: int = 50, gram: int = 8) -> DataFrame:
    """(doc_id, key, text, kept, n_words, n_removed) of each row of docs(doc_id, text): kept are the words that stay,
    joined by one space.

    A word goes if a window of `window` words covers it whose words also start in a document with a smaller doc_id; all
    windows are judged on the input. Runs of windows with one anchor are the passages: equal ones become one row with
    their first document before anything else is done, those whose anchor is in one document only are left out, and the
    rest are searched with an FM-index per shard of anchors. Passages of an anchor that has over MOST different ones (a
    line that very many documents hold) are cut into shorter ones with longer anchors, and where need be into single
    windows, so that no shard grows with the corpus.
    A null text has no words; a row with a null doc_id keeps all its words and takes none away; of rows with one doc_id
    none takes words from the other. An empty table gives an empty result, other columns are left out.
    """
    # columns of the right type stay as they are: an alias would keep Spark from seeing that it shuffles docs twice alike
    typed = [F.col(c) if docs.schema[c].dataType.simpleString() == t else F.col(c).cast(t).alias(c) for c, t in (("doc_id", "bigint"), ("text", "string"))]
    docs = docs.select(typed[0], text_key(F.col("text")).alias("key"), typed[1])
    known = docs.where("doc_id is not null")
    most = (window - gram).bit_length()  # then each range is one place, each run one window, and no anchor has two
    levels = (0, most // 2, most)
    runs, wanted, cuts = [], [], ()
    for level in levels:
        runs.append(cut(passages(known, window, gram, cuts), "passages"))
        units = runs[-1].groupBy("anchor", "unit").agg(F.min(F.struct("doc_id", "key", "start", "n")).alias("rep"), F.max("doc_id").alias("last"))
        anchors = units.groupBy("anchor").agg(F.count("*").alias("units"), F.min("rep.doc_id").alias("lo"), F.max("last").alias("hi")).where("lo < hi")
        found = cut(units.join(anchors, "anchor").select("anchor", "unit", "rep.*", "units"), "units")
        wanted.append(found.where(f"units <= {MOST}").drop("units"))
        slots = _slots(found.where(f"units > {MOST}"))
        if slots is None or level == most:
            break
        cuts = (*cuts, (levels[len(wanted)], slots))
    least = _search(_fetch(known, reduce(DataFrame.unionByName, wanted), window), window)
    late = reduce(DataFrame.unionByName, runs).join(least, ["anchor", "unit"]).where(F.col("doc_id") > F.array_min("least"))
    gone = late.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", F.transform("least", lambda x: x < F.col("doc_id")).alias("gone"))).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, most=SLICE):
            w = Words(batch.column(2))
            text, at, end = w.joined()
            cover = np.zeros(len(w) + 1, np.int32)
            flat = batch.column(3).flatten()
            if len(flat):
                doc = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(batch.column(3)), 0).to_numpy())
                start, flags = flat.field(0).to_numpy(), flat.field(1)
                n = pc.list_value_length(flags).to_numpy()
                j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                begin = (np.repeat(w.first[doc] + start, n) + j)[flags.flatten().to_numpy(zero_copy_only=False)]
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + window, -1)
            drop = np.cumsum(cover)[:-1] > 0
            removed = np.add.reduceat(np.append(drop, False), w.first[:-1]) * (w.counts > 0) if len(w) else np.zeros(len(w.counts))
            kept = []
            for d, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
                if a == b:
                    kept.append("")
                elif not removed[d]:
                    kept.append(text[at[a] : end[b - 1]].decode())
                else:
                    kept.append(b" ".join(text[at[i] : end[i]] for i in np.flatnonzero(~drop[a:b]) + a).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(kept, pa.string()), pa.array(w.counts.astype(np.int64)), pa.array(np.asarray(removed).astype(np.int64))],
                ["doc_id", "key", "text", "kept", "n_words", "n_removed"],
            )

    schema = "doc_id long, key long, text string, kept string, n_words long, n_removed long"
    unknown = docs.where("doc_id is null").withColumn("runs", F.lit(None).cast(gone.schema["runs"].dataType))
    return known.join(gone, ["doc_id", "key"], "left").unionByName(unknown).mapInArrow(run, schema)
