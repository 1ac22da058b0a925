"""Benchmark decontamination: winnowed fingerprints join documents with items, and matches extend to whole windows."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidelines.llm.common import cut
from sidelines.llm.text import ALNUM, Words, first_least, lists, parts, runs_hash

#: Benchmark fingerprints are broadcast up to this many bytes; beyond it the join shuffles.
BROADCAST_BYTES = 4 << 20
#: Documents drop fingerprints whose slot no benchmark fingerprint has; the table of slots has a fixed size.
SLOTS = 1 << 20


def _winnow(words: np.ndarray, left: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the least gram of each whole window, each once."""
    whole = np.flatnonzero(left >= window)
    if not len(whole):
        return whole, np.zeros(0, np.uint64)
    grams = runs_hash(words, np.arange(len(words) - gram + 1), gram)
    at = np.unique(first_least(grams, window - gram + 1)[whole])
    return at, grams[at]


def _around(words: np.ndarray, doc: np.ndarray, at: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Hashes of the words from window - gram before each position to window - 1 after it; 0 outside its text."""
    place = at[:, None] + np.arange(gram - window, window)[None, :]
    inside = (place >= 0) & (place < len(words))
    place = np.where(inside, place, 0)
    return np.where(inside & (doc[place] == doc[at][:, None]), words[place], 0) if len(at) else np.zeros((0, 2 * window - gram), np.uint64)


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * 8
    ends = (np.arange(len(rows) + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def item_prints(benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """(h, at_least, around, items): fingerprints of items; at_least is the window's length, less for a short item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            w = Words(batch.column(1), ALNUM, lower=True)
            words, left = w.hashes(), w.left()
            at, h = _winnow(words, left, window, gram)
            n = np.full(len(at), window)
            short = np.flatnonzero((w.counts > 0) & (w.counts < window))
            at, n = np.concatenate([at, w.first[short]]), np.concatenate([n, w.counts[short]])
            h = np.concatenate([h, runs_hash(words, w.first[short], w.counts[short], seed=3)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(n.astype(np.int32)), _binary(_around(words, w.doc, at, window, gram)), batch.column(0).take(pa.array(w.doc[at]))],
                ["h", "at_least", "around", "item_id"],
            )

    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    prints = items.mapInArrow(run, "h long, at_least int, around binary, item_id string")
    return prints.groupBy("h", "at_least", "around").agg(F.collect_set("item_id").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, gram: int = 5) -> DataFrame:
    """(row, doc_id, n_words, spans, items) of each row of docs(doc_id, text): spans array<struct<lo, hi>> are the word
    ranges that benchmark windows cover, items the item_ids of those windows.

    Words are runs of digits, a-z after lower-casing A-Z, and characters beyond ASCII. A window is `window` consecutive
    words of an item, or a whole item that has fewer. Of each window of a document the least of its gram hashes is kept,
    so every span of `window` words that text and item share has a fingerprint in both; a match is compared word by word
    as far as windows with that fingerprint reach. Short items meet documents by their whole length.
    Null or empty texts have no words, items without words or with a null id match nothing; repeated rows and null
    doc_ids give a row each. Other columns are left out.
    """
    before = window - gram
    bench = cut(item_prints(benchmark, window, gram), "items")
    short = sorted(r[0] for r in bench.where(F.col("at_least") < window).select("at_least").distinct().collect())
    slots = np.zeros(SLOTS, bool)
    slots[bench.select(F.pmod("h", F.lit(SLOTS)).cast("int").alias("slot")).distinct().toPandas()["slot"].to_numpy(np.int64)] = True

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            w = Words(batch.column(2), ALNUM, lower=True)
            words, left = w.hashes(), w.left()
            at, h = _winnow(words, left, window, gram)
            found = [(at, h)]
            for n in short:
                at = np.flatnonzero(left >= n)
                found.append((at, runs_hash(words, at, n, seed=3)))
            at, h = (np.concatenate(x) for x in zip(*found, strict=True))
            here = np.flatnonzero(slots[(h % np.uint64(SLOTS)).astype(np.int64)])
            at, h = at[here], h[here]
            order = np.argsort(at, kind="stable")
            at, h = at[order], h[order]
            counts = np.bincount(w.doc[at], minlength=batch.num_rows)
            rows = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array((at - w.first[w.doc[at]]).astype(np.int32)), _binary(_around(words, w.doc, at, window, gram))], ["h", "at", "around"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(w.counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), rows)],
                ["row", "doc_id", "n_words", "prints"],
            )

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, least = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            a, b = (np.array([np.frombuffer(x, "<u8") for x in batch.column(i).to_pylist()]) for i in (2, 4))
            same = (a == b) & (a != 0)
            right = np.cumprod(same[:, before:], axis=1).sum(axis=1)
            lefts = np.cumprod(same[:, :before][:, ::-1], axis=1).sum(axis=1)
            whole = least == window
            lo = np.where(whole, at - lefts, at)
            hi = np.where(whole, at + right, at + np.minimum(right, least))
            ok = pa.array(hi - lo >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), batch.column(5)], ["row", "lo", "hi", "items"]).filter(ok)

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = cut(texts.mapInArrow(prints, "row long, doc_id long, n_words long, prints array<struct<h: long, at: int, around: binary>>"), "prints")
    bench = bench.withColumnRenamed("around", "theirs")
    size = bench.agg(F.sum(F.length("theirs") + 40 + 20 * F.size("items"))).first()[0] or 0
    found = (
        seen.where(F.size("prints") > 0)
        .select("row", F.explode("prints").alias("p"))
        .select("row", "p.*")
        .join(F.broadcast(bench) if size <= BROADCAST_BYTES else bench, "h")
        .select("row", "at", "around", "at_least", "theirs", "items")
        .mapInArrow(extend, "row long, lo int, hi int, items array<string>")
        .groupBy("row")
        .agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    )
    return seen.drop("prints").join(found, "row", "left").select(
        "row",
        "doc_id",
        "n_words",
        F.coalesce("spans", F.expr("cast(array() as array<struct<lo:int,hi:int>>)")).alias("spans"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
    )


def report(found: DataFrame, share: int = 20) -> DataFrame:
    """Counts of contamination(): a document is contaminated if a word is hit and share * n_hit >= n_words."""
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["hi"] - F.greatest(a["end"], s["lo"].cast("long")))).alias("n"), F.greatest(a["end"], s["hi"].cast("long")).alias("end")),
        lambda a: a["n"],
    )
    return found.withColumn("n_hit", covered).select(
        "row",
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
