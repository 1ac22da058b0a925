"""Ranked lexical search: a set of queries over all documents, with the term sets that queries share scored once."""

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sidelines.llm.common import cut
from sidelines.llm.text import ALNUM, Words, distinct, lists, parts

#: Terms of the queries of one block; cells of documents by accumulators that a task holds at once.
BLOCK_TERMS, CELLS = 1 << 16, 1 << 22
#: Rows that wait to be ranked.
POOL = 1 << 18


class Shared:
    """A query-sharing graph: leaves are terms with their number in a query, every other node is the sum of two, and a query
    is the sum of its parts.

    Each query's leaves are listed by how many queries hold them; neighbours in the lists that several queries share become a
    node, again and again until none is left, so equal queries end as one node. Nodes are numbered by level."""

    def __init__(self, queries: list[dict[int, int]]):
        held = Counter(leaf for q in queries for leaf in q.items())
        self.leaves = sorted(held)
        number = {leaf: i for i, leaf in enumerate(self.leaves)}
        lists = [[number[leaf] for leaf in sorted(q.items(), key=lambda x: (-held[x], x))] for q in queries]
        level, pairs = [0] * len(number), []
        while True:
            met = Counter(p for q in lists for p in zip(q, q[1:]))
            if not met or max(met.values()) < 2:
                break
            made: dict[tuple[int, int], int] = {}
            for at, q in enumerate(lists):
                new, i = [], 0
                while i < len(q):
                    pair = tuple(q[i : i + 2])
                    if len(pair) == 2 and met[pair] > 1 and met[pair] >= met[tuple(q[i + 1 : i + 3])]:
                        if pair not in made:
                            made[pair] = len(level)
                            level.append(1 + max(level[pair[0]], level[pair[1]]))
                            pairs.append(pair)
                        new.append(made[pair])
                        i += 2
                    else:
                        new.append(q[i])
                        i += 1
                lists[at] = new
        order = sorted(range(len(level)), key=lambda n: level[n])
        place = np.zeros(len(level), np.int64)
        place[order] = np.arange(len(level))
        inner = [n for n in order if level[n]]
        both = np.array([pairs[n - len(number)] for n in inner], np.int64).reshape(-1, 2)
        self.left, self.right = place[both[:, 0]], place[both[:, 1]]
        self.levels = [len(number) + int(i) for i in np.searchsorted([level[n] for n in inner], range(1, max(level, default=0) + 2))]
        self.terms, self.times = (np.array(x, np.int64) for x in (zip(*self.leaves, strict=True) if self.leaves else ((), ())))
        self.parts = place[[n for q in lists for n in q]] if any(lists) else np.zeros(0, np.int64)
        self.first = np.cumsum([0, *map(len, lists)])
        self.size = len(level)

    def scores(self, values: np.ndarray) -> np.ndarray:
        """(queries, documents) from values (terms, documents)."""
        total = np.zeros((self.size, values.shape[1]), np.int64)
        total[: len(self.leaves)] = values[self.terms] * self.times[:, None]
        for a, b in zip(self.levels, self.levels[1:], strict=False):
            k = slice(a - len(self.leaves), b - len(self.leaves))
            total[a:b] = total[self.left[k]] + total[self.right[k]]
        out = np.zeros((len(self.first) - 1, values.shape[1]), np.int64)
        full = np.flatnonzero(np.diff(self.first))
        if len(full):
            out[full] = np.add.reduceat(total[self.parts], self.first[full], axis=0)
        return out


def _terms(items: DataFrame) -> DataFrame:
    """(item, terms, times) of items(item, text): each item's different terms and how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            w = Words(batch.column(1), ALNUM, lower=True)
            place, words = _words(w)
            key, n = np.unique(w.doc * max(len(words), 1) + place, return_counts=True)
            doc, term = key // max(len(words), 1), key % max(len(words), 1)
            counts = np.bincount(doc, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(words.take(pa.array(term)).cast(pa.binary()), counts, pa.binary()), lists(n, counts, pa.int64())], ["item", "terms", "times"])

    return items.mapInArrow(run, "item string, terms array<binary>, times array<long>")


def _words(w: Words) -> tuple[np.ndarray, pa.Array]:
    return distinct(np.concatenate([[0], np.cumsum(w.length)]), w.data[w.inside])


def postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, times) of each row of docs(doc_id, text) with a term: n is the number of all its terms, the lists
    have the given terms it holds, by number, and how often."""
    number = {term: i for i, term in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            w = Words(batch.column(1), ALNUM, lower=True)
            place, words = _words(w)
            own = np.array([number.get(x, -1) for x in words.to_pylist()], np.int64)[place] if len(w) else np.zeros(0, np.int64)
            known = own >= 0
            key, times = np.unique(w.doc[known] * max(len(terms), 1) + own[known], return_counts=True)
            counts = np.bincount(key // max(len(terms), 1), minlength=batch.num_rows)
            kept = pa.array(np.flatnonzero(w.counts > 0))
            columns = [batch.column(0), pa.array(w.counts.astype(np.int64)), lists((key % max(len(terms), 1)).astype(np.int32), counts, pa.int32()), lists(times.astype(np.int64), counts, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.take(kept) for c in columns], ["doc_id", "n", "terms", "times"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, times array<long>")


def _best(query: np.ndarray, doc: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Places of each query's first `most` rows by score and doc_id."""
    order = np.lexsort((doc, -score, query))
    q = query[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return order[rank < most]


def _block(docs: DataFrame, items: list[tuple], most: int) -> DataFrame:
    """(item, doc_id, score): each task's first `most` documents of each item."""
    terms = sorted({t for _, own, _ in items for t in own})
    number = {t: i for i, t in enumerate(terms)}
    graph = Shared([{number[t]: n for t, n in zip(own, times, strict=True)} for _, own, times in items])
    names = pa.array([item for item, _, _ in items], pa.string())
    found = cut(postings(docs, terms), "postings")
    documents, length = found.agg(F.count("*"), F.sum("n")).first()
    held = found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()
    weight = np.zeros(len(terms), np.int64)
    for t, df in zip(held.column("t").to_pylist(), held.column("df").to_pylist(), strict=True):
        weight[t] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    at_once, pool_rows = max(1, CELLS // max(graph.size + len(terms), 1)), POOL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool: list[list[np.ndarray]] = []
        bar = np.zeros(len(items), np.int64)

        def rank() -> None:
            if pool:
                q, d, s = (np.concatenate(x) for x in zip(*pool, strict=True))
                kept = _best(q, d, s, most)
                pool[:] = [[q[kept], d[kept], s[kept]]]
                full = np.bincount(q[kept], minlength=len(items)) >= most
                least = np.full(len(items), np.iinfo(np.int64).max)
                np.minimum.at(least, q[kept], s[kept])
                bar[full] = least[full]

        waiting = 0
        for batch in batches:
            for a in range(0, batch.num_rows, at_once):
                part = batch.slice(a, at_once)
                doc, n = part.column(0).to_numpy(), part.column(1).to_numpy()
                counts = part.column(2).value_lengths().to_numpy()
                term, times = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
                m = 75 + (25 * n * documents) // length
                of = np.repeat(np.arange(len(doc)), counts)
                values = np.zeros((len(terms), len(doc)), np.int64)
                values[term, of] = weight[term] * ((1_000_000_000 * times) // (1000 * times + 12 * m[of]))
                scores = graph.scores(values)
                q, d = np.nonzero((scores > 0) & (scores >= bar[:, None]))
                pool.append([q, doc[d], scores[q, d]])
                waiting += len(q)
                if waiting > pool_rows:
                    rank()
                    waiting = 0
        rank()
        if pool:
            yield pa.RecordBatch.from_arrays([names.take(pa.array(pool[0][0])), pa.array(pool[0][1], pa.int64()), pa.array(pool[0][2])], ["item", "doc_id", "score"])

    return found.where("doc_id is not null and size(terms) > 0").mapInArrow(run, "item string, doc_id long, score long")


def ranked(docs: DataFrame, benchmark: DataFrame, most: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): for each of benchmark(item_id, text) its first `most` rows of docs(doc_id, text) with a
    score above 0, by score and doc_id.

    Terms are runs of digits, a-z after lower-casing A-Z, and characters beyond ASCII. N is the number of documents with a
    term, L of all terms; a term in df documents weighs w = floor(1000 * ln((2N + 2) / (2df + 1))); in a document of n terms
    that holds it tf times it adds w * (10^9 * tf div (1000 * tf + 12 * m)), m = 75 + 25 * n * N div L, as often as the item has it.

    Items are scored in blocks of about BLOCK_TERMS terms, each against all documents: per block the documents' postings of
    the block's terms are written once, counted, and then summed along the graph of term sets that items share. Each task
    ranks what it reads, so only its first rows of each item are shuffled.
    Null texts have no terms. Rows without a doc_id count in N, L and df and are never listed; repeated rows count and are
    listed each. Of several rows of one item_id the one with the least text is the item; a null item_id is one too. Other
    columns are left out. Empty tables give no rows.
    """
    kind = benchmark.schema["item_id"].dataType
    items = benchmark.groupBy(F.col("item_id").cast("string").alias("item")).agg(F.min(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    items = cut(_terms(items).where("size(terms) > 0"), "items")
    total = items.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks, found = -(-total // BLOCK_TERMS), None
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toArrow().to_pylist()
        if mine:
            rows = _block(docs, sorted(((r["item"], r["terms"], r["times"]) for r in mine), key=lambda r: (r[0] is not None, r[0] or "")), most)
            found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item string, doc_id long, score long")
    order = [F.desc("score"), F.asc("doc_id")]
    spread = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(*order)
    first = found.withColumn("place", F.row_number().over(spread)).where(F.col("place") <= most)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= most)
    return first.select(F.col("item").cast(kind).alias("item_id"), "rank", "doc_id", "score")
