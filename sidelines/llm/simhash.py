"""SimHash near-duplicates: fingerprints of word shingles, linked through multi-index hashing."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sidelines.llm.common import components, cut
from sidelines.llm.text import Words, parts

#: A bucket with more fingerprints is compared in blocks, each pair of blocks by a task of its own.
BLOCK = 4096
#: Different fingerprints above which three segments would fill their buckets, and two are used.
CROWDED = 1 << 26


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id long, fingerprint long) of every row of docs(doc_id, text).

    Words are runs without white space, A-Z in lower case. Shingles are `shingle` words joined by one space, repeats
    included; fewer words make one shingle, no words (empty or null text) the fingerprint 0. A bit is 1 if it is set in
    over half of the shingles' XXH64. Repeated rows and null ids stay; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, most=1 << 20):
            w = Words(batch.column(1), lower=True)
            text, at, end = w.joined()
            n = np.where(w.counts > 0, np.maximum(w.counts - shingle + 1, 1), 0)
            begin = np.flatnonzero((w.left() >= shingle) | (np.arange(len(w)) == w.first[w.doc]))
            last = np.minimum(begin + shingle, w.first[w.doc[begin] + 1]) - 1
            h = np.fromiter((xxh64_intdigest(text[a:b], seed) for a, b in zip(at[begin].tolist(), end[last].tolist(), strict=True)), np.uint64, len(begin))
            out = np.zeros(len(n), np.uint64)
            if len(h):
                bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                some = np.flatnonzero(n)
                ones = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int32)
                out[some] = np.packbits(2 * ones > n[some, None], axis=1, bitorder="little").view("<u8")[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint long")


def segments(bits: int, distance: int, most: int = 3) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each of `most` segments, or fewer. Radii plus one sum to distance + 1, so of two
    fingerprints within `distance` bits at least one segment differs by its radius or less."""
    count = min(most, distance + 1)
    width, radius = [bits // count] * count, [(distance + 1) // count - 1] * count
    for i in range(bits % count):
        width[-1 - i] += 1
    for i in range((distance + 1) % count):
        radius[i] += 1
    return [(sum(width[:i]), width[i], radius[i]) for i in range(count)]


def _forest(fp: np.ndarray, node: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least node that it is linked with, directly or through others of these."""
    order = np.argsort(node, kind="stable")
    fp, node = fp[order], node[order]
    label = np.arange(len(fp))
    rows = max(1, (1 << 21) // len(fp))
    for at in range(0, len(fp), rows):
        near = np.bitwise_count(fp[at : at + rows, None] ^ fp[None, :]) <= distance
        for i in np.flatnonzero(near.sum(axis=1) > 1):
            met = label[near[i]]
            if (met != met[0]).any():
                label[np.isin(label, met)] = met.min()
    linked = label != np.arange(len(fp))
    return node[linked], node[label[linked]]


def links(nodes: DataFrame, distance: int = 4, most: int = 3) -> DataFrame:
    """Edges (a, b) that connect the same nodes as all pairs within `distance` bits do.

    nodes(node long, fingerprint long) holds each fingerprint once. Every fingerprint enters the table of each segment by
    its own key, and once for each key in the small ball around it that has a bit less (of two keys that differ in a bit,
    one has it), so two near fingerprints meet in a bucket. A bucket's task compares whole fingerprints and returns a
    spanning forest, never all pairs. A bucket over BLOCK rows is dealt out as pairs of blocks. Fewer, wider segments make
    smaller buckets of larger balls.
    """

    def ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fp = (batch.column(i).to_numpy() for i in range(2))
            for k, (shift, width, radius) in enumerate(segments(64, distance, most)):
                own = (fp.view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                ring = [(own, np.arange(len(own)), np.full(len(own), width))]
                for _ in range(radius):  # bits go in falling order, so each key comes up once
                    key, row, last = ring[-1]
                    found = []
                    for b in range(width):
                        has = np.flatnonzero((key >> np.uint64(b) & np.uint64(1) == 1) & (b < last))
                        found.append((key[has] ^ np.uint64(1 << b), row[has], np.full(len(has), b)))
                    ring.append(tuple(np.concatenate(x) for x in zip(*found, strict=True)))
                key, row = np.concatenate([x[0] for x in ring]), np.concatenate([x[1] for x in ring])
                yield pa.RecordBatch.from_arrays([pa.array((key | np.uint64(k << 60)).view(np.int64)), pa.array(node[row]), pa.array(fp[row])], ["key", "node", "fingerprint"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run(kept: list[np.ndarray]) -> pa.RecordBatch:
            key, node, fp = (np.concatenate(x) for x in zip(*kept, strict=True))
            edges = []
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            for a, b in zip(at.tolist(), [*at[1:].tolist(), len(key)], strict=True):
                if b - a > 1:
                    edges.append(_forest(fp[a:b], node[a:b], distance))
            a, b = (np.concatenate(x) for x in zip(*edges, strict=True)) if edges else (node[:0], node[:0])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        rest: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            change = np.flatnonzero(cols[0][1:] != cols[0][:-1])
            if not len(change):
                if rest and rest[-1][0][-1] != cols[0][0]:
                    yield run(rest)
                    rest = []
                rest.append(tuple(cols))
                continue
            to = int(change[-1]) + 1
            yield run([*rest, tuple(c[:to] for c in cols)])
            rest = [tuple(c[to:] for c in cols)]
        if rest:
            yield run(rest)

    rows = nodes.select("node", "fingerprint").mapInArrow(ball, "key long, node long, fingerprint long")
    large = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    rows = rows.join(large, "key", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("n") > BLOCK, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.lit(0)))))
    dealt = dealt.select(
        F.when(F.col("n") > BLOCK, F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).otherwise(F.col("key")).alias("bucket"),
        "node",
        "fingerprint",
    )
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """(doc_id, fingerprint string, component_id): one row for each row of docs(doc_id, text).

    Rows whose fingerprints differ in `distance` bits or fewer are linked, texts without words (fingerprint 0) like any
    other; component_id is the smallest doc_id reachable. A null doc_id has a fingerprint and a null component_id and
    links nothing. Rows with an equal doc_id are in one component. An empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, shingle), "prints")
    ids = prints.where("doc_id is not null")
    nodes = cut(ids.groupBy("fingerprint").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "nodes")
    same = ids.groupBy("doc_id").agg(F.min("fingerprint").alias("low"), F.max("fingerprint").alias("high")).where("low <> high")
    also = ids.join(same, "doc_id").join(nodes, "fingerprint").select("doc_id", "node")
    edges = links(nodes, distance, 3 if nodes.count() <= CROWDED else 2).unionByName(also.select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    found = components(edges)
    of_print = nodes.join(found, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component_id"))
    return prints.join(of_print, "fingerprint", "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
