"""Lexical search, packing and collocations against brute force, with nulls, ties, repeated rows and empty tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sidelines.llm import collocations as phrases
from sidelines.llm import lexical
from sidelines.llm.collocations import HatTrie, collocations
from sidelines.llm.lexical import Shared, ranked
from sidelines.llm.packing import Encoder, best_fit, plan, sequences, token_pieces
from sidelines.llm.queries import TOKENIZERS

MODEL = f"{TOKENIZERS}/byte_bpe_50k.json"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(seed, n, most=80):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß漢ÄXY7") for _ in range(rng.randint(1, 4))) for _ in range(40)]
    fixed = [" ".join(rng.choices(vocabulary, k=4)) for _ in range(3)]
    out = []
    for _ in range(n):
        words = [rng.choice(fixed) if rng.random() < 0.2 else rng.choice(vocabulary) for _ in range(rng.randint(0, most))]
        out.append("".join(w + rng.choice([" "] * 12 + ["  ", "\t", ". ", ", ", "\n", "-", "\r\n", "!"]) for w in words))
    return [*out, "", None, " ", " .;: \n"]


def brute_search(docs, items, most=20):
    terms = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    terms = [(i, c, sum(c.values())) for i, c in terms if c]
    count, length = len(terms), sum(n for _, _, n in terms)
    df = Counter(t for _, c, _ in terms for t in c)
    out = []
    for item, text in items:
        wanted, scores = Counter(TERM.findall(lower(text))), []
        for i, c, n in terms:
            m = 75 + 25 * n * count // length
            score = sum(k * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in wanted.items() if t in c)
            if score > 0 and i is not None:
                scores.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:most], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1 << 16, 30])
def test_ranked_is_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    monkeypatch.setattr(lexical, "CELLS", 500)
    monkeypatch.setattr(lexical, "POOL", 50)
    docs = list(enumerate(prose(1, 120))) + [(None, "a b c d e"), (5, prose(1, 120)[5]), (9999, "word " * 40_000)]
    items = [(i, t) for i, t in enumerate(prose(2, 25, 20))] + [(100, docs[3][1]), (101, docs[3][1]), (102, "zzzz unknown"), (103, "word word")]
    table = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, score int").repartition(5)
    found = ranked(table, spark.createDataFrame([(*x, "r") for x in items], "item_id long, text string, rank string"))
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_search(docs, items)


def test_ranked_takes_repeated_items_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    items = spark.createDataFrame([("x", "b"), ("x", "a"), (None, "c"), ("y", None)], "item_id string, text string")
    found = {(r.item_id, r.rank, r.doc_id) for r in ranked(docs, items).collect()}
    assert found == {("x", 1, 1), (None, 1, 2)}
    assert not ranked(docs.limit(0), items).count() and not ranked(docs, items.limit(0)).count()


def test_shared_graph_sums_each_query_with_fewer_additions():
    rng = random.Random(4)
    common = [rng.sample(range(60), 8) for _ in range(4)]
    queries = [{t: rng.choice([1, 1, 2]) for t in rng.choice(common) + rng.sample(range(60), 5)} for _ in range(50)] + [{}, {3: 1}]
    queries += queries[:3]
    graph = Shared(queries)
    values = np.random.default_rng(1).integers(0, 10**9, (60, 7))
    expected = np.array([sum((values[t] * n for t, n in q.items()), np.zeros(7, np.int64)) for q in queries])
    assert (graph.scores(values) == expected).all()
    added = len(graph.left) + sum(max(0, n - 1) for n in np.diff(graph.first))
    assert added < 0.7 * sum(max(0, len(q) - 1) for q in queries)
    assert np.diff(graph.first)[-3:].tolist() == [1, 1, 1]


def test_encoder_gives_the_library_ids():
    import pyarrow as pa

    tokenizer, rng = Tokenizer.from_file(MODEL), random.Random(3)
    signs = ["a", "B", "é", "漢", " ", " ", "  ", "\n", "'s", "'", "1", ".", " ", " ", "<|endoftext|>", "\t", "the", "\x00", "😀", "’t", "×", "÷", "ÿ", "Ω", "\xa0", "<", "|>", ",", "\r\n", "x|", "ß."]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(600)] + prose(5, 60)
    encoder = Encoder(open(MODEL).read(), 2)
    assert encoder.quick
    for turn in range(3):
        encoder.quick = encoder.quick if turn < 2 else None
        if turn == 2:
            encoder.clear()
        ids, first = encoder(pa.array(texts, pa.string()))
        for i, text in enumerate(texts):
            assert ids[first[i] : first[i + 1]].tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], repr(text)


def test_packing_keeps_all_tokens_in_gapless_sequences(spark):
    rng = random.Random(6)
    docs = list(enumerate(prose(7, 60) + [" ".join(str(rng.random()) for _ in range(rng.randint(1, 400))) for _ in range(80)]))
    docs += [(None, "null id"), (2, docs[2][1]), (3, "another text under the same id")]
    table = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, piece int").repartition(4)
    pieces = token_pieces(table, MODEL)
    packed = best_fit(pieces).collect()
    tokenizer = Tokenizer.from_file(MODEL)
    wanted = Counter()
    for i, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        head = len(ids) - 1024 * ((len(ids) - 1) // 1024)
        for piece, (a, b) in enumerate(zip([0, *range(head, len(ids), 1024)], [*range(head, len(ids) + 1, 1024)], strict=True)):
            wanted[i, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in packed) == wanted
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) <= 1024
    least = -(-sum(r.length for r in packed) // 1024)
    assert len(bins) <= least * 1.02 + 1
    whole = {r.sequence_id: r for r in sequences(spark.createDataFrame(packed)).collect()}
    some = packed[17]
    assert whole[some.sequence_id].ids[4 * some.offset : 4 * (some.offset + some.length)] == some.ids
    assert not best_fit(token_pieces(table.limit(0), MODEL)).count()


def test_lengths_outside_the_capacity_have_no_sequence(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, 0), (4, 9), (5, 8)], "id int, length long")
    assert {r.id for r in best_fit(rows, 8).where("sequence_id is null and offset is null").collect()} == {2, 3, 4}


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = 60
    counts = np.bincount(rng.integers(1, capacity + 1, rng.integers(1, 900)), minlength=capacity + 1)
    if seed == 5:
        counts[:] = 0
    slots, bins = plan(counts), defaultdict(list)
    for size in range(1, capacity + 1):
        mine = slots[slots[:, 0] == size]
        for rank in range(counts[size]):
            s = mine[np.searchsorted(mine[:, 1], rank, "right") - 1]
            k = rank - s[1]
            bins[s[3] + k // s[2]].append((s[4] + k % s[2] * size, size))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) <= capacity
        assert sum(3 * n > capacity for _, n in own) <= 2
    gaps: list[int] = []  # one piece after another, where the least gap takes it
    for size in sorted(np.repeat(np.arange(capacity + 1), counts).tolist(), reverse=True):
        fits = [g for g in gaps if g >= size]
        gap = min(fits) if fits else capacity
        if fits:
            gaps.remove(gap)
        gaps.append(gap - size)
    assert len(bins) <= len(gaps)


def brute_phrases(docs, least, most):
    f, total = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, *w[i : i + n]) for n in range(1, 5) for i in range(len(w) - n + 1))
    good = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    covered = {(p[0], *p[1 + i : 1 + i + n]) for p, a in good.items() for n in range(2, len(p) - 1) for i in range(len(p) - n) if 100 * a >= 80 * f[(p[0], *p[1 + i : 1 + i + n])]}
    out = []
    for p, a in good.items():
        if p not in covered:
            score, k = min((2_000_000 * a // (f[p[: k + 1]] + f[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1))
            out.append((p[0], " ".join(p[1:]), a, f[p[: k + 1]], f[(p[0], *p[k + 1 :])], total[p[0]], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    rank = Counter()
    for r in out:
        rank[r[0]] += 1
        if rank[r[0]] <= most:
            yield (r[0], rank[r[0]], *r[1:])


@pytest.mark.parametrize("small", [False, True])
def test_collocations_are_brute_force(spark, monkeypatch, small):
    if small:  # tries that burst and spill, and vocabularies that are full, all the time
        monkeypatch.setattr(phrases, "BURST", 3)
        monkeypatch.setattr(phrases, "MOST_ENTRIES", 40)
        monkeypatch.setattr(phrases, "WORDS_AT_ONCE", 100)
        monkeypatch.setattr(phrases, "ID_BITS", 8)
        monkeypatch.setattr(phrases, "SLOT_BITS", 12)
    texts = prose(11, 150)
    docs = [(["en", "de", None][i % 3], t) for i, t in enumerate(texts)] + [("en", texts[0])] * 3 + [("de", "a b c d e\nf " * 20_000)]
    table = spark.createDataFrame([(*d, 1) for d in docs], "lang string, text string, rank int").repartition(4)
    found = collocations(table, 12, 25)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute_phrases(docs, 12, 25))
    assert not small or not collocations(table.limit(0)).count()


def test_trie_counts_as_a_plain_counter():
    rng, plain, trie, spilled = np.random.default_rng(2), Counter(), HatTrie(4, burst=4), Counter()

    def unpack(found):
        for first, key, n in zip(*(x.tolist() for x in found), strict=True):
            spilled[first, key >> 2 * phrases.ID_BITS, key >> phrases.ID_BITS & (1 << phrases.ID_BITS) - 1, key & (1 << phrases.ID_BITS) - 1] += n

    for _ in range(40):
        words = rng.integers(0, 5, (30, 4))
        each, counts = np.unique(words, axis=0, return_counts=True)
        rest = np.zeros(len(each), np.int64)
        for j in range(1, 4):
            rest = rest << phrases.ID_BITS | each[:, j]
        trie.add(each[:, 0], rest, counts)
        for w, n in zip(each.tolist(), counts.tolist(), strict=True):
            plain[w[0], *w[1:]] += n
        unpack(trie.spill(100))
        assert trie.entries <= 100
    unpack(trie.spill(0))
    assert spilled == plain and trie.entries == 0


def test_crc_of_ids_is_that_of_little_endian_words(spark):
    docs = spark.createDataFrame([(1, "Hello world")], "doc_id long, text string")
    ids = [*Tokenizer.from_file(MODEL).encode("Hello world").ids, 2]
    found = token_pieces(docs, MODEL).select(F.crc32("ids").alias("c")).first().c
    assert found == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
