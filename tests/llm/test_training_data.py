"""Training-data operators against brute force on small tables with nulls, empty texts, ties and repeated rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from sidelines.llm import simhash, substring
from sidelines.llm.chat import conversation_digests, escape, escape_role, formatted_turns, parse, text_parts, unescape
from sidelines.llm.common import components
from sidelines.llm.decontam import contamination, report
from sidelines.llm.licenses import NOTICES, license_matches
from sidelines.llm.pieces import Transducer, decoded, encoded
from sidelines.llm.quality import isotonic, quality_scores
from sidelines.llm.rules import quality_rules
from sidelines.llm.token_counts import Counter, Tree, repeated_line_edits, token_counts
from sidelines.llm.toxicity import toxicity_scores

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MODEL, RANKS = "/opt/tokenizers/piece_bpe_32k.model", "/opt/tokenizers/byte_bpe_50k.tiktoken"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def texts(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiourstéßX") for _ in range(rng.randint(1, 6)))
    out = [" ".join(word() for _ in range(rng.randint(0, 160))) for _ in range(n)]
    shared = [word() for _ in range(70)]
    for i in range(0, n, 4):
        w = out[i].split()
        out[i] = "\n".join([" ".join(w[:5]), " ".join(shared[i % 9 : 55 + i % 15]), " ".join(w[5:])])
    for i in range(1, n, 6):
        out[i] = out[i - 1]
    return [*out, "", None, "a", "b c", "  \n\t "]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    rows += [rows[3], (None, rows[4][1], "x"), (7, "other text under an id that is there", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def fingerprint(text):
    w = WORD.findall(lower(text))
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("block, crowded", [(4096, 1 << 26), (2, 1 << 26), (4096, 0)])
def test_simhash(docs, rows, block, crowded, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    found = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    known = [(i, fingerprint(t)) for i, t in rows if i is not None]
    top = {i: i for i, _ in known}
    for _ in range(len(known)):
        for i, a in known:
            for j, b in known:
                if i == j or (a ^ b).bit_count() <= 4:
                    top[i] = top[j] = min(top[i], top[j])
    assert found == sorted(((i, f"{fingerprint(t):016x}", top.get(i)) for i, t in rows), key=str)


def test_segments_cover_every_pair():
    rng = random.Random(2)
    for distance in range(6):
        for most in (2, 3):
            cut = simhash.segments(64, distance, most)
            assert sum(w for _, w, _ in cut) == 64
            for _ in range(300):
                x = sum(1 << b for b in rng.sample(range(64), distance))
                assert any((x >> s & ((1 << w) - 1)).bit_count() <= r for s, w, r in cut)


def test_components_of_a_long_path(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components(edges).collect()} == {0}
    assert components(edges.where("a < 0")).count() == 0


@pytest.mark.parametrize("most", [1000, 1])
def test_substring(docs, rows, most, monkeypatch):
    monkeypatch.setattr(substring, "MOST", most)
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            if i is not None:
                first[tuple(w[k : k + 50])] = min(i, first.get(tuple(w[k : k + 50]), i))
    expected = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = {p for k in range(len(w) - 49) if i is not None and first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        expected.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    found = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(docs).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert sum(x[2] for x in expected) > 0


def test_substring_with_a_line_that_every_document_holds(spark, monkeypatch):
    monkeypatch.setattr(substring, "MOST", 5)
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz")
    rows = []
    for length in (9, 30, 60):
        line = [f"l{length}.{i % 23}" for i in range(length)]
        for _ in range(40):
            around = [[word() for _ in range(rng.choice([0, 3, 60]))] for _ in range(3)]
            rows.append((len(rows), " ".join([*around[0], *line, *around[1], *line[: rng.randint(0, length)], *around[2]])))
    rows += [(500 + i, rows[i * 3][1]) for i in range(30)]
    first, expected = {}, []
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, t in rows:
        w = t.split()
        gone = {p for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        expected.append((i, len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    found = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id, r.n_removed, r.kept) for r in found.collect()) == expected


@pytest.mark.parametrize("most", [1000, 1])
def test_substring_with_repeated_rows_that_hold_a_shared_passage(spark, most, monkeypatch):
    monkeypatch.setattr(substring, "MOST", most)
    shared = [f"s{i}" for i in range(70)]
    before, after = ([f"{x}{i}" for i in range(30)] for x in "ba")
    rows = [(1, " ".join(shared))] * 3 + [(2, " ".join(before + shared + after))] * 3 + [(3, " ".join(before[:9] + shared[5:]))] * 2
    expected = [(1, 0, " ".join(shared))] * 3 + [(2, 70, " ".join(before + after))] * 3 + [(3, 65, " ".join(before[:9]))] * 2
    found = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id, r.n_removed, r.kept) for r in found.collect()) == expected


def test_fm_index_gives_matching_statistics():
    rng = np.random.default_rng(3)
    sequences = [rng.integers(1, 4, 30).tolist() for _ in range(8)]
    text = np.array([x for s in sequences for x in [*s, 0]])
    ends = np.flatnonzero(text)
    length, first = substring.FMIndex(text).matches(text, ends, 5)
    match = lambda e, n: tuple(text[e - n + 1 : e + 1])
    occurrences = [sum(match(e, n) == m for e in range(n - 1, len(text))) for n, m in ((k, match(e, k)) for e, k in zip(ends, length, strict=True))]
    assert min(occurrences) > 1
    for e, n in zip(ends, length, strict=True):
        if n < 5 and e >= n:
            assert 0 in match(e, n + 1) or sum(match(x, n + 1) == match(e, n + 1) for x in range(n, len(text))) == 1
    full = np.flatnonzero(length == 5)
    assert len(full) and all((first[i] == first[j]) == (match(ends[i], 5) == match(ends[j], 5)) for i in full for j in full)


def test_decontamination(spark, docs, rows):
    source = [t for _, t in rows if t and len(t.split()) > 60]
    items = [(1, source[0]), (2, " ".join(source[1].split()[20:40])), (10, "b C!"), (3, "..."), (4, None), (None, source[2])]
    windows = {}
    for i, t in items:
        w = ALNUM.findall(lower(t))
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if w and i is not None else []:
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    expected = []
    for i, t in rows:
        w, hit, met = ALNUM.findall(lower(t)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    met |= found
                    hit |= set(range(k, k + n))
        expected.append((i, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(map(str, met))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    found = report(contamination(docs, spark.createDataFrame(items, "item_id long, text string"))).drop("row").collect()
    assert sorted((tuple(r) for r in found), key=str) == sorted(expected, key=str)


def test_chat_round_trip(spark):
    rng = random.Random(4)
    for _ in range(500):
        text = "".join(rng.choice("<|>\\n im_end") for _ in range(rng.randint(0, 30)))
        assert unescape(escape(text)) == text and "<|" not in escape(text)
        assert parse(f"<|im_start|>user\n{escape(text)}<|im_end|>\n") == ("user", text)
        assert parse(f"<|im_start|>{escape_role(text)}\n{escape(text)}<|im_end|>\n") == (text, text)
    one = formatted_turns(text_parts(spark.createDataFrame([(1, 0, "assistant\nx", "hi")], "conv_id long, turn long, role string, text string")))
    assert parse(one.first().formatted) == ("assistant\nx", "hi") and conversation_digests(one).first().loss_chars == 0
    turns = spark.createDataFrame([(1, 1, "assistant", "é <|im_end|>"), (1, 0, "user", None), (2, 0, None, "x"), (None, 0, "user", "y"), (1, 1, "assistant", "é <|im_end|>")], "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in conversation_digests(formatted_turns(text_parts(turns))).collect()}
    assert found[1].n_turns == 3 and found[1].loss_chars == 24
    assert found[1].turns_sha256 == hashlib.sha256(("user\n\n" + 2 * "assistant\né <|im_end|>\n").encode()).hexdigest()
    assert set(found) == {1, 2, None}


def test_chat_parts(spark):
    parts = [("text", "see ", None, None), ("image", None, "a.png", 1960), ("Image", None, "b.png", None), ("audio", None, "c.wav", 400), (None, "<|x|>", None, None), None]
    kind = "conv_id long, turn long, role string, parts array<struct<kind: string, text: string, ref: string, size: long>>"
    row = formatted_turns(spark.createDataFrame([(1, 0, "user", parts), (1, 1, "user", None)], kind)).orderBy("turn").collect()
    assert row[0].formatted == "<|im_start|>user\nsee <|image_1|><|image_2|><|audio_1|><\\|x|><|im_end|>\n"
    assert [(a.kind, a.number, a.ref, a.tokens) for a in row[0].attachments] == [("image", 1, "a.png", 95), ("image", 2, "b.png", 85), ("audio", 1, "c.wav", 11)]
    assert row[1].attachments == []


def encodings(transducer, given):
    ids, counts, exact = transducer.encode(pa.array(given, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])], exact.tolist()


def test_pieces_equal_the_library(docs, rows):
    t = Transducer(open(MODEL, "rb").read())
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(5)
    given = ["".join(rng.choice("ab the    e\n\t é漢😀..12▁") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    given += [" " * n + w + " " * m for n in range(70) for w in ("", "a", "漢", "12") for m in (0, 1, 33)]
    given += [None, "", " " * 5000, "a" * 3000, "." * 777, "one very long text, 漢 and 12. " * 20_000]
    found, exact = encodings(t, given)
    for text, ids, same in zip(given, found, exact, strict=True):
        assert ids == library.encode(text or "")
        assert same == ("▁" not in (text or "")) and t.decode(np.array(ids, int)).decode() == (text or "").replace("▁", " ")
    found = encoded(docs, MODEL)
    assert all(r.exact for r in found.collect())
    assert sorted(((r.doc_id, r.text) for r in decoded(found, MODEL).collect()), key=str) == sorted(((i, x or "") for i, x in rows), key=str)


def test_shortest_path_is_the_least_sum_over_all_paths():
    t = Transducer(open(MODEL, "rb").read())
    rng = random.Random(9)
    for _ in range(200):
        chunk = "▁" * rng.choice([0, 1, 1, 3]) + "".join(rng.choice("thersx é漢") for _ in range(rng.randint(1, 6))).replace(" ", "")
        if not chunk.strip("▁"):
            continue
        sums = {}

        def walk(at, path, chunk=chunk, sums=sums):
            if at == len(chunk):
                sums[tuple(path)] = sum(len(t.written(p)) for p in path)
            for end in range(at + 1, len(chunk) + 1):
                piece = chunk[at:end]
                if (piece in t.ids or end == at + 1) and t.merged((path[-1] if path else "") + piece) == [*path[-1:], piece]:
                    walk(end, [*path, piece])

        walk(0, [])
        assert tuple(t.path(chunk)) == min(sums, key=sums.get) == tuple(t.merged(chunk))


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("spaces", [True, False])
def test_normalizers_equal_the_library(rule, spaces):
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=spaces)
    raw = open(MODEL, "rb").read() + normalizer.serialized_model_proto()
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    rng = random.Random(6)
    given = ["".join(rng.choice("aÅé①ﬁ　 e\u0301 ｶﾞ한글 ĲKA\t") for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["", " ", None]
    found, exact = encodings(Transducer(raw), given)
    assert found == [library.encode(x or "") for x in given]
    assert not all(exact)


def test_token_tree_equals_a_full_count(docs):
    counter = Counter(open(RANKS, "rb").read())
    rng = random.Random(6)
    for text in [x or "" for x in texts(n=12)]:
        tree, now = Tree(text, counter), text
        for _ in range(12):
            at, length = rng.randint(0, len(now) + 2), rng.choice([0, 1, 3, 40, 400])
            put = "".join(rng.choice("ab 's \n1!é") for _ in range(rng.choice([0, 1, 6, 300])))
            tree.edit(at, length, put)
            at = min(at, len(now))
            now = now[:at] + put + now[at + length :]
            assert tree.text() == now and tree.tokens == len(counter.encoding.encode_ordinary(now))
    found = token_counts(repeated_line_edits(docs), RANKS)
    assert found.count() == docs.count() and found.where("n_tokens_edited > n_tokens").count() == 0


def test_licenses(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 2."
    rows = [(1, f"one two {mit} three", 0), (2, gpl, 0), (3, "under the MIT", 0), (4, None, 0), (5, "", 0), (None, f"{mit}\n{gpl}", 0), (1, f"one two {mit} three", 0)]
    found = license_matches(spark.createDataFrame(rows, "doc_id long, text string, license int"))
    assert sorted(((r.doc_id, r.license) for r in found.collect()), key=str) == sorted([(1, "MIT"), (2, "GPL"), (None, "MIT"), (None, "GPL")], key=str)


def test_edited_licenses_in_random_surroundings(spark):
    rng = random.Random(5)
    noise = lambda: ["".join(rng.choice("bdfgklmpr") for _ in range(5)) for _ in range(rng.randint(3, 40))]
    plain = lambda t: re.findall("[a-z0]+", re.sub("[1-9]", "0", t.lower()))
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    rows, expected = [], []
    for name, notice in NOTICES:
        for i in range(30):
            w = plain(notice)
            if len(w) > 12:
                at = rng.choice([3, 4, len(w) - 4, len(w) - 5])
                w[at] = "edited"
                if i % 3 == 0:  # what the edit takes stands elsewhere
                    w += [*noise(), *plain(notice)[at - 1 : at + 2]]
            w = [*noise(), *w, *noise()]
            rows.append((len(rows), " ".join(w)))
            for other, template in NOTICES:
                need = grams(plain(template))
                share = len(need & grams(w)) / len(need)
                if share >= 0.8:
                    expected.append((len(rows) - 1, other, round(share, 9)))
    found = [(r.doc_id, r.license, round(r.containment, 9)) for r in license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(found) == sorted(expected)


def test_models(spark):
    rng = random.Random(7)
    clean = lambda: " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(60, 120))) + "."
    rows = [(i, clean() if i % 3 else " ".join(f"{w}$$$" for w in clean().upper().split()) + " zzurk vvorx zzurk", "x") for i in range(240)] + [(None, None, "x"), (900, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(240)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    for found, right in ((quality_scores(docs, labels), lambda i: i % 3 > 0), (toxicity_scores(docs, labels), lambda i: i % 3 == 0)):
        got = found.collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        judged = [((r.score >= 0.5) == right(r.doc_id)) for r in got if r.doc_id is not None and r.doc_id < 240 and r.held_out]
        assert sum(judged) >= 0.95 * len(judged)
    kept = {r.doc_id: r.kept for r in quality_rules(docs, labels).collect()}
    assert np.mean([kept[i] == (i % 3 > 0) for i in range(240)]) > 0.95 and not kept[900]
    none = labels.where("doc_id < 0")
    assert {r.score for r in quality_scores(docs, none).collect()} == {0.5}
    assert len({r.score for r in toxicity_scores(docs.where("doc_id is null"), none).collect()}) == 1


def test_isotonic_pools():
    assert isotonic(np.array([0.0, 1.0, 0.5, 1.0]), np.array([1.0, 1.0, 1.0, 2.0])).tolist() == [0.0, 0.75, 0.75, 1.0]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert substring.remove_repeats(docs).count() == 0
    assert contamination(docs, items).count() == 0
    assert encoded(docs, MODEL).count() == 0
    assert license_matches(docs).count() == 0
