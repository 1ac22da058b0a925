"""Each stage of the corpus pipeline on its own input, against brute force, and the stages in a row."""

import random
import re

import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sidelines.llm.queries import TOKENIZERS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, kept string, _row int"
RUDE = 12


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioulnrstß") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus():
    """Plain texts; toxic ones; exact and near copies; a passage that several hold; benchmark passages; odd rows."""
    rng = random.Random(11)
    passage, item = prose(rng, 70), prose(rng, 30)
    texts = [prose(rng, rng.randint(150, 260)) for _ in range(70)]
    rude = set(range(0, 60, 4))
    for i in rude:
        w = texts[i].split()
        for at in rng.sample(range(len(w)), RUDE):
            w[at] = rng.choice(["zzurk", "vvorx", "qqupp"])
        texts[i] = " ".join(w)
    for i in (1, 5, 9):
        texts[i] = f"{texts[i]}\n{passage} end{i}"
    texts[13] = f"{item} {prose(rng, 100)}"
    texts[62], texts[63] = texts[61], texts[61] + " x"
    texts += ["", None, "one word", " \n\t"]
    rows = [(i, t, "en", "s", len(t or ""), i, f"k{i}", 1) for i, t in enumerate(texts)]
    rows += [rows[61], (None, texts[2], None, None, None, None, None, None), (None, prose(rng, 80), None, None, None, None, None, None)]
    return rows, item, rude


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, item, rude = corpus()
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None), (2, "...")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, 1, int(i in rude)) for i in range(60)] + [(None, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def fingerprint(text):
    w = WORD.findall(lower(text))
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_toxicity_stage(spark, docs, folder):
    rows, _, rude = corpus()
    kept = corpus_pipeline.toxicity(spark, docs, folder)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(rude & set(ids)) <= 1, "toxic documents go"
    clean = [r[0] for r in rows if r[0] not in rude]
    assert sum(i in ids for i in clean) >= len(clean) - 1, "clean documents stay"
    assert ids.count(None) == 2


def test_near_dedup_stage(spark, docs, folder):
    rows, _, _ = corpus()
    prints = {r[0]: fingerprint(r[1]) for r in rows if r[0] is not None}
    top = {i: i for i in prints}
    for _ in prints:
        for i, a in prints.items():
            for j, b in prints.items():
                if (a ^ b).bit_count() <= 4:
                    top[i] = top[j] = min(top[i], top[j])
    expected = {r for r in rows if r[0] is None or top[r[0]] == r[0]}
    assert len(expected) < len(set(rows)) and (61 in top) and top[62] == 61
    assert collected(corpus_pipeline.near_dedup(spark, docs, folder)) == sorted(expected, key=str)


def test_substring_stage(spark, docs, folder):
    rows, _, _ = corpus()
    first = {}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            if i is not None:
                first[tuple(w[k : k + 50])] = min(i, first.get(tuple(w[k : k + 50]), i))
    expected = []
    for i, t, lang, source, n, *rest in rows:
        w = WORD.findall(t or "")
        gone = {p for k in range(len(w) - 49) if i is not None and first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        if gone:
            t = " ".join(x for p, x in enumerate(w) if p not in gone)
            n = len(t)
        expected.append((i, t, lang, source, n, *rest))
    assert expected != rows
    assert collected(corpus_pipeline.substring_dedup(spark, docs, folder)) == sorted(expected, key=str)


def test_decontamination_stage(spark, docs, folder):
    rows, item, _ = corpus()
    window = ALNUM.findall(lower(item))
    shared = {tuple(window[k : k + 13]) for k in range(len(window) - 12)}

    def contaminated(text):
        w = ALNUM.findall(lower(text))
        hit = {p for k in range(len(w) - 12) if tuple(w[k : k + 13]) in shared for p in range(k, k + 13)}
        return bool(hit) and 20 * len(hit) >= len(w)

    gone = {r[0] for r in rows if contaminated(r[1])}
    assert gone == {13}
    expected = [r for r in rows if r[0] not in gone]
    assert collected(corpus_pipeline.decontamination(spark, docs, folder)) == sorted(expected, key=str)


def test_encoding_stage(spark, docs, folder):
    rows, _, _ = corpus()
    library = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    expected = [(i, library.encode(t or "")) for i, t, *_ in rows]
    found = corpus_pipeline.encoding(spark, docs, folder)
    assert sorted(((r.doc_id, list(r.token_ids)) for r in found.collect()), key=str) == sorted(expected, key=str)
    assert found.where(~F.col("exact")).count() == 0


def test_run_applies_the_stages_in_order(spark, docs, folder):
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, folder)
        if name != "encoding":
            assert now.columns == before.columns and now.count() <= before.count()
    found = corpus_pipeline.run(spark, folder)
    assert collected(found.select("doc_id", "n_tokens")) == collected(now.select("doc_id", "n_tokens"))


def test_stages_take_empty_tables(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
