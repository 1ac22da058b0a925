"""Very long texts, clashing columns, ties, repeated rows and null edits in every training-data operator."""

import hashlib
import random
import re

import duckdb
import pandas as pd
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sidelines.llm import queries
from sidelines.llm.chat import conversation_digests, formatted_turns, parse, text_parts
from sidelines.llm.decontam import contamination, report
from sidelines.llm.licenses import license_matches
from sidelines.llm.pieces import encoded
from sidelines.llm.quality import quality_scores
from sidelines.llm.rules import learned_rules, quality_rules
from sidelines.llm.simhash import near_duplicates
from sidelines.llm.stats import ratios, statistics
from sidelines.llm.substring import remove_repeats
from sidelines.llm.token_counts import Counter, counted_trees, edited_trees, repeated_line_edits, token_counts
from sidelines.llm.toxicity import toxicity_scores

MODEL, RANKS = "/opt/tokenizers/piece_bpe_32k.model", "/opt/tokenizers/byte_bpe_50k.tiktoken"
SCHEMA = "doc_id long, text string, label int, key string, h long, fingerprint string, score double, row long, unit long, edits string"
NOTICE = "Licensed under the Apache License, Version 2.0."


def prose(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("aeiounrst") for _ in range(rng.randint(2, 8))) for _ in range(n)]


LONG = prose(1, 60_000)
ITEM = prose(2, 20)
TEXTS = {
    0: " ".join(LONG),
    1: " ".join([*LONG[30_000:59_000], *ITEM, NOTICE]),
    2: " ".join(prose(3, 300)),
    3: "a" * 400_000,
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "k", 2, "f", 0.5, 3, 4, "e") for i, t in TEXTS.items()]
    return spark.createDataFrame([*rows, rows[2]], SCHEMA).repartition(2)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(4)], "doc_id long, quality int, toxic int")


def test_long_texts_in_simhash(docs):
    w = TEXTS[0].split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(len(w) - 3)]
    bits = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    found = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert found[0].fingerprint == f"{bits:016x}" and found[2].component_id == 2


def test_long_texts_in_substring_and_decontamination(spark, docs):
    found = sorted({(r.doc_id, r.n_words, r.n_removed) for r in remove_repeats(docs).collect()})
    assert found == [(0, 60_000, 0), (1, 29_027, 29_000), (2, 300, 0), (3, 1, 0)]
    items = spark.createDataFrame([(7, " ".join(ITEM))], "item_id long, text string")
    found = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in report(contamination(docs, items)).collect()}
    assert found[1] == (20, 1, False) and found[0] == (0, 0, False)
    whole = spark.createDataFrame([(7, TEXTS[0])], "item_id long, text string")
    found = {r.doc_id: (r.n_hit, r.contaminated) for r in report(contamination(docs, whole)).collect()}
    assert found[0] == (60_000, True) and found[1] == (29_000, True) and found[2] == (0, False)


def test_long_texts_in_pieces_licenses_and_counts(docs):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in encoded(docs, MODEL).collect():
        assert r.exact and r.token_ids == library.encode(TEXTS[r.doc_id])
    assert [(r.doc_id, r.license) for r in license_matches(docs).collect()] == [(1, "Apache")]
    counter = Counter(open(RANKS, "rb").read())
    for r in token_counts(repeated_line_edits(docs), RANKS).collect():
        assert r.n_tokens == r.n_tokens_edited == len(counter.encoding.encode_ordinary(TEXTS[r.doc_id]))


def test_long_texts_in_chat(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q", 1, "p"), (1, 1, "assistant", TEXTS[0] + "<|im_end|>", 1, "p")], "conv_id long, turn long, role string, text string, n_turns int, formatted string")
    turns = turns.union(turns.where("turn = 1"))
    row = conversation_digests(formatted_turns(text_parts(turns))).first()
    text = TEXTS[0] + "<|im_end|>"
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (3, 2 * len(text), hashlib.sha256((2 * text).encode()).hexdigest())
    assert parse(formatted_turns(text_parts(turns)).where("turn = 0").first().formatted) == ("user", "q")


def test_long_texts_and_ties_in_models(docs, labels):
    for found in (quality_scores(docs, labels), toxicity_scores(docs, labels)):
        rows = found.collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == 2}) == 1
    assert quality_rules(docs, labels).count() == 5
    again = labels.union(labels).union(labels.withColumn("toxic", 1 - F.col("toxic")).where("doc_id = 1"))
    assert sorted(map(str, toxicity_scores(docs, again).collect())) == sorted(map(str, toxicity_scores(docs, labels).collect()))


def test_long_texts_in_the_pipeline(spark, docs, labels, tmp_path):
    rows = docs.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, " ".join(ITEM))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    docs = corpus_pipeline.substring_dedup(spark, docs, str(tmp_path))
    assert sorted((r.doc_id, len(r.text.split())) for r in docs.collect()) == [(0, 60_000), (1, 27), (2, 300), (3, 1)]
    docs = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in corpus_pipeline.encoding(spark, docs, str(tmp_path)).where("exact").collect()) == [0, 2, 3]


EDITED = [
    ("one two three", [{"at": 4, "length": 3, "text": "2"}, {"at": 4, "length": 1, "text": "2"}, None]),
    ("one two three", [{"at": None, "length": None, "text": None}, {"at": 99, "length": 5, "text": " end"}]),
    ("one two three", None),
    (None, [{"at": 0, "length": 3, "text": "new"}]),
    ("x y " * 900, [{"at": 5, "length": 2, "text": ""}] * 3),
]
AFTER = ["one 2 three", "one two three end", "one two three", "new", ("x y " * 900)[:5] + ("x y " * 900)[11:]]


def test_null_and_repeated_edits_and_trees_that_are_kept(spark, tmp_path):
    size = Counter(open(RANKS, "rb").read()).encoding.encode_ordinary
    kind = "doc_id long, text string, edits array<struct<at: int, length: int, text: string>>, tree string, n_tokens int"
    rows = spark.createDataFrame([(i, t, e, "t", 9) for i, (t, e) in enumerate(EDITED)] + [(None, "a b", None, "t", 9)], kind)
    found = {r.doc_id: r.n_tokens_edited for r in token_counts(rows, RANKS).collect()}
    assert found == {**{i: len(size(t)) for i, t in enumerate(AFTER)}, None: 2}
    counted_trees(rows, RANKS).write.parquet(f"{tmp_path}/trees")
    for turn, edits in enumerate(("edits", "array(struct(0 as at, 0 as length, 'before ' as text))")):
        trees = spark.read.parquet(f"{tmp_path}/trees" if not turn else f"{tmp_path}/edited").select("doc_id", "tree")
        joined = trees.join(rows.select("doc_id", F.expr(edits).alias("edits")), "doc_id", "left")
        edited_trees(joined, RANKS).write.mode("overwrite").parquet(f"{tmp_path}/edited{turn or ''}")
    texts = {r.doc_id: ("".join(x.text for x in r.tree), r.n_tokens, r.n_recounted) for r in spark.read.parquet(f"{tmp_path}/edited1").collect()}
    for i, text in enumerate(AFTER):
        assert texts[i][:2] == (f"before {text}", len(size(f"before {text}"))) and texts[i][2] < 20
    assert texts[None][:2] == ("a b", 2)


@pytest.fixture(scope="module")
def judged():
    c = duckdb.connect()
    return c.execute("select doc_id, quality, toxic from read_parquet('/root/testdata/sf0.01/labels.parquet')").fetchdf()


@pytest.mark.parametrize("name, column, least", [("op2_quality_score", "quality", 0.95), ("op10_toxicity", "toxic", 0.95)])
def test_held_out_accuracy(spark, judged, name, column, least):
    found = queries.QUERIES[name](spark, "/root/testdata/sf0.01").where("held_out").toPandas().merge(judged, on="doc_id")
    assert len(found) > 50 and (found.predicted == found[column]).mean() >= least


def test_verdicts_follow_from_the_rules(spark, judged):
    """kept restated: a text fails by the base rule, or by the first learned rule that its statistics meet."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality_rules(docs, labels).toPandas().set_index("doc_id")
    stats = statistics(docs)
    rules = learned_rules(stats, labels)
    values = stats.select("doc_id", *(c.cast("double").alias(k) for k, c in ratios().items())).toPandas().set_index("doc_id")
    base = (found.n_words < 50) | (100 * found.n_repeat_words > 50 * found.n_words)
    rejected = pd.Series(False, found.index)
    for rule in rules:
        meets = pd.Series(True, found.index)
        for name, above, value in rule.conditions:
            own = values[name].reindex(found.index)
            meets &= own >= value if above else own < value
        rejected |= meets
    assert rules and (found.base_failed == base).all() and (found.kept == ~base & ~rejected).all()
    both = found[~base].merge(judged, left_index=True, right_on="doc_id")
    assert (both.kept == (both.quality == 1)).mean() >= 0.95


def test_licenses_against_brute_force(spark):
    from sidelines.llm.licenses import NOTICES

    table = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    plain = lambda t: re.findall("[a-z0]+", re.sub("[1-9]", "0", t.lower()))
    grams = lambda t: {tuple(w[i : i + 3]) for w in [plain(t)] for i in range(len(w) - 2)}
    needed = {name: grams(text) for name, text in NOTICES}
    expected = set()
    for doc_id, text in zip(table.doc_id, table.text, strict=True):
        own = grams(text or "")
        expected |= {(int(doc_id), name) for name, need in needed.items() if len(need & own) >= 0.8 * len(need)}
    found = {(r.doc_id, r.license) for r in queries.op7_licenses(spark, "/root/testdata/sf0.001").collect()}
    assert expected and found == expected
