"""Counts of the quality rules against brute force, and operators on empty tables."""

import random
import re
from collections import Counter

from sidelines.llm.chat import conversation_digests, formatted_turns, text_parts
from sidelines.llm.quality import quality_scores
from sidelines.llm.queries import TOKENIZERS
from sidelines.llm.rules import quality_rules
from sidelines.llm.token_counts import repeated_line_edits, token_counts
from sidelines.llm.toxicity import toxicity_scores

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


def counts(text):
    w = WORD.findall(text or "")
    triples = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    repeated = {p for k in range(len(w) - 2) if triples[tuple(w[k : k + 3])] > 1 for p in range(k, k + 3)}
    lines, seen, again = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), again, len(repeated), failed, not failed


def test_counts_of_quality_rules(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abé漢#*$%&|<>😀") for _ in range(rng.randint(1, 3)))
    texts = []
    for _ in range(120):
        few = [word() for _ in range(rng.choice([2, 5, 400]))]
        lines = [" ".join(rng.choice(few) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 16))]
        texts.append(rng.choice(["\n", "\n\n", "\r\n", " \n"]).join(lines + rng.choices(lines, k=rng.randint(0, 3))))
    texts += [None, "", "\n\n \n", "a", "a b c a b c", "x\ny\nx", " x\nx", " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(49)), "word " * 30_000]
    rows = [(i, t, -1) for i, t in enumerate(texts)] + [(None, texts[0], -1), (3, texts[3], -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int").repartition(3)
    found = quality_rules(docs, spark.createDataFrame([], LABELS))
    assert found.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(((i, *counts(t)) for i, t, _ in rows), key=str)


def test_models_and_counts_take_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    for labels in (spark.createDataFrame([], LABELS), spark.createDataFrame([(1, 1, 0), (2, 0, 1)], LABELS)):
        assert quality_scores(docs, labels).count() == 0
        assert quality_rules(docs, labels).count() == 0
        assert toxicity_scores(docs, labels).count() == 0
    assert token_counts(repeated_line_edits(docs), f"{TOKENIZERS}/byte_bpe_50k.tiktoken").count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_digests(formatted_turns(text_parts(turns))).count() == 0
