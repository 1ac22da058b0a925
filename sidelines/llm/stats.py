"""Counts over whole texts that the quality operators share."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidelines.llm.text import NOT_SPACE, Words, mix, parts, runs_hash

_all = np.arange(256)
_LINE = _all != 0x0A
#: Classes of bytes that are counted; n_chars counts code points (bytes that begin one).
CLASSES = {
    "n_chars": (_all & 0xC0) != 0x80,
    "n_symbols": np.isin(_all, [ord(c) for c in "#*$%&|<>]"]),
    "n_upper": (_all >= 65) & (_all <= 90),
    "n_lower": (_all >= 97) & (_all <= 122),
    "n_digits": (_all >= 48) & (_all <= 57),
    "n_bangs": np.isin(_all, [ord(c) for c in "!?"]),
    "n_bars": _all == ord("|"),
    "n_stops": np.isin(_all, [ord(c) for c in ".,;:"]),
    "n_breaks": _all == 0x0A,
    "n_beyond_ascii": _all >= 0xC0,
}
COLUMNS = ["n_words", "word_chars", *CLASSES, "n_lines", "n_dup_lines", "n_repeat_words"]


def _sums(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def _seen(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the same value stands earlier in the same text, and whether it stands there twice at all."""
    key = mix(value ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    earlier, twice = np.zeros(len(key), bool), np.zeros(len(key), bool)
    earlier[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return earlier, twice


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    w = Words(column)
    out = {"n_words": w.counts, "word_chars": _sums(w.inside & CLASSES["n_chars"][w.data], w.offsets)}
    out |= {name: _sums(of[w.data], w.offsets) for name, of in CLASSES.items()}
    lines = Words(column, _LINE)
    words_before = np.concatenate([[0], np.cumsum(w.inside, dtype=np.int64)])
    full = words_before[lines.end] > words_before[lines.start]
    earlier, _ = _seen(lines.doc[full], lines.hashes()[full])
    out["n_lines"] = _sums(full, lines.first)
    flags = np.zeros(len(lines), bool)
    flags[np.flatnonzero(full)[earlier]] = True
    out["n_dup_lines"] = _sums(flags, lines.first)
    triples = np.flatnonzero(w.left() >= 3)
    _, twice = _seen(w.doc[triples], runs_hash(w.hashes(), triples, 3))
    cover = np.zeros(len(w) + 3, np.int8)
    for k in range(3):
        cover[triples[twice] + k] = 1
    out["n_repeat_words"] = _sums(cover[: len(w)], w.first)
    return out


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COLUMNS (long) of each row of docs(doc_id, text). n_repeat_words counts words in three-word windows that
    stand twice in the text, n_dup_lines lines with a word that equal an earlier line. Null or empty texts: all 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = measure(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[c].astype(np.int64)) for c in COLUMNS)], ["doc_id", *COLUMNS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS))


def ratios() -> dict:
    """Scale-free columns of statistics()."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_chars"), F.lit(1))
    return {
        "log_words": F.log1p("n_words"),
        "word_length": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / chars,
        "upper_share": F.col("n_upper") / F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1)),
        "digit_share": F.col("n_digits") / chars,
        "bang_share": F.col("n_bangs") / words,
        "bar_share": F.col("n_bars") / words,
        "stop_share": F.col("n_stops") / words,
        "beyond_ascii_share": F.col("n_beyond_ascii") / chars,
        "words_per_line": F.log1p(words / F.greatest(F.col("n_lines"), F.lit(1))),
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
    }
