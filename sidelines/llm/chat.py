"""Chat formatting: typed content parts become one text with placeholders, and conversations one marked-up stream."""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's marks. Inside texts a backslash is put before a bar that follows "<" and before backslashes.
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
PARTS = "array<struct<kind: string, text: string, ref: string, size: long>>"
#: Tokens that one attachment stands for: a fixed count, or size divided by a unit (pixels, milliseconds, characters).
EXPANSION = {"image": (85, 196), "audio": (1, 40), "document": (1, 4)}


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str, letters: dict[str, str] = {}) -> str:  # noqa: B006
    out, at = [], 0
    while (to := text.find("\\", at)) >= 0 and to + 1 < len(text):
        out += [text[at:to], letters.get(text[to + 1], text[to + 1])]
        at = to + 2
    return "".join([*out, text[at:]])


def escape_role(role: str) -> str:
    """A role ends at the first line break, so its own become a backslash and an n."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(role, {"n": "\n"})


@dataclass
class Flattener:
    """Visits the parts of one turn in order."""

    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict | None) -> None:
        kind = ((part or {}).get("kind") or "text").lower()
        getattr(self, f"visit_{kind}", self.visit_unknown)(part or {})

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def visit_unknown(self, part: dict) -> None:
        self.visit_text(part)

    def _attach(self, kind: str, part: dict) -> None:
        number = 1 + sum(x["kind"] == kind for x in self.attachments)
        least, unit = EXPANSION[kind]
        self.pieces.append(f"<|{kind}_{number}|>")
        self.attachments.append({"kind": kind, "number": number, "ref": part.get("ref"), "tokens": least + max(0, part.get("size") or 0) // unit})

    def visit_image(self, part: dict) -> None:
        self._attach("image", part)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part)


ATTACHMENTS = "array<struct<kind: string, number: int, ref: string, tokens: long>>"
_KIND = pa.list_(pa.struct([("kind", pa.string()), ("number", pa.int32()), ("ref", pa.string()), ("tokens", pa.int64())]))


def formatted_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, formatted, attachments) of each row of turns(conv_id, turn, role, parts).

    Text parts are escaped, other parts become numbered placeholders in place, with their reference and the tokens they
    expand to; a part of an unknown or null kind counts as text, null parts as none, a null role as "". Line breaks in roles
    are escaped too. Each row gives one, repeated rows one each; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, attached = [], []
            for role, content in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                flat = Flattener()
                for part in content or []:
                    flat.visit(part)
                texts.append(f"{BEGIN}{escape_role(role or '')}\n{''.join(flat.pieces)}{END}")
                attached.append(flat.attachments)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string()), pa.array(attached, _KIND)], ["conv_id", "turn", "role", "formatted", "attachments"])

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("parts").cast(PARTS).alias("parts"))
    return rows.mapInArrow(run, f"conv_id long, turn long, role string, formatted string, attachments {ATTACHMENTS}")


def text_parts(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) as rows of one text part."""
    part = F.struct(F.lit("text").alias("kind"), F.col("text").cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("size"))
    return turns.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def parse(formatted: str) -> tuple[str, str]:
    """Role and text that a formatted turn holds; placeholders stay as they are."""
    role, _, text = formatted[len(BEGIN) : -len(END)].partition("\n")
    return unescape_role(role), unescape(text)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """One row per conv_id of formatted_turns(), read back from the formatted text: n_turns, turns_sha256 (role, line
    break, text, line break of every turn), loss_chars and loss_sha256 (all assistant texts in order), formatted_chars.

    Turns come in order of turn, role and text (nulls first), repeated ones as often as they are there; a null conv_id is
    a conversation of its own. Rows are sorted by conversation and digested as they stream by, so a conversation may be
    of any length; nothing of it is held but the digests' states.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        key: object = run  # no conversation yet
        turns, loss, counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]

        def close() -> None:
            if key is not run:
                rows.append((key, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]))

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key is run or conv != key:
                    close()
                    key, turns, loss, counts = conv, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                role, said = parse(text)
                turns.update(f"{role}\n{said}\n".encode())
                counts[0] += 1
                counts[2] += len(text)
                if role == "assistant":
                    loss.update(said.encode())
                    counts[1] += len(said)
            yield flush()
            rows.clear()
        close()
        yield flush()

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted").select("conv_id", "formatted")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
