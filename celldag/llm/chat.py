r"""Chat formatting with typed content parts.

A visitor flattens each turn's parts in order.  Text is escaped; an image, audio clip or document
becomes a placeholder, and an attachment row records its kind, reference, place and how many
tokens the placeholder expands to.  The template of a turn is

    [ROLE]role[/ROLE][INST]content[/INST]      for any role but assistant
    [ROLE]assistant[/ROLE]content</s>          for the assistant, whose content is the loss mask

and ``<s>`` opens a conversation.  Inside texts and roles a control string gets a backslash
after its first character and a backslash is doubled, so no control string is left there
and `parse` gives back the very texts.

One output row per turn, in order; a conversation's formatted text is its turns' texts one after
the other.  So a conversation of any length needs no row or group that holds it whole.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from celldag.llm.common import slices, texts_of

#: The control strings of the template.
CONTROL = ("<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]", "[IMAGE]", "[AUDIO]", "[DOCUMENT]")
_SPECIAL = re.compile("|".join([r"\\", *map(re.escape, CONTROL)]))
_ESCAPED = re.compile(r"\\(.?)", re.S)
_CONTROL = re.compile("(" + "|".join(map(re.escape, CONTROL)) + ")")

PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
OUT = "formatted string, n_tokens_extra long, attachments array<struct<kind: string, ref: string, at: int, tokens: long>>"


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    # A doubled backslash is one; a single one stands only inside a control string.
    return _ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else m[1], text)


@dataclass
class Flattener:
    """Visits parts in order.  Tokens: an image one per started patch, audio per started frame, a document per page."""

    patch: int = 14
    seconds_per_token: float = 0.04
    tokens_per_page: int = 256
    content: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict | None) -> None:
        kind = (part or {}).get("kind") or "text"
        getattr(self, f"visit_{kind}", self.visit_other)(part or {})

    def visit_text(self, part: dict) -> None:
        self.content.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self.place(part, "[IMAGE]", -(-int(part.get("width") or 0) // self.patch) * -(-int(part.get("height") or 0) // self.patch))

    def visit_audio(self, part: dict) -> None:
        self.place(part, "[AUDIO]", -int(-(part.get("seconds") or 0.0) // self.seconds_per_token))

    def visit_document(self, part: dict) -> None:
        self.place(part, "[DOCUMENT]", int(part.get("pages") or 0) * self.tokens_per_page)

    def visit_other(self, part: dict) -> None:
        raise ValueError(f"unknown kind of content part: {part.get('kind')!r}")

    def place(self, part: dict, mark: str, tokens: int) -> None:
        self.attachments.append({"kind": part["kind"], "ref": part.get("ref"), "at": sum(map(len, self.content)), "tokens": max(1, tokens)})
        self.content.append(mark)


def format_turn(role: str, parts: list[dict]) -> tuple[str, int, list[dict]]:
    """A turn's formatted text, how many tokens its placeholders add, and its attachments."""
    flat = Flattener()
    for part in parts:
        flat.visit(part)
    content = "".join(flat.content)
    body = f"{content}</s>" if role == "assistant" else f"[INST]{content}[/INST]"
    return f"[ROLE]{escape(role)}[/ROLE]{body}", sum(a["tokens"] for a in flat.attachments), flat.attachments


def parse(formatted: str) -> list[tuple[str, str, bool]]:
    """(role, content, in the loss mask) of every turn of a formatted text; placeholders stay in the content."""
    turns, role, content, state = [], "", [], ""
    for i, piece in enumerate(_CONTROL.split(formatted)):
        if i % 2 == 0:
            if state == "role":
                role += unescape(piece)
            elif state:
                content.append(unescape(piece))
        elif piece == "[ROLE]":
            role, content, state = "", [], "role"
        elif piece == "[/ROLE]":
            state = "content"
        elif piece in ("</s>", "[/INST]"):
            turns.append((role, "".join(content), piece == "</s>"))
            state = ""
        elif piece not in ("<s>", "[INST]"):
            content.append(piece)
    return turns


def text_parts(text: str = "text"):
    """A plain text column as content parts: one text part, its text empty where null."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(F.col(text), F.lit("")).alias("text")))


def format_chat(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, parts (array of PART's fields, kind and text at least) to conv_id, turn, pos and OUT, a row per turn.

    Order in a conversation: turn, then role, then formatted text; nulls come first, and a null
    conv_id is a conversation of its own.  Repeated rows stay.  A null role is the empty role,
    null parts are no parts.  pos counts turns from 0; an attachment's place counts code points
    of its turn's content.  Turns are formatted where they lie; only then are they sorted.
    """
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in turns.select("conv_id", "turn").schema)
    attached = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", pa.int64())]))

    def run(batches):
        for batch in slices(batches):
            out = [format_turn(r, ps or []) for r, ps in zip(texts_of(batch, "role"), batch.column("parts").to_pylist())]
            yield pa.RecordBatch.from_pydict(
                {c: batch.column(c) for c in ("conv_id", "turn", "role")}
                | {"formatted": pa.array([o[0] for o in out], pa.string()), "n_tokens_extra": pa.array([o[1] for o in out], pa.int64()), "attachments": pa.array([o[2] for o in out], attached)}
            )

    done = turns.select("conv_id", "turn", "role", "parts").mapInArrow(run, f"{kinds}, role string, {OUT}")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "formatted")
    done = done.withColumn("pos", F.row_number().over(order) - 1)
    opened = F.when(F.col("pos") == 0, F.concat(F.lit("<s>"), "formatted")).otherwise(F.col("formatted"))
    return done.select("conv_id", "turn", "pos", opened.alias("formatted"), "n_tokens_extra", "attachments")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted turns: turn count, hashes and lengths.

    A hash over a whole conversation is sequential by nature.  Rows come to the hasher sorted
    (Spark sorts on disk) and it keeps one running hash, never a conversation's rows.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches):
        now, turns, loss = object(), None, None
        n = chars = masked = 0
        done: list[tuple] = []

        def rows(kind):
            columns = zip(*done)
            types = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in slices(batches):
            kind = batch.schema.field("conv_id").type
            for conv, text in zip(batch.column("conv_id").to_pylist(), texts_of(batch, "formatted")):
                if conv != now:
                    if turns is not None:
                        done.append((now, n, turns.hexdigest(), masked, loss.hexdigest(), chars))
                    now, turns, loss = conv, hashlib.sha256(), hashlib.sha256()
                    n = chars = masked = 0
                chars += len(text)
                for role, content, in_loss in parse(text):
                    n += 1
                    turns.update(f"{role}\n{content}\n".encode("utf-8", "replace"))
                    if in_loss:
                        masked += len(content)
                        loss.update(content.encode("utf-8", "replace"))
            if done:
                yield rows(kind)
                done = []
        if turns is not None:
            done.append((now, n, turns.hexdigest(), masked, loss.hexdigest(), chars))
            yield rows(kind)

    sorted_rows = formatted.select("conv_id", "pos", "formatted").repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return sorted_rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
