"""Chat formatting: typed content parts, visited in order, become one escaped turn with placeholders.

Template of a turn: <|turn|>ROLE<|body|>BODY<|end|> and a line feed. In roles and texts `\\`, `<` and `[` are written
`\\\\`, `\\l` and `\\b`, so no text can hold a control string of this template or another's (`</s>`, `[INST]`), and
unescape() gives every text back. Parts other than text become <|image:K|>, <|audio:K|>, <|document:K|> or
<|file:K|>, K counting the turn's attachments; each is recorded with its reference and the tokens it expands to.
The loss mask covers the texts of assistant turns.

Turns of a conversation are ordered by turn, role and unescaped body, nulls first. Null text is empty and has a body; a null
role is the empty role; null conv_ids are one conversation; null parts are skipped; parts without a size expand to
one token. Rows that repeat are turns of their own; empty tables give no rows; other columns are not read.

A turn is formatted where it is read. Only the digests of whole conversations need the turns of one together:
they stream in order through running hashes, so a conversation of any length takes constant memory.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from attestor.llm.common import batch, lean

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
SHAPE = re.compile(r"<\|turn\|>(.*?)<\|body\|>(.*?)<\|end\|>\n", re.S)
PLACEHOLDER = re.compile(r"<\|(?:image|audio|document|file):\d+\|>")
PATCH, AUDIO_TOKENS_A_SECOND, TOKENS_A_PAGE = 28, 25, 256
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<ordinal:int,kind:string,ref:string,tokens:bigint>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l").replace("[", "\\b")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"l": "<", "b": "["}.get(m[1], m[1]), text, flags=re.S)


class PartVisitor:
    """Flattens the parts of one turn. visit() goes by the part's type; what it doesn't know is a file."""

    def __init__(self):
        self.body: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part.get('type')}", self.visit_file)(part)

    def visit_text(self, part: dict) -> None:
        self.body.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, math.ceil((part.get("width") or 1) / PATCH) * math.ceil((part.get("height") or 1) / PATCH))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0) * AUDIO_TOKENS_A_SECOND))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 0) * TOKENS_A_PAGE)

    def visit_file(self, part: dict) -> None:
        self._attach("file", part, 1)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        ordinal = len(self.attachments)
        self.attachments.append({"ordinal": ordinal, "kind": kind, "ref": part.get("ref"), "tokens": max(1, int(tokens))})
        self.body.append(f"<|{kind}:{ordinal}|>")


def format_turn(role: str | None, parts: list[dict | None] | None) -> tuple[str, list[dict]]:
    visitor = PartVisitor()
    for part in parts or []:
        visitor.visit(part)
    return f"{TURN}{escape(role or '')}{BODY}{''.join(visitor.body)}{END}", visitor.attachments


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn; placeholders are left out of the text."""
    return [(unescape(role), unescape(PLACEHOLDER.sub("", body))) for role, body in SHAPE.findall(formatted)]


def format_turns(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str | None = "text", parts_col: str | None = None) -> DataFrame:
    """conv_id, turn, role, formatted, loss (the body is under the mask), attachments, expanded_tokens for each row.

    Content is parts_col (an array of PART) if given, else text_col as one text part.
    """
    parts = F.col(parts_col).cast(f"array<{PART}>") if parts_col else F.array(F.struct(F.lit("text").alias("type"), F.col(text_col).cast("string").alias("text")))
    out = StructType.fromDDL(f"conv_id long, turn long, role string, formatted string, loss boolean, attachments array<{ATTACHMENT}>, expanded_tokens long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        for b in batches:
            roles = b.column("role").to_pylist()
            found = [format_turn(r, p) for r, p in zip(roles, b.column("parts").to_pylist(), strict=True)]
            yield batch(schema, b.column("conv_id"), b.column("turn"), b.column("role"), [f for f, _ in found], [r == "assistant" for r in roles], [a for _, a in found], [sum(x["tokens"] for x in a) for _, a in found])

    return turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), parts.alias("parts")).mapInArrow(lean(run), out)


def plain_body(formatted: str = "formatted") -> Column:
    """A formatted turn's unescaped body. A raw `[` never stands in it, so that can hold a backslash's place."""
    f = F.col(formatted)
    body = F.substring(f, F.instr(f, BODY) + len(BODY), F.length(f) - F.instr(f, BODY) - (len(BODY) + len(END) - 1))
    for escaped, held in (("\\\\", "["), ("\\l", "<"), ("\\b", "\\")):
        body = F.replace(body, F.lit(escaped), F.lit(held))
    return F.translate(body, "[\\", "\\[")


def digest_conversations(formatted: DataFrame, partitions: int | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted turns."""
    out = StructType.fromDDL("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, open_, done = to_arrow_schema(out), None, []

        def close() -> None:
            done.append((open_[0], open_[1], open_[2].hexdigest(), open_[3], open_[4].hexdigest(), open_[5]))

        for b in batches:
            for conv, text, loss in zip(b.column("conv_id").to_pylist(), b.column("formatted").to_pylist(), b.column("loss").to_pylist(), strict=True):
                if open_ is None or open_[0] != conv:
                    if open_ is not None:
                        close()
                    open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in read_back(text):
                    open_[1] += 1
                    open_[2].update(f"{role}\n{body}\n".encode())
                    if loss:
                        open_[3] += len(body)
                        open_[4].update(body.encode())
                open_[5] += len(text)
            if done:
                yield batch(schema, *zip(*done, strict=True))
                done = []
        if open_ is not None:
            close()
            yield batch(schema, *zip(*done, strict=True))

    rows = formatted.select("conv_id", "turn", "role", "formatted", "loss")
    rows = rows.repartition(partitions, "conv_id") if partitions else rows.repartition("conv_id")
    return rows.sortWithinPartitions("conv_id", "turn", "role", plain_body()).mapInArrow(lean(run), out)
