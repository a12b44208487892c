"""Chat formatting with typed content parts.

A turn becomes ``<|turn|>role<|text|>content<|end|>`` and a line break. Inside roles and contents a
backslash is doubled and ``<|`` becomes ``<\\|``, so no text can look like a mark, and
dropping the backslash before each escaped character gives the text back. A visitor flattens the parts of a content
in order: text is escaped, and an attachment leaves a numbered mark and a record with its
reference and the number of tokens that it expands to.

Turns are formatted row by row; a conversation is the concatenation of its turns in order, and is
never put together in memory.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Roles whose text is learnt.
LEARNT = ("assistant",)
#: Typed parts: text has ``text``; image ``ref``, ``width``, ``height``; audio ``ref``, ``seconds``; document ``ref``, ``pages``.
PARTS = (
    "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
)
FORMATTED = (
    "conv_id long, turn long, role string, tie string, output string, loss_start long, loss_end long, "
    "attachments array<struct<kind:string,ref:string,place:int,tokens:long>>, attachment_tokens long"
)
_MARKED = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class Flattener:
    """Visits the parts of one content; ``patch`` pixels, ``rate`` tokens a second and ``page`` tokens a page."""

    def __init__(self, patch: int = 28, rate: float = 25.0, page: int = 500):
        self.patch, self.rate, self.page = patch, rate, page
        self.pieces: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type')}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        across, down = (math.ceil(max(0, part.get(side) or 0) / self.patch) for side in ("width", "height"))
        self._attach("image", part, across * down)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil(max(0.0, part.get("seconds") or 0.0) * self.rate))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(0, part.get("pages") or 0) * self.page)

    def visit_other(self, part: dict) -> None:
        """Parts of an unknown type keep their place and reference, and expand to nothing."""
        self._attach("other", part, 0)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.pieces.append(f"<|{kind}:{len(self.attachments)}|>")
        self.attachments.append(
            {"kind": kind, "ref": part.get("ref"), "place": len(self.attachments), "tokens": tokens}
        )


def format_turn(role: str, parts: list[dict]) -> tuple[str, int | None, int | None, list[dict]]:
    """The turn's output, start and end of what is learnt of it (code points), and its attachments."""
    flat = Flattener()
    for part in parts:
        flat.visit(part)
    head, content = f"{TURN}{escape(role)}{TEXT}", "".join(flat.pieces)
    learnt = (len(head), len(head) + len(content)) if role in LEARNT else (None, None)
    return head + content + END, *learnt, flat.attachments


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per row of ``turns`` (conv_id, turn, role and text, or parts of type ``PARTS``), with columns ``FORMATTED``.

    Null texts, roles and parts are empty; a null conv_id is a conversation of its own and a
    null turn comes first. Turns of equal number are ordered by role and output (``tie``
    is its digest); repeated rows repeat. Other columns are ignored; an empty table gives no rows.
    """
    wanted = _parse_datatype_string(FORMATTED)
    arrow = to_arrow_schema(wanted)
    content = (
        F.col("parts").cast(PARTS)
        if "parts" in turns.columns
        else F.array(F.struct(F.lit("text").alias("type"), F.col("text").cast("string").alias("text")))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = []
                for row in batch.slice(at, 1000).to_pylist():
                    role = row["role"] or ""
                    output, start, end, attached = format_turn(role, [p for p in row["parts"] or [] if p])
                    tie = hashlib.sha256(output.encode()).hexdigest()
                    tokens = sum(a["tokens"] for a in attached)
                    rows.append((row["conv_id"], row["turn"], role, tie, output, start, end, attached, tokens))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow
                )

    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        content.alias("parts"),
    ).mapInArrow(run, wanted)


_READ = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "n_attachments long"
)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation of ``format_turns``: number and digest of its turns, size and digest of what is learnt.

    Everything is parsed from the output. A conversation's turns arrive in order in one task, which
    digests them one at a time: however long it is, no more than a batch is held.
    """
    wanted = _parse_datatype_string(_READ)
    arrow = to_arrow_schema(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, done = None, []

        def close() -> None:
            if current is not None:
                key, n, turns, chars, loss, size, attached = current
                done.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), size, attached))

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)
            done.clear()
            return made

        for batch in batches:
            for key, output, start, end in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if current is None or current[0] != key:
                    close()
                    current = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                role, content = _MARKED.fullmatch(output).groups()
                current[1] += 1
                current[2].update(f"{unescape(role)}\n{unescape(content)}\n".encode())
                if start is not None:
                    text = unescape(output[start:end])
                    current[3] += len(text)
                    current[4].update(text.encode())
                current[5] += len(output)
                current[6] += len(re.findall(r"<\|\w+:\d+\|>", content))
            if len(done) >= 1000:
                yield flush()
        close()
        if done:
            yield flush()

    return (
        formatted.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "tie")
        .select("conv_id", "output", "loss_start", "loss_end")
        .mapInArrow(run, wanted)
    )
