"""Chat formatting of messages made of typed content parts.

A visitor has one method per kind of part and turns each part into what stands for it in
the text: escaped text, or a placeholder with the reference of the attachment and the
number of tokens that a model puts in its place.  The formatted conversation is a row
per message, in order: pieces of bounded size that concatenate to the whole, with their
offset, so that no task ever holds a conversation.

Marks and placeholders are control strings.  Wherever one begins inside a text, a
backslash is put behind its first character, and backslashes are doubled; so a text
never holds a control string, and ``unescape`` gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches

# The parts of a message.  Fields that a kind does not use are null.
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

_FOREIGN = ("<s>", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>")


@dataclass(frozen=True)
class Template:
    """Marks around the messages of each role; other roles are named between two marks."""

    roles: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")}
    )
    other: tuple[str, str, str] = ("[ROLE]", "[SAYS]", "[/SAYS]")
    placeholders: dict[str, str] = field(
        default_factory=lambda: {"image": "[IMAGE]", "audio": "[AUDIO]", "document": "[DOCUMENT]", "unknown": "[PART]"}
    )
    learned: tuple[str, ...] = ("assistant",)
    foreign: tuple[str, ...] = _FOREIGN

    def __post_init__(self) -> None:
        """Refuse marks that could arise across the border of a mark and a text."""
        marks = [m for pair in self.roles.values() for m in pair] + [*self.other, *self.placeholders.values()]
        own = [pair[0] for pair in self.roles.values()] + [self.other[0], *self.placeholders.values()]
        if len(set(own)) < len(own):
            raise ValueError("two marks of the template are alike")
        for control in self.controls:
            if len(control) < 2 or "\\" in control or "\n" in control:
                raise ValueError(f"not a control string: {control!r}")
            for mark in marks:
                meet = any(control.endswith(mark[:k]) or mark.endswith(control[:k]) for k in range(1, min(len(control), len(mark))))
                if meet or (mark in control and mark != control):
                    raise ValueError(f"{mark!r} may run into {control!r}")

    @property
    def controls(self) -> tuple[str, ...]:
        pairs = [m for pair in self.roles.values() for m in pair]
        return tuple(dict.fromkeys([*pairs, *self.other, *self.placeholders.values(), *self.foreign]))

    def escape(self, text: Column) -> Column:
        begins = "|".join(re.escape(c) for c in self.controls)
        doubled = F.regexp_replace(text, r"\\", r"\\\\")
        return F.regexp_replace(doubled, f"(?=(?:{begins}))(.)", r"$1\\")


@dataclass(frozen=True)
class Costs:
    """Tokens that stand for an attachment once it is expanded."""

    image_tile: int = 512
    tokens_per_tile: int = 170
    image_base: int = 85
    audio_tokens_per_second: float = 25.0
    tokens_per_page: int = 560


class Flatten:
    """The visitor: ``visit`` dispatches a part to the method named by its kind.

    Each method returns (piece, ref, tokens) as Columns; kinds without a method go to
    ``unknown``.  A subclass adds kinds by adding methods and their placeholders.
    """

    kinds = ("text", "image", "audio", "document")

    def __init__(self, template: Template, costs: Costs | None = None):
        self.template, self.costs = template, costs or Costs()

    def text(self, part: Column) -> tuple[Column, Column, Column]:
        return self.template.escape(F.coalesce(part["text"], F.lit(""))), F.lit(None), F.lit(None)

    def image(self, part: Column) -> tuple[Column, Column, Column]:
        tiles = lambda side: F.ceil(F.greatest(F.coalesce(side, F.lit(1)), F.lit(1)) / self.costs.image_tile)
        tokens = self.costs.image_base + self.costs.tokens_per_tile * tiles(part["width"]) * tiles(part["height"])
        return F.lit(self.template.placeholders["image"]), part["ref"], tokens

    def audio(self, part: Column) -> tuple[Column, Column, Column]:
        seconds = F.greatest(F.nanvl(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
        return F.lit(self.template.placeholders["audio"]), part["ref"], F.ceil(seconds * self.costs.audio_tokens_per_second)

    def document(self, part: Column) -> tuple[Column, Column, Column]:
        pages = F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1))
        return F.lit(self.template.placeholders["document"]), part["ref"], pages * self.costs.tokens_per_page

    def unknown(self, part: Column) -> tuple[Column, Column, Column]:
        return F.lit(self.template.placeholders["unknown"]), part["ref"], F.lit(0)

    def visit(self, part: Column) -> Column:
        def shaped(found: tuple[Column, Column, Column]) -> Column:
            piece, ref, tokens = found
            return F.struct(
                piece.alias("piece"), part["kind"].alias("kind"), ref.cast("string").alias("ref"), tokens.cast("long").alias("tokens")
            )

        chosen = shaped(self.unknown(part))
        for kind in self.kinds:
            chosen = F.when(part["kind"] == kind, shaped(getattr(self, kind)(part))).otherwise(chosen)
        return chosen


def text_part(text: Column) -> Column:
    """Plain text as the only part of a message."""
    none = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(
        F.struct(F.lit("text").alias("kind"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in none.items()])
    )


def format_messages(messages: DataFrame, template: Template | None = None, visitor: Flatten | None = None) -> DataFrame:
    """One row per message: conv_id, turn, role, formatted, loss, attachments, attachment_tokens.

    ``messages``: conv_id, turn, role, parts (array of ``PART``); other columns are left
    out.  ``formatted`` is the piece of the message; the pieces of a conversation by
    (turn, role, formatted), nulls first, are its formatted text.  ``loss`` is the
    stretch [start, end) of code points in the piece that is learned from, null unless
    the role is one of ``template.learned``.  ``attachments`` lists kind, ref, place (in
    the piece, code points) and tokens of each placeholder, in order.

    A null role is an empty one, null parts, no parts and null text an empty text.
    Repeated rows are formatted as often as they come; no rows give no rows.
    """
    template = template or Template()
    visitor = visitor or Flatten(template)
    role = F.coalesce("role", F.lit(""))
    opened = F.concat(F.lit(template.other[0]), template.escape(role), F.lit(template.other[1]))
    closed = F.lit(template.other[2])
    for name, (before, after) in template.roles.items():
        opened = F.when(role == name, F.lit(before)).otherwise(opened)
        closed = F.when(role == name, F.lit(after)).otherwise(closed)
    flat = messages.select(
        "conv_id",
        "turn",
        role.alias("role"),
        opened.alias("_open"),
        closed.alias("_close"),
        F.transform(F.coalesce("parts", F.array().cast(f"array<{PART}>")), visitor.visit).alias("_flat"),
    )
    # Two texts side by side must not form a control string: a lone backslash parts them.
    parted = flat.withColumn(
        "_flat",
        F.transform(
            "_flat",
            lambda p, i: F.when(
                (i > 0) & p["tokens"].isNull() & (p["piece"] != ""), p.withField("piece", F.concat(F.lit("\\"), p["piece"]))
            ).otherwise(p),
        ),
    )
    start = F.length("_open").cast("long")
    none = F.array().cast("array<struct<kind:string,ref:string,place:long,tokens:long>>")
    listed = F.aggregate(
        "_flat",
        F.struct(start.alias("at"), none.alias("found")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["piece"])).alias("at"),
            F.when(
                p["tokens"].isNotNull(),
                F.concat(
                    s["found"],
                    F.array(F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), s["at"].alias("place"), p["tokens"].alias("tokens"))),
                ),
            )
            .otherwise(s["found"])
            .alias("found"),
        ),
    )
    body = parted.select(
        "conv_id",
        "turn",
        "role",
        "_open",
        "_close",
        F.array_join(F.transform("_flat", lambda p: p["piece"]), "").alias("_body"),
        listed["found"].alias("attachments"),
    )
    stretch = F.struct(start.alias("start"), (start + F.length("_body")).alias("end"))
    return body.select(
        "conv_id",
        "turn",
        "role",
        F.concat("_open", "_body", "_close").alias("formatted"),
        F.when(F.col("role").isin(*template.learned), stretch).alias("loss"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"),
    )


_BROKEN = re.compile(r"\\(\\?)")


def unescape(text: str) -> str:
    """The text that was escaped."""
    return _BROKEN.sub(r"\1", text)


def reader(template: Template):
    """A function from a formatted piece to its messages: (role, [parts]).

    A part is (kind, text); placeholders have no text.
    """
    named = {before: name for name, (before, _) in template.roles.items()}
    kinds = {mark: kind for kind, mark in template.placeholders.items()}
    held = re.compile("|".join(re.escape(m) for m in sorted(kinds, key=len, reverse=True)))
    opening = re.compile("|".join(map(re.escape, [*named, template.other[0]])))

    def read(piece: str) -> list[tuple[str, list[tuple[str, str | None]]]]:
        at, out = 0, []
        while at < len(piece):
            mark = opening.match(piece, at)
            if not mark:
                raise ValueError(f"no message begins at {at}")
            at = mark.end()
            if mark[0] in named:
                role, close = named[mark[0]], template.roles[named[mark[0]]][1]
            else:
                end = piece.index(template.other[1], at)
                role, close, at = unescape(piece[at:end]), template.other[2], end + len(template.other[1])
            end = piece.index(close, at)
            body, parts, last = piece[at:end], [], 0
            for m in held.finditer(body):
                if m.start() > last:
                    parts.append(("text", unescape(body[last : m.start()])))
                parts.append((kinds[m[0]], None))
                last = m.end()
            if last < len(body):
                parts.append(("text", unescape(body[last:])))
            out.append((role, parts))
            at = end + len(close)
        return out

    return read


# Columns of ``read_back`` behind conv_id.
READ = (
    "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long,"
    " attachments long, attachment_tokens long"
)


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests per conversation, read back from the rows of ``format_messages``.

    Columns: conv_id and ``READ``.  turns_sha256 is of role, line feed, text, line feed per message;
    loss_sha256 of all text under the loss mask, unescaped, nothing between.  Pieces
    stream through a task in order: it holds one batch and two running digests, however
    long a conversation is.  The null conv_id is one conversation.
    """
    template = template or Template()
    bounded_batches(formatted.sparkSession)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader(template)
        out: list[tuple] = []
        key: pa.DataType = pa.null()
        conv, turns, loss, sums = None, None, None, [0, 0, 0, 0, 0]

        def close() -> None:
            n, learned, chars, attached, tokens = sums
            out.append((conv, n, turns.hexdigest(), learned, loss.hexdigest(), chars, attached, tokens))

        def rows() -> pa.RecordBatch:
            kinds = [key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            names = ["conv_id", *(f.split()[0] for f in READ.split(", "))]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            key = batch.schema.field("conv_id").type
            columns = [batch.column(name).to_pylist() for name in ("conv_id", "formatted", "start", "end", "attached", "tokens")]
            for own, piece, start, end, attached, tokens in zip(*columns, strict=True):
                if turns is None or own != conv:
                    if turns is not None:
                        close()
                    conv, turns, loss, sums = own, hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0, 0]
                for role, parts in read(piece):
                    text = "".join(t for _, t in parts if t is not None)
                    turns.update(f"{role}\n{text}\n".encode())
                    sums[0] += 1
                if start is not None:
                    learned = "".join(t for _, t in _parts(piece[start:end], template) if t is not None)
                    loss.update(learned.encode())
                    sums[1] += len(learned)
                sums[2] += len(piece)
                sums[3] += attached
                sums[4] += tokens
            yield rows()
        if turns is not None:
            close()
            yield rows()

    pieces = formatted.select(
        "conv_id",
        "turn",
        "role",
        "formatted",
        F.col("loss.start").alias("start"),
        F.col("loss.end").alias("end"),
        F.size("attachments").cast("long").alias("attached"),
        F.col("attachment_tokens").alias("tokens"),
    )
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    return ordered.mapInArrow(stream, f"conv_id {formatted.schema['conv_id'].dataType.simpleString()}, {READ}")


def _parts(body: str, template: Template) -> list[tuple[str, str | None]]:
    """Parts of a bare body, which stands between no marks."""
    before, after = next(iter(template.roles.values()))
    return reader(template)(f"{before}{body}{after}")[0][1]
