"""Sectioning, source typing and marked spans, all inside one row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.config import MARKER_CLOSE, MARKER_OPEN
from gleaner.functions.text import WS, WS_CLASS, bind, lines, strip

HEADING = rf"^#{{1,3}}{WS}+([^{WS_CLASS}].*)$"
TABLE_ROW = rf"^{WS}*\|.*\|{WS}*$"
CODE_FENCE = "```"


def infer_source_type(text: Column) -> Column:
    """``table``, ``code`` or ``prose`` from the shape of the lines."""

    def decide(ls: Column) -> Column:
        share = lambda test: F.size(F.filter(ls, test)) / F.greatest(F.size(ls), F.lit(1))
        indented = lambda x: F.startswith(x, F.lit("    ")) | F.startswith(x, F.lit("\t"))
        return (
            F.when(share(lambda x: x.rlike(TABLE_ROW)) > 0.4, "table")
            .when(F.contains(text, F.lit(CODE_FENCE)) | (share(indented) > 0.4), "code")
            .otherwise("prose")
        )

    return bind(lines(strip(text)), decide)


def sections(text: Column) -> Column:
    """``array<struct<heading,body>>``.

    Headings of level one to three separate sections; without any, blank lines
    separate paragraphs.  Separator positions are found first and the bodies
    sliced between them, which is linear in the number of lines.
    """

    def cut(ls: Column) -> Column:
        positions = F.sequence(F.lit(0), F.size(ls) - 1)
        heads = F.filter(positions, lambda i: F.get(ls, i).rlike(HEADING))
        blanks = F.filter(positions, lambda i: strip(F.get(ls, i)) == "")

        def build(h: Column) -> Column:
            has_heading = F.size(h) > 0
            seps = F.concat(
                F.array(F.lit(-1)), F.when(has_heading, h).otherwise(blanks)
            )
            return bind(
                seps,
                lambda sp: F.transform(
                    sp,
                    lambda s, j: F.struct(
                        F.when(
                            has_heading & (s >= 0),
                            strip(F.regexp_extract(F.get(ls, s), HEADING, 1)),
                        ).alias("heading"),
                        strip(
                            F.array_join(
                                F.slice(
                                    ls, s + 2, F.coalesce(F.get(sp, j + 1), F.size(ls)) - s - 1
                                ),
                                "\n",
                            )
                        ).alias("body"),
                    ),
                ),
            )

        return F.filter(bind(heads, build), lambda x: x["body"] != "")

    empty = F.expr("cast(array() as array<struct<heading:string,body:string>>)")
    return bind(lines(text), lambda ls: F.when(F.size(ls) > 0, cut(ls)).otherwise(empty))


def _span(group: str, marker_open: str, marker_close: str) -> str:
    # Quoted literally for both Java and RE2: only the angle brackets, the slash
    # and word characters occur in markers, re.escape leaves those readable.
    return f"(?s){re.escape(marker_open)}{group}{re.escape(marker_close)}"


def marked_inner(text: Column, marker_open: str = MARKER_OPEN, marker_close: str = MARKER_CLOSE) -> Column:
    """Contents of the marked spans, in text order."""
    return F.regexp_extract_all(text, F.lit(_span("(.*?)", marker_open, marker_close)), F.lit(1))


def marked_outer(text: Column, marker_open: str = MARKER_OPEN, marker_close: str = MARKER_CLOSE) -> Column:
    """Text around the marked spans: always one piece more than there are spans."""
    return F.split(text, _span(".*?", marker_open, marker_close), -1)


def marked_blocks(text: Column, marker_open: str = MARKER_OPEN, marker_close: str = MARKER_CLOSE) -> Column:
    """``array<struct<block_no,start,end,chunks>>`` with character offsets.

    A span that yields no section but holds text is one chunk; a blank span has
    no chunks.
    """

    def one(inner: Column) -> Column:
        return bind(
            sections(inner),
            lambda s: F.when(
                (F.size(s) == 0) & (strip(inner) != ""),
                F.array(
                    F.struct(F.lit(None).cast("string").alias("heading"), strip(inner).alias("body"))
                ),
            ).otherwise(s),
        )

    width = len(marker_open) + len(marker_close)

    def with_offsets(s: Column) -> Column:
        before = lambda arr, upto: F.aggregate(
            F.slice(arr, F.lit(1), upto), F.lit(0), lambda acc, x: acc + F.length(x)
        )
        return F.transform(
            s["inner"],
            lambda x, i: F.struct(
                i.alias("block_no"),
                (before(s["outer"], i + 1) + before(s["inner"], i) + i * width).alias("start"),
                (before(s["outer"], i + 1) + before(s["inner"], i + 1) + (i + 1) * width).alias("end"),
                one(x).alias("chunks"),
            ),
        )

    return bind(
        F.struct(
            marked_inner(text, marker_open, marker_close).alias("inner"),
            marked_outer(text, marker_open, marker_close).alias("outer"),
        ),
        with_offsets,
    )


def strip_marked(text: Column, marker_open: str = MARKER_OPEN, marker_close: str = MARKER_CLOSE) -> Column:
    return strip(F.regexp_replace(text, _span(".*?", marker_open, marker_close), " "))


def wrap_as_marked(text: Column, marker_open: str = MARKER_OPEN, marker_close: str = MARKER_CLOSE) -> Column:
    return F.when(F.contains(text, F.lit(marker_open)), text).otherwise(
        F.concat(F.lit(marker_open + "\n"), text, F.lit("\n" + marker_close))
    )
