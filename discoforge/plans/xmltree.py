"""XML documents as columns: a tree of elements written down in Python becomes one expression for its text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import groupby
from xml.sax.saxutils import escape

from pyspark.sql import Column
from pyspark.sql import functions as F

from discoforge.functions.text import xml_escape


@dataclass
class E:
    """An element: its content is a text (column or literal) or a list of nodes. shown: a condition, None for always."""

    tag: str
    content: Column | str | list = ""
    attributes: dict[str, Column | str] = field(default_factory=dict)
    shown: Column | None = None


@dataclass
class Each:
    """A node for each item of an array."""

    items: Column
    node: Callable[[Column], E]


def _text(value: Column | str) -> Column | str:
    return escape(value, {'"': "&quot;", "'": "&apos;"}) if isinstance(value, str) else xml_escape(value)


def _pieces(node: E | Each, depth: int = 0) -> list[Column | str]:
    """A node's text, each line led by a line break: what is fixed as Python texts, what comes from the data as columns."""
    if isinstance(node, Each):
        return [F.array_join(F.transform(node.items, lambda x: _text_of(_pieces(node.node(x), depth))), "")]
    pad = "\n" + "  " * depth
    out = [f"{pad}<{node.tag}", *[x for k, v in node.attributes.items() for x in (f' {k}="', _text(v), '"')], ">"]
    if isinstance(node.content, list):
        out += [x for n in node.content for x in _pieces(n, depth + 1)] + [f"{pad}</{node.tag}>"]
    else:
        out += [_text(node.content), f"</{node.tag}>"]
    return out if node.shown is None else [F.when(node.shown, _text_of(out)).otherwise("")]


def _text_of(pieces: list[Column | str]) -> Column:
    """Pieces as one column; fixed ones that follow each other are one literal."""
    runs = groupby(pieces, lambda p: isinstance(p, str))
    return F.concat(*[x for fixed, run in runs for x in ([F.lit("".join(run))] if fixed else run)])


def document(root: E) -> Column:
    """The text of a document, with its prolog."""
    return _text_of(['<?xml version="1.0" encoding="UTF-8"?>', *_pieces(root)])
