"""JSON texts of unknown form: what can be read of a broken one, and a form in which equal objects are equal texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def outermost(text: Column) -> Column:
    """From the first ``{`` to the last ``}`` of a text that does not begin with an object, as answers wrap objects in prose; else the text, trimmed."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(bare.startswith("{") | (inner == ""), bare).otherwise(inner)


def tolerant(text: Column) -> Column:
    """The VARIANT of a text; of one that is none, of its outermost object; null if neither can be read.

    Also reads what stands behind a whole object, such as a closing fence.
    A null or blank text, or an object that breaks off, is null.
    """
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(outermost(text)), F.when(inner != "", F.try_parse_json(inner)))


def canonical(value: Column) -> Column:
    """A VARIANT as text with the keys of every object in order, at any depth: a key for equality, whatever the order was."""
    return F.to_json(value)


def canonical_text(text: Column) -> Column:
    """The canonical form of a text that can be read as JSON; else the text itself."""
    return F.coalesce(canonical(tolerant(text)), text)
