"""Priority classifications as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkscope.functions.names import contains_any, has_token

# Words that decide a parameter's role.
SIZE_WORDS = ("len", "length", "size", "count", "capacity", "avail")
CONTROL_WORDS = ("mode", "type", "flag", "flags", "option", "options", "kind", "op", "cmd", "flush")
OUTPUT_WORDS = ("out", "dst", "dest", "result", "output")
STATE_WORDS = ("state", "ctx", "context", "stream", "parser", "handle", "object", "info", "strm")
SUPPORT_WORDS = ("table", "array", "list", "entry", "entries", "palette", "hist", "map")
SUPPORT_TYPES = ("table", "array", "list", "palette", "hist")
NUMERIC_TYPES = ("int", "long", "short", "size_t", "ssize_t", "uint", "float", "double")

# Words that decide a call's phase, the first group that matches winning.
PHASE_WORDS = (
    ("cleanup", ("finish", "final", "flush", "close", "destroy", "free", "cleanup", "end", "dealloc", "release", "teardown")),
    ("setup", ("init", "open", "create", "alloc", "new", "setup", "begin", "start")),
    ("consume", ("parse", "read", "decode", "load", "consume", "process")),
    ("update", ("update", "write", "append", "push", "feed")),
)
# Words that decide a sink's role.
SINK_WORDS = (
    ("cleanup", ("free", "cleanup", "destroy", "release", "close", "end", "final", "deinit")),
    ("setup", ("init", "open", "create", "setup", "begin", "start")),
    ("update", ("update", "write", "append", "push", "feed")),
    ("consume", ("read", "parse", "decode", "load", "process", "finish")),
)
# Words that decide the kind of a state field.
FIELD_WORDS = (
    ("control-state", ("mode", "type", "flag", "state", "phase", "status")),
    ("size-state", ("len", "size", "count", "avail", "capacity")),
    ("buffer-state", ("buf", "data", "next", "ptr", "input", "output")),
)


def by_words(name: Column, groups: tuple[tuple[str, tuple[str, ...]], ...], otherwise: str) -> Column:
    """Label of the first group one of whose words occurs in the lower-cased name."""
    out = F
    for label, words in groups:
        out = out.when(contains_any(name, *words), F.lit(label))
    return out.otherwise(otherwise)


def call_phase(name: Column) -> Column:
    return by_words(name, PHASE_WORDS, "other")


def sink_role(name: Column) -> Column:
    return by_words(name, SINK_WORDS, "invoke")


def field_kind(field: Column) -> Column:
    return by_words(field, FIELD_WORDS, "state")


def is_size_name(name: Column) -> Column:
    return F.lower(F.coalesce(name, F.lit(""))).startswith("num") | has_token(name, *SIZE_WORDS)


def parameter_role(name: Column, kind: Column) -> Column:
    """Role of a parameter; names match by whole words."""
    low, typ = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(kind, F.lit("")))
    opaque = low.endswith("_ptr") & ~contains_any(low, "buf", "data", "text", "str")
    return (
        F.when(is_size_name(name), "size")
        .when(has_token(name, *CONTROL_WORDS), "control")
        .when(has_token(name, *OUTPUT_WORDS) | (low == "return") | typ.contains("**"), "output-buffer")
        .when(has_token(name, *STATE_WORDS) | opaque | typ.contains("%struct") | (typ.endswith("ptr") & ~typ.contains("*")), "state")
        .when(has_token(name, *SUPPORT_WORDS) | contains_any(typ, *SUPPORT_TYPES), "support-buffer")
        .when(contains_any(typ, "*", "char", "uint8", "int8", "void", "byte"), "input-buffer")
        .when(typ.rlike("(^|[^a-z0-9_])(" + "|".join(NUMERIC_TYPES) + ")($|[^a-z0-9_])"), "numeric")
        .otherwise("value")
    )


def signature_role(name: Column, kind: Column) -> Column:
    """Role of a parameter known only from a header: the same order, but names and types match by parts of words."""
    low, typ = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(kind, F.lit("unknown")))
    opaque = low.endswith("_ptr") & ~contains_any(low, "buf", "data", "text", "str")
    return (
        F.when(low.startswith("num") | contains_any(low, *SIZE_WORDS), "size")
        .when(contains_any(low, *CONTROL_WORDS), "control")
        .when(contains_any(low, *OUTPUT_WORDS, "return") | typ.contains("**"), "output-buffer")
        .when(contains_any(low, *STATE_WORDS) | opaque | typ.contains("%struct") | (typ.endswith("ptr") & ~typ.contains("*")), "state")
        .when(contains_any(low, *SUPPORT_WORDS) | contains_any(typ, *SUPPORT_TYPES), "support-buffer")
        .when(contains_any(typ, "*", "char", "void", "byte"), "input-buffer")
        .when(contains_any(typ, *NUMERIC_TYPES), "numeric")
        .otherwise("value")
    )
