"""Scalar expressions over identifiers, conditions and URLs; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning as anchors.
ANCHOR_STOP_TOKENS = ("ptr", "const")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _lower_tokens(c: Column, separator: str) -> Column:
    return F.filter(F.transform(F.split(c, separator), F.lower), lambda t: t != "")


def name_tokens(c: Column) -> Column:
    """Lower-case words of an identifier, cut at ``_``, digits and lower-to-upper changes."""
    return _lower_tokens(F.regexp_replace(_text(c), "([a-z])([A-Z])", "$1_$2"), "[_0-9]+")


def identifier_tokens(c: Column) -> Column:
    """Lower-case words of an identifier; digits stay, other signs count as ``_``."""
    return _lower_tokens(F.regexp_replace(F.regexp_replace(_text(c), "[^A-Za-z0-9_]+", "_"), "([a-z0-9])([A-Z])", "$1_$2"), "_")


def anchor_tokens(c: Column, stop: tuple[str, ...]) -> Column:
    """Identifier words without stop words; repeats stay."""
    return F.filter(identifier_tokens(c), lambda t: ~t.isin(*stop))


def has_token(c: Column, *tokens: str) -> Column:
    return F.arrays_overlap(name_tokens(c), F.array(*(F.lit(t) for t in tokens)))


def contains_any(c: Column, *parts: str) -> Column:
    """Whether the lower-cased text contains any of the given lower-case parts."""
    text = F.lower(_text(c))
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def pieces(c: Column, signs: str) -> Column:
    """The text as an array of the given single characters and the runs between them, in order."""
    set_ = "".join("\\" + s for s in signs)
    return F.regexp_extract_all(c, F.lit(f"[{set_}]|[^{set_}]+"), F.lit(0))


def split_top_level(c: Column) -> Column:
    """Comma-separated parts outside ``()<>[]{}``, trimmed, without empty ones; an unmatched closer is ignored."""
    state = F.struct(F.lit(0).alias("d"), F.lit("").alias("b"), F.array().cast("array<string>").alias("o"))

    def step(s: Column, ch: Column) -> Column:
        depth = F.when(ch.isin("(", "<", "[", "{"), s["d"] + 1).when(ch.isin(")", ">", "]", "}"), F.greatest(s["d"] - 1, F.lit(0))).otherwise(s["d"])
        cut = (ch == ",") & (depth == 0)
        return F.struct(
            depth.alias("d"),
            F.when(cut, F.lit("")).otherwise(F.concat(s["b"], ch)).alias("b"),
            F.when(cut, F.concat(s["o"], F.array(s["b"]))).otherwise(s["o"]).alias("o"),
        )

    text = _text(c)
    folded = F.aggregate(pieces(text, "()<>[]{},"), state, step, lambda s: F.concat(s["o"], F.array(s["b"])))
    # most texts hold no brackets; these need no fold over their pieces
    parts = F.when(text.rlike(r"[()<>\[\]{}]"), folded).otherwise(F.split(text, ","))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def matching_close(c: Column, open_index: Column, opener: str, closer: str) -> Column:
    """0-based index of the closer that matches the opener at ``open_index``, or -1."""
    parts = pieces(F.substr(_text(c), open_index + 1), opener + closer)
    init = F.struct(F.lit(0).alias("d"), F.lit(0).alias("i"), F.lit(-1).alias("at"))

    def step(s: Column, ch: Column) -> Column:
        d = s["d"] + F.when(ch == opener, 1).when(ch == closer, -1).otherwise(0)
        found = (s["at"] < 0) & (ch == closer) & (d == 0)
        return F.struct(d.alias("d"), (s["i"] + F.length(ch)).alias("i"), F.when(found, s["i"]).otherwise(s["at"]).alias("at"))

    at = F.aggregate(parts, init, step, lambda s: s["at"])
    return F.when(at >= 0, at + open_index).otherwise(-1)


def field_parts(target: Column) -> Column:
    """Pieces of ``a->b.c``, without empty ones."""
    return F.filter(F.split(F.trim(_text(target)), r"->|\."), lambda p: p != "")


def field_tail(target: Column) -> Column:
    parts = field_parts(target)
    return F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise("")


def relation_token(name: Column) -> Column:
    """Last piece of a lower-cased reference, ``[`` counting as a dot and ``]`` as nothing."""
    text = F.replace(F.replace(F.replace(F.lower(_text(name)), F.lit("->"), F.lit(".")), F.lit("["), F.lit(".")), F.lit("]"), F.lit(""))
    return F.element_at(F.split(text, r"\."), -1)


def is_count_like(name: Column) -> Column:
    return contains_any(relation_token(name), "count", "num", "len", "size", "capacity", "entry", "entries", "item", "items", "element", "elements", "palette", "slot")


def is_bound_like(name: Column) -> Column:
    return contains_any(relation_token(name), "bit", "bits", "depth", "width", "height", "shift", "bpp", "level")


def is_constant_like(name: Column) -> Column:
    value = F.trim(_text(name))
    return (value == "") | value.rlike(r"^-?\d+[uUlL]*$") | value.rlike("^[A-Z][A-Z0-9_]*$")


def is_null_like(value: Column, zero: bool = False) -> Column:
    """null, nullptr or z_null in any case; with ``zero`` also 0."""
    return F.lower(F.trim(_text(value))).isin("null", "nullptr", "z_null", *(["0"] if zero else []))


def is_internal_reference(name: Column) -> Column:
    value = _text(name)
    return value.contains("->") | value.contains(".")


def is_public_name(name: Column) -> Column:
    return ~is_constant_like(name) & ~is_internal_reference(name)


def has_lowercase(name: Column) -> Column:
    return _text(name).rlike("[a-z]")


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix, ignoring case."""
    a, b = F.lower(_text(a)), F.lower(_text(b))
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i))
    return F.array_max(same)


def semantic_match(candidates: Column, semantics: Column) -> Column:
    """Over all pairs of tokens: 3 if equal, else 2 if they share four leading letters."""
    pair = lambda a, b: F.when(a == b, 3).when(shared_prefix(a, b) >= 4, 2).otherwise(0)
    own = lambda a: F.aggregate(semantics, F.lit(0), lambda s, b: s + pair(a, b))
    return F.aggregate(candidates, F.lit(0), lambda s, a: s + own(a))


def condition_value(value: Column) -> Column:
    """A compared value without what follows ``&&`` or ``||``, trailing ``;,`` and unbalanced closers."""
    cut = F.regexp_replace(F.trim(F.element_at(F.split(F.trim(_text(value)), r"\s*(&&|\|\|)\s*"), 1)), "[;,]+$", "")
    count = lambda s, ch: F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))

    def step(s: Column, _: Column) -> Column:
        drop = F.lit(False)
        for o, c in ("()", "[]", "{}"):
            drop = drop | (s.endswith(c) & (count(s, c) > count(s, o)))
        return F.when(drop, F.rtrim(F.substr(s, F.lit(1), F.length(s) - 1))).otherwise(s)

    closers = F.sequence(F.lit(0), F.length(cut))
    return F.trim(F.aggregate(closers, cut, step))


def repository_url(url: Column) -> Column:
    """Canonical repository address: lower case, up to three scheme prefixes off, ``host:path`` as ``host/path``, one trailing slash and ``.git`` off."""
    text = F.lower(F.trim(_text(url)))
    for _ in range(3):
        text = F.regexp_replace(text, "^(https?://|git://|ssh://|git@)", "")
    text = F.when(text.contains("/"), F.regexp_replace(text, "^([^/:]*):", "$1/")).otherwise(text)
    return F.regexp_replace(F.regexp_replace(text, "/$", ""), r"\.git$", "")


def clip_lines(text: Column, limit: int) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), 1, limit), "\n")


def cap_text(text: Column, limit: int, marker: str) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)


def to_integer(token: Column) -> Column:
    """Value of a decimal or 0x literal, else null."""
    hexa = token.rlike("^0[xX][0-9a-fA-F]+$")
    return F.when(hexa, F.conv(F.substring(token, 3, 20), 16, 10)).when(token.rlike(r"^\d+$"), token).try_cast("long")


def decode_seed(content: Column, encoding: Column) -> Column:
    """Bytes of a seed: base64, hex (blanks ignored), else UTF-8; null if it is not decodable."""
    kind = F.lower(_text(encoding))
    return (
        F.when(kind == "base64", F.try_to_binary(content, F.lit("base64")))
        .when(kind == "hex", F.try_to_binary(F.regexp_replace(content, r"\s", ""), F.lit("hex")))
        .otherwise(F.encode(content, "UTF-8"))
    )


def without_fence(text: Column) -> Column:
    """Text of a fenced code block without its fences."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:python|py)?\s*\n", ""), r"\n```\s*$", "")


def unwrapped_code(text: Column) -> Column:
    """Code inside a JSON wrapper, by the first of the usual keys that is there; else the text itself."""
    body = F.trim(text)
    keys = F.coalesce(*(F.get_json_object(body, p) for p in ("$['fuzzer.cc']", "$.content", "$.code", "$.harness", "$.fileContent")))
    return F.when(body.startswith("{") & (F.coalesce(keys, F.lit("")) != ""), keys).otherwise(text)


def mentions_word(text: Column, words: Column) -> Column:
    """Whether one of an array of names stands in the text as a whole word, ignoring case."""
    return F.exists(words, lambda w: F.regexp_like(F.coalesce(text, F.lit("")), F.concat(F.lit(r"(?i)(^|[^A-Za-z0-9_])\Q"), w, F.lit(r"\E($|[^A-Za-z0-9_])"))))


def parameter_text(parameter: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(parameter["type"], F.lit("?")), F.coalesce(parameter["name"], F.lit("?")))
