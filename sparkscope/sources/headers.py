"""Headers and symbol listings: signatures, exports and public names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscope.functions.names import split_top_level
from sparkscope.operators.ordered import precedence, top_k

# Header names that are internal, keywords that are no functions, and words that no C type starts with.
PRIVATE = r"(?i)(priv|private|internals?|pstream)\.h$|(detail|impl)[/\\]"
KEYWORDS = ("if", "while", "for", "switch", "return", "sizeof", "typedef", "struct", "enum", "union")
PROSE = (
    "if", "the", "a", "an", "is", "has", "been", "previously", "or", "and", "not", "this", "that", "with", "from", "to", "for", "of", "when", "where",
    "which", "file", "should", "must", "can", "may",
)
# Symbols of the system and the C library.
SYSTEM_SYMBOLS = (
    "_init", "_fini", "__cxa_finalize", "__cxa_atexit", "_Jv_RegisterClasses", "_ITM_deregisterTMCloneTable", "_ITM_registerTMCloneTable",
    "_GLOBAL_OFFSET_TABLE_", "__gmon_start__", "_start", "main", "__libc_csu_init", "__libc_csu_fini", "__libc_start_main", "_dl_relocate_static_pie",
    "__assert_fail", "__errno_location", "fopen", "fclose", "fread", "fwrite", "malloc", "free", "calloc", "realloc", "printf", "fprintf", "sprintf",
    "snprintf", "memcpy", "memmove", "memset", "strlen", "strcmp", "strcpy", "strcat", "strncmp", "strncpy", "strncat",
)
_ID = "[a-zA-Z_][a-zA-Z0-9_]*"
DECLARATION = rf"\b({_ID})\s*\(([^)]*)\)\s*;"
WRAPPED = rf"\b(?:[A-Z_][A-Z0-9_]*\s+)?({_ID})\s*\(([^)]*)\)"
EXPORTED_NAME = rf"[A-Z_][A-Z0-9_]*EXPORT[A-Z0-9_]*\s+({_ID})\s*(?:[A-Z_][A-Z0-9_]*\s*)?\("
DOUBLE_BRACKETS = rf"\b({_ID})\s+OF\s*\(\s*\(([^)]*)\)"
# Ways to mark a function as exported.
EXPORT_FORMS = (
    rf"[A-Z_][A-Z0-9_]*EXPORT[A-Z0-9_]*\s*\(\s*(?:[^,]+\s*,\s*){{2,}}({_ID})\s*,",
    rf"[A-Z_][A-Z0-9_]*EXPORT[A-Z0-9_]*\s*\(\s*[^,]+\s*,\s*({_ID})\s*\)",
    rf"[A-Z_][A-Z0-9_]*EXPORT[A-Z0-9_]*\s+({_ID})\s*\(",
    rf"[A-Z_][A-Z0-9_]*\s+\w+\s+[A-Z_][A-Z0-9_]*EXPORT[A-Z0-9_]*\s+({_ID})\s*\(",
    rf"[A-Z_][A-Z0-9_]*API[A-Z0-9_]*\s+\w+\s+({_ID})\s*\(",
    rf"__declspec\(dllexport\)\s+\w+\s+({_ID})\s*\(",
    rf'__attribute__\s*\(\(visibility\s*\("default"\)\)\)\s+\w+\s+({_ID})\s*\(',
)


def looks_like_type(text: Column) -> Column:
    """Plausibly a C type: no quotes, no run of four lower-case words, no prose word first."""
    first = F.lower(F.element_at(F.split(F.trim(text), r"\s+"), 1))
    return (F.coalesce(text, F.lit("")) != "") & ~text.rlike("[\"']") & ~text.rlike(r"[a-z]+\s+[a-z]+\s+[a-z]+\s+[a-z]+") & ~first.isin(*PROSE)


def parameter_list(text: Column) -> Column:
    """array<struct<type,name>> of a prototype's parameters; nameless and prose ones are left out."""
    def one(part: Column) -> Column:
        words = F.split(part, r"\s+")
        name = F.regexp_replace(F.element_at(words, -1), r"^\*+", "")
        kind = F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " ")
        return F.when((F.size(words) >= 2) & (name != "") & looks_like_type(kind), F.struct(kind.alias("type"), name.alias("name")))

    return F.when(F.trim(text).isin("", "void"), F.array().cast("array<struct<type:string,name:string>>")).otherwise(F.array_compact(F.transform(split_top_level(text), one)))


def signatures(headers: DataFrame, recorded: DataFrame | None = None, public_only: bool = True) -> DataFrame:
    """(name, params, source): functions of headers (path, text), the first way of finding one counting.

    ``recorded`` (name, params) holds a parser's results, which go first. Headers
    are taken by path; within one, declarations, then wrapped ones, exports and
    double-bracketed ones.
    """
    shown = headers.where(~F.col("path").rlike(PRIVATE)) if public_only else headers
    plain = F.regexp_replace(F.regexp_replace("text", r"(?s)/\*.*?\*/", " "), r"//[^\n]*", " ")
    text = shown.select("path", plain.alias("text"))

    def found(rank: int, source: str, pattern: str, args: bool, blocked: tuple[str, ...] = KEYWORDS, prefix: str = "^$") -> DataFrame:
        pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("name"), (F.regexp_extract_all("text", F.lit(pattern), F.lit(2)) if args else F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("args"))
        rows = text.select("path", F.posexplode(pairs).alias("i", "p")).select("path", "i", "p.*").where(~F.col("name").isin(*blocked) & ~F.col("name").rlike(prefix))
        params = parameter_list(F.col("args")) if args else F.array().cast("array<struct<type:string,name:string>>")
        return rows.select("name", params.alias("params"), F.lit(source).alias("source"), F.struct(F.lit(1).alias("a"), F.col("path").alias("b"), F.lit(rank).alias("c"), F.col("i").alias("d")).alias("place"))

    parts = [found(0, "declaration", DECLARATION, True), found(1, "macro", WRAPPED, True, KEYWORDS, "^(_|Z_|OF)"), found(2, "export", EXPORTED_NAME, False, ("-",)), found(3, "of", DOUBLE_BRACKETS, True)]
    if recorded is not None:
        nothing = F.struct(F.lit(0).alias("a"), F.lit("").alias("b"), F.lit(0).alias("c"), F.lit(0).alias("d"))
        parts.append(recorded.select("name", "params", F.lit("parser").alias("source"), nothing.alias("place")))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("name").agg(F.min_by(F.struct("params", "source"), "place").alias("x")).select("name", "x.*")


def export_macros(text: Column) -> Column:
    """Macros of a header that mark exports; ``__EXPORT__`` stands for a compiler's own way."""
    defined = F.concat(*(F.regexp_extract_all(text, F.lit(rf"#define\s+([A-Z_][A-Z0-9_]*{w}[A-Z0-9_]*)\s"), F.lit(1)) for w in ("EXPORT", "API")))
    own = F.when(text.contains("__declspec(dllexport)") | text.contains('visibility("default")'), F.array(F.lit("__EXPORT__"))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(defined, own)))


def exported_functions(headers: DataFrame) -> DataFrame:
    """(name): functions that a header marks as exported, by common forms and by the macros it defines itself."""
    common = F.concat(*(F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in EXPORT_FORMS))
    fixed = headers.select(F.explode(common).alias("name"))
    own = headers.select("text", F.explode(export_macros(F.col("text"))).alias("m"))
    forms = (F.concat("m", F.lit(rf"\s*\([^,]*,\s*({_ID})\s*\)")), F.concat("m", F.lit(rf"\s+\w+\s+({_ID})\s*\(")))
    macro = own.select(F.explode(F.concat(*(F.regexp_extract_all("text", f, F.lit(1)) for f in forms))).alias("name"))
    return fixed.union(macro).where(~F.col("name").isin(*KEYWORDS)).distinct()


def exported_symbols(listings: DataFrame) -> DataFrame:
    """(library, name) from recorded tool output (library, tool, text): of each library the first tool that shows any counts.

    Tools are ``readelf``, ``nm_dynamic`` and ``nm``, in this order.
    """
    lines = listings.select("library", "tool", F.explode(F.split("text", "\n")).alias("line")).withColumn("w", F.split(F.trim("line"), r"\s+"))
    size = F.size("w")
    elf = lines.where((F.col("tool") == "readelf") & F.col("line").rlike("FUNC|OBJECT") & (size >= 8)).where(F.get("w", F.lit(4)).isin("GLOBAL", "WEAK") & (F.get("w", F.lit(5)) == "DEFAULT"))
    kind = F.when(size >= 3, F.substring(F.get("w", F.lit(1)), -1, 1)).when(size == 2, F.substring(F.get("w", F.lit(0)), -1, 1))
    nm = lambda tool: lines.where((F.col("tool") == tool) & ~F.col("line").contains(".o:") & kind.isin("T", "D", "B", "R")).select("library", F.element_at("w", -1).alias("name"))
    return precedence([elf.select("library", F.get("w", F.lit(7)).alias("name")), nm("nm_dynamic"), nm("nm")], ["library"]).distinct()


def library_api(symbols: DataFrame) -> DataFrame:
    """Symbols without version suffix, internal underscore names and the system's."""
    name = F.element_at(F.split("name", "@@"), 1)
    return symbols.withColumn("name", name).where(~F.col("name").startswith("_") & ~F.col("name").isin(*SYSTEM_SYMBOLS)).distinct()


def symbol_listing(libraries: DataFrame, symbols: DataFrame, most_libraries: int = 5, most: int = 200) -> DataFrame:
    """Up to ``most`` names of the largest libraries (library, size), without internal, mangled and dotted ones."""
    large = top_k(libraries, [], [F.desc("size"), "library"], most_libraries)
    good = symbols.join(large, "library", "left_semi").where(~F.col("name").rlike(r"^__|^_Z|\.")).select("name").distinct()
    return top_k(good, [], ["name"], most)


def public_names(exported: DataFrame, declared: DataFrame, marked: DataFrame) -> DataFrame:
    """(name): exported and declared, else exported, else marked in headers, else all declared."""
    both = exported.select("name").intersect(declared.select("name"))
    rank = [(both, 0), (exported.select("name"), 1), (marked.select("name"), 2), (declared.select("name"), 3)]
    tagged = [df.withColumn("one", F.lit(1)) for df, _ in rank]
    return precedence(tagged, ["one"]).select("name").distinct()
