"""Advisories and patches: merging sources, splitting and scoring patches, deriving names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkscope.functions.names import contains_any
from sparkscope.functions.patterns import Pattern, best_match, pattern_hits
from sparkscope.operators.ordered import known, segments

SOURCE_FILE = r"(?i)\.(c|h|cc|cpp|cxx|hh|hpp)$"
# Phrases of an advisory that name a function, with their scores.
FUNCTION_PHRASES = (
    Pattern("in_function", r"(?i)\bin\s+(?:the\s+)?([a-zA-Z_]\w+)\s*(?:\(\))?\s+function\b", 1, 10),
    Pattern("the_function", r"(?i)\bthe\s+([a-zA-Z_]\w+)\s*(?:\(\))?\s+function\b", 1, 9),
    Pattern("via", r"(?i)\bvia\s+(?:the\s+)?([a-zA-Z_]\w+)(?:\(\))?\s+(?:in|at)\s+[\w/.]+\.\w+", 1, 9),
    Pattern("shown_by", r"(?i)\b(?:demonstrated|evidenced|illustrated|shown|triggered)\s+by\s+([a-zA-Z_]\w+)", 1, 9),
    Pattern("ticked", r"`([a-zA-Z_]\w+?)(?:\(\))?`", 1, 12),
    Pattern("call", r"\b([a-zA-Z_]\w+)\(\)", 1, 8),
    Pattern("qualified", r"\b[a-zA-Z_]\w+::([a-zA-Z_]\w+)", 1, 8),
    Pattern("function_word", r"(?i)\bfunction\s+([a-zA-Z_]\w+)\b", 1, 5),
    Pattern("end_of_clause", r"(?i)\bin\s+([a-zA-Z_]\w{2,})\s*[,.]", 1, 3),
)
# Words of a commit subject that speak for a fix or for noise.
FIX_WORDS = (
    "fix", "vuln", "overflow", "out-of-bound", "out of bound", "use-after-free", "use after free", "double-free", "double free", "null", "leak", "crash",
    "segfault", "cve-", "security", "deref", "shift", "negative", "race", "infinite", "recursion", "exhaust", "sanitize", "oob", "uaf",
)
NOISE_WORDS = (
    "tidy", "release", "version bump", "changelog", "readme", "documentation", "doc:", "whitespace", "spelling", "typo", "comment:", "lint", "format",
    "reformat", "cosmetic", "rename ", "move ", "merge branch", "merge pull request",
)
DOC_PATHS = (".md", ".rst", ".txt", "/doc/", "/docs/", "/news", "/changelog", "/readme", ".html", ".pdf", ".bib", ".po", "/man/", ".1", ".3")
META_PATHS = ("cmakelists", "configure.ac", "configure.in", "makefile", ".am", "license", "authors", ".cmake", ".pc.in", ".spec")
VERSION_BUMP = (
    r"(?i)(?:#\s*define\s+\w*(?:VER|MAJOR|MINOR|PATCH|BUILD|RELEASE)\w*|VERSION\s*[:=]|\bversion\b.*\b\d+\.\d+|Copyright\b|\bAC_INIT\b|\bcmake_minimum_required\b"
    r"|\bset\s*\(\s*\w*(?:VERSION|VER)\w*|\bAC_PREREQ\b|\bAM_INIT_AUTOMAKE\b|\bRelease\b.*\b\d+\.\d+)"
)
KEYWORDS = ("security", "vuln", "cve-", "use-after-free", "buffer overflow", "heap overflow", "heap-use-after-free", "out-of-bounds", "denial of service", "double-free", "null dereference", "integer overflow")


def name_points(name: Column, underscore: bool = True) -> Column:
    """What the look of a name adds to its phrase's score."""
    points = F.when(F.length(name) >= 5, 1).otherwise(0) - F.when(F.length(name) < 4, 2).otherwise(0)
    return points + F.when(name.contains("_"), 2).otherwise(0) if underscore else points


def plausible_function(name: Column, blocked: Sequence[str] = ()) -> Column:
    """Looks like a C function: an identifier of two letters or more, not blocked, not a macro in capitals."""
    shape = name.rlike("^[a-zA-Z_][a-zA-Z0-9_]+$") & ~((F.length(name) >= 4) & (name == F.upper(name)))
    return shape & ~F.lower(name).isin(*blocked) if blocked else shape


def function_from_text(texts: DataFrame, id_col: str, text_col: str, blocked: DataFrame) -> DataFrame:
    """(id, value, score, pos): the function an advisory text most likely names; ``blocked`` (name) lists words that never are.

    Hits are held against the text in the pass that finds them, so no text is shuffled or sent anywhere.
    """
    hits = pattern_hits(texts.select(id_col, F.col(text_col).alias("_text")), id_col, "_text", FUNCTION_PHRASES, ["_text"])
    plain = (F.col("base") <= 3) & ~F.col("value").contains("_") & ((F.col("value") == F.lower("value")) | (F.col("value") == F.upper("value")))
    file = F.concat(F.lit(r"(^|\W)"), F.lower("value"), F.lit(r"\.(c|h|cc|cpp|cxx|hpp|hh)\b"))
    good = hits.where(plausible_function(F.col("value")) & ~plain).where(~F.regexp_like(F.lower("_text"), file)).drop("_text")
    named = good.join(blocked.select(F.lower("name").alias("b")), F.lower("value") == F.col("b"), "left_anti")
    return best_match(named.where(F.col(id_col).isNotNull()), id_col, F.col("base") + name_points(F.col("value")))


def near_top(scored: DataFrame, keys: Sequence[str], score: str, order: Sequence[str], slack: float) -> DataFrame:
    """The best row of each key, and further ones of positive score within ``slack`` of it."""
    by_key = Window.partitionBy(*keys)
    first = F.row_number().over(by_key.orderBy(F.desc(score), *order))
    marked = scored.withColumns({"_first": first, "_top": F.max(score).over(by_key)})
    return marked.where((F.col("_first") == 1) | ((F.col(score) > 0) & (F.col(score) >= F.col("_top") - slack))).drop("_first", "_top")


def patch_lines(patches: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, line_no, line, sub_no): lines, numbered by the mail-format patch they stand in (0 before the first)."""
    lines = patches.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return segments(lines, keys, ["line_no"], F.col("line").rlike("^From [0-9a-f]{40} "), "sub_no")


def sub_patches(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, sub_no, text) of the patches that are not blank."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    text = F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    return lines.groupBy(*keys, "sub_no").agg(text.alias("text")).where(F.trim("text") != "")


def searchable_lines(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines of commit messages and changed lines of hunks; file lists, headers and context are left out."""
    line = F.col("line")
    zone = F.when(F.trim(line) == "---", "stat").when(line.startswith("diff --git "), "meta").when(line.startswith("@@"), "hunk")
    by_sub = Window.partitionBy(*keys, "sub_no").orderBy("line_no")
    current = F.coalesce(F.last(zone, True).over(by_sub.rowsBetween(Window.unboundedPreceding, -1)), F.lit("message"))
    # a bare --- only ends a message; inside a patch it is a changed line
    tagged = lines.withColumn("_zone", current).withColumn("_new", zone)
    header = line.startswith("diff --git ") | line.startswith("--- ") | line.startswith("+++ ") | line.startswith("@@")
    meta = (F.col("_zone") == "meta") & line.rlike("^(index |old mode|new mode)")
    hidden = (F.col("_zone") == "stat") | ((F.col("_zone") == "message") & (F.col("_new") == "stat")) | ((F.col("_zone") == "hunk") & ~line.rlike("^[+-]"))
    return tagged.where(~F.coalesce(header | meta | hidden, F.lit(False))).drop("_zone", "_new")


def score_sub_patches(lines: DataFrame, keys: Sequence[str], keywords: Sequence[str] = KEYWORDS, affected_file: Column | None = None) -> DataFrame:
    """(keys, sub_no, score, n_source): how likely each patch is the fix, from subject, words, files and changed lines."""
    line = F.col("line")
    group = [*keys, "sub_no"]
    path = F.lower(F.regexp_extract(line, r"^diff --git a/(\S+)", 1))
    is_path = path != ""
    body = F.substring(line, 2, 1 << 30)
    changed = line.rlike("^[+-]") & ~line.rlike(r"^(\+\+\+|---)") & (F.trim(body) != "") & ~body.rlike(VERSION_BUMP) & ~F.trim(body).rlike(r"^(//|\*|/\*|#|--)")
    subject = F.regexp_extract(line, r"^Subject:\s*(?:\[PATCH(?:\s+\d+/\d+)?\]\s*)?(.*)$", 1)
    counted = lines.groupBy(*group).agg(
        F.lower(F.trim(F.coalesce(F.min_by(subject, F.when(line.startswith("Subject:"), F.col("line_no"))), F.lit("")))).alias("subject"),
        F.count_if(is_path).alias("n_files"),
        F.count_if(is_path & path.rlike(SOURCE_FILE)).alias("n_source"),
        F.count_if(is_path & contains_any(path, *DOC_PATHS)).alias("n_doc"),
        F.count_if(is_path & contains_any(path, *META_PATHS)).alias("n_meta"),
        F.count_if(is_path & (path.contains(F.lower(affected_file)) if affected_file is not None else F.lit(False))).alias("n_affected"),
        F.count_if(changed).alias("n_changed"),
    )
    spoken = searchable_lines(lines, keys).where(contains_any(line, *keywords)).select(*group).distinct().withColumn("_spoken", F.lit(2))
    s, n = F.col("subject"), F.col
    score = (
        F.when(contains_any(s, *FIX_WORDS), 4).otherwise(0)
        - F.when(contains_any(s, *NOISE_WORDS), 5).otherwise(0)
        + F.when(s.rlike(r"\bcve-\d{4}-\d{4,7}\b"), 5).otherwise(0)
        + F.coalesce("_spoken", F.lit(0))
        - F.when(n("n_files") >= 8, 2).otherwise(0)
        - F.when(n("n_files") >= 20, 4).otherwise(0)
        + F.when(n("n_source").between(1, 3) & (n("n_doc") <= 1) & (n("n_meta") <= 1), 3).otherwise(0)
        - F.when((n("n_files") > 0) & (n("n_doc") + n("n_meta") > n("n_source")), 3).otherwise(0)
        + F.when(n("n_affected") > 0, 4).otherwise(0)
        + F.when(n("n_changed").between(1, 50), 3).when(n("n_changed") > 200, -3).when(n("n_changed") == 0, -6).otherwise(0)
    )
    return counted.join(spoken, group, "left").select(*group, score.cast("double").alias("score"), "n_source")


def security_patches(patches: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, sub_no, text, score): per patch text the sub-patch of best score and those near it; all must touch C or C++ source."""
    lines = patch_lines(patches, keys, text)
    scored = score_sub_patches(lines, keys).where("n_source > 0")
    return near_top(scored, keys, "score", ["sub_no"], 2.0).join(sub_patches(lines, keys), [*keys, "sub_no"]).drop("n_source")


def merge_advisories(user: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per cve_id: what the user gave, else the sources' text by precedence (nvd, osv, gh, osv summary, gh summary).

    ``sources`` has (cve_id, source, description, summary, cvss_score, cwe_ids, refs);
    each source is pivoted into columns by one aggregation, so the merge is one join.
    """
    of = lambda source, column: F.max(F.when(F.col("source") == source, F.col(column))).alias(f"{source}_{column}")
    wide = sources.groupBy("cve_id").agg(
        of("nvd", "description"), of("osv", "description"), of("gh", "description"), of("osv", "summary"), of("gh", "summary"), of("nvd", "cvss_score"),
        F.max(F.when(F.col("source") == "nvd", F.col("cwe_ids"))).alias("cwes"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(rank_of_source(F.col("source")).alias("r"), "refs"))), lambda x: x["refs"]))).alias("refs"),
    )
    text = F.coalesce(known(F.col("description")), *(known(F.col(c)) for c in ("nvd_description", "osv_description", "gh_description", "osv_summary", "gh_summary")))
    return user.join(wide, "cve_id", "left").select(
        *[c for c in user.columns if c not in ("description", "cwe_id")],
        text.alias("description"),
        F.coalesce(known(F.col("cwe_id")), F.when(F.size("cwes") > 0, F.element_at("cwes", 1))).alias("cwe_id"),
        F.col("nvd_cvss_score").alias("cvss_score"),
        "refs",
    )


def rank_of_source(source: Column) -> Column:
    return F.when(source == "nvd", 0).when(source == "osv", 1).otherwise(2)


def version_bumps(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, sub_no, bump): whether a patch changes source and every changed line only bumps a version or copyright."""
    line = F.col("line")
    by_sub = Window.partitionBy(*keys, "sub_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    file = F.last(F.when(line.startswith("+++ "), F.regexp_extract(line, r"^\+\+\+ [ab]/(.*)$", 1)), True).over(by_sub)
    hunk = F.last(F.when(line.startswith("+++ "), False).when(line.rlike(r"^@@\s"), True), True).over(by_sub)
    body = F.substring(line, 2, 1 << 30)
    changed = lines.withColumns({"_file": file, "_hunk": hunk}).where(F.col("_hunk") & F.col("_file").rlike(SOURCE_FILE) & line.rlike("^[+-]") & ~line.startswith("+++") & (F.trim(body) != ""))
    return changed.groupBy(*keys, "sub_no").agg(F.every(body.rlike(VERSION_BUMP)).alias("bump"))
