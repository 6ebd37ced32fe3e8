"""Names derived from advisories and patches: affected files and functions, by cascades of sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkscope.operators.advisory import VERSION_BUMP, function_from_text, patch_lines, plausible_function
from sparkscope.operators.ordered import first_wins, precedence, top_k

# Lines without program behaviour, hunk heads, files in prose, subjects of fixes and names of test code.
NOISE_LINE = r"(?i)copyright\b|all rights reserved|last updated\s*:|^\s*version\s+\d+\.\d+|^\s*release\s+\d+\.\d+|^\s*<[a-z!/][^>]*>\s*$|^\s*[-=*#]{3,}\s*$|^\s*\*\s*$|^\s*//\s*$"
HUNK_FUNCTION = r"^@@[^@]+@@\s*(?:\w+\s+)*(\w+)\s*\("
FILE_IN_PROSE = r"(?i)\bin\s+(\w+\.(?:c|h|cc|cpp|cxx))\b"
FILE_THEN_IN = r"(?i)\b(\w+\.(?:c|h|cc|cpp|cxx))\s+in\b"
SECURITY_SUBJECT = r"(?i)CVE-|security|vulnerab|overflow|use.after.free|out.of.bounds|heap|uaf|double.free|injection|bypass"
TEST_NAME = r"(?i)test|spec|mock|stub|fake|dummy"


def changes(patches: DataFrame, limit: int = 15) -> DataFrame:
    """(cve_id, patch_no, removed, added, functions, hunks): what a patch took out and put in, without noise.

    Lines count from the first hunk on if they are 4 to 300 letters long and
    neither version bumps nor decoration.
    """
    key = ["cve_id", "patch_no"]
    lines = patches.select(*key, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    begun = F.max(F.col("line").startswith("@@")).over(Window.partitionBy(*key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    body = F.trim(F.substring("line", 2, 1 << 20))
    useful = F.length(body).between(4, 300) & ~body.rlike(VERSION_BUMP) & ~body.rlike(NOISE_LINE)
    sign = F.when(F.col("line").startswith("-") & ~F.col("line").startswith("---") & useful, "-").when(F.col("line").startswith("+") & ~F.col("line").startswith("+++") & useful, "+")
    marked = lines.withColumn("begun", begun).where("begun").withColumns({"sign": sign, "body": body, "fn": F.regexp_extract("line", HUNK_FUNCTION, 1)})

    def listed(condition: Column, value: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.when(condition, F.struct("line_no", value.alias("v")))))
        return F.transform(rows, lambda r: r["v"])

    found = marked.groupBy(*key).agg(
        F.slice(listed(F.col("sign") == "-", F.col("body")), 1, limit).alias("removed"), F.slice(listed(F.col("sign") == "+", F.col("body")), 1, limit).alias("added"),
        F.array_distinct(listed(F.col("fn") != "", F.col("fn"))).alias("functions"), F.slice(listed(F.col("line").startswith("@@"), F.col("line")), 1, 10).alias("hunks"),
    )
    shift = F.filter("removed", lambda x: x.rlike("<<|>>"))
    allocation = F.filter("removed", lambda x: x.rlike(r"\b(realloc|malloc|calloc)\b"))
    sized = F.filter("removed", lambda x: x.rlike("(?i)size|count|len|num|power|capacity"))
    bound = F.filter("added", lambda x: x.rlike(r"if\s*\(.*(?:>|<|>=|<=|==).*\)"))
    typed = F.filter("added", lambda x: x.rlike(r"\bunsigned\b|\bsize_t\b|\buint\d+"))
    guard = F.filter("added", lambda x: x.rlike("(?i)overflow|MAX|LIMIT|saturate"))
    return found.withColumn("summary", F.struct(shift.alias("shift"), allocation.alias("allocation"), sized.alias("sized"), bound.alias("bound"), typed.alias("typed"), guard.alias("guard")))


def affected_file(patches: DataFrame, texts: DataFrame) -> DataFrame:
    """(cve_id, file): a patched source that the advisory text (cve_id, text) names, else the first, implementations before headers; else a file in the text."""
    said = texts.select("cve_id", "text", F.lower(F.coalesce(*(F.when(F.regexp_extract("text", p, 1) != "", F.regexp_extract("text", p, 1)) for p in (FILE_IN_PROSE, FILE_THEN_IN)))).alias("named"))
    files = patches.select("cve_id", "patch_no", F.posexplode(F.split("text", "\n")).alias("i", "line")).where(F.col("line").startswith("+++ b/"))
    files = files.select("cve_id", "patch_no", "i", F.regexp_extract("line", r"([^/\s]+)\s*$", 1).alias("file")).where(F.col("file").rlike(r"(?i)\.(c|cc|cpp|cxx|h|hh|hpp)$"))
    told = files.join(said, "cve_id", "left")
    rank = F.when(F.lower("file") == F.col("named"), 0).when(F.lower("text").contains(F.lower("file")), 1).otherwise(2)
    order = F.struct(rank.alias("a"), "patch_no", (~F.col("file").rlike(r"(?i)\.(c|cc|cpp|cxx)$")).alias("h"), "i")
    patched = told.groupBy("cve_id").agg(F.min_by("file", order).alias("file"))
    prose = said.where(F.regexp_extract("text", FILE_IN_PROSE, 1) != "").select("cve_id", F.regexp_extract("text", FILE_IN_PROSE, 1).alias("file"))
    return precedence([patched, prose], ["cve_id"])


def hunk_functions(patches: DataFrame, files: DataFrame) -> DataFrame:
    """(cve_id, name): functions in hunk heads, of the affected file only where one is known (cve_id, file)."""
    key = ["cve_id", "patch_no"]
    lines = patches.select(*key, F.posexplode(F.split("text", "\n")).alias("i", "line"))
    file = F.last(F.when(F.col("line").startswith("+++ b/"), F.lower(F.regexp_extract("line", r"([^/\s]+)\s*$", 1))), True).over(Window.partitionBy(*key).orderBy("i"))
    heads = lines.withColumn("at", file).withColumn("name", F.regexp_extract("line", HUNK_FUNCTION, 1)).where("name != ''").where(plausible_function(F.col("name")))
    known_file = files.select("cve_id", F.lower(F.regexp_extract("file", "([^/]+)$", 1)).alias("wanted"))
    return heads.join(known_file, "cve_id", "left").where("wanted is null or at = wanted").select("cve_id", "name").distinct()


def subjects(patches: DataFrame) -> DataFrame:
    """(cve_id, place, subject): commit subjects, security ones first."""
    lines = patch_lines(patches, ["cve_id", "patch_no"], "text").where(F.col("line").startswith("Subject: "))
    subject = F.trim(F.regexp_replace("line", r"^Subject:\s*(?:\[.*?\]\s*)*", ""))
    return lines.select("cve_id", F.struct((~subject.rlike(SECURITY_SUBJECT)).alias("a"), "patch_no", "line_no").alias("place"), subject.alias("subject"))


def rank_functions(candidates: DataFrame, texts: DataFrame, said: DataFrame) -> DataFrame:
    """(cve_id, value): the best candidate (cve_id, name): in the advisory text 10, in a subject 8, like a library name 2, like a test -5."""
    spoken = said.groupBy("cve_id").agg(F.lower(F.array_join(F.collect_list("subject"), " ")).alias("subjects"))
    low = F.lower("name")
    mixed = F.col("name").contains("_") | ((F.col("name") != low) & (F.col("name") != F.upper("name")))
    points = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    scored = candidates.join(texts.select("cve_id", F.lower("text").alias("text")), "cve_id", "left").join(spoken, "cve_id", "left").where(plausible_function(F.col("name")))
    scored = scored.withColumn("score", points(F.col("text").contains(low), 10) + points(F.col("subjects").contains(low), 8) + points(mixed, 2) - points(low.rlike(TEST_NAME), 5))
    return top_k(scored, ["cve_id"], [F.desc("score"), "name"], 1).select("cve_id", F.col("name").alias("value"), "text")


def subject_function(said: DataFrame, blocked: DataFrame) -> DataFrame:
    """(cve_id, value): the function that the first telling subject names: by an advisory phrase, as a prefix, after in, or as a call."""
    keyed = said.withColumn("id", F.to_json(F.struct("cve_id", "place")))
    phrase = function_from_text(keyed, "id", "subject", blocked).select("id", F.lit(0).alias("way"), "value")
    ways = (r"^([a-zA-Z_]\w+)\s*:", r"(?i)\b(?:fix|patch|resolve|address)\b.*?\bin\s+([a-zA-Z_]\w+)\s*$", r"\b([a-zA-Z_]\w+)\(\)")
    others = [keyed.select("id", F.lit(i).alias("way"), F.regexp_extract("subject", p, 1).alias("value")).where("value != ''") for i, p in enumerate(ways, 1)]
    rows = reduce(DataFrame.unionByName, [phrase, *others]).where(plausible_function(F.col("value")))
    rows = rows.join(blocked.select(F.lower("name").alias("b")), F.lower("value") == F.col("b"), "left_anti").join(keyed.select("id", "cve_id", "place"), "id")
    return first_wins(rows.select("cve_id", "value", "place", "way"), ["cve_id"], ["place", "way"]).select("cve_id", "value")


def affected_function(texts: DataFrame, patches: DataFrame, files: DataFrame, pages: DataFrame, blocked: DataFrame, known_functions: DataFrame, override: DataFrame) -> DataFrame:
    """(cve_id, value, step): the affected function by the first step that has one.

    Steps: 0 a hunk's function that the text or the code base confirms, 1 the
    advisory texts (cve_id, rank, text) in order, known functions first, 2
    commit subjects, 3 hunks, 4 bug-tracker pages, 5 a recorded outside answer.
    """
    main = first_wins(texts, ["cve_id"], ["rank"]).select("cve_id", "text")
    said = subjects(patches)
    hunk = rank_functions(hunk_functions(patches, files), main, said)
    real = known_functions.select(F.col("name").alias("value")).distinct().withColumn("real", F.lit(True))
    named = F.regexp_like("text", F.concat(F.lit(r"(?i)\b"), F.lower("value"), F.lit(r"\b")))
    confirmed = hunk.join(real, "value", "left").where(F.coalesce("real", F.lit(False)) | F.coalesce(named, F.lit(False)))
    keyed = texts.withColumn("id", F.to_json(F.struct("cve_id", "rank")))
    prose = function_from_text(keyed, "id", "text", blocked).join(keyed.select("id", "cve_id", "rank"), "id").join(real, "value", "left").withColumn("unknown", F.col("real").isNull())
    told = first_wins(prose.select("cve_id", "value", "unknown", "rank"), ["cve_id"], ["unknown", "rank"])
    tracked = pages.withColumn("id", F.to_json(F.struct("cve_id", "place")))
    page = first_wins(function_from_text(tracked, "id", "text", blocked).join(tracked.select("id", "cve_id", "place"), "id").select("cve_id", "value", "place"), ["cve_id"], ["place"])
    steps = [confirmed, told, subject_function(said, blocked), hunk, page, override]
    return precedence([s.select("cve_id", "value", F.lit(i).alias("step")) for i, s in enumerate(steps)], ["cve_id"])


def class_rules(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """Entries (id, cwe) with the rows of a rule table (cwe, ...) for their weakness classes; ids may lack the prefix or hold several."""
    each = entries.select("id", F.explode(F.split(F.upper(F.coalesce("cwe", F.lit(""))), "[, ]+")).alias("c"))
    norm = F.when(F.col("c").rlike(r"^\d+$"), F.concat(F.lit("CWE-"), "c")).otherwise(F.col("c"))
    return each.select("id", norm.alias("cwe")).distinct().join(rules, "cwe")


def earliest_fix(commits: DataFrame, fixes: DataFrame, remote: Column) -> DataFrame:
    """The earliest commit (hash, time) among recorded fixes (repo, commit) of the same canonical repository.

    Fixes may shorten a hash. The lengths they have are counted first, so that each hash is looked up by its beginnings of these lengths.
    """
    from sparkscope.functions.names import repository_url

    own = fixes.where((repository_url(F.col("repo")) == repository_url(remote)) & F.col("commit").isNotNull()).select("commit").distinct()
    longest = commits.agg(F.max(F.length("hash"))).first()[0] or 0
    lengths = sorted(r[0] for r in own.select(F.length("commit").alias("l")).distinct().where(F.col("l") <= longest).collect())  # as many as a hash has characters
    begins = F.array(*(F.substring("hash", 1, n) for n in lengths)) if lengths else F.array().cast("array<string>")
    asked = commits.select("hash", "time", F.explode(F.array_distinct(begins)).alias("commit"))
    return top_k(asked.join(own, "commit", "left_semi"), [], ["time", "hash"], 1).select("hash", "time")


def repair_rules(details: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rules): what findings (keys, text) ask to be repaired, by words in all of a candidate's findings, six at most."""
    words = (
        ("shape_structure", r"structured input shaping|structured container|raw data/size directly"), ("feed_in_steps", "incremental|chunked|feed or update"), ("use_real_objects", "support object|null placeholders"),
        ("reach_work_units", "work unit|row|block|decoded"), ("vary_constants", r"(?s)(?=.*constant)(?=.*(?:table|config|palette)).*"),
        ("contain_errors", "deadly signal|abnormally|null callback placeholders|error recovery|abort"),
    )
    joined = details.groupBy(*keys).agg(F.lower(F.array_join(F.collect_list("text"), " ")).alias("t"))
    hit = F.array_compact(F.array(*(F.when(F.col("t").rlike(p), F.lit(n)) for n, p in words)))
    return joined.select(*keys, F.when(F.size(hit) > 0, hit).otherwise(F.array(F.lit("rewrite"))).alias("rules"))


def commit_messages(patches: DataFrame) -> DataFrame:
    """(cve_id, patch_no, sub_no, message): subject and body of each mail-format patch, up to its file list."""
    lines = patch_lines(patches, ["cve_id", "patch_no"], "text")
    by_sub = Window.partitionBy("cve_id", "patch_no", "sub_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.max(F.col("line").startswith("Subject:")).over(by_sub)
    ended = F.max(F.trim("line") == "---").over(by_sub)
    kept = lines.withColumns({"begun": begun, "ended": ended}).where("begun and not ended")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.regexp_replace("line", r"^Subject:\s*(?:\[.*?\]\s*)*", "").alias("t")))), lambda x: x["t"]), "\n")
    return kept.groupBy("cve_id", "patch_no", "sub_no").agg(F.trim(text).alias("message"))
