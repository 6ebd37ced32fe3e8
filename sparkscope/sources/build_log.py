"""Build logs: JSON lines of compiler calls, and questions about them. ``ord`` is the place in the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkscope.operators.ordered import first_wins, top_k

SCHEMA = T.StructType([
    T.StructField("argv", T.ArrayType(T.StringType())), T.StructField("cwd", T.StringType()),
    T.StructField("env", T.MapType(T.StringType(), T.StringType())), T.StructField("ll_file", T.StringType()),
])
# Common header folders, parts of test binaries' names, link flags of fuzzing engines, and flags that are always linked.
COMMON_INCLUDES = ("include", "includes", "inc", "lib", "src")
TEST_PARTS = (
    "test", "unity", "example", "demo", "sample", "parse_hex4", "parse_number", "parse_string", "parse_array", "parse_object", "parse_value", "parse_examples", "parse_with_opts",
    "print_hex4", "print_number", "print_string", "print_array", "print_object", "print_value", "misc_tests", "compare_tests", "cjson_add", "readme_examples", "cmTC_",
)
ENGINE_FLAGS = ("-lcentipede_runner", "-ldislocator", "-ltokencap", "-lcompcov", "-lFuzzingEngine", "-lafl", "-lhfuzz", "-lhonggfuzz", "-lAFLDriver", "-lqasan")
BASIC_FLAGS = ("-lm", "-pthread")
SOURCE = r"\.(c|cpp|cc)$"


def read_build_log(spark: SparkSession, path: str) -> DataFrame:
    """(ord, argv, cwd, env, ll_file); lines that are not JSON objects with argv are skipped, a missing cwd is ``.``."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("ord", "line"))
    return parse_build_log(lines)


def parse_build_log(lines: DataFrame) -> DataFrame:
    """The same from (ord, line)."""
    parsed = lines.select("ord", F.from_json("line", SCHEMA).alias("r")).where("r.argv is not null").select("ord", "r.*")
    return parsed.withColumn("cwd", F.coalesce("cwd", F.lit(".")))


def arguments(commands: DataFrame) -> DataFrame:
    """(ord, cwd, at, arg, next): arguments with the one after each; read off the array, so nothing is shuffled."""
    zipped = F.arrays_zip(F.col("argv").alias("arg"), F.concat(F.slice("argv", F.lit(2), F.size("argv")), F.array(F.lit(None).cast("string"))).alias("next"))
    return commands.select("ord", "cwd", F.posexplode(zipped).alias("at", "a")).select("ord", "cwd", "at", "a.arg", "a.next")


def _resolved(path: Column, base: Column) -> Column:
    joined = F.when(path.startswith("/"), path).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), path))
    clean = F.regexp_replace(F.regexp_replace(joined, r"/(\./)+", "/"), r"/\.$", "")
    for _ in range(8):
        clean = F.regexp_replace(clean, r"/(?!\.\.(?:/|$))[^/]+/\.\.(?=/|$)", "")
    return F.regexp_replace(F.regexp_replace(clean, "/{2,}", "/"), "(?<=.)/$", "")


def include_paths(commands: DataFrame) -> DataFrame:
    """(ord, path): include folders against each command's cwd, each once, in order of first mention."""
    args = arguments(commands)
    path = F.when(F.col("arg").startswith("-I") & (F.length("arg") > 2), F.substring("arg", 3, 1 << 20)).when(F.col("arg") == "-I", F.col("next"))
    rows = args.select(F.struct("ord", "at").alias("ord"), _resolved(path, F.col("cwd")).alias("path")).where("path is not null")
    return rows.groupBy("path").agg(F.min("ord").alias("ord")).select("ord", "path")


def public_include_dirs(commands: DataFrame, root: str, folders: DataFrame) -> DataFrame:
    """(path): include folders below the root that exist (``folders`` has path), common ones, and the root itself."""
    base = root.rstrip("/")
    inside = include_paths(commands.withColumn("cwd", F.lit(base))).where(F.col("path").startswith(base)).select("path")
    common = commands.sparkSession.createDataFrame([(f"{base}/{c}",) for c in COMMON_INCLUDES], "path string")
    there = inside.union(common).join(folders.select("path"), "path", "left_semi")
    return there.union(commands.sparkSession.createDataFrame([(base,)], "path string")).distinct()


def outputs(commands: DataFrame) -> DataFrame:
    """Commands with ``output``, what follows the first ``-o``, and its base name."""
    at = F.array_position("argv", "-o")
    out = F.when(at > 0, F.get("argv", at.cast("int")))
    return commands.withColumn("output", out).where("output is not null").withColumn("base", F.element_at(F.split("output", "/"), -1))


def is_test_binary(output: Column, argv: Column) -> Column:
    named = F.lit(False)
    for p in TEST_PARTS:
        named = named | F.lower(output).contains(p)
    return named | F.exists(argv, lambda a: F.lower(a).rlike("test|unity") & a.rlike(r"\.(c|cpp|cc|o)$"))


def link_command(commands: DataFrame, binary: str | None = None, skip_tests: bool = True) -> DataFrame:
    """The last command that links a program: the one of the given base name, else the last that is no test."""
    linked = outputs(commands).where(~F.col("output").endswith(".o") & ~F.col("output").contains(".so") & ~F.col("output").endswith(".a"))
    if binary is not None:
        linked = linked.where(F.col("base") == binary.rsplit("/", 1)[-1])
    elif skip_tests:
        linked = linked.where(~is_test_binary(F.col("output"), F.col("argv")))
    return top_k(linked, [], [F.desc("ord")], 1)


def library_name(base: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(base, "^lib", ""), r"\."), 1)


def shared_library(commands: DataFrame) -> DataFrame:
    """The shared library of the shortest name; of equal ones the last built."""
    built = outputs(commands).where(F.col("output").contains(".so") & ~F.col("output").endswith(".o")).withColumn("name", library_name(F.col("base")))
    full = F.when(F.col("output").startswith("/"), F.col("output")).otherwise(F.concat_ws("/", "cwd", "output"))
    return top_k(built, [], [F.length("name"), F.desc("ord")], 1).select("ord", "output", "cwd", "name", full.alias("full_path"))


def static_library(commands: DataFrame) -> DataFrame:
    return top_k(outputs(commands).where(F.col("output").endswith(".a")), [], [F.desc("ord")], 1).select("ord", "output", "cwd")


def object_files(commands: DataFrame) -> DataFrame:
    """(ord, output, cwd, source): objects of library sources, each once, last built first."""
    low = lambda c: F.lower(c)
    source = F.element_at(F.filter("argv", lambda a: a.rlike(SOURCE) & ~low(a).rlike("test|example|unity")), 1)
    built = outputs(commands).where(F.col("output").endswith(".o") & F.array_contains("argv", "-c") & ~low(F.col("output")).rlike("test|example"))
    built = built.where(~F.coalesce("cwd", F.lit("")).rlike(r"[/\\](tests?|example)")).withColumn("source", F.try_element_at(F.filter("argv", lambda a: a.rlike(SOURCE) & ~low(a).rlike("test|example|unity")), F.lit(1)))
    rows = built.where("source is not null").select("output", (-F.col("ord")).alias("back"), "ord", "cwd", "source")
    return first_wins(rows, ["output"], ["back"]).drop("back")


def compile_command(commands: DataFrame) -> DataFrame:
    """The last command that compiles a source that is no test."""
    good = F.exists("argv", lambda a: a.rlike(SOURCE) & ~F.lower(a).contains("test")) & F.array_contains("argv", "-c")
    return top_k(commands.where(good), [], [F.desc("ord")], 1)


def project_root(commands: DataFrame) -> DataFrame:
    """(root): the folder above the first build folder a command ran in."""
    builds = commands.where(F.col("cwd").rlike("(^|/)(build|_rf_build)$"))
    return top_k(builds, [], ["ord"], 1).select(F.regexp_replace("cwd", "/?[^/]+$", "").alias("root"))


def link_flags(commands: DataFrame) -> DataFrame:
    """(place, flag): libraries of link commands from the last to the first, each once, then the basic ones."""
    linked = outputs(commands).where(~F.col("output").endswith(".o"))
    rows = arguments(linked).where((F.col("arg").startswith("-l") | (F.col("arg") == "-pthread")) & ~F.col("arg").isin(*ENGINE_FLAGS))
    flags = rows.groupBy(F.col("arg").alias("flag")).agg(F.min(F.struct((-F.col("ord")).alias("a"), F.col("at").alias("b"))).alias("place"))
    basic = commands.sparkSession.createDataFrame([(f, i) for i, f in enumerate(BASIC_FLAGS)], "flag string, i int").join(flags, "flag", "left_anti")
    return flags.select("place", "flag").union(basic.select(F.struct(F.lit(1 << 40).alias("a"), F.col("i").alias("b")).alias("place"), "flag"))


def has_sanitizer(argv: Column) -> Column:
    return F.exists(argv, lambda a: a.contains("-fsanitize="))


def add_flags(argv: Column, flags: tuple[str, ...]) -> Column:
    """``argv`` with the missing flags right after the compiler."""
    missing = F.filter(F.array(*map(F.lit, flags)), lambda f: ~F.array_contains(argv, f))
    return F.concat(F.slice(argv, F.lit(1), F.lit(1)), missing, F.slice(argv, F.lit(2), F.size(argv)))


def find_library(files: DataFrame, root: str) -> DataFrame:
    """(path, name, type) of the library to link among files (path): by folder, then pattern, then the shortest base name."""
    base, folder = F.regexp_extract("path", r"([^/]+)$", 1), F.regexp_replace("path", "/[^/]+$", "")
    top = root.rstrip("/")
    where = F.when(folder == top, 0).when(folder == f"{top}/.libs", 1).when(folder == f"{top}/_rf_build", 2).when(folder == f"{top}/build", 3).when(folder.rlike(r"/(\.libs|build|_rf_build)$"), 4)
    below = F.when(folder.rlike(r"/(\.libs|build|_rf_build)/[^/]+$"), 5)
    kind = F.when(base.rlike(r"^lib.*\.a$"), 0).when(base.rlike(r"^lib.*\.so$"), 1).when(base.rlike(r"^lib.*\.so\."), 2)
    found = files.withColumns({"_w": F.coalesce(where, below), "_k": kind, "_b": base}).where("_w is not null and _k is not null")
    return top_k(found, [], ["_w", "_k", F.length("_b"), "path"], 1).select("path", library_name(F.col("_b")).alias("name"), F.when(F.col("_k") == 0, "static").otherwise("shared").alias("type"))


def ir_files(commands: DataFrame, listed: DataFrame) -> DataFrame:
    """(path): IR files found below the root and those that the log names, each once."""
    return listed.select("path").union(commands.where("ll_file is not null").select("ll_file")).distinct()


def strategy(library: DataFrame, shared: DataFrame, link: DataFrame, objects: DataFrame) -> DataFrame:
    """(strategy): how a program would be linked: a project library, a shared one, a link command, or objects."""
    branches = [(library, "project_library"), (shared, "shared_library"), (link, "link_command"), (objects, "objects")]
    rows = [df.limit(1).select(F.lit(i).alias("i"), F.lit(n).alias("strategy")) for i, (df, n) in enumerate(branches)]
    from functools import reduce

    return top_k(reduce(DataFrame.union, rows), [], ["i"], 1).drop("i")


# Folders without headers or libraries to use, and symbol parts of libraries that a static one needs (part, flag, own names).
SKIPPED_FOLDERS = (
    ".git", ".svn", ".hg", "__pycache__", "CMakeFiles", "node_modules", "tests", "test", "testsuite", "fuzz", "fuzzing", "benchmark", "benchmarks", "doc", "docs", "examples", "example", "private", "internal",
)
SYMBOL_LIBRARIES = (
    ("lzma_", "-llzma", ("lzma", "xz")), ("BZ2_", "-lbz2", ("bz2", "bzip2")), ("ZSTD_", "-lzstd", ("zstd",)), ("icuuc", "-licuuc", ("icuuc",)), ("icui18n", "-licui18n", ("icui18n",)),
    ("SSL_", "-lssl", ("ssl", "openssl")), ("EVP_", "-lcrypto", ("crypto", "openssl")), ("deflateInit", "-lz", ("z", "zlib")), ("inflateInit", "-lz", ("z", "zlib")), ("gzopen", "-lz", ("z", "zlib")),
    ("gzdopen", "-lz", ("z", "zlib")), ("gzread", "-lz", ("z", "zlib")), ("gzwrite", "-lz", ("z", "zlib")), ("gzclose", "-lz", ("z", "zlib")), ("jpeg_", "-ljpeg", ("jpeg", "libjpeg")),
    ("png_", "-lpng", ("png", "libpng")), ("jbg_", "-ljbig", ("jbig",)), ("acl_get_", "-lacl", ("acl",)), ("acl_set_", "-lacl", ("acl",)), ("acl_create", "-lacl", ("acl",)), ("LZ4_", "-llz4", ("lz4",)),
    ("lzo1x_", "-llzo2", ("lzo2",)), ("XML_Parse", "-lexpat", ("expat",)), ("xmlReadDoc", "-lxml2", ("xml2", "libxml2")),
)


MARKERS = ("configure", "configure.ac", "configure.in", "CMakeLists.txt", "Makefile", "meson.build")


def build_system(listing: DataFrame, tools: DataFrame) -> DataFrame:
    """(root, system) from marker files (root, file) at project roots and the build tools (name) at hand; of a root's files only marks are kept."""
    cmake = tools.agg(F.coalesce(F.bool_or(F.col("name") == "cmake"), F.lit(False)).alias("cmake"))
    has = {m: F.col(f"_{i}") for i, m in enumerate(MARKERS)}
    marked = listing.groupBy("root").agg(*(F.coalesce(F.bool_or(F.col("file") == m), F.lit(False)).alias(f"_{i}") for i, m in enumerate(MARKERS))).crossJoin(F.broadcast(cmake))
    input_ = has["configure.ac"] | has["configure.in"]
    system = (
        F.when(has["configure"] & (~F.col("cmake") | input_), "autotools").when(has["CMakeLists.txt"] & F.col("cmake"), "cmake").when(has["Makefile"], "make")
        .when(has["meson.build"], "meson").when(has["configure"] | input_, "autotools").otherwise("unknown")
    )
    return marked.select("root", system.alias("system"))


def extra_libraries(undefined: DataFrame, rules: tuple = SYMBOL_LIBRARIES) -> DataFrame:
    """(library, ord, flag): flags for the undefined symbols (library, symbol) of static libraries, not for a library itself; rule order."""
    name = F.lower(F.col("library"))

    def own(names: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for n in names:
            out = out | name.startswith(n)
        return out

    hits = F.array_compact(F.array(*(F.when(F.col("symbol").contains(p) & ~own(names), F.struct(F.lit(i).alias("ord"), F.lit(flag).alias("flag"))) for i, (p, flag, names) in enumerate(rules))))
    rows = undefined.select("library", F.explode(hits).alias("h"))
    return rows.groupBy("library", F.col("h.flag").alias("flag")).agg(F.min("h.ord").alias("ord")).select("library", "ord", "flag")


def search_paths(files: DataFrame, limit: int = 120) -> DataFrame:
    """(kind, value): folders with headers, folders with libraries, and library names, each kind sorted and cut to a limit."""
    seen = files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED_FOLDERS))))
    folder, base = F.regexp_replace("path", "/[^/]*$", ""), F.regexp_extract("path", "([^/]+)$", 1)
    library = base.rlike(r"^lib.+\.(a|so(\..*)?)$")
    found = F.array_compact(F.array(
        F.when(base.endswith(".h"), F.struct(F.lit("include").alias("kind"), folder.alias("value"))),
        F.when(library, F.struct(F.lit("library_dir").alias("kind"), folder.alias("value"))),
        F.when(library, F.struct(F.lit("library").alias("kind"), library_name(base).alias("value"))),
    ))
    return top_k(seen.select(F.explode(found).alias("f")).select("f.*").distinct(), ["kind"], ["value"], limit)
