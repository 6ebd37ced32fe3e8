import json

from pyspark.sql import functions as F

from sparkscope.operators import lifecycle, retrieval
from sparkscope.sources import build_log, headers


def log(spark, *commands):
    lines = [json.dumps(c) for c in commands] + ["not json", "{}", ""]
    return build_log.parse_build_log(spark.createDataFrame(list(enumerate(lines)), "ord int, line string"))


def test_build_log(spark, tmp_path):
    one = {"argv": ["cc", "-Iinc", "-I", "../sys", "-c", "a.c", "-o", "a.o"], "cwd": "/p/build", "ll_file": "/p/a.ll"}
    two = {"argv": ["cc", "-c", "test_b.c", "-o", "test_b.o"], "cwd": "/p/build"}
    so = {"argv": ["cc", "-shared", "-o", "libfoo_util.so.1", "a.o", "-lz"], "cwd": "/p/build"}
    main = {"argv": ["cc", "-shared", "-o", "libfoo.so.1", "a.o", "-lm", "-lafl", "-lz"], "cwd": "/p/build"}
    exe = {"argv": ["cc", "a.o", "-o", "bin/tool", "-pthread", "-fsanitize=address"], "cwd": "/p"}
    test = {"argv": ["cc", "a.o", "-o", "run_tests"], "cwd": "/p"}
    ar = {"argv": ["ar", "-o", "libfoo.a"], "cwd": "/p"}
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join(map(json.dumps, (one, two, so, main, exe, test, ar))) + "\nbad\n")
    c = build_log.read_build_log(spark, str(path))
    assert c.count() == 7
    assert [r.path for r in build_log.include_paths(c).orderBy("ord").collect()] == ["/p/build/inc", "/p/sys"]
    folders = spark.createDataFrame([("/p/inc",), ("/p/src",), ("/sys",)], "path string")
    assert {r.path for r in build_log.public_include_dirs(c, "/p", folders).collect()} == {"/p/inc", "/p/src", "/p"}
    assert build_log.link_command(c).first().output == "bin/tool" and build_log.link_command(c, "x/run_tests").first().output == "run_tests"
    assert build_log.link_command(c, skip_tests=False).first().output == "run_tests"
    shared = build_log.shared_library(c).first()
    assert (shared.name, shared.full_path) == ("foo", "/p/build/libfoo.so.1") and build_log.static_library(c).first().output == "libfoo.a"
    assert [(r.output, r.source) for r in build_log.object_files(c).collect()] == [("a.o", "a.c")]
    assert build_log.compile_command(c).first().ord == 0 and build_log.project_root(c).first().root == "/p"
    flags = [r.flag for r in build_log.link_flags(c).orderBy("place").collect()]
    assert flags == ["-pthread", "-lm", "-lz"]
    assert [r.ord for r in c.where(build_log.has_sanitizer(F.col("argv"))).collect()] == [4]
    assert c.where("ord = 2").select(build_log.add_flags(F.col("argv"), ("-lz", "-g")).alias("a")).first().a[:2] == ["cc", "-g"]
    assert {r.path for r in build_log.ir_files(c, spark.createDataFrame([("/p/a.ll",), ("/p/b.ll",)], "path string")).collect()} == {"/p/a.ll", "/p/b.ll"}
    files = spark.createDataFrame([("/p/sub/.libs/libfoo.a",), ("/p/libfoo_util.so",), ("/p/libfo.so",)], "path string")
    assert build_log.find_library(files, "/p").first().path == "/p/libfo.so"
    empty = spark.createDataFrame([], "x int")
    assert build_log.strategy(empty, spark.range(2), spark.range(1), empty).first().strategy == "shared_library"


def test_projects(spark):
    listing = spark.createDataFrame([("a", "configure"), ("a", "CMakeLists.txt"), ("b", "Makefile"), ("c", "configure.ac"), ("d", "x")], "root string, file string")
    tools = spark.createDataFrame([("cmake",)], "name string")
    systems = lambda t: {r.root: r.system for r in build_log.build_system(listing, t).collect()}
    assert systems(tools) == {"a": "cmake", "b": "make", "c": "autotools", "d": "unknown"} and systems(tools.where("false"))["a"] == "autotools"
    undefined = spark.createDataFrame([("tiff", "inflateInit_"), ("tiff", "gzread"), ("tiff", "jpeg_start"), ("zlib", "deflateInit_"), ("png16", "png_x")], "library string, symbol string")
    assert [(r.library, r.flag) for r in build_log.extra_libraries(undefined).orderBy("library", "ord").collect()] == [("tiff", "-lz"), ("tiff", "-ljpeg")]
    files = spark.createDataFrame([("/s/a/x.h",), ("/s/tests/y.h",), ("/s/b/libz.so.1",), ("/s/b/libq.a",)], "path string")
    assert {(r.kind, r.value) for r in build_log.search_paths(files).collect()} == {("include", "/s/a"), ("library_dir", "/s/b"), ("library", "z"), ("library", "q")}


HEADER = """#define FOO_API __attribute__((visibility("default")))
/* int hidden(int a); */
FOO_API int foo_open(const char *path, int flags);
int foo_plain(void); // int gone(int x);
EXTERN int ZEXPORT foo_old OF((int a, char *b));
PNG_EXPORT(1, void, foo_png, (int a));
int prose(if the file has been opened);
"""


def test_headers_and_symbols(spark):
    h = spark.createDataFrame([("inc/foo.h", HEADER), ("inc/foo_priv.h", "int secret(int a);")], "path string, text string")
    got = {r.name: ([(p.type, p.name) for p in r.params], r.source) for r in headers.signatures(h).collect()}
    assert got["foo_open"] == ([("const char", "path"), ("int", "flags")], "declaration") and got["foo_plain"][0] == [] and "hidden" not in got and "secret" not in got and "gone" not in got
    assert got["prose"][0] == []
    recorded = spark.createDataFrame([("foo_open", [("char *", "p")])], "name string, params array<struct<type:string,name:string>>")
    assert {r.name: r.source for r in headers.signatures(h, recorded).collect()}["foo_open"] == "parser"
    assert {r.name for r in headers.exported_functions(h).collect()} == {"foo_open", "foo_png"}
    assert h.where("path = 'inc/foo.h'").select(headers.export_macros(F.col("text")).alias("m")).first().m == ["FOO_API", "__EXPORT__"]
    elf = "  42: 000000000001a000   1234 FUNC    GLOBAL DEFAULT   13 foo_read@@V1\n 43: 0 1 FUNC LOCAL DEFAULT 13 loc\n 44: 0 1 FUNC WEAK HIDDEN 13 hid\n 45: 0 1 FUNC GLOBAL DEFAULT 13 _init\n 46: 0 1 FUNC GLOBAL DEFAULT 13 malloc"
    listings = spark.createDataFrame([("a.so", "readelf", elf), ("a.so", "nm", "0 T foo_nm"), ("b.a", "readelf", "nothing"), ("b.a", "nm", "b.a:x.o:\n0 T bar\n0 t local\nU undef")], "library string, tool string, text string")
    symbols = headers.exported_symbols(listings)
    assert {(r.library, r.name) for r in headers.library_api(symbols).collect()} == {("a.so", "foo_read"), ("b.a", "bar")}
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    none = names("x").where("false")
    public = lambda *a: {r.name for r in headers.public_names(*a).collect()}
    assert public(names("a", "b"), names("b", "c"), none) == {"b"} and public(names("a"), names("c"), none) == {"a"}
    assert public(none, names("c"), names("d")) == {"d"} and public(none, names("c"), none) == {"c"}


def test_lifecycle(spark):
    base = lambda *n: [r.b for r in spark.createDataFrame([(i, x) for i, x in enumerate(n)], "i int, n string").orderBy("i").select(lifecycle.lifecycle_base(F.col("n")).alias("b")).collect()]
    assert base("inflateInit2_", "inflateEnd", "Init", "fooOpenClose_2", None, "x_1") == ["inflate", "inflate", "init", "foo", "", "x"]
    public = spark.createDataFrame([(n,) for n in ("inflateInit_", "inflateInit2_", "inflateEnd", "deflateInit_", "XML_ParserCreate", "XML_Parse")], "name string")
    found = lambda api, phase: [r.name for r in lifecycle.lifecycle_candidates(api, public, phase).orderBy("name").collect()]
    assert found("inflate", "setup") == ["inflateInit2_", "inflateInit_"] and found("inflate", "cleanup") == ["inflateEnd"] and found("XML_Parse", "setup") == ["XML_ParserCreate"]
    helpers = spark.createDataFrame([(0, "inflateEnd", "cleanup"), (1, "other", "cleanup")], "ord int, name string, phase string")
    assert [r.name for r in lifecycle.phase_candidates(helpers, "inflate", public, "cleanup").collect()] == ["inflateEnd"]
    assert [r.name for r in lifecycle.phase_candidates(helpers.where("false"), "inflate", public, "cleanup").collect()] == ["inflateEnd"]
    side = lambda *r: spark.createDataFrame([("k", *x) for x in r], "k string, name string, role string")
    evidence = spark.createDataFrame([("k", "mode")], "k string, name string")
    chosen = lambda s, c: {r.name for r in lifecycle.choose_roles(s, c, evidence, ["k"]).collect()}
    assert chosen(side(("*a", "size"), ("b", "size")), side(("a", "state"), ("b", "control"))) == {"*a", "b"}
    assert chosen(side(("x", "value")), side(("mode", "control"))) == {"mode"} and chosen(side(("mode", "control")), side(("x", "value"))) == {"mode"}


def test_blocks_are_ranked_in_their_files_rows(spark, monkeypatch):
    """The same rows as by a join of calls and blocks, nested and repeated blocks included, in a plan that joins and shuffles no texts."""
    from sparkscope.operators import facts, ordered

    one = "int row_cb{0}(int a)\n{{\n  png_go(info_ptr); palette (é png_stop(a));\n}}\n"
    nested = "int outer{0}(int a) {{\n  png_go(a);\n  int inner{0}(int b) {{\n    png_stop(b); png_go(row_info);\n  }}\n  png_stop (palette);\n}}\npng_go(out);\n"
    texts = [one.format(1), nested.format(2), one.format(3) * 3 + nested.format(3), "png_go(1);", "", None, "int row_cb(int a) { quiet; }"]
    files = spark.createDataFrame([(f"{'tests' if i % 2 else 'src'}/a{i}.c", t) for i, t in enumerate(texts)], "path string, text string")
    tokens = lambda *t: F.array(*map(F.lit, t))
    found = lambda blocks, apis: retrieval.stage_evidence(files, blocks, apis, tokens("png"), tokens("go"), tokens("palette"), tokens("row"), 20)
    for names, n in ((["png_go", "png_stop", "gone"], 8), (["png_stop"], None), (["gone"], None), ([], None), ([None], None)):
        apis = spark.createDataFrame([(x,) for x in names], "name string")
        rows = [list(map(str, found(blocks, apis).collect())) for blocks in (None, facts.function_blocks(files))]
        assert rows[0] == rows[1] and len(rows[0]) > 3 and n in (None, len(rows[0]))
        plan = found(None, apis)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "SortMergeJoin" not in plan and "HashJoin" not in plan
    apis = spark.createDataFrame([("png_go",), ("png_stop",)], "name string")
    few = sorted(map(str, found(None, apis).collect()))
    told = ordered.told
    monkeypatch.setattr(ordered, "told", lambda names, column: told(names, column, 0))
    assert sorted(map(str, found(None, apis).collect())) == few
    # blocks of another source are joined, but not sent to all tasks
    plan = found(facts.function_blocks(files), apis)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_retrieval(spark):
    text = "static void row_callback(int a)\n{\n  png_set_quantize(info_ptr);\n}\nvoid set_read_fn(int a) {\n  p->read_fn = a;\n  p->row_fn = 0;\n  png_set_quantize(a);\n}\n"
    files = spark.createDataFrame([("src/a.c", text), ("tests/b.c", text)], "path string, text string")
    from sparkscope.operators import facts

    tokens = lambda *t: F.array(*map(F.lit, t))
    apis = spark.createDataFrame([("png_set_quantize",)], "name string")
    got = retrieval.stage_evidence(files, facts.function_blocks(files), apis, tokens("png"), tokens("quantize"), tokens("palette"), tokens("row"))
    rows = got.orderBy(F.desc("score"), "function").collect()
    assert (rows[0].file, rows[0].function, rows[0].placement, rows[0].score) == ("src/a.c", "row_callback", "post-parse-callback", 5 + 4 + 3 + 3)
    assert [r.name for r in retrieval.placement_candidates(got).collect()][0] == "row_callback"
    assert {r.function: r.registers for r in rows}["set_read_fn"]
    listing = spark.createDataFrame([("x/a.c",), ("build/b.c",), ("z.txt",), ("y/c.h",)], "path string")
    assert {r.path for r in retrieval.source_files(listing, spark.createDataFrame([("y/c.h",)], "path string"), 1).collect()} == {"y/c.h", "x/a.c"}
