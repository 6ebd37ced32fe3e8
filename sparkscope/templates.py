"""Templates of the texts that the program side reads: ``<<k>>`` and the like stand for numbers of a table's row."""

IR = """define void @set<<k>>(%struct.S<<k>>* %s) {
  %1 = getelementptr inbounds %struct.S<<k>>, %struct.S<<k>>* %s, i32 0, i32 <<b>>
  store void (i8*)* @target<<k>>, void (i8*)** %1, align 8
}
define void @other<<k>>(%struct.S<<k>>* %s) {
  %1 = getelementptr inbounds %struct.S<<k>>, %struct.S<<k>>* %s, i32 0, i32 <<c>>
  store void (i8*)* @func<<k>>, void (i8*)** %1, align 8
}
define i32 @parse_doc<<k>>(%struct.S<<k>>* %s,
    i8* noundef %data, i32 %mode)
{
  %2 = getelementptr inbounds %struct.S<<k>>, %struct.S<<k>>* %s, i32 0, i32 <<a>>
  %3 = load void (i8*)*, void (i8*)** %2, align 8
  call void %3(i8* %data)
  %4 = call i32 @helper<<k>>(i8* %data, i32 %mode)
}
define void @target<<k>>(i8* %p) {
}
define void @func<<k>>(i8* %p) {
}
declare i32 @helper<<k>>(i8* %a, i32 %b)
define void @virt<<k>>(ptr %o) {
  %v = load ptr, ptr %o
  %s = getelementptr inbounds ptr, ptr %v, i64 <<v>>
  %f = load ptr, ptr %s
  call void %f(ptr %o)
}
@_ZTV4Base = constant { [4 x ptr] } { [4 x ptr] [ptr null, ptr @_ZTI4Base, ptr @_ZN4Base3fooEv, ptr @_ZN4Base3barEv] }
"""

SOURCE = r"""#define MAX_MODE <<s>>
enum { FLAG_A = <<k>>, FLAG_B };
int inflateGetHeader(struct z *strm, struct hdr *head);
static int inflate(strm, flush)
    struct z<<a>> *strm;
    int flush;
{
    // files.Better than state
    if (strm == Z_NULL || strm->state == Z_NULL) return Z_STREAM_ERROR;
    if (flush == Z_FINISH<<s>>) goto fail_end;
    while (strm->avail_in > <<a>> && head->extra<<b>> != Z_NULL) {
        switch (state->mode) {
        case HEAD<<b>>: updatewindow<<s>>(strm); break;
        default: break;
        }
        strm->avail_in--;
    }
    head->extra_max = buf[0] == 0x1f && buf[1] == 0x8b;
fail_end:
    return -1;
}
int ansi(const char *name, int mode, char **out, size_t len) const {
    if (len > (1 << mode)) return 1;
    return parse_rows(name, len);
}
"""

BUILD_LOG = (
    '{"argv": ["cc", "-Iinc<<b>>", "-I", "../sys<<a>>", "-c", "a<<k>>.c", "-o", "a<<k>>.o"], "cwd": "/p/build"}',
    "broken <<k>>",
    '{"argv": ["cc", "-shared", "-o", "libfoo_util<<k>>.so.1", "a<<k>>.o", "-lz<<b>>"], "cwd": "/p/build"}',
    '{"argv": ["cc", "-shared", "-o", "libfoo<<k>>.so.1", "a<<k>>.o", "-lm", "-lafl", "-lz<<b>>"], "cwd": "/p/build"}',
    '{"argv": ["cc", "a<<k>>.o", "-o", "bin/tool<<k>>", "-pthread"], "cwd": "/p"}',
    '{"argv": ["cc", "a<<k>>.o", "-o", "run_tests"], "cwd": "/p"}',
)

HEADER = """#define FOO_API __attribute__((visibility("default")))
/* int hidden<<k>>(int a); */
FOO_API int foo<<k>>_open(const char *path, int flags<<a>>);
int foo<<k>>_plain(void); // int gone<<k>>(int x);
int prose<<k>>(if the file has been opened);
"""

SYMBOLS = (
    ("a<<k>>.so", "readelf", "  42: 01a000 1234 FUNC GLOBAL DEFAULT 13 foo<<s>>_read@@V1\n 43: 0 1 FUNC LOCAL DEFAULT 13 loc\n 45: 0 1 FUNC GLOBAL DEFAULT 13 malloc"),
    ("a<<k>>.so", "nm", "0 T foo_nm<<s>>"),
    ("b<<k>>.a", "readelf", "nothing"),
    ("b<<k>>.a", "nm", "b.a:x.o:\n0 T bar<<s>>\n0 t local"),
)

CALLBACKS = "static void row_callback<<k>>(int a)\n{\n  png_set_quantize(info_ptr);\n}\nvoid set_read_fn<<k>>(int a) {\n  p->read_fn = a;\n  p->row_fn = 0;\n  png_set_quantize(a);\n}\n"

PATCH = """From 0123456789012345678901234567890123456789 Mon Sep 17
Subject: [PATCH 1/2] Fix heap overflow CVE-2020-<<id>>
---
 lib/a.c | 2 +-
diff --git a/lib/a.c b/lib/a.c
--- a/lib/a.c
+++ b/lib/a.c
@@ -1,2 +1,2 @@ int foo_bar<<k>>(int x)
-  old = 1 << n<<s>>;
+  if (n<<s>> > 0x100) return;
From abcdefabcdefabcdefabcdefabcdefabcdefabcd Mon Sep 17
Subject: [PATCH 2/2] release version bump
diff --git a/lib/b.h b/lib/b.h
--- a/lib/b.h
+++ b/lib/b.h
@@ -1 +1 @@
-#define B_VERSION 1
+#define B_VERSION 2
"""

RAW_CODE = "int f(const uint8_t *data, size_t size) {\n  feed_it(data, size);\n  if (setjmp(b)) abort();\n}"
SHAPED_CODE = """int f(const uint8_t *data, size_t size) {
  std::vector<uint8_t> container;
  int depth = data[0] % 8;
  set_header(state, depth);
  int limit = 1 << depth;
  for (size_t i = 0; i < size; i++) container.push_back(data[i]);
  num_rows = limit;
  parse_it(container.data(), container.size());
}"""

_FEED, _LOOP = "int f() {\n  feed_it(x);\n}", "int f() {\n  for (;;) feed_it(x);\n}"
_STATE = {"roles": [("ctx", "state")], "error_calls": 1}
_STAGE = {"entry": "entry", "deferred_transform": True, "transform_calls": ["png_quantize"]}
_BUILT = "int f() {\n  std::vector<uint8_t> container;\n  container.push_back(1);\n  feed_it(container.data());\n}"
#: For each rule: a plan, a text that breaks the rule, and one that keeps it.
RULE_CASES = (
    ("MISSING_REPEATED_RECORDS_LOOP", {"operators": ["repeated-records"]}, _FEED, _LOOP),
    ("RAW_BUFFER_SEMANTIC_ARGS", {"primary": "semantic-arguments"}, "int f() {\n  feed_it(data, size);\n}", "int f() {\n  feed_it(args.data(), args.size());\n}"),
    ("MISSING_TRIGGER_CONTROL_SELECTOR", {"trigger_controls": ["mode"]}, _FEED, "int f() {\n  feed_it(data[0] % 4);\n}"),
    ("ENTROPY_OVER_SPREAD", {"policies": ["stabilize"]}, "int f() {\n" + "  x += data[1];\n" * 9 + "  feed_it(x);\n}", "int f() {\n  x += data[1];\n  feed_it(x);\n}"),
    ("BROAD_SETUP_MODE_SWITCH", {"profiles": 1}, "int f() {\n  int state = 0;\n  a = COLOR_RGB;\n  b = MODE_A;\n  c = TYPE_B;\n  feed_it(a);\n}", "int f() {\n  int state = 0;\n  a = COLOR_RGB;\n  feed_it(a);\n}"),
    ("MISSING_SETUP_REQUIREMENT", {"setup_requirements": ["initialise decoder before use"]}, _FEED, "int f() {\n  decoder_t d;\n  feed_it(&d);\n}"),
    ("NULL_HELPER_CALL", {"support_words": ["header"]}, "int f() {\n  set_header(NULL, 4);\n  feed_it(x);\n}", "int f() {\n  set_header(ctx, 4);\n  feed_it(x);\n}"),
    ("WEAK_SUPPORT_OBJECT_SOFT", {"entry": "parse_it", "support": [("table", ["rows", "cols"])]}, "int f() {\n  table t;\n  parse_it(t);\n}", "int f() {\n  table t;\n  t.rows = t.cols = 2;\n  parse_it(t);\n}"),
    ("WEAK_SUPPORT_OBJECT", {"support": [("table", ["rows", "cols"])]}, "int f() {\n  table t;\n  feed_it(t);\n}", "int f() {\n  table t;\n  t.rows = t.cols = 2;\n  feed_it(t);\n}"),
    ("NULL_CALLBACK_SETUP_SOFT", {**_STATE, "entry": "parse_it"}, "int f() {\n  ctx_create(NULL, NULL);\n  parse_it(ctx);\n}", "int f() {\n  ctx_create(on_error, on_warning);\n  parse_it(ctx);\n}"),
    ("NULL_CALLBACK_SETUP", _STATE, "int f() {\n  ctx_create(NULL, NULL);\n  feed_it(ctx);\n}", "int f() {\n  ctx_create(on_error, on_warning);\n  feed_it(ctx);\n}"),
    ("MISSING_OBJECT_LIFECYCLE", {"milestones": ["object-lifecycle"]}, _FEED, "int f() {\n  object_init(x);\n  feed_it(x);\n}"),
    ("MISSING_CONTAINER_SHAPING", {"milestones": ["container-parse"], "primary": "structured-format"}, _FEED, _BUILT),
    ("MISSING_INCREMENTAL_FEED", {"milestones": ["incremental-feed"]}, _FEED, _LOOP),
    ("MISSING_TRANSFORM_CONFIG", {"milestones": ["transform-gating"]}, _FEED, "int f() {\n  set_transform(x);\n  feed_it(x);\n}"),
    ("MISSING_DEFERRED_TRANSFORM", {"deferred_transform": True}, _FEED, "int f() {\n  set_transform(x);\n  feed_it(x);\n}"),
    ("EMPTY_TRANSFORM_CALLBACK", {**_STAGE, "placement": ["cb_b"]}, "void cb_b(int x) { }\nint f() {\n  entry(1);\n}", "void cb_b(int x) { png_quantize(x); }\nint f() {\n  entry(1);\n}"),
    ("EARLY_TRANSFORM_CALL", {**_STAGE, "placement": ["cb_a"]}, "void cb_a(int x) { png_quantize(x); }\nint f() {\n  png_quantize(1);\n  entry(1);\n}", "void cb_a(int x) { png_quantize(x); }\nint f() {\n  entry(1);\n}"),
    ("DEAD_SUPPORT_STATE", {**_STAGE, "support_words": ["palette"]}, "int f() {\n  palette[0] = 1;\n  entry(1);\n}", "int f() {\n  palette[0] = 1;\n  entry(palette);\n}"),
    ("WEAK_WORK_UNIT_EVIDENCE", {"milestones": ["work-unit"]}, _FEED, _LOOP),
    ("TRAILING_APPEND_HIGH_VALUE", {"regions": [("header", "field", "high")]}, "int f() {\n  buffer.append(data, size);\n  feed_it(x);\n}", _FEED),
    ("TRAILING_APPEND_WORK_UNIT", {"regions": [("decoded-work-unit", "field", "low")]}, "int f() {\n  buffer.append(data, size);\n  feed_it(x);\n}", _FEED),
    ("CONSTANT_SUPPORT_TABLE", {"regions": [("codes", "table", "low")], "support_words": ["codes"]}, "int f() {\n  codes[0] = 7;\n  feed_it(codes);\n}", "int f() {\n  codes[0] = data[1];\n  feed_it(codes);\n}"),
    ("ENTROPY_TOO_BROAD", {"stabilized": 1, "primary": "structured-format"}, "int f() {\n" + "  x += data[1];\n" * 15 + "  feed_it(x);\n}", "int f() {\n  x += data[1];\n  feed_it(x);\n}"),
    ("WEAK_INVARIANT_EVIDENCE", {"invariants": ["length equals payload"]}, _FEED, "int f() {\n  int length = 4;\n  feed_it(length);\n}"),
)

# Recorded answers of advisory services.
NVD = (
    '{"vulnerabilities": [{"cve": {"descriptions": [{"lang": "es", "value": "x"}, {"lang": "en", "value": "An overflow in fn<<k>> of release <<s>>"}], "metrics": {<<metrics>>}, "references": ['
    '{"url": "https://github.com/o/r<<s>>/commit/<<h1>>", "tags": ["Patch"]}, {"url": "https://github.com/o/r<<s>>/commit/<<h1>>", "tags": []}, {"url": "https://bugzilla.org/<<k>>", "tags": []}, '
    '{"url": "https://github.com/o/r<<s>>/pull/<<k>>", "tags": ["Patch"]}], "weaknesses": [{"description": [{"value": "CWE-<<s>>"}, {"value": "NVD-x"}]}, {"description": [{"value": "CWE-<<a>>"}]}]}}]}'
)
OSV = (
    '{"summary": "s<<k>>", "details": "d", "affected": [{"ranges": [{"repo": "https://github.com/o/r<<s>>.git", "events": [{"introduced": "0"}, {"fixed": "<<h1>>"}]}]}], "references": ['
    '{"type": "FIX", "url": "https://github.com/mirror/r/commit/<<h1>>/"}, {"type": "WEB", "url": "https://github.com/o/r<<s>>/commit/<<h2>>"}]}'
)
GITHUB = '[{"summary": "gs<<k>>", "severity": "rated <<s>>"}]'
