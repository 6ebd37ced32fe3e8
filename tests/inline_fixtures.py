"""Small inline inputs of the program-side operators."""

from sparkscope.templates import RAW_CODE, RULE_CASES, SHAPED_CODE  # noqa: F401

IR = """define void @set(%struct.S* %s) {
  %1 = getelementptr inbounds %struct.S, %struct.S* %s, i32 0, i32 3
  store void (i8*)* @target_func, void (i8*)** %1, align 8
}
define void @other(%struct.S* %s) {
  %1 = getelementptr inbounds %struct.S, %struct.S* %s, i32 0, i32 5
  store void (i8*)* @func_b, void (i8*)** %1, align 8
}
define i32 @parse_doc(%struct.S* %s,
    i8* noundef %data, i32 %mode)
{
  %2 = getelementptr inbounds %struct.S, %struct.S* %s, i32 0, i32 3
  %3 = load void (i8*)*, void (i8*)** %2, align 8
  call void %3(i8* %data)
  %4 = call i32 @helper(i8* %data, i32 %mode)
}
define void @target_func(i8* %p) {
}
define void @func_b(i8* %p) {
}
declare i32 @helper(i8* %a, i32 %b)
define void @virt(ptr %o) {
  %v = load ptr, ptr %o
  %s = getelementptr inbounds ptr, ptr %v, i64 2
  %f = load ptr, ptr %s
  call void %f(ptr %o)
}
@_ZTV4Base = constant { [4 x ptr] } { [4 x ptr] [ptr null, ptr @_ZTI4Base, ptr @_ZN4Base3fooEv, ptr @_ZN4Base3barEv] }
"""

SOURCE = r"""#define MAX_MODE 4
enum { FLAG_A = 1, FLAG_B };
int inflateGetHeader(struct z *strm, struct hdr *head);
static int inflate(strm, flush)
    struct z *strm;
    int flush;
{
    // files.Better than state
    if (strm == Z_NULL || strm->state == Z_NULL) return Z_STREAM_ERROR;
    if (flush == Z_FINISH) goto fail_end;
    while (strm->avail_in > 0 && head->extra != Z_NULL) {
        switch (state->mode) {
        case HEAD: updatewindow(strm); break;
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
    '{"argv": ["cc", "-Iinc", "-I", "../sys", "-c", "a.c", "-o", "a.o"], "cwd": "/p/build"}',
    "broken",
    '{"argv": ["cc", "-shared", "-o", "libfoo_util.so.1", "a.o", "-lz"], "cwd": "/p/build"}',
    '{"argv": ["cc", "-shared", "-o", "libfoo.so.1", "a.o", "-lm", "-lafl", "-lz"], "cwd": "/p/build"}',
    '{"argv": ["cc", "a.o", "-o", "bin/tool", "-pthread"], "cwd": "/p"}',
    '{"argv": ["cc", "a.o", "-o", "run_tests"], "cwd": "/p"}',
)

HEADER = """#define FOO_API __attribute__((visibility("default")))
/* int hidden(int a); */
FOO_API int foo_open(const char *path, int flags);
int foo_plain(void); // int gone(int x);
int prose(if the file has been opened);
"""

SYMBOLS = (
    ("a.so", "readelf", "  42: 01a000 1234 FUNC GLOBAL DEFAULT 13 foo_read@@V1\n 43: 0 1 FUNC LOCAL DEFAULT 13 loc\n 45: 0 1 FUNC GLOBAL DEFAULT 13 malloc"),
    ("a.so", "nm", "0 T foo_nm"),
    ("b.a", "readelf", "nothing"),
    ("b.a", "nm", "b.a:x.o:\n0 T bar\n0 t local"),
)

PATCH = """From 0123456789012345678901234567890123456789 Mon Sep 17
Subject: [PATCH 1/2] Fix heap overflow CVE-2020-12345
---
 lib/a.c | 2 +-
diff --git a/lib/a.c b/lib/a.c
--- a/lib/a.c
+++ b/lib/a.c
@@ -1,2 +1,2 @@ int foo_bar(int x)
-  old = 1 << n;
+  if (n > 0x100) return;
From abcdefabcdefabcdefabcdefabcdefabcdefabcd Mon Sep 17
Subject: [PATCH 2/2] release version bump
diff --git a/lib/b.h b/lib/b.h
--- a/lib/b.h
+++ b/lib/b.h
@@ -1 +1 @@
-#define B_VERSION 1
+#define B_VERSION 2
"""

# Recorded answers of advisory services, and a patch they lead to.
NVD = {"vulnerabilities": [{"cve": {
    "descriptions": [{"lang": "es", "value": "x"}, {"lang": "en", "value": "An overflow in the doContent function in xmlparse.c"}],
    "metrics": {"cvssMetricV2": [{"cvssData": {"baseScore": 5.0, "vectorString": "v2"}}], "cvssMetricV30": [{"cvssData": {"baseScore": 7.5, "vectorString": "v3"}}]},
    "references": [
        {"url": "https://github.com/o/r/commit/abcdef1234", "tags": ["Patch"]}, {"url": "https://github.com/o/r/commit/abcdef1234", "tags": []},
        {"url": "https://bugzilla.org/1", "tags": []}, {"url": "https://github.com/o/r/pull/7", "tags": ["Patch"]},
    ],
    "weaknesses": [{"description": [{"value": "CWE-787"}, {"value": "NVD-x"}]}, {"description": [{"value": "CWE-787"}]}],
}}]}
OSV = {
    "summary": "s", "details": "d", "affected": [{"ranges": [{"repo": "https://github.com/o/r.git", "events": [{"introduced": "0"}, {"fixed": "abcdef1234"}]}]}],
    "references": [{"type": "FIX", "url": "https://github.com/mirror/r/commit/abcdef1234/"}, {"type": "WEB", "url": "https://github.com/o/r/commit/1234567"}],
}
