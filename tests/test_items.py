"""Lists of items and source files by name, on odd rows."""

from pyspark.sql import functions as F

from sparkscope.operators import items
from sparkscope.sources import listing


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_items_once(spark):
    given = [("a", 2, '{"x": 1, "y": {"b": 2, "a": 3}}', "P"), ("a", 1, '{"y": {"a": 3, "b": 2}, "x": 1}', "O"), ("a", 3, "plain", "P"), ("a", 4, "plain", "P"), ("a", 5, None, "P"), ("b", 1, "", "P"), ("b", 2, "plain", "Q"), ("b", 3, "[1, 2]", "O"), ("b", 4, "[1,2]", None)]
    df = spark.createDataFrame(given, "k string, o int, item string, stage string")
    assert [r[:2] for r in rows(items.unique_objects(df, ["k"], "item", ["o"]))] == [("a", 1), ("a", 3), ("a", 5), ("b", 1), ("b", 2), ("b", 3)]
    assert [r[:2] for r in rows(items.unique_texts(df, ["k"], "item", ["o"]))] == [("a", 1), ("a", 2), ("a", 3), ("a", 5), ("b", 1), ("b", 2), ("b", 3), ("b", 4)]
    assert [r[:2] for r in rows(items.unique_texts(df, ["k"], "item", ["o"], drop_empty=True))] == [("a", 1), ("a", 2), ("a", 3), ("b", 2), ("b", 3), ("b", 4)]
    assert rows(items.merged_stages(df, ["k"], ["P", "O"], "item", ["o"], 2)) == [("a", 0, given[0][2]), ("a", 1, "plain"), ("b", 0, ""), ("b", 1, "[1, 2]")]
    assert items.merged_stages(df.where("false"), ["k"], ["P"], "item", ["o"], 2).count() == 0


def test_pruned_and_anchored(spark):
    given = [("k", "a", "uses abc", ["x"]), ("k", "abc", "none", ["png_row"]), ("k", "abd", None, None), ("k", None, "zz", ["rowCount", None]), ("j", "a", "uses abc", ["row"]), ("k", "a", "uses abc", ["x"])]
    df = spark.createDataFrame(given, "k string, name string, why string, uses array<string>")
    dropped = spark.createDataFrame([("k", "abc"), ("k", " "), ("k", None), ("j", "zz")], "k string, name string")
    assert rows(items.prune_fields(df, dropped, ["k"], ["name"], ["why"])) == sorted([given[2], given[3], given[4]], key=repr)
    assert rows(items.prune_fields(df, dropped.where("false"), ["k"], ["name"], ["why"])) == sorted(given, key=repr)
    anchors = spark.createDataFrame([("k", "row"), ("j", "uses"), ("k", None)], "k string, token string")
    assert rows(items.anchored(df, anchors, ["k"], ["name", "uses"])) == sorted([given[1], given[3]], key=repr)
    assert items.anchored(df, spark.createDataFrame([("k", "abc"), ("k", "uses")], "k string, token string"), ["k"], ["name", "why"]).count() == 3


def test_sources_by_name(spark):
    files = spark.createDataFrame([(p,) for p in ("/p/lib/a.c", "/p/a.c", "/p/x/b.cpp", "/p/x/b.cc", "/p/y/b.cc", "/q/c.c", "/p/d.e.c", "/p/lib/a.c")], "path string")
    wanted = [(1, "lib/a.c"), (2, "old/a.c"), (3, "c.c"), (4, ""), (5, None), (6, "b.cc"), (7, "/p/x/b.cpp"), (8, "lib/"), (2, "old/a.c")]
    got = listing.find_sources(spark.createDataFrame(wanted, "id int, path string"), files, "/p")
    truth = {1: "/p/lib/a.c", 2: "/p/a.c", 6: "/p/x/b.cc", 7: "/p/x/b.cpp"}
    assert rows(got) == sorted(((i, p, truth.get(i)) for i, p in wanted), key=repr)
    listed = spark.createDataFrame([(p,) for p in ("o/b.ll:7", "b.ll", "/t/d.e.ll", "zz.ll", "a.c:3", "a.o", None)], "path string")
    truth = {"o/b.ll:7": "/p/x/b.cc", "b.ll": "/p/x/b.cc", "/t/d.e.ll": "/p/d.e.c", "zz.ll": "", "a.c:3": "a.c", "a.o": "a.o", None: None}
    assert {r.path: r.source for r in listing.ir_sources(listed, files, "/p").collect()} == truth
    assert {r.path: r.source for r in listing.ir_sources(listed, files, "/p/", guess=True).where(F.col("path") == "zz.ll").collect()} == {"zz.ll": "/p/zz.c"}
