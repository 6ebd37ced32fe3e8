"""Recorded advisory answers (JSON text) as tables, and the patches they point to. Nothing is fetched."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscope.operators.ordered import known, top_k

# The parts that are read of the three kinds of answers, and the forms of patch addresses.
_METRIC = "array<struct<cvssData:struct<baseScore:double,vectorString:string>>>"
NVD = (
    "struct<vulnerabilities:array<struct<cve:struct<descriptions:array<struct<lang:string,value:string>>,"
    f"metrics:struct<cvssMetricV31:{_METRIC},cvssMetricV30:{_METRIC},cvssMetricV2:{_METRIC}>,"
    "references:array<struct<url:string,tags:array<string>>>,weaknesses:array<struct<description:array<struct<value:string>>>>>>>>"
)
OSV = (
    "struct<summary:string,details:string,affected:array<struct<ranges:array<struct<repo:string,events:array<struct<fixed:string>>>>>>,"
    "references:array<struct<type:string,url:string>>>"
)
GH = "array<struct<summary:string,description:string,severity:string>>"
COMMIT = r"^https?://github\.com/([^/]+/[^/]+)/commit/([0-9a-f]{7,40})"
PULL = r"^https?://github\.com/[^/]+/[^/]+/pull/\d+"
TRACKER = r"(?i)bugzilla|/issues?/|/bugs?/|crbug\.com|oss-fuzz\.com|bugs\.chromium|gitlab\.com/.*/issues|sourceware\.org|savannah"

_REF = "array<struct<url:string,tags:array<string>>>"
_FIX = "array<struct<repo:string,commit:string>>"


def _common(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    kinds = {"description": "string", "summary": "string", "cvss_score": "double", "cvss_vector": "string", "severity": "string", "cwe_ids": "array<string>", "refs": _REF, "fixes": _FIX}
    return df.select("cve_id", F.lit(source).alias("source"), *(columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()))


def nvd(answers: DataFrame) -> DataFrame:
    """Advisory rows from (cve_id, json): first record; first English text; scores of version 3.1, else 3.0, else 2."""
    row = answers.select("cve_id", F.get(F.from_json("json", NVD)["vulnerabilities"], F.lit(0))["cve"].alias("c")).where("c is not null")
    english = F.get(F.filter("c.descriptions", lambda d: d["lang"] == "en"), F.lit(0))["value"]
    metric = F.coalesce(*(F.get(F.col(f"c.metrics.{v}"), F.lit(0))["cvssData"] for v in ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2")))
    refs = F.filter("c.references", lambda r: F.coalesce(r["url"], F.lit("")) != "")
    urls = F.transform(refs, lambda r: r["url"])
    once = F.filter(refs, lambda r, i: F.array_position(urls, r["url"]) == i + 1)
    classes = F.flatten(F.transform("c.weaknesses", lambda w: F.transform(w["description"], lambda d: d["value"])))
    return _common(row, "nvd", description=english, cvss_score=metric["baseScore"], cvss_vector=metric["vectorString"], cwe_ids=F.array_distinct(F.filter(classes, lambda v: v.startswith("CWE-"))), refs=once)


def osv(answers: DataFrame) -> DataFrame:
    """Advisory rows from (cve_id, json), with every fixed event and its repository."""
    row = answers.select("cve_id", F.from_json("json", OSV).alias("o")).where("o is not null")
    ranges = F.flatten(F.transform("o.affected", lambda a: a["ranges"]))
    fixes = F.flatten(F.transform(ranges, lambda r: F.transform(F.filter(r["events"], lambda e: e["fixed"].isNotNull()), lambda e: F.struct(F.coalesce(r["repo"], F.lit("")).alias("repo"), e["fixed"].alias("commit")))))
    refs = F.transform("o.references", lambda r: F.struct(r["url"].alias("url"), F.array(r["type"]).alias("tags")))
    return _common(row, "osv", description=F.col("o.details"), summary=F.col("o.summary"), refs=refs, fixes=fixes)


def github(answers: DataFrame) -> DataFrame:
    row = answers.select("cve_id", F.get(F.from_json("json", GH), F.lit(0)).alias("g")).where("g is not null")
    return _common(row, "gh", description=F.col("g.description"), summary=F.col("g.summary"), severity=F.col("g.severity"))


def patch_urls(advisories: DataFrame) -> DataFrame:
    """(cve_id, place, url, commit, kind): addresses to fetch, commits before pull requests, each commit and address once.

    Commits come from fixes, then from references tagged Patch, then from the
    other source's references; mirrors of one commit count once.
    """
    fixed = advisories.where("source = 'osv'").select("cve_id", F.lit(0).alias("a"), F.posexplode("fixes").alias("b", "f"))
    fixed = fixed.where(F.col("f.repo").contains("github.com") & (F.col("f.commit") != "")).select("cve_id", "a", "b", F.concat(F.regexp_replace("f.repo", r"/+$|(\.git)?/*$", ""), F.lit("/commit/"), "f.commit").alias("url"))
    tagged = advisories.where("source in ('nvd', 'osv')").select("cve_id", F.when(F.col("source") == "nvd", 1).otherwise(2).alias("a"), F.posexplode("refs").alias("b", "r"))
    tagged = tagged.where((F.col("a") == 2) | F.array_contains("r.tags", "Patch")).select("cve_id", "a", "b", F.col("r.url").alias("url"))
    rows = fixed.unionByName(tagged).withColumn("url", F.regexp_replace("url", "/+$", ""))
    kind = F.when(F.col("url").rlike(COMMIT), "commit").when(F.col("url").rlike(PULL), "pull").when(F.col("a") == 0, "commit")
    rows = rows.withColumn("kind", kind).where("kind is not null").withColumn("commit", F.when(F.col("url").rlike(COMMIT), F.regexp_extract("url", COMMIT, 2)).when(F.col("a") == 0, F.regexp_extract("url", "([^/]+)$", 1)))
    key = F.coalesce("commit", "url")
    place = F.struct((F.col("kind") == "pull").alias("p"), "a", "b")
    return rows.groupBy("cve_id", key.alias("key")).agg(F.min_by(F.struct(place.alias("place"), "url", "commit", "kind"), place).alias("x")).select("cve_id", "x.*")


def fix_patches(urls: DataFrame, recorded: DataFrame, limit: int = 2, max_chars: int = 50000) -> DataFrame:
    """(cve_id, patch_no, url, text): the first recorded, non-empty patches (url, text) in order, cut to a length."""
    text = recorded.select("url", F.substring("text", 1, max_chars).alias("text")).where(known(F.col("text")).isNotNull())
    found = urls.join(text, "url")
    from pyspark.sql import Window

    best = top_k(found, ["cve_id"], ["place"], limit)
    return best.select("cve_id", (F.row_number().over(Window.partitionBy("cve_id").orderBy("place")) - 1).alias("patch_no"), "url", "text")


def tracker_pages(advisories: DataFrame, recorded: DataFrame, limit: int = 3, max_chars: int = 10240) -> DataFrame:
    """(cve_id, place, text): plain text of the first recorded bug-tracker pages (url, html) of an advisory."""
    refs = advisories.select("cve_id", F.when(F.col("source") == "nvd", 0).otherwise(1).alias("a"), F.posexplode("refs").alias("b", "r"))
    rows = refs.where(F.col("r.url").rlike(TRACKER)).select("cve_id", F.struct("a", "b").alias("place"), F.col("r.url").alias("url"), F.regexp_replace("r.url", "/+$", "").alias("key"))
    once = rows.groupBy("cve_id", "key").agg(F.min_by(F.struct("place", "url"), "place").alias("x")).select("cve_id", "x.*")
    first = top_k(once, ["cve_id"], ["place"], limit)
    return first.join(recorded, "url").select("cve_id", "place", F.regexp_replace(F.substring("html", 1, max_chars), "<[^>]+>", " ").alias("text"))


def united(*sources: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sources)
