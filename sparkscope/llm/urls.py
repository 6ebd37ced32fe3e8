"""URL filter: path rules first, then a weighted vocabulary found by an Aho-Corasick automaton."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Mapping, Sequence
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscope.session import workers_see_package

# Fixed values: (host, path, verdict) rules of the production filter.
RULES: tuple[tuple[str, str, str], ...] = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Points from which a URL is rejected; a term of so many points is strict and rejects alone, others are soft.
LIMIT = 100
# Terms of the production filter by their points. Only words with one meaning reject alone; everyday words need four others.
_TERMS: dict[int, tuple[str, ...]] = {
    100: (
        "bdsm", "camgirl", "camgirls", "casino", "casinos", "cialis", "escort", "escorts", "hentai", "milf", "phishing", "porn", "porno", "pornstar", "sexcam", "sexcams", "viagra", "warez", "xrated", "xxx",
        "adult video", "adult videos", "free sex", "free spins", "hot singles", "live cams", "nude pics", "online casino", "online pharmacy", "payday loan", "payday loans", "sex video", "sex videos", "weight loss pills",
    ),
    50: (
        "adult", "bet", "bets", "betting", "cams", "erotic", "fetish", "free", "gamble", "gambling", "hardcore", "jackpot", "keygen", "nude", "nudes", "nulled", "payday", "pills", "poker", "sex", "slots", "spam", "torrent", "torrents",
    ),
    34: ("babes", "bonus", "cheap", "clickbait", "crack", "cracked", "dating", "hacked", "loan", "loans", "pharmacy", "popunder", "prize", "replica", "singles", "slot", "weightloss", "winner"),
    20: (
        "ads", "bitcoin", "click", "coupon", "coupons", "credit", "crypto", "deal", "diet", "discount", "farm", "forex", "hot", "money", "offer", "offers", "promo", "redirect", "rich", "sale", "seo", "track", "traffic", "win",
    ),
}
# Phrases in which a term means something else.
EXCEPTIONS: tuple[str, ...] = (
    "sex education", "sex ed", "sex ratio", "same sex", "opposite sex", "adult learning", "adult education", "adult literacy", "young adult", "adult swim", "nude in art", "nude mice", "hardcore punk",
    "spam filter", "spam filters", "anti spam", "anti phishing", "phishing awareness", "phishing protection", "report phishing", "casino royale", "escort carrier", "ford escort", "tax free", "toll free", "gluten free", "free software",
)
# What strict words are glued to in host names, and the digits written for letters.
_GLUED = ("porn", "porno", "casino", "casinos", "hentai", "viagra", "xxx", "sexcam", "sexcams")
_BEFORE = ("best", "free", "hot", "live", "my", "online", "real", "teen", "top", "vip")
_AFTER = ("club", "games", "hd", "hub", "land", "online", "pics", "site", "sites", "tube", "video", "videos", "world", "zone")
_DIGITS = {"a": "4", "e": "3", "i": "1", "o": "0", "s": "5"}


def _vocabulary() -> dict[str, int]:
    """All terms by their points: phrases also without their spaces, strict words also glued to others and with one digit for a letter."""
    out = {term: points for points, terms in _TERMS.items() for term in terms}
    strict = [t for t in _TERMS[100] if " " not in t and len(t) > 3]
    for forms in (
        (t.replace(" ", "") for t in _TERMS[100] if " " in t),
        (w + t for t in _GLUED for w in _BEFORE),
        (t + w for t in _GLUED for w in _AFTER),
        (t[:i] + _DIGITS[c] + t[i + 1 :] for t in strict for i, c in enumerate(t) if c in _DIGITS),
    ):
        for form in forms:
            out.setdefault(form, LIMIT)
    return out


VOCABULARY: dict[str, int] = _vocabulary()

_WORDS = re.compile("[a-z0-9]+")
_A_TO_Z = {i: i + 32 for i in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL: host lower-cased in A-Z; both empty for null or without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    tail = rest[cut:]
    stop = min((i for c in "?#" if (i := tail.find(c)) >= 0), default=len(tail))
    return rest[:cut].translate(_A_TO_Z), tail[:stop]


class Rules:
    """Longest rule that fits a host (or a subdomain of it) and starts the path; of equally long ones that of the longer host, then the first."""

    def __init__(self, rules: Sequence[tuple[str, str, str]] = RULES):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        found, best = (None, None), -1
        name = host
        while name:
            for start, verdict in self.by_host.get(name, ()):
                if path.startswith(start) and len(name) + len(start) > best:
                    found, best = (name + start, verdict), len(name) + len(start)
            name = name.partition(".")[2]
        return found


class Vocabulary:
    """Weighted terms of whole words, found in one pass over the words of a URL, whichever characters stand between them.

    A term within a phrase of ``exceptions`` is no hit.
    """

    def __init__(self, terms: Mapping[str, int] = VOCABULARY, limit: int = LIMIT, exceptions: Sequence[str] = EXCEPTIONS):
        self.machine, self.limit = ahocorasick.Automaton(), limit
        self.terms = {plain(t): p for t, p in terms.items() if plain(t)}
        self.exceptions = {plain(e) for e in exceptions if plain(e)}
        for term in self.terms.keys() | self.exceptions:
            self.machine.add_word(term, term)
        self.machine.make_automaton()

    def count(self, text: str) -> tuple[int, int, int]:
        """(hits of strict terms, distinct soft terms, points of the distinct terms) of a lower-cased text."""
        words = plain(text)
        hits: list[tuple[int, int, str]] = []
        covers: list[tuple[int, int]] = []
        for last, term in self.machine.iter(words) if self.terms else ():
            start, end = last - len(term) + 1, last + 1
            if (start and words[start - 1] != " ") or (end < len(words) and words[end] != " "):
                continue
            if term in self.exceptions:
                covers.append((start, end))
            if term in self.terms:
                hits.append((start, end, term))
        covers.sort()
        starts, reach = [a for a, _ in covers], list(accumulate((b for _, b in covers), max))
        left = [term for start, end, term in hits if not (at := bisect_right(starts, start)) or reach[at - 1] < end]
        points = {t: self.terms[t] for t in left}
        return sum(points[t] >= self.limit for t in left), sum(p < self.limit for p in points.values()), sum(points.values())


def plain(text: str) -> str:
    """The words of a text, which are runs of a-z and 0-9, with one space between them."""
    return " ".join(_WORDS.findall(text.translate(_A_TO_Z)))


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    vocabulary: Mapping[str, int] = VOCABULARY,
    limit: int = LIMIT,
    exceptions: Sequence[str] = EXCEPTIONS,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_strict, n_soft, points): one row per page, no shuffle.

    A rule that fits decides; otherwise a URL is blocked whose distinct terms
    have ``limit`` points together: one strict term, or several distinct soft
    ones, as whole words and outside the phrases of ``exceptions``. The words
    of a term may stand apart by any other characters. Null URLs and
    URLs without ``://`` have an empty host and path and are judged by their
    text alone; repeated rows are judged alike; extra columns are ignored.
    """
    workers_see_package(pages.sparkSession)
    rules, vocabulary, exceptions = tuple(rules), dict(vocabulary), tuple(exceptions)
    names = ["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft", "points"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words = Rules(rules), Vocabulary(vocabulary, limit, exceptions)
        for batch in batches:
            rows = []
            for url in batch.column("url").to_pylist():
                host, path = split_url(url)
                rule, verdict = table.find(host, path)
                hard, mild, points = words.count(url or "")
                rows.append((host, path, rule, verdict or ("block" if points >= limit else "allow"), hard, mild, points))
            kinds = [pa.string()] * 4 + [pa.int64()] * 3
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *arrays], names)

    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return picked.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, n_strict long, n_soft long, points long")


def oracle(rules: Sequence[tuple[str, str, str]] = RULES, vocabulary: Mapping[str, int] = VOCABULARY, limit: int = LIMIT, exceptions: Sequence[str] = EXCEPTIONS) -> str:
    """DuckDB SQL for the query: the same judgement from regular expressions."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = " UNION ALL ".join(
        f"SELECT page_id, '{h}{p}' AS rule, '{v}' AS verdict FROM parts WHERE (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, v in rules
    )
    terms = ", ".join(f"('{plain(t)}', {p})" for t, p in vocabulary.items())
    phrases = ", ".join(f"('{plain(e)}')" for e in exceptions) or "('')"
    longest = max(plain(t).count(" ") + 1 for t in (*vocabulary, *exceptions))
    return f"""
    WITH parts AS (
      SELECT page_id, {lower.format("coalesce(url, '')")} AS text,
        CASE WHEN contains(url, '://') THEN {lower.format("regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)', 1)")} ELSE '' END AS host,
        CASE WHEN contains(url, '://') THEN regexp_extract(url, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
      FROM pages),
    fits AS ({fits}),
    best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fits GROUP BY page_id),
    vocabulary(term, points) AS (VALUES {terms}),
    exceptions(phrase) AS (VALUES {phrases}),
    words AS (SELECT page_id, regexp_extract_all(text, '[a-z0-9]+') AS w FROM parts),
    places AS (SELECT page_id, w, unnest(range(1, len(w) + 1)) AS i FROM words),
    grams AS (SELECT page_id, i, i + n - 1 AS j, array_to_string(w[i:i + n - 1], ' ') AS gram FROM places, range(1, {longest + 1}) AS r(n) WHERE i + n - 1 <= len(w)),
    covers AS (SELECT page_id, i, j FROM grams JOIN exceptions ON gram = phrase),
    hits AS (
      SELECT page_id, term, points, count(*) AS n FROM grams g JOIN vocabulary ON gram = term
      WHERE NOT EXISTS (SELECT 1 FROM covers c WHERE c.page_id = g.page_id AND c.i <= g.i AND g.j <= c.j) GROUP BY ALL),
    counts AS (
      SELECT page_id, sum(CASE WHEN points >= {limit} THEN n ELSE 0 END) AS n_strict, sum(CASE WHEN points < {limit} THEN 1 ELSE 0 END) AS n_soft, sum(points) AS points
      FROM hits GROUP BY page_id)
    SELECT p.page_id, host, path, rule, coalesce(b.verdict, CASE WHEN coalesce(points, 0) >= {limit} THEN 'block' ELSE 'allow' END) AS verdict,
      CAST(coalesce(n_strict, 0) AS BIGINT) AS n_strict, CAST(coalesce(n_soft, 0) AS BIGINT) AS n_soft, CAST(coalesce(points, 0) AS BIGINT) AS points
    FROM parts p LEFT JOIN best b USING (page_id) LEFT JOIN counts c USING (page_id)"""
