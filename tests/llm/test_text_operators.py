"""Operators on whole texts against brute force, on small tables with the awkward rows."""

import re
import tracemalloc
import zlib
from collections import defaultdict
from difflib import SequenceMatcher

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkscope.llm import crowds, kernels, langid, licenses, packing, simhash, tiling, tokencount

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AWKWARD = [None, "", " \n\t ", "!!! ???", "Von.", "a b", "é" * 3, "MIT License MIT LICENSE mit license", "x " * 30000, "<|endoftext|> tail", "naïve Œuvre 𝔘nicode 漢字"]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def table(spark, texts):
    # a clashing extra column, and a repeated row
    rows = [(i, t, i, "en") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string, n_chars long, score string")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").toPandas()


def test_words_are_the_contracts(documents):
    for text in [*documents.text, *AWKWARD]:
        hashes, start, end = kernels.located_words(None if text is None else text.encode())
        raw = (text or "").encode()
        assert [lower(raw[a:b].decode()) for a, b in zip(start, end)] == WORD.findall(lower(text))
        assert len(hashes) == len(start)
    a, b = (kernels.word_hashes(t.encode()) for t in ("one two, THREE one", "One! two three ONE"))
    assert (a == b).all() and a[0] == a[3] and len(set(a.tolist())) == 3


def brute_license(text):
    words = WORD.findall(lower(text))
    found = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_licenses(spark, documents):
    texts = [*documents.text, *AWKWARD, "GNU General Public License; general public, license general public license", "mit mit license license"]
    rows = licenses.scan_licenses(table(spark, texts)).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(texts[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense"
    found = licenses.scan_licenses(table(spark, ["x y z", f"Some words first. {grant} and more", "this is a plain text of the people"])).collect()
    assert [r.labels for r in sorted(found, key=lambda r: r.doc_id)][:3] == ["", "mit", ""]
    assert found[1].spans[0].start == 3 and found[1].n_base == 0
    assert licenses.scan_licenses(table(spark, ["x"]).where("false")).count() == 0


def brute_labels(text, templates):
    """Labels of templates of which matches of three words and more, in order and close together, cover enough; for texts with one place of a template."""
    words, out = WORD.findall(lower(text)), set()
    for label, many in templates.items():
        for t in many:
            own = WORD.findall(lower(t))
            if len(own) < licenses.MIN_WORDS:
                if any(words[i : i + len(own)] == own for i in range(len(words) - len(own) + 1)):
                    out.add(label)
                continue
            blocks = [b for b in SequenceMatcher(None, own, words, autojunk=False).get_matching_blocks() if b.size >= licenses.MIN_MATCH]
            runs, last = [[]], None
            for b in blocks:
                if last and b.b - last.b - last.size > licenses.MAX_GAP:
                    runs.append([])
                runs[-1].append(b)
                last = b
            covered = max(sum(b.size for b in run) for run in runs)
            if covered >= licenses.MIN_COVER * len(own) and covered >= licenses.MIN_WORDS:
                out.add(label)
    return out


def test_license_labels_against_brute_force(spark, documents):
    texts = [*documents.text, "The album was released under the name Foo.", "Licensed under CC BY-NC 4.0", "// SPDX-License-Identifier: BSD-3-Clause", "cc by nc sa 4.0", "word " * 200000]
    for many in licenses.PASSAGES.values():
        for t in many:
            own = t.split()
            texts += [f"some words {t} others", " ".join([*own[: len(own) // 2], "a b c d e f g h i j k"])]
            own[len(own) // 3] = "changed"
            texts.append(" ".join(own))
    rows = {r.doc_id: r for r in licenses.scan_licenses(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        own, base = (set(filter(None, labels.split(","))) for labels in (rows[i].labels, rows[i].base_labels))
        truth = brute_labels(t[:100000], licenses.TEMPLATES)
        # where texts of licences resemble each other, words count for the one that has the longest match
        assert own == base | truth if len(truth) < 2 else own and base <= own <= base | truth, t[:200]
    assert [rows[len(documents.text) + k].labels for k in range(4)] == ["", "cc-by-nc", "bsd", "cc-by-nc-sa"]
    assert any(rows[i].labels != rows[i].base_labels for i in range(len(documents.text)))


def test_short_names_of_licenses(spark):
    texts = {
        "Released under the MIT licence.": "mit", "GPLv3": "gpl", "see (LGPLv2.1) there": "lgpl", "GPL-v2 or later": "gpl", "under the GNU GPL 3": "gpl", "BSD 3-Clause License": "bsd", "dual BSD-licensed": "bsd", "the ISC Licence": "isc",
        "Apache 2.0 licensed": "apache", "AGPLv3 and GPLv2": "agpl,gpl", "an artistic licence": "artistic", "zlib/libpng license": "zlib",
        "a driving licence": "", "Apache 2.0 server": "", "the gpl": "", "mit students license nothing": "", "version 3": "", "x gplv33 gplv": "",
    }
    rows = {r.doc_id: r for r in licenses.scan_licenses(table(spark, list(texts))).collect()}
    assert [rows[i].labels for i in range(len(texts))] == list(texts.values())
    assert all(rows[i].n_base == 0 for i in range(len(texts)))
    assert [(s.start, s.end) for s in rows[9].spans] == [(0, 1), (2, 3)]


def test_phrases_of_one_word(spark):
    rows = licenses.scan_licenses(table(spark, ["a b a", "b", "c a b c"]), phrases={"a": "x", "a b": "y"}, templates={"z": ["c"]}).collect()
    assert {r.doc_id: (r.n_base, r.first_word, r.last_word, r.labels) for r in rows if r.doc_id < 3} == {0: (3, 0, 2, "x,y"), 1: (0, None, None, ""), 2: (2, 1, 1, "x,y,z")}


def test_suffix_automaton_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        sequences = [rng.integers(1, 4, rng.integers(1, 9)).tolist() for _ in range(3)]
        machine = licenses.SuffixAutomaton(sequences)
        text = rng.integers(1, 5, 20).tolist()
        for end, (state, length) in enumerate(machine.statistics(text), 1):
            best = max(n for n in range(end + 1) if n == 0 or any(s[i : i + n] == text[end - n : end] for s in sequences for i in range(len(s) - n + 1)))
            assert length == best
            if length:
                places = {(k, i + length) for k, s in enumerate(sequences) for i in range(len(s) - length + 1) if s[i : i + length] == text[end - length : end]}
                assert set(machine.ends(state)) == places


def brute_simhash(text, k=3):
    words = [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", lower(text)) if w]
    if not words:
        return 0
    values = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute_components(prints, radius):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_simhash_groups(spark, documents):
    texts = [*documents.text, *AWKWARD, documents.text[3], documents.text[3] + " tail", documents.text[150].replace("a", "e", 1)]
    rows = {r.doc_id: r for r in simhash.near_duplicates(table(spark, texts)).withColumn("hex", simhash.hex_fingerprint("fp")).collect()}
    prints = {i: brute_simhash(t) for i, t in enumerate(texts)}
    assert {i: int(r.hex, 16) for i, r in rows.items()} == prints and all(len(r.hex) == 16 for r in rows.values())
    assert {i: r.component_id for i, r in rows.items()} == brute_components(prints, 2)
    assert simhash.near_duplicates(table(spark, ["x"]).where("false")).count() == 0


@pytest.mark.parametrize("radius", [0, 2, 5])
def test_vantage_point_trees_find_every_link(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 250, dtype=np.uint64)
    values = [base]
    for _ in range(5):  # chains of near values, dense groups among them
        flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (2, 250), dtype=np.uint64), axis=0)
        values.append(values[-1] ^ flips)
    dense = base[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    values = np.unique(np.concatenate([*values, dense]))
    truth = brute_components(dict(enumerate(values.tolist())), radius)
    assert {i: int(r) for i, r in enumerate(simhash.local_groups(values, radius, block=16))} == truth
    points = spark.createDataFrame([(int(np.int64(np.uint64(v))) if v < 1 << 63 else int(v) - (1 << 64), i) for i, v in enumerate(values.tolist())], "fp long, rep long")
    for sample_rows, leaf_rows in ((256, 64), (64, 24))[: 1 + (radius == 2)]:  # the second sample shapes too few leaves, which are then split further
        edges = simhash.hamming_links(points, radius, sample_rows=sample_rows, leaf_rows=leaf_rows)
        found = {r.node: r.component for r in simhash.connected_components(edges).collect()}
        assert {i: found.get(i, i) for i in truth} == truth


def test_near_copies_against_brute_force(spark, documents, monkeypatch):
    rng = np.random.default_rng(9)
    base = [[f"w{x}" for x in rng.integers(0, 900, n)] for n in (30, 80, 200, 500)]
    texts = list(documents.text[:80])
    for words in base:
        for _ in range(12):
            changed = [*words]
            for i in rng.integers(0, len(words), max(1, len(words) // rng.choice([20, 60, 150]))):
                changed[i] = "new"
            texts.append(" ".join(changed))
    texts += [None, "", "! ?", "one", "One!", "one two three", texts[3].upper(), "a " * 5000]
    sets = {i: set(simhash.shingle_set(None if t is None else t.encode()).tolist()) for i, t in enumerate(texts)}
    near = lambda a, b: a == b or (len(a & b) >= 0.8 * len(a | b) if a and b else False)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            if near(sets[i], sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    truth = {i: find(i) for i in sets}
    for small, pairs, stars in ((simhash.SMALL_GROUP, crowds.GROUP_PAIRS, crowds.STARS), (4, 16, 2)):
        monkeypatch.setattr(simhash, "SMALL_GROUP", small)
        monkeypatch.setattr(crowds, "GROUP_PAIRS", pairs)
        monkeypatch.setattr(crowds, "STARS", stars)
        got = {r.doc_id: r.component_id for r in simhash.near_copies(table(spark, texts)).collect()}
        assert got == truth
    assert simhash.near_copies(table(spark, ["x"]).where("false")).count() == 0


def test_near_copies_in_a_template_crowd(spark):
    rng = np.random.default_rng(10)
    fresh = lambda n: [f"v{x}" for x in rng.integers(0, 1 << 40, n)]
    template = fresh(180)  # 176 shingles that all texts have, and 24 of their own: 0.79 to each other
    texts = [" ".join([*template, *fresh(24)]) for _ in range(300)]
    truth = {i: i for i in range(330)}
    for i in range(30):
        own = texts[i * 9].split()
        own[185 + i % 12] = "changed"  # 195 of 205 shingles in common
        texts.append(" ".join(own))
        truth[300 + i] = i * 9
    # texts that share so much may have the same fingerprint by chance, and are linked then as well
    same = defaultdict(list)
    for i, t in enumerate(texts):
        same[simhash.simhash(t.encode(), 5)].append(i)
    for many in same.values():
        groups = {truth[i] for i in many}
        truth = {i: min(groups) if r in groups else r for i, r in truth.items()}
    assert {r.doc_id: r.component_id for r in simhash.near_copies(table(spark, texts), radius=0).collect()} == truth


def test_packing_round_trip(spark, documents):
    texts = [*documents.text, *AWKWARD, "word " * 300000, "z" * 9000]
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*own.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    for shard in (1 << 20, 3000):
        rows = packing.pack_documents(table(spark, texts), shard_tokens=shard).collect()
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in rows:
            assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
            assert r.doc_tokens == len(ids[r.doc_id])
            pieces[r.doc_id].append((r.start, r.length))
            sequences[r.sequence_id].append((r.offset, r.length, r.sequence_length))
        for i, got in pieces.items():
            got, copies = sorted(got), 2 if i == len(texts) - 1 else 1
            assert sum(n for _, n in got) == copies * len(ids[i])
            if copies == 1:
                assert all(a + n == b for (a, n), (b, _) in zip(got, got[1:])) and got[0][0] == 0
        for got in sequences.values():
            at = 0
            for offset, n, total in sorted(got):
                assert offset == at
                at += n
            assert at == total and (at == 1024 or at & (at - 1) == 0)


def test_packing_balances_costs():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 700, 400).tolist()
    cost = defaultdict(float)
    for _, _, n, sequence, _ in packing.pack(lengths, 1024):
        cost[sequence] += packing.cost(n)
    full = [c for s, c in cost.items() if s < sum(lengths) // 1024]
    assert max(full) < 1.8 * np.mean(full)


def test_token_counts(spark, documents):
    path = public_tokenizers.path("byte_bpe_50k.json")
    scores = tokencount.zipf_scores(path)
    unknown = min(scores.values()) - 10

    def best(word):
        table = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            options = [(table[a][0] + scores[word[a:end]], table[a][1] + 1) for a in range(end) if word[a:end] in scores]
            options = options or [(table[end - 1][0] + unknown, table[end - 1][1] + 1)]
            table.append(max(options, key=lambda o: (o[0], -o[1])))
        return table[-1]

    texts = [*documents.text[:60], *AWKWARD]
    memo = {}
    for r in tokencount.count_tokens(table(spark, texts)).collect():
        words = [w.encode() for w in tokencount._SPLIT.findall(texts[r.doc_id] or "")]
        assert b"".join(words) == (texts[r.doc_id] or "").encode()
        found = [memo.setdefault(w, None) or memo.update({w: best(w)}) or memo[w] for w in words]
        assert (r.n_words, r.n_tokens) == (len(words), sum(n for _, n in found))
        assert r.log_prob == pytest.approx(sum(s for s, _ in found))
    assert tokencount.count_tokens(table(spark, ["x"]).where("false")).count() == 0


def test_language_model_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_language_model(docs)
    rows = langid.predict_languages(docs.withColumn("held", langid.fold() == 1), model).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert np.mean([r.rejected for r in rows]) < 0.01
    assert all(0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id: r for r in langid.predict_languages(table(spark, AWKWARD), model).collect()}
    for i, text in enumerate(AWKWARD):
        assert (odd[i].lang_pred == "und") == (not text or not any(c.isalpha() for c in text))
    # an id that repeats trains once, and few ids are enough to train on
    few = docs.where("doc_id < 12").crossJoin(spark.range(2000).select(F.col("id").alias("extra"))).withColumn("score", F.lit("clash"))
    small = langid.fit_language_model(few, train_rows=50)
    assert small.langs and {r.score for r in langid.predict_languages(few.limit(3), small).collect()} != {"clash"}
    none = langid.fit_language_model(docs.where("false"))
    assert {r.lang_pred for r in langid.predict_languages(docs.limit(5), none).collect()} == {"und"}


def brute_tiling(pattern, text, width):
    """Greedy string tiling by comparing all pairs of unmarked places, longest first."""
    marked_p, marked_t, tiles = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(pattern)):
            for t in range(len(text)):
                n = 0
                while p + n < len(pattern) and t + n < len(text) and pattern[p + n] == text[t + n] and p + n not in marked_p and t + n not in marked_t:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        if best[0] < width:
            return len(marked_p), tiles
        n, p, t = best
        marked_p |= set(range(p, p + n))
        marked_t |= set(range(t, t + n))
        tiles += 1


@pytest.mark.parametrize("seeds", [tiling.SEEDS, 3])
def test_tiling_against_brute_force(monkeypatch, seeds):
    monkeypatch.setattr(tiling, "SEEDS", seeds)
    rng = np.random.default_rng(5)
    for _ in range(150):
        pattern, text = (rng.integers(1, 4, n).astype(np.uint64) for n in (rng.integers(2, 16), rng.integers(2, 24)))
        found = list(tiling.Benchmark([(7, pattern)], 2).tilings(text))
        truth = brute_tiling(pattern.tolist(), text.tolist(), min(2, len(pattern)))
        assert (found[0][2:] if found else (0, 0)) == truth


def test_tiling_of_repeats_needs_little_memory():
    index = tiling.Benchmark([(1, kernels.word_hashes(b"w " * 100))], 5)
    words = kernels.word_hashes(b"w " * 60000)  # 5.8 million pairs of places
    tracemalloc.start()
    assert list(index.tilings(words)) == [(1, 100, 100, 1)]
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_contamination(spark):
    items = spark.createDataFrame(
        [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", 0), (2, "one two three", 0), (3, None, 0), (4, "", 0), (5, "- ! -", 0)], "item_id long, text string, doc_id long"
    )
    texts = [
        "x Alpha, beta gamma delta epsilon zeta eta theta iota KAPPA y",
        "zeta eta theta iota kappa and then alpha beta gamma delta epsilon",  # reordered
        "alpha beta gamma delta epsilon is half of it",
        "ONE two; three!",
        "one two",
        *AWKWARD,
    ]
    rows = {(r.doc_id, r.item_id): r for r in tiling.contaminations(table(spark, texts), items).collect()}
    assert set(rows) == {(0, 1), (1, 1), (3, 2)}
    assert rows[1, 1].n_tiles == 2 and rows[0, 1].n_tiles == 1 and rows[1, 1].coverage == 1.0
    small = tiling.contaminations(table(spark, texts), items, block_words=1)
    assert {(r.doc_id, r.item_id) for r in small.collect()} == set(rows)
    assert tiling.contaminations(table(spark, texts), items.where("false")).count() == 0
