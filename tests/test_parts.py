"""Hashed parts of texts: block borders, characters beyond the base plane, bit sets."""

import numpy as np

from sparkscope.functions import parts


def test_parts_do_not_depend_on_blocks(monkeypatch):
    text = "abc𝔘déabc𝔘dé" * 40 + "end"
    whole = {n: parts.part_hashes(text, n) for n in (1, 3, 6)}
    for n, hashes in whole.items():
        assert len(hashes) == len({text[i : i + n] for i in range(len(text) - n + 1)})
    monkeypatch.setattr(parts, "BLOCK", 7)
    for n, hashes in whole.items():
        assert (parts.part_hashes(text, n) == hashes).all()
    assert parts.part_hashes("ab", 3).size == parts.part_hashes("", 1).size == 0
    assert np.intersect1d(parts.part_hashes("abcd", 2), parts.part_hashes("abcd", 3)).size == 0


def test_bit_sets_keep_what_they_hold(spark):
    rows = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, ""), (4, "gamma"), (4, "gamma")], "k int, t string")
    of = parts.row_parts(rows.where("k = 1"), "k", "t", [4])
    bits = parts.bit_set(of, "hash")
    assert bits.nbytes == parts.BITS // 8
    assert set(parts.part_hashes("the alphabet", 4, bits).tolist()) == set(np.intersect1d(parts.part_hashes("the alphabet", 4), parts.part_hashes("alpha beta", 4)).tolist())
    assert parts.row_parts(rows, "k", "t", [4], bits).where("id != 1").count() == 0
    every = parts.bit_set(parts.row_parts(rows, "k", "t", [4]), "hash")
    assert {r.n for r in parts.count_parts(rows, "t", [4], every).collect()} == {1, 2}
    assert parts.bit_set(of.where("false"), "hash").sum() == 0


def test_short_texts_are_hashed_together(monkeypatch):
    texts = ["abcabc", None, "", "bc", "𝔘dé𝔘dé", "abc", "x" * 50, "cabca"]
    lengths = [(1, 3), (3,), (3,), (3, 2), (2,), (6, 3), (4,), (3, 1)]
    wanted = sorted((r, h) for r, (t, of) in enumerate(zip(texts, lengths, strict=True)) for n in of if t for h in parts.part_hashes(t, n).tolist())
    for block in (1 << 18, 8, 3):
        monkeypatch.setattr(parts, "BLOCK", block)
        assert sorted(zip(*(x.tolist() for x in parts.batch_hashes(texts, lengths)), strict=True)) == wanted
    monkeypatch.setattr(parts, "BLOCK", 1 << 18)
    calls, runs = [], parts._runs
    monkeypatch.setattr(parts, "_runs", lambda t, n: calls.append(n) or runs(t, n))
    parts.batch_hashes(["abcdef"] * 1000, [(3,)] * 1000)
    assert calls == [3]
