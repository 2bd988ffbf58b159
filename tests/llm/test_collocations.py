"""Collocations against a brute-force version; the trie against a dictionary."""

import re
from collections import Counter

import numpy as np
import pytest
from helpers import ODD, lower, rng

from prepforge.llm import collocations as C

SCHEMA = "doc_id bigint, text string, lang string, source string, phrase string, n int, w1 string"
STRANGE = ["A b, c d", "a\tb  c\x0bd", "a b\r\nc d", "x\x00y a b", "\x01 \x01 \x01", "é É é É", "a b?c d!", "\x1c a b a b"]


def brute(rows, least=10, longest=3, percent=50, top=2000):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            for size in range(1, longest + 1):
                for i in range(len(w) - size + 1):
                    counts[lang, tuple(w[i:i + size])] += 1
    good = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in good.items():
        cuts = [(10**6 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        around = [n for (g, v), n in good.items() if g == lang and len(v) > len(w)
                  and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if not any(100 * n >= percent * a for n in around):
            out.append((lang, -score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    found, rank = set(), Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            found.add((lang, rank[lang], phrase.decode(), -a, left, right, totals[lang], -score))
    return found


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i % 5, t, g, "s", "x", 1, "y") for i, (t, g) in enumerate(rows)], SCHEMA).repartition(parts)


def texts(seed, n, vocabulary=14):
    r = rng(seed)
    out = []
    for _ in range(n):
        text = "".join(r.choice(["w", "W", "é", "long-word-"]) + str(r.randrange(vocabulary)) + r.choice(
            [" "] * 8 + ["  ", "\t", ". ", ",", "\n"]) for _ in range(r.randrange(0, 60)))
        out.append((text, r.choice(["en", "de", None, "und", "x\ny", "x"])))
    return out


def collected(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("shard, merged", [(8 << 20, 1 << 21), (700, 60)])
def test_equal_to_brute_force(spark, monkeypatch, shard, merged):
    monkeypatch.setattr(C, "SHARD", shard)
    monkeypatch.setattr(C, "MERGED", merged)
    rows = texts(1, 700, 7) + [(t, "en") for _, t in ODD] + [(t, "de") for t in STRANGE for _ in range(11)]
    got = C.collocations(frame(spark, rows))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    found = got.collect()
    assert {tuple(r) for r in found} == brute(rows) and len(found) == len(brute(rows)) > 100


def test_scans_do_not_grow_with_the_number_of_tries(spark, monkeypatch):
    """The texts are read once for words and twice per width, before once for every two tries."""
    monkeypatch.setattr(C, "SHARD", 100)
    rows = texts(5, 300, 6)
    read = spark.sparkContext.accumulator(0)

    def tapped(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = frame(spark, rows)
    got = collected(C.collocations(docs.mapInArrow(tapped, SCHEMA)))
    assert got == brute(rows) and len(got) > 50
    assert read.value <= 5 * len(rows)


def test_parameters_top_and_other_widths(spark):
    rows = texts(2, 60, 5)
    assert collected(C.collocations(frame(spark, rows), least=4, top=7, percent=90)) == brute(rows, 4, 3, 90, 7)
    assert collected(C.collocations(frame(spark, rows), least=5, longest=4)) == brute(rows, 5, 4)
    assert collected(C.collocations(frame(spark, rows), least=3, longest=2)) == brute(rows, 3, 2)


def test_crowded_bitmap_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(C, "BITS", 15)
    rows = texts(3, 120)
    assert collected(C.collocations(frame(spark, rows))) == brute(rows)


def test_large_counts_stay_exact(spark):
    df = spark.sql("SELECT 99999999999 AS a, 100000000007 AS l, 100000000009 AS r")
    assert df.select(C._score(*[df[c] for c in "alr"])).first()[0] == 10**6 * 99999999999**2 // (100000000007 * 100000000009)


def test_empty_and_wordless_tables(spark):
    assert not collected(C.collocations(frame(spark, texts(4, 3)).limit(0)))
    assert not collected(C.collocations(frame(spark, [(None, "en"), ("", None), (" .,", "de"), ("a b", "en")])))


@pytest.mark.parametrize("seed", range(6))
def test_trie_is_a_dictionary(seed):
    r = rng(seed)
    keys = {bytes(r.choice(b"ab\x00\xff c" if seed % 2 else range(256)) for _ in range(r.randrange(1, 12)))
            for _ in range(r.choice([1, 5, 400, 4000]))}
    keys |= {b"z" * 500, bytes(range(256))}
    ordered = sorted(keys)
    trie = C.build_trie(ordered)
    for i, k in enumerate(ordered):
        assert trie.accept[trie.walk(k)] == i
    for _ in range(2000):
        k = bytes(r.choice(b"ab\x00\xff cz") for _ in range(r.randrange(1, 8)))
        state = trie.walk(k)
        assert (trie.accept[state] >= 0 if state >= 0 else False) == (k in keys)
        assert (state >= 0) == any(x.startswith(k) for x in ordered)
    used = np.flatnonzero(trie.check >= 0)
    assert len(used) == len({k[:i] for k in ordered for i in range(1, len(k) + 1)})
