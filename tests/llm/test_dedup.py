import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import ODD, collected, frame, groups, lower, rng, some_text, words

from prepforge.llm import near_dedup
from prepforge.llm.chunk_dedup import LEAST, MOST, chunk_ends, cut_points, exact_duplicates, normalised
from prepforge.llm.components import components
from prepforge.llm.near_dedup import SIZE, near_duplicates, superminhash
from prepforge.llm.textblocks import Block, blocks, mixed


def block(*texts):
    data = [t.encode() for t in texts]
    return Block(0, np.frombuffer(b"".join(data), dtype=np.uint8), np.cumsum([0, *map(len, data)]))


def test_words_and_hashes_do_not_cross_texts():
    b = block("ab cd", "", "ef", "  g\n\x0bh ", "cd")
    starts, ends, first = b.words()
    assert [b.data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)] == [b"ab", b"cd", b"ef", b"g", b"h", b"cd"]
    assert first.tolist() == [0, 2, 2, 3, 5, 6]
    h = b.hashes(starts, ends)
    assert h[1] == h[5] and len(set(h.tolist())) == 5


def test_normalised_text():
    b = normalised(block("  a\t\tb ", "", "\n", "c"))
    assert [b.text(i) for i in range(4)] == [b" a b ", b"", b" ", b"c"]


def test_chunks_follow_content():
    r = rng()
    tail = some_text(r, 3000)
    one, two = block(tail), block("inserted " + tail)
    ends = [chunk_ends(cut_points(b), 0, len(b.data)) for b in (one, two)]
    cut = [{b.data[s:e].tobytes() for s, e in zip([0, *x[:-1]], x, strict=True)}
           for b, x in zip((one, two), ends, strict=True)]
    assert len(cut[0] - cut[1]) <= 2
    for x in ends:
        sizes = np.diff([0, *x])
        assert sizes.max() <= MOST and (sizes[:-1] >= LEAST).all()


def expected_exact(rows):
    plain = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    size = Counter(plain)
    keep = {}
    for (i, _), p in zip(rows, plain, strict=True):
        keep[p] = min((x for x in (keep.get(p), i) if x is not None), default=None)
    return Counter((i, keep[p], size[p], i == keep[p], hashlib.sha256(p.encode()).hexdigest())
                   for (i, _), p in zip(rows, plain, strict=True))


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_duplicates(spark, bits):
    r = rng()
    base = [some_text(r, r.randrange(1, 900)) for _ in range(15)]
    rows = ODD + [(20 + k, r.choice(base).replace(" ", r.choice([" ", "  ", "\n"]))) for k in range(60)]
    out = exact_duplicates(frame(spark, rows), bits=bits).collect()
    assert Counter(tuple(x) for x in out) == expected_exact(rows)


def test_empty_tables(spark):
    none = frame(spark, [(1, "x")]).where("false")
    assert exact_duplicates(none).collect() == []
    assert near_duplicates(none).collect() == []


def test_superminhash_estimates_similarity():
    a = mixed(np.arange(1, 901, dtype=np.uint64))
    sets = [np.sort(a[:600]), np.sort(a[300:900]), np.sort(a[:600]), a[:1], a[:0]]
    sig = superminhash(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    assert (sig[0] == sig[2]).all()
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.15
    assert len(set((sig[3] >> np.uint64(32)).tolist())) == SIZE          # one element: every step once
    assert (sig[4] == np.iinfo(np.uint64).max).all()


def test_superminhash_is_the_sequential_algorithm():
    found = mixed(np.arange(50, 57, dtype=np.uint64))
    size, mask = 16, (1 << 64) - 1
    best = [1 << 80] * size
    for e in found.tolist():
        place = list(range(size))
        for j in range(size):
            draw = int(mixed(np.array([(e + 0x9E3779B97F4A7C15 * (j + 1)) & mask], dtype=np.uint64))[0])
            k = j + ((draw & 0xFFFFFFFF) * (size - j) >> 32)
            place[j], place[k] = place[k], place[j]
            best[place[j]] = min(best[place[j]], (j << 32) | (draw >> 32))
    assert superminhash(found, np.array([0, 7]), size)[0].tolist() == best


def shingles(text):
    w = words(lower(text))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def expected_near(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    pairs = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k]
             if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    found = groups(pairs, {i for i, _ in rows if i is not None})
    return Counter((i, len(s), found.get(i), i == found.get(i)) for i, s in sets)


@pytest.mark.parametrize("exact", [False, True])
def test_near_duplicates_against_all_pairs(spark, exact):
    r = rng(5)
    rows, number = list(ODD), 100
    for _ in range(12):
        base = some_text(r, r.randrange(30, 300)).split()
        for _ in range(r.randrange(1, 9)):
            copy = list(base)
            for _ in range(r.randrange(0, 9)):
                copy[r.randrange(len(copy))] = f"edit{r.randrange(10 ** 6)}"
            rows.append((number, " ".join(copy).upper() if r.random() < 0.2 else " ".join(copy)))
            number += 1
    passage = some_text(r, 120)
    rows += [(number + k, passage + " " + some_text(r, r.randrange(10, 90))) for k in range(40)]
    out = near_duplicates(frame(spark, rows), exact=exact).collect()
    assert Counter(tuple(x) for x in out) == expected_near(rows)


def test_components_against_union_find(spark):
    r = rng(9)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    pairs += [(5000, 5001 + i) for i in range(80)]
    df = spark.createDataFrame([*pairs, (None, 3), (4, None), (7, 7)], "a bigint, b bigint")
    real = [(a, b) for a, b in pairs if a != b]
    expected = groups(real, {x for p in real for x in p})
    assert {x["node"]: x["label"] for x in components(df).collect()} == expected
    assert components(df.where("a = b")).collect() == []


def test_rows_keep_their_other_columns(spark):
    from prepforge.llm.tables import keep_rows

    docs = frame(spark, ODD)
    kept = keep_rows(docs, exact_duplicates(docs))
    assert kept.columns == docs.columns
    assert Counter((x["doc_id"], x["text"]) for x in kept.collect()) == Counter(
        {(1, None): 1, (3, " \t\n"): 1, (4, "one"): 1, (5, "two words"): 1, (7, "x" * 300_000): 1,
         (8, "a b c d e " * 4000): 1, (9, "ÄÖ \u3000 é\x1c q"): 1})
    assert collected(kept)[4]["kept"] == "x"


def test_null_ids_stay_once_per_text(spark):
    from prepforge.llm.tables import keep_rows

    rows = ODD + [(None, "no id")] * 30 + [(None, "no \t\n id")] * 5 + [(None, "another")]
    docs = frame(spark, rows)
    exact = keep_rows(docs, exact_duplicates(docs)).collect()
    assert Counter(" ".join(words(x["text"])) for x in exact if x["doc_id"] is None) == {"no id": 1, "another": 1}
    assert {x["doc_id"] for x in exact} == {None, 1, 3, 4, 5, 7, 8, 9}
    near = keep_rows(docs, near_duplicates(docs)).collect()
    assert Counter(" ".join(words(x["text"])) for x in near if x["doc_id"] is None) == {
        "no id": 1, "another": 1, "two words": 1, "": 1}


@pytest.mark.parametrize("parts, turned", [(1, False), (1, True), (5, False)])
def test_one_id_on_two_texts_links_both(spark, parts, turned):
    r = rng(31)
    a, b = some_text(r, 200), some_text(r, 200)
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (4, some_text(r, 50)), (1, None)]
    out = near_duplicates(frame(spark, rows[::-1] if turned else rows, parts)).collect()
    assert {(x["doc_id"], x["component_id"]) for x in out} == {(1, 1), (2, 1), (3, 1), (4, 4)} and len(out) == 6


def test_a_passage_of_many_texts_pairs_none_of_them(spark):
    r = rng(32)
    shared = some_text(r, 120)
    texts = [f"{some_text(r, 100)} {shared} {some_text(r, 100)}" for _ in range(300)]
    found, bounds = near_dedup.shingle_sets(next(blocks(pa.array(texts))))
    sets_ = spark.createDataFrame([(i, i, found[bounds[i]:bounds[i + 1]].view("int64").tolist()) for i in range(300)],
                                  "node bigint, label bigint, shingles array<bigint>").repartition(4)
    assert near_dedup._sharing_a_rare_shingle(sets_, 75).count() < 60      # of 44,850: ends of the passage


def test_exact_join_of_all_classes(spark):
    r = rng(33)
    base = [f"w{i}" for i in range(104)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:50] + ["x"] + base[51:])), (3, some_text(r, 90))]
    sets_ = [set(zip(*[words(t)[i:] for i in range(5)])) for _, t in rows]
    percent = 100 * len(sets_[0] & sets_[1]) // len(sets_[0] | sets_[1])
    for least, linked in ((percent, True), (percent + 1, False)):
        out = near_duplicates(frame(spark, rows), percent=least, exact=True).collect()
        assert {x["doc_id"]: x["component_id"] for x in out} == {1: 1, 2: 1 if linked else 2, 3: 3}
