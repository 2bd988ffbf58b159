"""Language by compression: brute-force sizes, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pytest
import zstandard
from helpers import ODD, lower, rng

from prepforge.llm import language_id, queries
from prepforge.llm.language_id import compressed_sizes, fit_languages, predict_language
from prepforge.llm.textblocks import LOWER

PARTS = {"xa": ["ka", "lo", "mi", "tu", "ras"], "xb": ["bre", "sch", "ung", "ein", "dor"], "xc": ["ción", "ñar", "llo", "que", "es"]}
SCHEMA = "doc_id bigint, text string, lang string, source string, score double, _text string, _letter int"


def speech(r, lang, n):
    return " ".join("".join(r.choice(PARTS[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def rows():
    r = rng(9)
    out = [(i, speech(r, (lang := r.choice(list(PARTS))), r.randrange(4, 200)), lang) for i in range(1000, 1500)]
    return out + [(i, t, None) for i, t in ODD] + [(20, "12 34 !", "xa"), (21, "Ⅷ 8", "xb"), (22, "日本", "xa"), (23, None, "xb")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", 0.5, "c", 1) for i, t, g in rows], SCHEMA).repartition(4)


def test_sizes_are_those_of_chunks_compressed_alone():
    r = rng(2)
    texts = [b"", b"a", speech(r, "xa", 900).encode(), speech(r, "xc", 5).encode()]
    dictionaries = [speech(r, g, 400).encode() for g in PARTS]
    sizes = compressed_sizes(texts, dictionaries)
    for i, t in enumerate(texts):
        for k, content in enumerate(dictionaries):
            made = zstandard.ZstdCompressor(level=language_id.LEVEL, write_content_size=False, write_checksum=False,
                                            write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(
                                                content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            cut = [t[j:j + language_id.CHUNK] for j in range(0, len(t), language_id.CHUNK)]
            assert abs(sizes[i, k] - sum(len(made.compress(c)) for c in cut)) <= 4 * len(cut)   # tables made once
            back = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(
                content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            assert b"".join(back.decompress(made.compress(c), max_output_size=1 << 20) for c in cut) == t


def test_whole_text_decides():
    r = rng(3)
    a, b = speech(r, "xa", 300), speech(r, "xb", 3000)
    own = [speech(rng(5 + i), g, 2000).encode() for i, g in enumerate(PARTS)]
    assert compressed_sizes([(a + " " + b).encode()], own).argmin() == 1
    assert compressed_sizes([(b + " " + a).encode()], own).argmin() == 1


def test_held_out_rows_and_odd_rows(spark, rows):
    docs = frame(spark, rows)
    model = fit_languages(docs)
    assert sorted(model.names) == list(PARTS)
    got = predict_language(docs, model, into="score")
    assert got.columns == ["doc_id", "text", "lang", "source", "_text", "_letter", "score"] and got.count() == len(rows)
    found = [(r["doc_id"], r["text"], r["lang"], r["score"]) for r in got.collect()]
    tested = [(g, s) for i, _, g, s in found if i and i >= 1000 and held(i)]
    assert len(tested) > 100 and np.mean([g == s["lang"] for g, s in tested]) > 0.98
    assert np.mean([s["accepted"] for _, s in tested]) > 0.9
    assert all(0 <= s["score"] <= 1 for *_, s in found)
    for _, t, _, s in found:
        letters = any(c.isalpha() for c in t or "")
        assert (s["lang"] == "und") == (not letters)
        assert letters or (s["score"], s["margin"], s["accepted"]) == (0.0, 0.0, False)


def test_predictions_are_the_smallest_sizes(spark, rows):
    docs = frame(spark, rows)
    model = fit_languages(docs)
    for r in predict_language(docs, model).collect():
        if r["text"] and any(c.isalpha() for c in r["text"]):
            size = compressed_sizes([lower(r["text"]).encode()], model.dictionaries.value)[0]
            assert r["language"]["lang"] == model.names[int(size.argmin())]


def test_learning_ignores_held_out_rows_copies_and_order(spark, rows):
    base = fit_languages(frame(spark, rows))
    misled = [(i, speech(rng(i), "xa", 50), "xb") if i and held(i) and i >= 1000 else (i, t, g) for i, t, g in rows]
    assert fit_languages(frame(spark, misled)).dictionaries.value == base.dictionaries.value
    copies = rows + [(30, rows[1][1], rows[1][2])] * 40 + [(31, rows[1][1], rows[1][2])] * 40
    assert fit_languages(frame(spark, copies).repartition(7)).dictionaries.value == base.dictionaries.value


def test_bounds_and_empty_tables(spark, rows, monkeypatch):
    docs = frame(spark, rows)
    none = fit_languages(docs.limit(0))
    assert none.names == []
    assert {(r["language"]["lang"], r["language"]["score"]) for r in predict_language(docs, none).collect()} == {("und", 0.0)}
    assert predict_language(docs.limit(0), fit_languages(docs)).count() == 0
    monkeypatch.setattr(language_id, "TOTAL", 2400)
    small = fit_languages(docs)
    assert all(len(d) < 3 * 2400 for d in small.dictionaries.value)
    monkeypatch.setattr(language_id, "LANGUAGES", 1)
    one = fit_languages(docs)
    assert len(one.names) == 1
    assert {r["language"]["lang"] for r in predict_language(docs, one).collect()} == {one.names[0], "und"}


def test_query_on_given_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").collect()
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_compression"](spark, sf).collect()}
    assert len(got) == len(docs) and all(got[d["doc_id"]]["held_out"] == held(d["doc_id"]) for d in docs)
    tested = [d for d in docs if held(d["doc_id"])]
    assert np.mean([got[d["doc_id"]]["lang_pred"] == d["lang"] for d in tested]) > 0.97


def test_lowering_is_of_ascii_letters_alone():
    assert bytes(LOWER[list(b"AZaz@[\xc3\x84")]) == b"azaz@[\xc3\x84"
