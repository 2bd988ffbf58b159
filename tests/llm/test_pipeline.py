from collections import Counter

import pytest
from helpers import ODD, frame, rng, some_text, words

import corpus_pipeline
from compare import DATA, connect, differences
from prepforge.llm import queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = rng(12)
    rows, labels = list(ODD), []
    for i in range(100, 420):
        toxic = r.random() < 0.25
        text = some_text(r, r.randrange(30, 120), 3000) + (" vile scumbag grotty" * 2 if toxic else "")
        rows.append((i, text))
        labels.append((i, int(toxic)))
    clean = [x for x in rows if x[0] and x[0] >= 100 and "vile" not in x[1]]
    rows += [(1000 + k, x[1].replace(" ", "  ")) for k, x in enumerate(clean[:20])]
    rows += [(2000 + k, x[1] + " tail") for k, x in enumerate(clean[20:40])]
    folder = str(tmp_path_factory.mktemp("corpus"))
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, {i for i, _ in clean}


def test_stages(spark, tables):
    folder, rows, clean = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == columns
        path = f"{folder}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = Counter((x["doc_id"], x["text"]) for x in docs.collect())
    after_toxic = {i for i, _ in kept["toxicity"]}
    assert clean <= after_toxic
    assert sum("vile" in (t or "") for _, t in kept["toxicity"]) <= 3
    exact = kept["exact_dedup"]
    assert clean <= {i for i, _ in exact} and not [i for i, _ in exact if i and 1000 <= i < 2000]
    plain = Counter(" ".join(words(t)) for (_, t), n in exact.items() for _ in range(n) if words(t))
    assert max(plain.values()) == 1
    near = {i for i, _ in kept["near_dedup"]}
    assert clean <= near | {7, 8} and not [i for i in near if i and i >= 2000]
    tokens = lambda c: sum(len(words(t)) * n for (_, t), n in c.items())
    assert kept["mixing"].items() <= kept["near_dedup"].items()
    assert 0.3 * tokens(kept["near_dedup"]) < tokens(kept["mixing"]) <= 0.9 * tokens(kept["near_dedup"])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {x["doc_id"] for x in packed} == {i for i, _ in kept["mixing"]}
    whole = corpus_pipeline.run(spark, folder).select("doc_id", "piece", "length", "ids_crc32").collect()
    assert Counter(map(tuple, whole)) == Counter(
        (x["doc_id"], x["piece"], x["length"], x["ids_crc32"]) for x in packed)


@pytest.mark.parametrize("key", [None, 7])
def test_mixture_keeps_rows_of_a_leaf_not_all_of_an_id(spark, key):
    rows = [(key, "w " * 100, "en", "src1")] * 5 + [(key, "w " * 10, "en", "src2"), (8, "w " * 30, "de", "src1"),
                                                   (9, "w " * 40, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(3)
    chosen = corpus_pipeline.mixing.mixture(docs, corpus_pipeline.LEVELS, corpus_pipeline.WEIGHTS, share=0.9, epochs=1)
    want = Counter((x["doc_id"], x["tokens"]) for x in chosen.collect())
    got = Counter((x["doc_id"], len(words(x["text"]))) for x in corpus_pipeline.mix(spark, docs, "").collect())
    assert got == want and sum(t * n for (_, t), n in got.items()) <= 0.9 * 580


def test_empty_table(spark, tables):
    folder, _, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    out = queries.QUERIES[name](spark, f"{DATA}/sf0.001")
    if name in queries.ORACLES:
        assert differences(out, connect(f"{DATA}/sf0.001"), queries.ORACLES[name]) is None
    else:
        source = "pages" if name.startswith("op1_") else "documents"
        assert out.count() >= spark.read.parquet(f"{DATA}/sf0.001/{source}.parquet").count()
