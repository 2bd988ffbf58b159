import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import ODD, collected, frame, lower, rng, some_text, words

from prepforge.llm import byte_cnn as cnn
from prepforge.llm import katz
from prepforge.llm.byte_cnn import fit_quality, score_quality
from prepforge.llm.toxicity import decay, fit_toxicity, maximal_segments, score_toxicity


def held(i, folds):
    return zlib.crc32(str("" if i is None else i).encode()) % folds


def test_maximal_segments_against_the_recursive_definition():
    def whole(scores, at, out):
        total = np.concatenate(([0], np.cumsum(scores)))
        best = max(((total[j] - total[i], i - j, -i, i, j) for i in range(len(scores))
                    for j in range(i + 1, len(scores) + 1)), default=(0,))
        if best[0] <= 0:
            return out
        i, j = best[3:]
        whole(scores[:i], at, out)
        out.append((at + i, at + j - 1))
        return whole(scores[j:], at + j, out)

    r = np.random.default_rng(1)
    for _ in range(200):
        scores = r.integers(-5, 6, r.integers(1, 14)) + r.random() / 64
        hits = np.flatnonzero(scores > 0)
        total = np.concatenate(([0], np.cumsum(scores)))
        got = [(a, b) for a, b, _ in maximal_segments(hits, total[hits], total[hits + 1])]
        sums = lambda s: sorted(round(total[b + 1] - total[a], 9) for a, b in s)  # noqa: B023, E731
        assert sums(got) == sums(whole(scores, 0, []))


def test_chance_decay():
    rate = decay(np.array([-1.0, 1.0]), np.array([0.75, 0.25]))
    assert rate == pytest.approx(math.log(3), abs=1e-9)


@pytest.fixture(scope="module")
def labelled(spark):
    r = rng(2)
    rows, labels = list(ODD), [(1, 1, 0), (2, None, None), (4, 1, 0), (None, 0, 1), (5, 1, 0), (5, 1, 0)]
    for i in range(100, 500):
        bad, toxic = r.random() < 0.3, r.random() < 0.3
        w = some_text(r, r.randrange(20, 120), 300).split()
        if toxic:
            for _ in range(r.randrange(2, 6)):
                w[r.randrange(len(w))] = r.choice(["vile", "scumbag", "grotty"])
        text = " ".join(w)
        rows.append((i, text.upper() + "!!" if bad else text))
        labels.append((i, int(not bad), int(toxic)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), rows


def test_toxic_passages(spark, labelled):
    docs, labels, rows = labelled
    model = fit_toxicity(docs, labels)
    out = score_toxicity(docs, model).collect()
    assert len(out) == len(rows) and set(docs.columns) < set(out[0].asDict())
    text = dict(rows)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    wrong = [x for x in out if x["doc_id"] and x["doc_id"] >= 100 and held(x["doc_id"], 3) == 1
             and (x["toxicity"]["score"] >= 0.7) != truth[x["doc_id"]]]
    assert len(wrong) <= 3
    for x in out:
        assert 0 <= x["toxicity"]["score"] <= 1
        for p in x["toxicity"]["passages"]:
            found = [lower(w) for w in words(text[x["doc_id"]])[p["first_word"]:p["last_word"] + 1]]
            assert found[0].strip("!") in ("vile", "scumbag", "grotty") or x["doc_id"] < 100
    odd = {x["doc_id"]: x["toxicity"]["score"] for x in out if x["doc_id"] in (1, 2, 3)}
    assert len(set(odd.values())) == 1


def test_models_without_labels(spark, labelled):
    docs, labels, rows = labelled
    none = labels.where("false")
    assert score_toxicity(docs, fit_toxicity(docs, none)).where("toxicity.score >= 0.7").count() == 0
    assert score_quality(docs, fit_quality(docs, none)).where("quality_score between 0 and 1").count() == len(rows)
    assert score_toxicity(docs.where("false"), fit_toxicity(docs.where("false"), labels)).collect() == []
    with pytest.raises(ValueError):
        score_toxicity(docs, fit_toxicity(docs, none), into="kept")


def test_network_gradients():
    r = np.random.default_rng(0)
    texts = [r.integers(32, 127, n).astype(np.uint8) for n in (0, 3, 5, 700, 1300)]
    bounds, data = np.cumsum([0, *map(len, texts)]), np.concatenate(texts)
    w = cnn.Weights(*[a.astype(np.float64) for a in cnn.Weights.fresh().arrays()])
    y = np.array([1, 0, 1, 0, 1.0])

    def slowly():
        out = []
        for t in texts:
            p = np.concatenate((t, np.zeros(cnn.WIDTH, np.uint8)))
            each = np.array([sum(w.filters[k][p[i + k]] for k in range(cnn.WIDTH)) for i in range(len(t) + 1)])
            half = [each[i:i + cnn.HALF].max(0) for i in range(0, len(each), cnn.HALF)]
            chunk = [np.maximum(a, b) for a, b in zip(half, half[1:])] or [half[0]]
            chunk = np.maximum(np.array(chunk) + w.offset, 0)
            out.append(np.concatenate((chunk.mean(0), chunk.max(0), chunk.min(0))) @ w.head[:-1] + w.head[-1])
        return np.array(out)

    def loss():
        z = cnn.logits(data, bounds, w)
        return np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y))

    assert np.allclose(slowly(), cnn.logits(data, bounds, w), atol=1e-6)
    for values, gradient in zip(w.arrays(), cnn.gradients(data, bounds, y, w), strict=True):
        for i in np.argsort(-np.abs(gradient.reshape(-1)))[:5]:
            flat, before = values.reshape(-1), values.reshape(-1)[i]
            flat[i] = before + 1e-4
            up = loss()
            flat[i] = before - 1e-4
            down = loss()
            flat[i] = before
            assert (up - down) / 2e-4 == pytest.approx(float(gradient.reshape(-1)[i]), abs=2e-5)


def test_quality_network(spark, labelled):
    docs, labels, rows = labelled
    model = fit_quality(docs, labels)
    assert model == fit_quality(docs.repartition(5), labels.repartition(2))
    out = score_quality(docs, model).collect()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    wrong = [x for x in out if x["doc_id"] and x["doc_id"] >= 100 and held(x["doc_id"], 3) == 1
             and (x["quality_score"] >= 0.5) != truth[x["doc_id"]]]
    assert len(out) == len(rows) and len(wrong) <= 3


def katz_by_hand(rows, learns):
    tokens = [(i, [*words(lower(t)), None]) for i, t in rows]
    one, two, after = Counter(), Counter(), Counter()
    for i, w in tokens:
        if learns(i):
            for h, x in zip(["<s>", *w], w):
                one[x] += 1
                two[h, x] += 1
                after[h] += 1
    n, k = sum(one.values()), katz.CLASSES
    of = lambda c: katz.discounts([sum(v == r for v in c.values()) for r in range(1, k + 3)])
    d1, d2 = of(one), of(two)
    less = lambda c, d: c - katz.TAIL if c > k else c * d[c - 1] if c else 0
    p1 = {w: less(c, d1) / n for w, c in one.items()}
    rest = 1 - sum(p1.values())
    seen, single = defaultdict(float), defaultdict(float)
    for (h, w), c in two.items():
        seen[h] += less(c, d2)
        single[h] += p1[w]
    weight = {h: (1 - seen[h] / after[h]) / (1 - single[h]) for h in after}

    def p(h, w):
        if two[h, w]:
            return less(two[h, w], d2) / after[h]
        return weight.get(h, 1.0) * p1.get(w, rest)
    for h in [*list(after)[:5], "never"]:
        assert sum(p(h, w) for w in p1) + p(h, "never seen") == pytest.approx(1)
    for i, w in tokens:
        yield (i, len(w), sum(one[x] > 0 for x in w), n,
               sum(math.log10((one[x] + 0.1) / (n + 0.1 * (len(one) + 1))) for x in w),
               sum(math.log10(p(h, x)) for h, x in zip(["<s>", *w], w)))


def test_katz_against_one_process(spark, monkeypatch):
    r = rng(8)
    rows = ODD + [(50 + i, some_text(r, int(r.paretovariate(1) * 8), 60)) for i in range(150)]
    got = sorted(map(tuple, katz.katz_scores(frame(spark, rows)).collect()), key=repr)
    expected = sorted(katz_by_hand(rows, lambda i: held(i, 10) != 0), key=repr)
    assert [g[:4] for g in got] == [e[:4] for e in expected]
    for g, e in zip(got, expected, strict=True):
        assert g[4:] == pytest.approx(e[4:], rel=1e-9)


def test_katz_without_training(spark):
    from pyspark.sql import functions as F

    out = collected(katz.katz_scores(frame(spark, ODD[:5]), learn=F.lit(False)))
    assert out[5]["n_tokens"] == 3 and out[5]["n_known"] == 0 and out[5]["score"] == 0
    assert katz.katz_scores(frame(spark, ODD).where("false")).collect() == []
