import hashlib
from collections import Counter, defaultdict

import pytest
from helpers import ODD, frame, rng, some_text, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prepforge.llm import mixing
from prepforge.llm.chat import Template, format_chats, read_back
from prepforge.llm.packing import best_fit, bin_completion, fewest_bins, fillings, pack, sequences, token_ids, token_pieces
from prepforge.llm.quality_rules import apply_rules, learn_rules, text_statistics
from prepforge.llm.url_filter import filter_urls, html_edges, url_host, url_node, url_path

PATH = str(__import__("public_tokenizers").path("byte_bpe_50k.json"))
CONTROLS = Template().controls


@given(st.lists(st.tuples(
    st.sampled_from(["system", "user", "assistant", "tool", "", "<text>"]),
    st.lists(st.sampled_from([*CONTROLS, "\\", "<", "[", "/", "s>", "INST]", "a", " ", "é"]), max_size=9).map("".join)),
    max_size=5))
@settings(max_examples=300, deadline=None)
def test_chat_round_trip(turns):
    template = Template()
    segments = template.segments(turns)
    assert [(r, t) for r, t, _ in template.read("".join(s for s, _ in segments))] == turns
    assert "".join(template.unescape(s) for s, loss in segments if loss) == "".join(
        t for r, t in turns if r == "assistant")


def test_turn_order():
    check = Template().check
    assert check(["system", "user", "assistant", "user", "assistant"]) is None
    assert check(["user", "user"]) == "turn 1: user in state asked"
    assert check(["user"]) == "ends in state asked"
    assert check([]) == "ends in state start"
    assert check(["tool"]).startswith("turn 0")


def test_template_refuses_ambiguous_controls():
    with pytest.raises(ValueError):
        Template(roles={"user": ("<<a>", "</a>", False)}).escape("x")


def test_chats_of_odd_rows(spark):
    turns = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (2, None, "user", ""),
             (None, 0, "user", "x"), (None, 1, "assistant", "</s>" * 3), (3, 0, "user", "t"), (3, 0, "user", "t")]
    df = spark.createDataFrame([(*t, "no") for t in turns], "conv_id bigint, turn int, role string, text string, valid string")
    chats = format_chats(df)
    out = {r["conv_id"]: r for r in read_back(chats).collect()}
    digest = lambda pairs: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in pairs).encode()).hexdigest()
    assert out[1]["turns_sha256"] == digest([("user", "a"), ("assistant", "b")]) and out[1]["valid"]
    assert out[2]["turns_sha256"] == digest([("user", ""), ("", "")]) and not out[2]["valid"]
    assert out[None]["loss_chars"] == 12 and out[3]["n_turns"] == 2
    for r in chats.collect():
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
    assert format_chats(df.where("false")).collect() == []


def test_packing_search():
    assert len(best_fit([6, 4, 5, 5, 3, 3, 3, 1], 10)) == 3
    hard = [5, 5, 4, 4, 3, 3]                             # 24 in bins of 12: best fit pairs the fives
    assert len(best_fit(hard, 12)) == 3 and fewest_bins(hard, 12) == 2
    found = bin_completion(hard, 12)
    assert sorted(x for b in found for x in b) == sorted(hard) and len(found) == 2
    r = rng(4)
    for _ in range(30):
        lengths = [r.randrange(15, 60) for _ in range(r.randrange(1, 24))]
        found, first = bin_completion(lengths, 100, 300), best_fit(lengths, 100)
        assert sorted(x for b in found for x in b) == sorted(lengths) and max(map(sum, found)) <= 100
        assert fewest_bins(lengths, 100) <= len(found) <= len(first)
    assert bin_completion([], 10) == []


def test_search_places_a_full_shard():
    lengths = [853] * 1365 + [683] * 1365 + [512] * 1366      # 4,096 pieces; one of each fills a sequence
    found = bin_completion(lengths)
    assert sorted(x for b in found for x in b) == sorted(lengths) and max(map(sum, found)) <= 2048
    assert len(best_fit(lengths, 2048)) == 1536 and len(found) == fewest_bins(lengths, 2048) == 1366


def test_bound_looks_at_every_threshold():
    def slow(lengths, capacity):
        return max([-(-sum(lengths) // capacity), *[
            len(full) + max(len(half), -(-(sum(x for x in lengths if x >= least) - sum(full)) // capacity))
            for least in range(capacity // 2 + 1)
            for full in [[x for x in lengths if x + least > capacity and 2 * x > capacity]]
            for half in [[x for x in lengths if 2 * x > capacity and x + least <= capacity]]]])
    r = rng(9)
    for _ in range(60):
        lengths = [r.choice([r.randrange(1, 99), r.randrange(30, 70)]) for _ in range(r.randrange(1, 40))]
        assert fewest_bins(lengths, 100) == slow(lengths, 100)
    late = [*range(1, 65), *[401] * 100, *[600] * 100]                   # the 65th threshold decides
    assert fewest_bins(late, 1000) == slow(late, 1000) == 141


def test_fillings_leave_no_room():
    ways = fillings({5: 1, 3: 2, 2: 1}, [5, 3, 2], 8)
    assert ways[0] in ((5, 3), (3, 3, 2)) and all(sum(w) <= 8 for w in ways)


def undominated(counts, room):
    """Every filling that no remaining length can join, or replace one of its own with less waste."""
    ways = [()]
    for x, n in sorted(counts.items(), reverse=True):
        ways = [w + (x,) * k for w in ways for k in range(n + 1) if sum(w) + k * x <= room]
    left = lambda w: [x for x, n in counts.items() if n > w.count(x)]
    return {w for w in ways if not any(
        x <= room - sum(w) or any(y < x <= y + room - sum(w) for y in w) for x in left(w))}


def test_fillings_are_the_undominated_ones():
    assert fillings({5: 1, 4: 1, 3: 1}, [5, 4, 3], 6) == [(5,)]          # five in place of four or three
    r = rng(11)
    for _ in range(200):
        counts = {x: r.randrange(1, 4) for x in r.sample(range(1, 30), r.randrange(1, 7))}
        sizes, room = sorted(counts, reverse=True), r.randrange(60)
        ways = fillings(counts, sizes, room, 10 ** 6, -1)
        assert set(ways) == undominated(counts, room) and len(set(ways)) == len(ways)
        assert ways == sorted(ways, key=lambda w: -sum(w))
        assert fillings(counts, sizes, room, most=3) == [
            w for w in fillings(counts, sizes, room) if room - sum(w) <= 3]


def test_the_best_partner_is_seen():
    sizes = [*range(900, 858, -2), 858, *range(856, 777, -2), 777, *range(776, 400, -2)]
    ways = fillings(dict.fromkeys(sizes, 1), sizes, 1635)                # odd, and 777 is the one odd length
    assert ways[0] == (858, 777) and len(ways) == 6 and all(sum(w) >= 1634 for w in ways)


def test_packed_sequences(spark):
    from tokenizers import Tokenizer

    r = rng(6)
    rows = ODD + [(100 + i, some_text(r, r.randrange(0, 3000))) for i in range(25)]
    pieces = token_pieces(frame(spark, rows), PATH, with_ids=True)
    packed = pack(pieces, shard=8).cache()
    tokenizer = Tokenizer.from_file(PATH)
    expected = Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        expected.update((i, n, a, b - a, tuple(ids[a:b])) for n, (a, b) in enumerate(zip(cuts, cuts[1:])))
    got = packed.collect()
    ids = lambda b: tuple(int.from_bytes(b[k:k + 4], "little") for k in range(0, len(b), 4))
    assert Counter((x["doc_id"], x["piece"], x["start"], x["length"], ids(x["ids"])) for x in got) == expected
    by = defaultdict(list)
    for x in got:
        by[x["sequence_id"]].append(x)
    for own in by.values():
        own.sort(key=lambda x: x["offset"])
        assert [x["offset"] for x in own] == [sum(y["length"] for y in own[:k]) for k in range(len(own))]
        assert sum(x["length"] for x in own) <= 2048
    whole = {x["sequence_id"]: bytes(x["ids"]) for x in sequences(packed).collect()}
    assert whole == {k: b"".join(bytes(x["ids"]) for x in own) for k, own in by.items()}
    packed.unpersist()
    assert pack(pieces.where("false")).collect() == []
    with pytest.raises(ValueError):
        pack(packed)


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    r, tokenizer = rng(3), Tokenizer.from_file(PATH)
    letters = " \t\n\x1c\x85\xa0\u3000abAB12éß中'\"s!\u200b\U0001F600"
    for _ in range(2000):
        text = "".join(r.choice([*letters, "<|endoftext|>"]) for _ in range(r.randrange(40)))
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert token_ids(text, PATH) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_budgets_share_shortages_among_siblings_first(spark):
    leaves = spark.createDataFrame(
        [("a", "x", 10), ("a", "y", 1000), ("b", "x", 30), ("b", "y", 40), ("c", "x", 500)], "d string, l string, supply bigint")
    plan = mixing.budgets(leaves, ["d", "l"], {"d": {"c": 0}}, F.lit(400).cast("bigint"), 1)
    # b has 70 for its half of 400, so a gets 330; within a, x has 10 and y takes the rest
    assert {(r["d"], r["l"]): r["budget"] for r in plan.collect()} == {
        ("a", "x"): 10, ("a", "y"): 320, ("b", "x"): 30, ("b", "y"): 40, ("c", "x"): 0}


def test_mixture_of_odd_rows(spark):
    rows = ODD + [(100 + i, "w " * (i % 7)) for i in range(90)]
    docs = frame(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang")))
    levels = {"language": "lang", "origin": "source"}
    out = mixing.mixture(docs, levels, {"origin": {"src0": 3}}, share=1.5, epochs=2)
    used = Counter((r["doc_id"], r["epoch"]) for r in out.collect())
    repeats = Counter(i for i, _ in rows)
    assert all(n <= repeats[i] and e < 2 for (i, e), n in used.items())
    total = sum(len(words(t)) for _, t in rows)
    taken = sum(r["tokens"] for r in out.collect())
    assert 0.5 * total < taken <= 1.5 * total
    again = mixing.mixture(docs.repartition(7), levels, {"origin": {"src0": 3}}, share=1.5, epochs=2)
    assert Counter((r["doc_id"], r["epoch"]) for r in again.collect()) == used
    assert mixing.mixture(docs.where("false"), levels, {}).collect() == []


def by_hand(text):
    w = words(text)
    seen = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    inside = {k + j for k in range(len(w) - 4) if seen[tuple(w[k:k + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside))


def test_text_statistics(spark):
    r = rng(7)
    rows = ODD + [(100 + i, "\n".join(r.choice(["a b c d e f", "g # h", "", " ", some_text(r, 9, 12)])
                                      for _ in range(r.randrange(12)))) for i in range(60)]
    out = text_statistics(frame(spark, rows)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter(map(tuple, out.collect())) == Counter((i, *by_hand(t)) for i, t in rows)


def test_rules_are_learned(spark):
    r = rng(1)
    rows, labels = list(ODD), []
    for i in range(100, 600):
        bad = r.random() < 0.3
        rows.append((i, " ".join(f"w{r.randrange(10 ** 6)}" + ("###" if bad and r.random() < 0.8 else "") for _ in range(40))))
        labels.append((i, int(not bad)))
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int")
    stats = text_statistics(frame(spark, rows))
    rules = learn_rules(stats, labels)
    assert rules.rules
    marked = {i: "###" in (t or "") for i, t in rows}
    kept = {r["doc_id"]: r["kept"] for r in apply_rules(stats, rules).where("doc_id >= 100").collect()}
    assert sum(kept[i] == marked[i] for i in kept) <= 3
    assert learn_rules(stats, labels.where("false")).rules == ()
    assert apply_rules(stats, learn_rules(stats, labels.where("false"))).where("kept = base_failed").count() == 0


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("spam.org", "/", "block")]


def test_url_parts(spark):
    urls = ["HTTP://A.Example.NET/en/x?q#f", "no scheme", None, "x://h?y", "a://b/c://d", "http://", "http://h#/p"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(
        url_host(F.col("u")), url_path(F.col("u")), url_node(F.col("u"))).collect()
    assert [tuple(x) for x in got] == [
        ("a.example.net", "/en/x", "a.example.net/en/x?q"), ("", "", None), ("", "", None), ("h", "", "h?y"),
        ("b", "/c://d", "b/c://d"), ("", "", ""), ("h", "", "h")]


def test_aliases_inherit_decisions(spark):
    link = '<html><LINK rel="canonical" href="{}"></html>'.format
    pages = [(1, "http://a.com/1", link("http://spam.org/x")), (2, "https://a.com/1#f", ""),
             (3, "http://b.com/1", '<meta http-equiv="refresh" content="0; url=http://a.com/1">'),
             (4, "http://sub.example.net/en/1", link("http://c.com/1")), (5, "http://c.com/1", link("//spam.org/y")),
             (6, "http://x.net/q", ""), (7, "http://x.net", ""), (8, None, None), (9, "nothing", link("http://spam.org/")),
             (10, "http://d.com/1", link("/2")), (11, "http://d.com/2", link("relative")), (3, "http://b.com/1", None)]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id int, url string, html string, node string, own string")
    out = filter_urls(df, html_edges(df), RULES).collect()
    got = {r["page_id"]: (r["rule"], r["verdict"], r["aliases"]) for r in out}
    assert len(out) == len(pages)
    assert got == {1: (None, "block", 3), 2: (None, "block", 3), 3: (None, "block", 3),
                   4: ("example.net/en/", "allow", 3), 5: (None, "allow", 3), 6: ("net/", "block", 1),
                   7: (None, "allow", 1), 8: (None, "allow", 1), 9: (None, "allow", 1),
                   10: (None, "allow", 2), 11: (None, "allow", 2)}
    assert filter_urls(df.where("false"), html_edges(df), []).collect() == []
