import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, kept string, label int, node int, score double"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def some_text(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def frame(spark, rows, parts=3):
    """Documents with further columns whose names the operators use themselves."""
    full = [(i, t, "en", f"src{(i or 0) % 3}", "x", 1, 2, 0.5) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "two words"), (6, "two words"), (6, "two words"),
       (None, "two words"), (None, None), (7, "x" * 300_000), (8, "a b c d e " * 4000), (9, "ÄÖ \u3000 é\x1c q")]


def collected(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def rng(seed=3):
    return random.Random(seed)
