"""Token alignment against a brute-force version that uses the tokenizers' own libraries on whole texts."""

import hashlib
from collections import Counter
from pathlib import Path

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from helpers import ODD, frame, rng, some_text
from tokenizers import Tokenizer

from prepforge.llm import alignment, queries
from prepforge.session import shared_root

PATHS = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))
STRANGE = [" lead", "trail ", "a  b   c", "line\nbreak\n\n next", "tab\t x \t", "x \n y\n z", "naïve Größe 北京 🎉🎉", "a▁b plain",
           "<|endoftext|> </s> <s>", "don't I'll 'quote' we've", "\x00 nul", "1234567 89.5, 6!?", "…— »x«", " ", "\n", "  ",
           "fi ① Å", "a　b c ​d", "word.\nNext. other;\rthing", "<0x41>", "é a\x1c b\x85 c"]


def brute(rows):
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    shown = {chr(x): x for x in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    shown |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown.values())}
    docs, counts = [], Counter()
    for doc, text in rows:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(shown[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
                   else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        spelled = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != spelled or b"".join(bytes_b) != spelled:
            docs.append((doc, [], [], [], []))
            continue
        spans = []
        for parts in (bytes_a, bytes_b):
            at, own = 0, []
            for p in parts:
                own.append((at, at + len(p)))
                at += len(p)
            spans.append(own)
        links, lo = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while lo < len(spans[1]) and spans[1][lo][1] <= s:
                lo += 1
            j = lo
            while j < len(spans[1]) and spans[1][j][0] < e:
                links.append((ids_a[i], ids_b[j]))
                j += 1
        common = {e for _, e in spans[0]} & {e for _, e in spans[1]}
        groups, i, j = [], 0, 0
        for end in sorted(common):
            x = next(k for k in range(i, len(ids_a)) if spans[0][k][1] == end) + 1
            y = next(k for k in range(j, len(ids_b)) if spans[1][k][1] == end) + 1
            groups.append(",".join(map(str, ids_a[i:x])) + "|" + ",".join(map(str, ids_b[j:y])))
            i, j = x, y
        counts.update(links)
        docs.append((doc, ids_a, ids_b, groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return Counter(
        (doc, len(x), len(y), len(groups), len(links), sum(counts[k] == best[k[1]] for k in links),
         sum(counts[k] for k in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for doc, x, y, groups, links in docs), counts, best


def found(spark, docs):
    rows = queries.alignment_digest(alignment.align_tokens(docs, *PATHS).documents).collect()
    return Counter(tuple(r) for r in rows)


@pytest.mark.parametrize("batch, pairs", [(1 << 22, 1 << 22), (300, 0)])
def test_equal_to_brute_force(spark, monkeypatch, batch, pairs):
    monkeypatch.setattr(alignment, "BATCH", batch)
    monkeypatch.setattr(alignment, "PAIRS", pairs)
    r = rng(5)
    rows = ODD + [(100 + i, t) for i, t in enumerate(STRANGE)] + [(200, s) for s in STRANGE[:4]]
    rows += [(300 + i, some_text(r, r.randrange(1, 60), 90) + r.choice(STRANGE)) for i in range(60)]
    docs = frame(spark, rows)
    want, counts, best = brute(rows)
    assert found(spark, docs) == want
    pairs = {(p["a"], p["b"]): (p["count"], p["best"]) for p in alignment.align_tokens(docs, *PATHS).pairs.collect()}
    assert pairs == {k: (n, n == best[k[1]]) for k, n in counts.items()}


def test_cuts_give_what_whole_texts_give():
    own, whole = alignment.Aligner(*PATHS), alignment.Aligner(*PATHS)
    assert own.cuts
    whole.cuts = False
    r = rng(6)
    alphabet = ["a", "The", "é", " ", " ", "  ", "\n", "\t", "　", "'s", "1", "!", "▁", "北", "\x1c", "\x85", "\x00", "_", "?.", "²"]
    for _ in range(3000):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(1, 14)))
        parts, one = own.align(own.stretches(" " + text)), whole.align(whole.stretches(" " + text))
        if "▁" in text:
            assert one[1].sum() == 0 and (parts[1][0] == 0).any()
        else:
            assert ";".join(parts[0]) == one[0][0] and parts[2].tolist() == one[2].tolist()
            assert parts[1].sum(axis=1).tolist() == one[1][:, 0].tolist()


def test_worker_starts_anew_without_a_difference(monkeypatch):
    own = alignment.Aligner(*PATHS)
    first = own.numbers(["some words here", None, "", "some other words"])
    monkeypatch.setattr(alignment, "KEPT", 1)
    second = own.numbers(["some words here", None, "", "some other words"])
    assert [x.tolist() for x in first] == [x.tolist() for x in second] and len(own.number) == 4


def test_batches_of_a_task_are_written_in_small_parts(spark, monkeypatch):
    small = getattr(alignment, "LARGE_ROWS", {}) | {"parquet.block.size": 1 << 20}
    monkeypatch.setattr(alignment, "LARGE_ROWS", small, raising=False)
    monkeypatch.setattr(alignment, "BATCH", 1 << 16)
    r = rng(7)
    letters = "abcdefghijklmnopqrstuvwxyzäéßñ北京"
    root = Path(shared_root(spark).removeprefix("file://"))
    before = set(root.glob("alignment-*"))
    rows = [(i, " ".join("".join(r.choices(letters, k=r.randrange(2, 12))) for _ in range(800))) for i in range(150)]
    found = alignment.align_tokens(frame(spark, rows).coalesce(1), *PATHS).documents
    parts = [pq.ParquetFile(p).metadata for d in set(root.glob("alignment-*")) - before for p in d.glob("*.parquet")]
    batches = [m for m in parts if "content" in m.schema.to_arrow_schema().names]
    sizes = [m.row_group(i).total_byte_size for m in batches for i in range(m.num_row_groups)]
    assert len(batches) == 1 and sum(sizes) > 2 << 20 and max(sizes) < 3 << 19
    assert found.count() == len(rows)


def test_empty_table(spark):
    assert not found(spark, frame(spark, ODD).limit(0))
