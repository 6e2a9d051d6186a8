import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from sparkwarden.llm import alignment, tokens
from sparkwarden.llm.alignment import alignment_report, alignments, partners
from sparkwarden.llm.tokens import Vocabulary, byte_letters, pieces

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, row int, pairs string"
ODD = [
    "", None, " ", "a", "The quick brown fox", "  two  spaces ", "tab\tand\nline\r\n\n", "x<|endoftext|>y <s> </s> <unk> <0x41>", "é ñ ß 中文字 \U0001f600\U0001f468‍\U0001f469", "▁ the mark itself", "a\u0085b c　d",
    "ﬁ ① é", "it's we'll they'd 'S", "1234567890 3.14", "word, " * 40, "\x00\x01 nul", "a" * 700, " " * 500 + "b", "İstanbul ǆ ʰ", "x​y",
]


def plain(rows):
    """By the definition, with sets of ends."""
    model, pieces_of = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    model.encode_special_tokens = True
    letters = byte_letters()
    each = []
    for _, text in rows:
        a, b, ends = [], [], []
        if text:
            a = model.encode(" " + text, add_special_tokens=False).ids
            b = pieces_of.encode(text)
            told = [[bytes(letters[c] for c in model.id_to_token(i)) for i in a], [bytes([int(p[3:5], 16)]) if pieces_of.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, pieces_of.id_to_piece(i)) for i in b)]]
            if all(b"".join(t) == (" " + text).encode() for t in told):
                ends = [{sum(map(len, t[: k + 1])): k for k in range(len(t))} for t in told]
            else:
                a, b = [], []
        cuts = sorted(set(ends[0]) & set(ends[1])) if a else []
        each.append((a, b, [(ends[0][c], ends[1][c]) for c in cuts]))
    count = Counter((a[i], b[j]) for a, b, g in each for i, j in g)
    most = {}
    for (_, j), n in count.items():
        most[j] = max(most.get(j, 0), n)
    out = []
    for (doc_id, _), (a, b, g) in zip(rows, each, strict=True):
        at, said = (0, 0), []
        for i, j in g:
            said.append(",".join(map(str, a[at[0] : i + 1])) + "|" + ",".join(map(str, b[at[1] : j + 1])))
            at = i + 1, j + 1
        links = [(a[i], b[j]) for i, j in g]
        digest = hashlib.sha256(";".join(said).encode()).hexdigest() if a else ""
        out.append((doc_id, len(a), len(b), len(g), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), digest))
    return out, count, most


def some_texts(n):
    rng = random.Random(9)
    parts = ["the ", "ing", " un", "é", "中", "\n", "  ", "<s>", "12", ".", "'s", "▁", " Q", "\U0001f600", "Straße ", "x" * 50, " "]
    return ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(n)]


def test_equals_the_definition(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(ODD + some_texts(300))] + [(3, "a"), (None, "a"), (4, "The quick brown fox")]
    want, count, most = plain(rows)
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], SCHEMA).repartition(5)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, alignment_report(df, A, B).collect()), key=key) == sorted(want, key=key)
    monkeypatch.setattr(alignment, "HELD", 5)
    assert sorted(map(tuple, alignment_report(df, A, B, few=0).collect()), key=key) == sorted(want, key=key)  # joined instead
    assert {((r.a_id, r.b_id), r["count"], r.best) for r in partners(df, A, B).collect()} == {(p, n, n == most[p[1]]) for p, n in count.items()}
    assert alignment_report(df.limit(0), A, B).count() == 0


def test_full_alignment(spark):
    rows = [(i, t, 1, "clash") for i, t in enumerate(ODD + some_texts(40))]
    va, vb = Vocabulary(A), Vocabulary(B)
    for r in alignments(spark.createDataFrame(rows, SCHEMA), A, B).collect():
        text = rows[r.doc_id][1]
        size_a, size_b = va.size[r.a_ids], vb.size[r.b_ids]
        if not r.a_ids:
            assert not r.b_ids and not r.overlap_a and not r.end_a
            continue
        assert va.spread(__import__("numpy").array(r.a_ids)).tobytes() == (" " + text).encode()
        owner = [[k for k, n in enumerate(s) for _ in range(n)] for s in (size_a, size_b)]
        assert list(Counter(zip(*owner, strict=True)).items()) == [((i, j), n) for i, j, n in zip(r.overlap_a, r.overlap_b, r.overlap_bytes, strict=True)]
        ends = [{sum(s[: k + 1]): k for k in range(len(s))} for s in (size_a.tolist(), size_b.tolist())]
        assert list(zip(r.end_a, r.end_b, strict=True)) == [(ends[0][c], ends[1][c]) for c in sorted(set(ends[0]) & set(ends[1]))]


@pytest.mark.parametrize("path", [A, B])
def test_ids_are_the_librarys(path, monkeypatch):
    texts = [" " + t for t in ODD + some_texts(2000) if t]
    v = Vocabulary(path)
    if path == A:
        model = Tokenizer.from_file(A)
        model.encode_special_tokens = True
        want = [model.encode(t, add_special_tokens=False).ids for t in texts]
    else:
        want = SentencePieceProcessor(model_file=B).encode([t[1:] for t in texts])
    assert v.splits and v.encode(texts) == want
    monkeypatch.setattr(tokens, "CUT", 5)
    assert any(len(pieces(t)) > 3 for t in texts)
    for t, ids in zip(texts, want, strict=True):
        assert [i for x in v.encode(pieces(t)) for i in x] == ids


def test_long_text(spark):
    text = " ".join(some_texts(8000))
    want, _, _ = plain([(1, text)])
    assert len(text) > 10 * tokens.CUT
    assert list(map(tuple, alignment_report(spark.createDataFrame([(1, text)], "doc_id long, text string"), A, B).collect())) == want
