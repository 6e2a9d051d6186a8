import random
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkwarden.llm import token_count
from sparkwarden.llm.token_count import Counter, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n", "\n\n a", "a  b", " a", "a ", "it's 'S don't they'll'x", "x<|endoftext|> y", "<|endoftext|>", "a.\nB c\n d", "é, ñ. ß! 中文 字", "a  b​ c\x1c d\u0085 e", "1 2a a2, _x __ -a", "word, " * 3000, "y" * 3000, "a\t b\r\n c", "(a) [b] {c}, 'd'", "İ, ǆ. ʰ; \U0001f600 a"]


def plain(texts):
    t = Tokenizer.from_file(PATH)
    return [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]


def test_pieces_add_up(monkeypatch):
    rng = random.Random(1)
    parts = ["a", "Bc", " ", "  ", "\n", ".", ",", "'s", "'", "é", "1", "<|endoftext|>", " ", "$$", "|", "中", " ", "ll", "\t", "the"]
    texts = ODD + ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(3000)]
    counter = Counter(PATH)
    assert counter.count(texts) == plain(texts)
    monkeypatch.setattr(token_count, "CUT", 4)
    monkeypatch.setattr(token_count, "BATCH_BYTES", 50)
    assert len(Counter(PATH).pieces("word, " * 30)) > 10
    assert Counter(PATH).count(texts) == plain(texts)


def test_rows(spark):
    rows = [(i, t, 5) for i, t in enumerate(ODD)] + [(3, ODD[3], 5), (None, None, 5), (99, None, 5)]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH).collect()
    want = [(d, len((t or "").encode()), n, n > 512) for (d, t, _), n in zip(rows, plain([t or "" for _, t, _ in rows]), strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_files_take_texts_whole(name):
    c = Counter(public_tokenizers.path(name))
    assert not c.splits and c.count(["A b", "A b c"])[0] == c.encode(["A b"])[0]


def test_ranks_and_library_agree_on_all_pairs_of_characters():
    chars = [chr(i) for i in range(0x260)]
    texts = ["".join(f"a{x}{y}'{y}{x}1 {x} {y}" for y in chars) for x in chars]  # some go to the file's own library for what they hold
    texts += [f"{x}{y}{x}{x} {y}{y}" for x in chars[:0x250] for y in chars[:0x250:7]]
    counter = Counter(PATH)
    assert counter.ranks is not None and counter.count(texts) == plain(texts)


def test_special_strings_are_the_librarys():
    texts = ["a <|endoftext|>", "<|endoftext|>" * 3, "<|endoftext| >", "b <|endoftext|>" + " word" * 9000]
    assert Counter(PATH).count(texts) == plain(texts) and plain(texts)[1] == 3


def test_plain_texts_take_less_than_the_librarys_time():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 11))) for _ in range(300)) for _ in range(200)]
    model, counter, took = Tokenizer.from_file(PATH), Counter(PATH), []
    for count in (lambda: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)], lambda: counter.count(texts)):
        began = time.process_time()
        got = count()
        took.append(time.process_time() - began)
        assert got == plain(texts)
    assert took[1] < 0.75 * took[0], took
