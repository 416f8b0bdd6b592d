"""Ids of texts by their distinct words, against the tokenizer itself."""

from types import SimpleNamespace

import numpy as np
import pytest
import tokenizers

from sluice.llm import packing

PATH = packing.vocabulary_path()


def plain(texts):
    encode = tokenizers.Tokenizer.from_file(PATH).encode
    return [[*encode(t, add_special_tokens=False).ids, packing.END] for t in texts]


def test_a_word_met_again_is_not_encoded_again(monkeypatch):
    """However many distinct words stand between: more than the memory holds."""
    calls = []
    real = tokenizers.Tokenizer.from_file(PATH)

    def tokenize(piece):
        calls.append(piece)
        return real.model.tokenize(piece)

    counting = SimpleNamespace(encode=real.encode, get_vocab_size=real.get_vocab_size, model=SimpleNamespace(tokenize=tokenize))
    monkeypatch.setattr(tokenizers, "Tokenizer", SimpleNamespace(from_file=lambda path: counting))
    monkeypatch.setattr(packing, "_MEMORY", 16)
    names = [f"w{chr(97 + i // 10)}{chr(97 + i % 10)}" for i in range(100)]
    text = " ".join(names * 5)
    got = packing.WordIds(PATH).ids(text)
    assert sorted(calls) == names
    monkeypatch.undo()
    assert [np.frombuffer(got, "<u2").tolist()] == plain([text])


def test_every_latin_character():
    texts = [f"{c} a{c}b {c}{c} B{c}'S'{c}9 x{c.upper()}ll{c}'ll{c}!!" for c in map(chr, range(1, 0x2B0))]
    words = packing.WordIds(PATH)
    assert [np.frombuffer(words.ids(t), "<u2").tolist() for t in texts] == plain(texts)


@pytest.mark.parametrize("together", [1, 300, 1 << 24])
def test_texts_encoded_together(spark, monkeypatch, together):
    monkeypatch.setattr(packing, "_TOGETHER", together)
    rng = np.random.default_rng(8)
    parts = ["the", "Thé", "don't", "o'er", "a,b", "x2", "½", "***!!", "​", "é", "ΑΣ", "日本語", "<|endoftext|>", "a<|b", "\x0b", "\x1c", "\xa0", "\n\n", "\r\t", "", " ", "İI"]
    texts = [None, "", " ", "\n", *("".join(p + " " * int(rng.integers(0, 3)) for p in rng.choice(parts, int(rng.integers(1, 40)))) for _ in range(60))]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string").coalesce(1)
    got = {r.doc_id: (r.tokens, np.frombuffer(r.ids, "<u2").tolist()) for r in packing.encode(docs, PATH).collect()}
    assert got == {i: (len(ids), ids) for i, ids in enumerate(plain([t or "" for t in texts]))}
