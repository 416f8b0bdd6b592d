"""Token counts against the libraries' own encoding of whole texts."""

import random

import pytest

from sluice.llm import tokencounts as K

ALPHABET = ["a", "b", " ", "  ", "   ", "\n", "\r", "\t", "▁", "é", "日本", "😀", "\x00", "\x1c", " ", "</s>", "<|endoftext|>", "the ", " der", "x" * 40, "fi", "ﬁ", "'s", "12", "́", "　", "--", "();\r"]


def texts(seed, n, longest):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def whole(name, given):
    import public_tokenizers

    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return path, [len(model.encode(t or "")) for t in given]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return path, [len(model.encode(t or "", add_special_tokens=False).ids) for t in given]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_parts_of_texts_count_as_whole_texts(name):
    given = texts(1, 400, 120)
    path, expected = whole(name, given)
    for chunk in (3, 17, 64):
        assert K.count_texts(given, K.counter(path), chunk, 200) == expected


def test_counts(spark):
    given = [None, "", " ", "\n", "word " * 30_000, "a" * 40_000, "日" * 30_000, " " * 30_000, "a😀" * 20_000, "one two", "one two"]
    rows = [(i if i < 10 else 9, t, 5, "x") for i, t in enumerate(given)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int, n_bytes string").repartition(3)
    _, expected = whole("piece_bpe_32k.model", given)
    got = K.over_limit(K.count_tokens(docs)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((i if i < 10 else 9, len((t or "").encode()), n, n > 4096) for i, (t, n) in enumerate(zip(given, expected)))
    assert K.count_tokens(docs.limit(0)).count() == 0


def test_query_against_the_library(spark, sf_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    _, expected = whole("piece_bpe_32k.model", list(rows.values()))
    got = {r.doc_id: (r.n_tokens, r.over_limit) for r in K.op13_token_counts(spark, sf_dir).collect()}
    assert got == {i: (n, n > 4096) for i, n in zip(rows, expected)}
