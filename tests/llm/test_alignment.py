"""Alignment of two vocabularies against a plain walk over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sluice.llm import alignment as L
from sluice.llm import bitmaps as B

ALPHABET = ["a", "b", " ", "  ", "   ", "\n", "\r", "\t", "é", "日本", "😀", "\x00", "\x1c", " ", "</s>", "<|endoftext|>", "the ", " der", "x" * 9, "ﬁ", "'s", "12", "́", "　", "--", "();\r", "<0x41>", "ing ", "Straße "]


def plain(rows):
    """What the contract says, in plain Python: {doc_id: columns} of rows (doc_id, text)."""
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = L.vocabulary_paths()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    letters = L.byte_letters()
    out, held, links_of = {}, defaultdict(int), {}
    for i, text in rows:
        want = (" " + (text or "")).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a.id_to_token(x)) for x in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids_b]
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            out[i], links_of[i] = (0, 0, 0, 0, ""), Counter()
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        groups, links = [], Counter()
        for lo, hi in zip([0, *(cuts := sorted(set(ends_a) & set(ends_b)))], cuts):
            own_a, own_b = ([x for x, e in zip(ids, ends) if lo < e <= hi] for ids, ends in ((ids_a, ends_a), (ids_b, ends_b)))
            groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
            links.update((x, y) for x in own_a for y in own_b)
        out[i] = (len(ids_a), len(ids_b), len(groups), sum(links.values()), hashlib.sha256(";".join(groups).encode()).hexdigest())
        links_of[i] = links
        for pair in links:
            held[pair] += 1
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    total = Counter()
    for links in links_of.values():
        total.update(links)
    documents = {i: (*out[i][:4], sum(n for p, n in links.items() if held[p] == top[p[0]]), sum(n * held[p] for p, n in links.items()), out[i][4]) for i, links in links_of.items()}
    return documents, {p: (n, total[p], n == top[p[0]]) for p, n in held.items()}


def compare(found, rows):
    documents, pairs = plain(rows)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found.documents.collect()}
    assert got == documents
    assert {(r.a, r.b): (r.n_docs, r.n_links, r.best) for r in found.pairs.collect()} == pairs


@pytest.mark.parametrize("flush", [1 << 24, 300])
def test_against_plain_walk(spark, monkeypatch, flush):
    rng = random.Random(5)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += [None, "", " ", "  ", "a▁b", "▁", "the the the the", "a" * 3000, "日" * 2000, "😀" * 500, " " * 999, "x y " * 4000] + texts[:20] + ["same text"] * 9
    monkeypatch.setattr(L, "_FLUSH", flush)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 1, "p", 2) for i, t in rows], "doc_id bigint, text string, row int, pair string, block int").repartition(3)
    compare(L.align_documents(docs), rows)


def test_groups_and_empty(spark):
    docs = spark.createDataFrame([(1, "ab cd"), (1, "ab cd"), (2, None)], "doc_id bigint, text string")
    found = L.align_documents(docs, with_groups=True).documents.collect()
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in found if r.doc_id == 1)
    assert [(r.n_links, r.groups_sha256, r.groups) for r in found if r.doc_id == 2] == [(0, "", "")]
    assert len(found) == 3 and len({r.count_sum for r in found if r.doc_id == 1}) == 1
    assert L.align_documents(docs.limit(0)).documents.count() == 0
    assert L.align_documents(docs.where("doc_id = 2")).documents.count() == 1


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    documents, _ = plain(rows)
    got = L.op11_pair_bitmaps(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got} == documents


def test_bitmaps():
    rng = np.random.default_rng(2)
    sizes = [0, 1, 4095, 4096, 65_536, 0, 17, 9000, 2, 0]
    rows = [(g, x) for g, n in enumerate(sizes) for x in sorted(rng.choice(B.SPAN, n, replace=False).tolist())]
    group, number = np.array(rows, np.int64).T
    packed = B.pack(group, number, len(sizes))
    for first, last in ((0, 10), (2, 9), (5, 6), (4, 5)):
        here = (group >= first) & (group < last)
        place, back = B.unpack(packed.slice(first, last - first))
        assert (place + first == group[here]).all() and (back == number[here]).all() and len(back) == here.sum()
    assert max(len(x.as_py()) for x in packed) <= B.SPAN // 8
    times = rng.integers(1, 1 << 40, len(group))
    planes = L.bit_planes(group, number, times, len(sizes)).to_pylist()
    total = np.zeros(len(sizes), object)
    for g, p in enumerate(planes):
        for k, bits in enumerate(p):
            place, _ = B.unpack(__import__("pyarrow").array([bits], "binary"))
            total[g] += len(place) << k
    assert [int(x) + n for x, n in zip(total, sizes)] == [int(times[group == g].sum()) for g in range(len(sizes))]


def test_merge_of_parts(spark):
    """Parts of one pair and block, dealt over many rows, some dense."""
    rng = np.random.default_rng(4)
    docs = rng.permutation(B.SPAN)[:9000]
    times = rng.integers(1, 9, 9000)
    rows = []
    for part in np.array_split(np.arange(9000), 7):
        order = np.sort(docs[part])
        own = dict(zip(docs.tolist(), times.tolist()))
        batch = L._postings(np.int64(77) << 16 | order, np.array([own[d] for d in order.tolist()]), 3)
        rows += batch.select(["pair", "block", "docs", "planes"]).to_pylist()
    got = L.merge(spark.createDataFrame(rows, "pair bigint, block bigint, docs binary, planes array<binary>")).collect()
    assert [(r.pair, r.block, r.n_docs, r.n_links) for r in got] == [(77, 3, 9000, int(times.sum()))]
