"""Edge cases of the operators: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import io
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import archives, crf, decontam, langid, lattice, minhash, packing, rules, shards, suffixes

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
TEXTS = [None, "", "   \n\t", "One two", "the cat and the dog " * 30, "the cat and the dog " * 30, "été où ça " * 40, LONG, LONG + " tail", "$$$ ### ***"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, block bigint, key string, row string, n int, score double"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 2}", None if t is None else len(t), 1, "k", "r", 2, 0.5) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_decontaminate(spark, docs, none):
    bench = spark.createDataFrame([(1, "the cat and the dog the cat and the dog the"), (2, "One, TWO!"), (3, None), (4, ""), (5, "one two")], "item_id bigint, text string")
    found = by_id(decontam.matches(docs, bench))
    assert [found[i].n_hit for i in range(4)] == [0, 0, 0, 2] and found[3].item_ids == [2, 5]
    assert found[4].n_hit == found[4].n_words == 150 and found[4].item_ids == [1] and found[7].n_hit == 0
    assert decontam.matches(none, bench).count() == 0 and decontam.matches(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    kept = by_id(decontam.clean(docs, bench))
    assert set(kept) == set(range(10)) - {3, 4, 5} and kept[0].text is None and kept[7].text == LONG


def test_decontaminate_against_brute_force_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = list("abcdef")
    items = [(i, " ".join(rng.choice(words, n))) for i, n in enumerate((3, 12, 15, 2, 30, 10))]
    texts = [(i, " ".join(rng.choice(words, 400)) + " " + items[i % 6][1] + " zz " + items[(i + 1) % 6][1][4:]) for i in range(12)]
    expected = {}
    for d, t in texts:
        w, hit, met = t.split(), set(), set()
        for item, s in items:
            x = s.split()
            n = min(10, len(x))
            for k in range(len(x) - n + 1):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == x[k : k + n]:
                        hit.update(range(i, i + n))
                        met.add(item)
        expected[d] = (len(hit), sorted(met))
    docs, bench = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for chars in (1 << 21, 40):
        monkeypatch.setattr(decontam, "BLOCK_CHARS", chars)
        assert {r.doc_id: (r.n_hit, sorted(set(r.item_ids))) for r in decontam.matches(docs, bench).collect()} == expected


@pytest.mark.parametrize("version", [1, 2])
def test_archives(spark, tmp_path, version):
    html = [None, "", "<p>a\n\nfiledesc://x 1 2 3 4\n</p>", "<p>a\n\nfiledesc://x 1 2 3 4\n</p>", "é\r\n\r\nWARC/1.0\r\n" * 50]
    pages = spark.createDataFrame([(i, None if i == 2 else f"http://h/{i} b", h, 7) for i, h in enumerate(html)], "page_id bigint, url string, html string, record int").repartition(2)
    archives.write_arc(pages, f"{tmp_path}/arc", version)
    archives.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    got = {r.page_id: r for r in archives.read_warc(spark, f"{tmp_path}/warc").collect()}
    for i, h in enumerate(html):
        data = (h or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == archives.digest(data)
        assert got[i].payload is None if got[i].record_type == "revisit" else bytes(got[i].payload) == data
    assert [got[i].refers_to for i in range(5)] == [None, 0, None, 2, None]


def test_arc_lengths_are_held_to():
    line = b"http://a/ 1.2.3.4 20200102030405 text/html 500\nshort"
    with pytest.raises(ValueError, match="version block"):
        list(archives.parse_arc(io.BytesIO(line)))
    begin = b"filedesc://x 1.2.3.4 20200102030405 text/plain 9\n1 0 sluic\n"
    with pytest.raises(ValueError, match="beyond"):
        list(archives.parse_arc(io.BytesIO(begin + line)))


@pytest.mark.parametrize("size", [1, 200, 16 << 20])
def test_repeated_rows_have_one_response_each_and_ids_of_their_own(spark, tmp_path, size):
    rows = [(1, "http://a/", "x"), (1, "http://a/", "x"), (None, "http://a/", "x"), (None, None, "y"), (None, None, "y"), (5, "http://b/", None), (4, "http://b/", ""), (4, "http://c/", ""), (7, "http://d/", "z")]
    archives.write_arc(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2), f"{tmp_path}/arc", archive_bytes=size)
    archives.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc", archive_bytes=size)
    assert len(list((tmp_path / "warc").glob("*.gz"))) == len(rows) or size > 1
    got = archives.read_warc(spark, f"{tmp_path}/warc").collect()
    assert len(got) == len({r.record_id for r in got}) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.payload_digest, []).append(r)
    for copies in by.values():
        first, *others = sorted(copies, key=lambda r: r.record_type)
        assert first.record_type == "response" and all(r.record_type == "revisit" and r.refers_to_record == first.record_id and r.refers_to == first.page_id for r in others)
        assert first.page_id == min((r.page_id for r in copies if r.page_id is not None), default=None)
    assert sorted(map(len, by.values())) == [1, 2, 3, 3]
    archives.write_arc(spark.createDataFrame([], "page_id bigint, url string, html string"), f"{tmp_path}/none")
    archives.convert(spark, f"{tmp_path}/none", f"{tmp_path}/nothing")
    assert archives.read_warc(spark, f"{tmp_path}/nothing").count() == 0


def test_lattice_sums_all_segmentations(spark, docs, none):
    net = lattice.Lattice(["▁", "a", "b", "ab", "▁a", "ba"] + [f"<0x{b:02X}>" for b in range(256)])
    logs = np.log(np.full(net.n, 0.01) + np.arange(net.n) * 1e-4)

    def brute(s):
        if not s:
            return 1.0
        total = sum(math.exp(logs[net.number[s[:k]]]) * brute(s[k:]) for k in range(1, len(s) + 1) if s[:k] in net.number)
        return total + (0 if s[0] in net.number else math.exp(sum(logs[net.bytes[b]] for b in s[0].encode())) * brute(s[1:]))

    words = ["abab", "aébb", "", "bbb", "ba" * 5]
    assert np.allclose(np.exp(net.marginals(words, logs)), [brute("▁" + w) for w in words])
    found = by_id(lattice.score(docs, F.col("doc_id") < 5))
    assert found[0].score == found[1].score == found[2].score and found[0].n_tokens == 1 and found[7].n_tokens == 60_001
    assert all(r.score < 0 and math.isfinite(r.score) for r in found.values())
    assert lattice.score(none, F.lit(True)).count() == 0
    long = "xyzé" * 5_000
    assert np.allclose(net.marginals(["a", long], logs)[1], net.marginals([long], logs)[0])


def test_lattice_mixes_in_whole_words(spark):
    texts = ["the cat sat on the mat", "the dog sat", None, "A cat", "the zebra sat", "unseen 語 words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = by_id(lattice.score(docs, F.col("doc_id") < 4))
    seen = Counter(w for t in texts[:4] for w in (t or "").lower().split())
    total, once, twice = sum(seen.values()), *(sum(c == k for c in seen.values()) for k in (1, 2))
    discount = (once + 1) / (once + 2 * twice + 2)
    pieces = lattice.read_vocabulary(lattice.vocabulary_path())
    words = spark.createDataFrame([(w.encode(), c) for w, c in seen.items()], "word binary, c bigint")
    logs, net = lattice.train(words, pieces), lattice.Lattice(pieces)
    for i, text in enumerate(texts):
        p = 4 / (4 + total)
        for w in (text or "").lower().split():
            p *= total / (4 + total) * (max(seen[w] - discount, 0) / total + discount * len(seen) / total * math.exp(net.marginals([w], logs)[0]))
        assert math.isclose(found[i].score, math.log10(p), rel_tol=1e-9)
    untrained = by_id(lattice.score(docs, F.lit(False)))
    assert all(math.isfinite(r.score) and r.n_known == r.train_tokens == 0 for r in untrained.values())


def test_lattice_gains_from_training_on_held_out_texts(spark):
    docs, held_out = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    total = lambda training: lattice.score(docs, training).join(docs.where(held_out).select("doc_id"), "doc_id").agg(F.sum("score")).first()[0]
    assert total(~held_out) > 0.7 * total(F.lit(False))


def test_rules(docs, none):
    found = by_id(rules.apply_rules(docs))
    assert found[0].n_words == found[2].n_words == 0 and found[4].n_repeat_words == 150 and found[9].n_symbols == 9
    w = LONG.split()
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(3)}
    assert found[7].n_repeat_words == len(covered) and found[7].n_words == 60_000
    assert rules.apply_rules(none).count() == 0


def test_field(docs, none):
    texts = [f"some plain words here number {i} and more of them" for i in range(60)] + [f"you are a nasty{'ab'[i % 2]} person number {i} indeed" for i in range(40)]
    field = crf.fit(texts, [0] * 60 + [1] * 40, (0.6, 0.4))
    scores = [field.score(field.measure(field.marginals(crf._words(t)))) for t in texts]
    assert max(scores[:60]) < 0.5 < min(scores[60:])
    found = by_id(crf.tag(docs, field))
    assert found[0].score == found[1].score == found[9].score and all(0 <= r.score <= 1 for r in found.values())
    assert crf.tag(none, field).count() == 0 and {r.score for r in crf.tag(docs, None).collect()} == {0.0}
    step, words = np.exp(field.step), ["nastya", "person", "words"]
    weight = [field.potential(w) for w in words]
    paths = {}
    for y in np.ndindex(2, 2, 2):
        paths[y] = np.prod([weight[i] if y[i] else 1.0 for i in range(3)]) * step[y[0], y[1]] * step[y[1], y[2]]
    total = sum(paths.values())
    assert np.allclose(field.marginals(words), [sum(p for y, p in paths.items() if y[i]) / total for i in range(3)])


def test_offsets_are_those_of_the_text_itself(spark, none):
    texts = [f"some plain words here number {i} and more of them" for i in range(60)] + [f"you are a nasty{'ab'[i % 2]} person number {i} indeed" for i in range(40)]
    field = crf.fit(texts, [0] * 60 + [1] * 40, (0.6, 0.4))
    texts_in = ["İİ some plain words here number nastya", "ẞİ some plain words here number NASTYB!", "some plain words here"]
    rows = [(i, t) for i, t in enumerate(texts_in)] + [(0, texts_in[0])]
    found = [(r.doc_id, [texts_in[r.doc_id][a:b].split()[-1] for a, b in r.spans]) for r in crf.tag(spark.createDataFrame(rows, "doc_id bigint, text string"), field).collect()]
    assert sorted(found) == [(0, ["nastya"]), (0, ["nastya"]), (1, ["NASTYB"]), (2, [])]
    rows = [(i, t, int(i >= 60)) for i, t in enumerate(texts)] + [(200, "nastya " * 5000, 1), (201, "word " * 5000, 0)]
    labelled = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    small = crf.learn(labelled, sample_bytes=20_000, chunks=40)
    assert small is not None and crf.learn(labelled.where("toxic = 1")) is None and crf.learn(labelled.limit(0)) is None
    assert crf.tag(none.limit(0), small).count() == 0


def brute_repeats(texts, length=100):
    seen, out = set(), {}
    for d, t in texts:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if data[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(data[i : i + length])
        out[d] = (len(data), int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest())
    return out


def test_suffixes(spark, docs, none, monkeypatch):
    assert {(a - b) % suffixes.V for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.V))
    rng = np.random.default_rng(5)
    base = "".join(rng.choice(list("abcdé "), 3000))
    texts = [(i, base[a:b] + "".join(rng.choice(list("xyz"), 150)) + base[c : c + 99 + i % 3]) for i, (a, b, c) in enumerate(rng.integers(0, 2800, (24, 3)).tolist())]
    texts += [(30 + i, t) for i, t in enumerate(TEXTS[:7])] + [(40, "ab" * 400), (41, None)]
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 1 << 15)
    got = suffixes.repeats(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in got} == brute_repeats(texts)
    kept = by_id(suffixes.remove_repeats(docs))
    assert 0 in kept and kept[0].text is None and 5 not in kept and kept[3].text == "One two"
    assert suffixes.repeats(none).count() == 0


def test_shards(spark, docs, none):
    out = shards.shard_by_bytes(docs, 3).collect()
    assert len(out) == 10 and {r.doc_id: r.text_crc32 for r in out}[3] == zlib.crc32(b"One two")
    place = {r.doc_id: r.shard for r in out}
    assert place[4] == place[5] and place[0] == place[1]
    for s in set(place.values()):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(1 for r in out if r.shard == s)))
    assert shards.shard_by_bytes(none).count() == 0
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 4000, 300).tolist()
    rows = [(i, f"{i} " + "x" * n) for i, n in enumerate(sizes)]
    got = {r["shard"]: r["b"] for r in shards.shard_by_bytes(spark.createDataFrame(rows, "doc_id bigint, text string"), 7).groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    order = [len(t) + 1 for _, t in rows]

    def fits(c):
        n, now = 1, 0
        for v in order:
            n, now = (n, now + v) if now + v <= c else (n + 1, v)
        return n <= 7

    best = next(c for c in range(max(max(order), sum(order) // 7), sum(order)) if fits(c))
    assert max(got.values()) == best and len(got) <= 7


def test_packing(docs, none):
    from tokenizers import Tokenizer

    out = packing.pack(docs.union(docs), window=64).collect()
    encode = Tokenizer.from_file(packing.vocabulary_path()).encode
    for i, t in enumerate(TEXTS):
        ids = [*encode(t or "", add_special_tokens=False).ids, packing.END]
        pieces = [r for r in out if r.doc_id == i]
        assert sum(r.length for r in pieces) == 2 * len(ids) and {r.doc_tokens for r in pieces} == {len(ids)}
        assert all(zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in pieces)
    windows = {}
    for r in out:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for w, parts in windows.items():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 64 or w == max(windows)
    assert packing.pack(none).count() == 0


def test_served_counts_follow_shares_and_never_fall():
    totals = np.array([1, 5, 1000, 37, 2957])
    starts = np.arange(0, int(totals.sum()) + 1, 8)
    given = packing.served(starts, totals)
    assert (given.sum(1) == starts).all() and (np.diff(given, axis=0) >= 0).all()
    assert np.abs(given - starts[:, None] * totals / totals.sum()).max() < 3


def test_words_are_encoded_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    texts = ["It's I'LL don't 'S ' <|endoftext|> a<|startoftext|>b", "ΟΔΟΣ ὀδός", "İstanbul ÀÉ² ½x ªº ß ẞ", "a\x1cz\x85w\x0bq\x0cr", "日本語 🙂🙂 ŸÿŽ ǅ ſ K Å", "﻿x \xadsoft"]
    words, encode = packing.WordIds(packing.vocabulary_path()), Tokenizer.from_file(packing.vocabulary_path()).encode
    for t in texts:
        assert np.frombuffer(words.ids(t), "<u2").tolist() == [*encode(t, add_special_tokens=False).ids, packing.END]


def test_language(spark, docs, none):
    rng = np.random.default_rng(2)
    words = {"en": ["the", "thing", "with", "other", "sh"], "de": ["der", "schön", "nicht", "über", "ung"]}
    rows = [(i, " ".join(rng.choice(words[k], 60)), k) for i, k in enumerate(["en", "de"] * 40)]
    learned = langid.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert set(learned) == {"en", "de"}
    found = by_id(langid.identify(docs, learned))
    assert [found[i].lang_pred for i in (0, 1, 2, 9)] == ["und"] * 4 and all(0 <= r.score <= 1 for r in found.values())
    other = spark.createDataFrame([(i, " ".join(rng.choice(words[k], 80))) for i, k in enumerate(["en", "de"] * 10)], "doc_id bigint, text string")
    assert all(r.lang_pred == ["en", "de"][r.doc_id % 2] and not r.rejected for r in langid.identify(other, learned).collect())
    assert langid.identify(none, learned).count() == 0 and langid.learn(none) == {}
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}
    odd = spark.createDataFrame([(1, "½² Ⅷ ٣ ①"), (2, "\u0301\u0308 \u20dd"), (3, "_ 7 %"), (4, "ª")], "doc_id bigint, text string")
    assert [(r.lang_pred, r.score) for r in langid.identify(odd, learned).orderBy("doc_id").collect()][:3] == [("und", 0.0)] * 3
    assert by_id(langid.identify(odd, learned))[4].lang_pred in learned
    many = spark.range(300).selectExpr("id AS doc_id", "'words' AS text", "concat('l', id) AS lang")
    with pytest.raises(ValueError, match="languages"):
        langid.learn(many)


def test_language_is_that_of_the_smallest_code(spark):
    """Against a plain compressor for each language and text, without blocks, in which both coders are tried anew."""
    import zstandard

    rng = np.random.default_rng(8)
    syllables = {k: ["".join(rng.choice(list("abcdefghijklmnop"), 3)) for _ in range(40)] for k in ("aa", "bb", "cc")}
    prose = lambda k, n: " ".join("".join(rng.choice(syllables[k], int(rng.integers(1, 4)))) for _ in range(n))
    learned = {k: langid.letters(prose(k, 800)) for k in syllables}
    texts = [(i, prose(k, int(n))) for i, (k, n) in enumerate(zip(list(syllables) * 20, rng.integers(2, 150, 60)))]
    texts += [(100, prose("aa", 30) + " " + prose("bb", 30)), (101, "123 q"), (102, prose("cc", 5).upper())]

    def sizes(text, how):
        data = langid.letters(text).encode()
        out = []
        for d in learned.values():
            raw = zstandard.ZstdCompressionDict(d.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how_all = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, dict_size=len(d.encode()), source_size=langid.BLOCK, write_content_size=0, write_checksum=0, write_dict_id=0, **how)
            code = zstandard.ZstdCompressor(dict_data=raw, compression_params=how_all)
            out.append(sum(len(code.compress(data[i : i + langid.BLOCK])) for i in range(0, len(data), langid.BLOCK)))
        return out

    found = by_id(langid.identify(spark.createDataFrame(texts, "doc_id bigint, text string"), learned))
    for i, t in texts:
        own = sizes(t, langid.COARSE)
        if sorted(own)[1] - min(own) < langid.NEAR * min(own):
            own = sizes(t, langid.FINE)
        gap = sorted(own)[1] - min(own)
        assert found[i].lang_pred == list(learned)[own.index(min(own))], (t, own)
        assert found[i].rejected == (gap < max(langid.MARGIN_BYTES, langid.MARGIN * min(own))) and 0 < found[i].score <= 1


def test_near_duplicates(spark, docs, none):
    rng = np.random.default_rng(4)
    rows = []
    for f in range(4):
        base = [f"f{f}w{i}" for i in rng.integers(0, 400, 150)]
        for _ in range(12):
            w = list(base)
            for i in rng.integers(0, len(w), int(rng.integers(0, 9))):
                w[i] = f"n{rng.integers(1 << 30)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(100, None), (101, ""), (102, "Two words"), (103, "two WORDS"), (104, "two words more")]
    sets = {}
    for d, t in rows:
        w = (t or "").lower().split()
        sets[d] = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
    link = {d: d for d in sets}

    def root(x):
        while link[x] != x:
            x = link[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                link[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {d: (len(s), root(d)) for d, s in sets.items()}
    found = by_id(minhash.near_duplicates(docs))
    assert found[5].component_id == 4 and found[8].component_id == 7 and found[0].component_id == 0
    assert minhash.near_duplicates(none).count() == 0


def test_hot_buckets_and_repeated_ids_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in rng.integers(0, 4000, 200)]
    rows = []
    for i in range(120):
        w = list(base)
        for k in rng.integers(0, len(w), int(rng.integers(0, 6))):
            w[k] = f"n{rng.integers(1 << 30)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, f"other {i} " + " ".join(f"o{i}x{j}" for j in range(50))) for i in range(20)] + [(300, "w w w w"), (301, "W w w")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    cold = sorted(minhash.near_duplicates(docs).collect())
    monkeypatch.setattr(minhash, "_HOT", 2)
    monkeypatch.setattr(minhash, "partitions", lambda _: 1 << 40)
    assert sorted(minhash.near_duplicates(docs).collect()) == cold
    assert len({r.component_id for r in cold if r.doc_id < 120}) == 1 and all(r.component_id == r.doc_id for r in cold if 200 <= r.doc_id < 300)
    assert next(r.component_id for r in cold if r.doc_id == 301) == 300
    twice = sorted(minhash.near_duplicates(docs.union(docs.where("doc_id < 50"))).collect())
    assert len(twice) == len(cold) + 50 and sorted(set(twice)) == cold
