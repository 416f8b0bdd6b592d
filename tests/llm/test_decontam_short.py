"""Items of fewer words than a window, quoted in long texts."""

from sluice.llm import decontam


def test_whole_short_items_are_cut_out_of_long_texts(spark):
    nine, three, long = "what is the capital of the smallest german state", "Red, green: BLUE", " ".join(f"q{i}" for i in range(14))
    filler = " ".join(f"w{i}" for i in range(150))
    texts = {
        1: f"{filler} {nine} {filler}",
        2: f"{filler} red green blue. {filler}",
        3: f"{filler} {' '.join(nine.split()[:8])} {filler}",  # not the whole item
        4: f"{filler} {nine} {long} {filler}",  # two runs that meet
        5: f"{filler} red green blue {filler} {' '.join(long.split()[2:13])} {filler}",
        6: nine,
    }
    bench = spark.createDataFrame([(1, nine), (2, three), (3, long)], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in texts.items()], "doc_id bigint, text string, n_chars bigint")
    kept = {r.doc_id: r for r in decontam.clean(docs, bench).collect()}
    two = [*filler.split(), *filler.split()]
    assert {i: r.text.split() for i, r in kept.items() if i not in (2, 3, 5)} == {1: two, 4: two}
    assert kept[3].text == texts[3] and kept[2].text.replace(". ", "").split() == two
    assert kept[5].text.split() == two + filler.split() and all(r.n_chars == len(r.text) for r in kept.values())
    assert decontam.matches(spark.createDataFrame(list(kept.values())), bench).where("n_hit > 0").count() == 0


def test_longer_min_run_spares_parts_but_not_whole_short_items(spark):
    item, short = " ".join(f"q{i}" for i in range(30)), "one two three"
    filler = " ".join(f"w{i}" for i in range(100))
    text = f"{filler} {' '.join(item.split()[:12])} {filler} {short} {filler}"
    bench = spark.createDataFrame([(1, item), (2, short)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert decontam.clean(docs, bench, min_run=20).first().text.split() == text.replace(short, "").split()
