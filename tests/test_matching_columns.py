"""Templates over long texts: no step for each character, and no text or slots where none are asked for."""

import time

from sluice.operators import matching as M
from sluice.plans import queries_text as Q


def test_a_long_text_costs_no_step_a_character():
    trie = M.Templates([(M.parse_template(t), i) for i, t, _ in Q.TEXT_TEMPLATES], Q.TEXT_LEXICON, [" "], {"num": M._FUNCTIONS["num"]})
    text = "The word 12.5% rest  the than . " * 20_000
    begun = time.process_time()
    assert sorted(trie.tables[place][1] for place, _ in trie.match(text, False)) == [1, 2, 3, 4]
    assert time.process_time() - begun < 2.5


def test_columns_that_are_asked_for(spark):
    queries = spark.createDataFrame([(1, "the hall")], "query_id int, query string")
    templates = [(5, "the[W:1-9]", "a")]
    assert M.match_templates(queries, templates, {}, [" "], ()).collect() == [(1, 5, "a")]
    assert M.match_templates(queries, templates, {}, [" "], ("slots",)).columns == ["query_id", "template_id", "attr", "slots"]
    assert [tuple(r) for r in M.match_templates(queries, templates, {}, [" "]).select("query", "slots.value").collect()] == [("the hall", ["hall"])]
