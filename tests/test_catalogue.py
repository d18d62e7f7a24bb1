import re

from lorekeep.plans import catalogue


def test_facts_and_quotes_are_every_sentence(spark, tmp_path):
    text = "I like tea. I also like long walks by the sea.\nMy sister lives in a small town near the northern border"
    rows = [(1, 0, "user", text), (1, 1, "assistant", "Noted. Fine."), (2, 0, "user", "One only")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = [x.strip() for r in rows if r[2] == "user" for x in re.split("[.\n]", r[3]) if x.strip()]
    facts = catalogue._lines_as_facts(spark, str(tmp_path)).orderBy("fact_ord").collect()
    assert [r.fact for r in facts] == [r.source_quote for r in facts] == want and len({r.fact_ord for r in facts}) == 4
    assert {r.fact for r in catalogue.dedup_deterministic(spark, str(tmp_path)).collect()} == set(want)
    checked = catalogue.verify_fuzzy(spark, str(tmp_path)).collect()
    assert len(checked) == 4 and {r.fact_ord for r in checked} == {r.fact_ord for r in facts}
