"""Tree summaries: only what changed goes to the model."""

from pyspark.sql import functions as F

from weftline.operators import summaries
from weftline.plans.engine import Engine


def counting(seen):
    def model(parts):
        seen.append({r.hash: r.content for r in parts.collect()})
        return summaries.rule_summaries(parts)

    return model


def test_tree_and_kept_parts(spark):
    """Long lists shrink below the limit; one more description makes its own group anew and the levels above, no other group."""
    schema = "entity string, descriptions array<string>"
    lists = {"A": sorted(f"the thing number {k} stands somewhere near the old harbour" for k in range(120)), "B": ["short"], "C": ["word " * 600]}
    seen, none = [], spark.createDataFrame([], "hash string, summary string")
    found, parts = summaries.summarised(spark.createDataFrame(list(lists.items()), schema), none, counting(seen), 100, 200)
    got = {r.entity: r.summary for r in found.collect()}
    assert set(got) == {"A", "C"} and all(0 < len(t.split()) < 100 for t in got.values())
    first = {h: c for level in seen for h, c in level.items()}
    covered = sorted(d for c in seen[0].values() for d in c.split("<SEP>") if d.startswith("the thing"))
    assert covered == lists["A"] and all(len(c.split()) <= 260 or "word" in c for c in first.values())
    again = []
    summaries.summarised(spark.createDataFrame(list(lists.items()), schema), parts, counting(again), 100, 200)
    assert not any(again)
    lists["A"] = sorted([*lists["A"], "the thing number 555 stands elsewhere"])
    more = []
    summaries.summarised(spark.createDataFrame(list(lists.items()), schema), parts, counting(more), 100, 200)
    assert 1 <= len(more[0]) <= 2 and not set(more[0]) & set(first) and sum(map(len, more)) < len(first) / 2


def test_engine_summarises_what_changed(spark, tmp_path):
    seen = []
    engine = Engine(spark, str(tmp_path / "w"), summariser=counting(seen), summary_limit=8)
    engine.insert(spark.createDataFrame([("The lighthouse keeper watches. A lighthouse stands there alone. My lighthouse shines at night.",)], "content string"))
    calls = sum(map(len, seen))
    assert calls
    seen.clear()
    engine.insert(spark.createDataFrame([("Strawberries ripen. That lighthouse was painted white.",)], "content string"))
    assert 0 < sum(map(len, seen)) and engine.table("summaries").where(F.col("entity") == '"LIGHTHOUSE"').count() == 1
    held = {r.entity: r.description for r in engine.described().collect()}
    summary = engine.table("summaries").where(F.col("entity") == '"LIGHTHOUSE"').first().summary
    assert held['"LIGHTHOUSE"'] == summary and held['"STRAWBERRIES"'] == '"Strawberries ripen."'
