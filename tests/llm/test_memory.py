"""What executors hold between the stages of a job."""

import re

from auditlake.llm import common, decontamination, exact_dedup


def loaded_stores(spark):
    stores = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.execution.streaming.state.StateStore$")
    held = next(f for f in stores.getDeclaredFields() if f.getName().endswith("loadedProviders"))
    held.setAccessible(True)
    return held.get(None).size()


def test_state_stores_are_closed_with_their_tasks(spark, tmp_path):
    path = str(tmp_path / "documents")
    spark.createDataFrame([(i, f"text {i % 30}") for i in range(40)], "doc_id bigint, text string").write.parquet(path)
    before = loaded_stores(spark)
    assert exact_dedup.exact_dedup(spark.read.parquet(path)).where("kept").count() == 30
    assert loaded_stores(spark) <= before


def test_no_stage_chains_python_steps(spark, monkeypatch):
    """Joins by broadcast don't end a stage, so what is written has one Python step at most."""
    plans = []

    def written(df, name):
        plans.append((name, len(re.findall("MapInArrow", df._jdf.queryExecution().optimizedPlan().toString()))))
        return common.written(df, name)

    monkeypatch.setattr(decontamination, "written", written)
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"before it {item} and after"), (2, "nothing of it"), (3, None)], "doc_id bigint, text string")
    found = decontamination.contaminated(docs, spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()
    assert [(r.doc_id, r.item_id, r.score) for r in found] == [(1, 7, 1.0)]
    assert len(plans) > 3 and max(n for _, n in plans) == 1


def test_a_worker_holds_one_model(monkeypatch):
    monkeypatch.setattr(common, "_resident", {})
    first = common.resident("a", lambda: ["a"])
    assert common.resident("a", lambda: ["again"]) is first
    assert common.resident("b", lambda: ["b"]) == ["b"] and list(common._resident) == ["b"]
    assert common.resident() is None and not common._resident
