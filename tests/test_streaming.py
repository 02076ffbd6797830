import pandas as pd

from samplewright.operators import gates
from samplewright.streaming import stages


def test_gate_and_windows_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame(pd.DataFrame({"category": ["a", "a", "b"], "semantic_match": [0.99, 0.1, 0.99], "decided_at": pd.to_datetime(["2026-01-01 00:01", "2026-01-01 00:02", "2026-01-01 00:15"])}))
    rows.write.parquet(str(tmp_path / "in"))
    policy = gates.Policy(0.5, 0.0, True, (gates.Gate("semantic_match", 0.9),))
    stream = stages.decide_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), policy)
    query = stages.acceptance_windows(stream).writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r["category"], r["n"], r["accepted"], r["rejected"]) for r in spark.table("windows").collect()}
    assert got == {("a", 2, 1, 1), ("b", 1, 1, 0)}


def test_rate_budget(spark, tmp_path):
    rows = spark.createDataFrame(pd.DataFrame({"request_id": list("abc"), "backend_id": "x", "requested_at": pd.to_datetime(["2026-01-01"] * 3)}))
    rows.write.parquet(str(tmp_path / "in"))
    stream = stages.rate_budget(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 2, 10.0)
    query = stream.writeStream.outputMode("append").format("memory").queryName("starts").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = [r["start_at"].second for r in spark.table("starts").orderBy("start_at").collect()]
    assert got == [0, 0, 10]
