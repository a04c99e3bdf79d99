"""Open persona parameters: changes laid over each other name by name, against a fold in Python."""

import json
import random

from pyspark.sql import functions as F

from lorekeep.operators import personas


def _rows(df):
    return {r["id"]: None if r["p"] is None else json.loads(r["p"]) for r in df.select("id", F.to_json("params").alias("p")).collect()}


def test_catalogue(spark):
    rng, names = random.Random(3), ["k", "tone", "深", "a.b"]
    created = [(i, f"p{i}", "n", json.dumps({"k": i, "own": {"x": [i, None]}}) if i % 3 else None) for i in range(12)]
    created += [(90, None, "no id", "{}"), (91, "list", "not an object", "[1]"), (92, "broken", "", "{"), (93, "null", "", "null")]
    changes = []
    for seq in range(300):
        i = 0 if seq % 3 == 0 else rng.randrange(14)  # one persona is changed often, two are unknown
        some = {n: rng.choice([1, 2.5, "t", None, {"deep": seq}, True]) for n in rng.sample(names, rng.randrange(4))}
        changes.append((seq, f"p{i}", json.dumps(some)))
    changes += [(400, None, '{"k": 1}'), (401, "p5", None), (402, "list", '{"k": null}')]
    expected = {pid: json.loads(text) if text else None for _, pid, _, text in created if pid not in ("broken", "list")}
    expected |= {"broken": None, "list": None, "null": None}
    for _, pid, text in changes:
        if pid in expected and pid is not None and text and json.loads(text):
            expected[pid] = (expected[pid] or {}) | json.loads(text)
    df = spark.createDataFrame(created, "seq long, id string, name string, t string").withColumn("params", personas.parsed(F.col("t"))).drop("t")
    late = spark.createDataFrame(changes, "seq long, id string, t string").withColumn("params", personas.parsed(F.col("t")))
    gone = spark.createDataFrame([("p3",), ("p99",), (None,)], "id string")
    del expected["p3"]
    final = personas.catalogue(df, late.repartition(5), gone)
    assert _rows(final) == expected
    assert final.where("id = 'p1'").select(personas.open_value(F.col("params"), "own", "string").alias("o")).head().o == '{"x":[1,null]}'
    assert final.select(personas.open_value(F.col("params"), "none", "bigint").alias("o")).distinct().collect()[0].o is None
    assert personas.catalogue(df.limit(0), late, gone).count() == 0
    assert _rows(personas.catalogue(df, late.limit(0), gone.limit(0)))["p3"] is None
