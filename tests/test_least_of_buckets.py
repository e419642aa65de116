import numpy as np
import pyarrow as pa

from noticelake.operators import groups


def test_a_task_hands_on_one_row_for_each_bucket():
    rng = np.random.default_rng(1)
    h = rng.integers(-(1 << 60), 1 << 60, 30_000)
    h[20_000:] = h[:10_000]
    schema = pa.schema([pa.field("embedding", pa.list_(pa.float32())), pa.field("h", pa.int64(), False), pa.field("n", pa.int64(), False)])
    vector = [[float(x % 1000), 1.0] for x in h]
    whole = pa.RecordBatch.from_arrays([pa.array(vector, pa.list_(pa.float32())), pa.array(h), pa.array(np.ones(len(h), np.int64))], schema=schema)
    batches = [whole.slice(at, 7_000) for at in range(0, len(h), 7_000)] + [whole.slice(0, 0)]
    (made,) = groups._least_of_buckets(iter(batches))
    best, count = {}, {}
    for x, v in zip(h.tolist(), vector):
        b = x % groups.SAMPLE
        best[b], count[b] = min(best.get(b, (x, v)), (x, v)), count.get(b, 0) + 1
    got = {x % groups.SAMPLE: (x, v, n) for x, v, n in zip(*(made.column(c).to_pylist() for c in ("h", "embedding", "n")))}
    assert made.num_rows == len(best) and got == {b: (*best[b], count[b]) for b in best}
    assert list(groups._least_of_buckets(iter([]))) == []


def test_sampling_sorts_no_vectors(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 11), 1.0]) for i in range(500)], "p long, embedding array<float>").repartition(3)
    seen = []
    frame = type(rows)
    monkeypatch.setattr(frame, "orderBy", lambda self, *c: seen.append(self) or self.sort(*c))
    placed, rings = groups.group_points(rows, ["p"], 50)
    assert placed.count() == rings.size.sum() == 500
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    # What is sorted and aggregated has already been reduced in the tasks.
    assert "MapInArrow" in plan or "PythonMapInArrow" in plan
