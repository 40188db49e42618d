"""Alert rules over logs that take several turns, against those of one turn; sizes of what is shuffled."""

import random

from pyspark.sql import functions as F

from loomstore.operators import metrics
from loomstore.plans.analysis import _BOUNDS, _RULE, _RULES, _log
from tests.conftest import rows


def test_turns_add_up(spark):
    """A series cut anywhere gives the same windows and runs as in one piece."""
    import pyarrow as pa

    rng = random.Random(3)
    names = sorted({m for r in _RULES for m in (r[2], r[3]) if m})
    steps = sorted((s, t, m, rng.randrange(len(_BOUNDS) + 1)) for s in ("7", "a", "b") for t in range(60) for m in names if rng.random() < 0.6)
    cols = list(zip(*[(s, m, t, b, rng.random() * 50, rng.random() * 50, rng.randint(1, 4), t * 60.0 - rng.random()) for s, t, m, b in steps]))
    types = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.float64())
    t = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], names=["series", "metric", "step", "bucket", "total", "top", "n", "last"])
    rules = [dict(zip(("rule", "kind", "metric", "part", "label", "above", "limit", "for_s"), r)) for r in _RULES]

    def run(batch, at_once):
        metrics.STEPS_AT_ONCE, before = at_once, metrics.STEPS_AT_ONCE
        try:
            got = metrics._alert_batches(rules, names, _BOUNDS, 240, 60)(iter([t.slice(i, batch) for i in range(0, t.num_rows, batch)]))
            return sorted((r["rule"], r["series"], r["at"], round(r["measure"], 9), r["alert"]) for b in got for r in b.to_pylist())
        finally:
            metrics.STEPS_AT_ONCE = before

    whole = run(10_000, 10_000)
    assert len({r for r, *_ in whole}) > 15 and {a for *_, a in whole} == {True, False}
    for batch, at_once in ((1, 1), (7, 7), (5, 40), (50, 100)):
        assert run(batch, at_once) == whole


def test_only_steps_are_shuffled(spark, sf):
    log = _log(spark, sf).select("ts", F.col("event_type").alias("metric"), F.col("user_id").cast("string").alias("label"), "value")
    out = metrics.alerts(log, spark.createDataFrame(list(_RULES), _RULE), _BOUNDS, 86400, 21600)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 2
    assert len(rows(out)) > 0
