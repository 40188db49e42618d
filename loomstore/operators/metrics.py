"""Aggregations over metric logs: rates, histograms, quantiles, ratios, alerts that must hold for a while.

A log is (ts, series, value); counters log increments, gauges values.  Windows are aligned to the epoch and named by
their end; times are without zone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliding(log: DataFrame, by: Sequence[str], sums: dict[str, Column], width_s: int = 300, step_s: int = 30, ts: str = "ts") -> DataFrame:
    """(at, *by, *sums): sums over the windows ending at ``at``, with end - width < ts <= end, that hold a row.

    Rows are summed per step first; only these sums, one a step and series, are added up to the windows they fall into.
    """
    step = (F.ceil(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6) / step_s) * step_s).cast("long")
    own = log.groupBy(step.alias("step"), *by).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    spread = own.withColumn("at", F.explode(F.sequence(F.col("step"), F.col("step") + (width_s - step_s), F.lit(step_s).cast("long"))))
    return spread.groupBy("at", *by).agg(*[F.sum(n).alias(n) for n in sums])


def rate(log: DataFrame, by: Sequence[str], width_s: int = 300, step_s: int = 30, amount: Column | None = None) -> DataFrame:
    """Per window and series the increase and the increase per second of a counter."""
    what = amount if amount is not None else F.lit(1)
    return sliding(log, by, {"increase": what}, width_s, step_s).withColumn("rate", F.col("increase") / F.lit(float(width_s)))


def ratio(log: DataFrame, part: Column, by: Sequence[str], width_s: int = 300, step_s: int = 30) -> DataFrame:
    """Per window the share of rows for which ``part`` holds; windows without rows have none."""
    s = sliding(log, by, {"n": F.lit(1), "part": F.coalesce(part, F.lit(False)).cast("long")}, width_s, step_s)
    return s.select("at", *by, "n", (F.col("part") / F.col("n")).alias("ratio"))


#: What a rule measures: see :func:`alerts`.
KINDS = ("rate", "ratio", "gauge", "gauge_ratio", "p95", "age")


def alerts(log: DataFrame, rules: DataFrame, bounds: Sequence[float], width_s: int = 300, step_s: int = 30) -> DataFrame:
    """(rule, series, at, measure, alert) of threshold rules over a log (ts, metric, label, value), all in one pass.

    ``rules`` has (rule, kind, metric, part, label, above, limit, for_s): per window of ``width_s`` ending at each step a
    ``rate`` is the sum of the metric's values a second, a ``ratio`` the share of ``part`` in the sum of both metrics, a
    ``gauge`` the largest value, a ``gauge_ratio`` the largest value over the largest of ``part``, ``p95`` the quantile of
    the metric's values by ``bounds``, and ``age`` the seconds from the last value to the window's end.  ``label``, where
    not null, keeps one label's rows; else every label is a series (``label`` of the log; null as '').  An alert holds
    where the measure has been above ``limit`` (``above``; else below it) at every step since ``for_s`` seconds.  A window
    without rows has no measure and breaks a run.  Rules are a small table and are collected.

    Rows are summed per step in the map tasks; a series' steps then meet sorted in one task, which goes through them once
    with all rules (:func:`_alert_batches`).  Neither windows nor measures are shuffled.
    """
    own = [r.asDict() for r in rules.select("rule", "kind", "metric", "part", "label", "above", "limit", "for_s").collect()]
    used = sorted({m for r in own for m in (r["metric"], r["part"]) if m is not None})
    step = (F.ceil(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6) / step_s)).cast("long")
    les = F.array(*[F.lit(float(b)) for b in bounds])
    rows = log.where(F.col("value").isNotNull() & F.col("ts").isNotNull() & F.col("metric").isin(used)).select(
        F.coalesce("label", F.lit("")).alias("series"), "metric", F.col("value").cast("double").alias("value"), step.alias("step"), F.size(F.filter(les, lambda b: b < F.col("value"))).alias("bucket"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("sec"),
    )
    steps = rows.groupBy("series", "metric", "step", "bucket").agg(F.sum("value").alias("total"), F.max("value").alias("top"), F.count(F.lit(1)).alias("n"), F.max("sec").alias("last"))
    return steps.repartition("series").sortWithinPartitions("series", "step").mapInArrow(_alert_batches(own, used, [float(b) for b in bounds], width_s, step_s), "rule string, series string, at long, measure double, alert boolean")


#: Rows of steps that one turn of :func:`_alert_batches` takes.
STEPS_AT_ONCE = 100_000


def _alert_batches(rules: list[dict], metrics: list[str], bounds: list[float], width_s: int, step_s: int):
    """Steps (series, metric, step, bucket, total, top, n, last) sorted by series and step to the rows of :func:`alerts`.

    A turn takes a bounded number of steps, be it of many series or of a part of one; of a series that goes on, the steps
    that later windows need and the state of each rule are kept for the next turn.
    """
    spread = max((width_s - step_s) // step_s + 1, 1)
    les = np.array(bounds, dtype=float)

    def p95(h: np.ndarray) -> np.ndarray:
        run = np.cumsum(h, axis=1)
        rank = 0.95 * run[:, -1]
        k = (run < rank[:, None]).sum(axis=1)
        i = np.arange(len(h))
        base = np.where(k > 0, run[i, np.maximum(k - 1, 0)], 0)
        edges = np.concatenate([[0.0], les])
        low = edges[k]
        high = np.concatenate([les, [np.nan]])[k]
        inside = low + (high - low) * (rank - base) / (run[i, k] - base)
        return np.where(k < len(les), inside, low)

    def turn(t: pa.Table, since: int | None, until: int | None, state: list) -> Iterator[pa.RecordBatch]:
        """Windows of ``t``: of its first series those from ``since`` on, of its last those before ``until``."""
        names = t.column("series").combine_chunks().dictionary_encode()
        sid, names = names.indices.to_numpy(), names.dictionary
        metric = pa.compute.index_in(t.column("metric"), pa.array(metrics)).to_numpy()
        step, bucket, total, top, n, last = (t.column(c).to_numpy() for c in ("step", "bucket", "total", "top", "n", "last"))
        row = np.tile(np.arange(len(step)), spread)
        at = step[row] + np.repeat(np.arange(spread), len(step))
        keep = np.ones(len(row), dtype=bool)
        if since is not None:
            keep &= (sid[row] > 0) | (at >= since)
        if until is not None:
            keep &= (sid[row] < len(names) - 1) | (at < until)
        row, at = row[keep], at[keep]
        first, span = (int(at.min()), int(at.max() - at.min()) + 1) if len(at) else (0, 1)
        point = sid[row].astype(np.int64) * span + (at - first)
        order = np.argsort(point, kind="stable")
        row, point = row[order], point[order]
        points, place = np.unique(point, return_inverse=True)
        p_sid, p_at = points // span, points % span + first
        cells = {}
        for m in range(len(metrics)):
            mine = np.flatnonzero(metric[row] == m)
            where, cut = np.unique(place[mine], return_index=True)
            r = row[mine]
            if len(where):
                h = np.bincount(np.searchsorted(where, place[mine]) * (len(les) + 1) + bucket[r], weights=n[r], minlength=len(where) * (len(les) + 1)).reshape(len(where), -1)
                cells[metrics[m]] = where, np.add.reduceat(total[r], cut), np.maximum.reduceat(top[r], cut), np.maximum.reduceat(last[r], cut), h
        none = np.empty(0, np.int64), np.empty(0), np.empty(0), np.empty(0), np.empty((0, len(les) + 1))

        def full(c: tuple, i: int, where: np.ndarray, missing: float) -> np.ndarray:
            out = np.full(len(points), missing)
            out[c[0]] = c[i]
            return out[where]

        tail = len(names) - 1
        for i, rule in enumerate(rules):
            main, part, kind = cells.get(rule["metric"], none), cells.get(rule["part"], none), rule["kind"]
            where = main[0]
            with np.errstate(divide="ignore", invalid="ignore"):
                if kind == "rate":
                    measure = main[1] / float(width_s)
                elif kind == "ratio":
                    where = np.union1d(main[0], part[0])
                    x = full(part, 1, where, 0.0)
                    whole = full(main, 1, where, 0.0) + x
                    where, measure = where[whole != 0], x[whole != 0] / whole[whole != 0]
                elif kind == "gauge":
                    measure = main[2]
                elif kind == "gauge_ratio":
                    where, a, b = np.intersect1d(main[0], part[0], assume_unique=True, return_indices=True)
                    x, y = main[2][a], part[2][b]
                    where, measure = where[y != 0], x[y != 0] / y[y != 0]
                elif kind == "p95":
                    measure = p95(main[4])
                elif kind == "age":
                    measure = p_at[where] * step_s - main[3]
                else:
                    continue
            if rule["label"] is not None:
                mine = np.array([x == rule["label"] for x in names.to_pylist()])[p_sid[where]]
                where, measure = where[mine], measure[mine]
            held, state[i] = state[i], state[i] if until is not None and since is not None and tail == 0 else None
            if not len(where):
                continue
            s, at = p_sid[where], p_at[where]
            firing = ~(measure <= rule["limit"]) if rule["above"] else measure < rule["limit"]  # NaN is above all
            on = np.zeros(len(at), dtype=bool)
            on[1:] = (s[1:] == s[:-1]) & (at[1:] == at[:-1] + 1) & firing[:-1]
            begun = at.copy()
            if held and since is not None and s[0] == 0 and at[0] == held[0] + 1 and held[1]:
                begun[0] = held[2]
            begun = begun[np.maximum.accumulate(np.where(on & firing, 0, np.arange(len(at))))]
            if until is not None and s[-1] == tail:
                state[i] = int(at[-1]), bool(firing[-1]), int(begun[-1])
            alert = firing & ((at - begun) * step_s >= rule["for_s"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([rule["rule"]], pa.string()).take(pa.array(np.zeros(len(at), np.int32))), names.take(pa.array(s)), pa.array(at * step_s), pa.array(measure), pa.array(alert)], names=["rule", "series", "at", "measure", "alert"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, since, state = [], None, [None] * len(rules)
        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < STEPS_AT_ONCE:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            series = t.column("series").combine_chunks().dictionary_encode().indices.to_numpy()
            step = t.column("step").to_numpy()
            new = np.flatnonzero((series[1:] != series[:-1]) | (step[1:] != step[:-1]))
            if not len(new):
                continue
            c = int(new[-1]) + 1
            goes_on = series[c] == series[c - 1]
            until = int(step[c]) if goes_on else None
            yield from turn(t.slice(0, c), since, until, state)
            rest = t.slice(c)
            if goes_on:
                needed = np.flatnonzero((series[:c] == series[c]) & (step[:c] + spread - 1 >= until))
                if len(needed):
                    rest = t.slice(int(needed[0]))
            held, since, size = rest.to_batches(), until, t.num_rows - c
        if held:
            yield from turn(pa.Table.from_batches(held).combine_chunks(), since, None, state)

    return run


def histogram(log: DataFrame, bounds: Sequence[float], by: Sequence[str], value: str = "value") -> DataFrame:
    """Cumulative counts (le, n) per series; the last ``le`` is infinite.  One pass: each row adds to its own bucket first."""
    les = F.array(*[F.lit(float(b)) for b in bounds], F.lit(float("inf")))
    own = F.size(F.filter(les, lambda b: b < F.col(value)))
    counts = log.where(F.col(value).isNotNull()).groupBy(*by, own.alias("bucket")).agg(F.count(F.lit(1)).alias("c"))
    every = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "c"))).alias("m")).select(*by, "m", F.posexplode(les).alias("i", "le"))
    return every.select(*by, "le", F.aggregate(F.sequence(F.lit(0), F.col("i")), F.lit(0).cast("long"), lambda s, i: s + F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("n"))


def histogram_quantile(hist: DataFrame, q: float, by: Sequence[str]) -> DataFrame:
    """The quantile of cumulative histograms by linear interpolation inside its bucket; the last finite bound beyond it."""
    a = hist.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("le", "n"))).alias("h"))
    rank = F.lit(q) * F.element_at("h", -1)["n"]
    at = F.size(F.filter("h", lambda x: x["n"] < rank)) + 1
    hit, before = F.get("h", F.col("at") - 1), F.get("h", F.col("at") - 2)
    low, base = F.when(F.col("at") > 1, before["le"]).otherwise(0.0), F.when(F.col("at") > 1, before["n"]).otherwise(0)
    inside = low + (hit["le"] - low) * F.try_divide(rank - base, hit["n"] - base)
    return a.withColumn("at", at).select(*by, F.when(F.isnan(hit["le"] * 0), low).otherwise(inside).alias("quantile"))


def holds(states: DataFrame, by: Sequence[str], for_s: int | Column, step_s: int = 30) -> DataFrame:
    """``states`` (at, firing, ...) with ``alert``: firing at every step since ``for_s`` seconds or longer.

    Steps that follow each other in the log without a gap in time count as one run.  A series has a row per step, so
    its length is bounded by the time covered, not by the rows logged.
    """
    w = Window.partitionBy(*by).orderBy("at") if by else Window.partitionBy(F.lit(1)).orderBy("at")
    broken = ~F.col("firing") | (F.coalesce(F.col("at") - F.lag("at").over(w), F.lit(step_s)) > step_s)
    runs = states.withColumn("run", F.sum(broken.cast("int")).over(w))
    starts = Window.partitionBy(*by, "run") if by else Window.partitionBy("run")
    since = F.min(F.when(F.col("firing"), F.col("at"))).over(starts)
    return runs.withColumn("alert", F.col("firing") & (F.col("at") - since >= for_s)).drop("run")


def active_age(log: DataFrame, state: Column, by: Sequence[str], now: Column) -> DataFrame:
    """Per series the seconds since the last row for which ``state`` holds."""
    return log.where(state).groupBy(*by).agg(F.max("ts").alias("last")).select(*by, (F.unix_micros(now.cast("timestamp")) / 1e6 - F.unix_micros(F.col("last").cast("timestamp")) / 1e6).alias("age_s"))


def nearest_rank(log: DataFrame, by: Sequence[str], quantiles: Sequence[float], value: str = "value", pieces: int = 64) -> DataFrame:
    """Exact percentiles as the element number int(n * q) of the sorted values, and the median.

    Values are counted first.  Each series is then cut at approximate quantiles into pieces that are ranked apart, so
    that no task sorts a whole series; a piece's first rank is the sum of the pieces before it.
    """
    counts = log.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    cuts = log.where(F.col(value).isNotNull()).groupBy(*by).agg(F.percentile_approx(value, [i / pieces for i in range(1, pieces)], 1000).alias("cuts"), F.count(F.lit(1)).alias("n"))
    placed = counts.join(cuts, list(by)).withColumn("piece", F.size(F.filter("cuts", lambda x: x < F.col(value)))).drop("cuts")
    sums = placed.groupBy(*by, "piece").agg(F.sum("c").alias("own"))
    before = sums.withColumn("first", F.sum("own").over(Window.partitionBy(*by).orderBy("piece")) - F.col("own")).drop("own")
    w = Window.partitionBy(*by, "piece").orderBy(value)
    ranked = placed.join(before, [*by, "piece"]).withColumn("to", F.col("first") + F.sum("c").over(w)).withColumn("from", F.col("to") - F.col("c"))

    def at(i: Column) -> Column:
        return F.max(F.when((F.col("from") <= i) & (i < F.col("to")), F.col(value)))

    n = F.col("n")
    picks = [at(F.floor(n * F.lit(q))).alias(f"p{int(q * 100)}") for q in quantiles]
    return ranked.groupBy(*by).agg(((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("median"), *picks)


def growth(snapshots: DataFrame) -> DataFrame:
    """(namespace, at, per_hour) from counts (namespace, at, n): change per hour to the snapshot before; 0 once it vanished.

    The first snapshot of all gives no rows.  A namespace that a later snapshot lacks has 0 there, once per snapshot
    that follows one with it.
    """
    steps = snapshots.select("at").distinct().withColumn("before", F.lag("at").over(Window.partitionBy(F.lit(1)).orderBy("at"))).where(F.col("before").isNotNull())
    now = snapshots.select("namespace", "at", "n").withColumn("here", F.lit(True))
    was = snapshots.join(F.broadcast(steps.select(F.col("at").alias("next"), F.col("before").alias("at"))), "at").select("namespace", F.col("next").alias("at"), F.col("n").alias("was"))
    j = now.join(was, ["namespace", "at"], "full").join(F.broadcast(steps), "at")
    hours = (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))) / F.lit(3.6e9)
    return j.select("namespace", "at", F.when(F.col("here").isNull(), 0.0).otherwise(F.round((F.col("n") - F.coalesce("was", F.lit(0))) / hours, 2)).alias("per_hour"))


def hit_ratio(log: DataFrame, hit: Column, by: Sequence[str] = ()) -> DataFrame:
    """hits / (hits + misses), 0 where there is neither."""
    n = F.count(F.lit(1))
    return log.groupBy(*by).agg(F.when(n > 0, F.round(F.count_if(hit) / n, 6)).otherwise(0.0).alias("hit_ratio"))
