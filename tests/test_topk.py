"""Per-group top k by counted values against plain sorting."""

import hashlib
import random

import pytest

from textmine.operators import features as ft


def table(seed):
    rng = random.Random(seed)
    rows = []
    for g, n in (("a", 400), ("b", 37), ("c", 3), ("d", 90)):
        for i in range(n):
            v = rng.choice([rng.uniform(0, 50), float(rng.randint(0, 6)), -rng.uniform(0, 2), 0.0, 1e-9, 1e12]) if g != "d" else 2.5
            rows.append((g, f"f{i}", v))
    return rows


def want(rows, k, ties, short_class="keep"):
    out = set()
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        if len(own) < k:
            if short_class == "keep":
                out |= set(own)
            continue
        if ties == "min":
            kth = sorted((round(v, 6) for _, _, v in own), reverse=True)[k - 1]
            out |= {r for r in own if round(r[2], 6) >= kth}
        else:
            out |= set(sorted(own, key=lambda r: (-round(r[2], 6), hashlib.md5(f"{r[1]}:1".encode()).hexdigest()))[:k])
    return out


@pytest.mark.parametrize("k", [1, 5, 37, 60, 500])
@pytest.mark.parametrize("ties", ["min", "random"])
def test_top_k_equals_sorting(spark, k, ties):
    rows = table(k)
    df = spark.createDataFrame(rows, "label string, feature string, frequency double")
    assert {tuple(r) for r in ft.top_k(df, ["label"], k, ties=ties).collect()} == want(rows, k, ties)


def test_short_classes_are_kept_or_dropped(spark):
    rows = table(2)
    df = spark.createDataFrame(rows, "label string, feature string, frequency double")
    for short in ("keep", "drop"):
        got = {r.feature for r in ft.dictionary_builder(df, k=50, short_class=short).collect()}
        assert got == {f for _, f, _ in want(rows, 50, "min", short)}
    with pytest.raises(ValueError):
        ft.dictionary_builder(df, short_class="other")


def test_no_task_receives_a_class(spark):
    df = spark.createDataFrame(table(3), "label string, feature string, frequency double")
    plan = ft.top_k(df, ["label"], 10)._jdf.queryExecution().optimizedPlan().toString()
    # The windows run over counted bins and values, never over the features.
    for line in plan.splitlines():
        if "Window " in line:
            assert "_upto" in line
    assert ft.top_k(df.limit(0), ["label"], 10).count() == 0
