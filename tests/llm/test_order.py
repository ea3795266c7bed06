"""Curriculum and packing, and the pipeline that ends in them."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from colpattern.llm import curriculum, packing


# ------------------------------------------------ curriculum
def test_inverse_of_the_integral(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    grid = (0.0, 0.3, 0.7, 1.0)
    rows = []
    for _ in range(200):
        w = rng.random(4) * (rng.random(4) > 0.2)
        cum = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(grid))])
        t = rng.random()
        at = np.interp(np.linspace(0, t, 20_001), grid, w)
        rows.append((float(t), float(np.trapezoid(at, dx=t / 20_000)), w.tolist(), cum.tolist()))
    df = spark.createDataFrame(rows, "t double, area double, w array<double>, cum array<double>")
    for r in df.withColumn("got", curriculum.inverse(F.col("area"), grid, F.col("w"), F.col("cum"))).collect():
        lo, hi = np.interp([min(r["t"], r["got"]), max(r["t"], r["got"])], grid, r["w"])
        assert abs(r["t"] - r["got"]) < 1e-3 or max(lo, hi) < 1e-2 or 0 in r["w"]


def test_weights_are_met_over_time(docs):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 30), "en", "abc"[i % 3 if i % 7 else 0]) for i in range(3000)]
    plans = {"a": [0.8, 0.5, 0.1], "b": [0.1, 0.3, 0.5], "c": [0.1, 0.2, 0.4]}
    got = curriculum.schedule(docs(rows), schedules=plans, slice_rows=100).collect()
    assert {r["doc_id"] for r in got} == {i for i, _, _, _ in rows}  # none is cut
    total = sum(r["n_tokens"] for r in got)
    for lo in np.arange(0, 1, 0.1):
        part = [r for r in got if lo <= r["position"] < lo + 0.1]
        for s, w in plans.items():
            have = sum(r["n_tokens"] for r in part if r["source"] == s) / sum(r["n_tokens"] for r in part)
            assert have == pytest.approx(np.interp(lo + 0.05, curriculum.GRID, w), abs=0.04)
    epochs = Counter(r["epoch"] for r in got)
    assert epochs[0] == 3000 and total > sum(len(t.split()) for _, t, _, _ in rows)


def test_slices_do_not_matter(docs):
    rows = [(i, "w " * (i % 9), "en", f"s{i % 2}") for i in range(400)]
    one, two = ({(r["doc_id"], r["epoch"], r["position"]) for r in curriculum.schedule(docs(rows), slice_rows=n).collect()} for n in (10, 10_000))
    assert one == two


def test_rows_come_in_training_order(spark, docs, tmp_path):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randrange(9), "en", "aab"[i % 3]) for i in range(600)] + [(600, "w " * 2_000_000, "en", "b")]  # positions closer than they are rounded
    df = docs(rows)
    own = df.selectExpr("doc_id", "source", "size(split(text, 'w')) - 1 AS n_tokens")
    want = [(r["doc_id"], r["_epoch"]) for r in sorted(curriculum.place(own, "source", own["n_tokens"]).collect(), key=lambda r: (r["_t"], r["doc_id"], r["_epoch"]))]
    curriculum.schedule(df).write.parquet(str(tmp_path / "order"))
    files = [spark.read.parquet(str(f)).collect() for f in sorted((tmp_path / "order").glob("part-*"))]
    got = [r for f in files for r in f]
    assert [(r["doc_id"], r["epoch"]) for r in got] == want and len(files) > 1
    assert len({r["position"] for r in got if r["n_tokens"]}) < sum(r["n_tokens"] > 0 for r in got)


def test_a_given_budget_cuts_and_repeats(docs):
    rows = [(i, "w w", "en", "a" if i < 10 else "b") for i in range(100)]
    got = curriculum.schedule(docs(rows), schedules={"a": [1, 1, 1], "b": [1, 1, 1]}, total_tokens=100).collect()
    n = Counter(r["source"] for r in got)
    assert n == {"a": 25, "b": 25} and max(r["epoch"] for r in got if r["source"] == "a") == 2


def test_curriculum_odd_cases(docs, odd):
    df = docs(odd)
    got = curriculum.schedule(df).where("epoch = 0")
    assert got.count() == len(odd) and got.where("position is null or position < 0 or position > 1").count() == 0
    out = curriculum.in_order(df)
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == {r[0] for r in odd}
    assert curriculum.schedule(docs([])).count() == 0 and curriculum.in_order(docs([])).count() == 0
    assert curriculum.schedule(docs([(1, None), (2, "")])).count() == 2
    with pytest.raises(ValueError):
        curriculum.schedule(df, schedules={"a": [1]})


# ------------------------------------------------ packing
def test_patterns():
    got = packing.patterns(6, 3)
    assert sorted(got) == sorted({tuple(sorted((a, b, c), reverse=True)) for a in range(7) for b in range(7) for c in range(7) if a + b + c == 6} and {tuple(x for x in sorted((a, b, c), reverse=True) if x) for a in range(7) for b in range(7) for c in range(7) if a + b + c == 6})


def test_nnls_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = rng.random((8, 6)), rng.standard_normal(8)
        x = packing.nnls(a, b)
        g = a.T @ (a @ x - b)
        assert x.min() >= 0 and g.min() > -1e-6 and np.abs(g * x).max() < 1e-6


def test_plans_use_up_the_histogram():
    rng = random.Random(2)
    for _ in range(30):
        hist = {rng.randrange(1, 33): rng.randrange(1, 500) for _ in range(20)}
        plan = packing.plan(hist, 32)
        used = Counter()
        for p, r in plan:
            assert sum(p) <= 32
            for n in p:
                used[n] += r
        assert used == hist
        packs, need = sum(r for _, r in plan), sum(n * c for n, c in hist.items()) / 32
        assert packs <= 1.35 * need + sum(c for n, c in hist.items() if n > 16)


@pytest.mark.parametrize("slice_rows", [7, 10**6])
def test_every_piece_has_a_place(docs, monkeypatch, slice_rows):
    from pyspark.sql import functions as F

    monkeypatch.setattr(packing, "SLICE", slice_rows)
    rng = random.Random(3)
    rows = [(i, "x" * rng.choice([0, 1, 5, 30, 63, 64, 65, 100, 200])) for i in range(300)] + [(7, "x" * 30), (None, "x" * 9), (301, None)]
    got = packing.pack(docs(rows), max_len=64, step=4, tokens=F.coalesce(F.length("text"), F.lit(0))).collect()
    want = Counter()
    for i, t in rows:
        n, k = len(t or "") + 1, 0
        while n > 0:
            want[i, k, min(n, 64)] += 1
            n, k = n - 64, k + 1
    assert Counter((r["doc_id"], r["piece"], r["n_tokens"]) for r in got) == want
    packs = {}
    for r in got:
        packs.setdefault(r["pack_id"], []).append((r["slot"], r["start"], r["n_tokens"]))
    for p in packs.values():
        at = 0
        for k, (slot, start, n) in enumerate(sorted(p)):
            assert slot == k and start == at
            at += n
        assert at <= 64
    assert set(packs) == set(range(len(packs)))


def test_packing_odd_cases(docs, odd):
    got = packing.pack(docs(odd))
    assert {r["doc_id"] for r in got.collect()} == {r[0] for r in odd}
    assert packing.pack(docs([])).count() == 0


# ------------------------------------------------ pipeline
def test_packs_meet_the_weights_over_time(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 300)
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(20, 900), "en", "a" if i % 4 else "b") for i in range(1200)]
    plans = {"a": [0.9, 0.5, 0.1], "b": [0.1, 0.5, 0.9]}
    curriculum.in_order(docs(rows), schedules=plans).write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    got = corpus_pipeline.packs(spark, mixed, "").collect()
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(r["doc_id"] for r in mixed.collect())
    assert len({(r["pack_id"], r["slot"]) for r in got}) == len(got)
    n = len({r["pack_id"] for r in got})
    assert {r["pack_id"] for r in got} == set(range(n))
    for k in range(10):
        part = [r for r in got if k * n // 10 <= r["pack_id"] < (k + 1) * n // 10]
        have = sum(r["n_tokens"] for r in part if r["doc_id"] % 4) / sum(r["n_tokens"] for r in part)
        assert have == pytest.approx(np.interp((k + 0.5) / 10, curriculum.GRID, plans["a"]), abs=0.1)
    pieces = Counter(r["pack_id"] for r in got)  # packs of more pieces are left-overs, short pieces from far and wide
    alike = Counter((r["pack_id"], r["doc_id"], r["piece"]) for r in got if pieces[r["pack_id"]] <= packing.PARTS)
    assert max(alike.values()) == 1  # the epochs of a document stand apart


def test_stages_on_a_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    ids = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    assert 0.6 * d.count() < len(ids) <= d.count() and min(ids) == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "mixture", "packs"]


def test_stages_on_odd_tables(spark, docs, odd):
    for rows in (odd, []):
        df = docs(rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, "")
            assert out.columns == df.columns and out.count() <= 2 * len(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, df, "").count() >= len(rows)
