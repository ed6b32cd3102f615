"""Refusals that carry all rows at fault; values frozen once; resolved settings against the rules for one class."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.operators import contracts, gate, labels, signals
from tessella.sources import commits, io


@pytest.mark.parametrize("seed", range(4))
def test_key_faults_by_hand(spark, seed):
    draw = random.Random(seed)
    keys = [draw.choice([None, 1, 2, 3, 4, 5, 6]) for _ in range(draw.randint(0, 9))]
    expected = [draw.choice([None, 2, 3, 5, 7]) for _ in range(draw.randint(0, 6))]
    held, known = Counter(keys), set(expected) - {None}
    want = {(k, "repeated", n) for k, n in held.items() if k is not None and n > 1} | {(None, "missing", n) for k, n in held.items() if k is None}
    table = lambda xs: spark.createDataFrame([(x,) for x in xs], "k int")
    assert {tuple(r) for r in labels.key_faults(table(keys), "k").collect()} == want
    want |= {(k, "unexpected", n) for k, n in held.items() if k is not None and k not in known} | {(k, "absent", 0) for k in known - set(held)}
    assert {tuple(r) for r in labels.key_faults(table(keys), "k", table(expected)).collect()} == want


def test_publish_tells_all_keys_at_fault(spark, tmp_path):
    path, rows = f"file://{tmp_path}/t", spark.range(50).unionByName(spark.range(10))
    with pytest.raises(labels.Refused) as e:
        io.publish(rows, path, key="id", expected=spark.range(60))
    assert Counter(r.fault for r in e.value.faults.collect()) == {"repeated": 10, "absent": 10}
    assert not list(tmp_path.iterdir())
    io.publish(spark.range(60), path, key="id", expected=spark.range(60))
    assert spark.read.parquet(path).count() == 60


def test_frozen_values_are_written_once_or_not_at_all(spark, tmp_path):
    path = f"file://{tmp_path}/f"
    rows = lambda *xs: spark.createDataFrame(xs, "k int, a int, b string")
    io.freeze(spark, path, rows((1, 1, None), (2, 2, "x")), "k")
    io.freeze(spark, path, rows((1, 1, None), (3, 3, "y")), "k")
    with pytest.raises(labels.Refused) as e:
        io.freeze(spark, path, rows((1, 1, "n"), (2, 5, "z"), (4, 4, "w")), "k")
    assert {tuple(r) for r in e.value.faults.collect()} == {(1, "b", None, "n"), (2, "a", "2", "5"), (2, "b", "x", "z")}
    with pytest.raises(ValueError):
        io.freeze(spark, path, rows((5, 1, "a"), (5, 2, "b")), "k")
    assert {tuple(r) for r in commits.table(spark, path).collect()} == {(1, 1, None), (2, 2, "x"), (3, 3, "y")}


def test_a_writer_that_comes_second_is_refused(spark, tmp_path, monkeypatch):
    path, claim = f"file://{tmp_path}/f", commits.claim
    rows = lambda a: spark.createDataFrame([(1, a)], "k int, a int")

    def late(*args):
        monkeypatch.setattr(commits, "claim", claim)
        io.freeze(spark, path, rows(7), "k")  # another writer, just before
        return claim(*args)

    monkeypatch.setattr(commits, "claim", late)
    with pytest.raises(labels.Refused):
        io.freeze(spark, path, rows(8), "k")
    assert [tuple(r) for r in commits.table(spark, path).collect()] == [(1, 7)]


def test_designs(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, 1), (2, 5, 1), (3, None, 1)], "k int, size int, seed int")
    a = {r.k: r.design_hash for r in contracts.design_hashes(df, ["size", "seed"]).collect()}
    assert a == {r.k: r.design_hash for r in contracts.design_hashes(df, ["seed", "size"]).collect()}
    assert a[1] == a[2] and a[3] is None
    reported = contracts.design_hashes(df, ["size", "seed"]).where("k <> 2")
    builds = df.withColumn("size", F.when(F.col("k") == 1, 6).otherwise(F.col("size")))
    assert {tuple(r) for r in contracts.build_faults(builds, reported, "k", ["size", "seed"]).collect()} == {(1, "differs"), (2, "not_reported"), (3, "field_lacks")}


def test_report_fields(spark, tmp_path):
    texts = {"a": '{"n": 1, "deep": {"x": [1, 2]}}', "b": "no json", "c": '{"n": null}', "d": '{"n": "1",\n "s": "train"}'}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    reports = io.read_reports(spark, f"{tmp_path}/*.json")
    required = reports.select("name", F.explode(F.create_map(F.lit("n"), F.lit("1"), F.lit("s"), F.lit("train"))).alias("field", "expected"))
    got = {(r.name, r.field, r.found) for r in contracts.field_faults(reports, required, "name").collect()}
    assert got == {("a.json", "s", None), ("b.json", "n", None), ("b.json", "s", None), ("c.json", "n", None), ("c.json", "s", None)}


def test_admitted_features(spark):
    rows = lambda *xs: spark.createDataFrame(xs, "place int, feature string, signal string")
    alive = spark.createDataFrame([("s",), ("s",), ("t",)], "signal string")
    got = gate.admitted(rows((9, "c", "s"), (2, "a", "u"), (5, "b", "t")), alive)
    assert sorted(tuple(r) for r in got.collect()) == [(0, "b"), (1, "c")]
    with pytest.raises(labels.Refused) as e:
        gate.admitted(rows((1, "a", None), (2, "b", "s"), (3, "c", None)), alive)
    assert {r.feature for r in e.value.faults.collect()} == {"a", "c"}
    with pytest.raises(ValueError):
        gate.admitted(rows((1, "a", "u")), alive)


def test_resolved_thresholds_follow_the_rules_for_one_class(spark):
    """All combinations of settings and calibrations, against ``resolved_threshold``."""
    settings, found, want = [], [], {}
    cases = itertools.product([True, False, None], ["train", "final"], ["lower", "upper"], [None, "border"], [0.05, 0.1], [None, ("train", "lower", None, 0.05), ("final", "upper", "border", 0.05)])
    for k, (calibrated, split, rule, region, q, c) in enumerate(cases):
        settings.append((k, calibrated, 0.5, split, rule, region, q))
        names = ("source_split", "rule", "region", "quantile")
        if c:
            found.append((k, *c, 0.25))
        one = dict(zip(names, (split, rule, region, q))) | {"constant": 0.5} | ({} if calibrated is None else {"calibrated": calibrated})
        try:
            want[k] = signals.resolved_threshold(one, c and dict(zip(names, c)) | {"threshold": 0.25})
        except ValueError:
            want[k] = None
    s = spark.createDataFrame(settings, "k int, calibrated boolean, constant double, source_split string, rule string, region string, quantile double")
    c = spark.createDataFrame(found, "k int, source_split string, rule string, region string, quantile double, threshold double")
    got = signals.resolved_thresholds(s, c, "k").collect()
    assert {r.k: None if r.fault else (r.threshold, r.source) for r in got} == want
    assert all((r.threshold is None) == (r.fault is not None) for r in got)
