"""Ranks, quantiles, blocked vectors, comparison and contracts against plain Python."""

import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_oracles import DATA

from tessella.functions import frames
from tessella.operators import comparison, contracts, labels, recipes, select, signals, vectors
from tessella.plans import more
from tessella.plans.registry import Tables
from tessella.sources import io


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_quantiles_are_numpy_s(spark, accuracy):
    rng = random.Random(1)
    groups = {"one": [3.5], "two": [1.0, 2.0], "ties": [rng.choice([0.0, 1.0, 2.0]) for _ in range(400)], "many": [rng.gauss(0, 1) for _ in range(3000)], "few": [rng.random() for _ in range(7)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("few", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    qs = [0.0, 0.05, 0.25, 0.3, 0.5, 0.9, 0.999, 1.0]
    got = {(r.g, r.q): r.v for r in frames.quantiles(df, "v", qs, ["g"], accuracy).collect()}
    assert got == {(g, q): pytest.approx(float(np.quantile(vs, q)), abs=1e-12) for g, vs in groups.items() for q in qs}
    whole = [v for vs in groups.values() for v in vs]
    assert {r.q: r.v for r in frames.quantiles(df, "v", qs, accuracy=accuracy).collect()} == {q: pytest.approx(float(np.quantile(whole, q)), abs=1e-12) for q in qs}
    row = frames.quantile_row(df, {"low": ("v", 0.1), "high": (F.col("v") * 2, 0.9)}).first()
    assert (row.low, row.high) == (pytest.approx(np.quantile(whole, 0.1)), pytest.approx(2 * np.quantile(whole, 0.9)))
    assert [tuple(r) for r in frames.quantiles(df.limit(0), "v", [0.5]).collect()] == [(0.5, None)]
    assert tuple(frames.quantile_row(df.limit(0), {"m": ("v", 0.5)}).first()) == (None,)


def test_numbers_follow_the_order(spark):
    rows = [(i, (i * 7919) % 101) for i in range(700)] + [(None, 5)]
    got = frames.numbered(spark.createDataFrame(rows, "k int, v int").repartition(6), [F.col("v").desc(), F.col("k").asc_nulls_last()], "at").collect()
    want = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    assert [(r.k, r.v) for r in sorted(got, key=lambda r: r.at)] == want and sorted(r.at for r in got) == list(range(701))
    assert frames.numbered(spark.createDataFrame([], "k int"), [F.col("k")], "at").count() == 0


def test_grown_interval_takes_the_heavier_neighbour():
    rng = np.random.default_rng(2)
    for _ in range(300):
        mass = rng.integers(0, 4, rng.integers(1, 9)).astype(float)
        if not mass.sum():
            continue
        mass /= mass.sum()
        share = round(signals.grown_share(mass, 0.8) * len(mass))
        middle = next(i for i in range(len(mass)) if mass[: i + 1].sum() >= 0.5 - 1e-12)
        # every interval around the middle that a heavier-neighbour walk visits, by its length
        seen, inside = {1: mass[middle]}, [middle]
        while len(inside) < len(mass):
            sides = [(mass[i], i == inside[0] - 1, i) for i in (inside[0] - 1, inside[-1] + 1) if 0 <= i < len(mass)]
            inside = sorted([*inside, max(sides)[2]])
            seen[len(inside)] = mass[inside].sum()
        enough = [n for n, held in seen.items() if held >= 0.8 - 1e-12]
        assert share == min(enough) or abs(seen[share] - 0.8) < 1e-9 or abs(seen[min(enough)] - 0.8) < 1e-9


def test_border_weighs_corners_twice():
    image = np.arange(48.0).reshape(6, 8) % 5
    edge = np.concatenate([image[0], image[-1], image[:, 0], image[:, -1]])
    assert signals.border_uniform(image) == pytest.approx((abs(edge - edge.mean()) < 2).mean())
    assert signals.border_uniform(np.pad(image, 3), box=(3, 3, 11, 9)) == signals.border_uniform(image)


def test_image_files_may_hold_any_byte():
    pixels = np.arange(24, dtype=np.uint8)
    assert (signals.decoded(b"P5\n6 4\n255\n" + pixels.tobytes()) == pixels.reshape(4, 6)).all()
    assert (signals.decoded(b"P6 2 4 255\n" + pixels[::-1].tobytes()) == pixels[::-1].reshape(4, 2, 3)).all()
    for bad in (b"P6\n2 4\n255\nshort", b"P4\n2 2\n", b"", b"P5\n2 2\n65535\n" + bytes(8)):
        with pytest.raises(ValueError):
            signals.decoded(bad)


def png(pixels):
    """A PNG of an array (rows, columns) or (rows, columns, 3), without filters."""
    h, w = pixels.shape[:2]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_source_reads_png(spark, tmp_path):
    rng = np.random.default_rng(5)
    colour, grey = rng.integers(0, 256, (4, 6, 3)).astype(np.uint8), rng.integers(0, 256, (3, 5)).astype(np.uint8)
    for name, raw in (("c.png", png(colour)), ("g.png", png(grey)), ("bad.png", b"no image")):
        (tmp_path / name).write_bytes(raw)
    got = {r.path.rsplit("/", 1)[1]: r for r in signals.source_images(io.read_images(spark, str(tmp_path))).collect()}
    assert {k: (r.valid, r.width, r.height) for k, r in got.items()} == {"c.png": (True, 6, 4), "g.png": (True, 5, 3), "bad.png": (False, None, None)}
    assert np.array(got["c.png"].pixels) == pytest.approx(signals.luminance(colour)) and got["bad.png"].pixels is None
    assert got["c.png"].channel_spread == pytest.approx(colour.astype(float).std(axis=2).mean())
    assert (np.array(got["g.png"].pixels) == grey).all() and got["g.png"].channel_spread == 0


def embeddings(rng, n, dims=6):
    return [(k, rng.normal(size=dims).tolist(), int(k % 3 > 0)) for k in range(n)]


def test_blocks_agree_with_all_pairs(spark, monkeypatch):
    rows = embeddings(np.random.default_rng(3), 90)
    rows += [(200 + k, rows[k][1], rows[k][2]) for k in range(6)]  # exact copies
    df = spark.createDataFrame(rows, "k long, v array<double>, c int").repartition(3)
    unit = {k: np.array(v) / (np.linalg.norm(v) + 1e-8) for k, v, _ in rows}
    side = {k: c for k, _, c in rows}
    near = {k: sorted((float(unit[k] @ unit[o]) for o in unit if o != k and side[o] == side[k]), reverse=True) for k in unit}
    for block in (2048, 7):
        monkeypatch.setattr(vectors, "BLOCK", block)
        for r in vectors.distinctiveness(df, "k", "c", "v", k=4, duplicate=0.8).collect():
            s = near[r.k]
            assert (r.score, r.max_similarity) == (pytest.approx(1 - np.mean(s[:4])), pytest.approx(s[0])) and (r.n_peers, r.n_duplicates) == (len(s), sum(x >= 0.8 for x in s))
        got = {r.node: r.cluster for r in vectors.clusters(vectors.duplicate_edges(df, "k", "c", "v", 0.8)).collect()}
        parent = {k: k for k in unit}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a in unit:
            for b in unit:
                if a < b and side[a] == side[b] and unit[a] @ unit[b] >= 0.8:
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
        sizes = [root(k) for k in unit]
        assert got == {k: root(k) for k in unit if sizes.count(root(k)) > 1}


def test_classes_without_references_meet_all(spark):
    rng = np.random.default_rng(4)
    c = [(k, rng.normal(size=4).tolist(), k % 4) for k in range(20)]
    r = [(k, rng.normal(size=4).tolist(), k % 2) for k in range(30)]
    got = vectors.knn_scores(*(spark.createDataFrame(x, "k long, v array<double>, c int") for x in (c, r)), "k", "c", "v", k=3, least_references=10).collect()
    unit = lambda v: np.array(v) / (np.linalg.norm(v) + 1e-8)
    assert len(got) == 20
    for x in got:
        _, v, kind = c[x.k]
        own = sorted((float(unit(v) @ unit(w)) for _, w, k in r if kind > 1 or k == kind), reverse=True)
        assert (x.tier, x.n_references) == ("all" if kind > 1 else "same_class", len(own)) and x.knn_mean == pytest.approx(np.mean(own[:3]))


def test_tiers_walk_from_equal_sets_to_all(spark):
    t = Tables(spark, DATA)
    got = {r.vec_id: r for r in more.tiered(t).collect()}
    e = {r.vec_id: (r.label, np.array(r.embedding, dtype=float)) for r in t.embeddings.collect()}

    def labels_of(k):
        h = k // 2
        return frozenset(x for x in (f"l{e[k][0] % 4}" if h % 3 else None, "x" if h % 4 == 1 else None, "rare" if h % 50 == 7 else None, f"own{k}" if k % 90 == 8 else None) if x)

    refs = [k for k in e if k % 2]
    unit = {k: v / (np.linalg.norm(v) + 1e-8) for k, (_, v) in e.items()}
    tiers = set()
    for k in (k for k in e if k % 2 == 0):
        own = labels_of(k)
        choices = [[r for r in refs if labels_of(r) == own], [r for r in refs if own and len(own & labels_of(r)) >= 0.5 * len(own | labels_of(r))], [r for r in refs if own & labels_of(r)], refs]
        tier = next(i for i, c in enumerate(choices) if len(c) >= 5 or i == 3)
        s = sorted((float(unit[k] @ unit[r]) for r in choices[tier]), reverse=True)[:5]
        r = got[k]
        gap = s[0] - np.mean(s[1:])
        assert (r.tier, r.n_references) == (f"tier{tier + 1}", len(choices[tier]))
        assert (r.knn_mean, r.top1, r.topk_spread, r.top1_gap) == pytest.approx((np.mean(s), s[0], s[0] - s[-1], gap))
        assert r.is_near_duplicate == (s[0] >= 0.3) and r.collapsed == (s[0] >= 0.3 and gap >= 0.05)
        tiers.add(tier)
    assert len(got) == len(e) - len(refs) and len(tiers) >= 2


def test_comparison_refuses_partial_grids(spark):
    p = Tables(spark, DATA).predictions
    with pytest.raises(ValueError, match="without predictions"):
        comparison.comparable(p.where("condition <> 'B'"), comparison.PROTOCOLS["v1"])
    with pytest.raises(ValueError, match="every run"):
        comparison.comparable(p.where("condition <> 'B' or image_id % 7 <> 0"), comparison.PROTOCOLS["v1"])


def test_equal_conditions_do_not_differ(spark):
    rows = [(i, i // 2, c, s, i % 3, (i * (s + 1)) % 3) for i in range(60) for c in "ABC" for s in (1, 2)]
    p = spark.createDataFrame(rows, "image_id int, lesion_id int, condition string, seed int, true_class int, predicted int")
    got = comparison.compare(p, comparison.PROTOCOLS["v1"], "lesion_id", 20).collect()
    assert {r.family for r in got} == {"confirmatory", "exploratory"} and sum(r.family == "confirmatory" for r in got) == 1
    assert all(r.difference == 0 and r.p == 1 and not r.rejected for r in got)
    chances = p.withColumns({f"p{k}": (F.col("predicted") == k).cast("double") for k in range(3)})
    more = comparison.compare(chances, comparison.PROTOCOLS["v1"], "lesion_id", 20, probabilities=["p0", "p1", "p2"]).collect()
    assert {r.name for r in more} - {r.name for r in got} == {f"{x}:macro_auroc" for x in ("C_vs_B", "C_vs_A", "B_vs_A")}


def test_forbidden_paths_of_nested_trees(spark):
    rows = [(1, '{"a": {"b": ["x", {"c": "final"}]}, "d": "final"}'), (2, '"final"'), (3, "not json"), (4, None), (5, '{"a.b": ["final", "final"], "n": 42}'), (6, '{"final": "x"}')]
    df = spark.createDataFrame(rows, "k int, report string")
    got = {(r.k, r.path) for r in contracts.forbidden_paths(df, "report", "k", "final").collect()}
    assert got == {(1, "$.a.b[1].c"), (1, "$.d"), (2, "$"), (5, "$.a.b[0]"), (5, "$.a.b[1]")}
    assert {r.path for r in contracts.forbidden_paths(df, "report", "k", 42).collect()} == {"$.n"}
    with pytest.raises(Exception, match="deeper"):
        contracts.forbidden_paths(df, "report", "k", "final", depth=2).collect()


def test_preconditions_name_all_failures(spark):
    runs = spark.createDataFrame([("A", 1, "train", "p", "h1"), ("A", 1, "train", "p", "h1"), ("B", 1, "final", "q", "h1")], "condition string, seed int, split string, protocol string, trained_on string")
    grid = spark.createDataFrame([("A", 1), ("B", 1), ("B", 2)], "condition string, seed int")
    split = spark.createDataFrame([(1, None), (2, 5)], "image_id int, group_id int")
    checks = contracts.preconditions(runs, grid, split, ["protocol"])
    assert {r.check: r.n_bad for r in checks.collect()} == {"grid_complete": 2, "protected_split_unused": 1, "shared_protocol": 1, "training_data_differs": 1, "groups_known": 1}
    with pytest.raises(ValueError, match="grid_complete.*groups_known"):
        contracts.enforce(checks)


def test_final_selection_refuses_nothing(spark):
    pool = spark.createDataFrame([(1, "a", 0.2), (2, "b", 0.4)], "image_id int, dx string, score double")
    high = spark.createDataFrame([("a", 0.9), ("b", 0.9)], "dx string, threshold double")
    with pytest.raises(ValueError, match="selects nothing"):
        select.finalise(pool, "baseline", {"baseline": high})
    with pytest.raises(ValueError, match="unknown policy"):
        select.finalise(pool, "other", {})


def test_references_are_checked_again(spark):
    rows = spark.createDataFrame([(k, "a", float(k)) for k in range(8)], "image_id int, dx string, v double")
    none, some = rows.limit(0).select("image_id"), spark.createDataFrame([(99,)], "image_id int")
    of = lambda r, p, s="train", n=5: signals.reference_distributions(r, p, s, "dx", "image_id", "v", n)
    assert of(rows, some).count() == 8
    for bad, match in ((lambda: of(rows, some, "final"), "may not"), (lambda: of(rows, none), "protected keys"), (lambda: of(rows, rows.select("image_id").limit(1)), "protected split"), (lambda: of(rows.union(rows), some), "repeated"), (lambda: of(rows, some, n=9), "too few")):
        with pytest.raises(ValueError, match=match):
            bad()


def test_publish_replaces_by_renames_and_runs_once(spark, tmp_path):
    path, seen = f"file://{tmp_path}/t", spark.sparkContext.accumulator(0)

    def count(rows):
        for r in rows:
            seen.add(len(r))
            yield r

    io.publish(spark.range(5), path)
    io.publish(spark.range(7).mapInPandas(count, "id long"), path, once=False, provenance={"signal": "s"})
    assert spark.read.parquet(path).count() == 7 and seen.value == 7
    assert io.provenance_of(spark, path) == {"signal": "s", "n_rows": 7}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_source_and_metadata_faults_need_their_columns(spark):
    df = spark.createDataFrame([("p1", "1")], "path string, a string")
    for f in (lambda: labels.source_faults(df, "path", ["a", "b"], "p"), lambda: labels.metadata_faults(df, "path", "g", "a")):
        with pytest.raises(ValueError, match="missing columns"):
            f()


def test_recipes_meet_quotas_and_blocks(spark):
    t = Tables(spark, DATA)
    made = more.planned(t).collect()
    held = {x: sum(x in r.combination for r in made) for x in more.QUOTAS}
    assert all(held[x] >= n for x, n in more.QUOTAS.items()) and len({r.recipe_id for r in made}) == len(made)
    assert not any({"error", "view"} <= set(r.combination) or "zzz" in r.combination for r in made)
    total = sum(more.QUOTAS.values())
    assert sum(not r.combination for r in made) == round(total / 0.9) - total
    row = more.ag28_mix(t).first()
    assert (row.n_recipes, row.single + row.multi + row.none) == (len(made), len(made)) and json.loads(row.emitted) == held
    assert {r.age for r in made} == {20, 40, 60} and 0 < sum(r.support_devices for r in made) < len(made)
    for bad in ({"other": 1}, {"click": 5, "other": 1}):
        with pytest.raises(ValueError, match="no combination"):
            recipes.plan([("click",)], bad, 0.5, 0.1)
