"""Queries read whole tables: tables whose ids all lie far above the former id limits give every row its result."""

import hashlib
import itertools
import math
import os
import statistics
from collections import Counter

import duckdb
import pytest
from test_oracles import DATA, rows

from tessella.operators import labels, metrics, sampling
from tessella.plans import ORACLES, QUERIES
from tessella.plans.registry import TABLES

SHIFT = 100_000
KEYS = {"orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey"], "customer": ["c_custkey"]}


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """A folder of the tables with shifted ids, and DuckDB over it."""
    folder, c = tmp_path_factory.mktemp("far"), duckdb.connect()
    for t in TABLES:
        moved = ", ".join(f"{k} + {SHIFT} AS {k}" for k in KEYS.get(t, []))
        c.execute(f"copy (select * {f'replace ({moved})' if moved else ''} from '{DATA}/{t}.parquet') to '{folder}/{t}.parquet'")
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return str(folder), c


def whole(spark, far, name, count):
    """The query's rows, compared with its oracle's, and as many as ``count``, plain SQL without the oracle's, says."""
    folder, duck = far
    df = QUERIES[name](spark, folder)
    got = [r.asDict() for r in df.collect()]
    assert len(got) == duck.execute(count).fetchone()[0] > 0
    if name in ORACLES:
        want = duck.execute(ORACLES[name])
        names = [d[0] for d in want.description]
        assert rows([tuple(r.values()) for r in got], df.columns) == rows(want.fetchall(), names)
    return got


SUBSETS = {
    "ag9_banzhaf": "select count(distinct l_partkey % 50) from lineitem",
    "ag10_value_agreement": "select 1",
    "ag11_marginal_targets": "select count(distinct l_partkey % 50) from lineitem",
    "ag12_under_exposed": "select count(*) from (select i from range(55) r(i) left join (select distinct l_orderkey, l_partkey % 50 as k from lineitem) on k = i group by i having count(k) < 25)",
    "ag29_pooled_features": "select count(distinct l_orderkey) from lineitem",
    "st27_pairwise_ranking": "select 1",
    "jn17_pending": "select count(*) from orders where o_orderkey % 3 <> 0",
    "se3_winsorised": "select count(*) from orders",
    "se4_min_max": "select count(*) + 1 from orders",
}


@pytest.mark.parametrize("name", SUBSETS)
def test_subsets_are_all_orders(spark, far, name):
    got = whole(spark, far, name, SUBSETS[name])
    if name == "ag9_banzhaf":
        n = far[1].execute("select count(*) from (select distinct l_orderkey, l_partkey % 50 from lineitem)").fetchone()[0]
        assert sum(r["exposures"] for r in got) == n
    if name == "st27_pairwise_ranking":
        prices = [x for (x,) in far[1].execute("select count(*) from orders group by o_totalprice").fetchall()]
        assert got[0]["n_pairs"] == (sum(prices) ** 2 - sum(x * x for x in prices)) // 2


def test_pairs_are_counted_as_if_made(spark):
    data = [(g, k, None if k == 7 else float(k * 7 % 4), None if k == 9 else float(k * 5 % 6 if g else 1)) for g in (0, 1) for k in range(30)]
    got = metrics.pairwise_ranking_accuracy(spark.createDataFrame(data, "g int, k int, p double, m double"), ["g"], "p", "m", "k").collect()
    pairs = [(a, b) for a, b in itertools.combinations([x[2:] for x in data if x[0]], 2) if a[1] is not None and b[1] is not None and a[1] != b[1]]
    known = [(a[0] - b[0], math.copysign(1, a[1] - b[1])) for a, b in pairs if a[0] is not None and b[0] is not None]
    assert [r.g for r in got] == [1] and got[0].n_pairs == len(pairs)
    assert got[0].accuracy == pytest.approx(sum(d * s > 0 for d, s in known) / len(known))
    assert got[0].logistic_loss == pytest.approx(sum(math.log1p(math.exp(-d * s)) for d, s in known) / len(known))


LINES = "(select distinct l_orderkey, l_linenumber from lineitem)"
CUT = {
    "st12_one_vs_rest": "select 3",
    "st25_prediction_table": "select count(*) from orders",
    "im18_agreement": "select count(*) from orders",
    "im19_agreement_multi": "select count(*) from orders",
    "im16_uncertainty": "select count(distinct l_orderkey) from lineitem",
    "im17_uncertainty_multi": "select count(distinct l_orderkey) from lineitem",
    "ag21_verified_counts": "select count(distinct l_linenumber) from lineitem",
    "ag22_best_measured": "select count(distinct l_orderkey) from lineitem",
    "ag23_least_ranked": "select count(distinct l_orderkey) from lineitem",
    "ag24_median_threshold": "select count(distinct l_linenumber) from lineitem",
    "ag25_mean_threshold": "select 1",
    "ag26_threshold_stability": "select 1",
    "wn13_rank_in_context": f"select count(*) from {LINES}",
    "st28_threshold_regret": f"select count(*) from {LINES} where l_linenumber = 1",
}


@pytest.mark.parametrize("name", CUT)
def test_measured_and_predicted_rows_are_all_rows(spark, far, name):
    got = whole(spark, far, name, CUT[name])
    assert all(v is not None for r in got for v in r.values())
    if name == "ag21_verified_counts":
        assert sum(r["train"] + r["held_out"] for r in got) == far[1].execute(f"select count(*) from {LINES}").fetchone()[0]


def test_every_context_has_candidates_to_verify(spark, far):
    n = far[1].execute("select count(distinct l_orderkey) from lineitem").fetchone()[0]
    got = whole(spark, far, "se23_diversified", f"with m as (select l_orderkey as c, l_linenumber as p, (l_orderkey * 7 + l_linenumber * 3) % 5 as u, abs((l_orderkey * 11 + l_linenumber) % 40 - 20) as d from {LINES}), r as (select *, row_number() over (partition by c order by u desc, p) - 1 as k, count(*) over (partition by c) as n, row_number() over (partition by c order by d, p) as h, min(p) over (partition by c) as lo, max(p) over (partition by c) as hi from m) select count(*) from r where k < 3 or k % greatest(1, (n - 1) // 4) = 0 or p in (lo, hi) or h = 1")
    assert len({r["context_id"] for r in got}) == n


FAMILIES = {"st15_holm": "select count(*) from customer", "st16_benjamini_hochberg": "select count(*) from customer", "pf9_one_hot": "select 5 * count(*) from orders", "so7_subset_distinctness": "select count(distinct l_orderkey) from lineitem"}


@pytest.mark.parametrize("name", FAMILIES)
def test_families_and_labels_are_whole(spark, far, name):
    got = whole(spark, far, name, FAMILIES[name])
    if name == "pf9_one_hot":
        assert sum(r["hot"] for r in got) * 5 == len(got)
    if name == "so7_subset_distinctness":
        assert sum(r["declared"] for r in got) == far[1].execute("select count(*) from lineitem").fetchone()[0]
    if name not in ("st15_holm", "st16_benjamini_hochberg"):
        return
    # plain recomputation, with the size of the whole family
    families = {}
    for family, key in far[1].execute("select c_mktsegment, c_custkey from customer where c_custkey % 10 <> 0").fetchall():
        families.setdefault(family, []).append((key % 97 / 1000, key))
    want = {}
    for ps in families.values():
        ps.sort()
        m, best = len(ps), 0.0 if name == "st15_holm" else 1.0
        for i, (p, key) in enumerate(ps) if name == "st15_holm" else reversed(list(enumerate(ps))):
            best = max(best, min(1.0, p * (m - i))) if name == "st15_holm" else min(best, p * m / (i + 1))
            want[key] = best
    assert {r["name"]: r["adjusted"] for r in got if r["adjusted"] is not None} == pytest.approx(want, abs=1e-6)


def plain_allocation(vectors, shares):
    """The multi-label rule one group after the other: (vector, split) of each."""
    names, n = list(shares), len(vectors)
    room = {s: int(n * p) for s, p in shares.items()}
    room[max(names, key=shares.get)] += n - sum(room.values())
    full = dict(room)
    totals = [sum(c) for c in zip(*vectors, strict=True)]
    seen, out = {s: [0] * len(totals) for s in names}, []

    def order(v):
        return min([t for t, x in zip(totals, v, strict=True) if x], default=n + 1), -sum(v), hashlib.sha256(f"0:{v}".encode()).hexdigest()

    for v in sorted(vectors, key=order):
        best = None
        for i, s in enumerate(names):
            if room[s]:
                lack = sum(max(0.0, (shares[s] * t - h) / max(shares[s] * t, 1e-9)) for x, t, h in zip(v, totals, seen[s], strict=True) if x)
                mark = (round(lack, 9), room[s] / max(full[s], 1), -i)
                best = max(best or (mark, s), (mark, s), key=lambda m: m[0])
        room[best[1]] -= 1
        seen[best[1]] = [a + b for a, b in zip(seen[best[1]], v, strict=True)]
        out.append((v, best[1]))
    return out


def test_all_groups_take_part_in_the_heuristics(spark, far):
    folder, duck = far
    kinds = ", ".join(f"max((o_orderpriority = '{k}')::int)" for k in labels.CLASSES)
    groups = [(r[0], r[1:]) for r in duck.execute(f"select o_custkey, {kinds} from orders group by 1").fetchall()]
    few = dict(duck.execute("select o_custkey, count(*) from orders group by 1").fetchall())
    whole = {g: (*v, *(int(not v[k] and few[g] >= 8) for k in range(2))) for g, v in groups}
    got = {r.group_id: r.split for r in QUERIES["sp4_multilabel_allocation"](spark, folder).collect()}
    assert got.keys() == whole.keys()
    assert Counter((v, got[g]) for g, v in whole.items()) == Counter(plain_allocation(list(whole.values()), sampling.SPLITS))
    drawn = QUERIES["sm12_matched_draw"](spark, folder).collect()
    take = plain_draw(groups, [20, 25, 30, 20, 15], 45, 0.1, 0.9)
    assert {r.group_id: tuple(r)[1:] for r in drawn} == take
    got = {r.label: (r.achieved, r.delta) for r in QUERIES["sm12_draw_residuals"](spark, folder).collect()}
    assert got == {f"k{k}": (sum(v[k] for v in take.values()), sum(v[k] for v in take.values()) - w) for k, w in enumerate([20, 25, 30, 20, 15])}


def plain_draw(groups, wanted, size, single, multi):
    """The matched draw one group after the other, in the order of the vectors' and then the groups' hashes."""
    digest = lambda x: hashlib.sha256(f"0:{x}".encode()).hexdigest()
    left = sorted(groups, key=lambda g: (digest(tuple(g[1])), digest(g[0]), g[0]))
    out = []
    sums = lambda: [sum(v[k] for _, v in out) for k in range(len(wanted))]
    for k in sorted(range(len(wanted)), key=lambda k: (wanted[k], k)):
        for g in list(left):
            if len(out) < size and g[1][k] and sums()[k] < wanted[k]:
                out.append(g)
                left.remove(g)
    for g in sorted(left, key=lambda g: any(g[1]))[: size - len(out)]:
        out.append(g)
        left.remove(g)

    def mismatch():
        ones, more = sum(sum(v) == 1 for _, v in out) / size, sum(sum(v) > 1 for _, v in out) / size
        return round(sum(abs(a - w) / max(w, 1) for a, w in zip(sums(), wanted, strict=True)) + abs(ones - single) + abs(more - multi), 9)

    rank = {v: i for i, v in enumerate(sorted({tuple(v) for _, v in groups}, key=digest))}
    for _ in range(100):
        now, best = mismatch(), None
        for a in {tuple(g[1]): g for g in out}.values():
            for b in {tuple(g[1]): g for g in reversed(left)}.values():
                if a[1] != b[1]:
                    out[out.index(a)] = b
                    best = min([x for x in (best, (mismatch(), rank[tuple(a[1])], rank[tuple(b[1])], a, b)) if x])
                    out[out.index(b)] = a
        if best is None or best[0] >= now:
            break
        out[out.index(best[3])] = best[4]
        left[left.index(best[4])] = best[3]
    counts = Counter(tuple(v) for _, v in out)
    first = sorted(groups, key=lambda g: (digest(g[0]), g[0]))
    return {g: tuple(v) for g, v in first if (counts.__setitem__(tuple(v), counts[tuple(v)] - 1) or counts[tuple(v)] >= 0)}


def test_late_groups_are_candidates(spark):
    """Groups with the rare label come last by id, behind more groups than are drawn."""
    data = [(g, 1, 1, 0) for g in range(400)] + [(1000 + g, 1, 0, 1) for g in range(3)]
    groups = spark.createDataFrame(data, "group_id long, n_rows int, a int, b int")
    got = {r.group_id for r in sampling.rarity_first(groups, ["a", "b"], 200).collect()}
    assert len(got) == 200 and len([g for g in got if g >= 1000]) >= 1
    assert {r.group_id for r in sampling.rarity_first(groups, ["a", "b"], 5000).collect()} == {r[0] for r in data}
    assert sampling.rarity_first(groups.limit(0), ["a", "b"], 10).count() == 0


def test_groups_of_a_vector_are_dealt_in_hash_order(spark):
    data = [(g, int(g % 50 == 0), 1) for g in range(3000)]
    got = {r.group_id: r.split for r in sampling.multilabel_groups(spark.createDataFrame(data, "group_id long, a int, b int"), ["a", "b"], seed=4).collect()}
    plan = sampling.greedy_counts(Counter((a, b) for _, a, b in data), sampling.SPLITS)
    for v in {x[1:] for x in data}:
        ids = sorted((g for g, *w in data if tuple(w) == v), key=lambda g: hashlib.sha256(f"4:{g}".encode()).hexdigest())
        assert [got[g] for g in ids] == [s for (w, s), n in plan.items() if w == v for _ in range(n)]
    assert len(got) == 3000


def test_outer_merge_takes_whole_tables(spark, far):
    got = whole(spark, far, "jn2_outer_merge", "select count(*) from orders")
    assert sum(r["b"] is not None for r in got) == far[1].execute("select count(*) from orders where o_orderkey % 19 <> 0").fetchone()[0]
    a, b = spark.createDataFrame([(1, 10), (2, 20)], "k int, a int"), spark.createDataFrame([(2, 200), (3, 300)], "k int, b int")
    assert sorted(tuple(r) for r in labels.merge_all([a, b], "k", "full").collect()) == [(1, 10, None), (2, 20, 200), (3, None, 300)]


def test_median_takes_odd_contexts_too(spark, far):
    got = whole(spark, far, "ag24_median_threshold", "select count(distinct l_linenumber) from lineitem")
    values = {}
    for k, n in far[1].execute("select distinct l_orderkey, l_linenumber from lineitem").fetchall():
        values.setdefault(n, []).append(n / 10 * ((k * 7 + n * 3) % 5))
    assert {r["position"]: r["median"] for r in got} == pytest.approx({n: statistics.median(v) for n, v in values.items()}, abs=1e-6)


@pytest.mark.parametrize("name, table, change", [
    ("pf7_sanitize_id", "pages", "select page_id, case when page_id = (select max(page_id) from t) then 'http://late/x.html' else url end as url, html from t"),
    ("sm4_heads", "events", "select event_id, ts, case when event_id = (select min(event_id) from t) then 999999 else user_id end as user_id, event_type, 1.0::double as value, props from t"),
    ("fn10_content_hashes", "nation", "select * replace (case when n_nationkey = 24 then 'LATE' else n_name end as n_name) from t"),
    ("ct8_evaluation_runs", "customer", "select * replace (case when c_custkey = (select max(c_custkey) from t) then 'ZLATE' else c_mktsegment end as c_mktsegment) from t"),
    ("pf12_contributing_signals", "supplier", "select * replace (1e6::double as s_acctbal) from t"),
])
def test_rows_that_filters_once_left_out_change_the_answer(spark, tmp_path, name, table, change):
    folder = tmp_path / "sf"
    folder.mkdir()
    for f in os.listdir(DATA):
        os.symlink(f"{DATA}/{f}", folder / f)
    (folder / f"{table}.parquet").unlink()
    duckdb.sql(f"copy (with t as (select * from '{DATA}/{table}.parquet') {change}) to '{folder}/{table}.parquet' (format parquet)")
    read = lambda d: sorted(map(str, (tuple(r) for r in QUERIES[name](spark, str(d)).collect())))
    assert read(folder) != read(DATA)
