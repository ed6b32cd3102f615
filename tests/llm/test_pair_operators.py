"""Brute-force comparisons of spelling variants, conversation repair and vector near-duplicates; odd tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from tessella.llm import conversation_repair, embedding_dedup, spelling


# spelling


def plain_variants(counts, ratio=5):
    words = sorted(w for w, n in counts.items() if n >= 5 and len(w) >= 6)

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w in words:
        some = [x for x in words if x != w and near(w, x)]
        best = min(some, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
        out[w] = (form[w], counts[w], len(some), counts[form[w]] if form[w] else None)
    root = lambda w: root(form[w]) if form[w] else w
    return {w: (f, root(w), n, near_, fn) for w, (f, n, near_, fn) in out.items()}


def variants_of(spark, texts, **more):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, word string")
    got = spelling.group(docs, **more).collect()
    assert len({r.word for r in got}) == len(got)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


def test_variants_are_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 8))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "bbbbbbb"]
    words = []
    for _ in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 1, 1, 2))):
            i = rng.randrange(len(w))
            w[i : i + rng.choice((0, 1))] = rng.choice(([], ["a"], ["ÿ"]))
        words += ["".join(w)] * rng.choice((1, 4, 5, 6, 30, 200))
    words += [w for w, n in (("pqrstuv", 5), ("pqrstuw", 30), ("pqrstww", 200), ("pqrswww", 1100)) for _ in range(n)]  # a path
    rng.shuffle(words)
    texts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)]
    want = plain_variants(collections.Counter(words))
    assert sum(v[0] is not None for v in want.values()) > 5 and any(v[0] and v[1] != v[0] for v in want.values())
    assert variants_of(spark, texts) == want


def test_damage_and_case(spark):
    texts = ["Straße ÀÉîôûx Wordly wordly, worDlyx 7wordly_wordly"] * 300 + [None, "", "  "]
    counts = collections.Counter()
    for i, t in enumerate(texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    assert variants_of(spark, texts, damage=199) == plain_variants(counts)


def test_long_words_and_empty_tables(spark):
    long = "ab" * 20_000
    got = variants_of(spark, [f"{long} {long}x"] * 5 + [long] * 30)
    assert got == {long: (None, long, 35, 1, None), long + "x": (long, long, 5, 1, 35)}
    assert variants_of(spark, []) == {} and variants_of(spark, [None, "", "a b c"]) == {}


# conversation repair


def plain_repair(rows):
    """Costs and audit by a search over all edits, cheapest first, then least audit."""
    import heapq

    rows = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for t, r, x in rows))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, initials, said = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            break
        state = (at, "n" if not initials else initials[-1])
        if state in done:
            continue
        done.add(state)
        def add(c, letter, k, role, text):
            i = initials + role[:1]
            if role and re.fullmatch("s?(ua)*u?", i):
                heapq.heappush(heap, (cost + c, audit + letter, k, i, (*said, f"{role}:{text}")))

        if at < len(rows):
            _, _, role, text = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, initials, said))
            if faults[at] not in ("blank", "duplicate"):
                more = faults[at] == "truncated"
                add(more, "K", at + 1, role, text)
                for r in ("user", "assistant"):
                    add(2 + more, "R", at + 1, r, text)
        for r in ("user", "assistant"):
            add(2, "I", at, r, "")
    turns = [t for some, t, _, _ in rows if some]
    first = [r[:1] for _, _, r, _ in rows]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(first))
    n = collections.Counter(faults)
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


@pytest.mark.parametrize("most", [2, 4096])
def test_repair_is_a_search(spark, most):
    rng = random.Random(most)
    convs = {}
    for c in [None, *range(60)]:
        n = rng.choice((1, 2, 3, 5, 8, 14))
        rows = [(rng.choice((None, k, k, k, k // 2)), rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None)), rng.choice(("Yes.", "No", "Why?\n", " ", "", None, f"t{k}!", "a\nb."))) for k in range(n)]
        convs[c] = rows + [rng.choice(rows) for _ in range(rng.choice((0, 1, 3)))]
    flat = [(c, *r, 1) for c, rows in convs.items() for r in rows]
    rng.shuffle(flat)
    df = spark.createDataFrame(flat, "conv_id long, turn long, role string, text string, cost int").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.report(conversation_repair.repair(df, most), df.select("conv_id")).collect()}
    want = {c: plain_repair(rows) for c, rows in convs.items()}
    assert {c: g for c, g in got.items() if g != want[c]} == {} and len(got) == len(want)


def test_a_long_conversation_is_cut(spark):
    roles = itertools.cycle(("user", "assistant", "assistant"))
    rows = [(1, k, next(roles), f"text {k}.") for k in range(900)] + [(1, 900, "user", "same.")] * 500
    made = conversation_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 50)
    assert made.count() >= 900 // 50
    got = conversation_repair.report(made, spark.createDataFrame([(1,), (2,)], "conv_id long")).orderBy("conv_id").collect()
    want = plain_repair([r[1:] for r in rows])
    assert tuple(got[0])[1:] == want and tuple(got[1])[1:7] == (0,) * 6 and got[1].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    text = "\n".join(f"{r.role}:{r.text}" for r in conversation_repair.messages(made).orderBy("block", "place").collect())
    assert hashlib.sha256(text.encode()).hexdigest() == want[-1]


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.report(conversation_repair.repair(none), none).collect() == []
    got = conversation_repair.damaged(spark.createDataFrame([(1, k, None, None) for k in range(400)], "conv_id long, turn long, role string, text string"))
    kinds = collections.Counter(zlib.crc32(f"1:{k}".encode()) % 20 for k in range(400))
    assert got.count() == 400 - kinds[0] + kinds[3] and got.where("text = ''").count() == kinds[1] and got.where("role = 'user'").count() == kinds[4]


# vectors


def plain_links(rows, limit=0.93):
    """rows: (id, vector, label); (n_links, component) by row."""
    def usable(v, lab):
        return lab is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n, up = [0] * len(rows), {r[0]: r[0] for r in rows if r[0] is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (i, a), (j, b) in itertools.combinations(enumerate(rows), 2):
        if a[0] is None or b[0] is None or a[2] != b[2] or not usable(*a[1:]) or not usable(*b[1:]) or len(a[1]) != len(b[1]):
            continue
        x, y = (np.array(v, dtype=float) / max(map(abs, v)) for v in (a[1], b[1]))
        if x @ y >= limit * np.linalg.norm(x) * np.linalg.norm(y):
            n[i], n[j] = n[i] + 1, n[j] + 1
            p, q = sorted((root(a[0]), root(b[0])))
            up[q] = p
    return [(r[0], k, None if r[0] is None else root(r[0])) for r, k in zip(rows, n, strict=True)]


def test_vectors_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 24)
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for label in (1, 2, 3):
        centres = rng.normal(size=(6, 8))
        for c in centres:
            for _ in range(rng.integers(1, 40)):
                rows.append((k, [float(np.float32(v)) for v in (c + rng.normal(size=8) * rng.choice((0.05, 0.3, 0.6))) * 10.0 ** rng.integers(-3, 3)], label))
                k += 1
    rows += [(1000 + i, rows[3][1], rows[3][2]) for i in range(30)] + [(2000, [2 * v for v in rows[3][1]], rows[3][2])]
    rows += [(3, rows[-40][1], 1), (3001, None, 1), (3002, [0.0] * 8, 1), (3003, [float("nan")] * 8, 1), (3004, [1.0, None], 1), (3005, rows[0][1], None), (None, rows[0][1], 1), (3006, [], 1), (3007, rows[0][1][:4], 1), (3008, [float("inf")] + [1.0] * 7, 1), (3009, rows[0][1], 2), (3010, [1e300] * 8, 5), (3011, [1e-300] * 8, 5)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "vec_id long, embedding array<double>, label int, c double")
    got = collections.Counter((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.link(df).collect())
    want = collections.Counter(plain_links(rows))
    assert got - want == want - got == collections.Counter()
    assert embedding_dedup.link(df.limit(0)).collect() == []


@pytest.mark.parametrize("spread", [0.02, 0.1, 0.25])
def test_trees_give_all_pairs_and_open_few_nodes(monkeypatch, spread):
    monkeypatch.setattr(embedding_dedup, "LEAF", 8)
    monkeypatch.setattr(embedding_dedup, "SPREAD", 4)
    rng = np.random.default_rng(1)
    x = embedding_dedup.unit((rng.normal(size=(40, 1, 16)) + spread * rng.normal(size=(40, 25, 16))).reshape(-1, 16).tolist())
    y = embedding_dedup.unit((x[::3] + 0.05 * rng.normal(size=x[::3].shape)).tolist())

    def made(a, b, same):
        tree = embedding_dedup.tree(a)
        out, looked = np.zeros((len(a), len(b)), dtype=int), 0
        for i, j, hit in embedding_dedup.pairs(a, tree, b, tree if same else embedding_dedup.tree(b), 0.93, same):
            looked += len(i) * len(j) if hit is not None else 0
            out[np.ix_(i, j)] += 1 if hit is None else hit
        return out, looked

    for a, b, same in ((x, x, True), (x, y, False)):
        want, (got, looked) = (a @ b.T >= 0.93).astype(int), made(a, b, same)
        if same:
            want, got = np.triu(want, 1), got + np.tril(got, -1).T - np.tril(got, -1)
        assert (got == want).all() and looked < 0.2 * len(a) * len(b)
    nodes = [embedding_dedup.tree(x)]
    assert nodes[0].children
    while nodes:
        u = nodes.pop()
        assert np.allclose(embedding_dedup.chords(x[u.centre : u.centre + 1], x[u.at]).max(), u.radius, atol=1e-6)
        assert sorted(i for c in u.children for i in c.at) == sorted(u.at) * bool(u.children)
        nodes += u.children


def test_one_vector_holds_a_third_of_all_rows(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(3000)] + [(10_000 + i, [math.cos(i), math.sin(i), 0.1], 1) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embedding_dedup.link(df).collect()}
    assert all(got[i].n_links == 2999 and got[i].component_id == 0 for i in range(3000)) and sum(r.kept for r in got.values()) < 300
