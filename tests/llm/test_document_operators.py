"""Brute-force comparisons of classifier, chat, near-dedup, mixing and quality rules, and the pipeline."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import chat, components, line_rules, mixing, near_dedup, quality_mil

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_attention_finds_the_bad_passage():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    good = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts, y = [], []
    for i in range(200):
        n = rng.randint(100, 400)
        texts.append(good(n) if i % 3 else good(n) + " " + " ".join(w.upper() + "!!" for w in good(64).split()) + " " + good(60))
        y.append(int(i % 3 > 0))
    read = [quality_mil.Reader().read(t) for t in texts]
    model = quality_mil.Model().fit(read[:150], np.array(y[:150]))
    p = model.score(read[150:])
    assert ((p >= 0.3) == np.array(y[150:])).mean() > 0.9
    worst = int(np.argmin(p))
    ids, starts, counts, docs = quality_mil.laid([read[150 + worst]])
    _, h = model.encode(ids, starts, counts)
    a = model.attend(h, docs)[2]
    assert a.sum() == pytest.approx(1, abs=1e-4) and counts[int(a.argmax()), 0] > 0  # the passage with capitals


def test_gradients_are_finite_differences():
    rng = np.random.default_rng(3)
    read = [quality_mil.Reader().read(t) for t in ("a b C! d", "x Y z " * 60 + "A! 1 2 $ " * 40, "", "q " * 64)]
    y = np.array([0, 1, 1, 0])
    m = quality_mil.Model()
    m.p = {k: v.astype(np.float64) + 0.3 * rng.standard_normal(v.shape) for k, v in m.p.items()}
    _, g = m.gradients(read, y)
    assert set(g) == set(m.p)
    for k, (of, grad) in g.items():
        whole = np.zeros_like(m.p[k])
        whole[of] = grad
        used = np.argwhere(whole != 0) if k == "E" else np.argwhere(np.ones_like(whole))
        for at in map(tuple, used[rng.permutation(len(used))[:25]]):
            was, sides = m.p[k][at], []
            for step in (1e-5, -1e-5):
                m.p[k][at] = was + step
                sides.append(m.gradients(read, y)[0])
            m.p[k][at] = was
            assert whole[at] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=1e-4, abs=1e-8), (k, at)


def test_long_texts_are_read_as_short_ones(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice(["a", "Bc", "d1!", "x" * 9, "\u2003", " ", "\n", " ", "é"]) + " " * rng.randint(0, 1) for _ in range(40_000))
    whole = quality_mil.Reader().read(text)
    score = quality_mil.Model().score([whole, quality_mil.Reader().read("")])
    for size in (50, 999, 70_000):
        monkeypatch.setattr(quality_mil, "PIECE", size)
        monkeypatch.setattr(quality_mil, "BLOCK", 7)
        got = quality_mil.Reader().read(text)
        assert len(got[0]) == len(text.split()) and all((a == b).all() for a, b in zip(got, whole, strict=True))
        assert quality_mil.Model().score([got, quality_mil.Reader().read("")]) == pytest.approx(score, abs=1e-5)


def test_classifier_rows(spark):
    docs = spark.createDataFrame([(i, None if i == 5 else "" if i == 6 else ("good words here " * 30 if i % 2 else "BAD!! " * 90), "x", 1) for i in range(60)] + [(None, "t", "x", 1), (3, "again", "x", 1)], "doc_id long, text string, score string, quality int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)] + [(1, None, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality_mil.classify(docs, labels).collect()
    assert len(got) == 62
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0)
    sure = [r for r in got if r.doc_id is not None and r.doc_id > 6]
    assert np.mean([r.predicted == r.doc_id % 2 for r in sure]) > 0.95
    assert quality_mil.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality_mil.classify(docs, labels.limit(0)).collect()} == {0.5}


def folded(log):
    """The event rules, one event after the other."""
    out, seen = {}, set()
    for _, kind, message, role, text in sorted(log, key=lambda e: (e[0] is not None, e[0] or 0, chat.KINDS.index(e[1]), e[2], e[4] or "")):
        if kind == "start" or message not in seen:
            out[message] = [(role or "") if kind == "start" else "", ""]
        seen.add(message)
        if message in out:
            if kind == "regenerate":
                out[message][1] = ""
                for later in [m for m in out if m > message]:
                    del out[later]
            elif kind != "start":
                out[message][1] = (out[message][1] if kind == "delta" else "") + (text or "")
    return [(m, r, t) for m, (r, t) in sorted(out.items())]


LOG = "conv_id long, seq long, kind string, message long, role string, text string"


def fold_rows(spark, rows):
    got = collections.defaultdict(list)
    for r in chat.fold(spark.createDataFrame(rows, LOG)).collect():
        got[r.conv_id].append((r.message, r.role, r.text))
    return {k: sorted(v) for k, v in got.items()}


def test_fold_is_the_event_loop(spark):
    """Any event for any message at any time: regenerations after later starts, of dropped messages, restarts, equal and null numbers."""
    rng = random.Random(4)
    rows, want = [], {}
    for conv in range(150):
        log, n = [], rng.randint(1, 5)
        for seq in range(rng.randint(1, 16)):
            kind = rng.choice(["start", "start", "delta", "edit", "regenerate"])
            log.append((None if rng.random() < 0.03 else seq - (rng.random() < 0.2), kind, rng.randrange(n), "r" if kind == "start" else None, rng.choice(["a", "bé", "", None])))
        want[conv] = folded(log)
        rows += [(conv, *e) for e in log]
    rng.shuffle(rows)
    assert fold_rows(spark, rows) == {k: v for k, v in want.items() if v}
    with pytest.raises(Exception, match="unknown kind"):
        fold_rows(spark, [(1, 1, "shout", 0, "user", "x")])


def test_regeneration_of_a_dropped_message_drops_nothing(spark):
    log = [(1, "start", 1, "a", None), (2, "start", 2, "a", None), (3, "regenerate", 1, None, None), (4, "start", 3, "a", None), (5, "delta", 3, None, "x"), (6, "regenerate", 2, None, None)]
    assert fold_rows(spark, [(1, *e) for e in log]) == {1: folded(log)} == {1: [(1, "a", ""), (3, "a", "x")]}


def test_query_log_has_all_kinds(spark):
    rows = spark.createDataFrame([(1, 0, "user", "abc"), (1, 1, "assistant", "defg"), (1, 2, "user", ""), (2, 0, "assistant", None), (2, 0, "assistant", None)], "conv_id long, turn long, role string, text string")
    log = chat.events_of(rows).select("conv_id", "seq", "kind", "message", "role", "text")
    assert {r.kind for r in log.collect()} == set(chat.KINDS)
    got = fold_rows(spark, [tuple(r) for r in log.collect()])
    assert got == {1: [(1, "user", "abc"), (2, "assistant", "defg"), (3, "user", "")], 2: [(1, "assistant", ""), (2, "assistant", "")]}


def test_regeneration_drops_later_messages(spark):
    log = [(1, "start", 0, "user", None), (2, "delta", 0, None, "q"), (3, "start", 1, "assistant", None), (4, "delta", 1, None, "bad"), (5, "start", 2, "user", None), (6, "regenerate", 1, None, None), (7, "delta", 1, None, "good"), (8, "start", 2, "user", None), (9, "delta", 2, None, "more")]
    got = chat.fold(spark.createDataFrame([(1, *e) for e in log], "conv_id long, seq long, kind string, message long, role string, text string")).orderBy("message").collect()
    assert [(r.role, r.text) for r in got] == [("user", "q"), ("assistant", "good"), ("user", "more")]


def test_render_round_trip(spark):
    rng = random.Random(5)
    parts = ["<|im_start|>", "<|im_end|>", "<\\|im_end|>", "<|im_sep|>", "</s>", "<\\\\/s>", "[INST]", "[/INST]", "<", "[", "\\", "a", "é😀", "\n", "<<s>", "<s", "|im_end|>"]
    rows = [(c, m, rng.choice(["user", "assistant", "a\nb<|im_sep|>"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))) for c in range(60) for m in range(3)]
    out = chat.render(spark.createDataFrame(rows, "conv_id long, message long, role string, text string"))
    out = out.select("conv_id", "n_turns", "formatted", chat.turns(F.col("formatted")).alias("t"), chat.masked(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    for r in out.collect():
        own = [(role, text) for c, m, role, text in rows if c == r.conv_id]
        assert [tuple(t) for t in r.t] == own and r.n_turns == 3
        assert r.loss == "".join(text for role, text in own if role == "assistant")
        assert r.formatted.count("<|im_end|>") == 3 and "</s>" not in r.formatted and "[INST]" not in r.formatted


def test_chat_nulls(spark):
    rows = spark.createDataFrame([(None, None, None, None), (1, 0, "user", None), (1, 0, "user", None), (1, None, "system", "s")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.n_turns for r in chat.render(chat.fold(chat.events_of(rows))).collect()}
    assert got == {None: 1, 1: 3}
    assert chat.render(chat.fold(chat.events_of(rows.limit(0)))).count() == 0


def near_texts(seed=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    base = [word() for _ in range(120)]
    texts = [None, "", " \n ", "one two", "One TWO", "one two three", "x"]
    texts += [" ".join(word() for _ in range(80)) for _ in range(20)]
    for _ in range(60):  # near copies of near copies, with similarities all around the limit
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
        if rng.random() < 0.2:
            base = copy
    return texts + texts[30:40] + [texts[40].upper()]


def brute_components(texts):
    sets = {}
    for k, t in texts:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: (len(sets[k]), root(k)) for k in sets}


@pytest.mark.parametrize("block", [1024, 8])
def test_near_dedup_is_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    texts = list(enumerate(near_texts()))
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts] + [(None, "x", "y")], "doc_id long, text string, digest string")
    got = near_dedup.link(docs).collect()
    want = brute_components(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_near_dedup_empty_and_repeated_ids(spark):
    docs = spark.createDataFrame([(5, "a b c d e f g"), (5, "h i j k l m n"), (3, "h i j k l m n"), (9, "a b c d e f g")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_dedup.link(docs).collect()} == {(5, 3), (3, 3), (9, 3)}
    assert near_dedup.link(docs.limit(0)).count() == 0


def test_odd_sketch_estimates():
    from tessella.llm.shingles import MinHash, random64

    m = MinHash(near_dedup.BANDS * near_dedup.ROWS, near_dedup.SKETCH_BITS)
    pool = random64(77, 4000)
    errors = []
    for k in range(40):
        a, b = np.unique(pool[k : k + 900]), np.unique(pool[k + 90 : k + 990])  # similarity 810 / 990
        x, y = m.odd_sketch(m.minima(a)), m.odd_sketch(m.minima(b))
        errors.append(float(m.estimate(int(np.unpackbits(x ^ y).sum()))) - 810 / 990)
    assert abs(np.mean(errors)) < 0.02 and max(map(abs, errors)) < near_dedup.SLACK


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(None, 1), (5, 5)]
    parent = list(range(500))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: root(k) for e in edges if e[0] is not None and e[0] != e[1] for k in e}


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 60))), f"s{rng.randint(0, 3)}" if i % 50 else None, "x") for i in range(900)]
    rows += [(None, "a b c", "s1", "x")] * 3 + [(1, None, "tiny", "y"), (2, "a", "tiny", "z"), rows[5], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string")
    got = mixing.decide(docs, block=16).collect()
    assert len(got) == len(rows)
    size, taken = collections.Counter(), collections.Counter()
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
    names = sorted(s for s in size if s is not None) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), sum(size.values())
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * size[s]
            free.discard(s)
        rest = sum(size.values()) - sum(target[s] for s in target if s not in free)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source]
    assert all(abs(taken[s] - target[s]) <= 60 for s in names)
    again = sorted(map(str, mixing.decide(docs.repartition(7), block=16).collect()))
    assert again == sorted(map(str, got))
    mixed = mixing.mix(docs, block=16)
    assert mixed.columns == docs.columns
    words = collections.Counter()
    for r in mixed.collect():
        words[r.source] += len(WORD.findall(r.text or ""))
    assert all(abs(words[s] - target[s]) <= 60 for s in names)
    assert mixing.decide(docs.limit(0)).count() == 0


def test_rounding_keeps_expectations(spark):
    docs = spark.createDataFrame([(i, "a " * (1 + i % 5), "s0" if i < 300 else "s1") for i in range(600)], "doc_id long, text string, source string")
    counts = collections.Counter()
    for seed in range(6):
        for r in mixing.decide(docs, seed=seed, block=32).collect():
            counts[(r.source, r.size)] += r.copies
    plan = {r.source: r.target / r.source_size for r in mixing.decide(docs).collect()}
    for (source, _), n in counts.items():
        assert n / (6 * 60) == pytest.approx(plan[source], abs=0.12)


def base_counts(text):
    w = WORD.findall(text)
    seen = collections.defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    marked = {k for v in seen.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked)


def test_quality_rules(spark):
    rng = random.Random(9)
    texts = [None, "", "\n\n", "a\u00a0b c\x0bd", "x " * 30, ("q r s t u v w x y\n" * 5) + "z"]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 80))) for _ in range(40)]
    texts += ["\n".join(rng.choice(["a b", "c", "", "#$ %"]) for _ in range(12)) for _ in range(10)]
    common = "this very line stands in all documents of the host"
    texts += [f"{common}\n" + (" ".join(f"{i}-{k}" for k in range(60 if i % 2 else 12))) for i in range(60)]
    docs = spark.createDataFrame([(i, t, None if i < 5 else "h", "x") for i, t in enumerate(texts + texts[:3])], "doc_id long, text string, source string, kept string")
    got = line_rules.judge(docs, most_docs=20, least_kept=0.6).collect()
    assert len(got) == len(texts) + 3
    for r in got:
        want = base_counts(r.text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.text
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        held = common in (r.text or "")
        assert r.n_kept_words == want[0] - 10 * held and common not in r.cleaned_text
        assert r.kept == (not r.base_failed and r.n_kept_words >= 0.6 * want[0])
    assert line_rules.judge(docs.limit(0)).count() == 0


def test_copies_of_a_document_are_one_document(spark):
    docs = spark.createDataFrame([(i, "one two three four five six seven eight nine ten " * 1 + "eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty more", "h") for i in range(50)], "doc_id long, text string, source string")
    assert all(r.kept for r in line_rules.judge(docs).collect())


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.run(spark, DATA).collect()
    assert out and {r.doc_id for r in out} <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert all(n == s.__name__ for n, s in corpus_pipeline.STAGES)
    kept = near_dedup.link(docs.join(spark.createDataFrame([(r.doc_id,) for r in out], "doc_id long").distinct(), "doc_id", "left_semi"))
    assert all(r.kept for r in kept.collect())
    assert hashlib.sha256(b"").hexdigest() not in {r.decoded_sha256 for r in out}


def test_pipeline_is_its_stages_recomputed(spark, tmp_path, monkeypatch):
    """All five stages in plain Python, with the classifier's scores and the mix's draws given."""
    import corpus_pipeline
    import sentencepiece
    from tessella.llm.queries import vocabulary

    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(500)]
    fresh = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    line = "this very line stands in most documents of the first host"
    texts = [f"{line}\n{fresh(rng.randint(25, 60))}" for _ in range(60)] + [f"{line}\n{fresh(4)}" for _ in range(8)] + [fresh(rng.randint(25, 60)) for _ in range(60)]
    texts += [fresh(5), "", None, "same " * 40] + [t + " tail" for t in texts[:6]] + [texts[70], texts[70]]
    rows = [(i, t, "en", "one" if t and line in t else "two", 0 if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    predicted = lambda d: (F.col("doc_id") % 7 != 3).cast("int")
    monkeypatch.setattr(quality_mil, "classify", lambda docs, labels: docs.withColumn("predicted", predicted(docs)))
    drawn = {}

    def mixed(docs):
        drawn["docs"] = sorted((r.doc_id, r.text, r.source) for r in docs.collect())
        out = mix(docs)
        drawn["copies"] = collections.Counter(r.doc_id for r in out.collect())
        return out

    mix = mixing.mix
    monkeypatch.setattr(mixing, "mix", mixed)
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256").collect()]

    docs = [(i, t or "", s) for i, t, _, s, _ in rows if i % 7 != 3]
    holders = collections.defaultdict(set)
    for _, t, s in docs:
        for x in t.split("\n"):
            if WORD.search(x):
                holders[s, " ".join(x.lower().split())].add(t)
    above = {k for k, v in holders.items() if len(v) > 20}
    assert above == {("one", line)}
    kept = []
    for i, t, s in docs:
        rest = "\n".join(x for x in t.split("\n") if (s, " ".join(x.lower().split())) not in above)
        n, _, _, _, repeated = base_counts(t)
        if n >= 20 and 100 * repeated <= 30 * n and len(WORD.findall(rest)) >= 0.3 * n:
            kept.append((i, rest, s))
    first = brute_components([(i, t) for i, t, _ in kept])
    kept = [x for x in kept if first[x[0]][1] == x[0]]
    assert len(docs) > len(kept) > 80 and drawn["docs"] == sorted(kept)

    size = collections.Counter()
    for _, t, s in kept:
        size[s] += len(WORD.findall(t))
    target, total = {}, sum(size.values())
    for s, w in (("one", 1), ("two", 2)):
        target[s] = total * w / 3
    assert all(target[s] <= 3 * size[s] for s in size)
    words = collections.Counter()
    for i, t, s in kept:
        rate = target[s] / size[s]
        assert int(rate) <= drawn["copies"][i] <= int(rate) + 1
        words[s] += drawn["copies"][i] * len(WORD.findall(t))
    assert all(abs(words[s] - target[s]) <= 61 for s in size)

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    want = []
    for i, t, s in kept:
        ids = library.encode(t)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want += [(i, s, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))] * drawn["copies"][i]
    assert collections.Counter(got) == collections.Counter(want)
