"""The registered queries over whole tables: against their SQL where there is some, against plain Python elsewhere; and odd tables."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import chat, line_rules, media, mixing, near_dedup, quality_mil, queries, sentencepiece_codec, url_filter, warc
from tessella.llm.oracles import ORACLES
from tessella.llm.queries import QUERIES, vocabulary

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MORE = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = ("documents", "pages", "conversations", "labels", "embeddings")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def read(name, folder=DATA):
    con = duckdb.connect()
    rows = con.execute(f"SELECT * FROM read_parquet('{folder}/{name}.parquet')").fetchall()
    return [dict(zip([c[0] for c in con.description], r, strict=True)) for r in rows]


def by_id(spark, name, folder=DATA):
    got = QUERIES[name](spark, folder).collect()
    assert len({r.doc_id for r in got}) == len(got)
    return {r.doc_id: r for r in got}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    want = want.fetchall()
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns) and len(want) > 0
    assert collections.Counter(map(tuple, got.select(*columns).collect())) == collections.Counter(want)


def test_op1_is_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    got, docs = by_id(spark, "op1_sentencepiece"), read("documents")
    assert len(got) == len(docs)
    for d in docs:
        ids = sp.encode(d["text"] or "")
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        r = got[d["doc_id"]]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(sp.decode(ids)))


def plain_hash(pixels):
    """The cosine hash by its definition: cell means, the transform's sum term by term, the median of all but the first."""
    h, w = pixels.shape
    bounds = lambda n: [(k * n // 32, max((k + 1) * n // 32, k * n // 32 + 1)) for k in range(32)]
    small = np.array([[pixels[a:b, c:d].mean() for c, d in bounds(w)] for a, b in bounds(h)])
    angle = lambda k: np.array([math.cos(math.pi * k * (2 * x + 1) / 64) for x in range(32)])
    low = [round(float((np.outer(angle(u), angle(v)) * small).sum()), 6) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    return f"{int(''.join(str(int(x > middle)) for x in low), 2):016x}"


def test_op3_is_plain_python(spark):
    got, docs = by_id(spark, "op3_media"), read("documents")
    assert len(got) == len(docs)
    for d in docs:
        raw = (d["text"] or "").encode()
        padded, r = raw + bytes(-len(raw) % 64 if raw else 64), got[d["doc_id"]]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        pixels = np.frombuffer(padded, np.uint8).reshape(-1, 64)
        image = media.encode_png(pixels)
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
        close = bin(int(r.feature, 16) ^ int(plain_hash(pixels), 16)).count("1")
        assert close <= (len(padded) == 64), d["doc_id"]  # a coefficient of 0 up to rounding may fall on either side


def plain_score(model, text):
    """The network word by word and passage by passage."""
    p = {k: v.astype(float) for k, v in model.p.items()}
    ids, starts, counts = quality_mil.Reader().read(text)
    h = []
    for k, at in enumerate(starts):
        own = ids[at : at + 64]
        mean = sum(p["E"][i] for i in own) / len(own) if len(own) else np.zeros(quality_mil.WORD_SIZE)
        h.append(np.tanh(np.concatenate([mean, (counts[k] - model.mean) / model.scale]) @ p["W"] + p["b"]))
    e = [math.exp(sum(w * math.tanh(a) / (1 + math.exp(-b)) for w, a, b in zip(p["w"], x @ p["V"], x @ p["U"], strict=True))) for x in h]
    z = sum(x * a for x, a in zip(h, e, strict=True)) / sum(e)
    return 1 / (1 + math.exp(-(z @ p["c"] + p["d"][0])))


def test_op4_is_the_network(spark):
    got, docs = by_id(spark, "op4_quality", MORE), read("documents", MORE)
    labels = {x["doc_id"]: x["quality"] for x in read("labels", MORE)}
    assert len(got) == len(docs)
    table = lambda name: spark.read.parquet(f"{MORE}/{name}.parquet")
    model = quality_mil.train(table("documents"), table("labels"))
    right = []
    for d in docs:
        r = got[d["doc_id"]]
        assert r.held_out == (zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)
        assert r.score == pytest.approx(plain_score(model, d["text"] or ""), abs=2e-4)
        if r.held_out and labels.get(d["doc_id"]) is not None:
            right.append(r.predicted == labels[d["doc_id"]])
    assert len(right) > 40 and np.mean(right) > 0.9


def test_op4_sample_takes_all_lengths_and_one_row_a_key(spark):
    texts = ["good words"] * 20 + ["word " * 50_000] * 5
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 3 + [(1, "a second text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(25)], "doc_id long, quality int")
    got = quality_mil.sample(docs, labels).collect()
    learned = {i for i in range(25) if zlib.crc32(str(i).encode()) % 5}
    assert len(got) == len(learned) and {r.key_ for r in got} == learned
    assert {r.text for r in got if r.key_ == 1} <= {"a second text"} and any(len(r.text) == 250_000 for r in got)
    assert quality_mil.sample(docs, labels, most_rows=7).count() == 7


def plain_targets(docs):
    size = collections.Counter()
    for d in docs:
        size[d["source"]] += len(WORD.findall(d["text"] or ""))
    names = sorted(s for s in size if s is not None) + [None] * (None in size)
    weight, target, free = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}, {}, set(names)
    while True:
        rest = sum(size.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            return size, target | share
        target |= {s: 3 * size[s] for s in over}
        free -= set(over)


def test_op8_targets_and_rows(spark):
    got, docs = by_id(spark, "op8_mixing", MORE), read("documents", MORE)
    size, target = plain_targets(docs)
    taken, longest = collections.Counter(), collections.Counter()
    for d in docs:
        r, n = got[d["doc_id"]], len(WORD.findall(d["text"] or ""))
        assert (r.size, r.source_size) == (n, size[d["source"]]) and r.target == pytest.approx(target[d["source"]])
        rate = target[d["source"]] / size[d["source"]]
        assert r.taken in {math.floor(rate + 1e-9) * n, math.ceil(rate - 1e-9) * n} and r.taken <= 3 * n
        taken[d["source"]] += r.taken
        longest[d["source"]] = max(longest[d["source"]], n)
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in size)


def test_op8_step_is_plain_python(spark):
    rng = random.Random(10)
    blocks = [[(k, rng.choice([1, 3, 7, 50]), rng.choice([0.25, 0.5, rng.random()]), rng.random()) for k in range(rng.randint(1, 12))] for _ in range(40)]

    def steps(items):
        held, done = None, {}
        for row, size, p, u in items:
            if held is None:
                held = (row, size, p)
                continue
            up, down = min(1 - held[2], p * size / held[1]), min(held[2], (1 - p) * size / held[1])
            move = up if u * (up + down) < down else -down
            a, b = held[2] + move, p - move * held[1] / size
            whole = lambda x: min(x, 1 - x)
            ends = [(whole(a), held[:2], a), (whole(b), (row, size), b)]
            if all(e[0] < 1e-9 for e in ends):
                done |= {x[0]: round(q) for _, x, q in ends}
                held = None
            else:
                (_, x, q), (_, y, r) = (ends[0], ends[1]) if ends[0][0] < ends[1][0] else (ends[1], ends[0])
                done[x[0]], held = round(q), (*y, r)
        return held, done

    rows = spark.createDataFrame([(i, [((k,), n, p, u) for k, n, p, u in b]) for i, b in enumerate(blocks)], "i int, items array<struct<row: struct<k: int>, size: bigint, p: double, u: double>>")
    for r in rows.withColumn("s", F.expr(mixing.STEP.format(row="struct<k:int>"))).collect():
        held, done = steps(blocks[r.i])
        assert {x.row.k: x.taken for x in r.s.done} == done
        assert (r.s.held is None) == (held is None)
        assert held is None or (r.s.held.row.k, r.s.held.size, r.s.held.p) == (held[0], held[1], pytest.approx(held[2]))


def test_op9_is_the_library(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got, start = by_id(spark, "op9_token_files"), 0
    docs = sorted(read("documents"), key=lambda d: d["doc_id"])
    assert len(got) == len(docs)
    for d in docs:
        ids, r = [*tk.encode(d["text"] or "", add_special_tokens=False).ids, 0], got[d["doc_id"]]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


#: Names that operators use on the way or add, for columns that a table brings along.
CLASH = ["best", "start", "host", "lines", "lines_", "lost", "key", "key_", "here", "n", "n_", "first", "salt_", "digest", "digest_", "counts", "nth", "made", "size", "source_size", "kept", "label", "score", "id", "u", "c", "text_", "Score_", "a.b"]


def clashing(docs):
    return docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])


@pytest.mark.parametrize("name", ["encode", "warc", "media", "quality", "url", "mix", "rules"])
def test_clashing_columns_stay(spark, tmp_path, name):
    docs = clashing(spark.createDataFrame([(1, "a b c " * 30, "s"), (2, None, None), (2, None, None), (None, "x\n" * 4, "s")], "doc_id long, text string, source string"))
    pages = clashing(spark.createDataFrame([(1, "http://a.com/en/", "p" * 200), (2, None, "p" * 200)], "page_id long, url string, html string"))
    labels = clashing(spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    made = {
        "encode": lambda: sentencepiece_codec.round_trip(docs, vocabulary("piece_bpe_32k.model")),
        "warc": lambda: warc.decided(pages),
        "media": lambda: media.features(media.store(docs)),
        "quality": lambda: quality_mil.classify(docs, labels),
        "url": lambda: url_filter.judge(pages, url_filter.rule_table(spark)),
        "mix": lambda: mixing.mix(docs),
        "rules": lambda: line_rules.judge(docs),
    }[name]()
    replaced = {"quality": {"score"}, "url": {"host"}, "rules": {"kept"}}.get(name, set())
    source = pages if name in ("warc", "url") else docs
    assert set(source.columns) <= set(made.columns)
    rows = made.collect()
    assert name == "mix" or len(rows) == source.count()
    assert all(r[c] == k for r in rows for k, c in enumerate(CLASH) if c not in replaced)


def test_operators_that_name_their_columns(spark):
    """Near-dedup, mixing decisions and chat return the columns that they say, whatever the table brings along."""
    docs = clashing(spark.createDataFrame([(1, "a b c", "s"), (2, None, None)], "doc_id long, text string, source string"))
    assert near_dedup.link(docs).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert mixing.decide(docs).columns == ["doc_id", "source", "nth", "size", "source_size", "target", "copies", "taken"]
    turns = clashing(spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string"))
    assert chat.render(chat.fold(chat.events_of(turns))).columns == ["conv_id", "n_turns", "formatted", "loss_spans"]


def test_long_texts(spark):
    """Two megabytes in one text: near-dedup and rules agree with plain Python."""
    rng = random.Random(11)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(900)) for _ in range(250_000))
    near = long.split(" ")
    near[1000:1010] = ["other"] * 10
    docs = spark.createDataFrame([(1, long, "s"), (2, " ".join(near), "s"), (3, "short text", "s")], "doc_id long, text string, source string")
    words = long.split()
    got = {r.doc_id: r for r in near_dedup.link(docs).collect()}
    assert got[1].n_shingles == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    assert (got[1].component_id, got[2].component_id, got[3].component_id) == (1, 1, 3)
    r = line_rules.judge(docs).where("doc_id = 1").first()
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (250_000, len(marked), 0)


@pytest.fixture(scope="module")
def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", ["quality_classifier", "quality_rules", "near_duplicates", "source_mixing", "sentencepiece"])
def test_pipeline_stage_on_odd_tables(spark, tmp_path, stages, name):
    spark.createDataFrame([(i, i % 2, 0) for i in range(8)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    fresh = lambda k: " ".join(f"w{k}-{j}" for j in range(40))
    rows = [(i, fresh(i), "en", "s", 1) for i in range(12)] + [(20, None, None, None, None), (21, "", "en", "s", 0), (None, fresh(99), None, None, None), (3, fresh(3), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = stages[name](spark, docs, str(tmp_path))
    got = out.collect()
    assert got and {r.doc_id for r in got} <= {r[0] for r in rows}
    if name != "sentencepiece":
        assert out.columns == docs.columns
        texts = {(r[0], r[1]) for r in rows}
        assert name == "quality_rules" or {(r.doc_id, r.text) for r in got} <= texts
    if name == "near_duplicates":
        assert len(got) == len(rows)  # repeated rows of one id are one document; texts without words are no copies
    assert stages[name](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_queries_are_registered():
    assert [int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES] == list(range(1, 11)) and queries.ORACLES is ORACLES
