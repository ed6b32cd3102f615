"""Round trips and brute-force comparisons of tokenizers, media, archives and URL rules."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import files, media, sentencepiece_codec, token_files, url_filter, warc
from tessella.llm.queries import vocabulary

ODD = [None, "", " ", "  a  b ", "x", "a\n\nb\tc", "▁x ▁▁ y", "ﬁ① 😀é́ 汉字", "\x00a", "<s>a</s> <0x41>", "word " * 3000, "z" * 5000, "x", "x"]


def documents(spark, texts=ODD):
    return spark.createDataFrame([(None if i == 3 else i // 2, t, "c", "clash") for i, t in enumerate(texts)], "doc_id long, text string, N_Tokens string, digest string")


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.Codec(sentencepiece_codec.read_model(vocabulary("piece_bpe_32k.model")))


def test_codec_is_the_library(codec):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    rng = random.Random(3)
    parts = ["a", "b", " ", " ", "  ", "\n", "\t", "▁", "é", "the", "ing", "ﬁ", "①", "😀", "<s>", "\x00", "x" * 30, "____", "́", "汉字", "1234", "'s", "².", "THE"]
    for text in [t or "" for t in ODD] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)]:
        ids = codec.encode(text)
        assert ids == sp.encode(text), text
        assert codec.decode(ids) == sp.decode(ids), text
    for _ in range(500):
        ids = [rng.choice([*range(320), 28705, 31999]) for _ in range(rng.randint(0, 8))]
        assert codec.decode(ids) == sp.decode(ids), ids


def test_long_texts_are_encoded_in_pieces(codec, monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    rng = random.Random(8)
    text = " ".join(rng.choice(["the", "thing", "été\n", "x" * 70, "1234", "汉字"]) for _ in range(300_000))
    want = sp.encode(text)
    assert codec.encode(text) == want
    monkeypatch.setattr(sentencepiece_codec, "PIECE", 1000)
    assert codec.encode(text) == want


def test_other_models_are_refused(monkeypatch):
    import sentencepiece

    class Other(sentencepiece.SentencePieceProcessor):
        def encode(self, text, **options):  # as a normaliser would
            return super().encode(text.replace("ﬁ", "fi"), **options)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Other)
    with pytest.raises(ValueError, match="supported kind"):
        sentencepiece_codec.Codec(sentencepiece_codec.read_model(vocabulary("piece_bpe_32k.model")))


def test_backtracking_steps_back():
    """A toy vocabulary where the longest first piece leads nowhere."""
    c = object.__new__(sentencepiece_codec.Codec)
    import ahocorasick

    scores = {"a": -9.0, "b": -9.0, "c": -9.0, "bc": -1.0, "ab": -2.0, "abc": -5.0}
    c.memory, c.fits, c.scores, c.ids = 99, {}, scores, {p: i for i, p in enumerate(scores)}
    c.texts, c.foreign = {i: p for p, i in c.ids.items()}, len(scores)
    c.length = [len(p) for p in scores] + [1]
    c.automaton = ahocorasick.Automaton()
    for p, i in c.ids.items():
        c.automaton.add_word(p, i)
    c.automaton.make_automaton()
    c.shorter = [next((c.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in c.ids), -1) for p in scores] + [-1]
    for text in ("abc", "abbc", "abab", "bcab", "aabbcc", "abcx", "xabc"):
        assert [c.texts.get(i, "x") for i in c.segment(text)] == c.merged(text), text


def test_round_trip_rows(spark, codec):
    got = sentencepiece_codec.round_trip(documents(spark), vocabulary("piece_bpe_32k.model"))
    assert set(got.columns) == {"doc_id", "text", "digest", "n_tokens", "ids_sha256", "decoded_sha256"} and got.count() == len(ODD)
    for r in got.collect():
        ids = codec.encode(r.text or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    both = sentencepiece_codec.decode(sentencepiece_codec.encode(documents(spark), vocabulary("piece_bpe_32k.model")), vocabulary("piece_bpe_32k.model"))
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in both.collect())
    assert sentencepiece_codec.round_trip(documents(spark).limit(0), vocabulary("piece_bpe_32k.model")).count() == 0


def test_png():
    rng = np.random.default_rng(1)
    for shape in ((1, 64), (70, 64), (33, 7), (1, 1)):
        pixels = rng.integers(0, 256, shape).astype(np.uint8)
        for p in (pixels, np.sort(pixels, axis=0), np.sort(pixels, axis=1)):
            data = media.encode_png(p)
            assert (media.decode_png(data) == p).all()
    with pytest.raises(ValueError, match="checksum"):
        media.decode_png(data[:40] + bytes([data[40] ^ 1]) + data[41:])
    with pytest.raises(ValueError):
        media.decode_png(data[:-12])


def test_all_row_filters():
    rng = np.random.default_rng(2)
    pixels = rng.integers(0, 256, (25, 9)).astype(np.int64)
    kinds = np.array([k % 5 for k in range(25)][::-1], dtype=np.uint8)
    rows = np.zeros_like(pixels)
    for y in range(25):
        for x in range(9):
            a, b, c = pixels[y, x - 1] if x else 0, pixels[y - 1, x] if y else 0, pixels[y - 1, x - 1] if x and y else 0
            p = a + b - c
            paeth = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            rows[y, x] = (pixels[y, x] - (0, a, b, (a + b) // 2, paeth)[kinds[y]]) % 256
    assert (media.unfiltered(kinds, rows.astype(np.uint8)) == pixels).all()


def test_media_table(spark):
    got = media.features(media.store(documents(spark)))
    for r in got.collect():
        raw = (r.text or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert len(r.media) == r.media_bytes and hashlib.sha256(bytes(r.media)).hexdigest() == r.media_sha256
    assert len({r.feature for r in got.where("text = 'x'").collect()}) == 1


def test_cosine_hash_is_near_for_near_images():
    rng = np.random.default_rng(5)
    a, other = (np.kron(rng.integers(0, 256, (8, 8)), np.ones((8, 8))).astype(np.uint8) for _ in range(2))
    b = np.clip(a.astype(int) + np.random.default_rng(1).integers(-3, 4, a.shape), 0, 255).astype(np.uint8)
    distance = lambda p, q: bin(int.from_bytes(p, "big") ^ int.from_bytes(q, "big")).count("1")
    assert distance(media.cosine_hash(a), media.cosine_hash(b)) <= 8 < 16 < distance(media.cosine_hash(a), media.cosine_hash(other))


PAGES = [(1, "http://a/", "p" * 200), (2, "http://b/", "p" * 200), (2, "http://b/", "p" * 200), (3, None, "short"), (4, "u", "short"), (5, "u\nv", None), (None, "u", "q" * 300), (None, "u", "p" * 200), (7, "é", "ü" * 60000)]


@pytest.mark.parametrize("split", [1, 97, 1 << 20])
def test_warc_splits(spark, tmp_path, split):
    pages = spark.createDataFrame([(k, u, h, "x") for k, u, h in PAGES], "page_id long, url string, html string, record_type string").repartition(2)
    archives = warc.write(pages, f"file://{tmp_path}/w")
    rows = warc.read(spark, archives, split).collect() if split > 1 else [r for r in warc.read(spark, archives, 64).collect()]
    assert len(rows) == len(PAGES) and len({(r.file, r.offset) for r in rows}) == len(PAGES)
    kinds = sorted((r.record_id.removeprefix("urn:page:"), r.record_type, (r.refers_to_id or "").removeprefix("urn:page:")) for r in rows)
    assert kinds == [("", "response", ""), ("", "revisit", "1"), ("1", "response", ""), ("2", "revisit", "1"), ("2", "revisit", "1"), ("3", "response", ""), ("4", "response", ""), ("5", "response", ""), ("7", "response", "")]
    for r in rows:
        key = r.record_id.removeprefix("urn:page:")
        bodies = [(h or "").encode() for k, _, h in PAGES if str(k if k is not None else "") == key]
        assert r.payload_digest in {hashlib.sha256(b).hexdigest() for b in bodies} and r.payload_bytes in {len(b) for b in bodies}
        assert r.record_type == "revisit" or bytes(r.payload) in bodies


def test_warc_reads_other_members_and_skips_false_magic(tmp_path):
    inner = warc.member(warc.record("response", "urn:x", None, "u", "d", "0", b"<\x1f\x8b\x08 no member>", 20))
    noise = b"\x1f\x8b\x08 not gzip" + zlib.compress(b"x")
    plain = zlib.compressobj(0, zlib.DEFLATED, 31)
    stored = plain.compress(b"WARC/1.1\r\nbroken") + plain.flush()
    path = tmp_path / "a.warc.gz"
    path.write_bytes(noise + inner + stored + inner)
    with open(path, "rb") as f:
        got = list(warc.records(f, 0, path.stat().st_size))
    assert [at for at, _, _ in got] == [len(noise), len(noise + inner + stored)]


def one_record(k, body, level=6):
    return warc.member(warc.record("response", f"urn:{k}", None, "u", "d", hashlib.sha256(body).hexdigest(), body, len(body)), level)


def read_at_all_splits(spark, path, steps):
    """Records of one file, which must be the same for all split sizes."""
    size = path.stat().st_size
    with open(path, "rb") as f:
        whole = [(at, x["warc-record-id"].strip("<>")) for at, _, x in warc.records(f, 0, size)]
    for step in steps:
        got = warc.read(spark, [(f"file://{path}", size)], step, payloads=False).collect()
        assert sorted((r.offset, r.record_id) for r in got) == whole
    return [k for _, k in whole]


def test_warc_members_inside_stored_members(spark, tmp_path):
    """Splits that start inside a payload don't take what it holds for records, and all split sizes agree."""
    rng = random.Random(6)
    small = lambda k: one_record(k, rng.randbytes(rng.randint(0, 400)))
    outer = lambda k: one_record(k, b"x" * 3000 + b"".join(small(f"no-{j}") for j in range(3)) + b"y" * 2000, 0)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(outer(k) if k % 3 == 1 else small(k) for k in range(40)))
    assert read_at_all_splits(spark, path, (1000, 3500, 20000)) == [f"urn:{k}" for k in range(40)]


@pytest.mark.parametrize("n", [20, 200])
def test_warc_archive_inside_a_record(spark, tmp_path, n):
    inner = b"".join(one_record(f"no-{j}", bytes([j]) * 300) for j in range(n))
    path = tmp_path / "a.warc.gz"
    path.write_bytes(one_record(1, b"first") + one_record(2, inner, 0) + one_record(3, b"last"))
    assert read_at_all_splits(spark, path, (1000, len(inner) // 2, 1 << 20)) == ["urn:1", "urn:2", "urn:3"]


def test_warc_damage_costs_one_record(spark, tmp_path):
    rng = random.Random(8)
    members = [one_record(k, rng.randbytes(rng.randint(200, 900))) for k in range(60)]
    bad = bytearray(members[40])
    bad[len(bad) // 2] ^= 4
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join([*members[:40], bytes(bad), *members[41:]]))
    size = path.stat().st_size
    assert read_at_all_splits(spark, path, (1 << 10, 1 << 12, size // 2, size - 1, size)) == [f"urn:{k}" for k in range(60) if k != 40]


def test_warc_wrong_digest_is_an_error(spark, tmp_path):
    path = tmp_path / "a.warc.gz"
    path.write_bytes(warc.member(warc.record("response", "urn:1", None, "u", "d", "0" * 64, b"body", 4)))
    with pytest.raises(Exception, match="payload digest"):
        warc.read(spark, [(f"file://{path}", path.stat().st_size)]).collect()


def test_warc_writes_beside_clashing_columns(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "p" * 200, "k", "b", 7), (2, "v", "p" * 200, "r", "u", 8)], "page_id long, url string, html string, k string, b string, payload_bytes int")
    got = warc.read(spark, warc.write(pages, f"file://{tmp_path}/w")).collect()
    assert sorted((r.record_id, r.record_type, r.payload_bytes) for r in got) == [("urn:page:1", "response", 200), ("urn:page:2", "revisit", 200)]


def test_warc_long_member(tmp_path):
    body = random.Random(7).randbytes(24 << 20)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(warc.member(warc.record("response", "urn:x", None, "u", "d", "0", body, len(body)), level=1))
    with open(path, "rb") as f:
        assert [x["block"].endswith(body) for _, _, x in warc.records(f, 0, path.stat().st_size)] == [True]


def test_warc_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write(pages, f"file://{tmp_path}/w") == [] and warc.read(spark, []).count() == 0


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    texts = [t or "" for t in ODD] + ["a  b", " a", "b ", "a\n b", "it's 5pm.", "tab\there"] * 3
    docs = documents(spark, texts).repartition(3)
    made = token_files.write(docs, f"file://{tmp_path}/t", vocabulary("byte_bpe_50k.json"), length=16)
    got = token_files.read(spark, made, with_ids=True).orderBy("start").collect()
    want = sorted(([None if i == 3 else i // 2, [*tk.encode(t, add_special_tokens=False).ids, 0]] for i, t in enumerate(texts)), key=str)
    assert sorted(([r.doc_id, r.ids] for r in got), key=str) == want
    assert [r.doc_id is None for r in got][0] and [r.doc_id for r in got][1:] == sorted(r.doc_id for r in got if r.doc_id is not None)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        at += r.n_tokens


@pytest.mark.parametrize("text", ["<|endoftext|>", "x <|endoftext|> y", "<|endoftext|>a b", "a b<|endoftext|>", "<|endoftext|", "a <|endoftext|><|endoftext|>\n b <|endoftext |>"])
def test_special_strings_are_the_library_s(text):
    from tokenizers import Tokenizer

    with open(vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        c = token_files.WordCache(f.read())
    tk = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for _ in range(2):  # the second time from its tables
        assert [np.frombuffer(x, "<u4").tolist() for x in c.encode([text, "plain words here", text])] == [tk.encode(t, add_special_tokens=False).ids for t in (text, "plain words here", text)]


def test_token_file_layout(spark, tmp_path):
    import pyarrow as pa

    made = token_files.write(documents(spark, ["a b c"] * 30), f"file://{tmp_path}/t", vocabulary("byte_bpe_50k.json"), length=8)
    name = made[0][0]
    with files.mapped(name) as source:
        f = pa.ipc.open_file(source)
        before = pa.total_allocated_bytes()
        batch = f.get_batch(0)
        assert pa.total_allocated_bytes() == before  # mapped, not copied
        assert batch.schema.field("tokens").type.list_size == 8
        assert sum(np.asarray(batch.column("ends").flatten().to_numpy(zero_copy_only=False))) == made[0][1] and batch.column("filled").flatten().to_numpy(zero_copy_only=False).sum() == made[0][2]


def test_token_files_empty(spark, tmp_path):
    assert token_files.write(documents(spark, []), f"file://{tmp_path}/t", vocabulary("byte_bpe_50k.json")) == [] and token_files.read(spark, []).count() == 0


URLS = ["https://Example.com/en/7?x", "http://m.example.com/en/75", "https://a.b.example.com/en/8", "https://example.org/es", "https://x.org/es/1#/y", "no scheme.com/en/", None, "", "http://", "http://com/en/", "http://notcom/en/", "http://xexample.net/de/8", "HTTP://A.EXAMPLE.NET/de/8/", "a://b://com/en/", "http://x.com?/en/", "http://É.com/en/é", "http://x.com:80/en/"]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + URLS)], "page_id long, url string, Verdict string")
    got = url_filter.judge(pages, url_filter.rule_table(spark)).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        u = r.url or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *(max(fits)[1:] if fits else (None, "allow"))), u


def test_url_rules_clashing_names_and_letters(spark):
    pages = spark.createDataFrame([(1, "http://É.com/x", 1, 2, 3, 4, 5), (2, "http://É.COM/x", 1, 2, 3, 4, 5), (3, "http://é.com/x", 1, 2, 3, 4, 5)], "page_id long, url string, best int, host_ int, start int, salt_ int, `n.n` int")
    rules = spark.createDataFrame([("É.COM", "/", "block"), (None, "/", "block"), ("", None, "block")], "host string, path string, verdict string")
    got = url_filter.judge(pages, rules)
    assert got.columns == [*pages.columns, "host", "path", "rule", "verdict"]
    assert {(r.page_id, r.rule, r.verdict, r.best, r.salt_) for r in got.collect()} == {(1, "É.com/", "block", 1, 4), (2, "É.com/", "block", 1, 4), (3, None, "allow", 1, 4)}


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    from tessella.llm import common

    monkeypatch.setattr(common, "PARTS", 8)
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(600)] + [(None, 1)], "k long, v long")
    counts = rows.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = common.hot_keys(counts, ["k"])
    assert {r.k: r.salts_ for r in hot.collect()} == {1: 6}
    side = counts.select("k", F.col("n").alias("w"))
    for how, n in (("inner", 600), ("left", 601), ("left_semi", 600)):
        got = common.even_join(rows, side, ["k"], hot, how)
        assert got.columns == ["k", "v", "w"][: 3 if how != "left_semi" else 2] and got.count() == n
    assert common.hot_keys(counts.limit(0), ["k"]).count() == 0


def test_url_rules_without_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [r.verdict for r in url_filter.judge(pages, none).collect()] == ["allow"]
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark)).count() == 0


def test_url_rules_are_the_contracts(spark):
    """Each rule's word, from the contract's list and not from the code's."""
    want = {"http://x.com/en/1": "block", "http://example.com/en/7": "allow", "http://x.net/de/1": "allow", "http://example.net/de/8": "block", "http://a.example.net/de/9": "allow", "http://x.org/es/1": "block", "http://x.net/en/1": "allow"}
    pages = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    assert {r.url: r.verdict for r in url_filter.judge(pages, url_filter.rule_table(spark)).collect()} == want


def test_workers_hold_one_codec_until_other_tasks_come():
    from tessella.llm import common

    made = []
    one = common.held("a", lambda: made.append(1) or object())
    assert common.held("a", lambda: made.append(1) or object()) is one and made == [1]
    common.let_go()
    assert common.held("a", lambda: made.append(1) or object()) is not one and made == [1, 1]
    common.let_go()
