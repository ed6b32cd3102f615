"""WARC archives: a writer with one gzip member a record, and a splittable reader.

The reader's tasks take byte ranges of files. A task searches its range for the gzip magic, holds a
place for a record if the member there inflates to a WARC record, and goes on from its end. It owns
the records that start in its range and reads past its end to finish the last. What it takes for its
first record may lie inside a record that starts before its range (an archive stored in another's
payload); so each task also tells where its first record starts and where its last ends. By
file these are stitched: a range's records are right if the range before ends no later than its
first one starts; else, the range is read again from where that ended. So records don't
depend on where ranges are cut: they are those of one range that holds the whole file.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common, files

MAGIC = b"\x1f\x8b\x08"  # fixed by the format
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed by the format
LEAST_PAYLOAD = 100
SCHEMA = "file string, offset long, record_type string, record_id string, refers_to_id string, target_uri string, payload_digest string, payload_bytes long, payload binary"


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member, the same for the same bytes (no time stamp)."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(kind: str, record_id: str, refers_to: str | None, uri: str, date: str, digest: str, payload: bytes, n: int) -> bytes:
    """An uncompressed record; a revisit has the HTTP header alone, whose length field is the full payload's."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode() + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri:
        head.append(f"WARC-Target-URI: {uri}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(key) -> str:
    return f"urn:page:{'' if key is None else key}"


def decided(pages: DataFrame, key: str = "page_id", body: str = "html", least: int = LEAST_PAYLOAD) -> DataFrame:
    """``pages`` with payload_digest, payload_bytes, record_type and refers_to.

    Of rows with equal payloads of ``least`` bytes or more, that with the smallest key is the
    response (each, where rows repeat that key) and the others revisit it. A null body is an
    empty payload. A null key is never referred to: rows whose equals all have null keys are
    responses. Columns of the four names are replaced, others kept.
    """
    made = ["payload_digest", "payload_bytes", "record_type", "refers_to"]
    rows = pages.drop(*[c for c in pages.columns if c.lower() in made and c not in (key, body)])
    raw = F.encode(common.text_or_empty(body), "UTF-8")
    rows = rows.withColumns({"payload_digest": F.sha2(raw, 256), "payload_bytes": F.octet_length(raw).cast("long")})
    first = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = common.saved(first)  # a very common payload's rows are dealt out over many tasks
    of = common.free_name(rows, "first")
    rows = common.even_join(rows, first.select("payload_digest", F.col("first").alias(of)), ["payload_digest"], common.hot_keys(first, ["payload_digest"]), "left")
    again = F.col(of).isNotNull() & (F.col(key).isNull() | (F.col(key) > F.col(of)))
    return rows.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col(of))}).drop(of)


def write(pages: DataFrame, folder: str, key: str = "page_id", uri: str = "url", body: str = "html", date: str = "2020-01-01T00:00:00Z", least: int = LEAST_PAYLOAD) -> list[tuple[str, int]]:
    """Write a record for each row to gzip archives in ``folder``; returns (file, bytes) of each.

    A null URL leaves the field out; line ends in one become spaces. An empty table writes none.
    """
    spark = common.ship(pages.sparkSession)
    rows = decided(pages.select(key, uri, body), key, body, least)
    rows = rows.select(F.col(key).cast("string").alias("k"), F.regexp_replace(common.text_or_empty(uri), r"[\r\n]", " ").alias("u"), F.when(F.col("record_type") == "response", common.text_or_empty(body)).alias("b"), "payload_digest", "payload_bytes", "record_type", F.col("refers_to").cast("string").alias("r"))

    def put(batches: Iterator) -> Iterator:
        import pyarrow as pa

        context, sink, total = TaskContext.get(), None, 0
        name = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                opened = files.writing(name)
                sink = opened.__enter__()
            for row in zip(*batch.columns, strict=True):
                k, u, b, digest, n, kind, r = (x.as_py() for x in row)
                total += sink.write(member(record(kind, record_id(k), record_id(r), u, date, digest, (b or "").encode("utf-8", "surrogatepass"), n)))
        if sink is not None:
            opened.__exit__(None, None, None)
            yield pa.record_batch([[name], [total]], names=["file", "bytes"])

    return sorted((r.file, r.bytes) for r in rows.mapInArrow(put, "file string, bytes long").collect())


class Ranges:
    """Bytes of a file from a place on, fetched piece by piece; front and end of what is held move without copying the rest."""

    def __init__(self, source, at: int, step: int = 1 << 20):
        source.seek(at)
        self.source, self.base, self.held, self.step = source, at, bytearray(), step

    def more(self) -> bool:
        got = self.source.read(self.step)
        self.held += got
        return bool(got)

    def skip_to(self, at: int) -> None:
        while at > self.base + len(self.held) and self.more():
            pass
        del self.held[: at - self.base]
        self.base = at

    def find(self, limit: int) -> int | None:
        """The next place below ``limit`` that holds the magic."""
        while True:
            i = self.held.find(MAGIC)
            if i >= 0:
                return self.base + i if self.base + i < limit else None
            if self.base >= limit:
                return None
            self.skip_to(self.base + max(0, len(self.held) - len(MAGIC) + 1))
            if not self.more():
                return None

    def inflate(self, at: int = 0, header: bytes = b"WARC/1.") -> tuple[bytes, int] | None:
        """The member ``at`` bytes from the base and where it ends, or None where there is none that starts with ``header``."""
        z, out = zlib.decompressobj(31), bytearray()
        try:
            while not z.eof:
                if at >= len(self.held) and not self.more():
                    return None
                piece = bytes(self.held[at : at + (1 << 16)])
                at += len(piece)
                out += z.decompress(piece)
                if not header.startswith(out[: len(header)]):
                    return None
        except zlib.error:
            return None
        return (bytes(out), at - len(z.unused_data)) if out.startswith(header) else None


def parsed(data: bytes) -> dict:
    """Header fields (lower-case names) and block of an uncompressed record; ValueError where it isn't one."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC header")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"header line {line[:40]!r}")
        out[name.strip().lower()] = value.strip()
    n = int(out["content-length"])
    if len(rest) < n:
        raise ValueError("cut block")
    out["block"] = rest[:n]
    return out


def records(source, start: int, end: int) -> Iterator[tuple[int, int, dict]]:
    """Records that start in [start, end) of a file, searched for from ``start`` on: (place, end, fields).

    A place that holds no sound record is passed over by a byte; so a damaged record costs itself alone.
    """
    window = Ranges(source, start)
    while (at := window.find(end)) is not None:
        window.skip_to(at)
        got = window.inflate()
        try:
            fields = parsed(got[0]) if got else None
        except (ValueError, KeyError):
            fields = None
        if fields is None:
            window.skip_to(at + 1)
            continue
        yield at, at + got[1], fields
        window.skip_to(at + got[1])


TRIED = "file string, split long, entry long, end long, first long, exit long"


def tried(jobs: DataFrame, payloads: bool) -> DataFrame:
    """For jobs (file, split, end, entry): the records from ``entry`` on (offset and so on), and of each job a row without an offset that tells first and exit."""
    names = [c.split()[0] for c in f"{TRIED}, {SCHEMA.partition(', ')[2]}, sound boolean".split(", ")]

    def get(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for job in batch[["file", "split", "end", "entry"]].itertuples(index=False):
                name, split, end, entry = job
                rows, held, first, out = [], 0, None, end
                head = (name, split, entry, end)
                with files.reading(name) as source:
                    for at, out_, f in records(source, entry, end):
                        first, out = at if first is None else first, max(end, out_)
                        kind, digest = f["warc-type"], f.get("warc-payload-digest", "").removeprefix("sha256:")
                        top, _, payload = f["block"].partition(b"\r\n\r\n")
                        lengths = [int(x.partition(b":")[2]) for x in top.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                        sound = kind != "response" or not digest or hashlib.sha256(payload).hexdigest() == digest
                        strip = lambda k, f=f: f[k].strip("<>") if k in f else None
                        rows.append((*head, None, None, at, kind, strip("warc-record-id"), strip("warc-refers-to"), f.get("warc-target-uri"), digest, lengths[0] if lengths else len(payload), payload if payloads and kind == "response" else None, sound))
                        held += len(payload)
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                yield pd.DataFrame([*rows, (*head, first, out, *[None] * 9)], columns=names).astype({"first": "Int64", "exit": "Int64", "offset": "Int64", "payload_bytes": "Int64"})

    return jobs.mapInPandas(get, f"{TRIED}, {SCHEMA.partition(', ')[2]}, sound boolean")


def stitched(shown: DataFrame) -> DataFrame:
    """Of what was tried (TRIED): by file, the ``entry`` of each split whose records are right, and of others (``again``) where to read from."""

    def walk(group):
        import pandas as pd

        out, at = [], 0
        for split, tries in group.groupby("split", sort=True):
            end, entry = int(tries["end"].iloc[0]), max(at, split)
            if entry >= end:  # a record from before covers it
                continue
            fits = tries[(tries["entry"] == entry) | (tries["entry"] < entry) & ~(tries["first"] < entry)]
            out.append((tries["file"].iloc[0], split, end, int(fits["entry"].iloc[0]) if len(fits) else entry, not len(fits)))
            at = max(entry, int((fits if len(fits) else tries)["exit"].iloc[0]))
        return pd.DataFrame(out, columns=["file", "split", "end", "entry", "again"])

    return shown.groupBy("file").applyInPandas(walk, "file string, split long, end long, entry long, again boolean")


def read(spark: SparkSession, archives: list[tuple[str, int]], split_bytes: int = 32 << 20, payloads: bool = True) -> DataFrame:
    """A row for each record of gzip archives (file, bytes), by splits of ``split_bytes``.

    The payload of a response is checked against its digest (an error where they differ);
    that of a revisit is null, its payload_bytes is the full payload's length. ``payloads``
    False leaves the payloads out. No archives give no rows.
    """
    common.ship(spark)
    splits = [(name, at, min(at + split_bytes, size), at) for name, size in archives for at in range(0, size, split_bytes)]
    if not splits:
        return spark.createDataFrame([], SCHEMA)
    jobs = spark.createDataFrame(splits, "file string, split long, end long, entry long").repartition(min(len(splits), 10_000))
    folder, rounds = common.scratch(spark, "records"), 0
    try:
        while True:
            tried(jobs, payloads).write.parquet(f"{folder}/round={rounds}")
            seen = spark.read.parquet(folder)
            state = common.saved(stitched(seen.where("exit is not null").select(*[c.split()[0] for c in TRIED.split(", ")])))
            jobs, rounds = state.where("again").select("file", "split", "end", "entry"), rounds + 1
            if not (n := jobs.count()):
                break
            jobs = jobs.repartition(min(n, 10_000))
        right = seen.where("offset is not null").join(state.select("file", "split", "entry"), ["file", "split", "entry"], "left_semi")
        wrong = F.raise_error(F.concat("file", F.lit(" at "), F.col("offset").cast("string"), F.lit(": payload digest")))
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return common.saved(right.select(*[F.when(~F.col("sound"), wrong.cast("string")).otherwise(F.col(c)).alias(c) if c == "file" else c for c in names]))
    finally:
        files.delete(spark, folder)
