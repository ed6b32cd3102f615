"""Token ids in Arrow IPC files of fixed-size-list batches.

Each file is a stream of record batches with a footer, so any sequence can be read from a
memory map without copying: row ``k`` of ``tokens`` holds ids ``k*length .. (k+1)*length`` of
the file. ``filled`` marks positions that hold ids (only a file's last row has others) and
``ends`` those that close a document. A second small file beside it, ``*.index``, has the
document ids in order with their places. Documents are in ascending order of their id within
a file and from file to file.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import common, files

#: Default length of a sequence and sequences to a batch.
LENGTH, ROWS = 2048, 64


class _Uncut(Exception):
    """White space at a cut, or an added token: the text must be encoded whole."""


class _Table(dict):
    """Ids of words, made when first asked for; emptied when it is full."""

    def __init__(self, make, memory: int):
        self.make, self.memory = make, memory

    def __missing__(self, word: str) -> bytes:
        got = self.make(word)
        if len(self) >= self.memory:
            self.clear()
        if len(word) <= 64:
            self[word] = got
        return got


class WordCache:
    """Encodes texts with the tokenizers library, remembering the ids of words (in bounded tables).

    For a byte-level BPE, no token joins a non-space with white space after it. So a text may be
    cut before a space or a line end that stands alone between two non-spaces, and what a part
    encodes to doesn't depend on its neighbours. A part of letters alone is one token run: the
    library's model encodes it directly. Texts with other white space at a cut, texts that hold
    the string of an added token (which the library looks for first), and tokenizers of other
    kinds go through the library whole.
    """

    def __init__(self, definition: str, memory: int = 500_000):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        kind = json.loads(definition)
        pre = kind.get("pre_tokenizer") or {}
        self.cuts = kind.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and kind["model"].get("dropout") is None
        self.added = [t["content"] for t in kind.get("added_tokens") or []]
        self.narrow = self.tokenizer.get_vocab_size() <= 1 << 16
        self.tokenize = self.tokenizer.model.tokenize if self.cuts else None
        # byte-level BPE writes bytes as characters: printable ones as they are, others from U+0100 on
        plain = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
        self.letters = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}
        self.known = _Table(lambda w: self.part(" ", w), memory)  # words after a space
        self.first = _Table(lambda w: self.part("", w), memory // 4)  # words that start a line
        self.line_end = self.library(["\n"])[0]
        self.marks = dict(zip(".,;:!?", self.library([*".,;:!?"]), strict=True))

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def part(self, before: str, word: str) -> bytes:
        if word.isalpha():
            raw = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            return array("I", [t.id for t in self.tokenize((self.letters[32] if before else "") + raw)]).tobytes()
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Uncut
        if word[-1] in self.marks and word[:-1].isalpha():
            return (self.known if before else self.first)[word[:-1]] + self.marks[word[-1]]
        return self.library([before + word])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        if not self.cuts:
            return self.library(texts)
        known, first, out, whole = self.known.__getitem__, self.first, [], []
        for i, text in enumerate(texts):
            try:
                if any(a in text for a in self.added):
                    raise _Uncut
                lines = []
                for line in text.split("\n"):
                    words = line.split(" ")
                    lines.append(first[words[0]] + b"".join(map(known, words[1:])))
                out.append(self.line_end.join(lines))
            except _Uncut:
                out.append(b"")
                whole.append(i)
        for i, got in zip(whole, self.library([texts[i] for i in whole]), strict=True):
            out[i] = got
        return out


_CACHES: dict[int, WordCache] = {}


def cache(definition: str) -> WordCache:
    key = hash(definition)
    if key not in _CACHES:
        _CACHES.clear()
        _CACHES[key] = WordCache(definition)
    return _CACHES[key]


class Writer:
    """Packs ids into fixed-size lists and writes them batch by batch."""

    def __init__(self, sink, length: int, rows: int, narrow: bool):
        import numpy as np
        import pyarrow as pa

        self.dtype = np.uint16 if narrow else np.uint32
        self.length, self.size = length, length * rows
        of = lambda kind: pa.list_(pa.field("item", kind, nullable=False), length)
        self.schema = pa.schema([pa.field("tokens", of(pa.uint16() if narrow else pa.uint32()), nullable=False), pa.field("filled", of(pa.bool_()), nullable=False), pa.field("ends", of(pa.bool_()), nullable=False)])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held, self.marks, self.n, self.total = [], [], 0, 0

    def add(self, ids) -> None:
        """One document's ids, closing id included."""
        self.held.append(ids)
        self.n += len(ids)
        self.total += len(ids)
        self.marks.append(self.n - 1)
        if self.n >= self.size:
            self.flush(self.size)

    def flush(self, unit: int) -> None:
        import numpy as np
        import pyarrow as pa

        if not self.n:
            return
        ids, ends = np.concatenate(self.held).astype(self.dtype), np.zeros(self.n, dtype=bool)
        ends[self.marks] = True
        whole = self.n // unit * unit if unit == self.size else self.n
        for at in range(0, whole, self.size):
            part, mark = ids[at : min(at + self.size, whole)], ends[at : min(at + self.size, whole)]
            lack = -len(part) % self.length
            filled = np.ones(len(part) + lack, dtype=bool)
            if lack:
                filled[-lack:] = False
                part, mark = np.pad(part, (0, lack)), np.pad(mark, (0, lack))
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((part, filled, mark), self.schema, strict=True)]
            self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.held, self.n, self.marks = [ids[whole:]], self.n - whole, [m - whole for m in self.marks if m >= whole]

    def close(self) -> None:
        self.flush(1)
        self.out.close()


def write(docs: DataFrame, folder: str, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = 0, length: int = LENGTH) -> list[tuple[str, int, int]]:
    """Write the ids of each whole text to ``folder`` and return (file, documents, ids) in order.

    A null or empty text gives only the closing id. Rows are sorted by ``key`` (nulls first),
    ties by a hash of the text, which also lets rows of one key spread over several files;
    repeated rows are written as often as they come. Other columns aren't read. An empty table
    writes no file. The list has a row for each file, so it grows with the tasks only.
    """
    spark = common.ship(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(key).cast("long").alias("id"), common.text_or_empty(text).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")

    def put(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        c = cache(definition.value)
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}"
        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        index = []
        with files.writing(f"{name}.arrow") as sink:
            out = Writer(sink, length, ROWS, c.narrow and end_id < 1 << 16)
            batch = first
            while batch is not None:
                for at in range(0, batch.num_rows, 256):
                    piece = batch.slice(at, 256)
                    starts = []
                    for got in c.encode(piece.column(1).to_pylist()):
                        starts.append(out.total)
                        out.add(np.append(np.frombuffer(got, dtype="<u4"), np.uint32(end_id)))
                    index.append(pa.record_batch([piece.column(0), pa.array(starts, pa.int64())], names=["id", "start"]))
                batch = next(batches, None)
            out.close()
        with files.writing(f"{name}.index") as sink, pa.ipc.new_file(sink, index[0].schema) as w:
            for b in index:
                w.write_batch(b)
        yield pa.record_batch([[TaskContext.get().partitionId()], [f"{name}.arrow"], [sum(b.num_rows for b in index)], [out.total]], names=["part", "file", "docs", "ids"])

    made = rows.mapInArrow(put, "part long, file string, docs long, ids long").collect()
    return [(r.file, r.docs, r.ids) for r in sorted(made, key=lambda r: r.part)]


def read(spark: SparkSession, made: list[tuple[str, int, int]], with_ids: bool = False) -> DataFrame:
    """Documents of written files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    ``with_ids`` adds the ids themselves. Each file is one task's work; batches are read from a
    memory map as they are needed.
    """
    common.ship(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    jobs, base = [], 0
    for name, _, n in made:
        jobs.append((name, base, n))
        base += n
    if not jobs:
        return spark.createDataFrame([], schema)

    def get(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for jobs in batches:
            for name, base, total in zip(*(c.to_pylist() for c in jobs.columns[:3]), strict=True):
                with files.mapped(name) as source, files.mapped(name.removesuffix("arrow") + "index") as beside:
                    tokens, index = pa.ipc.open_file(source), pa.ipc.open_file(beside)
                    n_ids = 0
                    held, at, k = np.zeros(0, np.uint32), 0, 0  # ids from place ``at`` on; next batch
                    for i in range(index.num_record_batches):
                        part = index.get_batch(i)
                        starts = part.column(1).to_numpy()
                        after = index.get_batch(i + 1).column(1)[0].as_py() if i + 1 < index.num_record_batches else total
                        rows = []
                        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), after], strict=True):
                            more = [held[start - at :]]
                            have = len(more[0])
                            while have < end - start:
                                batch = tokens.get_batch(k)
                                ids = batch.column(0).flatten().to_numpy()
                                filled = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False))
                                ids = ids if filled.all() else ids[filled]
                                more.append(ids)
                                have += len(ids)
                                k += 1
                            held, at = (np.concatenate(more) if len(more) > 1 else more[0]), start
                            own = held[: end - start].astype("<u4")
                            n_ids += len(own)
                            rows.append((base + start, end - start, zlib.crc32(own.tobytes())) + ((own.tolist(),) if with_ids else ()))
                        columns = [part.column(0), *(pa.array(list(x), pa.int64()) for x in list(zip(*rows, strict=True))[:3])]
                        if with_ids:
                            columns.append(pa.array([r[3] for r in rows], pa.list_(pa.int64())))
                        yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
                    if n_ids != total:
                        raise ValueError(f"{name}: {n_ids} ids, {total} expected")

    rows = spark.createDataFrame(jobs, "file string, base long, ids long").repartition(len(jobs))
    return rows.mapInArrow(get, schema)
