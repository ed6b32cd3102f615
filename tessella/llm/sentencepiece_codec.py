"""SentencePiece (merge type) encoding by backtracking, and decoding.

A sequence of pieces is what the merge rule makes of a text exactly if each two adjacent
pieces are: re-merging the characters of the two must give the two again. So the encoder
walks over the text, takes the longest piece that starts at a position (all matches come
from one pass of an Aho-Corasick automaton) and is compatible with the piece before it,
tries shorter pieces where it isn't, and steps back where none fits. A bitfield holds the
positions from which the rest can't be encoded, so each position fails at most once.

A text is first cut where no piece can cross: before a run of space marks, around line ends
if no piece has one, and (for parts that aren't known yet) between Latin letters
and other characters if no piece mixes them. The model's own pieces are looked through for this. The
cut parts are encoded once and remembered in a bounded table. Inside, a space stands for the mark.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common

MARK = "▁"
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Texts that models of other types, normalisers or user-defined symbols are told by.
PROBES = ("", " ", "  a  b ", "a\tb\n\nc", "ﬁ① ½ Ａ", "e\u0301 é", "\u3000x\u00a0y", "the international thing", "12345 x2", "▁a", "\x00", "<s> </s> <unk>")
#: Characters of a text to split into words at once.
PIECE = 1 << 20


class Codec:
    """Encoder and decoder of one model (type BPE, identity normaliser, byte fallback; others are refused).

    ``memory``: distinct text parts and piece pairs to remember at most; only speed depends on it.
    """

    def __init__(self, model: bytes, memory: int = 200_000):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.memory = memory
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids: dict[int, int] = {}
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.surface: list[bytes] = []  # of each id
        self.silent, self.unknown = set(), sp.unk_id()
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.surface.append(bytes([value]))
            elif sp.is_control(i):
                self.silent.add(i)
                self.surface.append(b"")
            elif sp.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                plain = piece.replace(MARK, " ")
                self.ids[plain] = i
                self.scores[plain] = sp.get_score(i)
                self.surface.append(plain.encode())
        self.is_byte = set(self.byte_ids.values())
        self.prefix = sp.encode("") == [] and sp.encode("a")[:1] != sp.encode("a a")[-1:] or self.pieces[sp.encode("a")[0]].startswith(MARK)
        inner = [p.lstrip(" ") for p in self.ids]
        if any(" " in p for p in inner):
            raise ValueError("pieces with inner space marks are not supported")
        self.automaton = ahocorasick.Automaton()
        # numbers beyond the model's: characters that occur only inside pieces, then one for all that occur nowhere
        self.texts = {i: p for p, i in self.ids.items()}
        loose = sorted({c for p in self.ids for c in p} - self.ids.keys())
        self.texts |= {n + k: c for k, c in enumerate(loose)}
        self.foreign = n + len(loose)
        self.length = [len(self.texts.get(i, "")) for i in range(self.foreign)] + [1]
        for i, piece in self.texts.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        number = {p: i for i, p in self.texts.items()}
        self.shorter = [-1] * (self.foreign + 1)
        for i, p in self.texts.items():
            self.shorter[i] = next((number[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in number), -1)
        end = "" if any("\n" in p for p in inner) else "\n"
        self.parts = re.compile(f" *[^ {end}]+| +" + (f"|{end}" if end else "")).findall
        letter = re.compile(f"[{LATIN}]").match
        mixed = any(bool(letter(a)) != bool(letter(b)) for p in inner for a, b in zip(p, p[1:], strict=False))
        self.finer = self.parts if mixed else re.compile(f" *[{LATIN}]+| *[^ {end}{LATIN}]+| +" + (f"|{end}" if end else "")).findall
        self.words: dict[str, tuple[int, ...]] = {}  # by words after a single space
        self.known: dict[str, tuple[int, ...]] = {}  # by finer parts
        self.fits: dict[int, bool] = {}
        self.names = [str(i) for i in range(n)]
        some = [sp.decode([i]) for i in [*range(min(n, 300)), *range(300, n, 61)]]
        for text in [*PROBES, *some, *(a + b for a, b in zip(some, some[1:], strict=False))]:
            if self.encode(text) != sp.encode(text):
                raise ValueError(f"not a model of the supported kind: {text[:40]!r} is encoded otherwise")

    def merged(self, text: str) -> list[str]:
        """The merge rule itself, for short texts: join the adjacent two whose union scores highest, leftmost first."""
        parts, score = list(text), self.scores.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether re-merging two adjacent pieces gives them again (left -1: whether right alone does)."""
        if self.foreign in (left, right):
            other = right if left == self.foreign else left
            fit = other in (-1, self.foreign) or left != self.foreign or self.compatible(-1, other)
        else:
            a, b = self.texts.get(left, ""), self.texts[right]
            fit = self.merged(a + b) == ([a, b] if a else [b])
        if len(self.fits) >= self.memory:
            self.fits.clear()
        self.fits[(left + 1) << 20 | right] = fit
        return fit

    def segment(self, text: str) -> list[int]:
        """The numbers of the pieces of a text without cuts; a character outside the vocabulary stays single."""
        n, length, fits, shorter, foreign = len(text), self.length, self.fits.get, self.shorter, self.foreign
        longest = [foreign] * n
        for end, i in self.automaton.iter(text):
            longest[end - length[i] + 1] = i  # the last that starts there ends last
        failed = None  # a bit for each position from which the rest can't be encoded
        taken: list[int] = []
        pos, before, i = 0, -1, longest[0]
        while True:
            end = pos + length[i]
            fit = fits((before + 1) << 20 | i)
            if fit is None:
                fit = self.compatible(before, i)
            if fit and not (failed and failed[end >> 3] >> (end & 7) & 1):
                taken.append(i)
                if end == n:
                    return taken
                pos, before, i = end, i, longest[end]
                continue
            i = shorter[i]
            while i < 0:
                if not taken:
                    raise ValueError(f"no encoding of {text[:40]!r}")
                if failed is None:
                    failed = bytearray(n // 8 + 1)
                failed[pos >> 3] |= 1 << (pos & 7)
                i = taken.pop()
                pos -= length[i]
                before = taken[-1] if taken else -1
                i = shorter[i]

    def segment_ids(self, part: str) -> tuple[int, ...]:
        """Ids of a finer part: those of its pieces, or of the UTF-8 bytes of a character without a piece."""
        out, pos, n = self.segment(part), 0, len(self.names)
        if max(out) >= n:
            pieces, out = out, []
            for i in pieces:
                c = part[pos : pos + self.length[i]]
                pos += len(c)
                if i < n:
                    out.append(i)
                else:
                    out += [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]
        got = tuple(out)
        if len(part) <= 64:
            if len(self.known) >= self.memory:
                self.known.clear()
            self.known[part] = got
        return got

    def part_ids(self, part: str) -> tuple[int, ...]:
        """Ids of a part that no piece crosses the ends of."""
        known = self.known
        return tuple(chain.from_iterable([known.get(p) or self.segment_ids(p) for p in self.finer(part)]))

    def word_ids(self, word: str) -> tuple[int, ...]:
        """Ids of a word after a single space."""
        got = self.part_ids(" " + word)
        if len(word) <= 32 and "\n" not in word:
            if len(self.words) >= self.memory:
                self.words.clear()
            self.words[word] = got
        return got

    def encode(self, text: str) -> list[int]:
        """Ids of a text; an empty text has none."""
        if not text:
            return []
        plain = text.replace(MARK, " ")
        if self.prefix and "  " not in plain and plain[0] != " " and plain[-1] != " ":
            words, out, at = self.words, [], 0
            while at >= 0:
                cut = plain.find(" ", at + PIECE)
                own = plain[at : cut if cut >= 0 else None]
                out.extend(chain.from_iterable([words.get(w) or self.word_ids(w) for w in own.split(" ")]))
                at = cut + 1 if cut >= 0 else -1
            return out
        return list(chain.from_iterable([self.part_ids(p) for p in self.parts((" " if self.prefix else "") + plain)]))

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: space marks become spaces, runs of byte pieces UTF-8, the prefix's space goes.

        A byte that isn't part of valid UTF-8 becomes U+FFFD.
        """
        ids = ids if isinstance(ids, list) else list(ids)
        raw = b"".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if i not in self.silent), None)
        if self.prefix and first is not None and first not in self.is_byte and first != self.unknown and self.pieces[first].startswith(MARK):
            raw = raw[1:]
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return self.repaired(raw)

    @staticmethod
    def repaired(raw: bytes) -> str:
        out, at = [], 0
        while at < len(raw):
            try:
                out.append(raw[at:].decode("utf-8"))
                break
            except UnicodeDecodeError as e:
                out.append(raw[at : at + e.start].decode("utf-8") + "�")
                at += e.start + 1
        return "".join(out)


def codec(model: bytes) -> Codec:
    """This worker's codec of a model, kept from task to task until another operator's tasks come."""
    return common.held(("sentencepiece", hash(model)), lambda: Codec(model))


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column ``ids`` (array<int>) of the ids of each whole text.

    A null text counts as empty and has no ids. Rows, their number and all other columns stay
    as they are, repeated rows included; a column that is already named ``ids`` is replaced.
    """
    spark = common.ship(docs.sparkSession)
    model = spark.sparkContext.broadcast(read_model(model_path))  # one file of a fixed model, not data

    @F.pandas_udf("array<int>")
    def to_ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        c = codec(model.value)
        for texts in batches:
            yield pd.Series([np.array(c.encode(t), dtype=np.int32) for t in texts], dtype=object)

    return docs.withColumn(ids, to_ids(common.text_or_empty(text)))


def decode(rows: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of each array of ids; null ids give an empty text."""
    spark = common.ship(rows.sparkSession)
    model = spark.sparkContext.broadcast(read_model(model_path))

    @F.pandas_udf("string")
    def to_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(model.value)
        for lists in batches:
            yield pd.Series([c.decode(x.tolist()) if x is not None else "" for x in lists], dtype=object)

    return rows.withColumn(text, to_text(F.col(ids)))


def round_trip(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Digests of encoding and decoding each whole text, in one pass over Arrow batches.

    Adds n_tokens, ids_sha256 and decoded_sha256 (see ``digests``) to the other columns of
    ``docs``; columns of these names are replaced. Ids and texts don't leave the worker.
    """
    spark = common.ship(docs.sparkSession)
    model = spark.sparkContext.broadcast(read_model(model_path))

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(model.value)
        for texts in batches:
            yield pd.DataFrame([digests(c, t) for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    made = common.free_name(docs, "round_trip")
    out = docs.withColumn(made, both(common.text_or_empty(text)))
    for c in ("n_tokens", "ids_sha256", "decoded_sha256"):
        out = out.withColumn(c, F.col(f"{made}.{c}"))
    return out.drop(made)


def digests(c: Codec, text: str) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded text."""
    ids = c.encode(text)
    joined = ",".join(map(c.names.__getitem__, ids))
    return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(c.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()
