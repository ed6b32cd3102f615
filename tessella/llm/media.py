"""Media columns: lossless PNG images in a binary column, and features of their pixels.

Encoding writes 8-bit greyscale PNG: signature, chunks with CRC-32, one zlib stream of
filtered rows. Decoding checks every chunk's checksum, inflates, and undoes the row filters
with numpy. The feature is a perceptual hash: the image is averaged to 32 x 32, its two-way
cosine transform taken, and the 8 x 8 lowest frequencies compared with their median.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common

SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed by the format
WIDTH = 64
SIDE, LOW = 32, 8


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(pixels, level: int = 4) -> bytes:
    """A greyscale image (2-D uint8 array). All rows share the filter, none, left or up, with the least sum of absolute differences."""
    import numpy as np

    h, w = pixels.shape
    left = pixels.copy()
    left[:, 1:] -= pixels[:, :-1]
    up = pixels.copy()
    up[1:] -= pixels[:-1]
    cost = [int(np.abs(x.view(np.int8).astype(np.int16)).sum()) for x in (pixels, left, up)]
    kind = min(range(3), key=lambda k: (cost[k], k))
    raw = np.empty((h, w + 1), dtype=np.uint8)
    raw[:, 0] = kind
    raw[:, 1:] = (pixels, left, up)[kind]
    head = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + chunk(b"IEND", b"")


def decode_png(data: bytes):
    """The image of a greyscale 8-bit PNG without interlace; ValueError where a checksum, length or filter is wrong."""
    import numpy as np

    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, size, parts, ended = 8, None, [], False
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("cut chunk")
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("only 8-bit greyscale without interlace")
            size = (h, w)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            ended = True
        at += 12 + n
    if size is None or not ended:
        raise ValueError("no header or end")
    h, w = size
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), dtype=np.uint8)
    if len(raw) != h * (w + 1):
        raise ValueError("wrong length")
    raw = raw.reshape(h, w + 1)
    return unfiltered(raw[:, 0], raw[:, 1:])


def unfiltered(kinds, rows):
    """Undo the five row filters; runs of rows of one filter at once where the filter allows."""
    import numpy as np

    h, w = rows.shape
    out = np.empty((h, w), dtype=np.uint8)
    bounds = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), h] if h else [0]
    for a, b in zip(bounds, bounds[1:], strict=False):
        kind = int(kinds[a])
        if kind == 0:
            out[a:b] = rows[a:b]
        elif kind == 1:
            np.add.accumulate(rows[a:b], axis=1, dtype=np.uint8, out=out[a:b])
        elif kind == 2:
            np.add.accumulate(rows[a:b], axis=0, dtype=np.uint8, out=out[a:b])
            if a:
                out[a:b] += out[a - 1]
        elif kind in (3, 4):
            for y in range(a, b):
                above = out[y - 1].tolist() if y else [0] * w
                left = corner = 0
                line = []
                for x, value in enumerate(rows[y].tolist()):
                    if kind == 3:
                        guess = (left + above[x]) // 2
                    else:
                        base = left + above[x] - corner
                        near = (abs(base - left), abs(base - above[x]), abs(base - corner))
                        guess = (left, above[x], corner)[near.index(min(near))]
                    corner = above[x]
                    left = (value + guess) & 255
                    line.append(left)
                out[y] = line
        else:
            raise ValueError(f"filter {kind}")
    return out


@lru_cache(maxsize=512)
def _cells(n: int):
    """Start of each of SIDE cells along an axis of n samples, and the number of samples in it (at least one)."""
    import numpy as np

    starts = np.arange(SIDE) * n // SIDE
    return starts, np.maximum(np.append(starts[1:], n) - starts, 1)


@lru_cache(maxsize=1)
def _cosines():
    import numpy as np

    k = np.arange(LOW)[:, None]
    return np.cos(np.pi * k * (2 * np.arange(SIDE)[None, :] + 1) / (2 * SIDE))


def cosine_hash(pixels) -> bytes:
    """64 bits: whether each low-frequency coefficient is above the median of them (the constant one left out of it)."""
    import numpy as np

    (ys, ny), (xs, nx) = _cells(pixels.shape[0]), _cells(pixels.shape[1])
    tall = np.add.reduceat(pixels, ys, axis=0, dtype=np.int64) / ny[:, None]
    small = np.add.reduceat(tall, xs, axis=1) / nx[None, :]
    c = _cosines()
    low = np.round(c @ small @ c.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def payload_of(text: str) -> bytes:
    """The text in UTF-8 with bytes 0 appended up to the next positive multiple of the width."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def store(docs: DataFrame, text: str = "text", media: str = "media", n_bytes: str = "n_bytes") -> DataFrame:
    """``docs`` with each whole text as a PNG in binary column ``media`` and its length in bytes.

    A null or empty text (no bytes) becomes one row of zeros. Columns of these names are replaced, others kept.
    """
    common.ship(docs.sparkSession)

    @F.pandas_udf("binary")
    def to_png(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        for texts in batches:
            yield pd.Series([encode_png(np.frombuffer(payload_of(t), dtype=np.uint8).reshape(-1, WIDTH)) for t in texts], dtype=object)

    whole = common.text_or_empty(text)
    return docs.withColumns({media: to_png(whole), n_bytes: F.octet_length(whole).cast("long")})


def features(table: DataFrame, media: str = "media") -> DataFrame:
    """``table`` with what its stored images decode to: payload digests, digests of the stored form and the hash.

    Adds payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature_bits (binary)
    and feature (hex); columns of these names are replaced. A null image gives nulls; a damaged one
    fails the query.
    """
    common.ship(table.sparkSession)
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature_bits"]

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature_bits binary")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for images in batches:
            rows = []
            for data in images:
                if data is None:
                    rows.append((None,) * 6)
                    continue
                pixels = decode_png(data)
                raw = pixels.tobytes()
                rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(pixels)))
            yield pd.DataFrame(rows, columns=names)

    made = common.free_name(table, "looked")
    out = table.withColumn(made, look(F.col(media)))
    out = out.withColumns({n: F.col(f"{made}.{n}") for n in names}).drop(made)
    return out.withColumn("feature", F.lower(F.hex("feature_bits")))
