"""Media columns: bytes kept as the pixels of lossless WebP files, read back and described."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, id_in, id_out
from .encoding import slices
from .webp import decode
from .webp_text import decode_many, encode_many

#: Bytes in a row of the smallest picture: 48 pixels of four 8-bit samples.
ROW, SIDE = 192, 1 << 14


def padded(data: bytes) -> bytes:
    """With blanks up to a positive multiple of ``ROW`` bytes."""
    return data + b" " * (-len(data) % ROW if data else ROW)


def picture(payload: bytes) -> np.ndarray:
    """The payload as pixels: rows of 48 pixels, wider only where over 16384 rows would be needed (then zeros fill the last)."""
    rows = len(payload) // ROW
    wide = -(-rows // SIDE)
    high = -(-rows // wide)
    samples = np.frombuffer(payload + bytes(wide * high * ROW - len(payload)), np.uint8)
    return samples.reshape(high, wide * ROW // 4, 4)


def feature(payload: bytes) -> str:
    """64 bits as 16 hex digits: which of 64 even stretches are brighter than the mean of all samples."""
    x = np.frombuffer(payload, np.uint8)
    ends = np.arange(65) * len(x) // 64
    sums = np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[ends])
    bits = sums * len(x) > np.diff(ends) * int(x.sum(dtype=np.int64))
    return np.packbits(bits).tobytes().hex()


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Every text's UTF-8 bytes through a lossless WebP file and back: prefix codes, back-references and a colour cache.

    Returns ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature`` (``media`` too if asked for); all but ``n_bytes`` and the last three come from the bytes read back.
    Null and empty texts have a payload of 192 blanks; equal texts have equal files, whatever stands beside them; very long texts
    are one file each; null ids and repeated rows pass through; an empty table gives no rows; other columns are not read.
    """
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, ids, texts = [], b["doc_id"].tolist(), b["text"].tolist()
            for i, j in slices(texts, 1 << 21):
                data = [(t or "").encode("utf-8", "surrogatepass") for t in texts[i:j]]
                payloads = [padded(d) for d in data]
                files = encode_many([picture(x) for x in payloads])
                for doc, own, payload, stored, pixels in zip(ids[i:j], data, payloads, files, decode_many(files), strict=True):
                    back = pixels.tobytes()[: len(payload)]
                    row = (doc, len(own), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(back))
                    rows.append((*row, stored) if keep_media else row)
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in (fields + ", media binary" * keep_media).split(", ")])

    rows = docs.select(id_in(id_col).alias("doc_id"), column(text_col).cast("string").alias("text"))
    return id_out(rows.mapInPandas(run, fields + ", media binary" * keep_media))


def media_arrays(table: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """Decode a column of WebP files: ``doc_id, width, height, pixels`` with pixels as RGBA bytes, row by row.

    Files of the extended container are read too.  A null or a file that is not lossless WebP gives nulls in the last three; null ids
    and repeated rows pass through; a file of any size is decoded whole; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, data in zip(b["doc_id"].tolist(), b["media"].tolist(), strict=True):
                try:
                    p = decode(bytes(data)) if data is not None else None
                except ValueError:
                    p = None
                rows.append((doc, None, None, None) if p is None else (doc, p.shape[1], p.shape[0], p.tobytes()))
            out = pd.DataFrame(rows, columns=["doc_id", "width", "height", "pixels"])
            yield out.astype({"width": "Int32", "height": "Int32"})

    return id_out(table.select(id_in(id_col).alias("doc_id"), F.col(media_col).alias("media")).mapInPandas(run, "doc_id long, width int, height int, pixels binary"))
