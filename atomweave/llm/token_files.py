"""Token files: flat unsigned integers plus 64-bit document offsets, one pair of files per partition.

``<part>.bin`` holds the ids of all its documents end to end (little-endian, 16 bits if the
vocabulary fits, else 32); ``<part>.idx`` holds n + 1 offsets, then n document ids,
as 64-bit integers (a null id is the smallest integer).  Parts are ranges of document ids in order, and the position of a part in the
whole comes from a prefix sum over the parts' totals.  A reader maps the files into memory.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, id_in, id_out, staged
from .encoding import encoder, slices


def _store(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


def _put(fs: pafs.FileSystem, path: str, write) -> None:
    """Write under a name of this attempt's own, then rename: a task that runs twice leaves one whole file."""
    own = f"{path}.{os.getpid()}-{os.urandom(4).hex()}"
    with fs.open_output_stream(own) as f:
        write(f)
    try:
        fs.move(own, path)
    except OSError:  # a store whose rename refuses an existing target: an earlier attempt has left one
        fs.delete_file(path)
        fs.move(own, path)


def write_token_files(docs: DataFrame, root: str, tokenizer: str, end_id: int | None = 2, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end_id`` and write the files under ``root`` in ascending id order.

    Returns the manifest ``part, n_docs, n_tokens, base, width``, one row per file pair.  Null texts are
    empty documents; null ids come first; rows with equal ids stand side by side in order of their
    texts' hash; very long texts are one document each; an empty table gives no files; other columns are not read.
    """
    spark = docs.sparkSession
    n = partitions or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        dtype = np.dtype("<u2" if max(len(enc.bytes_of), (end_id or 0) + 1) <= 1 << 16 else "<u4")
        sizes, names = [], []
        fs, folder = _store(root)
        fs.create_dir(folder, recursive=True)
        end = np.array([] if end_id is None else [end_id], np.uint32)

        def ids(f) -> None:
            for b in batches:
                texts = b["text"].tolist()
                names.append(b["id"].to_numpy(np.int64))
                for i, j in slices(texts):
                    for x in enc.ids(texts[i:j]):
                        f.write(np.concatenate([x, end]).astype(dtype).tobytes())
                        sizes.append(len(x) + len(end))

        _put(fs, f"{folder}/{part:06d}.bin", ids)
        if not sizes:
            fs.delete_file(f"{folder}/{part:06d}.bin")
            return
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        _put(fs, f"{folder}/{part:06d}.idx", lambda f: f.write(np.concatenate([offsets, *names]).astype("<i8").tobytes()))
        yield pd.DataFrame({"part": [part], "n_docs": [len(sizes)], "n_tokens": [int(offsets[-1])], "width": [dtype.itemsize]})

    rows = docs.select(id_in(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange(n, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    parts = staged(ordered.mapInPandas(run, "part int, n_docs long, n_tokens long, width int"), "token-parts")
    table = parts.orderBy("part").toPandas()  # one row per file, not per document
    table["base"] = table["n_tokens"].cumsum() - table["n_tokens"]
    table = table.astype({"part": "int32", "n_docs": "int64", "n_tokens": "int64", "base": "int64", "width": "int32"})
    return spark.createDataFrame(table[["part", "n_docs", "n_tokens", "base", "width"]], "part int, n_docs long, n_tokens long, base long, width int")


class TokenFile:
    """One part, mapped into memory; ``tokens(i)`` is document i's ids.

    A store that cannot be mapped is copied to the task's temporary folder first and removed on ``close``.
    """

    def __init__(self, root: str, part: int, width: int):
        fs, folder = _store(root)
        self.copied, paths = [], []
        for kind in ("bin", "idx"):
            path = f"{folder}/{part:06d}.{kind}"
            if not isinstance(fs, pafs.LocalFileSystem):
                fd, own = tempfile.mkstemp()
                os.close(fd)
                pafs.copy_files(path, own, source_filesystem=fs, destination_filesystem=pafs.LocalFileSystem())
                self.copied.append(own)
                path = own
            paths.append(path)
        index = np.memmap(paths[1], "<i8", "r")
        n = len(index) // 2
        self.offsets, self.ids = index[: n + 1], index[n + 1 :]
        empty = not os.path.getsize(paths[0])
        self.data = np.empty(0, "<u2") if empty else np.memmap(paths[0], f"<u{width}", "r")

    def __len__(self) -> int:
        return len(self.ids)

    def tokens(self, i: int) -> np.ndarray:
        return self.data[self.offsets[i] : self.offsets[i + 1]]

    def close(self) -> None:
        for path in self.copied:
            os.unlink(path)


def read_token_files(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the mapped files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for m in b.itertuples():
                f = TokenFile(root, m.part, m.width)
                try:
                    offsets = np.asarray(f.offsets)
                    for i in range(0, len(f), 10_000):
                        rows = range(i, min(i + 10_000, len(f)))
                        crc = np.array([zlib.crc32(f.tokens(k).astype("<u4").tobytes()) for k in rows], np.int64)
                        ids = np.asarray(f.ids[rows.start : rows.stop])
                        yield pd.DataFrame({"doc_id": ids, "start": m.base + offsets[rows.start : rows.stop], "n_tokens": np.diff(offsets[rows.start : rows.stop + 1]), "ids_crc32": crc})
                finally:
                    f.close()

    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return id_out(manifest.repartition(n, "part").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, root: str | None = None) -> DataFrame:
    """Write all documents and read them back."""
    root = root or fresh_path(docs.sparkSession, "token-files")
    return read_token_files(docs.sparkSession, root, write_token_files(docs, root, tokenizer, end_id))
