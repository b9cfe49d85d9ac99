"""Media columns: texts as progressive JPEG files, and files as full-resolution RGB tensors.

A text's payload is its UTF-8 bytes, filled with zeros to a positive multiple of 64. Each 64 bytes are the quantised
coefficients of one 8 x 8 block (byte less 128, zigzag order), which the format codes without loss; blocks fill the luma
and then the two half-resolution chroma components of the smallest near-square frame. A comment keeps the payload's size.
Decoding accumulates the scans (two bands of a first pass, then one refining pass, for each component) into coefficient
arrays; the payload is read off these, and the image comes from their inverse transform.

Files of a batch are coded together, about two megabytes at a time; a longer text alone. One pass without a shuffle.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from twinframe.llm import jpeg
from twinframe.llm.common import in_batches, without

BLOCK = 64
#: Payload bytes that are coded together.
TOGETHER = 2 << 20


def payload(data: bytes) -> bytes:
    """``data`` filled with zeros to a positive multiple of 64."""
    return data + b"\0" * (max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def _shape(blocks: int) -> tuple[int, int]:
    """Units of six blocks across and down."""
    units = -(-blocks // 6)
    across = isqrt(units - 1) + 1
    return across, -(-units // across)


def to_files(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file of each payload."""
    if not payloads:
        return []
    shapes = [_shape(len(p) // BLOCK) for p in payloads]
    rows = [6 * a * d for a, d in shapes]
    coef = np.zeros((sum(rows), BLOCK), np.int32)
    at = 0
    for p, n in zip(payloads, rows):
        coef[at : at + len(p) // BLOCK] = np.frombuffer(p, np.uint8).reshape(-1, BLOCK).astype(np.int32) - 128
        at += n
    return jpeg.write(coef, shapes, [b"payload %d" % len(p) for p in payloads])


def from_files(files: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """(payload, image) of each file; the payload is empty in files that were not made here."""
    if not files:
        return []
    frames, coef = jpeg.read(files)
    out = []
    for f, image in zip(frames, jpeg.images(frames, coef)):
        size = next((int(c[8:]) for c in f.comments if c.startswith(b"payload ")), 0)
        row0 = f.components[0].row0
        out.append(((coef[row0 : row0 + size // BLOCK] + 128).astype(np.uint8).tobytes(), image))
    return out


def feature(image: np.ndarray) -> str:
    """Height x width, mean and standard deviation of each channel in thousandths, and the crc32 of the tensor."""
    flat = image.reshape(-1, 3).astype(np.int64)
    n, total, squares = len(flat), flat.sum(axis=0), (flat * flat).sum(axis=0)
    mean = [int(t) * 1000 // n for t in total]
    spread = [isqrt((int(q) * n - int(t) ** 2) * 1_000_000 // (n * n)) for t, q in zip(total, squares)]
    return f"{image.shape[0]}x{image.shape[1]}:{','.join(map(str, mean))}:{','.join(map(str, spread))}:{zlib.crc32(image.tobytes()):08x}"


def together(sizes: list[int]) -> Iterator[slice]:
    """Slices of about TOGETHER bytes."""
    start = total = 0
    for n, s in enumerate(sizes):
        total += s + BLOCK
        if total >= TOGETHER:
            yield slice(start, n + 1)
            start, total = n + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


def add_media(df: DataFrame, *, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """``df`` with ``media_col``, the JPEG file of each text (null text: that of an empty one)."""

    @pandas_udf("binary")
    def files(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            data = [payload((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            yield pd.Series([f for s in together([*map(len, data)]) for f in to_files(data[s])], dtype=object)

    return without(in_batches(df), [media_col]).withColumn(media_col, files(F.col(text_col)))


def add_images(df: DataFrame, *, media_col: str = "media", image_col: str = "image") -> DataFrame:
    """``df`` with ``image_col``: height, width and the RGB bytes of each progressive JPEG (null file: null)."""

    @pandas_udf("height int, width int, rgb binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for files in batches:
            rows: list = [(None, None, None)] * len(files)
            have = [n for n, f in enumerate(files) if f is not None]
            for s in together([len(files.iloc[n]) for n in have]):
                for n, (_, image) in zip(have[s], from_files([bytes(files.iloc[n]) for n in have[s]])):
                    rows[n] = (image.shape[0], image.shape[1], image.tobytes())
            yield pd.DataFrame(rows, columns=["height", "width", "rgb"])

    return without(in_batches(df), [image_col]).withColumn(image_col, decoded(F.col(media_col)))


_DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text through its file and back: sizes, the hashes of the payload read back and of the file, and the image's
    feature.

    A null text counts as empty; an empty text is one block of zeros. Equal texts give equal values, whatever stands
    beside them. Texts are stored whole; one of more than four gigabytes does not fit a frame and is an error. Other
    columns are not carried.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            del texts
            for s in together([*map(len, data)]):
                files = to_files([payload(d) for d in data[s]])
                back = from_files(files)
                columns = [
                    [len(d) for d in data[s]],
                    [len(p) for p, _ in back],
                    [hashlib.sha256(p).hexdigest() for p, _ in back],
                    [zlib.crc32(p[-BLOCK:]) for p, _ in back],
                    [len(f) for f in files],
                    [hashlib.sha256(f).hexdigest() for f in files],
                    [feature(image) for _, image in back],
                ]
                names = [c.split()[0] for c in _DIGEST.split(", ")]
                kinds = [pa.string() if c.endswith("string") else pa.int64() for c in _DIGEST.split(", ")]
                own = b.column(0).slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_arrays([own, *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["record_id", *names])

    rows = in_batches(df).select(F.col(id_col).alias("record_id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(work, f"record_id {rows.schema['record_id'].dataType.simpleString()}, {_DIGEST}")
    return found.withColumnRenamed("record_id", id_col)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a progressive JPEG, read back."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
