"""Media columns: FLAC streams in a binary column, read back as PCM blocks with seekable offsets.

Each stream is decoded from its stored bytes alone (Rice residuals, constant, verbatim, fixed and
linear predictors), header and frame checksums and the MD5 of the samples are verified, and PCM is
handed out in blocks that carry the place of their first sample (`pcm_blocks`), and can be written so
(`write_blocks`): a reader finds any sample with one comparison on (stream, first_sample) (`read_samples`).

Rows are independent: there is no shuffle and no group. Work goes in slices of a few MB whatever the
batch is; one row is held whole. Null or empty text makes a stream of padding; a null stream gives no
blocks. A damaged stream raises ValueError. Repeated rows repeat their results, an empty table gives
an empty one. Other columns are not read, so their names don't matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import flac

SLICE_BYTES = 4 << 20
BLOCK_SAMPLES = 65536
PAD = b" "


def pad(data: bytes) -> bytes:
    """data with spaces up to a positive multiple of the frame size."""
    return data + PAD * ((-len(data)) % flac.BLOCK or (0 if data else flac.BLOCK))


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > SLICE_BYTES:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def encode_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (of the text in UTF-8) and media: its padded bytes as an 8-bit mono FLAC stream."""
    schema = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, data = batch.column(0), batch.column(1).to_pylist()
            for a, z in _slices([len(d) for d in data]):
                media = flac.encode_many([pad(d) for d in data[a:z]])
                yield pa.RecordBatch.from_arrays([keys[a:z], pa.array([len(d) for d in data[a:z]], pa.int64()), pa.array(media, pa.binary())], schema=schema)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    return rows.mapInArrow(run, "key long, n_bytes long, media binary").withColumnRenamed("key", key)


def blocks_of(media: list[bytes], samples: int = BLOCK_SAMPLES) -> list[list[tuple[int, int, bytes]]]:
    """For each stream its PCM blocks: first sample, number of samples, bytes."""
    out = []
    for stream, pcm in zip(media, flac.decode_many(media), strict=True):
        info = flac.read_info(stream)
        width = info.channels * ((info.depth + 7) // 8)
        out.append([(a // width, min(samples, (len(pcm) - a) // width), pcm[a : a + samples * width]) for a in range(0, len(pcm), samples * width)])
    return out


def pcm_blocks(streams: DataFrame, key: str, media: str = "media", samples: int = BLOCK_SAMPLES) -> DataFrame:
    """Rows key, block, first_sample, n_samples, channels, depth, rate, pcm for every stored stream."""
    fields = [("key", pa.int64()), ("block", pa.int32()), ("first_sample", pa.int64()), ("n_samples", pa.int32()), ("channels", pa.int32()), ("depth", pa.int32()), ("rate", pa.int32()), ("pcm", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, data = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, z in _slices([len(d) for d in data]):
                rows = []
                for k, stream, blocks in zip(keys[a:z], data[a:z], blocks_of(data[a:z], samples), strict=True):
                    info = flac.read_info(stream)
                    rows += [(k, i, first, n, info.channels, info.depth, info.rate, pcm) for i, (first, n, pcm) in enumerate(blocks)]
                cols = list(zip(*rows, strict=True)) or [[] for _ in fields]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], schema=pa.schema(fields))

    rows = streams.select(F.col(key).cast("long").alias("key"), F.col(media).alias("media")).filter(F.col("media").isNotNull())
    kinds = "key long, block int, first_sample long, n_samples int, channels int, depth int, rate int, pcm binary"
    return rows.mapInArrow(run, kinds).withColumnRenamed("key", key)


def write_blocks(streams: DataFrame, key: str, path: str, media: str = "media", samples: int = BLOCK_SAMPLES) -> None:
    """The PCM blocks of all streams as Parquet at path."""
    pcm_blocks(streams, key, media, samples).write.parquet(path)


def read_samples(spark: SparkSession, path: str, key: str, stream: int, first: int, count: int) -> bytes:
    """PCM of samples first .. first + count of one written stream; only the blocks that hold them are read."""
    blocks = spark.read.parquet(path).filter((F.col(key) == stream) & (F.col("first_sample") < first + count) & (F.col("first_sample") + F.col("n_samples") > first))
    out = b""
    for row in blocks.orderBy("first_sample").toLocalIterator():  # a block at a time
        width = len(row.pcm) // row.n_samples
        a, z = max(0, first - row.first_sample), first + count - row.first_sample
        out += bytes(row.pcm[a * width : z * width])
    return out


def feature(pcm: bytes) -> str:
    """Mean, root mean square, peak and zero crossings of 8-bit samples."""
    x = np.frombuffer(pcm, dtype=np.uint8).astype(np.int32) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"mean={x.mean():.4f};rms={float(np.sqrt((x * x).mean())):.4f};peak={int(np.abs(x).max())};crossings={crossings}"


def digest(streams: DataFrame, key: str = "doc_id") -> DataFrame:
    """What the stored streams hold: key, n_bytes, payload and media lengths and digests, feature."""
    fields = [("key", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(2).to_pylist()
            for a, z in _slices([len(m) for m in media]):
                rows = []
                for stream, blocks in zip(media[a:z], blocks_of(media[a:z]), strict=True):
                    pcm = b"".join(b for _, _, b in blocks)
                    rows.append((len(pcm), hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-16:]), len(stream), hashlib.sha256(stream).hexdigest(), feature(pcm)))
                own = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields[2:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:z], batch.column(1)[a:z], *own], schema=pa.schema(fields))

    kinds = "key long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return streams.select(F.col(key).alias("key"), "n_bytes", "media").mapInArrow(run, kinds).withColumnRenamed("key", key)
