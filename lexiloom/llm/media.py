"""Media columns: texts stored as AVI motion-JPEG, and the timed clips of such files.

A text's UTF-8 bytes, filled with bytes 255 to a positive number of whole frames, are the samples of grey frames. Reading
parses the RIFF index, decodes each intra frame losslessly and cuts the frames into shots where their histograms'
difference stands out from those around it.

Defined results: a null or empty text is one frame of 255; equal texts give equal files; repeated rows are stored one by
one; a null media value gives no clips; a file that cannot be read (no AVI, broken frames, another coding) gives one row
without a clip that tells the reason, and no other file is the worse for it; frames of several sizes are compared by the
shares of their histograms; an empty table gives an empty result; extra columns are left aside.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import avi
from .common import slices, table


def encode_texts(texts: list[bytes]) -> list[bytes]:
    """An AVI file of each text; the frames of all are encoded together."""
    padded = [t.ljust(max(1, -(-len(t) // avi.SAMPLES)) * avi.SAMPLES, b"\xff") for t in texts]
    frames = avi.encode_frames(np.frombuffer(b"".join(padded), np.uint8).reshape(-1, avi.SIDE, avi.SIDE))
    files, at = [], 0
    for p in padded:
        n = len(p) // avi.SAMPLES
        files.append(avi.write_avi(frames[at : at + n]))
        at += n
    return files


def decode_files(files: list[bytes]) -> list[tuple[list[np.ndarray], float]]:
    """Frames and frame rate of each file; the frames of all are decoded together."""
    read = [avi.read_avi(f) for f in files]
    samples = avi.decode_frames([f for frames, _ in read for f in frames])
    ends = np.cumsum([0, *(len(frames) for frames, _ in read)]).tolist()
    return [(samples[a:b], rate) for a, b, (_, rate) in zip(ends[:-1], ends[1:], read, strict=True)]


def decode_any(files: list[bytes]) -> list[tuple[list[np.ndarray], float, str | None]]:
    """Frames, frame rate and the reason why there are none, of each file."""
    try:
        return [(*f, None) for f in decode_files(files)]
    except (ValueError, IndexError, KeyError, struct.error, ZeroDivisionError) as error:  # what broken files make of their own lengths and numbers
        if len(files) == 1:
            return [([], 0.0, f"{type(error).__name__}: {error}")]
        return [found for f in files for found in decode_any([f])]


def clips_of(samples: list[np.ndarray], rate: float) -> list[tuple[int, float, float, int, float]]:
    """(clip, start_s, end_s, frames, mean difference) of a file's shots."""
    return [(k, a / rate, b / rate, b - a, d) for k, (a, b, d) in enumerate(avi.shots(samples))] if len(samples) else []


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, media of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            files = encode_texts([(t or "").encode() for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(files, pa.binary())], ["doc_id", "media"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, media binary")


CLIP = "doc_id long, clip int, start_s double, end_s double, frames int, difference double, reason string"


def clips(media: DataFrame) -> DataFrame:
    """CLIP: a row for each clip of media (doc_id, media), or one with the reason why a file has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 1 << 20):
            have = [(i, m) for i, m in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True) if m is not None]
            rows = []
            for (i, _), (samples, rate, reason) in zip(have, decode_any([m for _, m in have]), strict=True):
                rows += [(i, *clip, None) for clip in clips_of(samples, rate)] or [(i, None, None, None, None, None, reason or "no frames")]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in CLIP.split(", ")])

    return media.selectExpr("cast(doc_id as long) doc_id", "media").mapInArrow(run, CLIP)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(docs: DataFrame) -> DataFrame:
    """Stores each text, reads the stored bytes back, and returns digests of both and the clips as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            files = encode_texts(texts)
            rows = []
            for doc_id, text, file, (samples, rate) in zip(batch.column("doc_id").to_pylist(), texts, files, decode_files(files), strict=True):
                payload = b"".join(frame.tobytes() for frame in samples)
                feature = f"{samples[0].shape[1]}x{samples[0].shape[0]}@{rate:g};" + ";".join(f"{a:.2f}-{b:.2f}:{d:.4f}" for _, a, b, _, d in clips_of(samples, rate))
                rows.append((doc_id, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in DIGEST.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, DIGEST)


def op4_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
