"""Operator 6: quartile bucket digests of whole texts.

Byte triplets (three shapes within four consecutive bytes) are hashed into 256 buckets and counted. The
three quartiles of the counts turn each count into a code of two bits. A digest is the length on a log scale,
two ratios of the quartiles, and the 256 codes, as hex. The difference of two digests adds up the steps
between codes (three steps count six), and the differences of length and ratios; it is bounded by `FARTHEST`,
and likeness is one minus its share of that.

Defined results: null and empty texts have the digest of no bytes; texts below three bytes have no triplets;
equal texts have equal digests and likeness 1; the order of documents is by id, equal ids by text, a null id
lowest; a single document is its own next; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewatch.llm.common import long_rows, partitions
from zonewatch.llm.neighbours import beside, cuts

BUCKETS = 256
FARTHEST = 400
CHUNK = 1 << 19
_SHAPES = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
_MULTIPLIERS = np.array([[0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], [0x27D4EB2F, 0x165667B1, 0xD3A2646D],
                         [0xFD7046C5, 0xB55A4F09, 0x8DA6B343]], dtype=np.uint32)
_STEP = np.array([0, 1, 2, 6])


def bucket_counts(data: bytes) -> np.ndarray:
    counts = np.zeros(BUCKETS, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    for at in range(0, len(raw), CHUNK):
        b = raw[at:at + CHUNK + 3].astype(np.uint32)
        for shape, (x, y, z) in zip(_SHAPES, _MULTIPLIERS):
            reach = min(CHUNK, len(b) - shape[2])
            if reach > 0:
                with np.errstate(over="ignore"):
                    h = b[shape[0]:shape[0] + reach] * x + b[shape[1]:shape[1] + reach] * y + b[shape[2]:shape[2] + reach] * z
                    h ^= h >> np.uint32(15)
                    h *= np.uint32(0x2C1B3C6D)
                counts += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return counts


def codes_of(data: bytes) -> np.ndarray:
    """Length code, two ratio codes, and the code of each bucket."""
    counts = bucket_counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    length = min(255, int(np.log(len(data) + 1.0) * 12))
    ratios = (int(q1 * 15 // q3), int(q2 * 15 // q3)) if q3 else (0, 0)
    return np.concatenate([[length, *ratios], codes]).astype(np.uint8)


def as_text(codes: np.ndarray) -> str:
    c = codes[3:].reshape(-1, 4)
    packed = c[:, 0] | (c[:, 1] << 2) | (c[:, 2] << 4) | (c[:, 3] << 6)
    return f"{codes[0]:02x}{codes[1]:x}{codes[2]:x}" + packed.astype(np.uint8).tobytes().hex()


def from_text(digest: str) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex(digest[4:]), dtype=np.uint8)
    codes = np.stack([(packed >> s) & 3 for s in (0, 2, 4, 6)], axis=1).reshape(-1)
    return np.concatenate([[int(digest[:2], 16), int(digest[2], 16), int(digest[3], 16)], codes]).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    apart = np.abs(a.astype(np.int64) - b)
    length = int(apart[0])
    total = int(_STEP[apart[3:]].sum()) + max(0, length - 1) * 2 + int(apart[1] + apart[2])
    return 1.0 - min(total, FARTHEST) / FARTHEST


def fingerprint_column(texts: pa.Array) -> list[str]:
    return [as_text(codes_of((t or "").encode())) for t in texts.to_pylist()]


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of all (doc_id, text), of the edited texts, and their likeness; see the contract.

    In ascending order the next document in descending order is the row before."""
    long_rows(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key_"))
    spans = cuts(rows, "key_", 3 * partitions(docs.sparkSession))
    dealt = beside(rows, "key_", spans, ["text"], round_trip=True).select("doc_id", "text", "range_", "order_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, before = None, None
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
            for doc_id, text, r, order in zip(*(c.to_pylist() for c in batch.columns)):
                if r != here:
                    here, before = r, None
                if order == 2:
                    continue
                codes = codes_of(text.encode())
                if order == 1:
                    following = before or (text, codes)
                    changed = edited(text, following[0]).encode()
                    theirs = codes_of(changed)
                    for k, v in zip(out, (doc_id, len(text), hashlib.sha256(changed).hexdigest(), as_text(codes), as_text(theirs),
                                          likeness(codes, theirs), likeness(codes, following[1]))):
                        out[k].append(v)
                before = (text, codes)
            yield pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), (
                batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=list(out))

    id_type = dict(docs.dtypes)["doc_id"]
    return dealt.mapInArrow(run, f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                 "near_edited double, near_next double")
