"""Document fingerprints by content-defined chunking.

A gear hash over the last WINDOW bytes runs along the text; a chunk ends where its top bits are zero.
Normalised cutting asks for more zero bits before the usual size and fewer after it, so sizes stay
near that size. Boundaries depend on nearby bytes only: an insertion moves one or two chunks and
leaves all later ones as they were. A fingerprint is the set of chunk digests with their lengths;
containment weighs shared digests by length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import bound_batches, chunks, utf8
from colloquy.session import materialize

WINDOW = 16
MIN_CHUNK, USUAL_CHUNK, MAX_CHUNK = 24, 64, 256
STRICT_BITS, LOOSE_BITS = 7, 5
#: A fingerprint has 6 bytes of digest per chunk and one for its length less 1.
DIGEST_BYTES = 6

#: One random 32-bit number per byte value, from a fixed rule.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=2024) for b in range(256)], dtype=np.uint32)


def gear_hashes(data: bytes) -> np.ndarray:
    """At each byte the gear hash of the WINDOW bytes that end there, by doubling spans."""
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    span = 1
    while span < WINDOW:
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    return h


def _cuts(length: int, strict: list[int], loose: list[int]) -> Iterator[tuple[int, int]]:
    start, i, j = 0, 0, 0
    while start < length:
        if length - start <= MIN_CHUNK:
            yield start, length
            return
        low, usual, most = start + MIN_CHUNK, start + USUAL_CHUNK, min(start + MAX_CHUNK, length)
        while i < len(strict) and strict[i] < low:
            i += 1
        end = most
        if i < len(strict) and strict[i] < usual:
            end = min(strict[i], most)
        else:
            while j < len(loose) and loose[j] < usual:
                j += 1
            if j < len(loose) and loose[j] < most:
                end = loose[j]
        yield start, end
        start = end


def fingerprints(texts: list[bytes]) -> list[dict[bytes, int]]:
    """Chunk digests of each text with their lengths; equal chunks count once."""
    out: list[dict[bytes, int]] = []
    for first, last in chunks([len(t) for t in texts]):
        joined = b"".join(texts[first:last])
        h = gear_hashes(joined) if joined else np.zeros(0, dtype=np.uint32)
        loose_at = np.flatnonzero(h >> np.uint32(32 - LOOSE_BITS) == 0)
        strict_at = loose_at[h[loose_at] >> np.uint32(32 - STRICT_BITS) == 0] + 1
        loose_at = loose_at + 1
        offset = 0
        for text in texts[first:last]:
            end = offset + len(text)
            own = [
                (at[np.searchsorted(at, offset):np.searchsorted(at, end, "right")] - offset).tolist()
                for at in (strict_at, loose_at)
            ]
            seen: dict[bytes, int] = {}
            for a, b in _cuts(len(text), *own):
                seen[xxhash.xxh3_64_digest(text[a:b])[:DIGEST_BYTES]] = b - a
            out.append(seen)
            offset = end
    return out


def pack(chunk_set: dict[bytes, int]) -> bytes:
    return b"".join(d + bytes([n - 1]) for d, n in sorted(chunk_set.items()))


def containment(a: dict[bytes, int], b: dict[bytes, int]) -> float:
    """Length of the shared chunks as a share of the smaller side; two empty texts are alike."""
    if not a or not b:
        return float(a == b)
    shared = sum(n for d, n in a.items() if d in b)
    return shared / min(sum(a.values()), sum(b.values()))


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(rows: list[tuple[str, str]]) -> list[tuple]:
    """For (text, next text): digest of the edited text, both fingerprints, likenesses."""
    edited = [utf8(_edited(t, f)) for t, f in rows]
    own = fingerprints([utf8(t) for t, _ in rows])
    changed = fingerprints(edited)
    following = fingerprints([utf8(f) for _, f in rows])
    return [
        (len(t), hashlib.sha256(e).hexdigest(), pack(a), pack(b), containment(a, b), containment(a, n))
        for (t, _), e, a, b, n in zip(rows, edited, own, changed, following)
    ]


_RESULT = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_FIELDS = [f.split()[0] for f in _RESULT.split(", ")]


def _run(ids: list, texts: list[str], follow: str) -> list[tuple]:
    """Rows of one run of neighbours; `follow` is the text after the last of them."""
    edited = [utf8(_edited(t, f)) for t, f in zip(texts, texts[1:] + [follow])]
    own = fingerprints([utf8(t) for t in [*texts, follow]])
    changed = fingerprints(edited)
    return [
        (ids[i], len(t), hashlib.sha256(edited[i]).hexdigest(), pack(own[i]), pack(changed[i]),
         containment(own[i], changed[i]), containment(own[i], own[i + 1]))
        for i, t in enumerate(texts)
    ]


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a sorted partition against their followers; its first and last row wait for others."""
    columns = ["doc_id", *_FIELDS, "part", "edge", "edge_text"]
    part, held = None, None
    for batch in batches:
        ids = [None if missing else int(i) for i, missing in zip(batch["doc_id"], batch["doc_id"].isna())]
        texts = [t or "" for t in batch["text"]]
        if not texts:
            continue
        rows: list[tuple] = []
        if part is None:
            part = int(batch["part"].iloc[0])
            yield pd.DataFrame([(None, *[None] * len(_FIELDS), part, "first", texts[0])], columns=columns)
        if held is not None:
            ids, texts = [held[0], *ids], [held[1], *texts]
        for a, b in chunks([len(t) for t in texts[:-1]]):
            rows = [(*r, part, None, None) for r in _run(ids[a:b], texts[a:b], texts[b])]
            yield pd.DataFrame(rows, columns=columns)
        held = ids[-1], texts[-1]
    if held is not None:
        yield pd.DataFrame([(held[0], *[None] * len(_FIELDS), part, "last", held[1])], columns=columns)


def edit_fingerprints(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, with likenesses to the edit and the next text.

    The next document is the next in descending doc_id (ties by text hash, rows without an id last);
    after the last comes the first. The edited text has its last half replaced by as much of the next
    text. Null and empty texts have an empty fingerprint; two empty fingerprints are alike (1), an
    empty and another are not (0). Repeated rows follow one another. An empty table gives no rows; a
    single row follows itself. Only doc_id and text are read.

    One range shuffle brings neighbours together; every partition then streams. The rows at the edges
    of partitions, two a partition, are matched in a second small step.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc_nulls_last("doc_id"), F.asc("tie"), F.asc("seq")]
    sorted_rows = (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .withColumn("tie", F.xxhash64("text"))
        # Splits rows that agree in all else, so that many copies of a row do not meet in one task.
        .withColumn("seq", F.monotonically_increasing_id())
        .repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text", F.spark_partition_id().cast("long").alias("part"))
    )
    walked = materialize(
        sorted_rows.mapInPandas(_walk, f"doc_id long, {_RESULT}, part long, edge string, edge_text string")
    )
    inner = walked.where("edge is null").select("doc_id", *_FIELDS)
    # One row a partition that has rows: the text of its first row, and of its last.
    firsts = walked.where("edge = 'first'").select("part", "edge_text")
    parts = sorted(r["part"] for r in firsts.select("part").collect())
    following = spark.createDataFrame(
        [(a, b) for a, b in zip(parts, parts[1:] + parts[:1])], "part long, next_part long"
    )
    ends = (
        walked.where("edge = 'last'").select("doc_id", "part", F.col("edge_text").alias("text"))
        .join(following, "part")
        .join(firsts.select(F.col("part").alias("next_part"), F.col("edge_text").alias("next_text")), "next_part")
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                found = _compare([(row["text"] or "", row["next_text"] or "")])[0]
                yield pd.DataFrame([(None if pd.isna(row["doc_id"]) else int(row["doc_id"]), *found)], columns=["doc_id", *_FIELDS])

    closing = ends.select("doc_id", "text", "next_text").mapInPandas(compare, f"doc_id long, {_RESULT}")
    return inner.unionByName(closing)
