"""Language-model scores with stupid backoff, computed over tables of n-gram counts.

The corpus scores itself: every document is scored by the n-gram counts of all other
documents (its own are subtracted, or nothing would ever back off). With counts so taken,
a word after its context scores count(context word) / count(context) at the longest
context with both counts above zero, times ALPHA for each word of context dropped; a word
that no other document has scores as half an occurrence.

Steps: (1) documents are packed in batches of about WORDS words, each with its distinct
words' hashes; (2) each batch's distinct n-grams (all orders) are exploded to the
partitions of the count table, which is dealt by hash: one entry for a batch and n-gram,
so a hot n-gram has at most as many entries as there are batches; (3) each partition adds
up its counts and joins them to the entries; (4) the counts return to their batches and
are summed to scores per document. N-grams travel as sorted 64-bit hashes in blocks.

Defined cases: null, empty and wordless texts have n_words 0, score 0 and a null mean;
rows are documents of their own, so repeated rows count for each other; a text of any
length is scored whole; an empty table gives an empty table. Only the named columns are
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.base import materialize

ALPHA = 0.4
#: Words after which a batch is closed, between documents.
WORDS = 900_000
#: N-grams of the corpus for one partition of the count table, before batches count theirs
#: together: from the first number, up to the second where there would be over PARTS partitions.
ENTRIES, MOST_ENTRIES, PARTS = 2_000_000, 8_000_000, 256
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

PACKED = "batch long, part int, n_words long, payload binary, counts binary"


def _squeeze(numbers: np.ndarray) -> bytes:
    """Integers as zstd of their byte planes."""
    raw = np.ascontiguousarray(numbers)
    planes = raw.view(np.uint8).reshape(-1, raw.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _expand(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).reshape(-1)


def _pack(keys: list, lengths: list[int], words: list[bytes]) -> bytes:
    known: dict[bytes, int] = {}
    tokens = np.array([known.setdefault(w, len(known)) for w in words], np.uint32)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
    missing = np.array([k is None for k in keys], np.uint8)
    parts = (np.array([k or 0 for k in keys], np.int64), missing, np.array(lengths, np.int64), hashes, tokens)
    blocks = [_squeeze(x) for x in parts]
    return np.array([len(b) for b in blocks], "<i8").tobytes() + b"".join(blocks)


class Batch:
    """A packed batch and its n-grams."""

    def __init__(self, payload: bytes, order: int):
        sizes = np.frombuffer(payload[:40], "<i8").tolist()
        at, parts = 40, []
        for size, kind in zip(sizes, (np.int64, np.uint8, np.int64, np.uint64, np.uint32), strict=True):
            parts.append(_expand(payload[at : at + size], kind))
            at += size
        self.keys, self.missing, self.lengths, hashes, tokens = parts
        self.order, n = order, len(tokens)
        self.document = np.repeat(np.arange(len(self.lengths)), self.lengths)
        first = np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.place = np.arange(n) - first  # of a word in its document
        word = hashes[tokens] if n else np.zeros(0, np.uint64)
        self.grams: list[np.ndarray] = []  # by order: name of the n-gram that ends at each word
        for size in range(1, order + 1):
            if size == 1:
                name = word * _MULTIPLIER
            else:
                before = np.concatenate((np.zeros(min(size - 1, n), np.uint64), word[: max(0, n - size + 1)]))
                name = (self.grams[-1] ^ (before >> np.uint64(31))) * _MULTIPLIER + before
            name = (name ^ (name >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            self.grams.append(name ^ (name >> np.uint64(32)) ^ np.uint64(size))
        self.valid = [self.place >= size for size in range(order)]
        held = np.concatenate([g[v] for g, v in zip(self.grams, self.valid, strict=True)]) if n else np.zeros(0, np.uint64)
        self.names, self.which, self.counts = np.unique(held, return_inverse=True, return_counts=True)

    def cut(self, bits: int) -> Iterator[tuple[int, slice]]:
        """The parts of the count table and where their names stand."""
        part = (self.names >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(self.names), np.int64)
        edges = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(part)], strict=True):
            if b > a:
                yield int(part[a]), slice(a, b)

    def scores(self, totals: np.ndarray, all_words: int) -> np.ndarray:
        """Sum of the logarithms of the words' scores, by document."""
        n = len(self.document)
        if not n:
            return np.zeros(len(self.lengths))
        others = []  # by order: occurrences in other documents, at each word
        documents = np.concatenate([self.document[v] for v in self.valid])
        own = np.unique(documents * len(self.names) + self.which, return_inverse=True, return_counts=True)
        other = totals[self.which] - own[2][own[1]]
        at = 0
        for v in self.valid:
            full = np.zeros(n, np.int64)
            full[v] = other[at : at + int(v.sum())]
            at += int(v.sum())
            others.append(full)
        rest = np.maximum(all_words - self.lengths[self.document], 1)
        score = np.log(np.where(others[0] > 0, others[0], 0.5) / rest)
        log_alpha = np.log(ALPHA)
        for size in range(2, self.order + 1):
            score = score + log_alpha * self.valid[size - 1]
            context = np.concatenate((np.zeros(1, np.int64), others[size - 2][:-1]))
            seen = self.valid[size - 1] & (others[size - 1] > 0) & (context > 0)
            score[seen] = np.log(others[size - 1][seen] / context[seen])
        return np.bincount(self.document, score, len(self.lengths))


def batches(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """One row per batch: batch, part -1, n_words, payload, no counts."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, keys, lengths, held = TaskContext.get().partitionId() << 32, [], [], []

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"batch": pa.array([number], pa.int64()), "part": pa.array([-1], pa.int32()), "n_words": pa.array([len(held)], pa.int64()), "payload": pa.array([_pack(keys, lengths, held)], pa.binary()), "counts": pa.array([None], pa.binary())})

        for rows_in in rows:
            for k, t in zip(rows_in.column(0).to_pylist(), rows_in.column(1), strict=True):
                own = (t.as_py() or "").encode().split()
                keys.append(k)
                lengths.append(len(own))
                held += own
                if len(held) >= words or len(keys) >= words:
                    yield close()
                    number, keys, lengths, held = number + 1, [], [], []
        if keys:
            yield close()

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, PACKED)


def entries(packed: DataFrame, order: int, bits: int) -> DataFrame:
    """Each batch's distinct n-grams by part of the count table, with their counts."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_in in rows:
            for number, payload in zip(rows_in.column("batch").to_pylist(), rows_in.column("payload"), strict=True):
                batch = Batch(payload.as_py(), order)
                found = list(batch.cut(bits))
                if found:
                    yield pa.RecordBatch.from_pydict(
                        {
                            "batch": pa.array([number] * len(found), pa.int64()),
                            "part": pa.array([p for p, _ in found], pa.int32()),
                            "n_words": pa.array([s.stop - s.start for _, s in found], pa.int64()),
                            "payload": pa.array([_squeeze(np.diff(batch.names[s], prepend=np.uint64(0))) for _, s in found], pa.binary()),
                            "counts": pa.array([_squeeze(batch.counts[s].astype(np.uint32)) for _, s in found], pa.binary()),
                        }
                    )

    return packed.mapInArrow(run, PACKED)


def counted(exploded: DataFrame) -> DataFrame:
    """The entries with the corpus' counts in place of their own."""

    def total(held: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        names, counts = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held]).astype(np.int64)
        order = np.argsort(names, kind="stable")
        ordered = names[order]
        first = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1))
        sums = np.add.reduceat(counts[order], first)
        back = np.empty(len(names), np.int64)
        back[order] = np.repeat(sums, np.diff(np.append(first, len(names))))
        ends = np.cumsum([len(x[2]) for x in held])
        return pa.RecordBatch.from_pydict(
            {
                "batch": pa.array([x[0] for x in held], pa.int64()),
                "part": pa.array([x[1] for x in held], pa.int32()),
                "n_words": pa.array([len(x[2]) for x in held], pa.int64()),
                "payload": pa.array([None] * len(held), pa.binary()),
                "counts": pa.array([_squeeze(x) for x in np.split(back, ends[:-1])], pa.binary()),
            }
        )

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for rows_in in rows:
            for number, part, payload, counts in zip(*(rows_in.column(c) for c in ("batch", "part", "payload", "counts")), strict=True):
                if held and held[-1][1] != part.as_py():
                    yield total(held)
                    held = []
                held.append((number.as_py(), part.as_py(), np.cumsum(_expand(payload.as_py(), np.uint64), dtype=np.uint64), _expand(counts.as_py(), np.uint32)))
        if held:
            yield total(held)

    return exploded.repartition(F.col("part")).sortWithinPartitions("part").mapInArrow(run, PACKED)


def part_bits(grams: int) -> int:
    """Bits of a hash that number the partitions of the count table. Each batch has one entry
    row for each, so a large corpus gets fewer, fuller partitions."""
    each = min(max(ENTRIES, grams // PARTS), MOST_ENTRIES)
    return max(4, int(grams // each).bit_length())


def score(docs: DataFrame, order: int = 2, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """key, n_words, log_score (natural logarithm, summed over words), mean_log_score."""
    packed = materialize(batches(docs, key, text, words), "lm-batches")
    all_words = packed.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    bits = part_bits(order * all_words)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, got = None, []

        def close() -> pa.RecordBatch:
            totals = np.concatenate(got) if got else np.zeros(0, np.int64)
            if len(totals) != len(batch.names):
                raise ValueError("counts are missing for a batch")
            found = batch.scores(totals, all_words)
            keys = pa.array(batch.keys, pa.int64(), mask=batch.missing.astype(bool))
            return pa.RecordBatch.from_arrays([keys, pa.array(batch.lengths), pa.array(found)], names=[key, "n_words", "log_score"])

        for rows_in in rows:
            for part, payload, counts in zip(*(rows_in.column(c) for c in ("part", "payload", "counts")), strict=True):
                if part.as_py() < 0:
                    if batch is not None:
                        yield close()
                    batch, got = Batch(payload.as_py(), order), []
                else:
                    got.append(_expand(counts.as_py(), np.int64))
        if batch is not None:
            yield close()

    returned = packed.unionByName(counted(entries(packed, order, bits))).repartition(F.col("batch")).sortWithinPartitions("batch", "part")
    return returned.mapInArrow(run, f"{key} long, n_words long, log_score double").withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
