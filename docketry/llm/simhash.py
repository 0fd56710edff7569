"""SimHash near duplicates by multi-index hashing.

Fingerprints: ASCII letters are lowered, words are runs of characters other than ASCII
white space, and a bit is set if it is set in over half of the XXH64 hashes of the
`width`-word shingles (repeats count; a shorter text is one shingle; no word: zero).

Search: the 64 bits are cut into segments, and segment i gets a radius r_i so that the
r_i + 1 add up to radius + 1. Two fingerprints that differ in at most `radius` bits then
differ in at most r_i bits within some segment i (pigeonhole). Each distinct fingerprint
enters its own value of each segment in a table and probes the table at all values
within r_i bits; what meets there is verified on all 64 bits. Equal fingerprints are one
class from the start. Few fingerprints need only narrow segments, which need no balls; the
more there are, the wider segments are taken, so that about as many meet in a place at any
size (plan_segments).

Only the links' connected components are wanted, so in a place with more links than
rows, links are followed breadth first and a fingerprint that has been reached is taken
out: a group of near copies costs a few sweeps and gives a tree, never all pairs. A place
with over LARGE fingerprints is first split by radius + 1 groups of the other bits (one of
which must agree) where these groups are wide enough to tell, which keeps every link.

Defined cases: null and empty texts have fingerprint zero and are linked like any other;
a null key takes part but names no component unless all its keys are null; rows that
share a key or a text are rows of their own; an empty table gives an empty table. Only
the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from docketry.llm.base import materialize
from docketry.llm.components import components

BITS = 64
#: Bits of a segment, at least, where their number is chosen.
NARROWEST = 16
#: Fingerprints that meet in one place before it is split by further bits.
LARGE = 16384
#: Up to so many fingerprints, a place is compared beside others.
MIDDLE = 4096
#: Links per fingerprint from which on a place gives a tree instead of all its links.
FEW = 4
#: Rows of whole places that are compared at once.
TOGETHER = 1 << 17


def shingles(text: str | None, width: int) -> tuple[bytes, list[int], list[int]]:
    """The text's words joined by spaces, and where its shingles begin and end in that."""
    words = (text or "").encode().lower().split()
    if not words:
        return b"", [], []
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    if len(words) < width:
        return joined, [0], [len(joined)]
    return joined, [0, *(e + 1 for e in ends[: len(words) - width])], ends[width - 1 :]


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    joined, begins, ends = shingles(text, width)
    n = len(begins)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(begins, ends, strict=True)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        some = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """key, fp (a long of the 64 bits) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), width, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[key, "fp"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text")).mapInArrow(run, f"{key} long, fp long")


def segments(radius: int, count: int) -> list[tuple[int, int, int]]:
    """(lowest bit, width, radius) of each segment; bits beyond 48 of a segment are left
    out, which keeps every link."""
    count = min(count, radius + 1)
    spare = radius + 1 - count
    found, at = [], 0
    for i in range(count):
        width = BITS // count + (i < BITS % count)
        found.append((at, min(width, 48), spare // count + (i < spare % count)))
        at += width
    return found


def places(fp: Column, radius: int, count: int) -> Column:
    """Array of the places where a fingerprint is entered (first of each segment) or probes."""
    found = []
    for i, (low, width, near) in enumerate(segments(radius, count)):
        own = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
        flips = [sum(1 << b for b in bits) for n in range(near + 1) for bits in combinations(range(width), n)]
        tagged = own.bitwiseOR(F.lit(i << 48))
        found += [tagged.bitwiseXOR(F.lit(x)) for x in flips]
    return F.array(*[x.cast("long") for x in found])


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints of one word, or of several in the last axis."""
    bits = np.bitwise_count(a ^ b)
    return bits if a.ndim == 1 else bits.sum(axis=-1, dtype=np.int64)


def _tree(fps: np.ndarray, radius: int) -> list[tuple[int, np.ndarray]]:
    """Breadth-first trees over the links of fingerprints: (place, places that it adds)."""
    made, left = [], np.arange(len(fps))
    words = [np.ascontiguousarray(w) for w in fps.reshape(len(fps), -1).T]
    own = fps.reshape(len(fps), -1)
    while len(left) > 1:
        queue, left, words = [left[0]], left[1:], [w[1:] for w in words]
        while queue and len(left):
            node = queue.pop()
            bits = np.bitwise_count(words[0] ^ own[node, 0])
            for w, x in zip(words[1:], own[node, 1:], strict=True):
                bits = np.add(bits, np.bitwise_count(w ^ x), dtype=np.uint16)
            near = bits <= radius
            if near.any():
                made.append((node, left[near]))
                queue.extend(left[near])
                left, words = left[~near], [w[~near] for w in words]
    return made


def _links(fps: np.ndarray, radius: int) -> list[tuple[int, np.ndarray]]:
    flat = fps.reshape(len(fps), -1)
    if len(fps) <= LARGE or 1 << 64 * flat.shape[1] // (radius + 1) < 4 * radius:
        return _tree(fps, radius)
    bits = np.unpackbits(flat.view(np.uint8), axis=1, bitorder="little")
    made = []
    for group in np.array_split(np.arange(bits.shape[1]), radius + 1):  # one group must agree
        name = np.packbits(bits[:, group], axis=1)
        order = np.lexsort(name.T)
        cuts = np.flatnonzero((name[order][1:] != name[order][:-1]).any(axis=1)) + 1
        for part in np.split(order, cuts):
            made += [(part[node], part[reached]) for node, reached in _tree(fps[part], radius)]
    return made


def _near(which: np.ndarray, size: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All links within runs of equal `which`; size: of each row's run."""
    at, found, gap = np.arange(len(which)), [], 1
    while len(which) > gap:
        same = np.flatnonzero(which[gap:] == which[:-gap])
        if not len(same):
            break
        near = same[apart(fp[same + gap], fp[same]) <= radius]
        if len(near):
            found.append((at[near], at[near + gap]))
        gap += 1
        if gap & (gap - 1) == 0:  # only longer runs have rows that far apart
            more = size > gap
            which, size, fp, at = which[more], size[more], fp[more], at[more]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def met(place: np.ndarray, node: np.ndarray, fp: np.ndarray, radius: int, entered: np.ndarray | None = None, aside: list[tuple] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among rows of whole places, sorted by place. A place where nothing is entered
    (rows only probe) is passed over. Places with over FEW links per row, and those of over
    MIDDLE rows, give a tree, or, if `aside` is a list, nothing but their (place, node) in
    that list; there, rows without a link may be left out."""
    begins = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
    sizes = np.diff(np.append(begins, len(place)))
    which = np.repeat(np.arange(len(sizes)), sizes)
    useful = sizes > 1
    if entered is not None:
        useful &= np.bincount(which, entered, len(sizes)) > 0
    rows = np.flatnonzero((useful & (sizes <= MIDDLE))[which])
    u, v = _near(which[rows], sizes[which[rows]], fp[rows], radius)
    u, v = rows[u], rows[v]
    dense = np.bincount(which[u], minlength=len(sizes)) > FEW * sizes
    loose = ~dense[which[u]]
    if loose.any():
        yield node[u[loose]], node[v[loose]]
    crowded = useful & ((sizes > MIDDLE) | dense)
    if aside is not None:
        linked_rows = np.zeros(len(place), bool)
        linked_rows[u], linked_rows[v] = True, True
        chosen = crowded[which] & (linked_rows | (sizes > MIDDLE)[which])
        aside.append((place[chosen], node[chosen]))
        return
    for i in np.flatnonzero(crowded):
        here = slice(begins[i], begins[i] + sizes[i])
        for at, reached in _links(fp[here], radius):
            yield np.full(len(reached), node[here][at]), node[here][reached]


def linked(rows: DataFrame, radius: int, own: list[tuple[int, int]] | None = None, crowds_aside: bool = False) -> DataFrame:
    """rows: place, node and the fingerprint (words, or one binary column; none: the node is
    the fingerprint). Returns links u, v between nodes, of at most `radius` bits, with the
    same components as all such links within places; a link may come more than once. own:
    (lowest bit, width) of the segments that the high bits of place number, to tell entries
    from probes.

    A tree keeps the components only of links that nothing removes later. Where `radius` is
    a bound before the last one, use crowds_aside: places that `met` sets aside then give no
    link but each of their rows that has one as (u: node, v: null, place); other rows have a
    null place, and all links of their places are there."""
    words = len(rows.columns) - 2
    binary = words == 1 and isinstance(rows.schema[2].dataType, BinaryType)
    names = ["u", "v", "place"] if crowds_aside else ["u", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            place, node, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            entered = None
            if own:
                segment = (place >> np.int64(48)).astype(np.int64)
                low, width = (np.array(x, np.uint64) for x in zip(*own, strict=True))
                value = (fp >> low[segment]) & ((np.uint64(1) << width[segment]) - np.uint64(1))
                entered = value == (place & np.int64((1 << 48) - 1)).view(np.uint64)
            aside: list[tuple] | None = [] if crowds_aside else None
            for u, v in met(place, node, fp, radius, entered, aside):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64())][: len(names)], names=names)
            for where, u in aside or []:
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.nulls(len(u), pa.int64()), pa.array(where)], names=names)

        held: list[tuple] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            place, node = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:2])
            if binary:
                fp = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            elif words == 1:
                fp = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            else:
                wide = [c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]]
                fp = np.stack([x.view(np.uint64) for x in wide], axis=1) if words else node.view(np.uint64)
            last = int(np.searchsorted(place, place[-1]))  # the last place may go on in the next batch
            if count + last < TOGETHER or (last == 0 and held[-1][0][-1] == place[0]):
                held.append((place, node, fp))
                count += batch.num_rows
                continue
            held.append((place[:last], node[:last], fp[:last]))
            yield from links([x for x in held if len(x[0])])
            held, count = [(place[last:], node[last:], fp[last:])], batch.num_rows - last
        if held:
            yield from links(held)

    return rows.repartition(F.col("place")).sortWithinPartitions("place").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def plan_segments(radius: int, classes: int, meeting: int = 16) -> int:
    """The most segments of which each is wide enough that about `meeting` of so many even
    fingerprints share a value; two, with balls, at any size beyond. None has less than
    NARROWEST bits, as its values are what the work is dealt by."""
    for count in range(min(radius + 1, BITS // NARROWEST), 2, -1):
        if classes >> BITS // count < meeting:
            return count
    return min(2, radius + 1)


def links(classes: DataFrame, radius: int = 4, count: int = 3) -> DataFrame:
    """classes: distinct fp. Verified links of at most `radius` bits."""
    rows = classes.select(F.explode(places(F.col("fp"), radius, count)).alias("place"), F.col("fp").alias("node"))
    return linked(rows, radius, [(low, width) for low, width, _ in segments(radius, count)])


def cluster(prints: DataFrame, radius: int = 4, count: int | None = None, key: str = "doc_id") -> DataFrame:
    """prints: key, fp (a table; read more than once). Adds component_id: the least key
    that is reachable over links of at most `radius` bits, the row's own included. count: of
    segments; by the number of classes if None."""
    classes = materialize(prints.groupBy("fp").agg(F.min(key).alias("least")), "classes")
    count = count or plan_segments(radius, classes.count())
    stars = components(links(classes.select("fp"), radius, count))
    stars = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
    named = classes.join(stars, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = named.join(roots, "root").select("fp", "component_id")
    return prints.join(found, "fp").select(key, "fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, count: int | None = None, key: str = "doc_id", text: str = "text", seed: int = 42) -> DataFrame:
    """key, fingerprint (16 hexadecimal digits), component_id for every row of docs."""
    prints = materialize(fingerprints(docs, key, text, width, seed), "fingerprints")
    found = cluster(prints, radius, count, key)
    return found.select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Words of 64 bits in the fingerprints of `one_of_each`; the first travels to its tables.
WIDE = 16


def wide_fingerprint(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """As fingerprint, of WIDE * 64 bits, over the set of shingles."""
    joined, begins, ends = shingles(text, width)
    if not begins:
        return np.zeros(WIDE, np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in zip(begins, ends, strict=True)), np.uint64, len(begins)))
    n, counts = len(hashes), np.zeros(64 * WIDE, np.int64)
    salts = np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, n, 1 << 12):
        more = (hashes[at : at + (1 << 12), None] ^ salts) * np.uint64(0xBF58476D1CE4E5B9)
        more = (more ^ (more >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        more ^= more >> np.uint64(29)
        counts += np.unpackbits(more.view(np.uint8).reshape(len(more), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(counts * 2 > n, bitorder="little").view("<u8")


def differing(similarity: float) -> float:
    """Chance that a bit differs between sets of a Jaccard similarity: their cosine is
    2 s / (1 + s), and the chance is the angle over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def bound(similarity: float, bits: int, slack: float) -> int:
    """Differing bits at that similarity: the mean and `slack` standard deviations."""
    p = differing(similarity)
    return int(bits * p + slack * math.sqrt(bits * p * (1 - p)))


def plan_tables(similarity: float, classes: int, recall: float = 0.985) -> tuple[int, int]:
    """Bits of a table, and tables. A table's bits grow with the logarithm of the classes,
    at every size alike, so that about 16 of evenly spread ones meet in a place, and the
    tables grow to keep the recall of a pair at exactly `similarity`."""
    width = max(1, classes.bit_length() - 4)
    return width, math.ceil(math.log(1 - recall) / math.log(1 - (1 - differing(similarity)) ** width))


def one_of_each(docs: DataFrame, similarity: float = 0.8, width: int = 5, key: str = "doc_id", text: str = "text", seed: int = 42) -> DataFrame:
    """The rows of docs, all columns, that stay when one document is left of each group of
    near duplicates: the one of least key (null first), then of least hash of its text, then
    of its row.

    Groups are components of links between SimHash fingerprints over the sets of
    `width`-word shingles, at the distance that `similarity` implies. That is too far for
    balls around a few segments, so each class (of equal fingerprints, all WIDE * 64 bits) is
    entered in many tables of sampled bits (balls of radius 0). What meets there is compared
    on 64 bits with room for their error (three standard deviations), and what passes is
    verified on all bits (one standard deviation of similarity is about 0.03 there). Places
    with many links fetch all bits of the rows that have one and give trees of verified
    links only. The texts are read once for fingerprints and shuffled once for the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [wide_fingerprint(t.as_py(), width, seed).astype("<u8").tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["key", "hash", "full"])

    slim = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.col(text).cast("string")).alias("hash"), F.col(text).cast("string").alias("text"))
    grouped = slim.mapInArrow(run, "key long, hash long, full binary").groupBy("full").agg(F.min(F.struct("key", "hash")).alias("best"))
    classes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "wide-classes")  # numbered once, when written
    bits, tables = plan_tables(similarity, classes.count())
    rng = np.random.default_rng(seed)
    chosen = np.stack([rng.choice(64 * WIDE, bits, replace=False) for _ in range(tables)])

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                full = np.frombuffer(b"".join(some.column(0).to_pylist()), np.uint8).reshape(-1, 8 * WIDE)
                all_bits = np.unpackbits(full, axis=1, bitorder="little")
                first = pa.array(np.ascontiguousarray(full[:, :8]).view(np.int64).reshape(-1))
                for number, own in enumerate(chosen):
                    place = all_bits[:, own] @ weights + (number << 48)
                    yield pa.RecordBatch.from_arrays([pa.array(place), some.column(1), first], names=["place", "node", "first"])

    entered = classes.select("full", "node").mapInArrow(enter, "place long, node long, first long")
    found = materialize(linked(entered, bound(similarity, 64, 3.0), crowds_aside=True), "wide-links")
    near = found.where("v is not null").select("u", "v").distinct()
    most = bound(similarity, 64 * WIDE, 1.0)
    crowded = found.where("v is null").select("place", F.col("u").alias("node")).join(classes.select("node", "full"), "node").select("place", "node", "full")
    trees = linked(crowded, most)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(-1, WIDE) for c in batch.columns[2:])
            yield batch.filter(pa.array(apart(a, b) <= most)).select(["u", "v"])

    side = lambda end: classes.select(F.col("node").alias(end), F.col("full").alias(f"full_{end}"))
    both = near.join(side("u"), "u").join(side("v"), "v").select("u", "v", "full_u", "full_v")
    stars = components(both.mapInArrow(verify, "u long, v long").unionByName(trees))
    stars = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
    rooted = classes.select("node", "best").join(stars, "node", "left").select(F.coalesce("root", "node").alias("root"), "best")
    stay = rooted.groupBy("root").agg(F.min("best").alias("best"))
    named = lambda k, h: (F.coalesce(k, F.lit(0)).alias("_key"), k.isNull().alias("_none"), h.alias("_text"))
    rows = docs.select(F.struct("*").alias("_row"), *named(F.col(key).cast("long"), F.xxhash64(F.col(text).cast("string"))))
    kept = rows.join(stay.select(*named(F.col("best.key"), F.col("best.hash"))), ["_key", "_none", "_text"])
    alike = Window.partitionBy("_key", "_none", "_text").orderBy(F.xxhash64("_row"))  # rows of one key and text; the join has brought them together
    return kept.withColumn("_rank", F.row_number().over(alike)).where("_rank = 1").select("_row.*")
