"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are lowered and their white space is collapsed. An item of m
characters may occur with at most e = min(rate * m, (m - q) / q) edits; by the q-gram
lemma such an occurrence shares at least m - q + 1 - q * e q-grams with the item, on
diagonals that lie within e of each other. Shared q-grams are counted in overlapping
bands of 2 * (e + 1) diagonals, each band beginning e + 1 after the one before, so one
band holds all of an occurrence. A position of the text counts once in a band, however often
its q-gram recurs in the item. Bands that reach the bound are verified by a banded alignment
of the whole item against free ends of the text.

Parts count too: an item of over PART characters is also searched by windows of PART
characters, one every PART // 2 and one at its end, each with its own edits. So any part of
3 * PART // 2 characters or more holds a whole window and is found wherever that window has
at most RATE edits. Windows of an item that overlap in the text are one match, of the
greatest distance among them; those that overlap a match of the whole item are not told.

The benchmark is dealt by hash to blocks of about BLOCK characters. Up to TOGETHER blocks
are sent to the executors at once and every text meets them in one scan. A larger benchmark
takes several rounds: each writes the matches of its blocks, by a 128-bit hash of the text
(equal texts have equal matches), and releases them before the next one, so the memory
needed does not grow with the benchmark. No pair of text and item is formed unless they
share enough q-grams, and shared q-grams are counted HITS at a time.

Defined cases: null and empty texts match nothing; null and empty items match nothing;
an item shorter than q is searched as it is; an item's id may repeat; a text of any length
is searched whole; an empty benchmark marks nothing. Only the named columns are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.base import materialize

Q = 9
#: Edits per character of an item.
RATE = 0.08
#: Characters of an item's windows.
PART = 80
#: Characters of benchmark text per block.
BLOCK = 4_000_000
#: Blocks that are sent out at once.
TOGETHER = 4
#: Characters hashed at a time, and shared q-grams counted at a time.
STEP, HITS = 1 << 20, 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
MATCHES = "array<struct<item_id:long,start:long,end:long,distance:int>>"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(text: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit name of each q-gram, by doubling; same for the same characters."""
    n = len(text) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    made, power, at, width, have = None, text.astype(np.uint64) * _P, 0, 1, q
    mixer = int(_P)
    while have:
        if have & 1:
            part = power[at : at + n]
            made = part.copy() if made is None else made * _P + part
            at += width
        have >>= 1
        if have:
            mixer = (mixer * 0xD1342543DE82EF95 + 1) % (1 << 64)
            power = power[:-width] * np.uint64(mixer) + power[width:]
            width *= 2
    made ^= made >> np.uint64(29)
    return made * np.uint64(0xBF58476D1CE4E5B9)


def align(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """Least edit distance of the whole item to a piece of text that starts anywhere, on
    diagonals low to high (text position minus item position), and where the piece ends."""
    width = high - low + 1
    far = len(item) + width + 1
    steps = np.arange(width)
    row = np.where((steps + low >= 0) & (steps + low <= len(text)), 0, far)
    padded = np.concatenate((np.full(max(0, -low), 0xFFFFFFFF, np.uint32), text[max(0, low) : max(0, high + len(item))]))
    padded = np.concatenate((padded, np.full(max(0, len(item) + width - len(padded)), 0xFFFFFFFF, np.uint32)))
    for i in range(len(item)):
        now = row + (padded[i : i + width] != item[i])
        now[:-1] = np.minimum(now[:-1], row[1:] + 1)
        at = steps + low + i + 1
        now[(at < 0) | (at > len(text))] = far
        row = np.minimum.accumulate(now - steps) + steps
        row[(at < 0) | (at > len(text))] = far
    k = int(row.argmin())
    return int(row[k]), k + low + len(item)


class Index:
    """Items of one block and their q-grams; with `part`, those of their windows too."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = RATE, part: int | None = None):
        self.q, self.ids, self.texts, self.short = q, [], [], []
        for item_id, text in items:
            plain = normal(text)
            if 0 < len(plain) < q:
                self.short.append((item_id, plain))
            elif plain:
                self.ids.append(item_id)
                self.texts.append(plain)
        self.n_whole = len(self.ids)
        for item_id, plain in list(zip(self.ids, self.texts, strict=True)) if part else []:
            if len(plain) > part:
                windows = [plain[at : at + part] for at in sorted({*range(0, len(plain) - part, part // 2), len(plain) - part})]
                for window in dict.fromkeys(windows):
                    self.ids.append(item_id)
                    self.texts.append(window)
        sizes = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.minimum((sizes * rate).astype(np.int64), (sizes - q) // q)
        self.bound = sizes - q + 1 - q * self.edits
        made = [grams(codes(t), q) for t in self.texts]
        flat = np.concatenate(made) if made else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(made)), [len(g) for g in made])
        place = np.concatenate([np.arange(len(g)) for g in made]) if made else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        order = order[self._telling(flat[order], item[order], place[order])]
        self.item, self.place = item[order].astype(np.int32), place[order].astype(np.int32)
        self.names, self.first = np.unique(flat[order], return_index=True)
        self.first = np.append(self.first, len(order))
        bits = max(16, int(len(self.names)).bit_length() + 5)
        self.shift, self.sieve = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.sieve[(self.names >> self.shift).astype(np.int64)] = True

    def _telling(self, flat: np.ndarray, item: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which places of a q-gram in an item are needed, in order of q-gram, item and place.
        Where those before and after a place are at most edits + 1 apart, it adds no band to
        theirs: so a q-gram has some 2 / rate places in an item at most."""
        left, odd, idle = np.arange(len(flat)), 0, 0
        while len(left) > 2 and idle < 2:
            f, i, p = flat[left], item[left], place[left]
            spare = (f[2:] == f[:-2]) & (i[2:] == i[:-2]) & (p[2:] - p[:-2] <= self.edits[i[1:-1]] + 1)
            spare[odd::2] = False  # no two neighbours at once
            idle, odd = 0 if spare.any() else idle + 1, 1 - odd
            left = left[~np.concatenate(([False], spare, [False]))]
        return left

    def hits(self, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Text position, item and item position of every shared q-gram, about HITS at a time."""
        for begin in range(0, max(1, len(text) - self.q + 1), STEP):
            own = grams(text[begin : begin + STEP + self.q - 1], self.q)
            some = np.flatnonzero(self.sieve.take((own >> self.shift).astype(np.int64)))
            own = own[some]
            found = np.searchsorted(self.names, own)
            sure = found < len(self.names)
            sure[sure] = self.names[found[sure]] == own[sure]
            at, name = some[sure] + begin, found[sure]
            each = self.first[name + 1] - self.first[name]
            upto = np.cumsum(each)
            cuts = np.searchsorted(upto, np.arange(HITS, upto[-1], HITS)) + 1 if len(upto) else []
            for a, b in pairwise(sorted({0, *(int(c) for c in cuts), len(at)})):
                n = each[a:b]
                total = int(n.sum())
                offset = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[name[a:b]], n)
                yield np.repeat(at[a:b], n), self.item[offset], self.place[offset]

    def regions(self, text: np.ndarray) -> list[tuple[int, int]]:
        """(item, first diagonal of its band) wherever a band reaches the item's bound."""
        found, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at, item, place in self.hits(text):
            band = (at - place) // (self.edits[item] + 1)
            pairs = (item.astype(np.int64) << 40) + band + (1 << 38)  # of a position and item, bands come in descending order
            new = np.ones(len(pairs), bool)
            new[1:] = (at[1:] != at[:-1]) | (pairs[1:] != pairs[:-1])
            at, pairs = at[new], pairs[new]
            below = np.ones(len(pairs), bool)
            below[:-1] = (at[1:] != at[:-1]) | (pairs[1:] != pairs[:-1] - 1)
            names, n = np.unique(np.concatenate((pairs, pairs[below] - 1)), return_counts=True)
            found, back = np.unique(np.concatenate((found, names)), return_inverse=True)
            count = np.bincount(back, np.concatenate((count, n)), len(found)).astype(np.int64)
        enough = found[count >= self.bound[found >> 40]]
        return [(int(x >> 40), int((x & ((1 << 40) - 1)) - (1 << 38)) * int(self.edits[x >> 40] + 1)) for x in enough]

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, distance) in the normal form of text, least distance per
        item and place, in order of start. What begins within a match of the same item (in
        texts that repeat themselves) is not told, but for what the next band holds."""
        plain = normal(text)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        parts: dict[int, list[tuple[int, int, int]]] = {}
        for item_id, t in self.short:
            at = plain.find(t)
            while at >= 0:
                best[item_id, at] = (0, at + len(t))
                at = plain.find(t, at + 1)
        if self.ids and plain:
            text_codes = codes(plain)
            held, held_low, until = -1, 0, 0  # the item last found, its band, and where it ends
            for item, low in self.regions(text_codes):
                edits, own = int(self.edits[item]), codes(self.texts[item])
                high = low + 2 * (edits + 1) - 1
                if item == held and low > held_low + edits + 1 and high + edits < until:
                    continue
                exact = plain.find(self.texts[item], max(0, low), high + len(own))
                if exact >= 0:  # nothing can be nearer
                    held, held_low, until = item, low, exact + len(own)
                    if item < self.n_whole:
                        best[self.ids[item], exact] = (0, exact + len(own))
                    else:
                        parts.setdefault(self.ids[item], []).append((exact, exact + len(own), 0))
                    continue
                distance, end = align(own, text_codes, low, high)
                if distance > edits:
                    continue
                reverse = text_codes[max(0, end - len(own) - edits) : end][::-1]
                start = end - align(own[::-1], reverse, -edits, edits)[1]
                held, held_low, until = item, low, end
                if item >= self.n_whole:
                    parts.setdefault(self.ids[item], []).append((start, end, distance))
                    continue
                key = (self.ids[item], start)
                best[key] = min(best.get(key, (edits + 1, 0)), (distance, end))
        whole: dict[int, list[tuple[int, int]]] = {}
        for (item_id, s), (_, e) in sorted(best.items(), key=lambda x: x[0][1]):
            upto = max(e, whole[item_id][-1][1]) if item_id in whole else e
            whole.setdefault(item_id, []).append((s, upto))  # starts, and the furthest end so far
        for item_id, spans in parts.items():
            runs: list[tuple[int, int, int]] = []
            for s, e, d in sorted(set(spans)):
                before = bisect_left(whole.get(item_id, ()), (e,))
                if before and whole[item_id][before - 1][1] > s:
                    continue
                if runs and s < runs[-1][1]:
                    runs[-1] = (runs[-1][0], max(e, runs[-1][1]), max(d, runs[-1][2]))
                else:
                    runs.append((s, e, d))
            best.update({(item_id, s): (d, e) for s, e, d in runs})
        return sorted(((i, s, e, d) for (i, s), (d, e) in best.items()), key=lambda x: (x[1], x[0]))


def matches(text: Column, index: Broadcast) -> Column:
    """Array of the matches of one block in a text column."""

    @F.pandas_udf(MATCHES)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Index(*index.value)
        for texts in batches:
            yield pd.Series([[{"item_id": i, "start": s, "end": e, "distance": d} for i, s, e, d in own.find(t)] for t in texts])

    return found(text.cast("string"))


def with_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", q: int = Q, rate: float = RATE, block: int = BLOCK, part: int | None = PART) -> DataFrame:
    """`_row` (all columns of docs) and `_matches` of all items and, with `part`, of parts of them."""
    sized = benchmark.select(F.col(item).cast("long").alias("item"), F.col("text").cast("string").alias("text"))
    total = sized.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block))
    numbered = sized.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    none = F.array().cast(MATCHES)

    def searched(rows: DataFrame, numbers: range) -> tuple[DataFrame, list[Broadcast]]:
        """rows with the matches of some blocks, and what was sent out for it."""
        sent = []
        for number in numbers:
            items = [(r["item"], r["text"]) for r in numbered.where(F.col("block") == number).collect()]  # about `block` characters
            sent.append(docs.sparkSession.sparkContext.broadcast((sorted(items, key=str), q, rate, part)))
            rows = rows.withColumn("_matches", F.concat("_matches", matches(F.col("_text"), sent[-1])))
        return rows, sent

    own = F.col(text).cast("string").alias("_text")
    in_order = F.transform(F.array_sort(F.transform("_matches", lambda m: F.struct(m["start"].alias("start"), m["item_id"].alias("item_id"), m["end"].alias("end"), m["distance"].alias("distance")))),
                           lambda m: F.struct(m["item_id"].alias("item_id"), m["start"].alias("start"), m["end"].alias("end"), m["distance"].alias("distance")))
    if blocks <= TOGETHER:
        found, _ = searched(docs.select(F.struct("*").alias("_row"), own, none.alias("_matches")), range(blocks))
        return found.select("_row", (in_order if blocks > 1 else F.col("_matches")).alias("_matches"))
    names = [F.xxhash64(F.col(text).cast("string")).alias("_h"), F.xxhash64(F.col(text).cast("string"), F.lit(1)).alias("_g")]
    rounds = None
    for begin in range(0, blocks, TOGETHER):
        found, sent = searched(docs.select(*names, own, none.alias("_matches")), range(begin, min(begin + TOGETHER, blocks)))
        one = materialize(found.where(F.size("_matches") > 0).groupBy("_h", "_g").agg(F.first("_matches").alias("_matches")), "matches")
        rounds = one if rounds is None else rounds.unionByName(one)
        for x in sent:
            x.destroy()
    all_rounds = rounds.groupBy("_h", "_g").agg(F.flatten(F.collect_list("_matches")).alias("_matches"))  # one entry a round
    rows = docs.select(F.struct("*").alias("_row"), *names).join(all_rounds, ["_h", "_g"], "left")
    return rows.select("_row", F.coalesce("_matches", none).alias("_matches")).select("_row", in_order.alias("_matches"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key, contaminated, n_items, item_ids (ascending, comma-joined), min_distance (null
    without a match) and spans (item:start:end:distance, comma-joined) for every row."""
    found = with_matches(docs.select(key, text), benchmark, text, **options)
    ids = F.array_sort(F.array_distinct(F.col("_matches.item_id")))
    span = F.transform("_matches", lambda m: F.concat_ws(":", m["item_id"], m["start"], m["end"], m["distance"]))
    return found.select(
        F.col(f"_row.{key}").alias(key),
        (F.size("_matches") > 0).alias("contaminated"),
        F.size(ids).cast("long").alias("n_items"),
        F.array_join(ids, ",").alias("item_ids"),
        F.array_min(F.col("_matches.distance")).alias("min_distance"),
        F.array_join(span, ",").alias("spans"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, without any match."""
    return with_matches(docs, benchmark, text, **options).where(F.size("_matches") == 0).select("_row.*")
