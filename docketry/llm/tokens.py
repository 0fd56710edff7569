"""Token ids of all documents in files of wavelet matrices, in ascending key order.

Rows are range-partitioned by key and sorted, so that the partitions in order are the
corpus in order. Each task encodes its rows and cuts them, between documents, into
blocks of about BLOCK tokens; a block is one wavelet file (see wavelet.py), kept as one
row of a Parquet table in the shared folder. Where a document starts in the corpus
follows from the tokens before it in its block, of the blocks before in its partition and
of the partitions before: only one number per partition is summed in one place.

Encoding: the pre-tokenizer of byte-level BPE always breaks at certain places (see
PieceEncoder.starts), so a text may be encoded in the pieces between them, and equal pieces
are encoded once. Pieces are found, named by a 64-bit hash and looked up for a whole run of
texts at once; every piece is then compared with the bytes that its name stands for, and a
run in which one differs is left to the tokenizer itself. What is remembered is bounded and
changes no result.

Defined cases: a null or empty text is the end id alone; a null key comes first; rows
that share a key come one after another by text; an empty table gives an empty table.
Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.base import materialize
from docketry.llm.wavelet import WaveletFile, build

#: Tokens after which a block is closed.
BLOCK = 1 << 20
#: Pieces and bytes of pieces that a worker remembers.
REMEMBERED, REMEMBERED_BYTES = 1_500_000, 1 << 26
#: Bytes that are encoded at once, but for longer pieces.
WINDOW = 1 << 21

FILES = "part int, block int, first long, n_tokens long, payload binary"
DOCS = "part int, {key} long, offset long, n_tokens long, ids_crc32 long"


#: What a byte may be: letters are those of ASCII and the second bytes of Latin-1 letters.
_LETTER, _BLANK, _OTHER, _FOREIGN, _END = 1, 2, 3, 4, 5
_KINDS = np.array([_BLANK if chr(c) in " \t\n\v\f\r" else _LETTER if chr(c).isalpha() else _OTHER for c in range(128)] + [_FOREIGN] * 127 + [_END], np.uint8)
_SPACE, _QUOTE, _LEAD = ord(" "), ord("'"), 0xC3
_P, _Q = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _kinds(raw: np.ndarray) -> np.ndarray:
    kind = _KINDS[raw]
    second = (raw[:-1] == _LEAD) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)  # all but the signs of times and division
    kind[1:][second] = _LETTER
    kind[:-1][second] = _LETTER
    return kind


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] numbers), then the same for the others."""
    upto = np.cumsum(size, dtype=np.int64)
    if not len(upto):
        return upto
    step = np.ones(upto[-1], np.int32)
    step[0] = first[0]
    step[upto[:-1]] = first[1:] - first[:-1] - size[:-1] + 1
    return np.cumsum(step, out=step)


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.held, self.n = np.zeros(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.held):
            self.held = np.concatenate((self.held[: self.n], np.zeros(self.n + len(more) + 1024, self.held.dtype)))
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.n]


class PieceEncoder:
    """Ids of whole texts, each followed by the end id, equal to the tokenizer's own."""

    def __init__(self, path: str, end_id: int = 0):
        self.tokenizer, self.end_id = tokenizers.Tokenizer.from_file(path), end_id
        self.vocabulary = max(self.tokenizer.get_vocab_size(), end_id + 1)
        #: Bytes of text that an id stands for: byte-level vocabularies spell each byte as one character.
        self.spans = np.zeros(self.vocabulary, np.int64)
        for word, i in self.tokenizer.get_vocab().items():
            self.spans[i] = len(word)
        self.added = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        for i, x in self.tokenizer.get_added_tokens_decoder().items():
            self.spans[i] = len(x.content.encode())
        self.newline = self._whole(b"\n")
        self.powers = np.zeros(0, np.uint64)
        self.forget()

    @classmethod
    def of(cls, path: str, end_id: int = 0) -> PieceEncoder:
        """One per worker process, whatever task it runs."""
        kept = tokenizers.__dict__.setdefault("_piece_encoders", {})
        if (path, end_id) not in kept:
            kept[path, end_id] = cls(path, end_id)
        return kept[path, end_id]

    def forget(self) -> None:
        self.names, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes, and the pieces' numbers
        self.near_names, self.near_numbers = np.zeros(1 << 20, np.uint64), np.zeros(1 << 20, np.int64)  # the last piece met at 20 bits of the hash
        self.near_names[0] = ~np.uint64(0)  # no piece yet: no such name has its place here
        self.spelling, self.ids = Grown(np.uint8), Grown(np.uint16 if self.vocabulary <= 1 << 16 else np.uint32)
        self.places, self.sizes, self.first, self.counts = (Grown(np.int32) for _ in range(4))

    def starts(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a piece starts at each byte, and whether the bytes before may be encoded
        without those from here on. A piece starts

        * at a space before a character that surely is no white space (the pre-tokenizer
          gives the space to what follows),
        * after a letter, where ASCII other than letters follows,
        * at a letter after ASCII other than letters and the apostrophe of contractions; after
          white space, if that is one character behind something else (of several, the
          pre-tokenizer cuts off the last, which a piece's own end would not show),
        * at the end mark of a text and behind it.

        Letters are those of ASCII and Latin-1; there is no piece's start beside any other
        character beyond ASCII.
        """
        kind = _kinds(raw)
        before = np.concatenate((np.array([_END], np.uint8), kind[:-1]))
        letter, was_letter = kind == _LETTER, before == _LETTER
        sure = letter | (kind == _OTHER)
        spaced = np.zeros(len(raw), bool)
        spaced[:-1] = (raw[:-1] == _SPACE) & sure[1:]
        free = before == _OTHER
        free[1:] &= raw[:-1] != _QUOTE
        lone = (before == _BLANK) & letter
        if lone.any():
            lone[1:] &= raw[:-1] != _SPACE
            lone[2:] &= (before[1:-1] == _OTHER) | (before[1:-1] == _LETTER) | (before[1:-1] == _END)
        end = (kind == _END) | (before == _END)
        return spaced | (was_letter & (kind >= _BLANK) & (kind <= _OTHER)) | (letter & (free | lone)) | end, spaced | end

    def _whole(self, raw: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([raw.decode()], add_special_tokens=False)[0].ids, np.int64)

    def _in_one(self, pieces: list[bytes], before: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that are encoded in one run, cut where the pieces' bytes end, and their numbers."""
        ids = self._whole(before + before.join(pieces))
        ends = np.cumsum(self.spans[ids])
        want = np.cumsum([len(before) + len(p) for p in pieces])
        cuts = np.searchsorted(ends, want)
        if len(ids) == 0 or not np.array_equal(ends[np.minimum(cuts, len(ids) - 1)], want):
            raise ValueError("the tokenizer does not keep the bytes of its input")
        counts = np.diff(cuts, prepend=-1)
        if before:
            mark = np.cumsum(counts) - counts
            if (ids[mark] != self.newline).any():
                raise ValueError("the tokenizer joins a new line to what follows")
            ids, counts = np.delete(ids, mark), counts - 1
        return ids, counts

    def _one(self, piece: bytes) -> np.ndarray:
        return np.array([self.end_id]) if piece == b"\xff" else self._whole(piece)

    def _learn(self, pieces: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the pieces, their ids in that order, and how many each has. Words with a
        space before them, and words alone, are encoded in long runs (new lines between the
        latter), others one by one."""
        spelt = b"".join(pieces)
        raw, first = np.frombuffer(spelt, np.uint8), np.cumsum(size) - size
        others = np.add.reduceat(_kinds(raw) != _LETTER, first, dtype=np.int64)
        lead = (raw[first] == _SPACE) & (size > 1)
        group = np.where(others == 0, 1, np.where(lead & (others == 1), 0, 2)) if not self._special(spelt) else np.full(len(pieces), 2)
        order = np.argsort(group, kind="stable")
        ids, counts = [], []
        for kind, mark in ((0, b""), (1, b"\n")):
            chosen = order[group[order] == kind].tolist()
            for at in range(0, len(chosen), 4096):
                own, n = self._in_one([pieces[i] for i in chosen[at : at + 4096]], mark)
                ids.append(own)
                counts.append(n)
        chosen = [pieces[i] for i in order[group[order] == 2].tolist()]
        for at in range(0, len(chosen), 4096):
            some = chosen[at : at + 4096]
            found = self.tokenizer.encode_batch_fast(["" if p == b"\xff" else p.decode() for p in some], add_special_tokens=False)
            made = [[self.end_id] if p == b"\xff" else e.ids for p, e in zip(some, found, strict=True)]
            ids.append(np.array([i for x in made for i in x], np.int64))
            counts.append(np.array([len(x) for x in made], np.int64))
        return order, np.concatenate(ids), np.concatenate(counts)

    def _special(self, piece: bytes) -> bool:
        return any(x in piece for x in self.added)

    def _numbers(self, names: np.ndarray, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each piece; new ones are learnt."""
        slot = (names >> np.uint64(44)).astype(np.int64)
        number = self.near_numbers[slot]
        other = np.flatnonzero(self.near_names[slot] != names)
        if not len(other):
            return number
        own, which, back = np.unique(names[other], return_index=True, return_inverse=True)
        at = np.searchsorted(self.names, own)
        known = at < len(self.names)
        known[known] = self.names[at[known]] == own[known]
        found = np.empty(len(own), np.int64)
        found[known] = self.numbers[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            where = other[which[new]]
            pieces = [raw[a : a + n].tobytes() for a, n in zip(begin[where].tolist(), size[where].tolist(), strict=True)]
            order, ids, counts = self._learn(pieces, size[where])
            own_size = size[where][order]
            found[new[order]] = self.sizes.n + np.arange(len(new))
            self.places.add(self.spelling.n + np.cumsum(own_size) - own_size)
            self.first.add(self.ids.n + np.cumsum(counts) - counts)
            self.sizes.add(own_size)
            self.counts.add(counts)
            self.spelling.add(np.frombuffer(b"".join([pieces[i] for i in order.tolist()]), np.uint8))
            self.ids.add(ids)
            self.names, self.numbers = np.insert(self.names, at[new], own[new]), np.insert(self.numbers, at[new], found[new])
        number[other] = found[back]
        self.near_names[slot[other]], self.near_numbers[slot[other]] = names[other], number[other]
        return number

    def _window(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of one window, and how many there are up to each of its end marks."""
        if len(self.powers) < len(raw):
            self.powers = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(len(raw), _P, np.uint64))))
            self.backward = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(len(raw), _Q, np.uint64))))
        begin = np.flatnonzero(starts)
        size = np.diff(begin, append=len(raw))
        sums = raw + np.uint64(1)
        sums *= self.powers[: len(raw)]
        upto = np.cumsum(sums, out=sums)[begin + size - 1]
        names = np.diff(upto, prepend=np.uint64(0)) * self.backward[begin]
        names = (names ^ (names >> np.uint64(32))) * np.uint64(0xD1342543DE82EF95)
        number = self._numbers(names, raw, begin, size)
        if (self.sizes.all[number] == size).all() and np.array_equal(self.spelling.all[_runs(self.places.all[number], size)], raw):
            counts = self.counts.all[number]
            return self.ids.all[_runs(self.first.all[number], counts)], np.cumsum(counts, dtype=np.int64)[raw[begin] == 0xFF]
        made = [self._one(raw[a : a + n].tobytes()) for a, n in zip(begin.tolist(), size.tolist(), strict=True)]  # two spellings share a name
        ids, counts = np.concatenate(made), np.array([len(x) for x in made])
        return ids, np.cumsum(counts)[raw[begin] == 0xFF]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, without the end id, as little-endian uint32 bytes."""
        ids, sizes = self.run([t.encode() for t in texts])
        return [own[:-1].astype("<u4").tobytes() for own in np.split(ids, np.cumsum(sizes)[:-1])]

    def run(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, an end id after each, and how many each text has."""
        if self.sizes.n > REMEMBERED or self.spelling.n > REMEMBERED_BYTES:
            self.forget()
        texts = [t.decode(errors="replace").encode() if b"\xff" in t else t for t in texts]
        raw = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8)
        special = [i for i, t in enumerate(texts) if self._special(t)]
        ends = np.cumsum([len(t) + 1 for t in texts])
        ids, upto, at, width, done = [], [], 0, WINDOW, 0
        while at < len(raw):
            some = raw[at : at + width]
            starts, safe = self.starts(some)
            for i in special:  # one piece each: added tokens come before all else
                inner = slice(max(0, ends[i] - len(texts[i]) - at), max(0, ends[i] - 1 - at))
                starts[inner] = safe[inner] = False
            if at + width < len(raw):
                whole = np.flatnonzero(safe[1:-1])
                if not len(whole):
                    width *= 2
                    continue
                some, starts = some[: whole[-1] + 1], starts[: whole[-1] + 1]
            starts[0] = True
            own, marks = self._window(some, starts)
            ids.append(own)
            upto.append(marks + done)
            at, width, done = at + len(some), WINDOW, done + len(own)
        return np.concatenate(ids), np.diff(np.concatenate(upto), prepend=0)


def _batches(batches: Iterator[pa.RecordBatch], size: int = WINDOW) -> Iterator[tuple[list, list[bytes]]]:
    """Keys and texts in runs of bounded size."""
    keys, texts, held = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            keys.append(key)
            texts.append(text.as_py() or b"")
            held += len(texts[-1]) + 1
            if held >= size:
                yield keys, texts
                keys, texts, held = [], [], 0
    if keys:
        yield keys, texts


def write_files(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """part, block, first (tokens before it in the part), n_tokens, payload: one row per file.

    path: a file of the tokenizers library that the executors can read.
    """
    vocabulary = max(tokenizers.Tokenizer.from_file(path).get_vocab_size(), end_id + 1)
    missing = np.iinfo(np.int64).min  # stands for a null key inside a file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = PieceEncoder.of(path, end_id), TaskContext.get().partitionId()
        number, first, ids, doc_ids, counts = 0, 0, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def close(n: int) -> pa.RecordBatch:
            """A file of the first n documents that are held."""
            starts = np.concatenate(([0], np.cumsum(counts[:n])))
            payload = build(ids[: starts[-1]], doc_ids[:n], starts, vocabulary)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([number], pa.int32()), "first": pa.array([first], pa.int64()), "n_tokens": pa.array([starts[-1]], pa.int64()), "payload": pa.array([payload], pa.binary())})

        for keys, texts in _batches(batches):
            own, sizes = encoder.run(texts)
            ids, counts = np.concatenate((ids.astype(own.dtype), own)), np.concatenate((counts, sizes))
            doc_ids = np.concatenate((doc_ids, np.array([missing if k is None else k for k in keys], np.int64)))
            while len(ids) >= block:
                n = int(np.searchsorted(np.cumsum(counts), block)) + 1
                yield close(n)
                used = int(counts[:n].sum())
                number, first, ids, doc_ids, counts = number + 1, first + used, ids[used:], doc_ids[n:], counts[n:]
        if len(doc_ids):
            yield close(len(doc_ids))

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").cast("binary").alias("text"))
    return rows.repartitionByRange(F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), "text").mapInArrow(run, FILES)


def read_files(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids_crc32 of every document, from the files' payloads alone."""
    missing = np.iinfo(np.int64).min

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, payload in zip(*(batch.column(c) for c in ("part", "first", "payload")), strict=True):
                held = WaveletFile(payload.as_py())
                ids = held.tokens().astype("<u4")
                at = held.starts.tolist()
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(crc), part.as_py(), np.int32)),
                        pa.array([None if x == missing else x for x in held.doc_ids.tolist()], pa.int64()),
                        pa.array(held.starts[:-1] + first.as_py(), pa.int64()),
                        pa.array(np.diff(held.starts), pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["part", key, "offset", "n_tokens", "ids_crc32"],
                )

    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    docs = files.select("part", "first", "payload").mapInArrow(run, DOCS.format(key=key))
    return docs.join(F.broadcast(offsets), "part").select(key, (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def encode_corpus(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files to the shared folder and read every document back from them."""
    return read_files(materialize(write_files(docs, path, end_id, key, text), "tokens"), key)
