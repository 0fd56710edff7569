"""Quality rules by weak supervision.

Rules vote good (+1) or bad (-1) on a document or abstain (0). A document's votes form a
pattern; the corpus is counted by pattern (at most 3 ** rules rows, whatever its size),
expectation-maximisation on those counts estimates how often each rule votes each way on
good and on bad documents, and the posterior probability of "good" given the pattern
replaces an all-must-pass filter. Documents that fail the base are rejected whatever the
votes, so the rules' accuracies are estimated on all the others.

Defined cases: a null, empty or wordless text has no words and all counts 0 and fails the
base; an equal row gets an equal result; a text of any length is taken whole; an empty
table gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.base import materialize

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
BLANKS = " \t\n\x0b\x0c\r"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters", "n_distinct", "n_exclamations")


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, all occurrences counted; exact.

    window must be 8: windows of 4 words are named by numbers, and pairs of those name
    windows of 8."""
    n = len(ids)
    if window != 8:
        raise ValueError("window must be 8")
    if n <= window:
        return 0
    base = int(ids.max()) + 1
    if base < 1 << 15:
        four = ((ids[:-3] * base + ids[1:-2]) * base + ids[2:-1]) * base + ids[3:]
    else:
        two = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)[1].astype(np.int64)
        four = two[:-2] * (int(two.max()) + 1) + two[2:]
    seen, four = np.unique(four, return_inverse=True)
    if len(seen) == len(four):
        return 0
    four = four.astype(np.int64)
    eight = four[:-4] * len(seen) + four[4:]
    _, which, count = np.unique(eight, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[which] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    edge[starts + window] -= 1
    return int((np.cumsum(edge)[:n] > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The numbers named in COUNTS."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # at ASCII white space
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    codes = np.frombuffer(raw, np.uint8)
    capitals = int(((codes - 65) < 26).sum())
    letters = int((((codes | 32) - 97) < 26).sum() + (codes >= 0xC3).sum())
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids),
        len(lines),
        capitals,
        letters,
        len(known),
        text.count("!"),
    )


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and COUNTS for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([counts(t.as_py()) for t in batch.column(1)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in found.T)], names=[key, *COUNTS])

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"{key} long, " + ", ".join(f"{c} long" for c in COUNTS))


@dataclass(frozen=True)
class Rule:
    """bad and good are conditions on COUNTS; a document that meets neither gets no vote."""

    name: str
    bad: str
    good: str


#: The vocabulary may grow more slowly than the text: a third of the words up to 1,000, then with their root.
RULES = (
    Rule("symbols", "n_symbols * 10 > n_words", "n_symbols * 50 <= n_words"),
    Rule("word_length", "word_chars < 3 * n_words or word_chars > 12 * n_words", "word_chars between 4 * n_words and 9 * n_words"),
    Rule("duplicate_lines", "n_dup_lines * 5 > n_lines", "n_dup_lines = 0 and n_lines > 2"),
    Rule("repetition", "n_repeat_words * 10 > n_words", "n_repeat_words * 50 <= n_words and n_words >= 50"),
    Rule("capitals", "n_capitals * 4 > n_letters", "n_capitals * 10 <= n_letters"),
    Rule("letters", "n_letters * 10 < word_chars * 7", "n_letters * 10 >= word_chars * 9"),
    Rule("vocabulary", "n_distinct * 3 < n_words and n_distinct * n_distinct * 9 < n_words * 1000", "n_distinct * 5 >= n_words * 2"),
    Rule("exclamations", "n_exclamations * 10 > n_words", "n_exclamations * 50 <= n_words"),
)


def votes(rule: Rule) -> Column:
    """0 bad, 1 no vote, 2 good."""
    return F.expr(f"CASE WHEN {rule.bad} THEN 0 WHEN {rule.good} THEN 2 ELSE 1 END")


def pattern(rules: Sequence[Rule]) -> Column:
    """The votes as one number in base 3."""
    code = F.lit(0)
    for rule in rules:
        code = code * 3 + votes(rule)
    return code.cast("int")


def unpack(code: int, n_rules: int) -> list[int]:
    found = []
    for _ in range(n_rules):
        code, vote = divmod(code, 3)
        found.append(vote)
    return found[::-1]


def maximise(patterns: np.ndarray, weights: np.ndarray, rounds: int = 500, prior: float = 0.8, accuracy: float = 0.7) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns.

    patterns: (k, rules) of 0, 1, 2. weights: documents with each. Starts from rules that
    are right with `accuracy` when they vote. Returns the posterior of good per pattern,
    P(vote | class) as (class, rule, vote) with class 1 good, and P(good). Each
    probability is smoothed by one document.
    """
    hot = np.eye(3)[patterns]  # (k, rules, 3)
    table = np.empty((2, patterns.shape[1], 3))
    silent = np.clip((hot[:, :, 1] * weights[:, None]).sum(0) / max(weights.sum(), 1), 0.01, 0.9)
    table[0] = np.stack([(1 - silent) * accuracy, silent, (1 - silent) * (1 - accuracy)], axis=1)
    table[1] = table[0][:, ::-1]
    posterior = np.zeros(len(patterns))
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + (hot * (np.log(table[1]) - np.log(table[0]))).sum((1, 2))
        now = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        done, posterior = np.abs(now - posterior).max(initial=0) < 1e-10, now
        for k, share in enumerate((weights * (1 - posterior), weights * posterior)):
            table[k] = ((hot * share[:, None, None]).sum(0) + 1) / (share.sum() + 3)
        prior = float(np.clip((weights @ posterior + 1) / (weights.sum() + 2), 1e-6, 1 - 1e-6))
        if done:
            break
    return posterior, table, prior


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    p_good and the votes, for every row."""
    spark = docs.sparkSession
    found = materialize(features(docs, key, text).withColumn("votes", pattern(rules)), "rules")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    counted = found.groupBy("votes").agg(F.count_if(~failed).alias("n")).collect()  # at most 3 ** len(rules) rows
    codes = [r["votes"] for r in counted]
    grid = np.array([unpack(c, len(rules)) for c in codes], int).reshape(-1, len(rules))
    posterior = maximise(grid, np.array([r["n"] for r in counted], float))[0] if codes else []
    scored = F.broadcast(spark.createDataFrame([(c, float(p)) for c, p in zip(codes, posterior, strict=True)], "votes int, p_good double"))
    return (
        found.join(scored, "votes")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
        .select(key, *COUNTS[:5], "base_failed", "kept", "p_good", "votes")
    )
