"""Rules, sharding, mixing, tokens and chat against brute force."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.llm import chat, lm, mixing, rules, sharding, tokens
from docketry.llm.wavelet import WaveletFile, build
from tests.llm.util import documents, empty, rows, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    held = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(held)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "\n", "a b c d", "#", "é", " ", " "]), max_size=60).map(" ".join))
def test_counts_match_brute_force(text):
    assert rules.counts(text)[:5] == base_counts(text)


def test_repeats_with_many_distinct_words():
    words = [str(i) for i in range(40_000)] + [str(i) for i in range(20)]
    assert rules.counts(" ".join(words))[4] == 40


def test_rules_on_awkward_rows(spark):
    found = rules.judge(documents(spark)).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows())
    by = defaultdict(list)
    for k, t, *_ in rows():
        by[k].append(base_counts(t))
    for r in found:
        own = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert own in by[r["doc_id"]]
        assert r["base_failed"] == (own[0] < 20 or 100 * own[4] > 30 * own[0])
        assert not (r["kept"] and r["base_failed"])
    assert rules.judge(empty(spark)).count() == 0


def test_vocabulary_of_long_texts(spark):
    rng = np.random.default_rng(3)
    handful = [" ".join(f"word{i}" for i in rng.integers(0, 12, n)) for n in (999, 1000, 1500, 20_000)]
    rich = " ".join(f"word{i}" for i in rng.integers(0, 3000, 4000))
    at = [r.name for r in rules.RULES].index("vocabulary")
    votes = {r["doc_id"]: rules.unpack(r["votes"], len(rules.RULES))[at] for r in rules.judge(table(spark, list(enumerate([*handful, rich])))).collect()}
    assert [votes[i] for i in range(4)] == [0] * 4 and votes[4] != 0


def test_em_finds_the_bad_rows():
    rng = np.random.default_rng(0)
    good = rng.random(4000) < 0.85
    votes = np.where(rng.random((4000, 6)) < 0.2, 1, np.where((rng.random((4000, 6)) < 0.85) == good[:, None], 2, 0))
    patterns, which, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, _, prior = rules.maximise(patterns, n.astype(float))
    assert ((posterior[which.reshape(-1)] > 0.5) == good).mean() > 0.95
    assert abs(prior - 0.85) < 0.05


def test_shards(spark):
    found = sharding.shard_rows(documents(spark), [1.0] * 24, [1.0] * 25).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows())
    texts = Counter((k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t, *_ in rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == texts
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in found if r["doc_id"] == 101}) == 1
    assert sharding.shard_rows(empty(spark), [1.0] * 24, [1.0] * 25).count() == 0


def test_shard_weights_and_growth(spark):
    ids = table(spark, [(i, "t") for i in range(6000)])
    n = Counter(r["shard"] for r in sharding.shard_rows(ids, [1.0, 2.0, 3.0]).collect())
    assert [round(n[s] / 1000) for s in range(3)] == [1, 2, 3]
    moved = [r for r in sharding.shard_rows(ids, [1.0] * 24, [1.0] * 25).collect() if r["shard"] != r["grown_shard"]]
    assert {r["grown_shard"] for r in moved} == {24} and abs(len(moved) - 240) < 60
    with pytest.raises(ValueError):
        sharding.shard_rows(ids, [0.0])


def reshared(sizes, weights, limit=3):
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] >= limit * sizes[i]}
        if not over:
            for i in open_:
                target[i] = share[i]
            break
        for i in over:
            target[i] = float(limit * sizes[i])
            left -= target[i]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1000, 5, 1], [0, 10, 90, 3, 7], [7]])
def test_targets(spark, sizes):
    frame = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = [r["target"] for r in mixing.targets(frame).orderBy("source").collect()]
    want = reshared(sizes, [(i % 3) + 1 for i in range(len(sizes))])
    assert all(math.isclose(a, b, abs_tol=1e-6) for a, b in zip(got, want, strict=True))


def test_mix_on_awkward_rows(spark):
    docs = documents(spark)
    found = mixing.mix_sources(docs).collect()
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix_sources(docs).collect()))
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows())
    by, target = defaultdict(int), {}
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(by[s] - target[s]) <= max(r["size"] for r in found if r["source"] == s) for s in by)
    assert mixing.mix_sources(empty(spark)).count() == 0
    assert mixing.mixed_rows(docs).columns == docs.columns


def test_flow_prefers_fewer_repeats():
    patterns = {"a": (10, ["x"]), "ab": (10, ["x", "y"]), "b": (10, ["y"])}
    flow = mixing.least_cost_flow(patterns, {"x": 20, "y": 10})
    assert sum(flow["a"].values()) == 10 and sum(flow["ab"].values()) == 10 and sum(flow["b"].values()) == 10
    flow = mixing.least_cost_flow({"a": (10, ["x"])}, {"x": 100})
    assert flow["a"]["x"] == 30


def test_flow_is_the_optimum_of_all_flows():
    rng = np.random.default_rng(5)

    def best(patterns, quotas):
        """Most words, then least cost, over every way of sending words."""
        found = (0, 0)
        ways = []
        for words, own in patterns.values():
            shares = [range(3 * words + 1) if s in own else range(1) for s in quotas]
            ways.append([x for x in itertools.product(*shares) if sum(x) <= 3 * words])
        for chosen in itertools.product(*ways):
            got = [sum(x[i] for x in chosen) for i in range(len(quotas))]
            if all(a <= b for a, b in zip(got, quotas.values(), strict=True)):
                cost = sum(sum(c * min(max(sum(x) - use * w, 0), w) for use, c in enumerate(mixing.COSTS)) for x, (w, _) in zip(chosen, patterns.values(), strict=True))
                found = max(found, (sum(got), -cost))
        return found

    for _ in range(25):
        quotas = {s: int(rng.integers(0, 9)) for s in "xy"}
        patterns = {f"p{i}": (int(rng.integers(0, 3)), [s for s in "xy" if rng.random() < 0.7]) for i in range(3)}
        flow = mixing.least_cost_flow(patterns, quotas)
        sent = {p: sum(flow[p].values()) for p in patterns}
        assert all(sum(f.get(s, 0) for f in flow.values()) <= quotas[s] for s in quotas) and all(sent[p] <= 3 * w for p, (w, _) in patterns.items())
        cost = sum(sum(c * min(max(sent[p] - use * w, 0), w) for use, c in enumerate(mixing.COSTS)) for p, (w, _) in patterns.items())
        assert (sum(sent.values()), -cost) == best(patterns, quotas)


def test_flow_over_many_patterns():
    """Every overlap of up to three of 60 sources: the flow fills all quotas that can be filled."""
    rng = np.random.default_rng(6)
    sets = [c for n in (1, 2, 3) for c in itertools.combinations(range(60), n)]
    patterns = {f"p{i}": (int(rng.integers(1, 2000)), [f"s{x}" for x in c]) for i, c in enumerate(sets)}
    total = sum(w for w, _ in patterns.values())
    quotas = {f"s{x}": int(total * (1 + x % 3) / 120) for x in range(60)}
    flow = mixing.least_cost_flow(patterns, quotas)
    assert len(patterns) > 35_000 and all(sum(f.get(s, 0) for f in flow.values()) == q for s, q in quotas.items())
    assert all(sum(flow[p].values()) <= w for p, (w, _) in patterns.items())  # no repeats are needed


def test_bins_follow_the_rows():
    assert [mixing.bin_digits(n) for n in (0, 300, 256_000, 10**9, 10**11)] == [1, 1, 3, 4, 5]


def test_overlapping_sources(spark):
    docs = spark.createDataFrame([(i, 10, ["x"] if i % 3 == 0 else ["y"] if i % 3 == 1 else ["x", "y"]) for i in range(300)], "doc_id long, size long, of array<string>")
    from pyspark.sql import functions as F

    got = mixing.mix(docs, F.col("of"), {"x": 1500, "y": 1500}).selectExpr("sum(_row.size * copies) s", "max(copies) m").first()
    assert got["s"] == 3000 and got["m"] == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab .,\n\t'é<|endoftext|>1 \x1c#", max_size=40), min_size=1, max_size=5))
def test_piece_encoder_equals_the_tokenizer(texts):
    encoder = tokens.PieceEncoder.of(BPE)
    plain = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == plain


@pytest.mark.parametrize("window", [7, 50, 1 << 21])
def test_runs_of_pieces_equal_the_tokenizer(monkeypatch, window):
    """Every kind of border between pieces, in windows that cut texts anywhere they may."""
    monkeypatch.setattr(tokens, "WINDOW", window)
    encoder = tokens.PieceEncoder(BPE, 2)
    atoms = ["a", "b", " ", "  ", "\n", "\t", "'", "'s", "é", "ß", "×", "÷", "ł", "\u0301", "\xa0", "\u2003", "\x85", "\x1c", "1", "23", ".", "!", "<|endoftext|>", "<|", "ª", "µ", "日", "𝄞", "don't", "l'eau", "word", "Ünï", "\x00"]
    rng = np.random.default_rng(window)
    for _ in range(400):
        texts = ["".join(rng.choice(atoms, rng.integers(0, 14))) for _ in range(rng.integers(1, 6))]
        want = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        ids, sizes = encoder.run([t.encode() for t in texts])
        assert ids.tolist() == sum(want, []) and sizes.tolist() == [len(x) for x in want]


def test_pieces_that_share_a_name_and_forgetting(monkeypatch):
    """Where hashes of pieces agree, the tokenizer itself is asked; a full memory is emptied."""
    monkeypatch.setattr(tokens, "_P", 1)
    monkeypatch.setattr(tokens, "_Q", 1)
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    encoder = tokens.PieceEncoder(BPE, 2)
    for texts in (["the eht hte", "ab ba"], ["one two three four five", "neo"], ["the eht hte"]):
        assert encoder.encode(texts) == [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_wavelet_file():
    rng = np.random.default_rng(1)
    ids = np.concatenate((rng.integers(0, 300, 3000), np.full(500, 49_999)))
    w = WaveletFile(build(ids, np.array([7, -3]), np.array([0, 100, 3500]), 50_000))
    assert (w.tokens() == ids).all() and w.doc_ids.tolist() == [7, -3] and w.starts.tolist() == [0, 100, 3500]
    assert all(w.access(i) == ids[i] for i in range(0, 3500, 97))
    for t in (int(ids[0]), 49_999, 299, 12_345):
        assert w.count(t) == (ids == t).sum() and w.count(t, 50, 900) == (ids[50:900] == t).sum()
        assert w.occurrences(t) == np.flatnonzero(ids == t).tolist()
    with pytest.raises(IndexError):
        w.access(3500)
    none = WaveletFile(build(np.zeros(0, int), np.zeros(0, int), np.zeros(1, int), 10))
    assert none.n == 0 and none.count(3) == 0 and len(none.tokens()) == 0


def test_token_files_round_trip(spark):
    found = tokens.encode_corpus(documents(spark), BPE, end_id=2).collect()
    tokenizer = tokenizers.Tokenizer.from_file(BPE)
    want = Counter()
    for k, t, *_ in rows():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[k, len(ids), zlib.crc32(ids)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == want
    found.sort(key=lambda r: r["start"])
    assert [r["start"] for r in found] == [0, *np.cumsum([r["n_tokens"] for r in found])[:-1].tolist()]
    keys = [-(1 << 62) if r["doc_id"] is None else r["doc_id"] for r in found]
    assert keys == sorted(keys)
    assert tokens.encode_corpus(empty(spark), BPE, end_id=2).count() == 0


CONTROLS = chat.INSTRUCT.controls


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*CONTROLS, "\\", "<", "[", "/", "x", "\n", ">", "|", "INST]", "s>"]), max_size=12).map("".join), st.sampled_from(["user", "assistant", "system", "tool", "", None, "<|text|>"]))
def test_chat_escapes_are_reversible(text, role):
    codec = chat.Codec(chat.INSTRUCT)
    held = codec.escape(text)
    assert codec.unescape(held) == text and not any(c in held for c in CONTROLS)
    assert codec.parse("".join(x for x, _ in codec.segments(role, text))) == (role, text)


def test_chat_on_awkward_rows(spark):
    data = [(1, 1, "assistant", "b", 0), (1, 0, "user", None, 0), (2, 0, "assistant", "first", 0), (2, 0, "assistant", "first", 0), (None, 0, "user", "x", 0), (3, None, "user", "</s>", 0), (3, 0, None, "y", 0), (4, 0, "user", "z" * 100_000, 0)]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, turn_no int")
    found = {r["conv_id"]: r for r in chat.format_and_read(frame).collect()}
    assert set(found) == {1, 2, 3, 4, None}
    assert found[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nb\n").hexdigest() and found[1]["order_ok"]
    assert found[1]["loss_chars"] == 1 and found[1]["loss_sha256"] == hashlib.sha256(b"b").hexdigest()
    assert found[2]["n_turns"] == 2 and not found[2]["order_ok"] and found[2]["loss_chars"] == 10
    assert not found[3]["order_ok"] and found[3]["n_turns"] == 2
    assert chat.format_and_read(frame.limit(0)).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores_match_brute_force(spark, order):
    data = [(k, t) for k, t, *_ in rows() if t is None or len(t) < 5000]
    words = [WORD.findall(t or "") for _, t in data]
    tables = [Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1)) for n in range(1, order + 1)]
    total = sum(map(len, words))
    want = []
    for (k, _), w in zip(data, words, strict=True):
        own = [Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for n in range(1, order + 1)]
        c = lambda g, own=own: tables[len(g) - 1][g] - own[len(g) - 1][g]
        score = 0.0
        for i in range(len(w)):
            factor, value = 1.0, None
            for n in range(min(order, i + 1), 1, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if c(g) > 0 and c(g[:-1]) > 0:
                    value = factor * c(g) / c(g[:-1])
                    break
                factor *= 0.4
            score += math.log(value or factor * (c((w[i],)) or 0.5) / max(total - len(w), 1))
        want.append((str(k), len(w), round(score, 6)))
    got = [(str(r["doc_id"]), r["n_words"], round(r["log_score"], 6)) for r in lm.score(table(spark, data), order=order, words=300).collect()]
    assert sorted(got) == sorted(want)


def test_lm_on_awkward_rows(spark):
    assert lm.score(documents(spark)).count() == len(rows())
    assert lm.score(empty(spark)).count() == 0


def test_more_sources_than_the_flow_takes(spark, monkeypatch):
    docs = documents(spark)
    mixes = lambda: [sorted(map(repr, f.collect())) for f in (mixing.mix_sources(docs), mixing.mixed_rows(docs).select("doc_id", "source"))]
    want = mixes()
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 2)
    assert mixes() == want
