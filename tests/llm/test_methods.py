"""The methods against plain versions of them, and the pipeline stage by stage."""

import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from docketry.llm import base, classifier, decontaminate, queries, rules, simhash
from tests.llm.util import sentence, table


def test_em_judges_as_em_over_single_documents(spark, sf):
    """`kept` against EM with one vote after the other, over documents instead of patterns."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    con = duckdb.connect()
    con.execute(f"CREATE TABLE c (doc_id BIGINT, {', '.join(f'{x} BIGINT' for x in rules.COUNTS)})")
    con.executemany(f"INSERT INTO c VALUES ({', '.join('?' * (1 + len(rules.COUNTS)))})", [(k, *rules.counts(t)) for k, t in texts.items()])
    cases = ", ".join(f"CASE WHEN {r.bad} THEN 0 WHEN {r.good} THEN 2 ELSE 1 END" for r in rules.RULES)
    failed = f"n_words < {rules.MIN_WORDS} OR n_repeat_words * 100 > n_words * {rules.MAX_REPEAT_PERCENT}"
    voted = {r[0]: (r[1], r[2:]) for r in con.execute(f"SELECT doc_id, {failed}, {cases} FROM c").fetchall()}
    base_ok = [v for bad, v in voted.values() if not bad]
    prior, n_rules, n = 0.8, len(rules.RULES), len(base_ok)
    chance = {}
    for r in range(n_rules):
        silent = min(max(sum(v[r] == 1 for v in base_ok) / n, 0.01), 0.9)
        chance[1, r] = [(1 - silent) * 0.3, silent, (1 - silent) * 0.7]
        chance[0, r] = chance[1, r][::-1]
        chance[0, r] = [(1 - silent) * 0.7, silent, (1 - silent) * 0.3]

    def posterior(v):
        good, bad = math.log(prior), math.log(1 - prior)
        for r in range(n_rules):
            good, bad = good + math.log(chance[1, r][v[r]]), bad + math.log(chance[0, r][v[r]])
        return 1 / (1 + math.exp(min(bad - good, 700)))

    last = None
    for _ in range(500):
        p = [posterior(v) for v in base_ok]
        if last is not None and max(abs(a - b) for a, b in zip(p, last, strict=True)) < 1e-10:
            break
        last = p
        for k in (0, 1):
            share = [x if k else 1 - x for x in p]
            for r in range(n_rules):
                chance[k, r] = [(sum(s for s, v in zip(share, base_ok, strict=True) if v[r] == vote) + 1) / (sum(share) + 3) for vote in range(3)]
        prior = min(max((sum(p) + 1) / (n + 2), 1e-6), 1 - 1e-6)
    got = {r["doc_id"]: r for r in rules.judge(docs).collect()}
    for k, (bad, v) in voted.items():
        want = posterior(v)
        assert got[k]["base_failed"] == bad and abs(got[k]["p_good"] - want) < 1e-6
        assert got[k]["kept"] == (not bad and want >= 0.5) or abs(want - 0.5) < 1e-6


def test_fit_reaches_the_plain_maximum():
    """The fit's penalised likelihood against a plain ascent with numeric gradients."""
    rng = np.random.default_rng(4)
    n, wide = 1200, 6
    x = rng.random((n, wide)) < 0.5
    z = x @ np.array([2.5, -2.0, 2.0, -2.0, 2.0, -2.5]) + rng.logistic(size=n)
    grades = (z > -0.5).astype(int) + (z > 1.0)
    rows = [np.flatnonzero(r).astype(np.int32) for r in x]
    model = classifier.fit(rows, grades, dimensions=wide)
    assert (model.weights != 0).all()

    def value(theta):
        cuts = theta[wide], theta[wide] + math.exp(theta[wide + 1])
        s = x @ theta[:wide]
        above = [np.ones(n), *(1 / (1 + np.exp(-(s - c))) for c in cuts), np.zeros(n)]
        chance = np.array([above[g][i] - above[g + 1][i] for i, g in enumerate(grades)])
        return np.log(np.maximum(chance, 1e-12)).sum() - 0.5 * (theta[:wide] ** 2).sum()

    theta, step = np.zeros(wide + 2), 1e-2
    for _ in range(3000):
        grad = np.array([(value(theta + d) - value(theta - d)) / 2e-5 for d in np.eye(wide + 2) * 1e-5])
        while step > 1e-9 and value(theta + step * grad) <= value(theta):
            step /= 2
        if step <= 1e-9 or np.abs(grad).max() < 1e-4:
            break
        theta, step = theta + step * grad, step * 1.5
    own = np.concatenate((model.weights, [model.thresholds[0], math.log(model.thresholds[1] - model.thresholds[0])]))
    assert value(own) > value(theta) - 0.02
    assert np.abs(own - theta).max() < 0.05


def test_repeated_keys_teach_alike(spark):
    data = [(i, sentence(i, 30)) for i in range(200)] + [(i, sentence(i + 1000, 30)) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    one, other = (classifier.train(table(spark, d), labels) for d in (data, data[::-1]))
    assert np.array_equal(one.weights, other.weights) and np.array_equal(one.thresholds, other.thresholds)


def shingle_set(text, width=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or {tuple(words)}


def edited(words, edits, rng):
    own = list(words)
    for at in rng.sample(range(len(own)), edits):
        own[at] = f"w{rng.randrange(10**6)}"
    return own


def test_recall_of_near_copies(spark):
    """All pairs by their true similarity: of those at 0.8 or more nearly none stay apart, and
    nothing leaves without a neighbour near 0.8."""
    rng = random.Random(17)
    texts = []
    for _ in range(250):
        base_words = [f"t{rng.randrange(4000)}" for _ in range(rng.choice([60, 150, 300, 600]))]
        texts.append(base_words)
        texts += [edited(base_words, max(1, int(len(base_words) * rng.choice([0.005, 0.01, 0.015, 0.02, 0.03, 0.05]))), rng) for _ in range(rng.randint(0, 4))]
    texts = [" ".join(t) for t in texts]
    sets = [shingle_set(t) for t in texts]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    shared = Counter((a, b) for own in holders.values() for k, a in enumerate(own) for b in own[k + 1 :])
    similar = {(a, b): n / (len(sets[a]) + len(sets[b]) - n) for (a, b), n in shared.items()}
    kept = {r["doc_id"] for r in simhash.one_of_each(table(spark, list(enumerate(texts)))).collect()}
    near = [p for p, s in similar.items() if s >= 0.8]
    apart = [p for p in near if p[0] in kept and p[1] in kept]
    assert len(near) > 200 and len(apart) <= 0.04 * len(near)
    best = defaultdict(float)
    for (a, b), s in similar.items():
        best[a], best[b] = max(best[a], s), max(best[b], s)
    assert all(best[i] >= 0.7 for i in range(len(texts)) if i not in kept)


def test_same_links_whatever_else_stands_in_a_place():
    """Strangers in a place take no link of the others."""
    rng = np.random.default_rng(2)
    trio = rng.integers(0, 1 << 63, 1, dtype=np.uint64) ^ np.array([0, 0b111, 0b111 << 20], np.uint64)
    for n in (0, 10, 30, 300, 5000):
        fps = np.concatenate((trio, rng.integers(0, 1 << 63, n, dtype=np.uint64)))
        nodes = np.arange(len(fps))
        links = {(int(a), int(b)) for u, v in simhash.met(np.zeros(len(fps), np.int64), nodes, fps, 4) for a, b in zip(u, v, strict=True)}
        assert {frozenset(x) for x in links} == {frozenset((0, 1)), frozenset((0, 2))}


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Rows before and after each stage of the pipeline, as written tables."""
    docs, found = base.table(spark, sf.replace("0.001", "0.01"), "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = base.materialize(stage(spark, docs, sf.replace("0.001", "0.01")), f"test-{name}")
        found[name] = docs, after
        docs = after
    return found


def ids(frame):
    return sorted(r["doc_id"] for r in frame.select("doc_id").collect())


def test_stage_quality(spark, sf, stages):
    before, after = stages["quality_classifier"]
    model, features = classifier.train(before, base.table(spark, sf.replace("0.001", "0.01"), "labels")), classifier.Features()
    want = []
    for r in before.collect():
        z = sum(float(model.weights[i]) for i in features(r["text"]).tolist())
        if 1 / (1 + math.exp(-(z - model.thresholds[-1]))) >= classifier.THRESHOLD:
            want.append(r["doc_id"])
    assert ids(after) == sorted(want)


def test_stage_near_duplicates(stages):
    """Every pair is compared: what leaves is linked, and of the pairs at 0.8 or more by their
    shingles one leaves."""
    before, after = stages["simhash_near_dedup"]
    rows = sorted((r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect())
    fps = np.stack([simhash.wide_fingerprint(t, 5) for _, t in rows])
    sets, kept = [shingle_set(t) for _, t in rows], set(ids(after))
    most, up, similar = simhash.bound(0.8, 1024, 1.0), list(range(len(rows))), 0

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(rows)):
        bits = simhash.apart(fps[:i], np.broadcast_to(fps[i], fps[:i].shape))
        for j in np.flatnonzero(bits <= most).tolist():
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
        for j in np.flatnonzero(bits <= 2 * most).tolist():
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                similar += 1
                assert rows[i][0] not in kept or rows[j][0] not in kept
    assert similar > 50
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    assert all(set(own) & kept for own in groups.values())  # one of each group stays
    assert all(own[0] in kept for own in groups.values())


def test_stage_decontamination(spark, sf, stages):
    before, after = stages["benchmark_decontamination"]
    items = [decontaminate.normal(r["text"]) for r in base.table(spark, sf.replace("0.001", "0.01"), "benchmark").collect()]
    want = [r["doc_id"] for r in before.collect() if not any(i in decontaminate.normal(r["text"]) for i in items)]
    assert ids(after) == sorted(want)


def test_stage_mixing_and_sharding(stages):
    con = duckdb.connect()
    before, after = stages["mixing"]
    con.register("documents", before.toPandas())
    want = Counter({k: n for k, n in con.execute(f"SELECT doc_id, copies FROM ({queries.OP4})").fetchall() if n})
    assert Counter(ids(after)) == want
    before, after = stages["sharding"]
    con.unregister("documents")
    con.register("documents", before.toPandas())
    columns = "doc_id, size, text_crc32, law, shard, grown_shard"
    assert sorted(con.execute(f"SELECT {columns} FROM ({queries.OP3})").fetchall()) == sorted(map(tuple, after.selectExpr(*columns.split(", ")).collect()))


def test_run_is_its_stages(spark, sf, stages):
    rows = lambda frame: sorted(map(str, frame.select("doc_id", "shard", "slot", "grown_shard").collect()))
    assert rows(corpus_pipeline.run(spark, sf.replace("0.001", "0.01"))) == rows(stages["sharding"][1])
