"""Near duplicates against brute force over all pairs, where a sieve or a sketch would lose or invent links."""

import itertools
import random

import numpy as np

from tidemark.llm import simhash

WORDS = [f"w{i}" for i in range(5000)]


def similarity(a, b):
    return len(a & b) / len(a | b)


def shingles(text):
    w = text.split()
    return set(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else {tuple(w)}


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    label = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if similarity(sets[a], sets[b]) >= 0.8]
    for _ in sets:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    return {i: label[i] for i in {x for link in links for x in link}}


def found(spark, docs):
    return dict(map(tuple, simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()))


def test_large_bucket_of_interleaved_groups(spark):
    rng = np.random.default_rng(5)
    template, docs = list(rng.choice(WORDS, 150)), []
    groups = [list(rng.choice(WORDS, 60)) for _ in range(100)]
    for k in range(4):
        for g, body in enumerate(groups):
            own = template + body
            own[150 + int(rng.integers(0, 60))] = f"edit{g}-{k}"
            own[int(rng.integers(20, 130))] = f"other{g}-{k}"
            docs.append((k * 100 + g, " ".join(own)))
    truth = brute(docs)
    assert len(set(truth.values())) > 50
    assert found(spark, docs) == truth


def test_copies_link_to_their_original(spark):
    rng = np.random.default_rng(6)
    docs = []
    for g in range(60):
        base = list(rng.choice(WORDS, 300))
        docs.append((10 * g, " ".join(base)))
        for k in (1, 2):
            own = list(base)
            for i in 8 + 45 * np.arange(6) + 10 * k:
                own[i] = f"new{g}-{k}-{i}"
            docs.append((10 * g + k, " ".join(own)))
    sets = {i: shingles(t) for i, t in docs}
    assert all(similarity(sets[10 * g], sets[10 * g + k]) >= 0.8 > similarity(sets[10 * g + 1], sets[10 * g + 2]) for g in range(60) for k in (1, 2))
    assert found(spark, docs) == {i: i // 10 * 10 for i, _ in docs}


def test_every_pair_at_the_threshold(spark):
    rng = np.random.default_rng(7)
    docs = []
    for g in range(300):
        base = list(rng.choice(WORDS, 300))
        own, size = list(base), int(rng.integers(18, 40))
        if g % 3 == 0:  # scattered edits
            for i in rng.choice(300, size // 5, replace=False):
                own[i] = f"new{g}-{i}"
        elif g % 3 == 1:  # one passage swapped
            at = int(rng.integers(0, 260))
            own[at : at + size] = rng.choice(WORDS, size)
        else:  # one passage added
            at = int(rng.integers(0, 300))
            own[at:at] = rng.choice(WORDS, 2 * size)
        docs += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(own))]
    truth = brute(docs)
    assert 200 < len(truth) < 590
    assert found(spark, docs) == truth


def test_sets_decide_and_not_counts(spark):
    rng = np.random.default_rng(8)
    line = " ".join(rng.choice(WORDS, 12))
    body = lambda: " ".join(rng.choice(WORDS, 60))
    one, two = body(), body()
    docs = [(1, f"{one} " + f"{line} " * 200), (2, f"{two} " + f"{line} " * 200)]  # one line, other bodies
    base, part = body(), " ".join(rng.choice(WORDS, 8))
    docs += [(3, f"{base} " + f"{part} " * 3), (4, f"{base} " + f"{part} " * 300)]  # one set, other counts
    assert brute(docs) == {3: 3, 4: 3}
    assert found(spark, docs) == {3: 3, 4: 3}


def test_near_duplicates_are_linked_by_ball_hashing_first(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    texts = [" ".join(base[:k] + ["other"] + base[k + 1 :]) for k in (10, 1500, 2990)] + [" ".join(f"v{rng.randrange(10**6)}" for _ in range(200)) for _ in range(5)]
    balls, pairs = simhash.fingerprint_links, []
    monkeypatch.setattr(simhash, "fingerprint_links", lambda *a: pairs.append(balls(*a)) or pairs[-1])
    found = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(map(tuple, found.collect())) == [(0, 0), (1, 0), (2, 0)]
    nodes = spark.createDataFrame([(n, {4: -1, 7: 5}.get(n, 0)) for n in range(8)], "node long, fp long")
    got = {frozenset(r) for r in simhash.fingerprint_pairs(nodes).collect()}
    assert len(pairs) == 2 and got == {frozenset((0, n)) for n in (1, 2, 3, 5, 6, 7)}
