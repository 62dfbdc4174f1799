import random

import numpy as np

from tsuzuri.llm import ngram_jaccard


def brute(rows):
    sets = [ngram_jaccard.shingle_set(t) for _, t in rows]
    count, links = [0] * len(rows), set()
    for i, s in enumerate(sets):
        for j in range(i):
            both = len(set(s.tolist()) & set(sets[j].tolist()))
            if len(s) and len(sets[j]) and 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                count[i] += 1
                count[j] += 1
                if not (len(s) == len(sets[j]) == both):
                    links.add((min(rows[i][0], rows[j][0]), max(rows[i][0], rows[j][0])))
    return {rows[i][0]: n for i, n in enumerate(count)}, links


def near_copies(seed, groups=(40, 30), words=400):
    rng = random.Random(seed)
    texts = [None, "", " ", "a b", "a b"]
    for g, n in enumerate(groups):
        base = [f"g{g}w{i}" for i in range(words)]
        texts += [" ".join(base)] * 2
        for i in range(n):
            t = list(base)
            for _ in range(rng.randint(1, 3)):
                t[rng.randrange(words)] = f"x{i}y{rng.random()}"
            texts.append(" ".join(t + [f"end{i}"] * rng.randint(0, 12)))
    rng.shuffle(texts)
    return list(enumerate(texts, 1))


def test_groups_of_many_near_copies_have_all_links(spark):
    rows = near_copies(3)
    n_links, links = brute(rows)
    got, own = ngram_jaccard.similarity_join(spark.createDataFrame(rows, "doc_id long, text string"))
    own = [(r.u, r.v) for r in own.collect()]
    class_of = {r.doc_id: r.class_id for r in got.collect()}
    between = {(min(p), max(p)) for p in ((class_of[a], class_of[b]) for a, b in links)}
    assert len(own) == len(set(own)) and set(own) == between and len(between) > 900
    assert {r.doc_id: r.n_links for r in got.collect()} == n_links


def test_blocks_of_few_sets_give_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 5)
    rows = near_copies(4, (60,))
    n_links, _ = brute(rows)
    got = ngram_jaccard.similarity_join(spark.createDataFrame(rows, "doc_id long, text string"))[0]
    assert {r.doc_id: r.n_links for r in got.collect()} == n_links


def test_lists_split_by_salt_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "SAMPLE", 1)
    monkeypatch.setattr(ngram_jaccard, "LIST", 8)
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 5)
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(90)]  # shared by all, so that lists hold many components
    texts = []
    for g in range(30):
        own = [f"g{g}w{i}" for i in range(rng.choice((20, 22, 60)))]
        for _ in range(rng.randint(1, 5)):
            t = own + passage
            t[rng.randrange(len(t))] = f"x{rng.random()}"
            texts.append(" ".join(t))
    rows = list(enumerate(texts, 1))
    n_links, links = brute(rows)
    got, own = ngram_jaccard.similarity_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.n_links for r in got.collect()} == n_links
    assert {(r.u, r.v) for r in own.collect()} == links
    parent = {k: k for k, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert {r.doc_id: r.component_id for r in got.collect()} == {k: root(k) for k in parent}


def test_derived_links_equal_whole_comparison():
    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 1 << 40, 300))
    sets = [np.unique(np.r_[rng.permutation(base)[: len(base) - k], rng.integers(0, 1 << 40, m)]) for k, m in rng.integers(0, 60, (50, 2))] + [np.unique(rng.integers(0, 1 << 40, 250))]
    got = ngram_jaccard.linked(sets[:20], sets[20:])
    for i, s in enumerate(sets[:20]):
        for j, t in enumerate(sets[20:]):
            both = len(np.intersect1d(s, t))
            assert got[i, j] == (100 * both >= 80 * (len(s) + len(t) - both))


def test_repeated_and_clashing_rows_keep_the_smallest(spark):
    rows = [(1, "b text", "x", 1), (1, "a text", "y", 2), (2, None, None, 3), (None, "n", "z", 4), (None, "n", "z", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string, h1 int")
    kept = ngram_jaccard.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [rows[1], rows[2], rows[3], rows[4]]))
