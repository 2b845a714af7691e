"""Near copies against brute force over all pairs."""

import random

import numpy as np

import corpus_pipeline

from foliospark.llm import near_copies


def sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute_groups(texts):
    own = {i: sets(t) for i, t in texts.items()}
    label = {i: i for i in texts}
    near = {i: [j for j in own if (not own[i] and not own[j]) or (own[i] and len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j]))] for i in own}
    while True:
        after = {i: min(label[j] for j in near[i]) for i in near}
        if after == label:
            return label
        label = after


def changed(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.random()}"
    return " ".join(words)


def planted():
    rng, texts = random.Random(5), {}
    for g in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for n in (0, 1, 2, 3, 4, 12, 40):
            texts[len(texts)] = changed(rng, base, n)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    for _ in range(150):  # one large group
        texts[len(texts)] = changed(rng, base, 2)
    for t in (None, "", " \n", "One word", "one  WORD", "a b c d e f", "a b c d e g"):
        texts[len(texts)] = t
    return texts


def test_near_copies_are_found(spark):
    texts = planted()
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = brute_groups(texts)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    assert got.keys() == want.keys()
    linked = [i for i in want if want[i] != i]
    assert all(want[got[i]] == want[i] for i in got)  # nothing is linked that brute force does not link
    assert sum(got[i] == want[i] for i in linked) >= 0.98 * len(linked)


def test_the_stage_drops_copies_with_a_few_changed_words(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = [(i, changed(rng, base, n)) for i, n in enumerate((0, 1, 2, 2, 3))] + [(9, " ".join(f"v{i}" for i in range(200)))]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [0, 9]


def test_fingerprints_are_majorities():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in (0, 1, 2, 300, 14, 15, 16, 3824, 3825, 3826, 50_000)]
    for h, row in zip(sets, near_copies.prints(sets), strict=True):
        x = (h[:, None] ^ near_copies.FLIPS) * near_copies.FACTORS
        x ^= x >> np.uint64(32)
        for k in (0, 7, near_copies.PRINTS - 1):
            want = sum(1 << b for b in range(64) if 2 * int(((x[:, k] >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
            assert int(row[k]) == want


def test_dense_groups_lose_no_link(spark, monkeypatch):
    """Families too dense for their pairs: several small parts, many roots in a group."""
    monkeypatch.setattr(near_copies, "CELL", 40)
    rng, texts = random.Random(11), {}
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    for _ in range(300):
        texts[len(texts)] = changed(rng, base, rng.choice((0, 1, 2, 25, 40)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = brute_groups(texts)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    linked = [i for i in want if want[i] != i]
    assert all(want[got[i]] == want[i] for i in got)
    assert sum(got[i] == want[i] for i in linked) >= 0.98 * len(linked)


def test_one_text_of_an_id_stays(spark):
    rng = random.Random(13)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [(1, " ".join(base), 1), (1, changed(rng, base, 1), 1), (2, " ".join(base), 1), (3, "quite another text", 1), (None, "quite another text", 1), (None, "alone", 1), (4, None, 1), (5, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept_id int")
    got = sorted((str(r["doc_id"]), r["text"]) for r in near_copies.keep_one(docs).collect())
    assert [x for x, _ in got] == ["1", "3", "4", "None"] and ("None", "alone") in got
    assert near_copies.keep_one(docs.where("false")).count() == 0


def test_pairs_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    """Texts that are near each other, most of them not similar: few pairs are compared one by one, and no link is lost."""
    rng, texts, seen = random.Random(17), {}, []
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    for _ in range(400):
        texts[len(texts)] = changed(rng, base, rng.choice((4, 5, 6)))
    similar = near_copies.similar
    monkeypatch.setattr(near_copies, "similar", lambda pairs, sets: (seen.append(pairs.count()), similar(pairs, sets))[1])
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = brute_groups(texts)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    linked = [i for i in want if want[i] != i]
    assert all(want[got[i]] == want[i] for i in got)
    assert sum(got[i] == want[i] for i in linked) >= 0.98 * len(linked)
    assert sum(seen) < 25_000, seen  # of 79,800


def test_a_dense_group_gives_as_few_links_as_join_it():
    rng = random.Random(19)
    texts = {}
    for g in range(3):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for _ in range(100):
            texts[len(texts)] = changed(rng, base, rng.choice((0, 2, 4, 6)))
    hashes = [near_copies.shingles(t.encode().split()).view(np.int64) for t in texts.values()]
    limits = np.concatenate(([0], np.cumsum([len(h) for h in hashes])))
    links = list(near_copies._linked(np.zeros(len(texts), dtype=np.int64), np.arange(len(texts)), np.concatenate(hashes), limits))
    want = brute_groups(texts)
    assert len(links) == len(texts) - len(set(want.values())) and all(want[i] == want[j] for i, j in links)
