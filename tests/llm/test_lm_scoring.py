"""The language model's work: what is read and scored once, and its sums against plain ones."""

import numpy as np
from pyspark.sql import functions as F

from foliospark.llm import lm_scoring, queries

TEXTS = ["the cat sat on the mat", "the dog lay on the rug while the cat slept", "", None, "a word apart", "One"]


def test_texts_are_read_once_and_copies_scored_once(spark, tmp_path, monkeypatch):
    """After the count one pass takes each document's words; the scores come from what it keeps of distinct texts."""
    docs = spark.createDataFrame([(k * 10 + i, t) for k in range(3) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    passes, whole = [], lm_scoring.lessons
    monkeypatch.setattr(lm_scoring, "lessons", lambda *a: passes.append(whole(*a)) or passes[-1])
    scored = queries.queries()["op9_lm_scoring"](spark, str(tmp_path))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert len(passes) == 1 and "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1
    assert passes[0].count() == 4
    got = {}
    for r in scored.collect():
        got.setdefault(r["doc_id"] % 10, []).append((r["n_tokens"], r["log_prob"], r["perplexity"]))
    assert all(len(v) == 3 and len(set(v)) == 1 for v in got.values())
    assert [got[i][0][0] for i in range(len(TEXTS))] == [len((t or "").split()) for t in TEXTS]
    assert got[2][0] == got[3][0] == (0, 0.0, None)


def test_what_is_kept_of_a_text(spark):
    """own and rare together say the counts of all words but the head's, however few go along."""
    docs = spark.createDataFrame(list(enumerate([*TEXTS, TEXTS[1], "mat mat dog"])), "doc_id bigint, text string")
    model = lm_scoring.fit(docs, heads=2)
    assert set(model.head) == {b"the", b"cat"}
    counts = {bytes(r["word"]): r["n"] for r in lm_scoring.word_counts(docs).collect()}
    say = lambda n: round(np.log(n) * lm_scoring.LOGS)
    few = {b"the": 0, b"cat": 0, b"dog": say(counts[b"dog"])}
    rows = lm_scoring.lessons(docs, lm_scoring.replace(model, common=few)).withColumn("words", F.length("cells") / 2 - 2 * lm_scoring.SIDE).collect()
    own = {(r["words"], r["own"]): sorted(x["n"] for x in r["rare"]) for r in rows}
    assert own == {(6, 0): [1] * 3, (10, say(counts[b"dog"])): [1] * 5, (3, 0): [1] * 3, (1, 0): [1], (3, say(counts[b"dog"])): [2]}


def test_a_place_alone_scores_as_in_company():
    rng = np.random.default_rng(2)
    model = lm_scoring.start([(b"the", 5)], np.ones(lm_scoring.TAIL))
    seen = rng.integers(1, lm_scoring.CELLS + 1, 200 + 2 * lm_scoring.SIDE).astype(np.uint16)
    at = np.arange(200) + lm_scoring.SIDE
    together = model.log_probs(seen, at)
    assert [model.log_probs(seen, at[i : i + 1])[0] for i in range(200)] == together.tolist()
    assert model.log_probs(seen, np.concatenate((np.resize(at, lm_scoring.BLOCK), at[:1])))[-1] == together[0]


def test_a_step_against_plain_sums():
    """One batch of Adagrad, with inputs that come once, some times and very often."""
    rng = np.random.default_rng(4)
    net = lm_scoring.start([(b"the", 5)], np.ones(lm_scoring.TAIL)).net
    n, side = lm_scoring.BATCH, lm_scoring.SIDE
    seen = np.zeros(n + 2 * side, dtype=np.uint16)
    seen[side : side + n] = np.where(rng.random(n) < 0.3, 7, rng.integers(1, lm_scoring.CELLS + 1, n) // rng.choice([1, 40], n) + 1).clip(1, lm_scoring.CELLS)
    at = np.arange(n) + side
    trainer = lm_scoring.Trainer(net)
    trainer.learn(seen, at)
    rows, places = np.divmod(seen[at].astype(int) - 1, lm_scoring.SIDES)
    wide = [v.astype(np.float64) for v in net.parts()]
    embed, row, row_bias, gate, place, place_bias = wide
    hidden = np.tanh(sum(embed[k][seen[at + step]] for k, step in enumerate(lm_scoring.offsets())))
    grads = [np.zeros_like(v) for v in wide]
    gated = hidden * gate[rows]
    back = []
    for logits, own in ((hidden @ row + row_bias, rows), (gated @ place + place_bias[rows], places)):
        chances = np.exp(logits - logits.max(axis=1, keepdims=True))
        chances /= chances.sum(axis=1, keepdims=True)
        chances[np.arange(n), own] -= 1
        back.append(chances / n)
    of_row, of_place = back
    grads[1], grads[2], grads[4] = hidden.T @ of_row, of_row.sum(axis=0), gated.T @ of_place
    np.add.at(grads[5], rows, of_place)
    np.add.at(grads[3], rows, of_place @ place.T * hidden)
    to_hidden = (of_row @ row.T + of_place @ place.T * gate[rows]) * (1 - hidden**2)
    for k, step in enumerate(lm_scoring.offsets()):
        np.add.at(grads[0][k], seen[at + step], to_hidden)
    for got, value, grad in zip(trainer.net.parts(), wide, grads, strict=True):
        assert np.allclose(got, value - lm_scoring.RATE * grad / np.sqrt(1e-6 + grad**2), atol=1e-4)
        assert not np.allclose(got, value, atol=1e-3)
