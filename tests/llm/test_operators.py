"""Each operator against brute force, round trips or held-out accuracy, and on odd tables."""

import hashlib
import random
import re
from dataclasses import replace

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from foliospark.llm import components, language_id, lm_scoring, mixing, nearest, quality_rules, sentencepiece_codec, simhash, suffix_array, suffix_dedup, toxicity, url_filters

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = sentencepiece_codec.default_model()


def odd_rows():
    """Nulls everywhere, empty and long texts, ties, repeated rows."""
    rng = random.Random(3)
    passage = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "épsilon"]) + str(rng.randint(0, 99)) for _ in range(60))
    prose = [" ".join(rng.choice(["the", "of", "and", "house", "river", "stone", "blue", "idea"]) + rng.choice(["", "", "s", "ed"]) for _ in range(rng.randint(1, 120))) for _ in range(30)]
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 4}", len(t)) for i, t in enumerate(prose)]
    rows += [(100 + i, f"{t} {passage} {t}", "en", "s1", None) for i, t in enumerate(prose[:6])]
    rows += [(200, prose[3], "en", None, 1), (201, prose[3] + " x", None, "s2", 1), (202, None, "en", "s1", 0), (203, "", None, None, None), (204, " \t\n", "en", "", 3)]
    rows += [(205, "ab " * 20_000, "en", "s3", 1), (206, "a" * 5000, "en", "s3", 1), (207, "日本語 テキスト 🙂 " * 40, "en", "s0", 1), (207, "日本語 テキスト 🙂 " * 40, "en", "s0", 1)]
    rows += [(None, prose[5], "en", "s1", 1), (None, "another text without an id", None, None, None), (0, "a second text for id 0", "fr", "s9", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def clashing(docs, *columns):
    for c in columns:
        docs = docs.withColumn(c, F.lit("mine"))
    return docs.withColumn("a.b", F.lit(1)).withColumn("made", F.lit(2)).withColumn("row", F.lit(3))


# 1


def test_sentencepiece_is_the_library(spark, docs, none):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    rng = random.Random(5)
    texts = [r[1] or "" for r in odd_rows()] + ["".join(rng.choice("abcdeéñ  th🙂\n.,1 ▁") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    for r in sentencepiece_codec.decode(sentencepiece_codec.encode(rows, MODEL), MODEL).collect():
        ids = lib.encode(texts[r["doc_id"]])
        assert r["pieces"] == ids and r["decoded"] == lib.decode(ids)
    apart = sentencepiece_codec.decode(sentencepiece_codec.encode(rows, MODEL), MODEL)
    assert sorted(map(str, apart.collect())) == sorted(map(str, sentencepiece_codec.encode_and_decode(rows, MODEL).collect()))
    out = sentencepiece_codec.encode(clashing(docs, "pieces"), MODEL)
    assert out.where("text is null").first()["pieces"] == [] and out.count() == docs.count() and "a.b" in out.columns
    assert sentencepiece_codec.encode(none, MODEL).count() == 0


def test_runs_are_worked_out_once_and_told_apart(monkeypatch):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    rng = random.Random(6)
    texts = ["".join(rng.choice(["th", "er", "sch", "ión", "é", " ", " ", ".\n", "🙂", "***", "a" * 40, "日本", "▁"]) for _ in range(rng.randint(0, 80))) for _ in range(120)]

    def encoded(model):
        ids, counts = model.encode(texts)
        decoded = model.decode_all(ids, counts).to_pylist()
        return [(p.tolist(), d) for p, d in zip(np.split(ids, np.cumsum(counts)[:-1]), decoded, strict=True)]

    want = [(lib.encode(t), lib.decode(lib.encode(t))) for t in texts]
    model = sentencepiece_codec.Model(MODEL)
    assert encoded(model) == want
    with monkeypatch.context() as m:
        m.setattr(model, "_viterbi", lambda *_: pytest.fail("searched again"))
        assert encoded(model) == want
    monkeypatch.setattr(sentencepiece_codec, "REMEMBERED", 40)
    assert encoded(model) == want and encoded(model) == want
    model._shrink()
    assert 0 < model.n <= 20 and model.n_chars <= 20 * sentencepiece_codec.WIDTH
    assert encoded(model) == want
    clash = sentencepiece_codec.Model(MODEL)
    monkeypatch.setattr(clash, "_hashes", lambda codes, starts, widths: codes[starts].astype(np.uint64) % np.uint64(3))
    assert encoded(clash) == want and encoded(clash) == want


def test_a_unigram_model_takes_the_best_sum():
    model = sentencepiece_codec.Model(MODEL)
    model.kind = sentencepiece_codec.UNIGRAM
    word = "▁hellos"
    best = {0: (0.0, [])}
    for j in range(1, len(word) + 1):
        options = [(best[i][0] + model.scores[model.by_text[word[i:j]]], best[i][1] + [model.by_text[word[i:j]]]) for i in range(j) if i in best and word[i:j] in model.by_text]
        if options:
            best[j] = max(options)
    ids, _ = model.encode(["hellos"])
    assert sum(model.scores[ids]) == pytest.approx(best[len(word)][0])


# 2


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left, w = total - sum(fixed.values()), sum(weight[s] for s in order if s not in fixed)
        target = {s: fixed.get(s, left * weight[s] / w if w else 0) for s in order}
        over = [s for s in order if s not in fixed and target[s] > most * sizes[s]]
        if not over:
            return target
        fixed |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("split", [True, False])
def test_mixing_meets_its_targets(docs, split):
    rows = mixing.mix_plan(docs, whole=not split).collect()
    assert len(rows) == docs.count()
    sizes, taken, target = {}, {}, {}
    for r in rows:
        n = len(WORDS.findall(r["text"] or ""))
        assert r["size"] == n and r["taken"] <= 3 * n and sum(c["words"] for c in r["copies"]) == r["taken"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    expected = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(expected[s])
        biggest = max((r["size"] for r in rows if r["source"] == s), default=0)
        assert abs(taken[s] - target[s]) <= (1.5 if split else biggest)
    assert sum(expected.values()) == pytest.approx(sum(sizes.values()))
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_plan(docs.repartition(5), whole=not split).collect()))


def test_mixing_odd_tables(docs, none):
    assert mixing.mix_plan(none).count() == 0 and mixing.mix(none).count() == 0
    out = mixing.mix(clashing(docs, "size", "taken", "shard", "copies"), shards=5)
    assert {r["shard"] for r in out.select("shard").distinct().collect()} <= set(range(5)) and "a.b" in out.columns


def test_the_splitting_tree_deals_every_quota(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAMILY", 2)
    quotas = [100, 7, 0, 300, 1, 12, 55]
    counts = spark.createDataFrame(list(enumerate(quotas)), "place bigint, quota bigint")
    rows = mixing.deal_quotas(counts, 6).collect()
    shares = np.zeros((6, len(quotas)), dtype=int)
    for r in rows:
        shares[r["shard"], r["place"]] = r["share"]
    assert len(rows) == 6 * len(quotas) and shares.sum(axis=0).tolist() == quotas and (shares >= 0).all()
    assert max(shares.sum(axis=1)) - min(shares.sum(axis=1)) <= 1


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_mixing_many_sources(spark, monkeypatch, broadcast):
    """100,000 sources: no row, task or broadcast holds them all; and a plan too large to send to all tasks."""
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", broadcast)
    n = 100_000 if broadcast else 3000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"))
    sizes = {f"s{i}": i % 7 for i in range(n)}
    want = brute_targets(sizes)
    rows = mixing.mix_plan(docs).select("source", "target", "taken", "size").collect()
    assert len(rows) == n
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and abs(r["taken"] - r["target"]) <= 0.5 + 1e-6


# 3


def brute_fingerprint(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = WORDS.findall(w)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(docs, none):
    rows = simhash.near_duplicates(clashing(docs, "component_id")).collect()
    given = odd_rows()
    prints = [(i, brute_fingerprint(t)) for i, t, *_ in given]
    assert sorted((str(r["doc_id"]), r["fingerprint"] & (2**64 - 1)) for r in rows) == sorted((str(i), f) for i, f in prints)
    group = {f: {f} for _, f in prints}
    for f in group:
        for g in group:
            if (f ^ g).bit_count() <= 2 and group[f] is not group[g]:
                group[f] |= group[g]
                for x in group[f]:
                    group[x] = group[f]
    for r in rows:
        members = [i for i, f in prints if f in group[r["fingerprint"] & (2**64 - 1)] and i is not None]
        assert r["component_id"] == min(members, default=None)
    assert simhash.near_duplicates(none).count() == 0


def test_trie_pairs_are_all_close_pairs():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64))
    groups = keys >> np.uint64(8)
    x, y = simhash.trie_pairs(keys & np.uint64(255), groups, 8, 2)
    found = {tuple(sorted(map(int, p))) for p in zip(x, y, strict=True)}
    assert found == {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if groups[i] == groups[j] and (int(keys[i]) ^ int(keys[j])).bit_count() <= 2}


def test_links_at_every_place_of_the_bits(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(200):
        f = rng.getrandbits(64)
        rows += [f, f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))]
    distinct = sorted({f - (1 << 64) if f >> 63 else f for f in rows})
    got = {tuple(sorted(r)) for r in simhash.links(spark.createDataFrame([(f,) for f in distinct], "fingerprint bigint")).collect()}
    assert got == {(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (None, 1)]
    found = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert len({found[i] for i in range(61)}) == 1 and len({found[1000 + i] for i in range(50)}) == 1 and found[0] != found[1000]


# 4


def test_language_is_learned_and_rejected(spark, none):
    rng = random.Random(7)
    kinds = {"aa": ["lomo", "tira", "sena", "bulo"], "bb": ["kräft", "schum", "drang", "pfeil"], "cc": ["whol", "ything", "brook", "stan"]}
    make = lambda k: " ".join("".join(rng.choice(kinds[k]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 40)))
    known = [(make(k).encode(), k) for _ in range(120) for k in kinds]
    model = language_id.train([t for t, _ in known], [k for _, k in known])
    trial = [(i, make(k), k) for i, k in enumerate(list(kinds) * 40)]
    rows = spark.createDataFrame([*trial, (900, None, None), (901, "123 ... !", None), (902, "", None)], "doc_id bigint, text string, truth string")
    out = language_id.identify(clashing(rows, "score"), model, reject=False).collect()
    right = [r for r in out if r["truth"] == r["lang_pred"]]
    assert len(right) >= 0.97 * len(trial) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["lang_pred"] for r in out if r["doc_id"] >= 900} == {"und"}
    assert language_id.identify(none, model).count() == 0
    strict = language_id.LanguageModel(model.languages, model.table, model.bias, model.temperature, 2.0)
    assert {r["lang_pred"] for r in language_id.identify(rows, strict).collect()} == {"und"}
    nothing = language_id.train([], [])
    assert language_id.identify(rows, nothing, reject=False).count() == rows.count()


# 5


def test_toxicity_on_held_out_texts(spark, none):
    rng = random.Random(8)
    clean = ["river", "stone", "walk", "paper", "green", "idea", "music", "house"]
    make = lambda bad: " ".join([rng.choice(clean) for _ in range(rng.randint(5, 60))] + ([rng.choice(["grumph", "grumphed", "zorkish"])] if bad else []))
    rows = [(i, make(i % 5 == 0), i % 5 == 0) for i in range(900)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, None), (5001, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(b)) for i, _, b in rows if i < 600] + [(1, None), (None, 1), (77777, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    out = {r["doc_id"]: r for r in toxicity.score(clashing(docs, "predicted"), model).collect()}
    late = [(out[i]["predicted"], int(b)) for i, _, b in rows if i >= 600]
    assert sum(p == b for p, b in late) >= 0.98 * len(late)
    assert 0 <= out[5000]["score"] <= 1 and out[5000]["score"] == out[5001]["score"] and out[5000]["predicted"] == 0
    empty = toxicity.fit(docs, labels.where("false"))
    assert toxicity.score(docs, empty).where("predicted = 1").count() == 0 and toxicity.score(none, model).count() == 0


# 6


def test_nearest_finds_most_and_scores_exactly(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(1500, 24))
    v[300:700] = v[300]  # one common vector
    rows = [(i, [float(x) for x in v[i]]) for i in range(1500)]
    odd = [(1500, None), (1550, [0.0] * 24), (1600, [float("nan")] * 24), (1650, [1.0] * 3), (None, rows[0][1]), (1700, [None] + [1.0] * 23), rows[50]]
    out = nearest.nearest(spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>")).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = {}
    for r in out:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 1500, 50))
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == [1, 2, 3, 4, 5] and len({x[1] for x in found}) == 5 and q not in {x[1] for x in found}
        assert all(s == pytest.approx(u[q] @ u[i], abs=1e-12) for _, i, s in found)
        assert found == sorted(found, key=lambda x: (-round(x[2], 12), x[1]))
        s = u @ u[q]
        s[q] = -2
        best = set(np.lexsort((np.arange(1500), -s.round(12)))[:5].tolist())
        hits += len(best & {x[1] for x in found})
    assert hits >= 0.9 * 5 * len(got)
    assert {x[1] for x in got[350]} == {300, 301, 302, 303, 304}
    few = nearest.nearest(spark.createDataFrame(rows[50:53], "vec_id bigint, embedding array<double>")).collect()
    assert sorted(r["rank"] for r in few) == [1, 2]
    assert nearest.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def brute_nearest(rows, every=50, k=5):
    """{query: [(vec_id, score)]} over rows of one dimension and distinct ids, by exact integers of the scaled vectors' cosines."""
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], dtype=np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = u @ u[q]
        order = [j for j in np.lexsort((ids, -s.round(12))) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def recall(out, want):
    got = {}
    for r in out:
        got.setdefault(r["query_id"], {})[r["rank"]] = r
    assert got.keys() == {q for q, x in want.items() if x}
    hits = total = 0
    for q, best in want.items():
        assert sorted(got.get(q, {})) == list(range(1, len(best) + 1)), q
        hits += len({r["vec_id"] for r in got.get(q, {}).values()} & {i for i, _ in best})
        total += len(best)
    return hits / total if total else 1.0


def test_nearest_of_extreme_magnitudes(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 16)).astype(np.float32)
    v[50] *= np.float32(1e-25)
    v[100] *= np.float32(1e25)
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)]
    out = nearest.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert recall(out, brute_nearest(rows)) >= 0.9
    wide = rng.normal(size=(200, 12))
    wide[50] *= 1e-200
    wide[100] *= 1e200
    rows = [(i, [float(x) for x in wide[i]]) for i in range(200)]
    out = nearest.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert recall(out, brute_nearest(rows)) >= 0.9 and all(-1.000001 <= r["score"] <= 1.000001 for r in out)


def test_nearest_serves_every_dimension(spark, monkeypatch):
    monkeypatch.setattr(nearest, "GROUP", 250)
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for n, (count, dim) in enumerate(((400, 8), (300, 6), (200, 5), (60, 3), (3, 2), (1, 7))):
        part = [(n * 1000 + i, [float(x) for x in rng.normal(size=dim)]) for i in range(count)]
        rows += part
        want |= brute_nearest(part)
    out = nearest.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert recall(out, want) >= 0.9


@pytest.mark.parametrize("n", [1, 6, 9, 20])
def test_nearest_in_small_tables(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i * 25, [float(x) for x in rng.normal(size=4)]) for i in range(n)]
    out = nearest.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert recall(out, brute_nearest(rows)) >= (1.0 if n <= 6 else 0.8)


def test_nearest_finds_five_where_lists_are_small(spark):
    """Tight clusters of three: one probed list never holds five candidates."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(60, 10)) * 10
    rows = [(i * 10, [float(x) for x in centres[i % 60] + rng.normal(size=10) * 0.01]) for i in range(180)]
    out = nearest.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert recall(out, brute_nearest(rows)) >= 0.7  # all ranks are there; the two of the cluster come first
    best = brute_nearest(rows)
    assert all(r["vec_id"] == best[r["query_id"]][r["rank"] - 1][0] for r in out if r["rank"] <= 2)


# 7


def test_url_filters_run_all_patterns_by_brute_force(spark):
    urls = [None, "", "nothing", "http://Spam-Farm.example.com/x", "https://x.ORG", "https://x.org/", "http://example.org/es/a?b", "http://a.example.org/en/12#c", "http://b.com/fr/", "http://b.com/de/?q", "http://notexample.org/es/", "http://a.net/tag/x/page/7", "http://ads.a.net/", "http://a.net/q?sessionid=1f", "weird://://h/p", "http://a.net/login", "http://h\nx/p", "http://cheap-pills.a.net/fr/1"]
    out = {r["page_id"]: r for r in url_filters.judge_urls(clashing(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), "rule")).collect()}
    for i, u in enumerate(urls):
        found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (found[1].lower(), found[2]) if found else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in url_filters.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, default=None)
        blocked = any(re.search(p.regex, (u or "").lower()) for p in url_filters.PATTERNS)
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, rule and rule[1]), u
        assert out[i]["verdict"] == (rule[2] if rule else "block" if blocked else "allow"), u


def test_rules_and_their_tokens():
    got = {r: url_filters.parse_rule(r) for r in ("^ads^", "||x", "/wp-admin/", "shop*cart", "|http://a.net/", "/login|", "*", "?q=")}
    assert got["^ads^"].tokens == ("ads",) and got["/wp-admin/"].tokens == ("wp", "admin") and got["shop*cart"].tokens == ()
    assert got["|http://a.net/"].tokens == ("http", "a", "net") and got["/login|"].tokens == ("login",) and got["*"].tokens == () and got["?q="].tokens == ("q",)
    assert url_filters.index_patterns([url_filters.Pattern("a-b", ("a", "b")), url_filters.Pattern("x", ())], {"a": 5, "b": 2}) == {"b": ["a-b"], "": ["x"]}
    for p in url_filters.PATTERNS:
        assert p.tokens


def test_an_index_of_thousands_of_rules(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 4)))
    rules = url_filters.parse_rules({rng.choice(("^", "/", "|http://", "", "."))+ word() + rng.choice(("^", "/", "-", "*", "=")) + word() + rng.choice(("^", "", "|", "?")) for _ in range(5000)})
    urls = [f"http://{word()}.{word()}/{word()}-{word()}/{word()}?{word()}={word()}" for _ in range(300)]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    out = {r["page_id"]: r["verdict"] for r in url_filters.judge_urls(table, patterns=rules, rules=()).collect()}
    every = [re.compile(p.regex) for p in rules]
    assert out == {i: "block" if any(x.search(u) for x in every) else "allow" for i, u in enumerate(urls)}
    assert url_filters.judge_urls(table.where("false")).count() == 0


# 8


def brute_repeats(rows, window=suffix_dedup.WINDOW):
    """(id, text) of distinct rows -> removed runs, by hashing every window in order."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            w = b[s : s + window]
            if w in seen:
                gone[s : s + window] = b"\1" * window
            seen.add(w)
        out[i] = bytes(c for c, g in zip(b, gone, strict=True) if not g), [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeats_go_and_first_ones_stay(spark, docs, none, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", 10**9)
    rows = [r for r in dict.fromkeys(odd_rows()) if r[0] is not None and r[1] != "a second text for id 0"]
    copied = rows[-8][1] if len(rows[-8][1] or "") > 300 else next(r[1] for r in rows if len(r[1] or "") > 300)
    rows += [(i, t, "en", "s1", 1) for i, t in ((60, copied), (61, copied), (62, f"before {copied} after"), (63, copied[:150]), (64, copied[:150]), (65, copied[:99]), (66, copied[:99]))]
    table = spark.createDataFrame(rows, DOCS)
    expected = brute_repeats([(r[0], r[1]) for r in rows])
    for r in suffix_dedup.strip_repeats(clashing(table, "kept", "key", "place")).collect():
        kept, runs = expected[r["doc_id"]]
        assert (bytes(r["kept"]), [tuple(x) for x in r["removed"]]) == (kept, runs), r["doc_id"]
    out = suffix_dedup.strip_repeats(docs).collect()
    assert len(out) == docs.count()
    twice = [r for r in out if r["doc_id"] == 207]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert suffix_dedup.strip_repeats(none).count() == 0


def test_suffix_arrays_and_prefixes_by_sorting():
    rng = np.random.default_rng(1)
    for _ in range(200):
        t = np.concatenate((rng.integers(1, rng.integers(2, 6), rng.integers(0, 60)), [0])).astype(np.uint16)
        sa, want = suffix_array.suffix_arrays([t])[0], sorted(range(len(t)), key=lambda i: tuple(t[i:]))
        assert sa.tolist() == want
        shared = suffix_array.common_prefixes(t, sa)
        for a, b in zip(want[1:], want, strict=False):
            n = next(k for k in range(len(t)) if t[a + k] != t[b + k])
            assert shared[a] == n


def test_suffix_arrays_of_several_texts_that_recur_deeply():
    rng = np.random.default_rng(2)
    for i in range(300):
        texts = []
        for _ in range(rng.integers(1, 6)):
            x = rng.integers(1, rng.integers(2, 6), rng.integers(0, 90))
            texts.append(np.concatenate((np.tile(x[: max(1, len(x) // 5)], 6)[: len(x)] if i % 2 else x, [0])).astype(np.uint16))
        for t, sa in zip(texts, suffix_array.suffix_arrays(texts), strict=True):
            assert sa.tolist() == sorted(range(len(t)), key=lambda k: tuple(t[k:]))
    a = [0, 1]
    for _ in range(12):  # a Fibonacci word: names repeat at every depth
        a = a[:] + a[: len(a) * 3 // 5]
    t = np.concatenate((np.array(a) + 1, [0])).astype(np.uint16)[-4000:]
    assert suffix_array.suffix_arrays([t])[0].tolist() == sorted(range(len(t)), key=lambda k: tuple(t[k:]))


# 9


def test_scores_are_chances_and_prefer_the_corpus(spark, none):
    rng = random.Random(6)
    base = "the cat sat on the mat and the dog lay on the rug while the cat slept".split()
    rows = [(i, " ".join(base[(k + i) % len(base)] for k in range(rng.randint(5, 60)))) for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, None), (901, " "), (902, "rug mat the the lay cat on on sat")], "doc_id bigint, text string")
    model = lm_scoring.fit(docs)
    out = {r["doc_id"]: r for r in lm_scoring.score(clashing(docs, "log_prob"), model).collect()}
    assert out[900]["n_tokens"] == 0 and out[900]["perplexity"] is None and out[901]["log_prob"] == 0
    assert out[3]["perplexity"] < out[902]["perplexity"]
    assert lm_scoring.score(none, model).count() == 0
    # the chances of all cells at a place sum to one, and each token is predicted without itself
    seen, at, _ = lm_scoring._lined_up(model, [[b"the cat sat on unknownword".split()]], {})
    every = []
    for cell in range(lm_scoring.CELLS):
        changed = seen.copy()
        changed[at[2]] = cell + 1
        every.append(model.log_probs(changed, at[2:3])[0] + model.mass[cell])
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-4)
    assert max(every) == every[model.head[b"sat"]] and min(every) < -5
    # near what the network says before its numbers are rounded
    assert np.allclose(model.log_probs(seen, at), [brute_place(model, seen, p) for p in at], atol=0.3)
    counts = {bytes(r["word"]): r["n"] for r in lm_scoring.word_counts(docs).collect()}
    assert counts[b"the"] == sum(t.split().count("the") for _, t in rows) + 2


def brute_place(model, seen, place, rounded=False):
    """One place's log-chance of its cell and of a word seen once in it."""
    net = model.net
    row, at = divmod(int(seen[place]) - 1, lm_scoring.SIDES)
    hidden = np.tanh(sum(net.embed[k][seen[place + step]] for k, step in enumerate(lm_scoring.offsets())))
    r = (lambda x: np.rint(np.clip(x, -16, 16) * 128) / 128) if rounded else (lambda x: x)
    hidden = r(hidden)
    total = 0.0
    for value, weights, bias, own in ((hidden, net.row, net.row_bias, row), (np.clip(r(hidden * r(net.gate[row])), -1, 1) if rounded else hidden * net.gate[row], net.place, net.place_bias[row], at)):
        logits = value.astype(float) @ r(weights).astype(float) + bias
        total += logits[own] - np.log(np.exp(logits - logits.max()).sum()) - logits.max()
    return total - model.mass[int(seen[place]) - 1]


def brute_log_prob(model, counts, text):
    """One text, word by word."""
    words = (text or "").encode().lower().split()
    seen, at, _ = lm_scoring._lined_up(model, [[words]], {})
    known = sum(np.log(counts.get(w, 1)) for w in words if w not in model.head)
    return known + sum(brute_place(model, seen, p, rounded=True) for p in at)


def test_scores_by_brute_force_on_odd_rows(spark, docs):
    model = lm_scoring.fit(docs, heads=4)
    assert len(model.head) == 4
    counts = {}
    for _, t, *_ in odd_rows():
        for w in (t or "").encode().lower().split():
            counts[w] = counts.get(w, 0) + 1
    best = sorted(counts, key=lambda w: (-counts[w], w))[:4]
    assert list(model.head) == best
    # each class's shares sum to less than one, by the word never seen
    for c in range(0, lm_scoring.TAIL, 8):
        assert sum(n for w, n in counts.items() if w not in best and xxhash.xxh64_intdigest(w, 42) % lm_scoring.TAIL == c) + 1 == pytest.approx(np.exp(model.mass[lm_scoring.HEAD + c]))
    out = lm_scoring.score(clashing(docs, "perplexity", "n", "key", "share"), model).collect()
    assert len(out) == len(odd_rows()) and all(r["key"] == "mine" for r in out)
    want = {(str(i), t): brute_log_prob(model, counts, t) for i, t, *_ in odd_rows() if len(t or "") < 10_000}
    for r in out:
        if (str(r["doc_id"]), r["text"]) in want:
            assert r["log_prob"] == pytest.approx(want[str(r["doc_id"]), r["text"]], abs=1e-5 + 1e-5 * r["n_tokens"])
            assert r["n_tokens"] == len(WORDS.findall(r["text"] or ""))
    again = lm_scoring.score(docs.repartition(7), model).collect()
    assert sorted((str(r["doc_id"]), r["log_prob"]) for r in again) == sorted((str(r["doc_id"]), r["log_prob"]) for r in out)


@pytest.mark.parametrize("shard", [2_000_000, 40])
def test_scores_do_not_depend_on_the_layout(spark, docs, monkeypatch, shard):
    """Model and scores, from the first count to the last sum, in other partitions and another order; one shard and many."""
    monkeypatch.setattr(lm_scoring, "SHARD", shard)
    prose = spark.createDataFrame([(1000 + i, f"{t} {t[::-1]}", "en", "s", 1) for i, (_, t, *_) in enumerate(odd_rows()) if t and len(t) < 5000], DOCS)
    both = docs.union(prose)
    runs = []
    for table in (both.repartition(1), both.orderBy(F.desc("text")).repartition(6)):
        model = lm_scoring.fit(table, heads=20)
        runs.append((model.net.flat().tobytes(), sorted((str(r["doc_id"]), r["log_prob"]) for r in lm_scoring.score(table, model).collect())))
    assert runs[0] == runs[1]
    assert model.net.flat().tobytes() != lm_scoring.start([], np.zeros(lm_scoring.TAIL)).net.flat().tobytes()


def test_every_word_is_learned_from_once(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BUFFER", 50)
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 700))) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (901, texts[5])], "doc_id bigint, text string")
    model = lm_scoring.start([(f"w{i}".encode(), 1) for i in range(40)], np.ones(lm_scoring.TAIL))
    rows = lm_scoring.lessons(docs, model).collect()
    side = lm_scoring.SIDE
    assert {r["turn"] for r in rows} == set(range(lm_scoring.ROUNDS))
    parts = {}
    for r in sorted(rows, key=lambda r: (r["high"], r["low"], r["part"])):
        parts.setdefault((r["high"], r["low"]), []).append(np.frombuffer(r["cells"], dtype=np.uint16))
    got = sorted(np.concatenate([c[side:-side] for c in p]).tolist() for p in parts.values())
    assert got == sorted([model.head[w] + 1 for w in t.encode().split()] for t in set(texts) if t)
    # a place's neighbours are the text's, across parts too
    steps = [np.concatenate(([0] * side, g, [0] * side)) for g in (np.concatenate([c[side:-side] for c in p]) for p in parts.values())]
    for whole, p in zip(steps, parts.values(), strict=True):
        at = 0
        for c in p:
            assert c.tolist() == whole[at : at + len(c)].tolist()
            at += len(c) - 2 * side
    trainer = lm_scoring.Trainer(model.net)
    trainer.learn(steps[0].astype(np.uint16), np.flatnonzero(steps[0]))
    assert trainer.used == np.count_nonzero(steps[0])


def test_scores_do_not_depend_on_which_counts_are_joined(spark, docs):
    model = lm_scoring.fit(docs, heads=4)
    none, some = ({w: v for w, v in model.common.items() if w in model.head or w in few} for few in (set(), set(list(model.common)[::3])))
    assert len(model.common) > len(some) > len(none) == 4
    runs = [sorted((str(r["doc_id"]), r["n_tokens"], r["log_prob"]) for r in lm_scoring.score(docs, replace(model, common=c)).collect()) for c in (model.common, some, none)]
    assert runs[0] == runs[1] == runs[2]
    assert len(lm_scoring.common(model.counts.select(F.col("h").cast("string").cast("binary").alias("word"), "n"), {}, 3)) <= 3


def test_strong_weights_stay_finite():
    model = lm_scoring.start([(b"the", 5)], np.ones(lm_scoring.TAIL))
    for weights in (model.net.row, model.net.place, model.net.gate, model.net.embed):
        weights *= 1000
    seen, at, _ = lm_scoring._lined_up(model, [[b"the cat sat on the mat".split()]], {})
    got = model.log_probs(seen, at)
    assert np.isfinite(got).all() and (got <= 0).all()


# 10


def brute_quality(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {w for w in windows if windows.count(w) > 1} if len(windows) < 2000 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in many for k in range(3)}
    n, r = len(words), len(covered)
    failed = n < 50 or 100 * r > 50 * n
    raw = text.encode()
    z = lambda b: len(zstandard.ZstdCompressor(level=3).compress(b)) / len(b)
    if failed:
        kept = False
    else:
        low, high = [b for b in quality_rules.BANDS if len(raw) >= b[0]][-1][1:]
        chunks = [raw[i : i + 4096] for i in range(0, len(raw), 4096)]
        chunks = [c for k, c in enumerate(chunks) if k == 0 or len(c) >= 2048]
        bad = sum(not 0.18 <= z(c) <= 0.75 for c in chunks) if len(chunks) > 1 else 0
        kept = low <= z(raw) <= high and bad <= 0.25 * len(chunks)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r, failed, kept


def test_quality_rules(spark, docs, none):
    rng = random.Random(1)
    extra = [(300, "\n".join(["same line here"] * 30 + ["other #*$ words"]), None, None, None), (301, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(70)) for _ in range(200)), None, None, None)]
    rows = clashing(docs.union(spark.createDataFrame(extra, DOCS)), "kept")
    for r in quality_rules.judge_quality(rows).collect():
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")) == brute_quality(r["text"]), r["doc_id"]
    verdicts = {r["doc_id"]: r for r in quality_rules.judge_quality(rows).collect()}
    assert not verdicts[301]["base_failed"] and not verdicts[301]["kept"]
    assert quality_rules.judge_quality(none).count() == 0


def test_digests_of_the_repeat_query(spark, tmp_path):
    rows = [(1, "x" * 250), (2, "é" * 120), (3, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in suffix_dedup.op8_suffix_array_dedup(spark, str(tmp_path)).collect():
        kept, runs = brute_repeats(rows)[r["doc_id"]]
        raw = (dict(rows)[r["doc_id"]] or "").encode()
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
