"""The Merkle manifest, the BPE codec and spelling variants against brute force."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.test_operators import DOCS, clashing, odd_rows

from foliospark.llm import bpe_codec, merkle, queries, spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def sorted_rows(rows):
    return sorted(map(str, rows))


# 11


def brute_tree(leaves, fanout):
    proofs, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for i, k in enumerate(at):
            first = k - k % fanout
            proofs[i].append(("".join(nodes[first:k]), "".join(nodes[k + 1 : first + fanout])))
            at[i] = k // fanout
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], proofs


def brute_proofs(rows, fanout):
    """(group, order, leaf) -> (group, order, leaf, subroot, root, proof) of every row."""
    groups = collections.defaultdict(list)
    for g, o, leaf in rows:
        groups[g].append((o is not None, o or 0, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [brute_tree([x[2] for x in sorted(groups[g])], fanout) for g in names]
    root, above = brute_tree([t[0] for t in trees], fanout)
    return [(g, o if known else None, leaf, sub, root, p + up) for g, (sub, proofs), up in zip(names, trees, above, strict=True) for (known, o, leaf), p in zip(sorted(groups[g]), proofs, strict=True)]


@pytest.mark.parametrize(("fanout", "levels"), [(2, 1), (3, 1), (2, 3), (8, 4)])
def test_proofs_by_brute_force(spark, fanout, levels):
    """Trees of one leaf, of one block, and of many blocks whose last groups are short at every level."""
    rng = random.Random(fanout * 10 + levels)
    sizes = {None: 3, "": 1, "a": 67, "é": 19, "z": 9, "B": 2, "a b": 28}
    rows = [(g, rng.choice([None, *range(40)]), sha(str(rng.randrange(50)))) for g, n in sizes.items() for _ in range(n)]
    table = clashing(spark.createDataFrame(rows, "g string, o bigint, leaf string").repartition(5), "root", "tree", "block")
    got = merkle.prove(table, "g", "o", fanout=fanout, levels=levels)
    assert got.columns == ["g", "o", "leaf", "tree", "block", "a.b", "made", "row", "subroot", "root", "proof"]
    found = [(r["g"], r["o"], r["leaf"], r["subroot"], r["root"], [tuple(x) for x in r["proof"]]) for r in got.collect()]
    assert sorted_rows(found) == sorted_rows(brute_proofs(rows, fanout))
    assert got.where(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0


def test_proofs_of_no_rows(spark):
    assert merkle.prove(spark.createDataFrame([], "g string, o bigint, leaf string"), "g", "o").count() == 0


def manifest_rows(rows):
    encoded = lambda values: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))
    now = collections.defaultdict(list)
    for r in rows:
        d = dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True))
        leaf = encoded(d[f] for f in FIELDS)
        text = d["text"].translate(LOW) if d["text"] is not None and d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 3 == 0 else d["text"]
        now[d["lang"], d["doc_id"], leaf] = encoded([*(d[f] for f in FIELDS[:-1]), text])
    made = []
    for lang, i, leaf, sub, root, proof in brute_proofs([(d[2], d[0], encoded((d[0], d[3], d[2], d[4], d[1]))) for d in rows], 8):
        h = now[lang, i, leaf]
        for a, b in proof:
            h = sha(a + h + b)
        made.append((i, leaf, sub, root, sha("".join(a + b for a, b in proof)), h, h == root))
    return made


def test_manifest_of_odd_rows(spark, tmp_path):
    rows = [*odd_rows(), (3, "Changed HERE", "en", "s", 1), (6, "CHANGED", None, "s", None), (9, "Ünï ABC", "fr", None, 2)]
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()]
    assert sorted_rows(got) == sorted_rows(manifest_rows(rows))
    assert {True, False} == {r[-1] for r in got}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted_rows(db.execute(merkle.op11_sql()).fetchall()) == sorted_rows(got)


# 12


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(bpe_codec.default_tokenizer())


CHARS = [*"abcdeéñßÀ  th🙂\n.,1 '-|<>", "\x85", " ", "́", "　", "\t", "\x0b", "\x1c", "\x00", "<|startoftext|>", "<|endoftext|>", "日", "Σ", "İ", "'s", " ", "ﬁ", "Å", "ᄀ", "ᅡ", "가", "×"]


def test_codec_is_the_library(library):
    rng = random.Random(4)
    codec = bpe_codec.Codec(bpe_codec.default_tokenizer())
    codec.chunks.most, codec.runs.most = 30, 200  # what was forgotten comes again
    for k in range(600):
        texts = ["".join(rng.choice(CHARS) for _ in range(rng.randint(0, rng.choice([10, 1500])))) for _ in range(4)]
        if k % 5 == 0:
            texts = [texts[0] * 20, "".join(x for x in texts[1] * 9 if not x.isspace()), texts[0], texts[0][5:]]
        raw = [t.encode() for t in texts]
        out = codec.encode(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]).tolist())
        for t, packed in zip(texts, out, strict=True):
            ids = library.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(packed, dtype="<u4").tolist() == ids, t
            assert codec.decode(np.frombuffer(packed, dtype="<u4")) == library.decode(ids, skip_special_tokens=False)


def test_other_tokenizers_are_asked_whole_runs(library):
    """Without the usual steps before the model, every run goes through the library."""
    import json

    spec = json.loads(bpe_codec.default_tokenizer())
    spec["normalizer"]["normalizers"].append({"type": "Replace", "pattern": {"String": "a"}, "content": "e"})
    from tokenizers import Tokenizer

    codec, lib = bpe_codec.Codec(json.dumps(spec)), Tokenizer.from_str(json.dumps(spec))
    assert codec.steps is None
    raw = b"A banana's day, and another banana " * 50
    assert np.frombuffer(codec.encode(np.frombuffer(raw, dtype=np.uint8), [0, len(raw)])[0], dtype="<u4").tolist() == lib.encode(raw.decode(), add_special_tokens=False).ids


def test_chunks_are_cut_alike_wherever_they_stand_and_encoded_once():
    rng = np.random.default_rng(3)
    passage = rng.integers(97, 123, 20_000).astype(np.uint8)
    alone = set(bpe_codec.cut_places(passage).tolist())
    inside = {c - 777 for c in bpe_codec.cut_places(np.concatenate((rng.integers(97, 123, 777).astype(np.uint8), passage))).tolist()}
    assert len(alone) > 20 and alone == {c for c in inside if c > bpe_codec.WINDOW}
    codec = bpe_codec.Codec(bpe_codec.default_tokenizer())
    asked = []
    whole = codec._run
    codec._run = lambda r: asked.append(r) or whole(r)
    text = " ".join("".join(map(chr, rng.integers(97, 123, 7))) for _ in range(3000)).encode()
    for start in (b"", b"one more ", b"and others "):
        raw = start + text
        codec.encode(np.frombuffer(raw, dtype=np.uint8), [0, len(raw)])
    assert len(asked) == len(set(asked)) and len(asked) <= len(set(text.split())) + 5


def test_codec_on_odd_rows(spark, tmp_path, library):
    rows = [*odd_rows(), (400, " ".join(f"word{i}" for i in range(300_000)), None, None, None), (401, "x" * 100_000, None, None, None)]
    table = spark.createDataFrame(rows, DOCS).repartition(3)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted_rows(tuple(r) for r in bpe_codec.op12_bpe(spark, str(tmp_path)).collect()) == sorted_rows(want)
    spec = bpe_codec.default_tokenizer()
    small = clashing(table.where("doc_id < 400 or doc_id is null"), "ids", "decoded")
    there = bpe_codec.decode(bpe_codec.encode(small, spec), spec)
    assert there.columns == [*DOCS.replace(" bigint", "").replace(" string", "").split(", "), "a.b", "made", "row", "ids", "decoded"]
    for r in there.collect():
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids and r["decoded"] == library.decode(r["ids"], skip_special_tokens=False)
    nulls = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in bpe_codec.decode(nulls, spec).collect()] == ["", ""]
    assert bpe_codec.encode(table.limit(0), spec).count() == 0


# 13


def brute_variants(n):
    patterns, near = collections.defaultdict(set), collections.defaultdict(set)
    for w in n:
        for i in range(len(w)):
            patterns[w[:i], w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in n:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for words in patterns.values():
        for w in words:
            near[w] |= words - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 5 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, n[w], len(near[w]), form.get(w), n.get(form.get(w)), root))
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_variants_by_brute_force(spark, partitions):
    """Few letters and short words: runs of equal letters, ties, long chains of forms, groups with a word for each letter."""
    rng = random.Random(partitions)
    n = {"".join(rng.choice("aabéÿ") for _ in range(rng.randint(1, 7))): 5 ** rng.randint(0, 9) for _ in range(900)}
    n |= {f"caf{c}": 2 for c in "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêë"} | {"x" * k: 6**k for k in range(1, 12)} | {"": 3}
    rows = [*n.items(), *[(w, 1) for w in list(n)[:9]], (None, 5)]
    for w in list(n)[:9]:
        n[w] += 1
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = spelling.group_variants(clashing(spark.createDataFrame(rows, "word string, n bigint"), "form", "root"))
        assert sorted_rows(tuple(r) for r in got.collect()) == sorted_rows(brute_variants(n))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert spelling.group_variants(spark.createDataFrame([], "word string, n bigint")).count() == 0


def counted(rows):
    n = collections.Counter()
    for i, t, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def test_spelling_of_odd_rows(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    stems = ["horizon", "Überfluß", "ÀÉcoleé", "garden", "planets"]
    rows = [*odd_rows(), *((500 + i, " ".join(rng.choice(stems) + rng.choice(["", "", "s", "X×"]) for _ in range(rng.randint(0, 80))), "en", "s", 1) for i in range(300))]
    rows += [(900, "letters" * 300_000 + " garden" * 200_000, "en", "s", 1), (901, "garten gartén " * 9, None, None, None)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = [(w, f, root, n, k, fn) for w, n, k, f, fn, root in brute_variants(counted(rows))]
    got = [tuple(r) for r in queries.queries()["op13_spelling"](spark, str(tmp_path)).collect()]
    assert sorted_rows(got) == sorted_rows(want) and any(r[1] for r in got)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet' WHERE doc_id IS NULL OR doc_id <> 900")
    short = [(w, f, root, n, k, fn) for w, n, k, f, fn, root in brute_variants(counted([r for r in rows if r[0] != 900]))]
    assert sorted_rows(db.execute(spelling.op13_sql()).fetchall()) == sorted_rows(short)


def test_slices_cut_no_run(monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 7)
    text = "abcdefghijk lm, nopq" * 5 + "é" * 30
    assert "".join(spelling._slices(text)) == text
    assert [w for s in spelling._slices(text) for w in spelling.RUN.findall(s)] == spelling.RUN.findall(text)


# 3: groups one after another


@pytest.mark.parametrize("at_once", [1, 40, 1 << 20])
def test_links_whatever_is_joined_at_once(spark, monkeypatch, at_once):
    from foliospark.llm import simhash

    monkeypatch.setattr(simhash, "AT_ONCE", at_once)
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(40)}
    prints |= {p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in list(prints) for _ in range(12)}
    signed = [p - (1 << 64) * (p >> 63) for p in prints]
    rows = spark.createDataFrame([(p,) for p in signed], "fingerprint bigint").repartition(3)
    unsigned = lambda x: x & ((1 << 64) - 1)
    got = {frozenset((unsigned(r["a"]), unsigned(r["b"]))) for r in simhash.links(rows).collect()}
    assert got == {frozenset((p, q)) for p in prints for q in prints if p < q and (p ^ q).bit_count() <= 2}
