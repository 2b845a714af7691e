"""BPE encoding and decoding with content-defined chunks.

A hash of the last WINDOW bytes, rolled over each text, cuts it where the hash
ends in CUT_BITS zeros, so equal passages are cut alike wherever they stand. A
chunk is encoded once and remembered. Where two chunks join, what stands at
the cut is encoded again, in a window that widens, over whole chunks if need
be, until white space is on both sides: no token reaches over white space and
the normaliser changes nothing across it, so from there on the ids agree
exactly with those of the chunks.

Chunks, and the runs between white space that they consist of, are remembered
by a worker for all its tasks, up to a bound. A table of the corpus's chunks
would shuffle the texts and their ids, about twice the input; nothing is
shuffled here.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliospark.llm.common import binary_parts, give_back, list_array, name, ranges, table, with_fields

WINDOW, CUT_BITS, FACTOR = 8, 9, 0x9E3779B97F4A7C15
#: Bytes of text, and new chunks, worked on at a time.
BATCH, PART = 1 << 20, 2048
#: Chunks and runs that a worker remembers, twice each at most, and bytes of the longest of them.
CHUNKS, RUNS, LONGEST = 40_000, 300_000, 4096
#: Characters that the usual steps before a model leave as they are, but for case: printable ASCII and Latin letters.
SIMPLE_LETTERS = [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]
SIMPLE = re.compile("[!-~" + "".join(SIMPLE_LETTERS) + "]*")
KINDS = {"ids": "array<int>", "packed": "binary", "decoded": "string"}


def cut_places(data: np.ndarray) -> np.ndarray:
    """Places of UTF-8 bytes at which chunks begin, by what stands before them alone."""
    if len(data) <= WINDOW:
        return np.zeros(0, dtype=np.int64)
    windows = np.ndarray((len(data) - WINDOW,), dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,))
    at = np.flatnonzero((windows * np.uint64(FACTOR)) >> np.uint64(64 - CUT_BITS) == 0) + WINDOW
    return at[(data[at] & 0xC0) != 0x80]


def parted(chunk: bytes) -> tuple[bytes, list[bytes], bytes] | None:
    """What stands before the first white space, the runs between, what stands after the last; None without white space."""
    runs = chunk.split()
    first, last = chunk[:1].isspace(), chunk[-1:].isspace()
    if len(runs) == 1 and not first and not last:
        return None
    head = runs.pop(0) if runs and not first else b""
    tail = runs.pop() if runs and not last else b""
    return head, runs, tail


class Memory:
    """A mapping in two generations: what a whole generation didn't ask for is forgotten."""

    def __init__(self, most: int) -> None:
        self.most, self.now, self.before = most, {}, {}

    def age(self) -> None:
        if len(self.now) > self.most:
            self.now, self.before = {}, self.now

    def missing(self, keys: set[bytes]) -> set[bytes]:
        """Keys without a value; values of the older generation come to the newer."""
        absent = keys.difference(self.now)
        if self.before:
            again = {k: self.before[k] for k in absent if k in self.before}
            self.now.update(again)
            absent.difference_update(again)
        return absent


def simple_steps(spec: dict) -> tuple[bool, str] | None:
    """Whether letters are lower-cased, and the pattern of pre-tokens, if the tokenizer's steps before the model are the
    usual ones (NFC, white space as a space, lower case; a kept pattern, bytes as characters); else None."""
    steps, parts = ([v] if v and k not in v else (v or {}).get(k, []) for v, k in ((spec.get("normalizer"), "normalizers"), (spec.get("pre_tokenizer"), "pretokenizers")))
    for s in steps:
        if s["type"] not in ("NFC", "Lowercase") and s != {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}:
            return None
    match parts:
        case [{"type": "Split", "pattern": {"Regex": str(pattern)}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]:
            return any(s["type"] == "Lowercase" for s in steps), pattern
    return None


class Codec:
    """One tokenizer with what it has encoded lately. Ids are little-endian unsigned 32-bit integers."""

    def __init__(self, spec: str) -> None:
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.plain = self.tokenizer.decoder is None
        self.model = self.tokenizer.model
        self.added = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        self.steps = simple_steps(json.loads(spec))
        if self.steps:
            self.pattern = regex.compile(self.steps[1])
            self.as_bytes = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in SIMPLE_LETTERS}
        self.chunks, self.runs = Memory(CHUNKS), Memory(RUNS)

    def _run(self, run: bytes) -> bytes:
        """The ids of one run. Where every character stands for itself in NFC and is a byte or a Latin letter, only the model is asked."""
        text = run.decode("utf-8", "replace")
        if self.steps and SIMPLE.fullmatch(text) and not self.added.search(text):
            text = text.lower() if self.steps[0] else text
            parts = self.pattern.findall(text)
            if not text.isascii():
                parts = [p.translate(self.as_bytes) for p in parts]
            ids = [t.id for p in parts for t in self.model.tokenize(p)]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _of(self, runs: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each of the runs, and of no run."""
        distinct = set(runs)
        new = {r: self._run(r) for r in self.runs.missing(distinct)}
        self.runs.now.update(new)
        of = {r: self.runs.now[r] for r in distinct}
        for r in new:
            if len(r) > LONGEST:
                del self.runs.now[r]
        return of

    def encode(self, data: np.ndarray, limits: list[int]) -> list[bytes]:
        """The ids of each of several texts, laid end to end in data."""
        self.chunks.age()
        self.runs.age()
        raw = data.tobytes()
        cuts = np.union1d(cut_places(data), limits).tolist()
        chunks = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        known = dict.fromkeys(chunks)
        fresh = list(self.chunks.missing(set(known)))
        for i in range(0, len(fresh), PART):
            split = {c: parted(c) for c in fresh[i : i + PART]}
            of = self._of([r for s in split.values() if s for r in s[1]])
            for c, s in split.items():
                known[c] = s and (s[0], b"".join(map(of.__getitem__, s[1])), s[2])
                if len(c) <= LONGEST:
                    self.chunks.now[c] = known[c]
        for c in self.chunks.now.keys() & known.keys():
            known[c] = self.chunks.now[c]
        at = np.searchsorted(cuts, limits).tolist()
        lines = [_joined(chunks[a:b], known) for a, b in zip(at[:-1], at[1:], strict=True)]
        of = self._of([r for line in lines for r in line[::2]])
        for line in lines:
            line[::2] = map(of.__getitem__, line[::2])
        return [b"".join(line) for line in lines]

    def decode(self, ids: np.ndarray) -> str:
        if self.plain:
            return " ".join(map(self.tokens.__getitem__, ids.tolist()))
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)


def _joined(chunks: list[bytes], known: dict[bytes, tuple[bytes, bytes, bytes] | None]) -> list[bytes]:
    """Runs over the cuts, to be encoded again, and between them the ids that chunks keep: run, ids, run, ..., run."""
    line: list[bytes] = []
    over: list[bytes] = []
    for c in chunks:
        kept = known[c]
        if kept is None:
            over.append(c)
        else:
            line += b"".join([*over, kept[0]]), kept[1]
            over = [kept[2]]
    line.append(b"".join(over))
    return line


@lru_cache(maxsize=2)
def codec_of(spec: str) -> Codec:
    """One codec for each worker process, however many tasks it runs."""
    return Codec(spec)


def encode(docs: DataFrame, spec: str, text: str = "text", fields: tuple[str, ...] = ("ids",)) -> DataFrame:
    """docs plus the asked fields of the whole text: ids, packed (little-endian, four bytes each) and decoded.

    spec: the JSON of a tokenizers file whose pre-tokenizer drops white space.
    Null and empty texts have no ids, repeated rows stay, columns named like
    the fields give way, an empty table gives none. Nothing is shuffled.
    """

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_of(spec)
        for batch in batches:
            data, limits = binary_parts(batch)
            for r0, r1 in ranges(np.diff(limits), BATCH):  # a part at a time: ids take more room than their text
                yield part(codec, data[limits[r0] : limits[r1]], (limits[r0 : r1 + 1] - limits[r0]).tolist())
        give_back()

    def part(codec: Codec, data: np.ndarray, limits: list[int]) -> pa.Array:
        packed = codec.encode(data, limits)
        made = []
        for f in fields:
            if f == "packed":
                made.append(pa.array(packed, pa.binary()))
            elif f == "ids":
                made.append(list_array(pa.array(np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32)), [len(p) // 4 for p in packed]))
            else:
                made.append(pa.array([codec.decode(np.frombuffer(p, dtype="<u4")) for p in packed], pa.string()))
        return pa.StructArray.from_arrays(made, names=list(fields))

    return with_fields(docs, F.arrow_udf(of, "struct<" + ",".join(f"{f}:{KINDS[f]}" for f in fields) + ">")(name(text).cast("binary")), fields)


def decode(docs: DataFrame, spec: str, ids: str = "ids") -> DataFrame:
    """docs plus decoded string, the text of the ids (null and empty lists: an empty text)."""

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_of(spec)
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                yield pa.StructArray.from_arrays([pa.array([codec.decode(x.values.to_numpy()) if x.is_valid else "" for x in part], pa.string())], names=["decoded"])

    return with_fields(docs, F.arrow_udf(of, "struct<decoded:string>")(name(ids)), ["decoded"])


def default_tokenizer() -> str:
    """The public word BPE of 49k tokens, read where the driver runs."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op12_bpe(spark: SparkSession, sf_dir: str, spec: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text they decode to; odd rows as encode says."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = encode(docs, spec or default_tokenizer(), fields=("packed", "decoded"))
    n = (F.octet_length("packed") / 4).cast("bigint")
    return made.select("doc_id", n.alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
