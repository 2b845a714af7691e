"""SentencePiece encoding and decoding, batched in numpy.

Encoding is a Viterbi search over the pieces of a model. Texts are cut into
runs wherever no piece has both neighbours, and a worker remembers the runs it
met. New ones advance together: the hashes of the substrings that begin at each
place probe the sorted hashes of the pieces, for as long as some piece begins
so; then, a column at a time, the best piece that ends at each place is stored
as its back-pointer.

For a unigram model a path scores the sum of its pieces' scores. For a BPE
model a step from piece p to piece q is allowed only where merging the text of
p and q alone gives back p and q. A segmentation whose neighbours all pass is
the one that merging would give for the whole word (the first merge across a
border would also happen in the two pieces alone), so exactly one path is left
and the search returns what the merge procedure returns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import binary_parts, give_back, list_array, name, ranges, table, with_fields

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NEVER = float("inf")
#: Characters of text encoded at once and searched at once, and how many runs (of so many characters on average) and pairs of pieces a worker remembers.
BATCH, SEARCHED, REMEMBERED, WIDTH, PAIRS = 1 << 19, 1 << 17, 300_000, 16, 1_000_000
#: Leading bits of a hash that number a slot.
SLOTS = 20
_BASE, _MIX, _SALT = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOTS)).astype(np.int64)


def _mixed(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.uint64) * np.uint64(_MIX) ^ np.uint64(_SALT)


def _pair_slot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A slot for each pair of characters."""
    return (left * np.uint32(0x9E3779B1) ^ right * np.uint32(0x85EBCA77)) >> np.uint32(32 - SLOTS)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of pieces of an array, laid end to end."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _room(values: np.ndarray, n: int) -> np.ndarray:
    """values, or a longer copy if it has fewer than n places."""
    return values if n <= len(values) else np.concatenate((values, np.zeros(max(n - len(values), len(values) // 2), dtype=values.dtype)))


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The top-level fields of a protocol-buffers message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(message):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = message[at : at + size], at + size
        yield tag >> 3, value


class Model:
    """The pieces of a SentencePiece model (its bytes), searchable by hash.

    Models that normalise text otherwise than by marking spaces, or that have
    user-defined pieces, are refused: their texts would need that step first.
    So are models with pieces of characters that are no pieces themselves.
    """

    def __init__(self, data: bytes) -> None:
        lib = sentencepiece.SentencePieceProcessor(model_proto=data)
        parts = dict(_fields(data))  # trainer 2, normaliser 3
        trainer, normaliser = dict(_fields(parts.get(2, b""))), dict(_fields(parts.get(3, b"")))
        self.kind = int(trainer.get(3, UNIGRAM))
        if self.kind not in (UNIGRAM, BPE) or normaliser.get(2) or normaliser.get(4, 1):
            raise ValueError("only unigram and BPE models without text normalisation are supported")
        self.prefix = bool(normaliser.get(3, 1))
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.scores = np.array([lib.get_score(i) for i in range(n)])
        self.unknown = lib.unk_id()
        plain = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.by_text = {self.pieces[i]: i for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.by_text):
            raise ValueError("pieces that cross words are not supported")
        if any(c not in self.by_text for p in self.by_text for c in p):
            raise ValueError("characters that stand in pieces but are none are not supported")
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(lib.is_byte(i) for i in range(n)) else None
        self.longest = max(map(len, self.by_text))
        keys = np.array([self._hash(p) for p in self.by_text], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.fromiter(self.by_text.values(), dtype=np.int64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.rank = {p: -float(self.scores[i]) for p, i in self.by_text.items()}
        self.lengths = np.array([len(p) for p in self.pieces])
        self.piece_bytes = [b"" if lib.is_control(i) else p.encode() for i, p in enumerate(self.pieces)]
        for b, i in enumerate(self.bytes or ()):
            self.piece_bytes[i] = bytes([b])
        self.piece_bytes[self.unknown] = b" \xe2\x81\x87 "
        shown = [b.replace(SPACE.encode(), b" ") for b in self.piece_bytes]
        self.shown, self.shown_sizes = np.frombuffer(b"".join(shown), dtype=np.uint8), np.array([len(b) for b in shown])
        self.shown_starts = np.cumsum(self.shown_sizes) - self.shown_sizes
        self.partial = np.array([len(b) == 1 and b[0] > 127 for b in self.piece_bytes])
        # by the first bits of a hash: 1 if a piece may have it, 2 if the beginning of a longer one may; and the first piece
        self.sieve = np.zeros(1 << SLOTS, dtype=np.uint8)
        self.sieve[_slot(self.keys)] = 1
        begun = np.array([self._hash(b) for b in {p[:k] for p in self.by_text for k in range(1, len(p))}], dtype=np.uint64)
        self.sieve[_slot(begun)] |= 2
        self.bucket = np.searchsorted(_slot(self.keys), np.arange(1 << SLOTS)).astype(np.int32)
        self.deepest = int(np.bincount(_slot(self.keys)).max())
        self.keys, self.ids = np.append(self.keys, np.uint64(2**64 - 1)), np.append(self.ids, -1)
        self.single = np.full(0x110000, -1, dtype=np.int32)  # the piece of each character
        for p, i in self.by_text.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        joints = np.array([(ord(a), ord(b)) for p in self.by_text for a, b in zip(p, p[1:])], dtype=np.uint32).reshape(-1, 2)
        self.joint = np.zeros(1 << SLOTS, dtype=bool)
        self.joint[_pair_slot(joints[:, 0], joints[:, 1])] = True
        self.pair_keys, self.pair_fits = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        self.fresh: dict[int, bool] = {}
        self.pairs = np.full(1 << SLOTS, -1, dtype=np.int64)
        self.powers = np.ones(1, dtype=np.uint64)
        self.forget()

    def forget(self) -> None:
        """Let go of the runs seen."""
        self.n, self.n_chars, self.n_flat = 0, 0, 0
        self.seats = np.full(1 << SLOTS, -1, dtype=np.int32)
        # of each run: its hash, where its characters and its pieces begin, how many it has, and whether it was met again
        self.hashes, self.again = np.zeros(1 << 12, dtype=np.uint64), np.zeros(1 << 12, dtype=bool)
        self.places, self.widths, self.starts, self.sizes = (np.zeros(1 << 12, dtype=np.int32) for _ in range(4))
        self.chars, self.flat = np.zeros(1 << 15, dtype=np.uint32), np.zeros(1 << 14, dtype=np.int32)

    @staticmethod
    def _hash(text: str) -> int:
        value = 0
        for c in text:
            value = (value * _BASE + (ord(c) * _MIX ^ _SALT)) & (2**64 - 1)
        return value

    def merged(self, text: str) -> list[str]:
        """The merge procedure on a short text: best score first, leftmost among equals."""
        parts, rank = list(text), self.rank
        found = [rank.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while found:
            best = min(found)
            if best == NEVER:
                break
            i = found.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del found[i]
            if i < len(found):
                found[i] = rank.get(parts[i] + parts[i + 1], NEVER)
            if i:
                found[i - 1] = rank.get(parts[i - 1] + parts[i], NEVER)
        return parts

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of pieces stays as it is when merged alone (left -1: the right one); settled pairs are remembered."""
        key = (left.astype(np.int64) + 1) * len(self.pieces) + right
        slot = _slot(key.astype(np.uint64) * np.uint64(_BASE))
        known = self.pairs[slot]
        out = (known & 1).astype(bool)
        new = np.flatnonzero(known >> 1 != key)
        if len(new):
            keys, back = np.unique(key[new], return_inverse=True)
            fits = self._settle(keys)
            out[new] = fits[back]
            self.pairs[slot[new]] = key[new] * 2 + fits[back]
        return out

    def _settle(self, key: np.ndarray) -> np.ndarray:
        """_fit for distinct pairs that their slots don't hold."""
        spot = np.searchsorted(self.pair_keys, key)
        spot[spot == len(self.pair_keys)] = 0
        known = self.pair_keys[spot] == key if len(self.pair_keys) else np.zeros(len(key), dtype=bool)
        out = np.zeros(len(key), dtype=bool)
        out[known] = self.pair_fits[spot[known]]
        if not known.all():
            verdicts = []
            for k in key[~known].tolist():
                if (verdict := self.fresh.get(k)) is None:
                    p, q = self.pieces[k // len(self.pieces) - 1] if k >= len(self.pieces) else "", self.pieces[k % len(self.pieces)]
                    verdict = self.fresh[k] = self.merged(p + q) == [x for x in (p, q) if x]
                verdicts.append(verdict)
            out[~known] = verdicts
            if len(self.fresh) > max(4096, len(self.pair_keys) // 4):
                if len(self.pair_keys) > PAIRS:
                    self.pair_keys, self.pair_fits = self.pair_keys[:0], self.pair_fits[:0]
                keys = np.concatenate((self.pair_keys, np.fromiter(self.fresh, dtype=np.int64)))
                fits = np.concatenate((self.pair_fits, np.fromiter(self.fresh.values(), dtype=bool)))
                order = np.argsort(keys)
                self.pair_keys, self.pair_fits = keys[order], fits[order]
                self.fresh.clear()
        return out

    def _candidates(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places where a piece of two or more characters begins, the piece and its size, shorter ones first.

        left: how many characters each place has to the end of its run.
        """
        mixed = _mixed(codes)
        at, key = np.arange(len(codes), dtype=np.int32), mixed
        found = [(at[:0], at[:0], at[:0])]
        for size in range(1, self.longest + 1):
            sieve = self.sieve[_slot(key)]
            if size > 1:
                seat = np.flatnonzero(sieve & 1)
                probe = key[seat]
                spot = self.bucket[_slot(probe)]
                for _ in range(self.deepest - 1):
                    spot += self.keys[spot] < probe
                hit = np.flatnonzero(self.keys[spot] == probe)
                found.append((at[seat[hit]], self.ids[spot[hit]].astype(np.int32), np.full(len(hit), size, dtype=np.int32)))
            on = np.flatnonzero((sieve & 2) & ((left[at] > size) * np.uint8(2)))
            at = at[on]
            key = key[on] * np.uint64(_BASE) + mixed[at + size]
        start, piece, size = map(np.concatenate, zip(*found, strict=True))
        return start, piece, size

    def _viterbi(self, codes: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of runs of the model's characters, given end to end as they are returned, and how many each has."""
        starts = np.cumsum(widths) - widths
        inside = np.arange(len(codes)) - np.repeat(starts, widths)
        start, piece, size = self._candidates(codes, np.repeat(widths, widths) - inside)
        end = start + size - 1
        column = inside[end]
        order = np.argsort(column.astype(np.int16) if len(column) and column.max() < 1 << 15 else column, kind="stable")
        start, piece, end, column = start[order], piece[order], end[order], column[order]
        first = inside[start] == 0
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(column)) + 1, [len(column)])).tolist()
        last = self.single[codes]  # until a longer piece is better
        if self.kind == BPE:
            # one path is left to each place: where no longer piece passes, the lone character's does
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                fits = self._fit(np.where(first[a:b], -1, last[start[a:b] - 1]), piece[a:b])
                last[end[a:b][fits]] = piece[a:b][fits]
        else:
            self._best_sums(inside, last, start, piece, end, column)
        used, at, begin = np.zeros(len(codes), dtype=bool), starts + widths - 1, starts
        while len(at):
            used[at] = True
            at = at - self.lengths[last[at]]
            on = np.flatnonzero(at >= begin)
            at, begin = at[on], begin[on]
        return last[used], np.add.reduceat(used, starts, dtype=np.int64) if len(starts) else starts

    def _best_sums(self, inside: np.ndarray, last: np.ndarray, start: np.ndarray, piece: np.ndarray, end: np.ndarray, column: np.ndarray) -> None:
        """For a unigram model, put the last piece of the best path to each place into last; of equal ones, the shortest."""
        best, rows = np.zeros(len(last)), np.argsort(inside, kind="stable")
        columns = np.arange(int(inside.max(initial=-1)) + 2)
        cuts, edges = np.searchsorted(inside[rows], columns).tolist(), np.searchsorted(column, columns).tolist()
        for j, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            at = rows[a:b]
            best[at] = self.scores[last[at]] + (best[at - 1] if j else 0)
            s, p, e = (v[edges[j] : edges[j + 1]][::-1] for v in (start, piece, end))
            score = self.scores[p] + np.where(inside[s] == 0, 0, best[s - 1])
            better = score > best[e]
            np.maximum.at(best, e, score)
            better &= score == best[e]
            last[e[better]] = p[better]

    def _fallback(self, character: str) -> list[int]:
        return [self.bytes[b] for b in character.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def _learn(self, codes: np.ndarray, starts: np.ndarray, widths: np.ndarray, hashes: np.ndarray) -> int:
        """Work out runs of codes and remember them, one after another; the seat of the first."""
        first = self.n
        for a, b in ranges(widths, SEARCHED):
            width = widths[a:b]
            chars = codes[_spread(starts[a:b], width)]
            lone = self.single[codes[starts[a:b]]] < 0  # these are runs of their own
            made, counts = self._viterbi(chars[~np.repeat(lone, width)], width[~lone])
            others = [self._fallback(chr(c)) for c in codes[starts[a:b][lone]].tolist()]
            sizes = np.zeros(b - a, dtype=np.int64)
            sizes[~lone], sizes[lone] = counts, list(map(len, others))
            which = np.repeat(lone, sizes)
            ids = np.zeros(len(which), dtype=np.int32)
            ids[~which], ids[which] = made, [i for o in others for i in o]
            self._keep(chars, width, ids, sizes, hashes[a:b])
        return first

    def _keep(self, chars: np.ndarray, widths: np.ndarray, ids: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> None:
        """Remember runs, their characters and pieces given end to end."""
        k, n = self.n, self.n + len(widths)
        self.hashes, self.again, self.places, self.widths, self.starts, self.sizes = (_room(v, n) for v in (self.hashes, self.again, self.places, self.widths, self.starts, self.sizes))
        self.chars, self.flat = _room(self.chars, self.n_chars + len(chars)), _room(self.flat, self.n_flat + len(ids))
        self.hashes[k:n], self.again[k:n], self.widths[k:n], self.sizes[k:n] = hashes, False, widths, sizes
        self.places[k:n], self.starts[k:n] = self.n_chars + np.cumsum(widths) - widths, self.n_flat + np.cumsum(sizes) - sizes
        self.chars[self.n_chars : self.n_chars + len(chars)], self.flat[self.n_flat : self.n_flat + len(ids)] = chars, ids
        self.seats[_slot(hashes)] = np.arange(k, n)
        self.n, self.n_chars, self.n_flat = n, self.n_chars + len(chars), self.n_flat + len(ids)

    def _shrink(self) -> None:
        """Keep the runs that were met again, the newest half of what may be remembered at most."""
        at = np.flatnonzero(self.again[: self.n])[-(REMEMBERED // 2) :]
        at = at[np.cumsum(self.widths[at][::-1], dtype=np.int64)[::-1] <= REMEMBERED * WIDTH // 2]
        widths, sizes, hashes = self.widths[at].astype(np.int64), self.sizes[at].astype(np.int64), self.hashes[at]
        chars, ids = self.chars[_spread(self.places[at], widths)], self.flat[_spread(self.starts[at], sizes)]
        self.forget()
        self._keep(chars, widths, ids, sizes, hashes)

    def _hashes(self, codes: np.ndarray, starts: np.ndarray, widths: np.ndarray) -> np.ndarray:
        while len(self.powers) < widths.max():
            self.powers = np.concatenate((self.powers, self.powers * np.uint64(int(self.powers[-1]) * _BASE & (2**64 - 1))))
        terms = _mixed(codes) * self.powers[np.arange(len(codes)) - np.repeat(starts, widths)]
        sums = np.add.reduceat(terms, starts)
        return (sums ^ sums >> np.uint64(32)) * np.uint64(_BASE)

    def _seats(self, codes: np.ndarray, starts: np.ndarray, widths: np.ndarray) -> np.ndarray:
        """Where the runs of codes, which are end to end, are remembered; new ones are learned."""
        if self.n > REMEMBERED or self.n_chars > REMEMBERED * WIDTH:
            self._shrink()
        hashes = self._hashes(codes, starts, widths)
        seat = self.seats[_slot(hashes)].astype(np.int64)
        hit = (seat >= 0) & (self.hashes[seat] == hashes)
        self.again[seat[hit]] = True
        new = np.flatnonzero(~hit)
        _, one, back = np.unique(hashes[new], return_index=True, return_inverse=True)
        one = new[one]
        seat[new] = self._learn(codes, starts[one], widths[one], hashes[one]) + back
        # other runs may have the same hash
        place = np.repeat(self.places[seat] - starts, widths) + np.arange(len(codes))
        same = self.chars[np.minimum(place, len(self.chars) - 1)] == codes
        wide = self.widths[seat] == widths
        if not (same.all() and wide.all()):
            wrong = np.flatnonzero(~(np.logical_and.reduceat(same, starts) & wide))
            seat[wrong] = self._learn(codes, starts[wrong], widths[wrong], hashes[wrong]) + np.arange(len(wrong))
        return seat

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts end to end, and how many each text has."""
        marked = [SPACE + t if t and self.prefix else t for t in texts]
        codes = np.frombuffer("".join(marked).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        limits = np.concatenate(([0], np.cumsum(np.fromiter(map(len, marked), dtype=np.int64, count=len(marked)))))
        if not len(codes):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        # cut where no piece has both neighbours; characters without a piece stand alone
        cut, lone = np.zeros(len(codes) + 1, dtype=bool), self.single[codes] < 0
        cut[1:-1] = ~self.joint[_pair_slot(codes[:-1], codes[1:])] | lone[:-1] | lone[1:]
        cut[limits] = True
        starts = np.flatnonzero(cut)
        seat = self._seats(codes, starts[:-1], np.diff(starts))
        sizes = self.sizes[seat]
        ids = self.flat[_spread(self.starts[seat], sizes)]
        return ids, np.diff(np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(starts, limits)])

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of piece ids that are end to end; counts: how many each has."""
        limits = np.concatenate(([0], np.cumsum(counts)))
        sizes = self.shown_sizes[ids]
        raw = self.shown[_spread(self.shown_starts[ids], sizes)]
        ends = np.concatenate(([0], np.cumsum(sizes)))[limits]
        begun = ends[:-1][ends[1:] > ends[:-1]]
        cut = begun[raw[begun] == 32] if self.prefix else begun[:0]
        raw, ends = np.delete(raw, cut), ends - np.searchsorted(cut, ends)
        # bytes that only several pieces make a character of go by decode
        odd = np.unique(np.searchsorted(limits, np.flatnonzero(self.partial[ids]), side="right") - 1)
        texts = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)])
        if len(odd):
            mask = np.zeros(len(counts), dtype=bool)
            mask[odd] = True
            texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([self.decode(ids[limits[i] : limits[i + 1]].tolist()).encode() for i in odd.tolist()], pa.large_binary()))
        return texts.cast(pa.binary()).cast(pa.string())

    def decode(self, ids: Sequence[int]) -> str:
        """The text of piece ids: byte pieces become bytes again, broken ones U+FFFD."""
        raw = b"".join(map(self.piece_bytes.__getitem__, ids))
        text = raw.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def model_of(data: bytes) -> Model:
    """One model for each worker process, however many tasks it runs."""
    return Model(data)


def _transcoded(docs: DataFrame, model: bytes, text: str, fields: tuple[str, ...]) -> DataFrame:
    kind = {"pieces": "array<int>", "decoded": "string"}

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = model_of(model)
        for batch in batches:
            data, limits = binary_parts(batch)
            for r0, r1 in ranges(np.diff(limits), BATCH):  # a part at a time: a batch's ids would take more room than its text
                yield part(codec, data[limits[r0] : limits[r1]].tobytes(), (limits[r0 : r1 + 1] - limits[r0]).tolist())
        give_back()

    def part(codec: Model, whole: bytes, at: list[int]) -> pa.Array:
        ids, counts = codec.encode([whole[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)])
        made = [list_array(pa.array(ids, pa.int32()), counts)]
        if "decoded" in fields:
            made.append(codec.decode_all(ids, counts))
        return pa.StructArray.from_arrays(made, names=list(fields))

    return with_fields(docs, F.arrow_udf(of, "struct<" + ",".join(f"{f}:{kind[f]}" for f in fields) + ">")(name(text).cast("binary")), fields)


def encode(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """docs plus pieces array<int>: the SentencePiece ids of the whole text (null and empty: no ids).

    model: the bytes of a model file, half a megabyte or so; they go with the tasks.
    A column named pieces gives way. Rows are independent: nothing is shuffled.
    """
    return _transcoded(docs, model, text, ("pieces",))


def encode_and_decode(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """docs plus pieces and decoded, the text of those ids: as encode and then decode, in one pass of one worker."""
    return _transcoded(docs, model, text, ("pieces", "decoded"))


def decode(docs: DataFrame, model: bytes, pieces: str = "pieces") -> DataFrame:
    """docs plus decoded string: the text of the ids (null and empty lists: an empty text)."""

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = model_of(model)
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                yield pa.StructArray.from_arrays([pa.array([codec.decode(ids.values.to_numpy().tolist()) if ids.is_valid else "" for ids in part], pa.string())], names=["decoded"])

    return with_fields(docs, F.arrow_udf(of, "struct<decoded:string>")(name(pieces)), ["decoded"])


def digest(column: str = "pieces") -> F.Column:
    """SHA-256 of the ids in decimal, joined by commas."""
    return F.sha2(F.array_join(F.transform(name(column), lambda x: x.cast("string")), ","), 256)


def default_model() -> bytes:
    """The public 32k BPE model, read where the driver runs."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model: bytes | None = None) -> DataFrame:
    """doc_id, n_pieces, pieces_sha256, and whether decoding gives the text back.

    Null texts are empty ones, without pieces; repeated rows stay; an empty
    table gives none.
    """
    model = model or default_model()
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = encode_and_decode(docs, model)
    return out.select("doc_id", F.size("pieces").cast("bigint").alias("n_pieces"), digest().alias("pieces_sha256"), (F.col("decoded") == F.replace("text", F.lit(SPACE), F.lit(" "))).alias("round_trip"))
