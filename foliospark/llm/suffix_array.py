"""Suffix arrays by induced sorting, in numpy, and their permuted common prefixes.

All steps work on whole arrays. Induction walks the buckets in order; inside
one bucket it goes in waves, a wave being the entries that the wave before put
into the same bucket, so runs of one symbol cost a wave each symbol. The text
of the leftmost-smaller substrings' names has many symbols and small buckets;
there the walk takes as many buckets at a step as put nothing into each other.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def classify(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one. The last symbol must be the only smallest."""
    n = len(t)
    step = np.zeros(n, dtype=np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1].astype(np.int64))
    step[-1] = 1
    following = np.where(step != 0, np.arange(n, dtype=np.int64), n - 1)
    following = np.minimum.accumulate(following[::-1])[::-1]
    return step[following] > 0


def leftmost_smaller(small: np.ndarray) -> np.ndarray:
    """Positions of suffixes that are smaller than their right neighbour while the left neighbour is not."""
    return np.flatnonzero(small[1:] & ~small[:-1]) + 1


def _induce(t: np.ndarray, placed: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The suffix array induced from its leftmost-smaller suffixes in the order given."""
    n, k = len(t), len(starts) - 1
    sa = np.full(n, -1, dtype=np.int64)
    # the given suffixes at the ends of their buckets, in order
    symbols = t[placed]
    order = np.argsort(symbols, kind="stable")
    counts = np.bincount(symbols, minlength=k)
    mine, sym = placed[order], symbols[order]
    seeds = starts[1:] - counts
    sa[(seeds - (np.cumsum(counts) - counts))[sym] + np.arange(len(mine))] = mine

    def deal(at: np.ndarray, least: int, most: int, put: np.ndarray, way: int) -> None:
        """Put those left neighbours whose symbol is in [least, most] at the open ends of their buckets."""
        at = at - 1
        if at.min() < 0:
            at = at[at >= 0]
        sym = t[at]
        if least:
            ok = sym >= least
        else:
            ok = sym <= most
        at, sym = at[ok], sym[ok]
        if not len(at):
            return
        order = np.argsort(sym, kind="stable")
        at, sym = at[order], sym[order]
        cut = np.flatnonzero(sym[1:] != sym[:-1]) + 1
        first = np.concatenate(([0], cut))
        size = np.diff(np.concatenate((first, [len(sym)])))
        which = sym[first]
        if way < 0:
            for w, f, z in zip(which.tolist(), first.tolist(), size.tolist(), strict=True):
                end = put[w]
                sa[end - z : end] = at[f : f + z][::-1]
                put[w] = end - z
        else:
            for w, f, z in zip(which.tolist(), first.tolist(), size.tolist(), strict=True):
                end = put[w]
                sa[end : end + z] = at[f : f + z]
                put[w] = end + z

    bounds, seeded = starts.tolist(), seeds.tolist()
    heads = bounds[:-1]
    for c in range(k):
        if bounds[c] == bounds[c + 1]:
            continue
        done = bounds[c]
        while done < heads[c]:
            upto = heads[c]
            deal(sa[done:upto], c, k, heads, 1)  # a larger suffix: its left neighbour is one too if its symbol is no less
            done = upto
        if seeded[c] < bounds[c + 1]:
            deal(sa[seeded[c] : bounds[c + 1]], c + 1, k, heads, 1)
    # smaller suffixes anew, from the larger ones
    tails = bounds[1:]
    for c in range(k - 1, -1, -1):
        if bounds[c] == bounds[c + 1]:
            continue
        done = bounds[c + 1]
        while done > tails[c]:
            upto = tails[c]
            deal(sa[upto:done][::-1], 0, c, tails, -1)
            done = upto
        if c and heads[c] > bounds[c]:
            deal(sa[bounds[c] : heads[c]][::-1], 0, c - 1, tails, -1)
    return sa


def _names(t: np.ndarray, cuts: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """The leftmost-smaller substrings in text order, each as the number of distinct smaller ones, and how many are distinct."""
    m = len(cuts)
    spot = np.zeros(len(t), dtype=np.int32)
    spot[cuts] = np.arange(m, dtype=np.int32)
    at = spot[order]
    length = np.concatenate((np.diff(cuts) + 1, [1]))[at]
    differs = np.ones(m, dtype=bool)
    differs[1:] = length[1:] != length[:-1]
    pairs = np.flatnonzero(~differs)
    j = 0
    while len(pairs):
        pairs = pairs[length[pairs] > j]
        unlike = t[order[pairs] + j] != t[order[pairs - 1] + j]
        differs[pairs[unlike]] = True
        pairs = pairs[~unlike]
        j += 1
    number = np.cumsum(differs) - 1
    names = np.empty(m, dtype=np.int64)
    names[at] = number
    return names, int(number[-1]) + 1


def _induce_many(t: np.ndarray, ends: np.ndarray, placed: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """As _induce, for many symbols and several texts end to end, whose ends (and only smallest symbols) are given.

    Each text has a range of symbols of its own, above the one before, so the
    texts' suffix arrays come out one after the other. All texts are walked
    together, each at its own pace.
    """
    n, k = len(t), len(starts) - 1
    t, starts, placed = t.astype(np.int32), starts.astype(np.int32), placed.astype(np.int32)
    sa = np.full(n, -1, dtype=np.int32)
    symbols = t[placed]
    order = np.argsort(symbols, kind="stable")
    counts = np.bincount(symbols, minlength=k)
    seeds = (starts[1:] - counts).astype(np.int32)
    sa[(seeds - (np.cumsum(counts) - counts))[symbols[order]] + np.arange(len(placed))] = placed[order]
    least, most = t[ends], np.concatenate((t[ends[1:]], [k])).astype(np.int32)
    sa[starts[least]] = ends
    spots = np.arange(n, dtype=np.int32)
    root = np.maximum.accumulate(np.where(np.concatenate(([True], t[1:] != t[:-1])), spots, 0))  # where each run of a symbol starts
    prior = np.concatenate((t[:1], t[:-1]))
    origins = np.concatenate(([0], ends[:-1] + 1))

    def deal(at: np.ndarray, sym: np.ndarray, put: np.ndarray, way: int) -> None:
        order = np.argsort(sym, kind="stable")
        at, sym = at[order], sym[order]
        fresh = np.flatnonzero(np.concatenate(([True], sym[1:] != sym[:-1])))
        size = np.diff(np.concatenate((fresh, [len(sym)])))
        within = np.arange(len(sym)) - np.repeat(fresh, size)
        sa[put[sym] + within if way > 0 else put[sym] - 1 - within] = at
        put[sym[fresh]] += way * size

    def grown(own: np.ndarray, kind: np.ndarray, mine: np.ndarray, put: np.ndarray, way: int) -> tuple[np.ndarray, np.ndarray]:
        """The entries with those that they put into their own buckets, which go in waves: a run of one symbol, from its end."""
        run = np.where(kind == 0, own - root[own], 0)
        total = int(run.sum())
        which = np.repeat(np.arange(len(own)), run)
        wave = np.arange(total) - np.repeat(np.cumsum(run) - run, run) + 1
        order = np.lexsort((which, wave, way * mine[which]))
        new = own[which[order]] - wave[order]
        deal(new, t[new], put, way)
        own, kind, mine = np.concatenate((own, own[which] - wave)), np.concatenate((kind, wave)), np.concatenate((mine, mine[which]))
        order = np.lexsort((np.concatenate((np.arange(len(run)), which)), kind, way * mine))
        return own[order], mine[order]

    def walk(put: np.ndarray, way: int) -> None:
        """Upwards: left neighbours whose symbol is no less than their own suffix's; downwards: no greater."""
        here, stop = (least.copy(), most) if way > 0 else (most.copy(), least)
        prior[origins] = -1 if way > 0 else k  # a text's start has no left neighbour
        reach = np.full(len(ends), 64, dtype=np.int32)
        while True:
            text = np.flatnonzero(here != stop)
            if not len(text):
                return
            far = np.minimum(here[text] + reach[text], stop[text]) if way > 0 else np.maximum(here[text] - reach[text], stop[text])
            lo, hi = (here[text], far) if way > 0 else (far, here[text])
            a, z = starts[lo], starts[hi]
            seat = np.concatenate([spots[i:j] for i, j in zip(a.tolist(), z.tolist(), strict=True)])[::way]
            own = sa[seat]
            full = own >= 0
            seat, own = seat[full], own[full]
            mine, sym = t[own], prior[own]
            # what goes into another bucket of the run ends it there
            edge = far.copy()
            out = sym > mine if way > 0 else sym < mine
            # given suffixes put nothing into their own bucket; nor do larger ones, downwards
            runs = sym == mine
            if runs.any():
                runs &= (seat < seeds[mine]) if way > 0 else (seat >= heads[mine])
            for to, of in ((sym[out], mine[out]), (prior[root[own[runs]]], mine[runs])):
                if len(of):
                    mine_of = np.searchsorted(least[text], of, side="right") - 1
                    if way > 0:
                        inner = (to > of) & (to < hi[mine_of])
                        np.minimum.at(edge, mine_of[inner], to[inner])
                    else:
                        inner = (to < of) & (to >= lo[mine_of])
                        np.maximum.at(edge, mine_of[inner], to[inner] + 1)
            if (edge != far).any():
                mine_of = np.searchsorted(least[text], mine, side="right") - 1
                keep = mine < edge[mine_of] if way > 0 else mine >= edge[mine_of]
                seat, own, mine, sym, out, runs = seat[keep], own[keep], mine[keep], sym[keep], out[keep], runs[keep]
            if runs.any():
                own, mine = grown(own, np.where((seat >= seeds[mine]) if way > 0 else (seat < heads[mine]), n, 0), mine, put, way)
                sym = prior[own]
                out = sym > mine if way > 0 else sym < mine
            if out.any():
                deal(own[out] - 1, sym[out], put, way)
            reach[text] = np.maximum(np.abs(edge - here[text]) * 3 // 2, 8)
            here[text] = edge

    heads = starts[:-1].copy()
    walk(heads, 1)
    # smaller suffixes anew, from the larger ones
    sa[spots >= np.repeat(heads, np.diff(starts))] = -1
    sa[starts[least]] = ends
    walk(starts[1:].copy(), -1)
    return sa


def _sorted_names(t: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix arrays, one after the other, of texts of names as _induce_many takes them.

    A name that occurs once places its suffix, and no comparison goes past it:
    of such names only those after a repeated one stay, to end what is before.
    """
    sizes = np.bincount(t)
    alone = sizes[t] == 1
    gone = alone & np.concatenate(([True], alone[:-1]))
    gone[ends] = False
    kept = np.flatnonzero(~gone)
    if len(kept) < len(t):
        short = t[kept]
        order = kept[_induced((np.cumsum(np.bincount(short) > 0) - 1)[short], np.searchsorted(kept, ends))]
        out, placed = np.empty(len(t), dtype=np.int64), np.zeros(len(t), dtype=bool)
        seats = (np.cumsum(sizes) - sizes)[t[gone]]
        out[seats], placed[seats] = np.flatnonzero(gone), True
        out[~placed] = order
        return out
    return _induced(t, ends)


def _induced(t: np.ndarray, ends: np.ndarray) -> np.ndarray:
    starts = np.concatenate(([0], np.cumsum(np.bincount(t)))).astype(np.int64)
    cuts = leftmost_smaller(classify(t))
    sa = _induce_many(t, ends, cuts, starts)
    if not len(cuts):
        return sa
    marked = np.zeros(len(t), dtype=bool)
    marked[cuts] = True
    order = sa[marked[sa]]
    names, distinct = _names(t, cuts, order)
    if distinct < len(cuts):
        spots = np.searchsorted(cuts, ends)
        spots[spots == len(cuts)] = 0
        order = cuts[_sorted_names(names, spots[cuts[spots] == ends])]
    return _induce_many(t, ends, order, starts)


def suffix_arrays(texts: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Suffix arrays of texts of small unsigned symbols; each text's last symbol must be its only smallest.

    The leftmost-smaller substrings are sorted by induction and named; where
    names repeat, the texts of the names are sorted in the same way, all of
    them together; and each suffix array is induced from that order.
    """
    found: list[tuple] = []
    names, ends, size, past = [], [], 0, 0
    for t in texts:
        starts = np.concatenate(([0], np.cumsum(np.bincount(t)))).astype(np.int64)
        cuts = leftmost_smaller(classify(t))
        sa = _induce(t, cuts, starts) if len(cuts) else np.arange(len(t))
        if len(cuts) > 1:
            marked = np.zeros(len(t), dtype=bool)
            marked[cuts] = True
            own, distinct = _names(t, cuts, sa[marked[sa]])
            names.append(own + past)
            found.append((t, starts, cuts, size))
            size, past = size + len(own), past + distinct
            ends.append(size - 1)
        else:
            found.append((sa,))
    whole = np.concatenate([np.zeros(0, dtype=np.int64), *names])
    order = _sorted_names(whole, np.array(ends)) if past < size else np.argsort(whole)
    out = []
    for f in found:
        if len(f) == 1:
            out.append(f[0])
        else:
            t, starts, cuts, at = f
            out.append(_induce(t, cuts[order[at : at + len(cuts)] - at], starts))
    return out


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each text position, how many symbols its suffix shares with the one before it in sa.

    Where the symbols left of both suffixes agree, the value is the left
    neighbour's less one; only the other, irreducible positions are compared.
    """
    n = len(t)
    phi = np.full(n, -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    own = phi < 1
    own[0] = True
    inner = np.flatnonzero(~own)
    own[inner] = t[inner - 1] != t[phi[inner] - 1]
    roots = np.flatnonzero(own & (phi >= 0))
    value = np.zeros(n, dtype=np.int64)
    live, other, j = roots, phi[roots], 0
    while len(live):
        ok = (live + j < n) & (other + j < n)
        ok[ok] = t[live[ok] + j] == t[other[ok] + j]
        value[live[~ok]] = j
        live, other = live[ok], other[ok]
        j += 1
    root = np.maximum.accumulate(np.where(own, at, 0))
    return np.maximum(value[root] - (at - root), 0)
