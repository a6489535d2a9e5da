"""Near-duplicate passages by compact windows.

The tokens of a document are the hashes of its five-word shingles. For a hash function, a compact window (l, c, r)
says that the least value of every sequence that begins in l..c and ends in c..r is that of token c; so a few
windows hold the signatures of all sequences of a document that are long enough. They are the nodes of the Cartesian
tree over the values that span enough tokens: such a node is the least of some run of that length, and so are all
nodes above it, so the tree is built over those few tokens alone. An interval join of the windows of all functions within
each document gives its cells: ranges of sequences of ``SEED`` tokens that share every function's least token, and so one signature.

Passages of 46 tokens or more whose Jaccard similarity is 0.8 differ in one ninth of the tokens at most, and an edit between two
runs costs four tokens at least. So they have a run of ``SEED`` tokens alike, in which every function agrees: documents meet in the
cells' signatures without loss. In each bucket of a signature, members are aligned with one of them and confirmed by Jaccard
similarity. Members whose cell lies in no confirmed passage are aligned with one another likewise, for some rounds. At last the members of
a bucket that are in different components, or in no passage yet, are sifted by the tokens around their cells, in blocks: pairs that are
enough alike are aligned there, which settles most, and come out to be aligned whole. So no component is missed. Exact repeats are, besides, counted by a hash
of their own, whatever the documents' links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import BROADCAST_KEYS, Scratch, having
from tracewell.llm.components import bucket_blocks, contract
from tracewell.llm.shingles import hash_words, mix, powers, runs_of

WIDTH, LEAST_WORDS, SIMILARITY = 5, 50, 0.8
#: Hash functions, all of which must agree in a sequence of ``SEED`` tokens.
HASHES, SEED = 2, 21
#: Tokens that an alignment may miss in a row, and by which it may shift: two edited words next to each other.
GAP = 2 * WIDTH
#: Rows of a block when the last members of a bucket are compared with each other.
BLOCK = 256
#: Rows of an Arrow batch: pairs carry two whole texts each.
BATCH_ROWS = 512
#: Rounds in which the members of a bucket are aligned with one of them.
ROUNDS = 2

#: Passages that two documents share: first word and word after the last, in either.
SHARED = "array<struct<a0:bigint,a1:bigint,b0:bigint,b1:bigint,similarity:double>>"
_SPANS = pa.list_(pa.struct([("a0", pa.int64()), ("a1", pa.int64()), ("b0", pa.int64()), ("b1", pa.int64()), ("similarity", pa.float64())]))

_rng = np.random.default_rng(20_230_618)
_ODD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def values(tokens: np.ndarray, function: int) -> np.ndarray:
    """The values of tokens under a hash function; 0, which stands for no token, stays 0 and is less than any other."""
    x = (tokens ^ _FLIP[function]) * _ODD[function]
    return np.where(tokens == 0, np.uint64(0), x ^ (x >> np.uint64(32)) | np.uint64(1))


def _slide(x: np.ndarray, t: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every run of t values."""
    n, width = len(x) - t + 1, 1
    while 2 * width <= t:
        x = pick(x[:-width], x[width:])
        width *= 2
    return pick(x[:n], x[t - width : t - width + n])


def compact_windows(v: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """l, c and r of the windows of at least t tokens; of equal values the first counts as the least."""
    n = len(v)
    if n < t:
        return (np.empty(0, np.int64),) * 3
    least = _slide(v, t, np.minimum)
    padded = np.concatenate([np.zeros(t - 1, v.dtype), least, np.zeros(t - 1, v.dtype)])
    chosen = np.flatnonzero(_slide(padded, t, np.maximum) == v)
    left, right, stack = [], [n] * len(chosen), []
    held = v[chosen].tolist()
    for i, x in enumerate(held):
        while stack and held[stack[-1]] > x:
            right[stack.pop()] = int(chosen[i])
        left.append(int(chosen[stack[-1]]) if stack else -1)
        stack.append(i)
    left, right = np.array(left) + 1, np.array(right) - 1
    wide = right - left + 1 >= t
    return left[wide], chosen[wide], right[wide]


def cells(tokens: np.ndarray, t: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The interval join of the windows of all functions: signature, first and last start of the sequences of t tokens that have it.

    ``tokens`` may hold several documents, parted by zeros. Every start of a sequence without a zero lies in one cell.
    """
    sides = []
    for i in range(HASHES):
        v = values(tokens, i)
        l, c, r = compact_windows(v, t)
        own = v[c] != 0
        l, c, r = l[own], c[own], r[own]
        first = np.maximum(l, c - t + 1)
        order = np.argsort(first, kind="stable")
        sides.append((first[order], np.minimum(c, r - t + 1)[order], c[order], v[c[order]]))
    first = np.unique(np.concatenate([s[0] for s in sides]))
    keys, last, anchor = np.zeros(len(first), np.uint64), None, None
    for starts, ends, c, v in sides:
        at = np.searchsorted(starts, first, "right") - 1
        keys = mix(keys + v[at])
        last = ends[at] if last is None else np.minimum(last, ends[at])
        if anchor is None:
            anchor = c[at]
        else:
            keys = mix(keys + (c[at] - anchor).astype(np.uint64))
    return keys.view(np.int64), first, last if last is not None else first


def run_starts(places: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last starts of the sequences of t tokens all of whose sequences of ``SEED`` tokens lie in the given cells (start << 8 | further starts)."""
    places = np.unique(places)
    first, last = places >> 8, (places >> 8) + (places & 255)
    reached = np.maximum.accumulate(last) if len(last) else last
    cuts = np.flatnonzero(first[1:] > reached[:-1] + 1) + 1
    begin, end = first[np.concatenate([[0], cuts]).astype(int)] if len(first) else first, reached[np.concatenate([cuts - 1, [len(last) - 1]]).astype(int)] if len(last) else last
    end = end - (t - SEED)
    return begin[end >= begin], end[end >= begin]


def run_hashes(tokens: np.ndarray, first: np.ndarray, last: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts from ``first`` to ``last`` and a hash of the t tokens from each, by sums of a polynomial's terms."""
    n = last - first + 1
    starts = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    up, back = powers(len(tokens) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(tokens * up[:-1])])
    return starts, mix((sums[starts + t] - sums[starts]) * back[starts]).view(np.int64)


def text_tokens(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of a text, and its tokens; a text of too few words for one has none."""
    hashes, begin = hash_words([text])
    return hashes, runs_of(hashes, begin, WIDTH)[: max(0, len(hashes) - WIDTH + 1)]


def node_id(hashes: np.ndarray, seed: int) -> int:
    """A 63-bit id for a sequence of words."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes(), seed) >> 1


def _repeats(order: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """How many of the tokens before each place stood earlier already, from the stable order of all."""
    again = np.zeros(len(order), np.int64)
    again[order[1:]] = ordered[1:] == ordered[:-1]
    return np.concatenate([[0], np.cumsum(again)])


def align(a: np.ndarray, b: np.ndarray, t: int) -> list[tuple[int, int, int, int, float]]:
    """Passages of at least t tokens that two documents share, as first and last token in either, with their Jaccard similarity.

    Tokens of ``a`` that are also in ``b`` are chained along their places in ``b`` with at most ``GAP`` missed or shifted
    in a row; of several places in ``b`` that is taken which continues the chain, or begins the best one. A chain that isn't similar enough is
    parted where it misses most, until its parts are similar or too short. If all are, chains are sought across wider gaps.
    """
    return _align(a, b, t)[0]


def _bridged(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, t: int) -> list[tuple[int, int, int, int, float]]:
    """Passages over the places ``p`` and ``q`` of matched tokens, in one order, however many are missed in a row.

    Matches s to e hold a passage if (1 + 1 / SIMILARITY) times their number reaches the tokens from s to e in both documents, so the
    earliest fit start of each end is found from least values; the longest passage is taken, then those on either side of it.
    """
    weight, out = 1 + 1 / SIMILARITY, []
    cuts = [0, *(np.flatnonzero(np.diff(q) <= 0) + 1).tolist(), len(q)]
    parts = list(zip(cuts, cuts[1:]))
    while parts:
        lo, hi = parts.pop()
        if hi - lo < t // 2:
            continue
        x, y = p[lo:hi], q[lo:hi]
        f = weight * np.arange(hi - lo) - x - y + 1e-9
        before = np.minimum(np.searchsorted(x, x - t + 1, "right"), np.searchsorted(y, y - t + 1, "right"))
        least = np.minimum.accumulate(f)
        ends = np.flatnonzero((before > 0) & (f >= least[np.maximum(before - 1, 0)] - (weight - 2)))
        if not len(ends):
            continue
        starts = np.searchsorted(-least, -(f[ends] + weight - 2))  # the first place from which on the least value is low enough
        best = int(np.argmax(ends - starts))
        s, e = lo + int(starts[best]), lo + int(ends[best])
        one, two = np.unique(a[p[s] : p[e] + 1]), np.unique(b[q[s] : q[e] + 1])
        both = len(np.intersect1d(one, two, assume_unique=True))
        if both >= SIMILARITY * (similar := len(one) + len(two) - both):
            out.append((int(p[s]), int(p[e]), int(q[s]), int(q[e]), both / similar))
        parts += [(lo, s), (e + 1, hi)]
    return out


def _align(a: np.ndarray, b: np.ndarray, t: int) -> tuple[list[tuple[int, int, int, int, float]], bool]:
    """``align``, and whether the other direction would find the same: tokens have one place each, in one order, and miss as much on either side."""
    order = np.argsort(b, kind="stable")
    ordered = b[order]
    lo, hi = np.searchsorted(ordered, a, "left"), np.searchsorted(ordered, a, "right")
    p = np.flatnonzero(hi > lo)
    if len(p) < t // 2:
        return [], False
    q = order[lo[p]]
    several = np.flatnonzero((hi - lo)[p] > 1).tolist()
    at, chosen, held_a, held_b = (x.tolist() if several else [] for x in (p, q, a, b))
    for k in several:
        expected = chosen[k - 1] + at[k] - at[k - 1] if k else -GAP - 1
        if 0 <= expected < len(b) and held_b[expected] == held_a[at[k]]:
            chosen[k] = expected
            continue
        places = order[lo[p[k]] : hi[p[k]]]
        near = np.searchsorted(places, expected)
        best = min(places[max(0, near - 1) : near + 1].tolist(), key=lambda x: abs(x - expected))
        if abs(best - expected) > GAP:  # a chain begins: at the place from which most tokens go on alike
            ahead = np.arange(min(t, len(a) - p[k]))
            alike = b[np.minimum(places[:, None] + ahead, len(b) - 1)] == a[p[k] + ahead]
            best = int(places[int(alike.sum(1).argmax())])
        chosen[k] = best
    q = np.array(chosen) if several else q
    shift = q - p
    missed = np.maximum(np.diff(p) - 1, np.abs(np.diff(shift)))
    breaks = np.flatnonzero(missed > GAP)
    order_a = np.argsort(a, kind="stable")
    again_a, again_b = _repeats(order_a, a[order_a]), _repeats(order, ordered)
    back = np.maximum(np.diff(q) - 1, np.abs(np.diff(shift)))
    close = np.minimum(missed, back) <= GAP
    once = not several and not (again_a[p + 1] > again_a[p]).any()
    alike = once and bool((np.diff(q) > 0).all()) and bool((missed == back)[close].all())
    out, chains = [], list(zip([0, *(breaks + 1).tolist()], [*breaks.tolist(), len(p) - 1]))
    while chains:
        s, e = chains.pop()
        a0, a1 = int(p[s]), int(p[e])
        b0, b1 = max(0, a0 + int(shift[s])), min(len(b) - 1, a1 + int(shift[e]))
        if a1 - a0 + 1 < t or b1 - b0 + 1 < t:
            continue
        both = similar = 0
        # no more distinct tokens are in both than places that are matched, and no fewer in either than places without a repeat
        shared = e - s + 1
        fresh_a, fresh_b = a1 - a0 + 1 - again_a[a1 + 1] + again_a[a0], b1 - b0 + 1 - again_b[b1 + 1] + again_b[b0]
        if once and fresh_a == a1 - a0 + 1 and fresh_b == b1 - b0 + 1:
            both = int(np.count_nonzero((q[s : e + 1] >= b0) & (q[s : e + 1] <= b1)))
            similar = int(fresh_a + fresh_b) - both
        elif shared >= SIMILARITY * max(fresh_a, fresh_b):
            one, two = np.unique(a[a0 : a1 + 1]), np.unique(b[b0 : b1 + 1])
            both = len(np.intersect1d(one, two, assume_unique=True))
            similar = len(one) + len(two) - both
        if similar and both >= SIMILARITY * similar:
            out.append((a0, a1, b0, b1, both / similar))
        elif s < e and missed[cut := s + int(np.argmax(missed[s:e]))] > 0:  # two passages: parted where most is missed
            chains += [(s, cut), (cut + 1, e)]
    return out or _bridged(a, b, p, q, t), alike


def align_both(a: np.ndarray, b: np.ndarray, t: int) -> list[tuple[int, int, int, int, float]]:
    """``align`` in both directions: a token has one place in the other document, so copies within ``b`` come out of the second only."""
    found, alike = _align(a, b, t)
    if alike or any((a0, a1, b0, b1) == (0, len(a) - 1, 0, len(b) - 1) for a0, a1, b0, b1, _ in found):
        return found  # nothing to add
    return list(dict.fromkeys(found + [(a0, a1, b0, b1, similarity) for b0, b1, a0, a1, similarity in align(b, a, t)]))


def _spans(found: list[tuple[int, int, int, int, float]]) -> list[dict]:
    return [{"a0": x[0], "a1": x[1] + WIDTH, "b0": x[2], "b1": x[3] + WIDTH, "similarity": x[4]} for x in found]


def _begin(place: int, t: int) -> int:
    """The first token that a shortest passage which holds the cell at ``place`` may have."""
    return max(0, (place >> 8) - t)


#: What a token that the other document lacks costs, where one that it has counts 1: in either document alone, and in both together.
_PRICE, _BOTH_PRICE = round(SIMILARITY / (1 - SIMILARITY)), round(2 * SIMILARITY / (1 - SIMILARITY))
_NONE = np.int32(-(10**6))


class Sought:
    """The tokens of a document that others are held against, sorted once."""

    def __init__(self, tokens: np.ndarray):
        self.tokens = tokens
        self.distinct, self.rank, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        self.again = counts[self.rank] > 1

    def may_share(self, other: np.ndarray, t: int) -> bool:
        """Whether ``align_both`` may find a passage with ``other``, from the tokens alone that each has of the other's."""
        if not len(self.distinct) or not len(other):
            return False
        at = np.minimum(np.searchsorted(self.distinct, other), len(self.distinct) - 1)
        there = self.distinct[at] == other
        here = np.zeros(len(self.distinct), bool)
        here[at[there]] = True
        if not _may_hold(here[self.rank], self.again, t):
            return False
        _, rank, counts = np.unique(other, return_inverse=True, return_counts=True)
        return _may_hold(there, counts[rank] > 1, t)


def _may_hold(alike: np.ndarray, again: np.ndarray, t: int) -> bool:
    """Whether some run of t tokens or more, of which ``alike`` are also in another document, may be a passage.

    It begins and ends with such a token, and of its distinct tokens ``SIMILARITY`` are such ones. Tokens that stand ``again`` in
    the document count at their best, so no passage is missed.
    """
    p = np.flatnonzero(alike)
    if not len(p) or p[-1] - p[0] + 1 < t:
        return False
    lost = np.cumsum(~(alike | again))[p]
    before = np.arange(len(p)) - _PRICE * lost
    starts = np.searchsorted(p, p - t + 1, "right")
    least = np.minimum.accumulate(before)
    return bool(((starts > 0) & (before + 1 >= least[np.maximum(starts - 1, 0)])).any())


def _best(alike: np.ndarray, lost: np.ndarray, cells: np.ndarray, t: int) -> np.ndarray:
    """For each row the most that a run of t tokens or more which holds its cell, and begins and ends alike, counts: 1 for a token ``alike``, else ``lost``."""
    n, size = alike.shape
    if size < t:
        return np.full(n, _NONE)
    sums = np.zeros((n, size + 1), np.int32)
    np.cumsum(np.where(alike, np.int32(1), lost), axis=1, out=sums[:, 1:])
    place, cells = np.arange(size), cells[:, None]
    ends = np.where(alike & (place >= cells), sums[:, 1:], _NONE)
    ends = np.maximum.accumulate(ends[:, ::-1], axis=1)[:, ::-1]  # of all from a place on
    m = size - t + 1
    return np.where(alike[:, :m] & (place[:m] <= cells), ends[:, t - 1 :] - sums[:, :m], _NONE).max(1)


def _sift(t: int):
    """Pairs of a block that are to be aligned whole, with the passages that the tokens around their cells hold.

    A bare member is aligned, in its surroundings, with others that are alike until a passage holds its cell; that pair comes out.
    Pairs of different components that are alike enough for a passage are aligned likewise. Where that finds one the two are one
    component from then on; they come out in any case, since whole texts may hold a longer one.
    """
    enough = int(np.ceil(t * SIMILARITY))  # tokens of t that the other has, or that repeat

    def compare(rows):
        rows.sort(key=lambda row: row[1])  # by id, so that the buckets of one passage make the same pairs
        own, ids, comps, bare, place, around = zip(*rows)
        each = [np.frombuffer(x, np.uint64) for x in around]
        n, lengths = len(each), np.array([len(x) for x in each])
        own, ids, comps, bare = np.array(own), np.array(ids), np.array(comps), np.array(bare)
        begin = [_begin(x, t) for x in place]
        cell = np.array([(x >> 8) - b for x, b in zip(place, begin)])
        across = own.min() != own.max()  # pairs within a block meet in that block alone
        # tokens by number, those that one member alone has by the last one
        distinct, number = np.unique(np.concatenate(each), return_inverse=True)
        owner = np.repeat(np.arange(n), lengths)
        held_by, of, times = np.unique(owner * len(distinct) + number, return_inverse=True, return_counts=True)
        common = np.bincount(held_by % len(distinct), minlength=len(distinct)) > 1
        number = np.where(common, np.cumsum(common) - 1, common.sum())[number]
        column = np.arange(len(number)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        sequence = np.full((n, lengths.max()), common.sum(), np.int32)
        sequence[owner, column] = number
        again = np.zeros(sequence.shape, bool)
        again[owner, column] = times[of] > 1
        has = np.zeros((n, common.sum() + 1), bool)
        has[owner, number] = True
        has[:, -1] = False
        lost, lost_both = (np.where(again, np.int32(0), np.int32(-x)) for x in (_PRICE, _BOTH_PRICE))
        out = []

        def holding(i, near):
            """Those of ``near`` with which a passage may hold the cells of both, by the tokens that each has of the other's."""
            theirs = has[i][sequence[near]]
            some = np.count_nonzero(theirs | again[near], axis=1) >= enough
            some[some] = _best(theirs[some], lost[near[some]], cell[near[some]], t) >= 0
            near, theirs = near[some], theirs[some]
            if not len(near):
                return near
            mine = has[near[:, None], sequence[i, : lengths[i]]]

            def best(lost):
                return _best(mine, np.broadcast_to(lost[i, : lengths[i]], mine.shape), np.full(len(near), cell[i]), t)

            return near[(best(lost) >= 0) & (best(lost_both) + _best(theirs, lost_both[near], cell[near], t) >= 0)]

        def held(found, i, j):
            """Settle what the passages of two members hold."""
            for member, first, last in ((i, 0, 1), (j, 2, 3)):
                bare[member] &= not any(x[first] <= cell[member] < x[last] + WIDTH for x in found)
            if found:
                comps[comps == comps[j]] = comps[i]

        def pair(found, i, j):
            moved = [(x[0] + begin[i], x[1] + begin[i], x[2] + begin[j], x[3] + begin[j], x[4]) for x in found]
            if ids[j] < ids[i]:
                i, j, moved = j, i, [(x[2], x[3], x[0], x[1], x[4]) for x in moved]
            out.append((int(ids[i]), int(ids[j]), _spans(moved)))

        for i in range(n):
            other = ids != ids[i]
            if across:
                other &= own != own[i]
            apart = other & (comps != comps[i]) & (np.arange(n) > i)
            sought = np.flatnonzero(other if bare[i] else apart)
            if not len(sought):
                continue
            likely = holding(i, sought).tolist()
            tried = {}
            for j in likely:
                if apart[j] and comps[i] != comps[j]:
                    tried[j] = align(each[i], each[j], t)
                    held(tried[j], i, j)
                    pair(tried[j], i, j)
            if bare[i]:
                for j in likely:
                    found = tried[j] if j in tried else align(each[i], each[j], t)
                    held(found, i, j)
                    if not bare[i]:
                        pair(found, i, j)
                        break
        if out:
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], _SPANS)], ["a", "b", "shared"])

    def run(batches):
        held, last = [], None
        for batch in batches:
            for block, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if block != last and len(held) > 1:
                    yield from compare(held)
                if block != last:
                    held, last = [], block
                held.append(row)
        if len(held) > 1:
            yield from compare(held)

    return run


def _distinct_buckets(rows: DataFrame) -> DataFrame:
    """Buckets of two ids or more; of those with the same ids one."""
    marks = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("id")).alias("one"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("two"))
    chosen = marks.where("k > 1").groupBy("k", "one", "two").agg(F.min("bucket").alias("bucket")).select("bucket")
    return rows.join(chosen, "bucket", "left_semi")


def repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """A row for each document that shares a passage of ``least_words`` words or more with another one.

    Columns: doc_id; class_id, the least doc_id reachable over shared passages; n_links, the documents it was confirmed to
    share with, exact copies included; n_words; repeated_words, how many of its words lie in such passages; spans, those passages as
    first word and word after the last, merged where they touch. Words are runs of anything but ASCII white space, A-Z lower-cased.

    Documents of equal word sequences are one node; their rows repeat its spans, and the whole document is one of
    them. Exact repeats are all in spans; of edited ones, every document that has one is linked, but not with every other one.
    Null doc_ids, null texts and texts of fewer words take no part; repeated rows count once.
    """
    t = least_words - WIDTH + 1
    if t < SEED:
        raise ValueError(f"passages have at least {SEED + WIDTH - 1} words")
    spark = docs.sparkSession
    scratch = Scratch(spark, "passages", BATCH_ROWS)
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")

    def digest(seed):
        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    hashes, begin = hash_words(part.column(1).to_pylist())
                    words = np.diff(begin)
                    tokens = runs_of(hashes, begin, WIDTH)
                    tokens[np.repeat(words < least_words, words)] = 0
                    keys, first, last = cells(tokens)
                    owner = np.searchsorted(begin, first, "right") - 1
                    offsets = pa.array(np.searchsorted(owner, np.arange(len(words) + 1)), pa.int32())
                    places = first - begin[owner] << 8 | last - first
                    each = [hashes[a:b] if b - a >= least_words else None for a, b in zip(begin.tolist(), begin[1:].tolist())]
                    rows = pa.RecordBatch.from_arrays([
                        part.column(0), pa.array([None if x is None else node_id(x, seed) for x in each], pa.int64()), pa.array([None if x is None else xxhash.xxh3_128_digest(x.tobytes()) for x in each], pa.binary()),
                        pa.array(words, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(keys)), pa.ListArray.from_arrays(offsets, pa.array(places)),
                    ], ["doc_id", "id", "key", "n_words", "keys", "places"])
                    yield rows.filter(pa.array([x is not None for x in each], pa.bool_()))

        return run

    seed = 0
    while True:
        seeds = scratch.save(narrow.mapInArrow(digest(seed), "doc_id bigint, id bigint, key binary, n_words bigint, keys array<bigint>, places array<bigint>"), f"seeds-{seed}")
        keyed = scratch.save(seeds.select("doc_id", "id", "key", "n_words"), f"keyed-{seed}")
        classes = keyed.groupBy("id").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("copies"), F.first("n_words").alias("n_words"), (F.min("key") != F.max("key")).alias("clash"))
        classes = scratch.save(classes, f"classes-{seed}")
        if classes.where("clash").isEmpty():
            break
        scratch.drop(f"seeds-{seed}")
        seed += 1  # two word sequences share an id: once in many corpora

    # one document of each word sequence; signatures that no other has are left out, counted before they are joined
    own = having(seeds.drop("key", "n_words"), classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id")
    crowded = own.select(F.explode(F.array_distinct("keys")).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    crowded = scratch.save(crowded, "crowded")
    placed = own.select("id", F.explode(F.arrays_zip("keys", "places")).alias("c")).select(F.col("c.keys").alias("bucket"), "id", F.col("c.places").alias("place"))
    met = scratch.save(placed.join(crowded, "bucket"), "met")
    scratch.drop(f"seeds-{seed}")

    def headed(rows: DataFrame, name: str) -> DataFrame:
        """Buckets of two ids or more, with their least id."""
        heads = rows.groupBy("bucket").agg(F.min("id").alias("head"), F.max("id").alias("top")).where("head <> top").select("bucket", "head")
        return scratch.save(rows.join(heads, "bucket"), name)

    buckets = headed(met, "buckets")
    scratch.drop("met")

    def tokenised(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                hashes, begin = hash_words(part.column(1).to_pylist())
                tokens, out = runs_of(hashes, begin, WIDTH), []
                for id_, a, b in zip(part.column(0).to_pylist(), begin.tolist(), begin[1:].tolist()):
                    # a doc_id that repeats brings further texts
                    out.append(tokens[a : max(a, b - WIDTH + 1)].tobytes() if node_id(hashes[a:b], seed) == id_ else None)
                found = pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["id", "tokens"])
                yield found.filter(pa.array([x is not None for x in out], pa.bool_()))

    ids = buckets.select("id").distinct().join(classes.select("id", F.col("rep").alias("doc_id")), "id")
    ids = scratch.save(ids, "ids")
    texts = narrow.join(F.broadcast(ids) if ids.count() <= BROADCAST_KEYS else ids, "doc_id").select("id", "text")
    tokens = scratch.save(texts.mapInArrow(tokenised, "id bigint, tokens binary"), "tokens")

    def spoken(keys: DataFrame, columns: list[str]) -> DataFrame:
        """The tokens of each row of ``keys`` (id and others). Keys are broadcast up to a bound, so that tokens stay where they are."""
        named = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
        return tokens.join(named, "id").select(*columns, "tokens")

    def merge_places(batches):
        for batch in batches:
            found = [run_starts(x.values.to_numpy(), t) for x in batch.column("places")]
            ranged = [len(a) > 0 for a, _ in found]
            columns = [pa.array([x[i] for x in found], pa.list_(pa.int64())) for i in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "first", "last"]).filter(pa.array(ranged, pa.bool_()))

    # a document's cells are bounded by its length
    listed = buckets.groupBy("id").agg(F.collect_list("place").alias("places"))
    ranges = scratch.save(listed.mapInArrow(merge_places, "id bigint, first array<bigint>, last array<bigint>"), "ranges")

    def emit_runs(batches):
        for batch in batches:
            for id_, first, last, held in zip(batch.column("id").to_pylist(), *(batch.column(c) for c in ("first", "last", "tokens"))):
                starts, runs = run_hashes(np.frombuffer(held.as_buffer(), np.uint64), first.values.to_numpy(), last.values.to_numpy(), t)
                yield pa.RecordBatch.from_arrays([pa.array(runs), pa.array(np.full(len(runs), id_)), pa.array(starts)], ["run", "id", "start"])

    def join_runs(batches):
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = []
            for x in batch.column("starts"):
                starts = np.unique(x.values.to_numpy())
                cuts = np.flatnonzero(np.diff(starts) > least_words) + 1
                rows.append([{"start": int(p[0]), "end": int(p[-1]) + least_words} for p in np.split(starts, cuts)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("partners"), pa.array(rows, span)], ["id", "partners", "spans"])

    runs = scratch.save(spoken(ranges, ["id", "first", "last"]).mapInArrow(emit_runs, "run bigint, id bigint, start bigint"), "runs")
    common = runs.groupBy("run").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("run", "lo")
    # a document's runs are bounded by its length
    gathered = runs.join(common, "run").groupBy("id").agg(F.collect_set("lo").alias("partners"), F.collect_list("start").alias("starts"))
    exact = scratch.save(gathered.mapInArrow(join_runs, "id bigint, partners array<bigint>, spans array<struct<start:bigint,end:bigint>>"), "exact")
    scratch.drop("runs")
    known = exact.select(F.explode("partners").alias("a"), F.col("id").alias("b")).where("a <> b")

    def confirm(batches):
        kept: tuple[int | None, Sought | None] = (None, None)
        for batch in batches:
            rows = []
            for a, b, one, two in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("t_a"), batch.column("t_b")):
                if kept[0] != a:
                    kept = (a, Sought(np.frombuffer(one.as_py(), np.uint64)))
                other = np.frombuffer(two.as_buffer(), np.uint64)
                if kept[1].may_share(other, t) and (found := align_both(kept[1].tokens, other, t)):
                    rows.append((a, b, _spans(found)))
            columns = list(zip(*rows)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], _SPANS)], ["a", "b", "shared"])

    tried: DataFrame | None = None
    links = spark.createDataFrame([], f"a bigint, b bigint, shared {SHARED}")

    def verify(pairs: DataFrame, turn: int) -> None:
        """Add the links among pairs that weren't tried before."""
        nonlocal tried, links
        fresh = pairs.distinct() if tried is None else pairs.distinct().join(tried, ["a", "b"], "left_anti")
        fresh = scratch.save(fresh, f"pairs-{turn}")
        one = spoken(fresh.select(F.col("a").alias("id")).distinct(), ["id"]).select(F.col("id").alias("a"), F.col("tokens").alias("t_a"))
        two = spoken(fresh.select("a", F.col("b").alias("id")), ["a", "id"]).select("a", F.col("id").alias("b"), F.col("tokens").alias("t_b"))
        found = scratch.save(two.join(one, "a").select("a", "b", "t_a", "t_b").mapInArrow(confirm, f"a bigint, b bigint, shared {SHARED}"), f"links-{turn}")
        tried = fresh if tried is None else tried.unionByName(fresh)
        links = links.unionByName(found)

    def uncovered(rows: DataFrame) -> DataFrame:
        """Members whose cell lies in no passage that is confirmed with their head; the head itself has met all others."""
        pairs = links.select(F.col("a").alias("head"), F.col("b").alias("id"), "shared")
        start = F.shiftright("place", 8)
        inside = F.exists("shared", lambda s: (s["b0"] <= start) & (start < s["b1"]))
        left = rows.where("id <> head").join(pairs, ["head", "id"], "left").where(F.col("shared").isNull() | ~inside)
        return left.groupBy("bucket", "id").agg(F.min("place").alias("place"))

    rows = buckets
    for turn in range(ROUNDS):
        verify(rows.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")), turn)
        left = scratch.save(uncovered(rows), f"left-{turn}")
        rows = headed(_distinct_buckets(left), f"rows-{turn}")

    def surroundings(batches):
        """The tokens around each cell of a document, as far as a shortest passage that holds it may reach."""
        for batch in batches:
            for id_, cells_, held in zip(batch.column("id").to_pylist(), batch.column("cells"), batch.column("tokens")):
                whole, out = np.frombuffer(held.as_buffer(), np.uint64), cells_.values
                around = [whole[_begin(x, t) : (x >> 8) + (x & 255) + SEED + t].tobytes() for x in out.field("place").to_pylist()]
                names = [c for c in carried if c != "id"]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), id_)), *(out.field(c) for c in names), pa.array(around, pa.binary())], ["id", *names, "around"])

    def components(tag: str) -> DataFrame:
        edges = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(known.toDF("u", "v"))
        return contract(scratch, edges, tag).select(F.col("node").alias("id"), F.col("root").alias("comp"))

    def side(end: str) -> DataFrame:
        return links.select(F.col(end).alias("id"), F.transform("shared", lambda x: F.struct(x[f"{end}0"].alias("s"), x[f"{end}1"].alias("e"))).alias("held"))

    repeated = exact.select("id", F.transform("spans", lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e"))).alias("held"))
    start = F.shiftright("place", 8)
    in_one = F.exists("held", lambda x: (x["s"] <= start) & (start < x["e"]))
    held = rows.select("bucket", "id", "place").join(side("a").unionByName(side("b")).unionByName(repeated), "id", "left").groupBy("bucket", "id").agg(F.min("place").alias("open"), F.max(F.coalesce(in_one, F.lit(False))).alias("covered"))
    bare = scratch.save(held.where("not covered").select("bucket", "id", "open", F.lit(True).alias("bare")), "bare")
    # heads have met all others of their bucket in the first round
    unmet = (buckets.where("id <> head") if ROUNDS else buckets).groupBy("bucket", "id").agg(F.min("place").alias("place"))
    unmet = scratch.save(unmet, "unmet")
    chosen = _distinct_buckets(unmet).unionByName(having(unmet, bare.select("bucket").distinct(), "bucket")).distinct()
    members = chosen.join(components("contract-0"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    members = scratch.save(members.join(bare, ["bucket", "id"], "left").withColumns({"bare": F.coalesce("bare", F.lit(False)), "place": F.coalesce("open", "place")}).drop("open"), "members")
    opened = members.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("bare").alias("any_bare")).where("lo <> hi or any_bare").select("bucket")
    left = scratch.save(members.join(opened, "bucket", "left_semi"), "opened")
    # members of the largest component that lie in a passage are compared with the others, not with each other
    hubs = left.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket").agg(F.max_by("comp", F.struct("k", "comp")).alias("hub"))
    carried = ["bucket", "id", "place", "comp", "bare", "active"]
    left = left.join(hubs, "bucket").withColumn("active", F.col("bare") | (F.col("comp") != F.col("hub"))).select(*carried)
    # a document's cells are bounded by its length
    each = left.groupBy("id").agg(F.collect_list(F.struct(*(c for c in carried if c != "id"))).alias("cells"))
    around = spoken(each, ["id", "cells"]).mapInArrow(surroundings, "id bigint, bucket bigint, place bigint, comp bigint, bare boolean, active boolean, around binary")
    dealt = bucket_blocks(scratch.save(around, "around"), BLOCK, "active").select("block", "own", "id", "comp", "bare", "place", "around")
    sifted = scratch.save(dealt.mapInArrow(_sift(t), f"a bigint, b bigint, shared {SHARED}"), "sifted")
    verify(sifted.select("a", "b"), ROUNDS)
    links = links.unionByName(sifted.where(F.size("shared") > 0))
    labels = components("contract-1")
    return _report(keyed, classes, labels, links, exact, known)


def _report(keyed: DataFrame, classes: DataFrame, labels: DataFrame, links: DataFrame, exact: DataFrame, known: DataFrame) -> DataFrame:
    """Links, exact repeats and copies, gathered by document."""
    pairs = links.select("a", "b").unionByName(known).distinct()
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    counts = ends.groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    comps = classes.select("id", "rep", "copies").join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    named = comps.join(comps.groupBy("comp").agg(F.min("rep").alias("root")), "comp").select("id", "copies", "root")
    each = links.select("a", "b", F.explode("shared").alias("s"))
    spans = (
        each.select(F.col("a").alias("id"), F.col("s.a0").alias("start"), F.col("s.a1").alias("end"))
        .unionByName(each.select(F.col("b").alias("id"), F.col("s.b0").alias("start"), F.col("s.b1").alias("end")))
        .unionByName(exact.select("id", F.explode("spans").alias("s")).select("id", "s.start", "s.end"))
        .unionByName(classes.where("copies > 1").select("id", F.lit(0).cast("bigint").alias("start"), F.col("n_words").alias("end")))
        .groupBy("id", "start").agg(F.max("end").alias("end"))
    )
    before = Window.partitionBy("id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("id").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    new = (F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int")
    merged = (
        spans.withColumn("new", new).withColumn("island", F.sum("new").over(upto)).groupBy("id", "island")
        .agg(F.struct(F.min("start").alias("start"), F.max("end").alias("end")).alias("span"))
        .groupBy("id").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    )
    found = (
        merged.join(named, "id").join(counts, "id", "left")
        .select("id", F.col("root").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "spans")
    )
    covered = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    rows = keyed.dropDuplicates(["doc_id", "id"]).join(found, "id")
    return rows.select("doc_id", "class_id", "n_links", "n_words", covered.alias("repeated_words"), "spans")
