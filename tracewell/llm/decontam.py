"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may differ from a passage by k = floor(rate * n) edits. Split into k + 1 pieces, at
least one piece is then in the passage unchanged. All pieces of all items are sought at once by an Aho-Corasick
automaton; around each hit Myers's bit-parallel algorithm finds the least edit distance, first of the pieces next to it,
then of ever larger parts, at last between the item and any passage there. Items and documents are compared lower-cased, with runs of anything but letters and digits as one blank.
"""

from __future__ import annotations

import re
import uuid
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import Scratch, row_type

#: Edits allowed for each character of an item.
ERROR_RATE = 0.1
#: Items of fewer normalised characters are sought as whole words.
MIN_CHARS = 40
#: Characters of items that one pass looks for; more items take more passes.
PASS_CHARS = 4_000_000

_GAP = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    return _GAP.sub(" ", (text or "").lower()).strip()


def pieces(n: int, budget: int) -> list[int]:
    """Where budget + 1 pieces of nearly equal length begin and end in an item of ``n`` characters."""
    return [n * i // (budget + 1) for i in range(budget + 2)]


class Pattern:
    """A string and, for each of its characters, the bits of where it stands."""

    def __init__(self, text: str):
        self.size, self.full, self.top = len(text), (1 << len(text)) - 1, 1 << len(text) - 1
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def distance(self, text: str) -> tuple[int, int]:
        """The least edit distance to any substring of ``text``, and where the first such substring ends (Myers's bit vectors)."""
        full, top, get = self.full, self.top, self.masks.get
        plus, minus, score, best, end = full, 0, self.size, self.size, 0
        for j, c in enumerate(text, 1):
            eq = get(c, 0)
            x = (((eq & plus) + plus) ^ plus) | eq | minus
            up, down = minus | ~(x | plus) & full, plus & x
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score < best:
                    best, end = score, j
            up, down = up << 1 & full, down << 1 & full
            eq |= minus
            plus, minus = down | ~(eq | up) & full, up & eq
        return best, end


class Item:
    """A test item with the tree over its pieces.

    A node of e + 1 pieces allows e edits. If it is within them, one of its two halves is within its own, so a
    piece that is hit is checked against ever larger nodes and given up at the first that isn't there.
    """

    def __init__(self, text: str, budget: int, words: bool = False):
        self.text, self.budget, self.words = text, budget, words
        self.cuts = pieces(len(text), budget)
        self.nodes: dict[tuple[int, int], Pattern] = {}

    def ladder(self, leaf: int) -> list[tuple[int, int]]:
        """The nodes over a piece, the smallest first."""
        found, lo, hi = [], 0, self.budget + 1
        while hi - lo > 1:
            found.append((lo, hi))
            middle = (lo + hi) // 2
            lo, hi = (lo, middle) if leaf < middle else (middle, hi)
        return found[::-1]

    def verify(self, doc: str, leaf: int, at: int) -> tuple[int, int] | None:
        """Least distance and end of a passage around the piece ``leaf`` at ``at``; None if beyond the budget."""
        best, end = 0, at + self.cuts[leaf + 1] - self.cuts[leaf]
        for lo, hi in self.ladder(leaf):
            if (node := self.nodes.get((lo, hi))) is None:
                node = self.nodes[lo, hi] = Pattern(self.text[self.cuts[lo] : self.cuts[hi]])
            allowed = hi - lo - 1
            a = max(0, at + self.cuts[lo] - self.cuts[leaf] - allowed)
            best, end = node.distance(doc[a : at + self.cuts[hi] - self.cuts[leaf] + allowed])
            if best > allowed:
                return None
            end += a
        return self.whole_words(doc, at - self.cuts[leaf]) if self.words else (best, end)

    def whole_words(self, doc: str, at: int) -> tuple[int, int] | None:
        """As ``verify``, of passages that begin near ``at`` and both begin and end where a word does."""
        n, found = len(self.text), []
        for start in range(max(1, at - self.budget), at + self.budget + 1):
            if doc[start - 1 : start] != " ":
                continue
            row = list(range(n + 1))
            for end, c in enumerate(doc[start : start + n + self.budget], start + 1):
                last, row[0] = row[0], end - start
                for i, x in enumerate(self.text, 1):
                    last, row[i] = row[i], min(last + (x != c), row[i] + 1, row[i - 1] + 1)
                if doc[end : end + 1] == " " and row[n] <= self.budget:
                    found.append((row[n], end))
        return min(found, default=None)


class Matcher:
    """An automaton over the pieces of some items."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        import ahocorasick

        self.items: list[tuple[int, Item]] = []
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            if not (text := normalise(text)):
                continue
            budget = int(rate * len(text))
            item = Item(text if budget else f" {text} ", budget, bool(budget) and len(text) < MIN_CHARS)
            for leaf, (a, b) in enumerate(zip(item.cuts, item.cuts[1:])):
                found.setdefault(item.text[a:b], []).append((len(self.items), leaf))
            self.items.append((item_id, item))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """Each item that the text holds within its budget: item_id, least distance, budget, where it ends in the normalised text."""
        if not self.items:
            return []
        doc = f" {normalise(text)} "
        best: dict[int, tuple[int, int]] = {}
        spans: dict[int, list[tuple[int, int]]] = {}
        for last, (n, places) in self.automaton.iter(doc):
            for number, leaf in places:
                item = self.items[number][1]
                start = last + 1 - n - item.cuts[leaf]
                if any(a <= start <= b for a, b in spans.get(number, ())[-1:]):
                    continue  # a hit of the passage found last
                if (found := item.verify(doc, leaf, last + 1 - n)) is not None:
                    spans.setdefault(number, []).append((start - item.budget, start + item.budget))
                    best[number] = min(best.get(number, found), found)
        return [(self.items[i][0], distance, self.items[i][1].budget, end) for i, (distance, end) in best.items()]


def _passes(items: DataFrame) -> list[Column]:
    """Conditions that part the items into passes of bounded size."""
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // PASS_CHARS) or 1
    return [F.pmod(F.xxhash64("item_id"), F.lit(n)) == i for i in range(n)]


def _matcher(items: DataFrame, chosen: Column, unnamed: bool = False):
    """The items of a pass, of bounded size, for every executor; those without id only if ``unnamed``."""
    named = F.lit(True) if unnamed else F.col("item_id").isNotNull()
    rows = [(r.item_id, r.text) for r in items.where(named).where("text is not null").where(chosen).select("item_id", "text").distinct().collect()]
    return items.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, rows))


_BUILT: dict[str, Matcher] = {}


def _built(shared) -> Matcher:
    """One automaton for each Python worker and broadcast; the last two are kept."""
    token, rows = shared.value
    if token not in _BUILT:
        while len(_BUILT) > 1:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[token] = Matcher(rows)
    return _BUILT[token]


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each document and item that it holds within the item's budget: doc_id, item_id, distance, budget, end_char.

    Whole texts are searched; null and empty texts and items hold nothing, and items without id aren't sought. Items of
    equal id and different texts are sought one by one; rows that repeat a document give its rows again. With several
    passes each is written before the next begins, so that the driver holds the items of one.
    """
    found, passes = None, _passes(items)
    scratch = Scratch(docs.sparkSession, "matches")
    for number, chosen in enumerate(passes):
        shared = _matcher(items, chosen)

        def run(batches, shared=shared):
            matcher = _built(shared)
            for batch in batches:
                ids, rows = [], []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    found = matcher.search(text.as_py())
                    ids += [doc_id] * len(found)
                    rows += found
                columns = list(zip(*rows)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "item_id", "distance", "budget", "end_char"])

        part = docs.select("doc_id", "text").mapInArrow(run, row_type(docs, ["doc_id"], item_id="bigint", distance="bigint", budget="bigint", end_char="bigint"))
        if len(passes) > 1:
            part = scratch.save(part, f"pass-{number}")
            shared.destroy()
        found = part if found is None else found.union(part)
    return found


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs``, all its columns, without the documents that hold an item, be it one without id. No shuffle.

    Without items all documents stay; repeated rows stay or go together. With several passes each is written before the next begins.
    """
    columns, passes = docs.columns, _passes(items)
    scratch = Scratch(docs.sparkSession, "clean")
    for number, chosen in enumerate(passes):
        shared = _matcher(items, chosen, unnamed=True)
        packed = docs.select(F.col("text").alias("text"), F.struct(*columns).alias("row"))

        def run(batches, shared=shared):
            matcher = _built(shared)
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array([not matcher.search(t.as_py()) for t in batch.column(0)], pa.bool_()))], ["row"])

        docs = packed.mapInArrow(run, row_type(packed, ["row"])).select("row.*")
        if len(passes) > 1:
            docs = scratch.save(docs, f"pass-{number}")
            shared.destroy()
    return docs
