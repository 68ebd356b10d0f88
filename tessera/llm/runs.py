"""Periodic run detection: all maximal repetitions of words in a text, and the text with each run collapsed to its first period.

A run is a stretch of words with smallest period q (words q apart are the same) that no neighbouring word extends with that period,
of at least ``exponent`` periods and ``least`` words. Texts are taken whole, half a megabyte of them at a time, by array operations:

1. Words become exact numbers and windows of 1, 2, 4, ... words are ranked by prefix doubling, until all are distinct within their text; places whose
   window is distinct already are not sorted again. The last ranking is the suffix array; the level at which neighbours part, and the ranks
   below it, give the longest common prefix (LCP) of neighbours.
2. The longest previous factor (LPF) of a place is its larger LCP with the nearest smaller places to both sides in the suffix array. The
   LPF array gives the Lempel-Ziv blocks: each is the longest piece that occurs before, or one new word.
3. Runs that touch or cross a block's border are found as Main does, by extension from the border: for a period p, how far words p apart agree to both sides
   of it. With the previous block of A and the own block of B words, the run whose last border this is has (exponent - 1) p < A + B, or
   < B if its first period reaches over the border, so that all borders of a text have a linear number of periods to try. Extensions to either side are read off the
   ranks of windows.
4. Runs inside a block are copies of runs inside its earlier occurrence. Blocks are taken from left to right, runs by the bucket of their start, and
   a block that overlaps its own earlier occurrence meets its own copies in turn.

The work is per text, so nothing is shuffled and a lost task is done again alone. Memory of a task is that of one chunk of texts, or of one longer text: some
10 numbers of four to eight bytes a word, and four bytes more for each doubling up to the longest repeat.

Edge cases
----------
* null, empty or blank text: no words, no run, empty collapsed text; fewer than ``least`` words: no run;
* runs are a matter of one text: repeated rows and ids, null ids and ties change nothing, every row gives one row;
* two runs of different periods may overlap or share a start; both count, and a word goes if any run has it after its first period;
* a text of one word repeated, or one text of many million words, is taken whole;
* empty table: empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .exchange import columns_of

LEAST, EXPONENT = 24, 3
#: Texts of about so many bytes are taken together, so that their arrays stay in a processor's cache.
CHUNK_BYTES = 512 << 10
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_text string"


def exact_numbers(w: W.Words) -> np.ndarray:
    """A number for each word, the same for the same words: hashes, checked word for word, under another base where two words share one."""
    base = W.FIXED.word[0]
    while True:
        _, first, number = np.unique(w.values(base), return_index=True, return_inverse=True)
        if w.equal(np.arange(len(number)), w, first[number]).all():
            return number
        base = W.new_key().word[0]


@dataclass
class Suffixes:
    """Suffix array and LCP of several texts one after another (``bounds``), and the ranks of windows of 1, 2, 4, ... words.

    Ranks have one entry more than words. Equal ranks mean equal windows within one text.
    """

    bounds: np.ndarray
    order: np.ndarray
    lcp: np.ndarray
    ranks: list[np.ndarray]

    @classmethod
    def of(cls, number: np.ndarray, bounds: np.ndarray) -> Suffixes:
        n = len(number)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        end = bounds[1:][text]
        key = text * (int(number.max(initial=0)) + 1) + number
        order = np.argsort(key)
        slot, key = np.arange(n), key[order]
        rank, ranks, parted = np.full(n + 1, -1, np.int64 if n >> 31 else np.int32), [], np.full(n, -1, np.int8)
        width = 1
        while True:
            # key: sorted keys of the places order[slot], which share all words looked at so far if keys are equal.
            differ = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
            begin = np.flatnonzero(differ)
            rank = rank.copy()
            rank[order[slot]] = np.repeat(slot[begin], np.diff(np.r_[begin, len(key)]))
            ranks.append(rank)
            shared = ~(differ & np.r_[differ[1:], True]) if len(key) else differ
            slot = slot[shared]
            if not len(slot):
                break
            place = order[slot]
            after = place + width
            old = rank[place].astype(np.int64)
            key = old * (n + 2) + np.where(after < end[place], rank[np.minimum(after, n)], -1) + 1
            by = np.argsort(key)
            order[slot], key = place[by], key[by]
            same = old[1:] == old[:-1]  # groups keep their slots, so ``old`` is in order
            parted[slot[1:][same & (key[1:] != key[:-1])]] = len(ranks) - 1
            width *= 2
        return cls(bounds, order, cls._lcp(order, ranks, parted), ranks)

    @staticmethod
    def _lcp(order: np.ndarray, ranks: list[np.ndarray], parted: np.ndarray) -> np.ndarray:
        """Neighbours that part at level l agree on 2^l words, and on less than 2^l more."""
        lcp = np.zeros(len(order), np.int64)
        for level in range(int(parted.max(initial=-1)) + 1):
            some = np.flatnonzero(parted == level)
            x, y = order[some - 1] + (1 << level), order[some] + (1 << level)
            for k in range(level - 1, -1, -1):
                step = (ranks[k][x] == ranks[k][y]).astype(np.int64) << k
                x, y = x + step, y + step
            lcp[some] = y - order[some]
        return lcp

    def forward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words from ``x`` and from ``y`` on agree."""
        out = np.zeros(len(x), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            out += (self.ranks[k][x + out] == self.ranks[k][y + out]).astype(np.int64) << k
        return out

    def backward(self, x: np.ndarray, y: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How many words before ``x`` and before ``y`` < ``x`` agree; ``first`` is where the text begins."""
        out = np.zeros(len(x), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = x - out - (1 << k), y - out - (1 << k)
            fits = b >= first
            out += (fits & (self.ranks[k][np.where(fits, a, 0)] == self.ranks[k][np.where(fits, b, 0)])).astype(np.int64) << k
        return out

    def previous_factors(self) -> tuple[np.ndarray, np.ndarray]:
        """LPF of every place, and an earlier place where that factor occurs (-1: none).

        The nearest smaller place to either side is found by halving steps over minima of 2^k entries; a step also takes the least LCP along.
        """
        order, lcp, n = self.order, self.lcp, len(self.order)
        length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        first = np.flatnonzero(np.r_[lcp == 0, True])  # groups that share their first word
        levels = int(np.diff(first).max(initial=1)).bit_length()
        some = np.flatnonzero((lcp > 0) | np.r_[lcp[1:] > 0, False])
        if not len(some):
            return length, source
        # place[k][i] and least[k][i]: minima over entries i - 2^k + 1 .. i
        place, least = [order], [lcp]
        for k in range(levels - 1):
            step = 1 << k
            for table in (place, least):
                wider = table[-1].copy()
                np.minimum(wider[step:], table[-1][:-step], out=wider[step:])
                table.append(wider)
        mine = order[some]
        far = np.int64(n + 1)
        for left in (True, False):
            at, common = some.copy(), np.full(len(some), far)
            for k in range(levels - 1, -1, -1):
                step = 1 << k
                to = at - step if left else at + step
                inside = to >= 0 if left else to < n
                ends = np.where(inside, at - 1 if left else to, 0)
                go = inside & (place[k][ends] > mine)
                shared = least[k][np.where(inside, at if left else to, 0)]
                common = np.where(go, np.minimum(common, shared), common)
                at = np.where(go, to, at)
            other = at - 1 if left else at + 1
            inside = (other >= 0) & (other < n)
            common = np.where(inside, np.minimum(common, lcp[np.where(inside, at if left else other, 0)]), 0)
            better = common > length[mine]
            length[mine[better]], source[mine[better]] = common[better], order[other[better]]
        return length, source


def blocks_of(length: np.ndarray) -> np.ndarray:
    """Where the Lempel-Ziv blocks begin; a text's first word has no previous factor, so texts begin blocks of their own.

    Factors of no more than one word make blocks of one word, so only longer ones are walked through.
    """
    longer = np.flatnonzero(length > 1)
    taken, at = [], 0
    for k, (place, after) in enumerate(zip(longer.tolist(), (longer + length[longer]).tolist())):
        if place >= at:
            taken.append(k)
            at = after
    taken = longer[taken]
    inside = np.zeros(len(length) + 1, np.int8)
    inside[taken + 1] += 1
    inside[taken + length[taken]] -= 1
    return np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8) == 0)


def _border_runs(s: Suffixes, begin: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of runs that touch or cross a border of blocks, sorted."""
    bounds = s.bounds[np.r_[True, s.bounds[1:] > s.bounds[:-1]]]  # texts without words have no border
    size = np.diff(np.r_[begin, len(s.order)])
    opens = np.isin(begin, bounds[:-1])
    inner = np.flatnonzero(~opens)
    # Borders before a block that is not its text's first, and at the end of each text.
    last = np.searchsorted(begin, bounds[1:]) - 1
    border = np.r_[begin[inner], bounds[1:]]
    before, own = np.r_[size[inner - 1], size[last]], np.r_[size[inner], np.zeros(len(last), np.int64)]
    first = bounds[np.searchsorted(bounds, border - 1, side="right") - 1]
    far = np.r_[bounds[1:], 0][np.searchsorted(bounds, border - 1, side="right") - 1]
    least_part = -(-least * (exponent - 1) // exponent)  # of a run without its first period
    found = []
    for over in (False, True):  # whether the first period reaches over the border
        reach = own if over else before + own
        some = np.flatnonzero(reach > least_part)
        periods = (reach[some] - 1) // (exponent - 1)
        b, a = np.repeat(border[some], periods), np.repeat(first[some], periods)
        p = np.arange(len(b)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
        fits = b + p <= np.repeat(far[some], periods) if over else b - p >= a
        b, a, p = b[fits], a[fits], p[fits]
        x = b + p if over else b
        right, left = s.forward(x, x - p), s.backward(x, x - p, a)
        good = left + right + p >= np.maximum(least, exponent * p)
        found.append(np.stack([(x - p - left)[good], (x + right)[good], p[good]]))
    start, end, period = np.concatenate(found, axis=1)
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    # A multiple of the period spans the same words.
    new = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])] if len(by) else np.zeros(0, bool)
    return list(zip(start[new].tolist(), end[new].tolist(), period[new].tolist()))


def _copied_runs(found: list[tuple[int, int, int]], begin: np.ndarray, total: int, source: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """``found`` and the runs inside blocks, copied from the blocks' earlier occurrences, sorted."""
    if not found:
        return found
    size = np.diff(np.r_[begin, total])
    some = np.flatnonzero(size >= least + 2)
    for at, n, origin in zip(begin[some].tolist(), size[some].tolist(), source[begin[some]].tolist()):
        k = bisect_right(found, (origin, total + 1, 0))  # past all that start at or before the origin
        while k < len(found) and found[k][0] < origin + n:
            start, end, period = found[k]
            if end < origin + n:
                insort(found, (start - origin + at, end - origin + at, period))
            k += 1
    return found


def runs_of(number: np.ndarray, bounds: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start, end, period) of all runs in texts of word numbers, by start and period; places count over all texts."""
    if not len(number):
        return np.zeros((0, 3), np.int64)
    s = Suffixes.of(number, bounds)
    length, source = s.previous_factors()
    begin = blocks_of(length)
    found = _copied_runs(_border_runs(s, begin, least, exponent), begin, len(number), source, least)
    return np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def _collapse(least: int, exponent: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in source:
            data, offsets = W.buffers(rows.column("text"))
            for at, to in W.chunks(offsets, CHUNK_BYTES):
                base = data[offsets[at] : offsets[to]]
                w = W.split(base, offsets[at : to + 1] - offsets[at], W.SPACE, False)
                found = runs_of(exact_numbers(w), w.doc, least, exponent)
                text = np.searchsorted(w.doc, found[:, 0], side="right") - 1
                edge = np.zeros(len(w.start) + 1, np.int32)
                np.add.at(edge, found[:, 0] + found[:, 2], 1)
                np.add.at(edge, found[:, 1], -1)
                gone = np.cumsum(edge[:-1]) > 0
                some = set(text.tolist())
                raw, kept = base.tobytes(), []
                for k, (a, b) in enumerate(zip(w.doc[:-1].tolist(), w.doc[1:].tolist())):
                    words = raw[w.start[a] : w.end[b - 1]].split() if b > a else []
                    kept.append(b" ".join([words[i] for i in np.flatnonzero(~gone[a:b])] if k in some else words).decode())
                per_text = np.r_[0, np.cumsum(np.bincount(text, minlength=to - at))].astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(found[:, 0] - w.doc[text]), pa.array(found[:, 1] - found[:, 0]), pa.array(found[:, 2])], fields=list(_RUN))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id")[at:to], pa.array(w.counts().astype(np.int64)), pa.ListArray.from_arrays(pa.array(per_text), values), pa.array(kept, pa.string())],
                    names=["id", "n_words", "runs", "collapsed_text"],
                )
        W.release()

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """(id_col, n_words, runs, collapsed_text): all runs (start, length, period) by start and period, and the words that no run has after its first period."""
    return columns_of(docs, id_col, text_col).mapInArrow(_collapse(least, exponent), _OUT).withColumnRenamed("id", id_col)


def strongest(runs: Column) -> Column:
    """The run of the greatest length by period, compared exactly; the first of equal ones; null without runs."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
