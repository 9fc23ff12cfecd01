"""Operator 3: repeated runs of words by suffix automata.

Pieces meet in shards as ``repeats`` describes. The distinct pieces of an anchor are the reference shard: their words build a suffix
automaton, and every state learns the smallest document among the pieces that hold its words. Pieces then stream through
it. The matching statistic of a place is the longest run of words ending there that the reference holds; where it reaches the
window, the state for the last window's words tells the smallest document.

An automaton holds whole anchors. One whose pieces exceed ``AUTOMATON_WORDS`` gets several, and the smallest document of a window
is taken over all of them.

The automata go where the pieces are instead of being broadcast: each reference shard sent to every document would be work
that grows with the square of the corpus, while an anchor's pieces are all that can match its automaton.

Cases: null and blank texts have no words; texts with fewer words than a window repeat nothing; repeated rows of one ``doc_id`` do not
count against each other; rows without ``doc_id`` come last; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from pagemill.llm.repeats import Kind, Matcher, Removed, Runs, remove_repeats, word_units

AUTOMATON_WORDS = 50_000  # pieces of several anchors share an automaton up to this size
MERGED_WORDS = 500_000  # words of one anchor whose windows are merged at once


class Automaton:
    """Suffix automaton of several sequences. ``least`` is the smallest value given with a sequence that holds a state's words."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.least = [0]

    def _state(self, length: int, link: int, moves: dict, value: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.least.append(value)
        return len(self.next) - 1

    def _split(self, p: int, c, q: int) -> int:
        """A copy of q for the shorter words that p leads to."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), self.least[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, words: list, value: int) -> None:
        last = 0
        for c in words:
            q = self.next[last].get(c)
            if q is not None:  # known words of an earlier sequence
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
            else:
                new = self._state(self.length[last] + 1, 0, {}, value)
                p = last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][c]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
                last = new
            if value < self.least[last]:
                self.least[last] = value

    def finish(self) -> None:
        """Longer words' values count for the shorter words they end with."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            if up > 0 and self.least[s] < self.least[up]:
                self.least[up] = self.least[s]

    def statistics(self, words: list, window: int):
        """For every place: length of the longest known run that ends there, and the value of its last ``window`` words (or None)."""
        state, have = 0, 0
        for c in words:
            while state and c not in self.next[state]:
                state = self.link[state]
                have = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                have += 1
            top = state
            while self.length[self.link[top]] >= window if top else False:
                top = self.link[top]
            yield have, self.least[top] if have >= window else None


def matcher(window: int) -> Matcher:
    def match(pieces: list[bytes], docs: np.ndarray, anchors: np.ndarray | None = None) -> list[Runs]:
        """Only pieces under one anchor can share windows; without ``anchors`` all pieces can."""
        words = [p.split(b" ") for p in pieces]
        values = docs.tolist()
        under = np.zeros(len(pieces), dtype=np.uint32) if anchors is None else anchors
        order = np.argsort(under, kind="stable")
        heads = np.flatnonzero(np.diff(under[order])) + 1
        out: list[Runs] = [[] for _ in pieces]

        def work(block: list[int]) -> None:
            for i, runs in zip(block, _match_block([words[i] for i in block], [values[i] for i in block], window), strict=True):
                out[i] = runs

        block, held = [], 0
        for one in map(np.ndarray.tolist, np.split(order, heads)):
            n = sum(len(words[i]) for i in one)
            if held + n > AUTOMATON_WORDS and block:
                work(block)
                block, held = [], 0
            if n <= AUTOMATON_WORDS:
                block += one
                held += n
                continue
            for i in one:  # an anchor beyond the size takes several automata, and their answers are merged
                block.append(i)
                held += len(words[i])
                if held >= AUTOMATON_WORDS:
                    work(block)
                    block, held = [], 0
            if block:
                work(block)
                block, held = [], 0
            for i, runs in zip(one, _merged([words[i] for i in one], [out[i] for i in one], window, -(-n // MERGED_WORDS)), strict=True):
                out[i] = runs
        if block:
            work(block)
        return out

    return match


def _merged(words: list[list[bytes]], told: list[Runs], window: int, rounds: int) -> list[Runs]:
    """The smallest document of every window over what several automata told. A round sees the windows of one part of the hashes."""
    values = [[d for a, b, d in runs for _ in range(a, b)] for runs in told]  # every window of a piece is told
    for k in range(rounds):
        least: dict[bytes, int] = {}
        seen = []
        for w, mine in zip(words, values, strict=True):
            for s, d in enumerate(mine):
                key = b" ".join(w[s : s + window])
                if hash(key) % rounds == k:
                    seen.append((mine, s, key))
                    if d < least.get(key, d + 1):
                        least[key] = d
        for mine, s, key in seen:
            mine[s] = least[key]
    return [_runs(mine) for mine in values]


def _runs(values: list[int]) -> Runs:
    out: Runs = []
    for s, d in enumerate(values):
        if out and out[-1][2] == d:
            out[-1] = (out[-1][0], s + 1, d)
        else:
            out.append((s, s + 1, d))
    return out


def _match_block(words: list[list[bytes]], docs: list[int], window: int) -> list[Runs]:
    automaton = Automaton()
    for w, d in zip(words, docs, strict=True):
        automaton.add(w, d)
    automaton.finish()
    out: list[Runs] = []
    for w in words:
        runs: Runs = []
        for k, (have, value) in enumerate(automaton.statistics(w, window)):
            if have >= window:
                s = k + 1 - window
                if runs and runs[-1][1] == s and runs[-1][2] == value:
                    runs[-1] = (runs[-1][0], s + 1, value)
                else:
                    runs.append((s, s + 1, value))
        out.append(runs)
    return out


def _kept(r: Removed, a: int, b: int) -> bytes:
    """The words [a, b) that stay, with one space between them."""
    if a == b:
        return b""
    low, high = r.units.start[a], r.units.end[b - 1]
    gone = r.gone[a:b]
    if not gone.any():
        return r.units.data[low:high].tobytes()
    stay = np.repeat(~gone, r.units.end[a:b] - r.units.start[a:b] + 1)
    return np.append(r.units.data[low:high], np.uint8(32))[stay].tobytes()[:-1]


def _report(r: Removed) -> list[tuple]:
    bounds = zip(r.units.first[:-1].tolist(), r.units.first[1:].tolist(), strict=True)
    return [(b - a, int(r.gone[a:b].sum()), hashlib.sha256(_kept(r, a, b)).hexdigest()) for a, b in bounds]


def repeated_words(docs: DataFrame, window: int = 13, gram: int = 4) -> DataFrame:
    """Per document: ``doc_id, n_words, n_removed, kept_sha256``."""
    return remove_repeats(docs, Kind(word_units, window, gram), matcher(window), _report, "n_words long, n_removed long, kept_sha256 string")


def without_repeated_words(docs: DataFrame, window: int = 13, gram: int = 4) -> DataFrame:
    """Per document: ``doc_id, kept, n_removed``: the words that stay, with one space between them."""

    def report(r: Removed) -> list[tuple]:
        bounds = zip(r.units.first[:-1].tolist(), r.units.first[1:].tolist(), strict=True)
        return [(_kept(r, a, b).decode(), int(r.gone[a:b].sum())) for a, b in bounds]

    return remove_repeats(docs, Kind(word_units, window, gram), matcher(window), report, "kept string, n_removed long")
