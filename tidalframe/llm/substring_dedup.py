"""Substring deduplication: suffix automata of reference shards, matching statistics, maximal repeated spans.

The reference is the corpus itself, which has no size bound, so its automata are not broadcast whole: every shard
holds the fragments of some anchors (see ``fragments``), with an automaton for each, and the texts that can match them
are streamed there.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tidalframe.llm.common import NULL_ID
from tidalframe.llm.fragments import Fragments, Units, read_octets, remove_repeats

WINDOW_WORDS = 13
ANCHOR_WORDS = 5
# Fragments of one anchor that may share an automaton; each has up to 21 words, so it holds up to 42,000 words, about
# 100 bytes of memory for each state and transition.
ANCHOR_FRAGMENTS = 2_000


class SuffixAutomaton:
    """All substrings of the added sequences; each state knows the least owner of its substrings."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.owner = [-1], [0], [NULL_ID]

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(NULL_ID)
        return len(self.link) - 1

    def _split(self, p: int, q: int, token) -> int:
        """The part of state q that is reached through p."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p != -1 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def add(self, sequence, owner: int) -> None:
        moves, link, length, owners = self.next, self.link, self.length, self.owner
        last = 0
        for token in sequence:
            q = moves[last].get(token)
            if q is None:
                new, p = self._state(length[last] + 1, 0, {}), last
                while p != -1 and token not in moves[p]:
                    moves[p][token] = new
                    p = link[p]
                if p != -1:
                    q = moves[p][token]
                    link[new] = q if length[p] + 1 == length[q] else self._split(p, q, token)
                last = new
            else:
                last = q if length[last] + 1 == length[q] else self._split(last, q, token)
            if owner < owners[last]:
                owners[last] = owner

    def close(self) -> None:
        """Hand owners on to shorter substrings."""
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up = self.link[v]
            if self.owner[v] < self.owner[up]:
                self.owner[up] = self.owner[v]

    def matching_statistics(self, sequence):
        """Longest match ending at each token: (its length, its state)."""
        moves, link = self.next, self.link
        state = size = 0
        for token in sequence:
            while state and token not in moves[state]:
                state = link[state]
                size = self.length[state]
            if token in moves[state]:
                state, size = moves[state][token], size + 1
            yield size, state

    def least_owners(self, sequence, window: int) -> list[int]:
        """For every window of the sequence the least owner of a sequence that holds it; NULL_ID if none does."""
        link, length, out = self.link, self.length, []
        for i, (size, state) in enumerate(self.matching_statistics(sequence)):
            if i + 1 < window:
                continue
            if size < window:
                out.append(NULL_ID)
                continue
            while length[link[state]] >= window:
                state = link[state]
            out.append(self.owner[state])
        return out


def solve(fragments: Fragments, length: int) -> list[np.ndarray]:
    """Whether each window is also in a document with a smaller id: one automaton for each anchor, as only its windows can be equal."""
    shards: dict[int, dict[bytes, int]] = {}
    docs = fragments.doc.tolist()
    for anchor, text, doc in zip(fragments.anchor.tolist(), fragments.texts, docs):
        shard = shards.setdefault(anchor, {})
        if doc < shard.get(text, NULL_ID + 1):
            shard[text] = doc
    least: dict[bytes, np.ndarray] = {}
    for shard in shards.values():
        automaton = SuffixAutomaton()
        split = {text: text.split() for text in shard}
        for text, owner in shard.items():
            automaton.add(split[text], owner)
        automaton.close()
        for text, words in split.items():
            least[text] = np.array(automaton.least_owners(words, length), np.int64)
    return [least[t] < d for t, d in zip(fragments.texts, docs)]


# The bytes that part words.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
# Longer words are hashed one by one.
LONG_WORD = 64


def word_hashes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit hash of the words ``data[lo:hi]``, eight bytes at a time for all words that have as many."""
    size = hi - lo
    padded = np.append(data, np.zeros(8, np.uint8))
    # the eight bytes from each place on, as one number
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = size.astype(np.uint64)
    todo = np.flatnonzero(size <= LONG_WORD)
    for depth in range(0, LONG_WORD, 8):
        todo = todo[size[todo] > depth]
        if not len(todo):
            break
        unused = 8 * np.maximum(depth + 8 - size[todo], 0).astype(np.uint64)
        mixed = (out[todo] * np.uint64(0x9E3779B97F4A7C15)) ^ (eight[lo[todo] + depth] << unused)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out[todo] = mixed ^ (mixed >> np.uint64(32))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[lo[i] : hi[i]])
    return out


def read_words(table: pa.Table) -> Units:
    """Words are the runs between ASCII white space, unchanged."""
    data, ends = read_octets(table)
    inside = ~_SPACE[data]
    before, after = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    before[1:], after[:-1] = inside, inside
    before[ends] = after[ends] = False  # words end with their text
    lo = np.flatnonzero(inside & ~before[:-1])
    hi = np.flatnonzero(inside & ~after[1:]) + 1
    bounds = np.searchsorted(lo, ends)
    raw = data.tobytes()

    def cut(a: np.ndarray, b: np.ndarray) -> list[bytes]:
        return [b" ".join(raw[x:y].split()) for x, y in zip(lo[a].tolist(), hi[b - 1].tolist())]

    def kept(i: int, mask: np.ndarray) -> bytes:
        split = raw[ends[i] : ends[i + 1]].split()
        return b" ".join(split if mask.all() else compress(split, mask.tolist()))

    return Units(word_hashes(data, lo, hi), bounds, cut, kept)


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS, most: int = ANCHOR_FRAGMENTS) -> DataFrame:
    """Remove every word covered by a ``window``-word run that also starts in a document with a smaller id.

    Returns one row per input row: id, n_units (words), n_removed, spans (word positions removed, maximal), kept
    (remaining words joined by one space, UTF-8). A null text has no words; texts shorter than the window lose
    nothing. Rows with a null id count as the last ones. Rows with equal ids never remove words from each other.
    Other columns are ignored, an empty table gives an empty result. ``most`` bounds the fragments of an anchor that meet
    in one automaton (beyond it they are split by window); it does not change the result.
    """
    gram = max(1, min(ANCHOR_WORDS, window))
    return remove_repeats(df, id_col, text_col, window, gram, read_words, solve, "substring", same_doc=False, most=most)
