"""Suffix-array deduplication: a depth-limited radix sort of the suffixes that can repeat.

Suffixes are ordered only through the first ``length`` bytes. The first and most significant pass reads the anchor gram
of a window (see ``fragments``) and leaves the suffixes whose gram occurs again. Further passes take eight bytes each and
drop every suffix that is alone in its group. What is equal after ``length`` bytes is exactly a repeated window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidalframe.llm.fragments import Fragments, Units, read_octets, remove_repeats

WINDOW_BYTES = 100
ANCHOR_BYTES = 32
DIGIT = 8
# Fragments of one anchor that may be sorted together; each has up to 69 windows.
ANCHOR_FRAGMENTS = 10_000


def radix_groups(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (as indexes into ``at``) that are equal to another of their group through ``length`` bytes, and their group.

    Groups come in order; suffixes of a group keep the order they came in.
    """
    alive = np.arange(len(at))
    for depth in range(-DIGIT, length, DIGIT):
        if depth >= 0:
            width = min(DIGIT, length - depth)
            digits = np.zeros((len(alive), DIGIT), np.uint8)
            digits[:, DIGIT - width :] = data[(at[alive] + depth)[:, None] + np.arange(width)]
            digit = digits.view(">u8").ravel()
            order = np.lexsort((digit, group))
            alive, group, digit = alive[order], group[order], digit[order]
            new = np.concatenate(([True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])))
        else:
            order = np.argsort(group, kind="stable")
            alive, group = alive[order], group[order]
            new = np.concatenate(([True], group[1:] != group[:-1]))
        if not len(alive):
            break
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        alive, group = alive[many], group[many]
    return alive, group


def solve(fragments: Fragments, length: int) -> list[np.ndarray]:
    """Whether each window also starts at an earlier place."""
    # equal fragments stand for each other: the earliest goes on
    ranks = np.lexsort((fragments.start, fragments.doc))
    known: dict[tuple[int, bytes], int] = {}
    leader = np.empty(len(ranks), np.int64)
    for i in ranks.tolist():
        leader[i] = known.setdefault((int(fragments.offset[i]), fragments.texts[i]), i)
    lead = np.fromiter(known.values(), np.int64, len(known))
    texts = [fragments.texts[i] for i in lead.tolist()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    base = np.cumsum([0] + [len(t) for t in texts])[:-1]
    n = fragments.windows[lead].astype(np.int64)
    owner = np.repeat(np.arange(len(lead)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    doc, start = fragments.doc[lead][owner], fragments.start[lead][owner] + step
    with np.errstate(over="ignore"):
        digit = fragments.anchor[lead][owner] * np.uint64(2 * length + 1) + (fragments.offset[lead][owner] - step + length).astype(np.uint64)
    alive, group = radix_groups(data, base[owner] + step, digit, length)
    late = np.zeros(len(owner), bool)
    if len(alive):
        order = np.lexsort((start[alive], doc[alive], group))
        alive, group = alive[order], group[order]
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        first = alive[first[np.cumsum(np.concatenate(([True], group[1:] != group[:-1]))) - 1]]
        late[alive] = (doc[alive] > doc[first]) | ((doc[alive] == doc[first]) & (start[alive] > start[first]))
    parts = dict(zip(lead.tolist(), np.split(late, np.cumsum(n)[:-1])))
    again = (fragments.doc != fragments.doc[leader]) | (fragments.start != fragments.start[leader])
    return [np.ones(w, bool) if x else parts[j] for x, j, w in zip(again.tolist(), leader.tolist(), fragments.windows.tolist())]


_BYTE_HASHES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)


def read_bytes(table: pa.Table) -> Units:
    data, bounds = read_octets(table)
    cut = lambda a, b: [data[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist())]
    return Units(_BYTE_HASHES[data], bounds, cut, lambda i, mask: data[bounds[i] : bounds[i + 1]][mask].tobytes())


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = WINDOW_BYTES, most: int = ANCHOR_FRAGMENTS) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts earlier: smaller id, or same id and earlier start.

    Returns one row per input row: id, n_units (bytes of the UTF-8 text), n_removed, spans (byte positions removed,
    maximal), kept (the remaining bytes). A null text is empty; texts shorter than the length lose nothing. Rows with
    a null id count as the last ones. Of rows with equal ids and texts none is earlier than the other. Other columns
    are ignored, an empty table gives an empty result. ``most`` bounds the fragments of an anchor that are sorted together
    (beyond it they are split by window); it does not change the result.
    """
    return remove_repeats(df, id_col, text_col, length, min(ANCHOR_BYTES, max(1, length // 3)), read_bytes, solve, "suffix", same_doc=True, most=most)
