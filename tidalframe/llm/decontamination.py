"""Benchmark decontamination by templates: numbers, names and units become typed slots."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalframe.llm.common import known_id, materialise
from tidalframe.llm.fragments import rolling

WINDOW = 10
# A template window has at least so many tokens of its own (words, marks of arithmetic), one of them a word. With fewer, its words
# are compared as they stand, or the window has to be the whole text with some tokens of its own.
LEAST_OWN = 4
LEAST_WHOLE = 2
# Items with a window of which fewer are plain words are also looked for word by word.
PLAIN_SHARE = 0.5
# An item is found where half its windows match, and always at so many.
ENOUGH_WINDOWS = 6
# Benchmark windows whose hashes are sent to all tasks (8 bytes each); a larger benchmark meets the documents in a join of all windows.
BROADCAST_WINDOWS = 2_000_000
# Words remembered between documents of a task.
_MEMORY = 400_000

# fixed values: units and number words
UNITS = frozenset(
    "mm cm m km meter meters metre metres kilometer kilometers kilometre kilometres inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms "
    "ton tons tonne tonnes pound pounds ounce ounces ml l liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degree degrees watt watts volt volts joule joules newton newtons hertz "
    "mètre mètres heure heures jour jours semaine semaines mois an ans stunde stunden tag tage woche wochen monat monate jahr jahre hora horas día días semana semanas mes meses año años".split()
) | {"%", "$", "€", "£", "°c", "°f"}
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
)
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*")
_QUANTITY = re.compile(r"([+-]?\d[\d.,]*)([^\W\d_]+|[%$€£°])")
_EDGES = re.compile(r"^[^\w$€£%°+-]+|[^\w$€£%°]+$")
# fixed values: marks that are tokens beside a number, and those that always are
MARKS = frozenset("* / = × ÷ ^ < >".split())
SIGNS = frozenset("+ -".split())
_WORD, _NUM, _CAP, _UNIT, _NONE, _MARK, _SIGN = range(7)
_SLOTS = {_NUM: "<number>", _CAP: "<name>", _UNIT: "<unit>"}
_IS_SLOT = np.array([k in _SLOTS for k in range(7)])
_LOOKED = np.dtype([("kind", np.int8), ("hash", np.uint64), ("ends", np.bool_)])
_SLOT_HASH = {k: xxhash.xxh3_64_intdigest(v.encode()) for k, v in _SLOTS.items()}


def _look(raw: str) -> tuple[int, int, bool]:
    """Kind, hash and end-of-sentence flag of a word as it stands in the text."""
    if len(raw) == 1 and (raw in MARKS or raw in SIGNS):
        return _MARK if raw in MARKS else _SIGN, xxhash.xxh3_64_intdigest(raw.encode()), False
    core = raw if raw.isalpha() else _EDGES.sub("", raw)
    if not core:
        return _NONE, 0, raw[-1] in ".!?:;"
    low = core.lower()
    letters = core.isalpha()
    if low in NUMBER_WORDS or (not letters and _NUMBER.fullmatch(core)):
        kind = _NUM
    elif not letters and (m := _QUANTITY.fullmatch(low)) and m[2] in UNITS:
        kind = _NUM
    elif low in UNITS:
        kind = _UNIT
    elif core[0].isupper():
        kind = _CAP
    else:
        kind = _WORD
    return kind, xxhash.xxh3_64_intdigest(low.encode()), raw[-1] in ".!?:;"


def _shown(raw: str) -> str:
    return _EDGES.sub("", raw).lower() or raw


class Words(dict):
    """What ``_look`` says of words, remembered."""

    def __missing__(self, raw: str) -> tuple[int, int, bool]:
        self[raw] = found = _look(raw)
        return found


class Template:
    """Tokens of a text: hashes in which slots are typed placeholders, which tokens are slots, and the words behind them."""

    def __init__(self, text: str, memory: Words):
        words, firsts = [], []
        for line in text.split("\n"):
            firsts.append(len(words))
            words += line.split()
        if len(memory) > _MEMORY:
            memory.clear()
        seen = np.fromiter(map(memory.__getitem__, words), _LOOKED, len(words))
        kind, hashes, ends = seen["kind"].copy(), seen["hash"].copy(), seen["ends"]
        number = np.concatenate(([False], kind == _NUM, [False]))
        kind[(kind == _MARK) & ~(number[:-2] | number[2:])] = _NONE
        real = np.flatnonzero(kind != _NONE)
        opens = np.zeros(len(words) + 1, bool)
        opens[firsts] = True
        opens[1:][ends] = True
        # a sentence opened by a lone mark is still open at the next word
        opened = np.cumsum(opens[:-1])
        kind, hashes = kind[real], hashes[real]
        start = np.diff(opened[real], prepend=-1) > 0
        after_number = np.concatenate(([False], kind[:-1] == _NUM)) if len(kind) else np.zeros(0, bool)
        kind[(kind == _CAP) & start] = _WORD
        kind[(kind == _UNIT) & ~after_number] = _WORD
        # neighbouring names are one name
        again = (kind == _CAP) & np.concatenate(([False], kind[:-1] == _CAP)) if len(kind) else np.zeros(0, bool)
        keep = np.flatnonzero(~again)
        stop = np.append(keep[1:], len(kind))
        self.slot, self.word = _IS_SLOT[kind[keep]], kind[keep] == _WORD
        self.exact, self.plain = hashes, (kind == _WORD) | (kind == _SIGN)
        self.hashes = hashes[keep]
        for k, h in _SLOT_HASH.items():
            self.hashes[kind[keep] == k] = h
        self.kind, self._real, self._words, self._keep, self._stop = kind[keep], real, words, keep, stop

    def value(self, i: int) -> str:
        return " ".join(_shown(self._words[self._real[j]]) for j in range(self._keep[i], self._stop[i]))

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows with enough tokens of their own."""
        if len(self.hashes) < length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        slots, words = (np.cumsum(np.concatenate(([0], x))) for x in (self.slot, self.word))
        least = LEAST_WHOLE if len(self.hashes) == length else LEAST_OWN
        starts = np.flatnonzero((length - (slots[length:] - slots[:-length]) >= least) & (words[length:] > words[:-length]))
        return starts, rolling(self.hashes, length)[starts]

    def slotted(self, window: int) -> bool:
        """Whether a window has not enough words, with neighbouring names as one name or as they stand."""
        for own, least in ((~self.slot, max(LEAST_OWN, PLAIN_SHARE * window)), (self.plain, PLAIN_SHARE * window)):
            size = min(window, len(own))
            count = np.cumsum(np.concatenate(([0], own)))
            if bool((count[size:] - count[: len(count) - size] < min(least, size)).any()):
                return True
        return False

    def exact_windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of all windows of the words as they stand, lower-cased, whatever their kind."""
        return np.arange(max(0, len(self.exact) - length + 1)), rolling(self.exact, length) if len(self.exact) >= length else np.zeros(0, np.uint64)

    def exact_text(self, start: int, length: int) -> str:
        return " ".join(_shown(self._words[j]) for j in self._real[start : start + length])

    def text(self, start: int, length: int) -> str:
        return " ".join(_SLOTS[self.kind[i]] if self.slot[i] else self.value(i) for i in range(start, start + length))

    def values(self, start: int, length: int) -> list[str]:
        return [self.value(i) for i in range(start, start + length) if self.slot[i]]


_WINDOWS = pa.schema([
    ("id", pa.int64()), ("mark", pa.int64()), ("pos", pa.int64()), ("length", pa.int32()), ("total", pa.int64()), ("hash", pa.int64()), ("template", pa.string()), ("slots", pa.list_(pa.string())),
])
_WINDOWS_DDL = "id bigint, mark bigint, pos bigint, length int, total bigint, hash bigint, template string, slots array<string>"


def _windows(batches: Iterator[pa.RecordBatch], lengths: list[int] | None, window: int, known) -> Iterator[pa.RecordBatch]:
    """Template windows of every row: of all ``lengths``, or for None of ``window``, and shorter texts as one window.

    A negative length is that of windows of the words as they stand; for None they follow where a template window has not enough words.
    """
    memory = Words()
    hashes = known.value if known is not None else None
    for batch in batches:
        rows = []
        for i, mark, text in zip(batch.column("id").to_pylist(), batch.column("mark").to_pylist(), batch.column("text")):
            t = Template(text.as_py(), memory)
            own = [min(window, len(t.hashes))] if lengths is None else lengths
            if lengths is None and own[0] and t.slotted(window):
                own = [*own, -min(window, len(t.exact))]
            for length in own:
                starts, found = t.windows(length) if length > 0 else t.exact_windows(-length) if length else ((), ())
                total = len(starts)
                if hashes is not None and total:
                    at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
                    starts, found = starts[hashes[at] == found], found[hashes[at] == found]
                for s, h in zip(starts, found):
                    shown = (t.text(s, length), t.values(s, length)) if length > 0 else (t.exact_text(s, -length), [])
                    rows.append((i, mark, int(s), length, total, int(np.int64(np.uint64(h).view(np.int64))), *shown))
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _WINDOWS)], schema=_WINDOWS)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _WINDOWS)], schema=_WINDOWS)


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(known_id(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def contamination(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """Table (id, mark, item_id, windows, item_windows, changed): items found in a document.

    ``windows`` of the ``item_windows`` windows of the item are in the document in line with each other, their slots
    filled consistently (equal fillings of the item are equal in the document); ``changed`` says whether a filling
    differs. An item counts as found at half its windows, or at ``ENOUGH_WINDOWS``. Items shorter than the window are one
    window. Slots of a window are free to differ if it has ``LEAST_OWN`` tokens of its own, one of them a word, or, as the whole of a
    document, ``LEAST_WHOLE``: of ``Who is Mary?`` only the words themselves are looked for. Marks of arithmetic beside a number are tokens. An item with a window of too few words of its own (numbers, lists of names, capitals) is also looked for word by word,
    without slots and in any case, by the same count over all its windows; null texts and texts without a word match nothing. ``mark`` is a hash of the text, so rows with equal ids
    stay apart. Null ids are the largest whole number. Other columns are ignored; empty tables give an empty result.
    """
    spark = df.sparkSession
    items = _rows(benchmark, item_id_col, item_text_col).mapInArrow(partial(_windows, lengths=None, window=window, known=None), _WINDOWS_DDL)
    items = materialise(items, "templates").select(
        F.col("id").alias("item_id"), F.col("mark").alias("item_mark"), F.col("pos").alias("item_pos"), "length", F.col("total").alias("item_windows"), "hash", "template", F.col("slots").alias("item_slots"),
    )
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())
    hashes = [r[0] for r in items.select("hash").distinct().limit(broadcast_windows + 1).collect()]
    known = spark.sparkContext.broadcast(np.sort(np.array(hashes, np.int64).view(np.uint64))) if len(hashes) <= broadcast_windows else None
    windows = _rows(df, id_col, text_col).mapInArrow(partial(_windows, lengths=lengths if hashes else [], window=window, known=known), _WINDOWS_DDL)
    met = windows.drop("total").join(items, ["hash", "length", "template"])
    met = met.withColumns({"line": F.col("pos") - F.col("item_pos"), "filled": F.zip_with("item_slots", "slots", lambda was, now: F.struct(was.alias("was"), now.alias("now")))})
    lined = met.groupBy("id", "mark", "item_id", "item_mark", "item_windows", (F.col("length") < 0).alias("exact"), "line").agg(
        F.count_distinct("item_pos").alias("windows"), F.array_distinct(F.flatten(F.collect_set("filled"))).alias("filled"),
    )
    lined = lined.where(F.size(F.array_distinct("filled.was")) == F.size("filled"))
    lined = lined.where(F.col("windows") >= F.least(F.lit(ENOUGH_WINDOWS), F.ceil(F.col("item_windows") / 2)))
    lined = lined.withColumn("changed", F.exists("filled", lambda x: x["was"] != x["now"]))
    return lined.groupBy("id", "mark", "item_id").agg(F.max("windows").alias("windows"), F.max("item_windows").alias("item_windows"), F.min("changed").alias("changed"))


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``df`` in which no benchmark item is found; null and empty texts stay."""
    found = materialise(contamination(df, benchmark, id_col, text_col, **how).select("id", "mark").distinct(), "contaminated")
    marked = df.withColumns({"_id": known_id(id_col), "_mark": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    return marked.join(found, (marked["_id"] == found["id"]) & (marked["_mark"] == found["mark"]), "left_anti").drop("_id", "_mark")
