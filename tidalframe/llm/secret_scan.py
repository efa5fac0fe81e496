"""Secret scans: base patterns, and sliding entropy windows per character class; built-in functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _any_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


@dataclass(frozen=True)
class BasePattern:
    """Matches, leftmost and not overlapping; those stay whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


@dataclass(frozen=True)
class EntropyClass:
    """Candidates are maximal strings of ``window`` or more of the characters; a window is random from ``bits`` a character on.

    With ``fold`` the two cases of a letter are one symbol.
    """

    kind: str
    characters: str
    alphabet: str
    window: int
    bits: float
    fold: bool = False

    @property
    def pattern(self) -> str:
        return f"[{self.characters}]{{{self.window},}}"


ASSIGN = _any_case("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A maximal string under the least length cannot hold a match, so the lengths of these two stand in the pattern.
BASE_PATTERNS = (BasePattern("assign", ASSIGN, 2, 8), BasePattern("access", "AKIA[A-Z0-9]{12,}"), BasePattern("hex", "[0-9a-f]{32,}"))
BASE_KINDS = tuple(p.kind for p in BASE_PATTERNS)

_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENTROPY_CLASSES = (
    EntropyClass("entropy_hex", "0-9a-fA-F", _DIGITS + "abcdef", 24, 3.0, fold=True),
    EntropyClass("entropy_alnum", "0-9a-z", _DIGITS + _LOWER, 24, 3.9),
    EntropyClass("entropy_base64", "A-Za-z0-9+/_-", _LOWER.upper() + _LOWER + _DIGITS + "+/_-", 32, 4.3),
)
# Candidates that are no secrets: numbers, parts of identifiers of the UUID form, alphabets written out, plain words with
# separators, keys of documentation.
ALLOW_LIST = (
    "^[0-9]+$", "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", "^(0123456789|abcdef(ghijklmnopqrstuvwxyz)?|ABCDEF(GHIJKLMNOPQRSTUVWXYZ)?|[+/_-])+$",
    "^/?([a-z]+[/_-])+[a-z]*$", "EXAMPLE(KEY)?$",
)

# Entropies are compared as whole numbers, so that sums of many windows stay exact.
_SCALE = 1 << 20


def _weight(n: int) -> int:
    return round(n * math.log2(n) * _SCALE) if n else 0


def _most(c: EntropyClass) -> int:
    """A window has ``bits`` or more a character where the weights of its counts sum to this or less."""
    return math.floor(c.window * (math.log2(c.window) - c.bits) * _SCALE)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, also where ``use`` looks at it for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(lengths: Column, block: int = 128) -> Column:
    """Sums of all lengths before each, with a block's sums copied on at most ``block`` times."""
    zero = F.lit(0).cast("bigint")

    def sums(values: Column, start: Column) -> Column:
        grown = F.aggregate(values, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.slice(grown, F.lit(1), F.size(values))

    def blocks(values: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), lambda i: F.slice(values, i * block + 1, F.lit(block)))
        return _let(parts, lambda p: _let(
            sums(F.transform(p, lambda v: F.aggregate(v, zero, lambda a, x: a + x)), zero),
            lambda starts: F.flatten(F.transform(p, lambda v, i: sums(v, F.get(starts, i))))))

    return _let(lengths, lambda values: F.when(F.size(values) > 0, blocks(values)).otherwise(F.array().cast("array<bigint>")))


def _matches(text: Column, pattern: str) -> Column:
    """Array of (start, found) of all matches of a pattern that is never empty; starts count code points."""

    def place(found: Column) -> Column:
        def starts(between: Column) -> Column:
            steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, m: (F.length(b) + F.length(m)).cast("bigint"))
            return _let(_running(steps), lambda before: F.transform(found, lambda m, i: F.struct((F.get(before, i) + F.length(F.get(between, i))).alias("start"), m.alias("found"))))

        return _let(F.split(text, pattern, -1), starts)

    none = F.array().cast("array<struct<start:bigint,found:string>>")
    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, place(found)).otherwise(none))


def _span(rank: int, start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))


def _base_spans(text: Column, p: BasePattern, rank: int) -> Column:
    found = _matches(text, p.pattern)
    if p.least > 1:
        found = F.filter(found, lambda m: F.length(F.regexp_extract(m["found"], p.pattern, p.group)) >= p.least)
    return F.transform(found, lambda m: _span(rank, m["start"], m["start"] + F.length(m["found"])))


def _random_part(candidate: Column, c: EntropyClass) -> Column:
    """From the first to the last window of a candidate whose entropy is high enough: struct (first, last); nulls if none.

    One pass: the symbol that enters a window and the one that leaves it change their counts, and the sum of n log n over
    the counts by just these differences.
    """
    weights = F.array(*[F.lit(_weight(n)) for n in range(c.window + 1)])
    text = F.lower(candidate) if c.fold else candidate
    codes = F.transform(F.split(text, ""), lambda x: F.instr(F.lit(c.alphabet), x) - 1)
    start = F.struct(
        F.array_repeat(F.lit(0), len(c.alphabet)).alias("counts"), F.lit(0).cast("bigint").alias("sum"), F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("last"),
    )

    def step(codes: Column, acc: Column, i: Column) -> Column:
        enters, leaves = F.get(codes, i), F.when(i >= c.window, F.get(codes, i - c.window))
        less, more = F.get(acc["counts"], leaves), F.get(acc["counts"], enters) - F.when(enters.eqNullSafe(leaves), 1).otherwise(0)
        change = F.coalesce(F.get(weights, less - 1) - F.get(weights, less), F.lit(0)) + F.get(weights, more + 1) - F.get(weights, more)
        counts = F.transform(acc["counts"], lambda n, k: n + F.when(k == enters, 1).otherwise(0) - F.when(k.eqNullSafe(leaves), 1).otherwise(0))
        random = (i >= c.window - 1) & (acc["sum"] + change <= _most(c))
        first = F.coalesce(acc["first"], F.when(random, (i - c.window + 1).cast("bigint")))
        return F.struct(counts.alias("counts"), (acc["sum"] + change).alias("sum"), first.alias("first"), F.when(random, (i + 1).cast("bigint")).otherwise(acc["last"]).alias("last"))

    return _let(codes, lambda x: F.aggregate(F.sequence(F.lit(0), F.size(x) - 1), start, lambda acc, i: step(x, acc, i)))


def _entropy_spans(text: Column, c: EntropyClass, rank: int, allow_list: tuple[str, ...]) -> Column:
    found = _matches(text, c.pattern)
    if allow_list:
        found = F.filter(found, lambda m: ~reduce(Column.__or__, [m["found"].rlike(a) for a in allow_list]))

    def span(m: Column) -> Column:
        return _let(_random_part(m["found"], c), lambda r: F.when(r["first"].isNotNull(), _span(rank, m["start"] + r["first"], m["start"] + r["last"])))

    return F.filter(F.transform(found, span), lambda s: s.isNotNull())


def secret_scan(df: DataFrame, text_col: str = "text", base_patterns=BASE_PATTERNS, entropy_classes=ENTROPY_CLASSES, allow_list: tuple[str, ...] = ALLOW_LIST) -> DataFrame:
    """The columns of ``df`` with spans: array of (kind, start, end) by start, then kind in the order given, in code points.

    Base patterns give all their matches. Each entropy class adds, of every candidate that no pattern of ``allow_list``
    fits, the part from its first to its last window of high Shannon entropy; candidates of several classes, and of base
    patterns, may give spans in the same place. A null or empty text has no spans. Rows are judged one by one, so nothing is
    shuffled; repeated rows give repeated results. A column named spans is replaced, all others stay. An empty table gives an empty one.
    """
    kinds = [p.kind for p in [*base_patterns, *entropy_classes]]
    text = F.col(text_col).cast("string")
    parts = [_base_spans(text, p, i) for i, p in enumerate(base_patterns)]
    parts += [_entropy_spans(text, c, i, tuple(allow_list)) for i, c in enumerate(entropy_classes, len(base_patterns))]
    names = F.array(*map(F.lit, kinds))
    spans = F.transform(F.array_sort(F.concat(*parts)), lambda s: F.struct(F.get(names, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return df.withColumn("spans", F.coalesce(spans, none))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _found_sql(rank: int, kind: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, regexp_extract_all(t, '{quoted}') AS m, regexp_split_to_array(t, '{quoted}') AS b FROM docs"


_ALLOWED_SQL = " OR ".join(f"regexp_matches(found, '{a}')" for a in ALLOW_LIST)
_CLASSES_SQL = ", ".join(f"({len(BASE_PATTERNS) + i}, {c.window}, {_most(c)}, {str(c.fold).lower()})" for i, c in enumerate(ENTROPY_CLASSES))
ORACLE = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_found_sql(i, p.kind, p.pattern) for i, p in enumerate([*BASE_PATTERNS, *ENTROPY_CLASSES]))}),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found),
placed AS (SELECT doc_id, rank, kind, m[i] AS found, coalesce(list_sum(list_transform(b[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s FROM each),
classes(rank, w, most, fold) AS (VALUES {_CLASSES_SQL}),
windows AS (SELECT doc_id, rank, kind, s, w, most, CASE WHEN fold THEN lower(found) ELSE found END AS x, unnest(range(length(found) - w + 1)) AS o
  FROM placed JOIN classes USING (rank) WHERE NOT ({_ALLOWED_SQL})),
symbols AS (SELECT doc_id, rank, kind, s, w, most, o, unnest(string_split(substr(x, o + 1, w), '')) AS c FROM windows),
counts AS (SELECT doc_id, rank, kind, s, w, most, o, c, count(*) AS n FROM symbols GROUP BY ALL),
random AS (SELECT doc_id, rank, kind, s, w, o FROM counts GROUP BY doc_id, rank, kind, s, w, most, o HAVING sum(round(n * log2(n) * {_SCALE})) <= most),
spans AS (
  SELECT doc_id, rank, kind, s::BIGINT AS s, (s + length(found))::BIGINT AS e FROM placed
  WHERE rank < {len(BASE_PATTERNS)} AND (kind <> 'assign' OR length(regexp_extract(found, '{ASSIGN.replace("'", "''")}', 2)) >= 8)
  UNION ALL SELECT doc_id, rank, kind, (s + min(o))::BIGINT, (s + max(o) + w)::BIGINT FROM random GROUP BY doc_id, rank, kind, s, w),
said AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)},
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < {len(BASE_PATTERNS)}) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM spans GROUP BY doc_id)
SELECT documents.doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN said USING (doc_id)
"""
