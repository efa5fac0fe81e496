"""Merkle dataset manifest: every row a leaf, a tree for each group, one root, and a proof for each leaf.

Trees grow by slot pivots: conditional aggregates spread the children of a parent into slot columns. A pivot takes the
slots of several levels at once, so a table of N rows needs log N / log ``SLOTS`` shuffles, the first of which moves all
leaves and each further one a ``SLOTS``-th of the one before. Inside a pivot, the slots of a run, concatenated, are hashed
to their parent; without the own slot they are the siblings that a proof needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalframe.llm.common import CRC32_SQL, crc32_sql, known_id, materialise, partitions

FANOUT = 2
SLOTS = 16


def _hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 in hex of the values, each as its UTF-8 byte count, a colon and its text; a null is a hyphen."""
    values = [c.cast("string") for c in columns]
    return _hash(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its proof lead to."""

    def parent(node: Column, step: Column) -> Column:
        before = F.slice(step["siblings"], F.lit(1), step["place"])
        after = F.slice(step["siblings"], step["place"] + 1, F.size(step["siblings"]) - step["place"])
        return _hash(F.concat(F.array_join(before, ""), node, F.array_join(after, "")))

    return F.aggregate(proof, leaf, parent)


def proof_text(proof: Column) -> Column:
    """All siblings of a proof, from the leaf to the root, left to right."""
    return F.array_join(F.flatten(F.transform(proof, lambda step: step["siblings"])), "")


def _numbered(rows: DataFrame, order: list[str], fanout: int) -> DataFrame:
    """(group, pos, height, node, carry): place of each row in its group, and the levels above its leaves.

    Rows are dealt out by ranges of (group, order) and counted by range, so no group is one task; ``order`` tells all rows
    apart. The counts have a row for each range and group that meet; Spark's own size check decides how they are joined.
    """
    ordered = rows.repartitionByRange(partitions(rows.sparkSession), "group", *order).sortWithinPartitions("group", *order)
    ordered = materialise(ordered.select("group", "node", "carry", F.monotonically_increasing_id().alias("at")), "merkle-ordered")
    ordered = ordered.withColumn("range", F.shiftright("at", 33))
    counts = ordered.groupBy("group", "range").agg(F.count("*").alias("n"), F.min("at").alias("least"))
    group = Window.partitionBy("group")
    counts = counts.withColumns({"shift": F.sum("n").over(group.orderBy("range")) - F.col("n") - F.col("least"), "total": F.sum("n").over(group)})
    powers = [fanout**k for k in range(64) if fanout**k < 1 << 62]
    height = F.size(F.filter(F.array(*map(F.lit, powers)), lambda p: p < F.col("total")))
    counts = materialise(counts.select("group", "range", "shift", height.alias("height")), "merkle-counts")
    return ordered.join(counts, ["group", "range"]).select("group", (F.col("at") + F.col("shift")).alias("pos"), "height", "node", "carry")


def _parents(nodes: Column, fanout: int) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fanout).cast("int"))
    return F.transform(runs, lambda i: _hash(F.array_join(F.slice(nodes, i * fanout + 1, F.lit(fanout)), "")))


def _step(nodes: Column, at: Column, fanout: int) -> Column:
    """Place of node ``at`` in its run, and the run without its column."""
    place = at % fanout
    run = F.slice(nodes, at - place + 1, F.lit(fanout))
    return F.struct(place.alias("place"), F.filter(run, lambda _, i: i != place).alias("siblings"))


def _climb(nodes: DataFrame, height: int, fanout: int, levels: int) -> list[DataFrame]:
    """Tables (group, block, height, slots, level_0 .. level_n) of all pivots; level_n of the last one holds the roots."""
    slots, out = fanout**levels, []
    for done in range(0, max(height, 1), levels):
        slot = F.col("pos") % slots
        columns = [F.max(F.when(slot == j, F.struct("node", "carry"))).alias(f"slot_{j}") for j in range(slots)]
        blocks = nodes.groupBy("group", F.expr(f"pos div {slots}").alias("block")).agg(F.max("height").alias("height"), *columns)
        # children are consecutive: an empty slot has none behind it
        blocks = blocks.select("group", "block", "height", F.filter(F.array(*[f"slot_{j}" for j in range(slots)]), lambda x: x.isNotNull()).alias("slots"))
        blocks = blocks.withColumn("level_0", F.transform("slots", lambda x: x["node"]))
        for k in range(levels):
            below = F.col(f"level_{k}")
            blocks = blocks.withColumn(f"level_{k + 1}", F.when(F.col("height") > done + k, _parents(below, fanout)).otherwise(below))
        out.append(materialise(blocks, "merkle-blocks"))
        nodes = out[-1].select("group", F.col("block").alias("pos"), "height", F.get(f"level_{levels}", F.lit(0)).alias("node"), F.lit(None).cast("string").alias("carry"))
    return out


def _descend(tables: list[DataFrame], tops: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Rows (group, node, carry, proof, ...) of all leaves; ``tops`` has (group, proof, ...) of the roots of the groups."""
    more = [c for c in tops.columns if c not in ("group", "proof")]
    paths = tops.withColumn("block", F.lit(0).cast("bigint"))
    for k in reversed(range(len(tables))):
        met = tables[k].join(paths, ["group", "block"])
        met = met.select("*", F.posexplode("slots").alias("slot", "child"))
        steps = [F.when(F.col("height") > k * levels + j, _step(F.col(f"level_{j}"), F.expr(f"slot div {fanout**j}").cast("int"), fanout)) for j in range(levels)]
        proof = F.concat(F.filter(F.array(*steps), lambda x: x.isNotNull()), "proof")
        block = (F.col("block") * fanout**levels + F.col("slot")).alias("block")
        paths = met.select("group", block, F.col("child.node").alias("node"), F.col("child.carry").alias("carry"), proof.alias("proof"), *more)
        if k:
            paths = paths.drop("node", "carry")
    return paths


_PROOF = "array<struct<place:int,siblings:array<string>>>"


def _forest(rows: DataFrame, order: list[str], fanout: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The pivots of all groups, and their roots (group, node)."""
    nodes = _numbered(rows, order, fanout)
    height = nodes.agg(F.max("height")).first()[0] or 0
    tables = _climb(nodes, height, fanout, levels)
    return tables, tables[-1].select("group", F.get(f"level_{levels}", F.lit(0)).alias("node"))


def merkle_manifest(df: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "lang", claims: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row per row: id, leaf, subroot, root, proof, and the columns ``claims`` (expressions over ``df``).

    A leaf is the hash of the values of ``columns``. In each group (value of ``group_col``) leaves ascend by id, and runs of
    ``fanout`` consecutive nodes (the last of a level may have fewer, even one) become their hash until one is left, the
    subroot. Subroots in order of their groups, null first, then by bytes, become the root in the same way. ``proof`` has a
    step for every level from the leaf to the root: ``place`` of the own node in its run, and its ``siblings``.

    Null ids come last in their group, rows with equal ids in order of their leaves; equal rows have equal leaves and each
    its own proof. Null and empty values have different leaves. Ids must be whole numbers. Other columns are ignored, an empty table gives an
    empty one. The text of a row is read once; after that only hashes move.
    """
    if fanout < 2:
        raise ValueError("a parent has two children at least")
    levels = 1
    while fanout ** (levels + 1) <= SLOTS:
        levels += 1
    names = list(claims or {})
    carry = F.struct(F.col(id_col).cast("bigint").alias("id"), *[F.struct(*[c.alias(f"c{i}") for i, c in enumerate((claims or {}).values())]).alias("claims")] * bool(names))
    group = F.when(F.col(group_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    rows = df.select(group.alias("group"), known_id(id_col).alias("order"), leaf_digest([F.col(c) for c in columns]).alias("node"), carry.alias("carry"), F.monotonically_increasing_id().alias("row"))
    tables, subroots = _forest(materialise(rows, "merkle-leaves"), ["order", "node", "row"], fanout, levels)
    above, root = _forest(subroots.select(F.lit("").alias("group"), F.col("group").alias("order"), "node", F.col("group").alias("carry")), ["order"], fanout, levels)
    root = root.select("group", F.col("node").alias("root"), F.array().cast(_PROOF).alias("proof"))
    tops = _descend(above, root, fanout, levels)
    tops = tops.select(F.col("carry").alias("group"), F.col("node").alias("subroot"), "root", "proof")
    out = _descend(tables, tops, fanout, levels)
    kept = [F.col(f"carry.claims.c{i}").alias(n) for i, n in enumerate(names)]
    return out.select(F.col("carry.id").alias("id"), F.col("node").alias("leaf"), "subroot", "root", "proof", *kept)


MANIFEST = ["doc_id", "source", "lang", "n_chars", "text"]


def _leaf_sql(n_chars: str = "n_chars") -> str:
    values = [f"{c}::VARCHAR" for c in ("doc_id", "source", "lang", n_chars, "text")]
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + "))"


ORACLE = f"""
WITH RECURSIVE {CRC32_SQL},
docs AS (SELECT doc_id, lang, {_leaf_sql()} AS leaf,
  CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} ELSE {_leaf_sql()} END AS claimed,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents, crc_table),
tree AS (SELECT lang, 0 AS level, pos, n, leaf AS h FROM docs
  UNION ALL SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY lang, level, pos // 2, n),
subroots AS (SELECT lang, level AS height, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS level, pos, n, subroot AS h FROM subroots
  UNION ALL SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 2, n),
steps AS (
  SELECT doc_id, t.level, (docs.pos >> t.level) & 1 AS side, t.h FROM docs JOIN tree t ON docs.lang IS NOT DISTINCT FROM t.lang AND t.pos = xor(docs.pos >> t.level, 1)
  UNION ALL SELECT doc_id, s.height + t.level, (s.pos >> t.level) & 1, t.h FROM docs JOIN subroots s ON docs.lang IS NOT DISTINCT FROM s.lang JOIN top t ON t.pos = xor(s.pos >> t.level, 1)),
proofs AS (SELECT doc_id, string_agg(h, '' ORDER BY level) AS proof FROM steps GROUP BY doc_id),
heights AS (SELECT max(level) AS top_height, any_value(h ORDER BY level DESC) AS root FROM top WHERE n = 1),
folds AS (SELECT doc_id, 0 AS level, s.height + top_height AS height, claimed AS h FROM docs JOIN subroots s ON docs.lang IS NOT DISTINCT FROM s.lang, heights
  UNION ALL SELECT f.doc_id, f.level + 1, height, sha256(CASE s.side WHEN 1 THEN s.h || f.h WHEN 0 THEN f.h || s.h ELSE f.h END)
    FROM folds f LEFT JOIN steps s ON f.doc_id = s.doc_id AND f.level = s.level WHERE f.level < height)
SELECT docs.doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folds.h AS folded_root, folds.h = root AS verified
FROM docs JOIN subroots s ON docs.lang IS NOT DISTINCT FROM s.lang JOIN folds ON docs.doc_id = folds.doc_id AND folds.level = folds.height
LEFT JOIN proofs ON docs.doc_id = proofs.doc_id, heights
"""
