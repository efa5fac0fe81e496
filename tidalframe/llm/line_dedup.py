"""Line deduplication by content-defined chunks of lines; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidalframe.llm.common import known_id, materialise

# A chunk has about so many lines.
CHUNK_LINES = 3
LEAST_LINES = 2


def _chunks(df: DataFrame, text_col: str, chunk_lines: int) -> DataFrame:
    """``df`` with column _chunks: array of (pos, lines, text).

    A chunk ends before a line where the rolling hash over the hashes of the line and the one before it is 0 modulo
    ``chunk_lines``, so a change in the text moves no boundary but those beside it.
    """
    df = df.withColumn("_lines", F.split(F.col(text_col).cast("string"), "\n", -1))
    df = df.withColumn("_hashes", F.transform("_lines", lambda x: F.md5(x.cast("binary"))))

    def starts(i: Column) -> Column:
        rolled = F.md5(F.concat(F.get("_hashes", i - 1), F.get("_hashes", i)).cast("binary"))
        return (i == 0) | (F.conv(F.substring(rolled, 1, 6), 16, 10).cast("bigint") % chunk_lines == 0)

    df = df.withColumn("_starts", F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), starts))

    def chunk(start: Column, pos: Column) -> Column:
        end = F.coalesce(F.get("_starts", pos + 1), F.size("_lines"))
        return F.struct(pos.alias("pos"), (end - start).alias("lines"), F.array_join(F.slice("_lines", start + 1, end - start), "\n").alias("text"))

    return df.withColumn("_chunks", F.transform("_starts", chunk)).drop("_lines", "_hashes", "_starts")


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_lines: int = CHUNK_LINES, least_lines: int = LEAST_LINES) -> DataFrame:
    """Remove every chunk of ``least_lines`` lines or more that is also found at an earlier place (id, then position).

    Returns the columns of ``df`` with the text replaced, and n_lines, n_removed (lines). Chunks meet by hash; a chunk
    goes only where its bytes are equal. A null text stays null and has no lines; an empty text is one empty line;
    a text that loses all its chunks becomes empty. Null ids come last. Rows equal in id and text are one document:
    neither removes the other. Columns named n_lines or n_removed are replaced. An empty table gives an empty one.
    """
    named = {"_id": known_id(id_col), "_hash": F.xxhash64(F.col(text_col).cast("string"))}
    rows = _chunks(df.select(id_col, text_col).withColumns(named), text_col, chunk_lines)
    # the outer form: for the other one the optimizer would add a filter that works out the chunks a second time, nested
    rows = rows.select("_id", "_hash", F.explode_outer("_chunks").alias("c")).where(F.col("c.lines") >= least_lines)
    place = F.struct("_id", "_hash", "pos")
    rows = rows.select("_id", "_hash", F.col("c.pos").alias("pos"), F.xxhash64("c.text").alias("chunk"), F.col("c.text").alias("chunk_text"))
    met = rows.groupBy("chunk").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high")
    # both tables that documents meet grow with them, so they are never broadcast: one plan at every size
    again = materialise(rows.join(met.select("chunk").hint("merge"), "chunk"), "lines-chunks")
    # equal bytes, not only equal hashes
    first = again.groupBy("chunk", "chunk_text").agg(F.min(place).alias("first"))
    gone = again.join(first, ["chunk", "chunk_text"]).where(place != F.col("first"))
    gone = gone.groupBy("_id", "_hash").agg(F.collect_set("pos").alias("_gone"))
    kept = df.withColumns(named).join(materialise(gone, "lines-gone").hint("merge"), ["_id", "_hash"], "left")
    kept = _chunks(kept, text_col, chunk_lines).withColumn("_gone", F.coalesce("_gone", F.array().cast("array<int>")))
    lines = lambda chunks: F.coalesce(F.aggregate(chunks, F.lit(0).cast("bigint"), lambda n, c: n + c["lines"]), F.lit(0).cast("bigint"))
    left = F.filter("_chunks", lambda c: ~F.array_contains("_gone", c["pos"]))
    kept = kept.withColumns({text_col: F.array_join(F.transform(left, lambda c: c["text"]), "\n"), "n_lines": lines(F.col("_chunks")), "n_removed": lines(F.col("_chunks")) - lines(left)})
    return kept.select(*dict.fromkeys([*df.columns, "n_lines", "n_removed"]))


ORACLE = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
i AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS k FROM d),
h AS (
  SELECT doc_id, k, l[k] AS line,
    CASE WHEN k = 1 OR ('0x' || substr(md5(md5(l[k - 1]) || md5(l[k])), 1, 6))::BIGINT % {CHUNK_LINES} = 0 THEN 1 ELSE 0 END AS s FROM i),
c AS (SELECT doc_id, k, line, sum(s) OVER (PARTITION BY doc_id ORDER BY k) AS pos FROM h),
g AS (SELECT doc_id, pos, count(*) AS lines, string_agg(line, chr(10) ORDER BY k) AS chunk FROM c GROUP BY doc_id, pos),
r AS (SELECT *, lines >= {LEAST_LINES} AND row_number() OVER (PARTITION BY chunk, lines >= {LEAST_LINES} ORDER BY doc_id, pos) > 1 AS gone FROM g)
SELECT documents.doc_id, coalesce(sum(lines), 0)::BIGINT AS n_lines, coalesce(sum(lines) FILTER (gone), 0)::BIGINT AS n_removed,
  CASE WHEN documents.text IS NOT NULL THEN sha256(coalesce(string_agg(chunk, chr(10) ORDER BY pos) FILTER (NOT gone), '')) END AS kept_sha256
FROM documents LEFT JOIN r ON documents.doc_id = r.doc_id GROUP BY documents.doc_id, documents.text
"""
