"""Block tables: every row once, bounded blocks, and their removal."""

from tidalframe.llm.blocks import drop_blocks, unpack, write_blocks


def test_blocks_hold_every_row_and_can_be_dropped(spark):
    df = spark.range(500).selectExpr("id", "repeat('x', CAST(id AS INT)) AS text").unionByName(spark.createDataFrame([(None, None)], "id bigint, text string"))
    blocks = write_blocks(df, "text", "testing", 4096).collect()
    rows = [r for b in blocks for r in unpack(bytes(b.payload)).to_pylist()]
    assert len({b.block for b in blocks}) == len(blocks) > 10
    assert sorted(map(repr, rows)) == sorted(repr(r.asDict()) for r in df.collect())
    drop_blocks(spark, "testing")
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("blocks_testing_")]
