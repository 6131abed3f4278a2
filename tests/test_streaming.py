"""Counts over blocks of cells that arrive one after the other."""

from hapforge.streaming import arriving_counts


def test_counts_follow_arriving_blocks(spark, tmp_path):
    folder = str(tmp_path / "cells")

    def arrive(cells):
        spark.createDataFrame(cells, "variant_idx bigint, hap_idx bigint").coalesce(1).write.mode("append").parquet(folder)

    arrive([(1, 0), (1, 2), (2, 0)])
    counts = arriving_counts(spark, folder)
    assert counts.isStreaming
    running = counts.writeStream.outputMode("complete").format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        running.processAllAvailable()
        assert {tuple(r) for r in spark.table("arrived").collect()} == {(1, 2), (2, 1)}
        arrive([(2, 5), (3, 1)])
        running.processAllAvailable()
        assert {tuple(r) for r in spark.table("arrived").collect()} == {(1, 2), (2, 2), (3, 1)}
    finally:
        running.stop()
