"""Text files in the order of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_lines(blocks: DataFrame, path: str, compression: str = "none") -> None:
    """``value`` in the order of ``block_id``, as text files that follow each other; ``bgzf`` gives BGZF blocks, which can be read from the middle."""
    ordered = blocks.repartitionByRange("block_id").sortWithinPartitions("block_id").select("value")
    if compression == "bgzf":
        from blockloom.sources import indexed

        indexed.register(blocks.sparkSession)
        ordered.write.format("bgzf").mode("append").save(path)
    else:
        ordered.write.text(path, compression=compression)
