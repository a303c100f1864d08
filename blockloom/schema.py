"""Tables of the data model.

``ROWS``: one record per aligned row.  ``block_id`` orders blocks, ``row_index``
orders rows inside a block (0 is the reference), coordinates are 0-based and on
the row's own strand, ``length`` counts the bases that aren't gaps.  ``TAGS``
holds the tagged columns only.
"""

ROWS = "block_id bigint, row_index bigint, sequence_name string, start bigint, length bigint, strand boolean, sequence_length bigint, bases string"
TAGS = "block_id bigint, col bigint, tags array<struct<key: string, value: string>>"
ROW_COLUMNS = [c.split()[0] for c in ROWS.split(", ")]
