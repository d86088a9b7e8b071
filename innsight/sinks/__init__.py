"""Writers: partitioned Parquet, sorted and single CSV, catalog tables, and typed read-back."""

from innsight.sinks.writers import (
    read_partitioned,
    save_partitioned_table,
    write_partitioned,
    write_single_csv,
    write_sorted_csv,
)

__all__ = ["read_partitioned", "save_partitioned_table", "write_partitioned", "write_single_csv", "write_sorted_csv"]
