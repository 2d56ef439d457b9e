"""Limits under which documents are read. A document beyond one gives an error and nothing else."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    max_input_bytes: int = 10 * 1024 * 1024
    max_group_depth: int = 256
    max_warnings: int = 1000
    max_rows_per_table: int = 10_000
    max_cells_per_row: int = 1000
    max_merge_span: int = 1000
    max_image_bytes_total: int = 50 * 1024 * 1024
    max_table_nesting_depth: int = 16

    @classmethod
    def unlimited(cls) -> "Limits":
        return cls(*[2**62] * 8)
