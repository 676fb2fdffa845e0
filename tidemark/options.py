"""Settings of a store."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Options:
    """Settings; a number that isn't positive falls back to its default.

    Sizes are logical bytes of records, as in the file metadata. The defaults suit small stores; for
    Parquet on a cluster, set target_file_size and base_level_size to hundreds of MiB and more.
    """

    memtable_size: int = 4 << 20
    l0_compaction_trigger: int = 4
    base_level_size: int = 10 << 20
    level_size_multiplier: int = 10
    target_file_size: int = 2 << 20
    bloom_bits_per_key: int = 10
    block_size: int = 4096
    max_levels: int = 7
    sync_wal: bool = True
    compact_interval: float = 0.05

    def __post_init__(self) -> None:
        for f in fields(self):
            if not isinstance(f.default, bool) and getattr(self, f.name) <= 0:
                object.__setattr__(self, f.name, f.default)
        if self.max_levels < 2:
            raise ValueError("a store has at least two levels")

    def level_target_size(self, level: int) -> int:
        """Bytes that a level may hold before it is compacted; level 0 is ruled by its file count."""
        return 0 if level <= 0 else self.base_level_size * self.level_size_multiplier ** (level - 1)
