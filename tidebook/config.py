"""Settings of a ledger service and their bounds."""

from __future__ import annotations

from dataclasses import dataclass, fields

from tidebook.schemas import MAX_BATCH, MAX_SHARDS

SECOND = 1_000_000
# The least and the greatest of each setting; times in microseconds.
BOUNDS = {
    "shards": (1, MAX_SHARDS),
    "queue": (1, 1_000_000),
    "in_flight": (1, 1_000_000),
    "batch": (1, MAX_BATCH),
    "flush_wait": (1, 5 * SECOND),
    "history_reads": (1, 32),
    "projection_batch": (1, MAX_BATCH),
    "collection_batch": (1, MAX_BATCH),
    "retention": (1, 31_536_000 * SECOND),
    "watermark_interval": (1, 60 * SECOND),
    "lookup_group": (1, MAX_BATCH),
    "lookups_in_flight": (1, 8),
    "checkpoint": (0, 1_000_000_000),
}


@dataclass(frozen=True)
class Settings:
    """Defaults suit one shard; ``check`` runs on creation."""

    shards: int = 1
    queue: int = 50_000
    in_flight: int = 50_000
    batch: int = 2048
    flush_wait: int = 5_000
    history_reads: int = 4
    projection_batch: int = 256
    collection_batch: int = 256
    retention: int = 60 * SECOND
    watermark_interval: int = SECOND
    lookup_group: int = 256
    lookups_in_flight: int = 4
    #: Rows of a shard between snapshots of its balances; 0: balances count as stored with each batch.
    checkpoint: int = 0

    def __post_init__(self) -> None:
        for f in fields(self):
            low, high = BOUNDS[f.name]
            low = self.shards if f.name in ("queue", "in_flight") else low
            if not low <= getattr(self, f.name) <= high:
                raise ValueError(f"{f.name} is {getattr(self, f.name)}; it must lie in {low} to {high}")

    def queue_of(self, shard: int) -> int:
        """The shard's part of the queue; the lowest shards take the remainder."""
        return self.queue // self.shards + (shard < self.queue % self.shards)
