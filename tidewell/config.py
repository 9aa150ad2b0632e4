"""Settings that change what queries return or what is accepted."""

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    max_query_limit: int = 10_000
    default_range_hours: int = 24
    retention_days: int = 90
    max_body_bytes: int = 1 << 20
    max_text_units: int = 256
    batch_files: int = 10_000
    flush_seconds: int = 3
    max_retries: int = 5
    backoff_ceiling_ms: int = 30_000
