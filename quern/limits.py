"""The environment's limits, in one validated place."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Limits:
    max_turns: int = 10
    context_tokens: int = 16384
    observation_tokens: int = 1024
    tables: int = 128
    columns: int = 128
    foreign_keys: int = 128
    inspect_values: int = 50
    rows: int = 50
    cell_chars: int = 512
    sql_chars: int = 32768
    query_seconds: float = 2.0
    verifier_seconds: float = 5.0
    verifier_rows: int = 100_000
    verifier_bytes: int = 64 * 1024 * 1024

    def __post_init__(self):
        for f in fields(self):
            if not getattr(self, f.name) > 0:
                raise ValueError(f"{f.name} must be positive")

    @classmethod
    def from_dict(cls, values: dict) -> Limits:
        unknown = sorted(set(values) - {f.name for f in fields(cls)})
        if unknown:
            raise ValueError(f"unknown limits: {', '.join(unknown)}")
        return cls(**values)
