"""Settings: defaults, overridden by LEADWEAVE_* variables of the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    name_threshold: float = 0.78
    edge_threshold: float = 0.65
    max_block: int = 100
    concurrent_requests: int = 10
    domain_delay: float = 2.0
    frontier_delay: int = 5
    max_depth: int = 3
    max_failures: int = 5
    max_search_pages: int = 3
    models: tuple[str, ...] = ()
    proxies: tuple[str, ...] = ()

    @classmethod
    def from_environment(cls, environment: dict[str, str] | None = None) -> Settings:
        """Lists are comma-separated, blanks dropped."""
        env = os.environ if environment is None else environment
        given = {}
        for f in fields(cls):
            if (raw := env.get(f"LEADWEAVE_{f.name.upper()}")) is not None:
                kind = type(f.default)
                given[f.name] = tuple(x.strip() for x in raw.split(",") if x.strip()) if kind is tuple else kind(raw)
        return cls(**given)
