"""Settings from the environment, each with a default."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """A field is read from the variable LEDGERLARK_<NAME>; blanks around values go, empty ones count as unset."""

    raw_dir: str = "data/raw"
    parsed_dir: str = "data/parsed"
    index_dir: str = "data/index"
    filing_type: str = "10-K"
    max_chunk_tokens: int = 1000
    chunk_overlap: int = 2
    final_k: int = 3

    @classmethod
    def load(cls, env: dict[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        found = {f.name: v for f in fields(cls) if (v := env.get(f"LEDGERLARK_{f.name.upper()}", "").strip())}
        return cls(**{f.name: type(f.default)(found[f.name]) for f in fields(cls) if f.name in found})
