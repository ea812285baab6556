"""Settings of a sampling run, from keyword arguments or text."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class SampleConfig:
    batch_size: int = 16
    fanouts: tuple[int, ...] = (10, 5)
    epochs: int = 1
    parts: int = 4
    cache_fraction: float = 0.25
    model: str = "mean"
    seed: int = 1

    @classmethod
    def parse(cls, **text: str) -> SampleConfig:
        """Values as text; fan-outs are separated by commas, -1 takes all neighbours."""
        kinds = {f.name: f.type for f in fields(cls)}
        unknown = set(text) - set(kinds)
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        read = {"int": int, "float": float, "str": str, "tuple[int, ...]": lambda t: tuple(int(x) for x in t.split(","))}
        return cls(**{k: read[kinds[k]](v) for k, v in text.items()})
