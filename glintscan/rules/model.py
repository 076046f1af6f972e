"""A detection rule."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """``kind`` is ``registry``, ``external`` or ``legacy``; a length, entropy or group of 0 means none."""

    id: str
    name: str
    provider: str
    secret_type: str
    severity: str
    pattern: str
    group: int = 0
    prior: float = 0.5
    min_entropy: float = 0.0
    min_len: int = 0
    max_len: int = 0
    high_fp: bool = False
    requires_context: bool = False
    context: tuple[str, ...] = ()
    validator: str = ""
    kind: str = "registry"
    tags: tuple[str, ...] = ()
