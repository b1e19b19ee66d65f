"""Job settings. Plain frozen dataclasses; every default is overridable per call."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Enrichment:
    seed: int = 17
    device_pool_size: int = 16
    suspicious_device_pool_size: int = 4
    ip_pool_size: int = 64
    suspicious_ip_pool_size: int = 8
    merchant_pool_size: int = 24


@dataclass(frozen=True)
class Temporal:
    windows: tuple[int, ...] = (1, 7, 30)
    recent_window: int = 7
    baseline_window: int = 30
    drift_top_k: int = 10


@dataclass(frozen=True)
class GraphJob:
    communities: bool = True
    community_seed: int = 42
    embedding_dimensions: int = 16
    embedding_seed: int = 42
    damping: float = 0.85


@dataclass(frozen=True)
class ModelJob:
    seed: int = 42
    test_size: float = 0.25
    max_iter: int = 1000
    num_trees: int = 200
    # Spark's forest cannot grow past depth 30
    max_depth: int = 30


@dataclass(frozen=True)
class Settings:
    enrichment: Enrichment = Enrichment()
    temporal: Temporal = Temporal()
    graph: GraphJob = GraphJob()
    model: ModelJob = ModelJob()


def checked_windows(windows) -> tuple[int, ...]:
    """Sorted distinct windows; the ratio features compare window 1 with the longest."""
    result = tuple(sorted({int(w) for w in windows}))
    if not result or result[0] != 1:
        raise ValueError("windows must contain 1, it is the numerator of the ratio features")
    return result
