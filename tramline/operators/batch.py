"""Batch runs: stages in order, the jobs of a stage with each other."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

#: Stages in their order.
STAGES = ("small", "medium", "large", "post-processing", "journey enrichment", "publishing")


def plan(jobs: list[tuple[str, str]]) -> list[list[str]]:
    """(name, stage) to the names of each stage, in order; empty stages are left out."""
    unknown = {s for _, s in jobs} - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    return [names for s in STAGES if (names := sorted(n for n, own in jobs if own == s))]


def run(stages: list[list[str]], job: Callable[[str], object], workers: int = 4) -> dict[str, str]:
    """Each stage waits for the one before; a job that fails stops none of the others."""
    out: dict[str, str] = {}

    def one(name: str) -> tuple[str, str]:
        try:
            job(name)
        except Exception as error:  # noqa: BLE001
            return name, f"failed: {error}"
        return name, "done"

    for names in stages:
        with ThreadPoolExecutor(workers) as pool:
            out |= dict(pool.map(one, names))
    return out
