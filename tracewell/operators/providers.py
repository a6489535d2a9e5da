"""What the reference leaves to models, as an interface; the default answers nothing, so that the structural paths decide.

A provider runs on executors and must be picklable. An error that a job must not go on after is raised as
``FatalProviderError``; any other leaves the link without spans.
"""

from __future__ import annotations

from tracewell.operators.alignment import Span


class FatalProviderError(Exception):
    """Quota, key or connection: the job fails."""


class Provider:
    """No model: no units, no groups, every span accepted, nothing recovered."""

    def units(self, description: str) -> list[str]:
        return []

    def groups(self, description: str, quote: str, level: str) -> list[tuple[str, list[str]]]:
        return []

    def verify(self, description: str, quote: str, spans: list[Span], thresholds: tuple[float, float, float]) -> list[Span]:
        return spans

    def recover(self, description: str, quote: str, spans: list[Span]) -> list[Span]:
        return []
