"""Run parameters with the checks that every entry point shares."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

DEFAULT_EPSILON, DEFAULT_PHI, DEFAULT_TAU = 1 / 50000, 1 / 10000, 0.1
#: Nanoseconds of a live run's sampling interval and burst, and the folder of its dumps.
LIVE_INTERVAL, LIVE_LENGTH, DEFAULT_DUMPS = 20_000_000, 2_000_000, "/tmp"


@dataclass(frozen=True)
class SketchParams:
    """Error, hot fraction and coverage fraction, all as fractions of the stream."""

    epsilon: float = DEFAULT_EPSILON
    phi: float = DEFAULT_PHI
    tau: float = DEFAULT_TAU

    def __post_init__(self) -> None:
        for name in ("epsilon", "phi", "tau"):
            if not 0 < getattr(self, name) <= 1:
                raise ValueError(f"{name} must be in (0, 1]")
        if self.phi < self.epsilon:
            raise ValueError("phi must not be below epsilon")

    @classmethod
    def from_reciprocals(cls, phi: int = 10000, epsilon: int = 50000, tau: int = 10) -> SketchParams:
        """From 1/phi, 1/epsilon and 1/tau, the form of trace replays and older dumps."""
        return cls(1 / epsilon, 1 / phi, 1 / tau)

    @classmethod
    def from_environment(cls, env: dict[str, str]) -> SketchParams:
        """EPSILON from an environment; a value outside (0, 1] gives the default."""
        try:
            epsilon = float(env.get("EPSILON", DEFAULT_EPSILON))
        except ValueError:
            epsilon = DEFAULT_EPSILON
        epsilon = epsilon if 0 < epsilon <= 1 else DEFAULT_EPSILON
        return cls(epsilon, min(1.0, max(5 * epsilon, DEFAULT_PHI)))

    @property
    def table_size(self) -> int:
        return table_size(self.epsilon)


@dataclass(frozen=True)
class BurstParams:
    """Sampling interval and burst length in ticks (or nanoseconds); re_enabling 0 turns adaptive bursts off."""

    interval: int = 50
    length: int = 1
    re_enabling: int = 0
    seed: int = 0

    def __post_init__(self) -> None:
        if self.length < 1 or self.interval < self.length or self.interval % self.length:
            raise ValueError("the interval must be a positive multiple of the burst length")
        if self.re_enabling < 0:
            raise ValueError("re_enabling must not be negative")

    @classmethod
    def from_environment(cls, env: dict[str, str]) -> BurstParams:
        """SINTVL and BLENGTH in nanoseconds (any base that a prefix tells); what is missing, zero or no number gives the default."""

        def number(name: str, default: int) -> int:
            try:
                return int(env.get(name) or "0", 0) or default
            except ValueError:
                return default

        return cls(number("SINTVL", LIVE_INTERVAL), number("BLENGTH", LIVE_LENGTH))

    @classmethod
    def from_arguments(cls, arguments: Sequence[str]) -> BurstParams:
        """-sampling and -burst of a replay's command line, in ticks."""
        given = dict(zip(arguments, arguments[1:], strict=False))
        return cls(int(given.get("-sampling", cls.interval)), int(given.get("-burst", cls.length)))

    def with_interval(self, interval: int) -> BurstParams:
        return replace(self, interval=interval)


def dump_folder(env: dict[str, str]) -> str:
    """Where dumps go: DUMPPATH, or the default."""
    return env.get("DUMPPATH") or DEFAULT_DUMPS


def table_size(epsilon: float) -> int:
    """Items in a sketch of error epsilon; outside (0, 1] the default error holds."""
    return math.ceil(1 / (epsilon if 0 < epsilon <= 1 else DEFAULT_EPSILON))


def choose_phi(candidate: float, epsilon: float | None = None) -> float:
    """phi of a tree: exact trees (no epsilon) take any in (0, 1); sketches need more than epsilon, else 5 epsilon."""
    if epsilon is None:
        return candidate if 0 < candidate < 1 else 5 / 50000
    return candidate if candidate > epsilon else 5 * epsilon


def min_threshold(phi: float, measure: int) -> int:
    """Counter from which a node is hot, of phi and the tree's measure (enters, sampled enters or ticks)."""
    return math.floor(phi * measure)


def trace_thresholds(n: int, phi: int, epsilon: int, engine: str = "lss", burst_n: int | None = None) -> tuple[int, int]:
    """Thresholds of the exact tree and of the sketch; phi and epsilon as reciprocals."""
    exact = n // phi
    if engine == "lc":
        return exact, n // phi - n // epsilon
    return exact, (burst_n if engine == "bss" and burst_n is not None else n) // phi


def pool_bytes(nodes: int, sketch: bool = False) -> int:
    """Bytes of a pool of nodes: pages of 1024 of 20 (exact) or 28 (sketch) bytes, and their table."""
    return 12 + math.ceil(nodes / 1024) * (4 + 1024 * (28 if sketch else 20))


def overlap_levels() -> list[float]:
    """The 30 degrees of overlap, 100 - 100 / 1.25 ** j."""
    return [100 - 100 / 1.25**j for j in range(math.floor(math.log(1000) / math.log(1.25)))]
