"""Options of the temperature programs as they come from a command line."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from ..operators.windows import BIN_WINDOWS, CHART_BINS, K, parsed_thresholds

LEAST_WIDTH, LEAST_BIN = 32, 256


@dataclass(frozen=True)
class TemperatureOptions:
    """k, windows of a bin, bins of the chart, concentration (None: Wallace's rule), thresholds.

    ``read`` takes texts: what is no number leaves the default, a width or bin that is too small
    becomes the least one, a concentration that isn't positive is none, names that are not known
    are ignored."""

    k: int = K
    bin: int = BIN_WINDOWS
    width: int = CHART_BINS
    sodium: float | None = None
    thresholds: tuple[float, ...] = ()

    @classmethod
    def read(cls, given: Mapping[str, str]) -> TemperatureOptions:
        whole = {f.name: f.default for f in fields(cls)}
        for name in ("k", "bin", "width"):
            try:
                value = int(given.get(name, "").strip())
            except ValueError:
                continue
            whole[name] = value if value > 0 else whole[name]
        whole["bin"], whole["width"] = max(whole["bin"], LEAST_BIN), max(whole["width"], LEAST_WIDTH)
        sodium = parsed_thresholds(given.get("sodium", ""))
        whole["sodium"] = sodium[0] if sodium and sodium[0] > 0 else None
        whole["thresholds"] = tuple(parsed_thresholds(given.get("thresholds", "")))
        return cls(**whole)
