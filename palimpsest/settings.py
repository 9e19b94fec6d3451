"""Settings with defaults and bounds. Loading clamps; an explicit change is rejected instead."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, fields

from palimpsest.operators.timepos import TimeParams

# --- fixed values: bounds of whole-number settings ------------------------------------------
WHOLE = {
    "compactionRecapMaxTokens": (0, 2000), "maxTokensPerTurn": (0, 4000), "maxItems": (0, 5),
    "maxCharsPerItem": (50, 1000), "observationTurns": (1, 8), "cooldownTurns": (0, 20),
    "maxRawCharsPerCompaction": (0, 4_000_000), "protectRecentDays": (0, 365),
    "trashAutoPurgeDays": (1, 365), "toolResultMaxChars": (200, 20_000),
    "toolResultBudgetChars": (0, 2_000_000), "diagnosePageSize": (5, 100),
    "diagnosePageLimit": (1, 10), "diagnoseCandidatePool": (30, 1000),
}
# --- fixed values: bounds of the time re-rank, loadable but not editable ---------------------
LOADABLE = {
    "timeNearPeakShare": (0.5, 1), "timeFarPeakShare": (0, 0.5), "timeBellPeakShare": (0.5, 1),
    "timeBellWidth": (0.05, 2), "timeBothEndsDip": (0, 1), "timeBoostMin": (0.1, 1),
    "timeBoostMax": (1, 3),
}


@dataclass(frozen=True)
class Settings:
    enabled: bool = True
    injectRecap: bool = True
    injectRecall: bool = True
    ingestSummary: bool = True
    ingestRawText: bool = True
    recapPersist: bool = True
    stickyRecall: bool = True
    dedupe: bool = True
    preferSummaryChunks: bool = True
    includeToolResults: bool = True
    includePrune: bool = False
    trashEnabled: bool = True
    trashAutoPurgeEnabled: bool = True
    compactionRecapMaxTokens: int = 300
    maxTokensPerTurn: int = 700
    maxItems: int = 2
    maxCharsPerItem: int = 300
    observationTurns: int = 3
    cooldownTurns: int = 1
    maxRawCharsPerCompaction: int = 400_000
    protectRecentDays: int = 7
    trashAutoPurgeDays: int = 7
    toolResultMaxChars: int = 4000
    toolResultBudgetChars: int = 120_000
    diagnosePageSize: int = 30
    diagnosePageLimit: int = 4
    diagnoseCandidatePool: int = 120
    minScore: float = 0.28
    timeNearPeakShare: float = 1.0
    timeFarPeakShare: float = 0.0
    timeBellPeakShare: float = 0.7
    timeBellWidth: float = 0.35
    timeBothEndsDip: float = 0.2
    timeBoostMin: float = 0.7
    timeBoostMax: float = 1.35
    toolResultNames: str = "read, grep, glob, web_fetch, history_read"

    def time_params(self) -> TimeParams:
        return TimeParams(
            self.timeNearPeakShare, self.timeFarPeakShare, self.timeBellPeakShare,
            self.timeBellWidth, self.timeBothEndsDip, self.timeBoostMin, self.timeBoostMax,
        )

    @classmethod
    def load(cls, stored: dict) -> Settings:
        """Settings from a stored file: wrong types fall back, numbers are clamped."""
        good = {}
        for name, default in asdict(cls()).items():
            value = stored.get(name, default)
            if isinstance(default, bool):
                good[name] = value if isinstance(value, bool) else default
            elif isinstance(default, str):
                good[name] = value.strip()[:300] if isinstance(value, str) and value.strip() else default
            elif not _finite(value):
                good[name] = default
            else:
                low, high = {**WHOLE, **LOADABLE}.get(name, (0, math.inf))
                value = math.floor(value) if name in WHOLE else value
                usable = value if name != "minScore" or value >= 0 else default
                good[name] = min(high, max(low, usable))
        return cls(**good)

    def change(self, **patch) -> Settings:
        """A changed copy; unknown names, wrong types and out-of-range values raise."""
        editable = {f.name for f in fields(self)} - set(LOADABLE)
        for name, value in patch.items():
            if name not in editable:
                raise ValueError(f"unknown setting {name}")
            default = getattr(Settings(), name)
            if isinstance(default, bool) != isinstance(value, bool):
                raise ValueError(f"{name} has the wrong type")
            if name in WHOLE:
                low, high = WHOLE[name]
                if not isinstance(value, int) or not low <= value <= high:
                    raise ValueError(f"{name} must be a whole number from {low} to {high}")
            elif isinstance(default, float) and not (_finite(value) and value >= 0):
                raise ValueError(f"{name} must be a number of 0 or more")
            elif isinstance(default, str) and not (isinstance(value, str) and 0 < len(value.strip()) <= 300):
                raise ValueError(f"{name} must be 1 to 300 characters")
        return Settings(**{**asdict(self), **patch})


def _finite(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
