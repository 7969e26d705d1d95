"""Enumerations, weights and tables that all operators share."""

from __future__ import annotations

from dataclasses import dataclass

STATUSES = ("open", "fixed", "wontfix", "false_positive", "auto_resolved")

# They must equal those of other implementations for equal scores.
CONFIDENCE_WEIGHT = {"high": "1.0", "medium": "0.7", "low": "0.3"}
DEFAULT_CONFIDENCE_WEIGHT = "0.7"
CONFIDENCE_ORDER = {"high": 0, "medium": 1, "low": 2}
FAILS = {"lenient": ("open",), "strict": ("open", "wontfix"), "verified_strict": ("open", "wontfix", "fixed", "false_positive")}
DIMENSION_WEIGHT = {"File health": "2.0", "Code quality": "1.0", "Duplication": "1.0", "Test health": "1.0", "Security": "1.0"}
MECHANICAL_SHARE, SUBJECTIVE_SHARE = "0.40", "0.60"
MIN_SAMPLE = 200
HOLISTIC_MULTIPLIER = 10
FILE_CAPS = ((6, "2.0"), (3, "1.5"), (1, "1.0"))


@dataclass(frozen=True)
class Detector:
    name: str
    action: str
    judgment: bool
    dimension: str | None
    file_based: bool = False
    loc_weight: bool = False
    no_zones: tuple[str, ...] = ()


_Q, _D = "Code quality", "Duplication"
# Detectors with their action, whether they need judgment, and how they are scored.
DETECTORS: list[Detector] = [
    Detector("unused", "auto_fix", False, _Q),
    Detector("logs", "auto_fix", False, _Q),
    Detector("exports", "manual_fix", False, _Q),
    Detector("smells", "auto_fix", True, _Q, file_based=True),
    Detector("orphaned", "reorganize", True, _Q),
    Detector("uncalled_functions", "refactor", True, None),
    Detector("flat_dirs", "reorganize", True, _Q),
    Detector("naming", "reorganize", True, _Q),
    Detector("single_use", "reorganize", True, _Q),
    Detector("coupling", "reorganize", True, _Q),
    Detector("cycles", "reorganize", True, "Security"),
    Detector("facade", "reorganize", True, _Q),
    Detector("structural", "refactor", True, "File health"),
    Detector("props", "refactor", True, _Q),
    Detector("react", "refactor", True, _Q),
    Detector("dupes", "refactor", True, _D),
    Detector("patterns", "refactor", True, _Q),
    Detector("dict_keys", "refactor", True, _Q, file_based=True),
    Detector("test_coverage", "refactor", False, "Test health", file_based=True, loc_weight=True),
    Detector("signature", "refactor", True, None),
    Detector("global_mutable_config", "manual_fix", True, _Q),
    Detector("private_imports", "manual_fix", True, _Q),
    Detector("layer_violation", "manual_fix", True, _Q),
    Detector("responsibility_cohesion", "refactor", True, _Q),
    Detector("boilerplate_duplication", "refactor", True, _D),
    Detector("stale_wontfix", "manual_fix", False, None),
    Detector("concerns", "refactor", False, None, file_based=True),
    Detector("deprecated", "manual_fix", False, _Q),
    Detector("stale_exclude", "manual_fix", False, _Q),
    Detector("security", "manual_fix", False, "Security", file_based=True, no_zones=("test", "config", "generated", "vendor")),
    Detector("review", "refactor", False, None, file_based=True),
    Detector("subjective_review", "manual_fix", False, "Test health", file_based=True),
]
NEVER_SCORED = ("review", "concerns")


def register(detector: Detector) -> None:
    """Add a detector, or replace the one of its name; scores, queues and concerns made afterwards know it."""
    DETECTORS[:] = [d for d in DETECTORS if d.name != detector.name] + [detector]


ZONES = ("production", "test", "config", "generated", "script", "vendor")

#: Findings, the fact table of scans, merges and scores.
FINDING = (
    "id string, detector string, file string, tier int, confidence string, summary string, status string, note string, "
    "first_seen timestamp_ntz, last_seen timestamp_ntz, resolved_at timestamp_ntz, reopen_count int, suppressed boolean, "
    "lang string, zone string, loc_weight decimal(10,1), holistic boolean, detail_count int, detail_line int"
)
