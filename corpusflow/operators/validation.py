"""Checks of configurations and manifests before anything runs; driver-side."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Mapping

from pyspark.sql import SparkSession

from ..sources import files
from .search import CONFIG

HEX40 = re.compile(r"[0-9a-f]{40}")


def manifest_errors(manifest: Mapping[str, Mapping]) -> dict[str, str]:
    """The first fault of each dataset: an unpinned revision, a missing license
    or role, an empty config, or a reasoning role without config or sources."""
    out = {}
    for name, entry in manifest.items():
        reasoning = entry.get("role") == "reasoning"
        tests = (
            (HEX40.fullmatch(str(entry.get("revision", ""))), "must be pinned to a full commit hash"),
            (entry.get("license"), "is missing license metadata"),
            (entry.get("role"), "is missing its training role"),
            ("config" not in entry or entry["config"], "has an empty dataset configuration"),
            (not reasoning or entry.get("config"), "reasoning data requires an explicit configuration"),
            (not reasoning or entry.get("included_sources"), "reasoning data requires an included-source allowlist"),
        )
        if fault := next((message for ok, message in tests if not ok), None):
            out[name] = f"{name} {fault}"
    return out


def load_manifest(spark: SparkSession, path: str) -> dict[str, dict]:
    manifest = json.loads(files.read_text(spark, path))
    if faults := manifest_errors(manifest):
        raise ValueError(next(iter(faults.values())))
    return manifest


def load_retrieval_config(spark: SparkSession, path: str | None = None) -> dict:
    return dict(CONFIG) if path is None else json.loads(files.read_text(spark, path))


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def check_training(reasoning_ratio: float, sequence_length: int, max_tokens: int, time_budget_hours: float, learning_rate: float, calibration_steps: int = 20, calibration_warmup_steps: int = 5) -> None:
    _need(0 <= reasoning_ratio <= 1, "reasoning_ratio must be between zero and one")
    _need(sequence_length > 1 and max_tokens >= sequence_length, "invalid token or sequence budget")
    _need(calibration_steps >= 1 and calibration_warmup_steps >= 0, "invalid calibration window")
    _need(math.isfinite(time_budget_hours) and time_budget_hours > 0 and learning_rate > 0, "time budget and learning rate must be positive")


def check_rollouts(group_size: int, max_searches: int, epochs: int, time_budget_hours: float, judge_model: str | None = None, judge_revision: str | None = None) -> None:
    _need(group_size >= 2, "group_size must be at least two")
    _need(0 <= max_searches <= 3, "max_searches must be between zero and three")
    _need(epochs >= 1, "epochs must be positive")
    _need(math.isfinite(time_budget_hours) and time_budget_hours > 0, "time_budget_hours must be positive")
    _need(not judge_model or bool(judge_revision), "judge_revision is required when judge_model is enabled")
    _need(not judge_revision or HEX40.fullmatch(judge_revision) is not None, "judge_revision must be a full lowercase commit hash")
