"""Checks of a configuration on the driver, as rows (FLT-20, FLT-21, FN-83)."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "name string, level string, message string"


def mapping(text: str | None) -> dict[str, str]:
    """FN-83: a column mapping as JSON, which must be an object; nothing is an empty one."""
    if not (text or "").strip():
        return {}
    found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError("a mapping must be an object")
    return {str(k): str(v) for k, v in found.items()}


def watched(folder: str, inner: list[str]) -> str | None:
    """FLT-20: what is wrong with a folder to watch: it must exist, be none of the engine's own folders and hold none."""
    if not folder or not os.path.isdir(folder):
        return "no such folder"
    own = os.path.realpath(folder)
    for other in map(os.path.realpath, inner):
        if os.path.commonpath([own, other]) in (own, other):
            return "overlaps a folder of the engine"
    return None


def check(spark: SparkSession, settings: dict, thresholds: tuple[str, str] = ("review", "auto")) -> DataFrame:
    """FLT-21: a row for each check: folders are there and can be written, watched folders are valid, thresholds are between 0 and 1 and in
    order, and providers have what they need."""
    rows: list[tuple[str, str, str]] = []
    folders = settings.get("folders", {})
    for name, path in folders.items():
        good = os.path.isdir(path) and os.access(path, os.W_OK)
        rows.append((f"folder:{name}", "ok" if good else "error", "" if good else "can't be written"))
    for path in settings.get("watch", []):
        wrong = watched(path, list(folders.values()))
        rows.append((f"watch:{path}", "error" if wrong else "ok", wrong or ""))
    low, high = (settings.get(t) for t in thresholds)
    good = low is not None and high is not None and 0 <= low <= high <= 1
    rows.append(("thresholds", "ok" if good else "error", "" if good else "must be between 0 and 1 and in order"))
    for name, needs in settings.get("providers", {}).items():
        missing = sorted(k for k, v in needs.items() if not v)
        rows.append((f"provider:{name}", "warning" if missing else "ok", ", ".join(missing)))
    return spark.createDataFrame(rows, SCHEMA)
