"""Dataset names and where they are kept."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The layers' prefixes.
PREFIXES = {"Bronze": "bronze_v3", "Silver": "silver_v3", "Gold": "gold_v3"}
METADATA, METADATA_LOG = "metadata_v3", "metadata_log_v3"
VERSIONS, VERSIONS_LOG = "versions", "versions_log_v3"


def sanitize(c: Column) -> Column:
    """Runs of other characters than A-Z a-z 0-9 _ - become one _; none at the edges; nothing left: dataset."""
    stub = F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9_-]+", "_"), r"\A_+|_+\z", "")
    return F.coalesce(F.nullif(stub, F.lit("")), F.lit("dataset"))


def sanitized(text: str) -> str:
    return re.sub("[^a-zA-Z0-9_-]+", "_", text).strip("_") or "dataset"


def without_csv(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)\.csv\z", "")


def last_segment(c: Column) -> Column:
    return F.element_at(F.split(c, "__"), -1)


def packed(division: str, kind: str, stub: str) -> str:
    return f"{division}__{kind}__{stub}"


def bronze_parts(name: str) -> tuple[str, str, str] | None:
    """(division, type, stub) of a packed name. The stub may hold further double underscores."""
    parts = name.split("__", 2)
    return (parts[0], parts[1], parts[2]) if len(parts) == 3 and all(parts) else None


def path_of(root: str, layer: str, name: str) -> str:
    root = root.rstrip("/")
    if layer == "Bronze":
        parts = bronze_parts(name)
        if parts is None:
            raise ValueError(f"unknown dataset {name!r} in layer {layer!r}")
        return f"{root}/{PREFIXES[layer]}/{parts[0]}/{parts[1]}/{parts[2]}.csv"
    if layer not in PREFIXES:
        raise ValueError(f"unknown layer {layer!r}")
    return f"{root}/{PREFIXES[layer]}/{name}/data.csv"


def metadata_path(root: str, layer: str, name: str) -> str:
    return f"{root.rstrip('/')}/{METADATA}/{layer}__{name}.json"
