"""Digests and checks around a matter's folder."""

from __future__ import annotations

import json
import posixpath
import re
import shlex

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of an event's text in a brief.
CLIP = 400
# Settings that send a session's traffic elsewhere.
REROUTING = ("ANTHROPIC_BASE_URL", "OPENAI_BASE_URL", "HTTP_PROXY", "HTTPS_PROXY", "ALL_PROXY", "apiBaseUrl", "base_url")


def brief(events: DataFrame, by: str = "matter", order: str = "at", kind: str = "kind", text: str = "text") -> DataFrame:
    """(by, brief): a matter's events in order, one line each, clipped."""
    one = F.regexp_replace(F.trim(F.coalesce(F.col(text), F.lit(""))), r"\s+", " ")
    line = F.concat(F.lit("- "), F.col(kind), F.lit(": "), F.when(F.length(one) > CLIP, F.concat(F.substring(one, 1, CLIP), F.lit("…"))).otherwise(one))
    rows = events.select(by, F.struct(F.col(order).alias("o"), line.alias("line")).alias("e"))
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["line"]), "\n").alias("brief"))


def inside(folder: str, path: str) -> bool:
    """Whether a path, taken from the folder, stays in it."""
    full = posixpath.normpath(posixpath.join(folder, path))
    return full == posixpath.normpath(folder) or full.startswith(posixpath.normpath(folder) + "/")


def outside_paths(folder: str, command: str) -> list[str]:
    """Paths a command names that are outside the folder."""
    try:
        words = shlex.split(command)
    except ValueError:
        words = command.split()
    paths = [w.split("=", 1)[-1] for w in words]
    return [p for p in paths if (p.startswith(("/", "~")) or ".." in p.split("/")) and not inside(folder, p.replace("~", "/~", 1))]


def rerouting(settings: str) -> list[str]:
    """Keys of a settings text (JSON or lines) that send traffic elsewhere."""
    try:
        tree = json.loads(settings)
    except ValueError:
        return [k for k in REROUTING if re.search(rf"^\s*(?:export\s+)?{re.escape(k)}\s*=", settings, re.M)]
    found, stack = set(), [tree]
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            found |= {k for k in node if k in REROUTING}
            stack += node.values()
        elif isinstance(node, list):
            stack += node
    return [k for k in REROUTING if k in found]


def choices(groups: Column) -> Column:
    """Model choices that come as groups of options, as one list without repeats."""
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: g["options"])))
