"""Publishing by a pointer: what readers see changes in one step, after everything is written and checked.

A folder of versions holds one small text dataset each; the newest complete one
(Spark's writers mark completion) is what counts.  A version is written once and
never changed, so a job that fails before it publishes leaves the earlier state
readable, and two jobs that publish the same version cannot both succeed.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from .sources.readers import list_folder

VERSIONS = "versions"


def versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions under ``root``, oldest first (metadata only)."""
    folder = f"{root.rstrip('/')}/{VERSIONS}"
    names = [n for n in list_folder(spark, folder) or [] if n.startswith("v")]
    return [int(n[1:]) for n in names if "_SUCCESS" in (list_folder(spark, f"{folder}/{n}") or [])]


def _path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/{VERSIONS}/v{version:09d}"


def published(spark: SparkSession, root: str) -> tuple[int, dict] | None:
    """The newest version and what it says; None where nothing has been published."""
    have = versions(spark, root)
    if not have:
        return None
    text = "".join(r["value"] for r in spark.read.text(_path(root, have[-1])).collect())
    return have[-1], json.loads(text)


def publish(spark: SparkSession, root: str, version: int, content: dict) -> None:
    """Make ``content`` the newest version; fails if that version is there already."""
    (spark.createDataFrame([(json.dumps(content, sort_keys=True),)], "value string")
     .coalesce(1).write.mode("error").text(_path(root, version)))
