"""Rule and configuration files."""

from __future__ import annotations

import logging
import re
from pathlib import Path

from pyspark.sql import SparkSession

from ruleforge.rules.model import Config, Rule
from ruleforge.rules.reader import parse_config, parse_rule, split_documents

log = logging.getLogger(__name__)


def _files(path: str | Path) -> list[Path]:
    path = Path(path)
    if path.is_file():
        return [path]
    if not path.exists():
        raise FileNotFoundError(path)
    return sorted(p for p in path.rglob("*") if p.is_file() and p.suffix.lower() in (".yml", ".yaml"))


def rules_of_text(text: str, name: str = "") -> list[Rule]:
    """The rules of a text of several documents; those that don't parse are warned of and left out."""
    out = []
    for document in split_documents(text):
        try:
            rule = parse_rule(document)
        except ValueError as e:
            log.warning("%s: %s", name, e)
            continue
        if rule.detection.searches or rule.correlation:
            out.append(rule)
    return out


def load_rules(path: str | Path) -> list[Rule]:
    """The rules of a file, or of all .yml and .yaml files below a folder, in the order of paths."""
    return [r for p in _files(path) for r in rules_of_text(p.read_text(encoding="utf-8"), str(p))]


def load_rules_remote(spark: SparkSession, path: str) -> list[Rule]:
    """The same for a folder that only Spark reads."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.y{ml,aml}").option("wholetext", "true").text(path).selectExpr("value", "_metadata.file_path AS path").orderBy("path").collect()
    return [r for row in rows for r in rules_of_text(row["value"], row["path"])]


def load_configs(paths: list[str | Path]) -> list[Config]:
    return [parse_config(p.read_text(encoding="utf-8")) for path in paths for p in _files(path)]


def excluded_ids(text: str) -> set[str]:
    """The ids of an exclusion list: one a line, remarks from #."""
    return {line for raw in text.splitlines() if (line := re.sub(r"#.*", "", raw).strip().lower())}


def exclude_rules(rules: list[Rule], text: str) -> list[Rule]:
    ids = excluded_ids(text)
    return [r for r in rules if r.id.lower() not in ids]


def load_exclusions(paths: str) -> str:
    """The lists of comma-separated files; a file that is missing is an error."""
    return "\n".join(Path(p.strip()).read_text(encoding="utf-8") for p in paths.split(",") if p.strip())
