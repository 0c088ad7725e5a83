"""Rule files: a directory tree of YAML documents."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

from ..plans.compiler import FieldMapping, RuleCompiler, RuleError
from ..plans.ir import Dropped, Ruleset


def rule_files(root: str) -> list[Path]:
    return sorted(p for p in Path(root).rglob("*") if p.suffix.lower() in (".yml", ".yaml") and p.is_file())


def load_rules(root: str, mapping: FieldMapping | None = None) -> tuple[Ruleset, int, int]:
    """All rules under a directory, and how many files were loaded and skipped; a file that fails is reported in ``dropped``."""
    compiler, loaded, skipped = RuleCompiler(mapping), 0, 0
    for path in rule_files(root):
        try:
            compiler.add(path.read_text(encoding="utf-8"))
            loaded += 1
        except (RuleError, OSError, UnicodeDecodeError) as e:
            compiler.ruleset.dropped.append(Dropped(str(path.relative_to(root)), str(e)))
            skipped += 1
    return compiler.ruleset, loaded, skipped


def load_rules_from_store(spark: SparkSession, path: str, mapping: FieldMapping | None = None) -> Ruleset:
    """Rules from any storage that Spark reads; a rule set fits on the driver."""
    compiler = RuleCompiler(mapping)
    for row in spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{yml,yaml}").text(path, wholetext=True).collect():
        try:
            compiler.add(row[0])
        except RuleError as e:
            compiler.ruleset.dropped.append(Dropped("", str(e)))
    return compiler.ruleset
