"""Settings of a map in a file: names and paths to leave out, paths to keep, and forced levels of detail."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .files import glob_regex

# What a file may be forced to.
LEVELS = {"full": 2, "omit": -1}


@dataclass(frozen=True)
class Config:
    method_blocklist: list[str] = field(default_factory=list)
    exclude_paths: list[str] = field(default_factory=list)
    include_paths: list[str] = field(default_factory=list)
    file_overrides: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str | None) -> Config:
        """The settings in YAML (where a reader of it is there) or JSON; no text means none. Unknown levels and bad patterns are errors."""
        if not (text or "").strip():
            return cls()
        try:
            import yaml

            raw = yaml.safe_load(text)
        except ImportError:
            raw = json.loads(text)
        listed = {k: [str(x).strip() for x in (raw or {}).get(k) or [] if str(x).strip()] for k in ("method_blocklist", "exclude_paths", "include_paths")}
        out = cls(**listed, file_overrides={str(k).strip(): str(v).strip() for k, v in ((raw or {}).get("file_overrides") or {}).items() if str(k).strip()})
        for glob, level in out.file_overrides.items():
            if level not in LEVELS:
                raise ValueError(f"file_overrides: {glob} is to be full or omit, not {level}")
        for pattern in [*map(_name_regex, out.method_blocklist), *map(glob_regex, [*out.exclude_paths, *out.include_paths, *out.file_overrides])]:
            re.compile(pattern)
        return out

    def blocked(self, name: Column) -> Column:
        """Whether a symbol's name is on the list of names to leave out: globs, or regular expressions between slashes."""
        found = F.lit(False)
        for pattern in self.method_blocklist:
            found = found | name.rlike(_name_regex(pattern))
        return found

    def files(self, files: DataFrame) -> DataFrame:
        """The files that no excluded glob holds, and that an included one does if there are any."""
        for g in self.exclude_paths:
            files = files.where(~F.col("path").rlike(glob_regex(g)))
        return files.where(F.col("path").rlike("|".join(map(glob_regex, self.include_paths)))) if self.include_paths else files

    def overrides(self, spark: SparkSession) -> DataFrame:
        """pattern, forced: the rules of operators.budget.apply_overrides."""
        rows = [(f"^{re.escape(g.split('**')[0])}" if "**" in g else glob_regex(g), LEVELS[v]) for g, v in self.file_overrides.items()]
        return spark.createDataFrame(rows, "pattern string, forced int")


def _name_regex(pattern: str) -> str:
    return pattern[1:-1] if len(pattern) >= 2 and pattern[0] == pattern[-1] == "/" else glob_regex(pattern)


def load(spark: SparkSession, path: str) -> Config:
    """The settings in a file, read through Spark; none where there is no such file."""
    found = spark.read.format("binaryFile").load(path.rpartition("/")[0]).where(F.endswith("path", F.lit("/" + path.rpartition("/")[2]))).select(F.decode("content", "UTF-8").alias("text")).first()
    return Config.parse(found["text"] if found else None)
