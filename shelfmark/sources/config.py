"""Normalisation data from JSON files: synonyms, aliases, stop words."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Config:
    """Names by their variants, and names that are left out. Files of this kind are small and read on the driver."""

    tags: dict[str, str] = field(default_factory=dict)
    people: dict[str, str] = field(default_factory=dict)
    studios: dict[str, str] = field(default_factory=dict)
    tag_stops: list[str] = field(default_factory=list)
    person_stops: list[str] = field(default_factory=list)

    def names(self, spark: SparkSession, kind: str) -> DataFrame:
        """(variant, canonical) of tags, people or studios, for freq.canonicaliser."""
        return spark.createDataFrame(sorted(getattr(self, kind).items()), "variant string, canonical string")


def read(*paths: str) -> Config:
    """The files in their order, later ones over earlier; keys that begin with _ are remarks; files that are missing or no JSON are passed over."""
    out = Config()
    for path in paths:
        try:
            data = json.loads(Path(path).read_text(encoding="utf-8"))
        except (OSError, ValueError):
            continue
        for key, into in (("tag_synonyms", out.tags), ("actor_aliases", out.people), ("studio_aliases", out.studios)):
            into.update({k: v for k, v in (data.get(key) or {}).items() if not k.startswith("_")})
        out.tag_stops += data.get("tag_stopwords") or []
        out.person_stops += data.get("actor_stopwords") or []
    return out
