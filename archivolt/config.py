"""Settings from the environment, where blank means the default, and what must hold before a run."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    candidates: int = 50
    rrf_k: int = 60
    top_k: int = 10
    rerank: int = 20
    per_unit: int = 3
    per_document: int = 4
    complementary: int = 0
    quota: int = 4
    boost_area: float = 0.002
    boost_body: float = 0.01
    cite_from: float = 0.5
    references: int = 6
    abstain_rerank: float = 0.025
    abstain_dense: float = 0.35
    temperature: float = 0.0
    model: str = "extractive"
    api_key: str = ""

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None, prefix: str = "ARCHIVOLT_") -> Config:
        env = os.environ if env is None else env
        given = {f.name: (env.get(prefix + f.name.upper()) or "").strip() for f in fields(cls)}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{name: kinds[name](value) for name, value in given.items() if value})

    def shown(self) -> dict:
        """The settings with secrets masked."""
        return {f.name: "***" if "key" in f.name and getattr(self, f.name) else getattr(self, f.name) for f in fields(self)}

    def check(self, allowed: tuple = ("extractive",)) -> None:
        if self.model not in allowed:
            raise ValueError(f"{self.model} is not an allowed model")
        if self.temperature != 0:
            raise ValueError("answers must be reproducible: temperature 0")


def resolved(given: DataFrame) -> DataFrame:
    """run, name and value of every setting of the runs in given(run, name, value): blank or absent means the default, and
    secrets are masked."""
    defaults = F.array(*[F.struct(F.lit(f.name).alias("name"), F.lit(str(f.default)).alias("default")) for f in fields(Config)])
    every = given.select("run").distinct().select("run", F.explode(defaults).alias("d")).select("run", "d.*")
    value = F.coalesce(F.nullif(F.trim("value"), F.lit("")), F.col("default"))
    shown = F.when(F.col("name").contains("key") & (value != ""), "***").otherwise(value)
    return every.join(given, ["run", "name"], "left").select("run", "name", shown.alias("value"))
