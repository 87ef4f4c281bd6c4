"""Configuration and small inputs that the driver reads."""

from __future__ import annotations

import functools
import os
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions.metrics import Fidelity

VARIABLE = "QUIRELAKE_CONFIG"
LOCAL, TEMPLATE = "config.local.toml", "config.toml"


@dataclass(frozen=True)
class Endpoint:
    name: str
    url: str
    key: str = ""


@dataclass(frozen=True)
class Config:
    root: str = "."
    engine: str = "fake"
    endpoints: dict[str, Endpoint] = field(default_factory=dict)
    roles: dict[str, str] = field(default_factory=dict)
    models: dict[str, dict[str, str]] = field(default_factory=dict)
    fidelity: Fidelity = Fidelity()
    ocr: dict[str, object] = field(default_factory=dict)
    preprocess: dict[str, object] = field(default_factory=dict)

    def endpoint(self, name: str) -> Endpoint:
        if name not in self.endpoints:
            raise KeyError(f"no endpoint {name}")
        return self.endpoints[name]

    def role_endpoint(self, role: str) -> Endpoint:
        """The endpoint of a role, else the first one that knows a model for it."""
        if role in self.roles:
            return self.endpoint(self.roles[role])
        for name in self.endpoints:
            if role in self.models.get(name, {}):
                return self.endpoints[name]
        raise KeyError(f"no endpoint for {role}")

    def model(self, role: str) -> str:
        own = self.models.get(self.role_endpoint(role).name, {})
        return own.get(role) or next(m[role] for m in self.models.values() if role in m)


def config_path(path: str | None = None, folder: str = ".") -> Path | None:
    """The file that counts: argument, environment, local file, template."""
    named = path or os.environ.get(VARIABLE)
    if named:
        return Path(named)
    return next((p for p in (Path(folder, LOCAL), Path(folder, TEMPLATE)) if p.exists()), None)


@functools.cache
def load(path: str | None = None, folder: str = ".") -> Config:
    own = config_path(path, folder)
    if own is None:
        return Config()
    raw = tomllib.loads(own.read_text(encoding="utf-8"))
    root = Path(raw.get("root", "."))
    ends = {n: Endpoint(n, e["url"], e.get("key", "")) for n, e in raw.get("endpoints", {}).items()}
    return Config(
        str(root if root.is_absolute() else (own.parent / root).resolve()),
        raw.get("engine", "fake"),
        ends,
        dict(raw.get("roles", {})),
        {n: dict(e.get("models", {})) for n, e in raw.get("endpoints", {}).items()},
        Fidelity(**raw.get("fidelity", {})),
        dict(raw.get("ocr", {})),
        dict(raw.get("preprocess", {})),
    )


def gold_set(raw: Column) -> Column:
    """(index, gold_text) entries of a JSON object that maps page numbers to texts."""
    entries = F.map_entries(F.from_json(raw, "map<string,string>"))
    return F.transform(entries, lambda e: F.struct(e["key"].cast("int").alias("index"), e["value"].alias("gold_text")))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.explode(gold_set(F.col("value"))).alias("e")).select("e.*")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files of one value each, by a declared schema."""
    return spark.read.schema(schema).json(path, multiLine=True)
