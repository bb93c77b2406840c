"""Settings of a single process from YAML: defaults, unknown fields ignored, ranges checked."""

from __future__ import annotations

from dataclasses import dataclass, fields

from marlstone.model import InvalidOptions

LEVELS, FORMATS = ("debug", "info", "warn", "error"), ("json", "text")


@dataclass
class Config:
    host: str = "127.0.0.1"
    port: int = 7890
    data_dir: str = "./data"
    level: str = "info"
    format: str = "json"

    #: Where each field stands in a file.
    SECTIONS = {"host": "server", "port": "server", "data_dir": "storage", "level": "log", "format": "log"}

    @classmethod
    def parse(cls, text: str) -> Config:
        try:
            import yaml
        except ImportError as e:
            raise InvalidOptions("YAML files need the yaml package") from e
        try:
            raw = yaml.safe_load(text) or {}
        except yaml.YAMLError as e:
            raise InvalidOptions(f"not YAML: {e}") from e
        if not isinstance(raw, dict):
            raise InvalidOptions("a configuration is a mapping")
        given = {f.name: raw[s][f.name] for f in fields(cls) if f.name in (raw.get(s := cls.SECTIONS[f.name]) or {})}
        return cls(**given).validate()

    @classmethod
    def load(cls, path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            return cls.parse(f.read())

    def validate(self) -> Config:
        if not isinstance(self.port, int) or not 1 <= self.port <= 65535:
            raise InvalidOptions(f"no such port: {self.port}")
        if self.level not in LEVELS:
            raise InvalidOptions(f"no such log level: {self.level}")
        if self.format not in FORMATS:
            raise InvalidOptions(f"no such log format: {self.format}")
        return self
