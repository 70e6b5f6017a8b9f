"""Configuration: TOML, then environment, then bounds. Driver-side only."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from sitelens import constants as C
from sitelens.operators.settings import Settings


@dataclass
class Config:
    contact_email: str = ""
    project_url: str = ""
    output_directory: str = "runs"
    formats: list[str] = field(default_factory=lambda: list(C.DEFAULT_FORMATS))
    timeout_seconds: float = 10.0
    retries: int = 3
    max_pages: int = C.BOUNDS["max_pages"][0]
    max_depth: int = C.BOUNDS["max_depth"][0]
    request_interval_seconds: float = C.BOUNDS["request_interval_seconds"][0]
    concurrent_requests: int = C.BOUNDS["concurrent_requests"][0]
    retention_days: int = C.BOUNDS["retention_days"][0]
    follow_sitemap: bool = True
    include_subdomains: bool = True
    phone_region: str = C.DEFAULT_REGION

    def require_contact(self) -> str:
        """The contact address, without which no run starts."""
        if not re.fullmatch(C.EMAIL, self.contact_email):
            raise ValueError("a valid contact_email is required before a run")
        return self.contact_email

    def settings(self) -> tuple[Settings, list[tuple[str, float, float]]]:
        names = {f.name for f in fields(Settings)}
        return Settings.clamped(**{k: v for k, v in asdict(self).items() if k in names})


#: Environment variables that win over the file.
ENVIRONMENT = {"CONTACT_EMAIL": "contact_email", "PROJECT_URL": "project_url", "OUTPUT_DIRECTORY": "output_directory"}


def paths(explicit: str | None = None) -> list[Path]:
    """Where a configuration may be, first wins."""
    home = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
    return [Path(p) for p in ([explicit] if explicit else ["sitelens.toml", f"{home}/sitelens/config.toml"])]


def load(explicit: str | None = None) -> Config:
    """The first file that exists, laid over the defaults; values of a wrong type raise."""
    config = Config()
    for path in paths(explicit):
        if path.is_file():
            for section in [doc := tomllib.loads(path.read_text("utf-8")), *[v for v in doc.values() if isinstance(v, dict)]]:
                for f in fields(Config):
                    if f.name in section:
                        setattr(config, f.name, _typed(f.name, section[f.name], getattr(config, f.name)))
            break
    for name, attribute in ENVIRONMENT.items():
        if value := os.environ.get(C.ENV_PREFIX + name):
            setattr(config, attribute, value)
    return config


def _typed(name: str, value, default):
    number = isinstance(value, int | float) and not isinstance(value, bool)
    ok = number if isinstance(default, float) else number and isinstance(value, int) if isinstance(default, int) and not isinstance(default, bool) else isinstance(value, type(default))
    if not ok or isinstance(default, list) and not all(isinstance(x, str) for x in value):
        raise TypeError(f"{name}: {value!r} is no {type(default).__name__}")
    return float(value) if isinstance(default, float) else value


def render(config: Config) -> str:
    def shown(v) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, list):
            return "[" + ", ".join(map(shown, v)) + "]"
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"' if isinstance(v, str) else repr(v)

    return "".join(f"{k} = {shown(v)}\n" for k, v in asdict(config).items())


def save(config: Config, explicit: str | None = None) -> Path:
    """Write to the first path that can be written."""
    for path in paths(explicit):
        try:
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(render(config), "utf-8")
        except OSError:
            continue
        return path
    raise OSError("no configuration path can be written")
