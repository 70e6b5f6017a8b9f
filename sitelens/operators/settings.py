"""What a run is allowed to do: target, bounded settings, purpose. Checked on the driver before any plan exists."""

from __future__ import annotations

import re
from dataclasses import dataclass

from sitelens import constants as C
from sitelens.functions import urls as U


@dataclass(frozen=True)
class Settings:
    max_pages: int = C.BOUNDS["max_pages"][0]
    max_depth: int = C.BOUNDS["max_depth"][0]
    request_interval_seconds: float = C.BOUNDS["request_interval_seconds"][0]
    concurrent_requests: int = C.BOUNDS["concurrent_requests"][0]
    retention_days: int = C.BOUNDS["retention_days"][0]
    follow_sitemap: bool = True
    phone_region: str = C.DEFAULT_REGION
    include_subdomains: bool = True

    def __post_init__(self) -> None:
        for name, (_, low, high) in C.BOUNDS.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}, not {getattr(self, name)}")
        if not re.fullmatch(C.REGION, self.phone_region):
            raise ValueError(f"phone_region must be two capital letters, not {self.phone_region!r}")

    @classmethod
    def clamped(cls, **values) -> tuple[Settings, list[tuple[str, float, float]]]:
        """Settings with values moved into bounds, and what was moved: (name, given, used)."""
        moved = []
        for name, (_, low, high) in C.BOUNDS.items():
            if name in values and values[name] != (used := min(max(values[name], low), high)):
                moved.append((name, values[name], used))
                values[name] = used
        return cls(**values), moved


@dataclass(frozen=True)
class Purpose:
    category: str
    note: str = ""

    def __post_init__(self) -> None:
        if self.category not in C.PURPOSES:
            raise ValueError(f"unknown purpose {self.category!r}")
        if self.category == "other" and len(self.note.strip()) < C.MIN_PURPOSE_NOTE:
            raise ValueError(f"purpose other needs a note of {C.MIN_PURPOSE_NOTE} characters")


@dataclass(frozen=True)
class Target:
    entered: str
    include_subdomains: bool = True

    @property
    def url(self) -> str:
        return U.target_url(self.entered)

    @property
    def scope_host(self) -> str:
        host = re.match(r"https?://([^/:]*)", self.url)[1]
        return host.removeprefix("www.")

    @property
    def scope_port(self) -> int | None:
        found = re.match(r"https?://[^/:]*:(\d+)", self.url)
        return int(found[1]) if found else None
