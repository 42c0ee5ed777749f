"""Settings of a run, read from a mapping such as ``os.environ``; what can't be read gives the default."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

# Providers of models by their names and by how a model's name begins, with the settings that they read.
PROVIDERS = {
    "gemini": {"names": ("gemini", "google"), "prefixes": ("gemini/",), "key": "GOOGLE_API_KEY", "model": "GEMINI_MODEL", "url": None},
    "nvidia": {"names": ("nvidia", "nvidia_nim", "nim"), "prefixes": ("nvidia_nim/", "nvidia/"), "key": "NVIDIA_API_KEY",
               "model": "NVIDIA_MODEL", "url": "NVIDIA_BASE_URL"},
}


def _read(settings: Mapping[str, str], name: str, kind: Callable, default):
    try:
        return kind(str(settings.get(name, default)).strip())
    except ValueError:
        return default


def whole(settings: Mapping[str, str], name: str, default: int, least: int | None = None) -> int:
    """A whole number, not below ``least``."""
    found = _read(settings, name, int, default)
    return found if least is None else max(least, found)


def number(settings: Mapping[str, str], name: str, default: float) -> float:
    return _read(settings, name, float, default)


def flag(settings: Mapping[str, str], name: str, default: bool = False) -> bool:
    """True for 1, true, yes and on, in any case; the default for what is missing or blank."""
    found = str(settings.get(name, "")).strip().lower()
    return found in ("1", "true", "yes", "on") if found else default


@dataclass(frozen=True)
class Model:
    provider: str
    name: str
    key: str
    url: str | None


def model(settings: Mapping[str, str], override: str | None = None, usual: Mapping[str, str] | None = None) -> Model:
    """Which model answers: the override's provider by the beginning of its name, else the provider asked for, else the
    one whose key is there. ``usual`` has each provider's usual model. No key and no known provider are errors.
    """
    named, wanted = (override or "").strip(), settings.get("MODEL_PROVIDER", "").strip().lower()
    by_name = next((p for p, about in PROVIDERS.items() if named.startswith(about["prefixes"])), None)
    provider = by_name or wanted or next((p for p, a in PROVIDERS.items() if settings.get(a["key"], "").strip()), "nvidia")
    found = next((p for p, about in PROVIDERS.items() if provider in about["names"]), None)
    if found is None:
        raise ValueError(f"no provider is called {provider}")
    about = PROVIDERS[found]
    key = settings.get(about["key"], "").strip()
    if not key:
        raise ValueError(f"{about['key']} is needed")
    name = named or settings.get(about["model"], "").strip() or (usual or {}).get(found, "")
    return Model(found, name, key, settings.get(about["url"], "").strip() or None if about["url"] else None)
