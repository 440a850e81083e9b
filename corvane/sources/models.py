"""The model configuration: which provider serves a role, and the request caps."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from corvane.operators.quarantine import Provider


class RouterError(ValueError):
    """A model configuration that cannot be used."""


@dataclass(frozen=True)
class Router:
    """Roles to (provider, model), read strictly; providers are built by name and kept."""

    roles: dict[str, tuple[str, str]]
    per_day: int | None = None
    per_run: int | None = None
    _built: dict[tuple[str, str], Provider] = field(default_factory=dict)

    def provider(self, role: str, builders: dict) -> Provider:
        """The provider of a role; ``builders`` make one from a model's name."""
        if role not in self.roles:
            raise RouterError(f"no model is configured for the role {role!r}")
        key = self.roles[role]
        if key[0] not in builders:
            raise RouterError(f"unknown provider {key[0]!r} for the role {role!r}")
        if key not in self._built:
            self._built[key] = builders[key[0]](key[1])
        return self._built[key]


def from_mapping(raw: object) -> Router:
    if not isinstance(raw, dict) or not isinstance(raw.get("roles"), dict):
        raise RouterError("a model configuration needs a mapping 'roles'")
    roles = {}
    for name, spec in raw["roles"].items():
        if not isinstance(spec, dict) or not all(isinstance(spec.get(k), str) and spec[k] for k in ("provider", "model")):
            raise RouterError(f"the role {name!r} needs a provider and a model")
        roles[str(name)] = (spec["provider"], spec["model"])
    budget = raw.get("budget") or {}
    caps = [budget.get(k) for k in ("max_requests_per_day", "max_requests_per_run")]
    if any(c is not None and (not isinstance(c, int) or c < 0) for c in caps):
        raise RouterError("request caps are whole numbers from 0 on")
    return Router(roles, *caps)


def load(path: str) -> Router:
    import yaml

    if not Path(path).is_file():
        raise RouterError(f"no model configuration at {path}")
    try:
        return from_mapping(yaml.safe_load(Path(path).read_text(encoding="utf-8")))
    except yaml.YAMLError as e:
        raise RouterError(f"{path} is not YAML: {e}") from e
