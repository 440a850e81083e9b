"""The security policy: a YAML file read strictly on the driver, as small tables."""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.lattice import UNTRUSTED, tier_of

SHIPPED = Path(__file__).resolve().parent.parent / "rules" / "policy.yaml"
POLICY_ROW = (
    "name string, side_effecting boolean, min_arg_tier int, high_risk_args array<string>, "
    "allowlists map<string,array<string>>, requires_confirmation boolean"
)
_TOOL_KEYS = {"name", "side_effecting", "min_arg_tier", "high_risk_args", "allowlists", "requires_confirmation"}


class PolicyError(ValueError):
    """A policy file that cannot be trusted to mean what it says."""


@dataclass(frozen=True)
class Policy:
    source_rules: tuple[tuple[str, int], ...]
    default_tier: int = UNTRUSTED
    blocking_flags: tuple[str, ...] = ()
    tools: tuple[dict, ...] = field(default_factory=tuple)

    @property
    def tool_names(self) -> tuple[str, ...]:
        return tuple(t["name"] for t in self.tools)

    def tier(self, uri: Column) -> Column:
        """The tier of the first rule that matches; a few rules make one CASE."""
        out = None
        for glob, tier in self.source_rules:
            hit = uri.rlike(glob_regex(glob))
            out = F.when(hit, tier) if out is None else out.when(hit, tier)
        return F.lit(self.default_tier) if out is None else out.otherwise(self.default_tier)

    def policies(self, spark: SparkSession) -> DataFrame:
        rows = [
            (t["name"], t["side_effecting"], t["min_arg_tier"], list(t["high_risk_args"]), {k: list(v) for k, v in t["allowlists"].items()}, t["requires_confirmation"])
            for t in self.tools
        ]
        return spark.createDataFrame(rows, POLICY_ROW)

    def rules(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, g, t) for i, (g, t) in enumerate(self.source_rules)], "idx int, glob string, tier int")


def glob_regex(glob: str) -> str:
    """A case-sensitive glob as a Java regular expression over the whole text."""
    body = fnmatch.translate(glob)
    return "(?s)\\A" + re.sub(r"^\(\?s:(.*)\)\\[Zz]$", r"(?:\1)", body) + "\\z"


def _tier(value, where: str) -> int:
    try:
        return tier_of(str(value))
    except ValueError as e:
        raise PolicyError(f"{where}: {e}") from None


def from_mapping(data: dict) -> Policy:
    if not isinstance(data, dict):
        raise PolicyError("a policy must be a mapping")
    rules = []
    for i, r in enumerate(data.get("source_rules") or []):
        if not isinstance(r, dict) or not r.get("match") or "tier" not in r:
            raise PolicyError(f"source_rules[{i}] needs 'match' and 'tier'")
        rules.append((str(r["match"]), _tier(r["tier"], f"source_rules[{i}]")))
    tools, seen = [], set()
    for i, t in enumerate(data.get("tools") or []):
        if not isinstance(t, dict) or not t.get("name"):
            raise PolicyError(f"tools[{i}] needs a 'name'")
        name = str(t["name"])
        if unknown := set(t) - _TOOL_KEYS:
            raise PolicyError(f"tool {name!r} has unknown keys: {sorted(unknown)}")
        if name in seen:
            raise PolicyError(f"tool {name!r} is named twice")
        seen.add(name)
        risky = [str(a) for a in t.get("high_risk_args") or []]
        lists = t.get("allowlists") or {}
        if stray := set(lists) - set(risky):
            raise PolicyError(f"tool {name!r} allowlists arguments that are not high-risk: {sorted(stray)}")
        floor = _tier(t.get("min_arg_tier", "T0_UNTRUSTED"), f"tool {name!r}")
        side, ask = bool(t.get("side_effecting", False)), bool(t.get("requires_confirmation", False))
        if side and not risky and floor == UNTRUSTED and not ask:
            raise PolicyError(f"side-effecting tool {name!r} has nothing for the gate to check")
        tools.append({"name": name, "side_effecting": side, "min_arg_tier": floor, "high_risk_args": risky, "allowlists": {str(k): [str(x) for x in v or []] for k, v in lists.items()}, "requires_confirmation": ask})
    default = _tier(data.get("default_tier", "T0_UNTRUSTED"), "default_tier")
    return Policy(tuple(rules), default, tuple(str(f) for f in data.get("blocking_flags") or ()), tuple(tools))


def load(path: str | Path = SHIPPED) -> Policy:
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_mapping(yaml.safe_load(f))
