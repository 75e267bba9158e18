"""Scenarios: how many rows each table gets and what overrides its columns."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from datetime import date, datetime
from typing import Any

DEFAULT_ROWS = 10


class ScenarioError(ValueError):
    pass


def _nearest(x: float) -> int:
    return max(0, math.floor(x + 0.5))


@dataclass(frozen=True)
class Fixed:
    n: int

    def rows(self, known: Mapping[str, int], default: int = DEFAULT_ROWS) -> int:
        return self.n


@dataclass(frozen=True)
class PerParent:
    parent: str
    low: int
    high: int

    def rows(self, known: Mapping[str, int], default: int = DEFAULT_ROWS) -> int:
        """Parents times the midpoint; the default without parents."""
        n = known.get(self.parent, 0)
        return _nearest(n * (self.low + self.high) / 2) if n else default


@dataclass(frozen=True)
class PercentOf:
    table: str
    percent: float

    def rows(self, known: Mapping[str, int], default: int = DEFAULT_ROWS) -> int:
        return _nearest(known.get(self.table, 0) * self.percent / 100)


Count = Fixed | PerParent | PercentOf


def parse_count(text: str | int) -> Count:
    """``12``, ``per_parent(users, 0..10)`` or ``30% of users``."""
    s = str(text).strip()
    if re.fullmatch(r"\d+", s):
        return Fixed(int(s))
    if m := re.fullmatch(r"per_parent\(\s*(\w+)\s*,\s*(\d+)\s*\.\.\s*(\d+)\s*\)", s):
        low, high = int(m[2]), int(m[3])
        if low > high:
            raise ScenarioError(f"range {low}..{high} is reversed")
        return PerParent(m[1], low, high)
    if m := re.fullmatch(r"(\d+(?:\.\d+)?)\s*%\s*of\s+(\w+)", s):
        return PercentOf(m[2], float(m[1]))
    raise ScenarioError(f"no count: {text!r}")


def parse_percent(x: str | float) -> float:
    """``5%`` and 5 are both 5."""
    return float(x.strip().removesuffix("%")) if isinstance(x, str) else float(x)


def parse_scalar(x: Any) -> float:
    """A number; an ISO date counts as days since 1970-01-01."""
    if isinstance(x, date):
        return float((x - date(1970, 1, 1)).days)
    if isinstance(x, str) and re.fullmatch(r"\d{4}-\d\d-\d\d", x.strip()):
        return float((date.fromisoformat(x.strip()) - date(1970, 1, 1)).days)
    return float(x)


_SECONDS = {"w": 604_800, "d": 86_400, "h": 3600, "m": 60, "s": 1}


def parse_duration(text: str) -> tuple[int, int]:
    """``1d..60d`` or ``2h`` as seconds (low, high)."""
    ends = []
    for part in text.split(".."):
        m = re.fullmatch(r"\s*(\d+)\s*([wdhms])\s*", part)
        if not m:
            raise ScenarioError(f"no duration: {text!r}")
        ends.append(int(m[1]) * _SECONDS[m[2]])
    if len(ends) > 2:
        raise ScenarioError(f"no duration: {text!r}")
    return ends[0], ends[-1]


def parse_temporal(spec: Mapping[str, Any]) -> tuple[str, str, str, tuple[int, int]]:
    """``{after: users.created_at, offset: 1d..60d}`` as (relation, parent, its column, bounds in seconds)."""
    relation = next((r for r in ("after", "before", "equals") if r in spec), None)
    parent, _, column = str(spec.get(relation, "")).partition(".")
    if not relation or not column:
        raise ScenarioError(f"no temporal constraint: {dict(spec)!r}")
    return relation, parent, column, parse_duration(str(spec.get("offset", "0s")))


@dataclass(frozen=True)
class Churn:
    """rate is a share of 1; column gets ``value`` on churn; with ``cascade`` the churned get no more children."""

    rate: float = 0.0
    grace: int = 0
    column: str = "is_active"
    value: Any = False
    cascade: bool = True


def parse_churn(spec: Mapping[str, Any]) -> Churn:
    rate = spec.get("rate", 0)
    rate = parse_percent(rate) / 100 if isinstance(rate, str) else float(rate)
    return Churn(rate, int(spec.get("grace_period", 0)), str(spec.get("column", "is_active")), spec.get("value", False), bool(spec.get("cascade", True)))


@dataclass(frozen=True)
class Override:
    kind: str  # distribution, range, quantiles, density, joint, formula, generator, timeline or from_parent
    value: Any


@dataclass(frozen=True)
class TablePlan:
    count: Count | None = None
    overrides: dict[str, Override] = field(default_factory=dict)
    growth: dict[str, Any] = field(default_factory=dict)
    churn: dict[str, Any] = field(default_factory=dict)
    seasonality: dict[str, Any] = field(default_factory=dict)
    temporal: dict[str, Any] = field(default_factory=dict)
    null_rates: dict[str, float] = field(default_factory=dict)  # percent, of nullable columns


@dataclass(frozen=True)
class Scenario:
    tables: dict[str, TablePlan]
    seed: int | None = None
    lifecycle: dict[str, Any] | None = None

    def with_counts(self, counts: Mapping[str, int]) -> Scenario:
        """Counts given from outside replace a table's own; its overrides stay."""
        tables = dict(self.tables)
        for name, n in counts.items():
            tables[name] = replace(tables.get(name, TablePlan()), count=Fixed(n))
        return replace(self, tables=tables)

    def row_counts(self, order: tuple[str, ...], default: int = DEFAULT_ROWS) -> dict[str, int]:
        """Rows of each table, parents first."""
        known: dict[str, int] = {}
        for name in order:
            plan = self.tables.get(name)
            known[name] = plan.count.rows(known, default) if plan and plan.count else default
        return known


def _override(spec: Mapping[str, Any]) -> Override:
    if "distribution" in spec:
        return Override("distribution", {str(k): parse_percent(v) for k, v in spec["distribution"].items()})
    if "range" in spec:
        low, high = map(parse_scalar, spec["range"])
        return Override("range", (min(low, high), max(low, high)))
    if "timeline" in spec:
        return Override("timeline", {str(d): {str(k): parse_percent(v) for k, v in w.items()} for d, w in spec["timeline"].items()})
    kind, value = next(iter(spec.items()))
    if kind not in ("formula", "generator", "from_parent", "after"):
        raise ScenarioError(f"no override: {kind!r}")
    return Override(kind, value)


def parse(plain: Mapping[str, Any]) -> Scenario:
    """A scenario from its plain form (what YAML or JSON gives)."""
    tables = {}
    for name, spec in (plain.get("tables") or {}).items():
        spec = spec or {}
        over = {c: _override(o) for c, o in (spec.get("overrides") or {}).items()}
        count = parse_count(spec["count"]) if "count" in spec else None
        nulls = {c: parse_percent(r) for c, r in (spec.get("null_rates") or {}).items()}
        tables[name] = TablePlan(count, over, dict(spec.get("growth") or {}), dict(spec.get("churn") or {}), dict(spec.get("seasonality") or {}), dict(spec.get("temporal") or {}), nulls)
    return Scenario(tables, plain.get("seed"), plain.get("lifecycle"))


def load(path: str) -> Scenario:
    import json

    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return parse(json.load(f))
        import yaml

        return parse(yaml.safe_load(f))


def effective_seed(flag: int | None, scenario: Scenario | None, clock: int) -> int:
    """The flag, else the scenario's seed, else the clock."""
    return flag if flag is not None else scenario.seed if scenario and scenario.seed is not None else clock


# The built-in scenarios that users call by name. Counts, weights, ranges and dates must be
# these for the same databases; tables and columns stand in their usual order.
TEMPLATES: dict[str, dict] = {
    "ecommerce": {"tables": {
        "users": {"count": 50},
        "categories": {"count": 15},
        "products": {"count": 200, "overrides": {"price": {"range": [4.99, 499.99]}}},
        "orders": {"count": "per_parent(users, 0..10)", "overrides": {"status": {"distribution": {"pending": 5, "paid": 60, "shipped": 20, "delivered": 10, "cancelled": 5}}}},
        "order_items": {"count": "per_parent(orders, 1..5)", "overrides": {"quantity": {"range": [1, 4]}}},
        "reviews": {"count": "per_parent(products, 0..5)", "overrides": {"rating": {"distribution": {"1": 5, "2": 5, "3": 15, "4": 35, "5": 40}}}},
    }},
    "saas": {"tables": {
        "organizations": {"count": 10},
        "users": {"count": "per_parent(organizations, 3..20)", "overrides": {"role": {"distribution": {"owner": 10, "admin": 15, "member": 65, "viewer": 10}}}},
        "subscriptions": {"count": "per_parent(organizations, 1..1)", "overrides": {"plan": {"distribution": {"free": 30, "pro": 50, "enterprise": 20}}}},
        "invoices": {"count": "per_parent(subscriptions, 1..12)", "overrides": {"status": {"distribution": {"paid": 80, "pending": 10, "overdue": 5, "failed": 5}}}},
    }},
    "blog": {"tables": {
        "users": {"count": 20, "overrides": {"role": {"distribution": {"admin": 5, "editor": 15, "author": 80}}}},
        "posts": {"count": "per_parent(users, 0..15)", "overrides": {"status": {"distribution": {"draft": 20, "published": 70, "archived": 10}}}},
        "comments": {"count": "per_parent(posts, 0..20)"},
        "tags": {"count": 30},
        "post_tags": {"count": "per_parent(posts, 1..4)"},
    }},
    "social": {"tables": {
        "users": {"count": 100},
        "posts": {"count": "per_parent(users, 0..50)"},
        "likes": {"count": "per_parent(posts, 0..100)"},
        "follows": {"count": "30% of users"},
        "messages": {"count": "per_parent(users, 0..20)"},
    }},
    "lifecycle": {"seed": 42, "lifecycle": {"start": "2023-01-01", "end": "2026-06-01", "bucket": "month"}, "tables": {
        "users": {
            "growth": {"model": "s_curve", "initial": 10, "capacity": 5000, "rate": 0.15}, "churn": {"rate": 0.03, "grace_period": 2, "column": "is_active", "value": False},
            "overrides": {
                "role": {"distribution": {"admin": 2, "moderator": 5, "user": 93}},
                "plan": {"timeline": {"2023-01-01": {"pro": 80, "free": 20}, "2024-06-01": {"pro": 40, "free": 45, "enterprise": 15}, "2025-06-01": {"pro": 25, "free": 55, "enterprise": 20}}},
            },
        },
        "orders": {
            "growth": {"follows": "users", "ratio": 3.2, "variance": 0.35}, "seasonality": {"monthly": [1.0, 0.7, 0.85, 1.0, 1.1, 0.8, 0.7, 0.85, 1.2, 1.4, 1.8, 2.5]},
            "temporal": {"created_at": {"after": "users.created_at", "offset": "1d..60d"}},
            "overrides": {
                "status": {"timeline": {"2023-01-01": {"pending": 40, "completed": 45, "cancelled": 15}, "2025-01-01": {"pending": 8, "completed": 72, "cancelled": 8, "refunded": 5, "shipped": 7}}},
                "total_amount": {"range": [15000, 2500000]},
            },
        },
        "order_items": {"growth": {"follows": "orders", "per_parent": "1..5"}, "temporal": {"created_at": {"equals": "orders.created_at"}}},
        "reviews": {
            "growth": {"follows": "orders", "ratio": 0.25}, "temporal": {"created_at": {"after": "orders.created_at", "offset": "3d..30d"}},
            "overrides": {"rating": {"distribution": {"5": 35, "4": 30, "3": 20, "2": 10, "1": 5}}},
        },
    }},
}


def template(name: str) -> Scenario:
    return parse(TEMPLATES[name])


def _days(iso: str) -> float:
    """Days since 1970-01-01 of a date or time."""
    return (datetime.fromisoformat(iso) - datetime(1970, 1, 1)).total_seconds() / 86_400


def _knots(stats: Mapping[str, Any]) -> tuple[tuple[float, float], ...]:
    """(share, value) from least to greatest; a percentile may not fall below the one before it."""
    named = [(0.0, stats["min"]), *((int(p[1:]) / 100, v) for p, v in sorted(stats["percentiles"].items(), key=lambda x: int(x[0][1:]))), (1.0, stats["max"])]
    out: list[tuple[float, float]] = []
    for q, v in named:
        out.append((q, max(float(v), out[-1][1]) if out else float(v)))
    return tuple(out)


def from_profile(profile: Mapping[str, Any], scale: float = 1.0) -> Scenario:
    """A scenario that regenerates a profiled database at a scale in (0, 1].

    A table without parents gets its rows times the scale, at least one; another the rounded
    bounds of its average number per parent, for the parent with the highest average.
    Categorical columns keep their distribution, numeric ones their quantiles, booleans their
    rate, dates and times their range and their shares of months, hours and weekdays, columns profiled
    together how their ranks go together, and every column its null rate.
    """
    if not 0 < scale <= 1:
        raise ScenarioError("scale must be over 0 and at most 1")
    tables = {}
    for name, t in profile["tables"].items():
        over, nulls = {}, {}
        for c, stats in t.get("columns", {}).items():
            if stats.get("null_rate"):
                nulls[c] = float(stats["null_rate"])
            if stats["type"] == "categorical":
                over[c] = Override("distribution", dict(stats["distribution"]))
            elif stats["type"] == "numeric":
                over[c] = Override("quantiles", _knots(stats)) if stats.get("percentiles") else Override("range", (stats["min"], stats["max"]))
            elif stats["type"] == "boolean":
                over[c] = Override("distribution", {"true": stats["true_rate"], "false": 100 - stats["true_rate"] - stats.get("null_rate", 0.0)})
            elif stats["type"] == "timestamp" and None not in stats["range"]:
                low, high = stats["range"]
                over[c] = Override("density", (stats["monthly_density"], stats.get("hourly_density") or {}, stats.get("weekday_ratio"), low, high)) if stats.get("monthly_density") else Override("range", (_days(low), _days(high)))
        joint = t.get("joint")
        for k, c in enumerate(joint["columns"] if joint else ()):
            over[c] = Override("joint", (joint["counts"], k, tuple((i / joint["bins"], v) for i, v in enumerate(joint["edges"][k]))))
        ratios = t.get("parent_ratios") or {}
        if ratios:
            parent, r = max(ratios.items(), key=lambda x: (x[1]["avg"], x[0]))
            count: Count = PerParent(parent.split(".")[0], math.floor(r["avg"]), math.ceil(r["avg"]))
        else:
            count = Fixed(max(1, _nearest(t["row_count"] * scale)))
        tables[name] = TablePlan(count, over, null_rates=nulls)
    return Scenario(tables)
