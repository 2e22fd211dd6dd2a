"""Comparing items as JSON values, by what they mean."""

from __future__ import annotations

import datetime as dt
import math
import re

_TIME = re.compile(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:?\d\d)$")


def _instant(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", text.replace("Z", "+00:00")))


def differences(a, b, precision: float = 1e-9, at: str = "$") -> list[str]:
    """Where two values differ. Numbers are equal within the precision, times as instants, NaN to NaN, and a key that
    is null to one that is missing; lists in order."""
    if isinstance(a, bool) or isinstance(b, bool):
        return [] if a is b else [f"{at}: {a!r} and {b!r}"]
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        same = a == b or (math.isnan(a) and math.isnan(b)) or abs(a - b) <= precision
        return [] if same else [f"{at}: {a!r} and {b!r}"]
    if type(a) is not type(b):
        return [f"{at}: {type(a).__name__} and {type(b).__name__}"]
    if isinstance(a, dict):
        return [d for k in dict.fromkeys((*a, *b)) if a.get(k) is not None or b.get(k) is not None for d in differences(a.get(k), b.get(k), precision, f"{at}.{k}")]
    if isinstance(a, list):
        if len(a) != len(b):
            return [f"{at}: {len(a)} and {len(b)} elements"]
        return [d for i, (x, y) in enumerate(zip(a, b)) for d in differences(x, y, precision, f"{at}[{i}]")]
    if isinstance(a, str) and a != b and _TIME.match(a) and _TIME.match(b):
        return [] if _instant(a) == _instant(b) else [f"{at}: {a} and {b}"]
    return [] if a == b else [f"{at}: {a!r} and {b!r}"]


def _link(x: dict, ignore_none: bool) -> dict:
    return {k: v for k, v in x.items() if v is not None} if ignore_none else x


def assert_items_equal(a, b, ignore_none: bool = False) -> None:
    """Raises ``AssertionError`` with all differences of two items, or two lists of items, which must be as long.

    Links are compared in the order of their targets.
    """
    if isinstance(a, dict) and a.get("type") == "FeatureCollection":
        a, b = a["features"], b["features"]
    if isinstance(a, list):
        assert len(a) == len(b), f"{len(a)} and {len(b)} items"
        for x, y in zip(a, b):
            assert_items_equal(x, y, ignore_none)
        return
    sort = lambda item: {**item, "links": sorted((_link(x, ignore_none) for x in item.get("links") or []), key=lambda x: x.get("href") or "")}
    found = differences(sort(a), sort(b))
    assert not found, "\n".join(found)
