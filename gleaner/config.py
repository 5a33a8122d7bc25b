"""Settings from a YAML file with {{ VARIABLE }} references."""

from __future__ import annotations

import os
import re


def substituted(text: str, variables=os.environ) -> str:
    """Environment variables filled in; one that is not set is empty."""
    return re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda m: variables.get(m[1], ""), text)


def _scalar(v: str):
    v = v.strip()
    if v[:1] in "\"'" and v[-1:] == v[:1] and len(v) > 1:
        return v[1:-1]
    if re.fullmatch(r"-?\d+", v):
        return int(v)
    if re.fullmatch(r"-?\d+\.\d+", v):
        return float(v)
    return {"true": True, "false": False}.get(v.lower(), v)


def load(path: str) -> dict:
    with open(path) as f:
        return parsed(f.read())


def parsed(text: str, variables=os.environ) -> dict:
    """Keys with scalars or lists of scalars: PyYAML's result if it is there, else the same for such files."""
    text = substituted(text, variables)
    try:
        import yaml

        return yaml.safe_load(text) or {}
    except ModuleNotFoundError:
        pass
    out: dict = {}
    key = None
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        m = re.match(r"\s*-\s+(.*)$", line)
        if m and key is not None:
            out[key] = out[key] if isinstance(out[key], list) else []
            out[key].append(_scalar(m[1]))
            continue
        key, _, value = line.partition(":")
        key = key.strip()
        out[key] = _scalar(value) if value.strip() else None
    return out
