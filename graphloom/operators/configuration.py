"""Strict configuration: a TOML text checked against the tables and keys there are."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

# The tables of a configuration and the types of their keys; a table's name ending in * holds keys of any name.
TABLES = {
    "languages": {"include": list, "exclude": list}, "discover": {"exclude": list, "max_bytes": int, "follow_ignore_files": bool}, "identity": {"repo_url": str}, "secrets": {"enabled": bool, "paths": list},
    "layers*": {"": list}, "rules": {"forbid": list, "require": list, "forbid_cycles": list}, "precise": {"indexes": list, "required": bool}, "server": {"host": str, "port": int, "permitted": list},
}
FORMS = {"forbid": ({"from_role", "to_role", "edge"}, {"from_context", "to_context"}), "require": ({"from_role", "to_role_any_of"},), "forbid_cycles": ({"level"},)}


def load(text: str | None) -> dict:
    """The configuration of a text; an unknown table or key, a wrong type or a rule of no known form raises ``ValueError``."""
    d = tomllib.loads(text or "")
    for table, body in d.items():
        keys = TABLES.get(table) or TABLES.get(table + "*")
        if keys is None or not isinstance(body, dict):
            raise ValueError(f"unknown table {table}")
        for key, value in body.items():
            kind = keys.get(key) or keys.get("")
            if kind is None:
                raise ValueError(f"unknown key {table}.{key}")
            if not isinstance(value, kind) or kind is int and isinstance(value, bool):
                raise ValueError(f"{table}.{key} is no {kind.__name__}")
    for kind, rules in (d.get("rules") or {}).items():
        for rule in rules:
            if not isinstance(rule, dict) or not any(set(rule) <= form and (len(set(rule)) >= 2 or kind == "forbid_cycles") for form in FORMS[kind]):
                raise ValueError(f"rules.{kind}: no form has {sorted(rule) if isinstance(rule, dict) else rule}")
    return d


def values(text: str | None) -> Iterator[tuple[str, str | None, str | None]]:
    """(key, value, error) rows: the flattened configuration, or one row that says why it is refused."""
    from graphloom.operators.extractors import flatten

    try:
        for k, v in flatten(load(text)):
            yield k, v, None
    except ValueError as e:
        yield "", None, str(e).split(" (at")[0]
