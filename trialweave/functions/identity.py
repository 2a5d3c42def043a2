"""Identities: canonical JSON, hashes, seeds, names."""

from __future__ import annotations

import hashlib
import json
import os
import re
from urllib.parse import urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that do not change which series a result belongs to.
NOT_IDENTITY = frozenset({"alpha", "seed", "max_block_bytes", "ci_kind", "contrasts"})


def canonical_json(value) -> str:
    """Sorted keys, no blanks, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def method_config_id(name: str, params: dict, defaults: dict, version: int = 1) -> str:
    """The series identity of a method: its name and the parameters that differ from the defaults."""
    own = {k: v for k, v in params.items() if k not in NOT_IDENTITY and v != defaults.get(k)}
    text = name + canonical_json(own) + (str(version) if version > 1 else "")
    return hashlib.sha256(text.encode()).hexdigest()


def method_config_id_column(name: Column, params_json: Column) -> Column:
    return F.sha2(F.concat(name, params_json), 256)


def derive_seed(*parts) -> int:
    """63 bits of the SHA-256 of the parts, joined by the unit separator."""
    digest = hashlib.sha256("\x1f".join(map(str, parts)).encode()).digest()
    return int.from_bytes(digest[:8], "big") >> 1


def derive_seed_column(*parts: Column) -> Column:
    digest = F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256)
    high, low = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 31).bitwiseOR(F.shiftright(low, 1))


def series_id(roles: dict, definition: str, cohort: dict | None = None) -> str:
    """16 hex digits that name a state series."""
    return hashlib.sha256(canonical_json([roles, normalized_sql(definition), cohort or {}]).encode()).hexdigest()[:16]


def column_set_id(source: str, roles: dict) -> str:
    return hashlib.sha256(canonical_json([source, roles]).encode()).hexdigest()[:16]


def normalized_sql(text: str) -> str:
    """White space outside quotes becomes one blank; quoted text stays."""
    parts = re.split(r"""('(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`)""", text)
    return "".join(p if i % 2 else re.sub(r"\s+", " ", p) for i, p in enumerate(parts)).strip()


def method_name(name: str) -> str:
    return name.strip().lower().replace("_", "-")


def from_environment(value):
    """``${NAME}`` and ``${NAME:-default}`` in strings, lists and dicts; an unknown name is an error."""
    if isinstance(value, dict):
        return {k: from_environment(v) for k, v in value.items()}
    if isinstance(value, list):
        return [from_environment(v) for v in value]
    if not isinstance(value, str):
        return value

    def put(m: re.Match) -> str:
        if (found := os.environ.get(m[1], m[2])) is None:
            raise KeyError(f"the environment has no {m[1]}")
        return found

    return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", put, value)


def redacted(url: str) -> str:
    """A URL without credentials, query or fragment."""
    parts = urlsplit(url)
    host = parts.hostname or ""
    return urlunsplit((parts.scheme, host + (f":{parts.port}" if parts.port else ""), parts.path, "", ""))


def signature(items: Column) -> Column:
    """Sorted distinct items, one a line."""
    return F.array_join(F.array_sort(F.array_distinct(items)), "\n")


def rollup_signature(leader: Column, separation: Column) -> Column:
    """The separation, with its leader only once it is separated."""
    return F.when(separation == "separated", F.concat(separation, F.lit(":"), F.coalesce(leader, F.lit("")))).otherwise(separation)
