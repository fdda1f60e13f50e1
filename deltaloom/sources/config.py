"""Configuration: defaults, a file's values over them, globs as regular expressions."""

from __future__ import annotations

import re
import tomllib
from copy import deepcopy
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.rank import WEIGHTS

DEFAULTS = {"project": {}, "entrypoints": {}, "layers": {}, "ignore": {"paths": []}, "ranking": dict(WEIGHTS), "diff": {"include_uncommitted": True},
    "refine": {"max_iterations": 1}}


def merged(base: dict, over: dict) -> dict:
    out = deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def from_text(text: str) -> dict:
    config = merged(DEFAULTS, tomllib.loads(text))
    validate(config)
    return config


def load(path: str) -> dict:
    """A missing file gives the defaults."""
    p = Path(path)
    return from_text(p.read_text()) if p.exists() else deepcopy(DEFAULTS)


def validate(config: dict) -> None:
    if any(w < 0 for w in config["ranking"].values()):
        raise ValueError("ranking weights can't be negative")
    if config["refine"]["max_iterations"] == 0:
        raise ValueError("max_iterations can't be 0")


def glob_regex(glob: str) -> str | None:
    """An anchored regular expression; null for a glob that is none."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] in "*?":
            out, i = out + ("[^/]*" if glob[i] == "*" else "[^/]"), i + 1
        elif glob[i] == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(re.escape(x) for x in glob[i + 1:end].split(",")) + ")", end + 1
        elif glob[i] == "[":
            if "]" not in glob[i:]:
                return None
            end = glob.index("]", i)
            out, i = out + glob[i:end + 1].replace("[!", "[^"), end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def is_ignored(path: Column, config: dict, internal: str = ".deltaloom/") -> Column:
    out = F.startswith(path, F.lit(internal))
    for g in config["ignore"]["paths"]:
        if (r := glob_regex(g)) is not None:
            out = out | path.rlike(r)
    return out


ENTRYPOINT_KINDS = ("http", "workers", "cli", "cron", "events")


def is_entrypoint_file(path: Column, config: dict) -> Column:
    """Whether a glob of the configured entry points covers the path."""
    out = F.lit(False)
    for kind in ENTRYPOINT_KINDS:
        for glob in config.get("entrypoints", {}).get(kind, ()):
            if regex := glob_regex(glob):
                out = out | path.rlike(regex)
    return out


def layer(path: Column, config: dict) -> Column:
    """The first layer by name whose glob matches, null for none."""
    out = F.lit(None).cast("string")
    for name in sorted(config["layers"], reverse=True):
        if (r := glob_regex(config["layers"][name])) is not None:
            out = F.when(path.rlike(r), name).otherwise(out)
    return out
