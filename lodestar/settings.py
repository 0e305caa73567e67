"""Settings from files on the driver: an allow-list of environment entries, and fit weights over the defaults."""

from __future__ import annotations

import json
import os
from pathlib import Path

from lodestar.operators.eligibility import WEIGHTS, check_weights

#: Settings that a file or the environment may set, with their defaults.
ALLOWED = {"LODESTAR_MODEL_URL": "", "LODESTAR_MODEL_NAME": "", "LODESTAR_API_KEY": "", "LODESTAR_TIMEOUT_SECONDS": "30", "LODESTAR_STORE": ""}


def load(path: str | None = None, environment: dict[str, str] | None = None) -> dict[str, str]:
    """Defaults, then KEY=value lines of the file, then the environment; unknown keys of a file are an error."""
    out, environment = dict(ALLOWED), os.environ if environment is None else environment
    for line in Path(path).read_text("utf-8").splitlines() if path else []:
        key, sep, value = line.partition("=")
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if not sep or key.strip() not in ALLOWED:
            raise ValueError(f"unknown setting {key.strip()!r}")
        out[key.strip()] = value.strip().strip("'\"")
    out |= {k: environment[k] for k in ALLOWED if environment.get(k)}
    if not 1 <= float(out["LODESTAR_TIMEOUT_SECONDS"]) <= 120:
        raise ValueError("the timeout must be from 1 to 120 seconds")
    return out


def load_weights(path: str) -> dict[str, float]:
    """Fit weights of a JSON object over the defaults."""
    given = json.loads(Path(path).read_text("utf-8"))
    if not isinstance(given, dict) or not set(given) <= set(WEIGHTS) or any(isinstance(v, bool) or not isinstance(v, int | float) for v in given.values()):
        raise ValueError("weights must be an object of known names and numbers")
    return check_weights({k: float(v) for k, v in given.items()})
