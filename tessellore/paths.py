"""Path templates of a configuration: ``${name}`` and ``${env:NAME}``."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

_TOKEN = re.compile(r"\$\{([^}]*)\}")


def expand(template: str, values: Mapping[str, str], environment: Mapping[str, str] | None = None) -> str:
    """The template with its variables filled in; an unknown or an empty one is an error."""
    environment = os.environ if environment is None else environment

    def value(m: re.Match) -> str:
        name = m[1]
        if name.startswith("env:"):
            found = environment.get(name[4:], "").strip()
            if not found:
                raise ValueError(f"path variable {m[0]} is empty")
            return found
        if name not in values:
            raise ValueError(f"unknown path variable {m[0]}; known are {', '.join(sorted(values))} and env:NAME")
        return values[name]

    return _TOKEN.sub(value, template)
