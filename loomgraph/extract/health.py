"""Which grammars work on this machine: probed once, for a while."""

from __future__ import annotations

import time
from collections.abc import Callable

TTL_SECONDS = 300.0
#: Fixed: names by which grammars may also be known.
ALIASES = {"csharp": ("c_sharp", "csharp"), "objc": ("objc", "objective_c"), "bash": ("bash", "shell"), "cpp": ("cpp", "c")}


class GrammarHealth:
    """load(name) gives a parser or raises. What failed is tried again after TTL_SECONDS."""

    def __init__(self, load: Callable[[str], object], clock: Callable[[], float] = time.monotonic):
        self._load, self._clock = load, clock
        self._known: dict[str, tuple[float, object | None]] = {}

    def parser(self, language: str) -> object | None:
        at, found = self._known.get(language, (-TTL_SECONDS, None))
        if found is None and self._clock() - at >= TTL_SECONDS:
            for name in ALIASES.get(language, (language,)):
                try:
                    found = self._load(name)
                    break
                except Exception:  # whatever a grammar raises, others may work
                    continue
            self._known[language] = (self._clock(), found)
        return found

    def available(self, language: str) -> bool:
        return self.parser(language) is not None
