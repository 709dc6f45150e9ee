"""What is made of texts that come again, kept within bounds."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

#: Characters of the texts of a generation. Two are kept, so what still comes again outlives the rest.
KEPT = 1 << 20


class Kept:
    """make(text), made once for a text as long as it comes again before so many other characters. Longer texts are not kept."""

    def __init__(self, make: Callable[[str], Any], room: int = KEPT) -> None:
        self._make, self._room, self._left = make, room, room
        self._new: dict[str, Any] = {}
        self._old: dict[str, Any] = {}

    def __call__(self, text: str) -> Any:
        made = self._new.get(text)
        if made is None:
            made = self._old.pop(text, None)
            if made is None:
                made = self._make(text)
            if len(text) < self._room:
                self._left -= len(text) + 1
                if self._left < 0:
                    self._old, self._new, self._left = self._new, {}, self._room - len(text)
                self._new[text] = made
        return made
