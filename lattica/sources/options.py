"""Option strings of readers and writers: ``NAME;NAME=VALUE;NAME=1,3-5``.

A string that begins with ``;`` names another separator by its next character.
Names have no case. Every option that is asked for is marked as seen; those that
nobody asked for are an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..model import MeshError

# Words for yes and no.
_YES, _NO = frozenset("true yes on 1".split()), frozenset("false no off 0".split())


@dataclass
class Options:
    items: list[tuple[str, str | None]] = field(default_factory=list)
    seen: set[int] = field(default_factory=set)

    @classmethod
    def parse(cls, text: str | None) -> Options:
        text = text or ""
        separator = ";"
        if text[:1] == ";":
            separator, text = text[1:2] or ";", text[2:]
        parts = [p for p in text.split(separator) if p]
        return cls([(n, v if eq else None) for n, eq, v in (p.partition("=") for p in parts)])

    def _find(self, name: str) -> tuple[bool, str | None]:
        for i, (n, v) in enumerate(self.items):
            if n.strip().lower() == name.lower():
                self.seen.add(i)
                return True, v
        return False, None

    def flag(self, name: str) -> bool:
        """Whether a bare option is there; one with a value is an error."""
        found, value = self._find(name)
        if value:
            raise MeshError("TYPE_OUT_OF_RANGE", f"{name} takes no value")
        return found

    def toggle(self, name: str, default: bool = False) -> bool:
        """Yes or no; a bare name means yes."""
        found, value = self._find(name)
        if not found:
            return default
        if value is None or value.lower() in _YES:
            return True
        if value.lower() in _NO:
            return False
        raise MeshError("TYPE_OUT_OF_RANGE", f"{name}={value}")

    def text(self, name: str) -> str:
        found, value = self._find(name)
        if not found:
            raise MeshError("ENTITY_NOT_FOUND", name)
        if not value:
            raise MeshError("TYPE_OUT_OF_RANGE", f"{name} needs a value")
        return value

    def integer(self, name: str, default: int | None = None) -> int:
        """A whole number; ``default`` where the name is bare."""
        found, value = self._find(name)
        if found and value is None and default is not None:
            return default
        return int(self._number(name, r"[+-]?\d+"))

    def real(self, name: str) -> float:
        return float(self._number(name, r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"))

    def _number(self, name: str, pattern: str) -> str:
        value = self.text(name).strip()
        if not re.fullmatch(pattern, value):
            raise MeshError("TYPE_OUT_OF_RANGE", f"{name}={value}")
        return value

    def integers(self, name: str) -> list[int]:
        """Numbers and ranges of numbers: ``1,3-5`` is 1, 3, 4, 5."""
        out: list[int] = []
        for part in re.split(r"[,\s]+", self.text(name).strip()):
            m = re.fullmatch(r"(-?\d+)(?:-(-?\d+))?", part)
            if m is None or m[2] and int(m[2]) < int(m[1]):
                raise MeshError("TYPE_OUT_OF_RANGE", f"{name}: {part}")
            out += range(int(m[1]), int(m[2] or m[1]) + 1)
        return out

    def reals(self, name: str) -> list[float]:
        try:
            return [float(x) for x in re.split(r"[,\s]+", self.text(name).strip())]
        except ValueError:
            raise MeshError("TYPE_OUT_OF_RANGE", name) from None

    def texts(self, name: str) -> list[str]:
        return [x for x in self.text(name).split(",") if x]

    def choice(self, name: str, values: list[str]) -> int:
        """Which of some values an option has."""
        value = self.text(name).lower()
        for i, v in enumerate(values):
            if v.lower() == value:
                return i
        raise MeshError("FAILURE", f"{name}={value}")

    def unseen(self) -> list[str]:
        return [n for i, (n, _) in enumerate(self.items) if i not in self.seen]

    def done(self) -> None:
        """Error for options that nothing has asked for."""
        if left := self.unseen():
            raise MeshError("UNHANDLED_OPTION", ", ".join(left))
