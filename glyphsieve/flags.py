"""Which text transforms a rule asks for."""

from __future__ import annotations

import json
from enum import IntFlag


class RuleError(ValueError):
    """A rule table that cannot be compiled."""


class InvalidProcessType(RuleError):
    """A process type of 0 or beyond the seven known bits."""


class EmptyPatterns(RuleError):
    """A rule table that leaves no pattern to look for."""


class ProcessType(IntFlag):
    """Transforms, applied in ascending order of their bits. NONE means the text as it is; beside another it means nothing."""

    NONE = 1
    VARIANT_NORM = 2
    DELETE = 4
    NORMALIZE = 8
    DELETE_NORMALIZE = 12
    VARIANT_NORM_DELETE_NORMALIZE = 14
    ROMANIZE = 16
    ROMANIZE_CHAR = 32
    EMOJI_NORM = 64

    @classmethod
    def checked(cls, bits: int) -> ProcessType:
        if isinstance(bits, bool) or not isinstance(bits, int) or not 0 < int(bits) < 128:
            raise InvalidProcessType(f"process type {bits!r} is not in 1..127")
        return cls(int(bits))

    @classmethod
    def from_json(cls, data: str) -> ProcessType:
        """From its number; bits beyond the seventh are refused."""
        return cls.checked(json.loads(data))

    def to_json(self) -> str:
        return json.dumps(int(self))

    def normalized(self) -> ProcessType:
        return ProcessType(self & ~1) if self > 1 else self

    def steps(self) -> list[ProcessType]:
        """Single transforms in the order of application; NONE is no step."""
        return [ProcessType(1 << k) for k in range(1, 7) if self & (1 << k)]

    def snake_case(self) -> str:
        names = {1: "none", 2: "variant_norm", 4: "delete", 8: "normalize", 16: "romanize", 32: "romanize_char", 64: "emoji_norm"}
        return "_".join(v for k, v in names.items() if self & k)
