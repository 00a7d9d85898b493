"""What the parser makes of a query."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Path:
    parts: tuple[str, ...]

    def __str__(self) -> str:
        return ".".join(self.parts)


@dataclass(frozen=True)
class Agg:
    name: str
    path: Path | None  # None: count(*)
    distinct: bool = False


@dataclass(frozen=True)
class Meta:
    name: str  # score or version


@dataclass(frozen=True)
class Distance:
    path: Path
    lat: object
    lon: object
    unit: str = "m"


@dataclass(frozen=True)
class Compare:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Between:
    path: object
    low: object
    high: object


@dataclass(frozen=True)
class In:
    path: object
    values: tuple


@dataclass(frozen=True)
class Like:
    path: Path
    pattern: object
    escape: str = "\\"


@dataclass(frozen=True)
class IsNull:
    path: Path


@dataclass(frozen=True)
class IsEmpty:
    path: Path


@dataclass(frozen=True)
class MemberOf:
    value: object
    path: Path


@dataclass(frozen=True)
class Const:
    value: bool


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Term:
    """Full text: words of value, within slop positions (phrase) or edits (single word)."""

    value: object
    slop: int | None = None


@dataclass(frozen=True)
class Regexp:
    value: str


@dataclass(frozen=True)
class TextRange:
    low: object
    high: object
    with_low: bool
    with_high: bool


@dataclass(frozen=True)
class Occur:
    sign: str  # + must, - must not, # filter
    part: object


@dataclass(frozen=True)
class Boost:
    part: object
    factor: float


@dataclass(frozen=True)
class FullText:
    path: Path
    clause: object


@dataclass(frozen=True)
class Knn:
    path: Path
    vector: object
    k: object
    filtering: object = None


@dataclass(frozen=True)
class Within:
    path: Path
    shape: str
    args: tuple


@dataclass(frozen=True)
class Order:
    key: object
    descending: bool = False


@dataclass(frozen=True)
class Join:
    path: Path
    alias: str
    kind: str = "inner"


@dataclass
class Statement:
    entity: str
    alias: str | None = None
    delete: bool = False
    distinct: bool = False
    select: list = field(default_factory=list)  # (expression, name or None)
    joins: list[Join] = field(default_factory=list)
    where: object = None
    group: list[Path] = field(default_factory=list)
    having: object = None
    order: list[Order] = field(default_factory=list)
