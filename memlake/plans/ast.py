"""Syntax tree."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Param:
    name: str


# conditions
@dataclass
class Compare:
    field: str
    op: str
    value: object


@dataclass
class Within:
    field: str
    values: list | Param
    negated: bool = False


@dataclass
class IsNull:
    field: str
    negated: bool = False


@dataclass
class Matches:
    field: str
    how: str  # contains, starts
    text: str


@dataclass
class IsCategory:
    field: str
    category: str


@dataclass
class Not:
    inner: object


@dataclass
class Both:
    left: object
    right: object


@dataclass
class Either:
    left: object
    right: object


@dataclass
class Stage:
    name: str
    args: tuple = ()


# statements
@dataclass
class Recall:
    grain_type: str | None
    about: str | None = None
    where: object = None
    recent: int | None = None
    since: str | None = None
    until: str | None = None
    limit: int | None = None
    contradictions: bool = False
    contradictions_of: object = None
    mine: bool = False


@dataclass
class SetOp:
    op: str
    operands: list


@dataclass
class Exists:
    recall: Recall


@dataclass
class History:
    hash: str | None = None
    where: object = None
    diff: str | None = None


@dataclass
class Source:
    label: str
    query: object = None
    literal: str | None = None
    hashes: list | None = None
    pin: bool = False


@dataclass
class Assemble:
    topic: str
    sources: list[Source]
    audience: str | None = None
    budget: int | None = None
    unit: str = "tokens"
    priority: dict[str, float] = field(default_factory=dict)
    stream: bool = False


@dataclass
class Coalesce:
    branches: list


@dataclass
class Batch:
    entries: dict


@dataclass
class EntityAt:
    subject: str
    relation: str
    at: int
    axis: str = "world"


@dataclass
class RunTrace:
    run_id: str
    limit: int | None = None


@dataclass
class RunsTouching:
    hash: str
    depth: int = 8


@dataclass
class DerivedFrom:
    hash: str


@dataclass
class ShowForks:
    pass


@dataclass
class Related:
    start: str
    via: list[str]
    direction: str = "out"
    depth: int = 1
    limit: int = 256


@dataclass
class Novelty:
    text: str
    subject: str | None = None
    relation: str | None = None
    limit: int = 5


@dataclass
class Describe:
    what: str
    argument: str | None = None


@dataclass
class Explain:
    query: object


@dataclass
class ReportSubject:
    subject: str
    text_mentions: bool = False


@dataclass
class Add:
    grain_type: str
    fields: dict
    reason: str
    options: dict = field(default_factory=dict)


@dataclass
class AddWorkflow:
    name: str
    edges: list[tuple[str, str]]
    bindings: dict
    reason: str
    supersedes: str | None = None


@dataclass
class Supersede:
    hash: str
    fields: dict
    reason: str


@dataclass
class Accumulate:
    grain_type: str
    where: object
    adds: dict
    sets: dict
    reason: str


@dataclass
class Merge:
    subject: str
    relation: str
    object: str
    confidence: float
    reason: str


@dataclass
class Remember:
    content: str
    options: dict


@dataclass
class Forget:
    hash: str | None = None
    subject: str | None = None
    text_mentions: bool = False
    reason: str | None = None


@dataclass
class Purge:
    age_ms: int
    grain_type: str | None
    ns: str | None
    limit: int
    reason: str


@dataclass
class DefineQuery:
    name: str
    params: list[str]
    body: str


@dataclass
class RunQuery:
    name: str
    args: dict


@dataclass
class DefineTemplate:
    name: str
    sections: dict[str, str]
    extends: str | None = None


@dataclass
class Drop:
    kind: str
    name: str


@dataclass
class Grant:
    verbs: list[str]
    ns: str
    to: str
    revoke: bool = False


@dataclass
class ShowGrants:
    pass


@dataclass
class Governance:
    action: str
    target: str
    reason: str | None = None


@dataclass
class Let:
    name: str
    extractor: str
    recall: object


@dataclass
class Query:
    statement: object
    lets: list[Let] = field(default_factory=list)
    stages: list[Stage] = field(default_factory=list)
    options: dict = field(default_factory=dict)
    formats: list[tuple[str, str | None]] = field(default_factory=list)
    where_after: object = None
