"""Branch metadata: segments, branches, checkpoints, table versions and the list of commits.

All of it is small, lives on the driver and is published as one JSON version at a time. A fork
or checkpoint never starts a Spark job.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field, fields, replace

from ramus.plans.allocator import LONG_DOMAIN, Allocator, IntervalExhausted


class BranchError(RuntimeError):
    pass


@dataclass
class Segment:
    id: int
    parent: int
    owner: str
    kind: str  # mutable, checkpoint, fork_base or merge
    lo: int
    hi: int
    point: int


@dataclass
class Branch:
    id: str
    current: int
    first: int
    parent: str | None = None
    kind: str = "mutable"
    children: int = 0
    checkpoints: int = 0
    created_at: float = 0.0
    metadata: dict = field(default_factory=dict)


@dataclass
class Checkpoint:
    id: str
    branch: str
    segment: int
    next_lo: int
    children: int = 0
    metadata: dict = field(default_factory=dict)


@dataclass
class Binding:
    """A table's shape over an interval; version None is a dropped table."""

    lo: int
    hi: int
    version: int | None
    seq: int


@dataclass
class Table:
    name: str
    pk: list[str]
    bindings: list[Binding] = field(default_factory=list)
    indexes: dict[str, list[str]] = field(default_factory=dict)
    #: Whether equal values written on both sides of a merge agree (vectors) or conflict.
    agree: bool = False


@dataclass
class Version:
    id: int
    table: str
    ddl: str
    pk: list[str]
    defaults: dict[str, str] = field(default_factory=dict)


@dataclass
class Commit:
    """A folder of version rows, no key twice. Rows of a plain commit share interval and writer; a base
    holds non-overlapping intervals of many writers."""

    seq: int
    version: int
    path: str
    lo: int
    hi: int
    writer: int
    rows: int
    base: bool = False
    #: Files of others, without the interval columns: all their rows share the commit's.
    adopted: bool = False
    #: SQL literals of columns that were added after the files were written; files may hold dropped ones of that name.
    fill: dict[str, str] = field(default_factory=dict)
    #: Shared with an older version of the table: only the part of its rows' intervals inside the commit's counts.
    shared: bool = False


@dataclass
class Catalog:
    domain: int = LONG_DOMAIN
    segments: dict[int, Segment] = field(default_factory=dict)
    branches: dict[str, Branch] = field(default_factory=dict)
    checkpoints: dict[str, Checkpoint] = field(default_factory=dict)
    tables: dict[str, Table] = field(default_factory=dict)
    versions: dict[int, Version] = field(default_factory=dict)
    commits: list[Commit] = field(default_factory=list)
    streams: dict[str, int] = field(default_factory=dict)
    next_segment: int = 1
    next_version: int = 1
    next_seq: int = 1

    @classmethod
    def new(cls, domain: int = LONG_DOMAIN) -> Catalog:
        c = cls(domain)
        root = c.add_segment(0, "main", "mutable", 0, domain)
        c.branches["main"] = Branch("main", root.id, root.id, created_at=time.time())
        return c

    def to_json(self) -> dict:
        """Plain dicts and lists, which share what they hold with the catalog: to be written at once."""
        d = dict(vars(self))
        for name in ("segments", "branches", "checkpoints", "versions"):
            d[name] = {k: vars(x) for k, x in d[name].items()}
        d["tables"] = {k: vars(t) | {"bindings": [vars(b) for b in t.bindings]} for k, t in self.tables.items()}
        d["commits"] = [vars(x) for x in self.commits]
        return d

    @classmethod
    def from_json(cls, d: dict) -> Catalog:
        def load(kind, x):
            return kind(**{f.name: x[f.name] for f in fields(kind) if f.name in x})

        c = cls(d["domain"], next_segment=d["next_segment"], next_version=d["next_version"], next_seq=d["next_seq"])
        c.segments = {int(k): load(Segment, v) for k, v in d["segments"].items()}
        c.branches = {k: load(Branch, v) for k, v in d["branches"].items()}
        c.checkpoints = {k: load(Checkpoint, v) for k, v in d["checkpoints"].items()}
        c.tables = {k: load(Table, v) for k, v in d["tables"].items()}
        for t in c.tables.values():
            t.bindings = [load(Binding, b) for b in t.bindings]
        c.versions = {int(k): load(Version, v) for k, v in d["versions"].items()}
        c.commits = [load(Commit, x) for x in d["commits"]]
        c.streams = d.get("streams", {})
        return c

    def copy(self) -> Catalog:
        """A catalog to change. Segments, versions, commits and bindings are never changed themselves, so both share them."""
        return replace(
            self, segments=dict(self.segments), versions=dict(self.versions), commits=list(self.commits), streams=dict(self.streams),
            branches={k: replace(b, metadata=dict(b.metadata)) for k, b in self.branches.items()},
            checkpoints={k: replace(c, metadata=dict(c.metadata)) for k, c in self.checkpoints.items()},
            tables={k: replace(t, bindings=list(t.bindings), indexes=dict(t.indexes)) for k, t in self.tables.items()},
        )

    # -- segments ----------------------------------------------------------------------------
    def add_segment(self, parent: int, owner: str, kind: str, lo: int, hi: int, point: int | None = None) -> Segment:
        s = Segment(self.next_segment, parent, owner, kind, lo, hi, lo + (hi - lo) // 2 if point is None else point)
        if not s.lo <= s.point < s.hi:
            raise IntervalExhausted("an empty interval")
        self.segments[s.id] = s
        self.next_segment += 1
        return s

    def ancestry(self, segment: int) -> list[Segment]:
        """The segment and its ancestors, nearest first."""
        out = []
        while segment:
            out.append(self.segments[segment])
            segment = out[-1].parent
        return out

    def branch(self, name: str) -> Branch:
        if name not in self.branches:
            raise BranchError(f"branch not found: {name}")
        return self.branches[name]

    def head(self, name: str) -> Segment:
        return self.segments[self.branch(name).current]

    def depth(self, name: str) -> int:
        n, b = 0, self.branch(name)
        while b.parent:
            n, b = n + 1, self.branches[b.parent]
        return n

    # -- lifecycle ----------------------------------------------------------------------------
    def fork(self, name: str, source: str, allocator: Allocator, terminal=False, fanout=0, width=None, metadata=None) -> Branch:
        """Split the source's interval into fork base [lo, lo+1), child and continuation."""
        b = self.branch(source)
        if name in self.branches:
            raise BranchError(f"branch already exists: {name}")
        if b.kind == "terminal":
            raise BranchError(f"a terminal branch can't be forked: {source}")
        s, first = self.segments[b.current], self.segments[b.first]
        w = allocator.child_width(s.hi - s.lo, first.hi - first.lo, self.depth(source), b.children, fanout, terminal, width)
        base = self.add_segment(s.id, source, "fork_base", s.lo, s.lo + 1)
        child = self.add_segment(base.id, name, "mutable", s.lo + 1, s.lo + 1 + w)
        rest = self.add_segment(base.id, source, "mutable", child.hi, s.hi, child.hi)
        b.current, b.children = rest.id, b.children + 1
        self.branches[name] = Branch(name, child.id, child.id, source, "terminal" if terminal else "mutable", created_at=time.time(), metadata=metadata or {})
        return self.branches[name]

    def checkpoint(self, name: str, branch: str, allocator: Allocator, metadata=None) -> Checkpoint:
        b = self.branch(branch)
        if name in self.checkpoints:
            raise BranchError(f"checkpoint already exists: {name}")
        if b.kind == "terminal":
            raise BranchError(f"a terminal branch has no checkpoints: {branch}")
        s = self.segments[b.current]
        cut = s.lo + allocator.checkpoint_width(s.hi - s.lo, b.checkpoints)
        rest = self.add_segment(s.id, branch, "mutable", cut, s.hi)
        kept = self.add_segment(s.id, branch, "checkpoint", s.lo, cut)
        b.current, b.checkpoints = rest.id, b.checkpoints + 1
        self.checkpoints[name] = Checkpoint(name, branch, kept.id, kept.lo, metadata=metadata or {})
        return self.checkpoints[name]

    def fork_checkpoint(self, name: str, checkpoint: str, allocator: Allocator, metadata=None) -> Branch:
        """A branch from a checkpoint; its coordinates are never given to another."""
        if checkpoint not in self.checkpoints:
            raise BranchError(f"checkpoint not found: {checkpoint}")
        if name in self.branches:
            raise BranchError(f"branch already exists: {name}")
        c = self.checkpoints[checkpoint]
        kept = self.segments[c.segment]
        w = (kept.hi - c.next_lo - 1) // (allocator.harmonic + c.children + 1)
        if w < 2:
            raise IntervalExhausted("no room for another branch of this checkpoint")
        base = self.add_segment(kept.id, c.branch, "fork_base", c.next_lo, c.next_lo + 1)
        child = self.add_segment(base.id, name, "mutable", c.next_lo + 1, c.next_lo + 1 + w)
        c.next_lo, c.children = child.hi, c.children + 1
        self.branches[name] = Branch(name, child.id, child.id, c.branch, created_at=time.time(), metadata=metadata or {})
        return self.branches[name]

    def delete(self, name: str) -> list[str]:
        """Delete a branch with its descendants and their checkpoints."""
        if name == "main":
            raise BranchError("main can't be deleted")
        self.branch(name)
        gone = [name]
        for n in gone:
            gone += [b.id for b in self.branches.values() if b.parent == n]
        for n in gone:
            del self.branches[n]
        self.checkpoints = {k: c for k, c in self.checkpoints.items() if c.branch not in gone}
        return gone

    def reachable(self) -> set[int]:
        heads = [b.current for b in self.branches.values()] + [c.segment for c in self.checkpoints.values()]
        return {s.id for h in heads for s in self.ancestry(h)}

    # -- merge geometry ------------------------------------------------------------------------
    def merge_base(self, source: int, target: int) -> tuple[int, set[int], set[int]]:
        """(base point, writers after it on the source side, on the target side)."""
        a, b = self.ancestry(source), self.ancestry(target)
        theirs = {s.id for s in b}
        shared = next((s for s in a if s.id in theirs and s.kind == "fork_base"), None) or next((s for s in a if s.id in theirs), None)
        if shared is None:
            raise BranchError("no common ancestor")
        def after(chain):
            out = []
            for s in chain:
                if s.id == shared.id:
                    return out
                out.append(s)
            return out
        left, right = after(a), after(b)
        point = shared.point
        if shared.kind != "fork_base":  # parted at a checkpoint: its snapshot is the base
            point = next((s.point for s in [*reversed(left), *reversed(right)] if s.kind == "checkpoint"), shared.lo)
        writers = lambda chain: {s.id for s in chain if s.kind in ("mutable", "merge")}
        return point, writers(left), writers(right)

    def merge_segments(self, target: str) -> tuple[Segment, Segment]:
        """The segment a merge writes to, and the branch's continuation."""
        b = self.branch(target)
        s = self.segments[b.current]
        lo = s.point + 1 if s.point + 3 < s.hi else s.lo
        if s.hi - lo < 3:
            raise IntervalExhausted("no room for a merge")
        merge = self.add_segment(s.id, target, "merge", lo, s.hi, lo)
        rest = self.add_segment(merge.id, target, "mutable", lo + 1, s.hi, lo + 1)
        b.current = rest.id
        return merge, rest

    def state(self, branch: str) -> tuple:
        """What a read of the branch depends on: its head, and the newest commit and shape it sees."""
        s = self.head(branch)
        commits = [c.seq for c in self.commits if c.lo <= s.point < c.hi]
        shapes = [b.seq for t in self.tables.values() for b in t.bindings if b.lo <= s.point < b.hi]
        return s.id, max(commits, default=0), len(commits), max(shapes, default=0)

    # -- tables ----------------------------------------------------------------------------------
    def bound(self, table: str, point: int) -> Version | None:
        t = self.tables.get(table)
        here = [b for b in t.bindings if b.lo <= point < b.hi] if t else []
        if not here:
            return None
        v = max(here, key=lambda b: b.seq).version
        return None if v is None else self.versions[v]

    def visible_tables(self, point: int) -> list[str]:
        return [t for t in self.tables if self.bound(t, point)]

    def bind(self, table: str, pk: list[str], segment: Segment, ddl: str | None, defaults=None) -> Version | None:
        t = self.tables.setdefault(table, Table(table, pk))
        v = None
        if ddl is not None:
            v = Version(self.next_version, table, ddl, pk, defaults or {})
            self.versions[v.id] = v
            self.next_version += 1
        t.bindings.append(Binding(segment.lo, segment.hi, v.id if v else None, self.next_seq))
        self.next_seq += 1
        return v
