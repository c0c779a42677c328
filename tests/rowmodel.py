"""The fold, the match and the D&B match as a model over plain rows, one value at a time.

Nothing of the library is used: a state is a dict per attribute, and every rule is applied
to lists of what is known about one value.  It is slow and meant to be read.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from datetime import datetime

ORDER = ("companies_house_id", "duns_number", "company_name", "contact_email", "cdms_ref", "postcode")


@dataclass(frozen=True)
class Claim:
    """One normalised description."""

    id: str
    source: str
    datetime: datetime
    known: tuple[tuple[str, str], ...]

    def get(self, attribute: str) -> str | None:
        return dict(self.known).get(attribute)

    def row(self) -> tuple:
        return (self.id, self.source, self.datetime, *[self.get(a) for a in ORDER])


@dataclass
class Entry:
    was: int
    now: int
    source: str
    datetime: datetime


@dataclass
class Model:
    tables: dict[str, dict[str, Entry]] = field(default_factory=lambda: {a: {} for a in ORDER})
    last_id: int = 0

    def update(self, claims: list[Claim]) -> None:
        for level in range(len(ORDER)):
            self._decide(level, claims)

    def _decide(self, level: int, claims: list[Claim]) -> None:
        attribute, above = ORDER[level], ORDER[:level]
        table = self.tables[attribute]
        # clusters whose members are looked at again: the value's own one, else where the nearest attribute above came from
        open_clusters = set()
        for c in claims:
            value = c.get(attribute)
            if value in table:
                open_clusters.add(table[value].now)
            else:
                origins = [self.tables[a][c.get(a)].was for a in reversed(above) if c.get(a) is not None]
                open_clusters.update(origins[:1])
        # what is known about each value: (time, source) of its mentions, and per attribute above (time, cluster)
        mentions: dict[str, list] = defaultdict(list)
        partners: dict[str, dict[str, list]] = defaultdict(lambda: defaultdict(list))
        for c in claims:
            value = c.get(attribute)
            if value is None:
                continue
            mentions[value].append((c.datetime, c.source))
            for a in above:
                if c.get(a) is not None:
                    partners[value][a].append((c.datetime, self.tables[a][c.get(a)].now))
        for value, entry in table.items():
            if entry.now in open_clusters:
                mentions[value].append((entry.datetime, entry.source))
                for a in above:
                    partners[value][a] += [(e.datetime, e.now) for e in self.tables[a].values() if e.was == entry.now]
        decided: dict[str, int] = {}
        homeless = []
        for value in mentions:
            choice = next((max(partners[value][a])[1] for a in above if partners[value][a]), None)
            if choice is None and value in table:
                choice = table[value].now
            if choice is None:
                homeless.append((max(mentions[value])[0], value))
            else:
                decided[value] = choice
        for _, value in sorted(homeless):
            self.last_id += 1
            decided[value] = self.last_id
        for value, cluster in decided.items():
            old = table.get(value)
            if old is None or old.now != cluster:
                time, source = max(mentions[value])
                table[value] = Entry(cluster if old is None else old.now, cluster, source, time)

    def rows(self) -> list[tuple]:
        """(attribute, value, was, now, source, time), sorted."""
        return sorted((a, v, e.was, e.now, e.source, e.datetime) for a, t in self.tables.items() for v, e in t.items())

    def match(self, claim: Claim) -> tuple[str, int | None, str]:
        found = [self.tables[a][claim.get(a)].now if claim.get(a) in self.tables[a] else None for a in ORDER]
        chosen = next((f for f in found if f is not None), None)
        return claim.id, chosen, "".join("1" if chosen is not None and f == chosen else "0" for f in found)

    def dnb(self, claim: Claim) -> tuple[str, str | None, str]:
        """The claim's own D&B number, else the newest of its cluster (of equally new ones the smallest)."""
        _, cluster, similarity = self.match(claim)
        held = [(e.datetime, v) for v, e in self.tables["duns_number"].items() if e.now == cluster]
        newest = min((v for t, v in held if t == max(held)[0]), default=None)
        return claim.id, claim.get("duns_number") or newest, similarity
