"""The fold against the row model: many random histories, and histories with a story.

Histories whose values are their own do not meet, so hundreds of them are folded side by
side in one state: only the ids of new clusters are dealt over all of them, which the
model does as well.
"""

import random
from datetime import datetime, timedelta

from matchfold import StateStore, match, update_mappings
from matchfold.operators.state import empty_state
from matchfold.schema import DESCRIPTION_SCHEMA
from matchfold.session import scratch_path
from tests.rowmodel import ORDER, Claim, Model

SHORT = dict(zip(("register", "dnb", "name", "domain", "crm", "postcode"), ORDER))


def claim(number, year, month=1, source="dit.crm", **known):
    """A description made in a month of a year, its attributes by their short names."""
    return Claim(str(number), source, datetime(year, month, 1), tuple((SHORT[k], v) for k, v in known.items()))


def frame(spark, claims):
    return spark.createDataFrame([c.row() for c in claims], DESCRIPTION_SCHEMA)


def state_rows(state):
    return sorted((r.attribute, r.value, r.prev_match_id, r.match_id, r.source, r.datetime) for r in state.long().collect())


def agree(spark, state, model, probes):
    assert state_rows(state) == model.rows()
    assert state.last_id == model.last_id
    batch = frame(spark, probes)
    assert sorted(tuple(r) for r in match(state, batch).collect()) == sorted(model.match(c) for c in probes)
    assert sorted(tuple(r) for r in match(state, batch, dnb=True).collect()) == sorted(model.dnb(c) for c in probes)


def random_batches(seed, worlds, batches):
    """Each world holds few values per attribute, so its claims meet, disagree and move clusters; times come in
    any order and repeat."""
    rng = random.Random(seed)
    out, number = [], 0
    for _ in range(batches):
        batch = []
        for world in range(worlds):
            for _ in range(rng.randint(0, 3)):
                number += 1
                density = rng.choice((0.25, 0.5, 0.8))
                known = tuple((a, f"{a[:2]}{world}v{rng.randint(1, 3)}") for a in ORDER if rng.random() < density)
                at = datetime(2000, 1, 1) + timedelta(days=rng.randint(0, 12))
                batch.append(Claim(str(number), rng.choice(("dit.crm", "register")), at, known))
        out.append(batch)
    return out


def test_random_histories(spark):
    state, model, seen = empty_state(spark), Model(), []
    for batch in random_batches(3, worlds=200, batches=3):
        state = update_mappings(state, frame(spark, batch))
        model.update(batch)
        seen += batch
        assert state_rows(state) == model.rows()
    agree(spark, state, model, seen)
    moved = [r for r in model.rows() if r[2] != r[3]]
    assert len(moved) > 50  # the histories do disagree


def test_random_histories_in_a_store(spark):
    """The same through layers, buckets and the index, with small batches that read only a few buckets."""
    store, model, seen = StateStore(spark, scratch_path(spark, "t-histories"), buckets=2, max_layers=2), Model(), []
    for i, batch in enumerate(random_batches(71, worlds=9, batches=4)):
        state = store.update(frame(spark, batch), batch_id=i)
        model.update(batch)
        seen += batch
        assert state_rows(state) == model.rows()
    agree(spark, state, model, seen)


#: Each story: its batches, and groups of (attribute, value) that must end in one cluster, each group in another.
STORIES = {
    "a renamed company keeps its cluster": (
        [
            [claim(1, 2004, register="sc700001", name="harbourfoods", postcode="ab11zz")],
            [claim(2, 2009, register="sc700001", name="tidewaykitchens")],
            [claim(3, 2011, name="tidewaykitchens", domain="tideway.example")],
        ],
        [{("register", "sc700001"), ("name", "harbourfoods"), ("name", "tidewaykitchens"), ("domain", "tideway.example"), ("postcode", "ab11zz")}],
    ),
    "a domain follows its newest owner, whatever arrives late": (
        [
            [claim(1, 2006, register="ni610001", domain="orchard.example")],
            [claim(2, 2014, register="ni610002", domain="orchard.example")],
            [claim(3, 2010, register="ni610003", domain="orchard.example")],
        ],
        [{("register", "ni610002"), ("domain", "orchard.example")}, {("register", "ni610001")}, {("register", "ni610003")}],
    ),
    "a postcode of two tenants in one batch": (
        [
            [
                claim(1, 2016, 5, register="oc440001", postcode="ls29zz"),
                claim(2, 2016, 9, register="oc440002", postcode="ls29zz"),
                claim(3, 2016, 2, crm="880044", postcode="ls27zz"),
            ],
        ],
        [{("register", "oc440001")}, {("register", "oc440002"), ("postcode", "ls29zz")}, {("crm", "880044"), ("postcode", "ls27zz")}],
    ),
    "what hung on a number moves with it when the register is learned": (
        [
            [claim(1, 2012, dnb="771000123", crm="660012"), claim(2, 2012, 3, dnb="771000123", postcode="eh39zz")],
            [claim(3, 2012, 6, register="sc700009", dnb="771000123")],
            [claim(4, 2012, 8, crm="660012"), claim(5, 2012, 9, postcode="eh39zz")],
        ],
        [{("register", "sc700009"), ("dnb", "771000123"), ("crm", "660012"), ("postcode", "eh39zz")}],
    ),
    "claims that know nothing leave no trace": (
        [[claim(1, 2018), claim(2, 2019)], [claim(3, 2017, name="quarryworks"), claim(4, 2018)]],
        [{("name", "quarryworks")}],
    ),
    "the same claims again change nothing": (
        [
            [claim(1, 2015, dnb="771000900", name="millgate"), claim(2, 2015, 4, name="millgate", domain="millgate.example")],
            [claim(1, 2015, dnb="771000900", name="millgate"), claim(2, 2015, 4, name="millgate", domain="millgate.example")],
        ],
        [{("dnb", "771000900"), ("name", "millgate"), ("domain", "millgate.example")}],
    ),
}


def test_stories(spark):
    """All stories side by side: their values are their own, like the worlds above."""
    state, model, seen = empty_state(spark), Model(), []
    for turn in range(max(len(batches) for batches, _ in STORIES.values())):
        batch = [c for batches, _ in STORIES.values() for c in batches[turn : turn + 1] for c in c]
        state = update_mappings(state, frame(spark, batch))
        model.update(batch)
        seen += [Claim(f"{len(seen)}-{c.id}", c.source, c.datetime, c.known) for c in batch]
    probes = list({c.id: c for c in seen}.values())
    agree(spark, state, model, probes)
    cluster = {(r.attribute, r.value): r.match_id for r in state.long().collect()}
    for name, (_, groups) in STORIES.items():
        ends = [{cluster[SHORT[a], v] for a, v in group} for group in groups]
        assert all(len(e) == 1 for e in ends), (name, ends)
        assert len(set.union(*ends)) == len(groups), (name, ends)


def test_numbers_of_new_clusters(spark):
    """Oldest first by a value's newest mention, then by value; the attributes in their order."""
    batch = [
        claim(1, 2021, register="fc030003"),
        claim(2, 2019, register="fc030001"),
        claim(3, 2022, register="fc030001"),
        claim(4, 2021, register="fc030002"),
        claim(5, 2001, name="unregistered"),
    ]
    state = update_mappings(empty_state(spark), frame(spark, batch))
    got = {r.value: r.match_id for r in state.long().collect()}
    assert got == {"fc030002": 1, "fc030003": 2, "fc030001": 3, "unregistered": 4}
