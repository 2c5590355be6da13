"""Families of texts against brute force, and without keys where rounds tie them."""

import random

import pytest
from pyspark.sql import functions as F

from quillmark.llm import neardup


def shares_two(rows):
    """Brute force: the sets of texts that two collections of several components connect."""
    holders = {}
    for sid, component, own in rows:
        for c in own:
            holders.setdefault(c, {})[sid] = component
    parent = {sid: sid for sid, _, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, of_a, own_a in rows:
        for b, of_b, own_b in rows:
            if of_a != of_b and len(set(own_a) & set(own_b)) > 1:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    sets = {}
    for sid, _, _ in rows:
        sets.setdefault(root(sid), set()).add(sid)
    return {frozenset(x) for x in sets.values() if len(x) > 1}


@pytest.mark.parametrize("seed", range(2))
def test_families_are_those_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    # groups around their own collections, some of which meet others
    rows = [(k, k, sorted(rng.sample([100 * (k % 9) + j for j in range(9)] + [5000 + rng.randrange(60)], rng.randint(2, 6)))) for k in range(120)]
    table = spark.createDataFrame([(s, 10, c, own) for s, c, own in rows], "sid long, n_shingles long, component long, own array<long>")
    found = {}
    for r in neardup._families(table).collect():
        found.setdefault(r.family, set()).add(r.sid)
    assert {frozenset(x) for x in found.values()} == shares_two(rows)


def test_a_large_group_leaves_no_keys(spark, monkeypatch):
    left = []
    monkeypatch.setattr(neardup, "_key_ties", lambda table, ties=getattr(neardup, "_key_ties", None): left.append(table.count()) or ties(table), raising=False)
    rng = random.Random(1)
    table = spark.createDataFrame([(k, 10, k, rng.sample(range(36), 12)) for k in range(300)], "sid long, n_shingles long, component long, own array<long>")
    families = neardup._families(table)
    assert families.agg(F.count("*"), F.countDistinct("family")).first() == (300, 1)
    assert left == [0]


def test_many_small_families_beside_a_large_one_leave_few_keys(spark, monkeypatch):
    left = []
    monkeypatch.setattr(neardup, "_key_ties", lambda table, ties=neardup._key_ties: left.extend(len(r.own) * (len(r.own) - 1) // 2 for r in table.collect()) or ties(table))
    rng = random.Random(2)
    rows = [(k, 10, k, sorted(rng.sample(range(36), 24))) for k in range(150)]
    # each of these meets some texts of the large family in two collections
    rows += [(1000 + k, 10, 1000 + k, rng.sample(rows[k][3], 2)) for k in range(150)]
    table = spark.createDataFrame(rows, "sid long, n_shingles long, component long, own array<long>")
    found = {}
    for r in neardup._families(table).collect():
        found.setdefault(r.family, set()).add(r.sid)
    assert {frozenset(x) for x in found.values()} == shares_two([(s, c, own) for s, _, c, own in rows])
    assert sum(left) <= 8 * len(rows)
