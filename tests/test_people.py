"""Distinct people, resolution and claims as joins, against one scope in memory."""

import random

import pytest

from maskwright.functions import names as N
from maskwright.operators.people import People, referent_score
from maskwright.plans import people

SCHEMA = "scope_id string, token string, name string, seeded boolean, number long"
GIVEN = ["Anna", "Annabel", "Alexander", "Alexandra", "A.", "Boris", "B.", "Maria", "Mariana", "Peter", "P.", "Ann-Marie", "Иван", "И."]
FAMILY = ["Kovalenko", "Kovalenkov", "Smith", "Smithson", "Petrov", "Petrova", "Petrovsky", "Lee", "de la Cruz", "Петров"]


def scope(r, n):
    out = []
    for i in range(n):
        parts = [r.choice(GIVEN) for _ in range(r.choice([0, 1, 1, 1, 2]))] + [r.choice(FAMILY) for _ in range(r.choice([1, 1, 1, 2]))]
        r.shuffle(parts)
        out.append((f"PERSON_{1000 + i}", " ".join(parts), r.random() < 0.1, 1000 + i))
    return out


def in_memory(rows):
    p = People()
    for token, name, seeded, number in rows:
        p.put(token, name, seeded, number)
    return p


@pytest.mark.parametrize("paired", [64, 3])
def test_small_scopes_equal_one_in_memory(spark, paired):
    r = random.Random(paired)
    scopes = {f"s{i}": scope(r, n) for i, n in enumerate([1, 2, 5, 20, 60])}
    df = spark.createDataFrame([(s, *row) for s, rows in scopes.items() for row in rows] + [("s1", None, "Anna Lee", False, 1), ("s1", "PERSON_1", None, False, 1), ("s1", "PERSON_2", " . ", False, 1)], SCHEMA)
    got = people.distinct_people(df, paired=paired)
    told = {}
    for row in got.collect():
        told.setdefault(row.scope_id, {})[row.token] = row.kept
    for s, rows in scopes.items():
        p = in_memory(rows)
        assert told[s] == {t: t in p.kept for t, *_ in rows}, s


def test_resolution_equals_one_in_memory(spark):
    r = random.Random(8)
    rows = scope(r, 50)
    asked = [(i, "s", " ".join(r.sample(GIVEN + FAMILY, r.choice([1, 2, 2, 3])))) for i in range(80)] + [(99, "other", "Anna Lee"), (100, "s", None), (101, None, "Anna Lee")]
    found = people.distinct_people(spark.createDataFrame([("s", *row) for row in rows], SCHEMA))
    out = people.resolved(found, spark.createDataFrame(asked, "i int, scope_id string, name string")).collect()
    p = in_memory(rows)
    assert len(out) == len(asked)
    for row in out:
        fits = p.fitting(N.skeleton(row["name"])) if row["name"] and row.scope_id == "s" else []
        assert (row.person, row.several) == (fits[0] if len(fits) == 1 else None, len(fits) > 1), row
        assert all(referent_score(p.bones[t], N.skeleton(row["name"])) >= 2 for t in fits)


def test_a_third_of_the_names_are_one_persons(spark):
    rows = [("s", f"PERSON_{i}", f"John M{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{i} Smith", False, i) for i in range(700)]
    rows += [("s", f"PERSON_{i}", f"Nam{i}x Fam{i}y", False, i) for i in range(1000, 1500)]
    got = {r.token: r.kept for r in people.distinct_people(spark.createDataFrame(rows, SCHEMA)).collect()}
    kept = in_memory([r[1:] for r in rows]).kept
    assert got == {t: t in kept for _, t, *_ in rows} and [t for t in got if got[t] and int(t[7:]) < 1000] == ["PERSON_0"]
    assert people.distinct_people(spark.createDataFrame([], SCHEMA)).collect() == []


def test_claims(spark):
    rows = [("s", "j smith", "J. Smith", "P_1"), ("s", "j smith", "J Smith", "P_2"), ("s", "j doe", "J. Doe", "P_1"), ("s", "j doe", "J. Doe", "P_1"), ("t", "j smith", "J. Smith", "P_9"), (None, "x", "X", "P_3"), ("s", None, "Y", "P_1")]
    got = {(r.scope_id, r.key): (r.surface, r.owner, r.several) for r in people.claims(spark.createDataFrame(rows, "scope_id string, key string, surface string, token string")).collect()}
    assert got == {("s", "j smith"): ("J Smith", None, True), ("s", "j doe"): ("J. Doe", "P_1", False), ("t", "j smith"): ("J. Smith", "P_9", False), (None, "x"): ("X", "P_3", False)}


def test_names_are_not_collected_to_be_broadcast(spark):
    rows = [("s", f"PERSON_{i}", f"Anna{i} Kovalenko{i}", False, i) for i in range(20)]
    found = people.distinct_people(spark.createDataFrame(rows, SCHEMA))
    keys = people._keys(found.selectExpr("monotonically_increasing_id() as node", "struct(token) as r", "scope_id", "bones")).selectExpr("*", "2L as n")
    for df in (people.resolved(found, found), people._edges(keys, found.selectExpr("monotonically_increasing_id() as node", "bones"), 512)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
