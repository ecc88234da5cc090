"""Scopes enrolled in parts, against the scope's one vault."""

import random

from pyspark.sql import functions as F

from maskwright.operators import vault
from maskwright.plans import apart, enrol

from .test_people import FAMILY, GIVEN


def rows_of(spark, found, salts, n):
    tokens, aliases = enrol.enrol(salts=salts, detections=found, scope_rows=n)
    told = []
    for df in (tokens, aliases):
        told.append([{k: v for k, v in r.asDict(True).items() if k != "seq"} for r in df.orderBy("scope_id", "seq").collect()])
    return told


def test_parts_of_a_scope_give_the_rows_of_its_one_vault(spark):
    r = random.Random(5)
    family = [a + b for a in ("Karst", "Moden", "Veril", "Tolb", "Sarn", "Дубр") for b in ("ov", "ova", "en", "ing", "ико")] + FAMILY
    rows = []
    for i in range(240):
        name = " ".join([r.choice(GIVEN), r.choice(family)] if r.random() < 0.3 else [r.choice(GIVEN) + "bcdfgh"[i % 6] + "eaiou"[i % 5] + "lmnrt"[i // 5 % 5], r.choice(family) + "klmpt"[i // 3 % 5] + "an"])
        kind, span = r.choice([("PERSON", name), ("PERSON", name), ("EMAIL", f"{name.split()[0].lower()}.{name.split()[-1].lower()}@ex{i}.org"), ("PHONE", f"+44 20 {i:07d}"), (apart.PLACE, name.split()[-1])])
        rows.append((i, f"s{i % 2}", 0, span, kind, r.choice(["en", "ru"])))
    found = spark.createDataFrame(rows, "doc_id long, scope_id string, ord int, span string, kind string, language string")
    salts = found.select("scope_id").distinct().withColumn("salt", F.lit(b"\x11" * 32))
    assert rows_of(spark, found, salts, 0) == rows_of(spark, found, salts, 10_000)


def test_a_token_that_another_part_holds_is_derived_again(spark):
    salt, seen, names = b"\x11" * 32, {}, None
    for i in range(100_000):
        name = "".join(chr(97 + int(c)) + "aeiou"[int(c) % 5] for c in f"{i:06d}").capitalize() + " " + "".join("bdfglmnrst"[int(c)] + "u" for c in f"{i * 7919 % 1_000_000:06d}").capitalize()
        t = vault.derive_token(salt, "PERSON", name)
        if t in seen:
            names = seen[t], name
            break
        seen[t] = name
    found = spark.createDataFrame([(i, "s", 0, n, "PERSON", "en") for i, n in enumerate([*names, "Anna Kovalenko"])], "doc_id long, scope_id string, ord int, span string, kind string, language string")
    salts = spark.createDataFrame([("s", bytearray(salt))], "scope_id string, salt binary")
    got = rows_of(spark, found, salts, 0)
    assert got == rows_of(spark, found, salts, 10_000)
    assert len({t["token"] for t in got[0]}) == len(got[0]) >= 3
    assert apart.large(enrol.distinct_detections(found), salts, 0).count() == 1
