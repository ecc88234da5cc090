"""What detectors find in large scopes, enrolled apart: no scope is one group.

Names of a scope bear on one another only through a key that both may claim or a part of theirs that lines up.  So each
detection is told by all such *marks* (`marks`, a superset), those that share one are tied, and each connected component is
enrolled by a vault of its own: the rows are those of the scope's one vault.  What they do share is the numbers of tokens:
of two that derive one token the later in the order of the whole scope yields, and its component is enrolled again
knowing what is taken, until no token is held twice.  A scope that names organisations is not cut, as those bear on whatever
text lies inside their names.  A component is one Python object: names that all share a part are one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import variants as V
from ..functions.fold import key
from ..operators.detect import PLACE
from ..operators.people import stems
from ..operators.vault import COMPANY_LIKE, LONGEST_KEY, Vault, attributes_row
from ..sources.held import hold

#: Detections of a scope up to which it is one group, and detections of a group of components, about.
SCOPE_ROWS, GROUP_ROWS = 10_000, 2000
_PLACE = "struct<language:string,phase:int,shorter:int,seq:decimal(38,0),k:string>"
_FIELDS = ("language", "phase", "shorter", "seq", "k")


def marks(span: str, kind: str) -> tuple[set[str], set[str]]:
    """(what ties a detection to all that share it, what ties it only to those that ask for it and is asked for by it: a subset of the former)."""
    surface = span.strip()
    names = list(dict.fromkeys((surface, N.trim_frame_words(surface)))) if kind == "PERSON" else []
    if kind == "EMAIL" and (name := N.person_from_email(surface)):
        names.append(name)
    held, loose, asks = {surface}, set(), set()
    bones: set[str] = set()
    for name in names:
        parts = [p for p, _ in V.person_fragments(name)]
        forms = [f for p in parts for f in (p, V.cyrillic_form(p)) if f]
        held |= {name, *V.person_variants(name), *parts, *(i for f in forms for i in V.russian_inflections(f))}
        skeleton = N.skeleton(name)
        bones |= {*skeleton, *map(N.skeleton_part, parts)}
        first = [f"~{b[0]}" for b in skeleton]
        loose |= {"".join(sorted(p)) for p in combinations(first, 2)}
        asks |= {"".join(sorted(p)) for p in combinations([f"~{b}" for b in skeleton if len(b) <= 1], 2)}
    whole = {f"={key(s)[:LONGEST_KEY]}" for s in held} | {f"-{s}" for b in bones if b for s in stems(b)}
    return whole | loose, whole | asks


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, units, asking = [], [], []
        for node, scope, span, kind in zip(*(batch[c].to_pylist() for c in ("node", "scope_id", "span", "kind")), strict=True):
            every, asks = marks(span, kind)
            for m in every:
                nodes.append(node)
                units.append(xxhash.xxh64_intdigest(f"{scope}\0{m}") - (1 << 63))
                asking.append(m in asks)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(units, pa.int64()), pa.array(asking, pa.bool_())], ["node", "unit", "asks"])


def _met(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    return a.hint("merge").join(b.hint("merge"), on, how)


def _components(nodes: DataFrame, groups: int) -> DataFrame:
    """(node, part): the smallest node that each is tied to over any number of ties."""
    units = hold(nodes.repartition(groups).mapInArrow(_marked, "node long, unit long, asks boolean"))
    first = units.groupBy("unit").agg(F.min("node").alias("part"), F.count("*").alias("n"), F.max("asks").alias("asked")).where("n > 1 and asked").select("unit", "part")
    ties = _met(units.select("unit", "node"), first, "unit").where("node <> part").select("node", F.col("part").alias("with")).distinct()
    ties = hold(ties.union(ties.select("with", "node")))
    at = hold(nodes.select("node", F.col("node").alias("part")))
    while True:
        near = _met(ties, at.select(F.col("node").alias("with"), "part"), "with").groupBy("node").agg(F.min("part").alias("near"))
        low = _met(at, near, "node", "left").select("node", "part", F.least("part", F.coalesce("near", "part")).alias("low"))
        on = low.groupBy("part").agg(F.min("low").alias("on"))  # a part that one of its nodes leaves is left by all
        new = hold(_met(low, on, "part").select("node", F.least("low", "on").alias("part"), (F.least("low", "on") < F.col("part")).alias("moved")))
        at = new.select("node", "part")
        if new.where("moved").isEmpty():
            return at


class _Taken:
    """Tokens that a vault may not mint: its own, and those that another component holds from earlier on."""

    def __init__(self, vault: Vault, others: dict[str, tuple]):
        self.vault, self.others = vault, others

    def __contains__(self, token: str) -> bool:
        return token in self.vault.by_token or (token in self.others and self.others[token] < self.vault.at)


_OUT = f"scope_id string, part long, tag string, i int, token string, place {_PLACE}, row string"
_AT = pa.struct([("language", pa.string()), ("phase", pa.int32()), ("shorter", pa.int32()), ("seq", pa.decimal128(38, 0)), ("k", pa.string())])
_ARROW = pa.schema([("scope_id", pa.string()), ("part", pa.int64()), ("tag", pa.string()), ("i", pa.int32()), ("token", pa.string()), ("place", _AT), ("row", pa.string())])


def _enrolled(table: pa.Table) -> pa.Table:
    parts: dict[tuple, tuple[list, dict]] = {}
    salts = {}
    for r in table.to_pylist():
        found, others = parts.setdefault((r["scope_id"], r["part"]), ([], {}))
        found.append((r["seq"], r["span"], r["kind"], r["language"] or "en"))
        salts[r["scope_id"]] = bytes(r["salt"])
        for t in r["taken"] or ():
            others[t["token"]] = tuple(t["place"][f] for f in _FIELDS)
    out = []
    for (scope, part), (found, others) in parts.items():
        v = Vault(salt=salts[scope])
        v.taken = _Taken(v, others)
        by_language: dict[str, list] = {}
        for seq, span, kind, language in sorted(found):
            by_language.setdefault(language, []).append((span, kind))
            v.seqs[span, kind] = seq
        for language, some in sorted(by_language.items()):
            v.absorb(some, language)
        rows = [("token", r.token, v.places[id(r)], {"token": r.token, "kind": r.kind, "real_value": r.real_value, "normalized": r.normalized, "status": r.status, "canonical_token": r.canonical_token, "attributes": attributes_row(r.attributes)}) for r in v.rows]
        rows += [("alias", a.token, v.places[id(a)], {"token": a.token, "surface": a.surface, "normalized": a.normalized, "source": a.source}) for a in v.aliases]
        out += [{"scope_id": scope, "part": part, "tag": tag, "i": i, "token": token, "place": dict(zip(_FIELDS, place, strict=True)), "row": json.dumps(row, ensure_ascii=False)} for i, (tag, token, place, row) in enumerate(rows)]
    return pa.Table.from_pylist(out, schema=_ARROW)


def _run(dealt: DataFrame, taken: DataFrame | None, groups: int) -> DataFrame:
    """dealt: detections with part, salt and group; taken: (part, token, place) of what others hold."""
    held = "array<struct<token:string,place:" + _PLACE + ">>"
    if taken is None:
        rows = dealt.withColumn("taken", F.lit(None).cast(held))
    else:
        rows = _met(dealt, taken.groupBy("part").agg(F.collect_list(F.struct("token", "place")).cast(held).alias("taken")), "part")
    return hold(rows.select("group", "scope_id", "part", "seq", "span", "kind", "language", "salt", "taken").repartition(groups, "group").groupBy("group").applyInArrow(_enrolled, _OUT))


def large(firsts: DataFrame, salts: DataFrame, scope_rows: int) -> DataFrame:
    """The scopes that are enrolled apart: of more detections, with a salt, without organisations."""
    sizes = firsts.groupBy("scope_id").agg(F.count("*").alias("n"), F.max(F.col("kind").isin(*COMPANY_LIKE)).alias("company"))
    return sizes.where((F.col("n") > scope_rows) & ~F.col("company")).join(salts.where("octet_length(salt) > 0").select("scope_id"), "scope_id", "left_semi").select("scope_id")


def enrol(firsts: DataFrame, salts: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(scope_id, tag, seq, row) of the vaults of distinct detections, as of one vault a scope; seq ascends in its order."""
    # (partitions by number, as few bytes are much work here)
    groups = max(-(-firsts.count() // group_rows), firsts.sparkSession.sparkContext.defaultParallelism)
    nodes = firsts.repartition(groups).withColumn("node", F.monotonically_increasing_id())
    if "language" not in nodes.columns:
        nodes = nodes.withColumn("language", F.lit("en"))
    nodes = hold(nodes.where(F.col("kind").isNotNull() & F.col("span").isNotNull()))
    dealt = _met(nodes, _components(nodes, groups), "node").join(F.broadcast(salts.select("scope_id", "salt")), "scope_id")
    dealt = hold(dealt.withColumn("group", F.pmod(F.xxhash64("part"), F.lit(groups))))
    done, taken = _run(dealt, None, groups), None
    while True:
        rows = done.where("tag = 'token'").select("scope_id", "token", "part", "place")
        twice = rows.groupBy("scope_id", "token").agg(F.count("*").alias("n"), F.min(F.struct("place", "part")).alias("first")).where("n > 1")
        late = hold(_met(rows, twice, ["scope_id", "token"]).where("part <> first.part").select("part", "token", F.col("first.place").alias("place")))
        if late.isEmpty():
            return done.orderBy("scope_id", "place", "part", "i").select("scope_id", "tag", F.monotonically_increasing_id().alias("seq"), "row")
        again = late.select("part").distinct()
        taken = late if taken is None else hold(taken.unionByName(late))
        mine = _met(taken, again, "part", "left_semi")
        done = hold(_met(done, again, "part", "left_anti").unionByName(_run(_met(dealt, again, "part", "left_semi"), mine, groups)))


__all__ = ["PLACE", "enrol", "large", "marks"]
