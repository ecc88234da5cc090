"""Secret scans over an incremental ledger of content-addressed blobs, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content.  The ledger holds which blob has
been scanned for which version of which rule; only pairs that it does not hold are scanned, once each,
however many paths share a blob, so a new rule is run alone over known blobs.  Findings are then joined
back to all paths.  Ledger and findings are Parquet below one folder.

One row of each unseen blob is elected on addresses alone; texts are not shuffled while the elected fit
MOST_ELECTED.  Beyond, each map task's first row of a blob is sent, and one is scanned.

Places are code points: with m1, m2, … the matches of a pattern and p0, p1, … the text between them,
match i begins at |p0| + |m1| + p1 … + |p(i-1)|, whatever the width of the characters.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C


@dataclass(frozen=True)
class Rule:
    """A pattern, the whole of which is the span; `group`, if not 0, must have `least` characters, else the match is dropped."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1
    #: A cheap pattern without which the rule cannot match.
    needs: str = ""

    @property
    def id(self) -> str:
        """A name for this version of the rule: it changes when its pattern, bound or version does."""
        return f"{self.kind}@{hashlib.sha256(repr((self.pattern, self.least, self.group, self.version)).encode()).hexdigest()[:12]}"


#: The base rules; spans of the same start are ordered as their rules are listed.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, needs=r"(?i)(?:pass(?:word|wd)|secret|token|api_?key)[\"']?\x20*[:=]"),
    Rule("access", r"AKIA[A-Z0-9]+", 20, needs="AKIA"),
    # a maximal run: the same matches as [0-9a-f]+ with the short ones dropped
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+", 24, needs="[0-9a-f]{24}"),
)
#: Further kinds that the ledger's operator looks for.
MORE_RULES = (
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}+", 40, needs="gh[pousr]_"),
    Rule("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}+", 15, needs="xox[abprs]-"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 30, needs="eyJ"),
    Rule("pem", r"-----BEGIN (?:[A-Z]{2,12} )?PRIVATE KEY-----", 27, needs="PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES
_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("rank", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("end", T.IntegerType())]))


def _none() -> Column:
    return F.array().cast(_SPAN)


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's spans of a text, in order; the text must not be null."""
    told = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda g: F.length(g))

    def found(p: Column) -> Column:
        one = lambda r: F.struct(r["s"]["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), r["s"]["end"].alias("end"))
        return F.transform(F.filter(p, lambda r: r["n"] >= rule.least), one).cast(_SPAN)

    pairs = F.arrays_zip(C.match_spans(text, rule.pattern).alias("s"), told.alias("n"))
    return F.when(text.rlike(rule.needs or rule.pattern), C.let(pairs, found)).otherwise(_none())


def _ledger(spark, folder: str, name: str, schema: str) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(f"{folder}/{name}") if there else spark.createDataFrame([], schema)


#: The pairs that have been scanned, and what was found: one row for each blob of a scan.
LEDGER = "blob string, rules array<string>"
FINDINGS = "blob string, rules array<string>, spans array<struct<start:int,end:int,kind:string,rule:string>>"
#: Elected rows (some 60 bytes each) and spans (some 60 bytes each) up to which they are broadcast.
MOST_ELECTED, MOST_SPANS = 1_000_000, 300_000
#: What is to be scanned of a blob: the numbers of the rules.
TODO = "array<smallint>"


def pairs_scanned(spark, ledger: str) -> int:
    """How many (blob, rule version) pairs a ledger holds."""
    pairs = _ledger(spark, ledger, "blobs", LEDGER).select("blob", F.explode("rules").alias("rule")).distinct()
    return pairs.count()


def _scan(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """FINDINGS of rows (blob, content, todo: the numbers of the rules)."""
    found, ids = [], []
    for i, r in enumerate(rules):
        due = F.array_contains("todo", F.lit(i).cast("smallint"))
        named = F.transform(spans_of(F.col("content"), r, i), lambda s: F.struct(s["start"], s["end"], s["kind"], F.lit(r.id).alias("rule")))  # noqa: B023
        found.append(F.when(due, named).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string,rule:string>>")))
        ids.append(F.when(due, F.lit(r.id)))
    return rows.select("blob", F.array_compact(F.array(*ids)).alias("rules"), F.concat(*found).alias("spans"))


def scan_versions(versions: DataFrame, ledger: str, content_col: str = "text", rules: tuple[Rule, ...] = RULES, most_elected: int = MOST_ELECTED) -> DataFrame:
    """Every row of versions with _blob, its content's SHA-256, and _spans, its findings (start, rank, kind, end), by start, then rank.

    ledger: a folder in shared storage; (blob, rule version) pairs that it already holds are not scanned,
    the others are scanned once each and added to it.  Null content counts as empty; no row is lost; rows
    with equal content share their findings; an empty table gives an empty result.
    """
    spark = versions.sparkSession
    content = F.coalesce(F.col(content_col), F.lit(""))
    address = F.sha2(content.cast("binary"), 256)
    known = _ledger(spark, ledger, "blobs", LEDGER).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("held"))
    held = F.coalesce("held", F.array().cast("array<string>"))
    numbers = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.id, i)])
    of = lambda ids: F.transform(ids, lambda r: numbers[r].cast("smallint"))
    every = F.array(*(F.lit(i).cast("smallint") for i in range(len(rules))))
    todo = F.array_except(every, of(held))
    rows = versions.select(F.monotonically_increasing_id().alias("rid"), address.alias("blob"), content.alias("content"))
    elected = rows.groupBy("blob").agg(F.min("rid").alias("rid")).join(known, "blob", "left").select("blob", "rid", todo.alias("todo")).where("size(todo) > 0")
    pending = f"{ledger}/pending/{uuid.uuid4().hex}"
    elected.write.parquet(pending)
    elected = spark.read.schema(f"blob string, rid long, todo {TODO}").parquet(pending)
    if elected.count() <= most_elected:
        chosen = rows.join(F.broadcast(elected.select("rid", "todo")), "rid")
        cores = spark.sparkContext.defaultParallelism
        if versions._jdf.rdd().getNumPartitions() < cores:  # a table of few files
            chosen = chosen.repartition(cores, "rid")
        _scan(chosen, rules).write.mode("append").parquet(f"{ledger}/findings")
    # what has not been scanned yet: all of it beyond MOST_ELECTED, else rows that were numbered otherwise at the second reading
    done = _ledger(spark, ledger, "findings", FINDINGS).select(F.col("blob").alias("b"), F.explode("rules").alias("r")).where(F.col("r").isin(*(r.id for r in rules)))
    done = done.groupBy("b").agg(F.collect_set("r").alias("done"))
    left = elected.join(done, F.col("blob") == F.col("b"), "left").select("blob", F.array_except("todo", F.coalesce(of(F.col("done")), F.array().cast(TODO))).alias("todo")).where("size(todo) > 0")
    if not left.isEmpty():
        one = rows.groupBy("blob").agg(F.first("content").alias("content"))
        _scan(one.join(left, "blob"), rules).write.mode("append").parquet(f"{ledger}/findings")
    # recorded last: a scan that was cut short is done again, and a blob scanned twice counts once
    findings = _ledger(spark, ledger, "findings", FINDINGS)
    findings.join(elected.select("blob"), "blob", "left_semi").select("blob", "rules").write.mode("append").parquet(f"{ledger}/blobs")
    current = F.filter("spans", lambda s: s["rule"].isin(*(r.id for r in rules)))
    some = findings.select("blob", current.alias("spans")).where(F.size("spans") > 0)
    total = some.agg(F.sum(F.size("spans"))).first()[0] or 0
    ranked = F.transform(F.flatten(F.collect_list("spans")), lambda s: F.struct(s["start"], numbers[s["rule"]].alias("rank"), s["kind"], s["end"]))
    # equal neighbours of the sorted spans (array_distinct compares all with all)
    unlike = C.let(F.array_sort(ranked), lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1))))
    once = some.groupBy(F.col("blob").alias("_found")).agg(unlike.cast(_SPAN).alias("_spans"))
    out = versions.withColumn("_blob", address)
    out = out.join(F.broadcast(once) if total <= MOST_SPANS else once, F.col("_blob") == F.col("_found"), "left")
    return out.drop("_found").withColumn("_spans", F.coalesce("_spans", _none()))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span (one that begins within another before it goes with that) replaced by [kind]."""

    def apart(s: Column) -> Column:
        before = C.running(F.transform(s, lambda x: x["end"]), 0, lambda top, end: F.greatest(top, end))  # where all spans before it end
        rows = F.filter(F.arrays_zip(s.alias("s"), before.alias("at")), lambda r: r["s"]["start"] >= r["at"])
        ends = F.concat(F.slice(F.transform(rows, lambda r: r["at"]), 2, F.size(rows)), F.array(F.array_max(F.transform(s, lambda x: x["end"]))))
        return F.zip_with(rows, ends, lambda r, end: F.struct(r["s"]["start"].alias("start"), end.alias("end"), F.concat(F.lit("["), r["s"]["kind"], F.lit("]")).alias("value")))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return C.replaced(text, C.let(spans, lambda s: F.when(F.size(s) > 0, apart(s)).otherwise(none)))
