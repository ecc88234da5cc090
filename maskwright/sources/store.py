"""Vault tables on storage, seed files, and the logs beside them.

A vault is one folder with tokens, aliases and salts as Parquet, partitioned by scope, so that a scope is
read by partition pruning and rewritten by dynamic partition overwrite.  Logs are JSON lines.
"""

from __future__ import annotations

import secrets
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.spans import longest_prefix
from ..schemas import ALIASES, SALTS, SEED_ENTITIES, SEED_PARTIES, TOKENS

SCHEMAS = {"tokens": TOKENS, "aliases": ALIASES, "salts": SALTS}


class VaultStore:
    """The vault below a path; a table that has not been written is empty."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def load(self, name: str, scopes: list[str] | None = None) -> DataFrame:
        """tokens (active and retired), aliases or salts, of some scopes or all; reading never makes a salt."""
        schema = SCHEMAS[name]
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        out = self.spark.read.schema(schema).parquet(f"{self.path}/{name}").select(*self.spark.createDataFrame([], schema).columns)
        return out if scopes is None else out.where(F.col("scope_id").isin(*scopes))

    def commit(self, name: str, rows: DataFrame) -> bool:
        """Replace the scopes that rows hold, and only them; nothing is written for no rows.

        rows may come from the same table: they are written beside it first, so nothing is read from
        what is being replaced.
        """
        import uuid

        if rows.isEmpty():
            return False
        beside = f"{self.path}/_{name}-{uuid.uuid4().hex}"
        rows.write.parquet(beside)
        held = self.spark.read.schema(rows.schema).parquet(beside)
        held.repartition("scope_id").sortWithinPartitions("seq" if "seq" in rows.columns else "scope_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scope_id").parquet(f"{self.path}/{name}")
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(beside)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        return True

    def ensure_salts(self, scopes: DataFrame) -> DataFrame:
        """The salts of all scopes (scope_id), new ones of 32 random bytes for those without; a writing path only."""
        missing = scopes.select("scope_id").where("scope_id is not null").distinct().join(self.load("salts"), "scope_id", "left_anti")

        def draw(batches):
            import pyarrow as pa

            for batch in batches:
                salts = [secrets.token_bytes(32) for _ in range(len(batch))]
                yield pa.RecordBatch.from_arrays([batch["scope_id"], pa.array(salts, pa.binary())], ["scope_id", "salt"])

        # drawn once, as they are written; what is read afterwards is what is stored
        self._append("salts", missing.mapInArrow(draw, SALTS))
        return self.load("salts")

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("scope_id").parquet(f"{self.path}/{name}")


def merged(base: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of changed in place of those with the same keys, and behind them the new ones."""
    return base.join(changed.select(*keys), keys, "left_anti").unionByName(changed)


def load_seeds(spark: SparkSession, paths: list[str], default_scope: str = "default") -> tuple[DataFrame, DataFrame]:
    """(entities, parties) of TOML files with [[entity]] and [[party]] tables; one without its type or name is an error."""
    entities, parties = [], []
    for path in paths:
        with open(path, "rb") as f:
            data = tomllib.load(f)
        scope = data.get("scope", default_scope)
        for e in data.get("entity", ()):
            if not e.get("type") or not e.get("name"):
                raise ValueError(f"{path}: an entity without a type or a name")
            related = [(r.get("type"), r.get("target"), r.get("shareholding_pct")) for r in e.get("relationships", ())]
            facts = {k: str(v) for k, v in (e.get("attributes") or {}).items()}
            entities.append((e.get("scope", scope), e["type"], e["name"], e.get("identifier"), e.get("identifier_type"), e.get("jurisdiction_country"), e.get("role"), facts, related, len(entities)))
        for p in data.get("party", ()):
            if not p.get("name"):
                raise ValueError(f"{path}: a party without a name")
            parties.append((p.get("scope", scope), p["name"], p.get("role"), len(parties)))
    return spark.createDataFrame(entities, SEED_ENTITIES), spark.createDataFrame(parties, SEED_PARTIES)


def save_added(path: str, scope: str, names: list[dict]) -> None:
    """Names a person has added, as a seed file of the scope (written whole or not at all)."""
    import json

    text = f"scope = {json.dumps(scope)}\n" + "".join("\n[[entity]]\n" + "".join(f"{k} = {json.dumps(str(v), ensure_ascii=False)}\n" for k, v in n.items() if v) for n in names)
    target = Path(path)
    beside = target.with_name(target.name + ".tmp")
    beside.write_text(text, "utf-8")
    beside.replace(target)


def scope_of_folders(paths: DataFrame, routes: DataFrame) -> DataFrame:
    """paths (path) with the scope of the longest folder of routes (prefix, scope_id) they lie in."""
    return longest_prefix(paths, routes)


def put_restores(known: DataFrame, new: DataFrame) -> DataFrame:
    """(key, value, at): the latest value of each key."""
    w = Window.partitionBy("key").orderBy(F.desc("at"), F.desc("value"))
    return known.unionByName(new).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def get_restores(texts: DataFrame, known: DataFrame, text_col: str = "text") -> DataFrame:
    """texts with original: what the model wrote where the person was given this text; null for none."""
    return texts.withColumn("_key", F.sha2(text_col, 256)).join(known.select(F.col("key").alias("_key"), F.col("value").alias("original")), "_key", "left").drop("_key")


def append_log(rows: DataFrame, path: str) -> None:
    """Audit, usage and record lines, appended as JSON."""
    rows.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_annotations(annotations: DataFrame, path: str) -> None:
    """One JSON line an annotation (id, document, annotation as JSON), in a folder for each document."""
    annotations.write.mode("append").partitionBy("document").json(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotations that are about the document whose folder they lie in; the others are left out."""
    rows = spark.read.schema("id string, annotation string, document string").json(path)
    return rows.where(F.get_json_object("annotation", "$.target.source") == F.col("document"))


def scan_folder(spark: SparkSession, path: str, most: int = 2 << 20, skip: tuple[str, ...] = (".git", "node_modules", "__pycache__", ".venv")) -> DataFrame:
    """(path, digest, length) of the files below a folder, large ones and tools' folders left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kept = files.where(F.col("length") <= most)
    for s in skip:
        kept = kept.where(~F.contains("path", F.lit(f"/{s}/")))
    return kept.select("path", F.sha2("content", 256).alias("digest"), "length")
