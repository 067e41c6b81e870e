"""Property graph of entities and relations: upserts, neighbourhoods, inventories, changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import predicate_name
from millrace.operators.vectors import upserted
from millrace.session import SharedTables

EDGE = ["src_id", "predicate", "dst_id", "resource_id"]


def upsert_entities(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    return upserted(stored, fresh, ["entity_id"])


def upsert_relations(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    return upserted(stored, fresh, EDGE)


def valid_relations(found: DataFrame, entities: DataFrame) -> DataFrame:
    """Extracted relations whose subject and object are different known entities, each once.

    Predicates are normalised and contexts cut to 500 characters; of equal relations the one of the
    highest confidence stays, the first of equal ones.
    """
    names = entities.select(F.col("name")).distinct()
    rows = found.where("subject <> object")
    rows = rows.join(names.withColumnRenamed("name", "subject"), "subject", "left_semi").join(names.withColumnRenamed("name", "object"), "object", "left_semi")
    rows = rows.withColumns({"predicate": predicate_name("predicate"), "context": F.substring("context", 1, 500)})
    best = Window.partitionBy("subject", "predicate", "object").orderBy(F.col("confidence").desc_nulls_last(), "pos")
    return rows.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def inventory(relations: DataFrame, entities: DataFrame, resources: Sequence | None = None, project: object = None, limit: int = 200) -> DataFrame:
    """Relations with the names of both ends, of some resources or a project or all, the first ``limit`` in order."""
    rows = relations
    if resources is not None:
        rows = rows.where(F.col("resource_id").isin(list(resources)))
    if project is not None:
        rows = rows.where(F.col("project_id") == project)
    ends = entities.groupBy("entity_id").agg(F.min("name").alias("name"))
    rows = rows.join(ends.select(F.col("entity_id").alias("src_id"), F.col("name").alias("subject")), "src_id")
    rows = rows.join(ends.select(F.col("entity_id").alias("dst_id"), F.col("name").alias("object")), "dst_id")
    return rows.orderBy("subject", "predicate", "object", "src_id", "dst_id", "resource_id").limit(limit)


def distances(relations: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """entity_id, dist: entities within ``hops`` undirected steps of a seed, with their least distance.

    One equi-join per hop against the links of the frontier; what was reached is written between hops.
    """
    store = SharedTables(relations.sparkSession)
    links = relations.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"))
    links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    reached = store.put("hop-0", seeds.select("entity_id").distinct().withColumn("dist", F.lit(0)))
    schema = reached.schema
    for hop in range(1, hops + 1):
        frontier = store.get(schema, f"hop-{hop - 1}").select(F.col("entity_id").alias("a"))
        new = links.join(frontier, "a").select(F.col("b").alias("entity_id")).distinct()
        new = new.join(reached, "entity_id", "left_anti").withColumn("dist", F.lit(hop))
        store.put(f"hop-{hop}", new)
        reached = store.get(schema, *(f"hop-{k}" for k in range(hop + 1)))
    return reached


def neighbourhood(relations: DataFrame, entities: DataFrame, names: Sequence[str], hops: int = 2, project: object = None, limit: int | None = 50) -> DataFrame:
    """Relations on a path of at most ``hops`` (1 to 5) from the named entities, nearest first.

    The project filter holds for the named entities only; relations of other projects are walked.
    """
    hops = min(5, max(1, hops))
    seeds = entities.where(F.col("name").isin(list(names)))
    if project is not None:
        seeds = seeds.where(F.col("project_id") == project)
    near = distances(relations, seeds, hops - 1)
    a = near.select(F.col("entity_id").alias("src_id"), F.col("dist").alias("da"))
    b = near.select(F.col("entity_id").alias("dst_id"), F.col("dist").alias("db"))
    rows = relations.distinct().join(a, "src_id", "left").join(b, "dst_id", "left").withColumn("dist", F.least("da", "db")).where("dist is not null").drop("da", "db")
    rows = rows.orderBy("dist", "src_id", "predicate", "dst_id", "resource_id")
    return rows.limit(limit) if limit else rows


def change_predicate(relations: DataFrame, subject: object, old: str, target: object, resource: object, new: str) -> DataFrame:
    """The relation with another predicate; if it already exists, one of both stays.  No match changes nothing."""
    hit = (F.col("src_id") == subject) & (F.col("predicate") == old) & (F.col("dst_id") == target) & (F.col("resource_id") == resource)
    rows = relations.withColumn("predicate", F.when(hit, predicate_name(F.lit(new))).otherwise(F.col("predicate")))
    return rows.dropDuplicates(EDGE)


def delete_relation(relations: DataFrame, subject: object, predicate: str, target: object, resource: object) -> DataFrame:
    hit = (F.col("src_id") == subject) & (F.col("predicate") == predicate) & (F.col("dst_id") == target) & (F.col("resource_id") == resource)
    return relations.where(~F.coalesce(hit, F.lit(False)))


def delete_resource(relations: DataFrame, resource: object) -> DataFrame:
    return relations.where(~F.coalesce(F.col("resource_id") == resource, F.lit(False)))
