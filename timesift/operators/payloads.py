"""Nested payloads of any shape and depth: every node as a row, and what may not be kept in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timesift.functions import fixed
from timesift.session import cut_lineage


def nodes(payloads: DataFrame) -> DataFrame:
    """(payload_id, path, key, kind, value) of every node of ``(payload_id, payload VARIANT)``.

    ``path`` is ``payload.a[0].b``, ``key`` the node's own field name (null in a list and at the root),
    ``kind`` one of OBJECT, ARRAY or the type of the value. One level is opened at a time for all payloads, so the
    rounds are as many as the deepest payload has levels, and a table of one level is written a round. Null payloads
    have no node.
    """
    spark = payloads.sparkSession
    level = cut_lineage(payloads.where("payload IS NOT NULL").select(
        "payload_id", F.lit("payload").alias("path"), F.lit(None).cast("string").alias("key"), F.col("payload").alias("value")))
    found = None
    while not level.isEmpty():
        kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
        seen = level.withColumn("kind", kind)
        found = seen if found is None else found.unionByName(seen)
        inner = seen.where("kind IN ('OBJECT', 'ARRAY')").select(
            "payload_id", F.col("path").alias("outer_path"), F.col("value").alias("outer_value"))
        opened = inner.lateralJoin(spark.tvf.variant_explode(F.col("outer_value").outer()))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.col("key"))).otherwise(
            F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = cut_lineage(opened.select("payload_id", F.concat("outer_path", step).alias("path"), "key", "value"))
    if found is None:
        found = level.withColumn("kind", F.lit(None).cast("string"))
    return found.select("payload_id", "path", "key", "kind", "value")


def payload_violations(payloads: DataFrame, secret_key: str = fixed.SECRET_KEY, secret_text: str = fixed.SECRET_TEXT) -> DataFrame:
    """(payload_id, path, rule) of JSON texts ``(payload_id, payload)``, one row for each rule a node breaks.

    A text that is no JSON, or repeats a field within one object, breaks the rule of its own at the root. Null
    payloads break none. Nodes below a refused field are looked at, too.
    """
    parsed = payloads.select("payload_id", "payload", F.try_parse_json("payload").alias("tree"))
    broken = parsed.where("payload IS NOT NULL AND tree IS NULL").select(
        "payload_id", F.lit("payload").alias("path"), F.lit("is not JSON").alias("rule"))
    all_nodes = nodes(parsed.select("payload_id", F.col("tree").alias("payload")))
    said = F.when(F.col("kind") == "STRING", F.try_variant_get("value", "$", "string"))
    filled = F.when(F.col("kind") == "STRING", said != "").otherwise(
        F.col("kind").isin("OBJECT", "ARRAY") & ~F.to_json("value").isin("{}", "[]"))
    rules = F.array_compact(F.array(
        F.when(F.col("key").rlike(secret_key), "secret-like field"),
        F.when(F.lower("key").isin(*fixed.MEDIA_KINDS) & filled, "persisted media"),
        F.when(said.contains("\u0000") | said.rlike(secret_text), "secret-like text"),
        F.when(_private(said), "absolute private path"),
        F.when(said.contains("://") & (said.contains("?") | said.contains("#")), "non-canonical URL")))
    return all_nodes.select("payload_id", "path", F.explode(rules).alias("rule")).unionByName(broken)


def _private(said: Column) -> Column:
    """Rooted, drive, network and home paths of any system, and file addresses."""
    return said.rlike(r"^(?:/|~/|\\|[A-Za-z]:\S|(?i:file:))")
