"""Facts and entities stored in equal buckets of their key, so that joining and grouping by it moves no row.

Both tables are written once as bucketed, sorted tables. Spark knows their layout: a join on the key
and a grouping by it run bucket by bucket without an exchange, as often as they are asked for. A bucket
holds all rows of its keys, so keys that own more than 1 / ``HOT_SHARE`` of the facts do not go into
buckets. There are fewer than ``HOT_SHARE`` of them, so their entities are small enough to be broadcast
to their facts, which lie in a plain table and are combined in their tasks before they are grouped.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actorlens.sources.storage import materialise, scratch_path

HOT_SHARE = 1000
#: Facts of a bucket that are wanted.
BUCKET_ROWS = 2_000_000


def write_bucketed(df: DataFrame, key: str, buckets: int, name: str | None = None) -> str:
    """Store ``df`` in buckets of ``key``, one sorted file each; returns the table's name."""
    spark, name = df.sparkSession, name or f"bucketed_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    writer.option("path", scratch_path(spark, name)).saveAsTable(name)
    return name


@dataclass(frozen=True)
class CoPartitioned:
    """Names of the bucketed tables, and the facts and entities of hot keys, if there are any."""

    spark: SparkSession
    key: str
    facts: str
    entities: str
    hot_facts: DataFrame | None
    hot_entities: DataFrame | None

    @classmethod
    def build(
        cls, facts: DataFrame, entities: DataFrame, key: str, buckets: int | None = None, hot_share: int = HOT_SHARE
    ) -> CoPartitioned:
        """Store both tables; facts without a key meet no entity and are left out, as in an inner join.

        Without ``buckets`` their number follows from the facts.
        """
        spark, known = facts.sparkSession, facts.filter(F.col(key).isNotNull())
        counts = materialise(known.groupBy(key).agg(F.count("*").alias("_rows")))
        total = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
        hot = materialise(counts.filter(F.col("_rows") * hot_share > max(total, hot_share)).select(key))
        buckets = buckets or max(1, -(-total // BUCKET_ROWS))
        hot_facts = hot_entities = None
        if not hot.isEmpty():
            few = F.broadcast(hot)
            hot_facts = materialise(known.join(few, key, "left_semi"))
            hot_entities = materialise(entities.join(few, key, "left_semi"))
            known, entities = known.join(few, key, "left_anti"), entities.join(few, key, "left_anti")
        return cls(
            spark, key, write_bucketed(known, key, buckets), write_bucketed(entities, key, buckets), hot_facts, hot_entities
        )

    def _sides(self) -> tuple[DataFrame, DataFrame]:
        return self.spark.table(self.facts), self.spark.table(self.entities).hint("merge")

    def join(self) -> DataFrame:
        """Every fact with the columns of its entity; neither table is shuffled."""
        facts, entities = self._sides()
        joined = facts.join(entities, self.key)
        if self.hot_facts is None:
            return joined
        return joined.unionByName(self.hot_facts.join(F.broadcast(self.hot_entities), self.key))

    def attach(self, aggregates: list[Column], how: str = "left") -> DataFrame:
        """Every entity with aggregates over its facts, nulls where it has none; ``how='inner'`` drops those.

        Facts are grouped in their buckets, then meet the entities there.
        """
        facts, entities = self._sides()
        grouped = facts.groupBy(self.key).agg(*aggregates)
        result = entities.join(grouped, self.key, how)
        if self.hot_facts is None:
            return result
        hot = self.hot_facts.groupBy(self.key).agg(*aggregates)
        # Hot keys have facts, so an inner join loses none of their entities.
        return result.unionByName(self.hot_entities.join(hot, self.key, how))

    def drop(self) -> None:
        """Forget the bucketed tables; their files go with the session."""
        for name in (self.facts, self.entities):
            self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")
