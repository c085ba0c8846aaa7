"""A trigram index of names, paths and summaries: substring search reads postings, and texts of candidates only.

Two tables in a folder, both only ever appended to. ``grams``: each distinct trigram of a lower-cased text with the text's
field and id, in folders by a hash of the trigram. ``texts``: the lower-cased texts, in folders by a hash of the id, each with
the number of the change that brought it. A later change of a text (or its removal, which is a null text) is a row of a
higher number; candidates are held against the latest text, so that old postings can mislead no search.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfinder.operators.lookup import summary_text
from wayfinder.schema import Model
from wayfinder.shared import BROADCAST_ROWS, fresh_path, materialize

#: Folders of each table; trigrams of a token that are looked up (a longer token's candidates are verified like any other's).
BUCKETS, MOST_GRAMS = 64, 62
GRAM = 3
GRAMS = "field string, id string, gram string, bucket int"
TEXTS = "field string, id string, text string, change int, bucket int"


def grams_of(low: Column) -> Column:
    """Distinct trigrams of a text, by characters; looks ahead, so that each place of the text is visited once."""
    return F.array_distinct(F.regexp_extract_all(low, F.lit("(?s)(?=(...))"), F.lit(1)))


def bucket_of(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(BUCKETS)).cast("int")


def searched_texts(entities: DataFrame, summaries: DataFrame) -> DataFrame:
    """field, id, text of what substring search looks into."""
    named = entities.select("id", F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("name", "path")))))
    return named.select("field", "id", "text").unionByName(summaries.select(F.lit("summary").alias("field"), F.col("entity_id").alias("id"), summary_text().alias("text")))


@dataclass(frozen=True)
class TextIndex:
    spark: SparkSession
    folder: str
    change: int = 0

    @staticmethod
    def build(m: Model, folder: str | None = None) -> TextIndex:
        spark = m.entities.sparkSession
        return TextIndex(spark, folder or fresh_path(spark, "text-index"), -1).put(searched_texts(m.entities, m.summaries))

    def put(self, texts: DataFrame) -> TextIndex:
        """The index after texts (field, id, text) were added, changed or, with a null text, taken away; each key stands once."""
        change = self.change + 1
        low = materialize(texts.select("field", "id", F.lower("text").alias("text")), "texts")
        rows = low.withColumns({"change": F.lit(change), "bucket": bucket_of(F.col("id"))})
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "field", "id").write.mode("append").partitionBy("bucket").parquet(f"{self.folder}/texts")
        grams = low.where("text is not null").select("field", "id", F.explode(grams_of(F.col("text"))).alias("gram")).withColumn("bucket", bucket_of(F.col("gram")))
        # sorted by trigram, so that a lookup reads few row groups; a large folder is split over several tasks
        grams.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram", "field", "id").write.mode("append").partitionBy("bucket").parquet(f"{self.folder}/grams")
        return TextIndex(self.spark, self.folder, change)

    def remove(self, keys: DataFrame) -> TextIndex:
        """The index without the texts of keys (field, id)."""
        return self.put(keys.select("field", "id", F.lit(None).cast("string").alias("text")))

    def texts(self) -> DataFrame:
        return self.spark.read.schema(TEXTS).parquet(f"{self.folder}/texts").where(F.col("change") <= self.change)

    def candidates(self, tokens: list[str]) -> DataFrame:
        """field, id, token: texts that hold, or held, all trigrams of a token of three characters or more."""
        pairs = [(t, g, 1 << k) for t in tokens for k, g in enumerate(dict.fromkeys(t[i : i + GRAM] for i in range(min(len(t), MOST_GRAMS) - GRAM + 1)))]
        wanted = self.spark.createDataFrame(pairs, "token string, gram string, bit long")
        full = self.spark.createDataFrame([(t, (1 << sum(p[0] == t for p in pairs)) - 1) for t in tokens], "token string, full long")
        looked_up = sorted({p[1] for p in pairs})
        folders = [r[0] for r in wanted.select(bucket_of(F.col("gram")).alias("b")).distinct().collect()]  # BUCKETS at most
        grams = self.spark.read.schema(GRAMS).parquet(f"{self.folder}/grams").where(F.col("bucket").isin(folders) & F.col("gram").isin(looked_up))
        # trigrams of the query's tokens are few
        met = grams.join(F.broadcast(wanted), "gram").groupBy("field", "id", "token").agg(F.bit_or("bit").alias("has"))
        return met.join(F.broadcast(full), "token").where("has = full").select("field", "id", "token")

    def find(self, tokens: list[str]) -> DataFrame:
        """id, field, token: which tokens (lower-cased) stand where. Tokens of fewer than three characters scan the texts."""
        long, short = [t for t in tokens if len(t) >= GRAM], [t for t in tokens if len(t) < GRAM]
        found = self.spark.createDataFrame([], "id string, field string, token string")
        if long:
            met = materialize(self.candidates(long).withColumn("bucket", bucket_of(F.col("id"))), "met")
            few = met.count() <= BROADCAST_ROWS
            # the folders of the candidates' ids are known when the texts are scanned, and others are passed over
            texts = self.texts().join(F.broadcast(met) if few else met, ["bucket", "field", "id"])
            last = texts.groupBy("field", "id", "token").agg(F.max_by(F.struct(F.col("text").contains(F.col("token")).alias("holds")), "change").alias("last"))
            found = found.unionByName(last.where("last.holds").select("id", "field", "token"))
        if short:
            holds = F.array_compact(F.array(*(F.when(F.col("text").contains(t), F.lit(t)) for t in short)))
            last = self.texts().select("field", "id", "change", holds.alias("holds")).groupBy("field", "id").agg(F.max_by(F.struct("holds"), "change").alias("last"))
            found = found.unionByName(last.select("id", "field", F.explode("last.holds").alias("token")))
        return found
