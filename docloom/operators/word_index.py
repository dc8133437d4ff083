"""A BM25 index that is kept up with its documents: postings in buckets of words, one segment for each change.

``postings`` (word, id, tf) lie in folders by segment and bucket, a hash of the word, so a
search opens the buckets of its words alone. ``live`` says for each document which
segment holds its postings; those of other segments are dead and are passed over.
``vocabulary`` has the number of live documents of each word, and ``stats`` what the
scores need besides. A change writes a segment of each table and no earlier file; ``stats``
comes last and is what readers go by, so they see a change whole or not at all, and a
repeated change gives the same segment.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import prepare
from ..functions.text import words
from ..sources.segments import last_segment, read_segments, write_segment
from . import retrieval as S

BUCKETS = 64


def _counted(batches):
    """Documents (id, w) -> word, id, tf: a document is one row, so its words are counted in place."""
    for batch in batches:
        words = pc.dictionary_encode(batch.column(1).flatten())
        at = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(1)).to_numpy())
        n = max(len(words.dictionary), 1)
        key, tf = np.unique(at * n + words.indices.to_numpy(), return_counts=True)
        yield pa.record_batch([words.dictionary.take(pa.array(key % n)), batch.column(0).take(pa.array(key // n)), pa.array(tf, pa.int64())], names=["word", "id", "tf"])


@dataclass(frozen=True)
class WordIndex:
    spark: SparkSession
    folder: str
    id_type: str = "string"
    buckets: int = BUCKETS

    def _read(self, name: str) -> DataFrame:
        schemas = {"postings": f"word string, id {self.id_type}, tf long, bucket int", "live": f"id {self.id_type}, dl int, born long", "vocabulary": "word string, df long, bucket int", "stats": "n_docs long, words long, mean_idf double"}
        return read_segments(self.spark, f"{self.folder}/{name}", schemas[name])

    def _at(self, name: str, segment: int) -> DataFrame:
        return self._read(name).where(F.col("segment") == segment).drop("segment")

    def _bucket(self):
        return F.pmod(F.xxhash64("word"), F.lit(self.buckets)).cast("int")

    def change(self, rows: DataFrame, segment: int) -> None:
        """Rows (id, text), each id once: a text replaces the document's former one, null removes it.

        ``segment`` follows the last one, or is the last one again. Added words cost what
        they are; removed or replaced documents cost a look through the postings for theirs.
        """
        prepare(self.spark)
        changed = rows.select(F.col("id").cast(self.id_type).alias("id"), words(F.col("text")).alias("w"))
        added = changed.where("w is not null")
        counted = added.mapInArrow(_counted, f"word string, id {self.id_type}, tf long").withColumn("bucket", self._bucket())
        # Rebalancing gives each bucket few files and splits those of very common words.
        write_segment(counted.hint("rebalance", "bucket"), f"{self.folder}/postings", segment, "bucket")
        before = self._at("live", segment - 1)
        gone = before.join(changed.select("id"), "id", "left_semi")
        # Hashing the few that are gone spares a sort of all postings.
        lost = self._read("postings").where(F.col("segment") < segment).join(gone.select("id", F.col("born").alias("segment")).hint("shuffle_hash"), ["id", "segment"], "left_semi")
        moved = self._at("vocabulary", segment - 1).select("word", "df").unionByName(self._at("postings", segment).select("word", F.lit(1).cast("long").alias("df"))).unionByName(lost.select("word", F.lit(-1).cast("long").alias("df")))
        counts = moved.groupBy("word").agg(F.sum("df").alias("df")).where("df > 0").withColumn("bucket", self._bucket())
        write_segment(counts.hint("rebalance", "bucket"), f"{self.folder}/vocabulary", segment, "bucket")
        kept = before.join(changed.select("id"), "id", "left_anti")
        write_segment(kept.unionByName(added.select("id", F.size("w").alias("dl"), F.lit(segment).cast("long").alias("born"))), f"{self.folder}/live", segment)
        size = self._at("live", segment).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words"))
        idf = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        mean = self._at("vocabulary", segment).crossJoin(F.broadcast(size)).agg(F.avg(idf).alias("mean_idf"))
        write_segment(size.crossJoin(mean), f"{self.folder}/stats", segment)

    def last(self) -> int:
        """The segment that readers see; -1 for an index without any."""
        return last_segment(self.spark, f"{self.folder}/stats")

    def _of_words(self, asked: DataFrame, segment: int, wanted: list[int]) -> DataFrame:
        rows = self._read("postings").where(F.col("bucket").isin(wanted) & (F.col("segment") <= segment))
        return rows.join(asked.select("word").distinct(), "word", "left_semi")

    def postings_of(self, asked: DataFrame, segment: int) -> DataFrame:
        """Live postings (word, id, tf, dl) of the words asked for. At most ``buckets`` numbers come to the driver."""
        wanted = [r.bucket for r in asked.select(self._bucket().alias("bucket")).distinct().collect()]
        return self._of_words(asked, segment, wanted).join(self._at("live", segment).withColumnRenamed("born", "segment"), ["id", "segment"]).select("word", "id", "tf", "dl")

    def scores(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """Queries (query_id, text) -> query_id, id, score, as ``retrieval.bm25_scores`` over the live documents; with k, candidates for each query's k best."""
        prepare(self.spark)
        segment = self.last()
        asked = queries.select("query_id", F.explode(words(F.col("text"))).alias("word")).groupBy("query_id", "word").agg(F.count(F.lit(1)).alias("qtf"))
        wanted = [r.bucket for r in asked.select(self._bucket().alias("bucket")).distinct().collect()]
        stats = F.broadcast(self._at("stats", segment))
        raw = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        weights = self._at("vocabulary", segment).where(F.col("bucket").isin(wanted)).join(asked, "word").crossJoin(stats)
        weights = weights.select("query_id", "word", (F.col("qtf") * F.when(raw < 0, S.EPSILON * F.col("mean_idf")).otherwise(raw)).alias("weight"))
        # The words asked for of each document in one row: rows do not multiply with the queries.
        listed = self._of_words(asked, segment, wanted).groupBy("id", "segment").agg(F.collect_list(F.struct("word", "tf")).alias("x"))
        live = self._at("live", segment).withColumnRenamed("born", "segment")
        rows = listed.join(live, ["id", "segment"]).crossJoin(stats).select("id", "dl", (F.col("words") / F.col("n_docs")).alias("avgdl"), F.col("x.word").alias("words"), F.col("x.tf").alias("tfs"))
        return S.word_scores(queries, weights, rows, k)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, id, score, rank of the k best documents; as ``retrieval.bm25_top_k``, others fill up with score 0 in id order."""
        return S.best_with_fill(self.scores(queries, k), queries, self._at("live", self.last()).select("id"), k)

    def merged(self, folder: str) -> WordIndex:
        """A copy of the index in one segment at another place, without what is dead."""
        other, at = WordIndex(self.spark, folder, self.id_type, self.buckets), self.last()
        live = self._at("live", at)
        rows = self._read("postings").join(live.select("id", F.col("born").alias("segment")), ["id", "segment"], "left_semi").select("word", "id", "tf", "bucket")
        write_segment(rows.hint("rebalance", "bucket"), f"{folder}/postings", 0, "bucket")
        write_segment(self._at("vocabulary", at).hint("rebalance", "bucket"), f"{folder}/vocabulary", 0, "bucket")
        write_segment(live.withColumn("born", F.lit(0).cast("long")), f"{folder}/live", 0)
        write_segment(self._at("stats", at), f"{folder}/stats", 0)
        return other
