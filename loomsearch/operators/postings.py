"""The keyword index: an inverted index as tables.

postings(term, id, tf, dl) with the document's length beside each posting, so scoring
needs no join with the documents; documents(id, dl) with one row per document, also of
those without tokens; terms(term, df); statistics(n, total_dl, avgdl) with one row.
Terms and statistics follow from the first two and are kept where the index is kept,
so a search touches the postings of its own terms only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stem_rows, tokens


@dataclass(frozen=True)
class KeywordIndex:
    postings: DataFrame
    documents: DataFrame
    stemming: bool = True
    kept_terms: DataFrame | None = None
    kept_statistics: DataFrame | None = None

    def terms(self) -> DataFrame:
        """term and df, the number of documents that have it."""
        return self.postings.groupBy("term").agg(F.count("*").alias("df")) if self.kept_terms is None else self.kept_terms

    def statistics(self) -> DataFrame:
        """n, total_dl and avgdl of the indexed documents; avgdl 0.0 when empty."""
        if self.kept_statistics is not None:
            return self.kept_statistics
        sums = self.documents.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("total_dl"))
        return sums.withColumn("avgdl", F.when(F.col("n") > 0, F.col("total_dl") / F.col("n")).otherwise(F.lit(0.0)))

    def term_statistics(self) -> DataFrame:
        """term, df and idf of every term."""
        one_row = F.broadcast(self.statistics().select("n"))
        return self.terms().join(one_row, how="cross").select("term", "df", idf(F.col("df"), F.col("n")).alias("idf"))

    def doc_count(self) -> int:
        return self.documents.count()

    def vocab_size(self) -> DataFrame:
        return self.terms().agg(F.count("*").alias("vocab_size"))

    def of_terms(self, terms: list[str]) -> KeywordIndex:
        """The index as far as some terms go; statistics stay those of all documents."""
        named = F.col("term").isin(terms)
        kept = None if self.kept_terms is None else self.kept_terms.where(named)
        return KeywordIndex(self.postings.where(named), self.documents, self.stemming, kept, self.kept_statistics)

    def term_freqs(self, term: str) -> DataFrame:
        """(id, tf) of the documents that have the first token `term` is analysed to."""
        first = F.get(tokens(F.lit(term), self.stemming), F.lit(0))
        return self.postings.where(F.col("term") == first).select("id", "tf")

    def term_freq(self, doc_id, term: str) -> int:
        """Frequency of a term in one document, 0 where it is not."""
        row = self.term_freqs(term).where(F.col("id") == doc_id).head()
        return row.tf if row else 0

    def which(self, ids: DataFrame) -> DataFrame:
        """(id, held) of every row of ids(id): whether the document is indexed."""
        own = self.documents.select("id", F.lit(True).alias("held"))
        return ids.select("id").join(own, "id", "left").select("id", F.coalesce("held", F.lit(False)).alias("held"))

    def contains(self, doc_id) -> bool:
        return not self.documents.where(F.col("id") == doc_id).isEmpty()

    def ids(self) -> DataFrame:
        return self.documents.select("id")

    def add(self, docs: DataFrame) -> KeywordIndex:
        """The index with documents (id, text) added; those of a known id replace it."""
        more = build_index(docs, self.stemming)
        kept = self.remove(docs.select("id"))
        return KeywordIndex(kept.postings.unionByName(more.postings), kept.documents.unionByName(more.documents), self.stemming)

    def remove(self, ids: DataFrame) -> KeywordIndex:
        """The index without the documents of ids(id); terms that only they had go."""
        gone = ids.select("id").distinct()
        return KeywordIndex(self.postings.join(gone, "id", "left_anti"), self.documents.join(gone, "id", "left_anti"), self.stemming)

    def persist(self) -> KeywordIndex:
        """The index held by the executors. Postings are dealt and sorted by term, so a
        search moves its few query terms to them and not them to the query."""
        level = StorageLevel.MEMORY_AND_DISK
        by_term = self.postings.repartition("term").sortWithinPartitions("term")
        kept = KeywordIndex(by_term.persist(level), self.documents.persist(level), self.stemming)
        return KeywordIndex(kept.postings, kept.documents, self.stemming, kept.terms().persist(level), kept.statistics().persist(level))


def idf(df, n):
    """ln((n - df + 0.5) / (df + 0.5) + 1); 0 where no document has the term."""
    return F.when((df > 0) & (n > 0), F.log((n - df + 0.5) / (df + 0.5) + 1.0)).otherwise(F.lit(0.0))


def latest(docs: DataFrame, order: str) -> DataFrame:
    """Of rows that share an id the one with the highest order."""
    newest = Window.partitionBy("id").orderBy(F.desc(order))
    return docs.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")


def build_index(docs: DataFrame, stemming: bool = True) -> KeywordIndex:
    """Indexes docs(id, text), whose ids are unique. A null text has no tokens; the
    document still counts. The texts are dealt by id once; counting a document's terms
    and the terms of a later join on id then need no further shuffle."""
    dealt = docs.select("id", "text").repartition("id").select("id", tokens("text", stemming=False).alias("tokens"))
    sized = dealt.select("id", "tokens", F.size("tokens").alias("dl"))
    # From a plain explode the optimizer would infer a filter that analyses texts twice.
    exploded = sized.select("id", "dl", F.explode_outer("tokens").alias("word")).where("word IS NOT NULL")
    # A word is stemmed once for each document, not each time it stands there; documents
    # lie whole in their partition, so neither count moves rows.
    counted = exploded.groupBy("id", "word").agg(F.count("*").alias("n"), F.first("dl").alias("dl"))
    stemmed = stem_rows(counted, "word", "term") if stemming else counted.withColumnRenamed("word", "term")
    postings = stemmed.groupBy("id", "term").agg(F.sum("n").cast("int").alias("tf"), F.first("dl").alias("dl"))
    return KeywordIndex(postings.select("term", "id", "tf", "dl"), sized.select("id", "dl"), stemming)
