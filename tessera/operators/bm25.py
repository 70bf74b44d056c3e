"""Sparse retrieval with BM25.

Weights are kept as rows (doc, token, weight), so that a query costs a join of its tokens with the postings. Tokens that
are in most documents have long postings; the join is on the token, and AQE splits its large partitions.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.cluster import release, send_package

K1, B, BROADCAST_TOKENS = 1.5, 0.75, 200_000
WORD = r"[\p{L}\p{N}_]{2,}"
# English stop words of the public tokenizer defaults.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these",
    "they", "this", "to", "was", "will", "with",
)


def tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """B1: lower-cased words of two characters or more, without stop words; repeated ones stay."""
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    words = STOP_WORDS if stop_words is None else stop_words
    return F.filter(found, lambda x: ~x.isin(*words)) if words else found


def counted(corpus: DataFrame, key: str, text: str, stop_words: list[str] | None = None) -> DataFrame:
    """doc, dl, own (token, tf): the different tokens of each text, counted in its row: words are sorted, and a run of equal ones ends where the next begins.
    Each step's column is used twice in the next one, so that Spark doesn't make it anew for every element."""
    words = corpus.select(F.col(key).alias("doc"), tokens(F.col(text), stop_words).alias("words"))
    rows = words.select("doc", F.size("words").alias("dl"), F.sort_array(F.coalesce("words", F.array().cast("array<string>"))).alias("words"))
    begins = F.transform("words", lambda w, i: F.when(~w.eqNullSafe(F.get("words", i - 1)), i))
    rows = rows.withColumn("begins", F.filter(begins, lambda i: i.isNotNull()))
    tf = lambda b, i: F.coalesce(F.get("begins", i + 1), F.size("words")) - b
    return rows.select("doc", "dl", F.transform("begins", lambda b, i: F.struct(F.get("words", b).alias("token"), tf(b, i).alias("tf"))).alias("own"))


def merged(rows: DataFrame) -> DataFrame:
    """doc, own (token, tf, dl): one row for each doc; of texts of one doc and length, counts are added up. Only docs with several rows are shuffled with their tokens."""
    alone = rows.select("doc", F.transform("own", lambda x: F.struct(x["token"].alias("token"), x["tf"].alias("tf"), F.col("dl").alias("dl"))).alias("own"))
    several = rows.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc").alias("__doc"))
    if several.isEmpty():
        return alone
    same = F.col("doc").eqNullSafe(F.col("__doc"))
    each = rows.join(several, same, "left_semi").select("doc", "dl", F.inline_outer("own")).groupBy("doc", "dl", "token").agg(F.sum("tf").cast("int").alias("tf"))
    together = each.filter("token is not null").groupBy("doc").agg(F.collect_list(F.struct("token", "tf", "dl")).alias("own"))
    return alone.join(several, same, "left_anti").unionByName(together)


def known(frequent: DataFrame) -> Callable[[Column], Column]:
    """Tokens of a row with their numbers of documents, null where they aren't frequent: at most ``BROADCAST_TOKENS`` are sent to the tasks."""
    spark = frequent.sparkSession
    send_package(spark)
    own = frequent.select("token", "df").toPandas()
    told = spark.sparkContext.broadcast((pa.array(own["token"], pa.string()), pa.array(own["df"], pa.int64())))

    @F.arrow_udf("array<bigint>")
    def run(found: pa.Array) -> pa.Array:
        names, df = told.value
        places = pc.index_in(found.flatten(), value_set=names)
        return pa.ListArray.from_arrays(pc.subtract(found.offsets, found.offsets[0]), df.take(places))

    return run


class Model:
    """Term weights of a corpus."""

    def __init__(self, k1: float = K1, b: float = B, stop_words: list[str] | None = None):
        self.k1, self.b, self.stop_words, self._postings, self._vocabulary, self._source = k1, b, stop_words, None, None, None

    @property
    def is_fitted(self) -> bool:
        return self._postings is not None

    def _need(self) -> None:
        if not self.is_fitted:
            raise RuntimeError("the model is not fitted")

    def fit(self, corpus: DataFrame, key: str, text: str, keep: Callable[[DataFrame], DataFrame] | None = None) -> Model:
        """tf, df, N and the mean length; one shuffle by (doc, token), one by token. ``keep`` makes a table of the counts, so that texts are split once.
        Texts without words go after they are exploded: Spark's own filter on the words would split every text a second time."""
        words = corpus.select(F.col(key).alias("doc"), tokens(F.col(text), self.stop_words).alias("words"))
        size = words.select("doc", F.size("words").alias("dl"))
        totals = size.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        tf = self._counts(words.select("doc", F.size("words").alias("dl"), F.explode_outer("words").alias("token")).filter("token is not null"))
        if keep is not None:
            tf = keep(tf)
            release(corpus.sparkSession)
        self._vocabulary = tf.groupBy("token").agg(F.count("*").alias("df"))
        self._postings, self._source = self._weighed(tf, self._vocabulary, totals), (words, totals)
        return self

    @staticmethod
    def _counts(rows: DataFrame) -> DataFrame:
        return rows.groupBy("doc", "dl", "token").agg(F.count("*").alias("tf"))

    def _weight(self, tf: Column, dl: Column, df: Column, n: Column, avgdl: Column) -> Column:
        return F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + self.k1 * (1 - self.b + self.b * dl / avgdl))

    def documents(self, corpus: DataFrame, key: str, text: str, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, Column]:
        """doc, tokens, tf, dl, df, most, a row for each document with words, and the column (token, weight) of its postings; most is the greatest weight. Tokens are
        counted and weighed in their document's row: numbers of documents with a token are sent to the tasks for the most frequent tokens, and only
        postings of the others are shuffled. Rows are shuffled as one string of tokens and arrays of whole numbers. ``keep`` makes tables."""
        rows = keep(counted(corpus, key, text, self.stop_words))
        totals = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
        rows = merged(rows).filter(F.size("own") > 0)
        vocabulary = keep(rows.select(F.explode("own.token").alias("token")).groupBy("token").agg(F.count("*").alias("df")))
        power = F.floor(F.log2("df")).cast("int")
        least, left = 0, BROADCAST_TOKENS
        for r in vocabulary.groupBy(power.alias("power")).count().orderBy(F.desc("power")).collect():  # 63 rows at most
            left -= r["count"]
            if left < 0:
                least = r["power"] + 1
                break
        frequent = known(vocabulary.filter(power >= least))
        plain = rows.select("doc", F.concat_ws(" ", "own.token").alias("tokens"), F.col("own.tf").alias("tf"), F.col("own.dl").alias("dl"))
        rows = plain.withColumn("df", frequent(F.split("tokens", " ")))
        # Zipped and not looked up by place: Spark would make an array of a struct's field anew for every place.
        each = F.arrays_zip(F.split("tokens", " "), "tf", "dl", "df").cast("array<struct<token:string,tf:int,dl:int,df:bigint>>")
        if least:
            lone = rows.select("doc", F.inline(F.filter(each, lambda x: x["df"].isNull()))).drop("df").join(vocabulary.filter(power < least).hint("merge"), "token")
            lone = lone.groupBy("doc").agg(F.collect_list(F.struct("token", "tf", "dl", "df")).alias("rare")).withColumnRenamed("doc", "__doc")
            rows = plain.join(lone, F.col("doc").eqNullSafe(F.col("__doc")), "left").withColumn("df", frequent(F.split("tokens", " ")))
            rows = rows.withColumn("own", F.concat(F.filter(each, lambda x: x["df"].isNotNull()), F.coalesce("rare", F.filter(each, lambda x: F.lit(False)))))
            rows = rows.select("doc", F.concat_ws(" ", "own.token").alias("tokens"), *[F.col(f"own.{c}").alias(c) for c in ("tf", "dl", "df")])
        weight = lambda x: self._weight(*[x[c] for c in ("tf", "dl", "df")], F.lit(totals["n"]), F.lit(totals["avgdl"]))
        rows = keep(rows.withColumn("most", F.array_max(F.transform(each, weight))))
        return rows, F.transform(each, lambda x: F.struct(x["token"], weight(x).alias("weight")))

    def _weighed(self, tf: DataFrame, vocabulary: DataFrame, totals: DataFrame) -> DataFrame:
        weight = self._weight(*map(F.col, ("tf", "dl", "df", "n", "avgdl")))
        joined = tf.join(vocabulary, "token").join(F.broadcast(totals.withColumn("one", F.lit(1))), F.lit(1) == F.col("one"))  # a single row
        return joined.select("doc", "token", weight.alias("weight"))

    def _postings_of(self, asked: DataFrame) -> DataFrame:
        """Postings of asked tokens. Where these are few, other tokens of the texts are left out before any shuffle."""
        wanted = asked.select("token").distinct()
        if self._source is None or wanted.limit(BROADCAST_TOKENS + 1).count() > BROADCAST_TOKENS:
            return self.postings
        words, totals = self._source
        rows = words.select("doc", F.size("words").alias("dl"), F.explode_outer("words").alias("token")).join(F.broadcast(wanted), "token", "left_semi")
        tf = self._counts(rows)
        return self._weighed(tf, tf.groupBy("token").agg(F.count("*").alias("df")), totals)

    @property
    def vocabulary(self) -> DataFrame:
        self._need()
        return self._vocabulary

    @property
    def postings(self) -> DataFrame:
        self._need()
        return self._postings

    def asked(self, queries: DataFrame, key: str, text: str) -> DataFrame:
        """query, token: the different tokens of each query."""
        return queries.select(F.col(key).alias("query"), F.explode(F.array_distinct(tokens(F.col(text), self.stop_words))).alias("token"))

    def query_vector(self, queries: DataFrame, key: str, text: str) -> DataFrame:
        """Distinct known tokens of each query, weight 1."""
        self._need()
        own = self.asked(queries, key, text)
        return own.join(self._vocabulary.select("token"), "token", "left_semi").select("query", "token", F.lit(1.0).alias("weight"))

    def scores(self, queries: DataFrame, key: str, text: str) -> DataFrame:
        """Dot products of query and document weights, rounded to six digits."""
        self._need()
        own = self.asked(queries, key, text)
        return self._postings_of(own).join(own, "token").groupBy("query", "doc").agg(F.round(F.sum("weight"), 6).alias("score"))

    def kept(self, spark, path: str) -> Model:
        """The same model read from its tables, so that the corpus is tokenised once, however often it is asked."""
        self.save(path)
        return Model.load(spark, path, k1=self.k1, b=self.b, stop_words=self.stop_words)

    def save(self, path: str) -> None:
        """K5: postings and vocabulary as tables."""
        self.postings.write.mode("overwrite").parquet(f"{path}/postings")
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")

    @classmethod
    def load(cls, spark, path: str, **options) -> Model:
        """K5: raises where the two tables don't tell the same tokens."""
        model = cls(**options)
        model._postings, model._vocabulary = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/vocabulary")
        there, known = model._postings.select("token").distinct(), model._vocabulary.select("token")
        if not there.join(known, "token", "left_anti").isEmpty() or not known.join(there, "token", "left_anti").isEmpty():
            raise ValueError("postings and vocabulary differ")
        return model


def top(scores: DataFrame, limit: int, by: tuple[str, ...] = ("query",), tie: str = "doc") -> DataFrame:
    """The best rows of each query with their rank from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), tie)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
