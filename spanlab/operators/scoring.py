"""Token scorers and candidate scores.

A scorer maps tokens (doc_id, pos, token, ...) to the same rows plus p_o, p_b,
p_i.  RuleScorer needs no training; MLScorer is a Spark ML pipeline over the
shapes around a token; BatchScorer runs any other model over token ids.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions.chars import let
from ..functions.hashrand import unit
from ..functions.shapes import encode


class RuleScorer:
    """Deterministic: B at the first token, I after it if the window holds a year, initials or a link; low otherwise."""

    SIGNS = ("APA_YEAR_PAREN", "APA_INITIALS", "APA_DOI", "APA_URL", "APA_PAGE_RANGE", "APA_VOL_ISSUE", "APA_ETAL")

    def transform(self, tokens: DataFrame) -> DataFrame:
        sign = F.max(F.col("token").isin(*self.SIGNS).cast("int")).over(W.partitionBy("doc_id")) == 1
        b = F.when(sign & (F.col("pos") == 0), 0.9).otherwise(0.02)
        i = F.when(sign & (F.col("pos") > 0), 0.9).otherwise(0.03)
        return tokens.withColumns({"p_b": b, "p_i": i}).withColumn("p_o", 1 - F.col("p_b") - F.col("p_i"))

    def arrays(self, tokens: Column) -> Column:
        """transform() of a text's token names: array<struct<p_o,p_b,p_i>>."""
        def one(sign: Column, i: Column) -> Column:
            b, c = F.when(sign & (i == 0), 0.9).otherwise(0.02), F.when(sign & (i > 0), 0.9).otherwise(0.03)
            return F.struct((1 - b - c).alias("p_o"), b.alias("p_b"), c.alias("p_i"))

        return let(tokens, lambda t: let(F.exists(t, lambda x: x.isin(*self.SIGNS)), lambda sign: F.transform(t, lambda _, i: one(sign, i))))


class HashScorer:
    """Pseudo-probabilities from a hash: for tests of everything that follows a scorer."""

    def __init__(self, seed: int = 1):
        self.seed = seed

    def transform(self, tokens: DataFrame) -> DataFrame:
        u = lambda s: unit(self.seed, F.concat_ws("/", F.col("doc_id").cast("string"), F.col("pos").cast("string")), s)
        return tokens.withColumns({"p_b": u("b") / 2, "p_i": u("i") / 2}).withColumn("p_o", 1 - F.col("p_b") - F.col("p_i"))


class MLScorer:
    """Multinomial logistic regression over one-hot shapes at offsets -reach..reach; names: a column for each label."""

    def __init__(self, reach: int = 3, model=None, names: tuple[str, ...] = ("p_o", "p_b", "p_i")):
        self.reach, self.model, self.names = reach, model, names

    def _features(self, tokens: DataFrame) -> DataFrame:
        order = W.partitionBy("doc_id").orderBy("pos")
        at = range(-self.reach, self.reach + 1)
        return tokens.withColumns({f"t{k + self.reach}": F.coalesce(F.lag("token", -k).over(order), F.lit("[PAD]")) for k in at})

    def fit(self, labelled: DataFrame, rounds: int = 20) -> MLScorer:
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

        n = 2 * self.reach + 1
        steps = [StringIndexer(inputCols=[f"t{k}" for k in range(n)], outputCols=[f"i{k}" for k in range(n)], handleInvalid="keep"),
                 OneHotEncoder(inputCols=[f"i{k}" for k in range(n)], outputCols=[f"h{k}" for k in range(n)], handleInvalid="keep"),
                 VectorAssembler(inputCols=[f"h{k}" for k in range(n)], outputCol="features"),
                 LogisticRegression(featuresCol="features", labelCol="label", family="multinomial", maxIter=rounds, regParam=1e-4)]
        self.model = Pipeline(stages=steps).fit(self._features(labelled).withColumn("label", F.col("label").cast("double")))
        return self

    def transform(self, tokens: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        out = self.model.transform(self._features(tokens)).withColumn("_p", vector_to_array("probability"))
        # a label that no training row has gets 0
        return out.select(*tokens.columns, *[F.coalesce(F.get("_p", F.lit(k)), F.lit(0.0)).alias(n) for k, n in enumerate(self.names)])

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str, reach: int = 3, names: tuple[str, ...] = ("p_o", "p_b", "p_i")) -> MLScorer:
        from pyspark.ml import PipelineModel

        return cls(reach, PipelineModel.load(path), names)


class BatchScorer:
    """Any model of a document's token ids, through predict_batch_udf.

    make_predict: called once in each worker; returns a function from an int array (documents, limit) of ids,
    padded with 0, to a float array (documents, limit * 3) of P(O), P(B), P(I) by token.  Tokens from ``limit``
    on are not scored: P(O) = 1.
    """

    def __init__(self, make_predict, limit: int = 512, batch_size: int = 64):
        self.make_predict, self.limit, self.batch_size = make_predict, limit, batch_size

    def transform(self, tokens: DataFrame) -> DataFrame:
        from pyspark.ml.functions import predict_batch_udf

        run = predict_batch_udf(self.make_predict, return_type=ArrayType(FloatType()), batch_size=self.batch_size, input_tensor_shapes=[[self.limit]])
        per = tokens.where(F.col("pos") < self.limit).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("t"))
        ids = encode(F.col("t"), self.limit)
        padded = per.select("doc_id", F.concat(ids, F.array_repeat(F.lit(0), F.lit(self.limit) - F.size(ids))).alias("ids"))
        scored = padded.select("doc_id", run("ids").alias("_p"))
        found = tokens.join(scored, "doc_id", "left")
        at = lambda k: F.when(F.col("pos") < self.limit, F.get("_p", F.col("pos") * 3 + k)).cast("double")
        return found.select(*tokens.columns, F.coalesce(at(0), F.lit(1.0)).alias("p_o"), *[F.coalesce(at(k), F.lit(0.0)).alias(n) for k, n in ((1, "p_b"), (2, "p_i"))])


def evaluate(scorer: MLScorer, labelled: DataFrame) -> dict[str, float]:
    """Accuracy and mean negative log likelihood of the gold labels; both nan without rows."""
    p = F.array(*[F.col(n) for n in scorer.names])
    best = F.array_position(p, F.array_max(p)) - 1
    own = F.get(p, F.col("label"))
    got = scorer.transform(labelled).agg(F.avg((best == F.col("label")).cast("double")), F.avg(-F.log(F.greatest(own, F.lit(1e-12))))).first()
    return {"accuracy": math.nan if got[0] is None else got[0], "loss": math.nan if got[1] is None else got[1]}


def best_label(p_o: Column, p_b: Column, p_i: Column) -> Column:
    """Most likely label; ties go to the lower id."""
    return F.when((p_o >= p_b) & (p_o >= p_i), 0).when(p_b >= p_i, 1).otherwise(2)


def candidate_scores(scored: DataFrame, limit: int = 512) -> DataFrame:
    """doc_id and max, mean, mean of the top 5, share over 0.5 of P(B)+P(I), and the token count, over the first ``limit`` tokens."""
    p = scored.where(F.col("pos") < limit).select("doc_id", (F.col("p_b") + F.col("p_i")).alias("p"))
    got = p.groupBy("doc_id").agg(F.max("p").alias("max_pos_prob"), F.avg("p").alias("mean_pos_prob"), F.collect_list("p").alias("all"),
                                  F.avg((F.col("p") > 0.5).cast("double")).alias("positive_fraction"), F.count("*").cast("int").alias("token_count"))
    top = F.slice(F.sort_array("all", False), 1, 5)
    mean = F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)
    return got.select("doc_id", "max_pos_prob", "mean_pos_prob", mean.alias("mean_topk_pos_prob"), "positive_fraction", "token_count")
