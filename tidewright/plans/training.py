"""Models on Spark ML: pair weights, boosted trees on a temporal split, causes of adjournments by character n-grams."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.functions import documents
from tidewright.sources.scratch import checkpointed


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)


def logistic_weights(pairs: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, weight) of a logistic regression in which both classes weigh the same; `bias` is the intercept."""
    n, positive = pairs.agg(F.count(F.lit(1)), F.sum(label)).first()
    if not positive or positive == n:
        raise ValueError("both classes are needed")
    weighed = _assembled(pairs, features).withColumn("w", F.when(F.col(label) == 1, n / (2 * positive)).otherwise(n / (2 * (n - positive))))
    m = LogisticRegression(labelCol=label, weightCol="w", regParam=1e-4).fit(weighed)
    return pairs.sparkSession.createDataFrame([("bias", float(m.intercept)), *((f, float(w)) for f, w in zip(features, m.coefficients, strict=True))], "feature string, weight double")


def holdout_scores(rows: DataFrame, features: list[str], label: str, early: Column, id_col: str, trees: int = 10, depth: int = 3) -> DataFrame:
    """(id, p, y): boosted trees learn from the early rows and score the later ones."""
    data = _assembled(rows, features)
    model = GBTClassifier(labelCol=label, maxIter=trees, maxDepth=depth, seed=7).fit(data.where(early))
    scored = model.transform(data.where(~early))
    return scored.select(id_col, F.get(vector_to_array("probability"), F.lit(1)).alias("p"), F.col(label).alias("y"))


# Lengths of n-grams, inverse of the regularisation, the least probability that names a cause, and the most
# confidence that a learned one gets.
SHORTEST, LONGEST, INVERSE, CERTAIN, MOST_SURE = 2, 4, 5.0, 0.7, 0.85


#: Distinct texts up to which their causes are broadcast.
MOST_BROADCAST = 100_000


def edge_ngrams(text: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """Array of the character n-grams of each word with a blank on either side, lower-cased; a word shorter than an
    n-gram gives itself once, blanks included. Null text has none."""
    words = F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(w: Column) -> Column:
        size = F.length(w)
        of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))
        # once an n-gram is as long as the word, longer ones add nothing
        return F.concat(*[F.when((n == shortest) | (size > n - 1), of(n)).otherwise(F.array().cast("array<string>")) for n in range(shortest, longest + 1)])

    return F.flatten(F.transform(words, grams))


def _term_weights(texts: DataFrame, idf: DataFrame) -> DataFrame:
    """(text, gram, x): weights (1 + ln tf) * idf of each distinct text's known n-grams, of length 1 together."""
    tf = texts.select("text", F.explode(edge_ngrams(F.col("text"))).alias("gram")).groupBy("text", "gram").agg(F.count(F.lit(1)).alias("tf"))
    raw = tf.join(idf, "gram").withColumn("x", (1 + F.log("tf")) * F.col("idf"))
    length = raw.groupBy("text").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("l"))
    return raw.join(length, "text").select("text", "gram", F.col("at") if "at" in idf.columns else F.lit(0).alias("at"), (F.col("x") / F.col("l")).alias("x"))


@F.udf(VectorUDT())
def _sparse(pairs, size):
    return SparseVector(size, sorted((p["at"], p["x"]) for p in pairs))


class CauseModel:
    """Weights of every n-gram for each class (gram, idf, w: array), intercepts and class names, in order."""

    def __init__(self, weights: DataFrame, intercepts: list[float], labels: list[str]):
        self.weights, self.intercepts, self.labels = weights, intercepts, labels


def learn_causes(labelled: DataFrame, text_col: str = "text", label_col: str = "label") -> CauseModel:
    """Multinomial regression on TF-IDF of character n-grams (sublinear tf, smoothed idf, unit length).

    Rows without text or label teach nothing. What is collected are the classes and, for the coefficients, one row of
    numbers a class; the n-grams stay a table. At least two classes are needed.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).alias("label")).where("trim(text) <> '' and label is not null")
    rows = checkpointed(rows.groupBy("text", "label").agg(F.count(F.lit(1)).alias("times")))  # equal rows are one, weighed
    labels = sorted(r["label"] for r in rows.select("label").distinct().collect())
    if len(labels) < 2:
        raise ValueError("at least two classes are needed")
    n = rows.agg(F.sum("times")).first()[0]
    df = rows.select("times", F.explode(F.array_distinct(edge_ngrams(F.col("text")))).alias("gram")).groupBy("gram").agg(F.sum("times").alias("df"))
    known = df.withColumn("idf", F.log((n + 1) / (F.col("df") + 1)) + 1).select("gram", "idf")
    known = checkpointed(known.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(1024)).cast("int")))
    # places in the vector without a window over all n-grams: counts of buckets, summed up on the driver (1,024 numbers)
    sizes = {r["bucket"]: r["count"] for r in known.groupBy("bucket").count().collect()}
    offset, starts = 0, {}
    for b in range(1024):
        starts[b], offset = offset, offset + sizes.get(b, 0)
    begin = F.get(F.array(*[F.lit(starts[b]) for b in range(1024)]), F.col("bucket"))
    known = checkpointed(known.withColumn("at", (begin + F.row_number().over(Window.partitionBy("bucket").orderBy("gram")) - 1).cast("int")).select("gram", "idf", "at"))
    vectors = _term_weights(rows.select("text").distinct(), known).groupBy("text").agg(_sparse(F.collect_list(F.struct("at", "x")), F.lit(offset)).alias("features"))
    place = F.array_position(F.array(*map(F.lit, labels)), F.col("label")) - 1
    data = rows.join(vectors, "text").select("features", place.cast("double").alias("y"), F.col("times").cast("double").alias("times"))
    m = LogisticRegression(labelCol="y", weightCol="times", family="multinomial", regParam=1 / (INVERSE * n), maxIter=200, standardization=False).fit(data)
    own = rows.sparkSession.createDataFrame([(k, c) for k, c in enumerate(zip(*m.coefficientMatrix.toArray().tolist(), strict=True))], "at int, w array<double>")
    return CauseModel(checkpointed(known.join(own, "at").select("gram", "idf", "w")), [float(x) for x in m.interceptVector], labels)


def attribute_causes(reasons: DataFrame, text_col: str, model: CauseModel) -> DataFrame:
    """`reasons` with struct `cause` (label, confidence, method): rules first; where none fits, the learned class if its
    probability is at least 0.7 (confidence at most 0.85), else unknown with the probability of the best guess.

    Each distinct text that no rule knows is scored once, by a join of its n-grams with their weights and a sum.
    """
    said = F.coalesce(F.col(text_col), F.lit(""))  # a missing reason counts as empty, which a rule knows
    known = checkpointed(reasons.select(said.alias("text")).distinct().select("text", F.explode(F.array(documents.delay_cause(F.col("text")))).alias("_rule")))
    texts = known.where("_rule is null").select("text")
    x = _term_weights(texts, model.weights.select("gram", "idf")).join(model.weights.select("gram", "w"), "gram")
    sums = x.groupBy("text").agg(*[F.sum(F.col("x") * F.get("w", F.lit(k))).alias(f"z{k}") for k in range(len(model.labels))])
    # a text without a known n-gram is scored by the intercepts alone
    sums = texts.join(sums, "text", "left").select("text", *[(F.coalesce(f"z{k}", F.lit(0.0)) + b).alias(f"z{k}") for k, b in enumerate(model.intercepts)])
    total = sum((F.exp(F.col(f"z{k}") - F.greatest(*[F.col(f"z{j}") for j in range(len(model.labels))])) for k in range(len(model.labels))), F.lit(0.0))
    top = F.greatest(*[F.struct(F.col(f"z{k}").alias("z"), F.lit(-k).alias("k")) for k in range(len(model.labels))])
    best = sums.select("text", F.get(F.array(*map(F.lit, model.labels)), -top["k"]).alias("guess"), (1 / total).alias("p"))
    sure = F.col("p") >= CERTAIN
    learned = F.struct(
        F.when(sure, F.col("guess")).otherwise("unknown").alias("label"), F.round(F.when(sure, F.least("p", F.lit(MOST_SURE))).otherwise(F.col("p")), 3).alias("confidence"), F.when(sure, "classifier").otherwise("classifier_low_confidence").alias("method"),
    )
    rule = F.struct(F.col("_rule.label").alias("label"), F.col("_rule.confidence").cast("double").alias("confidence"), F.lit("rules").alias("method"))
    causes = checkpointed(known.join(best, "text", "left").select(F.col("text").alias("_said"), F.when(F.col("_rule").isNotNull(), rule).otherwise(learned).alias("cause")))
    causes = F.broadcast(causes) if causes.count() <= MOST_BROADCAST else causes
    return reasons.withColumn("_said", said).join(causes, "_said").select(*reasons.columns, "cause")
