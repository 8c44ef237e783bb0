"""Text features as hashed tokens, and linear models over them, on Spark's own expressions and MLlib."""
import uuid

from pyspark.ml.classification import LinearSVC, LinearSVCModel, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..session import checkpoint_dir

FEATURES = 1 << 16


def letter_words(text):
    """Distinct words of letters in lower case."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def ends(words, n=3):
    """Distinct first and last ``n`` letters of the words, marked as such."""
    first = F.transform(words, lambda w: F.concat(F.lit("^"), F.substring(w, 1, n)))
    last = F.transform(words, lambda w: F.concat(F.right(w, F.lit(n)), F.lit("$")))
    return F.array_distinct(F.concat(first, last))


def with_features(docs, tokens, size=FEATURES):
    """Adds ``_x``: the set of tokens hashed to ``size`` places, as a vector of length one."""
    hashed = HashingTF(inputCol="_tokens", outputCol="_raw", numFeatures=size, binary=True).transform(docs.withColumn("_tokens", tokens))
    return Normalizer(inputCol="_raw", outputCol="_x").transform(hashed).drop("_tokens", "_raw")


def stored(model, kind, spark):
    """The model written to the shared folder and read back, without the record of its training."""
    path = f"{checkpoint_dir(spark)}/models/{uuid.uuid4().hex}"
    model.write().save(path)
    return kind.load(path)


def fit_classes(train, label, iterations=30, reg=1e-5):
    """Logistic regression of the class numbers in ``label``; adds the array ``out`` of class probabilities."""
    model = LogisticRegression(featuresCol="_x", labelCol=label, maxIter=iterations, regParam=reg, standardization=False,
                               rawPredictionCol="_r", probabilityCol="_p", predictionCol="_c").fit(train)
    model = stored(model, LogisticRegressionModel, train.sparkSession)
    return lambda docs, out: model.transform(docs).withColumn(out, vector_to_array("_p")).drop("_r", "_p", "_c")


def fit_margin(train, label, iterations=30, reg=1e-5):
    """Linear support vector machine of the 0/1 values in ``label``; adds the signed margin ``out``."""
    model = LinearSVC(featuresCol="_x", labelCol=label, maxIter=iterations, regParam=reg, standardization=False,
                      rawPredictionCol="_r", predictionCol="_c").fit(train)
    model = stored(model, LinearSVCModel, train.sparkSession)
    return lambda docs, out: model.transform(docs).withColumn(out, vector_to_array("_r")[1]).drop("_r", "_c")


def hash_share(*columns):
    """Uniform value in [0, 1) of the columns, for a sample that is the same on every run."""
    return F.pmod(F.xxhash64(F.lit(3), *columns), F.lit(1 << 40)) / F.lit(float(1 << 40))
