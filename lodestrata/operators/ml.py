"""Models: splits without leakage, prepared features, the library's estimators, search, clusters, recommendation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import evaluation as E
from pyspark.ml import feature as X
from pyspark.ml import regression as R
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import Rejected

CLASSIFIERS = {
    "logistic": lambda **k: C.LogisticRegression(**k), "forest": lambda **k: C.RandomForestClassifier(seed=7, **k), "tree": lambda **k: C.DecisionTreeClassifier(seed=7, **k),
    "boosting": lambda **k: C.GBTClassifier(seed=7, **k), "svm": lambda **k: C.LinearSVC(**k), "naive_bayes": lambda **k: C.NaiveBayes(modelType="gaussian", **k), "mlp": lambda **k: C.MultilayerPerceptronClassifier(seed=7, **k),
}
REGRESSORS = {
    "linear": lambda **k: R.LinearRegression(**k), "ridge": lambda **k: R.LinearRegression(**({"regParam": 0.1, "elasticNetParam": 0.0} | k)), "lasso": lambda **k: R.LinearRegression(**({"regParam": 0.1, "elasticNetParam": 1.0} | k)),
    "elasticnet": lambda **k: R.LinearRegression(**({"regParam": 0.1, "elasticNetParam": 0.5} | k)), "glm": lambda **k: R.GeneralizedLinearRegression(**k), "forest": lambda **k: R.RandomForestRegressor(seed=7, **k),
    "tree": lambda **k: R.DecisionTreeRegressor(seed=7, **k), "boosting": lambda **k: R.GBTRegressor(seed=7, **k), "aft": lambda **k: R.AFTSurvivalRegression(**k), "isotonic": lambda **k: R.IsotonicRegression(**k),
}


def _unit(seed: str, *columns: str):
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in columns])), 1, 12), 16, 10).cast("double") / float(1 << 48)


def split(df: DataFrame, key: str, test: float = 0.2, seed: str = "split", kind: str = "random", by: str | None = None) -> DataFrame:
    """Adds ``part`` (train or test).

    ``random`` and ``group`` (all rows of a group in one part) go by a seeded hash, so a
    row's part doesn't depend on others; ``stratified`` takes the share within each
    class; ``time`` tests on the latest.
    """
    if kind in ("random", "group"):
        return df.withColumn("part", F.when(_unit(seed, by if kind == "group" else key) < test, "test").otherwise("train"))
    if kind == "stratified":
        w = Window.partitionBy(by)
        rank = F.percent_rank().over(w.orderBy(_unit(seed, key), key))
        return df.withColumn("part", F.when(rank < test, "test").otherwise("train"))
    if kind == "time":
        cut = df.agg(F.percentile(F.col(by).cast("timestamp").cast("double"), F.lit(1 - test))).first()[0]
        return df.withColumn("part", F.when(F.col(by).cast("timestamp").cast("double") > F.lit(cut), "test").otherwise("train"))
    raise Rejected(kind)


def folds(df: DataFrame, key: str, n: int, seed: str = "folds") -> DataFrame:
    return df.withColumn("fold", F.floor(_unit(seed, key) * n).cast("int"))


def pipeline(numeric: Sequence[str], categorical: Sequence[str] = (), model: object = None, scale: bool = True) -> Pipeline:
    """Fills (median), codes, joins and scales features; all of it is learnt from the training part alone."""
    stages: list = [X.Imputer(strategy="median", inputCols=list(numeric), outputCols=[f"__i_{c}" for c in numeric])] if numeric else []
    for c in categorical:
        stages += [X.StringIndexer(inputCol=c, outputCol=f"__x_{c}", handleInvalid="keep"), X.OneHotEncoder(inputCol=f"__x_{c}", outputCol=f"__o_{c}")]
    inputs = [f"__i_{c}" for c in numeric] + [f"__o_{c}" for c in categorical]
    stages.append(X.VectorAssembler(inputCols=inputs, outputCol="__raw" if scale else "features", handleInvalid="keep"))
    if scale:
        stages.append(X.StandardScaler(inputCol="__raw", outputCol="features", withMean=False))
    return Pipeline(stages=[*stages, *([model] if model is not None else [])])


def fit(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str] = (), family: str = "logistic", task: str = "classification", **options) -> PipelineModel:
    table = CLASSIFIERS if task == "classification" else REGRESSORS
    if family not in table:
        raise Rejected(family)
    return pipeline(numeric, categorical, table[family](featuresCol="features", labelCol=target, **options)).fit(df)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    if "probability" in out.columns:
        out = out.withColumn("probability", vector_to_array("probability"))
    return out.select(*df.columns, *[c for c in ("prediction", "probability") if c in out.columns])


def regression_metrics(df: DataFrame, truth: str, predicted: str = "prediction") -> DataFrame:
    e = F.col(truth) - F.col(predicted)
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / (F.var_pop(truth) * F.count(e))).alias("r2"))


def class_metrics(df: DataFrame, truth: str, predicted: str = "prediction") -> DataFrame:
    """``class, support, precision, recall, f1``: from the confusion counts alone."""
    cells = df.groupBy(F.col(truth).cast("double").alias("y"), F.col(predicted).cast("double").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    both = cells.select(F.explode(F.array(F.struct(F.col("y").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("g")), F.struct(F.col("p").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("g")))).alias("x"), "n", "y", "p")
    k = both.groupBy(F.col("x.c").alias("class")).agg(F.sum(F.col("x.t") * F.col("n")).alias("support"), F.sum(F.col("x.g") * F.col("n")).alias("given"), F.sum(F.when((F.col("y") == F.col("p")) & (F.col("x.t") == 1), F.col("n")).otherwise(0)).alias("hit"))
    return k.select("class", "support", F.try_divide("hit", "given").alias("precision"), F.try_divide("hit", "support").alias("recall"), F.try_divide(2 * F.col("hit"), F.col("support") + F.col("given")).alias("f1"))


def search(df: DataFrame, target: str, numeric: Sequence[str], estimator: object, grid: dict, task: str = "classification", n: int = 3) -> PipelineModel:
    """The best of a grid by cross-validation; preparation is learnt anew in each fold."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), values)
    evaluator = E.MulticlassClassificationEvaluator(labelCol=target, metricName="f1") if task == "classification" else E.RegressionEvaluator(labelCol=target, metricName="rmse")
    return CrossValidator(estimator=pipeline(numeric, (), estimator), estimatorParamMaps=builder.build(), evaluator=evaluator, numFolds=n, seed=7, parallelism=2).fit(df).bestModel


def cluster(df: DataFrame, columns: Sequence[str], kind: str = "kmeans", k: int = 5) -> DataFrame:
    """Adds ``cluster``."""
    make = {"kmeans": K.KMeans, "bisecting": K.BisectingKMeans, "gmm": K.GaussianMixture}[kind]
    model = pipeline(columns, (), make(featuresCol="features", predictionCol="cluster", k=k, seed=7)).fit(df)
    return model.transform(df).select(*df.columns, "cluster")


def silhouette(df: DataFrame, columns: Sequence[str], label: str = "cluster") -> float:
    prepared = pipeline(columns).fit(df).transform(df)
    return E.ClusteringEvaluator(featuresCol="features", predictionCol=label).evaluate(prepared)


def dbscan(df: DataFrame, key: str, x: str, y: str, radius: float, least: int) -> DataFrame:
    """``key, cluster`` (null: noise) in the plane: points meet in the cells of a grid as wide as the radius."""
    from .graph import components

    p = df.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    cell = lambda c: F.floor(F.col(c) / radius)
    home = p.select("*", cell("x").alias("cx"), cell("y").alias("cy"))
    around = p.select(F.col("k").alias("k2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.explode(F.array(*[F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("c"))
    near = home.join(around.select("k2", "x2", "y2", "c.cx", "c.cy"), ["cx", "cy"]).filter((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2 <= radius**2).select("k", "k2")
    core = near.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("k")
    links = near.join(core, "k").join(core.select(F.col("k").alias("k2")), "k2").select(F.col("k").alias("src"), F.col("k2").alias("dst"))
    comps = components(links)
    border = near.join(comps, F.col("k2") == F.col("node")).groupBy("k").agg(F.min("component").alias("c"))
    own = p.select("k").join(comps, F.col("k") == F.col("node"), "left").join(border, "k", "left")
    return own.select(F.col("k").alias(key), F.coalesce("component", "c").alias("cluster"))


def pca(df: DataFrame, columns: Sequence[str], k: int) -> tuple[DataFrame, list[float]]:
    """(rows with ``pc`` arrays, shares of variance)."""
    model = Pipeline(stages=[*pipeline(columns).getStages(), X.PCA(k=k, inputCol="features", outputCol="__pc")]).fit(df)
    out = model.transform(df).withColumn("pc", vector_to_array("__pc")).select(*df.columns, "pc")
    return out, [float(v) for v in model.stages[-1].explainedVariance]


def select_by_variance(df: DataFrame, columns: Sequence[str], threshold: float = 0.0) -> list[str]:
    got = df.agg(*[F.var_samp(c).alias(c) for c in columns]).first()
    return [c for c in columns if got[c] is not None and got[c] > threshold]


def recommend(df: DataFrame, user: str, item: str, rating: str, k: int, implicit: bool = False) -> DataFrame:
    """``user, item, rank, score`` by alternating least squares."""
    model = ALS(userCol=user, itemCol=item, ratingCol=rating, implicitPrefs=implicit, coldStartStrategy="drop", seed=7).fit(df)
    rec = model.recommendForAllUsers(k).select(user, F.posexplode("recommendations").alias("rank", "r"))
    return rec.select(user, F.col(f"r.{item}").alias(item), (F.col("rank") + 1).alias("rank"), F.col("r.rating").cast("double").alias("score"))


def popularity(df: DataFrame, item: str, k: int) -> DataFrame:
    return df.groupBy(item).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), item).limit(k)


def topics(df: DataFrame, key: str, text: str, k: int, terms: int = 1000) -> DataFrame:
    """``key, topic, share`` by latent Dirichlet allocation."""
    from .text import tokens

    prepared = df.select(key, tokens(F.col(text)).alias("w"))
    model = Pipeline(stages=[X.CountVectorizer(inputCol="w", outputCol="features", vocabSize=terms), K.LDA(k=k, seed=7, maxIter=10)]).fit(prepared)
    return model.transform(prepared).select(key, F.posexplode(vector_to_array("topicDistribution")).alias("topic", "share"))


def permutation_importance(model: PipelineModel, df: DataFrame, target: str, columns: Sequence[str], key: str) -> DataFrame:
    """Loss of accuracy when one column's values are dealt anew among rows, by ranks of two seeded hashes."""
    base = predict(model, df).agg(F.avg((F.col(target) == F.col("prediction")).cast("double"))).first()[0]
    rows = []
    for c in columns:
        a = df.withColumn("__r", F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64(key), F.lit(64))).orderBy(_unit("a", key))))
        a = a.withColumn("__p", F.pmod(F.xxhash64(key), F.lit(64)))
        b = df.select(F.col(c).alias("__c"), F.pmod(F.xxhash64(key), F.lit(64)).alias("__p"), F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64(key), F.lit(64))).orderBy(_unit("b", key))).alias("__r"))
        dealt = a.drop(c).join(b, ["__p", "__r"]).withColumnRenamed("__c", c).select(*df.columns)
        rows.append((c, float(base - predict(model, dealt).agg(F.avg((F.col(target) == F.col("prediction")).cast("double"))).first()[0])))
    return df.sparkSession.createDataFrame(rows, "column string, importance double")


def partial_dependence(model: PipelineModel, df: DataFrame, column: str, values: Sequence[float]) -> DataFrame:
    """``value, mean_prediction``: each value in every row, one pass over the exploded grid."""
    grid = df.drop(column).withColumn(column, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return predict(model, grid).groupBy(F.col(column).alias("value")).agg(F.avg("prediction").alias("mean_prediction"))
