"""Features of units, data sets, splits, three fitted models with a vote, and rescoring of verdicts."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes
from pyspark.ml.feature import StringIndexer
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.storagelevel import StorageLevel

from lineament.functions.written import Written
from lineament.operators.attribution import with_primary
from lineament.operators.markov import voted
from lineament.plans.catalogue import FAMILIES, METRIC_RULES, SIGNALS

IDS = sorted([s.id for s in SIGNALS] + [r[0] for r in METRIC_RULES])
#: The mark of metrics in a schema; signals come before them.
METRIC = "metric:"


def extracted(signals: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """unit_id, language, lines_of_code, ``keep`` and ``features``: the weight of every fired signal, and every metric
    under its mark. A signal that did not fire is zero wherever it is looked up, so it is not kept.

    Input: unit_id, language, n, hits and, if there are any, metrics."""
    fired = "transform(hits, h -> struct(h.id AS key, h.tenths / 10D AS value))"
    own = f"transform(map_entries(metrics), m -> struct(concat('{METRIC}', m.key) AS key, m.value AS value))" if "metrics" in signals.columns else None
    every = f"concat({fired}, {own})" if own else fired
    return signals.select("unit_id", F.coalesce("language", F.lit("unknown")).alias("language"), F.col("n").alias("lines_of_code"), *keep, F.expr(f"map_from_entries({every})").alias("features"))


def schema_of(rows: DataFrame, ids: list[str] | None = None) -> list[str]:
    """Names in canonical order: all ids, then the metrics that occur, each sorted. Metrics are few by nature: one name a kind."""
    found = [r[0] for r in rows.select(F.explode(F.map_keys("features")).alias("k")).where(F.col("k").startswith(METRIC)).distinct().collect()]
    return [*(IDS if ids is None else sorted(ids)), *sorted(found)]


def flat(features: Column, schema: list[str]) -> Column:
    """Values in the order of a schema, zero where there is none."""
    names = F.lit(schema)
    return F.transform(names, lambda k: F.coalesce(F.element_at(features, k), F.lit(0.0)))


def dataset(rows: DataFrame, schema: list[str]) -> DataFrame:
    return rows.withColumn("x", flat(F.col("features"), schema))


@dataclass
class ModelMetadata:
    version: str
    trained_at: str
    algorithms: list[str]
    training_samples: int
    feature_dimensions: int
    coverage: dict[str, dict[str, int]] = field(default_factory=dict)
    accuracy: float | None = None

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> ModelMetadata:
        return ModelMetadata(**json.loads(text))


@dataclass
class Ensemble:
    """Logistic regression, naive Bayes and a decision tree over ``x``, each with one vote of its weight."""

    schema: list[str]
    labels: list[str]
    models: list
    weights: list[float]
    metadata: ModelMetadata

    def votes(self, rows: DataFrame, key: str = "unit_id") -> DataFrame:
        """unit_id, family, share: each model's class counts wholly."""
        out = vectors(rows.select(F.col(key).alias("unit_id"), "features"), self.schema)
        for k, model in enumerate(self.models):
            out = model.transform(out).withColumnRenamed("prediction", f"_p{k}").drop("rawPrediction", "probability")
        labels = F.lit(self.labels)
        each = [F.struct(F.element_at(labels, (F.col(f"_p{k}") + 1).cast("int")).alias("family"), F.lit(w).alias("weight")) for k, w in enumerate(self.weights)]
        return voted(out.select("unit_id", F.explode(F.array(*each)).alias("v")).select("unit_id", "v.*"))


def vectors(rows: DataFrame, schema: list[str]) -> DataFrame:
    """``rows`` without ``features``, with ``_x``, their values in the order of a schema, and ``_n``, the same moved up by
    the row's least value where that is negative: naive Bayes needs counts.

    Vectors hold what is not zero. They are written as what vectors consist of and read again as vectors, which
    takes no function outside Spark's own; only a row with a negative value is written in full."""
    places = F.create_map(*[F.lit(x) for k, name in enumerate(schema) for x in (name, k)])
    others = [c for c in rows.columns if c != "features"]
    at = F.transform(F.map_entries("features"), lambda e: F.struct(F.element_at(places, e["key"]).alias("k"), e["value"].alias("v")))
    found = rows.select(*others, "features", F.sort_array(F.filter(at, lambda e: e["k"].isNotNull() & (e["v"] != 0))).alias("_f"))
    sparse = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(len(schema)).alias("size"), F.col("_f.k").alias("indices"), F.col("_f.v").alias("values"))
    full = flat(F.col("features"), schema)
    moved = F.struct(F.lit(1).cast("byte").alias("type"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("array<int>").alias("indices"), F.transform(full, lambda v: v - F.array_min(full)).alias("values"))
    table = Written(found.select(*others, sparse.alias("_x"), F.when(F.array_min("_f.v") < 0, moved).otherwise(sparse).alias("_n")), "vectors")
    read = StructType([f for f in table.df.schema if f.name in others] + [StructField(c, VectorUDT()) for c in ("_x", "_n")])
    return rows.sparkSession.read.schema(read).parquet(table.path)


def fit(rows: DataFrame, label: str, trained_at: str = "", version: str = "1") -> Ensemble:
    """Fit on every labelled row with ``features``."""
    # Written once, since the rows are read for the schema and for the vectors; what all models read is written too.
    known = Written(rows.where(F.col(label).isNotNull()).select("unit_id", label, "language", "features"), "training-rows")
    schema = schema_of(known.df)
    train = vectors(known.df, schema)
    numbered = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(train)
    x = numbered.transform(train).select("_x", "_n", "_y").persist(StorageLevel.MEMORY_AND_DISK)
    kinds = (LogisticRegression(family="multinomial", maxIter=100, featuresCol="_x", labelCol="_y"), NaiveBayes(modelType="multinomial", featuresCol="_n", labelCol="_y"), DecisionTreeClassifier(maxDepth=10, featuresCol="_x", labelCol="_y"))
    models = [Pipeline(stages=[k]).fit(x) for k in kinds]
    x.unpersist()
    coverage: dict[str, dict[str, int]] = {}
    for r in train.groupBy("language", label).count().collect():
        coverage.setdefault(r[0], {})[r[1]] = r["count"]
    known.drop()
    n = sum(sum(c.values()) for c in coverage.values())
    return Ensemble(schema, list(numbered.labels), models, [1.0, 1.0, 1.0], ModelMetadata(version, trained_at, ["logistic_regression", "naive_bayes", "decision_tree"], n, len(schema), coverage))


def rescored(votes: DataFrame) -> DataFrame:
    """unit_id, share_<family>, primary and confidence from votes (unit_id, family, share).

    The mass of unknown families goes to the greatest known one (of equals, the one that
    wins ties of verdicts); then shares are divided by their sum."""
    known = [F.coalesce(F.sum(F.when(F.lower("family") == f, F.col("share"))), F.lit(0.0)).alias(f"k_{f}") for f in FAMILIES]
    sums = with_primary(votes.groupBy("unit_id").agg(*known).select("unit_id", *[F.col(f"k_{f}").alias(f"share_{f}") for f in FAMILIES]))
    total = sum((F.col(f"share_{f}") for f in FAMILIES[1:]), F.col(f"share_{FAMILIES[0]}"))
    more = [F.col(f"share_{f}") + F.when((F.col("primary") == f) & (total < 1), 1 - total).otherwise(0.0) for f in FAMILIES]
    given = sums.select("unit_id", *[m.alias(f"g_{f}") for f, m in zip(FAMILIES, more)])
    whole = sum((F.col(f"g_{f}") for f in FAMILIES[1:]), F.col(f"g_{FAMILIES[0]}"))
    return with_primary(given.select("unit_id", *[F.when(whole > 0, F.round(F.col(f"g_{f}") / whole, 6)).otherwise(0.0).alias(f"share_{f}") for f in FAMILIES]))


def lcg_split(labels: list[int], ratio: float, seed: int) -> tuple[list[int], list[int]]:
    """Indices for training and testing by a seeded shuffle within each class, in ascending order of classes.

    The generator's state is carried from class to class, so this is for lists that fit the driver;
    ``markov.stratified`` splits tables."""
    state, train, test = seed, [], []
    for label in sorted(set(labels)):
        own = [i for i, x in enumerate(labels) if x == label]
        for i in range(len(own) - 1, 0, -1):
            state = (state * 6364136223846793005 + 1) % (1 << 64)
            j = (state >> 33) % (i + 1)
            own[i], own[j] = own[j], own[i]
        n = min(max(1, int(len(own) * ratio + 0.5)), len(own) - 1)
        test += own[:n]
        train += own[n:]
    return sorted(train), sorted(test)


def saved_metadata(spark: SparkSession, metadata: ModelMetadata, folder: str) -> None:
    spark.createDataFrame([(metadata.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/metadata")
