"""Sequence models and votes: n-gram counts, Laplace probabilities, likelihoods, ensembles."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType

from lineament.functions.shipping import ship


def transitions(sequences: DataFrame, alpha: float = 0.5) -> DataFrame:
    """family, context, next, count, total and prob from (family, seq_id, pos, token), order 1."""
    pairs = sequences.select("family", "seq_id", F.col("token").alias("context"), F.lead("token").over(Window.partitionBy("seq_id").orderBy("pos")).alias("next")).where("next IS NOT NULL")
    counts = pairs.groupBy("family", "context", "next").agg(F.count(F.lit(1)).alias("count"))
    size = sequences.select("token").distinct().count()
    total = F.sum("count").over(Window.partitionBy("family", "context"))
    return counts.select("family", "context", "next", "count", total.alias("total"), F.round((F.col("count") + alpha) / (total + alpha * size), 6).alias("prob"))


def likelihoods(sequences: DataFrame, model: DataFrame, size: int) -> DataFrame:
    """seq_id, candidate and ll: an unseen context gives ln(1 / size), an unseen next shares what is left."""
    pairs = sequences.select("seq_id", F.col("token").alias("context"), F.lead("token").over(Window.partitionBy("seq_id").orderBy("pos")).alias("next")).where("next IS NOT NULL")
    counted = pairs.groupBy("seq_id", "context", "next").agg(F.count(F.lit(1)).alias("times"))
    contexts = model.groupBy("family", "context").agg(F.sum("prob").alias("mass"), F.count(F.lit(1)).alias("seen"))
    families = F.broadcast(model.select("family").distinct().agg(F.collect_set("family").alias("families")))
    rows = counted.join(families, F.lit(True)).select("seq_id", "context", "next", "times", F.explode("families").alias("family"))
    known = rows.join(contexts, ["family", "context"], "left").join(model.select("family", "context", "next", "prob"), ["family", "context", "next"], "left")
    left = F.greatest((1 - F.col("mass")) / F.greatest(F.lit(size) - F.col("seen"), F.lit(1)), F.lit(1e-12))
    lp = F.when(F.col("mass").isNull(), F.log(F.lit(1.0 / size))).otherwise(F.log(F.coalesce("prob", left)))
    return known.groupBy("seq_id", "family").agg(F.sum(F.col("times") * lp).alias("ll"))


def classified(ll: DataFrame) -> DataFrame:
    """seq_id, family and prob of the likeliest family, by a softmax over likelihoods."""
    top = F.max("ll").over(Window.partitionBy("seq_id"))
    p = ll.select("seq_id", "family", F.exp(F.col("ll") - top).alias("e"))
    best = p.groupBy("seq_id").agg(F.sum("e").alias("total"), F.max(F.struct("e", "family")).alias("m"))
    return best.select("seq_id", F.col("m.family").alias("family"), F.round(F.col("m.e") / F.col("total"), 6).alias("prob"))


def voted(votes: DataFrame) -> DataFrame:
    """unit_id, family and share from (unit_id, family, weight): weighted one-hot votes."""
    total = F.sum("weight").over(Window.partitionBy("unit_id"))
    return votes.groupBy("unit_id", "family").agg(F.sum("weight").alias("weight")).select("unit_id", "family", F.round(F.col("weight") / total, 6).alias("share"))


def accuracy(pairs: DataFrame, label: str, predicted: str) -> DataFrame:
    return pairs.agg(F.coalesce(F.round(F.avg((F.col(label) == F.col(predicted)).cast("double")), 6), F.lit(0.0)).alias("accuracy"))


def stratified(df: DataFrame, key: Column, label: str, ratio: float = 0.2) -> DataFrame:
    """Adds ``test``: of each class, max(1, round(n * ratio)) rows but never all, by a keyed hash.

    Rows are ranked within blocks of the hash's first three digits, and blocks by their counts,
    so that no class is gathered in one task."""
    hashed = df.withColumn("_h", F.md5(key.cast("string"))).withColumn("_block", F.substring("_h", 1, 3))
    blocks = hashed.groupBy(label, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(label).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.select(F.col(label).alias("_label"), F.col("_block").alias("_b"), before.alias("_before"), F.sum("_n").over(Window.partitionBy(label)).alias("_all"))
    inside = F.row_number().over(Window.partitionBy(label, "_block").orderBy("_h", key))
    ranked = hashed.withColumn("_inside", inside).join(placed, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_block") == F.col("_b")))
    take = F.least(F.greatest(F.floor(F.col("_all") * ratio + 0.5), F.lit(1)), F.col("_all") - 1)
    return ranked.select(*df.columns, (F.col("_before") + F.col("_inside") <= take).alias("test"))


# Orders one to three by language, with back-off. ------------------------------------

UNKNOWN = "<UNK>"


def encoded(sequences: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Tokens that the vocabulary (token) does not have become UNKNOWN. A vocabulary has a row a kind of token."""
    known = vocabulary.select("token", F.lit(True).alias("_known"))
    return sequences.join(known, "token", "left").withColumn("token", F.when(F.col("_known"), F.col("token")).otherwise(F.lit(UNKNOWN))).drop("_known")


def ngrams(sequences: DataFrame, orders: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """language, family, seq_id, order, context (tokens joined by commas) and next, one row a place.

    Input: language, family, seq_id, pos, token."""
    along = Window.partitionBy("seq_id").orderBy("pos")
    ahead = [F.col("token"), *(F.lead("token", k).over(along) for k in range(1, max(orders) + 1))]
    rows = sequences.select("language", "family", "seq_id", *[a.alias(f"t{k}") for k, a in enumerate(ahead)])
    each = [F.when(F.col(f"t{k}").isNotNull(), F.struct(F.lit(k).alias("order"), F.concat_ws(",", *[f"t{i}" for i in range(k)]).alias("context"), F.col(f"t{k}").alias("next"))) for k in orders]
    return rows.select("language", "family", "seq_id", F.explode(F.array_compact(F.array(*each))).alias("g")).select("language", "family", "seq_id", "g.*")


def trained_orders(grams: DataFrame, size: int, alpha: float = 0.5) -> DataFrame:
    """language, family, order, context, next, count, total and prob, smoothed over ``size`` tokens (UNKNOWN among them)."""
    return smoothed(grams.groupBy("language", "family", "order", "context", "next").agg(F.count(F.lit(1)).alias("count")), size, alpha)


def smoothed(counts: DataFrame, size: int, alpha: float = 0.5) -> DataFrame:
    """The same from counts."""
    totals = counts.groupBy("language", "family", "order", "context").agg(F.sum("count").alias("total"))
    rows = counts.join(totals, ["language", "family", "order", "context"])
    return rows.select("language", "family", "order", "context", "next", "count", "total", ((F.col("count") + alpha) / (F.col("total") + alpha * size)).alias("prob"))


#: Rows of a model that is sent along to executors; a larger one is joined.
MOST_SENT = 400_000
ORDERS = (1, 2, 3)


def whole(sequences: DataFrame) -> DataFrame:
    """language, seq_id, tokens and, if there is one, family: one row a sequence, its tokens in order."""
    keys = [k for k in ("language", "family", "seq_id") if k in sequences.columns]
    return sequences.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("_t")).select(*keys, F.col("_t.token").alias("tokens"))


def grams_of(tokens: list[str | None], order: int) -> list[tuple[str, str]]:
    """Contexts and what follows them, as ``ngrams`` makes them."""
    if None not in tokens:
        if order == 1:
            return list(zip(tokens, tokens[1:]))
        return list(zip(map(",".join, zip(*(tokens[i:] for i in range(order)))), tokens[order:]))
    return [(",".join(t for t in tokens[i : i + order] if t is not None), tokens[i + order]) for i in range(len(tokens) - order) if tokens[i + order] is not None]


def counted_orders(rows: DataFrame) -> DataFrame:
    """language, family, order, context, next and count from (language, family, tokens): batches are counted where they are,
    so what is shuffled is a row a kind of n-gram and batch, not one a place."""
    ship(rows.sparkSession)
    types = rows.select("language", "family").schema
    schema = types.add("order", IntegerType()).add("context", StringType()).add("next", StringType()).add("count", LongType())
    arrow = to_arrow_schema(schema)

    def run(batches):
        counts: Counter = Counter()

        def flushed():
            made = [[*k, n] for k, n in counts.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], arrow[i].type) for i in range(6)], schema=arrow)

        for batch in batches:
            for language, family, tokens in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for order in ORDERS:
                    counts.update([(language, family, order, *g) for g in grams_of(tokens, order)])
                if len(counts) > MOST_KINDS:
                    yield flushed()
        yield flushed()

    made = rows.select("language", "family", "tokens").mapInArrow(run, schema)
    return made.groupBy("language", "family", "order", "context", "next").agg(F.sum("count").alias("count"))


#: Kinds of n-grams that a task counts before it hands them on.
MOST_KINDS = 200_000


class Said:
    """Logarithms of a model's probabilities, by language and order, for all its families at once."""

    def __init__(self, rows: list, size: int):
        by = defaultdict(lambda: defaultdict(list))
        self.families: dict[str, list] = {}
        for language, family, order, context, following, prob in rows:
            by[language, order][context].append((family, following, prob))
        every = defaultdict(set)
        for (language, order), contexts in by.items():
            every[language] |= {f for own in contexts.values() for f, _, _ in own}
        self.families = {x: sorted(f) for x, f in every.items()}
        self.tables: dict[tuple, tuple] = {}
        for (language, order), contexts in by.items():
            families = sorted({f for own in contexts.values() for f, _, _ in own})
            place = {f: k for k, f in enumerate(families)}
            # Row 0 is for a context that nobody knows.
            table, at = [[math.log(1.0 / size)] * len(families)], {}
            for context, own in contexts.items():
                mass, seen = [0.0] * len(families), [0] * len(families)
                for f, _, prob in own:
                    mass[place[f]] += prob
                    seen[place[f]] += 1
                rest = [math.log(max((1 - m) / max(size - k, 1), 2.2250738585072014e-308)) if k else table[0][0] for m, k in zip(mass, seen)]
                at[context] = len(table)
                table.append(rest)
                for following in {n for _, n, _ in own}:
                    line = list(rest)
                    for f, n, prob in own:
                        if n == following:
                            line[place[f]] = math.log(prob)
                    at[context, following] = len(table)
                    table.append(line)
            self.tables[language, order] = families, at, np.array(table)

    def of(self, language: str, tokens: list[str | None]) -> list[tuple]:
        """family, order and prob."""
        if not (every := self.families.get(language)):
            return []
        best: dict = {}
        for order in ORDERS:
            if (known := self.tables.get((language, order))) and (grams := grams_of(tokens, order)):
                families, at, table = known
                counts = np.bincount([at.get(g) or at.get(g[0], 0) for g in grams], minlength=1)
                places = counts.nonzero()[0]
                for f, ll in zip(families, (counts[places] @ table[places]).tolist()):
                    if ll:
                        best[f] = order, ll
        if not best:
            return [(f, None, 1 / len(every)) for f in every]
        top = max(ll for _, ll in best.values())
        e = {f: math.exp(ll - top) for f, (_, ll) in best.items()}
        total = sum(e.values())
        return [(f, best[f][0] if f in best else None, e.get(f, 0.0) / total) for f in every]


def backed_off(sequences: DataFrame, model: DataFrame, size: int) -> DataFrame:
    """seq_id, family, order and prob of every family that the sequence's language has models of.

    A family speaks by its highest order whose likelihood is not zero: zero says that the
    sequence is too short. If none speaks, all are equally likely.

    Sequences are rows (language, seq_id, pos, token), or whole (``tokens``). Each stays in its row, and the model, a
    row a kind of n-gram, goes along; a model of more than MOST_SENT rows is joined by its n-grams."""
    few = model.select("language", "family", "order", "context", "next", "prob").limit(MOST_SENT + 1).toPandas()
    if len(few) > MOST_SENT:
        rows = sequences.select("language", "seq_id", F.posexplode("tokens").alias("pos", "token")) if "tokens" in sequences.columns else sequences
        return joined_orders(rows, model, size)
    ship(sequences.sparkSession)
    whole_ones = sequences if "tokens" in sequences.columns else whole(sequences.select("language", "seq_id", "pos", "token"))
    rows = whole_ones.select("seq_id", "language", "tokens")
    said = sequences.sparkSession.sparkContext.broadcast(list(few.where(few.notna(), None).itertuples(index=False, name=None)))
    schema = rows.select("seq_id").schema.add("family", model.schema["family"].dataType).add("order", IntegerType()).add("prob", DoubleType())
    arrow = to_arrow_schema(schema)

    def run(batches):
        models = Said(said.value, size)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = [models.of(x, t) for x, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                places = pa.array([k for k, m in enumerate(made) for _ in m], pa.int32())
                flat = [r for m in made for r in m]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow[0].type).take(places), *(pa.array([r[i] for r in flat], arrow[1 + i].type) for i in range(3))], schema=arrow)

    return rows.mapInArrow(run, schema)


def joined_orders(sequences: DataFrame, model: DataFrame, size: int) -> DataFrame:
    """``backed_off`` by joins, for models that are not sent along."""
    orders = tuple(range(1, 4))
    spoken = ngrams(sequences.withColumn("family", F.lit(None).cast("string")), orders).drop("family")
    counted = spoken.groupBy("language", "seq_id", "order", "context", "next").agg(F.count(F.lit(1)).alias("times"))
    families = model.select("language", "family", "order").distinct()
    rows = counted.join(families, ["language", "order"])
    contexts = model.groupBy("language", "family", "order", "context").agg(F.sum("prob").alias("mass"), F.count(F.lit(1)).alias("seen"))
    keys = ["language", "family", "order", "context"]
    known = rows.join(contexts, keys, "left").join(model.select(*keys, "next", "prob"), [*keys, "next"], "left")
    rest = F.greatest((1 - F.col("mass")) / F.greatest(F.lit(size) - F.col("seen"), F.lit(1)), F.lit(2.2250738585072014e-308))
    lp = F.when(F.col("mass").isNull(), F.log(F.lit(1.0 / size))).otherwise(F.log(F.coalesce("prob", rest)))
    ll = known.groupBy("seq_id", "family", "order").agg(F.sum(F.col("times") * lp).alias("ll")).where("ll <> 0")
    best = ll.groupBy("seq_id", "family").agg(F.max(F.struct("order", "ll")).alias("b"))
    every = sequences.select("seq_id", "language").distinct().join(families.select("language", "family").distinct(), "language")
    scored = every.join(best, ["seq_id", "family"], "left").select("seq_id", "family", F.col("b.order").alias("order"), F.col("b.ll").alias("ll"))
    tops = scored.groupBy("seq_id").agg(F.max("ll").alias("top"), F.count(F.lit(1)).alias("n"))
    weighed = scored.join(tops, "seq_id").withColumn("e", F.when(F.col("top").isNull(), 1 / F.col("n")).otherwise(F.coalesce(F.exp(F.col("ll") - F.col("top")), F.lit(0.0))))
    total = weighed.groupBy("seq_id").agg(F.sum("e").alias("sum"))
    return weighed.join(total, "seq_id").select("seq_id", "family", "order", (F.col("e") / F.col("sum")).alias("prob"))
