"""Encoders of categories, dates and texts."""

from __future__ import annotations

import re

from pyspark.ml.feature import IDF, PCA, HashingTF, OneHotEncoder
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtrail.features.base import ColumnwiseTransformer
from rowtrail.features.factorise import Weights, activations, fitted_weights, gram_counts
from rowtrail.functions import text, time
from rowtrail.operators.parts import MAX_BROADCAST_GROUPS
from rowtrail.operators.tracked import Tracked
from rowtrail.sources.numbering import number_rows
from rowtrail.sources.storage import store

LOW_CARDINALITY = 40  # fixed value: up to this many categories a table vectorizer uses one-hot


def category_table(t: Tracked, column: str) -> tuple[DataFrame, int]:
    """(value, rank) of a column's distinct values in sorted order, and how many there are."""
    values = t.df.select(F.col(column).alias("_value")).na.drop().distinct()
    n = values.count()
    if n <= MAX_BROADCAST_GROUPS:
        ordered = sorted(row[0] for row in values.collect())  # just counted: a bounded list
        kind = values.schema["_value"].dataType.simpleString()
        return values.sparkSession.createDataFrame(
            [(v, i) for i, v in enumerate(ordered)], f"_value {kind}, _rank bigint"
        ), n
    return number_rows(store(values, "categories"), ["_value"], "_rank"), n


def with_rank(t: Tracked, column: str, table: DataFrame, n: int, unknown: int, out: str) -> Tracked:
    """Add the rank of a category; ``unknown`` for values not in the table."""
    side = F.broadcast(table) if n <= MAX_BROADCAST_GROUPS else table
    joined = t.df.join(side, F.col(column) == F.col("_value"), "left")
    ranked = joined.withColumn("_rank", F.coalesce("_rank", F.lit(unknown).cast("long"))).drop("_value")
    if out in t.columns:
        ranked = ranked.drop(out)
    return Tracked(ranked.withColumnRenamed("_rank", out), t.trail, t.nodes)


class OrdinalEncoder(ColumnwiseTransformer):
    """Categories become their rank; values unseen in training become -1."""

    def fit(self, t: Tracked) -> "OrdinalEncoder":
        self.tables = {c: category_table(t, c) for c in self.columns}
        return self

    def transform(self, t: Tracked) -> Tracked:
        order = t.columns
        for c, (table, n) in self.tables.items():
            t = with_rank(t, c, table, n, -1, c)
        return t.select(*order)


class OneHotEncoder01(ColumnwiseTransformer):
    """0/1 per category; unseen values and NULL give zeros.

    ``form="columns"`` gives a column per category, ``form="vector"`` one sparse vector column per encoded column, for any number of
    categories. Names are made of column and value; those that would meet each other or a column of the frame are numbered.
    """

    def __init__(self, columns: list[str], form: str = "columns"):
        super().__init__(columns)
        if form not in ("columns", "vector"):
            raise ValueError("form must be columns or vector")
        self.form = form

    def fit(self, t: Tracked) -> "OneHotEncoder01":
        self.dense: dict[str, dict[str, object]] = {}
        self.sparse: dict[str, tuple] = {}
        taken = {c.lower() for c in t.columns}
        for c in self.columns:
            table, n = category_table(t, c)
            if self.form == "columns":
                if n > MAX_BROADCAST_GROUPS:
                    raise ValueError(f"{c} has {n} categories: use form='vector'")
                values = [row["_value"] for row in table.orderBy("_rank").collect()]
                names = [f"{c}_{re.sub('[^0-9A-Za-z]+', '_', str(v))}" for v in values]
                if len({x.lower() for x in names}) < n or taken & {x.lower() for x in names}:
                    names = _numbered_names(c, n, taken)
                taken |= {x.lower() for x in names}
                self.dense[c] = dict(zip(names, values))
            else:
                encoder = OneHotEncoder(inputCol="_rank", outputCol=f"{c}_onehot", dropLast=True)
                # rank n stands for unknown and is the dropped last category
                model = encoder.fit(table.sparkSession.createDataFrame([(float(n),)], "_rank double"))
                self.sparse[c] = (table, n, model)
        return self

    def transform(self, t: Tracked) -> Tracked:
        flags = {
            out: time.flag(F.col(c) == F.lit(v)) for c, outs in self.dense.items() for out, v in outs.items()
        }
        if flags:
            t = t.with_columns(flags)
        for c, (table, n, model) in self.sparse.items():
            ranked = with_rank(t, c, table, n, n, "_rank")
            ranked = ranked.with_columns({"_rank": F.col("_rank").cast("double")})
            t = Tracked(model.transform(ranked.df).drop("_rank"), t.trail, t.nodes)
        return t.drop(*self.columns)

    def outputs(self) -> list[str]:
        return [o for outs in self.dense.values() for o in outs] + [f"{c}_onehot" for c in self.sparse]


def _numbered_names(column: str, n: int, taken: set[str]) -> list[str]:
    stem = column
    while any(f"{stem}_{i}".lower() in taken for i in range(n)):
        stem += "_"
    return [f"{stem}_{i}" for i in range(n)]


class DatetimeEncoder(ColumnwiseTransformer):
    """Year, month, day, hour and epoch seconds of timestamp columns."""

    def fit(self, t: Tracked) -> "DatetimeEncoder":
        return self

    def transform(self, t: Tracked) -> Tracked:
        exprs = {name: expr for c in self.columns for name, expr in time.parts(c).items()}
        return t.with_columns(exprs).drop(*self.columns)

    def outputs(self) -> list[str]:
        return [f"{c}_{p}" for c in self.columns for p in time.PARTS]


class TimestampParser(ColumnwiseTransformer):
    """Text columns to timestamps; what cannot be parsed becomes NULL."""

    def fit(self, t: Tracked) -> "TimestampParser":
        return self

    def transform(self, t: Tracked) -> Tracked:
        return t.with_columns({c: time.parse(c) for c in self.columns})


class _TextEncoder(ColumnwiseTransformer):
    def __init__(self, columns: list[str], n_components: int = 30):
        super().__init__(columns)
        self.n_components = n_components

    def outputs(self) -> list[str]:
        return [f"{c}_{i}" for c in self.columns for i in range(self.n_components)]

    def _spread(self, t: Tracked, column: str, array: str) -> Tracked:
        exprs = {f"{column}_{i}": F.col(array)[i] for i in range(self.n_components)}
        return t.with_columns(exprs).drop(column, array)


def _lowered(column: str):
    return F.lower(F.coalesce(F.col(column), F.lit("")))


def _long_texts(df: DataFrame, column: str) -> DataFrame | None:
    """(_key, _long) of the distinct texts that are counted in pieces; None if there are none."""
    found = df.select(_lowered(column).alias("_long")).filter(F.length("_long") > text.PIECE_CHARS)
    found = found.select(F.sha2("_long", 256).alias("_key"), "_long").dropDuplicates(["_key"])
    return None if found.isEmpty() else found


def _added_up(texts: DataFrame, pieces: Column, items: Column, counter: HashingTF) -> DataFrame:
    """(_key, counts): what ``items`` finds in each of a text's ``pieces``, counted and added up; no row holds all of a text's items."""
    out = counter.getOutputCol()
    rows = texts.select("_key", F.explode(pieces).alias("_piece")).repartition("_key", "_piece")
    counted = counter.transform(rows.select("_key", items.alias(counter.getInputCol()))).select("_key", out)
    return store(counted.groupBy("_key").agg(Summarizer.sum(F.col(out)).alias(out)), "counts")


class MinHashEncoder(_TextEncoder):
    """Min-hash signature of a text's 2- to 4-grams: a projection, nothing to fit and nothing to shuffle."""

    def fit(self, t: Tracked) -> "MinHashEncoder":
        return self

    def transform(self, t: Tracked) -> Tracked:
        for c in self.columns:
            hashes = text.min_hashes(F.coalesce(F.col(c), F.lit("")), self.n_components)
            t = self._spread(t.with_columns({"_hashes": hashes}), c, "_hashes")
        return t


def _counted_by_length(df: DataFrame, column: str, count, count_long, items: str, out: str) -> DataFrame:
    """``count`` of the rows with short texts, and the long ones met with the counts of their texts."""
    long = _long_texts(df, column)
    if long is None:
        return count(df)
    is_long = F.length(_lowered(column)) > text.PIECE_CHARS
    kind = F.lit(None).cast("array<string>").alias(items)
    joined = df.filter(is_long).withColumn("_key", F.sha2(_lowered(column), 256)).join(count_long(long), "_key")
    return count(df.filter(~is_long)).unionByName(joined.select(*df.columns, kind, out))


class GapEncoder(_TextEncoder):
    """Latent topics of a text's character 2- to 4-grams: activations of a Gamma-Poisson factorisation, fitted on the distinct training texts.

    All grams count: they are hashed into ``buckets`` places, none is left out. Each distinct text is activated once, then met with its rows.
    """

    def __init__(self, columns: list[str], n_components: int = 30, buckets: int = 1 << 12, iterations: int = 10):
        super().__init__(columns, n_components)
        self.buckets, self.iterations = buckets, iterations

    def fit(self, t: Tracked) -> "GapEncoder":
        self.models: dict[str, Weights] = {}
        for c in self.columns:
            counts = store(gram_counts(t.df, c, 2, 4, self.buckets), "grams")
            self.models[c] = fitted_weights(counts, self.n_components, self.buckets, self.iterations)
        return self

    def transform(self, t: Tracked) -> Tracked:
        for c, weights in self.models.items():
            active = activations(gram_counts(t.df, c, 2, 4, self.buckets), weights)
            active = store(active.select(F.col("key").alias("_text"), F.col("active").alias("_topics")), "topics")
            side = F.broadcast(active) if active.count() <= MAX_BROADCAST_GROUPS else active
            df = t.df.join(side, F.sha2(_lowered(c), 256) == F.col("_text"), "left").drop("_text")
            t = self._spread(Tracked(df, t.trail, t.nodes), c, "_topics")
        return t

    def _counted(self, df: DataFrame, column: str) -> DataFrame:
        """Rows with ``_counts``: their hashed grams in order, each with how often it occurs."""
        counts = gram_counts(df, column, 2, 4, self.buckets)
        times = F.coalesce("times", F.transform("codes", lambda _: F.lit(1)))
        pairs = counts.select(F.col("key").alias("_text"), F.explode(F.arrays_zip(F.col("codes").alias("code"), times.alias("n"))).alias("p"))
        added = pairs.groupBy("_text", "p.code").agg(F.sum("p.n").alias("n")).groupBy("_text")
        listed = added.agg(F.array_sort(F.collect_list(F.struct("code", "n"))).alias("_counts"))
        rows = df.withColumn("_text", F.sha2(_lowered(column), 256)).join(listed, "_text", "left").drop("_text")
        return rows.withColumn("_counts", F.coalesce("_counts", F.array().cast("array<struct<code:int,n:bigint>>")))


class TextEncoder(_TextEncoder):
    """Text embedding: hashed word counts, idf weights, principal components.

    Takes the place of a pretrained sentence model; ``embed_with_model`` runs a user's own.
    """

    def __init__(self, columns: list[str], n_components: int = 30, buckets: int = 512):
        super().__init__(columns, n_components)
        self.buckets = buckets

    def fit(self, t: Tracked) -> "TextEncoder":
        self.models = {}
        for c in self.columns:
            counted = self._counted(t.df, c)
            idf = IDF(inputCol="_tf", outputCol="_tfidf").fit(counted)
            pca = PCA(k=self.n_components, inputCol="_tfidf", outputCol="_pca").fit(idf.transform(counted))
            self.models[c] = (idf, pca)
        return self

    def transform(self, t: Tracked) -> Tracked:
        for c, (idf, pca) in self.models.items():
            df = pca.transform(idf.transform(self._counted(t.df, c)))
            df = df.withColumn("_embedding", vector_to_array("_pca")).drop("_words", "_tf", "_tfidf", "_pca")
            t = self._spread(Tracked(df, t.trail, t.nodes), c, "_embedding")
        return t

    def _counted(self, df: DataFrame, column: str) -> DataFrame:
        counter = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=self.buckets)

        def count(rows):
            return counter.transform(rows.withColumn("_words", F.split(_lowered(column), r"\s+")))

        def count_long(texts):
            return _added_up(texts, text.word_pieces(F.col("_long")), F.split("_piece", r"\s+"), counter)

        return _counted_by_length(df, column, count, count_long, "_words", "_tf")


def embed_with_model(t: Tracked, column: str, out: str, load) -> Tracked:
    """Embed a text column with a user's model: ``load()`` runs once per task and returns a function from a
    list of texts to a list of float lists. Texts reach it in Arrow batches."""

    def run(batches):
        encode = load()
        for batch in batches:
            batch[out] = [list(map(float, v)) for v in encode(batch[column].tolist())]
            yield batch

    schema = T.StructType([*t.df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    return Tracked(t.df.mapInPandas(run, schema), t.trail, t.nodes)


class TableVectorizer:
    """Choose an encoder per column: numbers pass, timestamps give their parts, text columns with at most
    ``threshold`` distinct values become one-hot, the others go to ``high_cardinality(columns)``."""

    def __init__(self, high_cardinality=MinHashEncoder, threshold: int = LOW_CARDINALITY, exclude: tuple[str, ...] = ()):
        self.high_cardinality, self.threshold, self.exclude = high_cardinality, threshold, tuple(exclude)

    def fit(self, t: Tracked) -> "TableVectorizer":
        fields = [f for f in t.df.schema.fields if f.name in t.columns and f.name not in self.exclude]
        self.columns = [f.name for f in fields]
        self.numbers = [f.name for f in fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
        times = [f.name for f in fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
        texts = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
        # exact, and no more than threshold + 1 values are ever counted at the end
        kinds = {c: t.df.select(c).na.drop().distinct().limit(self.threshold + 1).count() for c in texts}
        low = [c for c in texts if kinds[c] <= self.threshold]
        high = [c for c in texts if kinds[c] > self.threshold]
        self.steps = [DatetimeEncoder(times)] if times else []
        self.steps += [OneHotEncoder01(low)] if low else []
        self.steps += [self.high_cardinality(high)] if high else []
        for step in self.steps:
            step.fit(t)
        return self

    def transform(self, t: Tracked) -> Tracked:
        for step in self.steps:
            t = step.transform(t)
        return t.select(*self.exclude, *self.outputs())

    def outputs(self) -> list[str]:
        return self.numbers + [o for step in self.steps for o in step.outputs()]


class TargetEncoder:
    """Mean target per category from the training rows only; unseen categories get the training mean."""

    def __init__(self, column: str, target: str, out: str):
        self.column, self.target, self.out = column, target, out
        self.columns = [column]

    def fit(self, t: Tracked) -> "TargetEncoder":
        self.rates = store(
            t.df.groupBy(F.col(self.column).alias("_category")).agg(F.avg(self.target).alias(self.out)), "target_means"
        )
        self.default = t.df.agg(F.avg(self.target)).first()[0]
        return self

    def transform(self, t: Tracked) -> Tracked:
        joined = t.df.join(self.rates, F.col(self.column).eqNullSafe(F.col("_category")), "left").drop("_category")
        filled = joined.withColumn(self.out, F.coalesce(self.out, F.lit(self.default).cast("double")))
        return Tracked(filled, t.trail, t.nodes)

    def outputs(self) -> list[str]:
        return [self.out]
