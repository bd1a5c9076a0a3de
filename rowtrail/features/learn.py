"""Boosted trees on tracked frames: the model sees feature columns only, its output rows keep their ids."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtrail.features.base import Transformer
from rowtrail.features.boosting import Settings, Training, boost, test_scores
from rowtrail.functions import ids
from rowtrail.operators.split import with_folds
from rowtrail.operators.tracked import Tracked
from rowtrail.sources.storage import side_by_side


@dataclass
class Learner:
    """Preprocessing and boosted trees, fitted on the frame given to ``fit`` and on nothing else. NULL features are missing values to the trees."""

    steps: list[Transformer]
    label: str
    kind: str = "classifier"
    iterations: int = 100
    depth: int = 5
    rate: float = 0.1
    early_stopping: bool | None = None

    def fit(self, train: Tracked) -> "Learner":
        train = self._prepared(train.stored("train")).stored("features")
        self.features = self._feature_names(train)
        [self.model], _ = boost([Training(train.df, self.features, self.label)], self.settings)
        return self

    @property
    def settings(self) -> Settings:
        return Settings(self.kind, self.iterations, self.depth, rate=self.rate, early_stopping=self.early_stopping)

    def training(self, train: Tracked, test: Tracked) -> Training:
        """Rows for ``boost``: steps fitted on ``train`` alone, and what they make of ``train`` and of ``test``, which is only scored."""
        for step in self.steps:
            step.fit(train)
            train, test = step.transform(train), step.transform(test)
        self.features = self._feature_names(train)
        sides = [t.df.select(*self.features, self.label).withColumn("_test", F.lit(x)) for t, x in ((train, False), (test, True))]
        return Training(sides[0].unionByName(sides[1]), self.features, self.label, "_test")

    def _prepared(self, t: Tracked) -> Tracked:
        """Fits the steps one after the other."""
        for step in self.steps:
            step.fit(t)
            t = step.transform(t)
        return t

    def predict(self, t: Tracked) -> Tracked:
        """Adds ``prediction``, for classifiers also ``probability`` of class 1."""
        for step in self.steps:
            t = step.transform(t)
        scored = t.df.withColumn("_raw", self.model.column(t.df))
        if self.kind == "classifier":
            columns = [(F.col("_raw") > 0).cast("double").alias("prediction"), (1 / (1 + F.exp(-F.col("_raw")))).alias("probability")]
        else:
            columns = [F.col("_raw").alias("prediction")]
        kept = [c for c in t.columns if not isinstance(t.df.schema[c].dataType, _vector_type())]
        return replace(t, df=scored.select(*kept, *columns, *t.hidden), fresh=None)

    def score(self, t: Tracked) -> DataFrame:
        """One row: accuracy of a classifier, R² of a regressor, and the number of rows."""
        return score(self.predict(t), self.label, self.kind)

    def _feature_names(self, t: Tracked) -> list[str]:
        usable = (T.NumericType, T.BooleanType, _vector_type())
        return [
            f.name for f in t.df.schema.fields
            if f.name != self.label and not ids.is_hidden(f.name) and f.name not in self._kept()
            and isinstance(f.dataType, usable)
        ]

    def _kept(self) -> set[str]:
        return {c for step in self.steps for c in getattr(step, "keep", ())} | {
            c for step in self.steps for c in getattr(step, "exclude", ())
        }


def _vector_type():
    from pyspark.ml.linalg import VectorUDT

    return VectorUDT


def score(predicted: Tracked, label: str, kind: str = "classifier") -> DataFrame:
    y, p = F.col(label).cast("double"), F.col("prediction")
    if kind == "classifier":
        return predicted.df.agg(
            F.avg((y == p).cast("double")).alias("score"), F.count(F.lit(1)).alias("n")
        )
    # 1 - residual / total sum of squares, both from one pass
    return predicted.df.agg(
        (1 - F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count(y))).alias("score"), F.count(F.lit(1)).alias("n")
    )


def baseline(predicted: Tracked, label: str, kind: str = "classifier") -> float:
    """The score of always saying the same: the share of the larger class, or 0 for R², that of the mean."""
    if kind != "classifier":
        return 0.0
    share = predicted.df.agg(F.avg(F.col(label).cast("double"))).first()[0]
    return max(share, 1 - share) if share is not None else 0.0


def verdicts(predicted: Tracked, label: str, kind: str = "classifier", margin: float = 0.0) -> Tracked:
    """The rows with what must hold of the fitted model: ``prediction_ok``, ``probability_ok`` (classifiers) and ``score_ok``.

    A class is 0 or 1 and the likelier of the two, a regression is a finite number, a probability lies in [0, 1]; the reported score is the
    one counted from these rows another way, and better than that of always saying the same by ``margin`` or more.
    """
    predicted = predicted.stored("predicted")
    y, p = F.col(label).cast("double"), F.col("prediction")
    reported = score(predicted, label, kind).first()
    if kind == "classifier":
        again = predicted.df.filter(y == p).count() / max(reported["n"], 1)
        chance = F.col("probability")
        flags = {"prediction_ok": p == F.when(chance > 0.5, 1.0).otherwise(0.0), "probability_ok": chance.between(0, 1)}
    else:
        mean = predicted.df.agg(F.avg(y)).first()[0] or 0.0
        left, whole = predicted.df.agg(F.sum((y - p) ** 2), F.sum((y - mean) ** 2)).first()
        again = 1 - left / whole if whole else None
        flags = {"prediction_ok": ~F.isnan(p) & (F.abs(p) < float("inf"))}
    ok = again is not None and abs(again - reported["score"]) < 1e-6
    ok = ok and baseline(predicted, label, kind) + margin <= reported["score"] <= 1
    return predicted.with_columns(flags | {"score_ok": F.lit(ok)})


def top_risks(predicted: Tracked, k: int) -> DataFrame:
    """The ``k`` rows with the highest probability."""
    return predicted.df.orderBy(F.desc("probability"), *predicted.hidden).limit(k)


def cross_validate(t: Tracked, make_learner, folds: int, seed: int = 0, key: str | None = None) -> list[tuple[int, float, int, float]]:
    """(fold, score, test rows, baseline) of a learner fitted anew without each fold."""
    return cross_validate_all(t, {"": make_learner}, folds, seed, key)[""]


def cross_validate_all(
    t: Tracked, makers: dict, folds: int, seed: int = 0, key: str | None = None
) -> dict[str, list[tuple[int, float, int, float]]]:
    """(fold, score, test rows, baseline) of each learner, fitted anew without each fold.

    Preprocessing is fitted per fold, on the other folds; the trees of all learners and folds then grow together, in the same jobs.
    """
    folded = with_folds(t, folds, seed, key, "_fold").stored("folds")
    steps, names = [], []
    for name, make in makers.items():
        for fold in range(folds):
            learner = make()
            train = folded.filter(F.col("_fold") != fold).drop("_fold")
            test = folded.filter(F.col("_fold") == fold).drop("_fold")
            names.append((name, fold))
            steps.append(partial(learner.training, train, test))
    trainings = side_by_side(steps)
    settings = {make().settings for make in makers.values()}
    if len(settings) > 1:
        raise ValueError("learners that are compared must boost alike")
    _, blocks = boost(trainings, settings.pop())
    kind = next(iter(makers.values()))().kind
    y, raw = F.col("y"), F.col("raw")
    if kind == "classifier":
        value, base = F.avg(((raw > 0) == (y > 0)).cast("double")), F.greatest(F.avg(y), 1 - F.avg(y))
    else:
        value, base = 1 - F.sum((y - raw) * (y - raw)) / (F.var_pop(y) * F.count(y)), F.lit(0.0)
    scores = test_scores(blocks).groupBy("model").agg(value.alias("score"), F.count(F.lit(1)).alias("n"), base.alias("baseline"))
    found = {r["model"]: r for r in scores.collect()}
    out: dict[str, list[tuple[int, float, int, float]]] = {name: [] for name in makers}
    for i, (name, fold) in enumerate(names):
        out[name].append((fold, *(found[i][c] for c in ("score", "n", "baseline"))) if i in found else (fold, None, 0, None))
    return out


def compare(spark, results: dict[str, list[tuple[int, float, int, float]]]) -> DataFrame:
    """Fold scores of several learners as one table (name, fold, score, n, baseline)."""
    rows = [(name, *fold) for name, folds in results.items() for fold in folds]
    return spark.createDataFrame(rows, "name string, fold int, score double, n bigint, baseline double")
