"""``pyspark.ml`` stages: standardiser, factor scorer, utility components and their aggregation, all savable.

What a stage does or has learned is a few numbers per column, kept as one JSON parameter. So a fitted stage scores new data
without another pass over those it was fitted on, and lives in a stored ``Pipeline`` or ``PipelineModel`` like any other stage.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import add
from ..operators import utility
from ..operators.encode import MIN_SD, scale_stats
from . import choice, latent


class Spec(Params, DefaultParamsReadable, DefaultParamsWritable):
    """A stage described by one JSON value. Stages are read back without arguments, so all of them are optional."""

    spec = Param(Params._dummy(), "spec", "what the stage does or has learned, as JSON", TypeConverters.toString)

    def _keep(self, **values: Any) -> None:
        self._set(spec=json.dumps(values))

    def value(self, name: str) -> Any:
        return json.loads(self.getOrDefault(self.spec))[name]


class ZScore(Estimator, Spec):
    """z-score columns; ``ddof`` 0 or 1."""

    def __init__(self, columns: list[str] | None = None, ddof: int = 0, suffix: str = "_z"):
        super().__init__()
        self._keep(columns=list(columns or []), ddof=ddof, suffix=suffix)

    def _fit(self, dataset: DataFrame) -> ZScoreModel:
        columns = self.value("columns")
        row = scale_stats(dataset, columns, self.value("ddof")).first()
        return ZScoreModel({c: (row[f"mu_{c}"], row[f"sd_{c}"]) for c in columns}, self.value("suffix"))


class ZScoreModel(Model, Spec):
    """A column without values becomes NULL; one that hardly varies is only centred."""

    def __init__(self, state: dict[str, tuple[float, float]] | None = None, suffix: str = "_z"):
        super().__init__()
        self._keep(state={c: (mu, sd if sd is not None and sd > MIN_SD else 1.0) for c, (mu, sd) in (state or {}).items()}, suffix=suffix)

    @property
    def state(self) -> dict[str, tuple[float, float]]:
        return {c: tuple(v) for c, v in self.value("state").items()}

    @property
    def suffix(self) -> str:
        return self.value("suffix")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({c + self.suffix: (F.col(c) - mu) / sd for c, (mu, sd) in self.state.items()})

    def inverse_transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({f"{c}_back": F.col(c + self.suffix) * sd + mu for c, (mu, sd) in self.state.items()})


class FactorScorer(Estimator, Spec):
    """Loadings of a factor model; scores are sum(loading * item) / sum(loading^2) over the answered items."""

    def __init__(self, factors: dict[str, list[str]] | None = None, paths: list[tuple[str, str]] = ()):
        super().__init__()
        self._keep(factors=factors or {}, paths=[list(p) for p in paths])

    def _fit(self, dataset: DataFrame) -> FactorScorerModel:
        factors, paths = self.value("factors"), [tuple(p) for p in self.value("paths")]
        every = [i for cols in factors.values() for i in cols]
        rows = latent.sem_params(latent.sem_fit(dataset, factors, paths), every).filter("part = 'loading'").collect()
        by_item = {r.lval: r.estimate for r in rows}
        return FactorScorerModel({f: {i: by_item[i] for i in cols} for f, cols in factors.items()})


class FactorScorerModel(Model, Spec):
    def __init__(self, loadings: dict[str, dict[str, float]] | None = None):
        super().__init__()
        self._keep(loadings=loadings or {})

    @property
    def loadings(self) -> dict[str, dict[str, float]]:
        return self.value("loadings")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({f: utility.loading_score(lam) for f, lam in self.loadings.items()})


class Component(Estimator, Spec):
    """One part of a utility function: a coefficient for each of its terms, learned from the outcome.

    A term is a column or a product of columns, written "a*b". ``how``: "slope" and "correlation" take one term at a time,
    "logit" fits all of them together (coefficients without the intercept).
    """

    def __init__(self, name: str = "", terms: list[str] | None = None, outcome: str = "chosen", how: str = "slope"):
        super().__init__()
        if how not in ("slope", "correlation", "logit"):
            raise ValueError(f"unknown way to fit a component: {how}")
        self._keep(name=name, terms=list(terms or []), outcome=outcome, how=how)

    def _fit(self, dataset: DataFrame) -> ComponentModel:
        terms, y = self.value("terms"), F.col(self.value("outcome")).cast("double")
        if self.value("how") == "logit":
            rows = dataset.select(self.value("outcome"), *[utility.product(t).alias(f"t{i}") for i, t in enumerate(terms)])
            fit = choice.fit_logit(rows, [f"t{i}" for i in range(len(terms))], self.value("outcome"))
            found = [fit.params[f"t{i}"] for i in range(len(terms))]
        else:
            one = (lambda x: F.regr_slope(y, x)) if self.value("how") == "slope" else (lambda x: F.corr(y, x))
            row = dataset.agg(*[one(utility.product(t)).alias(f"t{i}") for i, t in enumerate(terms)]).first()
            found = [0.0 if v is None or v != v else float(v) for v in row]
        return ComponentModel(self.value("name"), dict(zip(terms, found)))


class ComponentModel(Model, Spec):
    """Adds the component's utility as a column of its name; a missing attribute makes it 0."""

    def __init__(self, name: str = "", coefficients: dict[str, float] | None = None):
        super().__init__()
        self._keep(name=name, coefficients=coefficients or {})

    @property
    def name(self) -> str:
        return self.value("name")

    @property
    def coefficients(self) -> dict[str, float]:
        return self.value("coefficients")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        body = add([F.lit(float(b)) * utility.product(t) for t, b in self.coefficients.items()] or [F.lit(0.0)])
        return dataset.withColumn(self.name, F.coalesce(body, F.lit(0.0)))


class UtilityAggregator(Transformer, Spec):
    """Weighted sum (or product of 1 + part, less 1) of component columns as ``total_utility``."""

    def __init__(self, weights: dict[str, float] | None = None, how: str = "additive", total: str = "total_utility"):
        super().__init__()
        self._keep(weights=weights or {}, how=how, total=total)

    def with_component(self, name: str, weight: float = 1.0) -> UtilityAggregator:
        """The same with one more component, or another weight of one."""
        return UtilityAggregator(self.value("weights") | {name: float(weight)}, self.value("how"), self.value("total"))

    def without_component(self, name: str) -> UtilityAggregator:
        weights = self.value("weights")
        if name not in weights:
            raise ValueError(f"no component {name}; known: {sorted(weights)}")
        return UtilityAggregator({n: w for n, w in weights.items() if n != name}, self.value("how"), self.value("total"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights = self.value("weights")
        value = utility.total_utility(list(weights), weights, self.value("how")) if weights else F.lit(0.0)
        return dataset.withColumn(self.value("total"), value)
