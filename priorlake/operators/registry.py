"""Named forecast models: what each is fitted on, how it forecasts, and which ones run live."""
from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorlake.operators.assemble import combine_members

FORECAST = ["model", "game_id", "season", "week", "home_score", "away_score", "home_pred", "away_pred"]


@dataclass(frozen=True)
class Model:
    """forecast: feature table to walk-forward forecasts with home_pred and away_pred; table: the name of that table."""

    name: str
    table: str
    forecast: Callable[[DataFrame], DataFrame]
    live: bool = True


@dataclass
class Registry:
    models: dict[str, Model] = field(default_factory=dict)

    def add(self, model: Model) -> Model:
        if model.name in self.models:
            raise ValueError(f"{model.name} is registered already")
        self.models[model.name] = model
        return model

    def get(self, name: str) -> Model:
        if name not in self.models:
            raise KeyError(f"no model {name!r}; there are {', '.join(sorted(self.models))}")
        return self.models[name]

    def live(self, names: Iterable[str]) -> list[Model]:
        """The named models in that order; an unknown, repeated or not live-capable one is an error."""
        chosen = [self.get(n) for n in names]
        if not chosen or len({m.name for m in chosen}) < len(chosen):
            raise ValueError("a live list needs at least one model and no model twice")
        late = [m.name for m in chosen if not m.live]
        if late:
            raise ValueError(f"not live-capable: {', '.join(late)}")
        return chosen

    def forecasts(self, names: Iterable[str], tables: dict[str, DataFrame]) -> DataFrame:
        """One row per model and contest; every model reads the table it names."""
        out: DataFrame | None = None
        for model in map(self.get, names):
            if model.table not in tables:
                raise KeyError(f"{model.name} needs the table {model.table!r}")
            part = model.forecast(tables[model.table]).withColumn("model", F.lit(model.name)).select(*FORECAST)
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise ValueError("no models named")
        return out

    def composite(self, names: list[str], tables: dict[str, DataFrame], name: str = "composite") -> DataFrame:
        """Equal-weight mean of the named models' own forecasts."""
        return combine_members(self.forecasts(names, tables), names, name)
