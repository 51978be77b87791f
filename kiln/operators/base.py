"""The step contract shared by all operators.

A ``Step`` declares the statistics it needs (``request``), and turns them
into a lazy transformation (``apply``).  Steps that do not change the row
set and touch different columns can share one fit pass (``run_steps``).
Steps whose fit is not a plain aggregate (dictionaries, models) override
``fit_apply``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from kiln.functions.stats import Fit


@dataclass
class Step:
    rows_changing = False
    metrics: dict = field(default_factory=dict, init=False, repr=False, compare=False)

    # columns the fit reads and columns the apply writes (for fusion)
    def reads(self) -> set[str]:
        return set()

    def writes(self) -> set[str]:
        return set()

    def request(self, fit: Fit) -> None:
        return None

    def apply(self, df: DataFrame, stats: dict) -> DataFrame:
        raise NotImplementedError

    def fusable(self) -> bool:
        return type(self).fit_apply is Step.fit_apply and not self.rows_changing

    def fit_apply(self, df: DataFrame) -> DataFrame:
        fit = Fit()
        self.request(fit)
        stats = fit.run(df) if not fit.empty() else {}
        return self.apply(df, stats)


def run_steps(df: DataFrame, steps: list[Step]) -> DataFrame:
    """Run steps in order, fusing the fits of consecutive independent steps."""
    i = 0
    while i < len(steps):
        group = [steps[i]]
        if steps[i].fusable():
            written = set(steps[i].writes())
            j = i + 1
            while j < len(steps) and steps[j].fusable() and not (steps[j].reads() & written):
                group.append(steps[j])
                written |= steps[j].writes()
                j += 1
        if len(group) == 1:
            df = group[0].fit_apply(df)
        else:
            fit = Fit()
            for s in group:
                s.request(fit)
            stats = fit.run(df) if not fit.empty() else {}
            for s in group:
                df = s.apply(df, stats)
        i += len(group)
    return df


def check_columns(df: DataFrame, columns) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
