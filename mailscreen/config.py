"""Options of the plans, grouped by the step that reads them."""

from __future__ import annotations

from dataclasses import asdict, dataclass

# The two classes.
HAM, SPAM = 0, 1
LABEL_NAMES = ("ham", "spam")


@dataclass(frozen=True)
class SplitFractions:
    """How the rows are dealt out.  Fixed values: 70 / 15 / 15."""

    train: float = 0.70
    validation: float = 0.15
    test: float = 0.15

    def check(self) -> "SplitFractions":
        parts = (self.train, self.validation, self.test)
        if min(parts) < 0 or abs(sum(parts) - 1.0) > 1e-9:
            raise ValueError(f"{parts} are no shares of a whole")
        return self

    @property
    def validation_share_of_rest(self) -> float:
        """Share of the non-test rows that goes to validation."""
        return self.validation / (self.train + self.validation)


@dataclass(frozen=True)
class TermOptions:
    """Bounds on the vocabularies; None takes every term that qualifies."""

    most_words: int | None = None
    most_characters: int | None = None


@dataclass(frozen=True)
class FitOptions:
    """Penalties, folds and the iteration limit of the linear models.

    A fit ends when its objective is proven to be within `tolerance` (relative) of the least.
    """

    logistic_c: float = 4.0
    margin_c: float = 1.5
    folds: int = 3
    max_iterations: int = 4_000
    tolerance: float = 1e-5


@dataclass(frozen=True)
class HeadOptions:
    """Training of a head over epochs (`plans.head`)."""

    epochs: int = 8
    patience: int = 2  # epochs without a better score that are borne; below 0: all epochs are run
    learning_rate: float = 0.05
    weight_decay: float = 0.01
    warmup: float = 0.1  # share of all steps
    clip: float = 1.0
    batch_rows: int = 32
    block_rows: int = 8_192
    seed: int = 42


@dataclass(frozen=True)
class ScreeningConfig:
    """What a training run needs to know."""

    seed: int = 42
    split: SplitFractions = SplitFractions()
    terms: TermOptions = TermOptions()
    fit: FitOptions = FitOptions()
    head: HeadOptions = HeadOptions()
    signals_per_text: int = 8

    def as_dict(self) -> dict:
        return asdict(self)
