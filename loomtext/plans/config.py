"""Settings, and checks that raise before a plan runs."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Directions with their columns, language codes, target tag and prefix; backends; run keys.
DIRECTIONS = {
    "en-wes": {"source_column": "eng", "target_column": "wes", "source_lang": "eng_Latn", "target_lang": "wes_Latn", "tag": ">>wes<<", "prefix": "translate English to Cameroon Pidgin: "},
    "wes-en": {"source_column": "wes", "target_column": "eng", "source_lang": "wes_Latn", "target_lang": "eng_Latn", "tag": ">>eng<<", "prefix": "translate Cameroon Pidgin to English: "},
}
BACKENDS = ("nllb", "marian", "byt5")
RUN_KEYS = ("run_name", "backend", "base_model", "dataset_id", "output_dir")


@dataclass(frozen=True)
class CleaningConfig:
    """Rules of the cleaner; names and defaults are fixed values."""

    min_words: int = 2
    max_words: int = 180
    min_word_ratio: float = 0.35
    max_word_ratio: float = 3.0
    strip_reference_noise: bool = True
    detokenize: bool = True

    @classmethod
    def of(cls, values: Mapping[str, Any] | CleaningConfig | None) -> CleaningConfig:
        """From a mapping: a value of another kind than the default's raises, keys of no rule are named in a warning."""
        if isinstance(values, cls):
            return values
        given, chosen = dict(values or {}), {}
        for rule, default in cls().as_dict().items():
            value = given.pop(rule, default)
            if isinstance(value, bool) is not isinstance(default, bool) or not isinstance(value, int | float):
                raise TypeError(f"{rule} is {value!r}, not of the kind of {default!r}")
            chosen[rule] = value
        if given:
            warnings.warn(f"no cleaning rules: {sorted(given)}", stacklevel=2)
        return cls(**chosen)

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)


def require_columns(df: DataFrame, needed: Iterable[str], what: str = "table") -> None:
    if missing := sorted(set(needed) - set(df.columns)):
        raise ValueError(f"{what} lacks columns: {missing}")


def require_direction(direction: str) -> dict[str, str]:
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction: {direction}")
    return DIRECTIONS[direction]


def require_backend(backend: str) -> None:
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend: {backend}")


def require_known_directions(df: DataFrame, allowed: Iterable[str] = DIRECTIONS, what: str = "table") -> None:
    """Raises if ``direction`` holds another value than these; nulls pass."""
    allowed = sorted(allowed)
    unknown = [r[0] for r in df.where(F.col("direction").isNotNull() & ~F.col("direction").isin(allowed)).select("direction").distinct().orderBy("direction").limit(20).collect()]
    if unknown:
        raise ValueError(f"{what} has directions that are not supported: {unknown}")


def check_run_config(config: Mapping[str, Any]) -> dict[str, Any]:
    if missing := sorted(set(RUN_KEYS) - set(config)):
        raise ValueError(f"configuration lacks keys: {missing}")
    for direction in config.get("directions") or ():
        require_direction(direction)
    require_backend(config["backend"])
    return dict(config)
