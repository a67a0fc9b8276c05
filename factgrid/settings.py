"""Settings from a mapping such as the environment, checked before anything runs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from factgrid.operators.retrieval import TOP_K


@dataclass(frozen=True)
class Names:
    """What settings go by. Of several names the first that is set counts, even if it is blank. A model's name has to begin with model_family and go on."""

    key: tuple[str, ...] = ("API_KEY",)
    model: tuple[str, ...] = ("MODEL",)
    model_family: str = ""
    model_default: str = ""
    top_k: str = "TOP_K"
    full_document: str = "FULL_DOCUMENT"
    batch_size: str = "EMBEDDING_BATCH_SIZE"


@dataclass(frozen=True)
class Settings:
    key: str
    model: str
    top_k: int
    full_document: bool
    batch_size: int


def first_set(env: Mapping[str, str], names: tuple[str, ...], default: str = "") -> str:
    return next((env[n] for n in names if n in env), default)


def positive(env: Mapping[str, str], name: str, default: int) -> int:
    value = int(env.get(name, default))
    if value < 1:
        raise ValueError(f"{name} must be positive")
    return value


def model_of(env: Mapping[str, str], names: Names = Names()) -> str:
    model = first_set(env, names.model, names.model_default)
    if not model.startswith(names.model_family) or not model.removeprefix(names.model_family).strip():
        raise ValueError(f"{' or '.join(names.model)} must name a model" + (f" of {names.model_family}.." if names.model_family else ""))
    return model


def settings(env: Mapping[str, str], names: Names = Names()) -> Settings:
    """The settings, or the first error: a blank key, a model of another family, a number that isn't positive."""
    key = first_set(env, names.key).strip()
    if not key:
        raise ValueError(f"set {names.key[0]}")
    return Settings(key, model_of(env, names), positive(env, names.top_k, TOP_K), env.get(names.full_document) == "1", positive(env, names.batch_size, 4))
