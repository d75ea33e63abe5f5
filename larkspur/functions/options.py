"""Options of a run: what to render, prompts, figures, thresholds, and the parts a user plugs in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The layers that figures are drawn from.
LAYERS = ("masks", "boxes", "tracks", "labels", "faces", "limbs", "joints", "blur")


def targets(listed: DataFrame, confirmed: DataFrame, key: str, gid: str = "gid") -> DataFrame:
    """(key, gid): the explicit list of those keys that have one, as it stands, else the confirmed identities."""
    has = listed.select(key).distinct()
    return listed.select(key, gid).distinct().unionByName(confirmed.select(key, gid).distinct().join(has, key, "left_anti"))


def prompt(parts: list[Column], otherwise: str, between: str = ", ") -> Column:
    """The parts that say something, joined; ``otherwise`` if none does."""
    said = F.filter(F.transform(F.array(*parts), lambda p: F.trim(p)), lambda p: p.isNotNull() & (p != ""))
    return F.when(F.size(said) > 0, F.array_join(said, between)).otherwise(F.lit(otherwise))


def layers(spec: Column) -> Column:
    """The layers of a spec like ``"masks, boxes"``, in order; empty ones are left out."""
    return F.filter(F.transform(F.split(spec, ","), lambda x: F.trim(x)), lambda x: x != "")


def figure_key(names: Column) -> Column:
    return F.array_join(names, "_")


def unknown_layers(names: Column, known: tuple[str, ...] = LAYERS) -> Column:
    return F.array_except(names, F.array(*[F.lit(k) for k in known]))


def checked_layers(names: Column, known: tuple[str, ...] = LAYERS) -> Column:
    """The layers, or an error that names those nobody draws."""
    bad = unknown_layers(names, known)
    return F.when(F.size(bad) > 0, F.raise_error(F.concat(F.lit("unknown layers: "), F.array_join(bad, ", ")))).otherwise(names)


def thresholds(settings: Column, names: list[str]) -> Column:
    """struct of the named settings; null, the gate is off, unless all are there."""
    values = [F.try_element_at(settings, F.lit(n)) for n in names]
    every = values[0].isNotNull()
    for v in values[1:]:
        every = every & v.isNotNull()
    return F.when(every, F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)]))


class Registry:
    """Named makers of parts that bring a model of their own: posers, and what seeds a gallery (face, body, caption)."""

    def __init__(self) -> None:
        self._makers: dict[str, Callable] = {}

    def add(self, kind: str, maker: Callable) -> None:
        self._makers[kind] = maker

    def build(self, kind: str, **settings):
        if kind not in self._makers:
            raise ValueError(f"unknown kind {kind!r}; known: {', '.join(sorted(self._makers)) or 'none'}")
        return self._makers[kind](**settings)
