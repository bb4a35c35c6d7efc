"""Named configurations."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..operators.placement import Placement

#: The published ids of the panoptic taxonomy. Things are 1 to 90 but for those never given out; background follows.
THINGS = tuple(i for i in range(1, 91) if i not in (12, 26, 29, 30, 45, 66, 68, 69, 71, 83))
STUFF = (
    92, 93, 95, 100, 107, 109, 112, 118, 119, 122, 125, 128, 130, 133, 138, 141, 144, 145, 147, 148, 149, 151, 154, 155, 156, 159, 161,
    166, 168, 171, 175, 176, 177, 178, 180, 181, 184, 185, 186, 187, 188, 189, 190, 191, 192, 193, 194, 195, 196, 197, 198, 199, 200,
)


@dataclass(frozen=True)
class Harmonize:
    mode: str = "multiband"
    prob: float = 0.0
    levels: int = 5

    def __post_init__(self) -> None:
        if self.mode not in ("reinhard", "multiband", "poisson"):
            raise ValueError(f"unknown mode {self.mode!r}")


@dataclass(frozen=True)
class FromBatch:
    """Sources are the other samples of a target's batch."""

    kind: str = "intra_batch"


@dataclass(frozen=True)
class FromBank:
    """Sources are crops of a bank, which has its own placement if one is named; a ``share`` below one leaves the rest to the batch."""

    kind: str = "bank"
    placement: Placement | None = None
    share: float = 1.0

    def __post_init__(self) -> None:
        if not 0 <= self.share <= 1:
            raise ValueError("a share lies in [0, 1]")


def source(config: dict) -> FromBatch | FromBank:
    """A source by its ``kind``; unknown kinds and fields are errors."""
    kinds = {"intra_batch": FromBatch, "bank": FromBank}
    kind = config.get("kind", "intra_batch")
    if kind not in kinds:
        raise ValueError(f"unknown source {kind!r}")
    try:
        return kinds[kind](**config)
    except TypeError as e:
        raise ValueError(str(e)) from None


@dataclass(frozen=True)
class Paste:
    """A whole augmentation: placing, harmonising, what is dropped and what is reverted."""

    placement: Placement = field(default_factory=Placement)
    harmonize: Harmonize = field(default_factory=Harmonize)
    min_residual_area_frac: float = 0.0
    tau_stuff_frac: float | None = None
    #: Classes whose instances are pasted (all, if none are named), and those of the background, which ``tau_stuff_frac`` protects.
    things: tuple[int, ...] | None = None
    stuff: tuple[int, ...] | None = None
    source: FromBatch | FromBank = field(default_factory=FromBatch)
    slots: int = 32


@dataclass(frozen=True)
class Sampler:
    """How crops are drawn from a bank: class weights by ``t``, and what a step draws."""

    base_seed: int = 0xC0FFEE
    t: float = 1e-3
    samples_per_step: int = 1
    steps: int = 1
    epoch: int = 0
    rank: int = 0

    def __post_init__(self) -> None:
        if self.t <= 0 or self.samples_per_step < 1 or self.steps < 1:
            raise ValueError("the threshold and the numbers of draws must be positive")


@dataclass(frozen=True)
class Survivors:
    """What the per-sample kernel keeps: a least area, and the share of it that may be lost."""

    min_area: int = 50
    max_gone: float = 0.99


def taxonomy(spark):
    """(class_id, kind) of the panoptic preset: things first, then background."""
    return spark.createDataFrame([(i, "thing") for i in THINGS] + [(i, "stuff") for i in STUFF], "class_id long, kind string")


@dataclass(frozen=True)
class SignOff:
    """What a local run of a preset's checks found: engine version, seed, samples, day, checks that ran and that passed everywhere."""

    version: str
    sample_count: int
    iso_date: str
    dispatched: int
    passed: int
    seed: int = 0xC0FFEE

    def __post_init__(self) -> None:
        if not 0 <= self.passed <= self.dispatched:
            raise ValueError("no more checks can pass than ran")


@dataclass(frozen=True)
class Preset:
    """A named configuration, the layers it expects, and who vouches for it."""

    name: str
    description: str
    paste: Paste
    layers: tuple[str, ...]
    sign_off: SignOff | None = None


def signed(preset: Preset, reports, version: str, iso_date: str, seed: int = 0xC0FFEE) -> Preset:
    """The preset with the sign-off that its reports (:data:`evaluate.REPORTS`) give; one row a check reaches the driver."""
    from dataclasses import replace

    from pyspark.sql import functions as F

    per = reports.groupBy("name").agg(F.bool_and("ok").alias("ok")).collect()
    samples = reports.agg(F.count_distinct("sample_id")).first()[0]
    return replace(preset, sign_off=SignOff(version, samples, iso_date, len(per), sum(r["ok"] for r in per), seed))


_PRESETS: dict[str, Preset] = {}


def register(name: str, config: Paste, description: str = "", layers: tuple[str, ...] = ("image", "instance")) -> None:
    if name in _PRESETS:
        raise ValueError(f"preset {name!r} is there already")
    _PRESETS[name] = Preset(name, description, config, layers)


def get(name: str) -> Paste:
    return _PRESETS[name].paste


def described(name: str) -> Preset:
    return _PRESETS[name]


def names() -> list[str]:
    return sorted(_PRESETS)


register("coco-instance", Paste(Placement((0.5, 2.0), 0.5, 1.0, (1, 32)), min_residual_area_frac=0.1), "instances of other samples of the batch; a target goes when less than a tenth of it is left")
register("coco-panoptic", Paste(Placement((0.5, 2.0), 0.5, 0.5, (1, 20)), min_residual_area_frac=0.1, tau_stuff_frac=0.1, things=THINGS, stuff=STUFF), "things alone are pasted; background of which less than a tenth would be left is given back", ("image", "instance", "semantic", "panoptic"))
