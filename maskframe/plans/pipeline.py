"""The whole augmentation as one plan: place, warp, composite, revert, drop, merge."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import bits, rng
from ..operators import composite, evaluate, harmonize, layers, placement, warp
from .presets import Paste


@dataclass
class Outcome:
    instances: DataFrame  # sample_id, slot, label, instance_id, y, k, bits
    paste: DataFrame  # sample_id, y, k, paste
    semantic: DataFrame | None
    slots: DataFrame


def augment(samp: DataFrame, inst: DataFrame, rows: DataFrame, config: Paste, h: int, w: int, semantic: DataFrame | None = None, stuff: Column | None = None) -> Outcome:
    """Pastes instances of other samples of the batch onto every sample.

    With ``tau_stuff_frac`` and a semantic layer, pixels of background classes that would collapse are given back: the class
    layer, the target's masks and the pastes there. Reverting precedes the drop, and the drop frees slots for the merge.
    """
    placed, slots = placement.place(samp, inst, config.placement, eligible(config))
    warped = warp.masks(slots, rows, h, w)
    paste = composite.union(warped)
    after = None
    if semantic is not None:
        after = composite.select_labels(semantic, warp.label_bits(placed, semantic, h, w), paste)
        if config.tau_stuff_frac is not None and stuff is not None:
            gone = composite.collapsed(composite.histogram(semantic), composite.histogram(after), stuff, config.tau_stuff_frac)
            revert = composite.revert_rows(semantic, gone, paste)
            back = lambda df, c: df.join(revert, bits.LINE, "left").withColumn(c, bits.without(F.col(c), F.coalesce("revert", F.lit(0).cast("long")))).drop("revert").where(f"{c} <> 0")
            restored = bits.keyed(semantic).join(revert, bits.LINE).select(*bits.LINE, "class_id", F.col("bits").bitwiseAND(F.col("revert")).alias("bits"))
            after = back(after, "bits").unionByName(restored.where("bits <> 0")).groupBy(*bits.LINE, "class_id").agg(F.bit_or("bits").alias("bits"))
            warped, paste = back(warped, "bits"), back(paste, "paste")
    done = composite.drop_and_merge(rows.withColumn("instance_id", F.col("slot")), warped, config.min_residual_area_frac, config.slots)
    return Outcome(done, paste, after, slots)


def eligible(config: Paste) -> Column | None:
    """Whether an instance may be a source, by its ``label``."""
    return F.col("label").isin(*config.things) if config.things is not None else None


def whole(samples: DataFrame, placed: DataFrame, slots: DataFrame, config: Paste, sources: DataFrame | None = None, stuff: frozenset[int] = frozenset(), **options) -> DataFrame:
    """Every layer of every sample after the whole augmentation (:data:`layers.OUT`), instances dropped and merged.

    ``samples`` has the layers and instances of :data:`layers.ROWS`; ``placed`` and ``slots`` come from
    :func:`placement.place`, or :func:`placement.bank_place` with ``sources``, rows of the same form that only serve as sources.
    Placements and the slots to paste are small; each image is shuffled once, to its batch, or not at all: with ``load`` among the
    ``options`` of :func:`layers.pasted`, rows without layers get them there.
    """
    chosen = slots.where("paste_valid").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.col("slot").cast("long"))).alias("pasted"))
    gate = harmonize.gate(config.harmonize.prob, "sample_id", seed=config.placement.seed)
    where = placed.join(chosen, "sample_id", "left").select("sample_id", "src_id", "scale", "hflip", "ty", "tx", F.col("wv").cast("int").alias("wv"), "pasted", gate.alias("harmonized"))
    rows = samples.join(where, "sample_id", "left").withColumn("target", F.lit(True))
    if sources is not None:
        rows = rows.unionByName(sources.withColumn("target", F.lit(False)), allowMissingColumns=True)
    done = layers.pasted(rows, stuff or frozenset(config.stuff or ()), config.tau_stuff_frac, config.harmonize.mode, levels=config.harmonize.levels, **options)
    return layers.merged(done, config.slots, config.min_residual_area_frac)


def from_preset(samples: DataFrame, inst: DataFrame, whole_samples: DataFrame, config: Paste, load: Callable[[dict], dict] | None = None, pad_to: int | None = None, **options) -> DataFrame:
    """Everything a configuration decides, from samples to merged outcomes: who may be a source, placing, padding, blending, what is
    given back, dropped and merged. ``samples`` and ``inst`` are as for :func:`placement.place`, ``whole_samples`` as for :func:`whole`.

    With ``pad_to`` canvases are brought to its multiples first; valid extents stay those of the pictures.
    """
    if pad_to is not None:
        grid = lambda df: df.withColumn("h", (F.ceil(F.col("h") / pad_to) * pad_to).cast("int")).withColumn("w", (F.ceil(F.col("w") / pad_to) * pad_to).cast("int"))
        samples, inner = grid(samples), load
        if inner is None:
            whole_samples = layers.padded(whole_samples, pad_to)
        else:
            load = lambda r: layers.grown(inner(r), pad_to, 255)
    placed, slots = placement.place(samples, inst, config.placement, eligible(config))
    return whole(whole_samples, placed, slots, config, load=load, **options)


def rules(config: Paste) -> evaluate.Rules:
    """What outcomes of a configuration are checked by."""
    return evaluate.Rules(config.min_residual_area_frac, config.tau_stuff_frac, frozenset(config.things) if config.things is not None else None, frozenset(config.stuff or ()))


def sourced(samples: DataFrame, inst: DataFrame, config: Paste, crops: DataFrame | None = None, n_bank: int = 0, crop: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(placements, slots, bank sources) by the configured source: from the batch, a bank, or each target from either by a draw.

    Both kinds of placements have one form and are composed in one exchange. A bank's ``crops`` have ``idx`` from 0 to
    ``n_bank - 1``, ``class_id``, ``image`` and ``alpha`` of the size ``crop``; what is eligible doesn't bind them.
    """
    own = placement.place(samples, inst, config.placement, eligible(config))
    if config.source.kind == "intra_batch":
        return *own, None
    if crops is None or not n_bank or crop is None:
        raise ValueError("a bank source needs a bank")
    from_bank = rng.uniform(f"source{config.placement.seed}", "sample_id") < config.source.share
    at = placement.bank_place(samples.where(from_bank), crops.select("idx", "class_id"), n_bank, crop, config.source.placement or config.placement)
    at = at.withColumn("src_id", crop_id(F.col("idx"))).withColumn("wv", F.lit(crop[1]))
    common = ["sample_id", "src_id", "scale", "hflip", "ty", "tx", "wv"]
    placed = own[0].where(~from_bank).select(*common).unionByName(at.select(*common))
    slots = own[1].where(~from_bank).select("sample_id", F.col("slot").cast("long").alias("slot"), "paste_valid").unionByName(at.select("sample_id", F.lit(0).cast("long").alias("slot"), "paste_valid"))
    return placed, slots, bank_sources(at, crops, *crop)


def bank_sources(targets: DataFrame, crops: DataFrame, h: int, w: int) -> DataFrame:
    """The crops that targets were given (``idx``), as sources of their batches: one instance, the crop's alpha, slot 0.

    Crops have planes of bytes (``image``, ``alpha``) of ``h`` by ``w``; their ids are negative, so that they are no sample's.
    """
    pick = targets.select("batch_id", "idx").distinct().join(crops, "idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask = pa.array([layers.packed(np.frombuffer(a, np.uint8) > 0) for a in b.column("alpha").to_pylist()], pa.binary())
            yield b.set_column(b.schema.get_field_index("alpha"), "alpha", mask)

    pick = pick.select("batch_id", "idx", "class_id", "image", "alpha").mapInArrow(run, "batch_id long, idx long, class_id long, image binary, alpha binary")
    one = F.array(F.struct(F.lit(0).cast("long").alias("slot"), F.col("class_id").alias("label"), F.lit(0).cast("long").alias("instance_id"), F.col("alpha").alias("mask")))
    return pick.select("batch_id", crop_id(F.col("idx")).alias("sample_id"), F.lit(h).alias("h"), F.lit(w).alias("w"), "image", one.alias("instances"))


def crop_id(idx: Column) -> Column:
    return -1 - idx
