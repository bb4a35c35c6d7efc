"""Compositing and auditing of dense-label image datasets with PySpark."""

from .operators.evaluate import evaluated, injected
from .operators.layers import disagreements, merged, pasted
from .operators.placement import Placement, bank_place, place
from .operators.sampling import draws, loader, repeat_factors, stage
from .operators.resample import jittered
from .plans.pipeline import augment, from_preset, rules, sourced, whole
from .plans.presets import FromBank, FromBatch, Harmonize, Paste, Sampler, Survivors, get, names, register, source, taxonomy

__all__ = ["FromBank", "FromBatch", "Harmonize", "Paste", "Placement", "Sampler", "Survivors", "augment", "bank_place", "disagreements", "draws", "evaluated", "from_preset", "get", "injected", "jittered", "loader", "merged", "names", "pasted", "place", "register", "repeat_factors", "rules", "source", "sourced", "stage", "taxonomy", "whole"]
