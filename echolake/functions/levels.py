"""Scalar level, colour-scale and note arithmetic as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column | str) -> Column:
    """Six decimals, with minus zero turned into zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def amplitude_db(value: Column, floor: float = -120.0, tiny: float = 1e-20) -> Column:
    return F.when(F.abs(value) < tiny, F.lit(floor)).otherwise(20 * F.log10(F.abs(value)))


def energy_db(value: Column, floor: float = -120.0, tiny: float = 1e-20) -> Column:
    return F.when(value < tiny, F.lit(floor)).otherwise(10 * F.log10(value))


def gain_factor(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def grey_level(mag: Column, reference: Column, floor_db: float = -80.0, range_db: float = 80.0, gamma: float = 1.0,
               gain_db: float = 0.0) -> Column:
    """0-255 intensity of a magnitude: dB against a reference, clamped to a range, gamma-shaped."""
    db = F.when((mag <= 0) | (reference <= 0), F.lit(-math.inf)).otherwise(20 * F.log10(mag / reference)) + gain_db
    unit = F.least(F.greatest((db - floor_db) / range_db, F.lit(0.0)), F.lit(1.0))
    shaped = unit if gamma == 1.0 else F.pow(unit, F.lit(gamma))
    return F.floor(shaped * 255).cast("long")


def midi_note(freq: Column) -> Column:
    return F.lit(69.0) + 12 * F.log2(freq / 440.0)


def midi_freq(note: Column) -> Column:
    return 440.0 * F.pow(F.lit(2.0), (note - 69.0) / 12)


# Pitch-class names.
PITCH_CLASSES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


def pitch_class(note: Column) -> Column:
    return F.pmod(F.round(note), F.lit(12)).cast("int")


def pitch_name(pc: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in PITCH_CLASSES]), pc + 1)


def octave(note: Column) -> Column:
    return (F.floor(F.round(note) / 12) - 1).cast("long")


def wrap_phase(angle: Column) -> Column:
    """Angle in (-pi, pi]."""
    return angle - 2 * math.pi * F.ceil((angle - math.pi) / (2 * math.pi))


def binary_entropy(p: Column) -> Column:
    q = 1 - p
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-p * F.log2(p) - q * F.log2(q))


def butterworth_pole(cutoff: Column, sample_rate: Column) -> Column:
    """First-order high-pass pole for a cutoff, by the bilinear transform."""
    k = F.tan(math.pi * cutoff / sample_rate)
    return (1 - k) / (1 + k)


def butterworth_gain(pole: Column) -> Column:
    return (1 + pole) / 2


def butterworth_cutoff(pole: Column, sample_rate: Column) -> Column:
    return sample_rate / math.pi * F.atan((1 - pole) / (1 + pole))


def parametric_eq(freq: Column, center: float, gain_db: float, q: float) -> Column:
    """Linear gain of a bell around a centre frequency."""
    ratio = freq / center
    x = (ratio - 1 / ratio) * q
    return F.when(freq <= 0, F.lit(1.0)).otherwise(1 + (10 ** (gain_db / 20) - 1) / (1 + x * x))


def harmonics_band(low_hz: Column, high_hz: Column, bands: int = 4) -> Column:
    """struct(lo, hi) of the harmonics band above a range; null unless the equaliser has four bands and the range is proper."""
    lo, hi = F.greatest(2 * low_hz, high_hz), 2 * high_hz
    usable = F.lit(bands == 4) & (high_hz > 0) & (low_hz < high_hz) & (lo < hi)
    return F.when(usable, F.struct(lo.alias("lo"), hi.alias("hi")))
