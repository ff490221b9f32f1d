"""Physico-chemical scores of residue strings, as native expressions."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixmill import constants as K
from helixmill.functions.sequences import residues


def count_of(s: Column, residue: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(residue), F.lit("")))


def _none(s: Column) -> Column:
    return s.isNull() | (s == "")


def charge_score(s: Column, ideal: float = 4.5, sigma: float = 2.0) -> Column:
    q = count_of(s, "K") + count_of(s, "R") - count_of(s, "D") - count_of(s, "E")
    return F.when(_none(s), 0.0).otherwise(F.exp(-F.pow(q - ideal, F.lit(2.0)) / (2 * sigma**2)))


def _scale(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def hydrophobicity(s: Column) -> Column:
    """Each residue's consensus hydrophobicity, 0 for other signs; looked up by the sign's code."""
    by_code = F.array(*[F.lit(K.EISENBERG.get(chr(code), 0.0)) for code in range(128)])
    return F.transform(residues(s), lambda c: F.when(F.ascii(c) < 128, F.get(by_code, F.ascii(c))).otherwise(0.0))


def moment_of(values: Column, angle: float) -> Column:
    """Mean moment of ``hydrophobicity`` at ``angle`` degrees a residue; residues count from 1. 0 for none."""
    delta = math.radians(angle)

    def total(wave):
        return F.aggregate(F.transform(values, lambda v, i: v * wave(F.lit(delta) * (i + 1))), F.lit(0.0), lambda a, x: a + x)

    return F.when(F.size(values) > 0, F.sqrt(F.pow(total(F.cos), F.lit(2.0)) + F.pow(total(F.sin), F.lit(2.0))) / F.size(values)).otherwise(0.0)


def few_cysteines(s: Column) -> Column:
    """Fewer than the two that a hairpin's bridge needs."""
    return count_of(s, "C") < 2


def hmoment(s: Column, angle: float, need_cysteines: bool = False) -> Column:
    """Mean hydrophobic moment of a text; 0 for an empty one, and with ``need_cysteines`` for one with fewer than two."""
    empty = _none(s) | few_cysteines(s) if need_cysteines else _none(s)
    return F.when(empty, 0.0).otherwise(moment_of(hydrophobicity(s), angle))


def scale_mean(s: Column, values: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for residue, v in values.items():
        total = total + count_of(s, residue) * F.lit(v)
    return F.when(_none(s), 0.0).otherwise(total / F.length(s))


def boman(s: Column) -> Column:
    return scale_mean(s, K.BOMAN)


def gravy(s: Column) -> Column:
    return scale_mean(s, K.KYTE_DOOLITTLE)


def charge_at_ph(s: Column, ph: float = 7.0) -> Column:
    """Net charge by Henderson-Hasselbalch over side chains and termini; NULL for an empty text."""

    def positive(pk: Column) -> Column:
        x = F.pow(F.lit(10.0), pk - ph)
        return x / (1 + x)

    def negative(pk: Column) -> Column:
        x = F.pow(F.lit(10.0), F.lit(ph) - pk)
        return x / (1 + x)

    def terminus(residue: Column, default: float, by_residue: dict[str, float]) -> Column:
        return F.coalesce(F.try_element_at(_scale(by_residue), residue), F.lit(default))

    total = positive(terminus(F.substring(s, 1, 1), K.PK_N_TERM, K.PK_N_TERM_BY_RESIDUE))
    total = total - negative(terminus(F.substring(s, -1, 1), K.PK_C_TERM, K.PK_C_TERM_BY_RESIDUE))
    for residue, pk in K.PK_BASE.items():
        total = total + count_of(s, residue) * positive(F.lit(pk))
    for residue, pk in K.PK_ACID.items():
        total = total - count_of(s, residue) * negative(F.lit(pk))
    return F.when(~_none(s), total)


def diversity(s: Column) -> Column:
    """Distinct residues less a tenth of the number of K, R and L."""
    return F.size(F.array_distinct(residues(s))) - 0.1 * (count_of(s, "K") + count_of(s, "R") + count_of(s, "L"))
