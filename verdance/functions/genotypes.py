"""The four readings of a genotype string.

They differ on purpose: selection wants complete diploid calls, carrier
quality complete calls of any ploidy, state coverage and portfolios every
called allele.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(gt: Column) -> Column:
    return F.split(F.replace(gt, F.lit("|"), F.lit("/")), "/")


def _codes(gt: Column) -> Column:
    """Tokens as integers, null for those that are not."""
    return F.transform(tokens(gt), lambda t: t.try_cast("int"))


def _fail(text: str, gt: Column) -> Column:
    return F.raise_error(F.concat(F.lit(text), gt)).cast("array<int>")


def complete_alleles(gt: Column) -> Column:
    """Allele codes if every token is one, whatever the ploidy; else null."""
    codes = _codes(gt)
    return F.when(gt.isNotNull() & F.forall(codes, lambda c: c.isNotNull()), codes)


def strict_diploid_alleles(gt: Column, n_alt: Column | int = 1) -> Column:
    """Two complete codes, else null; a code beyond the alternatives is an error."""
    codes = complete_alleles(gt)
    n = F.lit(n_alt) if isinstance(n_alt, int) else n_alt
    two = F.size(codes) == 2
    return F.when(two & F.exists(codes, lambda c: (c < 0) | (c > n)), _fail("genotype outside the allele range: ", gt)).when(two, codes)


def called_alleles_lenient(gt: Column, n_alt: Column | int, allow_partial: bool = True) -> Column:
    """The called codes of a possibly partial call; a token that is neither code nor dot drops the call, a code out of range is an error."""
    raw, n = tokens(gt), F.lit(n_alt) if isinstance(n_alt, int) else n_alt
    called = F.filter(raw, lambda t: t != ".")
    codes = F.transform(called, lambda t: t.try_cast("int"))
    usable = gt.isNotNull() & (F.size(codes) > 0) & F.forall(codes, lambda c: c.isNotNull())
    if not allow_partial:
        usable &= F.size(called) == F.size(raw)
    return F.when(usable & F.exists(codes, lambda c: (c < 0) | (c > n)), _fail("genotype index outside the alternatives: ", gt)).when(usable, codes).otherwise(F.array().cast("array<int>"))


def called_alleles_strict(gt: Column, n_alt: Column | int = 1) -> Column:
    """The called codes; anything but codes in range and dots is an error, and so is a missing genotype."""
    n = F.lit(n_alt) if isinstance(n_alt, int) else n_alt
    called = F.filter(tokens(gt), lambda t: t != ".")
    codes = F.transform(called, lambda t: t.try_cast("int"))
    bad = F.exists(codes, lambda c: c.isNull() | (c < 0) | (c > n))
    return F.when(gt.isNull(), F.raise_error(F.lit("genotype is missing")).cast("array<int>")).when(bad, _fail("genotype outside the allele range: ", gt)).otherwise(codes)


def dosage(alleles: Column, code: Column | int) -> Column:
    """Copies of one code; 0 for a null call."""
    c = F.lit(code) if isinstance(code, int) else code
    return F.when(alleles.isNull(), 0).otherwise(F.size(F.filter(alleles, lambda a: a == c)))


def target_code(minor: Column) -> Column:
    return F.when(minor == "ALT", 1).otherwise(0)


def cell_field(cell: Column, fmt: Column, name: str) -> Column:
    """A named field of a sample cell by its place in FORMAT; null if FORMAT or the cell lacks it."""
    at = F.array_position(F.split(fmt, ":"), name)
    return F.when(at > 0, F.get(F.split(cell, ":"), (at - 1).cast("int")))


def numeric_field(value: Column) -> Column:
    """A field as a finite or infinite number; null words and NaN are null."""
    x = F.when(~value.isin("", ".", "NA"), value.try_cast("double"))
    return F.when(~F.isnan(x), x)
