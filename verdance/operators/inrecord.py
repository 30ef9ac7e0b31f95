"""Counts inside a record: alleles of groups of samples taken off a record's own array of cells.

A record of a cohort has hundreds of cells.  Here it never becomes a row per
cell: a batch's genotype strings are numbered, each distinct one is read once,
and the counts of a group are sums over the columns of its samples.  No row
leaves its partition, so counting needs no exchange.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.functions import genotypes as G
from verdance.operators.checks import ValidationError
from verdance.shipping import ship

#: The readings of :mod:`verdance.functions.genotypes` that can be counted.
LENIENT, COMPLETE_ONLY, STRICT, DIPLOID = "called_alleles_lenient", "called_alleles_lenient_complete", "called_alleles_strict", "strict_diploid_alleles"
SITE = "chrom string, pos string, ref string, alt string"

_WHOLE = re.compile(r"\s*[+-]?[0-9]+\s*")


def read_genotype(gt: str | None, reading: str) -> list[int] | None:
    """The codes of one genotype string; null where the reading drops the call. Codes are not held against the alternatives here."""
    if gt is None:
        if reading == STRICT:
            raise ValidationError("genotype is missing")
        return None
    tokens = gt.replace("|", "/").split("/")
    called = [t for t in tokens if t != "."]
    codes = [int(t) for t in called if _WHOLE.fullmatch(t)]
    whole = len(codes) == len(called)
    if reading == STRICT:
        if not whole:
            raise ValidationError(f"genotype outside the allele range: {gt}")
        return codes
    if reading == DIPLOID:
        return codes if whole and len(codes) == len(tokens) == 2 else None
    return codes if whole and codes and (reading == LENIENT or len(called) == len(tokens)) else None


def numbered_genotypes(cells: pa.ListArray, formats: list[str], columns: np.ndarray, width: int) -> tuple[list[str | None], np.ndarray]:
    """The distinct genotype strings of some columns of a batch, and a matrix ``[record, column]`` of their numbers; a cell that ends before GT has none."""
    n = len(cells)
    if (pc.list_value_length(cells).to_numpy(zero_copy_only=False) != width).any():
        raise ValidationError(f"records without {width} cells")
    places = []
    for f in formats:
        parts = (f or "").split(":")
        if "GT" not in parts:
            raise ValidationError(f"a record's FORMAT has no GT: {f}")
        places.append(parts.index("GT"))
    picked = cells.flatten().take(pa.array((np.arange(n)[:, None] * width + columns).ravel()))
    if set(formats) == {"GT"}:  # few strings, so only distinct ones are cut
        coded, found = pc.dictionary_encode(picked), {}
        of = np.array([found.setdefault(c if c is None else c.split(":", 1)[0], len(found)) for c in coded.dictionary.to_pylist()] or [0])
        at = coded.indices.fill_null(len(of)).to_numpy(zero_copy_only=False)
        if coded.null_count:
            of = np.append(of, found.setdefault(None, len(found)))
        return list(found), of[at].reshape(n, len(columns))
    if set(places) <= {0}:
        picked = pc.list_element(pc.split_pattern(picked, ":", max_splits=1), 0) if len(picked) else picked
        coded = pc.dictionary_encode(picked)
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).reshape(n, len(columns))
    coded, found = pc.dictionary_encode(picked), {}
    at = coded.indices.to_numpy(zero_copy_only=False).reshape(n, len(columns))
    split = [c.split(":") for c in coded.dictionary.to_pylist()]
    which, of = np.zeros(at.shape, np.int64), np.zeros(len(split), np.int64)
    for place in set(places):
        rows = np.array(places) == place
        for i in np.unique(at[rows]).tolist():
            gt = split[i][place] if place < len(split[i]) else None
            of[i] = found.setdefault(gt, len(found))
        which[rows] = of[at[rows]]
    return list(found), which


def copies(genotypes: list[str | None], which: np.ndarray, n_alts: np.ndarray, reading: str) -> np.ndarray:
    """Copies of each code in each distinct genotype, ``[genotype, code]``, after a check that no record has a code beyond its alternatives."""
    read = [read_genotype(g, reading) or [] for g in genotypes]
    most = max([0, *n_alts.tolist()])
    highest = np.array([max(c, default=0) for c in read] or [0])
    lowest = np.array([min(c, default=0) for c in read] or [0])
    if which.size:
        bad = (highest[which] > n_alts[:, None]) | (lowest[which] < 0)
        if bad.any():
            r, s = np.argwhere(bad)[0]
            raise ValidationError(f"genotype outside the allele range: {genotypes[which[r, s]]}")
    out = np.zeros((max(1, len(read)), most + 1), np.int64)
    for i, c in enumerate(read):
        for code in c:
            if code <= most:
                out[i, code] += 1
    return out


def places_of(names: Sequence[str], samples: Sequence[str]) -> np.ndarray:
    """Columns of samples; one that is absent is an error."""
    place = {s: i for i, s in enumerate(names)}
    absent = [s for s in samples if s not in place]
    if absent:
        raise ValidationError(f"samples absent from the VCF: {absent[:10]}")
    return np.array([place[s] for s in samples], np.int64)


def group_counts(records: DataFrame, names: Sequence[str], groups: Mapping[str, Sequence[str]], reading: str, carried: Sequence[str] = ()) -> DataFrame:
    """``(chrom, pos, ref, alt, <group>_AN, <group>_AC)`` of each record ``(chrom, pos, ref, alt, format, cells)``.

    ``<group>_AC`` has the copies of the reference and of each alternative;
    groups may share samples and may be empty.  Each record gives one row, in
    the partition that it is in.  ``carried`` names further columns of the
    records that stay with them, such as ``format`` and ``cells`` for whoever
    reads the cells of the sites that the counts choose.
    """
    ship(records.sparkSession)
    wanted = list(dict.fromkeys(s for samples in groups.values() for s in samples))
    columns = places_of(names, wanted)
    at = {s: i for i, s in enumerate(wanted)}
    members = {g: np.array([at[s] for s in samples], np.int64) for g, samples in groups.items()}
    width = len(names)
    ddl = SITE + "".join(f", `{g}_AN` long, `{g}_AC` array<long>" for g in groups) + "".join(f", `{c}` {records.schema[c].dataType.simpleString()}" for c in carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n_alts = pc.add(pc.count_substring(b.column(3), ","), 1).to_numpy(zero_copy_only=False).astype(np.int64)
            genotypes, which = numbered_genotypes(b.column(5), b.column(4).to_pylist(), columns, width)
            held = copies(genotypes, which, n_alts, reading)
            out, kinds = list(b.columns[:4]), len(held)
            ends = np.concatenate([[0], np.cumsum(n_alts + 1)])
            keep = np.arange(held.shape[1]) <= n_alts[:, None]
            for own in members.values():
                seen = np.bincount((np.arange(len(which))[:, None] * kinds + which[:, own]).ravel(), minlength=len(which) * kinds).reshape(len(which), kinds)
                sums = seen @ held
                out += [pa.array(sums.sum(1)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(sums[keep]))]
            out += [b.column(c) for c in carried]
            yield pa.RecordBatch.from_arrays(out, names=[*b.schema.names[:4], *[f"{g}_{c}" for g in groups for c in ("AN", "AC")], *carried])

    needed = ["chrom", "pos", "ref", "alt", "format", "cells"]
    return records.select(*needed, *[c for c in carried if c not in needed]).mapInArrow(run, ddl)


def carriers_and_called(sites: DataFrame, names: Sequence[str], samples: Sequence[str]) -> DataFrame:
    """The columns of ``sites`` without ``format``, ``cells`` and ``code``, with ``carriers`` and ``called``: sorted samples by complete diploid calls.

    ``code`` is the target allele's code at a biallelic site.  A site without
    a record (null cells) has neither.
    """
    ship(sites.sparkSession)
    columns, width = places_of(names, samples), len(names)
    order = np.argsort(np.array(samples, object)) if len(samples) else np.zeros(0, np.int64)
    columns, named = columns[order], np.array(samples, object)[order]
    rest = [f for f in sites.schema if f.name not in ("format", "cells", "code")]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", carriers array<string>, called array<string>"

    texts = pa.array(named, pa.string())

    def lists(mask: np.ndarray) -> pa.ListArray:
        ends = np.concatenate([[0], np.cumsum(mask.sum(1))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), texts.take(pa.array(np.nonzero(mask)[1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            carries = np.zeros((b.num_rows, len(columns)), bool)
            called = carries.copy()
            there = np.flatnonzero(pc.is_valid(b.column(1)).to_numpy(zero_copy_only=False))
            if len(there):
                part = b.take(pa.array(there))
                genotypes, which = numbered_genotypes(part.column(1), part.column(0).to_pylist(), columns, width)
                held = copies(genotypes, which, np.ones(len(there), np.int64), DIPLOID)
                code = part.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                called[there] = held.sum(1)[which] > 0
                carries[there] = held[which, code[:, None]] > 0
            yield pa.RecordBatch.from_arrays([*b.columns[3:], lists(carries), lists(called)], names=[*b.schema.names[3:], "carriers", "called"])

    return sites.select("format", "cells", "code", *[f.name for f in rest]).mapInArrow(run, ddl)


def target_sites(records: DataFrame, missing: DataFrame) -> DataFrame:
    """Missing targets with their record's format and cells and the target's code, for :func:`carriers_and_called`; null without a record."""
    goal = missing.select(F.col("CHROM").alias("chrom"), F.col("POS").alias("pos"), "Wild_minor_count", "Wild_MAF_bin", G.target_code(F.col("Wild_minor_allele")).alias("code"))
    return goal.join(records.select("chrom", "pos", "format", "cells"), ["chrom", "pos"], "left").withColumnsRenamed({"chrom": "CHROM", "pos": "POS"})
