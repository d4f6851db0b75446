"""Sequence expressions.  All of them take and return Columns of upper-case text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenlab.schema import BASES


def reverse_complement(s: Column) -> Column:
    """Other strand, read backwards; case and N are kept."""
    return F.reverse(F.translate(s, "ACGTacgtNn", "TGCAtgcaNn"))


def base_count(s: Column, bases: str) -> Column:
    """How many characters of ``s`` are among ``bases``."""
    return F.length(s) - F.length(F.translate(s, bases, ""))


def valid_count(s: Column) -> Column:
    return base_count(s, "ACGT")


def gc_fraction(s: Column) -> Column:
    """GC share of the A, C, G, T bases."""
    return base_count(s, "GC") / F.greatest(valid_count(s), F.lit(1))


def gc_of_length(s: Column) -> Column:
    """GC share of the whole length."""
    return F.coalesce(F.try_divide(base_count(s, "GC"), F.length(s)), F.lit(0.0))


def ambiguous_fraction(s: Column) -> Column:
    return F.lit(1.0) - valid_count(s) / F.greatest(F.length(s), F.lit(1))


def base_entropy(s: Column) -> Column:
    """Shannon entropy of the four bases, in bits."""
    total = F.greatest(valid_count(s), F.lit(1))
    out = F.lit(0.0)
    for b in BASES:
        share = base_count(s, b) / total
        out = out + F.when(share > 0, -share * F.log2(share)).otherwise(F.lit(0.0))
    return out


def windows(s: Column, k: int) -> Column:
    """Every length-k window in order, whatever its letters; [] when s is shorter."""
    at = F.sequence(F.lit(1), F.length(s) - (k - 1))
    return F.when(
        F.length(s) >= k, F.transform(at, lambda i: F.substring(s, i, F.lit(k)))
    ).otherwise(F.array().cast("array<string>"))


def kmers(s: Column, k: int) -> Column:
    """Every length-k window made of A, C, G, T only, overlapping ones included."""
    return F.regexp_extract_all(s, F.lit(f"(?=([ACGT]{{{k}}}))"), F.lit(1))


def longest_homopolymer(s: Column) -> Column:
    """Length of the longest run of one letter; 0 for empty text."""
    runs = F.regexp_extract_all(s, F.lit(r"((.)\2*)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def self_complement_run(s: Column) -> Column:
    """Longest stretch shared with the own reverse complement, at any alignment.

    A run along one alignment is a common substring.  Lengths are tried from 1
    and each needs a hit of the one before, so this is for guide-sized text.
    """
    other = F.reverse(F.translate(s, "ACGT", "TGCA"))

    def shared(size: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(s) - size + 1)
        return F.exists(starts, lambda i: F.contains(other, F.substring(s, i, size)))

    sizes = F.sequence(F.lit(1), F.length(s))
    longest = F.aggregate(
        sizes,
        F.lit(0),
        lambda best, size: F.when((best == size - 1) & shared(size), size).otherwise(best),
    )
    return F.when(F.length(s) > 0, longest).otherwise(F.lit(0))


def self_complement_share(s: Column, w: int = 4) -> Column:
    """Share of the length-w windows whose reverse complement is a window too."""
    parts = windows(s, w)
    hits = F.filter(
        parts, lambda x: F.array_contains(parts, F.reverse(F.translate(x, "ACGT", "TGCA")))
    )
    return F.coalesce(F.try_divide(F.size(hits), F.size(parts)), F.lit(0.0))


def complexity3(s: Column) -> Column:
    """Distinct 3-letter windows over the number of windows."""
    return F.size(F.array_distinct(windows(s, 3))) / F.greatest(F.length(s) - 2, F.lit(1))


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of ``part``."""
    removed = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.when(F.length(part) > 0, F.floor(removed / F.length(part))).otherwise(F.lit(0))


def first_position(text: Column, part: Column) -> Column:
    """0-based position of the first occurrence, -1 when absent."""
    return F.position(part, text) - 1


def relative_position(at: Column, text_length: Column, part_length: Column) -> Column:
    return F.when(at >= 0, at / F.greatest(text_length - part_length, F.lit(1))).otherwise(
        F.lit(0.0)
    )


def context(text: Column, at: Column, size: Column, flank: int = 50) -> Column:
    """``flank`` letters to both sides of [at, at + size), cut at the ends."""
    start = F.greatest(at - flank, F.lit(0))
    return F.substring(text, (start + 1).cast("int"), (at + size + flank - start).cast("int"))


def accession(s: Column) -> Column:
    """Accession without its version."""
    return F.substring_index(s, ".", 1)


def first_window(s: Column, size: int = 1000) -> Column:
    return F.substring(s, 1, size)


def last_window(s: Column, size: int = 1000) -> Column:
    return F.when(F.length(s) <= size, s).otherwise(F.right(s, F.lit(size)))
