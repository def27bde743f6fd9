"""Column functions on sequences; everything is a built-in expression.

Positions are counted from 0 in results and from 1 inside ``substring``. Units are code points.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
START = "AUG"
STOPS = ("UAA", "UAG", "UGA")


def ascii_upper(text: Column) -> Column:
    """Upper case of a-z only, which keeps the length of any text."""
    return F.translate(text, string.ascii_lowercase, string.ascii_uppercase)


def acgt_only(text: Column) -> Column:
    """Upper-cased, with everything but A, C, G and T removed; null stays null."""
    return F.regexp_replace(ascii_upper(text), "[^ACGT]", "")


def first_invalid(text: Column) -> Column:
    """The first symbol that is no base, null if there is none."""
    return F.nullif(F.regexp_extract(ascii_upper(text), "([^ACGT])", 1), F.lit(""))


def without_spaces(text: Column) -> Column:
    return F.translate(text, " ", "")


def without_whitespace(line: Column) -> Column:
    """Without the four kinds that the statistics scan skips."""
    return F.translate(line, " \t\r\n", "")


def to_rna(dna: Column) -> Column:
    return F.translate(ascii_upper(without_spaces(dna)), "T", "U")


def count_base(sequence: Column, base: str) -> Column:
    return (F.length(sequence) - F.length(F.translate(sequence, base, ""))).cast("long")


def gc_count(sequence: Column) -> Column:
    return (F.length(sequence) - F.length(F.translate(sequence, "GC", ""))).cast("long")


def gc_flag(base: Column) -> Column:
    """1 for G and C, 0 for A and T, null otherwise; either case."""
    upper = ascii_upper(base)
    return F.when(upper.isin("G", "C"), 1).when(upper.isin("A", "T"), 0)


def base_index(base: Column) -> Column:
    """0 to 3 in the order A, C, G, T; null otherwise."""
    return F.when(base.isin(*BASES), F.instr(F.lit(BASES), base) - 1)


def gc_percent(gc: Column, length: Column) -> Column:
    return F.when(length > 0, gc.cast("double") * 100.0 / length)


def tm_wallace(gc: Column, length: Column) -> Column:
    """4 degrees for each G or C and 2 for each A or T, in the linear form."""
    return (length * 2 + gc * 2).cast("long")


def checked_sodium(sodium: float, fallback: float | None = None) -> float:
    """The concentration, which has to be positive; ``fallback`` takes the place of others."""
    if sodium > 0:
        return sodium
    if fallback is None:
        raise ValueError("the sodium concentration must be positive")
    return fallback


def salt_constant(sodium: float) -> float:
    return 81.5 + 16.6 * math.log10(checked_sodium(sodium))


def tm_salt(gc: Column, length: Column, sodium: float = 0.05) -> Column:
    """81.5 + 16.6 log10(Na) + 0.41 GC% - 600 / length; null for an empty sequence."""
    return F.when(length > 0, F.lit(salt_constant(sodium)) + F.lit(41.0) * gc / length - F.lit(600.0) / length)


def relative(part: Column, total: Column) -> Column:
    return F.when(total > 0, part / total).otherwise(F.lit(0.0))


def clamp01(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def frame(rna: Column, number: int) -> Column:
    """The sequence read from frame 1, 2 or 3."""
    if number not in (1, 2, 3):
        raise ValueError("frames are 1, 2 and 3")
    return F.substr(rna, F.lit(number))


def whole_codons(rna: Column) -> Column:
    """Cut to a multiple of three."""
    return F.left(rna, F.length(rna) - F.length(rna) % 3)


def codons(rna: Column) -> Column:
    """The full codons from the start, as an array; empty for fewer than three symbols."""
    # one regular pass; a substring per position would be quadratic
    return F.regexp_extract_all(rna, F.lit("(?s)(...)"), 1)


def protein(codon_array: Column, code: Column) -> Column:
    """One letter per codon by the map ``code``, X for unknown ones."""
    return F.array_join(F.transform(codon_array, lambda c: F.coalesce(F.try_element_at(code, c), F.lit("X"))), "")


def window_count(length: Column, window: int, step: int) -> Column:
    return F.when(length < window, F.lit(0).cast("long")).otherwise(
        F.lit(1).cast("long") + F.floor((length.cast("long") - window) / F.lit(step))
    )


def short_header(line: Column) -> Column:
    """A header line without its sign and outer blanks, cut after 120 symbols."""
    body = F.trim(F.regexp_replace(line, "^>", ""))
    return F.when(F.length(body) > 120, F.concat(F.left(body, F.lit(120)), F.lit("…"))).otherwise(body)


def wrapped(sequence: Column, width: int) -> Column:
    """Lines of ``width`` symbols joined by line ends."""
    return F.rtrim(F.regexp_replace(sequence, f"(?s)(.{{{int(width)}}})", "$1\n"), F.lit("\n"))


def preview(values: Column, shown: int = 64) -> Column:
    """The first values with three decimals, and how many more there are."""
    head = F.array_join(F.transform(F.slice(values, 1, shown), lambda v: F.format_string("%.3f", v.cast("double"))), ", ")
    more = F.size(values) - shown
    return F.when(more > 0, F.concat(head, F.lit(" … (+"), more.cast("string"), F.lit(" more)"))).otherwise(head)


def share_text(value: Column) -> Column:
    """A share with four decimals."""
    return F.format_string("%.4f", value.cast("double"))


def percent_text(value: Column) -> Column:
    """A percentage with two decimals and its sign."""
    return F.format_string("%.2f%%", value.cast("double"))


def megabytes_text(size: Column) -> Column:
    """Bytes as millions with one decimal."""
    return F.format_string("%.1f MB", size.cast("double") / 1e6)
