"""Scalar expressions on names and bases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base codes: A, C, G, T, gap, anything else.
CODES = "ACGT-"
#: Terminal colours of the bases.
COLOURS = {"A": 31, "C": 32, "G": 34, "T": 33}


def default_genome(name: Column) -> Column:
    """The name before its first dot, unless the dot comes first."""
    return F.when(F.instr(name, ".") > 1, F.substring_index(name, ".", 1)).otherwise(name)


def genome_in(name: Column, genomes: list[str]) -> Column:
    """The shortest dotted prefix of ``name`` that is one of ``genomes``; null if none is."""
    known = F.array(*[F.lit(g) for g in genomes]) if genomes else F.array().cast("array<string>")
    parts = F.split(name, "\\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    return F.when(F.instr(name, ".") > 0, F.get(F.filter(prefixes, lambda p: F.array_contains(known, p)), 0))


def reverse_complement(bases: Column) -> Column:
    return F.reverse(F.translate(bases, "ACGTacgt", "TGCAtgca"))


def base_code(base: Column) -> Column:
    """0 to 3 for A, C, G, T of either case, 4 for a gap, 5 for anything else."""
    at = F.call_function("instr", F.lit(CODES), F.upper(base))
    return F.when(at > 0, at - 1).otherwise(5)


def base_codes(bases: Column) -> Column:
    """``base_code`` of each base of a string."""
    known = F.translate(F.regexp_replace(bases, "[^ACGTacgt-]", "N"), "ACGTacgt-N", "0123012345")
    return F.when(bases == "", F.array(F.lit(0))).otherwise(F.split(known, "").cast("array<int>"))


def one_hot(code: Column) -> Column:
    vectors = F.array(*[F.array(*[F.lit(float(k == c)).cast("float") for k in range(6)]) for c in range(6)])
    return F.coalesce(F.get(vectors, code), F.array(*[F.lit(0.0).cast("float")] * 6))


def run_length(bases: Column) -> Column:
    """``base count base count ...`` of the runs of a string."""
    runs = F.regexp_extract_all(bases, F.lit(r"(?s)(.)\1*"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.substring(r, 1, 1), F.lit(" "), F.length(r).cast("string"))), " ")


def run_length_decode(text: Column) -> Column:
    tokens = F.split(text, " ")
    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(2)), lambda i: F.repeat(F.get(tokens, i), F.get(tokens, i + 1).cast("int"))), "")


def coloured(bases: Column) -> Column:
    """Bases in terminal colours."""
    out = bases
    for base, code in COLOURS.items():
        out = F.regexp_replace(out, f"([{base}{base.lower()}])", f"\u001b[{code}m$1\u001b[0m")
    return out
