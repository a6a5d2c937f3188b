"""Column functions on sequences: all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(col: str | Column, keep: str = "ATGCN") -> Column:
    """Upper case of the letters in keep; everything else goes. A null stays null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.upper(F.regexp_replace(c, f"[^{keep}{keep.lower()}]+", ""))


def count_letter(col: str | Column, letter: str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return (F.length(c) - F.length(F.replace(c, F.lit(letter)))) / F.lit(len(letter))


def letters(col: str | Column, which: str) -> Column:
    """How many of the letters in which there are."""
    c = F.col(col) if isinstance(col, str) else col
    return F.length(c) - F.length(F.translate(c, which, ""))


def gc_share(col: str | Column) -> Column:
    """Share of G and C in all letters, N included; 0 for an empty sequence."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(letters(c, "GC") / F.nullif(F.length(c), F.lit(0)), F.lit(0.0))


def gc_percent(col: str | Column) -> Column:
    """Per cent of G and C in the known letters; 0 where there is none."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(letters(c, "GC") / F.nullif(letters(c, "ATGC"), F.lit(0)) * 100, F.lit(0.0))


def cpg_share(col: str | Column) -> Column:
    """CG pairs over pairs of neighbours; 0 for fewer than two letters."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(count_letter(c, "CG") / F.nullif(F.greatest(F.length(c) - 1, F.lit(0)), F.lit(0)), F.lit(0.0))


def gc3_share(col: str | Column) -> Column:
    """Share of frame-0 codons that end in G or C; gc_share where there is no codon."""
    c = F.col(col) if isinstance(col, str) else col
    codons = F.floor(F.length(c) / 3).cast("int")
    third = F.filter(F.sequence(F.lit(1), codons), lambda i: F.substring(c, (i * 3).cast("int"), F.lit(1)).isin("G", "C"))
    return F.when(codons >= 1, F.size(third) / codons).otherwise(gc_share(c))


def entropy(col: str | Column, alphabet: str = "ATGCN") -> Column:
    """Shannon entropy in bits of the letters of alphabet; 0 for an empty sequence."""
    c = F.col(col) if isinstance(col, str) else col
    total = F.nullif(letters(c, alphabet), F.lit(0))
    out = F.lit(0.0)
    for x in alphabet:
        p = letters(c, x) / total
        out = out - F.when(p > 0, p * F.log(2.0, p)).otherwise(F.lit(0.0))
    return out


def reverse_complement(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.reverse(F.translate(c, "ATGC", "TACG"))


def sequence_type(seq: str | Column, short: int = 50, suspect_gc: float = 0.55) -> Column:
    c = F.col(seq) if isinstance(seq, str) else seq
    return F.when(F.length(c) < short, "short").when(gc_share(c) > suspect_gc, "plasmid_suspect").otherwise("standard")


def gc_bucket(gc: Column) -> Column:
    return F.when(gc < 30, "low").when(gc > 65, "high").when(gc.between(40, 60), "typical").otherwise("slightly outside")


def length_bucket(n: Column) -> Column:
    return F.when(n < 2000, "short").when(n < 10000, "medium").otherwise("long")


def safe_id(col: str | Column) -> Column:
    """At most 64 of letters, digits, dash, underscore and dot; others become an underscore; empty becomes 'sequence'."""
    c = F.col(col) if isinstance(col, str) else col
    out = F.substring(F.regexp_replace(c, "[^A-Za-z0-9_.-]", "_"), 1, 64)
    return F.when(F.coalesce(out, F.lit("")) == "", "sequence").otherwise(out)


def format_evalue(e: Column) -> Column:
    return F.when(e == 0, "0").otherwise(F.format_string("%.2e", e))


def risk(p: Column, length: Column, classes: int = 3, short: int = 50, floor: float = 0.0) -> Column:
    """Per cent of the engineered classes of p = [natural, vector, synthetic]; of the second alone with two classes."""
    r = (p[1] + (p[2] if classes == 3 else F.lit(0.0))) * 100
    return F.when(length < short, F.greatest(r, F.lit(floor))).otherwise(r)


def typed_risk(p: Column, kind: Column, short_floor: float = 0.0, plasmid_floor: float = 25.0) -> Column:
    """(risk, flag) of p by sequence type."""
    r = (p[1] + p[2]) * 100
    value = F.when(kind == "short", F.greatest(r, F.lit(short_floor))).when(kind == "plasmid_suspect", F.greatest(r, F.lit(plasmid_floor))).otherwise(r)
    flag = F.when(kind == "short", "SHORT_FRAGMENT").when(kind == "plasmid_suspect", "PLASMID_SUSPECT")
    return F.struct(F.round(value, 2).alias("risk"), flag.alias("flag"))


def argmax(p: Column) -> Column:
    """Index of the largest value, the first of equals."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def majority(p: Column, names: tuple[str, ...] = ("natural", "vector", "synthetic")) -> Column:
    """Name of the class above a half, looked for from the last; 'uncertain' if none is."""
    out = F.lit("uncertain")
    for i, n in enumerate(names):
        out = F.when(p[i] > 0.5, n).otherwise(out)
    return out


def header_label(header: Column, seq_id: Column, labels: tuple[str, ...], tag: str = "SRC") -> Column:
    """A record's label: the tag in its header, else the first label named there, else the third part of its id."""
    h = F.upper(header)
    tagged = F.regexp_extract(h, f"{tag}=(?:LABEL_)?({'|'.join(labels)})", 1)
    part = F.upper(F.get(F.split(seq_id, "_"), F.lit(2)))
    named = F.coalesce(*(F.when(h.contains(x), x) for x in labels))
    return F.coalesce(F.nullif(tagged, F.lit("")), named, F.when(part.isin(*labels), part), F.lit("UNKNOWN"))


def header_level(header: Column, seq_id: Column, levels: tuple[str, ...] = ("EASY", "MEDIUM", "HARD", "CHALLENGING")) -> Column:
    h = F.upper(header)
    return F.coalesce(*(F.when(h.contains(x), x) for x in levels), F.upper(F.get(F.split(seq_id, "_"), F.lit(3))), F.lit("UNKNOWN"))


def tagged_label(header: Column, seq_id: Column, given: Column, labels: tuple[str, ...], tag: str = "SRC") -> Column:
    """A record's label: the given one, else its tag LABEL_X, else the first label named in its id alone; null if none."""
    tagged = F.nullif(F.regexp_extract(F.upper(header), f"{tag}=LABEL_({'|'.join(labels)})", 1), F.lit(""))
    return F.coalesce(given, tagged, *(F.when(F.upper(seq_id).contains(x), x) for x in labels))


def binary_label(header: Column, labels: tuple[tuple[str, int], ...] = (("NATURAL", 0), ("VECTOR", 1), ("SYNTHETIC", 1))) -> Column:
    """0 or 1 by the first name in the header; null if none."""
    return F.coalesce(*(F.when(F.upper(header).contains(name), y) for name, y in labels))
