"""Citation-marker normalisation (C1–C8) as chained regex column expressions.

Parametrised by a vocabulary ``(target, other, markup)``: ``("TREF", "REF",
"tags")`` for ``<TREF>…</TREF>`` markup or ``("CIT", "OTH", "bare")`` for
bare ``<CIT>`` markup.  Everything is a projection: no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmine.functions.lexicons import MARKERS_CIT


def _q(s: str) -> str:
    return re.escape(s)


def marker_order(target: str, other: str) -> list[str]:
    """Order in which the syntactic / drop rules visit the markers."""
    return [other, target, "G" + other, "G" + target]


# ------------------------------------------------------------------ C1
def mark_citations_col(text: Column, target="CIT", other="OTH", markup="bare") -> Column:
    """Markup -> marker words, case-insensitive."""
    out = text
    for m in (target, other):
        if markup == "tags":
            out = F.regexp_replace(out, f"(?i)<({_q(m)})>.+?</({_q(m)})>", m)
        else:
            out = F.regexp_replace(out, f"(?i)<({_q(m)})>", m)
    return out


# ------------------------------------------------------------------ C2
def group_rules(target: str, other: str) -> list[tuple[str, str]]:
    t, o = _q(target), _q(other)
    sep = "((;|,|_|) |( and )|( or ))"
    lead = f"(((({o}(;|,|_|))|({o} and)|({o} or))) )+"
    return [
        (f"(?i)({t})+({sep}({o}))+", "G" + target),
        (f"(?i){lead}(G{t}|{t})", "G" + target),
        (f"(?i)({o})+({sep}({o}))+", "G" + other),
        (f"(?i){lead}(G{o}|{o})", "G" + other),
    ]


def group_citations_col(text: Column, target="CIT", other="OTH") -> Column:
    """Collapse runs of markers into group markers (four ordered rules)."""
    out = text
    for rx, rep in group_rules(target, other):
        out = F.regexp_replace(out, rx, rep)
    return out


# ------------------------------------------------------------------ C3
def mark_syntactic_clause_col(text: Column, target="CIT", other="OTH") -> Column:
    """Marker at text start or after ``[,;'".] `` and before a space +
    ASCII alphanumeric becomes ``<marker>SYN``."""
    out = text
    for m in marker_order(target, other):
        qm = _q(m)
        # literal first, then the left context as a look-behind (same matches
        # as "((^M)|((?<=[,;'\".] )M))(SYN)*(?= \p{Alnum})", found much faster)
        out = F.regexp_replace(out, f"{qm}(?<=(?:^|[,;'\".] ){qm})(SYN)*(?= \\p{{Alnum}})", m + "SYN")
    return out


# ------------------------------------------------------------------ C4
def prep_lookbehind(prepositions: list[str]) -> str:
    return "|".join(_q(p) for p in prepositions)


def mark_syntactic_prep_col(text: Column, prepositions: list[str], target="CIT", other="OTH") -> Column:
    """C4: marker right after a preposition (not word-bounded) gets ``SYN``.

    The preposition list is a small word list; it is compiled into one
    regex literal (values escaped)."""
    if not prepositions:
        return text
    alt = prep_lookbehind(prepositions)
    out = text
    for m in marker_order(target, other):
        # same matches as "(?<=prep) (M)"; the literal leads so the search is fast
        out = F.regexp_replace(out, f" ({_q(m)})(?<=(?:{alt}) {_q(m)})", " " + m + "SYN")
    return out


# ------------------------------------------------------------------ C5
def drop_nonsyntactic_col(text: Column, target="CIT", other="OTH", glue=True) -> Column:
    """Delete remaining plain markers with the space before and one
    following character outside ``[A-z]`` (glues neighbours)."""
    out = text
    for m in marker_order(target, other):
        out = F.regexp_replace(out, f" ({_q(m)})([^A-z]|$)", "" if glue else " ")
    return out


# ------------------------------------------------------------------ C6 / C7
def count_references_col(raw_text: Column, target="CIT", other="OTH", markup="bare") -> Column:
    """Number of space-separated words containing ``REF`` (any case)
    after folding both markups to ``REF``."""
    if markup == "tags":
        folded = F.regexp_replace(raw_text, f"(?i)<T*({_q(other)})>.+?</T*({_q(other)})>", "REF")
    else:
        folded = F.regexp_replace(raw_text, f"(?i)<({_q(target)}|{_q(other)})>", "REF")
    return F.size(F.filter(F.split(folded, " "), lambda w: w.rlike("(?i)REF")))


def is_separate_col(grouped_text: Column, target="CIT") -> Column:
    """1 when the grouped text holds no group-target marker."""
    return F.when(grouped_text.rlike(f"(?i)G{_q(target)}"), F.lit(0)).otherwise(F.lit(1))


def strip_pos_suffix(col: Column, tag: str) -> Column:
    """Remove a ``_TAG`` suffix."""
    return F.regexp_replace(col, "_" + _q(tag), "")


# ------------------------------------------------------- DataFrame forms
def normalise_markers(df: DataFrame, prepositions: list[str], text_col="text",
                      vocab=MARKERS_CIT, glue=True) -> DataFrame:
    """C1..C5 in one projection; keeps the C2 output (``grouped``) for C7."""
    target, other, markup = vocab
    c1 = mark_citations_col(F.col(text_col), target, other, markup)
    c2 = group_citations_col(c1, target, other)
    df = df.withColumn("grouped", c2)
    c3 = mark_syntactic_clause_col(F.col("grouped"), target, other)
    c4 = mark_syntactic_prep_col(c3, prepositions, target, other)
    return df.withColumn("clean", drop_nonsyntactic_col(c4, target, other, glue))


def citation_columns(df: DataFrame, text_col="text", vocab=MARKERS_CIT) -> DataFrame:
    """C6 + C7 per document: ``Count`` and ``Separate``."""
    target, other, markup = vocab
    grouped = group_citations_col(mark_citations_col(F.col(text_col), target, other, markup), target, other)
    return df.withColumn("Count", count_references_col(F.col(text_col), target, other, markup)) \
             .withColumn("Separate", is_separate_col(grouped, target))
