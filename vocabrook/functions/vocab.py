"""Column functions for vocabulary sources and evaluation tables."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import _col

#: Three-letter names of amino acids.
AMINO_ACIDS = "ala arg asn asp asx cys glu gln glx gly his ile leu lys met phe pro ser thr trp tyr val".split()


def is_aa_sequence(s) -> Column:
    """Whether a text is capitalised amino-acid abbreviations joined by dashes."""
    parts = F.split(_col(s), "-")
    return (F.size(parts) > 1) & F.forall(parts, lambda p: p.isin(*[a.capitalize() for a in AMINO_ACIDS]))


def alias_names(s) -> Column:
    """The items of a comma-separated list; quoted ones may hold commas, and a doubled quotation mark is one."""
    items = F.regexp_extract_all(_col(s), F.lit('(?:"(?:[^"]|"")*"|[^,"])+'), F.lit(0))

    def plain(x):
        x = F.trim(x)
        quoted = x.startswith('"') & x.endswith('"') & (F.length(x) > 1)
        return F.trim(F.when(quoted, F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))

    return F.transform(items, plain)


def withdrawn_to(s) -> Column:
    """The id that a withdrawn symbol's name refers to, else ''."""
    return F.regexp_extract(_col(s), r"symbol withdrawn, see \[HGNC:(?: ?)(\d+)\]", 1)


def clean_synonym(s) -> Column:
    """null for 'ambiguous' synonyms; the part before '(formerly' and before the first quotation mark."""
    s = _col(s)
    head = F.when(s.rlike(r".+ \(formerly"), F.regexp_extract(s, r"(.+) \(formerly", 1)).otherwise(s)
    return F.when(~F.lower(s).contains("ambiguous"), F.split(head, '"')[0])


def normal_ids(s) -> Column:
    """'|'-separated ids in their usual spelling."""

    def one(x):
        ns, rest = F.split(x, ":", 2)[0], F.split(x, ":", 2)[1]
        return (
            F.when(x.startswith("CVCL"), F.replace(x, F.lit("_"), F.lit(":"))).when(ns == "Uberon", rest).when(ns == "Uniprot", F.concat(F.lit("UP:"), rest))
            .when(ns.isin("GO", "CHEBI"), F.concat(ns, F.lit(":"), x)).otherwise(x)
        )

    return F.transform(F.split(_col(s), r"\|"), one)


def entity_type(ids) -> Column:
    """The class of an array of ids, by the first prefix that any of them has."""
    any_of = lambda *ps: F.exists(_col(ids), lambda x: x.rlike("^(" + "|".join(map(re.escape, ps)) + ")"))
    return (
        F.when(any_of("NCBI gene", "UP"), "Gene").when(any_of("Rfam"), "miRNA").when(any_of("CHEBI", "PubChem"), "Small Molecule").when(any_of("GO"), "Cellular Component")
        .when(any_of("CVCL", "CL"), "Cell types/Cell lines").when(any_of("UBERON"), "Tissue/Organ").when(any_of("NCBI taxon"), "Taxon").otherwise("unknown")
    )


def gene_type(ids, equivalents) -> Column:
    """entity_type(), where a gene is a human one if any equivalent id is of HGNC."""
    kind = entity_type(ids)
    human = F.exists(_col(equivalents), lambda x: x.startswith("HGNC"))
    return F.when(kind != "Gene", kind).when(F.coalesce(human, F.lit(False)), "Human Gene").otherwise("Nonhuman Gene")


#: Namespaces and the names that tables show for them.
DISPLAY_NAMES = {"UP": "Uniprot", "NCBI gene": "Entrez", "PubChem": "PubChem", "CL": "Cell Ontology", "CVCL": "Cellosaurus", "UBERON": "Uberon", "FPLX": "Famplex"}


def display_name(ns) -> Column:
    names = F.create_map(*[F.lit(x) for pair in DISPLAY_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, _col(ns)), _col(ns))


#: Misspelt metabolite names and suffixes that are written on.
TYPOS = {"stereamide": "stearamide", "staericacid": "stearicacid"}
SUFFIXES = ("acid", "mononucleotide")


def metabolite_name(s) -> Column:
    """A metabolite's name without a trailing (abbreviation), with spaces for underscores and before suffixes, up to a slash."""
    out = _col(s)
    for wrong, right in TYPOS.items():
        out = F.when(out == wrong, right).otherwise(out)
    out = F.replace(F.regexp_replace(out, r"\([a-zA-Z]+\)$", ""), F.lit("_"), F.lit(" "))
    for suffix in SUFFIXES:
        out = F.regexp_replace(out, f"([^ ])({suffix})$", f"$1 {suffix}")
    return F.split_part(out, F.lit("/"), F.lit(1))


def without_suffix(s) -> Column:
    """A synonym as it is and, second, without a trailing ' (..)'."""
    return F.array(_col(s), F.regexp_replace(_col(s), r"^(.*) \(.*\)$", "$1"))


def f1(precision, recall) -> Column:
    """Harmonic mean; 0 where both are 0."""
    p, r = _col(precision), _col(recall)
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def _names(s: str) -> list[str]:
    """The first name, then the synonyms in parentheses behind it; sections in brackets and EC numbers are left out."""
    rest = re.sub(r"\[Includes: [^\]]+\]", "", s).strip()
    rest = re.sub(r"\[Cleaved into: [^\]]+\]( \(Fragments\))?", "", rest).strip()
    found: list[str] = []
    while rest.endswith(")"):
        # the parenthesis that the last one closes
        depth = 0
        opening = next((k for k in range(len(rest) - 1, -1, -1) if not (depth := depth + (rest[k] == ")") - (rest[k] == "("))), 0)
        if opening == 0 or rest[opening - 1] != " ":
            break
        if not re.match(r"EC [\d.-]+", inner := rest[opening + 1 : -1]):
            found.append(inner)
        rest = rest[: opening - 1]
    return ([rest] if rest else []) + found[::-1]


@F.pandas_udf(T.ArrayType(T.StringType()))
def protein_names(values: pd.Series) -> pd.Series:
    return values.map(lambda s: _names(s) if isinstance(s, str) else [])
