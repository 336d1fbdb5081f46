"""CURIEs, links and groundings of lexicon entries, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col


def get_curie(db, id_, style: str = "bioregistry") -> Column:
    """db and id as a CURIE; null if the id has more than one colon. An id with one colon brings its own prefix."""
    db, id_ = _col(db), _col(id_)
    prefix = F.when(db == "UP", "uniprot").otherwise(F.lower(db))
    parts = F.split(id_, ":", -1)
    case = F.upper if style == "identifiers" else F.lower
    return F.when(F.size(parts) == 1, F.concat(prefix, F.lit(":"), id_)).when(F.size(parts) == 2, F.concat(case(parts[0]), F.lit(":"), parts[1]))


def get_identifiers_curie(db, id_) -> Column:
    return get_curie(db, id_, "identifiers")


def get_identifiers_url(db, id_) -> Column:
    return F.concat(F.lit("https://identifiers.org/"), get_identifiers_curie(db, id_))


def get_bioregistry_url(db, id_) -> Column:
    return F.concat(F.lit("https://bioregistry.io/"), get_curie(db, id_))


get_url = get_bioregistry_url


def term_groundings(db="db", id_="id", source_db="source_db", source_id="source_id") -> Column:
    """array<struct(db, id)>: the entry's own and the one it was mapped from."""
    pair = lambda a, b: F.struct(_col(a).alias("db"), _col(b).alias("id"))
    mapped = _col(source_db).isNotNull() & (_col(source_db) != "")
    return F.array_compact(F.array(pair(db, id_), F.when(mapped, pair(source_db, source_id))))


def term_namespaces(db="db", source_db="source_db") -> Column:
    return F.array_distinct(F.array_compact(F.array(_col(db), F.when(_col(source_db) != "", _col(source_db)))))


def match_groundings(term: Column, subsumed: Column) -> Column:
    """Distinct groundings of a match: its entry's and those of the entries it subsumes."""
    of = lambda t: term_groundings(t["db"], t["id"], t["source_db"], t["source_id"])
    return F.array_distinct(F.concat(of(term), F.flatten(F.transform(subsumed, of))))


def match_namespaces(term: Column, subsumed: Column) -> Column:
    of = lambda t: term_namespaces(t["db"], t["source_db"])
    return F.array_distinct(F.concat(of(term), F.flatten(F.transform(subsumed, of))))


def grounding_dict(groundings: Column) -> Column:
    """map CURIE -> link of an array of groundings; those without a CURIE are left out."""
    named = F.transform(groundings, lambda g: F.struct(get_curie(g["db"], g["id"]).alias("k"), get_bioregistry_url(g["db"], g["id"]).alias("v")))
    return F.map_from_entries(F.array_distinct(F.filter(named, lambda e: e["k"].isNotNull())))
