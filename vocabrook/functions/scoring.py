"""String match and score of a query against a lexicon entry, as Column functions (JVM only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, capitalization, kept, replace_dashes, replace_whitespace

#: Ranks of the statuses, and the radices of the score's digits.
STATUS = {"curated": 4, "name": 3, "synonym": 2, "former_name": 1}
RADICES = {"short": 2, "mixed": 3, "exact": 2, "acic": 3, "combo": 5, "dash": 3}

_STATE = "struct<i:int,j:int,q:string,r:string,pieces:array<struct<q:string,r:string>>,dq:boolean,dr:boolean,space:boolean>"


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(query: Column, ref: Column) -> Column:
    """Both strings read side by side; the state after the shorter one ends. Leftover characters are not looked at."""
    at = lambda s, k: F.substr(s, k, F.lit(1))
    state = lambda **x: F.struct(*[x[k].alias(k) for k in ("i", "j", "q", "r", "pieces", "dq", "dr", "space")])

    def step(s, _):
        keep = {k: s[k] for k in ("i", "j", "q", "r", "pieces", "dq", "dr", "space")}
        cut = F.array_append(s["pieces"], F.struct(s["q"].alias("q"), s["r"].alias("r")))
        empty = F.lit("")

        def after_space(s, read_q, read_r):
            """s as it is; read_q and read_r its next characters (empty at an end)."""
            keep = {k: s[k] for k in ("i", "j", "q", "r", "pieces", "dq", "dr", "space")}
            cut = F.array_append(s["pieces"], F.struct(s["q"].alias("q"), s["r"].alias("r")))
            new = keep | {"q": empty, "r": empty, "pieces": cut}
            return (
                F.when((read_q == "") | (read_r == ""), state(**keep))
                .when((read_q == "-") & (read_r == "-"), state(**new | {"i": s["i"] + 1, "j": s["j"] + 1}))
                .when(read_q == "-", state(**new | {"i": s["i"] + 1, "dq": F.lit(True)}))
                .when(read_r == "-", state(**new | {"j": s["j"] + 1, "dr": F.lit(True)}))
                .otherwise(state(**keep | {"i": s["i"] + 1, "j": s["j"] + 1, "q": F.concat(s["q"], read_q), "r": F.concat(s["r"], read_r)}))
            )

        qc, rc = at(query, s["i"]), at(ref, s["j"])
        both = state(**keep | {"i": s["i"] + 1, "j": s["j"] + 1, "q": empty, "r": empty, "pieces": cut})
        return (
            F.when(s["space"] | (s["i"] > F.length(query)) | (s["j"] > F.length(ref)), state(**keep))
            .when((qc == " ") & (rc == " "), let(both, lambda t: after_space(t, at(query, t["i"]), at(ref, t["j"]))))
            .when((qc == " ") | (rc == " "), state(**keep | {"space": F.lit(True)}))
            .otherwise(after_space(s, qc, rc))
        )

    start = state(i=F.lit(1), j=F.lit(1), q=F.lit(""), r=F.lit(""), pieces=F.array().cast("array<struct<q:string,r:string>>"), dq=F.lit(False), dr=F.lit(False), space=F.lit(False)).cast(_STATE)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(query) + F.length(ref))), start, lambda s, k: step(s, k).cast(_STATE))


@kept
def generate_match(query, ref, sentence_start: bool = False) -> Column:
    """struct(query, ref, exact, space_mismatch, dash_mismatches, cap_combos)."""
    q = replace_dashes(replace_whitespace(query))
    r = replace_dashes(F.regexp_replace(replace_whitespace(ref), " +$", ""))
    combo = "array<struct<query:string,ref:string>>"
    none = F.array().cast(combo)

    def build(q, r):
        def judged(s):
            pieces = F.array_append(s["pieces"], F.struct(s["q"].alias("q"), s["r"].alias("r")))
            first = lambda p, k: (k == 0) if sentence_start else F.lit(False)
            pattern = lambda p, k: F.when(first(p, k), capitalization(p, True)).otherwise(capitalization(p)) if sentence_start else capitalization(p)
            marked = F.transform(pieces, lambda p, k: F.struct((p["q"] == p["r"]).alias("same"), first(p, k).alias("first"), pattern(p["q"], k).alias("query"), capitalization(p["r"]).alias("ref")))
            is_exact = lambda m: m["same"] & (~m["first"] | (m["query"] == m["ref"]))
            combos = F.transform(F.filter(marked, lambda m: ~is_exact(m)), lambda m: F.struct(m["query"].alias("query"), m["ref"].alias("ref")))
            dashes = F.array_compact(F.array(F.when(s["dq"], "query"), F.when(s["dr"], "ref")))
            gone = s["space"]
            return F.struct(
                q.alias("query"), r.alias("ref"), (~gone & F.exists(marked, is_exact)).alias("exact"), gone.alias("space_mismatch"),
                F.when(gone, F.array().cast("array<string>")).otherwise(dashes).alias("dash_mismatches"), F.when(gone, none).otherwise(combos).alias("cap_combos"),
            )

        equal = F.struct(q.alias("query"), r.alias("ref"), F.lit(True).alias("exact"), F.lit(False).alias("space_mismatch"), F.array().cast("array<string>").alias("dash_mismatches"), none.alias("cap_combos"))
        scanned = let(_scan(q, r), judged)
        return scanned if sentence_start else F.when(q == r, equal).otherwise(scanned)

    return let(F.struct(q.alias("q"), r.alias("r")), lambda x: build(x["q"], x["r"]))


def _has(match: Column, query: str, ref: str) -> Column:
    return F.exists(match["cap_combos"], lambda c: (c["query"] == query) & (c["ref"] == ref))


def _cases(match: Column, side: str) -> Column:
    return F.array_distinct(F.transform(match["cap_combos"], lambda c: c[side]))


def score_short(m: Column) -> Column:
    return F.when((F.length(m["ref"]) <= 3) & (_has(m, "all_caps", "all_lower") | _has(m, "all_lower", "all_caps")), 0).otherwise(1)


def score_mixed(m: Column) -> Column:
    return F.when(_has(m, "mixed", "mixed"), 0).when(F.exists(m["cap_combos"], lambda c: (c["query"] == "mixed") | (c["ref"] == "mixed")), 1).otherwise(2)


def score_exact(m: Column) -> Column:
    return m["exact"].cast("int")


def score_acic(m: Column) -> Column:
    title = lambda c: ((c["query"] == "all_caps") & (c["ref"] == "sentence_initial_cap")) | ((c["query"] == "sentence_initial_cap") & (c["ref"] == "all_caps"))
    return F.when(m["exact"] & (F.size(m["cap_combos"]) == 0), 2).when(m["exact"] & F.forall(m["cap_combos"], title), 1).otherwise(0)


def score_combo(m: Column) -> Column:
    q, r = _cases(m, "query"), _cases(m, "ref")
    has = F.array_contains
    single = lambda c: (has(c, "single_cap_letter") & (has(c, "all_caps") | has(c, "initial_cap"))).cast("int")
    start = has(q, "sentence_initial_cap") & (F.size(q) == 1) & _has(m, "sentence_initial_cap", "all_lower")
    usual = F.arrays_overlap(q, F.array(*[F.lit(x) for x in ("single_cap_letter", "initial_cap", "all_lower")]))
    return F.greatest(4 - F.size(q) + single(q) + (start | usual).cast("int"), 4 - F.size(r) + single(r))


def score_dash(m: Column) -> Column:
    return 2 - F.size(m["dash_mismatches"])


@kept
def score_string_match(match) -> Column:
    """The digits short, mixed, exact, acic, combo, dash as one mixed-radix number, over its largest value."""
    m = _col(match)
    total, norm = F.lit(0), 1
    for digit, radix in zip((score_short, score_mixed, score_exact, score_acic, score_combo, score_dash), RADICES.values(), strict=True):
        total, norm = total * radix + digit(m), norm * radix
    return total.cast("double") / F.lit(float(norm - 1))


def score_status(status) -> Column:
    table = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    return table[_col(status)]


def score(string_score, status) -> Column:
    """The status digit and the string score, in [0, 1]."""
    return (score_status(status).cast("double") * 2.0 + _col(string_score)) / 9.0
