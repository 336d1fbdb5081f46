"""DuckDB SQL for the queries of this package, written independently of the DataFrame plans."""

from __future__ import annotations

from ..functions.stopwords import CORE_STOP_WORDS, ENTITY_STOP_WORDS
from ..functions.text import GREEK, GREEK_LATIN, ROMAN
from .derived import EXOTIC, PAIRS
from .queries import ORDERS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows, *names: str) -> str:
    body = ", ".join("(" + ", ".join(lit(x) for x in (r if isinstance(r, tuple) else (r,))) + ")" for r in rows)
    return f"(VALUES {body}) v({', '.join(names)})"


def chain(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    return x


DASH = "[−\\x2D‐-―]"


def ws(x: str) -> str:
    return f"regexp_replace({x}, '[\\s  - 　]+', ' ', 'g')"


def dashes(x: str, rep: str) -> str:
    return f"regexp_replace({x}, '{DASH}', '{rep}', 'g')"


def norm(x: str) -> str:
    return f"lower(replace(replace(strip_accents({dashes(ws(x), '')}), '’', ''''), 'ß', 'ss'))"


def greek_uni(x):
    return chain(x, [(v, k) for k, v in GREEK.items()])


def greek_latin(x):
    return chain(x, GREEK_LATIN.items())


def greek_spelled(x):
    return chain(x, GREEK.items())


def roman(x: str) -> str:
    last = f"upper(regexp_extract({x}, '(?i)^.*[- ](\\d+|[IXV]+)$', 1))"
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for i, r in enumerate(ROMAN, 1) for a, b in ((r, str(i)), (str(i), r)))
    return f"coalesce(substr({x}, 1, len({x}) - len({last})) || CASE {last} {cases} END, {x})"


def singulars(x: str) -> str:
    cut = lambda n: f"substr({x}, 1, greatest(len({x}) - {n}, 0))"
    two = lambda a, r: f"[{{'s': {a}, 'r': '{r}'}}, {{'s': {cut(1)}, 'r': 'plural_s'}}]"
    return (
        f"CASE WHEN NOT suffix({x}, 's') OR suffix({x}, 'sis') THEN [{{'s': {x}, 'r': 'non_plural'}}] WHEN suffix({x}, 'oes') THEN {two(cut(2), 'plural_oes')} "
        f"WHEN suffix({x}, 'ies') THEN {two(cut(3) + " || 'y'", 'plural_ies')} WHEN regexp_matches({x}, '(xes|ses|ches|shes)$') THEN {two(cut(2), 'plural_es')} "
        f"WHEN regexp_full_match({cut(1)}, '\\p{{Lu}}+') THEN [{{'s': {cut(1)}, 'r': 'plural_caps_s'}}] ELSE [{{'s': {cut(1)}, 'r': 'plural_s'}}] END"
    )


def lookups(x: str) -> str:
    forms = [norm(f) for f in (x, dashes(x, " "), greek_uni(x), greek_latin(x), greek_spelled(x), roman(x))]
    return f"list_distinct(list_concat([{', '.join(forms)}], list_transform({singulars(x)}, lambda z: {norm('z.s')})))"


def pattern(x: str, start: bool = False) -> str:
    first = f"WHEN regexp_full_match({x}, '\\p{{Lu}}\\p{{Ll}}*') THEN 'sentence_initial_cap' " if start else ""
    return f"CASE {first}WHEN regexp_full_match({x}, '\\p{{Lu}}') THEN 'single_cap_letter' WHEN regexp_full_match({x}, '\\p{{Lu}}+') THEN 'all_caps' WHEN regexp_full_match({x}, '\\p{{Ll}}+') THEN 'all_lower' WHEN regexp_full_match({x}, '\\p{{Lu}}\\p{{Ll}}+') THEN 'initial_cap' ELSE 'mixed' END"


def curie(db: str, id_: str, upper: bool = False) -> str:
    return (
        f"CASE len({id_}) - len(replace({id_}, ':', '')) WHEN 0 THEN CASE WHEN {db} = 'UP' THEN 'uniprot' ELSE lower({db}) END || ':' || {id_} "
        f"WHEN 1 THEN {'upper' if upper else 'lower'}(split_part({id_}, ':', 1)) || ':' || split_part({id_}, ':', 2) END"
    )


WORDS = f"words AS (SELECT DISTINCT raw FROM (SELECT p_name AS raw FROM part UNION ALL SELECT s_name FROM supplier UNION ALL SELECT * FROM {values(EXOTIC, 'raw')}))"

TERMS = f"""src AS (
    SELECT CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) ELSE upper(p_name[1]) || p_name[2:] END AS text, p_type AS db, p_size::VARCHAR AS id, p_partkey::BIGINT AS k FROM part
    UNION ALL SELECT n_name, 'NATION', n_nationkey::VARCHAR, n_nationkey FROM nation UNION ALL SELECT r_name, 'REGION', r_regionkey::VARCHAR, r_regionkey FROM region
    UNION ALL SELECT s_name, 'SUPP', s_suppkey::VARCHAR, s_suppkey FROM supplier),
terms AS (SELECT {norm('text')} AS norm_text, text, db, id, text AS entry_name, CASE k % 4 WHEN 0 THEN 'curated' WHEN 1 THEN 'name' WHEN 2 THEN 'synonym' ELSE 'former_name' END AS status, lower(db) AS source,
    CASE k % 3 WHEN 0 THEN '9606' WHEN 1 THEN '10090' END AS organism, CASE WHEN k % 5 = 0 THEN 'XDB' END AS source_db, CASE WHEN k % 5 = 0 THEN k::VARCHAR END AS source_id FROM src)"""

SPELLINGS = """[text, upper(text), array_to_string(list_transform(string_split(text, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '),
    text || 's', replace(text, ' ', '-'), text || ' II', text || ' 2', {lower}]"""
MENTIONS = f"""mentions AS (SELECT DISTINCT trim(unnest({SPELLINGS.format(lower='lower(text)')})) AS raw FROM (SELECT DISTINCT text FROM terms))"""


def scan(pairs: str) -> str:
    """pairs(q, r) -> scored(q, r, exact, space, n_dash, nc, s): the two strings read side by side, then the digits of the score."""
    return f"""pp AS (SELECT DISTINCT q AS q0, r AS r0, {dashes(ws('q'), '-')} AS q, {dashes("rtrim(" + ws('r') + ", ' ')", '-')} AS r FROM {pairs}),
walk AS (
    SELECT q0, r0, q, r, 1 AS i, 1 AS j, '' AS a, '' AS b, CAST([] AS STRUCT(x VARCHAR, y VARCHAR)[]) AS ps, FALSE AS dq, FALSE AS dr, FALSE AS sp, FALSE AS after FROM pp WHERE q <> r
    UNION ALL
    SELECT q0, r0, q, r, CASE WHEN bs THEN i + 1 WHEN ss THEN i WHEN qc = '-' THEN i + 1 WHEN rc = '-' THEN i ELSE i + 1 END,
        CASE WHEN bs THEN j + 1 WHEN ss THEN j WHEN rc = '-' THEN j + 1 WHEN qc = '-' THEN j ELSE j + 1 END,
        CASE WHEN bs OR ((qc = '-' OR rc = '-') AND NOT ss) THEN '' WHEN ss THEN a ELSE a || qc END, CASE WHEN bs OR ((qc = '-' OR rc = '-') AND NOT ss) THEN '' WHEN ss THEN b ELSE b || rc END,
        CASE WHEN bs OR ((qc = '-' OR rc = '-') AND NOT ss) THEN list_append(ps, {{'x': a, 'y': b}}) ELSE ps END,
        dq OR (NOT bs AND NOT ss AND qc = '-' AND rc <> '-'), dr OR (NOT bs AND NOT ss AND rc = '-' AND qc <> '-'), ss, bs
    FROM (SELECT *, q[i] AS qc, r[j] AS rc, q[i] = ' ' AND r[j] = ' ' AS bs, (q[i] = ' ') <> (r[j] = ' ') AS ss FROM walk WHERE NOT sp AND i <= len(q) AND j <= len(r))),
fin AS (SELECT q0, r0, q, r, sp, dq, dr, list_append(ps, {{'x': a, 'y': b}}) AS ps FROM walk WHERE sp OR i > len(q) OR j > len(r)
    UNION ALL SELECT q0, r0, q, r, FALSE, FALSE, FALSE, CAST([] AS STRUCT(x VARCHAR, y VARCHAR)[]) FROM pp WHERE q = r),
jud AS (SELECT q0, r0, r, sp, q = r OR (NOT sp AND len(list_filter(ps, lambda p: p.x = p.y)) > 0) AS exact, CASE WHEN sp THEN 0 ELSE dq::INT + dr::INT END AS n_dash,
    CASE WHEN sp THEN [] ELSE list_transform(list_filter(ps, lambda p: p.x <> p.y), lambda p: {{'c': {pattern('p.x')}, 'd': {pattern('p.y')}}}) END AS cs FROM fin),
dig AS (SELECT q0, r0, sp, exact, n_dash, cs, list_distinct(list_transform(cs, lambda z: z.c)) AS qc, list_distinct(list_transform(cs, lambda z: z.d)) AS rc, len(r) AS rl FROM jud),
scored AS (SELECT q0 AS q, r0 AS r, exact, sp AS space, n_dash::BIGINT AS n_dash, len(cs)::BIGINT AS n_combos,
    ((((((CASE WHEN rl <= 3 AND (list_contains(cs, {{'c': 'all_caps', 'd': 'all_lower'}}) OR list_contains(cs, {{'c': 'all_lower', 'd': 'all_caps'}})) THEN 0 ELSE 1 END) * 3
      + CASE WHEN list_contains(cs, {{'c': 'mixed', 'd': 'mixed'}}) THEN 0 WHEN list_contains(qc, 'mixed') OR list_contains(rc, 'mixed') THEN 1 ELSE 2 END) * 2 + exact::INT) * 3
      + CASE WHEN exact AND len(cs) = 0 THEN 2 ELSE 0 END) * 5
      + greatest(4 - len(qc) + (list_contains(qc, 'single_cap_letter') AND (list_contains(qc, 'all_caps') OR list_contains(qc, 'initial_cap')))::INT + (list_has_any(qc, ['single_cap_letter', 'initial_cap', 'all_lower']))::INT,
          4 - len(rc) + (list_contains(rc, 'single_cap_letter') AND (list_contains(rc, 'all_caps') OR list_contains(rc, 'initial_cap')))::INT)) * 3 + 2 - n_dash)::DOUBLE / 539.0 AS s FROM dig)"""


RANK = "CASE status WHEN 'curated' THEN 4 WHEN 'name' THEN 3 WHEN 'synonym' THEN 2 ELSE 1 END"
GROUND = f"""{TERMS}, {MENTIONS},
keys AS (SELECT raw, unnest({lookups('raw')}) AS norm_text FROM mentions),
hit0 AS (SELECT k.raw, t.* FROM keys k JOIN terms t ON k.norm_text = t.norm_text),
"""


def ground(organisms: tuple[str, ...] = ("9606",), namespaces: tuple[str, ...] = ()) -> str:
    place = "CASE organism " + " ".join(f"WHEN '{o}' THEN {i}" for i, o in enumerate(organisms)) + " END"
    keep = f"WHERE list_has_any(ns, [{', '.join(map(lit, namespaces))}])" if namespaces else ""
    return f"""WITH RECURSIVE {GROUND}
hit1 AS (SELECT *, {place} AS place FROM hit0 WHERE organism IS NULL OR {place} IS NOT NULL),
hit AS (SELECT * FROM (SELECT *, min(place) OVER (PARTITION BY raw) AS best FROM hit1) WHERE organism IS NULL OR place = best),
prs AS (SELECT DISTINCT raw AS q, text AS r FROM hit), {scan('prs')},
full_ AS (SELECT h.*, (({RANK}) * 2.0 + s.s) / 9.0::DOUBLE AS score FROM hit h JOIN scored s ON h.raw = s.q AND h.text = s.r),
mrg AS (SELECT raw, db, id, max(score) AS score, count(*) - 1 AS n_subsumed, list_distinct(list_concat([db], list_filter(list(source_db), lambda x: x IS NOT NULL))) AS ns,
    first(text ORDER BY -score, text, status, source, organism NULLS FIRST, source_db NULLS FIRST, source_id NULLS FIRST) AS text FROM full_ GROUP BY raw, db, id),
rnk AS (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY score DESC, db, id)::INT AS rank FROM mrg {keep})
SELECT raw, rank, db, id, text, score, n_subsumed::BIGINT AS n_subsumed, {curie('db', 'id')} AS curie FROM rnk"""


def sql() -> dict[str, str]:
    core, both = ", ".join(map(lit, CORE_STOP_WORDS)), ", ".join(map(lit, [*CORE_STOP_WORDS, *ENTITY_STOP_WORDS]))
    best = f"SELECT * FROM ({ground()}) WHERE rank = 1"
    amb = f"""WITH {TERMS}, g AS (SELECT text, count(*)::BIGINT AS n_terms, count(DISTINCT (db, id))::BIGINT AS n_groundings, bool_or(status = 'name') AS nm, bool_or(status = 'curated') AS cu, count(DISTINCT lower(entry_name)) = 1 AS sm FROM terms GROUP BY text)
SELECT text, n_terms, n_groundings FROM g WHERE n_terms >= 2 AND n_groundings > 1"""
    dedupe = f"""WITH {TERMS}, r AS (SELECT *, row_number() OVER (PARTITION BY db, id, coalesce(source_db, ''), coalesce(source_id, ''), text ORDER BY -({RANK}), CASE WHEN lower(db) = lower(source) THEN 0 ELSE 1 END, norm_text, entry_name, status, source, organism NULLS FIRST) AS n FROM terms)
SELECT norm_text, text, db, id, entry_name, status, source, organism, source_db, source_id FROM r WHERE n = 1"""
    word_terms = """wd AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents WHERE lang = 'en'),
ones AS (SELECT t FROM (SELECT unnest(w) AS t FROM wd) WHERE len(t) >= 4 GROUP BY t HAVING count(*) >= 40),
twos AS (SELECT t FROM (SELECT unnest(list_filter(list_transform(range(1, len(w)), lambda i: CASE WHEN len(w[i]) >= 4 AND len(w[i + 1]) >= 4 THEN w[i] || ' ' || w[i + 1] END), lambda z: z IS NOT NULL)) AS t FROM wd) GROUP BY t HAVING count(*) >= 12),
wt AS (SELECT t, len(t) - len(replace(t, ' ', '')) + 1 AS n, split_part(t, ' ', 1) AS f FROM (SELECT t FROM ones UNION ALL SELECT t FROM twos))"""
    # simple tokens: runs of ASCII letters in lines of English documents without other letters
    spans = f"""WITH RECURSIVE {word_terms},
ln AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda l: l <> '')) AS l, generate_subscripts(list_filter(string_split(text, chr(10)), lambda l: l <> ''), 1) - 1 AS sent FROM documents WHERE lang = 'en' AND regexp_full_match(text, '[\\x00-\\x7F]*')),
tk AS (SELECT doc_id, sent, regexp_extract_all(lower(l), '[a-z]+') AS w FROM ln),
ix AS (SELECT doc_id, sent, w, unnest(range(1, len(w) + 1)) AS i FROM tk),
cd AS (SELECT doc_id, sent, i, t.n, t.t FROM ix JOIN (SELECT DISTINCT f, n FROM wt) p ON w[i] = p.f AND i + p.n - 1 <= len(w) JOIN wt t ON t.f = p.f AND t.n = p.n AND t.t = array_to_string(w[i:i + p.n - 1], ' ')
    WHERE w[i] NOT IN ({core}) AND (p.n > 1 OR w[i] NOT IN ({both})) AND len(t.t) > 1),
bs AS (SELECT doc_id, sent, i, max(n) AS n FROM cd GROUP BY ALL),
ls AS (SELECT doc_id, sent, list({{'i': i, 'n': n}} ORDER BY i) AS xs FROM bs GROUP BY ALL),
gr AS (SELECT doc_id, sent, list_reduce(list_prepend({{'nx': 0::BIGINT, 'k': 0::BIGINT}}, list_transform(xs, lambda x: {{'nx': x.i::BIGINT, 'k': x.n::BIGINT}})), lambda s, x: CASE WHEN x.nx >= s.nx THEN {{'nx': x.nx + x.k, 'k': s.k + 1}} ELSE s END) AS z FROM ls)
SELECT doc_id, sum(z.k)::BIGINT AS n_annotations FROM gr GROUP BY doc_id"""
    return {
        "normalize": f"WITH {WORDS} SELECT raw, {norm('raw')} AS norm_text, {dashes('raw', '-')} AS dashed, {ws('raw')} AS spaced FROM words",
        "greek_variants": f"WITH {WORDS} SELECT raw, {greek_uni('raw')} AS uni, {greek_latin('raw')} AS latin, {greek_spelled('raw')} AS spelled FROM words",
        "roman_arabic": f"WITH {WORDS} SELECT raw, {roman('raw')} AS other FROM words",
        "depluralize": f"WITH {WORDS}, s AS (SELECT raw, unnest({singulars('raw')}) AS z FROM words) SELECT raw, z.s AS singular, z.r AS rule FROM s",
        "cap_pattern": f"WITH {WORDS} SELECT raw, {pattern('raw')} AS pattern, {pattern('raw', True)} AS at_start FROM words",
        "lookups_exploded": f"WITH {TERMS}, {MENTIONS} SELECT raw, unnest({lookups('raw')}) AS norm_text FROM mentions",
        "curies": f"WITH {TERMS}, x AS (SELECT DISTINCT db, id FROM terms UNION ALL SELECT * FROM (VALUES ('UP', 'P12345'), ('HGNC', '12345'), ('CHEBI', 'CHEBI:12345'), ('X', 'a:b:c'))) SELECT db, id, {curie('db', 'id')} AS curie, {curie('db', 'id', True)} AS identifiers, 'https://bioregistry.io/' || {curie('db', 'id')} AS url FROM x",
        "term_groundings": f"WITH {TERMS} SELECT text, db, id, CASE WHEN source_db IS NULL THEN 1 ELSE 2 END::BIGINT AS n, CASE WHEN source_db IS NULL THEN db ELSE db || ',' || source_db END AS namespaces FROM terms",
        "match_pairs": f"WITH RECURSIVE {TERMS}, prs AS (SELECT DISTINCT unnest({SPELLINGS.format(lower="' ' || lower(text) || ' '")}) AS q, text AS r FROM (SELECT DISTINCT text FROM terms) UNION SELECT * FROM {values(PAIRS, 'q', 'r')}), {scan('prs')} SELECT q, r, exact, space, n_dash, n_combos, s AS string_score FROM scored",
        "lookup_join": f"WITH {GROUND.rstrip().rstrip(',')} SELECT raw, count(*)::BIGINT AS n_terms, count(DISTINCT (db, id))::BIGINT AS n_groundings FROM hit0 GROUP BY raw",
        "organism_filter": f"WITH {GROUND.rstrip().rstrip(',')}, h AS (SELECT *, CASE organism WHEN '10090' THEN 0 WHEN '9606' THEN 1 END AS p FROM hit0), b AS (SELECT *, min(p) OVER (PARTITION BY raw) AS m FROM h) SELECT raw, count(*)::BIGINT AS n, count(organism)::BIGINT AS n_organism FROM b WHERE organism IS NULL OR p = m GROUP BY raw",
        "ground_all": ground(),
        "ground_best": best,
        "ground_namespaces": ground(("10090", "9606"), ("XDB", "NATION")),
        "ground_by_order": " UNION ALL ".join(f"SELECT {lit(o)} AS organisms, * FROM ({ground(tuple(o.split(',')))})" for o in ORDERS),
        "ground_column": f"WITH best AS ({best}) SELECT p_partkey, p_name, curie AS p_name_grounded FROM part LEFT JOIN best ON trim(p_name) = raw",
        "dedupe_terms": dedupe,
        "ambiguities": amb + " AND NOT nm AND NOT cu AND NOT sm",
        "ambiguities_all": amb,
        "names": f"WITH {TERMS} SELECT DISTINCT text FROM terms WHERE db = 'NATION' AND status = 'name'",
        "summary": f"WITH {TERMS} SELECT count(DISTINCT norm_text)::BIGINT AS lookups, count(*)::BIGINT AS terms, count(DISTINCT db)::BIGINT AS namespaces, count(*) FILTER (status = 'curated')::BIGINT AS curated, count(*) FILTER (status = 'name')::BIGINT AS name, count(*) FILTER (status = 'synonym')::BIGINT AS synonym, count(*) FILTER (status = 'former_name')::BIGINT AS former_name FROM terms",
        "status_counts": f"WITH {TERMS} SELECT status, count(*)::BIGINT AS n_terms FROM terms GROUP BY status",
        "prefix_index": f"WITH {TERMS}, w AS (SELECT list_filter(string_split(norm_text, ' '), lambda x: x <> '') AS w FROM terms) SELECT w[1] AS first_word, array_to_string(list_sort(list(DISTINCT len(w))), ',') AS lengths FROM w WHERE len(w) > 0 GROUP BY 1",
        "annotations": spans,
        "eval_rollup": """SELECT coalesce(c_mktsegment, 'Total') AS entity_type, count(*)::BIGINT AS n, sum((c_acctbal > 0)::INT)::BIGINT AS n_grounded, sum((c_acctbal > 5000)::INT)::BIGINT AS n_correct,
round(sum((c_acctbal > 5000)::INT) / sum((c_acctbal > 0)::INT), 3) AS precision, round(sum((c_acctbal > 5000)::INT) / count(*), 3) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 9) AS f1 FROM customer GROUP BY ROLLUP (c_mktsegment)""",
        "eval_spans": """WITH g AS (SELECT DISTINCT l_orderkey % 500 AS doc, l_linenumber::VARCHAR AS text, l_partkey % 50 AS s FROM lineitem WHERE l_quantity < 30), f AS (SELECT DISTINCT l_orderkey % 500 AS doc, l_linenumber::VARCHAR AS text, l_partkey % 50 AS s FROM lineitem WHERE l_quantity >= 20),
t AS (SELECT (SELECT count(*) FROM (SELECT * FROM g INTERSECT SELECT * FROM f)) AS tp, (SELECT count(*) FROM (SELECT * FROM f EXCEPT SELECT * FROM g)) AS fp, (SELECT count(*) FROM (SELECT * FROM g EXCEPT SELECT * FROM f)) AS fn)
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, round(2 * precision * recall / (precision + recall), 9) AS f1 FROM t""",
        "namespace_crosstab": "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F')::BIGINT AS F, count(*) FILTER (l_linestatus = 'O')::BIGINT AS O FROM lineitem GROUP BY 1",
        "run_diff": "WITH o AS (SELECT o_orderkey AS row, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS v FROM orders), n AS (SELECT o_orderkey AS row, CASE WHEN o_orderkey % 5 > 0 THEN CASE WHEN o_orderkey % 7 = 0 THEN 'new' ELSE o_orderpriority END END AS v FROM orders) SELECT CASE WHEN o.v IS NOT DISTINCT FROM n.v THEN 'same' WHEN o.v IS NULL THEN 'gained' WHEN n.v IS NULL THEN 'lost' ELSE 'changed' END AS change, count(*)::BIGINT AS n FROM o FULL JOIN n USING (row) WHERE o.v IS NOT NULL OR n.v IS NOT NULL GROUP BY 1",
        "throughput_stats": "SELECT l_returnflag AS type, l_linestatus AS context, round(avg(1.0 / l_quantity), 1) AS mean, round(stddev_samp(1.0 / l_quantity), 1) AS std FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2",
        "top_false_positives": "WITH g AS (SELECT DISTINCT event_type AS text, user_id % 50 AS doc FROM events WHERE value < 5), f AS (SELECT event_type AS text, user_id % 50 AS doc, event_id FROM events) SELECT text, count(*)::BIGINT AS n FROM f ANTI JOIN g USING (text, doc) GROUP BY text ORDER BY n DESC, text LIMIT 50",
        "disambiguate": """WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND text <> ''), h AS (SELECT DISTINCT text, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM d),
z AS (SELECT text, 0.2::DOUBLE + list_contains(w, 'the')::INT * 1.5 + list_contains(w, 'with')::INT * -0.5 AS a, 0.1::DOUBLE + list_contains(w, 'for')::INT * 0.7 AS b, 0.0::DOUBLE AS c FROM h),
p AS (SELECT text, exp(a - greatest(a, b, c)) / (exp(a - greatest(a, b, c)) + exp(b - greatest(a, b, c)) + exp(c - greatest(a, b, c))) AS pa FROM z) SELECT d.doc_id, round(pa, 9) AS probability FROM d JOIN p USING (text)""",
    }
