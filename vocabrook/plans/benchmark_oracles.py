"""DuckDB SQL for benchmark_queries, written independently of the DataFrame plans; only the derived rows are shared."""

from __future__ import annotations

from ..operators.lexicon_ops import CLASS_ROOTS
from .benchmark_queries import INPUTS, PATTERN
from .source_oracles import CANDIDATES, TABLES, chosen
from .source_queries import INPUTS as SOURCE_INPUTS


def given(*names: str) -> str:
    known = SOURCE_INPUTS | INPUTS
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({known[n].format(**{t: t for t in TABLES})})" for n in names)


CONTAINED = f"""{given("order_parts", "customer_parts")}, n AS (SELECT DISTINCT * FROM order_parts), h AS (SELECT DISTINCT * FROM customer_parts),
c AS (SELECT needle, count(*) AS size FROM n GROUP BY needle)
SELECT needle, hay FROM n JOIN h USING (item) JOIN c USING (needle) GROUP BY needle, hay, size HAVING count(*) = size"""

SYNONYMS = f"""{given("gold_curies", "curie_links", "family_members")},
g AS (SELECT DISTINCT list_sort(list(DISTINCT curie)) AS curies FROM gold_curies GROUP BY doc),
o AS (SELECT curies, unnest(curies) AS curie FROM g), w AS (SELECT * FROM o UNION SELECT curies, other FROM o JOIN curie_links USING (curie)),
s AS (SELECT curies, list(curie) AS all_ FROM w GROUP BY curies), m AS (SELECT family, list(DISTINCT member) AS members FROM family_members GROUP BY family),
f AS (SELECT curies, 'FPLX:' || family AS curie FROM s JOIN m ON list_has_all(all_, members)), a AS (SELECT * FROM w UNION SELECT * FROM f)
SELECT array_to_string(curies, ',') AS curies, string_agg(curie, ',' ORDER BY curie) AS synonyms FROM a GROUP BY curies"""

CURATED = f"""{given("curation", "pubchem", "told", "assertions")},
b AS (SELECT * FROM curation WHERE ord < coalesce((SELECT min(ord) FROM curation WHERE Grounding IS NULL), 1 << 60)),
p AS (SELECT b.ord, b.Text AS text, b.Grounding <> '0' AS correct, replace(DB_Id1, 'GO:GO', 'GO') AS go, DB_Id2 AS pubchem, coalesce(x.chebi_id, DB_Id3) AS chebi FROM b LEFT JOIN pubchem x ON b.DB_Ns2 = 'PUBCHEM' AND x.id = b.DB_Id2),
r AS (SELECT p.*, t.db, t.id, CASE t.db WHEN 'GO' THEN go WHEN 'CHEBI' THEN chebi END AS own,
    (SELECT bool_or(a.right) FROM assertions a WHERE a.text = p.text AND a.db = t.db AND a.id = t.id) AS said FROM p JOIN told t USING (ord)),
e AS (SELECT ord, text, CASE WHEN coalesce(go, pubchem, chebi) IS NULL THEN 'ungrounded' WHEN correct THEN 'correct' ELSE 'incorrect' END AS old,
    CASE WHEN db IS NULL THEN 'ungrounded' WHEN said THEN 'correct' WHEN NOT said THEN 'incorrect' WHEN own = id AND correct THEN 'correct' WHEN own = id THEN 'incorrect' ELSE 'unknown' END AS new,
    concat_ws(',', 'CHEBI=' || chebi, 'GO=' || go, 'PUBCHEM=' || pubchem) AS db_refs FROM r)"""
MATRIX = f"""{CURATED}, q AS (SELECT o AS old, n AS new, (SELECT count(*) FROM e WHERE e.old = o AND e.new = n)::BIGINT AS n
    FROM (VALUES ('ungrounded'), ('correct'), ('incorrect')) a(o), (VALUES ('ungrounded'), ('unknown'), ('correct'), ('incorrect')) b(n))"""


def share(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) ELSE 0.0 END"


BOUNDS = f"""{MATRIX}, t AS (SELECT {', '.join(f"sum(n) FILTER (old = '{x}')::DOUBLE AS o_{x}" for x in ('ungrounded', 'correct', 'incorrect'))},
    {', '.join(f"sum(n) FILTER (new = '{x}')::DOUBLE AS n_{x}" for x in ('ungrounded', 'unknown', 'correct', 'incorrect'))} FROM q),
u AS (SELECT 'reference' AS trial, {share('o_correct', '(o_correct + o_incorrect)')} AS p, {share('o_correct', '(o_correct + o_ungrounded)')} AS r FROM t
    UNION ALL SELECT 'least', {share('n_correct', '(n_correct + n_incorrect + n_unknown)')}, {share('n_correct', '(n_correct + n_ungrounded)')} FROM t
    UNION ALL SELECT 'largest', {share('n_correct + n_unknown', '(n_correct + n_incorrect + n_unknown)')}, {share('n_correct + n_unknown', '(n_correct + n_unknown + n_ungrounded)')} FROM t)
SELECT trial, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 9) AS f1 FROM u"""

KEY = "doc, figure, text, start, stop"
NER = f"""{given("gold_spans", "found_spans")},
g AS (SELECT {KEY}, list_distinct(flatten(list([c1, c2]))) AS gs FROM gold_spans GROUP BY ALL),
f AS (SELECT {KEY}, list_distinct(flatten(list(list_filter([m1, m2], lambda x: x IS NOT NULL)))) AS fs FROM found_spans GROUP BY ALL),
h AS (SELECT coalesce(list_contains(gs, m1) OR list_contains(gs, m2), FALSE) AS hit, coalesce(list_contains(gs, m1), FALSE) AS top FROM found_spans LEFT JOIN g USING ({KEY})),
z AS (SELECT count(*) FILTER (NOT coalesce(list_contains(fs, c1) OR list_contains(fs, c2), FALSE)) AS fn FROM gold_spans LEFT JOIN f USING ({KEY})),
c AS (SELECT 'all' AS match_type, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fp, (SELECT fn FROM z) AS fn FROM h UNION ALL SELECT 'top', count(*) FILTER (top), count(*) FILTER (NOT hit), (SELECT fn FROM z) FROM h),
d AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM c)
SELECT match_type, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1 FROM d"""

CLASSES = " UNION ".join(f"SELECT DISTINCT id AS source_id, '{c}' AS class FROM tree WHERE tree_number = '{r}' OR starts_with(tree_number, '{r + '.' * (len(r) > 1)}')" for c, r in CLASS_ROOTS)

PROBABILITIES = f"""WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND text <> ''),
w AS (SELECT doc_id, regexp_extract_all(lower(text), '{PATTERN}') AS w FROM d),
a AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w), t AS (SELECT doc_id, f, count(*) AS tf FROM a GROUP BY ALL),
n AS (SELECT count(*) AS n FROM d), o AS (SELECT f, count(*) AS df FROM t GROUP BY f HAVING count(*) * 20 >= (SELECT n FROM n)),
v AS (SELECT doc_id, tf * ln((n + 1) / (df + 1)) AS x, ((len(f) * 7 + df) % 11 - 5) / 4.0 AS wa, ((len(f) * 7 + df * 3) % 11 - 5) / 4.0 AS wb FROM t JOIN o USING (f), n),
s AS (SELECT doc_id, sum(x * wa)::DOUBLE AS a, sum(x * wb)::DOUBLE AS b, sum(x * x)::DOUBLE AS q FROM v GROUP BY doc_id),
z AS (SELECT d.doc_id, 0.25 + CASE WHEN q > 0 THEN a / sqrt(q) ELSE 0 END AS a, -0.125 + CASE WHEN q > 0 THEN b / sqrt(q) ELSE 0 END AS b FROM d LEFT JOIN s USING (doc_id))
SELECT doc_id, round(1 / (1 + exp(b - a)), 7) AS probability FROM z"""

#: A word is what is left of a token without quotes, brackets and signs around it; all numbers are '#'.
ABBREVIATIONS = r"""WITH t AS (SELECT unnest(list_transform(regexp_extract_all(lower(text), '\S+'), lambda x: regexp_replace(regexp_replace(x, '^["''(\[{]+', ''), '["'')\]},;:?!]+$', ''))) AS t FROM documents WHERE text IS NOT NULL),
u AS (SELECT CASE WHEN regexp_full_match(t, '-?[0-9]+([.,][0-9]+)*\.?') THEN CASE WHEN suffix(t, '.') THEN '#.' ELSE '#' END ELSE t END AS t FROM t WHERE regexp_matches(t, '[\p{L}\p{N}]')),
v AS (SELECT t, suffix(t, '.') AND NOT suffix(t, '..') AS stop FROM u),
w AS (SELECT CASE WHEN stop THEN left(t, len(t) - 1) ELSE t END AS word, count(*) FILTER (stop) AS w, count(*) FILTER (NOT stop) AS o FROM v GROUP BY 1),
s AS (SELECT sum(w + o) AS n, sum(w) AS k FROM w), x AS (SELECT word, w, o, k / n AS p, len(word) - len(replace(word, '.', '')) AS d FROM w, s WHERE w > 0 AND regexp_matches(word, '\p{L}')),
y AS (SELECT *, len(word) - d AS c, 2 * (w * ln(0.99) + o * ln(0.01) - w * ln(p) - CASE WHEN o > 0 THEN o * ln(1 - p) ELSE 0 END) AS r FROM x)
SELECT word, w::BIGINT AS with_stop, o::BIGINT AS without, round(r * exp(-c) * (d + 1) * pow(c::DOUBLE, -o), 6) + 0.0 AS score FROM y"""


def sql() -> dict[str, str]:
    return {
        "sets_contained": CONTAINED,
        "synonym_sets": SYNONYMS,
        "curated_rows": f"{CURATED} SELECT ord, text, old, new, db_refs FROM e",
        "curated_matrix": f"{MATRIX} SELECT * FROM q",
        "curated_bounds": BOUNDS,
        "ner_evaluation": NER,
        "mesh_classes": f"{given('tree')} {CLASSES}",
        "mappings_by_descent": f"{given('mappable', 'tree')}, classes AS ({CLASSES}), {CANDIDATES} {chosen('cand')}",
        "model_probabilities": PROBABILITIES,
        "abbreviation_scores": ABBREVIATIONS,
    }
