"""DuckDB SQL for source_queries, written independently of the DataFrame plans; only the derived rows are shared."""

from __future__ import annotations

from ..functions.vocab import AMINO_ACIDS, SUFFIXES, TYPOS
from ..operators.lexicon_ops import MANUAL_GO, MAPPING_CLASSES, MAPPING_PRIORITY
from .oracles import RANK, TERMS, lit, norm
from .source_queries import INPUTS

TABLES = ("part", "nation", "region", "supplier", "lineitem", "orders", "customer")


def given(*names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({INPUTS[n].format(**{t: t for t in TABLES})})" for n in names)


def items(x: str, sep: str = "|") -> str:
    return f"list_filter(string_split({x}, '{sep}'), lambda z: z <> '')"


def terms(rows: str) -> str:
    """rows with text, db, id, entry_name, status, source, organism, source_db, source_id."""
    columns = "text::VARCHAR AS text, db::VARCHAR AS db, id::VARCHAR AS id, entry_name::VARCHAR AS entry_name, status::VARCHAR AS status, source::VARCHAR AS source, organism::VARCHAR AS organism, source_db::VARCHAR AS source_db, source_id::VARCHAR AS source_id"
    return f"SELECT {norm('text')} AS norm_text, {columns} FROM ({rows}) WHERE trim(text) <> ''"


HGNC = f"""{given("hgnc")}, g AS (SELECT *, replace(hgnc_id, 'HGNC:', '') AS gid FROM hgnc),
live AS (SELECT * FROM g WHERE status <> 'Symbol Withdrawn'),
t AS (SELECT gid, symbol, unnest(list_distinct([symbol, name])) AS text, 'name' AS status, 'hgnc' AS source FROM live
    UNION ALL SELECT gid, symbol, unnest({items('aliases', ', ')}), 'synonym', 'hgnc' FROM live UNION ALL SELECT gid, symbol, unnest({items('previous', ', ')}), 'former_name', 'hgnc' FROM live
    UNION ALL SELECT gid, symbol, trim(unnest(string_split(alias_names, '"')[2:2])), 'synonym', 'synonym' FROM live WHERE alias_names <> ''
    UNION ALL SELECT gid, symbol, trim(regexp_replace(alias_names, '^"[^"]*",?', '')), 'synonym', 'synonym' FROM live WHERE alias_names <> ''),
u AS (SELECT text, 'HGNC' AS db, gid AS id, symbol AS entry_name, status, source FROM t
    UNION ALL SELECT w.symbol, 'HGNC', n.gid, n.symbol, 'former_name', 'hgnc' FROM g w JOIN g n ON w.status = 'Symbol Withdrawn' AND n.gid = regexp_extract(w.name, 'HGNC:(\\d+)', 1))
{terms("SELECT *, '9606' AS organism, NULL AS source_db, NULL AS source_id FROM u")}"""

CHEBI = f"""{given("chebi", "chebi_names", "chebi_primary")},
s AS (SELECT DISTINCT 'CHEBI:' || coalesce(p.primary_id, n.compound_id) AS id, n.name FROM chebi_names n LEFT JOIN chebi_primary p USING (compound_id)),
j AS (SELECT s.id, s.name, c.name AS standard FROM s JOIN chebi c USING (id)),
k AS (SELECT * FROM j WHERE NOT (contains(standard, '-') AND len(list_filter(string_split(standard, '-'), lambda z: NOT list_contains([{', '.join(lit(a.capitalize()) for a in AMINO_ACIDS)}], z))) = 0 AND regexp_full_match(name, '[A-Z-]+'))),
u AS (SELECT name AS text, id, name AS entry_name, 'name' AS status FROM chebi UNION ALL SELECT name, id, standard, 'synonym' FROM k
    UNION ALL SELECT unnest(list_distinct(list_filter({items('synonyms')}, lambda z: NOT contains(lower(z), 'ambiguous')))), id, name, 'synonym' FROM chebi)
{terms("SELECT *, 'CHEBI' AS db, 'chebi' AS source, NULL AS organism, NULL AS source_db, NULL AS source_id FROM u")}"""

MESH_ROWS = f"""m AS (SELECT a.id AS mid, a.name AS mname, a.synonyms, f.db AS fdb, f.id AS fid, f.name AS fname FROM mesh a LEFT JOIN (SELECT * FROM forward WHERE db NOT IN ('EFO', 'HP', 'DOID')) f ON a.id = f.mesh_id),
mt AS (SELECT mid, fdb, fid, coalesce(fname, mname) AS entry_name, mname AS text, CASE WHEN fdb IS NULL THEN 'name' ELSE 'synonym' END AS status FROM m
    UNION ALL SELECT mid, fdb, fid, coalesce(fname, mname), unnest({items('synonyms')}), 'synonym' FROM m),
mu AS (SELECT text, coalesce(fdb, 'MESH') AS db, coalesce(fid, mid) AS id, entry_name, status, 'mesh' AS source, NULL AS organism, CASE WHEN fdb IS NOT NULL THEN 'MESH' END AS source_db, CASE WHEN fdb IS NOT NULL THEN mid END AS source_id FROM mt)"""
GO_ROWS = f"""gt AS (SELECT id, name, name AS text, 'name' AS status FROM go UNION ALL SELECT id, name, text, 'synonym' FROM (SELECT id, name, unnest(list_distinct({items('synonyms')})) AS text FROM go)
    WHERE text <> name AND (NOT contains(name, 'activity') OR contains(text, 'activity'))),
gu AS (SELECT text, 'GO' AS db, id, name AS entry_name, status, 'go' AS source, NULL AS organism, NULL AS source_db, NULL AS source_id FROM gt)"""

FAMPLEX = f"""{given("famplex", "forward", "genes", "proteins", "labels_of")}, r AS (SELECT text, string_split(pairs, '|') AS p FROM famplex),
n AS (SELECT text, p, list_extract(list_filter(['FPLX', 'HGNC', 'UP', 'CHEBI', 'GO', 'MESH'], lambda z: list_contains(p[1:1], z) OR list_contains(p[3:3], z)), 1) AS ns FROM r),
k AS (SELECT text, ns, CASE WHEN p[1] = ns THEN p[2] ELSE p[4] END AS id FROM n WHERE ns IS NOT NULL),
u AS (SELECT text, CASE WHEN ns = 'UP' AND p.hgnc_id IS NOT NULL THEN 'HGNC' WHEN ns = 'MESH' AND f.db IS NOT NULL THEN f.db ELSE ns END AS db,
    CASE ns WHEN 'HGNC' THEN g.hgnc_id WHEN 'UP' THEN coalesce(p.hgnc_id, k.id) WHEN 'MESH' THEN coalesce(f.id, k.id) ELSE k.id END AS id,
    CASE ns WHEN 'FPLX' THEN k.id WHEN 'HGNC' THEN k.id WHEN 'UP' THEN coalesce(p.symbol, k.id) WHEN 'MESH' THEN coalesce(f.name, l.name) ELSE l.name END AS entry_name,
    CASE WHEN ns = 'HGNC' OR p.entry IS NOT NULL THEN '9606' END AS organism, CASE WHEN ns = 'MESH' THEN 'MESH' END AS source_db, CASE WHEN ns = 'MESH' THEN k.id END AS source_id
    FROM k LEFT JOIN genes g ON ns = 'HGNC' AND g.symbol = k.id LEFT JOIN proteins p ON ns = 'UP' AND p.entry = k.id LEFT JOIN labels_of l ON l.db = ns AND l.id = k.id LEFT JOIN forward f ON ns = 'MESH' AND f.mesh_id = k.id)
{terms("SELECT *, 'curated' AS status, 'famplex' AS source FROM u WHERE id IS NOT NULL")}"""

UNIPROT = f"""{given("uniprot", "gene_of")}, r AS (SELECT u.*, o.hgnc_id, o.symbol, string_split(u."primary", '; ') AS g, string_split(u.synonyms, '; ') AS s, split_part(u.names, ' (', 1) AS p1, rtrim(split_part(u.names, ' (', 2), ')') AS p2
    FROM uniprot u LEFT JOIN gene_of o USING (entry)),
q AS (SELECT *, len(g) > 1 AS many, CASE WHEN len(g) > 1 THEN p1 ELSE g[1] END AS first, hgnc_id IS NOT NULL AND len(g) = 1 AS ok FROM r),
z AS (SELECT *, CASE WHEN ok THEN symbol ELSE first END AS standard FROM q WHERE first <> ''),
t AS (SELECT *, standard AS text, 'name' AS status FROM z UNION ALL SELECT * FROM (SELECT *, unnest([p1, p2]) AS text, 'synonym' AS status FROM z) WHERE text <> standard
    UNION ALL SELECT * FROM (SELECT *, unnest(list_concat(list_filter(string_split(s[1], ' '), lambda w: w <> ''), CASE WHEN g[1] <> standard AND g[1] <> '' THEN [g[1]] ELSE [] END)) AS text, 'synonym' AS status FROM z WHERE NOT (organism = '9606' AND many)))
{terms("SELECT text, CASE WHEN ok THEN 'HGNC' ELSE 'UP' END AS db, CASE WHEN ok THEN hgnc_id ELSE entry END AS id, standard AS entry_name, status, 'uniprot' AS source, organism, CASE WHEN ok THEN 'UP' END AS source_db, CASE WHEN ok THEN entry END AS source_id FROM t")}"""

ADEFT = f"""{given("adeft")}, r AS (SELECT *, split_part(grounding, ':', 1) AS d, substr(grounding, len(split_part(grounding, ':', 1)) + 2) AS i FROM adeft WHERE contains(grounding, ':'))
SELECT DISTINCT * FROM ({terms("SELECT shortform AS text, d AS db, CASE WHEN d IN ('EFO', 'NCIT', 'OMIT') AND starts_with(i, d || ':') THEN substr(i, len(d) + 2) WHEN d IN ('BTO', 'HP', 'DOID') AND NOT starts_with(i, d || ':') THEN d || ':' || i ELSE i END AS id, name AS entry_name, 'synonym' AS status, 'adeft' AS source, NULL AS organism, NULL AS source_db, NULL AS source_id FROM r")})"""

def ontology(name: str, prefix: str) -> str:
    """Terms of one ontology, moved to MeSH or DOID where they are mapped."""
    upper, rest = prefix.upper(), " AND NOT starts_with(tid, 'BFO:')" if prefix == "efo" else ""
    return f"""{given(name, "mesh_names", "forward", "reverse", "doid")},
x AS (SELECT *, nullif(regexp_extract(xrefs, '(?:MESH|MSH):([A-Z]\\d+)', 1), '') AS xm, nullif(regexp_extract(xrefs, '(DOID:\\d+)$', 1), '') AS xd FROM {name}),
j AS (SELECT x.*, v.mesh_id AS am, v.mesh_name AS an, m.mesh_name AS mn, f.db AS fd, f.id AS fi, f.name AS fn, coalesce(d."primary", d.doid) AS di FROM x LEFT JOIN reverse v ON v.db = '{upper}' AND v.id = x.id LEFT JOIN mesh_names m ON m.mesh_id = xm
    LEFT JOIN (SELECT * FROM forward WHERE db NOT IN ('EFO', 'HP', 'DOID')) f ON f.mesh_id = xm LEFT JOIN doid d ON d.doid = xd),
k AS (SELECT j.*, e.doid_name AS dn, CASE WHEN am IS NOT NULL THEN 1 WHEN xm LIKE 'D%' AND mn IS NOT NULL THEN 2 WHEN xm IS NULL AND e.doid_name IS NOT NULL THEN 3 ELSE 4 END AS way FROM j LEFT JOIN doid e ON e.doid = di AND e.doid_name IS NOT NULL),
u AS (SELECT id AS oid, name AS oname, synonyms, CASE way WHEN 1 THEN 'MESH' WHEN 2 THEN coalesce(fd, 'MESH') WHEN 3 THEN 'DOID' ELSE '{upper}' END AS db, CASE way WHEN 1 THEN am WHEN 2 THEN coalesce(fi, xm) WHEN 3 THEN di ELSE id END AS tid,
    CASE way WHEN 1 THEN an WHEN 2 THEN coalesce(fn, mn) WHEN 3 THEN dn ELSE name END AS entry_name FROM k),
t AS (SELECT *, oname AS text, 'name' AS status FROM u UNION ALL SELECT * REPLACE (split_part(text, ' (formerly', 1) AS text) FROM (SELECT *, unnest(list_distinct({items('synonyms')})) AS text, 'synonym' AS status FROM u) WHERE NOT contains(lower(text), 'ambiguous'))
{terms(f"SELECT text, db, tid AS id, entry_name, status, '{prefix}' AS source, NULL AS organism, CASE WHEN db <> '{upper}' THEN '{upper}' END AS source_db, CASE WHEN db <> '{upper}' THEN oid END AS source_id FROM t WHERE TRUE{rest}")}"""


CANDIDATES = f"""one AS (SELECT key, db, id, arg_max(entry_name, rank * 1000000 + pos) AS name FROM (SELECT *, row_number() OVER (ORDER BY text) AS pos, 5 - ({RANK}) AS rank FROM (SELECT text AS key, * FROM mappable)) GROUP BY key, db, id),
mine AS (SELECT key, min(id) AS source_id, min(name) AS source_name FROM one WHERE db = 'MESH' GROUP BY key HAVING count(*) = 1),
cand AS (SELECT o.key, m.source_id, m.source_name, o.db, o.id, o.name FROM one o JOIN mine m USING (key) WHERE o.db <> 'MESH')"""
LOOSE = CANDIDATES.replace("text AS key", "norm_text AS key").replace("one AS", "one2 AS").replace("FROM one ", "FROM one2 ").replace("mine AS", "mine2 AS").replace("JOIN mine m", "JOIN mine2 m").replace("cand AS", "cand2 AS")
PLACE = "CASE db " + " ".join(f"WHEN {lit(p)} THEN {k}" for k, p in enumerate(MAPPING_PRIORITY, 1)) + " END"
CLASS = "CASE db " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in MAPPING_CLASSES.items()) + " END"


def chosen(of: str) -> str:
    ok = f"({CLASS} IS NULL OR EXISTS (SELECT 1 FROM classes k WHERE k.source_id = x.source_id AND k.class = {CLASS}))"
    return f"SELECT key, source_id, source_name, db, id, name FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {PLACE}) AS r FROM (SELECT *, count(*) OVER (PARTITION BY key, db) AS n FROM {of}) x WHERE n = 1 AND {PLACE} IS NOT NULL AND {ok}) WHERE r = 1"


AMBIGUOUS = """g AS (SELECT text, count(*)::BIGINT AS n_terms, count(DISTINCT (db, id))::BIGINT AS n_groundings, bool_or(status = 'name') AS nm, bool_or(status = 'curated') AS cu, bool_or(source = 'adeft') AS ad,
    count(DISTINCT lower(entry_name)) = 1 AS sm, bool_and(db IN ('HGNC', 'UP')) AND count(DISTINCT coalesce(organism, '')) = count(*) AS sp FROM ambiguous GROUP BY text)
SELECT text, n_terms, n_groundings FROM g WHERE n_terms >= 2 AND n_groundings > 1 AND NOT ad AND NOT sm AND NOT coalesce(sp, FALSE)"""
COMMON = "len(list_filter(range(1, least(len(lo), len(hi)) + 1), lambda k: lo[1:k] = hi[1:k]))"
ONE_TO_ONE = """p AS (SELECT DISTINCT *, lower(source_name) = lower(name) AS same FROM pairs),
l AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY source_id) AS n, sum(same::INT) OVER (PARTITION BY source_id) AS s FROM p) WHERE n = 1 OR (same AND s = 1)),
r AS (SELECT * FROM (SELECT * EXCLUDE (n, s), count(*) OVER (PARTITION BY db, id) AS n, sum(same::INT) OVER (PARTITION BY db, id) AS s FROM l) WHERE n = 1 OR (same AND s = 1))
SELECT source_id, source_name, db, id, name FROM r"""


def sql() -> dict[str, str]:
    golds = f"{given('groundings', 'edges')}, up AS (SELECT child, parent AS anc FROM edges UNION SELECT u.child, e.parent FROM up u JOIN edges e ON u.anc = e.child), r AS (SELECT k, gold, {items('found')} AS f FROM groundings)"
    meets = lambda x, y, loose: f"({x} = {y} OR EXISTS (SELECT 1 FROM up WHERE (child = {x} AND anc = {y})" + (f" OR (child = {y} AND anc = {x})" if loose else "") + "))"
    either = lambda loose: f"coalesce({meets('gold', 'f[1]', loose)}, FALSE) OR coalesce({meets('gold', 'f[2]', loose)}, FALSE)"
    typo = "CASE " + " ".join(f"WHEN raw = {lit(a)} THEN {lit(b)}" for a, b in TYPOS.items()) + " ELSE raw END"
    clean = f"replace(regexp_replace({typo}, '\\([a-zA-Z]+\\)$', ''), '_', ' ')"
    for s in SUFFIXES:
        clean = f"regexp_replace({clean}, '([^ ])({s})$', '\\1 \\2')"
    words = "words AS (SELECT raw, lower(context) AS c FROM asked)"
    out = {
        "hgnc_terms": HGNC,
        "chebi_terms": CHEBI,
        "mesh_terms": f"{given('mesh', 'forward')}, {MESH_ROWS} {terms('SELECT * FROM mu')}",
        "go_terms": f"{given('go')}, {GO_ROWS} {terms('SELECT * FROM gu')}",
        "famplex_terms": FAMPLEX,
        "uniprot_terms": UNIPROT,
        "adeft_terms": ADEFT,
        "obo_terms": ontology("ontology", "hp"),
        "efo_terms": ontology("ontology_efo", "efo"),
        "mapping_candidates": f"{given('mappable')}, {CANDIDATES} SELECT * FROM cand",
        "mappings_by_priority": f"{given('mappable', 'classes')}, {CANDIDATES} {chosen('cand')}",
        "mappings_built": f"""{given('mappable', 'classes')}, {CANDIDATES}, {LOOSE}, a AS (SELECT DISTINCT source_id, source_name, db, id, name FROM ({chosen('cand')})),
b AS (SELECT DISTINCT source_id, source_name, db, id, name FROM ({chosen('(SELECT * FROM cand2 WHERE len(key) > 6)')}) WHERE source_id NOT IN (SELECT source_id FROM a)), ab AS (SELECT * FROM a UNION ALL SELECT * FROM b),
h AS (SELECT m.id AS source_id, max(m.entry_name) AS source_name, 'GO' AS db, g.id, max(g.entry_name) AS name FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in MANUAL_GO)}) v(x, y) JOIN mappable m ON m.db = 'MESH' AND m.id = x JOIN mappable g ON g.db = 'GO' AND g.id = y GROUP BY m.id, g.id)
SELECT * FROM ab UNION ALL SELECT * FROM h WHERE source_id NOT IN (SELECT source_id FROM ab)""",
        "mappings_one_to_one": f"{given('pairs')}, {ONE_TO_ONE}",
        "mappings_overridden": f"""{given('pairs', 'positives', 'negatives')} SELECT source_id, db, id FROM (SELECT DISTINCT * FROM pairs) p WHERE NOT EXISTS (SELECT 1 FROM negatives n WHERE n.source_id = p.source_id AND n.db = p.db AND n.id = p.id)
    AND source_id NOT IN (SELECT source_id FROM positives) UNION ALL SELECT DISTINCT * FROM positives""",
        "ambiguities_flagged": f"{given('ambiguous')}, {AMBIGUOUS}",
        "ambiguities_strict": f"{given('ambiguous')}, {AMBIGUOUS} AND NOT nm AND NOT cu",
        "training_ambiguities": f"""{given('ambiguous', 'mesh_proteins', 'uses')}, g AS (SELECT text, count(DISTINCT (db, id)) AS n, count(DISTINCT (db, id)) FILTER (NOT (db = 'MESH' AND id IN (SELECT id FROM mesh_proteins))) AS k,
    bool_or(db = 'CHEBI' OR status IN ('name', 'curated') OR source = 'adeft' OR entry_name IS NULL) AS bad, min(entry_name) AS lo, max(entry_name) AS hi FROM ambiguous GROUP BY text)
SELECT g.text, k::BIGINT AS n_groundings, coalesce(u.n, 0)::BIGINT AS n FROM g LEFT JOIN uses u USING (text) WHERE g.n > 1 AND NOT bad AND k > 1 AND {COMMON} < 3""",
        "names_of": f"WITH {TERMS} SELECT DISTINCT text, id FROM terms WHERE db = 'NATION' AND ((id IN ('1', '5') AND status = 'name') OR id = '3')",
        "namespace_priority": f"""{given('priority_terms')} SELECT text AS raw, (row_number() OVER (PARTITION BY text ORDER BY CASE db WHEN 'FPLX' THEN 1 WHEN 'HGNC' THEN 2 WHEN 'UP' THEN 3 WHEN 'GO' THEN 4 WHEN 'EFO' THEN 5 ELSE 6 END, db, id))::INT AS rank, db, id, text FROM priority_terms""",
        "disambiguation_factors": f"""{given('asked', 'models')}, {words},
l AS (SELECT surface, kind, label, sum(weight) FILTER (feature IS NULL) AS b FROM models GROUP BY ALL),
z AS (SELECT w.raw, l.kind, l.label, l.b + coalesce((SELECT sum(m.weight) FROM models m WHERE m.surface = w.raw AND m.label = l.label AND m.feature IS NOT NULL AND list_contains(regexp_extract_all(w.c, '[a-z0-9]+'), m.feature)), 0) AS z FROM words w JOIN l ON l.surface = w.raw),
p AS (SELECT raw, kind, label, exp(z) / sum(exp(z)) OVER (PARTITION BY raw) AS p FROM z),
ids AS (SELECT DISTINCT surface AS raw, split_part(label, ':', 2) AS id FROM models WHERE label <> 'ungrounded'),
m AS (SELECT a.raw, unnest(['GO', 'UP', 'HP']) AS db, coalesce(i.id, 'none') AS id FROM asked a LEFT JOIN ids i USING (raw)),
k AS (SELECT m.*, (SELECT min(kind) FROM l WHERE surface = m.raw) AS kind, (SELECT p.p FROM p WHERE p.raw = m.raw AND p.label = m.db || ':' || m.id) AS own, (SELECT p.p FROM p WHERE p.raw = m.raw AND p.label = 'ungrounded') AS none FROM m)
SELECT raw, db, id, round(0.5::DOUBLE * CASE WHEN kind IS NULL THEN 1 WHEN own IS NOT NULL THEN own WHEN kind = 'adeft' THEN coalesce(none, 1) ELSE 0 END, 9) AS score, kind AS type, CASE WHEN kind IS NULL THEN NULL WHEN own IS NULL THEN 'ungrounded' ELSE 'grounded' END AS match FROM k""",
        "correctness": f"""{golds} SELECT k, coalesce(gold = f[1], FALSE) AS top_correct, list_contains(f, gold) AS exists_correct, coalesce({meets('gold', 'f[1]', False)}, FALSE) AS top_correct_family, {either(False)} AS exists_correct_family,
    coalesce({meets('gold', 'f[1]', True)}, FALSE) AS top_correct_loose, {either(True)} AS exists_correct_loose FROM r""",
        "namespace_breakdown": f"""{given('groundings')}, r AS (SELECT gold, {items('found')} AS f FROM groundings), c AS (SELECT count(*) FILTER (starts_with(f[1], 'A:3') AND gold = f[1])::BIGINT AS tp, count(*) FILTER (starts_with(f[1], 'A:3') AND gold <> f[1])::BIGINT AS fp, count(*) FILTER (starts_with(gold, 'A:3'))::BIGINT AS positives FROM r),
d AS (SELECT *, tp / (tp + fp) AS precision, tp / positives AS recall FROM c) SELECT tp, fp, positives, round(precision, 9) AS precision, round(recall, 9) AS recall, round(2 * precision * recall / (precision + recall), 9) AS f1 FROM d""",
        "crosstab_totals": """WITH c AS (SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F')::BIGINT AS F, count(*) FILTER (l_linestatus = 'O')::BIGINT AS O FROM lineitem GROUP BY 1)
SELECT l_returnflag, F, O, F + O AS Total FROM c UNION ALL SELECT 'Total', sum(F)::BIGINT, sum(O)::BIGINT, sum(F + O)::BIGINT FROM c""",
        "agreement_classes": f"""{given('entities')} SELECT CASE WHEN a IS NULL AND b IS NULL THEN 'ungrounded_ungrounded' WHEN a IS NULL THEN 'ungrounded_grounded' WHEN b IS NULL THEN 'grounded_ungrounded' WHEN a = b THEN 'grounded_matching' ELSE 'grounded_different' END AS agreement,
    count(*)::BIGINT AS n FROM entities GROUP BY 1""",
        "value_counts": "SELECT c_mktsegment, count(*)::BIGINT AS n FROM customer GROUP BY 1",
        "group_synonyms": "SELECT l_orderkey % 40 AS article, l_returnflag AS text, array_to_string(list_sort(list_distinct(list_concat(list(l_linenumber::VARCHAR), list(l_linestatus)))), ',') AS synonyms FROM lineitem GROUP BY 1, 2",
        "metabolite_names": f"WITH r AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '_') || 'acid(abc)' WHEN 1 THEN p_name || '/' || p_type ELSE 'stereamide' END AS raw FROM part) SELECT k, split_part({clean}, '/', 1) AS name FROM r",
    }
    columns = "norm_text, text, db, id, entry_name, status, source, organism, source_db, source_id"
    union = " UNION ALL ".join(f"SELECT {columns} FROM ({out[f'{k}_terms']})" for k in ("hgnc", "chebi", "mesh", "go", "famplex", "uniprot", "adeft", "obo"))
    order = f"-({RANK}), CASE WHEN lower(db) = lower(source) THEN 0 ELSE 1 END, norm_text NULLS FIRST, entry_name NULLS FIRST, status, source, organism NULLS FIRST"
    key = "db, id, coalesce(source_db, ''), coalesce(source_id, ''), text"
    out["all_terms"] = f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS n FROM ({union})) WHERE n = 1"
    return out
