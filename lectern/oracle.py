"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from .functions.fixed import FILE_TYPES, KNOWN_AUTHORS, NON_AUTHORS, TAXONOMY, TAXONOMY_ELSE, TITLE_PUBLISHERS
from .functions.metadata import TAXONOMY_FIELDS
from .operators.context import FOOT, HEAD, INSTRUCTION, NOTHING
from .queries import QUESTION, RAW

_RAW = RAW.replace("AS STRING", "AS VARCHAR")
_TITLES = f"titles AS (SELECT p_partkey, {_RAW} AS raw FROM part)"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _case(rows, test, value, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {test(r)} THEN {value(r)}" for r in rows) + f" ELSE {other} END"


_EXT = "|".join(sorted((x[1:] for x in FILE_TYPES), key=lambda x: (-len(x), x)))
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_NO_EXT = _STRIP.format(f"regexp_replace(raw, '(?i)([^./\\s])(\\s*\\.({_EXT}))+\\s*$', '\\1')")
_NO_COPY = f"""SELECT p_partkey, CASE WHEN regexp_matches(a, '^.+[\\s_]+[1-9]\\d?$') AND NOT list_contains(['volume','vol','part','pack','book','chapter','level','phase','step','grade','class','no','v','edition','issue'],
  lower(regexp_extract(replace(regexp_replace(a, '[\\s_]+[1-9]\\d?$', ''), '_', ' '), '(\\S+)\\s*$', 1))) THEN {_STRIP.format("regexp_replace(a, '[\\s_]+[1-9]\\d?$', '')")} ELSE a END AS title
  FROM (SELECT p_partkey, {_STRIP.format(f"regexp_replace({_NO_EXT}, '[\\s_]*\\([1-9]\\d?\\)$', '')")} AS a FROM titles)"""
_INFO = (
    "SELECT p_partkey, raw, ext, CASE WHEN ext = '.csv.docx' THEN 'Word (DOCX)' WHEN ext = '.tar.gz' THEN 'TAR.GZ Archive' "
    + " ".join(f"WHEN ext = {_q(k)} THEN {_q(v)}" for k, v in FILE_TYPES.items())
    + " WHEN regexp_matches(ext, '^\\.[^.]{1,4}$') THEN upper(substring(ext, 2)) ELSE 'Directory / Folder' END AS file_type FROM (SELECT p_partkey, raw, CASE WHEN lower(raw) LIKE '%.csv.docx' THEN '.csv.docx' WHEN lower(raw) LIKE '%.tar.gz' THEN '.tar.gz' ELSE lower(regexp_extract(raw, '^.+(\\.[^.]+)$', 1)) END AS ext FROM titles)"
)
_EDITION = """SELECT p_partkey, raw, coalesce(n, p, v, 1)::INT AS revision, CASE WHEN n IS NOT NULL THEN concat(n, CASE WHEN n BETWEEN 11 AND 13 THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END, ' Edition')
  WHEN p IS NOT NULL THEN concat('Pack ', p) WHEN v IS NOT NULL THEN concat('Version ', v, '.0') ELSE '1st Edition' END AS edition
  FROM (SELECT p_partkey, raw, nullif(regexp_extract(lower(raw), '\\b(\\d+)(?:st|nd|rd|th)\\s+(?:edition|ed)\\b', 1), '')::INT AS n, nullif(regexp_extract(lower(raw), '\\bpack[-_\\s]*(\\d+)\\b', 1), '')::INT AS p, nullif(regexp_extract(lower(raw), '\\bv(\\d+)\\b', 1), '')::INT AS v FROM titles)"""
_PUBLISHER = _case(TITLE_PUBLISHERS, lambda r: f"regexp_matches(concat(raw, ' ', raw), {_q('(?i)' + r[1])})", lambda r: _q(r[0]), "NULL")
_YEARS = "list_filter(regexp_extract_all({}, {}, 1), lambda y: y::INT BETWEEN 1950 AND 2030)"
_MEDIA_TESTS = (
    ("course", ("udemy", "bootcamp", "course", "tutorial")), ("pack", ("pack", "collection", "130+")), ("project", ("manifest", "specification", "architecture")),
    ("bom", ("bom", ".csv", "datasheet")), ("money", ("statement", "bill", "1040", "invoice")),
)


def _media(kind: str) -> str:
    any_ = {k: "(" + " OR ".join(f"contains(lower(concat(' ', raw)), {_q(w)})" for w in ws) + ")" for k, ws in _MEDIA_TESTS}
    flag = "(" + " OR ".join(f"contains(lower(raw), {_q(w)})" for w in ("bootcamp", "pack", "collection")) + ")"
    return f"""CASE WHEN {any_['course']} THEN 'Course / Video Series' WHEN {any_['pack']} THEN 'Collection / Resource Pack' WHEN {any_['project']} OR {kind} = 'Markdown' THEN 'Project Documentation / Manifest'
      WHEN {any_['bom']} THEN 'Hardware Specification / BOM' WHEN {any_['money']} THEN 'Financial Record / Document' WHEN {kind} = 'Directory / Folder' THEN 'Directory / Resource Pack' ELSE 'Book / Ebook' END AS media_type,
      CASE WHEN {any_['course']} THEN {flag}::INT WHEN {any_['pack']} THEN 1 WHEN {any_['project']} OR {kind} = 'Markdown' OR {any_['bom']} OR {any_['money']} THEN 0 WHEN {kind} = 'Directory / Folder' THEN 1 ELSE 0 END AS is_collection"""


def _taxonomy(field: int) -> str:
    return _case(TAXONOMY, lambda r: f"regexp_matches(lower(concat(' ', raw)), {_q('(?i)' + r[0])})", lambda r: _q(r[field + 1]), _q(TAXONOMY_ELSE[field]))


_HTML = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g')"
_ENT = "replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
_CLEAN = "regexp_replace(regexp_replace(regexp_replace(replace({}, chr(0), ' '), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
_DENSE = "list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"
_CATALOG = """SELECT s_suppkey AS id, s_name AS clean_title, concat('Title ', s_suppkey % 40, '.pdf') AS raw_title, CASE WHEN s_suppkey % 3 = 0 THEN concat('Author ', s_nationkey) END AS author, (s_suppkey % 2)::INT AS in_directory,
  CASE WHEN s_suppkey % 5 = 0 THEN concat('/d/', s_suppkey) END AS source_path, 'en' AS language, 1 AS revision, 'before' AS updated_at FROM supplier"""
_SIDES = """l AS (SELECT lower(concat(p_name, ' ', p_size + p_partkey % 5)) AS k, min(p_partkey) AS list_key FROM part GROUP BY k), r AS (SELECT lower(concat(p_name, ' ', p_size + p_partkey % 3)) AS k, max(p_partkey) AS dir_key FROM part GROUP BY k)"""
_STATUS = f"""WITH {_SIDES} SELECT coalesce(l.k, r.k) AS normalized_title, list_key, dir_key, CASE WHEN l.k IS NULL THEN 'unlisted' WHEN r.k IS NULL THEN 'missing' ELSE 'matched' END AS status FROM l FULL JOIN r ON l.k = r.k"""
_AND = "SELECT doc_id, round(0.1::DOUBLE * n, 6) AS rank FROM (SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_\\p{M}]+'), lambda w: w = 'and')) AS n FROM documents) WHERE n > 0 ORDER BY n DESC, doc_id LIMIT 20"
_BEST = f"(SELECT d.*, row_number() OVER (ORDER BY rank DESC, doc_id) AS n FROM documents d JOIN ({_AND.replace('LIMIT 20', 'LIMIT 12')}) USING (doc_id))"
_ENTRY = f"SELECT n, concat('--- [Passage ', n, '] 《', source, '》', CASE WHEN doc_id <> 0 THEN concat(' | p. ', doc_id) ELSE '' END, ' ---', chr(10), {_STRIP.format('text')}, chr(10)) AS entry FROM {_BEST}"
_LIBRARY = """c AS (SELECT vec_id AS chunk_id, label AS book_id, embedding, vec_id % 7 AS page_number, text AS content, n_name AS clean_title FROM embeddings LEFT JOIN documents ON vec_id = doc_id JOIN nation ON label = n_nationkey WHERE n_name ILIKE '%a%'),
  dv AS (SELECT c.*, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS s FROM c),
  sv AS (SELECT *, 0.1::DOUBLE * n AS rank FROM (SELECT *, len(list_filter(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_\\p{M}]+'), lambda w: w = 'and')) AS n FROM c) WHERE n > 0)"""


_ESTIMATE = "greatest(1, floor((floor(len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')) * 1.33::DOUBLE) + 1 + floor(length({0}) / 4.0) + 1) / 2.0))::INT"
_PARAS = f"list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\n\\s*\\n'), lambda x: {_STRIP.format('x')}), lambda x: x <> '')"
_SENTENCES = f"list_filter(list_transform(string_split(regexp_replace(para, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_STRIP.format('x')}), lambda x: x <> '')"
# units in order with the end of each in tokens; the state of a step is where the held units begin
_CHUNKS = f"""p AS (SELECT *, {_ESTIMATE.format('para')} AS size FROM (SELECT doc_id AS book_id, generate_subscripts(u, 1) AS j, unnest(u) AS para FROM (SELECT doc_id, {_PARAS} AS u FROM documents))),
  un AS (SELECT book_id, j, 0 AS k, para AS t, size AS n FROM p WHERE size <= 512
    UNION ALL SELECT book_id, j, k, t, {_ESTIMATE.format('t')} FROM (SELECT book_id, j, generate_subscripts(u, 1) AS k, unnest(u) AS t FROM (SELECT book_id, j, {_SENTENCES} AS u FROM p WHERE size > 512))),
  u AS (SELECT book_id, t, n, row_number() OVER o AS i, sum(n) OVER o AS upto FROM un WINDOW o AS (PARTITION BY book_id ORDER BY j, k)),
  tail AS (SELECT a.book_id, a.i + 1 AS i, arg_min(b.i, b.i) AS first, arg_min(b.upto - b.n, b.i) AS base FROM u a JOIN u b ON a.book_id = b.book_id AND b.i BETWEEN a.i - 64 AND a.i AND (a.i = b.i OR a.upto - (b.upto - b.n) <= 64) GROUP BY ALL),
  step AS (SELECT u.book_id, u.i, u.n, u.upto, first, base AS tail_base FROM u LEFT JOIN tail USING (book_id, i)),
  r AS (SELECT book_id, i, i AS low, 0::HUGEINT AS base, NULL::BIGINT AS full_low, NULL::HUGEINT AS full_tokens, upto FROM step WHERE i = 1
    UNION ALL SELECT x.book_id, x.i, CASE WHEN x.upto - r.base > 512 THEN greatest(r.low, x.first) ELSE r.low END, CASE WHEN x.upto - r.base > 512 THEN greatest(r.base, x.tail_base) ELSE r.base END,
      CASE WHEN x.upto - r.base > 512 THEN r.low END, CASE WHEN x.upto - r.base > 512 THEN r.upto - r.base END, x.upto FROM r JOIN step x ON x.book_id = r.book_id AND x.i = r.i + 1),
  ends AS (SELECT book_id, max(i) AS i, count(*) FILTER (full_tokens >= 30) AS emitted FROM r GROUP BY book_id),
  spans AS (SELECT book_id, full_low AS low, i - 1 AS high, full_tokens AS tokens FROM r WHERE full_tokens >= 30
    UNION ALL SELECT book_id, low, i, upto - base FROM r JOIN ends USING (book_id, i) WHERE upto - base >= 30 OR emitted = 0),
  chunks AS (SELECT book_id, (row_number() OVER (PARTITION BY book_id ORDER BY high, low) - 1)::INT AS chunk_index, content, 1 AS page_number, NULL::VARCHAR AS section_title, tokens::INT AS token_count, length(content)::INT AS char_count
    FROM (SELECT s.book_id, low, high, any_value(tokens) AS tokens, string_agg(t, chr(10) || chr(10) ORDER BY i) AS content FROM spans s JOIN u ON u.book_id = s.book_id AND u.i BETWEEN low AND high GROUP BY s.book_id, low, high))"""
_TOKENS = "(SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS place FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_\\p{M}]+') AS w FROM documents))"


def _two_terms(first: str, second: str) -> str:
    """Cover density of two terms: a minimal cover is a place of one with the nearest place of the other before it."""
    return f"""SELECT doc_id, round(rank, 6) AS rank FROM (SELECT doc_id, list_reduce(list(0.1::DOUBLE / (place - before) ORDER BY place), lambda a, b: a + b) AS rank
      FROM (SELECT doc_id, place, term, lag(place) OVER o AS before, lag(term) OVER o AS other FROM (SELECT doc_id, place, regexp_matches(w, {_q(first)}) AS term FROM {_TOKENS} WHERE regexp_matches(w, {_q(first)}) OR regexp_matches(w, {_q(second)}))
      WINDOW o AS (PARTITION BY doc_id ORDER BY place)) WHERE term <> other GROUP BY doc_id) AS ranked ORDER BY ranked.rank DESC, doc_id LIMIT 20"""


_RETITLED = """WITH c AS (SELECT p_partkey AS id, concat(p_name, ' ', p_partkey) AS t, p_brand AS author FROM part),
  a AS (SELECT c.id, c.t AS old, CASE WHEN c.id % 10 = 4 THEN h.t WHEN c.id % 6 = 0 THEN concat('Title ', c.id % 400) WHEN c.id % 6 = 2 THEN concat('part ', c.id) ELSE c.t END AS t FROM c LEFT JOIN c h ON h.id * 2 = c.id WHERE c.id % 2 = 0),
  l AS (SELECT a.id, a.t, coalesce(c.id, min(a.id) OVER (PARTITION BY a.t)) AS holder FROM a LEFT JOIN c ON a.t = c.t WHERE a.t <> a.old),
  x AS (SELECT id, t AS clean_title, holder FROM l WHERE holder <> id)"""


def _search_words() -> str:
    q = _STRIP.format("raw")
    for pattern in ("(?i)^Udemy\\s*-\\s*", "\\[[^\\]]+\\]", "(?i)\\b(\\d+)(?:st|nd|rd|th)\\s+(?:edition|ed)\\b", "(?i)\\b(?:pack|collection)[-_\\s]*\\d+\\b", "\\b(19\\d\\d|20\\d\\d)\\b"):
        q = f"regexp_replace({q}, {_q(pattern)}, '', 'g')"
    words = f"list_filter(regexp_split_to_array(regexp_replace({q}, '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 AND NOT regexp_full_match(w, '\\d+'))"
    never = "(?i)\\b(statement|invoice|bill|1040|tax|manifest|diagnostic\\s+ecosystem|bom|two\\s+kings\\s+manual|202403|202407|12251)\\b"
    rejected = f"regexp_full_match({_STRIP.format('raw')}, '[\\d\\s\\-_.]+') OR regexp_matches({_STRIP.format('raw')}, '(?i)^[0-9a-f]{{16,}}') OR regexp_matches({_STRIP.format('raw')}, {_q(never)})"
    return f"WITH {_TITLES} SELECT p_partkey, CASE WHEN NOT ({rejected}) AND len(w) >= 2 THEN array_to_string(w[1:6], ' ') END AS query FROM (SELECT p_partkey, raw, {words} AS w FROM titles)"


def _context(most: int) -> str:
    return f"SELECT coalesce(string_agg(entry, chr(10) ORDER BY n), {_q(NOTHING)}) AS context FROM (SELECT *, sum(length(entry)) OVER (ORDER BY n) AS used FROM ({_ENTRY})) WHERE n = 1 OR used <= {most}"


_FULL = {
    "catalog_count": "SELECT count(*) AS books FROM part",
    "catalog_head": "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 5",
    "verify_catalog": "SELECT sum(n)::BIGINT AS rows, count(*) FILTER (n > 1) AS duplicate_keys, sum(b)::BIGINT AS null_p_brand FROM (SELECT p_name, count(*) AS n, count(*) FILTER (p_brand IS NULL) AS b FROM part GROUP BY p_name)",
    "number_titles": "SELECT row_number() OVER (ORDER BY p_name, p_partkey) AS id, p_partkey FROM part",
    "first_titles": "SELECT p_name, p_partkey, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1",
    "reconcile_status": _STATUS,
    "reconcile_summary": f"SELECT m + x AS total_list, m + u AS total_dir, m AS matched, x AS missing_from_dir, u AS unlisted_in_dir, round(CASE WHEN m + x > 0 THEN m / (m + x) * 100 ELSE 0 END, 6) AS match_rate FROM (SELECT count(*) FILTER (status = 'matched') AS m, count(*) FILTER (status = 'missing') AS x, count(*) FILTER (status = 'unlisted') AS u FROM ({_STATUS}))",
    "list_missing": f"WITH {_SIDES} SELECT k AS normalized_title, list_key AS p_partkey FROM l WHERE k NOT IN (SELECT k FROM r)",
    "dir_unlisted": f"WITH {_SIDES} SELECT k AS normalized_title, dir_key AS p_partkey FROM r WHERE k NOT IN (SELECT k FROM l)",
    "sync_merge": f"""WITH {_SIDES}, s AS (SELECT coalesce(l.k, r.k) AS k, coalesce(list_key, dir_key) AS i, dir_key FROM l FULL JOIN r ON l.k = r.k), n AS (SELECT lower(p_name) AS low, any_value(p_name) AS p_name FROM part GROUP BY 1),
      t AS (SELECT concat(p_name, ' ', p_size) AS k, min(p_partkey) AS i FROM part GROUP BY 1), u AS (SELECT s.*, concat(p_name, regexp_extract(k, ' \\d+$')) AS title FROM s JOIN n ON low = regexp_replace(k, ' \\d+$', ''))
      SELECT coalesce(t.k, u.title) AS clean_title, CASE WHEN t.k IS NULL THEN concat('raw ', u.i) ELSE concat('old ', t.i) END AS raw_title, CASE WHEN u.dir_key IS NOT NULL THEN concat('/d/', u.dir_key) WHEN t.k IS NULL THEN 'list' ELSE 'old' END AS source_path,
      (u.dir_key IS NOT NULL)::INT AS in_directory, CASE WHEN u.k IS NULL THEN 'before' ELSE 'now' END AS updated_at FROM t FULL JOIN u ON t.k = u.title""",
    "sync_totals": f"SELECT count(*) FILTER (status = 'matched') AS matched_synced, count(*) FILTER (status = 'missing') AS missing_synced, count(*) FILTER (status = 'unlisted') AS unlisted_synced FROM ({_STATUS})",
    "reclean_merge": "SELECT p_name, min(p_partkey) AS p_partkey, arg_max(p_brand, p_partkey) FILTER (p_size % 2 = 0) AS brand, max(p_size % 2)::INT AS in_directory FROM part GROUP BY p_name",
    "enrich_collisions": f"{_RETITLED} SELECT * FROM x",
    "enrich_titles": f"{_RETITLED} SELECT c.id, CASE WHEN a.id IS NULL OR x.id IS NOT NULL THEN c.t ELSE coalesce(a.t, c.t) END AS clean_title, CASE WHEN a.id IS NULL THEN c.author ELSE 'new' END AS author FROM c LEFT JOIN a ON c.id = a.id LEFT JOIN x ON c.id = x.id",
    "graph_exact": "SELECT query, id, rank, round(s, 5) AS similarity FROM (SELECT q.vec_id AS query, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s, (row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id))::INT AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) WHERE rank <= 10",
    "catalog_upsert": "SELECT coalesce(a.p_partkey, b.k) AS p_partkey, coalesce(b.name, a.p_name) AS p_name, coalesce(b.size, a.p_size)::INT AS p_size FROM part a FULL JOIN (SELECT p_partkey * 3 AS k, upper(p_name) AS name, p_size + 100 AS size FROM part) b ON a.p_partkey = b.k",
    "stored_upsert": "SELECT coalesce(a.p_partkey, b.k) AS p_partkey, coalesce(b.name, a.p_name) AS p_name, coalesce(b.size, a.p_size)::INT AS p_size FROM part a FULL JOIN (SELECT p_partkey * 3 AS k, upper(p_name) AS name, p_size + 100 AS size FROM part) b ON a.p_partkey = b.k",
    "chunk_replace": "WITH x AS (SELECT doc_id % 50 AS book_id, doc_id AS chunk_id, n_chars FROM documents), f AS (SELECT book_id, chunk_id, -n_chars AS n_chars FROM x WHERE book_id % 10 = 4 AND chunk_id % 4 = 0) SELECT * FROM f UNION ALL SELECT * FROM x WHERE book_id NOT IN (SELECT book_id FROM f)",
    "dense_rounded": f"SELECT vec_id, round(s, 4) AS similarity FROM (SELECT vec_id, {_DENSE.replace('vec_id = 0', 'vec_id = 1')} AS s FROM embeddings e) ORDER BY s DESC, vec_id LIMIT 10",
    "seed_upsert": f"""WITH c AS ({_CATALOG}), r AS (SELECT s_suppkey AS place, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE concat('new ', s_name) END AS t, concat('seed ', s_suppkey) AS raw FROM supplier)
      SELECT coalesce(c.id, (SELECT max(id) FROM c) + r.place) AS id, coalesce(c.clean_title, r.t) AS clean_title, coalesce(r.raw, c.raw_title) AS raw_title, c.author, CASE WHEN c.id IS NULL THEN 0 ELSE c.in_directory END AS in_directory, c.source_path,
      'en' AS language, 1 AS revision, CASE WHEN r.t IS NULL THEN 'before' ELSE 'now' END AS updated_at FROM c FULL JOIN r ON c.clean_title = r.t""",
    "reclean_renumbered": f"""WITH n AS (SELECT * REPLACE (row_number() OVER (ORDER BY id) AS id, regexp_replace(raw_title, '\\.pdf$', '') AS clean_title) FROM ({_CATALOG}) WHERE id % 7 <> 0)
      SELECT min(id) AS id, clean_title, arg_max(raw_title, id) AS raw_title, arg_max(author, id) FILTER (author IS NOT NULL) AS author, max(in_directory) AS in_directory, arg_max(source_path, id) FILTER (source_path IS NOT NULL) AS source_path,
      'en' AS language, 1 AS revision, CASE WHEN count(*) > 1 THEN 'now' ELSE 'before' END AS updated_at FROM n GROUP BY clean_title""",
    "reclean_counts": "SELECT count(*) FILTER (s_suppkey % 7 <> 0) AS processed, count(*) FILTER (s_suppkey % 7 = 0) AS skipped, count(DISTINCT CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 40 END) AS titles FROM supplier",
    "ingest_guard": "SELECT s_suppkey + 1000 AS book_id, concat('/d/', s_suppkey) AS path FROM supplier WHERE s_suppkey % 10 = 0 AND s_suppkey % 4 <> 1",
    "ingest_report": "SELECT (SELECT count(*) FROM part) AS catalog_records_ingested, count(DISTINCT doc_id % 97) AS documents_chunked, count(*) AS total_chunks_ingested, 384 AS vector_dimension FROM documents",
    "catalog_introspection": "SELECT count(*) AS row_count, 9 AS total_columns, 'created_at, domain, edition, file_extension, file_type, genre, is_collection, key_concepts, media_type, published, publisher, subfield, subject, subtitle, summary, target_audience, topics, updated_at' AS wrong_columns, false AS valid FROM supplier",
    "lookup_answers": """WITH p AS (SELECT concat(lower(p_name), ' ', p_partkey) AS q, p_size % 4 IN (0, 3) AS near, p_brand FROM part), x AS (SELECT q, near AS ol, length(q) % 3 = 0 AS cr, p_brand, length(q) AS n FROM p)
      SELECT concat('k:', q) AS key, ol OR cr AS hit, CASE WHEN ol THEN CASE WHEN n % 2 = 0 THEN 'A, B, C' END WHEN cr THEN 'E' END AS author, CASE WHEN ol THEN (n + 1900)::VARCHAR WHEN cr THEN '2001' END AS published,
      CASE WHEN ol THEN p_brand WHEN cr THEN 'P' END AS publisher, CASE WHEN ol THEN 'en' END AS language, CASE WHEN ol AND n % 3 > 1 THEN (n % 3)::INT END AS revision, CASE WHEN ol THEN 'OpenLibrary' WHEN cr THEN 'Crossref' END AS source FROM x""",
    "isbn_answers": """SELECT concat('isbn:978', lpad(p_partkey::VARCHAR, 10, '0')) AS key, a OR b AS hit, CASE WHEN a OR b THEN p_name END AS title, CASE WHEN a THEN 'A' WHEN b THEN 'B' END AS author, CASE WHEN a THEN '1999' WHEN b THEN '2010' END AS published,
      CASE WHEN a THEN 'de' WHEN b THEN 'en' END AS language, CASE WHEN b AND NOT a THEN 'text' END AS summary, CASE WHEN a THEN 'OpenLibrary:ISBN' WHEN b THEN 'GoogleBooks:ISBN' END AS source
      FROM (SELECT *, p_partkey % 2 = 0 AS a, p_partkey % 3 = 0 AS b FROM part WHERE p_partkey % 5 <> 0)""",
    "ext_strip": f"WITH {_TITLES} SELECT p_partkey, {_NO_EXT} AS title FROM titles",
    "doubled_extension": f"WITH {_TITLES} SELECT p_partkey, CASE WHEN raw LIKE '%.pdf' THEN raw ELSE raw || '.pdf' END AS name FROM titles",
    "copy_suffix": f"WITH {_TITLES} {_NO_COPY}",
    "camel_split": f"WITH {_TITLES} SELECT p_partkey, regexp_replace(regexp_replace(raw, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g') AS title FROM titles",
    "file_info": f"WITH {_TITLES} SELECT p_partkey, file_type, CASE WHEN file_type = 'Directory / Folder' THEN '' ELSE ext END AS extension FROM ({_INFO})",
    "publisher": f"WITH {_TITLES} SELECT p_partkey, {_PUBLISHER} AS publisher FROM titles",
    "subtitle": f"WITH {_TITLES} SELECT p_partkey, CASE WHEN contains(raw, ':') THEN nullif({_STRIP.format("regexp_extract(raw, '^[^:]*:(.*)$', 1)")}, '') WHEN contains(raw, ' - ') AND lower(trim(split_part(raw, ' - ', 1))) NOT IN ('udemy', 'statement', '2024') THEN nullif({_STRIP.format("regexp_extract(raw, '^.*?\\s-\\s(.*)$', 1)")}, '') END AS subtitle FROM titles",
    "edition": f"WITH {_TITLES} SELECT p_partkey, revision, edition FROM ({_EDITION})",
    "published_year": f"WITH {_TITLES} SELECT p_partkey, coalesce(nullif(replace(regexp_extract(raw, '\\b((?:19\\d\\d|20\\d\\d)[-_](?:0[1-9]|1[0-2])[-_](?:0[1-9]|[12]\\d|3[01]))\\b', 1), '_', '-'), ''), {_YEARS.format("concat(' ', raw, ' ')", "'[\\(\\[\\s_-](19\\d\\d|20\\d\\d)[\\)\\]\\s_.-]'")}[-1], {_YEARS.format('raw', "'\\b(19\\d\\d|20\\d\\d)\\b'")}[-1]) AS published FROM titles",
    "author": f"""WITH {_TITLES}, g AS (SELECT *, trim(regexp_extract(raw, '^\\s*\\[([^\\]]+)\\]', 1)) AS tag FROM titles)
      SELECT p_partkey, CASE WHEN tag <> '' AND lower(tag) NOT IN ({", ".join(map(_q, NON_AUTHORS))}) AND NOT regexp_matches(lower(tag), 'http|www\\.|\\.com|\\.org') AND NOT regexp_matches(tag, '^\\d+$') THEN tag
      ELSE coalesce(nullif(regexp_extract(raw, '\\bby\\s+([A-Z][a-z]+(?:\\s+[A-Z][a-z.]+){{1,3}})\\b', 1), ''), {_case(KNOWN_AUTHORS, lambda r: f"regexp_matches(raw, {_q('(?i)' + chr(92) + 'b' + r[0] + chr(92) + 'b')})", lambda r: _q(r[1]), "NULL")}) END AS author FROM g""",
    "taxonomy": f"WITH {_TITLES} SELECT p_partkey, " + ", ".join(f"{_taxonomy(i)} AS {f}" for i, f in enumerate(TAXONOMY_FIELDS)) + " FROM titles",
    "media_class": f"WITH {_TITLES} SELECT p_partkey, {_media('file_type')} FROM ({_INFO})",
    "uninformative": f"""WITH {_TITLES}, s AS (SELECT p_partkey, trim(raw) AS w, trim(regexp_replace(trim(raw), '(.)\\.[^.]+$', '\\1')) AS s FROM titles)
      SELECT p_partkey, w = '' OR length(s) <= 2 OR regexp_matches(s, '^[\\d\\s\\-_.]+$') OR regexp_matches(s, '^\\d{{6,14}}$') OR regexp_matches(s, '^[0-9a-fA-F]{{16,}}$') OR regexp_matches(w, '^[0-9a-fA-F]{{16,}}$')
      OR regexp_matches(s, '(?i)^(book|ebook|document|doc|untitled|scan|file|temp|download|sample|test|pdf|free[-_]?learning)$') OR regexp_matches(w, '(?i)^(book|ebook|document|doc|untitled|scan|file|temp|download|sample|test|pdf|free[-_]?learning)$')
      OR regexp_matches(s, '(?i)^packt[-_]?\\d{{6,14}}$') AS uninformative FROM s""",
    "isbn_valid": "SELECT p_partkey, x AS isbn, regexp_matches(x, '^97[89]\\d{10}$') OR regexp_matches(x, '^\\d{9}[\\dX]$') AS valid FROM (SELECT p_partkey, upper(replace(concat('978-', lpad(p_partkey::VARCHAR, 9, '0'), CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'x' END, '-7'), '-', '')) AS x FROM part)",
    "isbn_find": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('9781', lpad(p_partkey::VARCHAR, 8, '1'), '9') END AS isbn FROM part",
    "title_jaccard": "SELECT a.p_partkey, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS similarity FROM (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '\\w+')) AS x FROM part) a JOIN (SELECT p_partkey - 1 AS p_partkey, list_distinct(regexp_extract_all(lower(p_name), '\\w+')) AS y FROM part) b ON a.p_partkey = b.p_partkey",
    "metadata_passage": "SELECT p_partkey, concat_ws(' | ', 'Title: ' || coalesce(nullif(p_name, ''), 'Unknown'), 'Author: ' || s_name, 'Publisher: ' || p_brand, 'Edition: ' || p_size, 'Genre: ' || p_type) AS passage FROM part LEFT JOIN supplier ON p_partkey = s_suppkey",
    "summary_text": f"""WITH {_TITLES}, x AS (SELECT *, {_PUBLISHER} AS pub, {_taxonomy(0)} AS domain, {_taxonomy(1)} AS subject, {_taxonomy(2)} AS subfield, {_taxonomy(3)} AS genre, {_media("'PDF'")} FROM ({_EDITION})),
      y AS (SELECT *, CASE WHEN pub IS NULL THEN '' ELSE ' from ' || pub END AS f FROM x)
      SELECT p_partkey, CASE WHEN contains(media_type, 'Collection') OR contains(media_type, 'Pack') THEN concat('Comprehensive resource bundle and reference collection focusing on ', raw, f, '. Covers key principles, curated documentation, and multi-part assets across ', subfield, ' within ', domain, '.')
      WHEN contains(media_type, 'Course') THEN concat('Structured educational course and instructional video curriculum covering ', raw, f, '. Designed to build practical mastery and hands-on proficiency in ', subfield, '.')
      WHEN contains(media_type, 'Documentation') THEN concat('System architecture blueprint and diagnostic specification for ', raw, '. Details functional protocols, instrumentation pipelines, and execution frameworks in ', domain, '.')
      WHEN contains(media_type, 'Financial') THEN concat('Official fiscal documentation and financial statement record regarding ', raw, '.')
      ELSE concat('A comprehensive ', lower(genre), ' on ', raw, ' (', edition, ')', f, '. Explores foundational principles, technical methodologies, and practical applications in ', subject, ' and ', subfield, '.') END AS summary FROM y""",
    "enrich_counts": "SELECT count(*) AS rows, 0::BIGINT AS online, count(*) AS local FROM part",
    "html_strip": f"SELECT page_id, {_CLEAN.format(_ENT.format(_HTML))} AS text FROM pages",
    "html_snippet": f"SELECT page_id, trim(regexp_replace({_ENT.format("regexp_replace(html, '<[^>]+>', ' ', 'g')")}, '\\s+', ' ', 'g')) AS text FROM pages",
    "html_unescaped": f"SELECT page_id, trim(regexp_replace({_ENT.format("regexp_replace(html, '<[^>]+>', ' ', 'g')")}, '\\s+', ' ', 'g')) AS text FROM pages",
    "html_heading": f"SELECT page_id, nullif({_CLEAN.format(_ENT.format("regexp_replace(regexp_extract(html, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1), '<[^>]+>', ' ', 'g')"))}, '') AS heading FROM pages",
    "token_estimate": "SELECT doc_id, (CASE WHEN length(text) > 0 THEN greatest(1, floor((floor(w * 1.33::DOUBLE) + 1 + floor(length(text) / 4.0) + 1) / 2.0)) ELSE 0 END)::INT AS tokens FROM (SELECT doc_id, text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM documents)",
    "search_words": _search_words(),
    "chunked_documents": f"WITH RECURSIVE {_CHUNKS} SELECT * FROM chunks",
    "embedded_chunks": f"""WITH RECURSIVE {_CHUNKS}, h AS (SELECT book_id, chunk_index, ('0x' || substring(sha256(w), 1, 16))::UBIGINT AS h FROM (SELECT book_id, chunk_index, unnest(regexp_split_to_array(lower(content), '\\s+')) AS w FROM chunks) WHERE w <> ''),
      v AS (SELECT book_id, chunk_index, (h % 384)::INT AS slot, sum(CASE WHEN h >= 9223372036854775808 THEN 1 ELSE -1 END)::DOUBLE AS x FROM h GROUP BY ALL)
      SELECT book_id, chunk_index, 384 AS dimension, 1.0::DOUBLE AS norm, round(sum((x / norm)::FLOAT::DOUBLE * (slot + 1)), 5) AS digest FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY book_id, chunk_index)) AS norm FROM v) GROUP BY book_id, chunk_index""",
    "markdown_sections": f"""WITH x AS (SELECT conv_id, turn, role, {_CLEAN.format('text')} AS body FROM conversations) SELECT conv_id, turn, 1 AS page_number, role AS section_title, length(body)::INT AS chars, md5(body) AS digest FROM x WHERE body <> ''
      UNION ALL SELECT conv_id, turn, CASE WHEN body <> '' THEN 2 ELSE 1 END, 'end', 3, md5('bye') FROM x""",
    # the published stemmer takes "ly" off after d, e and g, among others, but not after s
    "keyword_stemmed": _two_terms("^licens(e|es|ed|ing)$", "^on(es|(e|ed|ing)(ly)?)$"),
    "keyword_cover_density": _two_terms("^the$", "^and$"),
    "clean_text": f"SELECT doc_id, {_CLEAN.format("concat(text, chr(9), ' ', chr(10), chr(10), chr(10), chr(10), 'end  ')")} AS text FROM documents",
    "paragraph_units": f"SELECT doc_id, (generate_subscripts(u, 1) - 1)::INT AS n, unnest(u) AS unit FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, '.' || chr(10), '.' || chr(10) || ' ' || chr(10)), '\\n\\s*\\n'), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS u FROM documents)",
    "sentence_units": f"SELECT doc_id, (generate_subscripts(u, 1) - 1)::INT AS n, unnest(u) AS unit FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS u FROM documents)",
    "dense_topk": f"SELECT vec_id, round(s, 6) AS similarity FROM (SELECT vec_id, {_DENSE} AS s FROM embeddings e) ORDER BY s DESC, vec_id LIMIT 10",
    "dense_topk_filtered": f"SELECT vec_id, n_name AS domain, round(s, 6) AS similarity FROM (SELECT vec_id, n_name, {_DENSE} AS s FROM embeddings e JOIN nation ON label = n_nationkey WHERE n_name ILIKE '%a%') ORDER BY s DESC, vec_id LIMIT 10",
    "l2_normalize": "SELECT vec_id, CASE WHEN vec_id = 0 THEN 0.0 ELSE round(embedding[1]::DOUBLE * vec_id / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: (x * vec_id) * (x * vec_id)))), 6) END AS first, (CASE WHEN vec_id = 0 THEN 0.0 ELSE 1.0 END)::DOUBLE AS norm FROM embeddings",
    "hierarchical": "WITH b AS (SELECT label AS book_id, ["
    + ", ".join(f"round(avg(embedding[{i}]::DOUBLE), 9)" for i in range(1, 65))
    + f"] AS v FROM embeddings GROUP BY label), top AS (SELECT book_id FROM b ORDER BY list_cosine_similarity(v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, book_id LIMIT 3) SELECT vec_id, label::BIGINT AS book_id, round(s, 6) AS similarity FROM (SELECT vec_id, label, {_DENSE} AS s FROM embeddings e WHERE label IN (SELECT book_id FROM top)) ORDER BY s DESC, vec_id LIMIT 9",
    "keyword_single": _AND,
    "rrf_scores": "SELECT p_partkey, round(1.0::DOUBLE / (60 + p_partkey), 9) AS score, round(0.5::DOUBLE / (10 + p_partkey), 9) AS half FROM part",
    "hybrid_rrf": f"""WITH d AS (SELECT vec_id AS chunk_id, row_number() OVER (ORDER BY s DESC, vec_id) AS dense_rank FROM (SELECT vec_id, {_DENSE} AS s FROM embeddings e) ORDER BY s DESC, vec_id LIMIT 20),
      s AS (SELECT doc_id AS chunk_id, row_number() OVER (ORDER BY rank DESC, doc_id) AS sparse_rank FROM ({_AND}))
      SELECT chunk_id, dense_rank::INT AS dense_rank, sparse_rank::INT AS sparse_rank, round(score, 9) AS score FROM (SELECT coalesce(d.chunk_id, s.chunk_id) AS chunk_id, dense_rank, sparse_rank, coalesce(0.5::DOUBLE / (60 + dense_rank), 0) + coalesce(0.5::DOUBLE / (60 + sparse_rank), 0) AS score FROM d FULL JOIN s ON d.chunk_id = s.chunk_id)
      ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST LIMIT 5""",
    "chunk_search_dense": f"WITH {_LIBRARY} SELECT chunk_id, clean_title, page_number, round(s, 6) AS similarity FROM dv ORDER BY s DESC, chunk_id LIMIT 10",
    "chunk_search_sparse": f"WITH {_LIBRARY} SELECT chunk_id, clean_title, page_number, round(rank, 6) AS rank FROM sv ORDER BY n DESC, chunk_id LIMIT 10",
    "chunk_search_hybrid": f"""WITH {_LIBRARY}, a AS (SELECT chunk_id, clean_title, row_number() OVER (ORDER BY s DESC, chunk_id) AS dense_rank FROM dv QUALIFY dense_rank <= 20), b AS (SELECT chunk_id, clean_title, row_number() OVER (ORDER BY n DESC, chunk_id) AS sparse_rank FROM sv QUALIFY sparse_rank <= 20)
      SELECT chunk_id, clean_title, dense_rank::INT AS dense_rank, sparse_rank::INT AS sparse_rank, round(score, 9) AS score FROM (SELECT coalesce(a.chunk_id, b.chunk_id) AS chunk_id, coalesce(a.clean_title, b.clean_title) AS clean_title, dense_rank, sparse_rank, coalesce(0.5::DOUBLE / (60 + dense_rank), 0) + coalesce(0.5::DOUBLE / (60 + sparse_rank), 0) AS score FROM a FULL JOIN b ON a.chunk_id = b.chunk_id)
      ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST LIMIT 5""",
    "keyword_indexed": _AND,
    "keyword_stored": _AND,
    "keyword_stored_pair": _two_terms("^the$", "^and$"),
    "keyword_stored_replaced": _AND.replace("FROM documents", "FROM (SELECT doc_id, CASE WHEN doc_id % 50 % 7 = 3 THEN concat('and and ', text) ELSE text END AS text FROM documents WHERE doc_id % 50 % 7 <> 4)"),
    "citations": "SELECT doc_id, concat_ws(' | ', '《' || source || '》', 'by ' || lang, CASE WHEN doc_id % 2 = 1 THEN 'Section: intro' END, CASE WHEN doc_id % 3 = 1 THEN 'p. ' || doc_id END) AS citation FROM documents",
    "rag_context": _context(60_000),
    "rag_prompt": f"SELECT concat({_q(INSTRUCTION)}, chr(10), chr(10), {_q(HEAD)}, chr(10), context, chr(10), {_q(FOOT)}, chr(10), chr(10), 'User Question: {QUESTION}', chr(10), chr(10), 'Answer:') AS prompt FROM ({_context(8000)})",
    "embedding_cache_miss": "SELECT DISTINCT sha256(concat('m:', text)) AS key, length(text)::INT AS chars FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)",
}

ORACLE_SQL: dict[str, str] = dict(_FULL)
