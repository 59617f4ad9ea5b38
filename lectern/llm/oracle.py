"""DuckDB SQL for the registered queries that SQL can express.

Media files, trained fields, hashed models, best-fit bins and tokenizers have no SQL; their queries are tested
against brute force, exact round trips or held-out labels in ``tests/llm``.
"""

from __future__ import annotations

from itertools import permutations

from .audit import FILTERS, SYMBOLS, Limits
from .linededup import LEAST_WORDS
from .mixing import LANES, MOST_TIMES, PERCENT, SEED, WEIGHTS
from .neardup import PERCENT as PERCENT_NEAR
from .rules import HostRules
from .stamps import DAY, FIRST_DAY, LAST_DAY, MONTHS, PARTS, PATTERN, SECOND, SPACE, TIMES
from .urlfilter import ALPHABET, BIN, HELD, LOWER, MICRO, ORDER, RULES, UPPER

_WORD = r"[^\x20\x09-\x0D]+"
_R = HostRules()

_MIX = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(f"{x}::DOUBLE" for x in WEIGHTS)}][(k - 1) % {len(WEIGHTS)} + 1] AS w, {MOST_TIMES} * n AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, k) AS turn, (SELECT sum(n) * {PERCENT} / 100 FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  (SELECT sum(w) FROM w) - coalesce(sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS heavy FROM w),
c AS (SELECT coalesce(min(turn), 1 << 30) AS first_free FROM o WHERE NOT rest * w / heavy > cap),
f AS (SELECT rest, heavy FROM o, c WHERE turn = first_free),
t AS (SELECT source, n, CASE WHEN turn < first_free THEN cap::DOUBLE ELSE (SELECT rest FROM f)::DOUBLE * w / (SELECT heavy FROM f) END AS target FROM o, c),
r AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % {LANES}, doc_id) AS i FROM d WHERE size > 0),
u AS (SELECT source, ('0x' || substr(md5('{SEED}/' || coalesce(source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u FROM s)
SELECT d.doc_id, d.size::BIGINT AS size, t.n AS source_size, t.target, (CASE WHEN d.size > 0 THEN floor(t.target / t.n * r.i + u.u) - floor(t.target / t.n * (r.i - 1) + u.u) ELSE 0 END)::BIGINT * d.size AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN u ON d.source IS NOT DISTINCT FROM u.source LEFT JOIN r ON r.doc_id = d.doc_id
"""

_HOSTS = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT d.doc_id, d.source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN l ON d.doc_id = l.doc_id LEFT JOIN cov ON d.doc_id = cov.doc_id),
b AS (SELECT *, n_words < {_R.least_words} OR 100 * n_repeat_words > {_R.most_repeat_percent} * n_words AS base_failed, 100 * n_symbols > {_R.most_symbol_percent} * word_chars OR 100 * n_dup_lines > {_R.most_dup_line_percent} * n_lines AS odd FROM m),
h AS (SELECT source, count(*) AS docs, count(*) FILTER (base_failed OR odd) AS failures FROM b GROUP BY source),
p AS (SELECT least(greatest(sum(failures) / sum(docs), 1e-6), 1 - 1e-6) AS mean, count(*) - 1 AS k, sum(docs) AS docs, sum(failures * failures / docs) - sum(failures) * sum(failures) / sum(docs) AS raw, sum(docs * docs) AS squares FROM h),
e AS (SELECT mean, raw - k * mean * (1 - mean) AS spread, docs - squares / docs - k AS weight FROM p),
q AS (SELECT mean, CASE WHEN spread > 0 AND weight > 0 THEN least(greatest(mean * (1 - mean) * weight / spread - 1, 1), 1e6) ELSE 1e6 END AS strength FROM e),
v AS (SELECT source, (failures + mean * strength) / (docs + strength) AS rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= {_R.most_failures} AND (rate <= {_R.trusted_failures} OR NOT odd) AS kept FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""


def _url_sql() -> str:
    by_length = sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))
    fits = lambda r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r[1]}{r[2]}'" for r in by_length) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r[0]}'" for r in by_length) + " END"
    out = [
        f"u AS (SELECT page_id, coalesce(url, '') AS text, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)",
        f"j AS (SELECT *, {rule} AS rule, {verdict} AS by_rule FROM u)",
        f"t AS (SELECT text, count(*) FILTER (by_rule = 'allow') AS good, count(*) FILTER (by_rule = 'block') AS bad, ('0x' || substr(md5(text), 1, 8))::BIGINT % {HELD} = 0 AS held FROM j GROUP BY text)",
        f"e AS (SELECT text, CASE WHEN held THEN 0 ELSE good END AS good, CASE WHEN held THEN 0 ELSE bad END AS bad, substring(text || chr(10), greatest(1, i - {ORDER})::INT, least(i, {ORDER + 1})::INT) AS win FROM (SELECT *, unnest(range(1, length(text) + 2)) AS i FROM t))",
        f"x AS (SELECT win, sum(good)::BIGINT AS good, sum(bad)::BIGINT AS bad, {1.0 / ALPHABET}::DOUBLE AS p_good, {1.0 / ALPHABET}::DOUBLE AS p_bad FROM e GROUP BY win)",
    ]
    before = "x"
    for o in range(ORDER + 1):
        out.append(f"g{o} AS (SELECT right(win, {o + 1}) AS gram, left(right(win, {o + 1}), {o}) AS ctx, sum(good)::BIGINT AS good, sum(bad)::BIGINT AS bad FROM x WHERE length(win) > {o} GROUP BY 1, 2)")
        out.append(f"c{o} AS (SELECT ctx, sum(good)::BIGINT AS n_good, sum(bad)::BIGINT AS n_bad, count(*) FILTER (good > 0) AS t_good, count(*) FILTER (bad > 0) AS t_bad FROM g{o} GROUP BY ctx)")
        step = lambda k: f"CASE WHEN c.n_{k} > 0 THEN (g.{k} + c.t_{k} * y.p_{k}) / (c.n_{k} + c.t_{k}) ELSE y.p_{k} END AS p_{k}"
        out.append(f"y{o} AS (SELECT y.win, {step('good')}, {step('bad')} FROM {before} y LEFT JOIN g{o} g ON length(y.win) > {o} AND right(y.win, {o + 1}) = g.gram LEFT JOIN c{o} c ON g.ctx = c.ctx)")
        before = f"y{o}"
    out += [
        f"s AS (SELECT win, round(ln(p_good / p_bad) * {MICRO})::BIGINT AS score FROM {before})",
        f"m AS (SELECT t.text, t.good, t.bad, t.held, b.bin FROM t JOIN (SELECT text, floor(sum(score)::DOUBLE / count(*) / {BIN}) AS bin FROM e JOIN s ON e.win = s.win GROUP BY text) b ON t.text = b.text)",
        "h AS (SELECT bin, sum(good) AS good, sum(bad) AS bad FROM m WHERE held AND good + bad > 0 GROUP BY bin)",
        "k AS (SELECT bin, coalesce(lag(bin) OVER (ORDER BY bin), bin - 1) AS low, coalesce(sum(good) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lost, coalesce(sum(bad) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caught, sum(good) OVER () AS n_good, sum(bad) OVER () AS n_bad FROM h)",
        "z AS (SELECT floor((low + bin + 1) / 2) AS bin FROM k WHERE n_good > 0 AND n_bad > 0 ORDER BY lost / n_good + (n_bad - caught) / n_bad, low - bin, bin LIMIT 1)",
    ]
    out.append("n AS (SELECT coalesce(sum(good), 0) > 0 AND coalesce(sum(bad), 0) > 0 AS trained FROM m WHERE NOT held)")
    by_model = "CASE WHEN (SELECT trained FROM n) AND bin < coalesce((SELECT bin FROM z), 0) THEN 'block' ELSE 'allow' END"
    return "WITH " + ",\n".join(out) + f"\nSELECT page_id, host, path, rule, coalesce(by_rule, {by_model}) AS verdict FROM j JOIN m ON j.text = m.text"


_LINES = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
a AS (SELECT doc_id, unnest(range(len(ls))) AS raw, unnest(ls) AS line FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY raw) AS pos, sum(w) OVER (PARTITION BY doc_id ORDER BY raw) AS upto FROM (SELECT *, len(regexp_extract_all(line, '{_WORD}')) AS w FROM a) WHERE w > 0),
i AS (SELECT s.doc_id, s.pos, s.upto AS own, max(p.pos) AS last, string_agg(md5(p.line), '' ORDER BY p.pos) AS name FROM l s JOIN l p ON s.doc_id = p.doc_id AND p.pos >= s.pos AND p.upto - p.w - (s.upto - s.w) < {LEAST_WORDS}
  GROUP BY s.doc_id, s.pos, s.upto, s.w HAVING sum(p.w) >= {LEAST_WORDS}),
f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id, pos) > 1 AS later, count(*) OVER (PARTITION BY name) > 1 AS shared FROM i),
x AS (SELECT f.doc_id, f.pos, q.pos AS last, f.name || '/' || string_agg(md5(q.line), '') OVER (PARTITION BY f.doc_id, f.pos ORDER BY q.pos) AS name FROM f JOIN l q ON f.shared AND f.doc_id = q.doc_id AND q.pos > f.last AND q.upto - f.own < {LEAST_WORDS}),
y AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id, pos) > 1 AS later FROM x),
r AS (SELECT doc_id, pos, last FROM f WHERE later UNION ALL SELECT doc_id, pos, last FROM y WHERE later),
g AS (SELECT DISTINCT l.doc_id, l.raw FROM l JOIN r ON l.doc_id = r.doc_id AND l.pos BETWEEN r.pos AND r.last),
m AS (SELECT a.*, l.pos IS NOT NULL AS solid, g.raw IS NOT NULL AS gone FROM a LEFT JOIN l ON a.doc_id = l.doc_id AND a.raw = l.raw LEFT JOIN g ON a.doc_id = g.doc_id AND a.raw = g.raw),
b AS (SELECT *, last_value(CASE WHEN solid THEN gone END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY raw ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before, first_value(CASE WHEN solid THEN gone END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY raw ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM m),
k AS (SELECT doc_id, raw, line, coalesce(before, false) AND coalesce(after, false) AS del FROM b),
o AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (del) AS n_deleted, coalesce(string_agg(line, chr(10) ORDER BY raw) FILTER (NOT del), '') AS text FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(o.n_lines, 0)::BIGINT AS n_lines, coalesce(o.n_deleted, 0)::BIGINT AS n_deleted, o.text FROM d LEFT JOIN o ON d.doc_id = o.doc_id
"""

_NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_WORD}') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON p.x = a.doc_id JOIN n b ON p.y = b.doc_id WHERE 100 * c >= {PERCENT_NEAR} * (a.n + b.n - c)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT b.y, r.root FROM r JOIN b ON r.doc_id = b.x),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN c ON w.doc_id = c.doc_id LEFT JOIN n ON w.doc_id = n.doc_id
"""

_L = Limits()
_ORDERS = ", ".join(f"'{''.join(p)}'" for p in permutations(FILTERS))

_AUDIT = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
f AS (SELECT doc_id, part, [len(ws) < {_L.least_words}, 100 * len(list_distinct(ws)) < {_L.least_distinct_percent} * len(ws), 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > {_L.most_upper_percent} * length(x),
  regexp_matches(x, '[{SYMBOLS}]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false)] AS fails FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY part, fails),
o AS (SELECT unnest([{_ORDERS}]) AS filter_order),
s AS (SELECT filter_order, step, instr('{FILTERS}', substr(filter_order, step, 1)) AS own FROM o, (SELECT unnest(range(1, {len(FILTERS) + 1})) AS step)),
g AS (SELECT part, fails, n, good, toxic, filter_order, min(step) AS out_at FROM c, s WHERE fails[own] GROUP BY ALL),
t AS (SELECT c.part, c.fails, c.n, c.good, c.toxic, s.filter_order, s.step::INT AS step, s.own, coalesce(g.out_at, 99) AS out_at FROM c CROSS JOIN s LEFT JOIN g ON c.part = g.part AND c.fails = g.fails AND s.filter_order = g.filter_order),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (out_at > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (out_at = step), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails[own] AND out_at < step), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (fails[own] AND len(list_filter(fails, lambda b: b)) = 1), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (out_at = step), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (out_at = step), 0)::BIGINT AS toxic_lost FROM t GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""

_STAMPS = f"""
WITH t AS (SELECT row_number() OVER () AS r, stamp_id, source, zone, regexp_replace(raw, '^{SPACE}+|{SPACE}+\\z', '', 'g') AS x FROM stamps),
g AS (SELECT *, CASE WHEN regexp_full_match(x, '[0-9]{{10}}') THEN x::BIGINT * {SECOND} WHEN regexp_full_match(x, '[0-9]{{13}}') THEN x::BIGINT * 1000 END AS epoch_us,
  CASE WHEN regexp_matches(x, '{PATTERN}') THEN regexp_extract(x, '{PATTERN}', [{", ".join(f"'{n}'" for n in PARTS)}]) END AS g FROM t),
f AS (SELECT *, g.y5 <> '' AS slashed, try_cast(g.h AS INT) AS h, try_cast(g.i AS INT) AS i, coalesce(try_cast(g.s AS INT), 0) AS s,
  CASE WHEN g.y5 <> '' THEN try_cast(g.y5 || '-' || g.q || '-' || g.p AS DATE) WHEN g.b4 <> '' THEN try_cast(g.y4 || '-' || lpad(list_position([{", ".join(f"'{m}'" for m in MONTHS)}], g.b4)::VARCHAR, 2, '0') || '-' || g.d4 AS DATE) ELSE try_cast(g.y1 || g.y2 || g.y3 || '-' || g.m1 || g.m2 || g.m3 || '-' || g.d1 || g.d2 || g.d3 AS DATE) END AS day,
  CASE WHEN g.y5 <> '' THEN try_cast(g.y5 || '-' || g.p || '-' || g.q AS DATE) END AS other,
  CASE WHEN g.z <> '' THEN 0 WHEN g.sign <> '' THEN try_cast(g.sign AS INT) * 3600 + try_cast(left(g.sign, 1) || g.oi AS INT) * 60 END AS off FROM g),
k AS (SELECT *, CASE WHEN g.h = '' THEN 0 WHEN g.half = '' AND h <= 23 THEN h * 3600 + i * 60 + s WHEN g.half <> '' AND h BETWEEN 1 AND 12 THEN (h % 12 + CASE g.half WHEN 'P' THEN 12 ELSE 0 END) * 3600 + i * 60 + s END AS secs FROM f),
b AS (SELECT *, coalesce(epoch_us IS NULL AND (secs IS NULL OR (day IS NULL AND other IS NULL) OR (off IS NULL AND (zone IS NULL OR zone NOT IN (SELECT name FROM pg_timezone_names())))), true) AS bad FROM k),
v AS (SELECT source, count(*) FILTER (slashed AND day IS NOT NULL AND other IS NULL) AS dv, count(*) FILTER (slashed AND day IS NULL AND other IS NOT NULL) AS mv FROM b WHERE NOT bad GROUP BY source),
c AS (SELECT b.*, CASE WHEN NOT bad AND slashed AND day <> other THEN CASE WHEN mv > {TIMES} * dv THEN 'month' WHEN dv > {TIMES} * mv THEN 'day' ELSE 'default' END END AS how FROM b LEFT JOIN v ON b.source IS NOT DISTINCT FROM v.source),
w AS (SELECT *, epoch_us(CASE WHEN how = 'month' THEN other ELSE coalesce(day, other) END::TIMESTAMP) + secs::BIGINT * {SECOND} AS wall FROM c),
z AS (SELECT DISTINCT zone, (epoch_us(timezone(zone, make_timestamptz(d * {DAY * SECOND}))) - d * {DAY * SECOND}) // {SECOND} AS o FROM (SELECT DISTINCT zone FROM stamps WHERE zone IN (SELECT name FROM pg_timezone_names())), (SELECT unnest(range({FIRST_DAY}, {LAST_DAY + 1})) AS d)),
y AS (SELECT r, wall, o, (epoch_us(timezone(w.zone, make_timestamptz(wall - o * {SECOND}))) - wall + o * {SECOND}) // {SECOND} AS back FROM w JOIN z ON w.zone = z.zone WHERE NOT bad AND epoch_us IS NULL AND off IS NULL),
l AS (SELECT r, count(*) FILTER (o = back) AS n, min(o) FILTER (o = back) AS low FROM y GROUP BY r),
p AS (SELECT a.r, max(a.o) AS o FROM y a JOIN y b ON a.r = b.r AND a.back = b.o AND b.back = a.o AND a.o > b.o GROUP BY a.r)
SELECT stamp_id, CASE WHEN bad THEN NULL ELSE coalesce(epoch_us, wall - coalesce(off, low, p.o) * {SECOND}) END AS utc_us,
  CASE WHEN bad THEN 'bad' WHEN epoch_us IS NOT NULL THEN 'epoch' WHEN how IN ('month', 'day') THEN 'votes' WHEN how = 'default' THEN 'default' ELSE 'plain' END AS rule, how IS NOT NULL OR coalesce(n <> 1, false) AS ambiguous,
  CASE n WHEN 0 THEN 'gap' WHEN 1 THEN 'once' ELSE CASE WHEN n > 1 THEN 'overlap' END END AS wall
FROM w LEFT JOIN l ON w.r = l.r LEFT JOIN p ON w.r = p.r
"""

ORACLE_SQL: dict[str, str] = {"op4_source_mixing": _MIX, "op5_host_rules": _HOSTS, "op7_line_dedup": _LINES, "op8_url_filter": _url_sql(), "op9_minhash_neardup": _NEAR, "op12_filter_audit": _AUDIT, "op13_stamp_normalisation": _STAMPS}
