"""DuckDB SQL with the rows of the registered queries."""

from __future__ import annotations

from ..functions.text import WHITE_SPACE

_WS = WHITE_SPACE.replace("'", "''")
_RAW = r"""
tokens AS (SELECT doc_id, regexp_extract_all(lower(concat_ws(' ', coalesce(source, 'None'), text)), '[A-Za-z0-9]+') AS w FROM documents),
doclen AS (SELECT doc_id, len(w) AS length FROM tokens),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM tokens) GROUP BY ALL),
sz AS (SELECT count(*) AS n, avg(length) AS avgdl FROM doclen),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raws AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw_idf FROM dfs, sz),
stats AS (SELECT term, df, raw_idf, CASE WHEN raw_idf < 0 THEN 0.25::DOUBLE * (SELECT avg(raw_idf) FROM raws) ELSE raw_idf END AS idf FROM raws),
posts AS (SELECT term, doc_id, tf, length, idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avgdl)) AS part FROM tf JOIN stats USING (term) JOIN doclen USING (doc_id), sz)"""


def _ranked(queries: str, top: int) -> str:
    return f"""{_RAW},
q AS ({queries}),
qt AS (SELECT id, term, count(*) AS times FROM (SELECT id, unnest(regexp_extract_all(lower(query), '[A-Za-z0-9]+')) AS term FROM q) GROUP BY ALL),
hits AS (SELECT id, doc_id, round(sum(times * part), 9) AS score FROM qt JOIN posts USING (term) GROUP BY ALL),
scored AS (SELECT q.id, d.doc_id, coalesce(h.score, 0.0) AS score FROM q CROSS JOIN (SELECT doc_id FROM documents) d LEFT JOIN hits h ON h.id = q.id AND h.doc_id = d.doc_id),
top AS (SELECT * FROM (SELECT id, doc_id, score, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scored) WHERE rank <= {top})"""


_ITEMS = "SELECT item_id AS id, text AS query, CASE WHEN item_id % 3 = 0 THEN 'REFUTES' ELSE 'SUPPORTS' END AS label FROM benchmark"
_TOP = _ranked(_ITEMS, 20)
_POST = _TOP + """,
share AS (SELECT (count(*) FILTER (quality = 1) + 1) / (count(*) + 2) AS p FROM labels),
post AS (SELECT top.id, rank, top.doc_id, score, q.label, p,
  CASE WHEN quality IS NULL THEN p ELSE (1 - score / (score + 10)) * p + score / (score + 10) * (quality = 1)::INT END AS e0,
  CASE WHEN quality IS NULL THEN 1 - p ELSE (1 - score / (score + 10)) * (1 - p) + score / (score + 10) * (quality <> 1)::INT END AS e1
  FROM top JOIN q USING (id) CROSS JOIN share LEFT JOIN labels USING (doc_id)),
eff AS (SELECT *, e0 - b0 AS x0, e1 - b1 AS x1, t0 - b0 AS d0, t1 - b1 AS d1 FROM (
  SELECT *, 0.999::DOUBLE * p + 0.0005::DOUBLE AS b0, 0.999::DOUBLE * (1 - p) + 0.0005::DOUBLE AS b1,
    CASE label WHEN 'SUPPORTS' THEN 0.999::DOUBLE + 0.0005::DOUBLE ELSE 0.0005::DOUBLE END AS t0, CASE label WHEN 'REFUTES' THEN 0.999::DOUBLE + 0.0005::DOUBLE ELSE 0.0005::DOUBLE END AS t1 FROM post)),
legacy AS (SELECT *, e0 - p AS x0, e1 - (1 - p) AS x1, (label = 'SUPPORTS')::INT - p AS d0, (label = 'REFUTES')::INT - (1 - p) AS d1 FROM post)"""


def _steps(source: str, name: str) -> str:
    """With two labels all effects are parallel: Theta(S) = d'd X / (lambda + X), X the sum of x'x over S."""
    return f""",
{name}_order AS (SELECT *, x0 * x0 + x1 * x1 AS xx, d0 * d0 + d1 * d1 AS dd, row_number() OVER (PARTITION BY id ORDER BY x0 * x0 + x1 * x1 DESC, rank) - 1 AS step FROM {source}),
{name}_sums AS (SELECT *, coalesce(sum(xx) OVER (PARTITION BY id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before FROM {name}_order),
{name} AS (SELECT *, dd * before / (0.01::DOUBLE + before) AS theta_before, dd * (before + xx) / (0.01::DOUBLE + before + xx) AS theta_after FROM {name}_sums)"""


_TEACH = _POST + _steps("eff", "walk") + _steps("legacy", "old") + """,
states AS (SELECT id, step, before FROM walk WHERE step < 4),
gains AS (SELECT s.id, s.step, w.doc_id, w.rank, w.score, w.label, w.p, w.e0, w.e1, w.step AS own, w.dd * (s.before + w.xx) / (0.01::DOUBLE + s.before + w.xx) - w.dd * s.before / (0.01::DOUBLE + s.before) AS gain
  FROM states s JOIN walk w ON w.id = s.id AND w.step >= s.step)"""


def _rows(source: str, stop: float | None = None) -> str:
    if stop is None:
        return f"""SELECT id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY step) AS selected, CASE WHEN count(*) >= 4 THEN 'top_m_reached' ELSE 'no_candidates' END AS stop_reason,
round(max_by(theta_after, step), 6) AS theta_final, CAST(NULL AS INT) AS stopped_at FROM {source} WHERE step < 4 GROUP BY id"""
    return f"""SELECT id, coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY step) FILTER (step < stopped), '') AS selected,
CASE WHEN min(stopped) < 4 AND min(stopped) < min(pool) THEN 'gain_below_threshold' WHEN min(stopped) >= 4 THEN 'top_m_reached' ELSE 'no_candidates' END AS stop_reason,
round(coalesce(max_by(theta_after, step) FILTER (step < stopped), 0.0), 6) AS theta_final, CAST(CASE WHEN min(stopped) < 4 AND min(stopped) < min(pool) THEN min(stopped) END AS INT) AS stopped_at
FROM (SELECT *, coalesce(min(CASE WHEN theta_after - theta_before < {stop} THEN step END) OVER (PARTITION BY id), 99) AS stopped_, least(coalesce(min(CASE WHEN theta_after - theta_before < {stop} THEN step END) OVER (PARTITION BY id), 99), 4) AS stopped, count(*) OVER (PARTITION BY id) AS pool FROM {source}) WHERE step < 4 GROUP BY id"""


_TRIM = lambda c: f"trim({c}, '{_WS}')"
_MENU = "'\n\nChoose the correct label:\nA. SUPPORTS\nB. REFUTES\n\nAnswer:'"
_HEAD = "'You are a fact verification model.\n\n'"


def _prompt(evidence: str) -> str:
    return f"{_HEAD} || CASE WHEN {evidence} IS NULL THEN '' ELSE 'Evidence:\n' || {_TRIM(evidence)} || '\n\n' END || 'Claim:\n' || {_TRIM('query')} || {_MENU}"


_BLOCK = """string_agg('[' || rank || '] ' || CASE WHEN coalesce(source, '') <> '' THEN 'Title: ' || source || chr(10) ELSE '' END || coalesce(text, ''), chr(10) || chr(10) ORDER BY rank)"""
_CHANCE = "(('0x' || substr(md5({0}), 1, 6))::INT % 1000 + 1) / 1002"
_PRED = f"""{_TOP},
blocks AS (SELECT id, query, label, {_BLOCK} AS e, count(*) AS num_docs, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS selected FROM top JOIN documents USING (doc_id) JOIN q USING (id) WHERE rank <= 4 GROUP BY id, query, label),
asked AS (SELECT *, {_prompt('e')} AS prompt FROM blocks),
probs AS (SELECT *, {_CHANCE.format('prompt')} AS p0 FROM asked),
preds AS (SELECT id, label AS gold, CASE WHEN p0 >= 1 - p0 THEN 'SUPPORTS' ELSE 'REFUTES' END AS pred, p0, CAST(num_docs AS INT) AS num_docs, CAST(length(e) AS INT) AS evidence_chars, selected FROM probs)"""

_ALONE = f"""{_TOP},
asked AS (SELECT id, label, {_prompt('CAST(NULL AS VARCHAR)')} AS prompt FROM q),
probs AS (SELECT *, {_CHANCE.format('prompt')} AS p0 FROM asked),
preds AS (SELECT id, label AS gold, CASE WHEN p0 >= 1 - p0 THEN 'SUPPORTS' ELSE 'REFUTES' END AS pred, p0 FROM probs)"""

_SCORED = f"""WITH {_TOP}, base AS (SELECT id, {_CHANCE.format(_prompt('CAST(NULL AS VARCHAR)'))} AS eta0 FROM q)
SELECT id, round(eta0, 6) AS eta0, CAST(rank - 1 AS INT) AS place, CAST(doc_id AS VARCHAR) AS doc_id, round({_CHANCE.format(_prompt('documents.text'))}, 6) AS eta FROM top JOIN documents USING (doc_id) JOIN q USING (id) JOIN base USING (id)"""

_LINES = rf"""
pages AS (SELECT doc_id, source, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS parts FROM documents WHERE coalesce(source, '') <> '' AND {_TRIM("coalesce(text, '')")} <> ''),
cut AS (SELECT doc_id, source, CASE WHEN parts[len(parts)] = '' THEN parts[1:len(parts) - 1] ELSE parts END AS parts FROM pages),
linewise AS (SELECT doc_id, source, generate_subscripts(parts, 1) - 1 AS place, unnest(parts) AS line FROM cut),
fields AS (SELECT *, string_split(line, chr(9)) AS f FROM linewise),
sentences AS (SELECT doc_id, source, place, CAST(CASE WHEN regexp_full_match({_TRIM('f[1]')}, '[+-]?[0-9]+') THEN coalesce(TRY_CAST({_TRIM('f[1]')} AS INT), place) ELSE place END AS INT) AS sentence_id,
  {_TRIM('CASE WHEN len(f) >= 2 THEN f[2] ELSE line END')} AS text FROM fields)"""

_CLAIMS = """raw AS (SELECT l.doc_id, d.text, CASE WHEN toxic = 1 AND quality = 1 THEN 'DISPUTED' WHEN toxic = 1 THEN 'NOT ENOUGH INFO' WHEN quality = 1 THEN 'SUPPORTS' ELSE 'REFUTES' END AS label FROM labels l JOIN documents d USING (doc_id))"""


def _flat(limit: int | None) -> str:
    cut = "" if limit is None else f"WHERE o <= (SELECT max(o) FROM (SELECT min(o) AS o FROM numbered GROUP BY id ORDER BY o LIMIT {limit}))"
    return f"""WITH numbered AS (SELECT l_orderkey AS id, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS o, CASE WHEN l_suppkey % 3 = 0 THEN 'NOT ENOUGH INFO' ELSE 'SUPPORTS' END AS label,
  'claim ' || l_partkey AS claim, l_suppkey % 7 AS ann, CASE WHEN l_partkey % 11 = 0 THEN -1 ELSE l_linenumber END AS ev, CASE WHEN l_linenumber <> 3 THEN 'page_' || (l_partkey % 50) END AS url, l_linenumber - 2 AS sent FROM lineitem),
rows AS (SELECT id, o, label, claim, CASE WHEN label = 'NOT ENOUGH INFO' OR url IS NULL OR sent < 0 THEN ann || ':' || ev || ':-:-' ELSE ann || ':' || ev || ':' || url || ':' || sent END AS item FROM numbered {cut}),
items AS (SELECT id, item, min(o) AS seen FROM rows GROUP BY ALL)
SELECT id, label, claim, CAST(n AS INT) AS n, evidence FROM (SELECT id, min_by(label, o) AS label, min_by(claim, o) AS claim FROM rows GROUP BY id) JOIN (SELECT id, count(*) AS n, string_agg(item, ';' ORDER BY seen) AS evidence FROM items GROUP BY id) USING (id)"""


def _selected(source: str, method: str) -> str:
    return f"""SELECT id, '{method}' AS method, label, CAST(count(*) OVER (PARTITION BY id) AS INT) AS num_docs, CASE WHEN count(*) OVER (PARTITION BY id) >= 4 THEN 'top_m_reached' ELSE 'no_candidates' END AS stop_reason, CAST(step AS INT) AS step, CAST(doc_id AS VARCHAR) AS doc_id, rank, round(score, 6) AS score, CAST((SELECT count(*) FROM top t WHERE t.id = s.id) - step AS INT) AS remaining FROM {source} s"""


_LSE = """, groups AS (SELECT id, step, score, gain, max(score) OVER w AS ts, max(gain) OVER w AS tg FROM gains WINDOW w AS (PARTITION BY id, step))"""
_MULTI = """, marked AS (SELECT id, step, score, gain, CASE WHEN gain > 0.01::DOUBLE THEN 'p' WHEN gain < 0.001::DOUBLE THEN 'n' ELSE 'o' END AS kind FROM gains),
parts AS (SELECT id, step, coalesce(avg(CASE kind WHEN 'p' THEN ln(1 + exp(-score)) WHEN 'n' THEN score + ln(1 + exp(-score)) END), 0) AS ce,
  sum(exp(0.5::DOUBLE * (score - 25))) FILTER (kind = 'n') AS zn, sum(exp(-0.5::DOUBLE * (score - 25))) FILTER (kind = 'p') AS zp,
  count(*) FILTER (kind = 'p') AS num_positive, count(*) FILTER (kind = 'n') AS num_negative, count(*) FILTER (kind = 'o') AS num_neutral FROM marked GROUP BY id, step),
multi AS (SELECT *, coalesce(ln(1 + zn * zp), 0) AS rank_loss, 0.5 * ce + 0.5 * coalesce(ln(1 + zn * zp), 0) AS total, num_positive > 0 AND num_negative > 0 AS valid FROM parts)"""

_COS = lambda a, b: f"CASE WHEN 2 * abs({a}) * abs({b}) <= 1e-12 THEN 0.0 ELSE CAST(sign({a}) * sign({b}) AS DOUBLE) END"
_H = lambda a, b: f"-(greatest(least({a}, 1.0), 1e-12) * ln(greatest(least({a}, 1.0), 1e-12)) + greatest(least({b}, 1.0), 1e-12) * ln(greatest(least({b}, 1.0), 1e-12)))"
_FEATURES = f"""{_TEACH},
shifts AS (SELECT *, e0 - p AS s0, e1 - (1 - p) AS s1 FROM gains),
chosen AS (SELECT s.id, s.step, w.e0 - w.p AS c0 FROM states s JOIN walk w ON w.id = s.id AND w.step < s.step),
means AS (SELECT id, step, avg(c0) AS m0, list(c0) AS cs FROM chosen GROUP BY id, step),
feats AS (SELECT sh.*, coalesce(m0, 0.0) AS m0, coalesce(list_max(list_transform(cs, lambda c: {_COS('s0', 'c')})), 0.0) AS closest, coalesce({_COS('s0', 'm0')}, 0.0) AS to_mean FROM shifts sh LEFT JOIN means USING (id, step))"""
_F = ["p", "1 - p", "e0", "e1", "s0", "s1", "abs(s0)", "abs(s1)", _H("p", "(1 - p)"), _H("e0", "e1"), f"{_H('p', '(1 - p)')} - {_H('e0', 'e1')}", "sqrt(s0 * s0 + s1 * s1)", "1.0::DOUBLE / rank", "score", "CAST(step AS DOUBLE)", "CAST(step AS DOUBLE)", "m0", "-m0", "closest", "to_mean"]

_BUILT = """, built AS (SELECT id, step, count(*) AS asked, count(*) FILTER (trim(coalesce(nullif(text, ''), source, '')) <> '') AS n FROM gains JOIN documents USING (doc_id) GROUP BY id, step)"""


def _chosen(top_m: int = 4, least: int = 1, threshold: float = -0.5) -> str:
    """The model's greedy choice, a step at a time: ds and cs hold the documents and shifts chosen so far."""
    base = f"""1.5::DOUBLE * e0 - 1.5::DOUBLE * e1 + 1.6::DOUBLE * abs(s0) + 0.1::DOUBLE * ({_H("e0", "e1")}) + 0.2::DOUBLE * ({_H("p", "(1 - p)")} - {_H("e0", "e1")}) + 0.5::DOUBLE * sqrt(2 * s0 * s0) + 0.3::DOUBLE / rank + 0.01::DOUBLE * score - 1"""
    sql = f"""{_POST}, shifts AS (SELECT *, e0 - p AS s0 FROM post), fixed AS (SELECT id, rank, doc_id, s0, {base} AS f FROM shifts),
sel0 AS (SELECT DISTINCT id, CAST([] AS BIGINT[]) AS ds, CAST([] AS DOUBLE[]) AS cs, 0 AS steps, 'no_candidates' AS reason, true AS open FROM fixed)"""
    for k in range(top_m):
        sql += f""",
ask{k} AS (SELECT x.id, x.rank, x.doc_id, x.s0, f - 0.05::DOUBLE * {k} + 0.4::DOUBLE * m0 + 0.1::DOUBLE * {_COS("x.s0", "m0")} - 0.4::DOUBLE * coalesce(list_max(list_transform(cs, lambda c: {_COS("x.s0", "c")})), 0.0) AS sc
  FROM fixed x JOIN (SELECT *, coalesce(list_avg(cs), 0.0) AS m0 FROM sel{k}) s ON x.id = s.id AND open AND NOT list_contains(ds, x.doc_id)),
best{k} AS (SELECT *, {k} >= {least} AND sc < {threshold} AS stop FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sc DESC, rank) AS nth FROM ask{k}) WHERE nth = 1),
sel{k + 1} AS (SELECT s.id, CASE WHEN b.stop = false THEN list_append(ds, b.doc_id) ELSE ds END AS ds, CASE WHEN b.stop = false THEN list_append(cs, b.s0) ELSE cs END AS cs, steps + (b.id IS NOT NULL)::INT AS steps,
  CASE WHEN b.stop THEN 'score_below_threshold' WHEN b.stop = false AND {k + 1} = {top_m} THEN 'top_m_reached' ELSE reason END AS reason, coalesce(NOT b.stop, false) AS open FROM sel{k} s LEFT JOIN best{k} b USING (id))"""
    return f"WITH {sql} SELECT id, CAST(len(ds) AS INT) AS num_docs, reason AS stop_reason, array_to_string(ds, ',') AS selected, CAST(steps AS INT) AS steps FROM sel{top_m}"


_TITLED = f"""CASE WHEN {_TRIM("coalesce(source, '')")} <> '' AND {_TRIM("coalesce(text, '')")} <> '' THEN {_TRIM('source')} || ': ' || {_TRIM('text')} ELSE {_TRIM("coalesce(source, '')")} || {_TRIM("coalesce(text, '')")} END"""
_TASK = "'\n\nTask:\nScore how useful the candidate evidence is as an additional evidence item for verifying the claim, considering the already selected evidence.'"


def _texts_chosen(top_m: int = 4, least: int = 2, threshold: float = 0.9) -> str:
    """A text scorer's greedy choice, a step at a time: ds, ts and ss hold the documents, their texts and the scores so far."""
    sql = f"""{_TOP}, docs AS (SELECT id, rank, doc_id, query, {_TITLED} AS t FROM top JOIN documents USING (doc_id) JOIN q USING (id)),
sel0 AS (SELECT id, CAST([] AS BIGINT[]) AS ds, CAST([] AS VARCHAR[]) AS ts, CAST([] AS DOUBLE[]) AS ss, 'no_candidates' AS reason, true AS open FROM q)"""
    for k in range(top_m):
        sql += f""",
ask{k} AS (SELECT d.id, d.rank, d.doc_id, d.t, 'Claim:\n' || substr(query, 1, 2000) || '\n\nCandidate evidence:\n' || substr(d.t, 1, 5000) || '\n\nAlready selected evidence:\n' ||
  CASE WHEN len(ts) = 0 THEN 'None' ELSE substr(array_to_string(list_transform(ts, lambda x, i: '[' || i || '] ' || x), chr(10)), 1, 5000) END || {_TASK} AS input FROM docs d JOIN sel{k} s ON s.id = d.id AND open AND NOT list_contains(ds, d.doc_id)),
order{k} AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sc DESC, rank) AS nth, count(*) OVER (PARTITION BY id) AS remaining FROM (SELECT *, {_CHANCE.format("input")} AS sc FROM ask{k})),
best{k} AS (SELECT *, {k} >= {least} AND sc < {threshold} AS stop FROM order{k} WHERE nth = 1),
sel{k + 1} AS (SELECT s.id, CASE WHEN b.stop = false THEN list_append(ds, b.doc_id) ELSE ds END AS ds, CASE WHEN b.stop = false THEN list_append(ts, b.t) ELSE ts END AS ts, CASE WHEN b.id IS NULL THEN ss ELSE list_append(ss, b.sc) END AS ss,
  CASE WHEN b.stop THEN 'score_below_threshold' WHEN b.stop = false AND {k + 1} = {top_m} THEN 'top_m_reached' ELSE reason END AS reason, coalesce(NOT b.stop, false) AS open FROM sel{k} s LEFT JOIN best{k} b USING (id))"""
    return sql


def _newton(steps: int = 5, penalty: float = 1.0) -> str:
    """Newton steps of a logistic regression on x1 and x2 with a shift; 3 x 3 systems by determinants."""
    sql = f"""{_FEATURES}, data AS (SELECT sqrt(s0 * s0 + s1 * s1) AS x1, 1.0::DOUBLE / rank AS x2, (own = step)::INT AS y FROM feats), n0 AS (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2)"""
    for k in range(steps + 1):
        sql += f""",
s{k} AS (SELECT b0, b1, b2, sum(greatest(m, 0) + ln(1 + exp(-abs(m))) - y * m) + {penalty / 2} * (b1 * b1 + b2 * b2) AS loss, sum(y - p) AS g0, sum((y - p) * x1) - {penalty} * b1 AS g1, sum((y - p) * x2) - {penalty} * b2 AS g2,
  sum(w) AS a, sum(w * x1) AS b, sum(w * x2) AS c, sum(w * x1 * x1) + {penalty} AS d, sum(w * x1 * x2) AS e, sum(w * x2 * x2) + {penalty} AS f
  FROM (SELECT *, p * (1 - p) AS w FROM (SELECT *, 1 / (1 + exp(-m)) AS p FROM (SELECT *, b0 + b1 * x1 + b2 * x2 AS m FROM data CROSS JOIN n{k}))) GROUP BY b0, b1, b2),
n{k + 1} AS (SELECT b0 + (g0 * (d * f - e * e) - b * (g1 * f - e * g2) + c * (g1 * e - d * g2)) / det AS b0, b1 + (a * (g1 * f - e * g2) - g0 * (b * f - e * c) + c * (b * g2 - g1 * c)) / det AS b1,
  b2 + (a * (d * g2 - g1 * e) - b * (b * g2 - g1 * c) + g0 * (b * e - d * c)) / det AS b2 FROM (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM s{k}))"""
    rows = " UNION ALL ".join(f"SELECT {k} AS step, * FROM s{k}" for k in range(steps + 1))
    return f"WITH {sql} SELECT CAST(step AS INT) AS step, round(b0, 6) AS shift, round(b1, 6) AS shift_norm, round(b2, 6) AS inverse_rank, round(loss, 5) AS loss FROM ({rows})"


_LOGIT = lambda token: f"(('0x' || substr(md5(prompt || '{token}'), 1, 6))::INT % 1000 / 250.0::DOUBLE - 2)"
_LOGITS = lambda name: " + ".join(f"exp({_LOGIT(t)})" for t in (name, " " + name, "\n" + name))

# Sentences stand for documents, their pages for titles.
_SENTENCES = _LINES.replace("source, string_split_regex", "'page_' || doc_id AS source, string_split_regex") + ", numbered AS (SELECT row_number() OVER (ORDER BY doc_id, place) AS number, source, sentence_id, text FROM sentences WHERE length(text) >= 5), passages AS (SELECT number AS doc_id, source, text FROM numbered)"
_CLAIMED = "SELECT DISTINCT doc_id AS id, substr(text, 1, 80) AS query, 'SUPPORTS' AS label FROM labels JOIN documents USING (doc_id) WHERE text IS NOT NULL"


def _recalled(upto: int) -> str:
    """Gold tuples of each claim (three sentence ids of its page) and those among the first ``upto`` candidates."""
    ranked = _ranked(_CLAIMED, 20).replace("FROM documents)", "FROM passages)").replace("FROM documents),", "FROM passages),").replace("text), '[A-Za-z0-9]+') AS w FROM documents", "text), '[A-Za-z0-9]+') AS w FROM passages")
    ranked = ranked.replace("JOIN documents USING (doc_id) WHERE text IS NOT NULL", "JOIN main.documents USING (doc_id) WHERE text IS NOT NULL")
    return f"""WITH {_SENTENCES}, {ranked},
gold AS (SELECT id, 'page_' || id AS page, unnest([0, 1, 2]) AS sentence FROM q),
met AS (SELECT top.id, n.source AS page, n.sentence_id AS sentence, min(top.rank) AS rank FROM top JOIN numbered n ON n.number = top.doc_id WHERE top.rank <= {upto} GROUP BY ALL),
recalled AS (SELECT id, count(*) AS gold, count(rank) AS found, min(rank) AS first_rank FROM gold LEFT JOIN met USING (id, page, sentence) GROUP BY id)"""


# The teacher's walk over the first three candidates, where every third document's text is blank.
_FEW = _TEACH.replace("FROM top JOIN q USING (id) CROSS JOIN share", "FROM (SELECT * FROM top WHERE rank <= 3) top JOIN q USING (id) CROSS JOIN share")
_USABLE = f""", built AS (SELECT id, step, count(*) AS asked, count(*) FILTER (doc_id % 3 <> 0 AND {_TRIM("coalesce(text, '')")} <> '') AS n FROM gains JOIN documents USING (doc_id) GROUP BY id, step)"""

ORACLES: dict[str, str] = {
    "select_with_text_model": f"WITH {_texts_chosen()} SELECT id, 'text_selector' AS method, CAST(len(ds) AS INT) AS num_docs, reason AS stop_reason, array_to_string(ds, ',') AS selected, array_to_string(list_transform(ss, lambda x: CAST(CAST(round(x * 1002) AS BIGINT) AS VARCHAR)), ',') AS scores FROM sel4",
    "text_model_candidates": f"WITH {_texts_chosen()} " + " UNION ALL ".join(f"SELECT o.id, {k} AS step, CAST(o.remaining AS INT) AS remaining, b.stop, CAST(o.nth - 1 AS INT) AS place, CAST(o.doc_id AS VARCHAR) AS doc_id, round(o.sc, 6) AS score FROM order{k} o JOIN best{k} b ON b.id = o.id WHERE o.nth <= 5" for k in range(4)),
    "fitted_pair": _newton(),
    "logit_posteriors": f"""WITH {_TOP}, asked AS (SELECT id, 0 AS place, {_prompt('CAST(NULL AS VARCHAR)')} AS prompt FROM q UNION ALL SELECT id, rank, {_prompt('documents.text')} FROM top JOIN documents USING (doc_id) JOIN q USING (id)),
read AS (SELECT id, place, {_LOGITS('A')} AS a, {_LOGITS('B')} AS b FROM asked)
SELECT id, CAST(place AS INT) AS place, CAST(6 AS INT) AS tokens, round(a / (a + b), 6) AS p0, round(b / (a + b), 6) AS p1 FROM read""",
    "evidence_recall": _recalled(20) + " SELECT id, gold, found, first_rank FROM recalled",
    "evidence_recall_summary": _recalled(5) + " SELECT count(*) AS claims, CAST(sum(gold) AS BIGINT) AS gold, CAST(sum(found) AS BIGINT) AS found, count(*) FILTER (found > 0) AS any_found, count(*) FILTER (found = gold) AS all_found, round(avg(found / gold), 6) AS mean_recall FROM recalled",
    "first_claims": f"""WITH {_CLAIMS}, placed AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS o FROM raw), kept AS (SELECT * FROM placed WHERE o <= 150 AND label IN ('SUPPORTS', 'REFUTES'))
SELECT 'fever2_train_' || lpad(CAST(row_number() OVER (ORDER BY o) AS VARCHAR), 8, '0') AS id, label, doc_id AS original_id FROM kept""",
    "corpus_of_first_pages": f"""WITH {_LINES}, kept AS (SELECT doc_id, source, place, sentence_id, text FROM sentences WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, source, 0, 0, {_TRIM('text')} FROM documents WHERE doc_id % 5 = 0 AND coalesce(source, '') <> '' AND {_TRIM("coalesce(text, '')")} <> '')
SELECT 'feverwiki_' || lpad(CAST(row_number() OVER (ORDER BY doc_id, place) AS VARCHAR), 8, '0') || '_sent_' || lpad(CAST(sentence_id AS VARCHAR), CAST(greatest(4, length(CAST(sentence_id AS VARCHAR))) AS INT), '0') AS doc_id, source AS title, CAST(length(text) AS INT) AS chars, sha256(text) AS sha FROM kept WHERE doc_id <= 300 AND length(text) >= 5""",
    "nested_round_trip": "SELECT row_number() OVER (ORDER BY coalesce(lang, 'none'), CAST(doc_id % 7 AS VARCHAR), doc_id) AS ord, doc_id, CAST(length(text) AS INT) AS chars, sha256(text) AS sha FROM documents",
    "written_metrics": f"""WITH {_PRED} SELECT 'metrics.v2' AS schema_version, (SELECT count(*) FROM preds) AS num_examples, (SELECT count(*) FILTER (pred = gold) FROM preds) AS num_correct, round((SELECT avg((pred = gold)::INT) FROM preds), 6) AS accuracy, l.label, count(gold) AS label_rows, count(*) FILTER (pred = gold) AS label_correct FROM (VALUES ('SUPPORTS'), ('REFUTES')) l(label) LEFT JOIN preds ON gold = l.label GROUP BY l.label""",
    "metrics_of_saved_predictions": f"""WITH {_PRED} SELECT count(*) AS num_examples, count(*) FILTER (pred = gold) AS num_correct, round(count(*) FILTER (pred = gold) / count(*), 6) AS accuracy, CAST(0 AS DOUBLE) AS avg_num_docs, CAST(0 AS DOUBLE) AS median_num_docs, CAST(0 AS INT) AS min_num_docs, CAST(0 AS INT) AS max_num_docs, CAST(0 AS DOUBLE) AS avg_evidence_chars, CAST(0 AS BIGINT) AS num_non_finite, count(*) FILTER (pred IS NULL) AS num_missing FROM preds""",
    "metrics_with_faults": f"""WITH {_PRED}, bad AS (SELECT gold, CASE WHEN id % 3 <> 0 THEN pred END AS pred, CASE WHEN id % 4 = 0 THEN 'nan'::DOUBLE WHEN id % 4 = 1 THEN '-inf'::DOUBLE ELSE p0 END AS p FROM preds)
SELECT count(*) AS num_examples, count(*) FILTER (pred = gold) AS num_correct, round(count(*) FILTER (pred = gold) / count(*), 6) AS accuracy, count(*) FILTER (isnan(p) OR isinf(p)) AS num_non_finite, count(*) FILTER (pred IS NULL) AS num_missing FROM bad""",
    "distribution_check": "WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings) SELECT vec_id, least(a, b, 1 - a - b) >= -1e-8 AS valid, 1 - a * a >= -1e-8 AS square_valid FROM e",
    "first_groups": f"WITH {_FEW}{_USABLE} SELECT id, CAST(step AS INT) AS step, CAST(n AS INT) AS candidates FROM built WHERE n >= 2 ORDER BY -id, step LIMIT 50",
    "group_stats_of_blank_texts": f"WITH {_FEW}{_USABLE} SELECT count(*) FILTER (n >= 2) AS groups, CAST(sum(asked - n) AS BIGINT) AS skipped_missing, count(*) FILTER (n < 2) AS skipped_small FROM built",
    "merged_repeats": f"""WITH {_TOP} SELECT id, CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN rank % 2 = 0 THEN 'again ' || doc_id ELSE source END AS title, CAST(length(text) AS INT) AS chars, CAST(CASE WHEN rank % 2 = 0 THEN rank + 100 ELSE rank END AS INT) AS rank FROM top JOIN documents USING (doc_id)""",
    "select_with_model": _chosen(),
    "prepare_claims": f"""WITH {_CLAIMS} SELECT 'fever2_train_' || lpad(CAST(row_number() OVER (ORDER BY doc_id) AS VARCHAR), 8, '0') AS id, 'fever2' AS dataset, 'train' AS split, text AS query, label, doc_id AS original_id, label AS original_label FROM raw WHERE label IN ('SUPPORTS', 'REFUTES')""",
    "claims_of_splits": f"""WITH {_CLAIMS}, claimed AS (SELECT 'train' AS split, doc_id AS o, text AS query, label FROM raw UNION ALL SELECT 'dev', item_id, text, CASE WHEN item_id % 3 = 0 THEN 'REFUTES' ELSE 'SUPPORTS' END FROM benchmark)
SELECT 'fever2_' || split || '_' || lpad(CAST(row_number() OVER (PARTITION BY split ORDER BY o) AS VARCHAR), 8, '0') AS id, split, query, label FROM claimed WHERE label IN ('SUPPORTS', 'REFUTES')""",
    "claim_stats": f"""WITH {_CLAIMS} SELECT count(*) AS read, count(*) FILTER (label IN ('SUPPORTS', 'REFUTES')) AS kept, count(*) FILTER (label = 'NOT ENOUGH INFO') AS dropped, count(*) FILTER (label = 'DISPUTED') AS skipped FROM raw""",
    "sentence_corpus": f"""WITH {_LINES} SELECT 'feverwiki_' || lpad(CAST(row_number() OVER (ORDER BY doc_id, place) AS VARCHAR), 8, '0') || '_sent_' || lpad(CAST(sentence_id AS VARCHAR), CAST(greatest(4, length(CAST(sentence_id AS VARCHAR))) AS INT), '0') AS doc_id, source AS title, text, sentence_id FROM sentences WHERE length(text) >= 5""",
    "corpus_stats": f"""WITH {_LINES}, per AS (SELECT d.doc_id, count(*) FILTER (length(s.text) >= 5) AS ok, count(*) FILTER (length(s.text) < 5) AS short FROM documents d LEFT JOIN sentences s USING (doc_id) GROUP BY d.doc_id)
SELECT count(*) AS pages, CAST(sum(ok) AS BIGINT) AS passages, CAST(sum(short + (ok = 0)::INT) AS BIGINT) AS skipped FROM per""",
    "claims_from_flat_evidence": _flat(None),
    "claims_from_first_evidence": _flat(100),
    "term_stats": f"WITH {_RAW} SELECT term, df, round(raw_idf, 6) AS raw_idf, round(idf, 6) AS idf FROM stats",
    "postings": f"WITH {_RAW} SELECT term, doc_id AS doc_ord, tf, CAST(length AS INT) AS length, round(part, 6) AS part FROM posts",
    "bm25_top_n": f"WITH {_TOP} SELECT id, rank, doc_id AS doc_ord, round(score, 6) AS score FROM top",
    "bm25_padded": "WITH "
    + _ranked("SELECT id, min_by(term, (df, term)) AS query FROM (SELECT item_id AS id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9]+')) AS term FROM benchmark) JOIN dfs USING (term) GROUP BY id", 20)
    + " SELECT id, rank, doc_id AS doc_ord, round(score, 6) AS score FROM top",
    "bm25_nested": f"""WITH {_TOP} SELECT id, label, 'test' AS split, CAST(count(*) AS INT) AS n, string_agg(rank || '|' || doc_id || '|' || CAST(round(score * 1000000) AS BIGINT) || '|' || source || '|' || length(text), ';' ORDER BY rank) AS candidates FROM top JOIN documents USING (doc_id) JOIN q USING (id) GROUP BY id, label""",
    "retrieval_recall": f"WITH {_TOP} SELECT count(*) AS gold, count(t.rank) AS found FROM q LEFT JOIN top t ON t.id = q.id AND t.doc_id = q.id",
    "posterior_from_logits": f"""WITH z AS (SELECT vec_id, list_transform([embedding[1:3], embedding[4:6], embedding[7:9]], lambda g: ln(list_sum(list_transform(g, lambda v: exp(v::DOUBLE))))) AS l FROM embeddings),
e AS (SELECT vec_id, exp(l[1]) AS a, exp(l[2]) AS b, exp(l[3]) AS c FROM z), p AS (SELECT vec_id, a / (a + b + c) AS p0, b / (a + b + c) AS p1, c / (a + b + c) AS p2 FROM e)
SELECT vec_id, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2, true AS valid, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'a' WHEN p1 >= p2 THEN 'b' ELSE 'c' END AS best, round(-(p0 * ln(p0) + p1 * ln(p1) + p2 * ln(p2)), 6) AS entropy FROM p""",
    "score_posteriors": f"{_SCORED} WHERE rank <= 5",
    "score_all_posteriors": _SCORED,
    "resumed_posteriors": _SCORED,
    "prompts_all": f"""WITH {_TOP}, asked AS (SELECT id, 0 AS place, {_prompt('CAST(NULL AS VARCHAR)')} AS prompt FROM q UNION ALL SELECT id, rank, {_prompt('documents.text')} FROM top JOIN documents USING (doc_id) JOIN q USING (id))
SELECT id, CAST(place AS INT) AS place, CAST(length(prompt) AS INT) AS chars, sha256(prompt) AS sha FROM asked""",
    "jsonl_round_trip": "SELECT row_number() OVER (ORDER BY doc_id) AS ord, doc_id, CAST(quality AS INT) AS quality, CAST(toxic AS INT) AS toxic FROM labels",
    "page_shards": "SELECT source AS id, '' AS text, CAST(length(text) AS INT) AS chars, sha256(text) AS sha FROM documents",
    "no_evidence_predictions": f"WITH {_ALONE} SELECT id, gold, pred, pred = gold AS correct, round(p0, 6) AS p0, CAST(0 AS INT) AS num_docs, CAST(0 AS INT) AS evidence_chars, '' AS selected, 'no_evidence' AS method FROM preds",
    "no_evidence_metrics": f"""WITH {_ALONE} SELECT count(*) AS num_examples, count(*) FILTER (pred = gold) AS num_correct, round(count(*) FILTER (pred = gold) / count(*), 6) AS accuracy, CAST(0 AS DOUBLE) AS avg_num_docs, CAST(0 AS DOUBLE) AS median_num_docs, CAST(0 AS INT) AS min_num_docs, CAST(0 AS INT) AS max_num_docs, CAST(0 AS DOUBLE) AS avg_evidence_chars, count(*) FILTER (isinf(p0) OR isnan(p0)) AS num_non_finite, count(*) FILTER (pred IS NULL) AS num_missing FROM preds""",
    "recovered_predictions": f"WITH {_PRED.replace('rank <= 4', 'rank <= 2')} SELECT id, gold, pred, pred = gold AS correct, round(p0, 6) AS p0, num_docs, evidence_chars, selected, 'naive_topm' AS method FROM preds",
    "confusion_of_seen_labels": f"""WITH {_PRED}, names AS (SELECT gold AS label FROM preds UNION SELECT pred FROM preds) SELECT g.label AS gold, p.label AS pred, count(x.id) AS n FROM names g CROSS JOIN names p LEFT JOIN preds x ON x.gold = g.label AND x.pred = p.label GROUP BY ALL""",
    "candidate_count": f"WITH {_POST} SELECT count(DISTINCT id) AS rows, count(*) AS candidates FROM post",
    "pending_rows": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "duplicate_ids": "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1",
    "unexpected_ids": "SELECT DISTINCT doc_id * 2 AS doc_id FROM labels WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)",
    "prompts": f"""WITH {_ranked(_ITEMS, 3)}, asked AS (SELECT id, 0 AS place, {_prompt('CAST(NULL AS VARCHAR)')} AS prompt FROM q UNION ALL SELECT id, rank, {_prompt('documents.text')} FROM top JOIN documents USING (doc_id) JOIN q USING (id))
SELECT id, CAST(place AS INT) AS place, CAST(length(prompt) AS INT) AS chars, sha256(prompt) AS sha FROM asked""",
    "local_effects": f"WITH {_POST} SELECT id, CAST(doc_id AS VARCHAR) AS doc_id, round(d0, 6) AS d0, round(x0, 6) AS x0, round(x1, 6) AS x1, round(x0 * d0 + x1 * d1, 6) AS alignment, round(sqrt(x0 * x0 + x1 * x1), 6) AS norm_x FROM eff",
    "first_step_gain": f"WITH {_POST} SELECT id, CAST(doc_id AS VARCHAR) AS doc_id, round((x0 * d0 + x1 * d1) ** 2 / (x0 * x0 + x1 * x1 + 0.01::DOUBLE), 6) AS gain FROM eff",
    "teacher_steps": f"WITH {_TEACH} SELECT id, CAST(step AS INT) AS step, CAST(doc_id AS VARCHAR) AS doc_id, CAST(rank - 1 AS INT) AS best_index, round(theta_after - theta_before, 6) AS gain, round(theta_after, 6) AS theta_after FROM walk WHERE step < 4",
    "teacher_rows": f"WITH {_TEACH} {_rows('walk')}",
    "teacher_legacy_smoothing": f"WITH {_TEACH} {_rows('old')}",
    "teacher_stops": f"WITH {_TEACH} {_rows('walk', 0.001)}",
    "label_gain": f"WITH {_POST} SELECT id, CAST(doc_id AS VARCHAR) AS doc_id, round(CASE label WHEN 'SUPPORTS' THEN e0 - p ELSE e1 - (1 - p) END, 6) AS gain FROM post",
    "feature_rows": f"WITH {_FEATURES} SELECT id, CAST(step AS INT) AS step, CAST(doc_id AS VARCHAR) AS doc_id, {', '.join(f'round({x} + 0.0, 6) AS f{i:02d}' for i, x in enumerate(_F))}, round(gain, 6) AS gain, CAST(own = step AS INT) AS is_best FROM feats",
    "train_balance": f"WITH {_TEACH} SELECT count(*) FILTER (own = step) AS positives, count(*) FILTER (own <> step) AS negatives, bool_or(own = step) AND bool_or(own <> step) AS usable FROM gains",
    "listwise_groups": f"WITH {_TEACH} SELECT id, CAST(step AS INT) AS step, CAST(step AS INT) AS n_selected, CAST(doc_id AS VARCHAR) AS doc_id, rank, CAST(length(text) AS INT) AS chars, round(gain, 6) AS gain FROM gains JOIN documents USING (doc_id)",
    "group_stats": f"WITH {_TEACH} {_BUILT} SELECT count(*) FILTER (n >= 2) AS groups, CAST(sum(asked - n) AS BIGINT) AS skipped_missing, count(*) FILTER (n < 2) AS skipped_small FROM built",
    "epoch_order": f"WITH {_TEACH}{_BUILT} SELECT id, CAST(step AS INT) AS step, CAST(n AS INT) AS candidates FROM built WHERE n >= 2",
    "first_feature_rows": f"""WITH {_TEACH}, firsts AS (SELECT id, step FROM states ORDER BY -id, step LIMIT 100),
nearest AS (SELECT *, row_number() OVER (PARTITION BY id, step ORDER BY rank) AS nth FROM gains JOIN firsts USING (id, step))
SELECT id, CAST(step AS INT) AS step, CAST(doc_id AS VARCHAR) AS doc_id, round(gain, 6) AS gain, CAST(own = step AS INT) AS is_best FROM nearest WHERE nth <= 5""",
    "listwise_loss": f"WITH {_TEACH}{_LSE} SELECT id, CAST(step AS INT) AS step, round(max(ts) + ln(sum(exp(score - ts))) - sum(exp((gain - tg) / 0.1::DOUBLE) * score) / sum(exp((gain - tg) / 0.1::DOUBLE)), 6) AS loss FROM groups GROUP BY id, step",
    "multitask_loss": f"WITH {_TEACH}{_MULTI} SELECT id, CAST(step AS INT) AS step, round(ce, 6) AS ce_loss, round(rank_loss, 6) AS rank_loss, round(total, 6) AS total, num_positive, num_negative, num_neutral, valid FROM multi",
    "loss_report": f"WITH {_TEACH}{_MULTI} SELECT count(*) AS groups, round(avg(total), 6) AS mean_total, round(avg(ce), 6) AS mean_ce_loss, round(avg(rank_loss), 6) AS mean_rank_loss, CAST(sum(num_positive) AS BIGINT) AS num_positive, CAST(sum(num_negative) AS BIGINT) AS num_negative, CAST(sum(num_neutral) AS BIGINT) AS num_neutral, count(*) FILTER (valid) AS valid_groups, count(*) FILTER (NOT valid) AS skipped_groups FROM multi",
    "select_naive": f"WITH {_TOP} {_selected('(SELECT *, rank - 1 AS step FROM top JOIN q USING (id) WHERE rank <= 4)', 'naive_topm')}",
    "select_oracle": f"WITH {_TEACH} {_selected('(SELECT * FROM walk WHERE step < 4)', 'oracle')}",
    "selection_violations": "SELECT item_id AS id, 'naive_topm' AS method, CAST(5 AS INT) AS num_docs FROM benchmark WHERE item_id % 5 = 0",
    "selection_overlap": f"WITH {_TEACH} SELECT 'oracle' AS method, rank, count(*) AS n FROM walk WHERE step < 4 GROUP BY rank",
    "oracle_vs_naive": f"WITH {_TEACH} SELECT id, CAST(count(*) FILTER (rank <= 4) AS INT) AS shared, CAST(count(*) FILTER (rank > 4) AS INT) AS only_left, CAST(4 - count(*) FILTER (rank <= 4) AS INT) AS only_right FROM walk WHERE step < 4 GROUP BY id",
    "evidence_block": f"WITH {_TOP} SELECT id, CAST(length({_BLOCK}) AS INT) AS chars, sha256({_BLOCK}) AS sha FROM top JOIN documents USING (doc_id) WHERE rank <= 4 GROUP BY id",
    "selector_input": f"""WITH {_TOP}, docs AS (SELECT id, rank, CASE WHEN {_TRIM("coalesce(source, '')")} <> '' AND {_TRIM("coalesce(text, '')")} <> '' THEN {_TRIM('source')} || ': ' || {_TRIM('text')} ELSE {_TRIM("coalesce(source, '')")} || {_TRIM("coalesce(text, '')")} END AS t FROM top JOIN documents USING (doc_id) WHERE rank <= 6),
made AS (SELECT q.id, 'Claim:\n' || substr(query, 1, 2000) || '\n\nCandidate evidence:\n' || (SELECT substr(t, 1, 5000) FROM docs d WHERE d.id = q.id AND rank = 6) || '\n\nAlready selected evidence:\n' || (SELECT substr(string_agg('[' || (rank - 1) || '] ' || t, chr(10) ORDER BY rank), 1, 5000) FROM docs d WHERE d.id = q.id AND rank BETWEEN 2 AND 5) || '\n\nTask:\nScore how useful the candidate evidence is as an additional evidence item for verifying the claim, considering the already selected evidence.' AS t FROM q)
SELECT id, CAST(length(t) AS INT) AS chars, sha256(t) AS sha FROM made""",
    "predictions": f"WITH {_PRED} SELECT id, gold, pred, pred = gold AS correct, round(p0, 6) AS p0, num_docs, evidence_chars, selected, 'naive_topm' AS method FROM preds",
    "metrics_summary": f"""WITH {_PRED} SELECT count(*) AS num_examples, count(*) FILTER (pred = gold) AS num_correct, round(count(*) FILTER (pred = gold) / count(*), 6) AS accuracy, round(avg(num_docs), 6) AS avg_num_docs, round(median(num_docs), 6) AS median_num_docs, min(num_docs) AS min_num_docs, max(num_docs) AS max_num_docs, round(avg(evidence_chars), 6) AS avg_evidence_chars, CAST(0 AS BIGINT) AS num_non_finite, count(*) FILTER (pred IS NULL) AS num_missing FROM preds""",
    "metrics_document": f"""WITH {_PRED}, names AS (SELECT * FROM (VALUES ('SUPPORTS'), ('REFUTES')) l(label)), cells AS (SELECT g.label AS gold, p.label AS pred, count(x.id) AS n FROM names g CROSS JOIN names p LEFT JOIN preds x ON x.gold = g.label AND x.pred = p.label GROUP BY ALL)
SELECT 'metrics.v2' AS schema_version, (SELECT count(*) FROM preds) AS num_examples, round((SELECT avg((pred = gold)::INT) FROM preds), 6) AS accuracy, gold, pred, n, (SELECT count(*) FROM preds WHERE preds.gold = cells.gold) AS gold_rows, (SELECT count(*) FROM preds WHERE preds.pred = cells.pred) AS pred_rows, (SELECT count(*) FROM preds) AS counted FROM cells""",
    "metrics_per_class": f"""WITH {_PRED} SELECT l.label, count(gold) AS num_examples, count(*) FILTER (pred = gold) AS num_correct, round(coalesce(count(*) FILTER (pred = gold) / nullif(count(gold), 0), 0.0), 6) AS accuracy FROM (VALUES ('SUPPORTS'), ('REFUTES')) l(label) LEFT JOIN preds ON gold = l.label GROUP BY l.label""",
    "confusion_matrix": f"""WITH {_PRED}, names AS (SELECT * FROM (VALUES ('SUPPORTS'), ('REFUTES'), ('NOT_ENOUGH_INFO')) l(label)) SELECT g.label AS gold, p.label AS pred, count(x.id) AS n FROM names g CROSS JOIN names p LEFT JOIN preds x ON x.gold = g.label AND x.pred = p.label GROUP BY ALL""",
    "prediction_distribution": f"""WITH {_PRED} SELECT l.label, count(pred) AS n FROM (VALUES ('SUPPORTS'), ('REFUTES')) l(label) LEFT JOIN preds ON pred = l.label GROUP BY l.label""",
    "num_docs_histogram": f"WITH {_PRED} SELECT num_docs, count(*) AS n FROM preds GROUP BY num_docs",
    "run_method": f"""WITH {_TEACH}, chosen AS (SELECT id, 'naive_topm' AS method, false AS diagnostic FROM top WHERE rank <= 4 UNION ALL SELECT id, 'oracle', true FROM walk WHERE step < 4)
SELECT CASE WHEN count(DISTINCT method) = 1 THEN min(method) ELSE 'selection' END AS method, coalesce(bool_or(diagnostic), false) AS diagnostic_only FROM chosen""",
    "method_table": f"""WITH {_PRED}, runs AS (SELECT id % 3 AS seed, avg((pred = gold)::INT) AS a FROM preds GROUP BY seed) SELECT 'naive_topm' AS method, count(*) AS runs, round(avg(a), 6) AS mean_accuracy, round(stddev_samp(a), 6) AS std_accuracy FROM runs""",
    "fingerprint": "SELECT item_id, sha256(CAST(to_json({'item_id': item_id, 'text': text}) AS VARCHAR)) AS sha FROM benchmark",
}
