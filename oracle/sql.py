"""DuckDB statements of the same results, written independently of the Spark expressions.

They share named subqueries; ``stmt`` puts those a statement needs in front of it.
"""

from __future__ import annotations

from leafmark.functions import rules as R
from leafmark.plans.corpus import NOTES, QUESTION_NOTES

WS = R.WS_CHARS
NL = "chr(10)"
CJK = r"[\x{3400}-\x{9FFF}]"
SCOPE = "('src1', 'src4', 'src7', 'src12')"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strlist(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]::VARCHAR[]"


def trim(x: str) -> str:
    return f"trim({x}, {lit(WS)})"


def squeeze(x: str) -> str:
    return trim(f"regexp_replace({x}, {lit(R.WS + '+')}, ' ', 'g')")


def compact(x: str) -> str:
    return f"regexp_replace({x}, {lit(R.WS + '+')}, '', 'g')"


def fold(x: str) -> str:
    return f"upper(replace({x}, 'ß', 'ss'))"


def first_seen(x: str) -> str:
    return f"list_filter({x}, lambda v_, i_: list_position({x}, v_) = i_)"


def terms(x: str) -> str:
    """x must be a column name."""
    runs = f"regexp_extract_all({fold(x)}, '{CJK}+')"
    pairs = (
        f"flatten(list_transform({runs}, lambda r_: CASE WHEN length(r_) = 1 THEN [r_] "
        "ELSE list_transform(range(1, length(r_)), lambda j_: substring(r_, j_, 2)) END))"
    )
    return f"list_concat(regexp_extract_all({fold(x)}, '[A-Z0-9_]{{2,}}|[0-9]'), {pairs})"


def excerpt(x: str, n: int = 420) -> str:
    flat = squeeze(x)
    return f"CASE WHEN length({flat}) > {n} THEN substring({flat}, 1, {n - 3}) || '...' ELSE {flat} END"


def strip_stop(x: str) -> str:
    for word in R.STOPWORDS:
        x = f"replace({x}, '{word}', ' ')"
    return squeeze(x)


def strip_meta(x: str) -> str:
    for word in R.META_WORDS:
        x = f"replace({x}, '{word}', ' ')"
    return x


def normalize(x: str) -> str:
    x = f"replace({x}, chr(0), '')"
    x = f"regexp_replace({x}, '[ \\t]+\\n', {NL}, 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', {NL} || {NL}, 'g')"
    return trim(f"regexp_replace({x}, '[ \\t]{{2,}}', ' ', 'g')")


NOTE = f"({strlist(NOTES)})[(doc_id % {len(NOTES)}) + 1]"
QNOTE = f"({strlist(QUESTION_NOTES)})[(item_id % {len(QUESTION_NOTES)}) + 1]"

LEVEL = "CASE WHEN doc_id % 7 = 0 THEN 1 WHEN doc_id % 7 <= 2 THEN 2 WHEN doc_id % 7 <= 4 THEN 3 END"


def corpus(cjk: bool) -> str:
    text = f"text || {NL} || {NOTE}" if cjk else "text"
    qtext = f"{QNOTE} || ' ' || text" if cjk else "text"
    return f"""
kept AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text),
page AS (SELECT doc_id, source AS document_id, doc_id + 1 AS page_number, {text} AS text,
                {trim(f"regexp_extract(text, '^{R.WS}*([^.' || {NL} || ']+)', 1)")} AS node_title
         FROM documents SEMI JOIN kept USING (doc_id)),
toc AS (SELECT document_id, doc_id AS seq, node_title AS title, {LEVEL} AS level, page_number
        FROM page WHERE {LEVEL} IS NOT NULL AND node_title <> ''),
question AS (SELECT item_id AS query_id, {qtext} AS question FROM benchmark)"""


HEADING = """
headed AS (SELECT p.document_id, p.page_number,
                  arg_max(t.title, t.page_number * 1000 + t.level) AS heading
           FROM page p LEFT JOIN toc t ON t.document_id = p.document_id AND t.page_number <= p.page_number
           GROUP BY ALL)"""

SECTION = """
section AS (SELECT t.document_id, t.seq, t.title, t.page_number, t.level,
                   coalesce(min(n.page_number) - 1, 9007199254740991) AS end_page
            FROM toc t LEFT JOIN toc n ON n.document_id = t.document_id
                 AND n.page_number > t.page_number AND n.level <= t.level
            GROUP BY ALL)"""

_wide = f"regexp_replace(substring(t, start + 161, 542), ' ({CJK})', {NL} || '\\1', 'g')"
_marks = f"translate(substring({_wide}, 1, 541), '。！？；.!?;', repeat({NL}, 8))"
_head = f"length(regexp_extract({_marks}, '(?s)^.*\\n'))"
_end = f"CASE WHEN start + 700 >= length(t) THEN length(t) WHEN {_head} > 0 THEN start + 160 + {_head} ELSE start + 700 END"
CHUNK = f"""
clean AS (SELECT document_id, page_number, {normalize('text')} AS t FROM page),
cut AS (
    SELECT document_id, page_number, t, 0::BIGINT AS start FROM clean WHERE t <> ''
    UNION ALL
    SELECT document_id, page_number, t,
           nxt + length(substring(t, nxt + 1)) - length(ltrim(substring(t, nxt + 1), {lit(WS)}))
    FROM (SELECT *, greatest(start + 1, fin - 120) AS nxt
          FROM (SELECT *, {_end} AS fin FROM cut) WHERE fin < length(t))
    WHERE nxt + length(substring(t, nxt + 1)) - length(ltrim(substring(t, nxt + 1), {lit(WS)})) < length(t)
),
piece AS (SELECT document_id, page_number, start, {trim(f"substring(t, start + 1, ({_end}) - start)")} AS text FROM cut),
chunk AS MATERIALIZED (
    SELECT p.document_id || ':' || p.page_number || ':' || p.i AS chunk_id, p.document_id, p.page_number,
           p.i AS chunk_index, h.heading, p.text
    FROM (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY start) - 1 AS i
          FROM piece WHERE text <> '') p
    LEFT JOIN headed h ON h.document_id = p.document_id AND h.page_number = p.page_number)"""

TOK = f"""
searched AS (SELECT chunk_id, document_id, page_number,
                    concat_ws({NL}, document_id, nullif(heading, ''), text) AS s FROM chunk),
rawtok AS (SELECT chunk_id, document_id, page_number, {terms('s')} AS l FROM searched),
tok AS MATERIALIZED (SELECT chunk_id, document_id, page_number, {first_seen('l')} AS tokens FROM rawtok),
seq AS MATERIALIZED (
    SELECT chunk_id, document_id,
           flatten(list_transform(tokens, lambda t_: list_filter(string_split(t_, '_'), lambda x_: x_ <> ''))) AS subs
    FROM tok),
size AS (SELECT chunk_id, document_id, len(subs) AS dl, '  ' || array_to_string(subs, '  ') || '  ' AS line FROM seq),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM size)"""

ANALYSIS_BASE = f"""
folded AS (SELECT query_id, question, {fold('question')} AS normalized FROM question),
stripped AS (SELECT query_id, {strip_meta(strip_stop('normalized'))} AS s FROM folded),
clause AS (SELECT query_id, unnest(regexp_split_to_array(s, {lit(R.CLAUSE)})) AS c,
                  generate_subscripts(regexp_split_to_array(s, {lit(R.CLAUSE)}), 1) AS n FROM stripped),
word AS (SELECT query_id, n, unnest(list_concat(regexp_extract_all(c, '[A-Z0-9_]{{2,}}'),
                                                regexp_extract_all(c, '{CJK}{{2,}}'))) AS w,
                generate_subscripts(list_concat(regexp_extract_all(c, '[A-Z0-9_]{{2,}}'),
                                                regexp_extract_all(c, '{CJK}{{2,}}')), 1) AS i FROM clause),
worded AS (SELECT query_id, w, min(n * 100000 + i) AS o FROM word GROUP BY ALL),
kw AS (SELECT query_id, list(w ORDER BY o) AS keywords FROM worded GROUP BY query_id)"""


def _apply(rows) -> str:
    return "list_concat(" + ", ".join(
        f"CASE WHEN {c} THEN {strlist(t)} ELSE []::VARCHAR[] END" for c, t in rows
    ) + ")"


def _re(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern}')"


_inferred = _apply(
    [
        (" AND ".join([f"contains(normalized, '{w}')" for w in ws] + ([_re("normalized", p)] if p else [])), t)
        for ws, p, t in R.INFERRED
    ]
)
_ids = f"list_concat(regexp_extract_all(normalized, '\\b(?:{R.IDENTIFIER})\\b'), {_inferred})"
_alias = _apply([(_re("question", p), t) for p, t in R.ALIASES])
_prefix = (
    "list_filter(list_transform(list_concat(identifiers, aliases), lambda v_: CASE "
    + " ".join(f"WHEN starts_with(v_, '{p}') THEN '{p}'" for p in R.PERIPHERALS)
    + " END), lambda p_: p_ IS NOT NULL)"
)
_intent = "CASE " + " ".join(f"WHEN {_re('question', p)} THEN '{n}'" for n, p in R.INTENTS) + " ELSE 'general' END"
_concepts = _apply([(_re("normalized", p), t.split()) for _, p, t in R.CONCEPTS])


def _structs(rows) -> str:
    return "[" + ", ".join(
        f"{{'id': {lit(i)}, 'query': {lit(q)}, 'keywords': {strlist(k)}}}" for i, q, k in rows
    ) + "]"


ANALYSIS = ANALYSIS_BASE + f""",
an1 AS (SELECT f.*, coalesce(k.keywords, []::VARCHAR[]) AS keywords,
               regexp_extract_all(normalized, '{R.CHIP}') AS c0, {_ids} AS i0, {_alias} AS a0,
               {_intent} AS intent, {_concepts} AS n0
        FROM folded f LEFT JOIN kw k USING (query_id)),
an2 AS (SELECT query_id, question, normalized, keywords, intent,
               {first_seen('c0')} AS chip_models, {first_seen('i0')} AS identifiers,
               CASE WHEN {_re('normalized', R.CORE_TIMER)} THEN list_filter({first_seen('a0')}, lambda x_: x_ <> 'TIM')
                    ELSE {first_seen('a0')} END AS aliases,
               {first_seen('n0')} AS concepts FROM an1),
an3 AS (SELECT *, {_prefix} AS p0 FROM an2),
an4 AS (SELECT * EXCLUDE (p0), {first_seen('p0')} AS peripherals FROM an3),
analysis AS MATERIALIZED (
  SELECT *,
    CASE WHEN contains(normalized, 'PA9') AND contains(normalized, 'USART1_TX') THEN {_structs(R.ASPECTS_REMAP)}
         WHEN contains(normalized, 'ADC') AND {_re('normalized', R.SAMPLING)} THEN {_structs(R.ASPECTS_ADC)}
         WHEN contains(normalized, 'GPIO') AND {_re('normalized', R.MODE_WORDS)} THEN {_structs(R.ASPECTS_GPIO)}
         WHEN list_contains(peripherals, 'TIM') AND {_re('normalized', R.QUANTITY)} THEN {_structs(R.ASPECTS_TIMER)}
         WHEN len(peripherals) > 0 THEN
              [{{'id': lower(peripherals[1]) || '-configuration',
                 'query': array_to_string(identifiers || aliases || peripherals, ' '),
                 'keywords': identifiers || peripherals}}]
         ELSE [] END AS aspects
  FROM an4),
entry AS (
  SELECT query_id, 0 AS p, question AS q, 0.9::DOUBLE AS w FROM analysis
  UNION ALL SELECT query_id, 1, array_to_string(chip_models || keywords || identifiers || peripherals || aliases, ' '), 1.05 FROM analysis
  UNION ALL SELECT query_id, 2, array_to_string(keywords, ' '), 1.25 FROM analysis
  UNION ALL SELECT query_id, 3, array_to_string(concepts, ' '), 0.95 FROM analysis
  UNION ALL SELECT query_id, 3 + r, k, 1.15 FROM (
      SELECT query_id, k, row_number() OVER (PARTITION BY query_id ORDER BY length(k) DESC, i) AS r
      FROM (SELECT query_id, unnest(keywords) AS k, generate_subscripts(keywords, 1) AS i FROM analysis)) WHERE r <= 2
  UNION ALL SELECT query_id, 5 + i, a.query, 0.85
      FROM (SELECT query_id, unnest(aspects) AS a, generate_subscripts(aspects, 1) AS i FROM analysis)),
variant AS (
  SELECT query_id, q AS query, max(w) AS weight, row_number() OVER (PARTITION BY query_id ORDER BY min(p)) - 1 AS variant_no
  FROM (SELECT query_id, p, w, {trim('q')} AS q FROM entry) WHERE q <> '' GROUP BY query_id, q),
vtext AS (
  SELECT v.query_id, v.variant_no, v.weight,
         {strip_stop("concat_ws(' ', upper(replace(v.query, 'ß', 'ss')), nullif(array_to_string(a.identifiers || a.peripherals || a.aliases, ' '), ''))")} AS s
  FROM variant v JOIN analysis a USING (query_id)),
vraw AS (SELECT query_id, variant_no, weight, {terms('s')} AS l FROM vtext),
vterms AS MATERIALIZED (SELECT query_id, variant_no, weight, {first_seen('l')} AS terms FROM vraw)"""


def selection(scope: bool) -> str:
    inside = f"document_id IN {SCOPE}" if scope else "true"
    return f"""
asked AS (SELECT query_id, variant_no, weight, unnest(terms) AS term, generate_subscripts(terms, 1) AS pos FROM vterms),
dterm AS (SELECT DISTINCT term, list_filter(string_split(term, '_'), lambda x_: x_ <> '') AS ps FROM asked),
occ AS MATERIALIZED (
  SELECT d.term, o.chunk_id, o.document_id, o.dl, o.tf FROM dterm d
  JOIN (SELECT s, chunk_id, document_id, dl, count(*) AS tf
        FROM (SELECT unnest(subs) AS s, chunk_id, document_id, len(subs) AS dl FROM seq) GROUP BY ALL) o ON o.s = d.ps[1]
  WHERE len(d.ps) = 1
  UNION ALL
  SELECT d.term, z.chunk_id, z.document_id, z.dl,
         (length(z.line) - length(replace(z.line, d.pat, ''))) // length(d.pat) AS tf
  FROM (SELECT term, ' ' || array_to_string(ps, '  ') || ' ' AS pat FROM dterm WHERE len(ps) > 1) d
  JOIN size z ON contains(z.line, d.pat)),
freq AS (SELECT term, count(*) AS df_all, count(*) FILTER (WHERE {inside}) AS df FROM occ GROUP BY term),
scoped_n AS (SELECT count(*) AS n FROM size WHERE {inside}),
known AS (SELECT a.*, f.df, f.df_all, f.df <= greatest(3, (SELECT n FROM scoped_n) // 5) AS rare
          FROM asked a JOIN freq f USING (term) WHERE f.df > 0),
picked AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY df, pos) AS place
    FROM (SELECT *, bool_or(rare) OVER (PARTITION BY query_id, variant_no) AS any_rare FROM known)
    WHERE rare OR NOT any_rare)
  WHERE place <= 48)"""


def lexical(scope: bool) -> str:
    inside = f"o.document_id IN {SCOPE}" if scope else "true"
    return f"""
part AS (
  SELECT p.query_id, p.variant_no, o.chunk_id,
         CASE WHEN ln((c.n - p.df_all + 0.5) / (p.df_all + 0.5)) > 0
              THEN ln((c.n - p.df_all + 0.5) / (p.df_all + 0.5)) ELSE 1e-6 END
         * o.tf * 2.2 / (o.tf + 1.2 * (0.25 + 0.75 * o.dl / c.avgdl)) AS s
  FROM picked p JOIN occ o USING (term) CROSS JOIN corpus c WHERE {inside}),
cand AS MATERIALIZED (
  SELECT *, max(bm25) OVER (PARTITION BY query_id, variant_no) AS best FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY bm25 DESC, chunk_id) AS place
    FROM (SELECT query_id, variant_no, chunk_id, round(sum(s), 9) AS bm25 FROM part GROUP BY ALL))
  WHERE place <= 160)"""


BLEND = f"""
sel AS (SELECT query_id, variant_no, any_value(weight) AS weight, list(term) AS ts FROM picked GROUP BY ALL),
kws AS (SELECT query_id, list_filter(keywords, lambda k_: length(k_) >= 2) AS ks FROM analysis),
flat AS (SELECT chunk_id, text, upper(replace({compact('text')}, 'ß', 'ss')) AS body FROM chunk),
hitkw AS MATERIALIZED (
  SELECT x.query_id, x.chunk_id,
         CASE WHEN len(ks) > 0 THEN len(list_filter(ks, lambda k_: contains(f.body, k_))) / len(ks) ELSE 0 END AS phrase,
         CASE WHEN len(ks) > 0 THEN len(list_filter(ks, lambda k_: contains(f.text, k_)
              AND regexp_matches(f.text, '[0-9]{R.WS}*' || k_))) / len(ks) ELSE 0 END AS sect
  FROM (SELECT DISTINCT query_id, chunk_id FROM cand) x JOIN kws USING (query_id) JOIN flat f USING (chunk_id)),
blend AS (
  SELECT c.query_id, c.variant_no, s.weight, c.chunk_id, c.place,
         round(0.35 * c.bm25 / greatest(c.best, 2.220446049250313e-16)
               + 0.25 * (len(list_filter(s.ts, lambda t_: list_contains(k.tokens, t_))) / len(s.ts))
               + 0.2 * h.phrase + 0.2 * h.sect, 9) AS score
  FROM cand c JOIN sel s USING (query_id, variant_no) JOIN tok k USING (chunk_id) JOIN hitkw h USING (query_id, chunk_id)),
lists AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY score DESC, place) AS rank FROM blend)
  WHERE rank <= 40)"""

# variants of a question with one term set are one list: first variant, summed weight
MERGED = """
keyed AS (SELECT query_id, variant_no, weight, list_sort(ts) AS k FROM sel),
merged AS (SELECT query_id, k, min(variant_no) AS variant_no, sum(weight) AS weight FROM keyed GROUP BY ALL)"""

FUSED = """
fused AS MATERIALIZED (
  SELECT query_id, chunk_id, sum(weight / (60 + rank)) AS rrf, min(rank) AS rank FROM lists GROUP BY ALL)"""


def _count(values: str, test: str) -> str:
    return f"len(list_filter({values}, lambda v_: {test}))"


SCORES = f"""
hay AS MATERIALIZED (
  SELECT f.query_id, f.chunk_id, f.rrf, f.rank, c.document_id, c.page_number, c.heading, c.text, a.* EXCLUDE (query_id),
         upper(c.document_id) AS ut, {fold("coalesce(c.heading, '')")} AS uh, {fold('c.text')} AS ux,
         {fold("coalesce(c.heading, '')")} || {NL} || {fold('c.text')} AS ub,
         list_filter(a.identifiers, lambda v_: NOT list_contains(a.chip_models, v_)) AS specific,
         len(regexp_extract_all(c.text, '\\.{{4,}}')) >= 3 AS dotted
  FROM fused f JOIN chunk c USING (chunk_id) JOIN analysis a USING (query_id)),
hay2 AS MATERIALIZED (
  SELECT *, ut || {NL} || ub AS ua, regexp_matches(uh, '{R.NAVIGATION}') OR dotted AS navigation FROM hay),
matched AS MATERIALIZED (
  SELECT DISTINCT a.query_id, s.document_id, s.page_number, s.end_page
  FROM (SELECT query_id, unnest(keywords) AS k FROM analysis) a
  JOIN section s ON length(a.k) >= 2 AND contains({fold('s.title')}, a.k)),
secboost AS MATERIALIZED (
  SELECT h.query_id, h.chunk_id,
         max(CASE WHEN m.page_number = h.page_number THEN 0.55 WHEN m.page_number < h.page_number AND h.page_number <= m.end_page THEN 0.18 ELSE 0 END) AS sb
  FROM hay2 h JOIN matched m USING (query_id, document_id) GROUP BY ALL),
boosted AS MATERIALIZED (
  SELECT h.*, coalesce(s.sb, 0)::DOUBLE AS sb,
         0.035::DOUBLE * {_count('identifiers', 'contains(ua, v_)')} + 0.02::DOUBLE * {_count('peripherals', 'contains(ua, v_)')}
         + 0.02::DOUBLE * {_count('chip_models', 'contains(ua, v_)')}
         + CASE WHEN heading IS NOT NULL AND {_count('identifiers', 'contains(heading, v_)')} > 0 THEN 0.04::DOUBLE ELSE 0 END AS structural,
         coalesce(list_sum(list_transform(aspects, lambda a_:
            least(0.45::DOUBLE, 0.32::DOUBLE * len(list_filter(a_.keywords, lambda k_: contains(uh, upper(k_)))))
            + least(0.24::DOUBLE, 0.06::DOUBLE * len(list_filter(a_.keywords, lambda k_: contains(ub, upper(k_))))))), 0) AS aspect
  FROM hay2 h LEFT JOIN secboost s USING (query_id, chunk_id)),
pool1 AS (SELECT *, count(*) FILTER (WHERE NOT navigation) OVER (PARTITION BY query_id) AS others FROM boosted),
pool2 AS (SELECT *, {_count('specific', 'contains(ua, v_)')} > 0 AS exact FROM pool1 WHERE others < 3 OR NOT navigation),
pooled AS MATERIALIZED (SELECT * FROM (SELECT *, bool_or(exact) OVER (PARTITION BY query_id) AS any_exact FROM pool2) WHERE exact OR NOT any_exact),
ranked AS MATERIALIZED (
  SELECT *, round(rrf + structural + aspect + sb + 1 / (20 + rank)
    + coalesce(list_sum(list_transform(specific, lambda v_: CASE WHEN contains(uh, v_) THEN 0.65 WHEN contains(ux, v_) THEN 0.45 ELSE 0 END)), 0)::DOUBLE
    + coalesce(list_sum(list_transform(keywords, lambda k_: CASE WHEN contains(uh, k_) THEN 0.45 WHEN length(k_) >= 4 AND contains(ux, k_) THEN 0.12 ELSE 0 END)), 0)::DOUBLE
    + CASE WHEN {_count('specific', 'contains(ux, v_)')} >= 2 THEN 0.55 ELSE 0 END::DOUBLE
    + 0.08::DOUBLE * {_count('peripherals', 'contains(ux, v_) OR contains(uh, v_)')}
    + 0.04::DOUBLE * {_count('chip_models', 'contains(ux, v_) OR contains(ut, v_)')}
    + CASE WHEN length({compact('normalized')}) >= 4 AND contains({compact('ux')}, {compact('normalized')}) THEN 0.35 ELSE 0 END::DOUBLE
    - CASE WHEN regexp_matches(uh, '{R.NAVIGATION}') THEN 0.45 ELSE 0 END::DOUBLE
    - CASE WHEN dotted THEN 0.8 ELSE 0 END::DOUBLE, 9) AS score
  FROM pooled)"""


def diverse(aspect_steps: int) -> str:
    """Final selection; each aspect step removes the pages already taken."""
    out = """
s0 AS MATERIALIZED (SELECT query_id, chunk_id, document_id, page_number, score, rank, aspects, uh, ub,
              max(score) OVER (PARTITION BY query_id) AS top, false AS taken, false AS seen FROM ranked)"""
    for n in range(1, aspect_steps + 1):
        out += f""",
c{n} AS (SELECT query_id, chunk_id, score, top, row_number() OVER (PARTITION BY query_id ORDER BY
          (len(list_filter(aspects[{n}].keywords, lambda k_: contains(uh, upper(k_)))) > 0) DESC, score DESC, rank, chunk_id) AS r
       FROM s{n - 1} WHERE NOT seen AND len(aspects) >= {n} AND len(list_filter(aspects[{n}].keywords, lambda k_: contains(ub, upper(k_)))) > 0),
g{n} AS (SELECT query_id, chunk_id FROM c{n} WHERE r = 1 AND score >= top * 0.15),
s{n} AS MATERIALIZED (SELECT s.* REPLACE (s.taken OR g.chunk_id IS NOT NULL AS taken,
          s.seen OR bool_or(g.chunk_id IS NOT NULL) OVER (PARTITION BY s.query_id, s.document_id, s.page_number) AS seen)
       FROM s{n - 1} s LEFT JOIN g{n} g USING (query_id, chunk_id))"""
    last = f"s{aspect_steps}"
    return out + f""",
cnt AS (SELECT query_id, count(*) AS k FROM {last} WHERE taken GROUP BY ALL),
dcnt AS (SELECT query_id, document_id, count(*) AS k FROM {last} WHERE taken GROUP BY ALL),
free1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id, page_number ORDER BY score DESC, rank, chunk_id) AS rp
          FROM {last} WHERE NOT seen AND score >= CASE WHEN top > 1.6 THEN top * 0.38 ELSE 0 END),
free2 AS (SELECT f.*, row_number() OVER (PARTITION BY f.query_id, f.document_id ORDER BY score DESC, rank, chunk_id) + coalesce(d.k, 0) AS rd
          FROM free1 f LEFT JOIN dcnt d USING (query_id, document_id) WHERE rp = 1),
free3 AS (SELECT f.*, row_number() OVER (PARTITION BY f.query_id ORDER BY score DESC, rank, chunk_id) + coalesce(c.k, 0) AS rq
          FROM free2 f LEFT JOIN cnt c USING (query_id) WHERE rd <= 6),
chosen AS (SELECT query_id, chunk_id, score, rank FROM free3
           WHERE rq <= CASE WHEN len(list_filter(aspects, lambda a_: a_.id = 'timer-inventory')) > 0 THEN 4 ELSE 8 END
           UNION ALL SELECT query_id, chunk_id, score, rank FROM {last} WHERE taken),
final AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, chunk_id) AS no FROM chosen) WHERE no <= 8)"""


def _printed(x: str, page: str) -> str:
    w = R.WS
    pats = [f"页{w}*([0-9]+){w}*/{w}*[0-9]+", f"([0-9]+){w}*/{w}*[0-9]+", f"(?:第{w}*)?([0-9]+){w}*页"]
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, {lit(p)}, 1), '')" for p in pats) + f", {page}::VARCHAR)"


CITED = f"""SELECT f.query_id, 'S' || f.no AS source_id, c.document_id, c.chunk_id, c.page_number,
  {_printed('p.text', 'p.page_number')} AS printed_page, c.heading, {excerpt('c.text')} AS excerpt, round(f.score, 6) AS score
FROM final f JOIN chunk c USING (chunk_id) JOIN page p ON p.document_id = c.document_id AND p.page_number = c.page_number"""


def stmt(select: str, *parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + "\n" + select if parts else select


INDEX = (HEADING, CHUNK, TOK)


def indexed(cjk: bool) -> tuple[str, ...]:
    return (corpus(cjk), *INDEX)


def searched(cjk: bool, scope: bool = False) -> tuple[str, ...]:
    return (*indexed(cjk), ANALYSIS, selection(scope), lexical(scope), BLEND)


def reranked(cjk: bool, scope: bool = False) -> tuple[str, ...]:
    return (*searched(cjk, scope), FUSED, SECTION, SCORES)


_PICKED = "SELECT query_id, variant_no::BIGINT AS variant_no, term, df, place FROM picked"
_BM25 = "SELECT query_id, variant_no::BIGINT AS variant_no, chunk_id, place, round(bm25, 6) AS bm25 FROM cand"
_LISTS = """SELECT m.query_id, m.variant_no::BIGINT AS variant_no, l.chunk_id, round(m.weight, 6) AS weight, round(l.score, 6) AS score, l.rank
FROM merged m JOIN lists l USING (query_id, variant_no)"""
_CHUNKS = "SELECT document_id, page_number, chunk_index, text FROM chunk"
_TOKENS = "SELECT chunk_id, array_to_string(tokens, ' ') AS tokens FROM tok"

DOCS = """
docs AS (SELECT document_id, document_id AS title, document_id || '.' || kind AS original_filename, kind, page_count, created_at
  FROM (SELECT document_id, count(*) AS page_count, min(page_number) AS created_at,
               CASE regexp_extract(document_id, '([0-9]+)$', 1)::BIGINT % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'xlsx' ELSE 'image' END AS kind
        FROM page GROUP BY document_id))"""

ORACLES: dict[str, str] = {}
O = ORACLES

O["library_list"] = stmt(
    """SELECT d.*, coalesce(n, 0) AS indexed_chunk_count,
       CASE WHEN coalesce(n, 0) = 0 THEN 'none' WHEN kind = 'image' THEN 'metadata' ELSE 'content' END AS index_coverage
FROM docs d LEFT JOIN (SELECT document_id, count(*) AS n FROM chunk GROUP BY 1) USING (document_id)""",
    corpus(False), HEADING, CHUNK, DOCS,
)
O["library_name_filter"] = stmt(
    "SELECT document_id, original_filename, kind FROM docs WHERE contains(lower(title || ' ' || original_filename), 'src1')",
    corpus(False), DOCS,
)
O["library_total_pages"] = stmt("SELECT sum(page_count)::BIGINT AS total_pages FROM docs", corpus(False), DOCS)
O["doc_dedup"] = """SELECT doc_id, sha256(text) AS sha256,
  CASE WHEN doc_id = first THEN 'imported' ELSE 'duplicate' END AS status,
  CASE WHEN doc_id <> first THEN first END AS duplicate_of
FROM (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS first FROM documents)"""
O["coverage_report"] = stmt(
    f"""SELECT document_id, count(*) AS pages, count(*) FILTER (WHERE n < 20) AS empty_pages,
  round((count(*) - count(*) FILTER (WHERE n < 20)) / count(*) * 100, 2) AS coverage,
  round(sum(n) / count(*))::BIGINT AS avg_chars_per_page,
  coalesce((SELECT count(*) FROM toc t WHERE t.document_id = p.document_id), 0) AS outline_nodes
FROM (SELECT document_id, length({compact('text')}) AS n FROM page) p GROUP BY document_id""",
    corpus(False),
)
O["cascade_delete"] = stmt(
    """SELECT 'documents' AS table_name, count(*) AS rows FROM docs WHERE document_id NOT IN (FROM gone)
UNION ALL SELECT 'pages', count(*) FROM page WHERE document_id NOT IN (FROM gone)
UNION ALL SELECT 'toc_nodes', count(*) FROM toc WHERE document_id NOT IN (FROM gone)
UNION ALL SELECT 'chunks', count(*) FROM chunk WHERE document_id NOT IN (FROM gone)
UNION ALL SELECT 'embeddings', count(*) FROM chunk JOIN embeddings ON vec_id = page_number - 1
  WHERE document_id NOT IN (FROM gone)""",
    corpus(False), HEADING, CHUNK, DOCS,
    "\ngone AS (SELECT document_id FROM docs WHERE page_count = (SELECT max(page_count) FROM docs))",
)
O["normalize_page_text"] = f"SELECT doc_id, {normalize('text')} AS clean FROM documents"
O["printed_pages"] = f"SELECT doc_id, {_printed("t", "(doc_id + 1)")} AS printed_page FROM (SELECT doc_id, text || {NL} || {NOTE} AS t FROM documents)"
O["chunk_pages"] = stmt(_CHUNKS, corpus(False), HEADING, CHUNK)
O["chunk_pages_cjk"] = stmt(_CHUNKS, corpus(True), HEADING, CHUNK)
_join = "regexp_replace({}, '([A-Za-z0-9)]) +([A-Za-z0-9(])', '\\1' || chr(31) || '\\2', 'g')"
O["pdf_lines"] = f"""SELECT doc_id, {normalize(f"string_agg(line, {NL} ORDER BY i)")} AS text FROM (
  SELECT doc_id, i, {trim("replace(replace(" + _join.format(_join.format("l")) + ", ' ', ''), chr(31), ' ')")} AS line FROM (
    SELECT doc_id, unnest(string_split(text, {NL})) AS l, generate_subscripts(string_split(text, {NL}), 1) AS i FROM documents))
WHERE line <> '' GROUP BY doc_id"""
O["workbook_pages"] = f"""SELECT sheet, string_agg(line, {NL} ORDER BY l_linenumber, line) AS text FROM (
  SELECT l_orderkey AS sheet, l_linenumber, l_linenumber || chr(9) || l_partkey || chr(9)
  || CASE WHEN l_returnflag <> 'N' THEN l_returnflag ELSE '' END || chr(9)
  || CASE WHEN l_returnflag <> 'N' THEN l_linestatus ELSE '' END AS line FROM lineitem) GROUP BY sheet"""
O["heading_for_page"] = stmt("SELECT document_id, page_number, heading FROM headed", corpus(False), HEADING)
O["toc_parents"] = stmt(
    """SELECT document_id, seq, title, level::BIGINT AS level, CASE WHEN parent_level = level - 1 THEN parent END AS parent_seq FROM (
  SELECT t.document_id, t.seq, t.title, t.level, max(p.seq) AS parent, arg_max(p.level, p.seq) AS parent_level
  FROM toc t LEFT JOIN toc p ON p.document_id = t.document_id AND p.seq < t.seq AND p.level < t.level GROUP BY ALL)""",
    corpus(False),
)
O["toc_sections"] = stmt(
    "SELECT document_id, seq, page_number, level::BIGINT AS level, end_page FROM section", corpus(False), SECTION
)
O["section_match"] = stmt(
    f"""SELECT DISTINCT a.query_id, s.document_id, s.seq, s.page_number AS from_page, s.end_page AS to_page
FROM (SELECT query_id, unnest(keywords) AS k FROM kw) a JOIN section s ON contains({fold('s.title')}, a.k)""",
    corpus(False), SECTION, ANALYSIS_BASE,
)
O["search_terms"] = stmt(_TOKENS, *indexed(False))
O["search_terms_cjk"] = stmt(_TOKENS, *indexed(True))
_ents = f"regexp_extract_all({fold('text')}, '\\b(?:{R.ENTITY})\\b')"
O["entity_tokens"] = stmt(
    f"SELECT chunk_id, array_to_string({first_seen('e')}, ' ') AS entities FROM (SELECT chunk_id, {_ents} AS e FROM chunk)",
    corpus(True), HEADING, CHUNK,
)
O["document_frequency"] = stmt(
    "SELECT term, count(DISTINCT chunk_id) AS df FROM (SELECT chunk_id, unnest(subs) AS term FROM seq) GROUP BY term",
    *indexed(False),
)
O["df_pruned_terms"] = stmt(_PICKED, *indexed(False), ANALYSIS, selection(False))
O["df_pruned_terms_scoped"] = stmt(_PICKED, *indexed(False), ANALYSIS, selection(True))
O["df_pruned_terms_cjk"] = stmt(_PICKED, *indexed(True), ANALYSIS, selection(False))
O["query_keywords"] = stmt(
    "SELECT q.query_id, coalesce(array_to_string(k.keywords, ' '), '') AS keywords FROM question q LEFT JOIN kw k USING (query_id)",
    corpus(True), ANALYSIS_BASE,
)
O["query_intent"] = stmt("SELECT query_id, intent FROM analysis", corpus(True), ANALYSIS)
O["query_identifiers"] = stmt(
    "SELECT query_id, array_to_string(chip_models, ' ') AS chip_models, array_to_string(identifiers, ' ') AS identifiers, array_to_string(peripherals, ' ') AS peripherals, array_to_string(aliases, ' ') AS aliases FROM analysis",
    corpus(True), ANALYSIS,
)
O["concept_expand"] = stmt("SELECT query_id, array_to_string(concepts, ' ') AS concepts FROM analysis", corpus(True), ANALYSIS)
O["query_aspects"] = stmt(
    "SELECT query_id, (i - 1)::BIGINT AS aspect_no, a.id AS aspect, a.query AS aspect_query, array_to_string(a.keywords, ' ') AS aspect_keywords FROM (SELECT query_id, unnest(aspects) AS a, generate_subscripts(aspects, 1) AS i FROM analysis)",
    corpus(True), ANALYSIS,
)
O["retrieval_variants"] = stmt("SELECT query_id, variant_no, query, weight FROM variant", corpus(True), ANALYSIS)
O["variant_terms"] = stmt("SELECT query_id, variant_no, array_to_string(terms, ' ') AS terms FROM vterms", corpus(True), ANALYSIS)
O["bm25_topk"] = stmt(_BM25, *indexed(False), ANALYSIS, selection(False), lexical(False))
O["bm25_phrase"] = stmt(_BM25, *indexed(True), ANALYSIS, selection(False), lexical(False))
O["lexical_blend"] = stmt(_LISTS, *searched(False), MERGED)
O["lexical_blend_cjk"] = stmt(_LISTS, *searched(True), MERGED)
O["lexical_scoped"] = stmt(_LISTS, *searched(False, True), MERGED)

_COS = """near AS (SELECT b.item_id AS query_id, e.vec_id AS chunk_id, e.label,
  CASE WHEN list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) = 0 OR list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) = 0 THEN -1
       ELSE round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 9) END AS score
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id JOIN embeddings e ON len(e.embedding) = len(q.embedding))"""
_NEAR = "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM near {}) WHERE rank <= {}"
O["vector_topk"] = stmt(_NEAR.format("", 50), _COS)
O["vector_scoped"] = stmt(_NEAR.format("WHERE label IN (1, 3, 8)", 10), _COS)
CV = "\ncv AS (SELECT c.chunk_id, c.document_id, e.embedding FROM chunk c JOIN embeddings e ON e.vec_id = c.page_number - 1)"
O["embedding_status"] = stmt(
    "SELECT (SELECT count(*) FROM cv) AS indexed, count(*) AS total, (SELECT count(*) FROM cv) = count(*) AS complete FROM chunk",
    corpus(False), HEADING, CHUNK, CV,
)
O["missing_embeddings"] = stmt("SELECT chunk_id FROM chunk ANTI JOIN cv USING (chunk_id)", corpus(False), HEADING, CHUNK, CV)
O["rrf_weighted"] = stmt("SELECT query_id, chunk_id, round(rrf, 6) AS rrf, rank FROM fused", *searched(False), FUSED)
O["nav_filter"] = stmt(
    "SELECT query_id, chunk_id, navigation, others < 3 OR NOT navigation AS kept FROM pool1", *reranked(True)
)
O["exact_identifier_filter"] = stmt("SELECT query_id, chunk_id, exact FROM pooled", *reranked(True))
O["structural_boosts"] = stmt(
    "SELECT query_id, chunk_id, round(structural, 6) AS structural, round(aspect, 6) AS aspect, sb AS section FROM boosted",
    *reranked(True),
)
O["rerank_scores"] = stmt("SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ranked", *reranked(True))
O["retrieve_citations"] = stmt(CITED, *reranked(False), diverse(1))
O["retrieve_citations_cjk"] = stmt(CITED, *reranked(True), diverse(5))
O["retrieve_scoped"] = stmt(CITED, *reranked(False, True), diverse(1))
HYBRID = f"""
vpair AS (SELECT b.item_id AS query_id, c.chunk_id, round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) / sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_inner_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])), 9) AS score
          FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id CROSS JOIN cv c),
vlist AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vpair) WHERE rank <= 50),
fused AS MATERIALIZED (SELECT query_id, chunk_id, sum(w / (60 + rank)) AS rrf, min(rank) AS rank FROM (
  SELECT query_id, chunk_id, weight AS w, rank FROM lists UNION ALL SELECT query_id, chunk_id, 1.15, rank FROM vlist) GROUP BY ALL)"""
O["retrieve_hybrid"] = stmt(CITED, *searched(False), CV, HYBRID, SECTION, SCORES, diverse(1))
O["retrieval_warnings"] = stmt(
    f"SELECT q.query_id, {lit(R.MSG_NO_VECTORS)} || CASE WHEN count(f.chunk_id) = 0 THEN {NL} || {lit(R.MSG_NO_HITS)} ELSE '' END AS warnings FROM question q LEFT JOIN final f USING (query_id) GROUP BY ALL",
    *reranked(False), diverse(1),
)
LOCATE = f"""
ocr AS (SELECT query_id, {fold(squeeze(f"regexp_replace(question, {lit(R.OCR_PUNCTUATION)}, ' ', 'g')"))} AS o FROM question),
oraw AS (SELECT query_id, {terms('o')} AS l FROM ocr),
oterms AS (SELECT query_id, ({first_seen('l')})[1:400] AS ts FROM oraw),
oterm AS (SELECT query_id, unnest(ts) AS term FROM oterms WHERE len(ts) >= 4),
ofreq AS (SELECT term, count(DISTINCT chunk_id) AS df FROM (SELECT chunk_id, unnest(subs) AS term FROM seq) GROUP BY term),
wt AS MATERIALIZED (SELECT query_id, term, pow(ln(1 + n / (1 + df)), 2) AS w FROM oterm JOIN ofreq USING (term) CROSS JOIN corpus
       WHERE df <= greatest(4, n * 3 // 10)),
whole AS (SELECT query_id, sum(w) AS total FROM wt GROUP BY 1),
ptok AS (SELECT DISTINCT document_id, page_number, unnest(tokens) AS term FROM tok),
pscore AS (SELECT query_id, document_id, page_number, round(coalesce(any_value(s), 0) / any_value(total), 9) AS score
           FROM whole CROSS JOIN (SELECT DISTINCT document_id, page_number FROM tok) LEFT JOIN
             (SELECT query_id, document_id, page_number, sum(w) AS s FROM wt JOIN ptok USING (term) GROUP BY ALL) USING (query_id, document_id, page_number) GROUP BY ALL),
best8 AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, page_number) AS rank FROM pscore) WHERE rank <= 8),
shown AS (SELECT b.*, k.chunk_id, (SELECT count(*) FROM wt WHERE wt.query_id = b.query_id AND list_contains(k.tokens, wt.term)) AS m
          FROM best8 b JOIN tok k USING (document_id, page_number)),
top8 AS MATERIALIZED (SELECT s.query_id, s.rank, s.document_id, s.page_number, round(s.score, 6) AS score, c.chunk_index, c.heading, c.text
         FROM (SELECT s.*, row_number() OVER (PARTITION BY s.query_id, s.rank ORDER BY m DESC, split_part(chunk_id, ':', 3)::BIGINT) AS r FROM shown s) s
         JOIN chunk c USING (chunk_id) WHERE r = 1)"""
O["page_match_top8"] = stmt(
    f"SELECT query_id, rank, document_id, page_number, score, chunk_index, heading, {excerpt('text', 260)} AS excerpt FROM top8",
    *indexed(False), LOCATE,
)
O["page_match_confidence"] = stmt(
    f"""SELECT q.query_id, coalesce(max(score), 0) >= 0.25 AS matched, coalesce(max(score), 0)::DOUBLE AS confidence, count(rank) AS candidates,
  CASE WHEN len(any_value(t.ts)) < 4 THEN {lit(R.MSG_FEW_TERMS)} WHEN count(rank) = 0 THEN {lit(R.MSG_NO_PAGE)}
  ELSE concat_ws({NL}, CASE WHEN max(score) < 0.3 THEN {lit(R.MSG_LOW_CONFIDENCE)} END,
       CASE WHEN max(score) - max(score) FILTER (WHERE rank = 2) < 0.05 THEN {lit(R.MSG_CLOSE_SCORES)} END) END AS warnings
FROM question q JOIN oterms t USING (query_id) LEFT JOIN best8 b USING (query_id) GROUP BY q.query_id""",
    *indexed(False), LOCATE,
)
ANSWER = """
answer AS (SELECT conv_id || '-' || turn AS answer_id, conv_id AS query_id,
  text || CASE WHEN turn % 4 = 1 THEN ' [S1] x [S' || (conv_id % 11) || '] [S1]' ELSE '' END AS answer
  FROM conversations WHERE role = 'assistant')"""
SOURCE = "\nsource AS (SELECT query_id, 'S' || no AS source_id, no AS source_no, chunk_id FROM final)"
_labels = "regexp_extract_all(answer, '\\[(S[0-9]+)\\]', 1)"
LABEL = f"""
label0 AS (SELECT answer_id, query_id, unnest({_labels}) AS source_id, generate_subscripts({_labels}, 1) AS i FROM answer),
label1 AS (SELECT answer_id, query_id, source_id, row_number() OVER (PARTITION BY answer_id ORDER BY o) - 1 AS position
  FROM (SELECT answer_id, query_id, source_id, min(i) AS o FROM label0 GROUP BY ALL)),
label AS (SELECT l.*, s.chunk_id FROM label1 l JOIN source s USING (query_id, source_id))"""
_cite = (*reranked(False), diverse(1), SOURCE, ANSWER, LABEL)
O["citation_parse"] = stmt("SELECT answer_id, position, source_id, chunk_id FROM label", *_cite)


def _clean_answer(x: str) -> str:
    for p, n in [
        (r"\r\n?", NL), (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "''"), (r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]", "''"),
        ("<｜[^｜>]+｜>", "''"), (r"[ \t]+\n", NL), (r"\n{3,}", f"{NL} || {NL}"),
    ]:
        x = f"regexp_replace({x}, {lit(p)}, {n}, 'g')"
    return trim(x)


O["citation_fallback"] = stmt(
    f"""SELECT answer_id, labels, fallback, {_clean_answer("full_answer")} AS answer FROM (
  SELECT a.answer_id, CASE WHEN c.ls IS NULL AND s.ids IS NOT NULL THEN array_to_string(s.ids[1:4], ' ') ELSE coalesce(array_to_string(c.ls, ' '), '') END AS labels,
    c.ls IS NULL AND s.ids IS NOT NULL AS fallback,
    a.answer || CASE WHEN c.ls IS NULL AND s.ids IS NOT NULL THEN {NL} || {NL} || {lit(R.FALLBACK_LABEL)} || '[' || array_to_string(s.ids[1:4], '] [') || ']' ELSE '' END AS full_answer
  FROM answer a LEFT JOIN (SELECT answer_id, list(source_id ORDER BY position) AS ls FROM label GROUP BY 1) c USING (answer_id)
  LEFT JOIN (SELECT query_id, list(source_id ORDER BY source_no) AS ids FROM source GROUP BY 1) s USING (query_id))""",
    *_cite,
)
_messy = f"'  ' || chr(13) || {NL} || replace(text, '. ', '. ' || chr(9) || chr(13) || {NL} || chr(13) || {NL} || {NL} || chr(8203) || '<｜end｜>' || chr(7)) || ' ' || {NL} || {NL}"
O["answer_normalize"] = f"SELECT doc_id, {_clean_answer(_messy)} AS answer FROM documents"
_ocr = f"regexp_replace(text || {NL} || {NOTE}, '({CJK})', '\\1 ', 'g')"


def _gap(x: str) -> str:
    return f"regexp_replace({x}, '({CJK}){R.WS}+({CJK})', '\\1\\2', 'g')"


# the notes' full-width comma becomes an ASCII one under NFKC; both turn into a blank here
O["ocr_normalize"] = f"""SELECT doc_id, {fold(squeeze(f"regexp_replace({_gap(_gap(_ocr))}, {lit(R.OCR_PUNCTUATION)}, ' ', 'g')"))} AS ocr FROM documents"""
O["excerpts"] = f"SELECT doc_id, {excerpt('text')} AS excerpt, {excerpt('text', 260)} AS page_excerpt FROM documents"
_secret = "regexp_extract(text, '([A-Za-z]{3,})', 1)"
O["redact"] = f"SELECT doc_id, CASE WHEN {_secret} = '' THEN text ELSE replace(text, {_secret}, '[REDACTED]') END AS redacted FROM documents"
O["link_citations"] = stmt("SELECT answer_id, regexp_replace(answer, '\\[(S[0-9]+)\\]', '[\\1](#citation-\\1)', 'g') AS markdown FROM answer", ANSWER)
_intent_label = "CASE intent " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in R.INTENT_LABELS.items()) + " END"
O["answer_prompts"] = stmt(
    f"""SELECT a.query_id, {lit(R.PROMPT_SYSTEM)} AS system,
  concat_ws({NL}, {lit(R.PROMPT_QUESTION)} || question, {lit(R.PROMPT_CONCEPTS)} || coalesce(nullif(array_to_string(keywords, '、'), ''), normalized),
    {lit(R.PROMPT_INTENT)} || {_intent_label}, '', {lit(R.PROMPT_EVIDENCE)}, b.blocks, '', {lit(R.PROMPT_CLOSING)}) AS user
FROM analysis a LEFT JOIN (
  SELECT query_id, string_agg('[' || source_id || '] 文档：' || document_id || {NL} || 'PDF 页码：' || page_number || '，印刷页码：' || printed_page
     || CASE WHEN coalesce(heading, '') <> '' THEN {NL} || '章节：' || heading ELSE '' END || {NL} || '原文：' || excerpt, {NL} ORDER BY source_id) AS blocks
  FROM ({CITED}) GROUP BY 1) b USING (query_id)""",
    *reranked(False), diverse(1),
)
_title = f"coalesce(nullif(substring({squeeze('text')}, 1, 48), ''), {lit(R.DEFAULT_TITLE)})"
O["conversation_list"] = f"""SELECT conv_id AS conversation_id, coalesce(arg_min({_title}, turn) FILTER (WHERE role = 'user'), {lit(R.DEFAULT_TITLE)}) AS title,
  min(turn) AS created_at, max(turn) AS updated_at, count(*) AS message_count FROM conversations GROUP BY conv_id"""
O["conversation_messages"] = """SELECT conv_id AS conversation_id, conv_id || '-' || turn AS message_id, role, text AS content, 'complete' AS status, turn AS created_at FROM conversations"""
_late = 'data: {"choices":[{"delta":{"content":"late"}}]}'
_tail = f"'data: {{broken' || {NL} || {NL} || ': note' || {NL} || {NL} || 'data: [DONE]' || {NL} || {NL}"
O["sse_parse"] = f"""WITH s AS (SELECT conv_id || '-' || turn AS stream_id, CASE WHEN turn % 2 = 0 THEN 37 ELSE 29 END AS size, string_split(text, '. ') AS parts FROM conversations),
n AS (SELECT *, list_sum(list_transform(parts, lambda p_: length('data: {{"choices":[{{"delta":{{"content":' || to_json(p_) || '}}}}]}}') + 2)) + length({_tail}) AS done_at FROM s)
SELECT stream_id, (i - 1)::BIGINT AS frame_no, p AS delta FROM (SELECT stream_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM n) WHERE p <> ''
UNION ALL SELECT stream_id, len(parts) + 3, 'late' FROM n WHERE ceil(done_at / size) = ceil((done_at + {len(_late) + 2}) / size)"""
O["chat_event_fold"] = f"""WITH r AS (SELECT conv_id, max(turn) FILTER (WHERE role = 'system' OR turn = 4) AS since FROM conversations GROUP BY 1),
said AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS t FROM conversations JOIN r USING (conv_id) WHERE since IS NULL OR turn >= since GROUP BY 1)
SELECT conv_id AS message_id, CASE WHEN conv_id % 5 = 0 THEN CASE WHEN t <> '' THEN t || {NL} || {NL} || '[回答中断：timeout]' ELSE '回答失败：timeout' END ELSE t END AS content,
  CASE WHEN conv_id % 5 = 0 THEN 'error' ELSE 'complete' END AS status,
  CASE WHEN conv_id % 5 <> 0 THEN 'S' || (conv_id % 8) END AS citations, CASE WHEN conv_id % 5 = 0 THEN 'timeout' END AS error FROM said"""
O["workbook_formats"] = """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS shipped,
  strftime(l_shipdate, '%A %-d %b %y') AS shipped_long, format('{:,.2f}', l_extendedprice::DECIMAL(18, 2)) AS price,
  round(l_discount * 100)::BIGINT || '%' AS discount, lpad(round(l_quantity)::BIGINT::VARCHAR, 3, '0') || ' pcs' AS quantity FROM lineitem"""
O["sse_stream"], O["chat_event_stream"] = O["sse_parse"], O["chat_event_fold"]
_topic = trim("regexp_replace(title, '^\\s*[0-9]+(\\.[0-9]+)*\\s*', '')")
O["eval_outline_questions"] = stmt(
    f"""SELECT document_id, seq, topic || ' 怎么配置' AS question, page_number AS page_from, greatest(page_number, least(end_page, last_page)) AS page_to
FROM (SELECT *, {_topic} AS topic FROM section) JOIN (SELECT document_id, max(page_number) AS last_page FROM page GROUP BY 1) USING (document_id)
WHERE length(title) >= 5 AND length(topic) >= 4 AND NOT regexp_matches(title, '目录|相关文档|参考文献|版本|(?i)[.]png|[.]jpg|[.]xlsx|[.]pdf')
  AND NOT regexp_matches(topic, '一路走来|前言|致谢|索引|术语|词汇|关于本|声明|修订|勘误|设计提示|提示和技巧')""",
    corpus(False), SECTION,
)
TRUTH = """
truth AS MATERIALIZED (SELECT b.item_id AS query_id, p.document_id, p.page_number FROM benchmark b JOIN page p ON contains(p.text, b.text))"""
O["eval_hit_rate"] = stmt(
    """SELECT 'suite' || (query_id % 3) AS suite, count(*) AS cases, count(no) AS hits, count(*) FILTER (WHERE no = 1) AS top1,
  round(avg(CASE WHEN no IS NOT NULL THEN 1 ELSE 0 END), 6) AS hit_rate
FROM (SELECT t.query_id, min(f.no) AS no FROM truth t LEFT JOIN (SELECT f.query_id, f.no, c.document_id, c.page_number FROM final f JOIN chunk c USING (chunk_id)) f
      USING (query_id, document_id, page_number) GROUP BY 1) GROUP BY ALL""",
    *reranked(False), diverse(1), TRUTH,
)
O["eval_page_match"] = stmt(
    """SELECT count(*) AS cases, count(*) FILTER (WHERE rank = 1) AS top1, count(rank) AS in_candidates
FROM (SELECT t.query_id, min(b.rank) AS rank FROM truth t LEFT JOIN best8 b USING (query_id, document_id, page_number) GROUP BY 1)""",
    *indexed(False), LOCATE, TRUTH,
)
_uncut = diverse(1).replace("CASE WHEN top > 1.6 THEN top * 0.38 ELSE 0 END", "-1e9").replace("WHERE rd <= 6", "").replace("no <= 8", "no <= 12")
_uncut = _uncut.replace("rq <= CASE WHEN len(list_filter(aspects, lambda a_: a_.id = 'timer-inventory')) > 0 THEN 4 ELSE 8 END", "rq <= 12")
O["retrieve_uncapped"] = stmt(CITED, *reranked(False), _uncut)
O["lexical_uncapped"] = stmt(
    "SELECT query_id, count(*) AS rows, count(DISTINCT chunk_id) AS chunks FROM merged JOIN lists USING (query_id, variant_no) GROUP BY 1",
    *indexed(False), ANALYSIS,
    selection(False).replace("(SELECT n FROM scoped_n) // 5", "f.df").replace("WHERE place <= 48", ""),
    lexical(False).replace("WHERE place <= 160", ""), BLEND.replace("WHERE rank <= 40", ""), MERGED,
)
O["page_match_all_terms"] = stmt(
    "SELECT query_id, rank, document_id, page_number, round(score, 6) AS score FROM best8",
    *indexed(False),
    LOCATE.replace("[1:400]", "").replace("len(ts) >= 4", "true").replace("WHERE df <= greatest(4, n * 3 // 10)", "").replace("rank <= 8", "rank <= 12"),
)

_HALVES = """
e AS (SELECT min(doc_id::VARCHAR) AS id, text FROM documents WHERE doc_id % 2 = 0 GROUP BY text),
o AS (SELECT min(doc_id::VARCHAR) AS id, text FROM documents WHERE doc_id % 2 = 1 AND text NOT IN (SELECT text FROM e) GROUP BY text)"""
O["library_after_changes"] = stmt(
    """SELECT id AS document_id, length(text) AS chars FROM (FROM e UNION ALL FROM o) WHERE id NOT IN ('0', '1')
UNION ALL SELECT '1', length(text || ' revised') FROM documents WHERE doc_id = 1""",
    _HALVES,
)
O["import_progress"] = stmt(
    """SELECT * FROM (SELECT 'first' AS import_id, 'imported' AS stage, count(*) AS documents FROM e UNION ALL SELECT 'second', 'imported', count(*) FROM o
UNION ALL SELECT 'first', 'duplicate', (SELECT count(*) FROM documents WHERE doc_id % 2 = 0) - count(*) FROM e
UNION ALL SELECT 'second', 'duplicate', (SELECT count(*) FROM documents WHERE doc_id % 2 = 1) - count(*) FROM o
UNION ALL SELECT 'third', 'imported', 1) WHERE documents > 0""",
    _HALVES,
)
_chunked = f"count(*) FILTER (WHERE {normalize('text')} <> '')"
O["import_stages"] = stmt(
    f"""SELECT import_id, unnest(['hashed', 'extracted', 'chunked', 'indexed']) AS stage, unnest([given, fresh, filled, filled]) AS documents FROM (
SELECT 'first' AS import_id, (SELECT count(*) FROM documents WHERE doc_id % 2 = 0) AS given, count(*) AS fresh, {_chunked} AS filled FROM e
UNION ALL SELECT 'second', (SELECT count(*) FROM documents WHERE doc_id % 2 = 1), count(*), {_chunked} FROM o UNION ALL SELECT 'third', 1, 1, 1)""",
    _HALVES,
)
O["embedding_progress"] = stmt(
    """SELECT 'lengths' AS model, batch, embedded, sum(embedded) OVER (ORDER BY batch)::BIGINT AS indexed, sum(embedded) OVER ()::BIGINT AS total
FROM (SELECT b AS batch, count(chunk_id) AS embedded FROM range(4) r(b) LEFT JOIN chunk ON ('0x' || substr(md5(chunk_id), 1, 6))::BIGINT % 4 = b GROUP BY 1)""",
    _HALVES,
    """
page AS (SELECT id AS document_id, 1 AS page_number, text FROM (FROM e UNION ALL FROM o) WHERE id NOT IN ('0', '1')
    UNION ALL SELECT '1', 1, text || ' revised' FROM documents WHERE doc_id = 1),
headed AS (SELECT document_id, page_number, NULL::VARCHAR AS heading FROM page)""",
    CHUNK,
)
O["outline_flatten"] = """
SELECT source AS document_id, seq, 'T' || doc_id AS title, len(place) AS level, doc_id + 1 AS page_number FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY place) - 1 AS seq FROM (
    SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN [doc_id] WHEN doc_id % 7 <= 2 THEN [doc_id - 1, doc_id] ELSE [doc_id - 2, doc_id - 1, doc_id] END AS place
    FROM documents WHERE doc_id % 7 <= 4))
WHERE doc_id % 10 <> 0"""
