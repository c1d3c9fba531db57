"""DuckDB statements for the queries that SQL can express."""

from leafmark.llm import licences

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _terms(text: str) -> str:
    return f"list_filter(regexp_split_to_array({LOWER.format(text)}, '[^a-z0-9]+'), lambda x: x <> '')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


TEMPLATES = ", ".join(f"({k}, {_quoted(lic)}, {_quoted(t)})" for k, (lic, t) in enumerate(licences.TEMPLATES))
LICENCES = f"""
with tpl(k, licence, t) as (values {TEMPLATES}),
tterm as (select k, licence, term, count(*) tf from (select k, licence, unnest({_terms('t')}) term from tpl) group by all),
doc as (select doc_id, coalesce(text, '') as text, coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || coalesce(floor(doc_id / 100)::bigint::varchar, '_')
    as dir, dir || '/' || coalesce(doc_id::varchar, '_') as path from documents),
dterm as (select distinct doc_id, unnest({_terms('text')}) term from doc),
total as (select (select count(*) from doc) + (select count(*) from tpl) as n),
idf as (select v.term, ln((1 + any_value(n)) / (1 + coalesce(any_value(d.df), 0) + any_value(v.tdf))) + 1 as idf
    from (select term, count(*) tdf from tterm group by 1) v left join (select term, count(*) df from dterm group by 1) d using (term) cross join total group by 1),
tvec as (select k, licence, term, w / sqrt(sum(w * w) over (partition by k)) w from (select k, licence, term, tf * idf w from tterm join idf using (term))),
seg as (select distinct doc_id, s from (
    select doc_id, unnest(string_split(text, chr(10))) s from doc
    union all select doc_id, unnest(list_filter(regexp_split_to_array(text, '\\n[\\x20\\x09\\r]*\\n'), lambda x: contains(x, chr(10)))) from doc)),
sterm as (select doc_id, s, term, count(*) tf from (select doc_id, s, unnest({_terms('s')}) term from seg) group by all),
w as (select doc_id, s, term, tf, tf * coalesce(idf, ln(1 + n) + 1) w from sterm left join idf using (term) cross join total),
norm as (select doc_id, s, sqrt(sum(w * w)) norm, sum(tf) terms from w group by all),
scored as (select doc_id, s, licence, terms, round(sum(w.w * tvec.w) / norm, 6) sim from w join tvec using (term) join norm using (doc_id, s) group by doc_id, s, k, licence, norm, terms),
hit as (select doc_id, s, licence, terms, sim from scored where sim >= {licences.THRESHOLD}
    qualify row_number() over (partition by doc_id, s order by sim desc, licence) = 1),
best as (select doc_id, licence, sim, max(terms) over (partition by doc_id) terms from hit qualify row_number() over (partition by doc_id order by sim desc, licence) = 1),
own as (select d.doc_id, d.dir, d.path, b.licence, b.sim, b.terms >= {licences.COVERAGE} * len({_terms('d.text')}) covered from doc d left join best b using (doc_id)),
given as (select dir as above, licence as given from own
    where licence is not null and (covered or regexp_matches(doc_id::varchar, '(?i)^(un)?licen[cs]es?([._-].*)?$'))
    qualify row_number() over (partition by dir order by sim desc, licence, path) = 1),
up as (select dir, unnest(range(0, len(string_split(dir, '/')) + 1)) depth from (select distinct dir from own)),
near as (select u.dir, g.above, g.given from (select dir, depth, array_to_string(string_split(dir, '/')[1:depth], '/') above from up) u join given g using (above)
    qualify row_number() over (partition by u.dir order by depth desc) = 1)
select doc_id, path, coalesce(licence, given) licence, case when licence is not null then 'text' when given is not null then 'directory' else 'none' end origin,
    sim similarity, case when licence is null then above end from_directory
from own left join near using (dir)
"""

CRC_STEP = "list_reduce(list_prepend(xor(a, b), range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))"
CRC = f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint)), lambda a, b: {CRC_STEP}), 4294967295::bigint)"
TRIE = f"""
with turns as (select conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) own
    from conversations where conv_id is not null group by 1),
plan as (select conv_id, own, {CRC} % 9 as h, conv_id - conv_id % 5 as donor from turns),
built as (select p.conv_id, list_concat(list_slice(coalesce(d.own, []), 1, p.h), list_slice(p.own, p.h + 1, len(p.own))) seq from plan p left join turns d on d.conv_id = p.donor),
starts as (select conv_id, unnest(range(0, len(seq) + 1)) as depth, seq from built),
node as (select depth, list_slice(seq, 1, depth) key, min(conv_id) conv_id, count(*) n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (len(seq) = depth), '')) ends_sha256 from starts group by 1, 2),
linked as (select n.*, p.conv_id parent_conv_id, case when n.depth > 0 then (n.n_convs - 1) * strlen(n.key[n.depth].t) else 0 end saved,
    (select count(*) from node c where c.depth = n.depth + 1 and list_slice(c.key, 1, n.depth) = n.key) n_children
    from node n left join node p on p.depth = n.depth - 1 and p.key = list_slice(n.key, 1, n.depth - 1))
select a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, count(*) filter (b.n_children = 0) n_leaves, sum(b.saved)::bigint saved_tokens, a.ends_sha256
from linked a join linked b on b.depth >= a.depth and list_slice(b.key, 1, a.depth) = a.key
group by a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, a.ends_sha256, a.key
"""

SEARCH_TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(LOWER.format("coalesce(text, '')"))
SEARCH = f"""
with each as (select doc_id, unnest({SEARCH_TERMS}) term from documents),
tfs as (select doc_id, term, count(*) tf from each group by 1, 2),
docs as (select doc_id, sum(tf)::bigint n from tfs group by 1),
total as (select count(*)::bigint n_docs, sum(n)::bigint n_terms from docs),
norm as (select doc_id, 75 + ((25 * n * n_docs) // n_terms) m from docs cross join total),
weight as (select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint w from tfs cross join total group by 1),
item as (select item_id, unnest({SEARCH_TERMS}) term from benchmark),
hit as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint score
    from item join weight using (term) join tfs using (term) join norm using (doc_id) group by 1, 2 having score > 0)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::integer as rank, doc_id, score from hit
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 20
"""

ORACLES = {
    "op13_strata": SEARCH,
    "op11_euler_trie": TRIE,
    "op1_licences": LICENCES,
    "op7_recipes": r"""
        with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') n from documents)
        select doc_id, first_value(doc_id) over w keep_id, count(*) over (partition by n) group_size,
            row_number() over w = 1 kept, sha256(n) text_sha256
        from t window w as (partition by n order by doc_id nulls last)
    """,
}
