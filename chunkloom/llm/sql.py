"""What the operators' queries return, in SQL, where SQL can say it.

The statements read whole tables and are made for small ones: they list all sets of a URL's
tokens, all passages' words, all matches' positions.
"""

from __future__ import annotations

from . import decontam, secrets, urlrules

#: Exact links by an inverted join of shingles, and components by reachability.
NEAR_DUPLICATES = r"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
 shingles as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from words),
 sizes as (select words.doc_id, count(s) as n from words left join shingles using (doc_id) group by words.doc_id),
 links as (select a.doc_id as a, b.doc_id as b from shingles a join shingles b using (s) join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
  where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))),
 reach as (select doc_id, doc_id as other from documents union select r.doc_id, l.b from reach r join links l on l.a = r.other)
select s.doc_id, s.n as n_shingles, c.component_id, s.doc_id = c.component_id as kept from sizes s join (select doc_id, min(other) as component_id from reach group by doc_id) c using (doc_id)
"""


def url_rules(p: urlrules.Params = urlrules.Params()) -> str:
    """Every set of a labelled URL's tokens is counted; the rules are those that pass, and a URL's
    confidence is that of the best rule among its own sets."""
    url = r"'://([^/?#]*)([^?#]*)(?:\?([^#]*))?'"
    fits = lambda r: f"((host = '{r[0].partition('/')[0]}' or ends_with(host, '.{r[0].partition('/')[0]}')) and starts_with(path, '/{r[0].partition('/')[2]}'))"
    longest = sorted(urlrules.LIST, key=lambda r: (len(r[0]), r[0]), reverse=True)
    rule = "case " + " ".join(f"when {fits(r)} then '{r[0]}'" for r in longest) + " end"
    says = "case " + " ".join(f"when {fits(r)} then '{r[1]}'" for r in longest) + " end"
    named = lambda mark, parts: f"list_transform(list_filter({parts}, lambda x: x <> ''), lambda x: '{mark}' || x)"
    return rf"""
with urls as (select page_id, translate(coalesce(regexp_extract(url, {url}, 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  coalesce(regexp_extract(url, {url}, 2), '') as path, coalesce(regexp_extract(url, {url}, 3), '') as query from pages),
 tokens as (select page_id, host, path, list_sort(list_distinct({named('h:', "string_split(host, '.')")}
  || {named('p:', "list_transform(string_split(path, '/'), lambda x: regexp_replace(x, '[0-9]+', '0', 'g'))")} || {named('q:', "list_transform(string_split(query, '&'), lambda x: split_part(x, '=', 1))")})) as t from urls),
 sets as (select page_id, list_filter(t, lambda x, i: (mask >> (i - 1)) & 1 = 1) as s from (select page_id, t, unnest(range(1, 1::bigint << len(t))) as mask from tokens)),
 marks as (select doc_id as page_id, quality = 0 or toxic = 1 as block from labels where page_id is not null),
 labelled as (select page_id, block from pages join marks using (page_id) where block is not null),
 total as (select count(*) as n, count(*) filter (block) as b, ceil(least(1.0, greatest({p.support}::double, {p.least_urls} / count(*)::double)) * count(*)) as least from labelled),
 counted as (select s, count(*) as n, count(*) filter (block) as b from sets join labelled using (page_id) group by s),
 rules as (select s, c.b / c.n::double as sure from counted c, total where c.b >= least and c.b / c.n::double >= {p.confidence} and (c.b / c.n::double) / (total.b / total.n::double) >= {p.lift}),
 fired as (select page_id, max(sure) as sure from sets join rules using (s) group by page_id),
 judged as (select page_id, host, path, {rule} as rule, {says} as says, coalesce(sure, 0.0)::double as confidence from tokens left join fired using (page_id))
select page_id, host, path, rule, coalesce(says, case when confidence > 0 then 'block' else 'allow' end) as verdict, confidence from judged
"""


def decontamination(p: decontam.Params = decontam.Params()) -> str:
    """BM25 over all passages and items, and the shares of shingles found."""
    word = r"'[\p{L}\p{N}_]+'"
    grams = lambda w, k: f"case when len({w}) = 0 then [] else list_distinct(list_transform(range(1, len({w}) - least({k}, len({w})) + 2), lambda i: array_to_string({w}[i:i + least({k}, len({w})) - 1], ' '))) end"
    k = p.shingle
    found = lambda part: f"(select count(*) from (select unnest({part}_s) as s) x where list_contains(case when len({part}) >= {k} then g else list_transform(range(1, len(near) - len({part}) + 2), lambda i: array_to_string(near[i:i + len({part}) - 1], ' ')) end, x.s))"
    return rf"""
with cut as (select item_id, text, regexp_extract(trim(text), '(?s)^(.*[.?!])\s+(.*)$', 1) as head, regexp_extract(trim(text), '(?s)^(.*[.?!])\s+(.*)$', 2) as tail from benchmark where item_id is not null and text is not null),
 items as (select item_id, regexp_extract_all(lower(text), {word}) as w, case when len(regexp_extract_all(lower(tail), {word})) > 0 then regexp_extract_all(lower(head), {word}) else regexp_extract_all(lower(text), {word}) end as q,
  regexp_extract_all(lower(tail), {word}) as a from cut where len(regexp_extract_all(lower(text), {word})) > 0),
 about as (select count(*) as n, sum(len(w))::double / count(*) as mean, max(len(w)) as stride from items),
 terms as (select item_id, len(w) as size, unnest(w) as t from items),
 tf as (select item_id, size, t, count(*) as c from terms group by all), df as (select t, count(*) as d from tf group by t),
 raw as (select item_id, t, ln(1 + (n - d + 0.5) / (d + 0.5)) * c * ({p.k1} + 1) / (c + {p.k1} * (1 - {p.b} + {p.b} * size / mean)) as v from tf join df using (t), about),
 weights as (select item_id, t, v / sum(v) over (partition by item_id) as weight from raw),
 docs as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), {word}) as w from documents),
 placed as (select doc_id, t, (i - 1) // stride as k from (select doc_id, unnest(w) as t, unnest(range(1, len(w) + 1)) as i from docs), about),
 passages as (select distinct doc_id, t, k from placed where t in (select t from df) union select doc_id, t, k - 1 from placed where k > 0 and t in (select t from df)),
 scores as (select doc_id, k, item_id, sum(weight) as score from passages join weights using (t) group by all having sum(weight) >= {p.least_score} - 1e-9),
 near as (select s.*, i.q, i.a, {grams('i.q', k)} as q_s, case when len(i.q) = len(i.w) and i.q = i.w then [] else {grams('i.a', k)} end as a_s, d.w[greatest(1, (k - 1) * stride + 1):(k + 3) * stride] as near
  from scores s join items i using (item_id) join docs d using (doc_id), about),
 shares as (select *, list_transform(range(1, len(near) - {k} + 2), lambda i: array_to_string(near[i:i + {k} - 1], ' ')) as g from near),
 hits as (select doc_id, item_id, k, score, q_s, a_s, {found('q')} as fq, case when len(a_s) = 0 then 0 else {found('a')} end as fa from shares),
 leaks as (select *, case when len(q_s) = 0 then 1.0 else fq / len(q_s)::double end as qo, case when len(a_s) = 0 then 1.0 else fa / len(a_s)::double end as ao from hits
  where (fq + fa) / (len(q_s) + len(a_s))::double >= {p.least_overlap} or (len(q_s) > 0 and fq / len(q_s)::double >= {p.least_overlap})),
 best as (select *, row_number() over (partition by doc_id, item_id order by round(score, 9) desc, k) as place from leaks)
select doc_id, item_id, round(score, 6) as score, qo::double as question_overlap, ao::double as answer_overlap from best where place = 1
"""


#: crc32 of a list of bytes, bit by bit; unsigned, as a bigint.
def _crc32(values: str) -> str:
    step = "list_reduce(list_concat([xor(c, b)], range(8)), lambda a, i: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {values}), lambda c, b: {step}), 4294967295)"


MEDIA = f"""
with bytes as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
 padded as (select doc_id, (length(h) // 2)::bigint as n_bytes, h || repeat('FF', (greatest(576, cast(ceil(length(h) / 2 / 576.0) as bigint) * 576) - length(h) // 2)::bigint) as p from bytes)
select doc_id, n_bytes, (length(p) // 2)::bigint as payload_bytes, sha256(unhex(p)) as payload_sha256,
 {_crc32("list_transform(range(32), lambda i: ('0x' || substr(p, (length(p) - 63 + 2 * i)::bigint, 2))::bigint)")}::bigint as tail_crc32 from padded
"""


def _located(name: str, pattern: str, table: str) -> str:
    """CTE text: rows of (doc_id, s, e, m) of a pattern's matches."""
    size = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda x: length(x))), 0)"
    return f"""{name}_m as (select doc_id, regexp_extract_all(text, {pattern}) as ms, regexp_split_to_array(text, {pattern}) as ps from {table}),
 {name} as (select doc_id, ({size('ps[1:i]')} + {size('ms[1:i - 1]')})::bigint as s, m from (select doc_id, ms, ps, unnest(ms) as m, unnest(range(1, len(ms) + 1)) as i from {name}_m where len(ms) > 0))"""


def _digest(base: tuple[str, ...], more: str) -> str:
    counts = ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in base)
    told = lambda cond: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, o) filter ({cond}), '')"
    return f"""said as (select doc_id, {counts}, {told(f'o < {len(base)}')} as base, {told('kind is not null')} as spans from docs left join (select * from base union all by name {more}) using (doc_id) group by doc_id)
select doc_id, {", ".join(f'n_{k}' for k in base)}, sha256(base) as base_sha256{', spans' if more else ''} from said"""


DOCS = "docs as (select doc_id, coalesce(text, '') as text from documents)"


def secret_scan(p: secrets.Params = secrets.Params()) -> str:
    """The fixed formats, the Markov models' counts, and every token's likelihood ratio."""
    any_case = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    names = "|".join([*map(any_case, ("password", "passwd", "secret", "token")), any_case("api") + "_?" + any_case("key")])
    assign = rf"""'({names})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'"""
    alphabet, size = secrets.ALPHABET, secrets.SIZE
    keys = " union all ".join(f"select '{a}' as a" for a in secrets.KEY_ALPHABETS)
    title = lambda w: f"upper(substr({w}, 1, 1)) || lower(substr({w}, 2))"
    number, small = "(1900 + i * 37 % 150)::varchar", "(i * 7 % 100)::varchar"
    styles = (
        "lower(a) || '_' || lower(b)", f"lower(a) || '_' || lower(b) || '_' || {small}", f"lower(a) || {title('b')}", f"lower(a) || '-' || lower(b) || '-' || {number}",
        "upper(a) || '_' || upper(b)", f"{title('a')} || {title('b')} || {small}", "lower(a) || '/' || lower(b)", f"{number} || '-' || {small} || '-' || lower(a)",
    )
    styled = "case i % 8 " + " ".join(f"when {k} then {s}" for k, s in enumerate(styles)) + " end"
    steps = lambda t: f"unnest(list_transform(range(1, length({t})), lambda j: strpos('{alphabet}', substr({t}, j, 1)) * {size} + strpos('{alphabet}', substr({t}, j + 1, 1))))"
    code = "strpos('" + alphabet + "', substr({0}, {1}::bigint, 1)) "
    return rf"""
with {DOCS}, {_located('assign_all', assign, 'docs')}, {_located('access_all', "'AKIA[A-Z0-9]+'", 'docs')}, {_located('hex_all', "'[0-9a-f]{24,}'", 'docs')},
 assign as (select *, regexp_extract(m, {assign}, 2) as value from assign_all where length(regexp_extract(m, {assign}, 2)) >= 6), access as (select * from access_all where length(m) >= 20),
 base as (select doc_id, s, s + length(m) as e, 'assign' as kind, 0 as o from assign union all select doc_id, s, s + length(m), 'access', 1 from access union all select doc_id, s, s + length(m), 'hex', 2 from hex_all),
 {_located('runs', r"'[\p{L}\p{N}+/_=-]+'", 'docs')},
 tokens as (select doc_id, s, s + length(m) as e, m from runs where regexp_full_match(m, '[A-Za-z0-9+/_=-]{{16,}}') and regexp_matches(m, '[A-Za-z]')),
 picked as (select doc_id from docs where ('0x' || substr(md5(doc_id::varchar), 1, 7))::bigint < least(1.0, {float(p.sample)} / (select greatest(1, count(*)) from docs)) * 268435456),
 values_ as (select value as t from assign join picked using (doc_id) where regexp_matches(value, '[0-9]') and length(value) >= 8 union all select m from access join picked using (doc_id) union all select m from hex_all join picked using (doc_id)),
 words as (select doc_id, m as a, row_number() over (partition by doc_id order by m) - 1 as i, lead(m) over (partition by doc_id order by m) as b from (select distinct doc_id, m from runs join picked using (doc_id) where regexp_full_match(m, '[A-Za-z][a-z]{{2,19}}'))),
 samples as (select 1 as y, t from values_ union all select 0, a from words union all select 0, {styled} from words where b is not null),
 seen as (select y, k, count(*)::double as n from (select y, {steps('t')} as k from samples where length(t) >= 2) group by all),
 keys as ({keys}),
 even as (select 1 as y, {code.format('x.a', 'p')} * {size} + {code.format('x.a', 'q')} as k, {p.per_alphabet} / (length(x.a) * length(x.a))::double as n from keys x, range(1, 65) u(p), range(1, 65) v(q) where p <= length(x.a) and q <= length(x.a)),
 counts as (select y, k, sum(n) as n from (select * from seen union all select * from even) group by all),
 rows_ as (select y, k // {size} as a, sum(n) as n from counts group by all),
 grid as (select y, a, b, a * {size} + b as k from range(2) y(y), range({size}) a(a), range({size}) b(b)),
 logs as (select g.y, g.k, ln((coalesce(c.n, 0) + {p.smooth}) / (coalesce(r.n, 0) + {p.smooth} * {size})) as lp from grid g left join counts c on c.y = g.y and c.k = g.k left join rows_ r on r.y = g.y and r.a = g.a),
 ratios as (select x.k, round(x.lp - z.lp, 6) as r from logs x join logs z on z.k = x.k and x.y = 1 and z.y = 0),
 apart as (select * from tokens t where not exists (select 1 from base b where b.doc_id = t.doc_id and t.s < b.e and b.s < t.e)),
 scored as (select doc_id, s, e, sum(r) as total from (select doc_id, s, e, {steps('m')} as k from apart) join ratios using (k) group by all),
 markov as (select doc_id, s, e, 'markov' as kind, 3 as o from scored where total >= greatest({p.least_ratio}, {p.least_mean} * (e - s)) and exists (select 1 from seen where y = 0)),
 {_digest(secrets.BASE, 'select * from markov')}
"""


def personal_data_base() -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: case when i % 2 = 1 then substr({digits}, -i, 1)::int else case when substr({digits}, -i, 1)::int > 4 then substr({digits}, -i, 1)::int * 2 - 9 else substr({digits}, -i, 1)::int * 2 end end)) % 10 = 0"
    span = lambda k, o: f"select doc_id, s, s + length(m) as e, '{k}' as kind, {o} as o from {k}"
    return rf"""
with {DOCS}, {_located('email', r"'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'", 'docs')}, {_located('ip_all', r"'[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'", 'docs')},
 {_located('card_all', r"'[0-9]([\x20-]?[0-9])+'", 'docs')}, {_located('phone_all', r"'\+[0-9][\x20().0-9-]+[0-9]'", 'docs')},
 ip as (select * from ip_all where list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 and coalesce(try_cast('0' || ltrim(x, '0') as bigint), 999) <= 255))),
 card as (select * from card_all where length({digits}) between 14 and 19 and {luhn}), phone as (select * from phone_all where length({digits}) between 10 and 15),
 base as ({span('email', 0)} union all {span('ip', 1)} union all {span('card', 2)} union all {span('phone', 3)}),
 {_digest(('email', 'ip', 'card', 'phone'), '').replace(' union all by name ', ' ')}
"""
