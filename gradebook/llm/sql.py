"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

SUFFIX_DEDUP = """
with d as (
  select doc_id, hex(encode(coalesce(text, ''))) h, octet_length(encode(coalesce(text, ''))) n
  from documents),
starts as (
  select doc_id, i, substr(h, 2 * i + 1, 100) s
  from (select doc_id, h, unnest(range(0, n - 49)) i from d where n >= 50)),
hit as (
  select doc_id, i from (
    select doc_id, i, min(doc_id) over (partition by s) m from starts) where doc_id > m),
runs as (
  select doc_id, i, sum(new) over (partition by doc_id order by i) g from (
    select doc_id, i,
      case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end new
    from hit)),
spans as (select doc_id, min(i) a, max(i) + 50 b from runs group by doc_id, g),
kept as (
  select s.doc_id, sum(b - a) removed, count(*) spans,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a)
      || substr(any_value(h), 2 * max(b) + 1) rest
  from (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) before
        from spans) s join d using (doc_id) group by s.doc_id)
select d.doc_id, d.n::bigint n_bytes, coalesce(removed, 0)::bigint n_removed,
  coalesce(spans, 0)::bigint n_spans,
  sha256(unhex(coalesce(rest, h))) kept_sha256
from d left join kept using (doc_id)
"""

SOURCE_MIX = rf"""
with sized as (
  select doc_id, source,
    coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::bigint size,
    md5('mix-1:' || coalesce(doc_id::varchar, 'null')) k
  from documents),
per_source as (
  select source, sum(size)::bigint source_size,
    (row_number() over (order by source nulls last) - 1) % 3 place
  from sized group by source),
weighted as (
  select source, source_size, case place when 0 then 3.0::double when 1 then 1.0::double
    else 2.0::double end w, (source_size * 2)::double cap from per_source),
levels as (
  select *, (sum(source_size) over () * 1.5::double
      - coalesce(sum(cap) over (order by cap / w, source nulls last
          rows between unbounded preceding and 1 preceding), 0.0::double))
    / sum(w) over (order by cap / w, source nulls last
          rows between current row and unbounded following) level
  from weighted),
open as (select level from levels where cap / w > level order by cap / w limit 1),
targets as (
  select source, source_size,
    coalesce(least(cap, (select level from open) * w), cap) target from levels),
cuts as (
  select source, source_size, target,
    case when source_size > 0 then least(2, round(target)::bigint // source_size) else 0 end epochs
  from targets),
placed as (
  select s.doc_id, s.size, c.source_size, c.target, c.epochs,
    round(c.target)::bigint - c.epochs * c.source_size rest,
    sum(s.size) over (partition by s.source order by s.k, s.doc_id, s.size) upto
  from sized s join cuts c on s.source is not distinct from c.source)
select doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, rest - (upto - size))))::bigint taken
from placed
"""

# Kind, rank, pattern, check.
_KINDS = (
    ("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", 1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
     "list_max([try_cast(x as hugeint) for x in string_split(hit, '.')]) <= 255"),
    ("card", 2, r"[0-9]([\x20-]?[0-9])+",
     "length(digits) between 14 and 19 and list_sum([case when (length(digits) - i) % 2 = 0 "
     "then digits[i]::int else digits[i]::int * 2 - (case when digits[i]::int > 4 then 9 else 0 "
     "end) end for i in range(1, length(digits) + 1)]) % 10 = 0"),
    ("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) between 10 and 15"),
    ("iban", 4, r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
     "list_reduce(list_prepend(0::bigint, [case when c between '0' and '9' then c::bigint "
     "else ascii(c)::bigint - 55 end for c in string_split(substr(hit, 5) || substr(hit, 1, 4), "
     "'')]), lambda acc, v: case when v > 9 then (acc * 100 + v) % 97 else (acc * 10 + v) % 97 "
     "end) = 1"),
    ("ssn", 5, r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
     "substr(hit, 1, 3) not in ('000', '666') and regexp_matches(lower(substr(text, "
     "greatest(start - 39, 1), least(start, 40))), 'ssn|social security|tax id|taxpayer')"),
)


def _personal_data() -> str:
    parts = " union all ".join(f"""
      select doc_id, text, '{kind}' kind, {rank} rank, unnest(range(1, len(hits) + 1)) j, hits,
        gaps
      from (select doc_id, text, regexp_extract_all(text, '{pattern}') hits,
              string_split_regex(text, '{pattern}') gaps from d
            where regexp_matches(text, '{pattern}'))"""
                               for kind, rank, pattern, _ in _KINDS)
    checks = " ".join(f"when '{kind}' then {check}" for kind, _, _, check in _KINDS)
    return f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
hits as ({parts}),
placed as (
  select doc_id, text, kind, rank, hits[j] hit,
    regexp_replace(hits[j], '[^0-9]', '', 'g') digits,
    (list_sum([length(x) for x in gaps[1:j]])
      + coalesce(list_sum([length(x) for x in hits[1:j - 1]]), 0))::bigint start
  from hits),
good as (
  select doc_id, kind, rank, start, start + length(hit) stop from placed
  where case kind {checks} end),
per_doc as (
  select doc_id, count(*) filter (kind = 'email') n_email, count(*) filter (kind = 'ip') n_ip,
    count(*) filter (kind = 'card') n_card, count(*) filter (kind = 'phone') n_phone,
    coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank)
      filter (rank < 4), '') base,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) spans
  from good group by doc_id)
select d.doc_id, coalesce(n_email, 0)::bigint n_email, coalesce(n_ip, 0)::bigint n_ip,
  coalesce(n_card, 0)::bigint n_card, coalesce(n_phone, 0)::bigint n_phone,
  sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from d left join per_doc using (doc_id)
"""


CHAT_FORMAT = r"""
with rows_ as (
  select conv_id::bigint conv_id, turn::bigint turn, coalesce(role, '') as role,
    coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped as (
  select *, length(regexp_replace(role, '([\\<\[|])', '\\\1', 'g'))
    + length(regexp_replace(text, '([\\<\[|])', '\\\1', 'g')) + 10 chars from rows_)
select conv_id, count(*)::bigint n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), ''))
    loss_sha256,
  sum(chars)::bigint formatted_chars, 0::bigint rewrites
from escaped group by conv_id
"""

JACCARD_JOIN = rf"""
with recursive d as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{_WORD}'), []::varchar[]) w from documents),
s as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') x
  from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) i from d where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
links as (
  select a.doc_id a, b.doc_id b
  from s a join s b on a.x = b.x and a.doc_id <> b.doc_id
  join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, na.n, nb.n
  having 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach(doc_id, other) as (
  select doc_id, doc_id from d
  union select r.doc_id, l.b from reach r join links l on l.a = r.other)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint n_shingles, min(r.other) component_id
from d join reach r using (doc_id) left join n using (doc_id) group by d.doc_id
"""

HILBERT_SEARCH = """
with v as (
  select vec_id, list_transform(embedding, lambda x: x::double) e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
f as (
  select vec_id, e, sqrt(list_reduce(list_prepend(0.0::double,
    list_transform(e, lambda x: x * x)), lambda a, b: a + b)) norm from v),
u as (select distinct * from f where norm > 0),
p as (
  select q.vec_id query_id, c.vec_id vec_id,
    list_reduce(list_prepend(0.0::double, list_transform(range(1, len(q.e) + 1),
      lambda i: q.e[i] * c.e[i])), lambda a, b: a + b) / (q.norm * c.norm) score
  from u q join u c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0),
r as (
  select query_id, vec_id, score,
    row_number() over (partition by query_id order by score desc, vec_id) rank from p)
select query_id, rank::integer rank, vec_id, score from r where rank <= 5
"""

FILTER_AUDIT = rf"""
with recursive texts as (
  select doc_id, coalesce(source, '') part, coalesce(text, '') as body,
    coalesce(regexp_extract_all(text, '{_WORD}'), []::varchar[]) w,
    min(doc_id) over (partition by coalesce(text, '')) least_id from documents),
flags as (
  select doc_id::bigint doc_id, max(coalesce(quality = 1, false)::int) good,
    max(coalesce(toxic = 1, false)::int) toxic from labels where doc_id is not null group by 1),
masks as (
  select part, coalesce(good, 0) good, coalesce(toxic, 0) toxic,
    case when len(w) < 50 then 1 else 0 end
    | case when 100 * len(list_distinct(w)) < 65 * len(w) then 2 else 0 end
    | case when 100 * length(regexp_replace(body, '[^A-Z]+', '', 'g')) > 5 * length(body)
        then 4 else 0 end
    | case when regexp_matches(body, '[#$%&*|]') then 8 else 0 end
    | case when coalesce(texts.doc_id > least_id, false) then 16 else 0 end mask
  from texts left join flags using (doc_id)),
cells as (
  select part, mask, count(*) n, sum(good) good, sum(toxic) toxic from masks group by part, mask),
letters(letter, letter_bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
walk(prefix, letter, bit, done, step) as (
  select '', '', 0, 0, 0
  union all
  select prefix || l.letter, l.letter, letter_bit, done | bit, step + 1
  from walk join letters l on ((done | bit) & letter_bit) = 0),
steps as (
  select part, prefix, letter, step,
    sum(case when (mask & (done | bit)) = 0 then n else 0 end) kept,
    sum(case when (mask & done) = 0 and (mask & bit) <> 0 then n else 0 end) removed,
    sum(case when (mask & done) <> 0 and (mask & bit) <> 0 then n else 0 end) redundant,
    sum(case when mask = bit then n else 0 end) unique_fails,
    sum(case when (mask & done) = 0 and (mask & bit) <> 0 then good else 0 end) good_lost,
    sum(case when (mask & done) = 0 and (mask & bit) <> 0 then toxic else 0 end) toxic_lost
  from walk, cells where step > 0 group by part, prefix, letter, step),
orders as (select prefix filter_order, unnest(range(1, 6)) upto from walk where step = 5)
select part, filter_order, step::integer step, kept::bigint kept, removed::bigint removed,
  redundant::bigint redundant, unique_fails::bigint unique_fails, good_lost::bigint good_lost,
  toxic_lost::bigint toxic_lost,
  (sum(removed) over (partition by part, letter))::bigint shapley
from steps join orders on prefix = substr(filter_order, 1, upto)
"""

DIVERGENCE_AUDIT = r"""
with d as (
  select row_number() over () id, coalesce(lang, '') lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w from documents),
found as (select id, lang, source, unnest(w) term from d),
vocabulary as (
  select lang, term, count(*) lang_tf from found group by lang, term
  having count(distinct id) >= 30),
groups as (select distinct lang, source from d),
counted as (select lang, source, term, count(*) n from found group by lang, source, term),
filled as (
  select g.lang, g.source, v.term, v.lang_tf, coalesce(c.n, 0) tf
  from groups g join vocabulary v using (lang) left join counted c using (lang, source, term)),
shares as (
  select lang, source, term, tf,
    1 + (1000000000::hugeint * (tf + 5)) // (sum(tf) over own + 5 * count(*) over own) p,
    1 + (1000000000::hugeint * (lang_tf + 5)) // (sum(lang_tf) over own + 5 * count(*) over own) q
  from filled window own as (partition by lang, source)),
apart as (
  select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) v
  from shares a join shares b using (lang, term) where a.source <> b.source
  group by a.lang, a.source, b.source),
rows_ as (
  select a.lang, a.source, 'pair' part, b.source item, coalesce(v, 0) v
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join apart x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all
  select lang, source, 'term', term, p - q from shares where tf > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by v desc, item) r from rows_)
select lang, source, part, item, v::bigint as value, r::integer rank from ranked
where part = 'pair' or r <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": SUFFIX_DEDUP,
        "op2_source_mix": SOURCE_MIX,
        "op3_personal_data": _personal_data(),
        "op5_chat_format": CHAT_FORMAT,
        "op8_jaccard_join": JACCARD_JOIN,
        "op10_hilbert_search": HILBERT_SEARCH,
        "op11_filter_audit": FILTER_AUDIT,
        "op13_source_divergence": DIVERGENCE_AUDIT,
    }
