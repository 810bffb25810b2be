"""DuckDB SQL for the queries that SQL can express; views carry the table names."""

from paroxys.llm.common import LOWER, UPPER

_W = r"[^\x20\x09-\x0D]+"

EXACT_DEDUP = r"""
with t as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm
  from documents
), h as (select doc_id, sha256(norm) as text_sha256 from t)
select doc_id,
       min(doc_id) over (partition by text_sha256) as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       doc_id = min(doc_id) over (partition by text_sha256) as kept,
       text_sha256
from h
"""

WARC = r"""
with t as (
  select page_id, coalesce(html, '') as body from pages
), h as (
  select page_id, strlen(body) as payload_bytes, sha256(body) as payload_digest from t
), f as (
  select *, min(page_id) over (partition by payload_digest) as origin from h
)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> origin then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> origin then origin end as refers_to
from f
"""

CHAT = r"""
with t as (
  select conv_id, turn, coalesce(role, 'unknown') as speaker, coalesce(text, '') as text from conversations
), people as (
  select distinct conv_id, speaker as perspective from t where speaker <> 'system'
), seen as (
  select t.*, perspective,
         case when speaker = perspective then 'assistant' when speaker = 'system' then 'system' else 'user' end as seen_as
  from t join people on t.conv_id is not distinct from people.conv_id
), heads as (
  select *, '<|im_start|>' || seen_as
            || case when seen_as = 'user' then ' name=' || speaker else '' end || chr(10) as head
  from seen
), r as (
  select *, head || text || '<|im_end|>' || chr(10) as rendered from heads
), p as (
  select *,
         row_number() over w - 1 as place,
         sum(length(rendered)) over w as stop
  from r
  window w as (partition by conv_id, perspective order by turn nulls first, speaker, text
               rows between unbounded preceding and current row)
)
select conv_id, perspective, place, turn, seen_as,
       case when seen_as = 'user' then speaker end as name,
       rendered, stop - length(rendered) as start, stop as "end",
       seen_as = 'assistant' as mask,
       case when seen_as = 'assistant' then stop - length(rendered) + length(head) end as learn_start
from p
"""

DECONTAMINATION = r"""
with d as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from documents
), dw as (
  select doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from d
), b as (
  select item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), windows as (
  select distinct item_id, array_to_string(w[i:i + 9], ' ') as g, least(len(w), 10) as n
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)
), lengths as (select distinct n from windows),
grams as (
  select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, lengths where len(w) >= n)
), hits as (
  select doc_id, i, g.n, item_id from grams g join windows x on g.g = x.g and g.n = x.n
), covered as (
  select doc_id, count(distinct p) as n_hit
  from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id
), items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names
  from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id
)
select dw.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join covered using (doc_id) left join items using (doc_id)
"""


def _split(nodes: str, parent: str, budget: str, name: str) -> str:
    """One level of the budget tree over ``nodes`` (cap, weight, given budget, names)."""
    part = f"partition by {parent}" if parent else ""
    return f"""
  select *, case when lvl is null or rank_ < lvl.r then cap
                 else cast(floor(cast(lvl.l as double) * weight / lvl.s) as bigint) end as budget
  from (
    select *, min(case when floor(cast(left_ as double) * weight / onward) < cap
                       then {{'r': rank_, 'l': left_, 's': onward}} end) over ({part}) as lvl
    from (
      select *, row_number() over o as rank_,
             greatest({budget} - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0), 0) as left_,
             sum(weight) over (o rows between current row and unbounded following) as onward
      from {nodes}
      window o as ({part} order by cast(cap as double) / weight, cap, {name})
    )
  )"""


def _weights(column: str, weights: dict[str, int]) -> str:
    cases = " ".join(f"when '{k}' then {v}" for k, v in sorted(weights.items()))
    return f"case {column} {cases} else 1 end" if cases else "1"


def source_mix(weights: dict[str, dict[str, int]], share: float, epochs: int, seed: int) -> str:
    return rf"""
with named as (
  select doc_id, lang as own_lang, source as own_source,
         case when regexp_extract(source, '([0-9]+)$', 1) <> '' then
           ['web', 'books', 'code', 'forum'][cast(regexp_extract(source, '([0-9]+)$', 1) as bigint) % 4 + 1]
         end as d0,
         coalesce(lang, 'unknown') as lang, coalesce(source, 'unknown') as source,
         coalesce(cast(doc_id as varchar), '') as uid,
         len(regexp_extract_all(coalesce(text, ''), '{_W}')) as n
  from documents
), slim as (select *, coalesce(d0, 'unknown') as domain from named),
leaves as (
  select domain, lang, source, sum(n) as tokens, sum(n) * {epochs} as cap from slim group by all
), total as (select cast(floor(coalesce(sum(n), 0) * cast({share} as double)) as bigint) as total from slim),
n1 as (select domain, sum(cap) as cap, {_weights("domain", weights.get("domain", {}))} as weight from leaves group by domain),
b1 as ({_split("n1", "", "(select total from total)", "domain")}),
n2 as (select l.domain, lang, sum(l.cap) as cap, {_weights("lang", weights.get("lang", {}))} as weight, any_value(b1.budget) as given
       from leaves l join b1 on l.domain = b1.domain group by l.domain, lang),
b2 as ({_split("n2", "domain", "given", "lang")}),
n3 as (select l.domain, l.lang, source, l.cap, tokens, {_weights("source", weights.get("source", {}))} as weight, b2.budget as given
       from leaves l join b2 on l.domain = b2.domain and l.lang = b2.lang),
b3 as ({_split("n3", "domain, lang", "given", "source")}),
plan as (
  select domain, lang, source, case when tokens > 0 then budget // tokens else 0 end as whole,
         case when tokens > 0 then budget % tokens else budget end as rest
  from b3
), units as (
  select domain, lang, source, uid, whole, rest, sum(n) as n, md5('{seed}:' || cast(whole as varchar) || ':' || uid) as h
  from slim join plan using (domain, lang, source) group by all
), taken as (
  select domain, lang, source, uid, true as last
  from (select *, sum(n) over (partition by domain, lang, source order by h, uid) as upto from units)
  where upto <= rest and rest > 0
), times as (
  select s.*, whole + case when last then 1 else 0 end as times
  from slim s join plan using (domain, lang, source) left join taken using (domain, lang, source, uid)
)
select doc_id, domain, own_lang as lang, own_source as source, n as n_tokens, epoch
from (select *, unnest(range(0, cast(times as bigint))) as epoch from times)
"""


_A = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# CRC-32 with bit operations, eight bits at a time from a table that SQL builds itself.
IMPORTANCE = rf"""
with recursive bits as (
  select range::bigint as b, range::bigint as c, 0 as k from range(256)
  union all
  select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8
), crc_table as materialized (select list(c order by b) as tab from bits where k = 8
), d as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_A}') as w
  from documents
), b as (
  select regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_A}') as w from benchmark
), df as (
  select r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from d
), bf as (
  select unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from b
), named as materialized (
  select f, list_reduce(
           list_concat([4294967295::bigint],
                       list_transform(range(1, strlen(f) + 1),
                                      lambda i: ('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::bigint)),
           lambda a, x: xor(tab[(xor(a, x) & 255) + 1], a >> 8)) as state
  from (select f from df union select f from bf), crc_table
), hashed as (select f, xor(state, 4294967295) % 10000 as bucket from named),
dc as (select bucket, count(*) as s from df join hashed using (f) group by bucket),
bc as (select bucket, count(*) as t from bf join hashed using (f) group by bucket),
total as (select coalesce((select sum(s) from dc), 0)::double as alls, coalesce((select sum(t) from bc), 0)::double as allt),
gain as (
  select bucket, floor(1000 * ln((coalesce(t, 0)::double + 1) * (alls + 10000)
                                 / ((coalesce(s, 0)::double + 1) * (allt + 10000))))::bigint as gain
  from (select range as bucket from range(10000)) left join dc using (bucket) left join bc using (bucket), total
), weights as (
  select r, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight
  from df join hashed using (f) join gain using (bucket) group by r
), scored as (
  select d.r, doc_id, len(w) as n, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln(
           (('0x' || sha256('7:' || coalesce(doc_id::varchar, ''))[1:8])::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from d left join weights using (r)
), ranked as (
  select *, row_number() over (partition by n >= 20 order by score desc, doc_id nulls last) as place,
         count(*) filter (n >= 20) over () as able
  from scored
)
select doc_id, n_features::bigint as n_features, weight, score,
       case when n >= 20 and place <= able * 25 // 100 then place end as rank
from ranked
"""


def quality_rules(rules: dict[str, tuple[str, str]], base_failed: str, rounds: int, hits: float, misses: float) -> str:
    """Figures, votes, and the estimation as a recursion over one row of parameters."""
    n = range(len(rules))
    ballots = ", ".join(
        f"case when {bad} then -1 when {good} then 1 else 0 end as v{j}" for j, (bad, good) in enumerate(rules.values())
    )
    names = ", ".join(f"v{j}" for j in n)
    good = ", ".join(
        f"(coalesce(sum(n * q) filter (v{j} = 1), 0) + {hits}) / (coalesce(sum(n * q) filter (v{j} <> 0), 0) + {hits + misses})"
        for j in n
    )
    bad = ", ".join(
        f"(coalesce(sum(n * (1 - q)) filter (v{j} = -1), 0) + {hits}) / (coalesce(sum(n * (1 - q)) filter (v{j} <> 0), 0) + {hits + misses})"
        for j in n
    )
    odds = " + ".join(
        f"case v{j} when 1 then ln(g[{j + 1}] / (1 - b[{j + 1}])) when -1 then ln((1 - g[{j + 1}]) / b[{j + 1}]) else 0 end"
        for j in n
    )
    quality = f"1 / (1 + exp(-(ln(p / (1 - p)) + {odds})))"
    update = f"(sum(n * q) + 1) / (sum(n) + 2) as p, [{good}] as g, [{bad}] as b"
    ups = " + ".join(f"(v{j} = 1)::int" for j in n)
    said = " + ".join(f"(v{j} <> 0)::int" for j in n)
    return rf"""
with recursive d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '{_W}') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{_W}')) as lines
  from documents
), places as (select r, w, unnest(range(1, len(w) + 1)) as i from d
), windows as (
  select r, i, count(*) over (partition by r, g) as c
  from (select r, i, list_aggregate(w[i:i + 7], 'string_agg', ' ') as g from places where i + 7 <= len(w))
), repeated as (
  select r, count(distinct p) as n from (select r, unnest(range(i, i + 8)) as p from windows where c > 1) group by r
), tops as (
  select r, max(c) as n from (select r, w[i] as x, count(*) as c from places group by r, x) group by r
), f as materialized (
  select d.r, doc_id, len(w) as n_words,
         length(array_to_string(w, '')) as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
         len(lines) - len(list_distinct(lines)) as n_dup_lines,
         coalesce(repeated.n, 0) as n_repeat_words,
         len(lines) as n_lines,
         length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) as n_letters,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_capitals,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as n_echoes,
         coalesce(tops.n, 0) as n_top
  from d left join repeated using (r) left join tops using (r)
), v as materialized (select *, {base_failed} as base_failed, {ballots} from f
), patterns as materialized (
  select {names}, count(*)::double as n from v group by all
), start as (select *, ({ups} + 0.5::double) / ({said} + 1) as q from patterns
), model as (
  select 1 as round_, {update} from start
  union all
  select round_ + 1, {update}
  from (select round_, n, {names}, {quality} as q from patterns, model where round_ < {rounds}) group by round_
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and {quality} >= 0.5 as kept, round({quality}, 6) as quality
from v, model where round_ = {rounds}
"""


def _field(value: str) -> str:
    return f"case when {value} is null then '-' else strlen({value}::varchar) || ':' || {value}::varchar end"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


MANIFEST = rf"""
with recursive bits as (
  select range::bigint as b, range::bigint as c, 0 as k from range(256)
  union all
  select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8
), crc_table as materialized (select list(c order by b) as tab from bits where k = 8
), d as (
  select coalesce('+' || source, '') as key, doc_id,
         xor(list_reduce(list_concat([4294967295::bigint],
               list_transform(range(1, length(coalesce(doc_id::varchar, '')) + 1),
                              lambda i: ascii(substr(coalesce(doc_id::varchar, ''), i, 1))::bigint)),
             lambda a, x: xor(tab[(xor(a, x) & 255) + 1], a >> 8)), 4294967295) % 5 = 0 as touched,
         {_leaf("text")} as leaf,
         {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} as changed
  from documents, crc_table
), leaves as materialized (
  select row_number() over () as r, *,
         row_number() over (partition by key order by doc_id nulls first, leaf) - 1 as pos,
         count(*) over (partition by key) as size
  from d
), tree as (
  select 0 as level, key, pos, size, leaf as digest from leaves
  union all
  select level + 1, key, pos // 16, any_value((size + 15) // 16), sha256(string_agg(digest, '' order by pos))
  from tree where size > 1 group by level, key, pos // 16
), subroots as materialized (
  select key, digest, row_number() over (order by key) - 1 as pos, count(*) over () as size from tree where size = 1
), top as (
  select 0 as level, pos, size, digest from subroots
  union all
  select level + 1, pos // 16, any_value((size + 15) // 16), sha256(string_agg(digest, '' order by pos))
  from top where size > 1 group by level, pos // 16
), inner_sides as (
  select level, key, pos,
         coalesce(string_agg(digest, '') over (partition by level, key, pos // 16 order by pos
                  rows between unbounded preceding and 1 preceding), '') as left_,
         coalesce(string_agg(digest, '') over (partition by level, key, pos // 16 order by pos
                  rows between 1 following and unbounded following), '') as right_
  from tree where size > 1
), top_sides as (
  select level, pos,
         coalesce(string_agg(digest, '') over (partition by level, pos // 16 order by pos
                  rows between unbounded preceding and 1 preceding), '') as left_,
         coalesce(string_agg(digest, '') over (partition by level, pos // 16 order by pos
                  rows between 1 following and unbounded following), '') as right_
  from top where size > 1
), steps as materialized (
  select r, row_number() over (partition by r order by part, level) as step, left_, right_
  from (
    select r, 0 as part, s.level, left_, right_
    from leaves l join inner_sides s on l.key = s.key and s.pos = l.pos // (16 ** s.level)::bigint
    union all
    select r, 1, s.level, left_, right_
    from leaves l join subroots u on l.key = u.key join top_sides s on s.pos = u.pos // (16 ** s.level)::bigint
  )
), fold as (
  select r, 0 as step, case when touched then changed else leaf end as digest from leaves
  union all
  select f.r, f.step + 1, sha256(left_ || f.digest || right_)
  from fold f join steps s on f.r = s.r and s.step = f.step + 1
), folded as (select r, arg_max(digest, step) as folded_root from fold group by r
), proofs as (select r, sha256(string_agg(left_ || right_, '' order by step)) as proof_sha256 from steps group by r
), root as (select digest as root from top where size = 1)
select doc_id, leaf, u.digest as subroot, root, coalesce(proof_sha256, sha256('')) as proof_sha256,
       folded_root, folded_root = root as verified
from leaves l join subroots u on l.key = u.key join folded using (r) left join proofs using (r), root
"""


def oracles() -> dict[str, str]:
    from paroxys.llm import mixing, quality
    from paroxys.llm.queries import MIX_WEIGHTS

    return {
        "op1_exact_dedup": EXACT_DEDUP,
        "op3_source_mix": source_mix(MIX_WEIGHTS, mixing.BUDGET_SHARE, mixing.MAX_EPOCHS, mixing.SEED),
        "op4_warc_revisits": WARC,
        "op8_chat_rotation": CHAT,
        "op10_decontamination": DECONTAMINATION,
        "op11_quality_rules": quality_rules(
            quality.RULES, quality.BASE_FAILED, quality.ROUNDS, quality.HITS, quality.MISSES
        ),
        "op12_importance": IMPORTANCE,
        "op13_manifest": MANIFEST,
    }
