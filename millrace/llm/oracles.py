"""DuckDB SQL of the operators that SQL can express on whole tables."""

from __future__ import annotations

from millrace.llm import collocations, fill_in_middle, near_dups, secrets, sharding

# ---- sharding: crc32 by its table, numbers walked through the Feistel network


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def _bytes(text: str) -> str:
    return f"list_transform(regexp_extract_all(hex({text}), '..'), lambda h: concat('0x', h)::bigint)"


def _crc32(text: str) -> str:
    step = f"xor(c >> 8, list_extract({_crc_table()}, (xor(c, b) & 255) + 1))"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {_bytes(text)}), lambda c, b: {step}), 4294967295::bigint)"


def _once(source: str, seed: int = 17) -> str:
    """(row_no, n, a, b, x): x after one step of the permutation of 0..a*b-1."""
    sql = f"select row_no, n, a, b, x // b as l, x % b as r from ({source})"
    p = sharding._P
    for i, (k, m, z) in enumerate(sharding._round_keys(seed)):
        y = f"((r % {p} * {k} + {m}) % {p})"
        sql = f"select row_no, n, a, b, r as l, (l + ({y} * {y} + {z}) % {p} * {k} % {p}) % {'a' if i % 2 == 0 else 'b'} as r from ({sql})"
    return f"select row_no, n, a, b, l * b + r as x from ({sql})"


_SIZED = f"select doc_id, octet_length(encode(coalesce(text, ''))) + 1 as size, {_crc32('coalesce(text, chr(32)[1:0])')} as text_crc32 from documents"
SHARDING = f"""with recursive s as ({_SIZED}),
r as (select *, row_number() over (order by doc_id nulls first, text_crc32, size) - 1 as row_no from s),
d as (select n, floor(sqrt(greatest(n - 1, 0)::double))::bigint + 1 as a from (select count(*) as n from documents)),
e as (select n, a, greatest((n + a - 1) // a, 1) as b from d),
walk as ({_once('select row_no, n, a, b, row_no as x from r, e')} union all {_once('select row_no, n, a, b, x from walk where x >= n')})
select doc_id, size::bigint as size, text_crc32, 'rows' as law, (x % 8)::int as shard, (x // 8)::bigint as slot, null::int as grown_shard
from walk join r using (row_no) where x < n"""

# ---- near copies: exact multiset similarity of all pairs that share a shingle, and the classes of their links

_SPACES = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
NEAR_DUPS = f"""with recursive
w as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_SPACES}'), lambda x: x <> '') as words from documents),
g as (select doc_id, case when len(words) >= {near_dups.SHINGLE} then list_transform(range(1, len(words) - {near_dups.SHINGLE - 2}), lambda i: array_to_string(words[i:i + {near_dups.SHINGLE - 1}], ' ')) when len(words) > 0 then [array_to_string(words, ' ')] else [] end as s from w),
e as (select doc_id, md5(s) as s, row_number() over (partition by doc_id, s) as k from (select doc_id, unnest(s) as s from g)),
z as (select doc_id, count(*) as n from e group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from e x join e y on x.s = y.s and x.k = y.k and x.doc_id < y.doc_id group by all),
l as (select a, b from p join z x on x.doc_id = a join z y on y.doc_id = b where c::double / (x.n + y.n - c) >= {near_dups.SIMILARITY}),
m as (select a, b from l union all select b, a from l),
r as (select doc_id as a, doc_id as b from documents union select r.a, m.b from r join m on m.a = r.b),
c as (select a as doc_id, min(b) as class_id from r group by a)
select doc_id, class_id, count(*) over (partition by class_id) as class_size from c"""

# ---- secrets: every rule by expression; the texts between matches give their places

_EXPRESSIONS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?[A-Za-z0-9+/_.=-]+""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+",
    "private_key": "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", "web_token": r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    "hosting_token": "gh[pousr]_[A-Za-z0-9]+", "chat_token": "xox[abprs]-[A-Za-z0-9-]+",
}


def _spans(rank: int, kind: str) -> str:
    x = _EXPRESSIONS[kind].replace("'", "''")
    value = x[: -len("[A-Za-z0-9+/_.=-]+")]
    length = f"length(regexp_replace(m[i], '^{value}', ''))" if kind == "assign" else "length(m[i])"
    least = secrets.MIN_ASSIGN_VALUE if kind == "assign" else secrets.MIN_LENGTH.get(kind, 0)
    before = "coalesce(list_sum(list_transform(b[1:i], lambda t: length(t))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda t: length(t))), 0)"
    cut = f"select doc_id, regexp_extract_all(t, '{x}') as m, regexp_split_to_array(t, '{x}') as b from d"
    found = f"select doc_id, m[i] as found, {length} as size, ({before})::bigint as start from (select *, unnest(range(1, len(m) + 1)) as i from ({cut}))"
    return f"select doc_id, {rank} as rank, '{kind}' as kind, start, start + length(found) as stop from ({found}) where size >= {least}"


_LISTED = "coalesce(string_agg(concat(kind, ':', start, ':', stop), ',' order by start, rank){where}, '')"
_BASE = " filter (where rank < 3)"
SECRETS = f"""with d as (select doc_id, coalesce(text, '') as t from documents),
f as ({' union all '.join(_spans(i, k) for i, k in enumerate(_EXPRESSIONS))})
select d.doc_id, {', '.join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in secrets.BASE)},
sha256({_LISTED.format(where=_BASE)}) as base_sha256, {_LISTED.format(where=' filter (where kind is not null)')} as spans
from d left join f on f.doc_id = d.doc_id group by d.doc_id"""

# ---- fill-in-middle: the same cuts by substrings

_DRAWS = ", ".join(f"concat('0x', substring(digest, {1 + 8 * i}, 8))::bigint as h{i + 1}" for i in range(4))
_SENTINELS = " or ".join(f"contains(t, '{x}')" for x in (fill_in_middle.PREFIX, fill_in_middle.SUFFIX, fill_in_middle.MIDDLE))
_ORDERS = {form: " || ".join(f"'{getattr(fill_in_middle, name.upper())}' || {name}" for name in order) for form, order in (("psm", ("prefix", "suffix", "middle")), ("spm", ("suffix", "prefix", "middle")))}
FILL_IN_MIDDLE = f"""with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256(concat('1:', doc_id)) as digest from documents),
h as (select doc_id, t, n, {_DRAWS} from d),
f as (select *, case when n = 0 or {_SENTINELS} or h3 % 100 >= {fill_in_middle.CUT_PERCENT} then 'plain' when h4 % 100 < {fill_in_middle.SPM_PERCENT} then 'spm' else 'psm' end as form, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b from h),
c as (select *, t[1:a] as prefix, t[a + 1:b] as middle, t[b + 1:] as suffix from f)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
sha256(case form when 'psm' then {_ORDERS['psm']} when 'spm' then {_ORDERS['spm']} else t end) as output_sha256, sha256(t) as restored_sha256 from c"""

# ---- collocations: every phrase counted, no pruning

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SUB = "array_to_string(ws[i:i + m - 1], ' ')"
COLLOCATIONS = f"""with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\x0a-\\x0d]')) as p from documents),
w as (select lang, list_filter(regexp_split_to_array(p, '[ \\t]+'), lambda x: x <> '') as ws from p),
g as (select lang, m, {_SUB} as phrase from (select lang, ws, m, unnest(range(1, len(ws) - m + 2)) as i from w, range(1, {collocations.LONGEST + 1}) t(m))),
f as materialized (select lang, m, phrase, concat(lang, chr(1), phrase) as key, count(*) as n from g group by all),
c as materialized (select lang, phrase, key, m as k, string_split(phrase, ' ') as ws, n as a from f where m >= 2 and n >= {collocations.MIN_COUNT}),
x as (select *, concat(lang, chr(1), array_to_string(ws[1:cut], ' ')) as first, concat(lang, chr(1), array_to_string(ws[cut + 1:], ' ')) as rest from (select *, unnest(range(1, k)) as cut from c)),
s as (select x.*, l.n as l, r.n as r, {collocations.SCALE}::hugeint * a // (l.n + r.n) as score from x join f l on l.key = first join f r on r.key = rest),
b as (select * from s qualify row_number() over (partition by key order by score, cut) = 1),
o as (select concat(lang, chr(1), {_SUB}) as key, max(a) as longer from (select *, unnest(range(1, k - m + 2)) as i from (select *, unnest(range(2, k)) as m from c where k > 2)) group by 1),
z as (select b.*, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b left join o using (key) where longer is null or 100::hugeint * longer < {collocations.COVERED}::hugeint * a)
select lang, rank, phrase, a, l, r, n, score::bigint as score from z join (select lang, sum(n)::bigint as n from f where m = 1 group by 1) using (lang) where rank <= {collocations.TOP}"""

SQL = {
    "op4_secrets": SECRETS, "op6_near_dups": NEAR_DUPS, "op7_sharding": SHARDING, "op12_fill_in_middle": FILL_IN_MIDDLE,
    "op13_collocations": COLLOCATIONS,
}
