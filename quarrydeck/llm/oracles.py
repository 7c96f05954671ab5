"""DuckDB SQL of those queries that SQL can express; independent of the operators' methods."""

from __future__ import annotations

from . import decontamination, filter_audit, topk_search

NEAR_DEDUP = r"""
with recursive d as (
  select doc_id, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' '), ' ') as w from documents
), l as (
  select doc_id, case when len(w) = 1 and w[1] = '' then [] else w end as w from d
), s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g from l
), h as (select doc_id, md5(g) as g from s
), n as (select doc_id, count(*) as n from h group by 1
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from h a join h b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
), e as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)
), u as (select a as src, b as dst from e union select b, a from e
), r(src, dst) as (select src, dst from u union select r.src, u.dst from r join u on r.dst = u.src
), m as (select src, min(dst) as c from r group by 1)
select l.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(least(l.doc_id, m.c), l.doc_id) as component_id,
       l.doc_id = coalesce(least(l.doc_id, m.c), l.doc_id) as kept
from l left join n on n.doc_id = l.doc_id left join m on m.src = l.doc_id
"""

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?"""
#: kind, pattern and what a match must be in full besides.
_KINDS = (
    ("assign", _ASSIGN + r"[A-Za-z0-9+/_.=-]+", _ASSIGN + r"[A-Za-z0-9+/_.=-]{6,}"),
    ("access", "AKIA[A-Z0-9]{16,}", ".*"),
    ("hex", "[0-9a-f]{24,}", ".*"),
    ("pem", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", ".*"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ".*"),
    ("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]{20,}", ".*"),
)


def _secrets() -> str:
    parts = []
    for k, (kind, rx, whole) in enumerate(_KINDS):
        parts.append(f"select doc_id, row, {k} as place, '{kind}' as kind, '{whole}' as whole, regexp_extract_all(t, '{rx}') as m, list_transform(string_split_regex(t, '{rx}'), lambda x: length(x)) as g from t")
    return f"""
with t as (select doc_id, row_number() over () as row, coalesce(text, '') as t from documents),
x as ({" union all ".join(parts)}),
y as (select doc_id, row, place, kind, whole, m, g, unnest(range(1, len(m) + 1)) as i from x),
z as (select doc_id, row, place, kind, m[i] as hit, coalesce(list_sum(g[1:i]), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda v: length(v))), 0) as a, whole from y),
f as (select doc_id, row, place, kind, a::bigint as a, (a + length(hit))::bigint as b from z where regexp_full_match(hit, whole)),
j as (select row, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  coalesce(string_agg(kind || ':' || a || ':' || b, ',' order by a, place) filter (place < 3), '') as base, string_agg(kind || ':' || a || ':' || b, ',' order by a, place) as spans from f group by 1)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, sha256(t) as blob
from t left join j on j.row = t.row
"""


SQL = {"op11_filter_audit": filter_audit.ORACLE, "op13_decontamination": decontamination.ORACLE, "op3_topk": topk_search.ORACLE, "op4_near_dedup": NEAR_DEDUP, "op7_secrets": _secrets()}
