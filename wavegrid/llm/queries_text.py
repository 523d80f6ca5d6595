"""Further registered queries, see :mod:`wavegrid.llm.queries`."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrid.llm import decontaminate, licence_scan, secret_scan, substring_dedup
from wavegrid.llm.licence_texts import LICENCES, NOTICES
from wavegrid.llm.queries import ORACLES, query, table


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), size=20)
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op4_substring_dedup"] = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), p as (
  select doc_id, i, array_to_string(w[i : i + 19], ' ') as g
  from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from w where len(w) >= 20)
), f as (
  select doc_id, i, min(row(doc_id, i)) over (partition by g) as first from p
), gone as (
  select distinct doc_id, unnest(range(i, i + 20)) as k from f where row(doc_id, i) > first
), r as (
  select doc_id, list(k) as ks from gone group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(len(ks), 0)::bigint as n_removed,
       sha256(array_to_string(case when ks is null then w else list_transform(list_filter(range(1, len(w) + 1), lambda k: not list_contains(ks, k)), lambda k: w[k]) end, ' ')) as kept_sha256
from w left join r using (doc_id)
"""


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))

    def of(rank: int):
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    digest = F.sha2(secret_scan.listed(F.col("base")).cast("binary"), 256)
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), digest.alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


ORACLES["op6_secret_scan"] = r"""
with d as (
  select doc_id, coalesce(text, '') as t from documents
), rule(kind, rank, pattern, part) as (values
  ('assign', 0, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2),
  ('access', 1, 'AKIA[A-Z0-9]+', 0), ('hex', 2, '[0-9a-f]+', 0), ('random', 3, '[A-Za-z0-9+/_-]{24,}', 0)
), x as (
  select doc_id, kind, rank, regexp_extract_all(t, pattern, 0) as w, regexp_split_to_array(t, pattern) as g,
         case when part = 2 then regexp_extract_all(t, pattern, 2) else regexp_extract_all(t, pattern, 0) end as s
  from d, rule where regexp_matches(t, pattern)
), y as (
  select *, list_transform(g, lambda a: length(a)) as gl, list_transform(w, lambda a: length(a)) as wl from x
), m as (
  select doc_id, kind, rank, unnest(s) as word, unnest(wl) as n, unnest(gl[1 : len(wl)]) as gap, unnest(range(len(wl))) as i from y
), placed as (
  select doc_id, kind, rank, word, n,
         (sum(gap + n) over (partition by doc_id, kind order by i) - n)::bigint as b from m
), base as (
  select doc_id, kind, rank, b, b + n as e from placed
  where kind = 'assign' and length(word) >= 6 or kind = 'access' and n >= 20 or kind = 'hex' and n >= 24
), coded as (
  select doc_id, b, b + n as e, word,
    case when not regexp_matches(word, '[0-9]') or not regexp_matches(word, '[A-Za-z]') then null
         when regexp_full_match(word, '[0-9a-f]+|[0-9A-F]+') then 'hex'
         when regexp_full_match(word, '[A-Z2-7]+') then 'base32'
         when regexp_full_match(word, '[0-9a-z]+|[0-9A-Z]+') then 'base36'
         when regexp_matches(word, '[a-z]') and regexp_matches(word, '[A-Z]') then 'base64' end as code
  from placed where kind = 'random'
), around as (
  select coded.*, least(length(word), 4096) as n, regexp_replace(substr(t, greatest(0, b - 12 * least(length(word), 4096)) + 1, b - greatest(0, b - 12 * least(length(word), 4096)))
      || ' ' || substr(t, e + 1, 12 * least(length(word), 4096)), '[A-Za-z0-9+/_-]{24,}', ' ', 'g') as near,
    floor(2e0 * log2(least(length(word), 4096)::double))::integer + case code when 'hex' then 0 when 'base32' then 100 when 'base36' then 200 else 300 end as family
  from coded join d using (doc_id) where code is not null
), made as (
  select doc_id, b, e, code, family, n, case when code = 'hex' then '' else substr(regexp_replace(substr(word, 1, n), '[^0-9]', '', 'g'), 1, 4) end as digits,
    case when code = 'hex' then regexp_replace(near, '[^0-9a-fA-F]', '', 'g') when code = 'base32' then upper(joined) else joined end as letters
  from (select *, array_to_string(list_transform(regexp_extract_all(near, '[A-Za-z]+'), lambda x: upper(x[1]) || x[2:]), '') as joined from around)
), strings as (
  select doc_id, b, e, code, family, true as target, word as w from around
  union all
  select doc_id, b, e, code, family, false, substr(letters, i * (n - length(digits)) + 1, n - length(digits)) || digits
  from made, range(0, 8) as r(i) where length(substr(letters, i * (n - length(digits)) + 1, n - length(digits))) = n - length(digits)
), v as (
  select doc_id, b, e, family, target, length(a)::double as k, list_transform(string_split(w, ''), lambda c: (instr(a, c) - 1)::double) as v
  from (select doc_id, b, e, family, target,
          case code when 'base64' then translate(w, '-_', '+/') when 'base32' then w else lower(w) end as w,
          case code when 'hex' then '0123456789abcdef' when 'base32' then 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'
            when 'base36' then '0123456789abcdefghijklmnopqrstuvwxyz'
            else 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/' end as a
        from strings)
), q as (
  select doc_id, b, e, family, target, k, len(v)::double as n,
    list_sum(list_transform(range(0, k::bigint), lambda s: pow(len(list_filter(v, lambda y: y = s)), 2))) as squares,
    len(list_filter(v, lambda y: y >= k / 2))::double as ones,
    len(list_filter(list_zip(v[2:], v[:-2]), lambda r: (r[1] >= k / 2) <> (r[2] >= k / 2)))::double as turns,
    list_sum(v) as total, list_sum(list_transform(v, lambda y: y * y)) as power,
    list_sum(list_transform(list_zip(v[2:], v[:-2]), lambda r: r[1] * r[2])) as lagged, v[1] as first, v[-1] as last
  from v
), c as (
  select *, squares * k / n - n as chi, 2e0 / (9e0 * (k - 1)) as spread, 2e0 * ones * (n - ones) as pairs, total / n as mean,
    power - n * (total / n) * (total / n) as around from q
), t as (
  select doc_id, b, e, family, target,
    (pow(greatest(chi, 0e0) / (k - 1), 1e0 / 3) - (1e0 - spread)) / sqrt(spread) as z1,
    case when pairs * (pairs - n) / (n * n * (n - 1)) > 0 then abs(turns - pairs / n) / sqrt(pairs * (pairs - n) / (n * n * (n - 1))) else 40e0 end as z2,
    case when around > 1e-9 then abs((lagged - mean * (2 * total - first - last) + (n - 1) * mean * mean) / around + 1e0 / n) * sqrt(n) else 40e0 end as z3
  from c
), u as (
  select doc_id, b, e, family, target, round_even((least(40e0, z1) + (least(40e0, z2) + least(40e0, z3)) / 2e0) * 64e0, 0)::bigint as u from t
), others as (
  select doc_id, b, e, count(*)::double as d, sum(u)::double as s, sum(u * u)::double as q from u where not target group by doc_id, b, e having count(*) >= 2
), apart as (
  select u.doc_id, u.b, u.e, family, round_even((u - s / d) / sqrt(1e0 + 1e0 / d), 0)::integer as x, d - 1 as spare, q - s * s / d as spread
  from u join others o on o.doc_id = u.doc_id and o.b = u.b and o.e = u.e where target
), null_ as (
  select family, count(*) as every, greatest(0.5e0, sqrt(sum(spread) / sum(spare)) / 64e0) as deviation from apart group by family having sum(spare) >= 8
), cum as (
  select family, x, sum(n) over (partition by family order by x) as below from (select family, x, count(*) as n from apart group by family, x)
), z as (
  select *, -x / 64e0 / deviation as z from cum join null_ using (family)
), h as (
  select *, 1e0 / (1e0 + 0.3275911e0 * (abs(z) / sqrt(2e0))) as a, abs(z) / sqrt(2e0) as r from z
), tail as (
  select *, 0.5e0 * a * (0.254829592e0 + a * (-0.284496736e0 + a * (1.421413741e0 + a * (-1.453152027e0 + a * 1.061405429e0)))) * exp(-r * r) as half from h
), cut as (
  select family, max(x) as cut from tail where case when z >= 0 then half else 1e0 - half end <= 0.05e0 * below / every group by family
), more as (
  select apart.doc_id, 'random' as kind, 3 as rank, apart.b, apart.e from apart join cut using (family)
  where x <= cut and not exists (select 1 from base where base.doc_id = apart.doc_id and base.b < apart.e and apart.b < base.e)
), spans as (
  select * from base union all select * from more
), s as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(kind || ':' || b || ':' || e, ',' order by b, rank) filter (kind <> 'random') as base, string_agg(kind || ':' || b || ':' || e, ',' order by b, rank) as spans
  from spans group by doc_id
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join s using (doc_id)
"""


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=8, least_items=2)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


ORACLES["op9_decontaminate"] = r"""
with d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents
), b as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark
), t as (
  select distinct item_id, least(8, len(w)) as n, array_to_string(w[i : i + 7], ' ') as g
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) as i from b where len(w) > 0)
), sizes as (select distinct n from t),
p as (
  select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)
), m as (
  select p.doc_id, p.i, p.n, t.item_id from p join t on t.n = p.n and t.g = p.g
), h as (
  select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from m) group by doc_id
), c as (
  select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from m group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from d left join h using (doc_id) left join c using (doc_id)
"""


@query
def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licence_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "license_id", F.size("notices").cast("long").alias("n_notices"), F.array_join("notices", ",").alias("notice_ids"))


def _word_form(text: str) -> str:
    """The canonical form once more, word by word, for the oracle alone."""
    import regex

    mark = regex.compile(r"[^\p{L}\p{N}(©]*(copyright[ \t]*(\(c\)|©|[0-9<\[{])|\(c\)[ \t]*(copyright|[0-9])|©|all rights reserved)")
    lines = [x for x in regex.split("[\r\n]+", text.lower()) if not mark.match(x)]
    one = {old: new for old, new in licence_scan.EQUIVALENT if " " not in old}
    form = " ".join(one.get(w, w) for x in lines for w in regex.findall(r"[\p{L}\p{N}]+", x))
    for old, new in licence_scan.EQUIVALENT:
        if " " in old:
            form = regex.sub(rf"\b{old}\b", new, form)
    return form


def _licence_oracle() -> str:
    one = " ".join(f"when '{old}' then '{new}'" for old, new in licence_scan.EQUIVALENT if " " not in old)

    def form(x: str) -> str:
        lines = f"list_filter(regexp_split_to_array(lower({x}), '[\\r\\n]+'), lambda y: not regexp_matches(y, '^[^\\p{{L}}\\p{{N}}(©]*(copyright[ \\t]*(\\(c\\)|©|[0-9<\\[{{])|\\(c\\)[ \\t]*(copyright|[0-9])|©|all rights reserved)'))"
        words = f"list_filter(regexp_split_to_array(array_to_string({lines}, ' '), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
        out = f"array_to_string(list_transform({words}, lambda w: case w {one} else w end), ' ')"
        for old, new in licence_scan.EQUIVALENT:
            if " " in old:
                out = f"regexp_replace({out}, '\\b{old}\\b', '{new}', 'g')"
        return f"sha256({out})"

    def values(known) -> str:
        return ", ".join(sorted({f"('{hashlib.sha256(_word_form(text).encode()).hexdigest()}', '{name}')" for name, text in known}))

    return f"""
with licences(digest, id) as (values {values(LICENCES)}), notices(digest, id) as (values {values(NOTICES)}),
w as (select doc_id, {form("text")} as digest from documents where text is not null),
l as (
  select doc_id, {form("line")} as digest
  from (select doc_id, unnest(regexp_split_to_array(text, '[\\r\\n]+')) as line from documents)
), n as (
  select doc_id, count(*) as n, string_agg(id, ',' order by id) as ids from l join notices using (digest) group by doc_id
)
select d.doc_id, licences.id as license_id, coalesce(n.n, 0)::bigint as n_notices, coalesce(n.ids, '') as notice_ids
from documents d left join w using (doc_id) left join licences using (digest) left join n on n.doc_id = d.doc_id
"""


ORACLES["op10_licence_scan"] = _licence_oracle()
