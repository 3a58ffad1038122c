"""DuckDB formulations that the registered queries are checked against; built from shared common table expressions."""
from __future__ import annotations

from ..functions.config import ABBREVIATIONS, CUES, DRUG_INDICATIONS, DRUG_LEAD_INS, DRUG_SYNONYMS, FILLERS, SECTIONS
from ..functions.text import _alphabet, normalize_literal
from .notes import notes_sql


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(expr: str) -> str:
    """Normalisation restricted to letters that occur in the test tables (below U+2000)."""
    src, dst = _alphabet(True, True)
    pairs = [(a, b) for a, b in zip(src, dst) if ord(a) < 0x2000 and ord(b) < 0x2000]
    return f"translate({expr}, {q(''.join(a for a, _ in pairs))}, {q(''.join(b for _, b in pairs))})"


def values(rows: list[tuple]) -> str:
    return "(values " + ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else q(x) for x in r) + ")" for r in rows) + ")"


WSX = r"[\s]"
TRIM_CHARS = "' ' || chr(9) || chr(13) || chr(10) || ',;:.•-'"


def trim(expr: str) -> str:
    return f"trim({expr}, {TRIM_CHARS})"


def trim_start(text: str, start: str) -> str:
    return f"({start} + length({text}) - length(ltrim({text}, {TRIM_CHARS})))"


def lines_sql(source: str) -> str:
    """lines(doc_id, line_no, line_start, line) of a table expression with doc_id, raw."""
    return f"""
split_ as (select doc_id, string_split(raw, chr(10)) as ps from {source}),
pieces_ as (select doc_id, unnest(generate_series(1, len(ps))) as i, unnest(ps) as line, len(ps) as n from split_),
lines as (select doc_id, cast(i - 1 as int) as line_no, cast(coalesce(sum(length(line) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as int) as line_start, line
  from pieces_ qualify not (i = n and line = ''))"""


def positions(cte: str, source: str, key: str, text: str, pattern: str, raw: str | None = None) -> str:
    """``cte``(key, start, end_, raw): matches of a pattern with offsets, from the gaps and the matches."""
    raw = raw or text
    return f"""
{cte}_m as (select {key}, {raw} as raw_, regexp_extract_all({text}, {pattern}) as ms, string_split_regex({text}, {pattern}) as gs from {source}),
{cte}_x as (select {key}, raw_, unnest(generate_series(1, len(ms))) as i, unnest(ms) as m, unnest(gs[1:len(ms)]) as g from {cte}_m where len(ms) > 0),
{cte}_y as (select {key}, raw_, i, m, sum(length(g) + length(m)) over (partition by {key} order by i) as e from {cte}_x),
{cte} as (select {key}, cast(e - length(m) as int) as start, cast(e as int) as end_, substr(raw_, cast(e - length(m) as int) + 1, length(m)) as raw from {cte}_y)"""


def headers_sql() -> str:
    """headed(lines.*, kind, header, canonical): the exact and the substring tiers; no line of the notes reaches the fuzzy one."""
    patterns = [(i, c, p) for i, (c, p) in enumerate((c, p) for c, ps in SECTIONS.items() for p in ps)]
    return f"""
patterns as (select * from {values(patterns)} as t(ord, canon, p)),
cand as (select *, case when regexp_matches(line, '^\\s*\\d+\\s*[.)]\\s*.+') then 'num'
    when regexp_matches(regexp_replace(line, '^\\s*[-*•]\\s*', ''), '^\\s*[^:\\n]{{3,60}}?\\s*:') then 'colon' else 'bare' end as k,
  regexp_replace(line, '^\\s*[-*•]\\s*', '') as body from lines),
cand2 as (select *, trim(case when k = 'num' then regexp_extract(line, '^\\s*\\d+\\s*[.)]\\s*(.+?)\\s*$', 1) when k = 'colon' then regexp_extract(body, '^\\s*([^:\\n]{{3,60}}?)\\s*:', 1) else trim(body) end) as header_ from cand),
hs as materialized (select header_, {norm('header_')} as h from (select distinct header_ from cand2 where length(header_) between 1 and 90)),
scored as (select header_, p, canon, ord, h from hs, patterns),
best as materialized (select header_, arg_min(canon, (ord)) filter (h = p) as exact_, arg_min(canon, {{'l': -length(p), 'o': ord}}) filter (contains(h, p)) as sub_, max(length(p)) filter (contains(h, p)) as sublen, any_value(length(h)) as hl from scored group by header_),
canon_ as (select header_, coalesce(exact_, sub_) as c, case when exact_ is not null then 1.0 when sublen >= 0.6 * hl then 0.99 when sub_ is not null then 0.6 end as conf from best),
headed as (select l.doc_id, l.line_no, l.line_start, l.line, case when k = 'num' or (k = 'colon' and c is not null) or (c is not null and conf >= 0.95) then k end as kind,
    case when k = 'num' or (k = 'colon' and c is not null) or (c is not null and conf >= 0.95) then l.header_ end as header,
    case when k = 'num' then coalesce(c, 'OTHER') when k = 'colon' then c when conf >= 0.95 then c end as canonical
  from cand2 l left join canon_ on l.header_ = canon_.header_),
placed as materialized (select *, coalesce(last_value(canonical ignore nulls) over w, 'OTHER') as section, coalesce(last_value(header ignore nulls) over w, '') as section_header,
    coalesce(last_value(case when kind = 'num' then canonical end ignore nulls) over w, 'OTHER') as doc_section
  from headed window w as (partition by doc_id order by line_no rows between unbounded preceding and current row))"""


def cue(cues: list[str]) -> str:
    return q(r"(^|[^\p{L}\p{N}_])(?:" + "|".join(sorted(cues, key=len, reverse=True)) + r")($|[^\p{L}\p{N}_])")


def assertions_sql(kind: str, line: str, start: str, section: str, header: str, doc_section: str, prefix: str) -> str:
    """The list of assertions, joined by '|'."""
    window = f"substr(lower({line}), greatest(0, {start} - 35) + 1, {start} - greatest(0, {start} - 35))"
    exc = " or ".join(f"contains({window}, {q(x)})" for x in CUES["negation_exceptions"])
    heads = " or ".join(f"contains(lower({header}), {q(x)})" for x in CUES["historical_section_headers"])
    hist = f"({section} = 'HISTORY_PAST' or {doc_section} = 'HISTORY_PAST' or {heads} or regexp_matches(lower({line}), {cue(CUES['isHistorical'])}))"
    neg = f"({prefix} or (regexp_matches({window}, {cue(CUES['isNegated'])}) and not ({exc})))"
    fam = f"(regexp_matches(lower({line}), {cue(CUES['isFamily'])}) or regexp_matches(lower({header}), {cue(CUES['isFamily'])}))"
    return f"case when {kind} in ('TRIỆU_CHỨNG', 'CHẨN_ĐOÁN', 'THUỐC') then concat_ws('|', case when {hist} then 'isHistorical' end, case when {neg} then 'isNegated' end, case when {fam} then 'isFamily' end) else '' end"


def negation_sql(text: str) -> str:
    cues = "|".join(sorted(CUES["isNegated"], key=len, reverse=True))
    exc = " or ".join(f"starts_with(lower({text}), {q(x)})" for x in CUES["negation_exceptions"])
    hit = f"regexp_extract(lower({text}), {q(f'^(?:{cues})(?: |$)')})"
    return f"case when {exc} or {hit} = '' then 0 else length(regexp_extract(lower({text}), {q(f'^(?:{cues})(?:$| ' + chr(92) + 's*)')})) end"


def extract_sql() -> str:
    """concepts(doc_id, text, type, start, end_, assertions) of the notes."""
    lead = "^\\s*(?:" + "|".join(DRUG_LEAD_INS) + ")\\s+"
    tail = "(?i)\\s+(?:" + "|".join(DRUG_INDICATIONS) + ")(?:$|[^\\p{L}\\p{N}_]).*$"
    cols = "doc_id, line_no, line, line_start, section, section_header, doc_section"
    return f"""{headers_sql()},
typed as (select *, case section when 'SYMPTOM' then 'TRIỆU_CHỨNG' when 'DIAGNOSIS' then 'CHẨN_ĐOÁN' else 'THUỐC' end as type, regexp_matches(line, '^\\s*[-*•]') as bullet from placed
  where section in ('SYMPTOM', 'DIAGNOSIS', 'DRUG') and trim(line) <> ''),
cut as (select *, case when kind = 'colon' then length(regexp_extract(line, '^[^:]*:\\s*')) when kind is null and bullet then length(regexp_extract(line, '^\\s*[-*•]\\s*'))
    when kind is null and regexp_matches(line, '^\\s*[^:\\n]{{3,60}}?\\s*:') then length(regexp_extract(line, '^\\s*[^:\\n]{{3,60}}?\\s*:\\s*')) end as c from typed),
data as materialized (select {cols}, type, substr(line, cast(c as int) + 1) as content, line_start + c as at_, not (kind is null and bullet) as split from cut where c < length(line) or (kind is null and bullet)),
split1 as (select {cols}, type, at_, unnest(generate_series(1, len(string_split_regex(content, '[,;]')))) as i, unnest(string_split_regex(content, '[,;]')) as part from data where split and type <> 'THUỐC'),
parts as (select {cols}, type, part, cast(at_ + coalesce(sum(length(part) + 1) over (partition by doc_id, line_no order by i rows between unbounded preceding and 1 preceding), 0) as bigint) as s from split1
  union all select {cols}, type, content, at_ from data where not split and type <> 'THUỐC'),
sd1 as (select {cols}, type, {trim('part')} as t, {trim_start('part', 's')} as s from parts),
sd2 as (select {cols}, type, s, case when contains(t, ':') then string_split(t, ':')[1] else t end as t from sd1 where t <> ''),
sd3 as (select *, {negation_sql('t')} as n from sd2),
sd4 as (select {cols}, type, n, {trim('substr(t, n + 1)')} as t, {trim_start('substr(t, n + 1)', 's + n')} as s from sd3),
sd as (select doc_id, t as text, type, cast(s as int) as start, cast(s + length(t) as int) as end_, {assertions_sql('type', 'line', '(s - line_start)', 'section', 'section_header', 'doc_section', 'n > 0')} as assertions
  from sd4 where t <> '' and length(t) <= 120 and len(list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '')) <= 10),
dr1 as (select {cols}, {trim('content')} as t, {trim_start('content', 'at_')} as s from data where type = 'THUỐC'),
dr2 as (select {cols}, case when regexp_matches(lower(t), {q(lead)}) then substr(t, length(regexp_extract(lower(t), {q(lead)})) + 1) else t end as t, case when regexp_matches(lower(t), {q(lead)}) then s + length(regexp_extract(lower(t), {q(lead)})) else s end as s from dr1 where t <> ''),
dr3 as (select {cols}, s, {trim(f"regexp_replace(t, {q(tail)}, '')")} as t from dr2),
dr4 as (select {cols}, s, {trim("regexp_replace(t, '\\s*\\([^)]*\\)?\\s*$', '')")} as t from dr3),
dr as (select doc_id, t as text, 'THUỐC' as type, cast(s as int) as start, cast(s + length(t) as int) as end_, {assertions_sql("'THUỐC'", 'line', '(s - line_start)', 'section', 'section_header', 'doc_section', 'false')} as assertions
  from dr4 where t <> '' and length(t) <= 120 and len(list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '')) <= 8 and regexp_matches(t, '[A-Za-z]{{4,}}')),
lab0 as (select {cols}, case when regexp_matches(line, '^\\s*[-*•]') then length(regexp_extract(line, '^\\s*[-*•]\\s*')) else 0 end as hd, kind from placed where section = 'LAB' and trim(line) <> '' and (kind is null or kind = 'colon')),
lab1 as (select {cols}, hd + case when kind = 'colon' then length(regexp_extract(substr(line, hd + 1), '^\\s*[^:\\n]{{3,60}}?\\s*:\\s*')) else 0 end as c from lab0),
lab2 as (select {cols}, line_start + c as at_, string_split(substr(line, c + 1), ';') as ps from lab1 where c < length(line)),
lab3 as (select {cols}, at_, unnest(generate_series(1, len(ps))) as i, unnest(ps) as part from lab2),
lab4 as (select {cols}, part, cast(at_ + coalesce(sum(length(part) + 1) over (partition by doc_id, line_no order by i rows between unbounded preceding and 1 preceding), 0) as bigint) as s from lab3),
lab5 as (select {cols}, {trim('part')} as t, {trim_start('part', 's')} as s from lab4),
lab6 as (select *, length(regexp_extract(t, '^([^0-9+-]*(?:[+-][^0-9+-]+)*)[+-]?\\d', 1)) as a from lab5 where regexp_matches(t, '\\d')),
lab7 as (select doc_id, s, a, {trim('substr(t, 1, cast(a as int))')} as name, {trim('substr(t, cast(a as int) + 1)')} as val, {trim_start('substr(t, 1, cast(a as int))', 's')} as ns, {trim_start('substr(t, cast(a as int) + 1)', 's + a')} as vs from lab6),
lab as (select doc_id, name as text, 'TÊN_XÉT_NGHIỆM' as type, cast(ns as int) as start, cast(ns + length(name) as int) as end_, '' as assertions from lab7 where name <> '' and length(name) <= 60
  union all select doc_id, val, 'KẾT_QUẢ_XÉT_NGHIỆM', cast(vs as int), cast(vs + length(val) as int), '' from lab7 where name <> '' and length(name) <= 60 and val <> ''),
concepts as (select * from sd union all select * from dr union all select * from lab)"""


def with_notes(*ctes: str, select: str) -> str:
    return "with " + ",".join([notes_sql(), *ctes]) + " " + select


__all__ = ["ABBREVIATIONS", "DRUG_SYNONYMS", "FILLERS", "extract_sql", "headers_sql", "lines_sql", "negation_sql", "norm", "normalize_literal", "positions", "q", "trim", "values", "with_notes"]
