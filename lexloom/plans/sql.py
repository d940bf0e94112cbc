"""Building blocks of the SQL that the queries are held against."""

from __future__ import annotations

import re

from lexloom.functions import rules as R
from lexloom.functions import text as T
from lexloom.sources import contracts as C


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pattern(p: str) -> str:
    """A rule's pattern as a literal; look-ahead for a capital becomes the capital itself."""
    return lit(p.replace('(?=[A-Z"(“])', '[A-Z"(“]'))


def swap(x: str, p: str, to: str) -> str:
    return f"regexp_replace({x}, {lit(p)}, {lit(to)}, 'g')"


def trim(x: str) -> str:
    return swap(x, rf"^[{R.WS}]+|[{R.WS}]+$", "")


def one_spaced(x: str) -> str:
    return trim(swap(x, rf"[{R.WS}]+", " "))


def fold(x: str) -> str:
    return f"translate(lower({one_spaced(x)}), {lit('‘’ʼ“”–—−')}, {lit(chr(39) * 3 + chr(34) * 2 + '---')})"


def normal(x: str) -> str:
    x = swap(swap(x, "\r\n?", "\n"), "([a-z])-\n([a-z])", r"\1\2")
    x = swap(swap(x, f"[{R.WS_NO_LF}]+", " "), " *\n *", "\n")
    return trim(swap(x, "\n{3,}", "\n\n"))


def tokens(x: str) -> str:
    stop = "[" + ",".join(map(lit, R.STOPWORDS)) + "]"
    return f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda t: length(t) > 1 and not list_contains({stop}, t))"


def stem(x: str) -> str:
    first = f"""case when {x} like '%ies' and length({x}) > 4 then left({x}, length({x}) - 3) || 'y'
        when regexp_matches({x}, '(?:ss|sh|ch|x|z)es$') then left({x}, length({x}) - 2)
        when {x} like '%s' and {x} not like '%ss' and {x} not like '%us' and length({x}) >= 4 then left({x}, length({x}) - 1) else {x} end"""
    for _ in R.SUFFIXES:
        first = f"regexp_replace({first}, {lit(T.SUFFIX)}, '\\1')"
    return first


def verhoeff(x: str) -> str:
    d = "[" + ",".join("[" + ",".join(r) + "]" for r in R.VERHOEFF_D) + "]"
    p = "[" + ",".join("[" + ",".join(r) + "]" for r in R.VERHOEFF_P) + "]"
    step = f"{d}[c + 1][{p}[i % 8 + 1][cast(substr({x}, 12 - i, 1) as int) + 1] + 1]"
    return f"coalesce(regexp_full_match({x}, '\\d{{12}}') and list_reduce(list_prepend(0, range(0, 12)), lambda c, i: cast({step} as bigint)) = 0, false)"


def contracts(draft: str = "a", name: str = "") -> str:
    """CTEs c (k, text), n (k, t) normalised, r (k, t and counts) redacted, cl (k, idx, label, text) clauses; names end in ``name``."""
    body = C.DRAFT_A if draft == "a" else C.DRAFT_B
    # The driver reads the statement without its line ends changed, so texts keep theirs.
    ids = f"regexp_extract_all(t, {lit(R.CHECKED_ID)}, 0)"
    digits = "regexp_replace(x, '[^0-9]', '', 'g')"
    steps, last = "", "r0"
    for i, (kind, p) in enumerate(R.REDACTIONS, 1):
        counts = ", ".join(f"n_{k.lower()}" for k, _ in R.REDACTIONS[: i - 1])
        steps += f", r{i}{name} as (select k, n_aadhaar{', ' + counts if counts else ''}, cast(len(regexp_extract_all(t, {lit(p)})) as bigint) as n_{kind.lower()}, regexp_replace(t, {lit(p)}, '[REDACTED:{kind}]', 'g') as t from {last}{name})"
        last = f"r{i}"
    split = R.MARKERS[1][1].replace('(?=[A-Z"(“])', '[A-Z"(“]')
    split = re.sub(r"^\(\?m\)\^\((.*?)\)\[", r"(?m)^(\1[", split, count=1) + ")"
    return f"""c{name} as (select k, {body} as text from (select {C.INPUT} from orders join customer on o_custkey = c_custkey)),
    n{name} as materialized (select k, {normal('text')} as t from c{name}),
    i{name} as (select k, t, list_filter({ids}, lambda x: {verhoeff(digits)}) as ids from n{name}),
    r0{name} as (select k, cast(len(ids) as bigint) as n_aadhaar, list_reduce(list_prepend(t, ids), lambda a, x: replace(a, x, '[REDACTED:AADHAAR]')) as t from i{name}){steps},
    m{name} as materialized (select k, string_split(regexp_replace(t, {lit(split)}, chr(1) || '\\1', 'g'), chr(1)) as parts from {last}{name}),
    p{name} as (select k, unnest(parts) as raw, unnest(range(0, len(parts))) as pos from m{name}),
    s{name} as (select k, pos, {trim('raw')} as body, case when pos > 0 then nullif(regexp_extract(raw, '^(\\d{{1,3}})[.)]', 1), '') end as label from p{name} where not (pos = 0 and length(raw) <= {R.MIN_CLAUSE})),
    g{name} as (select *, sum(case when length(body) >= {R.MIN_CLAUSE} or rn = 1 then 1 else 0 end) over (partition by k order by pos) as part from (select *, row_number() over (partition by k order by pos) as rn from s{name} where body <> '')),
    cl{name} as materialized (select k, cast(part - 1 as int) as idx, arg_min(coalesce(label, ''), pos) as lab, string_agg(body, chr(10) order by pos) as text from g{name} group by k, part)"""


REDACTED = f"r{len(R.REDACTIONS)}"


def grounded(quote: str, source: str) -> str:
    return f"({one_spaced(quote)} <> '' and strpos({fold(source)}, {fold(quote)}) > 0)"


def weight(x: str = "risk") -> str:
    return f"case {x} when 'high' then 10 when 'medium' then 4 else 0 end"


#: CTE an: validated analyses of the clauses of draft A, from the fields that the replies are made of.
_R = {k: f"({v})" for k, v in C.REPLY.items()}
ANALYSES = f"""rp as (select k, idx, nullif(lab, '') as label, text, {', '.join(f'{v} as {n}' for n, v in _R.items())} from cl),
    an as materialized (select k, idx, label, text, {trim('heading')} as heading, {trim('plain')} as plain, {trim('quote')} as quote, ask, {grounded(trim('quote'), 'text')} as grounded,
      case when {grounded(trim('quote'), 'text')} and lower(risk) in ('high', 'medium', 'low', 'info') then lower(risk) else 'info' end as risk,
      case when {grounded(trim('quote'), 'text')} and {grounded(trim('ob_quote'), 'text')} then 1 else 0 end as obs,
      case when who in ('you', 'other-party', 'both') then who else 'you' end as who, {trim('what')} as what, nullif(due, '') as due, {trim('ob_quote')} as ob_quote from rp)"""


def dedupe_key(x: str) -> str:
    return f"trim({swap(swap(f'lower({x})', '[^a-z0-9 ]+', ''), ' +', ' ')})"


OBLIGATIONS = f"""ob as (select k, idx, who, what, due, ob_quote, row_number() over (partition by k, who || '|' || {dedupe_key('what')} order by idx) as n from an where obs = 1 and what <> '')"""
QUESTIONS = f"""qu as (select k, idx, trim(ask) as ask, risk, row_number() over (partition by k, {dedupe_key('ask')} order by {weight()} desc, idx) as n from an where grounded and {weight()} > 0 and trim(ask) <> '')"""

_NUM = R.NUM
_VAL = "case when regexp_full_match(a, '[0-9,.]+') then cast(replace(a, ',', '') as double) else case lower(a) " + " ".join(f"when {lit(w)} then {v}" for w, v in R.NUMBER_WORDS.items()) + " end end"
_PARTS = " union all ".join(
    f"select k, idx, lab, text, '{kind}' as kind, unnest(regexp_extract_all(text, {lit(p)})) as match, unnest(range(0, len(regexp_extract_all(text, {lit(p)})))) as spot, {i} as rule from cl" for i, (kind, p) in enumerate(R.TERMS)
)
_A = "case rule " + " ".join(f"when {i} then regexp_extract(match, {lit(p)}, 1)" for i, (_, p) in enumerate(R.TERMS)) + " end"
_B = "case rule " + " ".join(f"when {i} then lower(regexp_extract(match, {lit(p)}, 2))" for i, (k, p) in enumerate(R.TERMS) if k in ("notice-period", "interest-rate", "lock-in")) + " end"
#: CTE v: every stated term (k, kind, value, idx, at, a).
VALUES = f"""v0 as ({_PARTS}), v1 as materialized (select *, {_A} as a, {_B} as b from v0), v2 as (select *, {_VAL} as num from v1),
    v as (select k, kind, idx, spot, a, case when kind = 'jurisdiction' then lower(a) else cast(cast(case
      when kind in ('notice-period', 'lock-in') then num * case b when 'day' then 1 when 'week' then 7 when 'month' then 30 when 'year' then 365 end
      when kind = 'interest-rate' and b = 'month' then num * 12 else num end as decimal(18,2)) as varchar) end as value from v2),
    vi as (select * from (select *, row_number() over (partition by k, kind, value order by idx, spot) as n from v where value is not null) where n = 1),
    vc as materialized (select *, count(*) over (partition by k, kind) as ways from vi)"""


def term_ctes(source: str, keys: str, name: str = "") -> str:
    """CTE tf{name} (keys, term, tf) over source (keys, text)."""
    return f"tk{name} as (select {keys}, unnest({tokens('text')}) as tok from {source}), tf{name} as materialized (select {keys}, {stem('tok')} as term, count(*) as tf from tk{name} group by all)"


EXPANSIONS = "ex(term, alt, ord) as (values " + ", ".join(f"({lit(t)}, {lit(a)}, {i})" for t, alts in {T.stem_word(w): [T.stem_word(x) for x in al.split()] for w, al in R.SYNONYMS.items()}.items() for i, a in enumerate(alts)) + ")"


def asked(question: str) -> str:
    """CTEs up to qt (term, ord) for a question."""
    return f"""{EXPANSIONS}, qt0 as (select unnest(tok) as tok, unnest(range(0, len(tok))) as pos from (select {tokens(lit(question))} as tok)),
    qt1 as (select {stem('tok')} as term, pos from qt0),
    qt2 as (select term, pos as spot from qt1 union all select alt, pos * 100 + ord + 1000000 from qt1 join ex using (term)),
    qt as (select term, row_number() over (order by spot) as ord from (select term, min(spot) as spot from qt2 group by term))"""


def ranked(clauses: str, question: str) -> str:
    """CTEs up to rk (k, idx, score, rank, matched) for one question asked of every document of ``clauses`` (k, idx, text)."""
    return f"""{asked(question)}, {term_ctes(clauses, 'k, idx')}, ln as materialized (select k, idx, len({tokens('text')}) as length from {clauses}),
    st as (select k, count(*) as n, avg(length) as avg from ln group by k), df as (select k, term, count(*) as df from tf group by all),
    sc as materialized (select k, idx, round(sum(ln(1 + n / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (1 - 0.6 + 0.6 * length / avg))), 9) as score, string_agg(term, ' ' order by ord) as matched
      from qt join tf using (term) join df using (k, term) join ln using (k, idx) join st using (k) group by k, idx),
    rk as (select * from (select *, row_number() over (partition by k order by score desc, idx) as rank from sc where score >= 0.35) where rank <= 3)"""


def alignment() -> str:
    """CTEs up to pr (k, idx_a, idx_b, similarity, identical) over cl_a and cl_b."""
    canon = lambda x: f"trim({swap(f'lower({x})', '[^a-z0-9]+', ' ')})"
    return f"""{term_ctes('cl_a', 'k, idx', '_a')}, {term_ctes('cl_b', 'k, idx', '_b')},
    na as (select k, idx, sum(tf * tf) as nn from tf_a group by all), nb as (select k, idx, sum(tf * tf) as nn from tf_b group by all),
    dt as (select tf_a.k, tf_a.idx as idx_a, tf_b.idx as idx_b, sum(tf_a.tf * tf_b.tf) as dot from tf_a join tf_b on tf_a.k = tf_b.k and tf_a.term = tf_b.term group by all),
    sm as (select dt.k, idx_a, idx_b, round(dot / sqrt(cast(na.nn * nb.nn as double)), 9) as base, a.lab <> '' and a.lab = b.lab as same, a.text as text_a, b.text as text_b
      from dt join na on na.k = dt.k and na.idx = idx_a join nb on nb.k = dt.k and nb.idx = idx_b join cl_a a on a.k = dt.k and a.idx = idx_a join cl_b b on b.k = dt.k and b.idx = idx_b),
    sm2 as materialized (select *, round(least(1.0, base + case when same then 0.12 else 0 end), 9) as score from sm),
    pr as materialized (select k, idx_a, idx_b, score as similarity, {canon('text_a')} = {canon('text_b')} as identical, text_a, text_b from (select *, row_number() over (partition by k, idx_a order by score desc, idx_b) as ra,
      row_number() over (partition by k, idx_b order by score desc, idx_a) as rb from sm2) where ra = 1 and rb = 1 and score >= 0.34),
    di as materialized (select * from (select *, row_number() over (partition by k order by o, coalesce(idx_a, idx_b)) as n from (
      select k, 0 as o, 'changed' as kind, idx_a, idx_b, similarity, text_a, text_b from pr where not identical
      union all select k, 1, 'only-in-a', idx, null, 0.0, text, '' from cl_a where not exists (select 1 from pr where pr.k = cl_a.k and idx_a = idx)
      union all select k, 2, 'only-in-b', null, idx, 0.0, '', text from cl_b where not exists (select 1 from pr where pr.k = cl_b.k and idx_b = idx))) where n <= 40)"""
