"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_PII_KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b",
}


def _pii() -> str:
    luhn = """list_sum(list_transform(range(1, length(d) + 1), lambda i:
        case when i % 2 = 0 then (case when 2 * cast(substr(reverse(d), i, 1) as int) > 9 then 2 * cast(substr(reverse(d), i, 1) as int) - 9
             else 2 * cast(substr(reverse(d), i, 1) as int) end) else cast(substr(reverse(d), i, 1) as int) end)) % 10 = 0"""
    parts = []
    for n, (kind, pattern) in enumerate(_PII_KINDS.items()):
        parts.append(f"""select doc_id, rid, {n} as k, '{kind}' as kind, unnest(regexp_extract_all(text, '{pattern}')) as v,
            generate_subscripts(regexp_extract_all(text, '{pattern}'), 1) as i,
            list_transform(string_split_regex(text, '{pattern}'), lambda x: length(x)) as gaps,
            list_transform(regexp_extract_all(text, '{pattern}'), lambda x: length(x)) as lens from t""")
    union = " union all ".join(parts)
    return f"""
    with t as (select doc_id, row_number() over () as rid, coalesce(text, '') as text from documents),
    m as ({union}),
    p as (select doc_id, rid, k, kind, v, regexp_replace(v, '[^0-9]', '', 'g') as d, text as txt,
          list_sum(gaps[1:i]) + coalesce(list_sum(lens[1:i - 1]), 0) as s from m join t using (doc_id, rid)),
    good as (select *, s + length(v) as e from p where case kind
        when 'email' then true
        when 'ip' then list_bool_and(list_transform(string_split(v, '.'), lambda x: length(ltrim(x, '0')) <= 3 and coalesce(try_cast(ltrim(x, '0') as int), 0) <= 255))
        when 'card' then length(d) between 16 and 19 and {luhn}
        when 'phone' then length(d) between 8 and 15
        else length(replace(v, ' ', '')) between 15 and 34 and list_reduce(list_prepend(0, list_transform(
             string_split(substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4), ''), lambda c: ascii(c))),
             lambda r, c: case when c < 65 then (r * 10 + c - 48) % 97 else (r * 100 + c - 55) % 97 end) = 1 end),
    near as (select *, lower(substr(txt, cast(greatest(s - 40, 0) + 1 as bigint), cast(s - greatest(s - 40, 0) as bigint)) || ' ' || substr(txt, cast(e + 1 as bigint), 40)) as a from good),
    scored as (select *, round(least(1.0, case kind when 'email' then 0.8 when 'ip' then 0.5 when 'card' then 0.8 when 'phone' then 0.5 else 0.9 end
        + case when regexp_matches(a, '(?:^|[^\\pL])(?:' || case kind when 'email' then 'mail|e-mail|contact|write|courriel|correo|kontakt'
            when 'ip' then 'ip|host|server|address|adresse|login' when 'card' then 'card|visa|credit|debit|karte|carte|tarjeta|payment'
            when 'phone' then 'phone|tel|call|mobile|fax|telefon|téléphone|teléfono' else 'iban|bank|account|konto|compte|cuenta' end || ')(?:[^\\pL]|$)') then 0.15 else 0 end
        - case when regexp_matches(a, '(?:^|[^\\pL])(?:example|sample|test|dummy|fake|version|isbn)(?:[^\\pL]|$)') then 0.3 else 0 end), 2) as score from near)
    select t.doc_id, count(*) filter (kind = 'email') as n_email, count(*) filter (kind = 'ip') as n_ip, count(*) filter (kind = 'card') as n_card,
        count(*) filter (kind = 'phone') as n_phone, count(*) filter (kind = 'iban') as n_iban,
        sha256(coalesce(string_agg(kind || ':' || cast(s as bigint) || ':' || cast(e as bigint), ',' order by k, s) filter (kind <> 'iban'), '')) as base_sha256,
        coalesce(string_agg(kind || ':' || cast(s as bigint) || ':' || cast(e as bigint), ',' order by k, s), '') as spans,
        round(coalesce(sum(score), 0.0), 2) as pii_score
    from t left join scored using (doc_id, rid) group by t.rid, t.doc_id"""


PII = _pii()

DECONTAMINATION = r"""
    with words as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents where doc_id is not null and text is not null),
    items as (select distinct item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from benchmark where text is not null),
    parts as (select distinct item_id, w, least(len(w), 5) as k, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2),
        lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) as s from items where len(w) > 0),
    sizes as (select item_id, w, count(*) as n from parts group by all),
    found as (select distinct doc_id, k, unnest(list_transform(range(1, greatest(len(words.w) - k + 2, 1)), lambda i: array_to_string(words.w[i:i + k - 1], ' '))) as s
        from words, (select distinct k from parts))
    select doc_id, item_id, n as n_shingles, count(*) as n_shared, round(count(*) / n, 6) as containment
    from found join parts using (k, s) join sizes using (item_id, w) group by doc_id, item_id, w, n having count(*) >= 0.8 * n - 1e-9"""

URLS = r"""
    with recursive cut as (select page_id, url, html, case when url like '%://%' then translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
        case when url like '%://%' then regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) else '' end as path from pages),
    rules(verdict, h, p) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
    target as (select host, path, replace(unnest(list_concat(list_transform(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'),
        lambda x: regexp_extract(x, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)), regexp_extract_all(html, '(?is)<meta\b[^>]*http-equiv\s*=\s*["'']?refresh\b[^>]*?url\s*=\s*["'']?([^"''\s>]+)', 1))), '&amp;', '&') as t from cut where html is not null),
    parted as (select *, regexp_extract(t, '(?s)^[^?#]*') as own, coalesce(nullif(regexp_extract(path, '(?s)^.*/'), ''), '/') as folder from target where t <> ''),
    whole as (select host || path as a, host, case when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') then t when t like '//%' then 'http:' || t end as t,
        case when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') or host = '' then null when own = '' then path when own like '/%' then own else folder || own end as p, own = '' as same from parted),
    dotted as (select distinct p, p as q from whole where t is null and not same and p is not null union select p, case when regexp_matches(q, '^/\.\.(/|$)') then regexp_replace(q, '^/\.\.(/|$)', '/')
        when regexp_matches(q, '/\.(/|$)') then regexp_replace(q, '/\.(/|$)', '/') else regexp_replace(q, '/[^/]*/\.\.(/|$)', '/') end from dotted where regexp_matches(q, '/\.\.?(/|$)')),
    ends as (select a, translate(regexp_extract(t, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(t, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as b from whole where t is not null
        union all select a, host || p from whole where t is null and same and p is not null
        union all select a, host || q from whole join dotted using (p) where t is null and not same and not regexp_matches(q, '/\.\.?(/|$)')),
    edges as (select a, b from ends where a <> '' and b <> '' union select b, a from ends where a <> '' and b <> ''),
    reach as (select a as node, a as other from edges union select r.node, e.b from reach r join edges e on r.other = e.a),
    ruled as (select n.node, r.verdict from (select distinct other as node from reach) n join rules r
        on (regexp_extract(n.node, '(?s)^([^/]*)', 1) = h or ends_with(regexp_extract(n.node, '(?s)^([^/]*)', 1), '.' || h)) and starts_with(substr(n.node, length(regexp_extract(n.node, '(?s)^([^/]*)', 1)) + 1), p)
        qualify row_number() over (partition by n.node order by length(h || p) desc) = 1),
    tainted as (select reach.node from reach join ruled on reach.other = ruled.node group by 1 having bool_or(verdict = 'block') and not bool_or(verdict = 'allow')),
    fit as (select page_id, url, host, path, h || p as rule, verdict, row_number() over (partition by cut.rowid_ order by length(h || p) desc) as k
        from (select *, row_number() over () as rowid_ from cut) cut left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
    select page_id, host, path, rule, coalesce(verdict, case when host || path in (select node from tainted) then 'block' else 'allow' end) as verdict from fit where k = 1"""

WARC = """
    with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
    f as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest, payload_bytes >= 1000) end as first from p)
    select page_id, payload_bytes, payload_digest, case when first is not null and first is distinct from page_id then 'revisit' else 'response' end as record_type,
        case when first is distinct from page_id then first end as refers_to from f"""

CHAT = r"""
    with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
        union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    sized as (select *, length(text) + length(regexp_replace(text, '[^\\]', '', 'g'))
            + len(regexp_extract_all(text, '<(?:/?s>|<SYS>>|</SYS>>|/SYS>>|SYS>>|\\)'))
            + len(regexp_extract_all(text, '\[(?:/?INST\]|/?ROLE\]|\\)'))
            + case role when 'system' then 18 when 'user' then 15 when 'assistant' then 6 else 6 + length(role) + 8 + 5 end as chars from turns)
    select conv_id, count(*) as n_turns, count(*) filter (role = 'assistant') as n_examples,
        sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
        coalesce(cast(sum(length(text)) filter (role = 'assistant') as bigint), 0) as loss_chars,
        sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) as loss_sha256,
        cast(sum(chars) as bigint) as formatted_chars from sized group by conv_id"""


def _quality() -> str:
    rules = {
        "length": ("n_words", 15, 40, 1000000, 2000000),
        "symbols": ("100.0::double * n_symbols / nullif(n_words, 0)", None, None, 3, 15),
        "repeats": ("100.0::double * n_repeat_words / nullif(n_words, 0)", None, None, 2, 15),
        "lines": ("100.0::double * n_dup_lines / nullif(n_lines, 0)", None, None, 5, 30),
        "word_length": ("word_chars::double / nullif(n_words, 0)", 2, 3, 9, 12),
        "shouting": ("100.0::double * n_upper / nullif(word_chars, 0)", None, None, 15, 60),
    }
    votes = []
    for name, (value, bad_below, good_from, good_to, bad_above) in rules.items():
        low = "" if bad_below is None else f" or {value} < {bad_below}"
        floor = "" if good_from is None else f" and {value} >= {good_from}"
        votes.append(f"case when {value} is null or {value} > {bad_above}{low} then -1 when {value} <= {good_to}{floor} then 1 else 0 end as v_{name}")
    odds = " + ".join(f"v_{r} * ln(a_{r} / (1 - a_{r}))" for r in rules)
    chance = f"1 / (1 + exp(-(ln(share / (1 - share)) + {odds})))"
    new = ", ".join(
        f"least(0.95, greatest(0.55, (sum(n * case v_{r} when 1 then p when -1 then 1 - p else 0 end) + 8.5) / (sum(n * abs(v_{r})) + 10))) as b_{r}" for r in rules
    )
    return f"""
    with recursive t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
    w as (select rid, doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from t),
    win as (select rid, i, array_to_string(w[i:i + 4], ' ') as s from (select rid, w, unnest(range(1, greatest(len(w) - 3, 1))) as i from w)),
    twice as (select rid, i from win qualify count(*) over (partition by rid, s) > 1),
    covered as (select rid, count(distinct i + k) as n from twice, range(5) r(k) group by rid),
    stats as (select rid, doc_id, len(w) as n_words, cast(list_sum(list_transform(w, lambda x: length(x))) as bigint) as wc, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols,
        len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words, len(l) as n_lines, len(regexp_extract_all(text, '[A-Z]')) as n_upper from w left join covered using (rid)),
    voted as (select *, {", ".join(votes)} from (select *, coalesce(wc, 0) as word_chars from stats)),
    patterns as (select {", ".join(f"v_{r}" for r in rules)}, cast(count(*) as double) as n from voted group by all),
    em(round, done, share, {", ".join(f"a_{r}" for r in rules)}) as (
        select 0, false, 0.8::double, {", ".join("0.85::double" for _ in rules)}
        union all
        select round + 1, greatest({", ".join(["abs(new_share - share)"] + [f"abs(b_{r} - a_{r})" for r in rules])}) < 1e-6, new_share, {", ".join(f"b_{r}" for r in rules)}
        from (select any_value(round) as round, any_value(share) as share, {", ".join(f"any_value(a_{r}) as a_{r}" for r in rules)},
            least(0.95, greatest(0.05, sum(p * n) / sum(n))) as new_share, {new} from (select *, {chance} as p from em, patterns where not done and round < 25) having count(*) > 0)),
    last as (select * from em order by round desc limit 1),
    judged as (select *, round({chance}, 6) as quality, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from voted, last)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality, not base_failed and quality >= 0.5 as kept from judged"""


QUALITY = _quality()

PHRASES = r"""
    with t as (select row_number() over () as d, coalesce(lang, 'und') as lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents),
    pieces as (select lang, unnest(string_split_regex(x, '[.,;:!?\x0A-\x0D]')) as piece from t),
    w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda v: v <> '') as w from pieces),
    totals as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
    spans as (select lang, w, unnest(range(1, len(w) + 1)) as i from w),
    grams as (select lang, w[i : i + k - 1] as ph from spans, range(1, 6) as r(k) where i + k - 1 <= len(w)),
    f as (select lang, ph, count(*) as a from grams group by all having count(*) >= 100),
    cuts as (select lang, ph, a, unnest(range(1, len(ph))) as k from f where len(ph) > 1),
    scored as (select c.lang, c.ph, c.a, c.k, x.a as l, y.a as r, n, cast((1000::hugeint * c.a * n) // (x.a::hugeint * y.a) as bigint) as score
        from cuts c join f x on x.lang = c.lang and x.ph = c.ph[1 : c.k] join f y on y.lang = c.lang and y.ph = c.ph[c.k + 1 :] join totals on totals.lang = c.lang),
    weakest as (select * from scored qualify row_number() over (partition by lang, ph order by score, k) = 1),
    starts as (select lang, ph, a, unnest(range(1, len(ph) + 1)) as i from f where len(ph) > 2),
    inner_ as (select lang, ph[i : i + k - 1] as ph, max(a) as longer from starts, range(2, 5) as r(k) where k < len(starts.ph) and i + k - 1 <= len(starts.ph) group by all),
    kept as (select w.*, array_to_string(w.ph, ' ') as phrase from weakest w left join inner_ using (lang, ph) where longer is null or 100 * longer < 100 * a),
    ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
    select lang, rank, phrase, a, l, r, n, score from ranked where rank <= 2000"""
