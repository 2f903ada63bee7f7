"""DuckDB SQL with the results of the queries."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
PIECES = r"len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]'))"


def _license_sql() -> str:
    from .licenses import APART, FILES, THRESHOLD, template_rows

    quoted = ", ".join("('%s', %d, '%s')" % (name, i, text.replace("'", "''")) for name, i, text in template_rows())
    terms = lambda c: f"list_filter(regexp_split_to_array(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{APART}'), lambda x: x <> '')"
    return f"""
        with f as (
            select doc_id, coalesce(source, '') as repo, coalesce(text, '') as text,
                   'd' || doc_id // 500 || case when doc_id % 500 = 0 then '/LICENSE' when doc_id % 25 = 0 then '/s' || doc_id // 25 % 20 || '/LICENSE' else '/s' || doc_id // 25 % 20 || '/' || doc_id || '.txt' end as path
            from documents),
        g as (select *, regexp_replace(path, '(^|/)[^/]*$', '') as dir, regexp_matches(regexp_extract(path, '[^/]*$'), '{FILES}') as is_licence from f),
        df as (select term, count(*) as df from (select distinct doc_id, unnest({terms("text")}) as term from f) group by 1),
        n as (select count(*) as n from f),
        t as (select license, nth, unnest({terms("text")}) as term from (values {quoted}) v(license, nth, text)),
        tw as (select license, nth, t.term, count(*) * (ln((any_value(n) + 1.0) / (coalesce(any_value(df), 0) + 1)) + 1) as w from t cross join n left join df using (term) group by all),
        tn as (select *, sqrt(sum(w * w) over (partition by license, nth)) as norm from tw),
        u as (select doc_id, unnest(string_split(text, chr(10)) || case when is_licence then [text] else [] end) as line, generate_subscripts(string_split(text, chr(10)) || case when is_licence then [text] else [] end, 1) as unit from g),
        uw as (select doc_id, unit, term, count(*) * (ln((any_value(n) + 1.0) / (any_value(df) + 1)) + 1) as w from (select doc_id, unit, unnest({terms("line")}) as term from u) cross join n join df using (term) group by all),
        us as (select doc_id, unit, sqrt(sum(w * w)) as size from uw group by all),
        dots as (select doc_id, unit, license, nth, sum(uw.w * tn.w / norm) as dot from uw join tn using (term) group by all),
        sc as (select doc_id, license, round(dot / size, 6) as score from dots join us using (doc_id, unit) where round(dot / size, 6) >= {THRESHOLD}),
        own as (select doc_id, license as own_license, score as own_score from sc qualify row_number() over (partition by doc_id order by score desc, license) = 1),
        o as (select g.*, own_license, own_score from g left join own using (doc_id)),
        st as (select repo, dir, own_license as license from o where is_licence and own_license is not null qualify row_number() over (partition by repo, dir order by own_score desc, own_license) = 1),
        near as (
            select o.doc_id, st.license, st.dir from o join st on o.repo = st.repo and (st.dir = '' or o.dir = st.dir or starts_with(o.dir, st.dir || '/'))
            qualify row_number() over (partition by o.doc_id order by length(st.dir) desc) = 1)
        select o.doc_id, path, own_license, own_score, coalesce(own_license, near.license) as license, case when own_license is null then near.dir end as license_dir
        from o left join near using (doc_id)"""


def _secret_sql() -> str:
    """Places of matches from the texts between them; frequencies; spans that add something to the base."""
    from .secrets import KINDS, MIXED

    def one(no: int, kind: str) -> str:
        pattern, group, least = KINDS[kind]
        pattern = pattern.replace("'", "''")
        mixed = " ".join(f"and regexp_matches(value, '{m}')" for m in MIXED) if kind == "owned" else ""
        return f"""select doc_id, owner, {no} as kind_no, '{kind}' as kind, stop - length(whole) as start, stop, value from (
            select *, sum(length(gap) + length(whole)) over (partition by doc_id order by pos) as stop from (
                select doc_id, owner, generate_subscripts(ms, 1) as pos, unnest(ms) as whole, unnest(vs) as value, unnest(gaps[1:len(ms)]) as gap from (
                    select doc_id, coalesce(source, '') as owner, regexp_extract_all(t, '{pattern}', 0) as ms, regexp_extract_all(t, '{pattern}', {group}) as vs, string_split_regex(t, '{pattern}') as gaps
                    from (select doc_id, source, coalesce(text, '') as t from documents) where regexp_matches(t, '{pattern}')))) where length(value) >= {least} {mixed}"""

    span = "kind || ':' || start::bigint || ':' || stop::bigint"
    return f"""
        with f as ({" union all ".join(one(i, k) for i, k in enumerate(KINDS))}),
        seen as (select value, count(distinct owner) as owners, count(distinct (owner, doc_id)) as repos from f group by 1),
        s as (select f.*, owners <= 1 and repos <= 3 as live from f join seen using (value)),
        shown as (select * from s where kind <> 'owned' or (live and not exists (select 1 from s b where b.doc_id = s.doc_id and b.kind <> 'owned' and b.start <= s.start and s.stop <= b.stop))),
        g as (select doc_id, count(*) filter (kind = 'assign') as a, count(*) filter (kind = 'access') as c, count(*) filter (kind = 'hex') as h, string_agg({span}, ',' order by start, kind_no) filter (kind <> 'owned') as base,
                string_agg({span}, ',' order by start, kind_no) as spans, count(*) filter (kind <> 'owned' and live) as lv, count(*) filter (kind <> 'owned' and not live) as ex from shown group by 1)
        select doc_id, coalesce(a, 0) as n_assign, coalesce(c, 0) as n_access, coalesce(h, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(lv, 0) as n_live, coalesce(ex, 0) as n_example
        from documents left join g using (doc_id)"""


SPLIT = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _quality_sql() -> str:
    from .quality import Rules

    r = Rules()
    runs = ", ".join(f"coalesce(max(c) filter (k = {k}), 0)::bigint as run_{k}" for k in r.run)
    kept = " and ".join(f"100 * run_{k} <= {most} * word_chars" for k, most in r.run.items())
    return rf"""
        with d as (select doc_id, coalesce(text, '') as t, {SPLIT.format("coalesce(text, '')")} as w from documents),
        runs as (
            select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as run
            from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select unnest({[3, *r.run]}) as k) where len(w) >= k)),
        seen as (select *, count(*) over same as n, row_number() over (partition by doc_id, k, run order by i) as nth from runs window same as (partition by doc_id, k, run)),
        hit as (select distinct doc_id, k, p from (select doc_id, k, unnest(range(i, i + k)) as p from seen where n > 1 and (k = 3 or nth > 1))),
        chars as (select doc_id, k, count(*) as words, sum(length(w[p])) as c from hit join d using (doc_id) group by all),
        cov as (select doc_id, coalesce(max(words) filter (k = 3), 0)::bigint as n_repeat_words, {runs} from chars group by all),
        lines as (select doc_id, line, row_number() over (partition by doc_id, line) > 1 as again from (select doc_id, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^ 	-
]')),
        ln as (select doc_id, count(*) as n_lines, count(*) filter (again) as n_dup_lines, coalesce(sum(length(line)) filter (again), 0)::bigint as line_chars, sum(length(line))::bigint as all_line_chars from lines group by all),
        m as (
            select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
                   coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_lines, 0)::bigint as n_lines, coalesce(line_chars, 0)::bigint as line_chars, coalesce(all_line_chars, 0)::bigint as all_line_chars,
                   {", ".join(f"coalesce(run_{k}, 0)::bigint as run_{k}" for k in r.run)}
            from d left join cov using (doc_id) left join ln using (doc_id))
        select *, n_words < {r.least_words} or 100 * n_repeat_words > {r.repeat_words} * n_words as base_failed,
               not (n_words < {r.least_words} or 100 * n_repeat_words > {r.repeat_words} * n_words) and {kept} and 100 * n_dup_lines <= {r.lines} * n_lines and 100 * line_chars <= {r.line_chars} * all_line_chars as kept
        from m"""


ORACLES = {
    "op1_license_scan": _license_sql(),
    "op9_token_counts": f"""
        with d as (select source, lang, {WORDS} as w, {PIECES} as p from documents)
        select source, lang, 'words' as version, count(*) as n_docs, sum(case when lang = 'de' then p else w end)::bigint as n_tokens from d where w >= 40 group by all
        union all
        select source, lang, 'pieces', count(*), sum(p)::bigint from d where w >= 40 group by all""",
    "op6_exact_dedup": f"""
        with d as (select doc_id, {LOWER} as t from documents)
        select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
               row_number() over (partition by t order by doc_id desc) = 1 as kept, sha256(t) as text_sha256
        from d""",
    "op8_decontamination": rf"""
        with d as (select doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        b as (select item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        win as (
            select distinct item_id, array_to_string(w[i:i + m - 1], ' ') as k, m
            from (select item_id, w, least(len(w), 10) as m, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)),
        sizes as (select distinct m from win),
        runs as (
            select doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') as k
            from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from d, sizes where len(w) >= m)),
        hit as (select doc_id, i, r.m, item_id from runs r join win using (k, m)),
        pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + m)) as p from hit) group by 1),
        its as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hit group by 1)
        select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
               sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join pos using (doc_id) left join its using (doc_id)""",
    "op2_jaccard_join": f"""
        with recursive d as (select doc_id, {SPLIT.format(LOWER)} as w from documents),
        sh as (select distinct doc_id, s from (select doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from d)),
        n as (select doc_id, count(*) as n from sh group by 1),
        common as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b using (s) where a.doc_id < b.doc_id group by 1, 2),
        links as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
        sides as (select a, b from links union all select b, a from links),
        reach as (select doc_id as id, doc_id as root from d union select sides.b, root from reach join sides on sides.a = reach.id)
        select d.doc_id, coalesce(n, 0)::bigint as n_shingles, (select min(root) from reach where id = d.doc_id) as component_id from d left join n using (doc_id)""",
    "op3_secrets": _secret_sql(),
    "op11_hard_negatives": """
        with v as (
            select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
            from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select a.rid as rid, a.vec_id as anchor_id, b.vec_id as id, b.label = a.label as alike, list_inner_product(a.q, b.q)::bigint as score from v a join v b on a.rid <> b.rid where a.vec_id % 100 = 0),
        p as (select rid, anchor_id, id as positive_id, score as positive_score from s where alike qualify row_number() over (partition by rid order by score desc, id) <= 5)
        select p.anchor_id, positive_id, row_number() over (partition by p.rid, positive_id order by s.score desc, s.id)::int as rank, s.id as negative_id, positive_score, s.score as negative_score
        from p join s on s.rid = p.rid and not s.alike and 80 * positive_score <= 100 * s.score and s.score <= positive_score
        qualify rank <= 5""",
    "op12_collocations": rf"""
        with p as (select doc_id, coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')) as piece from documents),
        w as (select lang, row_number() over () as no, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
        n as (select lang, sum(len(w))::bigint as n from w group by 1),
        g as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, (values (1), (2), (3)) s(k) where len(w) >= k)),
        f as (select lang, k, phrase, count(*) as f from g group by all having count(*) >= 10),
        c as (select *, string_split(phrase, ' ') as w from f where k > 1),
        cuts as (select lang, phrase, k, f as a, cut, array_to_string(w[1:cut], ' ') as head, array_to_string(w[cut + 1:], ' ') as tail from (select *, unnest(range(1, k)) as cut from c)),
        s as (select cuts.*, l.f as l, r.f as r, (1000000::hugeint * a * a // (l.f::hugeint * r.f))::bigint as score from cuts join f l on l.lang = cuts.lang and l.phrase = head join f r on r.lang = cuts.lang and r.phrase = tail),
        low as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
        sub as (select lang, array_to_string(w[i:i + 1], ' ') as phrase, max(f) as longer from (select *, unnest([1, 2]) as i from c where k = 3) group by all),
        kept as (select low.* from low left join sub on sub.lang = low.lang and sub.phrase = low.phrase and low.k = 2 where longer is null or 100 * longer < 50 * a)
        select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
        from kept join n using (lang) qualify rank <= 2000""",
    "op13_quality_rules": _quality_sql(),
    "op10_substring_dedup": f"""
        with d as (select doc_id, {SPLIT.format("coalesce(text, '')")} as w from documents),
        win as (select doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) as k from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)),
        low as (select k, min(doc_id) as low from win group by 1),
        gone as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 50)) as p from win join low using (k) where low < doc_id)),
        runs as (select doc_id, count(*) as n, count(*) filter (before is distinct from p - 1) as runs from (select *, lag(p) over (partition by doc_id order by p) as before from gone) group by 1),
        kept as (select doc_id, string_agg(x, ' ' order by p) as kept from (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as p from d) left join gone g using (doc_id, p) where g.p is null group by 1)
        select doc_id, len(w)::bigint as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256, coalesce(runs, 0) as n_repeats from d left join runs using (doc_id) left join kept using (doc_id)""",
}
