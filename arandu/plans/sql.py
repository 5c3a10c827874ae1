"""Pieces of DuckDB SQL."""

from __future__ import annotations

from ..functions import values as V
from ..functions.legal import references_plain
from ..functions.plain import fold_plain, tokens_plain


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def fold(x: str) -> str:
    return f"strip_accents(lower({squeeze(f'coalesce({x}, {quoted(str())})')}))"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({fold(x)}, '[^\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) > 1 or regexp_full_match(t, '[0-9]+'))"


def shortened(x: str, most: int) -> str:
    return f"(case when length({squeeze(x)}) <= {most} then {squeeze(x)} else rtrim(substr({squeeze(x)}, 1, {most - 3})) || '...' end)"


def words_of(folded: str) -> str:
    return f"regexp_split_to_array({folded}, '[^\\p{{L}}\\p{{N}}_]+')"


def times(folded: str, words: str, word: str) -> str:
    """Whole-word occurrences, else occurrences anywhere; words: the split text."""
    w = quoted(word)
    whole = f"length(list_filter({words}, lambda t: t = {w}))"
    return f"(case when {whole} > 0 then {whole} else (length({folded}) - length(replace({folded}, {w}, ''))) // {len(word)} end)"


def mapped(values: dict[str, float], key: str, default: float) -> str:
    return f"(case {key} " + " ".join(f"when {quoted(k)} then {v}" for k, v in values.items()) + f" else {default} end)"


def lexical(query: str, profile: str = "generic", source_kind: str = "'chunk'", archetype: str = "archetype") -> str:
    """Score over columns f_title, f_heading, f_body, f_file, f_type (folded), w_body (its words), n (length) and, for the
    legal profile, r_title, r_heading, r_body (references) and r_primary."""
    q, words = quoted(fold_plain(query)), tokens_plain(query)
    has = lambda c, w: f"contains({c}, {quoted(w)})::int"
    hits = {c: " + ".join(has(c, w) for w in words) or "0" for c in ("f_title", "f_heading", "f_body", "f_file", "f_type")}
    counts = [times("f_body", "w_body", w) for w in words]
    terms = [
        f"contains(f_title, {q})::int * 12",
        f"contains(f_heading, {q})::int * (case when contains(f_title, {q}) then 4 else 10 end)",
        f"contains(f_body, {q})::int * 4",
        f"contains(f_file, {q})::int * 5",
        f"({hits['f_title']}) * 6",
        f"({hits['f_heading']}) * 5",
        f"least({' + '.join(f'least({n}, 3)' for n in counts)}, {3 * max(len(words), 1)}) * 2",
        f"({hits['f_file']}) * 3",
        f"({hits['f_type']}) * 2",
        f"(case when ({hits['f_title']}) + ({hits['f_heading']}) + ({hits['f_body']}) + ({hits['f_file']}) + contains(f_body, {q})::int > 0 then {mapped(V.SOURCE_BOOST, source_kind, 0)} else 0 end)",
        "(n between 80 and 900)::int * 2",
        "(case when n > 0 and n < 40 then -1 when n > 2200 then -4 when n > 1400 then -2 else 0 end)",
        f"-least({' + '.join(f'greatest({n} - 6, 0)' for n in counts)}, 6)",
    ]
    if profile == "legal":
        terms.append(f"({archetype} in ({', '.join(map(quoted, V.ARCHETYPES[:-1]))}))::int")
        for r in references_plain(query):
            base = r.split("-")[0]
            for c, exact, partial in (("r_title", 26, -14), ("r_heading", 24, -12), ("r_body", 8, -4)):
                terms.append(f"list_contains({c}, {quoted(r)})::int * {exact}")
                if "-" in r:
                    terms.append(f"(not list_contains({c}, {quoted(r)}) and list_contains({c}, {quoted(base)}))::int * {partial}")
            terms.append(f"coalesce(r_primary = {quoted(r)}, false)::int * 42")
            if "-" in r:
                terms.append(f"coalesce(r_primary = {quoted(base)}, false)::int * -20")
    values = f"[{', '.join(terms)}]"
    return f"(case when list_max({values}) > 0 and list_sum({values}) > 0 then list_sum({values})::int else 0 end)"


def references(x: str) -> str:
    """Distinct references of a text, article mentions first."""
    art, bare = V.ARTICLE_MENTION.replace("\\b", r"\b"), V.BARE_MENTION
    part = lambda p: f"list_transform(regexp_extract_all({x}, {quoted('(?i)' + p)}), lambda m: regexp_extract(m, '\\d+') || coalesce('-' || nullif(lower(regexp_extract(m, '(?i)\\d\\s*-?\\s*([a-z])$', 1)), ''), ''))"
    return f"list_concat({part(art)}, {part(bare)})"


#: Lines of documents, and groups of three lines as chunks.
LINES = f"""
lines as (
    select doc_id, lang, source, i as line, {squeeze('l')} as text
    from (select doc_id, lang, source, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)
    where {squeeze('l')} <> ''
), numbered as (
    select *, row_number() over (partition by doc_id order by line) as pos from lines
)"""
CHUNKS = f"""{LINES}, chunks as (
    select doc_id, (pos - 1) // 3 as grp, min(pos) as first_pos, min(lang) as file_type, 'doc_' || doc_id as file_name, 'generic_document' as archetype,
           {shortened("arg_min(text, pos)", 90)} as heading, string_agg(text, chr(10) || chr(10) order by pos) as text
    from numbered group by doc_id, (pos - 1) // 3
)"""
FOLDED = f"""{CHUNKS}, folded as (
    select *, {fold('heading')} as f_title, {fold('heading')} as f_heading, {fold('text')} as f_body, {words_of(fold('text'))} as w_body, {fold('file_name')} as f_file, {fold('archetype')} as f_type, length({squeeze('text')}) as n
    from chunks
)"""


def values(rows: list[tuple], columns: list[str]) -> str:
    """An inline table."""

    def one(v: object) -> str:
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(one, v)) + "]"
        return quoted(v) if isinstance(v, str) else repr(v)

    return "(values " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") as t({', '.join(columns)})"


def hashed_vectors(rows: str, size: int) -> str:
    """id, k, x of the feature-hashed unit vectors of rows (id, text): words, ends of words, pairs, pieces of 3 and 4 characters."""
    h = lambda kind: f"(('0x' || substr(sha1('{kind}::' || feature), 1, 8))::hugeint * 4294967296 + ('0x' || substr(sha1('{kind}::' || feature), 9, 8))::hugeint)"
    run = "replace(f, ' ', '_')"
    pieces = " union all ".join(f"select id, 'char::' || substr({run}, i, {n}), {weight} from (select id, f, unnest(range(1, length(f) - {n} + 2)) as i from t where length(w) > 0)" for n, weight in ((3, 0.18), (4, 0.12)))
    return f"""with t as (select id, {fold('text')} as f, {tokens('text')} as w from ({rows})), each_ as (select id, unnest(w) as x from t),
    feats as (
        select id, 'word::' || x as feature, (1.0::double + least(length(x), 12) / 24.0::double) as weight from each_
        union all select id, 'prefix::' || left(x, 4), 0.28 from each_ where length(x) >= 4 union all select id, 'suffix::' || right(x, 4), 0.28 from each_ where length(x) >= 4
        union all select id, 'bigram::' || w[i] || '_' || w[i + 1], 1.35 from (select id, w, unnest(range(1, length(w))) as i from t) union all {pieces}
    ), signed as (select id, weight::double * case when {h('sign')} % 2 = 0 then 1 else -1 end as v, ({h('primary')} % {size})::int as a, ({h('secondary')} % {size})::int as b from feats),
    sums as (select id, k, sum(v) as v from (select id, a as k, v from signed union all select id, b, v * 0.45::double from signed) group by id, k),
    norms as (select id, sqrt(sum(v * v)) as n from sums group by id)
    select id, k::int as k, round(coalesce(s.v, 0) / n, 6) + 0.0::double as x from norms cross join (select unnest(range({size})) as k) left join sums s using (id, k)"""
