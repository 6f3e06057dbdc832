"""DuckDB SQL with the results of the catalog's queries, built from the same constants and small tables."""

from __future__ import annotations

from lodestone import constants as C
from lodestone.plans import catalog as Q
from lodestone.plans import fixtures as X

BLOCK = X.SUBJECT_BLOCK
V = X.sql_value


def _list(words) -> str:
    return V(sorted(words))


def _re(pattern: str) -> str:
    return V(pattern)


STOPS = _list(C.STOP_WORDS | C.QUESTION_WORDS)
NAME_TOKEN = V(C.NAME_TOKEN)
NAME_STRIP = V(C.NAME_STRIP)
ATOM = V(r"\[[^\]]+\]|Br|Cl|[BCNOSPFIbcnosp]")


def bibliography(text: str) -> str:
    m, c, i = (f"len(regexp_extract_all({text}, {V(p)}))" for p in (C.REFERENCE_MARKER, C.REFERENCE_CITATION, C.REFERENCE_INITIALS))
    return f"({m} >= 3 or {c} >= 3 or ({i} >= 6 and {m} >= 1))"


def terms(text: str) -> str:
    tokens = f"regexp_extract_all(lower({text}), '[a-z0-9]+')"
    kept = f"list_filter({tokens}, lambda t: not list_contains({STOPS}, t))"
    return f"case when len({kept}) = 0 then {tokens} else {kept} end"


STEP = C.CHUNK_WORDS - C.OVERLAP_WORDS
#: More chunks than a page can have; a passage's key here is one number, and two columns in results.
PAGE_STEP = 1 << 32
PLACE = f"cast(chunk_ord // {PAGE_STEP} as bigint) as page_ord, cast(chunk_ord % {PAGE_STEP} as integer) as chunk_idx"
def chunks_of(pages: str = "documents", p: str = "") -> str:
    """CTEs that end in ``chunks`` over a table of documents."""
    return f"""
{p}page_words as (select doc_id, source, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as ws from {pages}),
{p}chunks as (
  select cast(doc_id as hugeint) * {PAGE_STEP} + i as chunk_ord, source as source_doc, doc_id as page_number, cast(i as integer) as chunk_idx,
    array_to_string(ws[i * {STEP} + 1 : i * {STEP} + {C.CHUNK_WORDS}], ' ') as text
  from (select *, unnest(range(0, case when len(ws) <= {C.CHUNK_WORDS} then 1 else 1 + cast(ceil((len(ws) - {C.CHUNK_WORDS}) / {STEP}.0) as bigint) end)) as i from {p}page_words where len(ws) > 0)
)"""


CHUNKS = chunks_of()
PROSE = f"prose as (select * from chunks where not {bibliography('text')})"


def names_of(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, {NAME_TOKEN}), lambda t: lower(trim(t, {NAME_STRIP})))"


def morphemes(word: str, words: tuple[str, ...] = C.MORPHEMES) -> str:
    spans = f"list_transform({V(list(words))}, lambda m: {{'s': instr({word}, m), 'e': instr({word}, m) + length(m)}})"
    found = f"list_transform(list_filter({spans}, lambda p: p.s > 0), lambda p: [p])"
    clash = "len(list_filter(a, lambda t: t.s < x[1].e and x[1].s < t.e)) > 0"
    return f"cast(len(list_reduce({found}, lambda a, x: case when {clash} then a else list_concat(a, x) end, cast([] as struct(s bigint, e bigint)[]))) as integer)"


def looks(word: str, suffixes: tuple[str, ...]) -> str:
    locant = f"(regexp_matches({word}, {V(C.LOCANT)}) or regexp_matches({word}, '^({'|'.join(C.LOCANT_PREFIXES)})'))"
    suffix, alpha = f"regexp_matches({word}, '({'|'.join(suffixes)})$')", f"regexp_full_match({word}, '\\p{{L}}+')"
    return (
        f"(case when length({word}) < {C.MIN_WORD} or list_contains({_list(C.FALSE_FRIENDS)}, {word}) then false when list_contains({_list(C.SEEDS)}, {word}) then true "
        f"when {locant} and ({suffix} or regexp_matches({word}, '[0-9]')) then true when {suffix} and {alpha} then true "
        f"else length({word}) >= {C.MIN_MORPHEME_WORD} and {alpha} and {morphemes(word)} >= {C.MIN_MORPHEMES} end)"
    )


def candidates(suffixes: tuple[str, ...], vocabulary: str, source: str = "chunks", p: str = "") -> str:
    """CTEs up to ``candidates`` (chunk_ord, name); vocabulary is a table with a name."""
    return f"""
{p}vocab as (select distinct name from {vocabulary}),
{p}split as (select chunk_ord, {names_of('text')} as ws from {source}),
{p}toks as (select chunk_ord, ws[i] as w, ws[i + 1] as nxt from (select *, unnest(range(1, len(ws) + 1)) as i from {p}split)),
{p}lexical as (select distinct chunk_ord, w as name from {p}toks where w in (select w from (select distinct w from {p}toks) where {looks('w', suffixes)})),
{p}hyphen as (select distinct chunk_ord, lower(trim(part, {NAME_STRIP})) as name from (select chunk_ord, unnest(string_split(w, '-')) as part from {p}toks where contains(w, '-') and w not in (select name from {p}vocab)) where lower(trim(part, {NAME_STRIP})) in (select name from {p}vocab)),
{p}joined as (select distinct chunk_ord, w || nxt as name from {p}toks where w <> '' and nxt <> '' and w || nxt in (select name from {p}vocab)),
{p}acid as (select distinct chunk_ord, w || ' acid' as name from {p}toks where nxt = 'acid' and length(w) > {C.MIN_ACID_STEM} and w like '%ic'),
{p}candidates as (select * from {p}lexical union select * from {p}hyphen union select * from {p}joined union select * from {p}acid)"""


LEXICON = X.sql_rows(X.LEXICON, "name, smiles")
CACHE = X.sql_rows(X.CACHE, "name, smiles")


def graphs(strings: str, p: str = "") -> str:
    """CTEs that end in ``{p}graph`` (smiles, valid, block, atoms, key): the structure of each of ``strings`` (smiles), whatever way it is written."""
    near = "list_transform(near, lambda x, i: md5(c[i] || array_to_string(list_sort(list_transform(x, lambda j: c[j + 1])), '')))"

    def together(c: str) -> str:
        return f"md5(array_to_string(list_sort(list_filter({c}, lambda x, i: mine[i])), ''))"

    room = " ".join(
        f"when element = '{e}' then case when aromatic then greatest(0, {v[0]} - used - 1) " + " ".join(f"when used <= {x} then {x} - used" for x in v) + " else 0 end" for e, v in C.VALENCES.items()
    )
    fits = " ".join(f"when element = '{e}' then aromatic or used <= {v[-1]}" for e, v in C.VALENCES.items())
    return f"""
{p}strings as (select distinct smiles from {strings} where smiles is not null),
{p}cut as (select smiles, array_to_string(s, '') = smiles as whole, unnest(s) as symbol, unnest(range(len(s))) as i from (select smiles, regexp_extract_all(smiles, {V(C.SMILES_SYMBOL)}) as s from {p}strings)),
{p}kinds as (select *, case when symbol = '(' then 'open' when symbol = ')' then 'close' when symbol = '.' then 'dot' when symbol[1] between '0' and '9' or symbol[1] = '%' then 'ring' when symbol[1] in ('-', '=', '#', '$', ':', '/', '\\') then 'bond' else 'atom' end as kind from {p}cut),
{p}deep as (select *, sum(case kind when 'open' then 1 when 'close' then -1 else 0 end) over w as depth, case when kind = 'atom' then count(*) filter (kind = 'atom') over w - 1 end as atom,
  lag(kind) over (partition by smiles order by i) as before, lag(symbol) over (partition by smiles order by i) as symbol_before, lead(kind) over (partition by smiles order by i) is null as final from {p}kinds window w as (partition by smiles order by i rows unbounded preceding)),
{p}parts as (select *, coalesce(max(case when kind = 'open' then i end) over (partition by smiles, depth order by i rows unbounded preceding), -1) as branch from {p}deep),
{p}latest as (select *, last_value(atom ignore nulls) over (partition by smiles, depth, branch order by i rows unbounded preceding) as own from {p}parts),
{p}starts as (select *, coalesce(atom, case when kind = 'open' then lag(own) over (partition by smiles order by i) end) as start from {p}latest),
{p}placed as (select *, last_value(start ignore nulls) over (partition by smiles, depth, branch order by i rows unbounded preceding) as anchor,
  case when kind = 'atom' and before is distinct from 'dot' then last_value(start ignore nulls) over (partition by smiles, depth, branch order by i rows between unbounded preceding and 1 preceding) end as parent,
  case when before = 'bond' then symbol_before end as bond,
  coalesce(whole and depth >= 0 and (not final or (depth = 0 and kind in ('atom', 'ring', 'close'))) and case kind when 'atom' then true when 'bond' then before in ('atom', 'ring', 'open', 'close') when 'ring' then before in ('atom', 'ring', 'bond', 'close') else before in ('atom', 'ring', 'close') end, false) as sound from {p}starts),
{p}ends as (select *, row_number() over (partition by smiles, label order by i) - 1 as nth from (select smiles, i, anchor, cast(ltrim(symbol, '%') as integer) as label, case bond when '=' then 2 when '#' then 3 when '$' then 4 else case when bond is not null then 1 end end as given from {p}placed where kind = 'ring')),
{p}bonds as (
  select smiles, parent as a, atom as b, case bond when '=' then 2 when '#' then 3 when '$' then 4 else 1 end as o, true as sound from {p}placed where parent is not null
  union all select smiles, arg_min(anchor, i), arg_max(anchor, i), coalesce(max(given), 1), count(*) = 2 and arg_min(anchor, i) <> arg_max(anchor, i) and coalesce(max(given) = min(given), true) from {p}ends group by smiles, label, nth // 2),
{p}beside as (select smiles, atom, sum(o) as used, list(other order by other) as others from (select smiles, a as atom, b as other, o from {p}bonds union all select smiles, b, a, o from {p}bonds) group by smiles, atom),
{p}raw as (select smiles, atom, symbol[1] = '[' as boxed, case when symbol[1] = '[' then regexp_extract(symbol, {V(C.SMILES_BRACKET)}, 2) else symbol end as name, regexp_extract(symbol, {V(C.SMILES_BRACKET)}, 1) as isotope, regexp_extract(symbol, {V(C.SMILES_BRACKET)}, 4) as hs, regexp_extract(symbol, {V(C.SMILES_BRACKET)}, 5) as plus from {p}placed where kind = 'atom'),
{p}atoms as (select r.*, upper(name[1]) || name[2:] as element, lower(name) = name as aromatic, coalesce(used, 0) as used, coalesce(others, []) as others,
  case when not boxed or plus = '' then 0 when regexp_matches(plus, '[0-9]') then cast(plus as integer) else len(plus) * case when plus[1] = '-' then -1 else 1 end end as charge from {p}raw r left join {p}beside using (smiles, atom)),
{p}counted as (select *, case when boxed then case when hs = '' then 0 when hs = 'H' then 1 else cast(hs[2:] as integer) end else case {room} else 0 end end as hydrogens,
  element in ({', '.join(map(V, C.ELEMENTS))}) and len(list_distinct(others)) = len(others) and (boxed or case {fits} else true end) as sound from {p}atoms),
{p}mols as (
  select smiles, a.hs, a.es, a.cs, a.iso, a.others, s.ok and coalesce(a.ok, false) and coalesce(b.ok, true) as valid from (select smiles, bool_and(sound) as ok from {p}placed group by smiles) s
  left join (select smiles, list(hydrogens order by atom) as hs, list(element order by atom) as es, list(charge order by atom) as cs, list(isotope order by atom) as iso, list(others order by atom) as others, bool_and(sound) as ok from {p}counted group by smiles) a using (smiles)
  left join (select smiles, bool_and(sound) as ok from {p}bonds group by smiles) b using (smiles)),
{p}nets as (select *, list_transform(others, lambda x, i: list_filter(x, lambda j: es[i] <> 'H' and es[j + 1] <> 'H')) as near,
  list_transform(es, lambda e, i: e || ':' || (hs[i] + len(list_filter(others[i], lambda j: es[j + 1] = 'H')) - case when len(list_filter(others[i], lambda j: cs[j + 1] <> 0)) > 0 then 0 else cs[i] end)) as labels from {p}mols where valid),
{p}joined(smiles, r, c, near) as (select smiles, 0, range(len(es)), near from {p}nets union all select smiles, r + 1, list_transform(near, lambda x, i: list_min(list_concat([c[i]], list_transform(x, lambda j: c[j + 1])))), near from {p}joined where r < len(near)),
{p}pieces as (select n.*, j.c as piece from {p}nets n join {p}joined j on j.smiles = n.smiles and j.r = len(n.near)),
{p}sized as (select smiles, arg_max(root, size * 100000 - root) as root, max(size) as size from (select smiles, root, count(*) filter (heavy) as size from (select smiles, unnest(piece) as root, unnest(list_transform(es, lambda e: e <> 'H')) as heavy from {p}pieces) group by smiles, root) group by smiles),
{p}own as (select p.*, size, cast(size // 2 + 1 as bigint) as times, list_transform(piece, lambda x, i: x = root and es[i] <> 'H') as mine from {p}pieces p join {p}sized using (smiles)),
{p}around(smiles, r, c, near, times, n, told) as (select smiles, 0, labels, near, times, len(list_distinct(labels)), false from {p}own union all select smiles, r + 1, x, near, times, len(list_distinct(x)), len(list_distinct(x)) = n from (select *, {near} as x from {p}around where r < times and not told)),
{p}coloured as (select o.*, a.c from {p}own o join (select * from {p}around qualify row_number() over (partition by smiles order by r desc) = 1) a using (smiles)),
{p}alike as (select smiles, unnest(list_filter(range(1, len(c) + 1), lambda v: mine[v] and len(list_filter(c, lambda x, i: mine[i] and x = c[v])) > 1)) as v from {p}coloured),
{p}marks as (select *, list_transform(c, lambda x, i: case when i = v then x || '*' else x end) as m from {p}coloured join {p}alike using (smiles)),
{p}marked(smiles, v, r, c, near, times, n, told) as (select smiles, v, 0, m, near, times, len(list_distinct(m)), false from {p}marks union all select smiles, v, r + 1, x, near, times, len(list_distinct(x)), len(list_distinct(x)) = n from (select *, {near} as x from {p}marked where r < times and not told)),
{p}told as (select smiles, string_agg(t, '' order by t) as t from (select m.smiles, {together('m.c')} as t from (select * from {p}marked qualify row_number() over (partition by smiles, v order by r desc) = 1) m join {p}own o on o.smiles = m.smiles) group by smiles),
{p}graph as (select s.smiles, coalesce(valid, false) as valid, size as atoms, case when size >= {C.MIN_HEAVY_ATOMS} then upper(left(sha256({together('c')} || coalesce(t, '')), 14)) end as block,
  upper(left(sha256(array_to_string(list_sort(list_filter(list_transform(c, lambda x, i: case when mine[i] and (cs[i] <> 0 or iso[i] <> '') then x || ':' || cs[i] || ':' || iso[i] end), lambda x: x is not null)), '')), 10)) as rest
  from {p}strings s left join {p}coloured using (smiles) left join {p}told using (smiles))"""


def keyed(source: str = "resolved", p: str = "") -> str:
    """CTEs that end in ``{p}keyed`` (name, smiles, f, valid, block, atoms) of a source (name, smiles); f is the largest part as it is written."""
    return f"""
{graphs(source, p + 'mol_')},
{p}frags as (select smiles, f, j, len(regexp_extract_all(f, {ATOM})) as n from (select smiles, string_split(smiles, '.') as fs, unnest(range(1, len(string_split(smiles, '.')) + 1)) as j, fs[j] as f from {p}mol_strings)),
{p}keyed as (select name, r.smiles, f, valid, block, atoms from {source} r join {p}mol_graph g on g.smiles = r.smiles join (select smiles, arg_max(f, n * 1000 - j) as f from {p}frags group by smiles) w on w.smiles = r.smiles)"""


def written(source: str) -> str:
    """CTEs that end in ``keyed`` (name, block, atoms): digests of the largest part as it is written, for canonical strings."""
    return f"""
frags as (select name, smiles, f, j, len(regexp_extract_all(f, {ATOM})) as atoms from (select name, smiles, string_split(smiles, '.') as fs, unnest(range(1, len(string_split(smiles, '.')) + 1)) as j, fs[j] as f from {source} where smiles is not null)),
largest as (select name, smiles, arg_max(f, atoms * 1000 - j) as f, max(atoms) as atoms from frags group by name, smiles),
keyed as (select name, smiles, f, case when atoms >= {C.MIN_HEAVY_ATOMS} then upper(left(sha256(regexp_replace(f, '[/\\\\@]', '', 'g')), 14)) end as block, atoms from largest)"""


def resolve(wanted: str = "wanted", lexicon: str = LEXICON, p: str = "") -> str:
    return f"""
{p}resolved as (select n.name, case when l.name is not null then l.smiles when c.name is not null then c.smiles end as smiles,
  case when l.name is not null then 'lexicon' when c.name is not null then 'cache' else 'unresolved' end as tier
  from {wanted} n left join {lexicon} l using (name) left join {CACHE} c on c.name = n.name)"""


KEYED, RESOLVE = keyed(), resolve()
#: The structures of all names.
WHOLE_INDEX = f"""{CHUNKS},{candidates(X.RULES.suffixes, LEXICON)},
frequency as (select name, count(*) as frequency from candidates group by name),
wanted as (select name from frequency),{RESOLVE},{KEYED},
compounds as (select name, smiles, block from keyed where block is not null),
entities as (select chunk_ord, c.name, block from candidates c join compounds using (name)),
gathered as (select chunk_ord, list_sort(list_distinct(list(name))) as compounds, list_sort(list_distinct(list(block))) as blocks from entities group by chunk_ord),
annotated as (select c.*, coalesce(g.compounds, cast([] as varchar[])) as compounds, coalesce(g.blocks, cast([] as varchar[])) as blocks from chunks c left join gathered g using (chunk_ord))"""
#: Those of the most frequent names.
INDEX = WHOLE_INDEX.replace("wanted as (select name from frequency)", f"wanted as (select name from frequency order by frequency desc, name limit {X.MAX_CANDIDATES})")


def bm25(name: str, scope: str, questions: str, k: int) -> str:
    """CTEs that end in ``name`` (question_id, chunk_ord, score, rank) over the scope's prose."""
    p = name
    return f"""
{p}_scope as (select chunk_ord, regexp_extract_all(lower(text), '[a-z0-9]+') as ts from {scope} where not {bibliography('text')}),
{p}_stats as (select count(*) as n, avg(len(ts)) as mean from {p}_scope),
{p}_asked as (select question_id, term, count(*) as weight from (select question_id, unnest({terms('question')}) as term from {questions}) group by all),
{p}_tf as (select chunk_ord, dl, term, count(*) as tf from (select chunk_ord, len(ts) as dl, unnest(ts) as term from {p}_scope) where term in (select term from {p}_asked) group by all),
{p}_df as (select term, count(*) as df from {p}_tf group by term),
{p}_all as (select question_id, chunk_ord, round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {C.BM25_K1 + 1} / (tf + {C.BM25_K1} * (1 - {C.BM25_B} + {C.BM25_B} * dl / mean))), 3) as score
  from {p}_tf join {p}_df using (term) cross join {p}_stats join {p}_asked using (term) group by all),
{p} as (select * from (select *, cast(row_number() over (partition by question_id order by score desc, chunk_ord) as integer) as rank from {p}_all) where rank <= {k})"""


ONE = f"(select cast(question_id as bigint) as question_id, question from {X.sql_rows([(0, X.QUESTION)], 'question_id, question')})"
SCOPE = f"scope as (select * from annotated where list_contains(blocks, '{BLOCK}'))"


def structure(name: str, questions: str, k: int, scope: str = "scope") -> str:
    """CTEs that end in ``name`` (question_id, chunk_ord, score, rank), with the fallback."""
    return f"""{bm25(f'{name}_text', scope, f"(select * from {questions} where coalesce(question, '') <> '')", k)},
{name}_rich as (select chunk_ord, cast(row_number() over (order by len(compounds) desc, chunk_ord) as integer) as rank from {scope} where not {bibliography('text')}),
{name} as (select question_id, chunk_ord, score, rank from {name}_text union all
  select question_id, chunk_ord, cast(null as double), rank from {questions} cross join {name}_rich where rank <= {k} and question_id not in (select question_id from {name}_text))"""


def interleaved(name: str, routes: list[str], marker: str, k: int) -> str:
    union = " union all ".join(f"select question_id, chunk_ord, score, (rank - 1) * {len(routes)} + {i} as place, {i} as route_no from {r}" for i, r in enumerate(routes))
    return f"""
{name}_all as ({union}),
{name}_once as (select * from (select m.*, row_number() over (partition by question_id, {marker} order by place) as copy from {name}_all m join chunks c using (chunk_ord)) where copy = 1),
{name} as (select * from (select question_id, chunk_ord, score, route_no, cast(row_number() over (partition by question_id order by place) as integer) as rank from {name}_once) where rank <= {k})"""


TURNS = """
turns as (select conv_id as question_id, turn, role, text, max(case when role = 'user' then turn end) over (partition by conv_id) as last from conversations),
questions as (select question_id, text as question from turns where turn = last and role = 'user'),
history as (select question_id, turn, role, text from turns where turn < last)"""
CONTEXTUAL = f"""
recent as (select * from (select *, row_number() over (partition by question_id order by turn desc) as age from history) where age <= {C.HISTORY_TURNS}),
asked as (select question_id, string_agg(text, ' ' order by turn) as asked from (select *, row_number() over (partition by question_id order by turn desc) as back from recent where role = 'user') where back <= {C.CARRIED_QUESTIONS} group by question_id),
answers as (select question_id, arg_max(text, turn) as answer from recent where role = 'assistant' group by question_id),
contextual as (select question_id, question, concat_ws(' ', asked, case when len({terms('question')}) <= {C.SHORT_QUESTION} then left(regexp_replace(answer, '\\[Source [0-9]+\\]', '', 'g'), {C.HINT_CHARACTERS}) end, question) as contextual
  from questions left join asked using (question_id) left join answers using (question_id))"""
FOLLOW_UP = f"(regexp_matches({{0}}, {V('(?i)' + C.FOLLOW_UP)}) or len({terms('{0}')}) <= {C.FOLLOW_UP_TERMS})"


def follow_up(text: str) -> str:
    return FOLLOW_UP.replace("{0}", text)


QUERY_NAMES = f"""
own as (select distinct name from compounds where block = '{BLOCK}'),
names as (select name from own union select '{X.EXTRA_NAME}' where lower('{X.EXTRA_NAME}') not in (select lower(name) from own))"""
EDGE_L, EDGE_R = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
NAME_HITS = f"hits as (select name, chunk_ord from names join chunks on regexp_matches(text, '(?i){EDGE_L}' || name || '{EDGE_R}'))"

_IMAGE = "filename, page, image_index, width, height, white_frac, ink_frac, chroma, n_hlines, grid"
IMAGES = (
    f"(select * from {X.sql_rows([(*i, *(X.FEATURES.get(i[:3]) or (None,) * 5)) for i in X.IMAGES], _IMAGE)} union all "
    f"select filename, page, image_index, width, height, {', '.join(f'case when decoded then {c} end' for c in ('white_frac', 'ink_frac', 'chroma', 'n_hlines', 'grid'))} from {X.duck_rows(X.IMAGES_OF_DOCUMENTS, documents='documents')})"
)
THIN = f"coalesce(width <> 0 and height <> 0 and ((height <= {C.STRIP_THICKNESS} and width / cast(height as double) >= {C.STRIP_ASPECT}) or (width <= {C.STRIP_THICKNESS} and width / cast(height as double) <= {1 / C.STRIP_ASPECT})), false)"
TABLE_LIKE = "((aspect >= 1.7 and n_hlines >= 4 and white_frac >= 0.45 and ink_frac <= 0.5) or (grid and aspect >= 1.35 and white_frac >= 0.4 and ink_frac <= 0.5))"
LINE_ART = "(white_frac >= 0.45 and ink_frac <= 0.35 and chroma < 20)"
_CASES = [
    ("coalesce(width, 0) = 0 or coalesce(height, 0) = 0", "unknown", "['missing_dimensions']"), (f"{THIN} and height <= {C.STRIP_THICKNESS}", "table_image", "['thin_wide_strip']"), (THIN, "table_image", "['thin_tall_strip']"),
    ("white_frac is null and aspect >= 2.2", "scheme_or_reaction", "['wide_aspect_only']"), ("white_frac is null and aspect between 0.65 and 1.45", "structure_drawing", "['near_square_only']"), ("white_frac is null", "other", "['geometry_only']"),
    (TABLE_LIKE, "table_image", "list_filter([case when aspect >= 1.7 then 'wide_aspect' end, case when grid then 'grid_like' end, 'horizontal_lines'], lambda x: x is not null)"),
    (f"aspect between 0.55 and 1.7 and {LINE_ART}", "structure_drawing", "['near_square', 'sparse_line_art']"), (LINE_ART, "scheme_or_reaction", "['line_art_composite']"), ("aspect >= 1.6 and white_frac >= 0.35", "scheme_or_reaction", "['wide_composite']"),
]
CLASSIFIED = (
    f"images as (select *, width / cast(nullif(height, 0) as double) as aspect from {IMAGES}), "
    f"classified as (select *, case {' '.join(f'when {c} then {V(label)}' for c, label, _ in _CASES)} else 'other' end as label, "
    f"case {' '.join(f'when {c} then {r}' for c, _, r in _CASES)} else ['dense_or_photo'] end as reasons from images)"
)

_WORDS = "(select doc_id, i - 1 as word_ord, ws[i] as text from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from (select doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as ws from documents)))"
_BOX = 'table_id, word_ord, text, conf, "left", top, width, height'
BOXES = f"(select * from {X.sql_rows(X.word_boxes(), _BOX)} union all select {_BOX} from {X.duck_rows(X.BOXES_OF_WORDS, words=_WORDS)})"
TABLES = f"(select distinct table_id from {X.sql_rows(X.word_boxes(), _BOX)} union all select 'empty' union all select 'doc' || doc_id from documents)"
ROWS = f"""
boxes as (select * from {BOXES}),
measured as (select b.*, line_height, top + height / 2.0 as centre from boxes b join (select table_id, median(height) as line_height from boxes group by table_id) using (table_id)),
flagged as (select *, case when centre - lag(centre) over (partition by table_id order by centre) > greatest({C.ROW_FLOOR}, {C.ROW_SCALE} * line_height) then 1 else 0 end as opens from measured),
text_rows as (select *, cast(sum(opens) over (partition by table_id order by centre range between unbounded preceding and current row) as integer) as "row" from flagged)"""
GUTTERS = f"""
rights as (select *, max("left" + width) over (partition by table_id, "row" order by "left", word_ord rows between unbounded preceding and 1 preceding) as rgt from text_rows),
gutters as (select table_id, "row", line_height, (rgt + "left") / 2.0 as x from rights where "left" - rgt >= greatest({C.GUTTER_FLOOR}, {C.GUTTER_SCALE} * line_height))"""
EDGES = f"""
voted as (select *, case when x - lag(x) over (partition by table_id order by x) > greatest({C.MERGE_FLOOR}, {C.MERGE_SCALE} * line_height) then 1 else 0 end as opens from gutters),
voting as (select *, sum(opens) over (partition by table_id order by x range between unbounded preceding and current row) as edge from voted),
sizes as (select table_id, max("row") + 1 as n_rows from text_rows group by table_id),
counted as (select table_id, edge, count(distinct "row") as support, median(x) as x from voting group by all),
column_edges as (select table_id, list(x order by x) as edges from counted join sizes using (table_id) where support >= greatest({C.SUPPORT_FLOOR}, ceil(n_rows * {C.SUPPORT_SHARE}::double)) group by table_id)"""
GRID = f"""
sized as (select table_id, n_rows, edges, len(edges) + 1 as n_cols from sizes join column_edges using (table_id) where n_rows >= {C.OCR_MIN_ROWS} and len(edges) + 1 >= {C.OCR_MIN_COLS}),
extents as (select table_id, "row", min("left") as low, max("left" + width) as high from text_rows group by all),
lines as (select e.table_id, e."row", n_rows, n_cols, edges, (e.table_id, e."row") not in (select (table_id, "row") from gutters) and len(list_filter(edges, lambda x: low < x and x < high)) > 0 as spans from extents e join sized using (table_id)),
placed as (select r.table_id, r."row", case when spans then 0 else len(list_filter(edges, lambda x: x < r."left" + r.width / 2.0)) end as col, r.text, r."left" as l, r.word_ord from text_rows r join lines using (table_id, "row")),
cells as (select table_id, "row", col, string_agg(text, ' ' order by l, word_ord) as cell from placed group by all),
dense as (select l.*, c.col, coalesce(x.cell, '') as cell from (select *, unnest(range(0, n_cols)) as col from lines) c join lines l using (table_id, "row") left join cells x on x.table_id = c.table_id and x."row" = c."row" and x.col = c.col),
by_row as (select table_id, "row", n_rows, n_cols, edges, spans, string_agg(cell, ' | ' order by col) as line, max(case when col = 0 then cell end) as first_cell, sum(case when not spans and trim(cell) <> '' then 1 else 0 end) as used from dense group by all),
grids as (select table_id, n_rows, cast(n_cols as integer) as n_cols, trim(string_agg(line, chr(10) order by "row"), ' ' || chr(10)) as text, trim(string_agg(case when spans then first_cell else line end, chr(10) order by "row"), ' ' || chr(9) || chr(10) || chr(13)) as body, coalesce(list("row" order by "row") filter (spans), cast([] as integer[])) as spanning_rows,
  case when count(*) filter (not spans) > 0 then sum(used) / (count(*) filter (not spans) * n_cols) else 0.0 end as fill_fraction, count(*) filter (spans) / n_rows as spanning_fraction, list_transform(edges, lambda e: round(e, 1)) as column_boundaries
  from by_row group by table_id, n_rows, n_cols, edges)"""
RAW = """raw_lines as (select table_id, "row", string_agg(text, ' ' order by "left", word_ord) as line from text_rows group by all), raw as (select table_id, string_agg(line, chr(10) order by "row") as raw_text from raw_lines group by table_id)"""
_AXES = {"ys": "(select cast(unnest(range(12)) as integer) as y)", "xs": "(select cast(unnest(range(8)) as integer) as x)"}
PIXELS = f"(select * from {X.sql_rows(X.pixels(), 'image, y, x, v')} union all select * from {X.duck_rows(X.PIXELS_OF_DOCUMENTS, documents='documents', **_AXES)})"
PIXEL_ROWS = f"""
px as (select * from {PIXELS}),
px_rows as (select image, y, avg(v) as mean, stddev_pop(v) as deviation from px group by all),
px_lines as (select *, deviation < 25 and coalesce(abs(mean - lag(mean) over (partition by image order by y)), 0) > 8 as is_line from px_rows)"""
DECIDED = f"""{ROWS},{GUTTERS},{EDGES},{GRID},
means as (select table_id, avg(conf) as mean from boxes group by table_id),
decided as (select *, case when reason is null then 'accepted' else 'refused' end as status from (select table_id, mean, n_rows, n_cols, body, case when mean is null then 'no_text' when mean < {C.OCR_CONFIDENCE} then 'low_confidence' when text is null then 'grid_not_recovered' when fill_fraction < {C.OCR_MIN_FILL} then 'sparse_grid' end as reason
  from {TABLES} t left join means using (table_id) left join grids using (table_id)))"""
#: Bodies of the chosen records' tables, as they must come out.
_BODIES = {"tbl_1": "Compound | %\nacetaminophen | 50", "tbl_4": "caption\nacetaminophen |  | HPLC"}
REPORT = f"""{DECIDED},
report as (
  select id, filename, page, status, reason, body from {X.sql_rows([(r[1], r[2], r[3], r[4], r[5], _BODIES.get(r[1])) for r in X.TABLE_REPORT], 'id, filename, page, status, reason, body')}
  union all select 'tbl_' || table_id, coalesce(source, 'none'), cast(doc_id % 1000 as integer), status, reason, case when status = 'accepted' then body end from decided join documents on table_id = 'doc' || doc_id)"""


def validated(source: str, name: str) -> str:
    """CTEs that end in ``name``: a source (predicted_smiles, error, ...) with reason, status, part, block and atoms."""
    return f"""
said as (select name, predicted_smiles as smiles from (select distinct predicted_smiles as name, predicted_smiles from {source})),{keyed('said', 'said_')},
reasoned as (select s.* , case when valid then f end as part, k.block as key_block, atoms, case when error is not null then 'recognizer_error:' || error when predicted_smiles is null then 'empty_prediction' when not valid then 'invalid_smiles' when atoms < {C.MIN_HEAVY_ATOMS} then 'too_small' end as reason
  from {source} s left join said_keyed k on k.name = s.predicted_smiles),
{name} as (select *, case when reason is null then 'accepted' else 'refused' end as status, case when reason is null then key_block end as block from reasoned)"""


STRUCTURES = f"""
predictions as (select ord, id, source_doc, page_number, nullif(trim(coalesce(smiles, '')), '') as predicted_smiles, error, confidence from (select * from {X.sql_rows(X.STRUCTURES, 'ord, id, source_doc, page_number, smiles, error, confidence')} union all select * from {X.duck_rows(X.PREDICTIONS_OF_DOCUMENTS, documents='documents')})),
{validated('predictions', 'structures')},
deduped as (select * from (select *, row_number() over (partition by source_doc, page_number, block, status order by ord) as copy from structures) where status <> 'accepted' or copy = 1)"""

#: The corpus' passages, and chosen ones with ids below 0.
NAME_TEXTS = f"texts as (select chunk_ord, text from chunks union all select cast(-id as hugeint) * {PAGE_STEP}, text from {X.sql_rows(X.NAME_TEXTS, 'id, text')})"
LARGE_LEXICON = f"(select * from {LEXICON} union all select * from {X.duck_rows(X.LEXICON_OF_DOCUMENTS, documents='documents')})"
CONVERSATION = (
    f"{INDEX},{SCOPE},{TURNS},{CONTEXTUAL}, follow_ups as (select question_id, contextual as question from contextual where {follow_up('question')} and question_id in (select question_id from history)),{structure('current', 'questions', C.CHAT_TOP_K)},{bm25('context', 'scope', 'follow_ups', C.CHAT_TOP_K)},"
    f"{interleaved('mixed', ['current_text', 'context'], 'source_doc, page_number, text', C.CHAT_TOP_K)}, turned as (select question_id, chunk_ord, score, rank from mixed union all select question_id, chunk_ord, score, rank from current where question_id not in (select question_id from mixed))"
)
WHOLE_CONVERSATION = WHOLE_INDEX + CONVERSATION.removeprefix(INDEX)


def expanded(hits: str) -> str:
    """CTEs that end in ``expanded``: the first hit of each page, with the page's prose, where a chunk goes on behind the longest end of what stands before it."""
    shared = "list_max(list_concat([0], list_filter(range(1, least(len(a), len(x)) + 1), lambda k: a[len(a) - k + 1 : len(a)] = x[1 : k])))"
    return f"""
placed as (select h.*, c.source_doc, c.page_number, c.text as anchor_text, row_number() over (partition by h.question_id, source_doc, page_number order by h.rank) as copy from {hits} h join chunks c using (chunk_ord)),
firsts as (select * from placed where copy = 1),
parts as (select source_doc, page_number, list(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') order by chunk_ord) as lists, cast(count(*) as integer) as n from chunks semi join firsts using (source_doc, page_number) where not {bibliography('text')} group by all),
merged as (select source_doc, page_number, n, list_reduce(lists, lambda a, x: list_concat(a, x[{shared} + 1 : len(x)])) as ws from parts),
expanded as (select f.* exclude (copy), case when len(ws) > 0 then array_to_string(ws, ' ') else anchor_text end as text, 'same-page expansion' as context_scope, coalesce(n, 0) as context_chunks from firsts f left join merged using (source_doc, page_number))"""


def source_blocks(hits: str, subject: bool) -> str:
    """(question_id, context) of hits, without page expansion."""
    flag = f"case when list_contains(blocks, '{BLOCK}') then ' | SUBJECT: yes' else ' | SUBJECT: NO - different molecule' end" if subject else "''"
    return (
        "select question_id, string_agg('[Source ' || rank || '] ' || source_doc || ' | page ' || page_number || ' | route: structure | compounds: ' || case when len(compounds) > 0 then array_to_string(compounds, ', ') else 'none' end || "
        f"{flag} || ' | context: matched chunk' || chr(10) || text, chr(10) || chr(10) order by rank) as context from {hits} join annotated using (chunk_ord) group by question_id"
    )


TABLE_LEXICON = f"(select * from {LEXICON} union all select 'acetaminophen', {V(X.SUBJECT)})"
#: Facts by RE2, which can't look around: blanks are doubled, so that what parts two rows is there for both.
_PAIRED = r"[0-9]+\.[0-9]+" + r"(?:\s+[0-9]+\.[0-9]+\s*±\s*[0-9]+\.[0-9]+)" * 4
FACTS = f"""
fact_pages as (select * from (select cast(rank + 1000000000 as bigint) as rank, source_doc, page_number, text from {X.sql_rows([(1, 'other.pdf', C.FACT_PAGE, X.fact_page()), (2, C.FACT_DOCUMENT, C.FACT_PAGE, X.fact_page()), (3, C.FACT_DOCUMENT, C.FACT_PAGE, X.fact_page())], 'rank, source_doc, page_number, text')}
  union all select * from {X.duck_rows(X.facts_in_documents(), documents='documents')})
  where source_doc = {V(C.FACT_DOCUMENT)} and page_number = {C.FACT_PAGE} and {' and '.join(f'contains(text, {V(t)})' for t in C.FACT_TOKENS)} and regexp_matches(text, {V(C.FACT_TEMPERATURES)})),
headed as (select rank, source_doc, page_number, regexp_extract_all(text, {V(C.FACT_HEADER)}) as heads, string_split_regex(text, {V(C.FACT_HEADER)}) as cuts from fact_pages),
sections as (select rank, source_doc, page_number, i, regexp_extract(heads[i], {V(C.FACT_HEADER)}, 1) as symbol, regexp_extract(heads[i], {V(C.FACT_HEADER)}, 2) as solvent,
  list_transform(regexp_extract_all(regexp_replace(cuts[i + 1], '(\\s)', '\\1\\1', 'g'), '(?:^|[^0-9.])({_PAIRED})(?:$|[^0-9.])', 1), lambda l: list_transform(regexp_extract_all(l, '[0-9]+\\.[0-9]+'), lambda v: cast(v as double))) as figures
  from (select *, unnest(range(1, len(heads) + 1)) as i from headed)),
whole as (select * from sections where symbol = 'A' and list_transform(figures, lambda f: f[1]) = case when solvent = 'DMSO' then {list(map(float, C.FACT_STEPS))} else {list(map(float, C.FACT_STEPS[1:]))} end),
chosen as (select * from (select *, row_number() over (partition by solvent order by rank, i) as copy from whole) where copy = 1),
facts as (select solvent, 'Paracetamol · ' || solvent || ' + water' as title, cast(rank as integer) as source, source_doc, cast(page_number as bigint) as page, cast(r - 1 as integer) as row_ord, figures[r][1] as organic_fraction,
  cast(25 + 5 * t as integer) as "temperature_C", figures[r][2 + 2 * t] as solubility_x100, figures[r][3 + 2 * t] as uncertainty_x100, figures[r][2 + 2 * t] - figures[r][3 + 2 * t] as lower, figures[r][2 + 2 * t] + figures[r][3 + 2 * t] as upper
  from (select *, unnest(range(1, len(figures) + 1)) as r from chosen) cross join (select unnest(range(4)) as t))"""
def said(n: str) -> str:
    """What the simple recogniser answers for n bytes."""
    return f"case {n} % 6 when 0 then 'CCO' when 1 then 'CC(=O)Nc1ccc(O)cc1' when 2 then 'no structure' when 3 then '' when 4 then 'O' end"


def sure(n: str) -> str:
    return f"case {n} % 6 when 1 then 0.5::double when 2 then cast({n} as double) end"


HIT_COLUMNS = f"question_id, rank, {PLACE}, score"
_FILES = f"(select * from {X.sql_rows([(f,) for f in X.FILES], 'filename')} union all select * from {X.duck_rows(X.FILENAMES, documents='documents')})"
_ANSWERS = f"(select cast(answer_id as bigint) as answer_id, raw from {X.sql_rows(X.ANSWERS, 'answer_id, raw')} union all select * from {X.duck_rows(X.ANSWERS_OF_TURNS, conversations='conversations')})"
_FOLLOWUP_TAIL = "trim(split_part(substr(raw, instr(raw, '<followups>') + 11), '</followups>', 1), ' ' || chr(10))"

ORACLE: dict[str, str] = {
    "bm25_topk": f"with recursive {CHUNKS},{bm25('best', 'chunks', ONE, 10)} select {HIT_COLUMNS}, source_doc, page_number, 'text' as route, text from best join chunks using (chunk_ord)",
    "bm25_stored": f"with recursive {CHUNKS},{bm25('best', 'chunks', ONE, 10)} select {HIT_COLUMNS} from best",
    "stored_postings": f"with recursive {CHUNKS} select term, count(distinct chunk_ord) as n_chunks, count(*) as n_tokens from (select chunk_ord, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from chunks) group by term",
    "bm25_batch": f"with recursive {CHUNKS},{bm25('best', 'chunks', '(select item_id as question_id, text as question from benchmark)', C.TOP_K)} select {HIT_COLUMNS} from best",
    "chunk_windows": f"with recursive {CHUNKS} select source_doc, page_number, chunk_idx, text from chunks",
    "chunk_token_stats": f"with recursive {CHUNKS} select {PLACE}, cast(len(ts) as integer) as n_tokens, cast(len(list_distinct(ts)) as integer) as n_distinct from (select chunk_ord, regexp_extract_all(lower(text), '[a-z0-9]+') as ts from chunks)",
    "repair_hyphen_literal": f"select cast(id as bigint) as id, regexp_replace(translate(text, '‐‑‒–', '----'), '([\\p{{L}}\\p{{N}}_])-[ \\t\\x{{a0}}]*\\n[ \\t\\x{{a0}}]*([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g') as repaired from (select * from {X.sql_rows(X.HYPHEN_TEXTS, 'id, text')} union all select * from {X.duck_rows(X.PARTED_TEXTS, documents='documents')})",
    "query_terms_benchmark": f"select item_id as question_id, {terms('text')} as terms from benchmark",
    "bibliography_flag": f"with recursive {CHUNKS} select page_ord, chunk_idx, {bibliography('text')} as is_bibliography from (select cast(-id as bigint) as page_ord, 0 as chunk_idx, text from {X.sql_rows(X.REFERENCE_TEXTS, 'id, text')} union all select {PLACE}, text from chunks)",
    "candidate_suffix": f"with recursive {CHUNKS},{candidates(X.RULES.suffixes, LEXICON)} select {PLACE}, name from lexical",
    "candidate_literal": f"with recursive {CHUNKS},{NAME_TEXTS},{candidates(C.SUFFIXES, X.sql_rows([(v,) for v in X.VOCABULARY], 'name'), 'texts')} select {PLACE}, name from candidates",
    "morpheme_count_literal": f"with recursive {CHUNKS},{NAME_TEXTS}, words as (select distinct unnest({names_of('text')}) as word from texts union select unnest(['acetaminophen', 'phenacetin', 'hydrochlorothiazide', 'paper'])) select word, {morphemes('word')} as n_morphemes from words",
    "candidate_bigram_join": f"with recursive {CHUNKS},{candidates(X.RULES.suffixes, LEXICON)} select {PLACE}, name from joined",
    "candidate_hyphen_part": f"with recursive {chunks_of(X.duck_rows(X.HYPHENATED, documents='documents'))},{candidates(X.RULES.suffixes, X.sql_rows([*[(n,) for n, _ in X.LEXICON], ('the',), ('er',), ('de',)], 'name'))} select {PLACE}, name from hyphen",
    "candidate_acid_literal": f"with recursive {CHUNKS},{NAME_TEXTS},{candidates(C.SUFFIXES, LEXICON, 'texts')} select {PLACE}, name from acid",
    "name_frequency_topn": f"with recursive {CHUNKS},{candidates(X.RULES.suffixes, LEXICON)} select name, count(*) as frequency from candidates group by name order by frequency desc, name limit 100",
    "resolve_tiers": f"with recursive {CHUNKS}, wanted as (select distinct lower(trim(name)) as name from (select * from {X.sql_rows([(n,) for n in ('THBLE ', 'ontion', 'retion', 'thing', 'nothing known', 'erble')], 'name')} union all select unnest(ws) from page_words)),{RESOLVE} select name, smiles, tier from resolved",
    "unresolved_names": f"with recursive {CHUNKS},{candidates(X.RULES.suffixes, LEXICON)}, top as (select name, count(*) as n from candidates group by name order by n desc, name limit {X.MAX_CANDIDATES}) select name from top where name not in (select name from {LEXICON}) and name not in (select name from {CACHE})",
    "surrogate_key": f"with recursive {written(LARGE_LEXICON)} select name, block, cast(atoms as integer) as heavy_atoms from keyed",
    "name_cache_snapshots": f"with recursive {CHUNKS},{candidates(X.RULES.suffixes, LEXICON)}, wanted as (select distinct name from candidates),{RESOLVE} select name, smiles from {CACHE} union all select name, smiles from resolved where name not in (select name from {CACHE})",
    "structure_key": f"with recursive words as (select distinct word from (select unnest(regexp_extract_all(text, '[^\\s\u00a0]+')) as word from documents) where regexp_matches(word, '^[a-z]{{3,4}}$')), given as (select * from {X.sql_rows([(n, s) for n, w in X.SPELLINGS for s in w], 'name, smiles')} union all select * from {X.duck_rows(X.STRUCTURES_OF_WORDS, words='words')}), {graphs('given').lstrip()} "
    "select name, count(*) as n_spellings, count(*) filter (valid) as n_valid, count(distinct block) as n_blocks, min(block) as block, cast(max(atoms) as integer) as heavy_atoms from given join graph using (smiles) group by name",
    "structure_bonds": f"with recursive {graphs(LARGE_LEXICON).lstrip()} select smiles, cast(least(a, b) as integer) as a, cast(greatest(a, b) as integer) as b, cast(o as integer) as bond_order from bonds where sound",
    "verified_lexicon": f"with recursive seed as (select * from {LARGE_LEXICON} union all select 'nothing', null), {keyed('seed').lstrip()} select r.name, r.smiles, case when valid then k.f end as canonical, k.block, cast(case when valid then len(regexp_extract_all(r.smiles, {ATOM})) end as integer) as heavy_atoms, coalesce(valid, false) as accepted from seed r left join keyed k using (name)",
    "chunk_annotation": f"with recursive {INDEX} select {PLACE}, compounds, blocks from annotated",
    "synonym_groups": f"with recursive {INDEX} select block, list_sort(list(name)) as names from compounds group by block having count(*) > 1",
    "spellings_for_block": f"with recursive {INDEX} select name from compounds where block = '{BLOCK}'",
    "structure_filter": f"with recursive {WHOLE_INDEX},{SCOPE} select {PLACE}, source_doc, page_number from scope",
    "structure_search": f"with recursive {INDEX},{SCOPE},{structure('found', ONE, 6)} select {HIT_COLUMNS}, 'structure' as route from found",
    "structure_fallback": f"with recursive {INDEX},{SCOPE}, asked as (select cast(question_id as bigint) as question_id, question from {X.sql_rows([(0, ''), (1, 'zzzz qqqq'), (2, None)], 'question_id, question')}),{structure('found', 'asked', 6)} select {HIT_COLUMNS}, 'structure' as route from found",
    "scoped_documents_search": f"with recursive {WHOLE_INDEX}, scope as (select * from annotated where list_contains(blocks, '{BLOCK}') and source_doc in ({', '.join(map(V, Q.DOCUMENTS))})),{structure('found', ONE, 6)} select {HIT_COLUMNS} from found",
    "hybrid_interleave": f"with recursive {INDEX},{SCOPE},{structure('found', ONE, 8)},{bm25('best', 'annotated', ONE, 8)},{interleaved('mixed', ['found', 'best'], 'source_doc, page_number, left(text, 60)', 8)} select {HIT_COLUMNS}, case route_no when 0 then 'structure' else 'text' end as route from mixed",
    "route_comparison": f"with recursive {INDEX},{SCOPE},{structure('found', ONE, 5)},{bm25('best', 'annotated', ONE, 5)} select {HIT_COLUMNS}, 'structure' as route from found union all select {HIT_COLUMNS}, 'text' from best",
    "checked_retrieval": f"with recursive {INDEX},{SCOPE},{structure('found', ONE, 5)} select {HIT_COLUMNS}, true as on_structure from found",
    "follow_up_flag": f"select conv_id, turn, {follow_up('text')} as is_follow_up from conversations where role = 'user'",
    "retrieval_query": f"with recursive {TURNS},{CONTEXTUAL} select question_id, contextual from contextual",
    "conversation_hits": f"with recursive {CONVERSATION} select {HIT_COLUMNS} from turned",
    "conversation_search": f"with recursive {CONVERSATION},{expanded('turned')} select question_id, rank, score, source_doc, page_number, text, anchor_text, context_scope, context_chunks from expanded",
    "page_expansion": f"with recursive {INDEX},{SCOPE},{structure('found', ONE, 8)},{expanded('found')} select rank, source_doc, page_number, text, anchor_text, context_scope, context_chunks from expanded",
    "documents_for_structure": f"with recursive {INDEX},{SCOPE}, found as (select source_doc, list_sort(list_distinct(list(e.name))) as names from scope s join entities e using (chunk_ord) where e.block = '{BLOCK}' group by source_doc) select distinct source_doc, coalesce(names, cast([] as varchar[])) as names from scope left join found using (source_doc)",
    "exact_name_counts": f"with recursive {INDEX},{QUERY_NAMES},{NAME_HITS} select name, count(chunk_ord) as n_chunks, regexp_matches(name, {V(C.REGISTRY_NUMBER)}) as is_registry_number from names left join hits using (name) group by name",
    "reach_report": f"with recursive {INDEX},{QUERY_NAMES},{NAME_HITS}, flags as (select list_contains(blocks, '{BLOCK}') as s, chunk_ord in (select chunk_ord from hits) as u from annotated), counts as (select name, count(chunk_ord) as n from names left join hits using (name) group by name), best as (select name, n from counts order by n desc, name limit 1) "
    "select count(*) filter (s) as n_structure, count(*) filter (u) as n_union, count(*) filter (s and not u) as adds, count(*) filter (u and not s) as misses, (select count(*) from counts) as n_names, (select name from best) as best_name, (select n from best) as best_count from flags",
    "reach_unreachable": f"with recursive {INDEX}, names as (select distinct name from compounds where block = '{BLOCK}'),{NAME_HITS}, alone as (select chunk_ord, text from annotated where list_contains(blocks, '{BLOCK}') and chunk_ord not in (select chunk_ord from hits)), "
    "tried as (select chunk_ord, text, name, regexp_extract(text, '(?i)' || array_to_string(regexp_extract_all(name, '.'), '[\\s\\-]?')) as fragment from alone cross join names), first as (select chunk_ord, text, arg_min(fragment, name) as fragment from tried where fragment <> '' group by all) "
    f"select {PLACE}, fragment, case when fragment is null then left(a.text, 240) else substr(a.text, greatest(1, strpos(a.text, fragment) - 90), strpos(a.text, fragment) + length(fragment) + 90 - greatest(1, strpos(a.text, fragment) - 90)) end as snippet from alone a left join first using (chunk_ord)",
    "set_difference": f"with recursive {WHOLE_INDEX}, names as (select 'thble' as name),{NAME_HITS}, flags as (select list_contains(blocks, '{BLOCK}') as s, chunk_ord in (select chunk_ord from hits) as u from annotated) select count(*) filter (s and not u) as recovered, count(*) filter (s and u) as shared, count(*) filter (u and not s) as text_only from flags",
    "library_stats": f"with recursive {CHUNKS} select source_doc, count(*) as n_passages, count(distinct page_number) as n_pages from chunks group by source_doc",
    "index_totals": f"with recursive {WHOLE_INDEX} select (select count(*) from annotated) as n_chunks, (select count(*) from annotated where len(blocks) > 0) as n_annotated, (select count(*) from annotated where {bibliography('text')}) as n_bibliography, (select count(*) from compounds) as n_names, (select count(distinct block) from compounds) as n_blocks",
    "build_context": f"with recursive {INDEX},{SCOPE},{structure('found', ONE, 3)} {source_blocks('found', True)}",
    "split_follow_ups": f"with a as (select *, instr(raw, '<followups>') > 0 as tagged from {_ANSWERS}), t as (select *, case when tagged then {_FOLLOWUP_TAIL} end as tail from a), lists as (select answer_id, tail from t where json_valid(tail) and json_type(tail) = 'ARRAY'), "
    f"items as (select answer_id, i, json_extract(tail, '$[' || i || ']') as j from (select *, unnest(range(0, cast(json_array_length(tail) as bigint))) as i from lists)), texts as (select answer_id, i, trim(j ->> '$') as q from items where json_type(j) = 'VARCHAR'), kept as (select answer_id, q, min(i) as i from texts where length(q) between 1 and {C.FOLLOW_UP_CHARACTERS} group by all), "
    f"firsts as (select answer_id, list(q order by i)[1:{C.FOLLOW_UPS}] as followups from kept group by answer_id) select answer_id, case when tagged then trim(split_part(raw, '<followups>', 1), ' ' || chr(10)) else raw end as body, coalesce(followups, cast([] as varchar[])) as followups from t left join firsts using (answer_id)",
    "plot_intent": f"select conv_id, turn, regexp_matches(text, {V(C.PLOT_INTENT)}) as is_plot_request from (select conv_id, turn, text from conversations union all select cast(conv_id as bigint), cast(turn as bigint), text from {X.sql_rows([(-1, 0, 'Please plot it'), (-2, 0, 'a Chart, now'), (-3, 0, 'charting'), (-4, 0, 'visualise this')], 'conv_id, turn, text')})",
    "chat_messages": f"with recursive {WHOLE_CONVERSATION}, past as (select question_id, list(role order by turn) as rs, list(text order by turn) as cs from (select * from (select *, row_number() over (partition by question_id order by turn desc) as age from history) where age <= {C.HISTORY_TURNS}) group by question_id), contexts as ({source_blocks('turned', False)}) "
    "select question_id, case when context is not null then list_concat(['system'], coalesce(rs, []), ['user']) end as roles, case when context is not null then list_concat(['system text'], coalesce(cs, []), ['Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || question || chr(10)]) end as contents from questions left join past using (question_id) left join contexts using (question_id)",
    "evidence_export": f"with recursive {WHOLE_INDEX},{SCOPE},{structure('found', ONE, 3)} select question_id, to_json({{'query': {V(X.QUESTION)}, 'smiles': {V(X.SUBJECT)}, 'block': '{BLOCK}', 'sources': list({{'source_doc': source_doc, 'page_number': page_number, 'text': text, 'compounds': compounds, 'blocks': blocks, 'score': score, 'route': 'structure'}} order by rank)}})::varchar as json from found join annotated using (chunk_ord) group by question_id",
    "previews": "select doc_id, case when length(text) > 240 then left(text, 240) || '…' else text end as preview from documents",
    "paper_ids": f"with f as (select filename, regexp_replace(regexp_extract(filename, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') as stem from {_FILES}) select filename, case when contains(stem, '_') and split_part(stem, '_', 1) <> '' then split_part(stem, '_', 1) when stem <> '' then stem else filename end as paper_id from f",
    "thin_rule": f"select filename, page, image_index, {THIN} as thin, not {THIN} as needs_pixels from {IMAGES}",
    "pixel_rows": f"with recursive {PIXEL_ROWS} select image, y, round(mean, 6) as mean, round(deviation, 6) as deviation, is_line from px_lines",
    "pixel_features": f"with recursive {PIXEL_ROWS}, fr as (select image, avg(case when v < 200 then 1.0 else 0 end) as ink, avg(case when v > 240 then 1.0 else 0 end) as white, count(*) as n from px group by image), en as (select image, 0 - sum(c / n * log2(c / n)) as entropy from (select image, least(v * 16 // 256, 15) as bin, count(*) as c from px group by all) join fr using (image) group by image), "
    "gp as (select image, count(*) as lines, avg(gap) as mean_gap, stddev_pop(gap) as dev from (select image, y - lag(y) over (partition by image order by y) as gap from px_lines where is_line) group by image), hs as (select image, count(*) as height, count(*) filter (is_line) as n_hlines from px_lines group by image) "
    "select image, round(ink, 6) as ink_frac, round(white, 6) as white_frac, round(entropy, 6) as entropy, round(n_hlines / height, 6) as hline_frac, n_hlines, coalesce(lines >= 4 and dev < greatest(2.0, 0.35 * mean_gap), false) as grid from fr join en using (image) join hs using (image) left join gp using (image)",
    "image_classify": f"with recursive {CLASSIFIED} select filename, page, image_index, label, reasons from classified",
    "inventory_pivot": f"with recursive {CLASSIFIED} select filename, {', '.join(f'count(*) filter (label = {V(x)}) as {x}' for x in C.IMAGE_LABELS)}, count(*) as total from classified group by filename",
    "inventory_rollup": f"with recursive {CLASSIFIED} select filename, label, count(*) as n_images from classified group by rollup (filename, label)",
    "inventory_summary": f"with recursive {CLASSIFIED}, papers as (select split_part(filename, '_', 1) as k0, regexp_replace(filename, '\\.pdf$', '') as stem from classified), named as (select case when contains(stem, '_') and k0 <> '' then k0 else stem end as k from papers), by_paper as (select k, count(*) as n from named group by k), by_class as (select label as k, count(*) as n from classified group by label) "
    "select (select count(*) from classified) as total_images, (select '{' || string_agg('\"' || k || '\":' || n, ',' order by k) || '}' from by_paper) as counts_by_paper, (select '{' || string_agg('\"' || k || '\":' || n, ',' order by k) || '}' from by_class) as counts_by_class",
    "ocr_skip_reason": f"with recursive {CLASSIFIED} select filename, page, image_index, case when label is distinct from 'table_image' then 'not_table_image' when {THIN} then 'thin_table_rule' when width < {C.OCR_MIN_WIDTH} or height < {C.OCR_MIN_HEIGHT} then 'not_table_like' end as skip_reason from (select filename, page, image_index, label, coalesce(width, 0) as width, coalesce(height, 0) as height from (select filename, page, image_index, label, width, height from classified union all select 'chosen ' || id, 0, 0, label, width, height from {X.sql_rows([(i, *r) for i, r in enumerate(X.TABLE_IMAGES)], 'id, label, width, height')}))",
    "ocr_words": f"select * from (values ('t', 0, 'a', 90.0::double, 1, 1, 1, 1), ('t', 5, 'e', 91.0::double, 6, 6, 6, 6)) v(table_id, word_ord, text, conf, \"left\", top, width, height) union all "
    f"select 'doc' || doc_id, cast(word_ord as integer), text, cast(word_ord % 97 - 1 as double), case when word_ord % 29 <> 0 then cast(word_ord as integer) end, cast(2 * word_ord as integer), cast(length(text) as integer), 12 from {_WORDS} where word_ord % 5 <> 0 and word_ord % 97 > 0 and word_ord % 11 <> 0",
    "ocr_rows": f"with recursive {ROWS} select table_id, word_ord, \"row\" from text_rows",
    "ocr_raw_text": f"with recursive {ROWS}, {RAW} select table_id, raw_text from raw",
    "ocr_gutters": f"with recursive {ROWS},{GUTTERS} select table_id, \"row\", x from gutters",
    "ocr_boundaries": f"with recursive {ROWS},{GUTTERS},{EDGES} select table_id, edges from column_edges",
    "ocr_grid": f"with recursive {ROWS},{GUTTERS},{EDGES},{GRID} select * exclude (body) from grids",
    "ocr_decision": f"with recursive {DECIDED} select table_id, status, reason, round(mean, 6) as mean_confidence, case when reason is null then n_rows end as n_rows, case when reason is null then n_cols end as n_cols from decided",
    "ocr_summary": f"with recursive {REPORT} select status, reason, cast(grouping(status) + grouping(reason) as integer) as level, count(*) as n_tables from report group by grouping sets ((status, reason), (status), ())",
    "table_text": f"with recursive {REPORT} select id, body as text from report where body is not null",
    "attach_tables": f"with recursive {WHOLE_INDEX},{REPORT}, bodies as (select id as chunk_ord, body as text, filename, page from report where status = 'accepted'),{candidates(C.SUFFIXES, TABLE_LEXICON, 'bodies', 'b_')}, first_names as (select chunk_ord, name from b_candidates), "
    f"b_wanted as (select distinct name from first_names where name not in (select name from compounds)),{resolve('b_wanted', TABLE_LEXICON, 'b_').replace(CACHE, '(select null::varchar as name, null::varchar as smiles where false)')},{keyed('b_resolved', 'b_')}, every as (select name, block from compounds union all select name, block from b_keyed where block is not null), "
    "marks as (select chunk_ord, list_sort(list_distinct(list(name))) as compounds, list_sort(list_distinct(list(block))) as blocks from first_names join every using (name) group by chunk_ord) "
    f"select filename as source_doc, cast(page as bigint) as page_number, {V(C.TABLE_PASSAGE)} || text as text, coalesce(compounds, []) as compounds, coalesce(blocks, []) as blocks, chunk_ord as table_ocr_id from bodies left join marks using (chunk_ord)",
    "ocsr_candidates": f"with recursive {CLASSIFIED} select filename, page, image_index from classified where label in ({', '.join(map(V, C.STRUCTURE_LABELS))}) and not {THIN}",
    "ocsr_validate": f"with recursive {STRUCTURES} select id, status, reason, predicted_smiles, case when reason is null then part end as smiles, block, case when reason is null then cast(atoms as integer) end as heavy_atoms, cast(confidence as double) as confidence from structures",
    "ocsr_dedupe": f"with recursive {STRUCTURES} select id, status from deduped",
    "ocsr_summary": f"with recursive {STRUCTURES} select count(*) as crops, count(*) filter (status = 'accepted') as accepted, count(*) filter (status = 'refused') as refused, (select '{{' || string_agg('\"' || reason || '\":' || n, ',' order by reason) || '}}' from (select reason, count(*) as n from deduped where status = 'refused' group by reason)) as refused_by_reason from deduped",
    "structures_for_block": f"with recursive {STRUCTURES} select id, source_doc, page_number from structures where status = 'accepted' and block = '{BLOCK}'",
    "attach_structures": f"with recursive {CHUNKS},{STRUCTURES}, both_kinds as (select 'page' as method, source_doc from chunks union all select 'structure_ocr', source_doc from deduped where status = 'accepted') select method, count(*) as n_chunks, count(distinct source_doc) as n_documents from both_kinds group by method",
    "solubility_rows": f"with recursive {FACTS} select * from facts",
    "chart_series": f"with recursive {FACTS} select solvent, cast(\"temperature_C\" as double) as series, list(solubility_x100 order by organic_fraction) as figures from facts group by all",
    "file_pages": "select '/in/' || doc_id || '.pdf' as path, doc_id || '.pdf' as source_doc, cast(n as integer) as page_number, lines[n] as text from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as n from (select doc_id, string_split(text, chr(10)) as lines from documents))",
    "merged_name_cache": f"with recursive {CHUNKS},{candidates(X.RULES.suffixes, LEXICON)}, top as (select name, count(*) as n from candidates group by name order by n desc, name limit {X.MAX_CANDIDATES}) select name, smiles from {CACHE} union all "
    f"select name, case when length(name) % 3 <> 0 then repeat('C', length(name)) end as smiles from top where name not in (select name from {LEXICON}) and name not in (select name from {CACHE})",
    "recognised_answers": f"select cast(doc_id as varchar) as crop_id, {said('n')} as predicted_smiles, {sure('n')} as confidence, case when n % 6 = 5 then 'RuntimeError' end as error from (select doc_id, strlen(text) as n from documents)",
    "structure_run": f"""with recursive {CLASSIFIED},
tried as (select filename, page, image_index, strlen(filename || '|' || page || '|' || image_index) as n from classified where label in ({', '.join(map(V, C.STRUCTURE_LABELS))}) and not {THIN}),
crops as (select filename, page, image_index, cast(c as integer) as crop_index, n + c as n, false as failed from (select *, unnest(range(1 + n % 2)) as c from tried where n % 7 <> 0) union all select filename, page, image_index, 0, n, true from tried where n % 7 = 0),
answers as (select *, 'ocsr_' || left(sha1(concat_ws('|', filename, page, 'embedded', image_index, crop_index)), 14) as id, case when not failed then nullif({said('n')}, '') end as predicted_smiles, case when failed then 'ValueError' when n % 6 = 5 then 'RuntimeError' end as error from crops),
{validated('answers', 'keys')}
select id, filename as source_doc, page as page_number, image_index as source_index, crop_index, status, reason, predicted_smiles, case when reason is null then part end as smiles, block
from (select *, row_number() over (partition by filename, page, block, status order by image_index, crop_index) as copy from keys) where status <> 'accepted' or copy = 1""",
    "table_run": f"""with recursive {CLASSIFIED},{DECIDED},
own as (select c.*, 'tbl_' || left(sha1(concat_ws('|', filename, page, image_index)), 14) as image_id, case when filename not in ('A_first.pdf', 'B_second.pdf', 'notes.pdf') then 'doc' || (page + 1000 * image_index) end as table_id,
  case when {THIN} then 'thin_table_rule' when coalesce(width, 0) < {C.OCR_MIN_WIDTH} or coalesce(height, 0) < {C.OCR_MIN_HEIGHT} then 'not_table_like' end as skipped from classified c where label = 'table_image')
select image_id as table_id, filename, page, image_index, case when skipped is not null then 'skipped' else coalesce(status, 'refused') end as status, coalesce(skipped, case when status is null then 'no_text' else reason end) as reason, round(mean, 6) as mean_confidence,
  case when status = 'accepted' then n_rows end as n_rows, case when status = 'accepted' then n_cols end as n_cols from own left join decided using (table_id)""",
    "stable_ids": "select doc_id, 'tbl_' || left(sha1(concat_ws('|', source, doc_id, 0)), 14) as table_id, 'ocsr_' || left(sha1(concat_ws('|', source, doc_id, 'embedded', 1, 'None')), 14) as structure_id from documents",
}
