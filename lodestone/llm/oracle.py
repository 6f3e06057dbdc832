"""DuckDB SQL of the queries and of the pipeline, by plain joins over whole tables.

Each statement is a function of the name of its documents table, so that the pipeline's stages can be put behind each other.
"""

from __future__ import annotations

from lodestone.llm import licenses, manifest, personal_data, prefix_trie, secrets, topk
from lodestone.llm.decontaminate import SHARE, SPAN
from lodestone.llm.mixing import MOST, SETTLED, WEIGHTS
from lodestone.llm.mixing import SHARE as MIXED_SHARE
from lodestone.llm.near_dedup import PERCENT, SHINGLE_WORDS
from lodestone.llm.quality_rules import Limits
from lodestone.llm.sharding import LAW, RING_BITS, SHARDS, VIRTUAL_NODES
from lodestone.llm.substring_dedup import LENGTH

_LOWERED = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ALNUM = f"regexp_extract_all({_LOWERED.format('text')}, '{_WORD}')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _digits(text: str, n: int) -> str:
    """The first n hexadecimal digits of a digest, as a number."""
    return f"cast('0x' || left(md5({text}), {n}) as bigint)"


def near_dedup(documents: str = "documents", percent: int = PERCENT) -> str:
    return f"""
with recursive words as (select doc_id, {_SPACED.format(_LOWERED.format('text'))} as ws from {documents}),
shingles as (
  select distinct doc_id, case when len(ws) < {SHINGLE_WORDS} then array_to_string(ws, ' ') else array_to_string(ws[i : i + {SHINGLE_WORDS - 1}], ' ') end as s
  from (select *, unnest(range(1, greatest(len(ws) - {SHINGLE_WORDS - 1}, 1) + 1)) as i from words where len(ws) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as common from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * common >= {percent} * (x.n + y.n - common)),
reach(a, b) as (select doc_id, doc_id from {documents} union select r.a, l.b from reach r join links l on l.a = r.b),
smallest as (select a as doc_id, min(b) as component_id from reach group by a)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept from {documents} d left join sizes using (doc_id) join smallest using (doc_id)"""


def decontaminate(documents: str = "documents") -> str:
    return f"""
with items as (select cast(item_id as varchar) as item, {_ALNUM} as ws from benchmark where item_id is not null),
item_windows as (select distinct item, n, array_to_string(ws[i : i + n - 1], ' ') as w from (select *, least({SPAN}, len(ws)) as n, unnest(range(1, len(ws) - least({SPAN}, len(ws)) + 2)) as i from items where len(ws) > 0)),
lengths as (select distinct n from item_windows),
docs as (select doc_id, {_ALNUM} as ws from {documents}),
hits as (select doc_id, i, n, w from (select doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') as w from (select *, unnest(range(1, greatest(len(ws) - n + 2, 1))) as i from docs cross join lengths)) where (n, w) in (select (n, w) from item_windows)),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
held as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from hits join item_windows using (n, w)) group by doc_id)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and {SHARE} * coalesce(n_hit, 0) >= len(ws) as contaminated
from docs left join covered using (doc_id) left join held using (doc_id)"""


_L = Limits()


def _quality(documents: str) -> str:
    """CTEs that end in ``counted``, and ``lines`` and ``frequent``, which the removal of lines needs too."""
    return rf"""
texts as (select doc_id, coalesce(source, chr(0)) as host, coalesce(text, '') as t from {documents}),
docs as (select *, {_SPACED.format('t')} as ws, list_filter(string_split(t, chr(10)), lambda x: trim(x, {_BLANKS}) <> '') as ls from texts),
windows as (select doc_id, i, array_to_string(ws[i : i + 2], ' ') as w from (select *, unnest(range(1, greatest(len(ws) - 1, 1))) as i from docs)),
twice as (select doc_id, i from windows join (select doc_id, w from windows group by all having count(*) > 1) using (doc_id, w)),
repeats as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from twice) group by doc_id),
lines as (select doc_id, host, t, l, place, regexp_replace(regexp_replace(lower(trim(l, {_BLANKS})), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g') as line, len({_SPACED.format('l')}) as n
  from (select doc_id, host, t, unnest(string_split(t, chr(10))) as l, unnest(range(len(string_split(t, chr(10))))) as place from texts)),
spoken as (select * from lines where n > 0),
hosts as (select host, count(distinct t) as documents from docs group by host),
frequent as (select host, line from (select host, line, count(distinct t) as c from spoken group by all) join hosts using (host) where c > {_L.line_documents} and c > {_L.line_share} * documents),
removed as (select doc_id, cast(sum(n) as bigint) as n from spoken join frequent using (host, line) group by doc_id),
counted as (
  select d.doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
    coalesce(r.n, 0) as n_repeat_words, coalesce(m.n, 0) as n_removed_words
  from docs d left join repeats r using (doc_id) left join removed m using (doc_id)),
judged as (select *, n_words < {_L.min_words} or 100 * n_repeat_words > {_L.repeat_percent} * n_words as base_failed,
  not (n_words < {_L.min_words} or 100 * n_repeat_words > {_L.repeat_percent} * n_words) and n_removed_words <= {_L.removed_share} * n_words as kept from counted)"""


def quality_rules(documents: str = "documents") -> str:
    return f"with {_quality(documents)} select * from judged"


def kept_texts(documents: str) -> str:
    """The documents that the quality rules keep, without their frequent lines."""
    return f"""
with {_quality(documents)},
stays as (select doc_id, string_agg(l, chr(10) order by place) as t from lines where (host, line) not in (select (host, line) from frequent) group by doc_id),
changed as (select d.doc_id, case when n_removed_words = 0 then text else coalesce(t, '') end as new, n_removed_words from {documents} d join judged using (doc_id) left join stays using (doc_id) where kept)
select d.* replace (new as text, case when n_removed_words = 0 then n_chars else length(new) end as n_chars) from {documents} d join changed using (doc_id)"""


def suffix_dedup(documents: str = "documents") -> str:
    """Each byte as two hexadecimal digits, so that stretches of bytes are stretches of text."""
    return f"""
with docs as (select doc_id, hex(encode(coalesce(text, ''))) as t, strlen(coalesce(text, '')) as n from {documents}),
stretches as (select doc_id, i, substr(t, 2 * i + 1, {2 * LENGTH}) as s from (select *, unnest(range(0, greatest(n - {LENGTH - 1}, 0))) as i from docs)),
ranked as (select doc_id, i, row_number() over (partition by s order by doc_id, i) as r from stretches),
starts as (select doc_id, i, i - lag(i) over (partition by doc_id order by i) as gap from ranked where r > 1),
islands as (select *, sum(case when gap <= {LENGTH} then 0 else 1 end) over (partition by doc_id order by i) as island from starts),
spans as (select doc_id, min(i) as a, max(i) + {LENGTH} as b from islands group by doc_id, island),
gaps as (
  select doc_id, b as a, lead(a, 1, n) over (partition by doc_id order by a) as b from spans join docs using (doc_id)
  union all select doc_id, 0, min(a) from spans group by doc_id union all select doc_id, 0, n from docs where doc_id not in (select doc_id from spans)),
kept as (select doc_id, string_agg(substr(t, 2 * a + 1, 2 * (b - a)), '' order by a) as k from gaps join docs using (doc_id) group by doc_id)
select doc_id, n as n_bytes, coalesce(gone, 0) as n_removed, coalesce(c, 0) as n_spans, sha256(unhex(k)) as kept_sha256
from docs join kept using (doc_id) left join (select doc_id, cast(sum(b - a) as bigint) as gone, count(*) as c from spans group by doc_id) using (doc_id)"""


#: The table of CRC-32, as a single row.
_CRCS = "crcs as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as k)"


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes, beside the row of ``_CRCS``."""
    return f"xor(list_reduce(regexp_extract_all(hex(encode({text})), '..').list_transform(lambda x: cast('0x' || x as bigint)), lambda c, b: xor(c >> 8, k[xor(c, b) % 256 + 1]), 4294967295), 4294967295)"


def _shards(documents: str, columns: str) -> str:
    """The ring, the counts between its nodes, and the runs of ring order that shards take, one node after the other."""
    return f"""
with recursive nodes as (select s, {_digits("s || '/' || v", RING_BITS // 4)} as pos from (select unnest(range({SHARDS})) as s) cross join (select unnest(range({VIRTUAL_NODES})) as v)),
ring as (select list(s order by pos, s) as owner, list(pos order by pos, s) as spots from nodes),
{_CRCS},
held as (select d.*, coalesce({_digits('cast(doc_id as varchar)', RING_BITS // 4)}, {_digits("'text:' || coalesce(text, '')", RING_BITS // 4)}) as pos, strlen(coalesce(text, '')) + 1 as size,
  {_crc32("coalesce(text, '')")} as crc from {documents} d cross join crcs),
arcs as (select len(list_filter(spots, lambda x: x < pos)) as arc from held cross join ring),
counts as (select list_transform(range({SHARDS * VIRTUAL_NODES + 1}), lambda a: coalesce(m[a], 0)) as n, (select count(*) from held) as total from (select map_from_entries(list((arc, c))) as m from (select arc, count(*) as c from arcs group by arc))),
walk as (
  select 0 as arc, 0 as node, n[1] as n, list_transform(range({SHARDS}), lambda s: total // {SHARDS} + case when s < total % {SHARDS} then 1 else 0 end) as free, list_transform(range({SHARDS}), lambda s: cast(0 as bigint)) as used,
    cast(0 as bigint) as done, cast(null as bigint) as shard, cast(0 as bigint) as took, cast(0 as bigint) as slot from counts
  union all
  select case when left_over = 0 then arc + 1 else arc end, case when left_over = 0 then arc + 1 else node + 1 end, case when left_over = 0 then ns[arc + 2] else left_over end,
    list_transform(free, lambda f, i: case when i - 1 = s then f - take else f end), list_transform(used, lambda u, i: case when i - 1 = s then u + take else u end), done + take, s, take, used[s + 1]
  from (select *, least(w.n, free[s + 1]) as take, w.n - least(w.n, free[s + 1]) as left_over from (select walk.*, counts.n as ns, owner[node % {SHARDS * VIRTUAL_NODES} + 1] as s from walk cross join ring cross join counts where arc <= {SHARDS * VIRTUAL_NODES}) w)),
runs as (select done - took as first, done as stop, shard, slot from walk where took > 0),
ranked as (select *, row_number() over (order by pos, doc_id, crc, size) - 1 as rank from held)
select {columns} from ranked r join runs on rank >= first and rank < stop"""


def shards(documents: str = "documents") -> str:
    return _shards(documents, f"doc_id, cast(size as bigint) as size, cast(crc as bigint) as text_crc32, '{LAW}' as law, cast(shard as integer) as shard, slot + rank - first as slot, cast(null as integer) as grown_shard")


def licenses_found() -> str:
    """Places of phrases, and the least edits with which each notice occurs, tried around its pieces."""
    chosen = [licenses.notice(*n) for n in licenses.NOTICES]
    phrases = ", ".join(f"({_quoted(p)}, {len(p.split())}, {_quoted(label)})" for p, label in licenses.PHRASES)
    pieces = ", ".join(f"({i}, {_quoted(n.text)}, {_quoted(n.label)}, {n.edits}, {_quoted(piece)}, {offset})" for i, n in enumerate(chosen) for piece, offset in n.pieces())
    return f"""
with docs as (select doc_id, {_ALNUM} as ws, translate({_LOWERED.format('text')}, {_BLANKS}, '      ') as t from documents),
phrases as (select * from (values {phrases}) v(phrase, size, label)),
placed as (select doc_id, i - 1 as word, label from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from docs) join phrases on ws[i] = split_part(phrase, ' ', 1) where array_to_string(ws[i : i + size - 1], ' ') = phrase),
base as (select doc_id, count(*) as n, min(word) as low, max(word) as high, string_agg(distinct label, ',' order by label) as names from placed group by doc_id),
pieces as (select * from (values {pieces}) v(id, notice, label, edits, piece, off)),
cut as (select doc_id, t, p.*, string_split(t, piece) as parts from docs join pieces p on contains(t, piece)),
found as (select doc_id, t, id, notice, label, edits, list_sum(list_transform(parts[1 : i], lambda x: length(x))) + (i - 1) * length(piece) - off as start from (select *, unnest(range(1, len(parts))) as i from cut)),
near as (select distinct doc_id, id, label, edits, notice, substr(t, cast(greatest(a, 0) + 1 as bigint), cast(n + least(a, 0) as bigint)) as s
  from (select *, start + unnest(range(-edits, edits + 1)) as a from found) cross join (select unnest(range({min(len(n.text) - n.edits for n in chosen)}, {max(len(n.text) + n.edits for n in chosen) + 1})) as n)
  where n between length(notice) - edits and length(notice) + edits and n + least(a, 0) > 0),
best as (select doc_id, id, label, min(levenshtein(s, notice)) as e, any_value(length(notice)) as n from near group by doc_id, id, label, edits having min(levenshtein(s, notice)) <= edits),
by_doc as (select doc_id, list(distinct label) as names, max(1 - e / n) as score, min(e) as least_edits from best group by doc_id)
select doc_id, len(ws) as n_words, coalesce(b.n, 0) as n_base, b.low as first_word, b.high as last_word, coalesce(b.names, '') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(f.names, []), case when b.names is null then [] else string_split(b.names, ',') end))), ',') as labels,
  case when b.n > 0 then 1.0 else coalesce(f.score, 0.0) end as score, f.least_edits
from docs left join base b using (doc_id) left join by_doc f using (doc_id)"""


def _positioned(kind: str, rank: int, pattern: str, accepts: str, source: str = "docs") -> str:
    """Matches m of a pattern in t, with their places from the stretches between them."""
    return f"""select doc_id, c, {rank} as rank, '{kind}' as kind, start, start + length(m) as stop, m from (
  select doc_id, c, ms[i] as m, cast(list_sum(list_transform(gs[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1 : i - 1], lambda x: length(x))), 0) as bigint) as start
  from (select doc_id, c, ms, gs, unnest(range(1, len(ms) + 1)) as i from (select doc_id, c, regexp_extract_all(t, '{pattern}') as ms, string_split_regex(t, '{pattern}') as gs from {source}))) where {accepts}"""


def private_terms() -> str:
    """Identifiers by pattern, terms by their mutual information with identifiers over distinct texts."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(list_reverse(string_split({digits}, '')), lambda d, i: case when i % 2 = 1 then cast(d as integer) when cast(d as integer) > 4 then 2 * cast(d as integer) - 9 else 2 * cast(d as integer) end)) % 10 = 0"
    base = " union all ".join((
        _positioned("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        _positioned("ip", 1, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 or coalesce(try_cast(p as bigint), 256) > 255)) = 0"),
        _positioned("card", 2, r"[0-9](?:[\x20-]?[0-9])+", f"length({digits}) between 14 and 19 and {luhn}"),
        _positioned("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) between 10 and 15"),
    ))
    disclosed, chance = personal_data.DISCLOSES, personal_data.CHANCE

    def entropy(share: str, by: str) -> str:
        def part(a: str, b: str) -> str:
            return f"case when {a} > 0 then ({a}) * ln(({a}) / ({b})) else 0 end"

        return f"({part(share, by)} + {part(f'1 - {share}', f'1 - {by}')})"

    return f"""
with docs as (select doc_id, md5(coalesce(text, '')) as c, coalesce(text, '') as t from documents),
firsts as (select min(doc_id) as doc_id, c, any_value(t) as t from docs group by c),
own as (select c, doc_id from firsts),
bases as ({base}),
lowered as (select f.doc_id, f.c, {_LOWERED.format('f.t')} as t from firsts f),
words as (select c, start, stop, m as word from ({_positioned('word', 0, _WORD, 'true', 'lowered')})),
marks as (select b.c, kind, start, stop, {_LOWERED.format('m')} as m from bases b join own using (c, doc_id)),
inside as (select distinct w.c, w.start from words w join marks b on w.c = b.c and b.start < w.stop and b.stop > w.start),
free as (select * from words anti join inside using (c, start)),
total as (select cast(count(*) as double) as n from firsts),
texts as (select word, cast(count(distinct c) as double) as t from words group by word),
identified as (select distinct c, kind || ':' || m as identifier from marks),
terms as (select distinct c, word from free semi join identified using (c)),
entities as (select identifier, cast(count(*) as double) as e from identified group by identifier),
classes as (select j, cast(count(*) as double) as alike, count(*) over () as n_classes from (select length(bin(cast(t as bigint))) - 1 as j from texts) group by j),
pairs as (select identifier, word, cast(count(*) as double) as c from identified join terms using (c) group by all),
weighed as (select *, ln(n / e) / ln(2) as own_bits, ln(c * n / (e * t)) / ln(2) as bits from pairs join entities using (identifier) join texts using (word) cross join total join classes on j = length(bin(cast(t as bigint))) - 1),
disclosing as (select distinct word from weighed where own_bits > 0 and t <= pow(n, 1 - {disclosed}) * pow(e, {disclosed}) * 1.001 and bits >= {disclosed} * own_bits
  and greatest(e * {entropy('(c / e)', '(t / n)')}, t * {entropy('(c / t)', '(e / n)')}) >= ln(alike * n_classes / {chance})),
spans as (select c, {len(personal_data.BASE)} as rank, '{personal_data.TERM}' as kind, start, stop from free semi join disclosing using (word) union all select b.c, rank, kind, start, stop from bases b join own using (c, doc_id)),
shown as (select c, {', '.join(f"count(*) filter (kind = '{k}') as n_{k}" for k in personal_data.BASE)}, count(*) filter (rank < {len(personal_data.BASE)}) as n_base, count(*) as n_spans,
  string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank, stop) filter (rank < {len(personal_data.BASE)}) as base, string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank, stop) as spans from spans group by c)
select d.doc_id, {', '.join(f"coalesce({k}, 0) as {k}" for k in (*(f"n_{k}" for k in personal_data.BASE), "n_base", "n_spans"))}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from docs d left join shown using (c)"""


def _mixed(documents: str) -> str:
    """CTEs that end in ``copies`` (doc_id, size, source_size, target, copies): targets by raising the level, tilts by bisection, rounding as the operator rounds."""

    def unit(salt: int) -> str:
        return f"{_digits(f'''concat_ws(':', '{salt}', coalesce(cast(doc_id as varchar), 'null'), t, cast(number as varchar))''', 12)} / 281474976710656.0"

    weights = f"[{', '.join(map(str, WEIGHTS))}]"
    return f"""
sized as (select doc_id, case when source is null then 'b' else 'a' || source end as k, cast(len({_SPACED.format("coalesce(text, '')")}) as bigint) as size, row_number() over () as row, md5(coalesce(text, '')) as t, row_number() over (partition by doc_id, source, md5(coalesce(text, ''))) - 1 as number from {documents}),
sources as (select k, cast(sum(size) as bigint) as source_size, count(*) as n, {weights}[(row_number() over (order by encode(k)) - 1) % {len(WEIGHTS)} + 1] as w from sized group by k),
levels as (
  select 0 as step, 0.0::double as level union all
  select step + 1, (select (sum(source_size) * {MIXED_SHARE} - coalesce(sum(case when source_size * {float(MOST)} < level * w then source_size * {float(MOST)} end), 0)) / sum(case when source_size * {float(MOST)} < level * w then 0 else w end) from sources)
  from levels where step < (select count(*) from sources) + 1),
goals as (select k, source_size, n, source_size / cast(n as double) as mean, least(source_size * {float(MOST)}, (select max(level) from levels) * w)::double as target from sources),
histogram as (select k, size, count(*) as m, size / any_value(mean) as x from sized join goals using (k) group by k, size),
bounded as (select k, target from goals where target < source_size * {float(MOST)} * (1 - 1e-12) and mean > 0),
bisected as (
  select 0 as step, k, target, -4096.0::double as low, 4096.0::double as high from bounded union all
  select step + 1, k, any_value(target), case when sum(size * m * exp(least((low + high) / 2 * x, ln({MOST}.0)))) <= any_value(target) then any_value(low + high) / 2 else any_value(low) end,
    case when sum(size * m * exp(least((low + high) / 2 * x, ln({MOST}.0)))) <= any_value(target) then any_value(high) else any_value(low + high) / 2 end
  from bisected join histogram using (k) where step < 120 group by step, k),
tilts as (select k, (low + high) / 2 as tilt from bisected where step = 120),
rated as (select s.*, source_size, n, goals.target, case when size = 0 then 0.0 when mean > 0 and b.k is null then {float(MOST)} else exp(least(coalesce(tilt, 0) * size / mean, ln({MOST}.0))) end as rate, {unit(2)} * n < {SETTLED} as settles
  from sized s join goals using (k) left join bounded b using (k) left join tilts using (k)),
hashed as (select *, case when size = 0 then 0 else floor(rate) + case when {unit(1)} < rate - floor(rate) then 1 else 0 end end as copies from rated where not settles),
used as (select k, sum(copies * size) as used from hashed group by k),
settling as (select *, row_number() over (partition by k order by size desc, {unit(3)}, doc_id) as i, target - coalesce(used, 0) as due, sum(rate * size) over (partition by k) as planned from rated left join used using (k) where settles),
scaled as (select *, least({MOST}, greatest(0, rate * case when planned > 0 then due / planned else 0 end)) * size as part from settling),
settled as (
  select k, cast(0 as bigint) as i, cast(null as bigint) as row, 0.0::double as goal, 0.0::double as taken, 0.0::double as copies from goals union all
  select k, i, row, goal, before + size * copies, copies from (select *, case when size > 0 then least({MOST}, greatest(0, floor((goal - before) / size + 0.5))) else 0 end as copies from (select s.k, s.i, s.row, s.size, t.goal + s.part as goal, t.taken as before from settled t join scaled s on s.k = t.k and s.i = t.i + 1))),
copies as (select r.row, doc_id, size, source_size, target, cast(coalesce(h.copies, t.copies) as bigint) as copies from rated r left join (select row, copies from hashed) h using (row) left join (select row, copies from settled where row is not null) t using (row))"""


def mixed(documents: str = "documents") -> str:
    return f"with recursive {_mixed(documents)} select doc_id, size, source_size, target, copies * size as taken from copies"


def pipeline(percent: int) -> str:
    """The five stages behind each other; each works on the table that the one before it gives."""
    clean = f"select d.* from deduplicated d join ({decontaminate('deduplicated')}) using (doc_id) where not contaminated"
    taken = f"with recursive {_mixed('clean')} select d.*, unnest(range(copies)) as copy from clean d join copies using (doc_id)"
    placed = _shards("repeated", "r.* exclude (pos, size, crc, rank), cast(shard as integer) as shard, slot + rank - first as slot")
    return f"""
with good as materialized ({kept_texts('documents')}),
deduplicated as materialized (select d.* from good d join ({near_dedup('good', percent)}) using (doc_id) where kept),
clean as materialized ({clean}),
repeated as materialized (select * exclude (copy) from ({taken})),
placed as materialized ({placed})
select * from placed"""


def top_k(embeddings: str = "embeddings") -> str:
    """Inner products of all pairs of a query row and another row."""
    return f"""
with rows as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * cast(x as double))) as x from {embeddings} where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (select q.r, q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.x, c.x) as bigint) as score from rows q join rows c on c.r <> q.r where q.vec_id % {topk.EVERY} = 0)
select query_id, cast(rank as integer) as rank, vec_id, score from (select *, row_number() over (partition by r order by score desc, vec_id nulls last) as rank from scores) where rank <= {topk.K}"""


def merkle_manifest(documents: str = "documents") -> str:
    """Every level of every tree from the one below, then a look at each level for each row."""

    def leaf(changed: str) -> str:
        shown = [changed if f == "n_chars" else f for f in manifest.FIELDS]
        return "sha256(" + " || ".join(f"coalesce(strlen(cast({f} as varchar)) || ':' || cast({f} as varchar), '-')" for f in shown) + ")"

    def above(nodes: str, group: str) -> str:
        return f"select {group}, level + 1, idx // 2, sha256(string_agg(h, '' order by idx)), (n + 1) // 2 from {nodes} where n > 1 group by {group}, level, idx // 2, n"

    def step(level: str, idx: str, found: str) -> str:
        return f"struct_pack(o := {level}, s := case when {found} is null then 'N' when ({idx} >> {level.split(' ')[-1]}) % 2 = 1 then 'L' || {found} else 'R' || {found} end)"

    return f"""
with recursive {_CRCS},
docs as (select doc_id, coalesce('=' || lang, '') as g, {leaf('n_chars')} as leaf, {leaf('(n_chars + case when hit then 1 else 0 end)')} as tampered from (select *, coalesce({_crc32('cast(doc_id as varchar)')} % 7 = 0, false) as hit from {documents} cross join crcs)),
leaves as (select *, row_number() over () as r, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by g) as n from docs),
nodes(g, level, idx, h, n) as (select g, 0, idx, leaf, n from leaves union all {above('nodes', 'g')}),
groups as (select g, h, row_number() over (order by g) - 1 as idx, count(*) over () as n from nodes where n = 1),
tops(g, level, idx, h, n) as (select 0, 0, idx, h, n from groups union all {above('tops', 'g')}),
asked as (
  select r, {step('l.level', 'leaves.idx', 'x.h')} as step from leaves join (select distinct g, level from nodes where n > 1) l using (g) left join nodes x on x.g = leaves.g and x.level = l.level and x.idx = xor(leaves.idx >> l.level, 1)
  union all select r, struct_pack(o := 1000 + l.level, s := {step('l.level', 'groups.idx', 'x.h')}.s) from leaves join groups on groups.g = leaves.g cross join (select distinct level from tops where n > 1) l left join tops x on x.level = l.level and x.idx = xor(groups.idx >> l.level, 1)),
proofs as (select r, list(step.s order by step.o) as steps from asked group by r),
held as (select leaves.*, coalesce(steps, []) as steps, groups.h as subroot, (select h from tops where n = 1) as root from leaves join groups using (g) left join proofs using (r)),
folds as (select *, list_reduce(steps, lambda a, s: sha256(case when s[1] = 'L' then s[2:] || a when s[1] = 'R' then a || s[2:] else a end), tampered) as folded_root from held)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) as proof_sha256, folded_root, folded_root = root as verified from folds"""


def prefix_trie_nodes(conversations: str = "conversations") -> str:
    """Rebuilt conversations, their prefixes, and all pairs of a prefix and one that begins with it."""
    what = "sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))"
    return f"""
with recursive {_CRCS},
turns as (select conv_id as c, {what} as what, strlen(coalesce(text, '')) as b, row_number() over (partition by conv_id order by turn nulls first, {what}) as i from {conversations} where conv_id is not null),
convs as (select c, c - c % {prefix_trie.FAMILY} as base, {_crc32('cast(c as varchar)')} % {prefix_trie.HEADS} as h from (select distinct c from turns) cross join crcs),
rebuilt as (select c, what, b, row_number() over (partition by c order by own, i) as d from (
  select v.c, what, b, i, 0 as own from convs v join turns t on t.c = v.base and t.i <= v.h union all select v.c, what, b, i, 1 from convs v join turns t on t.c = v.c and t.i > v.h)),
paths(c, d, p, above, b) as (
  select c, cast(0 as bigint), '', cast(null as varchar), cast(0 as bigint) from convs union all
  select r.c, r.d, sha256(p || r.what), p, cast(r.b as bigint) from paths join rebuilt r on r.c = paths.c and r.d = paths.d + 1),
nodes as (select p, any_value(d) as depth, any_value(above) as above, min(c) as conv_id, count(*) as n, any_value(b) as b from paths group by p),
children as (select above as p, count(*) as n_children from nodes where above is not null group by above),
beneath as (select distinct a.p, x.p as below from paths a join paths x on x.c = a.c and x.d >= a.d),
sums as (select s.p, count(*) filter (n_children is null) as n_leaves, cast(sum((n - 1) * b) as bigint) as saved_tokens from beneath s join nodes x on x.p = s.below left join children y on y.p = s.below group by s.p),
ends as (select p, sha256(string_agg(cast(c as varchar), ',' order by c)) as ends from (select *, max(d) over (partition by c) as last from paths) where d = last group by p)
select x.conv_id, depth, u.conv_id as parent_conv_id, x.n as n_convs, coalesce(n_children, 0) as n_children, n_leaves, saved_tokens, coalesce(ends, sha256('')) as ends_sha256
from nodes x join sums using (p) left join children using (p) left join ends using (p) left join (select p as above, conv_id from nodes) u on u.above = x.above"""


ORACLE_SQL = {
    "op1_near_dedup": near_dedup(), "op3_secret_scan": secrets.oracle_sql(), "op4_consistent_hash_shards": shards(), "op5_decontaminate": decontaminate(), "op6_license_notices": licenses_found(),
    "op7_quality_rules": quality_rules(), "op8_suffix_dedup": suffix_dedup(), "op9_private_terms": private_terms(), "op10_mix_sources": mixed(),
    "op11_top_k": top_k(), "op12_merkle_manifest": merkle_manifest(), "op13_prefix_trie": prefix_trie_nodes(),
}
