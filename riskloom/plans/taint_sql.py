"""The SQL form of user input followed through files: a fold over the lines of each file, again for each round of names that carry input."""

from __future__ import annotations

from ..functions import taint_patterns as T
from ..functions.code_patterns import SOURCES
from ..sources.derived import quoted

#: Rounds of the fold. A name that would carry input only after so many hops between files shows as a difference.
ROUNDS = 4


def _by_ending(patterns: dict[str, str], value: str) -> str:
    return "case ext " + " ".join(f"when {quoted(end)} then {value.replace('@P@', quoted(p))}" for end, p in patterns.items()) + " end"


def _inside(text: str) -> str:
    """What stands before the parenthesis that closes one opened before the text, or all of it."""
    shut = f"list_filter(range(1, len({text}) + 1), lambda j: len(replace(left({text}, j), '(', '')) - len(replace(left({text}, j), ')', '')) = 1)[1]"
    return f"left({text}, coalesce({shut} - 1, len({text})))"


_DEPTH = "(len(regexp_replace(left(q, j), '[>)\\]]', '', 'g')) - len(regexp_replace(left(q, j), '[<(\\[]', '', 'g')))"
_WORDS = "list_filter(regexp_split_to_array(string_split(regexp_replace(p, '\\[[^\\]]*\\]', ' ', 'g'), '=')[1], '\\s+'), lambda x: x <> '')"
_FEATURES = f"""tf as materialized (select path, line_no, line, row_number() over (partition by path order by line_no) - 1 as i, regexp_extract(path, '\\.[A-Za-z0-9]+$') as ext from code_lines),
f1 as (select *, coalesce({_by_ending(T.BOUNDARY, 'regexp_matches(line, @P@)')}, false) as boundary, {_by_ending(T.DEFINITION, 'case when regexp_matches(line, @P@) then regexp_extract(line, @P@, 1) end')} as def_name, {_by_ending(T.DEFINITION, 'case when regexp_matches(line, @P@) then regexp_extract(line, @P@, 2) end')} as def_param,
  case when ext = '.cs' and regexp_matches(line, {quoted(T.CS_NAME)}) then regexp_extract(line, {quoted(T.CS_NAME)}, 1) end as cs_name, ext = '.cs' and regexp_matches(line, {quoted(T.CS_ACTION)}) as is_action, ext = '.cs' and regexp_matches(line, {quoted(T.CS_METHOD)}) as is_method,
  regexp_matches(line, {quoted(SOURCES)}) as direct, list_distinct(regexp_extract_all(line, '[A-Za-z0-9_$]+')) as toks, case when regexp_matches(line, {quoted(T.ASSIGN)}) then regexp_extract(line, {quoted(T.ASSIGN)}, 1) end as an, regexp_extract(line, {quoted(T.ASSIGN)}, 2) as av,
  regexp_split_to_array(line, {quoted(T.CALL)}) as pieces, regexp_extract_all(line, {quoted(T.CALL)}, 0) as cm, regexp_extract_all(line, {quoted(T.CALL)}, 1) as cn,
  case when strpos(line, '(') > 0 and contains(line, ')') then substr(line, strpos(line, '(') + 1) else '' end as opened from tf),
f2 as (select *, list_distinct(regexp_extract_all(av, '[A-Za-z0-9_$]+')) as vtoks, regexp_matches(av, {quoted(SOURCES)}) as vdirect, regexp_matches(av, {quoted(T.TYPED)}) as typed, regexp_matches(av, {quoted(T.ENCODED)}) as encoded,
  list_transform(range(1, len(cm) + 1), lambda k: substr(line, 1 + list_sum(list_transform(pieces[1:k], lambda x: len(x)))::bigint + list_sum(list_transform(cm[1:k], lambda x: len(x)))::bigint)) as rests, {_inside('opened')} as q from f1),
f3 as (select *, list_transform(rests, lambda r: {_inside('r')}) as inner_texts, string_split(array_to_string(list_transform(range(1, len(q) + 1), lambda j: case when q[j] = ',' and {_DEPTH} = 0 then chr(1) else q[j] end), ''), chr(1)) as listed from f2),
feat as materialized (select path, i, line_no, ext, boundary, def_name, def_param, cs_name, is_action, is_method, direct, toks, an, vtoks, vdirect, typed, encoded, line,
  list_transform(range(1, len(cn) + 1), lambda k: {{'n': cn[k], 'd': regexp_matches(inner_texts[k], {quoted(SOURCES)}), 't': regexp_extract_all(inner_texts[k], '[A-Za-z0-9_$]+')}}) as calls,
  list_distinct(list_filter(list_transform(listed, lambda p: case when len({_WORDS}) > 1 and regexp_full_match(ltrim({_WORDS}[-1], '@'), '[A-Za-z0-9_$]+') then regexp_replace({_WORDS}[-1], '^@', '') end), lambda x: x is not null)) as params from f3),
defs as (select path, def_name as name from feat where def_name is not null union select path, cs_name from feat where cs_name is not null),
uniq as materialized (select name, min(path) as path from defs group by name having count(*) = 1 and name not in ({', '.join(map(quoted, T.KEYWORDS))})),
seeds as (select distinct regexp_extract(line, {quoted(T.SEED_CALL)}, 1) as name from code_lines where regexp_matches(line, {quoted(T.SEED_CALL)})),
reading as materialized (select distinct path from feat where direct or is_action),
names_0 as materialized (select name, path from uniq where name in (select name from seeds))"""


def _fold(k: int) -> str:
    put = lambda e, names: f"list_concat(list_filter({e}, lambda x: not list_contains({names}, x.n)), list_transform({names}, lambda p: {{'n': p, 'l': (i + 1)::int}}))"
    return f"""fold_{k} as (
  select p.path, 0 as i, []::struct(n varchar, l int)[] as e, []::varchar[] as s, -100 as act, []::varchar[] as called, false as tainted, false as safe, 0 as origin, coalesce(c.names, []) as names
  from (select path from reading union select path from names_{k}) p left join (select path, list(name) as names from names_{k} group by path) c on c.path = p.path
  union all
  select path, (i + 1)::int, e4, s4, act1, list_distinct(list_concat(called, list_filter(list_transform(calls, lambda c: case when c.n not in ({', '.join(map(quoted, T.KEYWORDS))}) and (c.d or len(list_filter(e4, lambda x: list_contains(c.t, x.n))) > 0) then c.n end), lambda x: x is not null))),
    len(ents) > 0, len(heldl) > 0 and not direct and len(list_filter(heldl, lambda x: not list_contains(s0, x.n))) = 0, coalesce(list_min(ents), 0)::int, names from (
    select *, case when not touched then e2 when typed then list_filter(e2, lambda x: x.n <> an) else list_concat(list_filter(e2, lambda x: x.n <> an), [{{'n': an, 'l': case when vdirect or len(known) = 0 then i + 1 else list_min(known) end::int}}]) end as e4,
      case when not touched then s0 when typed or not encoded then list_filter(s0, lambda x: x <> an) else list_distinct(list_append(s0, an)) end as s4 from (
      select *, list_concat(list_transform(heldl, lambda x: x.l), case when direct then [(i + 1)::int] else [] end) as ents, an is not null and (len(hv) > 0 or vdirect) as touched, list_transform(list_filter(hv, lambda x: x.n <> an), lambda x: x.l) as known from (
        select *, list_filter(e2, lambda x: list_contains(toks, x.n)) as heldl, list_filter(e2, lambda x: list_contains(vtoks, x.n)) as hv from (
          select *, case when is_method and i - act1 <= {T.ACTION_LINES} then list_concat(e1, list_transform(list_filter(params, lambda p: not list_contains(list_transform(e1, lambda x: x.n), p)), lambda p: {{'n': p, 'l': (i + 1)::int}})) else e1 end as e2 from (
            select *, case when boundary and list_contains(names, cs_name) then {put('ed', 'params')} else ed end as e1 from (
              select f.path, f.called, f.names, l.* exclude (path), case when boundary and list_contains(names, def_name) then [{{'n': def_param, 'l': (l.i + 1)::int}}] when boundary then [] else f.e end as ed, case when boundary then [] else f.s end as s0, case when is_action then l.i::int else f.act end as act1
              from fold_{k} f join feat l on l.path = f.path and l.i = f.i)))))))"""


def _rounds() -> str:
    out = []
    for k in range(ROUNDS):
        out.append(_fold(k))
        if k < ROUNDS - 1:
            out.append(f"names_{k + 1} as materialized (select name, path from names_{k} union select u.name, u.path from uniq u where u.name in (select unnest(called) from fold_{k}))")
    return ",\n".join(out)


#: reached(path, line_no, tainted, html_safe, origin), over code_lines; within a `with recursive`.
REACHED = f"""{_FEATURES}, {_rounds()},
reached as materialized (select f.path, l.line_no, f.tainted, f.safe as html_safe, case when origin > 0 then o.line_no else 0 end as origin from fold_{ROUNDS - 1} f join feat l on l.path = f.path and l.i = f.i - 1 left join feat o on o.path = f.path and o.i = f.origin - 1)"""
