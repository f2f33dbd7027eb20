"""Reference SQL for the registered queries, written for DuckDB.

The SQL does not share the engine's method: it tokenises texts with
`regexp_extract_all`, numbers tokens with windows, expands them to lines and
judges lines with `bool_or`; docstrings are found by a recursive walk over
lines.
"""

from __future__ import annotations

import re

from linescope.catalog import views
from linescope.operators.languages import FILE_NAMES, LANGUAGES, SHEBANGS
from linescope.operators.policy import LOCKFILES, RULES

BLANK = r"\t\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def quoted(text: str | None) -> str:
    return "null" if text is None else "'" + text.replace("'", "''") + "'"


def _row(*values) -> str:
    return "(" + ", ".join(v if isinstance(v, str) else str(v).lower() for v in values) + ")"


def _strings(quotes: str, closed: bool) -> list[str]:
    stop = "" if closed else r"|\z"
    found = []
    if "v" in quotes:
        found.append(rf'@"[^"]*(?:""[^"]*)*(?:"{stop})')
    if "t" in quotes:
        found += [rf"{q}[\s\S]*?(?:{q}{stop})" for q in ('"""', "'''")]
    escaped_end = "" if closed else r"|\\?\z"
    for kind, q in (("q", "'"), ("d", '"')):
        if kind in quotes:
            found.append(rf"{q}[^{q}\\]*(?:\\[\s\S][^{q}\\]*)*(?:{q}{escaped_end})")
    return found


def _lexer() -> str:
    rows = []
    for lang in LANGUAGES:
        line, block, quotes = lang.lexicon
        parts = _strings(quotes, closed=False)
        if block:
            parts.append(rf"{re.escape(block[0])}[\s\S]*?(?:{re.escape(block[1])}|\z)")
        parts += [rf"{re.escape(p)}[^\n]*" for p in line]
        token = "|".join([*parts, r"\n", rf"[{BLANK}]+", "[0-9A-Za-z_]+", r"[\s\S]"])
        starts = [re.escape(s) for s in (['@"'] if "v" in quotes else [])
                  + (['"""', "'''"] if "t" in quotes else [])
                  + (["'"] if "q" in quotes else []) + (['"'] if "d" in quotes else [])]
        rows.append(
            _row(
                quoted(lang.name),
                quoted(token),
                quoted("|".join(starts) or r"[^\s\S]"),
                quoted(re.escape(block[0]) if block else r"[^\s\S]"),
                quoted("|".join(re.escape(p) for p in line) or r"[^\s\S]"),
                quoted("|".join(_strings(quotes, closed=True)) or r"[^\s\S]"),
                quoted(rf"{re.escape(block[0])}[\s\S]*?{re.escape(block[1])}" if block else r"[^\s\S]"),
            )
        )
    columns = "language, token, string_start, block_start, line_start, string_closed, block_closed"
    return f"select * from (values {', '.join(rows)}) v({columns})"


def classified(texts: str) -> str:
    """CTEs over `texts(id, language, text)`: `lines(id, line_no, category)`
    and `flags(id, unclosed_block, unclosed_string)`."""
    blank_line = rf"^[{BLANK}]*$"
    return f"""
texts as materialized (select id, language, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as text
  from ({texts}) t),
all_lines as materialized (
  select id, language, unnest(parts) as line, generate_subscripts(parts, 1) as n
  from (select id, language, case when text = '' then []::varchar[] else
          string_split(case when text like '%' || chr(10) then left(text, length(text) - 1) else text end, chr(10)) end
          as parts from texts) s),
py as materialized (
  select id, n, line, trim(line, chr(32) || chr(9) || chr(11) || chr(12)) as bare,
    length(line) - length(ltrim(line, chr(32) || chr(9) || chr(11) || chr(12))) as indent
  from all_lines where language = 'Python'),
walk as (
  select id, 0 as n, null::varchar as active, null::bigint as pending, false as seen, false as doc
  from (select distinct id from py) p
  union all
  select id, n, next_active, case when doc then null when header then indent
      when bare = '' or bare[1] = '#' or active is not null then pending when indent > pending then null
      when bare[1] = '@' then pending end,
    seen or (active is null and bare <> '' and bare[1] <> '#'), doc
  from (select *, active is not null or opens as doc,
      active is null and not opens and regexp_matches(bare, '^(?:(?:async )?def |class )') and right(bare, 1) = ':' as header,
      case when active is not null then case when contains(bare, active) then null else active end
        when opens and (length(bare) - length(replace(bare, delim, ''))) / 3 < 2 then delim end as next_active
    from (select w.id, p.n, p.bare, p.indent, w.active, w.pending, w.seen,
        regexp_extract(p.bare, '^[rRuUbBfF]*("{{3}}|''{{3}})', 1) as delim,
        w.active is null and bare <> '' and regexp_matches(p.bare, '^[rRuUbBfF]*("{{3}}|''{{3}})')
          and (not w.seen or coalesce(p.indent > w.pending, false)) as opens
      from walk w join py p on p.id = w.id and p.n = w.n + 1) a) b),
docs as materialized (select id, n from walk where doc),
kept as materialized (
  select l.id, l.language, l.n, row_number() over (partition by l.id order by l.n) as k, l.line
  from all_lines l left join docs d on d.id = l.id and d.n = l.n where d.id is null),
bodies as (
  select id, any_value(language) as language, string_agg(line || chr(10), '' order by n) as body from kept group by id),
lexer as ({_lexer()}),
tokens as materialized (
  select b.id, unnest(toks) as tok, generate_subscripts(toks, 1) as i, string_start, block_start, line_start,
    string_closed, block_closed
  from (select b.id, regexp_extract_all(b.body, x.token) as toks, x.* exclude (language)
        from bodies b join lexer x using (language)) b),
kinds as materialized (
  select id, i, tok,
    case when regexp_matches(tok, '^(?:' || string_start || ')') then 'S'
         when regexp_matches(tok, '^(?:' || block_start || ')') then 'B'
         when regexp_matches(tok, '^(?:' || line_start || ')') then 'L'
         when tok = chr(10) then 'N' when regexp_matches(tok, '{blank_line}') then 'W' else 'C' end as kind,
    string_closed, block_closed,
    coalesce(sum(length(tok) - length(replace(tok, chr(10), ''))) over (
      partition by id order by i rows between unbounded preceding and 1 preceding), 0) as before
  from tokens),
pieces as (
  select id, kind, before + generate_subscripts(parts, 1) as k, unnest(parts) as piece
  from (select *, string_split(tok, chr(10)) as parts from kinds where kind in ('S', 'B', 'L', 'C')) s),
facts as (
  select id, k, bool_or(kind = 'C' or (kind = 'S' and piece <> '')) as code, bool_or(kind = 'L') as single,
    bool_or(kind = 'B') as multi
  from pieces group by id, k),
lines as materialized (
  select id, n as line_no, case when code and single then 'mixed_code_single_comment_lines'
    when code and multi then 'mixed_code_multi_comment_lines' when code then 'code_only_lines'
    when single then 'single_comment_only_lines' when multi then 'multi_comment_only_lines'
    else 'blank_only_lines' end as category
  from kept left join facts using (id, k)
  union all select id, n, 'docstring_comment_lines' from docs),
flags as (
  select t.id,
    coalesce(bool_or(kind = 'B' and not regexp_full_match(tok, block_closed)), false) as unclosed_block,
    coalesce(bool_or(kind = 'S' and not regexp_full_match(tok, string_closed)), false) as unclosed_string
  from texts t left join kinds k on k.id = t.id and kind in ('B', 'S') group by t.id)"""


def raw_columns() -> str:
    names = [
        "blank_only_lines", "code_only_lines", "single_comment_only_lines", "multi_comment_only_lines",
        "mixed_code_single_comment_lines", "mixed_code_multi_comment_lines", "docstring_comment_lines",
    ]
    counted = ", ".join(f"count(*) filter (category = '{name}') as {name}" for name in names)
    return f"count(line_no) as total_physical_lines, {counted}, 0 as skipped_unknown_lines"


def effective(policy: str, docstrings_as_comments: bool = True) -> str:
    mixed = "mixed_code_single_comment_lines + mixed_code_multi_comment_lines"
    docs = "docstring_comment_lines"
    code = "code_only_lines" + ("" if docstrings_as_comments else f" + {docs}")
    comment = "single_comment_only_lines + multi_comment_only_lines" + (f" + {docs}" if docstrings_as_comments else "")
    return f"""{code} + case when {policy} in ('code_only', 'code_and_comment') then {mixed} else 0 end as code_lines,
  {comment} + case when {policy} in ('comment_only', 'code_and_comment') then {mixed} else 0 end as comment_lines,
  blank_only_lines as blank_lines,
  case when {policy} = 'separate_mixed_category' then {mixed} else 0 end as mixed_lines_separate"""


def _list(names) -> str:
    return ", ".join(quoted(name) for name in names)


def detected(path: str = "path", text: str = "text") -> str:
    """Language expression over a path and a text."""
    name = f"string_split({path}, '/')[-1]"
    ext = f"lower(regexp_extract({name}, '^.+\\.([^.]*)$', 1))"
    exact = " ".join(f"when {name} in ({_list(files.split())}) then {quoted(lang)}" for lang, files in FILE_NAMES.items())
    by_ext = " ".join(
        f"when {ext} in ({_list(lang.extensions.split())}) then {quoted(lang.name)}"
        for lang in LANGUAGES if lang.extensions
    )
    first = f"lower(string_split({text}, chr(10))[1])"
    hints = " ".join(
        f"when {' or '.join(f'contains({first}, {quoted(h)})' for h in hints)} then {quoted(lang)}" for lang, hints in SHEBANGS
    )
    return f"""case when lower({name}) = 'dockerfile' or {name} like 'Dockerfile.%' then 'Dockerfile' {exact} {by_ext}
  when {text} like '#!%' then case {hints} end end"""


def corpus(where: str = "", text: str = "text") -> str:
    """Corpus rows with relative path, size, language and encoding."""
    return f"""
select *, case kind when 'plain' then length_bytes when 'nul' then length_bytes + 1 when 'cp1252' then length_bytes + 1
    when 'bom' then length_bytes + 3 when 'badbom' then length_bytes + 4
    else 2 + 2 * (length(text) + length(regexp_replace(text, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))) end as size_bytes,
  case kind when 'cp1252' then 'windows-1252' when 'bom' then 'utf-8-bom' when 'badbom' then 'utf-8-bom'
    when 'utf16' then 'utf-16le' else 'utf-8' end as encoding,
  {detected()} as detected
from (select doc_id, source, lang, kind, path, replace(path, '/repo/', '') as relative_path, text,
    strlen(text) as length_bytes
  from (select * replace ({text} as text) from ({views.CORPUS}) c0) c {where}) c1"""


def _in_head(marker: str) -> str:
    """The marker ends within the first 1024 bytes of the file (its letters
    are two bytes each in UTF-16, so it is not seen there)."""
    position = f"strpos(lower(text), {quoted(marker)})"
    start = "case kind when 'nul' then 1 when 'bom' then 3 when 'badbom' then 3 else 0 end"
    return (
        f"(kind <> 'utf16' and {position} > 0 and "
        f"strlen(left(text, {position} + {len(marker) - 1})) + {start} <= 1024)"
    )


def ruled(source: str, max_size: int = 2097152, exclude: str = "false", hidden: bool = True, enabled: str = "true") -> str:
    """Corpus rows with the rule that stops them (null when analysed)."""
    part = "list_has_any(string_split(path, '/'), [{}])"
    name = "string_split(path, '/')[-1]"
    visible = "where not regexp_matches(relative_path, '(^|/)\\.')" if hidden else ""
    return f"""
select *, case when {name} = '.gitignore' then 'gitignore_file'
  when {part.format(_list(['.git', 'node_modules', 'target']))} then 'excluded_dir'
  when size_bytes > {max_size} then 'max_size'
  when {exclude} then 'exclude_glob'
  when {name} in ({_list(LOCKFILES)}) then 'lockfile'
  when {part.format(_list(['vendor', 'node_modules', 'packages']))} then 'vendor'
  when contains({name}, '.generated.') or contains({name}, '.g.')
    or {_in_head('@generated')} or {_in_head('generated by')} then 'generated'
  when contains({name}, '.min.') then 'minified'
  when kind = 'nul' then 'binary'
  when kind = 'badbom' then 'decode_error'
  when detected is null then 'unsupported'
  when not ({enabled}) then 'disabled_language' end as rule
from ({source}) r {visible}"""


def _rule_case(position: int) -> str:
    return "case rule " + " ".join(f"when {quoted(r)} then {quoted(v[position])}" for r, v in RULES.items()) + " end"


def records(source: str, policy: str = "code_only", docstrings: bool = True) -> str:
    """CTE list ending in `records`: flat file records of ruled rows."""
    # A trailing windows-1252 dash is code that joins the last line.
    body = "case kind when 'cp1252' then text || '–' else text end"
    return f"""
ruled as materialized ({source}),
{classified(f"select path as id, detected as language, {body} as text from ruled where rule is null")},
raw as (select t.id, {raw_columns()} from texts t left join lines l using (id) group by t.id),
records as materialized (
  select r.*, case when rule is null then detected end as language,
    coalesce(total_physical_lines, 0) as total_physical_lines, coalesce(e.code_lines, 0) as code_lines,
    coalesce(e.comment_lines, 0) as comment_lines, coalesce(e.blank_lines, 0) as blank_lines,
    coalesce(e.mixed_lines_separate, 0) as mixed_lines_separate, e.docstring_comment_lines,
    unclosed_block, unclosed_string,
    case when rule is not null then {_rule_case(0)} when unclosed_block or unclosed_string
      then 'analyzed_best_effort' else 'analyzed_exact' end as status,
    case when rule is not null then replace({_rule_case(1)}, '{{}}', case rule when 'max_size' then '20000' else coalesce(detected, '') end)
      else concat_ws('; ', case when encoding = 'windows-1252' then 'decoded using windows-1252 fallback' end,
        case when unclosed_block then 'unclosed block comment detected; result is best effort' end,
        case when unclosed_string then 'unclosed string literal detected; result is best effort' end) end as warnings
  from ruled r left join flags f on f.id = r.path
  left join (select raw.*, {effective(quoted(policy), docstrings)} from raw) e on e.id = r.path)"""


def with_records(body: str, **options) -> str:
    """A query over `records` of the whole corpus."""
    source_options = {k: options.pop(k) for k in ("where", "text") if k in options}
    rule_options = {k: options.pop(k) for k in ("max_size", "exclude", "hidden", "enabled") if k in options}
    return f"with recursive {records(ruled(corpus(**source_options), **rule_options), **options)}\n{body}"
