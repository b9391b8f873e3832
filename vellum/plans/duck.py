"""The text rules as SQL expressions, for the statements that queries are held against."""

from __future__ import annotations

from ..functions import text as rules

WS = r"[\s\p{Z}]"


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze(x: str) -> str:
    return rf"regexp_replace({trim(x)}, '{WS}+', ' ', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def count(x: str) -> str:
    return f"len({words(x)})"


def core(x: str) -> str:
    return rf"regexp_replace({x}, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def any_of(x: str, parts: list[str]) -> str:
    return f"len(list_filter({_list(parts)}, lambda p: contains({x}, p))) > 0"


def is_furniture(x: str) -> str:
    t = rf"regexp_replace({trim(x)}, '^[\[\]]+|[\[\]]+$', '', 'g')"
    bare = rf"regexp_replace({t}, '{WS}+', '', 'g')"
    return f"((octet_length(encode({t})) >= 3 AND {has(t, '^[-_*]+$')}) OR (length({t}) <= 12 AND ({has(bare, '^[0-9]+$')} OR {has(f'lower({bare})', '^[ivxlcdm]+$')})))"


def is_all_caps(x: str) -> str:
    return rf"({has(x, r'\p{L}')} AND NOT {has(x, r'\p{Ll}')})"


def is_title_case(x: str) -> str:
    t = trim(x)
    kept = f"list_filter(list_transform({words(t)}, lambda w, i: CASE WHEN i > 1 AND list_contains({_list(rules.MINOR_WORDS)}, lower({core('w')})) THEN '' ELSE {core('w')} END), lambda c: c <> '')"
    return rf"(length({t}) <= 80 AND {count(t)} BETWEEN 2 AND 10 AND len({kept}) >= 2 AND len(list_filter({kept}, lambda c: NOT {has('c', r'^\p{Lu}')})) = 0)"


def looks_like_heading(x: str) -> str:
    t = trim(x)
    return (
        f"CASE WHEN {t} = '' OR {count(t)} > 12 THEN false WHEN {has(t, '^(§|Sec[.]|SEC[.])')} THEN true "
        f"WHEN list_contains({_list(rules.HEADING_OPENERS)}, lower({core(words(t) + '[1]')})) AND {count(t)} <= 6 THEN true "
        f"WHEN {is_all_caps(t)} AND {count(t)} <= 8 THEN true "
        rf"WHEN {count(t)} <= 8 AND NOT {has(t, '[.!?,;:]$')} AND {has(t, r'^\p{Lu}')} THEN true "
        f"ELSE {is_title_case(t)} END"
    )


def line_kind(x: str) -> str:
    return f"CASE WHEN {has(trim(x), '^#{1,4} ')} THEN 'heading' WHEN starts_with({trim(x)}, '> ') THEN 'quote' ELSE 'paragraph' END"


def line_content(x: str) -> str:
    inner = f"regexp_replace({trim(x)}, '^(#{{1,4}}|>) ', '')"
    return trim(inner)


def _end(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+$', '')"


def ends_mid_sentence(x: str) -> str:
    return f"""({_end(x)} <> '' AND NOT {has(_end(x), '[.!?"”’]$')})"""


def starts_mid_sentence(x: str) -> str:
    return has(x, r"^\P{L}*\p{Ll}")


def _normal(x: str) -> str:
    return f"lower({trim(f'''regexp_replace({trim(x)}, '[.:—-]+$', '')''')})"


def is_numeral(x: str) -> str:
    return has(core(x), "^([0-9]+|[ivxlcdmIVXLCDM]+)$")


def is_running_head(x: str) -> str:
    return rf"({has(x, r'[\[\]]')} OR len(list_filter({words(f'lower({x})')}[2:], lambda w: list_contains({_list(rules.RUNNING_WORDS)}, {core('w')}))) > 0)"


def heading_level(x: str) -> str:
    t = _normal(x)
    first, n = core(words(t) + "[1]"), count(t)
    return (
        f"CASE WHEN {t} = '' THEN 'minor' WHEN list_contains({_list(rules.PART_WORDS)}, {first}) AND {n} <= 4 THEN 'part' "
        f"WHEN list_contains({_list(rules.STANDALONE)}, {first}) AND {n} <= 3 THEN 'part' "
        f"WHEN list_contains({_list(rules.CHAPTER_WORDS)}, {first}) AND {n} <= 4 THEN 'chapter' "
        f"WHEN starts_with({t}, '§') OR {first} IN ('sec', 'section') THEN 'section' "
        f"WHEN {n} = 1 AND {is_numeral(words(t) + '[1]')} THEN 'chapter' "
        f"WHEN {is_title_case(x)} AND NOT {is_all_caps(x)} AND NOT {is_running_head(x)} THEN 'topic' ELSE 'minor' END"
    )


def is_bare_marker(x: str) -> str:
    t = _normal(x)
    w = words(t)
    return (
        f"CASE WHEN {count(t)} = 1 THEN {is_numeral(w + '[1]')} OR list_contains({_list(rules.STANDALONE)}, {w}[1]) "
        f"WHEN {count(t)} = 2 THEN list_contains({_list(rules.CHAPTER_WORDS + rules.PART_WORDS)}, {core(w + '[1]')}) AND {is_numeral(w + '[2]')} ELSE false END"
    )


def roman_value(x: str) -> str:
    worth = "[1, 5, 10, 50, 100, 500, 1000]"
    at = lambda i: f"coalesce({worth}[strpos('ivxlcdm', nullif(substr(lower({x}), {i}::INT, 1), ''))], 0)"
    total = f"list_sum(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN {at('i')} < {at('(i + 1)')} THEN -{at('i')} ELSE {at('i')} END))::BIGINT"
    return f"CASE WHEN {has(f'lower({x})', '^[ivxlcdm]+$')} AND {total} BETWEEN 1 AND 3999 THEN {total} END"


def number_on_line(x: str) -> str:
    t = rf"regexp_replace({trim(x)}, '^[\[\]\-.\s\p{{Z}}]+|[\[\]\-.\s\p{{Z}}]+$', '', 'g')"
    value = rf"try_cast(regexp_replace({t}, '^\+', '') AS BIGINT)"
    return rf"CASE WHEN {t} <> '' AND length({t}) <= 8 THEN CASE WHEN {has(t, r'^\+?[0-9]+$')} THEN CASE WHEN {value} BETWEEN 1 AND 2999 THEN {value} END ELSE {roman_value(t)} END END"


def folio_reply(x: str) -> str:
    t = trim(x)
    return f"CASE WHEN {t} = '' OR lower({t}) = 'none' OR {count(t)} > 2 THEN NULL ELSE {number_on_line(t)} END"


def without_structural_numerals(x: str) -> str:
    return f"CASE WHEN {any_of(f'lower({x})', rules.STRUCTURAL_MARKERS)} THEN '' ELSE {x} END"


def is_commentary(x: str) -> str:
    return f"(length({x}) <= 300 AND {any_of(f'lower({x})', rules.COMMENTARY)})"


def is_trailing_meta(x: str) -> str:
    return f"(length({x}) <= 300 AND {any_of(f'lower({x})', rules.TRAILING_META)})"


def furniture_key(x: str) -> str:
    t = rf"lower(regexp_replace({trim(x)}, '^[§#0-9.\s\p{{Z}}]+', ''))"
    return squeeze(rf"regexp_replace({t}, '[^\p{{L}}\p{{N}}\s\p{{Z}}]', '', 'g')")


def plain_words(x: str) -> str:
    return f"list_filter(list_transform({words(x)}, lambda w: lower({core('w')})), lambda w: w <> '')"


def runs(w: str, n: int = rules.SHARED_RUN) -> str:
    return f"list_transform(range(1, greatest(len({w}) - {n - 1}, 0) + 1), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))"


def sentences(w: str) -> str:
    """Of a column that holds a list of words: they are marked where a sentence closes, then cut there."""
    mark = (
        f"list_transform({w}, lambda v, i: v || CASE WHEN i < len({w}) AND NOT list_contains({_list(rules.ABBREVIATIONS)}, lower(v)) AND {has('v', '[.!?]$')} "
        rf"AND {has(f'{w}[i + 1]', r'^[^\p{L}\p{N}' + '\"“]*' + r'[\p{Lu}0-9' + '\"“]')} THEN chr(1) ELSE ' ' END)"
    )
    return f"list_filter(list_transform(string_split(array_to_string({mark}, ''), chr(1)), lambda s: rtrim(s, ' ')), lambda s: s <> '')"


def normalise(x: str, level: str = "full") -> str:
    for mark, plain in [*rules.LIGATURES, *([("ſ", "s")] if level == "full" else [])]:
        x = f"replace({x}, '{mark}', '{plain}')"
    return x


def join_hyphenated(left: str, right: str) -> str:
    body = f"regexp_replace({left}, '[{rules.HYPHENS}]+$', '')"
    head = f"regexp_replace({right}, '^{WS}+', '')"
    return rf"CASE WHEN {has(body, r'\p{L}$')} AND {has(head, r'^\p{L}')} THEN {body} || CASE WHEN {has(head, r'^\p{Ll}')} THEN '' ELSE '-' END || {head} ELSE {body} || {right} END"


def stitch(tail: str, head: str) -> str:
    t, h = _end(tail), f"regexp_replace({head}, '^{WS}+', '')"
    return f"CASE WHEN {t} = '' THEN {h} WHEN {h} = '' THEN {t} WHEN {has(t, f'[{rules.HYPHENS}]$')} THEN {join_hyphenated(t, h)} ELSE {t} || ' ' || {h} END"


def surface(x: str) -> str:
    t = rf"regexp_replace({trim(x)}, '^[^\p{{L}}\p{{N}}''-]+|[^\p{{L}}\p{{N}}''-]+$', '', 'g')"
    return rf"CASE WHEN {has(t, r'[\p{L}\p{N}]')} THEN lower({t}) ELSE '' END"


def preview(x: str, limit: int = 70) -> str:
    clean = squeeze(x)
    cut = f"nullif(regexp_extract({clean} || ' ', '^(.{{1,{limit}}}) ', 1), '')"
    return f"CASE WHEN length({clean}) <= {limit} THEN {clean} ELSE coalesce({cut}, left({clean}, {limit})) || '…' END"
