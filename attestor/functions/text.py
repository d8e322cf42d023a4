"""Text functions as Column expressions, and the same in the SQL that they are held against (names ending in _sql)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.functions import constants as K


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _in(words: list[str]) -> str:
    return ", ".join('"' + w.replace('"', '\\"') + '"' for w in words)


def _cut(low: str) -> str:
    return f"""regexp_replace(regexp_replace({low}, "n['’]t\\\\b", ''), "['’](s|re|ve|ll|d|m)\\\\b", '')"""


def plain(column: str) -> Column:
    """Lower case, negations and clitics cut; its runs of a-z and 0-9 are the tokens, stop words among them (see words.tokens)."""
    low = f"lower(coalesce({column}, ''))"
    return F.expr(f"""case when contains({low}, "'") or contains({low}, '’') then {_cut(low)} else {low} end""")


def tokens(column: str, stop: list[str] | None = None) -> Column:
    """Lower case, negations and clitics cut, runs of a-z and 0-9, stop words out; order and repeats stay."""
    low = f"lower(coalesce({column}, ''))"
    found = f"regexp_extract_all({_cut(low)}, '([a-z0-9]+)', 1)"
    return F.expr(f"filter({found}, x -> x not in ({_in(K.STOPWORDS if stop is None else stop)}))" if stop != [] else found)


def tokens_sql(column: str, stop: list[str] | None = None) -> str:
    plain = f"""regexp_replace(regexp_replace(lower(coalesce({column}, '')), 'n[''’]t\\b', '', 'g'), '[''’](s|re|ve|ll|d|m)\\b', '', 'g')"""
    return f"list_filter(regexp_extract_all({plain}, '([a-z0-9]+)', 1), lambda x: x not in ({quoted(K.STOPWORDS if stop is None else stop)}))"


def content_words(column: str) -> Column:
    """Distinct words of more than two letters that the copier compares."""
    return F.expr(f"array_distinct(filter(regexp_extract_all(lower(coalesce({column}, '')), '([a-z0-9]+)', 1), x -> length(x) > 2 and x not in ({_in(K.COPIER_STOPWORDS)})))")


def content_words_sql(column: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({column}, '')), '([a-z0-9]+)', 1), lambda x: length(x) > 2 and x not in ({quoted(K.COPIER_STOPWORDS)})))"


def question_terms(column: str, names: str) -> Column:
    """Distinct tokens of a question in order: 3 letters or more, no fillers, no word of a known name. names: SQL of an array of lower-case names."""
    distinct = F.array_distinct(tokens(column))
    return F.filter(distinct, lambda x: (F.length(x) >= 3) & ~x.isin(K.QUESTION_FILLERS) & ~F.array_contains(F.expr(f"flatten(transform({names}, n -> concat(array(n), split(n, ' '))))"), x))


def sentences(column: str, pattern: str) -> Column:
    """Pieces of the trimmed text, blanks out."""
    return F.expr(f"filter(split(trim(coalesce({column}, '')), '{pattern.replace(chr(92), chr(92) * 2)}'), x -> trim(x) <> '')")


def sentences_sql(column: str, marks: str) -> str:
    """marks: the characters of the pattern's look-behind; RE2 has none, so a separator is put in."""
    return f"list_filter(string_split(regexp_replace(trim(coalesce({column}, '')), '([{marks}])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')"


def citations(column: str) -> Column:
    """Citation keys of a text in order: document#section, or the document alone."""
    p = K.CITATION.replace("\\", "\\\\")
    return F.expr(f"zip_with(regexp_extract_all({column}, '{p}', 1), regexp_extract_all({column}, '{p}', 2), (d, s) -> case when s = '' then d else concat(d, '#', s) end)")


def citations_sql(column: str) -> str:
    return f"list_transform(list_zip(regexp_extract_all({column}, '{K.CITATION}', 1), regexp_extract_all({column}, '{K.CITATION}', 2)), lambda z: case when coalesce(z[2], '') = '' then z[1] else z[1] || '#' || z[2] end)"


def strict(column: str) -> Column:
    """All citations name a section."""
    return F.regexp_count(column, F.lit(K.CITATION)) == F.regexp_count(column, F.lit(K.STRICT_CITATION))


def abstains(column: str) -> Column:
    low = F.lower(F.coalesce(F.col(column), F.lit("")))
    out = F.lit(False)
    for phrase in K.ABSTENTION_PHRASES:
        out = out | low.contains(phrase)
    return out


def any_phrase(column: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for phrase in phrases:
        out = out | column.contains(phrase)
    return out


def any_phrase_sql(column: str, phrases: list[str]) -> str:
    return "(" + " or ".join("contains(" + column + ", '" + p.replace("'", "''") + "')" for p in phrases) + ")"


def cue(column: str) -> Column:
    return F.regexp_extract(F.lower(column), r"(?i)\b(" + "|".join(K.CUES) + r")\b", 1)


def cue_sql(column: str) -> str:
    return f"regexp_extract(lower({column}), '\\b(" + "|".join(K.CUES) + ")\\b', 1)"


def names_it(text: Column, name: Column) -> Column:
    """The name stands in the text as a whole word."""
    return F.rlike(text, F.concat(F.lit(r"(?i)\b\Q"), name, F.lit(r"\E\b")))


def normal_argument(kind: str, query: str, drug: str, codes: str) -> Column:
    """Key of a tried action: a plain argument in lower case with single blanks; a structured one as query|drug|codes in order."""
    return F.expr(f"case when {kind} = 'plain' then lower(trim(regexp_replace({query}, '\\\\s+', ' '))) else concat_ws('|', lower(trim(regexp_replace({query}, '\\\\s+', ' '))), coalesce({drug}, ''), array_join(array_sort(coalesce({codes}, array())), ',')) end")


def clean_entity(column: Column) -> Column:
    """An extracted name without brackets, frames, tails and numbers."""
    out = column
    for pattern in (r"\[[^\]]*\]", r"\([^)]*\)", r"\s*\(.*$"):
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(F.trim(out), r"(?i)^(?:known\s+|a\s+history\s+of\s+|history\s+of\s+|the\s+|any\s+)", "")
    out = F.regexp_replace(out, r"(?i)\s*(?:with other drugs|and other drugs|or other drugs|\[.*$|which .*$|that .*$|such as .*$|including .*$|is contraindicated.*$)", "")
    for word in (" which ", " such as ", " including "):
        out = F.substring_index(out, word, 1)
    out = F.when((F.instr(out, " or ") > 0) & (F.length(F.substring_index(out, " or ", 1)) > 6), F.substring_index(out, " or ", 1)).otherwise(out)
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"^[ ,.;:\[\]()]+|[ ,.;:\[\]()]+$", ""), r"\s+\d+$", ""))
