"""Text functions as column expressions. Patterns are Java's; (?U) gives \\w and \\s their Unicode meaning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CODE = r"[A-H]-[0-9]{1,2}(?:-[0-9]{1,2})?"


def clean_html(html: Column) -> Column:
    """Visible text: scripts and styles go, tags become line breaks, five entities are resolved, blanks collapse."""
    out = F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>", "")
    out = F.regexp_replace(out, r"<[^>]+>", "\n")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&nbsp;", " "), ("&quot;", '"')):
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"(?U)\n\s*\n+", "\n")
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def between(html: Column, opening: str, after: str, ends: tuple[str, ...]) -> Column:
    """The part of a page from the sign `after` behind `opening` to the first of the end marks behind it; null if one
    of both isn't there. An end mark at its very start doesn't count."""
    start = F.instr(html, opening)
    rest = F.substr(html, start)
    inner = F.substr(rest, F.instr(rest, after) + F.lit(len(after)))
    places = [F.when(F.instr(inner, e) > 1, F.instr(inner, e)) for e in ends]
    stop = F.least(*places) if len(places) > 1 else places[0]
    return F.when((start > 0) & (F.instr(rest, after) > 0), F.when(stop.isNull(), inner).otherwise(F.substr(inner, F.lit(1), stop - 1)))


def printable(text: Column) -> Column:
    """control characters out, other than tabs and line feeds."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F]", "")


def spoken_codes(text: Column) -> Column:
    """codes as people write them: any case, white space around the hyphen or none at all, as."""
    loose = F.regexp_extract_all(text, F.lit(r"(?i)\b([A-H]\s*-\s*\d{1,2}(?:-\d)?)"), F.lit(1))
    bare = F.transform(F.regexp_extract_all(text, F.lit(r"(\([A-H]\s?\d{1,2}\))"), F.lit(1)), lambda x: F.regexp_replace(x, r"\(([A-H])\s?(\d{1,2})\)", "$1-$2"))
    return F.array_distinct(F.concat(F.transform(loose, lambda x: F.upper(F.regexp_replace(x, r"\s", ""))), bare))


def key_terms(title: Column, prefixes: tuple[str, ...] = ()) -> Column:
    """words of three and more characters of a title, without the prefixes, a leading article number, the annex mark
    and what stands in parentheses."""
    out = title
    for p in prefixes:
        out = F.replace(out, F.lit(p), F.lit(""))
    out = F.regexp_replace(out, r"(?U)^\s*제\d+조(의\d+)?\s*|별표\s*", "")  # the corpus's fixed marks
    out = F.trim(F.regexp_replace(out, r"\(.*?\)", ""))
    return F.filter(F.split(out, r"(?U)[/·,ㆍ]|\s+"), lambda w: F.char_length(w) >= 3)


def codes(text: Column) -> Column:
    """Distinct codes of a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({CODE})"), F.lit(1))))


def digit_key(text: Column) -> Column:
    """The distinct digit runs of a text, sorted: what two names must share to be compared at all."""
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1)))), ",")


def tokens_with_grams(text: Column) -> Column:
    """Words (other characters than word characters and - part them) and, after them, their 2-grams; a word of one
    character is its own gram."""
    words = F.filter(F.split(text, r"(?U)[^\w-]+"), lambda w: w != "")
    grams = lambda w: F.when(F.char_length(w) == 1, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.char_length(w) - 1), lambda i: F.substr(w, i, F.lit(2))))
    return F.concat(words, F.flatten(F.transform(words, grams)))


def label(node: Column, name: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(node, F.lit("("), name, F.lit(")"))).otherwise(node)


def split_sources(joined: Column) -> Column:
    return F.filter(F.transform(F.split(joined, ";"), lambda x: F.trim(x)), lambda x: x != "")


def snippet(text: Column, at: Column, before: int = 120, after: int = 200) -> Column:
    """The text from before to after characters around a place (from 1), white space collapsed."""
    start = F.greatest(F.lit(1), at - before)
    return F.trim(F.regexp_replace(F.substr(text, start, at + after - start), r"\s+", " "))


def route(reply: Column) -> Column:
    return F.when(F.contains(reply, F.lit("global")), "global").when(F.contains(reply, F.lit("path")), "path").otherwise("local")


def unsupported_numbers(answer: Column, context: Column, units: str = "year|month|day|%") -> Column:
    """Numbers with a unit that the context doesn't have, white space aside. Digits and white space are Unicode's, and any
    amount of it may stand between number and unit."""
    bare = F.regexp_replace(context, r"(?U)\s+", "")
    found = F.regexp_extract_all(answer, F.lit(rf"(?U)(\d+\s*(?:{units}))"), F.lit(1))
    return F.filter(found, lambda n: ~F.contains(bare, F.regexp_replace(n, r"(?U)\s+", "")))


def render(verdict: Column, steps: Column, details: Column, unknown: Column) -> Column:
    """An answer's parts as text: numbered steps, empty parts left out."""
    numbered = F.array_join(F.transform(steps, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")
    parts = [F.when(F.coalesce(p, F.lit("")) != "", p) for p in (verdict, numbered, details, unknown)]
    return F.concat_ws("\n\n", *parts)


def safe_name(title: Column) -> Column:
    return F.regexp_replace(title, r'[\\/:*?"<>|]', "_")
