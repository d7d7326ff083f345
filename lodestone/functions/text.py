"""Column functions on text: lines, sentences, tokens, overlaps, windows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .constants import GENERIC_QUERY_TERMS, KEY_TERM_STOPWORDS

#: What ends a line.
LINE_END = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
EMPTY = "CAST(array() AS array<string>)"
#: All characters that (?U)\s matches.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squash(text) -> Column:
    """Runs of white space become one space; none at the ends."""
    # A single space is no match, so that plain text is copied as it is.
    return F.trim(F.regexp_replace(col(text), r"(?U)[\s&&[^ ]]\s*| \s+", " "))


def strip(text) -> Column:
    return F.btrim(col(text), F.lit(WHITE))


def strip_of(text, characters: str) -> Column:
    """Without any of the characters at either end."""
    return F.btrim(col(text), F.lit(characters))


def raw_lines(text) -> Column:
    return F.transform(F.split(F.coalesce(col(text), F.lit("")), LINE_END, -1), strip)


def lines(text) -> Column:
    """Lines that aren't blank, without white space at the ends."""
    return F.filter(raw_lines(text), lambda x: x != "")


def clean_lines(text) -> Column:
    return F.filter(F.transform(raw_lines(text), squash), lambda x: x != "")


def sentences(text) -> Column:
    return F.filter(F.transform(F.split(squash(text), r"(?<=[.!?])\s+", -1), strip), lambda x: x != "")


def words(text) -> Column:
    return F.filter(F.split(squash(text), " ", -1), lambda x: x != "")


def contains_any(text, phrases) -> Column:
    text = col(text)
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def count_of(text, pattern: str) -> Column:
    return F.regexp_count(col(text), F.lit(pattern))


def count_in(text, category: str) -> Column:
    r"""How many characters are of a category (such as "Nd"): the length without the runs of others, so that no match becomes a string of its own."""
    return F.length(F.regexp_replace(col(text), rf"\P{{{category}}}+", ""))


def is_upper(text) -> Column:
    """Has letters of a case, and all of them are capitals."""
    text = col(text)
    return (F.upper(text) == text) & (F.lower(text) != text)


def is_title(text) -> Column:
    """Capitals start runs of letters and nothing else does."""
    text = col(text)
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"(?<!\p{L})\p{Ll}") & ~text.rlike(r"(?<=\p{L})\p{Lu}")


def title_case(text) -> Column:
    """A capital after anything but a letter, small letters elsewhere."""
    parts = F.regexp_extract_all(F.lower(col(text)), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substr(x, F.lit(2)))), "")


def tokens(text) -> Column:
    """Runs of ASCII letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit("[A-Za-z0-9]+"), F.lit(0))


def search_tokens(text) -> Column:
    """Words of two or more letters, digits or underscores of any script, in lower case."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def key_tokens(text) -> Column:
    return F.filter(tokens(text), lambda x: (F.length(x) > 2) & ~x.isin(*KEY_TERM_STOPWORDS))


def question_terms(question) -> Column:
    return F.array_distinct(F.filter(tokens(question), lambda x: F.length(x) > 3))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def keyword_overlap(question, text) -> Column:
    """Share of the question's terms that the text has."""
    return let(question_terms(question), lambda q: F.when(F.size(q) > 0, shared(q, tokens(text)) / F.size(q)).otherwise(F.lit(0.0)))


def fold_plurals(terms: Column) -> Column:
    """The terms and what they would be in the singular."""

    def folded(t):
        one = F.transform(F.filter(t, lambda x: (F.length(x) > 4) & x.endswith("s")), lambda x: F.left(x, F.length(x) - 1))
        two = F.transform(F.filter(t, lambda x: (F.length(x) > 5) & x.endswith("ies")), lambda x: F.concat(F.left(x, F.length(x) - 3), F.lit("y")))
        return F.array_distinct(F.concat(t, one, two))

    return let(terms, folded)


def significant_terms(question) -> Column:
    return fold_plurals(F.array_distinct(F.filter(tokens(question), lambda x: (F.length(x) > 3) & ~x.isin(*GENERIC_QUERY_TERMS))))


def content_overlap(question, *texts) -> Column:
    """Share of the question's significant terms among the texts' terms."""
    found = fold_plurals(F.array_distinct(F.flatten(F.array(*[tokens(t) for t in texts]))))
    return let(significant_terms(question), lambda q: F.when(F.size(q) > 0, shared(q, found) / F.size(q)).otherwise(F.lit(0.0)))


def jaccard(a: Column, b: Column) -> Column:
    return let(F.size(F.array_union(a, b)), lambda n: F.when(n > 0, shared(a, b) / n).otherwise(F.lit(0.0)))


def distinct_by_case(items: Column) -> Column:
    """The first of items that differ in case only, in order."""
    return let(items, lambda t: let(F.transform(t, F.lower), lambda low: F.filter(t, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)))


def first_distinct(items: Column, limit: int | None = None) -> Column:
    """Items without regard to case, trimmed; the first of equals stays, in order."""
    tidy = F.filter(F.transform(items, lambda x: strip_of(squash(x), " .,:;|-")), lambda x: x != "")
    kept = distinct_by_case(tidy)
    return F.slice(kept, 1, limit) if limit else kept


def windows(text, size: int, overlap: int) -> Column:
    """Windows of `size` characters, each starting `overlap` before the end of
    the one before; the last is the first to reach the end; blank ones go."""
    text, step = col(text), max(size - overlap, 1)
    n = F.ceil(F.greatest(F.length(text) - size, F.lit(0)) / step).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n), lambda i: strip(F.substr(text, i * step + 1, F.lit(size))))
    return F.when(F.length(text) > 0, F.filter(cut, lambda x: x != "")).otherwise(F.expr(EMPTY))


def digit_ratio(text) -> Column:
    text = col(text)
    return F.length(F.regexp_replace(text, "[^0-9]+", "")) / F.greatest(F.length(text), F.lit(1))


def page_number(label) -> Column:
    return F.regexp_extract(col(label), r"([0-9]+)", 1).try_cast("int")


def roman_number(text) -> Column:
    """Value of a Roman numeral of I, V, X, L and C; null for anything else."""
    value = F.create_map(*[F.lit(x) for p in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100)) for x in p])
    back = F.regexp_extract_all(F.reverse(F.upper(col(text))), F.lit("."), F.lit(0))
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("most"))

    def step(a, c):
        v = F.element_at(value, c)
        return F.struct((a["sum"] + F.when(v < a["most"], -v).otherwise(v)).alias("sum"), F.greatest(a["most"], v).alias("most"))

    return F.when(F.upper(col(text)).rlike("^[IVXLC]+$"), F.aggregate(back, zero, step, lambda a: a["sum"]))


def fingerprint(content) -> Column:
    return F.sha2(col(content), 256)


def document_id(content) -> Column:
    return F.left(fingerprint(content), F.lit(16))


def slug(text) -> Column:
    return strip_of(F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", "-"), "-")


def cache_key(*parts) -> Column:
    """SHA-256 of the parts; a question is squashed and in lower case."""
    return F.sha2(F.concat_ws("|", *[F.lower(squash(p)) for p in parts]), 256)


def without_references(text) -> Column:
    return F.get(F.split(col(text), r"\n\s*References:\s*\n", 2), F.lit(0))


def preview(text, size: int = 240) -> Column:
    return F.left(F.translate(col(text), "\n", " "), F.lit(size))


def parse_time(text) -> Column:
    return F.try_to_timestamp(F.nullif(col(text), F.lit("")))


def clamp(x, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def similarity_of(distance) -> Column:
    return 1.0 / (1.0 + F.greatest(col(distance), F.lit(0.0)))
