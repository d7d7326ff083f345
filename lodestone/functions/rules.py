"""Column predicates and classifiers on lines, headings, pages and chunks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import constants as C
from .text import clean_lines, col, contains_any, count_in, count_of, digit_ratio, distinct_by_case, is_title, is_upper, let, lines, page_number, sentences, squash, strip, strip_of, title_case, words

CLAUSE = r"^(\d+(?:\.\d+)+)\b"
LEADERS = r"\.{4,}\s*\d+\s*$"
NUMBER_HEAD = r"^\d+(?:\.\d+)*\s*"
#: How every known heading starts once it is in lower case: other lines need no closer look.
KNOWN_START = rf"(?U)^[\s.:\-\d]*+(?:appendix|{'|'.join(sorted({h.split()[0] for h in C.PAGE_HEADINGS}))})"
#: 15 words or more that heading_text() leaves, the first without a digit in front: unless it is a known heading, such a line is none.
LONG_LINE = r"(?U)^[\s.:\-]*+[^\s.:\-\d]\S*+(?:\s++(?:[.:\-\d]++\s++)*+[.:\-\d]*+[^\s.:\-\d]\S*+){14}"


def starts_upper(w: Column) -> Column:
    return w.rlike(r"^\p{Lu}")


def heading_text(line) -> Column:
    """A line as a heading: squashed, without dot leaders and marks at the ends."""
    return strip_of(F.regexp_replace(squash(line), LEADERS, ""), " .:-")


def is_page_artifact(line) -> Column:
    low = F.lower(col(line))
    return low.rlike(r"^(?:[ivxlcdm]+|\d+|.*page\s+\d+)$") | F.contains(low, F.lit("author manuscript"))


def is_author_line(line) -> Column:
    line = col(line)
    w = F.filter(F.split(squash(F.translate(line, ",", " ")), " "), lambda x: x != "")
    names = let(w, lambda v: F.size(v).between(1, 12) & F.forall(v, starts_upper) & F.exists(v, lambda x: x.rlike("[123]$")))
    marked = F.when(line.rlike("[123]"), names).otherwise(False)  # the words of other lines aren't looked at
    return F.contains(line, F.lit("@")) | contains_any(F.lower(line), ("department of", "university", "institute", "center for")) | contains_any(line, ("1,3", "2,3", "1)", "2)", "3)")) | marked


def is_reference_line(line) -> Column:
    line = col(line)
    low = F.lower(line)
    return F.contains(low, F.lit("[pubmed:")) | line.rlike(r"^\d{1,3}\.\s+[A-Z]") | (F.contains(low, F.lit("et al.")) & line.rlike(r"\p{Nd}"))


def is_sentence_like(line) -> Column:
    small = lambda w: F.size(F.filter(w, lambda x: x.rlike(r"^\p{Ll}")))
    return let(words(line), lambda w: (F.size(w) >= 6) & (small(w) >= F.greatest(F.lit(2), F.floor(F.size(w) / 3))))


def page_heading(line) -> Column:
    """The known heading that a line is, or empty."""
    known = F.create_map(*[x for h in C.PAGE_HEADINGS for x in (F.lit(h), F.lit(" ".join(w if w == "and" else w.capitalize() for w in h.split())))])
    bare = lambda text: F.lower(F.trim(F.regexp_replace(text, NUMBER_HEAD, "")))
    named = lambda text: let(bare(text), lambda b: F.when(b.startswith("appendix"), title_case(text)).otherwise(F.coalesce(F.element_at(known, b), F.lit(""))))
    return F.when(may_be_known(line), let(heading_text(line), named)).otherwise("")


def may_be_known(line) -> Column:
    return F.lower(col(line)).rlike(KNOWN_START)


def is_heading(line) -> Column:
    tested = let(heading_text(line), lambda text: let(words(text), lambda w: heading_test(line, text, w)))
    return F.when(col(line).rlike(LONG_LINE) & ~may_be_known(line), False).otherwise(tested)


def heading_test(line, text: Column, w: Column) -> Column:
    """Is a line a heading, given its text as a heading and that text's words?"""
    n = F.size(w)
    small = F.array(*[F.lit(x) for x in C.TITLE_SMALL_WORDS])
    titled = F.size(F.filter(w, lambda x: starts_upper(x) | F.array_contains(small, F.lower(x))))
    capital = F.size(F.filter(w, starts_upper))
    letters, capitals = count_in(text, "L"), count_in(text, "Lu")
    academic = F.regexp_extract(text, r"^\d+(?:\.\d+){0,2}\s+([A-Z][A-Za-z0-9 ,/&()-]{2,120})$", 1)
    closed = text.rlike("[.?!]$")
    short = (n <= 10) & starts_upper(text) & ~closed & ~text.rlike("[,;]") & ~is_sentence_like(text)
    rejected = (text == "") | is_page_artifact(text) | is_author_line(text) | is_reference_line(text)
    return (
        F.when(rejected, False)
        .when((page_heading(text) != "") | text.rlike(CLAUSE), True)
        .when(col(line).rlike(LEADERS), False)
        .when(academic != "", ~is_sentence_like(academic))
        .when(short, True)
        .when((n <= 12) & starts_upper(F.get(w, F.lit(0))) & ~closed & (titled / n >= 0.8), True)
        .when((n > 14) | is_sentence_like(text) | (letters == 0), False)
        .otherwise((capitals / letters >= 0.7) | (capital / n >= 0.8))
    )


def section_kind(heading) -> Column:
    low = F.lower(col(heading))
    bare = F.trim(F.regexp_replace(low, NUMBER_HEAD, ""))
    return (
        F.when(low.startswith("appendix"), "appendix")
        .when(bare.isin(*C.PAGE_HEADINGS), bare)
        .when(contains_any(bare, ("future work", "future direction")), "future work")
        .when(contains_any(bare, ("conclusion", "final remarks")), "conclusion")
        .when(F.contains(bare, F.lit("results")), "results")
        .when(F.contains(bare, F.lit("discussion")), "discussion")
        .when(F.contains(bare, F.lit("method")), "methodology")
        .when(F.contains(bare, F.lit("abstract")), "abstract")
        .when(contains_any(bare, ("introduction", "background")), "introduction")
        .when(F.contains(bare, F.lit("reference")), "references")
        .otherwise("general")
    )


def content_type(heading, text, kind) -> Column:
    joined = F.lower(F.concat(col(heading), F.lit(" "), F.left(col(text), F.lit(1200))))
    known = ("references", "appendix", "future work", "discussion", "conclusion", "results", "methodology", "abstract", "introduction")
    out = F.when(col(kind).isin(*known), col(kind))
    for name, phrases in C.CONTENT_CUES:
        out = out.when(contains_any(joined, phrases), name)
    return out.otherwise("general")


def document_style(text) -> Column:
    """Style of a document from its headings and the beginnings of its first pages."""
    low = F.lower(col(text))
    points = [sum((F.when(contains_any(low, phrases), p).otherwise(0) for p, phrases in cues), F.lit(0)) for _, cues in C.STYLE_CUES]
    best = F.greatest(*points)
    out = F.when(best < 2, "generic_longform")
    for (name, _), p in zip(C.STYLE_CUES, points):
        out = out.when(p == best, name)
    return out


def is_noise_line(line) -> Column:
    return let(F.lower(col(line)), lambda low: noise_test(col(line), low))


def noise_test(line: Column, low: Column) -> Column:
    digits, letters = count_in(line, "Nd"), count_in(line, "L")
    # The cheap tests come first: words are only counted where they decide.
    return (
        F.when((low == "") | F.contains(line, F.lit("@")) | low.rlike("^(?:doi|http)"), True)
        .when(contains_any(low, ("author manuscript", "available in pmc", "[pubmed:", "copyright")) | low.rlike(r"^page\s+\d+$"), True)
        .otherwise((digits >= 6) & (digits > letters) & (F.size(words(line)) <= 24))
    )


def is_heading_line(line) -> Column:
    """A heading as chunking sees it."""

    def test(x):
        n = F.size(words(x))
        return x.rlike(r"^\d+(?:\.\d+)*\s+[A-Za-z]") | (is_upper(x) & (n <= 8)) | (is_title(x) & (n <= 8) & (F.length(x) <= 80) & ~x.rlike("[.!?]$"))

    return let(squash(line), test)


def is_table_caption(line) -> Column:
    line = F.trim(col(line))
    return line.rlike(r"(?i)^(?:table|exhibit)\s+[A-Za-z0-9.\-:]+") & ~F.lower(line).isin("table of contents", "list of tables")


def is_tabular_line(line) -> Column:
    line = col(line)
    return line.rlike(r"\s{2,}|\t|[|]") & ((digit_ratio(line) >= 0.12) | (F.size(words(line)) >= 4))


def is_footnote_line(line) -> Column:
    line = col(line)
    return line.rlike(r"(?U)^(?:\d{1,3}|[*†‡§])\s+[\w(]") & (F.length(line) >= 24) & ~line.rlike(r"^\d+(?:\.\d+)+\s+[A-Za-z]") & ~is_table_caption(line)


def starts_block(line) -> Column:
    return col(line).rlike(CLAUSE) | is_upper(line)


def canonical_section_heading(text) -> Column:
    """The first known heading among the first lines, or empty."""
    bare = F.transform(F.slice(clean_lines(text), 1, 20), lambda x: F.lower(strip_of(F.regexp_replace(x, NUMBER_HEAD, ""), " :-")))

    def known(x):
        found = F.when(x.isin(*C.SECTION_HEADINGS), title_case(x))
        for h in C.SECTION_HEADINGS:
            found = found.when(x.startswith(h + ":"), title_case(F.lit(h)))
        return found

    return F.coalesce(F.get(F.filter(F.transform(bare, known), lambda x: x.isNotNull()), F.lit(0)), F.lit(""))


def best_title(fallback, text, label) -> Column:
    bare = F.transform(F.slice(clean_lines(text), 1, 15), lambda x: strip_of(F.regexp_replace(x, NUMBER_HEAD, ""), " :-"))
    # What prose fails at once comes first.
    fits = F.filter(bare, lambda x: (is_upper(x) | is_title(x)) & (F.size(words(x)) <= 12) & ~is_noise_line(x))
    return F.coalesce(F.nullif(canonical_section_heading(text), F.lit("")), F.get(fits, F.lit(0)), F.nullif(col(fallback), F.lit("")), col(label))


def sentences_with(text, keywords, limit: int = 3) -> Column:
    return F.slice(F.filter(sentences(text), lambda s: contains_any(F.lower(s), keywords)), 1, limit)


def excerpt(text, limit: int = 3) -> Column:
    useful = sentences(F.array_join(F.filter(clean_lines(text), lambda x: ~is_noise_line(x)), " "))
    chosen = let(useful, lambda u: F.when(F.size(u) > 0, u).otherwise(sentences(text)))
    return F.left(F.array_join(F.slice(chosen, 1, limit), " "), F.lit(900))


def section_summary(title, text) -> Column:
    return let(excerpt(text), lambda short: let(sentences(short), lambda parts: summary_of(title, short, parts)))


def summary_of(title, short: Column, parts: Column) -> Column:
    """A section's summary from its excerpt and that excerpt's sentences."""
    low, n = F.lower(col(title)), F.size(parts)
    cut = lambda x: F.left(x, F.lit(900))
    out = F.when(short == "", col(title))
    for titles, keywords in C.SUMMARY_KEYWORDS:
        holds = lambda s, keywords=keywords: contains_any(F.lower(s), keywords)
        picked = F.slice(F.filter(parts, with_one(holds)), 1, 3)
        out = out.when(low.isin(*titles) & F.exists(parts, with_one(holds)), cut(F.array_join(picked, " ")))
    out = out.when((n >= 3) & low.isin("discussion", "conclusion", "conclusions", "future work", "future directions"), cut(F.array_join(F.slice(parts, -2, 2), " ")))
    out = out.when((n >= 3) & low.isin("abstract", "introduction", "background"), cut(F.array_join(F.slice(parts, 1, 3), " ")))
    return out.when(n >= 4, cut(F.concat_ws(" ", F.get(parts, F.lit(0)), F.element_at(parts, -1)))).otherwise(cut(short))


def with_one(f):
    """f as a function of one argument, which array functions tell from one of an item and its place."""
    return lambda x: f(x)


def section_aliases(title, kind, path) -> Column:
    known = F.lit(None).cast("array<string>")
    for name, aliases in C.SECTION_KIND_ALIASES.items():
        known = F.when(F.lower(col(kind)) == name, F.array(*[F.lit(a) for a in aliases])).otherwise(known)
    items = F.transform(F.concat(F.coalesce(known, F.expr("CAST(array() AS array<string>)")), F.array(col(title)), col(path)), squash)
    return F.slice(distinct_by_case(F.filter(items, lambda x: x != "")), 1, 10)


def front_matter(title, text, label) -> Column:
    """(kind, score, low_value) of a page or section."""
    facts = F.struct(F.lower(squash(title)).alias("title"), F.lower(col(text)).alias("text"))
    joined = lambda f: F.concat(f["title"], F.lit(" "), F.left(f["text"], F.lit(1600)))
    return let(facts, lambda f: let(joined(f), lambda both: matter_of(f["title"], f["text"], both, label)))


def matter_of(low_title: Column, low_text: Column, both: Column, label) -> Column:
    row = lambda kind, score, low: F.struct(F.lit(kind).alias("kind"), F.lit(score).alias("score"), F.lit(low).alias("low_value"))
    out = F.when(low_title.isin("contents", "table of contents"), row("contents", 0.98, True))
    for kind, score, phrases in C.FRONT_MATTER:
        out = out.when(contains_any(both, phrases), row(kind, score, True))
    out = out.when(low_title.isin("references", "bibliography"), row("references", 0.78, True))
    first = page_number(label)
    return out.when((first <= 2) & contains_any(low_text, C.TITLE_PAGE_CUES), row("title_page", 0.68, False)).otherwise(row("body", 0.0, False))


def chunk_role(text) -> Column:
    """(role, score): what a chunk is good for as evidence."""
    return let(strip(text), lambda t: let(lines(t), lambda own: role_of(t, own)))


def role_of(text: Column, own: Column) -> Column:
    """A chunk's role from its text and its lines."""
    return let(F.lower(text), lambda low: role_by(text, own, low))


def role_by(text: Column, own: Column, low: Column) -> Column:
    n = F.size(own)
    closed = text.rlike(r"[A-Za-z][.!?](?:\s|$)")
    leaders = text.rlike(r"(?m)\.{4,}\s*\d+$") | F.exists(own, lambda x: x.rlike(r"\.{3,}\s*\d+$"))
    contents = contains_any(low, ("table of contents", "list of figures", "list of tables")) | low.startswith("contents")
    row = lambda role, score: F.struct(F.lit(role).alias("role"), F.lit(score).alias("score"))
    # Only short chunks can be headings, so only their lines are looked at.
    heads = F.when((F.length(text) <= 180) & ~closed, F.size(F.filter(own, is_heading_line))).otherwise(0)
    stub = let(heads, lambda h: F.when((n <= 3) & (h >= F.greatest(F.lit(1), n - 1)), 0.12).when((F.length(text) <= 120) & (h >= 1), 0.18))
    return (
        F.when(text == "", row("navigation_like", 0.0))
        .when(contents | leaders, row("navigation_like", 0.02))
        .when(contains_any(low, ("doi", "available in pmc", "author manuscript", "et al.", "vol.", "pmid", "pmcid")), row("reference_like", 0.08))
        .when((digit_ratio(text) > 0.18) & (n <= 8) & ~closed, row("table_fragment", 0.22))
        .otherwise(let(stub, lambda s: F.when(s.isNotNull(), F.struct(F.lit("heading_stub").alias("role"), s.alias("score"))).otherwise(row("body", 0.88))))
    )


def low_value_prior(body_score, matter_score, low_value) -> Column:
    return F.greatest(1.0 - col(body_score), F.when(col(low_value), col(matter_score)).otherwise(col(matter_score) * 0.55))


def is_low_value_text(text) -> Column:
    text = col(text)
    low = F.lower(text)
    return contains_any(low, C.LOW_VALUE_PHRASES) | low.rlike(r"\bextended data (fig|figure|table)") | text.rlike(r"\.{10,}") | (F.contains(low, F.lit(".pdf")) & low.rlike(r"\p{Nd}"))


def region_kind(heading, text) -> Column:
    """Kind of a region from what its headings say and how its text looks."""
    low, text = F.lower(col(heading)), col(text)
    head = F.left(text, F.lit(1200))
    numeric = digit_ratio(F.left(text, F.lit(1500)))
    table = (count_of(head, r"[|]|\t") + count_of(F.lower(head), "table ")) / F.greatest(F.length(head), F.lit(1))
    scores = []
    for kind, keywords in C.REGION_KEYWORDS:
        s = sum((F.when(F.contains(low, F.lit(k)), 1.0).otherwise(0.0) for k in keywords), F.lit(0.0))
        if kind == "evidence":
            s = s + F.when(numeric > 0.05, 1.5).otherwise(0.0) + F.when(table > 0.003, 1.0).otherwise(0.0)
        if kind == "appendix":
            s = s + F.when(F.contains(low, F.lit("reference")), 1.5).otherwise(0.0)
        scores.append(s)
    best = F.greatest(*scores)
    out = F.when(best <= 0, "general")
    for (kind, _), s in zip(C.REGION_KEYWORDS, scores):
        out = out.when(s == best, kind)
    return out


def section_role(heading, summary, matter_kind) -> Column:
    """(role, confidence) of a section."""
    low, brief = F.lower(col(heading)), F.lower(F.left(col(summary), F.lit(500)))
    scores = []
    for role, keywords in C.ROLE_KEYWORDS:
        s = sum((F.when(F.contains(low, F.lit(k)), 2.0).otherwise(0.0) + F.when(F.contains(brief, F.lit(k)), 0.5).otherwise(0.0) for k in keywords), F.lit(0.0))
        scores.append(F.greatest(s, F.when(col(matter_kind) != "body", 1.0).otherwise(0.0)) if role == "appendix" else s)
    best, total = F.greatest(*scores), sum(scores, F.lit(0.0))
    out = F.when(best <= 0, "general")
    for (role, _), s in zip(C.ROLE_KEYWORDS, scores):
        out = out.when(s == best, role)
    confidence = F.when(best <= 0, 0.35).otherwise(F.least(F.lit(0.95), 0.45 + best / F.greatest(total, F.lit(1.0)) * 0.5))
    return F.struct(out.alias("role"), confidence.alias("confidence"))


def is_noisy_title(title) -> Column:
    return contains_any(F.lower(col(title)), C.NOISY_TITLE_PHRASES)


def header_signature(title) -> Column:
    x = F.replace(F.lower(squash(title)), F.lit("…"), F.lit(" "))
    x = F.regexp_replace(F.regexp_replace(x, r"\bpage\s+\d+\b", " "), r"\b\d+\b", " ")
    return strip_of(squash(x), " .,:;|-")


def is_header_title(title) -> Column:
    low = F.lower(squash(title))
    return is_noisy_title(title) | (count_of(low, ",") >= 3) | low.rlike(r"^\d+\s+[a-z]") | low.rlike(r"\bgeneration\s+\d+\b") | ((F.length(header_signature(title)) >= 28) & low.rlike(r"\p{Nd}"))
