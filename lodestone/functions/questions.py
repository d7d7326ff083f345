"""Column functions on questions: what is asked, the plan for it, and signals of an answer."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import constants as C
from .text import col, contains_any, content_overlap, significant_terms, squash, strip_of

MARKS = " .,:;?!\"'"


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def asks(question) -> dict[str, Column]:
    """What the question's phrases ask for; each a boolean."""
    q = F.lower(col(question))
    summary = contains_any(q, C.SUMMARY_CUES)
    detail = contains_any(q, C.DETAIL_CUES) | q.rlike(r"\bwhat\b.*\b(features?|variables?|inputs?|signals?|factors?)\b.*\bused\b")
    page, clause = q.rlike(r"\bpages?\s+\d+\b"), F.size(clause_terms(question)) > 0
    section = F.size(named_sections(question)) > 0
    return {
        "summary": summary,
        "detail": detail,
        "definition": ~summary & contains_any(q, C.DEFINITION_CUES),
        "process": ~summary & (contains_any(q, C.PROCESS_CUES) | detail),
        "numeric": contains_any(q, C.NUMERIC_CUES),
        "table": contains_any(q, C.TABLE_CUES),
        "front_matter": contains_any(q, C.FRONT_MATTER_CUES),
        "footnote": contains_any(q, C.FOOTNOTE_CUES),
        "bibliography": contains_any(q, C.BIBLIOGRAPHY_CUES),
        "comparison": contains_any(q, C.COMPARISON_CUES),
        "distributed": contains_any(q, C.DISTRIBUTED_CUES) | q.rlike(r"\bwhat\b.*\b[a-z0-9_-]{3,}s\b.*\bapply\b"),
        "global_summary": summary & contains_any(q, C.GLOBAL_SUMMARY_CUES),
        "page": page,
        "clause": clause,
        "section": section | contains_any(q, C.EXPLICIT_SECTION_CUES),
        "constraint": page | clause | section,
        "conclude": F.contains(q, F.lit(C.CONCLUDE_CUE)),
    }


def quoted_terms(question) -> Column:
    return extract(col(question), '"([^"]+)"')


def clause_terms(question) -> Column:
    return extract(col(question), r"(?i)(?:clause|section)\s+(\d+(?:\.\d+)+)")


def named_sections(question) -> Column:
    return F.concat(quoted_terms(question), extract(col(question), r"(?i)(?:section|chapter)\s+([A-Za-z][A-Za-z0-9 ._-]*)"))


def page_labels(question) -> Column:
    return F.transform(extract(F.lower(col(question)), r"\bpages?\s+(\d+)\b"), lambda x: F.concat(F.lit("Page "), x))


def section_filter(question) -> Column:
    """Sections a question names, cut at the first question word; generic names only if there is no other."""
    inside = extract(col(question), r"(?i)\bin the\s+([A-Za-z][A-Za-z0-9 ._-]*?)\s+(?:what|which|how|why|when|where|tell|summarize|explain|describe|is|are|was|were|does|do|did)\b")

    def tidy(x):
        head = F.get(F.split(squash(strip_of(x, MARKS)), r"(?i)\b(?:what|which|how|why|when|where|tell|summarize|explain|describe)\b", 2), F.lit(0))
        return strip_of(head, MARKS)

    terms = F.filter(F.transform(F.concat(named_sections(question), inside), tidy), lambda x: x != "")
    special = F.filter(terms, lambda x: ~F.lower(x).isin(*C.GENERIC_SECTION_TERMS))
    return F.array_distinct(F.when(F.size(special) > 0, special).otherwise(terms))


def profile(question) -> Column:
    """query_type, intent_type, evidence_spread, preferred content types and the flags."""
    a = asks(question)
    intent = F.when(a["comparison"], "comparison").when(a["summary"], "summary").when(a["process"], "procedure").when(a["numeric"], "numeric").when(a["distributed"], "cross_cutting").otherwise("lookup")
    spread = (
        F.when(a["page"] | a["clause"], "atomic")
        .when((intent == "summary") & (a["global_summary"] | a["conclude"]), "global")
        .when(intent.isin("comparison", "cross_cutting") | a["distributed"], "distributed")
        .when(intent.isin("summary", "numeric", "procedure") | a["section"], "sectional")
        .otherwise("atomic")
    )
    kind = (
        F.when(intent == "summary", "summary_lookup")
        .when(a["definition"], "definition_lookup")
        .when(intent == "procedure", "process_lookup")
        .when(intent == "numeric", "numeric_lookup")
        .when(intent == "comparison", "comparison_lookup")
        .when(intent == "cross_cutting", "cross_cutting_lookup")
        .otherwise("general_lookup")
    )
    text = lambda *names: F.array(*[F.lit(n) for n in names])
    artifacts = F.filter(
        F.array(
            F.when(a["table"] | a["numeric"], "table"),
            F.when(a["front_matter"], "front_matter"),
            F.when(a["footnote"], "footnote"),
            F.when(a["bibliography"], "bibliography"),
        ),
        lambda x: x.isNotNull(),
    )
    body = (
        F.when(a["definition"], text("definition", "general"))
        .when(a["process"], text("methodology", "general", "results"))
        .when(a["numeric"], text("results", "general"))
        .when(intent == "summary", text("general", "results"))
        .when(intent.isin("comparison", "cross_cutting"), text("general", "definition", "results"))
        .otherwise(text("general", "definition"))
    )
    flags = [a[k].alias("asks_" + k) for k in ("definition", "process", "numeric", "comparison", "detail")]
    return F.struct(kind.alias("query_type"), intent.alias("intent_type"), spread.alias("evidence_spread"), F.concat(artifacts, body).alias("content_types"), *flags, a["constraint"].alias("explicit"))


def target_regions(p: Column) -> Column:
    text = lambda *names: F.array(*[F.lit(n) for n in names])
    intent = p["intent_type"]
    return (
        F.when(p["explicit"], F.expr("CAST(array() AS array<string>)"))
        .when(p["asks_definition"], text("definitions", "general"))
        .when(intent == "procedure", text("procedure", "evidence", "general"))
        .when(intent == "numeric", text("evidence", "discussion", "general"))
        .when(intent == "comparison", text("evidence", "discussion", "overview"))
        .when(intent == "summary", text("overview", "discussion", "evidence"))
        .when(intent == "cross_cutting", text("rules", "discussion", "evidence", "general"))
        .otherwise(text("general", "rules", "definitions"))
    )


def constraint_mode(question, p: Column) -> Column:
    filtered = (F.size(page_labels(question)) + F.size(clause_terms(question)) + F.size(section_filter(question))) > 0
    return F.when(filtered, "hard_region").when(p["evidence_spread"] == "sectional", "soft_local").when(p["evidence_spread"].isin("distributed", "global"), "soft_multi_region").otherwise("none")


def preferred_route(mode: Column, p: Column) -> Column:
    return (
        F.when((mode == "hard_region") | (p["evidence_spread"] == "atomic"), "chunk_first")
        .when((p["intent_type"] == "procedure") & p["asks_detail"], "hybrid_both")
        .otherwise("synopsis_first")
    )


def plan_confidence(question, mode: Column, p: Column, has_targets: Column) -> Column:
    spread = p["evidence_spread"]
    start = F.when(mode == "hard_region", 0.92).when(spread == "atomic", 0.86).when(spread == "global", 0.78).when(spread == "sectional", 0.74).otherwise(0.66)
    soft = F.when(mode.isin("soft_local", "soft_multi_region") & ~has_targets, 0.08).otherwise(0.0)
    named = F.when((F.size(section_filter(question)) > 0) & ~has_targets, 0.08).otherwise(0.0)
    return F.greatest(start - soft - named, F.lit(0.0))


# Phrases that favour chunks or synopses.
CHUNK_HINTS = ("clause ", "define", "exact", "page ", "quote", "what is", "what does")
SYNOPSIS_HINTS = (
    "future work", "key takeaway", "main conclusion", "main focus", "overview", "summary", "summarize", "what did the thesis conclude",
    "what does the paper say about",
)


def route(question, p: Column) -> Column:
    """(route, confidence) without a model."""
    q, spread = F.lower(col(question)), p["evidence_spread"]
    row = lambda name, c: F.struct(F.lit(name).alias("route"), (c if isinstance(c, Column) else F.lit(c)).alias("confidence"))
    return (
        F.when(p["explicit"] & contains_any(q, CHUNK_HINTS), row("chunk_first", 0.9))
        .when(spread == "atomic", row("chunk_first", 0.84))
        .when(spread == "global", row("synopsis_first", 0.84))
        .when(spread == "sectional", row("synopsis_first", F.when(contains_any(q, SYNOPSIS_HINTS), 0.78).otherwise(0.7)))
        .when(spread == "distributed", row("hybrid_both", 0.62))
        .otherwise(row("hybrid_both", 0.55))
    )


def has_term(terms: Column, words) -> Column:
    return F.arrays_overlap(terms, F.array(*[F.lit(w) for w in words]))


def summary_focus(question) -> Column:
    t = significant_terms(question)
    return F.when(has_term(t, C.FINDINGS_SUMMARY_TERMS), "findings").when(has_term(t, C.LATE_SUMMARY_TERMS), "late").when(has_term(t, C.EARLY_SUMMARY_TERMS), "overview").otherwise("balanced")


def definition_target(question) -> Column:
    """What the question wants defined, or empty."""
    q = F.lower(col(question))
    heads = (r"\bdefine\s+", r"\bdefinition of\s+", r"\bhow does .{0,80} define\s+")
    found = [F.nullif(strip_of(F.regexp_extract(q, h + r"(?:an?|the)?\s*([a-z][a-z0-9 -]{2,60})\??", 1), " ?."), F.lit("")) for h in heads]
    return F.coalesce(*found, F.lit(""))


def fact_signal(question, text, query_type) -> Column:
    """How much a text looks like it holds the fact asked for, 0.55 at most."""
    q, low, raw, kind = F.lower(col(question)), F.lower(col(text)), col(text), col(query_type)
    points = lambda test, n: F.when(test, n).otherwise(0.0)
    marker = low.rlike(r"\b(refers to|defined as|means|is an?|are)\b")
    target = definition_target(question)
    defines = kind == "definition_lookup"
    dated = low.rlike(r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s+\d{1,2}(?:[-–]\d{1,2})?,?\s+\d{4}\b") | low.rlike(r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b")
    who = q.rlike("^(?:who|which) ") | q.rlike(r"\b(author|director|member|supervisor|agency|program)\b")
    names = F.regexp_count(raw, F.lit(r"\b[A-Z][a-z]+(?:\s+[A-Z]\.)?(?:\s+[A-Z][a-z]+)+\b"))
    bodies = low.rlike(r"\b(agency|foundation|center|centre|institute|department|program|programme|award|grant)\b") | raw.rlike(r"\b[A-Z]{2,}(?:-[A-Z0-9]+)?\b")
    numeric = (kind == "numeric_lookup") | q.rlike(r"\b(how many|how much|rate|percent|amount|total|limit)\b")
    figure = low.rlike(r"(?:[$€£]\s*)?\b\d+(?:[.,]\d+)?\s*(?:%|percent|billion|million|trillion|gw|°c|degrees?)?\b")
    return F.least(
        F.lit(0.55),
        0.18 * content_overlap(question, text)
        + points(defines & marker, 0.12)
        + points(defines & marker & (target != "") & F.contains(low, target), 0.28)
        + points((q.startswith("when ") | F.contains(q, F.lit(" scheduled "))) & dated, 0.30)
        + points(who, 1.0) * (F.least(F.lit(0.18), 0.06 * names) + points(bodies, 0.12) + points(low.rlike(r"\b(voting|voted|dissent|dissented|against this action)\b"), 0.10))
        + points(numeric & figure, 0.22),
    )


def may_recover(p: Column) -> Column:
    """Is a second, wider search worth a try after an abstention?"""
    kind = p["query_type"]
    return ~kind.isin("summary_lookup", "comparison_lookup", "cross_cutting_lookup") & (kind.isin(*C.RECOVERY_QUERY_TYPES) | (p["evidence_spread"] == "atomic"))


# What an answer should dwell on, by phrases, in the order of the result.
FOCUS_CUES = (
    ("summary", ("summary", "summarize", "overview")),
    ("conclusions", ("conclusion", "conclusions", "takeaway", "takeaways")),
    ("findings", ("finding", "findings")),
    ("results", ("result", "results", "outcome", "outcomes")),
    ("limitations", ("challenge", "challenges", "limitation", "limitations", "constraint", "constraints")),
    ("methodology", ("methodology", "method", "methods")),
    ("implementation", ("implementation", "implemented")),
    ("recommendations", ("recommendation", "recommendations")),
)
# First questions by a document's style.
STARTERS = {
    "policy_document": (
        "What are the main exclusions or waiting periods in this policy?",
        "What obligations or deadlines should the insured person be aware of?",
        "How does the policy define key terms like grace period, cashless facility, or network provider?",
    ),
    "thesis_document": (
        "What is the main research aim of this thesis?",
        "What are the strongest findings or conclusions from this thesis?",
        "What future work or next steps does this thesis recommend?",
    ),
    "research_paper": (
        "What is the main focus of this paper?",
        "What are the most important findings or claims in this paper?",
        "What limitations, challenges, or future directions does this paper discuss?",
    ),
    "generic_longform": (
        "What are the key ideas or themes in this document?",
        "What important obligations, constraints, or conclusions does the document contain?",
        "What sections should I read first to understand the document quickly?",
    ),
}


def answer_focus(question) -> Column:
    q = F.lower(col(question))
    return F.filter(F.array(*[F.when(contains_any(q, phrases), name) for name, phrases in FOCUS_CUES]), lambda x: x.isNotNull())


def starters(style) -> Column:
    """First questions for a document; an unknown style gets the general ones."""
    out = F.lit(None).cast("array<string>")
    for name, asked in STARTERS.items():
        out = F.when(col(style) == name, F.array(*[F.lit(a) for a in asked])).otherwise(out)
    return F.coalesce(out, F.array(*[F.lit(a) for a in STARTERS["generic_longform"]]))
