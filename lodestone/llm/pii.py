r"""PII (DataFrame functions only): patterns propose, validators confirm, context adjusts.

Each kind has a pattern; its matches are found left to right without overlap.
Kinds `email`, `ip`, `card` and `phone` are the base: a match stays if its
validator holds (parts of an address, Luhn's sum, the number of digits). Kinds
`iban` (remainder modulo 97) and `ssn` come on top. A span's score starts from
its kind's and rises with words near it that speak of that kind; a span is
reported from `threshold` on. Base kinds start above it, so context only ranks
them; `ssn`, which has no checksum, starts below.

The patterns are written without backtracking: a run of characters is entered
at its start only (or where the match before ended, \G), and its quantifiers
are possessive where what follows cannot match inside. They find the same
matches as the plain ones, in time that grows with the text, whatever it holds.

Places come from the lengths of the pieces between matches, summed by a window
over the matches of a document; so time and memory of a task grow with the
matches, also in one very long text. Rows shuffle as matches, not as texts.

Defined results: a null or empty text has no spans; places count code points,
the end exclusive; rows with equal identifiers are separate documents; other
columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import whole_text

LOCAL = r"[A-Za-z0-9._%+-]"
#: kind -> pattern, the score to start from, words that speak of it. The order is that of equal starts.
KINDS = {
    "email": (rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.8, "mail|contact|write|reply"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, r"\bip\b|address|host|server|login"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", 0.7, "card|visa|credit|debit|payment"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|call|tel|mobile|fax"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", 0.8, "iban|bank|account|transfer"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, r"\bssn\b|social|security"),
}
BASE = ("email", "ip", "card", "phone")
#: Characters before and after a span in which words count, and what they add.
BEFORE, AFTER, BONUS = 48, 24, 0.2
#: What a text must contain for a kind's pattern to be tried at all.
NEEDS = {"email": "@", "phone": "+", "ssn": "-"}


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def sum_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def luhn(digits: Column) -> Column:
    """Does Luhn's sum of a string of digits end in 0?"""
    back = F.reverse(digits)

    def worth(i):
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return sum_of(F.transform(F.sequence(F.lit(1), F.length(digits)), worth)) % 10 == 0


def mod97(text: Column) -> Column:
    """Is an account number's remainder 1, letters counting 10 to 35 and its head at the end?"""
    bare = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.left(bare, F.lit(4)))
    worth = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.conv(F.substring(turned, i, F.lit(1)), 36, 10).cast("int"))
    return F.aggregate(worth, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97) == 1


def octets(text: Column) -> Column:
    part = lambda x: F.regexp_replace(x, "^0+", "")
    return F.forall(F.split(text, r"\."), lambda x: (F.length(part(x)) < 3) | (F.length(part(x)) == 3) & (part(x).cast("int") <= 255))


def confirmed(kind: Column, text: Column) -> Column:
    digits = digits_of(text)
    return (
        F.when(kind == "ip", octets(text))
        .when(kind == "card", F.length(digits).between(12, 19) & luhn(F.left(digits, F.lit(19))))
        .when(kind == "phone", F.length(digits).between(9, 15))
        .when(kind == "iban", mod97(text))
        .otherwise(F.lit(True))
    )


def proposals(text: Column, kind: str) -> Column:
    """(rank, place in order, length of the piece before, match, text around) of each match of a kind."""
    pattern, _, _ = KINDS[kind]
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    rows = F.transform(
        F.arrays_zip(F.slice(pieces, 1, F.greatest(F.size(found), F.lit(0))).alias("p"), found.alias("m"), F.slice(pieces, 2, F.greatest(F.size(found), F.lit(1))).alias("q")),
        lambda x, i: F.struct(
            F.lit(list(KINDS).index(kind)).alias("rank"),
            i.alias("at"),
            F.length(x["p"]).alias("gap"),
            x["m"].alias("text"),
            F.lower(F.concat(F.right(x["p"], F.lit(BEFORE)), F.lit("\n"), F.left(x["q"], F.lit(AFTER)))).alias("around"),
        ),
    )
    none = F.expr("CAST(array() AS array<struct<rank:int,at:int,gap:int,text:string,around:string>>)")
    tried = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)
    return F.when(tried & F.regexp_like(text, F.lit(pattern)), rows).otherwise(none)


def find_pii(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row for each document: doc_id, found (array of kind, start, end, score, text)."""
    names = list(KINDS)
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), whole_text().alias("_text"))
    rows = rows.select("doc_id", "_row", F.explode_outer(F.concat(*[proposals(F.col("_text"), k) for k in names])).alias("x")).select("doc_id", "_row", "x.*")
    inside = W.partitionBy("_row", "rank").orderBy("at")
    end = F.sum(F.col("gap") + F.length("text")).over(inside)
    by_rank = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("rank") + 1)
    near = F.regexp_like(F.col("around"), by_rank([KINDS[k][2] for k in names]))
    rows = rows.withColumn("end", end)
    rows = (
        rows.withColumn("kind", by_rank(names))
        .withColumn("score", by_rank([KINDS[k][1] for k in names]) + F.when(near, BONUS).otherwise(0.0))
        .withColumn("good", (F.col("score") >= threshold) & confirmed(F.col("kind"), F.col("text")))
    )
    span = F.struct((F.col("end") - F.length("text")).alias("start"), "rank", "kind", "end", "score", "text")
    gathered = rows.groupBy("_row", "doc_id").agg(F.collect_list(F.when(F.col("good"), span)).alias("found"))
    return gathered.select("doc_id", F.transform(F.array_sort("found"), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score"), x["text"].alias("text"))).alias("found"))


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts of the base kinds and the digests of the spans."""
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))

    def number(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[number(k) for k in BASE], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("found")).alias("spans"))
