"""Scans through groups cut in many ranges, against plain loops."""

import random

from pyspark.sql import functions as F

from lodestone.operators import chunking, structure
from lodestone.operators.scan import play, ranged

SCHEMA = "g string, n int, v string, c int, events array<struct<cut: int, value: string>>, _x int"


def made(seed: int, sizes: dict) -> list:
    pick = random.Random(seed)
    event = lambda: (pick.choice([0, 1, 1, 2, 2, 3, 5, 9, None]), pick.choice(["a", "b", "c", None]))
    rows = []
    for g, size in sizes.items():
        for n in range(size):
            rows.append((g, n if n else None, pick.choice(["x", "y", "", None, None, None]), pick.choice([1, 2, -1, None]), pick.choice([None, [], [event()], [event(), event(), event()]]), 7))
    pick.shuffle(rows)
    return rows


def plain(rows: list) -> dict:
    out, state = {}, {}
    for g, n, v, c, events, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] or 0)):
        last, total, stack = state.get(g, (None, 0, []))
        before, was = last, total
        last, total = last if v is None else v, total + (c or 0)
        for cut, value in events or ():
            stack = stack[: cut or 0] + [value]
        state[g] = last, total, stack
        out[g, n] = before, last, total, was, stack
    return out


def scanned(r):
    r = r.last({"before": F.col("v")}).last({"so_far": F.col("v")}, own=True).sums({"total": F.col("c")}).sums({"was": F.col("c")}, own=False).stacks("path", F.col("events"))
    assert r.rows.columns == ["g", "n", "v", "c", "events", "_x", "_range", "before", "so_far", "total", "was", "path"]
    return {(x.g, x.n): (x.before, x.so_far, x.total, x.was, x.path) for x in r.rows.collect()}


def test_scans(spark):
    rows = made(1, {"big": 400, "mid": 40, None: 60, "one": 1, "": 2, **{f"k{i}": 3 for i in range(20)}})
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    r = ranged(table, ["g"], ["n"], ranges=13)
    assert r.rows.where("g = 'big'").select("_range").distinct().count() > 5  # one group, many tasks
    assert r.rows.where("g IS NULL").select("_range").distinct().count() > 1
    assert r.shared.count() <= 26
    assert scanned(r) == plain(rows)


def test_one_group_of_all_rows_and_none(spark):
    rows = made(2, {"g": 500})
    assert scanned(ranged(spark.createDataFrame(rows, SCHEMA), ["g"], ["n"], ranges=9)) == plain(rows)
    assert scanned(ranged(spark.createDataFrame([], SCHEMA), ["g"], ["n"], ranges=3)) == {}


def test_summaries_merge_in_any_grouping():
    """The events that stay on an empty stack do for all of them, on any stack."""
    pick = random.Random(3)
    for _ in range(2000):
        events = [{"cut": pick.randrange(5), "value": i} for i in range(pick.randrange(12))]
        whole = [{"cut": 0, "value": -1 - i} for i in range(pick.randrange(6))]
        short, parts, at = list(whole), [], pick.randrange(len(events) + 1)
        for part in (events[:at], events[at:]):
            kept: list = []
            play(kept, part)
            assert len(kept) <= 5
            play(parts, kept)
        play(whole, events)
        play(short, parts)
        assert whole == short


def test_long_document(spark):
    """A document of 3,000 pages, in many ranges: paths, clauses and chunk numbers go through it whole."""
    pick = random.Random(4)
    heads = ["References", "1.1 Study Design", "1.2.1 Outcome Measures", "2.1.3.4 Dose Levels", "3.1 Follow Up", "", "", ""]
    taken = [pick.choice(heads) for _ in range(3000)]
    text = lambda h: (h + "\n" if h else "") + "the patients in this group were seen again after some weeks."
    rows = [("long", i, f"Page {i + 1}", text(h), "") for i, h in enumerate(taken)] + [("short", 0, "Page 1", text("References"), "")]
    table = spark.createDataFrame(rows, "document_id string, page_no int, page_label string, text string, section_heading string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        found = structure.enrich_pages(table).collect()
        got = {(r.document_id, r.page_no): (r.section_heading, r.section_path, r.clause_ids) for r in found}
        chunks = chunking.chunk_pages(table.withColumn("section_kind", F.lit("general"))).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    path, clauses, heading, want = [], [], "", {}
    for i, h in enumerate(taken):
        number, _, title = h.partition(" ") if h[:1].isdigit() else ("", "", h)
        if h:
            parts = number.count(".") + 1
            path = (path[: max(parts - 2, 0)] if number else []) + [title]
            heading = title
        if number:
            clauses = clauses[: parts - 1] + [number]
        want[i] = heading, path, [number] if number else clauses[-2:]
    first = next(i for i, h in enumerate(taken) if h)
    assert first < 100 and {i: got["long", i] for i in range(first, 3000)} == {i: w for i, w in want.items() if i >= first}
    assert got["short", 0][:2] == ("References", ["References"])
    numbers = sorted((r.page_no, r.chunk_index) for r in chunks if r.document_id == "long")
    assert [n for _, n in numbers] == list(range(len(numbers))) and len(numbers) >= 3000
