"""Physical plan text: cleaning for reading, operator flags for rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plan line is kept when it holds one of these marks.
LINE_MARKS = ("+-", ":", "(", "*", "==")
# for display only: rules read the uncut text
MAX_LINES = 50

# What counts as white space at the ends of a line.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# flag name -> node name as it stands in a plan
NODES = {
    "has_sort_merge_join": "SortMergeJoin",
    "has_broadcast_hash_join": "BroadcastHashJoin",
    "has_nested_loop_join": "BroadcastNestedLoopJoin",
    "has_cartesian": "CartesianProduct",
    "has_exchange": "Exchange",
    "has_single_partition": "SinglePartition",
    "has_window": "Window",
    "has_batch_python": "BatchEvalPython",
    "has_arrow_python": "ArrowEvalPython",
    "has_generate": "Generate",
    "has_sort": "Sort",
}


def first_plan(*candidates: Column) -> Column:
    """First non-empty plan text, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit(""))


def drop_codegen_ids(text: Column) -> Column:
    return F.regexp_replace(text, r"\[codegen id : \d+\]", "")


def mask_expression_ids(text: Column) -> Column:
    return F.regexp_replace(text, r"#\d+", "#ID")


# from the first opening bracket of a piece: three items, then at least two more, then the last one
_LONG_LIST = r"(?s)^([^\[]*+\[.*?, .*?, .*?), .*?, .*, (.*)$"


def _short_lists_of_line(line: Column) -> Column:
    """Cut at closing brackets; what stands after the first opening one of a piece is a list. The last piece is not closed."""

    def of(pieces: Column) -> Column:
        closed = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
        short = F.transform(closed, lambda piece: F.regexp_replace(piece, _LONG_LIST, "$1, ..., $2"))
        return F.array_join(F.concat(short, F.slice(pieces, -1, 1)), "]")

    # the array of one binds the pieces, so that a line is split once
    short = F.element_at(F.transform(F.array(F.split(line, "]", -1)), of), 1)
    return F.when(F.contains(line, F.lit("]")), short).otherwise(line)


def shorten_lists(text: Column) -> Column:
    """Bracketed lists of more than five items keep the first three and the last.

    Lists end on their line. Each piece of a line is matched once from its start,
    so the work grows with the text, and no pattern repeats a group.
    """
    return F.array_join(F.transform(F.split(text, "\n", -1), _short_lists_of_line), "\n")


def _stripped(line: Column) -> Column:
    """Without white space at the ends; the costly search for rare kinds only where one stands there after blanks are gone."""
    blanks, rare = F.trim(line), F.lit(WHITESPACE.replace(" ", ""))
    ends = F.contains(rare, F.substring(blanks, 1, 1)) | F.contains(rare, F.substring(blanks, -1, 1))
    return F.when(ends, F.btrim(line, F.lit(WHITESPACE))).otherwise(blanks)


def keep_plan_lines(text: Column) -> Column:
    """Marked lines only, stripped, the first fifty."""

    def marked(line: Column) -> Column:
        hit = F.lit(False)
        for mark in LINE_MARKS:
            hit = hit | line.contains(mark)
        return hit

    lines = F.slice(F.filter(F.split(text, "\n"), marked), 1, MAX_LINES)
    return F.array_join(F.transform(lines, _stripped), "\n")


def clean_plan(text: Column) -> Column:
    """Readable plan: no codegen or expression ids, short lists, tree lines only."""
    text = F.coalesce(text, F.lit(""))
    return keep_plan_lines(shorten_lists(mask_expression_ids(drop_codegen_ids(text))))


_FINAL, _INITIAL = "== Final Plan ==", "== Initial Plan =="


def ran_plan(text: Column) -> Column:
    """The part of an uncut plan that ran: without initial plans and without details of nodes that only they have.

    An initial plan goes to the next blank line. A section of details, "(12) Sort"
    and what follows it up to a blank line, stays if a tree line ends in its number.
    """
    text = F.coalesce(text, F.lit(""))
    parts = F.split(text, _INITIAL, -1)
    after = F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda part: F.when(F.instr(part, "\n\n") > 0, F.substr(part, F.instr(part, "\n\n"))).otherwise(F.lit("")),
    )
    final = F.concat(F.element_at(parts, 1), F.array_join(after, ""))
    sections = F.split(final, "\n\n", -1)
    is_detail = lambda section: section.rlike(r"^\s*\(\d+\) ")
    trees = F.array_join(F.filter(sections, lambda section: ~is_detail(section)), "\n\n")
    ids = F.regexp_extract_all(trees, F.lit(r"(?m)\((\d+)\) *$"), 1)
    number = lambda section: F.regexp_extract(section, r"^\s*\((\d+)\) ", 1)
    kept = F.filter(sections, lambda section: ~is_detail(section) | F.array_contains(ids, number(section)))
    return F.array_join(kept, "\n\n")


# Nodes with one child that leave rows where they are, as they may stand between a window and its exchange.
_PASSING = "Sort|Project|Filter|AQEShuffleRead|CustomShuffleReader|ShuffleQueryStage|InputAdapter|WholeStageCodegen|WindowGroupLimit|Window"


def has_unpartitioned_window(ran: Column) -> Column:
    """Does a window take its rows from an exchange into a single partition?

    Told from the tree: each node between stands on the line below its parent.
    The exchange names its partitioning on its own line, or in its details.
    """
    sections = F.filter(
        F.split(ran, "\n\n", -1), lambda s: s.rlike(r"^\s*\(\d+\) Exchange") & F.contains(s, F.lit("Arguments: SinglePartition"))
    )
    singles = F.transform(sections, lambda s: F.regexp_extract(s, r"^\s*\((\d+)\) ", 1))

    def mark(line: Column) -> Column:
        name = F.regexp_extract(line, r"^[\s:+\-*()\d]*([A-Za-z]\w*)", 1)
        number = F.regexp_extract(line, r"\((\d+)\) *$", 1)
        single = (name == "Exchange") & (F.contains(line, F.lit("SinglePartition")) | F.array_contains(singles, number))
        passing = F.lit(f"|{_PASSING}|").contains(F.concat(F.lit("|"), name, F.lit("|")))
        return F.when(single, "x").when(name == "Window", "w").when(passing, "p").otherwise("-")

    # the lines are only looked at where there may be a window
    may = ran.contains("Window")
    return F.when(may, F.array_join(F.transform(F.split(ran, "\n", -1), mark), "").rlike("w[wp]*x")).otherwise(may)


def plan_flags(text: Column) -> Column:
    """One boolean per plan operator the rules ask about, from the uncut text of a plan, as far as it ran."""
    ran = ran_plan(text)
    return F.struct(
        *[ran.rlike(rf"\b{node}\b").alias(flag) for flag, node in NODES.items()],
        has_unpartitioned_window(ran).alias("has_unpartitioned_window"),
    )


def plan_node_count(text: Column, node: str) -> Column:
    """How often a plan operator occurs."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(rf"\b{node}\b"))


FLAGS = (*NODES, "has_unpartitioned_window")
