import hashlib
import random

import duckdb
from helpers import by_id, no_documents, odd_documents
from pyspark.sql import functions as F

from stagelens.llm.line_dedup import KEY, LineRuns, kept_lines, keyed_lines, without_repeated_lines
from stagelens.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def kept_by_brute_force(rows, least_length=20, least_documents=3):
    """(id, kept text, lines, dropped) for rows (id, text); a null id is below all others."""
    order = lambda i: (i is not None, i)
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= least_length:
                holders.setdefault(key_of(line), set()).add((i, text))
    owner = {k: max((i for i, _ in held), key=order) for k, held in holders.items() if len(held) >= least_documents}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if owner.get(key_of(line), i) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def shared_lines(seed, documents=120):
    rnd = random.Random(seed)
    pool = [" ".join(rnd.choice(["alpha", "Beta", "gamma", "délta"]) for _ in range(rnd.randint(1, 7))) for _ in range(60)]
    rows = []
    for i in range(documents):
        lines = [rnd.choice(["", " ", "\t"]) + rnd.choice(pool) + rnd.choice(["", "\r", " \x0b"]) for _ in range(rnd.randint(0, 9))]
        lines += [f"a line of its own, number {i}"] + ["the very same line in all documents"] * rnd.randint(0, 2)
        rnd.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    return rows


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_kept_lines_by_brute_force(spark):
    rows = shared_lines(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = kept_by_brute_force(rows)
    assert sum(r[3] for r in want) > 100
    assert collected(kept_lines(docs)) == want
    # neither the number of batches nor how runs are compacted changes the result
    assert collected(kept_lines(docs.repartition(3), batches=5, fanout=2)) == want
    assert collected(kept_lines(docs, least_length=5, least_documents=2, batches=3)) == kept_by_brute_force(rows, 5, 2)


def test_query_equals_sql(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = {r[0]: [r] for r in duck.execute(QUERIES["op13_drop_lines"].sql).fetchall()}
    assert by_id(QUERIES["op13_drop_lines"].run(spark, sf)) == want


def test_runs_hold_every_key_once(spark):
    docs = spark.createDataFrame(shared_lines(2), "doc_id long, text string")
    lines = keyed_lines(docs, "text", "doc_id", 5).withColumn("batch", F.col("id") % 7)
    runs = LineRuns(spark, 3, fanout=3)
    seen = set()
    for batch in range(7):
        mine = lines.filter(F.col("batch") == batch)
        keys = {tuple(r) for r in mine.select(*KEY).collect()}
        assert {(r["h1"], r["h2"]) for r in runs.add(mine).collect()} == keys - seen
        seen |= keys
    assert [len(level) for level in runs.levels["first"]] == [1, 2]
    stored = [(r["h1"], r["h2"]) for run in runs.runs("first") for r in run.collect()]
    assert len(stored) == len(set(stored)) and set(stored) == seen
    per_key = lines.groupBy(*KEY).agg(F.countDistinct("id").alias("n_documents"), F.max("id").alias("top"))
    assert collected(runs.totals()) == collected(per_key)
    # a batch meets a run bucket by bucket: the run is not shuffled
    own, run = spark.table(runs.levels["first"][0][0]), spark.table(runs.levels["first"][1][0])
    plan = own.join(run.hint("merge"), KEY, "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert collected(kept_lines(docs, batches=2)) == kept_by_brute_force(rows)
    assert kept_lines(no_documents(spark), batches=2).collect() == []
    cut = without_repeated_lines(docs, batches=1)
    assert cut.columns == docs.columns and cut.count() == len(rows)


def test_null_and_repeated_ids(spark):
    line = "a line of more than twenty letters"
    rows = [(None, line + "\nx"), (None, line), (1, line), (2, line.upper()), (2, line + "\nother"), (2, line + "\nother")]
    rows += [(None, "only documents without ids " + c) for c in "abc"] + [(None, f"nobody knows our numbers at all\n{c}") for c in "abc"]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collected(kept_lines(docs, batches=2))
    assert got == kept_by_brute_force(rows)
    assert (2, line.upper(), 1, 0) in got and (1, "", 1, 1) in got
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    assert collected(kept_lines(named, batches=2)) == kept_by_brute_force([(None if i is None else f"d{i}", t) for i, t in rows])


def test_very_long_text(spark):
    lines = [f"line number {i} of a very long document" for i in range(60_000)]
    rows = [(i, "\n".join(lines[i:])) for i in range(3)] + [(3, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], hashlib.md5(r["text"].encode()).hexdigest()) for r in kept_lines(docs, batches=2).collect()}
    want = {i: (n, d, hashlib.md5(t.encode()).hexdigest()) for i, t, n, d in kept_by_brute_force(rows)}
    assert got == want
