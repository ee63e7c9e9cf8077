from pyspark.sql import functions as F

from basalt.llm import quality_rules as q

SCHEMA = "doc_id long, text string, n_words string"


def test_edges(spark):
    good = " ".join(f"word{i}" for i in range(30))
    eight = "a b c d e f g h"
    rows = [(1, None, "x"), (2, "", "x"), (3, good, "x"), (3, good, "x"), (4, f"{eight} {eight} " + good, "x"), (5, "l one\nl one\n\n  \nl two", "x"), (6, "é#ü $", "x"), (7, good + " " + "x" * 300_000, "x")]
    got = {r.doc_id: r for r in q.apply_policy(q.ledger(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert (got[1].n_words, got[1].base_failed, got[1].kept) == (0, True, False) and got[2].n_words == 0
    assert got[3].kept and not got[3].base_failed
    assert got[4].n_repeat_words == 16 and got[4].base_failed
    assert got[5].n_dup_lines == 1 and got[5].n_words == 6
    assert (got[6].word_chars, got[6].n_symbols) == (4, 2)
    assert got[7].n_words == 31 and got[7].base_failed is False and got[7].kept is False
    assert q.ledger(spark.createDataFrame(rows, SCHEMA)).count() == len(rows)


def test_empty_and_ablations(spark):
    led = q.ledger(spark.createDataFrame([], SCHEMA))
    assert led.count() == 0 and q.ablations(led).count() == 0
    led = spark.createDataFrame([(1, 1), (2, 3), (3, 0), (4, 2)], "doc_id long, failed_bits long")
    got = {r.rule: r for r in q.ablations(led).collect()}
    assert (got["few_words"].n_failed, got["few_words"].n_only, got["few_words"].n_kept_without) == (2, 1, 2)
    assert led.filter(F.col("failed_bits") == 0).count() == 1
