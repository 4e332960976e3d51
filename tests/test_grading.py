"""Grading within a deadline and votes by graders that are not transitive, against plain Python."""

import random
import re
import time

import psutil
from pyspark.sql import functions as F

from millrace.functions.deadline import Deadline
from millrace.functions.grading import either_way
from millrace.operators import vote


def grader():
    """A function that workers get by value."""

    def endless(a, b):
        if a == "loop":
            re.match(r"(a|aa)+$", "a" * 200 + "b")
        if a == "sleep":
            time.sleep(60)
        if a == "fail":
            raise ValueError
        print("a grader may print")
        return b.startswith(a)

    return endless


endless = grader()


def test_deadline_holds():
    with Deadline(endless, 0.5) as timed:
        assert timed("a", "ab") == "True" and timed("b", "ab") == "False" and timed("fail", "") == "FAILED" and timed.started == 1
        for a in ("loop", "sleep"):
            began = time.monotonic()
            assert timed(a, "x") == "TIMED_OUT" and time.monotonic() - began < 1.0 and timed.process is None
            assert timed("a", "ab") == "True"
        assert timed.started == 3 and either_way(timed, "ab", "a") == "True" and either_way(timed, "b", "loop") == "TIMED_OUT"
        timed("a", "ab")
        last = timed.process.pid
    assert not psutil.pid_exists(last) and not [p for p in psutil.Process().children() if p.cmdline()[1:2] == ["-c"]]


def test_process_that_dies():
    with Deadline(lambda a: __import__("os")._exit(3), 5) as timed:
        assert [timed("x"), timed("x")] == ["FAILED", "FAILED"] and timed.started == 2


def slow_vote(rows, rule, grade):
    """The classes of each group, row by row; a comparison with 'loop' is timed out."""
    groups = {}
    for g, _, a in sorted((r for r in rows if r[0] is not None and r[2] and r[2].strip(" ")), key=lambda r: (r[0], r[1], r[2])):
        classes, a = groups.setdefault(g, {}), a.strip(" ")
        for known in classes:
            if rule(a, known) or (a != "loop" and (grade(a, known) or (known != "loop" and grade(known, a)))):
                classes[known] += 1
                break
        else:
            classes[a] = 1
    return {g: (max(c, key=c.get), max(c.values()), sum(c.values())) for g, c in groups.items()}


def test_graded_votes(spark):
    rng = random.Random(3)
    words = ["a", "ab", "abc", "b", "ba", " ab ", "no x", "No y", "", None, " "]
    rows = [(rng.choice([1, 2, 3, None]), i, rng.choice(words)) for i in range(400)] + [(4, i, None) for i in range(3)]
    df = spark.createDataFrame(rows, "q long, i int, said string").repartition(5)
    for rule in (vote.no_rule, vote.any_case_rule):
        got = vote.graded(df, "q", F.col("said"), ["i", "said"], endless, 5.0, rule).collect()
        assert {r["q"]: (r["answer"], r["votes"], r["n"]) for r in got} == slow_vote(rows, rule, lambda a, b: b.startswith(a))
    assert vote.graded(df.limit(0), "q", F.col("said"), ["i"], endless).count() == 0


def test_vote_goes_on_after_a_deadline(spark):
    rows = [(1, 0, "loop"), (1, 1, "a"), (1, 2, "ab"), (1, 3, "loop"), (1, 4, "c")]
    df = spark.createDataFrame(rows, "q long, i int, said string")
    (r,) = vote.graded(df, "q", F.col("said"), ["i"], endless, 0.5).collect()
    assert (r["answer"], r["votes"], r["n"]) == ("loop", 2, 5) and r["timeouts"] == 3  # "a", "ab" and "c" against "loop"


def test_agreement_without_answers(spark):
    rows = [(1, 0, "a", "ab"), (1, 1, "x", "ab"), (2, 0, None, "ab"), (2, 1, " ", None)]
    df = spark.createDataFrame(rows, "q long, i int, said string, own string")
    got = {r["q"]: r for r in vote.graded_agreement(df, "q", F.col("said"), F.col("own"), ["i"], endless, 5.0).collect()}
    assert (got[1]["agreed"], got[1]["n"], got[1]["agreement"]) == (1, 2, 0.5) and (got[2]["agreed"], got[2]["n"], got[2]["answer"]) == (0, 0, "")
