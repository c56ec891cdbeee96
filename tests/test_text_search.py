"""Token predicates against plain Python, and the golden search cases as truth tables."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions.fixed_values import SEPARATORS
from tidemark.operators.search import Search

WORDS = ["kafka", "logs", "kafkaesque", "log", "élan", "a1", "error", "k"]


def py_tokens(s):
    return [t for t in re.split(SEPARATORS + "+", s.lower()) if t]


def contains_run(tokens, run, prefix=False):
    for i in range(len(tokens) - len(run) + 1):
        window = tokens[i:i + len(run)]
        if window == run or (prefix and window[:-1] == run[:-1] and window[-1].startswith(run[-1])):
            return True
    return False


@pytest.mark.parametrize("query", ["kafka", "logs kafka", "Kafka-Logs", "k", "élan a1", "error, log", "lo"])
def test_match_predicates_equal_python(spark, query):
    rng = random.Random(7)
    texts = ["".join(rng.choice(WORDS).upper() if rng.random() < .2 else rng.choice(WORDS)
                     for _ in range(1)) for _ in range(5)]
    texts += [rng.choice(["", " ", "--"]).join([""]) + "".join(
        w + rng.choice([" ", "_", "-", ".", "\n", "  ", "/"]) for w in rng.choices(WORDS, k=rng.randint(0, 7)))
        for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", text.match_any("t", query).alias("any"), text.match_all("t", query).alias("all"),
                    text.match_phrase("t", query).alias("phrase"),
                    text.match_phrase_prefix("t", query).alias("prefix"), text.tokens("t").alias("tokens")).collect()
    run = py_tokens(query)
    for r in got:
        own = py_tokens(r["t"])
        assert r["tokens"] == own
        assert r["any"] == any(t in own for t in run), r["t"]
        assert r["all"] == all(t in own for t in run), r["t"]
        assert r["phrase"] == contains_run(own, run), r["t"]
        assert r["prefix"] == contains_run(own, run, prefix=True), r["t"]


def test_empty_query_matches_nothing(spark):
    df = spark.createDataFrame([("a",)], "t string")
    assert df.filter(text.match_any("t", " - ") | text.match_phrase("t", "")).count() == 0


ROWS = [
    (1, "kafka", "lib error", "failed", 50.0, datetime(2023, 12, 31)),
    (2, "kafka logs", "scope", "ok", 100.0, datetime(2024, 1, 1)),
    (3, "zookeeper", "kafkaesque", "failed", 500.0, datetime(2024, 1, 15)),
    (4, "error", None, "failed", 501.0, datetime(2024, 1, 31)),
    (5, None, None, "ok", None, datetime(2024, 2, 1)),
]
GOLDEN = {
    "bare term": (lambda s: s.anywhere("error"), {1, 4}),
    "field term": (lambda s: s.term("service_name", "kafka"), {1, 2}),
    "bare phrase": (lambda s: s.anywhere("kafka logs", phrase=True), {2}),
    "field phrase": (lambda s: s.phrase("service_name", "kafka logs"), {2}),
    "and": (lambda s: s.term("service_name", "kafka") & s.term("status", "failed"), {1}),
    "not": (lambda s: ~s.term("service_name", "kafka"), {3, 4}),
    "negated bare term": (lambda s: s.anywhere("kafka", negate=True), {3, 4, 5}),
    "grouped or": (lambda s: (s.term("service_name", "kafka") | s.term("service_name", "zookeeper"))
                   & s.term("status", "failed"), {1, 3}),
    "suffix wildcard": (lambda s: s.anywhere("kaf", suffix=True), {1, 2, 3}),
    "number range": (lambda s: s.between("duration", 100, 500), {2, 3}),
    "date range, typed": (lambda s: s.between("timestamp", "2024-01-01", "2024-01-31"), {2, 3, 4}),
    "greater": (lambda s: s.compare("duration", ">", "500"), {4}),
    "date at most, typed": (lambda s: s.compare("timestamp", "<=", "2024-01-01"), {1, 2}),
    "exists": (lambda s: s.exists("scope_name"), {1, 2, 3}),
    "negated comparison flips": (lambda s: s.compare("duration", ">=", 500, negate=True), {1, 2}),
    "unknown field": (lambda s: s.term("nope", "x") | s.between("nope", 1, 2), set()),
}


@pytest.mark.parametrize("case", sorted(GOLDEN))
def test_golden_cases(spark, case):
    df = spark.createDataFrame(ROWS, "id int, service_name string, scope_name string, status string, duration double, timestamp timestamp_ntz")
    build, expected = GOLDEN[case]
    s = Search(df, implicit=["service_name", "scope_name"])
    assert {r["id"] for r in df.filter(build(s)).collect()} == expected


def test_highlight(spark):
    df = spark.createDataFrame([("Error: error_code errors",)], "t string")
    got = df.select(text.highlight("t", "error").alias("m"), text.highlight("t", '"error_c"').alias("p")).first()
    assert got["m"] == "<mark>Error</mark>: <mark>error</mark>_code errors"
    assert got["p"] == "Error: <mark>error_c</mark>ode errors"


def test_entities_and_terms(spark):
    df = spark.createDataFrame([("Alpha beta Gamma! Alpha Delta, tiny Ep", "What is the Neural net")], "t string, q string")
    row = df.select(text.extract_entities("t").alias("e"), text.query_terms("q").alias("q"),
                    text.clean_entities(F.array(*[F.lit(x) for x in ["d1", "ab", "model", "model", "the", "rc1x", "Graph"]])).alias("c")).first()
    assert [(e["name"], e["type"]) for e in row["e"]] == [("Alpha", "CONCEPT"), ("Gamma", "PERSON"), ("Delta", "ORG")]
    assert row["q"] == ["neural", "net"]
    assert row["c"] == ["model", "Graph"]
