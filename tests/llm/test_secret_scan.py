import hashlib
import re

import pytest

from gradewell.llm import queries, secret_scan

ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def brute(text):
    t = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    spans.sort()
    listing = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
    counts = tuple(sum(k == i for _, k, _ in spans) for i in range(3))
    return (*counts, hashlib.sha256(listing.encode()).hexdigest(), listing)


SECRETS = [
    "password=abc then PassWord : 'abcdef' secret=token: abcdef token='x'",
    "api_key=1234567 API-KEY=1234567 apikey = \"" + "0123456789abcdef" * 3 + "\"",
    "AKIA" + "Z" * 15 + " AKIA" + "Q9" * 8 + " AKIAAKIA" + "B" * 12,
    "f" * 23 + " " + "e" * 24 + "g" + "0" * 40,
    "é😀 token=zzzzzz \x01 secret = \x02 passwd:abc.def",
    "pas ass ssw swo wor ord, the trigrams but no password",
    "ſecret=abcdefgh toKen=abcdefgh",
    "token=" * 500,
]


def test_like_brute_force(spark, documents, odd_rows):
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(SECRETS)]
    found = secret_scan.summary(secret_scan.scan(documents(rows).withColumnRenamed("source", "spans")))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, tuple(r)[1:]) for r in found.collect())
    assert got == sorted((i is None, i or 0, brute(t)) for i, t in rows)


def test_query_over_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op2_secret_scan(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r["doc_id"]: brute(r["text"]) for r in rows}


def test_empty_table(documents):
    assert secret_scan.scan(documents([])).count() == 0


@pytest.mark.parametrize(
    ("pattern", "query"),
    [
        ("abcd", [{"abc", "bcd"}]),
        ("ab|abcd", []),
        ("(abc|xyz)+q", [{"abc"}, {"xyz"}]),
        ("abc[0-9]*def", [{"abc", "def"}]),
        ("[0-9a-f]{24,}", []),
        ("ABC_?d", [{"abc", "bc_", "c_d"}, {"abc", "bcd"}]),
    ],
)
def test_trigram_query(pattern, query):
    assert sorted(map(sorted, secret_scan.trigram_query(pattern))) == sorted(map(sorted, query))


def test_no_python_in_plan(documents):
    plan = secret_scan.scan(documents(["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)
