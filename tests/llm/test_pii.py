import hashlib
import random
import re

from pyspark.sql import functions as F

from chronaxis.llm import pii
from tests.llm.fixtures import SF, awkward, query

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(value):
    total = 0
    for i, d in enumerate(reversed([int(c) for c in value if c.isdigit()])):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        found = []
        for m in re.finditer(pattern, text or ""):
            n = len(re.sub("[^0-9]", "", m.group()))
            good = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else False, "card": 16 <= n <= 19 and luhn(m.group()), "phone": 8 <= n <= 15}[kind]
            if good:
                found.append(f"{kind}:{m.start()}:{m.end()}")
        out[kind] = found
    return out


def check(got, texts):
    for r in got:
        if r.doc_id is None:
            continue
        want = plain(texts[r.doc_id])
        assert {k: r[f"n_{k}"] for k in PATTERNS} == {k: len(x) for k, x in want.items()}, texts[r.doc_id]
        base = [s for k in PATTERNS for s in want[k]]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if s.split(":")[0] in PATTERNS] == base


EDGES = [
    "a@b.cc_d@e.ff x", "..a%b+c@d-e.f-g.h.", "a@b a@b. a@.b @b.c", "1.2.3.4.5.6.7.8", "1.2.3.256 01.002.3.0004 1.2.3", "999.1.1.1.1 é 1.1.1.1",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112", "5500005555555559" + "0" * 3, "12 34 5678 9012 3456 7890 1234 5678", "+1 (234) 555-0123 +12 +1-2 +123456789012345678", "+1 (2)\n+3 4.5.6.7.8.9.0", "😀 a@b.cd 😀 é@x.yz",
    "a@b.c" * 30, "1.1.1.1@2.2.2.2.com", "++1 234 567 8",
]


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    fuzz = ["".join(rng.choice("01239a.@+- ()é\n_") for _ in range(80)) for _ in range(300)]
    rows = awkward() + [(2000 + i, t, None, None, 1) for i, t in enumerate(EDGES + fuzz)]
    check(query(spark, "op7_pii", tmp_path, rows=rows), {r[0]: r[1] for r in rows})


def test_given_documents(spark):
    from chronaxis.llm.queries import op7_pii

    check(op7_pii(spark, SF).collect(), {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()})


def test_long_runs_are_quick_and_safe(spark, tmp_path):
    rows = [(i, t, None, None, 1) for i, t in enumerate(["a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 50_000, "+1" * 50_000, "a@" + "b." * 60_000 + "c", "1 " * 100_000])]
    got = {r.doc_id: r for r in query(spark, "op7_pii", tmp_path, rows=rows)}
    assert len(got) == 7 and got[5].n_email == 1


def test_checksums_and_context(spark):
    rows = [(1, "IBAN GB82 WEST 1234 5698 7654 32 ok"), (2, "IBAN GB82 WEST 1234 5698 7654 33 ok"), (3, "my ssn 123-45-6789."), (4, "part 123-45-6789."), (5, "amex 378282246310005"), (6, "378282246310005"), (7, "call 555 123 4567")]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sizes = {i: {k.name: len(r[k.name]) for k in pii.KINDS if len(r[k.name])} for i, r in found.items()}
    assert sizes == {1: {"iban": 1}, 2: {}, 3: {"national_id": 1}, 4: {}, 5: {"short_card": 1}, 6: {}, 7: {"local_phone": 1}}


def test_context_reaches_across_matches(spark):
    texts = [
        "SSNs: 123-45-6789, 987-65-4321", "123-45-6789, 987-65-4321 are ssn", "amex 378282246310005, 371449635398431", "amex 1234567890123, 378282246310005",
        "phones 555 123 4567, 555 123 4568", "ssn " + "x" * 40 + " 123-45-6789", "ssn " + "x" * 50 + " 123-45-6789", "é😀 ssn 123-45-6789é987-65-4321, 111-22-3333",
    ]
    rng = random.Random(3)
    texts += [", ".join(rng.choice(["ssn", "x", "é" * 9, "123-45-6789", "987-65-4321", "a" * 20]) for _ in range(12)) for _ in range(100)]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [len(found[i].national_id) for i in (0, 1, 5, 6, 7)] == [2, 2, 1, 0, 3] and len(found[2].short_card) == 2 and [(x.start, x.end) for x in found[3].short_card] == [(20, 35)] and len(found[4].local_phone) == 2
    kind = next(k for k in pii.KINDS if k.name == "national_id")
    for i, text in enumerate(texts):
        want = [m.span() for m in re.finditer(kind.pattern, text) if any(re.search(rf"\b(?:{kind.context})", x) for x in (text[max(0, m.start() - 48) : m.start()].lower(), text[m.end() : m.end() + 24].lower()))]
        assert [(x.start, x.end) for x in found[i].national_id] == want, text


def test_secrets(spark):
    run = "a1" * 12
    texts = {f'token = "{run}" then': 1, f"API_KEY: {run}": 1, f"keys {run}": 0, f"plain {run}": 0, f"password {'a' * 30}": 0, f"password {'1' * 30}": 0, f"token {run[:19]}": 0, f"{run} is the secret": 1, f"token {run}-{run}": 2}
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {list(texts)[r.doc_id]: len(r.secret) for r in found} == texts


def test_many_matches_in_one_text(spark, tmp_path):
    """More matches than a block holds, at every remainder; and very many in bounded time."""
    texts = [" ".join(f"u{i}@h{i}.org 1.2.3.{i % 300} +1 234 567 {i}" for i in range(n)) for n in (255, 256, 257, 513, 700)] + ["é a@b.cd " * 60_000]
    rows = [(i, t, None, None, 1) for i, t in enumerate(texts)]
    check(query(spark, "op7_pii", tmp_path, rows=rows), {r[0]: r[1] for r in rows})


def test_planted_documents_are_found(spark):
    """Every document with a planted address, card, phone, mail or secret has a span."""
    from chronaxis.llm.queries import op7_pii

    sf = "/root/testdata/sf0.01"
    found = {r.doc_id: r.spans for r in op7_pii(spark, sf).collect()}
    planted = re.compile(r"""(?i)[a-z0-9.]+@[a-z0-9]+\.[a-z]+|token = "[0-9a-f]{40}"|\+[0-9][0-9 ()-]{9,}[0-9]""")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [i for i, t in texts.items() if planted.search(t)]
    assert len(held) > 20 and sum(bool(found[i]) for i in held) / len(held) > 0.98
    assert sum(bool(s) for s in found.values()) < 0.2 * len(found)


def test_no_python_in_the_plan(spark):
    plan = pii.find(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_redact(spark):
    df = spark.createDataFrame([("mail a@b.cd or +1 234 567 89",)], "text string")
    assert pii.redact(df).select(F.col("text")).first()[0] == "mail <email> or <phone>"


def test_empty_table(spark, tmp_path):
    assert query(spark, "op7_pii", tmp_path, rows=[]) == []
