import hashlib
import random
import re

import pytest

from tallyspark.llm import pii


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def brute(text):
    """Spans by Python's regular expressions, with the patterns as they are stated."""
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    spans = [(m.start(), i, m.end(), kind) for i, (kind, p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m)]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans)]


HARD = [
    "a@b.c_d@e.f 1.2.3.4.5.6.7.8 x@y@z.w é😀 q.r@s-t.uv. @a.b a@.b a@b",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111x5",
    "0300.1.2.3 000001.2.3.4 256.1.1.1 99999999999999999999.1.1.1 1.1.1",
    "+1 (2)3-4567890 +12345678 +123456789012345 +1234567890123456 +1 ) +1-2",
    "+12345678 " * 300,
    "1.1.1.1 " * 500 + "😀a@b.cd",
    "1" * 60_000 + " " + "a." * 60_000 + "a@" + "b." * 30_000 + "b",
    "%+-._@x.y",
]


def test_base_spans_equal_brute_force(documents):
    rows = pii.scanned(documents(HARD)).collect()
    for r in rows:
        want = brute(HARD[r.doc_id])
        assert hashlib.sha256(",".join(want).encode()).hexdigest() == r.base_sha256, r.doc_id
        assert set(want) <= set(r.spans.split(","))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k) for s in want) for k in ("email", "ip", "card", "phone"))


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.scanned(docs).collect():
        assert hashlib.sha256(",".join(brute(texts[r.doc_id])).encode()).hexdigest() == r.base_sha256


def corpus(n):
    """Texts with plain and with disguised personal data, and numbers that are none: (text, added span or None, forbidden text)."""
    rng = random.Random(13)
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    rows = []
    for i in range(n):
        name, host = f"user{number(3)}", f"host{i % 9}"
        phone = f"{rng.randint(200, 999)}-{number(3)}-{number(4)}"
        word = rng.choice(["call", "phone", "tel", "mobile"])
        rows += [
            (f"write to {name}@{host}.example.com or {word} +1 {phone} today", None, None),
            (f"from server 10.{i % 250}.3.{i % 200} to 300.{i % 99}.{i % 250}.999 now", None, f"300.{i % 99}.{i % 250}.999"),
            (f"order {number(10)} of {2000 + i % 25}-{1 + i % 12:02}-{1 + i % 28:02} 12.30", None, None),
            (f"part {number(4)}-{number(8)} in run {number(13)}", None, None),
            (f"please contact {name} [at] {host} [dot] example [dot] com soon", f"{name} [at] {host} [dot] example [dot] com", None),
            (f"{word} {phone} before noon", phone, None),
        ]
    return rows


def test_disguised_data_is_added_and_plain_numbers_are_not(documents):
    rows = corpus(250)
    found = {r.doc_id: r for r in pii.scanned(documents([t for t, _, _ in rows])).collect()}
    hits = {"mail": [0, 0], "phone": [0, 0]}
    wrong = right = 0
    for i, (text, wanted, _) in enumerate(rows):
        base = set(brute(text))
        assert hashlib.sha256(",".join(brute(text)).encode()).hexdigest() == found[i].base_sha256
        added = [s for s in found[i].spans.split(",") if s and s not in base]
        texts = {text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in added}
        if wanted:
            kind = hits["mail" if "[at]" in wanted else "phone"]
            kind[0] += wanted in texts
            kind[1] += 1
        wrong += len(texts - {wanted})
        right += wanted in texts
    assert all(a >= 0.9 * n for a, n in hits.values()), hits
    assert right >= 0.9 * (right + wrong), (right, wrong)


def test_rare_confirmed_candidates_are_learned_from(documents):
    """30 confirmed numbers among 40,000 refuted ones: all of them count."""
    rng = random.Random(17)
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    phone = lambda: f"{rng.randint(200, 999)}-{number(3)}-{number(4)}"
    texts = [f"call +1 {phone()} today" for _ in range(30)] + [f"call {phone()} today" for _ in range(20)]
    texts += [" ".join(f"order {number(10)} x" for _ in range(100)) for _ in range(400)]
    rows = {r.doc_id: r.spans for r in pii.scanned(documents(texts)).collect()}
    assert sum(rows[i] == "phone_like:5:17" for i in range(30, 50)) >= 18
    assert not any(rows[i] for i in range(50, 450) if not brute(texts[i]))


def test_no_python_worker_is_used(documents):
    plan = pii.scanned(documents([t for t, _, _ in corpus(20)]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


def test_labels_come_from_spans_of_the_kind_and_from_checks(documents):
    from pyspark.sql import functions as F

    text = "tel +1 555-010-1234 or 555-010-9999; 300.1.1.1; 2024-01-31 10; joe [at] ex [dot] com; id 4111111111111112"
    rows = pii.proposed(documents([text]), "doc_id", "text").select(F.explode("found").alias("c")).select("c.kind", "c.start", "c.end", "c.label").collect()
    labels = {(r.kind, text[r.start : r.end]): r.label for r in rows}
    assert labels["phone_like", "+1 555-010-1234"] == 1 and labels["phone_like", "555-010-9999"] is None
    assert labels["ip_like", "300.1.1.1"] == 0 and labels["phone_like", "2024-01-31 10"] == 0
    assert labels["email_like", "joe [at] ex [dot] com"] is None and labels["card_like", "4111111111111112"] == 0


def test_odd_rows(odd, spark):
    rows = pii.scanned(odd).collect()
    assert len(rows) == odd.count() and all(r.spans == "" and r.n_card == 0 for r in rows)
    assert pii.scanned(odd.limit(0)).collect() == []


@pytest.mark.parametrize("n", [1, 63, 64, 65, 200])
def test_prefix_sums_by_blocks(spark, n):
    from pyspark.sql import functions as F

    text = "".join(f"{'-' * (i % 5)}{i}" for i in range(n))
    df = pii.matched(spark.createDataFrame([(text,)], "text string"), "text", {"card": "[0-9]+"})
    got = df.select(F.expr("transform(_card, x -> named_struct('a', x.start, 'b', x.end, 'v', x.value))")).first()[0]
    assert [(x.a, x.b, x.v) for x in got] == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", text)]
