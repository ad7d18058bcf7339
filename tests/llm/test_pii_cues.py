import random

import brute
import pytest

from emberlog.llm import pii, secrets, token_counts

IBAN = "DE89 3704 0044 0532 0130 00"


@pytest.mark.parametrize("before", ["", "é İ "])
@pytest.mark.parametrize(
    ("cue", "kind", "value"),
    [
        ("Social Security", "ssn", "123-45-6789"),
        ("Social Security Number: ", "ssn", "123-45-6789"),
        ("Ssn ", "ssn", "123-45-6789"),
        ("SSN Number: ", "ssn", "123-45-6789"),
        ("IBAN No: ", "iban", IBAN),
        ("IBan NR. ", "iban", IBAN),
        ("IBAN ", "iban", "NO93 8601 1117 947"),
        ("AccT No. ", "account", "123456789"),
    ],
)
def test_cues_in_any_case(before, cue, kind, value):
    cue = cue if cue.endswith(" ") else cue + " "
    text = f"{before}{cue}{value}, end"
    assert [text[a:z] for k, a, z in pii.spans(text) if k == kind] == [value]


def test_added_kinds_as_the_plain_version():
    rng = random.Random(9)
    parts = ["IBAN ", "iban: ", "account no. ", "Konto:", "acct", "SSN ", "social security number ", "compte # ", IBAN, "NO93 8601 1117 947", "DE89370400440532013000", "DE00 1234 5678 9012 3456", "123-45-6789", "123456789", "12 34-56", "http://a.b/c?d=e", "ftp://x,", "1x+y://z.", "://", "https://", "(see http://q.r).", "é", " ", " ", ".", "-", "9", "A"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        assert [s for s in pii.spans(text) if s[0] not in pii.BASE_KINDS] == brute.added_private_spans(text), text


def test_result_columns_that_the_input_has(spark):
    df = spark.createDataFrame([(1, "a@b.co", "old", "old", 5, 5, True, "x")], "doc_id long, text string, spans string, found string, n_tokens int, n_bytes int, over_limit boolean, marked string")
    r = pii.with_spans(df).first()
    assert [tuple(s) for s in r.spans] == [("email", 0, 6)] and (r.found, r.marked) == ("old", "x")
    r = secrets.with_spans(df, secrets.learn(df, "doc_id")).first()
    assert r.spans == [] and r.found == "old"
    r = token_counts.with_token_counts(df, limit=1).first()
    assert r.n_bytes == 6 and r.n_tokens > 1 and r.over_limit and r.spans == "old"


def test_very_long_texts(spark):
    """Spans at both ends of megabytes that hold anchors without spans, in linear time."""
    filler = "a@b +1 :// 12 34567 @ iban x 1.2.3 " * 60_000
    text = f"me@example.org {filler} +49 30 1234567 é {'9' * 300_000} {'x' * 300_000}@example.org"
    got = pii.spans(text)
    assert ("email", 0, 14) in got and got == sorted(got, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
    assert [s for s in got if s[0] == "email"][-1][2] == len(text)
    at = text.index("+49")
    assert ("phone", at, at + 14) in got
    row = pii.with_spans(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(s.kind, s.start, s.end) for s in row[0].spans] == got and row[1].spans == []
