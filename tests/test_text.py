import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from msgshield.functions import text as T
from msgshield.functions.chars import count_digits, round_exact, strip, token_count, with_ratios
from msgshield.functions.fixed import MESSAGE_FEATURES
from msgshield.functions.signals import with_message_signals


def values(spark, texts, column, schema="t string"):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, f"i long, {schema}")
    return [r[0] for r in df.withColumn("out", column(F.col("t"))).orderBy("i").select("out").collect()]


def test_clean_text(spark):
    cases = {
        None: "",
        "": "",
        "  a  b \n\n c\r\nd ": "a  b c d",
        "x&amp;y &lt;b&gt; &nbsp;z&#33;": "x&y <b>  z!",
        "a\x00b\x0bc\x7fd": "abcd",
        "tab\tin line": "tab\tin line",
        "&amp;lt;": "&lt;",
        "\u2003wide\u2003\n\u3000row": "wide row",
        "caf\u00e9 &eacute; &copy": "caf\u00e9 \u00e9 \u00a9",
    }
    assert values(spark, list(cases), T.clean_text) == list(cases.values())


def test_purge_reason(spark):
    cases = {
        "ab": "empty",
        "http://a.b/c d": "raw_url",
        " www.x": "raw_url",
        "a.b/c": "raw_url",
        "HTTP://A.B C": None,
        "a.b/c d": None,
        "<HTML lang=x> hello": "html",
        "see <header> here": "html",
        "<title attr>": None,
        "x" * 200 + "/.": None,
    }
    assert values(spark, list(cases), lambda c: T.purge_reason(c, c)) == list(cases.values())


def test_channel(spark):
    cases = {
        "Subject: hi": "EMAIL",
        "subject: hi": "EMAIL",
        "Re Subject: hi": "SMS",
        "mail\nFrom: me": "EMAIL",
        "mail\u2028From: me": "SMS",
        "mailto:me": "EMAIL",
        "write to a@b.c": "SOCIAL_CHAT",
        "a @ b # c": "SMS",
        "#tag": "SOCIAL_CHAT",
        "for instance": "SOCIAL_CHAT",
        "see http://t.co/x": "SOCIAL_CHAT",
        "t.co http": "SMS",
        "WhatsApp": "SOCIAL_CHAT",
        "ok": "SMS",
        "a" * 300: "SMS",
        "a" * 301: "EMAIL",
        "@\u00e9": "SOCIAL_CHAT",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i long, cleaned_text string")
    got = [r.channel for r in T.with_channel(df).orderBy("i").collect()]
    assert got == list(cases.values())


def test_message_stats(spark):
    text = "Subject: CALL 12345 now! http://a.b www.c  d"
    df = spark.createDataFrame([(text,), ("",), ("(555) 123-4567",), ("a123456b",)], "cleaned_text string")
    rows = [r.asDict() for r in T.with_message_stats(df).collect()]
    assert rows[0]["message_length"] == len(text) and rows[0]["word_count"] == 7
    assert rows[0]["has_url"] and rows[0]["url_count"] == 2
    assert rows[0]["has_phone"] and rows[0]["has_email_header"]
    assert rows[0]["uppercase_ratio"] == round(5 / len(text), 4)
    assert rows[0]["special_char_ratio"] == round(7 / len(text), 4)
    assert rows[1]["word_count"] == 0 and rows[1]["uppercase_ratio"] == 0.0
    assert rows[2]["has_phone"] and not rows[3]["has_phone"]


def test_template_skeleton(spark):
    cases = {
        "Pay 500 to @Bob at http://x.y/z": "pay [NUM] to [USER] at [URL]",
        "Mail Me.X+y@Host.co.uk, 1,234.50!": "mail [EMAIL], [NUM]!",
        " a \n\t b ": "a b",
        "room2 2nd 3-4": "room2 2nd [NUM]",
        "\u00e95 5\u00e9": "\u00e95 5\u00e9",
        None: "",
    }
    assert values(spark, list(cases), T.template_skeleton) == list(cases.values())


def test_signals_of_a_phishing_text(spark):
    text = "URGENT: Your SBI account is blocked! Verify password now at http://bit.ly/3x8q or call 88600."
    df = spark.createDataFrame([(text,)], "cleaned_text string")
    row = with_message_signals(df).first().asDict()
    assert list(row)[1:] == MESSAGE_FEATURES
    expected = {
        "message_length": 93.0, "word_count": 14.0, "sentence_count": 3.0, "exclamation_count": 1.0,
        "question_count": 0.0, "has_url": 1.0, "url_count": 1.0, "domain_count": 1.0, "has_ip_url": 0.0,
        "has_shortened_url": 1.0, "has_http_only": 1.0, "url_length_max": 18.0, "urgency_score": 2.0,
        "account_threat": 1.0, "credential_request": 1.0, "otp_request": 0.0, "payment_request": 0.0,
        "impersonation_flag": 1.0, "uppercase_ratio": round(11 / 93, 4), "digit_ratio": round(7 / 93, 4),
    }
    assert {k: row[k] for k in expected} == expected


@pytest.mark.parametrize(
    "text, name, value",
    [
        ("http://microsoft.com/x", "has_shortened_url", 1.0),
        ("http://a.b http://a.b/c https://a.b", "domain_count", 2.0),
        ("go to 10.0.0.1/x or ftp", "has_ip_url", 0.0),
        ("http://300.1.2.3/x", "has_ip_url", 1.0),
        ("sub.host.com/path", "url_count", 1.0),
        ("within 12 hours", "urgency_score", 1.0),
        ("within \u0661\u0662 hours", "urgency_score", 1.0),
        ("know nowhere", "urgency_score", 0.0),
        ("\u00e9now", "urgency_score", 0.0),
        ("...", "sentence_count", 1.0),
        ("\u00b2\u2460 5", "digit_ratio", 0.75),
        (None, "message_length", 0.0),
    ],
)
def test_single_signals(spark, text, name, value):
    df = spark.createDataFrame([(text,)], "cleaned_text string")
    assert with_message_signals(df).first()[name] == value


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2000), st.integers(1, 2000)), min_size=1, max_size=200))
def test_rounding_equals_python(spark, pairs):
    df = spark.createDataFrame([(i, min(a, b), b) for i, (a, b) in enumerate(pairs)], "i int, a int, b int")
    got = [r.r for r in with_ratios(df, {"r": (F.col("a"), F.col("b"))}).orderBy("i").collect()]
    assert got == [round(min(a, b) / b, 4) for a, b in pairs]


def test_rounding_of_ties(spark):
    xs = [3 / 160, 0.00005, 0.03125, 0.00125, 0.0, 1.0, 0.12345, 0.24500000000000002]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = [r[0] for r in df.orderBy("i").select(round_exact(F.col("x"), 4)).collect()]
    assert got == [round(x, 4) for x in xs]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=40))
def test_unicode_helpers_equal_python(spark, texts):
    texts = [t.replace("\x00", "").encode("utf-8", "ignore").decode() for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    t = F.col("t")
    rows = df.select(strip(t), token_count(t), count_digits(t)).collect()
    assert [r[0] for r in rows] == [x.strip() for x in texts]
    assert [r[1] for r in rows] == [len(x.split()) for x in texts]
    assert [r[2] for r in rows] == [sum(c.isdigit() for c in x) for x in texts]
