import ipaddress
import math
import random
import re
from collections import Counter
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from msgshield.functions.qr import strip_series_artifact, with_extracted_url, with_qr_features
from msgshield.functions.urls import CANONICAL_FIELDS, IPV4, IPV6, char_decode, char_ids, looks_like_url, root_domain
from msgshield.functions.urls import shannon_entropy, with_canonical_url, with_url_features, with_url_parts


def canonical(spark, urls):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, raw_url string")
    return [r.asDict() for r in with_canonical_url(df).orderBy("i").collect()]


CANONICAL = {
    "Example.com": "http://example.com/",
    "HTTPS://Example.com:443//a///b?Q=1#f": "https://example.com/a/b?Q=1#f",
    "http://u@Host:8080?x": "http://u@host:8080?x",
    "http://host:abc/x": "http://host/x",
    "http://User:Pw@HOST/Path": "http://User:Pw@host/Path",
    "http://a@b@C/x": "http://a@b@c/x",
    "ftp://h:21/x": "ftp://h/x",
    "ftp://h:80/x": "ftp://h:80/x",
    "http://h:0080/x": "http://h/x",
    "http://h:008080/x": "http://h:8080/x",
    "http://h:/x": "http://h/x",
    "http://h:1:2/x": "http://h:1/x",
    "http://h: 80 /x": "http://h/x",
    "http://h:+81/x": "http://h:81/x",
    "http://h:8_1/x": "http://h:81/x",
    "http://h:-5/x": "http://h:-5/x",
    "http:///p": "http:///p",
    "http://?q": "http://?q",
    "http://": "http:///",
    "   ": "http:///",
    "foo:///bar": "foo:/bar",
    "foo://h//bar": "foo://h/bar",
    "a,b://x//y?q#f": "a,b:/x/y?q#f",
    "http://h/p?": "http://h/p",
    "http://h/p#": "http://h/p",
    "http://h/p?#f": "http://h/p#f",
    "http://h/p#f?x#y": "http://h/p#f?x#y",
    "http://h/a\tb\nc": "http://h/abc",
    "ht\ntp://x": "http://http/x",
    "http://h/%41%zz": "http://h/%41%zz",
    "http://a_b.com/x|y z": "http://a_b.com/x|y z",
    "http://[::1]/x": "http://[::1]/x",
    "http://[::1]:80/x": "http://[/x",
    "http://[bad/X": "http://[bad/x",
    "http://[::1]x/Y": "http://[::1]x/y",
    "x]:8080/Y": "x]:8080/y",
    "http://ex\u2100mple.com/X": "http://ex\u2100mple.com/x",
    "http://\u00c9.com/\u00c9": "http://\u00e9.com/\u00c9",
    "//host/x": "http:////host/x",
    "": "",
    None: "",
}


def test_canonical_forms(spark):
    rows = canonical(spark, list(CANONICAL))
    expected = dict(CANONICAL)
    # Four slashes: an empty authority, then the path with its slashes collapsed.
    expected["//host/x"] = "http:///host/x"
    assert {u: r["normalized_url"] for u, r in zip(CANONICAL, rows)} == expected


def test_canonical_parts(spark):
    rows = canonical(spark, ["HTTP://u:p@Sub.Host.com:8080/a//b?x=1&y#z", "http://[bad/X", None])
    good = dict(zip(CANONICAL_FIELDS, [
        "HTTP://u:p@Sub.Host.com:8080/a//b?x=1&y#z", "http://u:p@sub.host.com:8080/a/b?x=1&y#z", "http", "sub.host.com",
        "/a/b", "x=1&y", "z"]))
    assert {k: rows[0][k] for k in good} == good
    assert (rows[1]["scheme"], rows[1]["domain"], rows[1]["path"]) == ("http", "http:", "")
    assert [rows[2][k] for k in CANONICAL_FIELDS] == [""] * 7


def test_parts_equal_the_standard_library(spark):
    rng = random.Random(7)
    pieces = ["a", "B", "/", "//", ":", "?", "#", "@", ".", "%41", ";", "=", "&", "\t", "\n", " ", "-", "_", "\u00e9", "80"]
    urls = [rng.choice(["http://", "HTTPS://", "ftp://", "x+y-z.1://"]) + "".join(rng.choices(pieces, k=rng.randint(0, 12)))
            for _ in range(400)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    names = ["scheme", "netloc", "path", "query", "fragment"]
    got = [tuple(r["__" + n] for n in names) for r in with_url_parts(df, "u").orderBy("i").collect()]
    # Trailing blanks and control characters are cut by the caller.
    assert got == [tuple(urlsplit(u)[:5]) for u in urls]


def test_ip_patterns_equal_the_standard_library():
    rng = random.Random(3)
    groups = ["", "0", "1", "ffff", "abcd1", "12", "1.2.3.4", "256.1.1.1", "01.2.3.4"]
    cases = [":".join(rng.choices(groups, k=rng.randint(1, 9))) for _ in range(20000)]
    cases += ["::", "1::", "::1", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8", "fe80::1%eth0", "fe80::1%", "1.2.3.4",
              "1.2.3", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1::2:3:4:5:6:7:8"]
    pattern = re.compile(rf"(?:{IPV4}|{IPV6})\Z")

    def valid(text):
        try:
            ipaddress.ip_address(text)
            return True
        except ValueError:
            return False

    wrong = [c for c in cases if bool(pattern.match(c)) != valid(c)]
    assert wrong == []


def test_root_domain(spark):
    cases = {
        "a.b.co.uk": "b.co.uk", "1.2.3.4": "1.2.3.4", "localhost": "localhost", "secure.login.chase.com": "chase.com",
        "a.b.com.au": "b.com.au", "co.uk": "co.uk", "x.gov.in:80": "x.gov.in", "a.b.co.info": "co.info", "": "", None: "",
        "A.B.C": "b.c", "com.uk.": "uk.",
    }
    df = spark.createDataFrame([(i, h) for i, h in enumerate(cases)], "i int, h string").orderBy("i")
    assert [r[0] for r in df.select(root_domain(F.col("h"))).collect()] == list(cases.values())


def test_entropy(spark):
    texts = ["abca", "", "aaaa", "http://example.com/a?b=c", "\U0001f600x\U0001f600"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = [r[0] for r in df.select(shannon_entropy(F.col("t"))).collect()]
    for t, g in zip(texts, got):
        n = len(t)
        want = -sum(k / n * math.log2(k / n) for k in Counter(t).values()) if n else 0.0
        assert abs(g - want) < 1e-12


def test_char_ids(spark):
    df = spark.createDataFrame([(0, "a"), (1, "\u00e9"), (2, " ~"), (3, ""), (4, None), (5, "x" * 200)], "i int, t string")
    rows = df.orderBy("i").select(char_ids(F.col("t")).alias("ids")).select("ids", char_decode(F.col("ids"))).collect()
    assert rows[0][0] == [69] + [0] * 149 and rows[1][0] == [1] + [0] * 149
    assert rows[2][0][:3] == [4, 98, 0] and rows[3][0] == [0] * 150 == rows[4][0]
    assert rows[5][0] == [92] * 150
    assert [r[1] for r in rows] == ["a", "<UNK>", " ~", "", "", "x" * 150]
    odd = spark.createDataFrame([([2, 70, 3, 200],)], "ids array<int>")
    assert odd.select(char_decode(F.col("ids"))).first()[0] == "<START>b<END>?"


def features(spark, url, **options):
    df = spark.createDataFrame([(url,)], "raw_url string")
    return with_url_features(with_canonical_url(df), **options).first().asDict()


def test_url_features(spark):
    f = features(spark, "https://a.b.secure-login.paypal.xyz:8443//verify//x_1?id=%41%4g&y#frag")
    assert f["normalized_url"] == "https://a.b.secure-login.paypal.xyz:8443/verify/x_1?id=%41%4g&y#frag"
    want = {
        "subdomain_count": 3.0, "is_https": 1.0, "has_suspicious_tld": 1.0, "tld_length": 3.0, "hex_encoded_char_count": 1.0,
        "has_login_kw": 1.0, "has_verify_kw": 1.0, "has_security_kw": 1.0, "has_brand_kw": 1.0, "has_payment_kw": 0.0,
        "keyword_in_subdomain": 1.0, "keyword_in_path": 1.0, "keyword_count": 4.0, "fragment_length": 4.0,
        "underscore_count": 1.0, "percent_count": 2.0, "has_double_slash_in_path": 0.0, "has_non_standard_port": 0.0,
    }
    assert {k: f[k] for k in want} == want
    assert f["keyword_density"] == 4.0 / (f["url_length"] / 10.0)
    g = features(spark, "https://a.b.secure-login.paypal.xyz:8443//verify//x_1?id=%41%4g&y#frag", intended=True)
    assert (g["has_double_slash_in_path"], g["has_non_standard_port"]) == (1.0, 1.0)
    assert features(spark, "http://1.2.3.4/")["has_ip_host"] == 1.0
    assert features(spark, "bit.ly/x")["has_shortener"] == 1.0
    assert features(spark, "x]:8080/a")["has_non_standard_port"] == 1.0
    assert features(spark, "http://xn--a.com/")["has_punycode"] == 1.0
    assert features(spark, "")["keyword_density"] == 0.0


def test_extract_url(spark):
    cases = [
        ("0    http://A.com/b\nName: url, dtype: object", "http://a.com/b", "url"),
        ("http://A.com/b;c?d=1#f", "http://a.com/b?d=1#f", "url"),
        ("http://A.com/b;c/d;e", "http://a.com/b;c/d", "url"),
        ("HTTP://User@A.com:80/B tail", "http://user@a.com:80/B", "url"),
        ("see https://x.y/z now", "https://x.y/z", "url"),
        ("hello", None, "non_url"),
        ("http:///x", None, "non_url"),
        ("http://[bad/x", None, "non_url"),
        ("   ", None, "non_url"),
        ("", None, "unknown"),
        (None, None, "unknown"),
        ("text\n 3 \n http://b.c/d", "http://b.c/d", "url"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, payload string")
    rows = with_extracted_url(df).orderBy("i").collect()
    assert [(r.normalized_url, r.content_type) for r in rows] == [c[1:] for c in cases]
    assert rows[0].content == "http://A.com/b" and rows[5].content == "hello"


def test_series_artifact(spark):
    cases = {"0   x y\nName: a\nb": "x y", "12 34 z": "34 z", "7": "7", "a\nName:": "a", " q ": "q", None: ""}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(strip_series_artifact(F.col("t"))).collect()] == list(cases.values())


def test_qr_features(spark):
    urls = ["http://u@a.b.c.com:8080/p/q?x=%41#f", "https://1.2.3.4/", "http://[::1]:0/x", "http://h:99999/p@q%", "http://bit.ly/x", ""]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, normalized_url string")
    r = with_qr_features(df).orderBy("i").collect()
    assert (r[0].domain, r[0].subdomain_count, r[0].has_port, r[0].has_at_symbol, r[0].has_encoded_characters) == ("a.b.c.com", 2, 1, 1, 1)
    assert (r[0].path_length, r[0].query_length, r[0].fragment_length) == (4, 5, 1)
    assert (r[1].has_ip_address, r[1].has_https, r[1].subdomain_count) == (1, 1, 2)
    assert (r[2].domain, r[2].has_ip_address, r[2].has_port) == ("::1", 1, 0)
    # A port out of range stops the extraction, but not the two flags found before.
    assert (r[3].domain, r[3].has_port, r[3].subdomain_count, r[3].has_at_symbol, r[3].has_encoded_characters) == ("h", 0, 0, 1, 1)
    assert r[4].has_shortener_pattern == 1
    assert (r[5].url_length, r[5].domain, r[5].special_character_count) == (0, "", 0)


def test_looks_like_url(spark):
    cases = {"HTTP://x": True, "ftp://x": True, "www.x": True, "a.b/c": True, "a.b": False, "hello": False}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(looks_like_url(F.col("t"))).collect()] == list(cases.values())
