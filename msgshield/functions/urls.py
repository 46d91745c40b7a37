"""URL expressions: canonical form, root domain, entropy, the 42 features and character ids.

Each ``with_*`` operator is a short chain of projections. A value that later expressions read several times is bound
to its own column, so that no expression is evaluated twice; the helper columns are dropped at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chars import ALNUM, contains_any, count_char, count_class, count_digits, count_not_class, delimiter_lookalikes
from .chars import strip
from .fixed import CHAR_SEQUENCE_LENGTH, DEFAULT_PORTS, SECOND_LEVEL_LABELS, SUSPICIOUS_TLDS, URL_FEATURES
from .fixed import URL_KEYWORD_GROUPS, URL_KEYWORDS, URL_SHORTENERS
from .stages import Stages, apply_stages, once

CANONICAL_FIELDS = ["original_url", "normalized_url", "scheme", "domain", "path", "query", "fragment"]

# Fixed value: the pattern decides the results.
# The accepted scheme characters include a comma, although a comma makes the scheme invalid later on.
SCHEME = r"^[a-zA-Z][a-zA-Z0-9+,\-.]*://"
DOTTED_QUAD = r"\A\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3}\n?\z"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_HEX = r"[0-9a-fA-F]{1,4}"


def _ipv6() -> str:
    """Every legal IPv6 spelling: full, with one ``::``, each also with an embedded IPv4 tail."""
    forms = []
    for tail, width in ((_HEX, 1), (IPV4, 2)):
        forms.append(rf"(?:{_HEX}:){{{8 - width}}}{tail}")
        # "::" stands for at least one group: `left` groups before it, at most `right` after it.
        for left in range(0, 8 - width):
            right = 7 - left - width
            head = rf"{_HEX}(?::{_HEX}){{{left - 1}}}" if left else ""
            forms.append(rf"{head}::(?:{_HEX}:){{0,{right}}}{tail}")
    for left in range(0, 8):
        head = rf"{_HEX}(?::{_HEX}){{{left - 1}}}" if left else ""
        forms.append(rf"{head}::")
    return rf"(?:{'|'.join(forms)})(?:%[^%\]]+)?"


IPV6 = _ipv6()
_FUTURE = r"v[a-fA-F0-9]+\."
# Host and port where brackets occur: an IPv6 address or a future address form in brackets, then at most a port. If
# the brackets are in the user part only, the bare host has to be of the future form.
BRACKETED = rf"\A(?:\[(?:{IPV6}|{_FUTURE}[^\]]+)\](?::.*)?|{_FUTURE}[^:\[]+(?::.*)?)\z"


def malformed_netloc(netloc: Column) -> Column:
    """True where the authority part cannot be split: unbalanced or wrongly placed brackets, a bad bracketed address,
    or characters that normalise into URL delimiters."""
    opened, closed = F.contains(netloc, F.lit("[")), F.contains(netloc, F.lit("]"))
    return (
        (opened != closed)
        | (opened & ~F.substring_index(netloc, "@", -1).rlike(BRACKETED))
        | ((F.octet_length(netloc) > F.length(netloc)) & netloc.rlike(f"[{delimiter_lookalikes()}]"))
    )


@once
def _part_stages(url: str) -> Stages:
    """Plain string cuts instead of a regex: fragment at the first '#', query at the first '?', then the scheme, then
    the authority up to the first '/'. A scheme with a comma is not one: all of it belongs to the path."""
    c = lambda name: F.col("__" + name)
    return [
        {"__url": F.translate(F.col(url), "\t\r\n", "")},
        {"__nofrag": F.substring_index(c("url"), "#", 1)},
        {
            "__fragment": F.substr(c("url"), F.length(c("nofrag")) + 2),
            "__front": F.substring_index(c("nofrag"), "?", 1),
        },
        {
            "__query": F.substr(c("nofrag"), F.length(c("front")) + 2),
            "__lead": F.substring_index(c("front"), "://", 1),
        },
        {"__absolute": ~F.contains(c("lead"), F.lit(","))},
        {
            "__scheme": F.when(c("absolute"), F.lower(c("lead"))).otherwise(""),
            "__rest": F.when(c("absolute"), F.substr(c("front"), F.length(c("lead")) + 4)).otherwise(c("front")),
        },
        {"__netloc": F.when(c("absolute"), F.substring_index(c("rest"), "/", 1)).otherwise("")},
        {"__path": F.substr(c("rest"), F.length(c("netloc")) + 1)},
    ]


def with_url_parts(df: DataFrame, url: str) -> DataFrame:
    """Split an absolute URL at its delimiters into ``__scheme, __netloc, __path, __query, __fragment``."""
    out = apply_stages(df, _part_stages(url))
    return out.drop("__url", "__nofrag", "__front", "__lead", "__absolute", "__rest")


@once
def _canonical_stages(url: str) -> Stages:
    c = lambda name: F.col("__" + name)
    given = F.coalesce(F.col(url), F.lit(""))
    # A blank but not empty input still becomes "http://".
    first: Stages = [
        {"__original": strip(given), "__given": given != ""},
        {
            "__full": F.when(c("original").rlike(SCHEME), c("original")).otherwise(
                F.concat(F.lit("http://"), c("original"))
            )
        },
    ]
    # The port is the second ':'-piece, if it reads as an integer; sign, spaces and digit grouping are allowed.
    port = F.regexp_replace(
        F.regexp_replace(c("portpiece"), F.lit(r"[_+]"), F.lit("")), F.lit(r"^(-?)0+(?=[0-9])"), F.lit("$1")
    )
    default_port = reduce(
        lambda a, b: a | b, [(c("scheme") == s) & (c("port") == p) for s, p in DEFAULT_PORTS.items()]
    )
    has_port = F.contains(c("hostport"), F.lit(":")) & ~(
        F.startswith(c("hostport"), F.lit("[")) & F.endswith(c("hostport"), F.lit("]"))
    )
    joined = _unsplit(c("scheme"), c("cnetloc"), c("cpath"), c("query"), c("fragment"))
    blank = F.lit("")

    def field(good: Column, bad: Column) -> Column:
        return F.when(~c("given"), blank).when(c("ok"), good).otherwise(bad)

    return [
        *first,
        *_part_stages("__full"),
        {
            "__ok": ~malformed_netloc(c("netloc")),
            "__user": F.when(
                F.contains(c("netloc"), F.lit("@")), F.concat(F.substring_index(c("netloc"), "@", 1), F.lit("@"))
            ).otherwise(""),
        },
        {"__hostport": F.substr(c("netloc"), F.length(c("user")) + 1)},
        {"__hasport": has_port, "__portpiece": strip(F.split_part(c("hostport"), F.lit(":"), F.lit(2)))},
        {
            "__port": F.when(c("hasport") & c("portpiece").rlike(r"\A[+-]?[0-9]+(_[0-9]+)*\z"), port).otherwise(""),
            "__host": F.lower(
                F.when(c("hasport"), F.substring_index(c("hostport"), ":", 1)).otherwise(c("hostport"))
            ),
            "__cpath": F.when((c("path") == "") & (c("query") == ""), "/").otherwise(
                F.regexp_replace(c("path"), F.lit("/{2,}"), F.lit("/"))
            ),
        },
        {
            "__cnetloc": F.concat(
                c("user"),
                c("host"),
                F.when((c("port") == "") | default_port, "")
                .when(c("port") == "-0", ":0")
                .otherwise(F.concat(F.lit(":"), c("port"))),
            )
        },
        {
            "original_url": c("original"),
            "normalized_url": field(joined, F.lower(c("original"))),
            "scheme": field(c("scheme"), F.lit("http")),
            "domain": field(c("host"), F.lower(F.substring_index(c("original"), "/", 1))),
            "path": field(c("cpath"), blank),
            "query": field(c("query"), blank),
            "fragment": field(c("fragment"), blank),
        },
    ]


def with_canonical_url(df: DataFrame, url: str = "raw_url") -> DataFrame:
    """Add the seven canonical-URL strings."""
    out = apply_stages(df, _canonical_stages(url))
    return out.select(*[x for x in df.columns if x not in CANONICAL_FIELDS], *CANONICAL_FIELDS)


# Schemes whose URLs carry an authority part even when it is empty.
AUTHORITY_SCHEMES = [
    "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https", "shttp", "snews", "prospero",
    "rtsp", "rtsps", "rtspu", "rsync", "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss",
    "itms-services",
]


def _unsplit(scheme: Column, netloc: Column, path: Column, query: Column, fragment: Column) -> Column:
    """Join URL parts; empty query and fragment lose their delimiter."""
    rooted = F.when((path != "") & ~F.startswith(path, F.lit("/")), F.concat(F.lit("/"), path)).otherwise(path)
    body = (
        F.when(netloc != "", F.concat(F.lit("//"), netloc, rooted))
        .when(F.startswith(path, F.lit("//")), F.concat(F.lit("//"), path))
        .when(
            scheme.isin(AUTHORITY_SCHEMES) & ((path == "") | F.startswith(path, F.lit("/"))),
            F.concat(F.lit("//"), path),
        )
        .otherwise(path)
    )
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        body,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )


def root_domain(host: Column) -> Column:
    """Registered domain of a host: the last two labels, or three under a two-letter country suffix."""
    name = F.lower(strip(F.substring_index(F.coalesce(host, F.lit("")), ":", 1)))
    last = F.substring_index(name, ".", -1)
    second = F.substring_index(F.substring_index(name, ".", -2), ".", 1)
    three = second.isin(SECOND_LEVEL_LABELS) & (F.length(last) == 2)
    # With two labels or fewer both cuts return the whole name.
    return (
        F.when(name.rlike(DOTTED_QUAD), name)
        .when(three, F.substring_index(name, ".", -3))
        .otherwise(F.substring_index(name, ".", -2))
    )


def shannon_entropy(col: Column) -> Column:
    """Bits per character; 0 for the empty string."""
    total = F.length(col)
    shares = F.transform(
        F.array_distinct(F.split(col, "")), lambda ch: (total - F.length(F.replace(col, ch, F.lit("")))) / total
    )
    return F.when(total > 0, F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))).otherwise(0.0)


def _bool(condition: Column) -> Column:
    return condition.cast("int").cast("double")


@once
def _feature_stages(intended: bool) -> Stages:
    url, domain, path = F.col("normalized_url"), F.col("domain"), F.col("path")
    c = lambda name: F.col("__" + name)
    parts: Stages = [
        {"__root": root_domain(domain), "__low": F.lower(url)},
        {
            "__sub": F.when(
                c("root") != "", F.substr(domain, F.lit(1), F.greatest(F.length(domain) - F.length(c("root")), F.lit(0)))
            ).otherwise(""),
            "__tld": F.when(F.contains(domain, F.lit(".")), F.lower(F.substring_index(domain, ".", -1))).otherwise(""),
        },
        {"__subtrim": F.rtrim(c("sub"), F.lit("."))},
    ]
    if intended:
        netloc = F.regexp_extract("original_url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)|^([^/?#]*)", 0)
        port = F.regexp_extract(netloc, r":(\d+)$", 1)
        odd_port = (port != "") & ~port.isin("80", "443")
        raw_path = F.regexp_replace("original_url", F.lit(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://|[?#].*$"), F.lit(""))
        double_slash = F.contains(raw_path, F.lit("//"))
    else:
        port = F.substring_index(domain, ":", -1)
        odd_port = (
            F.contains(domain, F.lit(":")) & port.rlike(r"\A[0-9]+\z") & ~port.rlike(r"\A0*(80|443)\z")
        )
        double_slash = F.contains(path, F.lit("//"))
    groups = {
        name: _bool(contains_any(c("low"), words)) for name, words in URL_KEYWORD_GROUPS.items()
    }
    first = {
        "url_length": F.length(url),
        "hostname_length": F.length(domain),
        "path_length": F.length(path),
        "query_length": F.length("query"),
        "fragment_length": F.length("fragment"),
        "digit_count": count_digits(url),
        "letter_count": count_class(url, r"\p{L}"),
        "special_char_count": count_not_class(url, ALNUM),
        "subdomain_count": F.when(
            (c("root") != domain) & (c("subtrim") != ""), count_char(c("subtrim"), ".") + 1
        ).otherwise(0),
        "dot_count": count_char(url, "."),
        "slash_count": count_char(url, "/"),
        "hyphen_count": count_char(url, "-"),
        "underscore_count": count_char(url, "_"),
        "equal_count": count_char(url, "="),
        "ampersand_count": count_char(url, "&"),
        "percent_count": count_char(url, "%"),
        "question_mark_count": count_char(url, "?"),
        "at_symbol_count": count_char(url, "@"),
        "url_entropy": shannon_entropy(url),
        "hostname_entropy": shannon_entropy(domain),
    }
    second = {
        "is_https": _bool(F.col("scheme") == "https"),
        "has_ip_host": _bool(domain.rlike(DOTTED_QUAD)),
        "has_non_standard_port": _bool(odd_port),
        "has_punycode": _bool(F.contains(c("low"), F.lit("xn--"))),
        "has_double_slash_in_path": _bool(double_slash),
        "has_shortener": _bool(c("root").isin(URL_SHORTENERS)),
        "has_suspicious_tld": _bool(c("tld").isin(SUSPICIOUS_TLDS)),
        "consecutive_hyphens": _bool(F.contains(url, F.lit("--"))),
        "hex_encoded_char_count": F.when(
            F.contains("original_url", F.lit("%")), F.regexp_count("original_url", F.lit("%[0-9a-fA-F]{2}"))
        ).otherwise(0),
        "tld_length": F.length(c("tld")),
        "keyword_count": reduce(lambda a, b: a + b, [F.contains(c("low"), F.lit(k)).cast("int") for k in URL_KEYWORDS]),
        **groups,
        "keyword_in_subdomain": _bool(contains_any(F.lower(c("sub")), URL_KEYWORDS)),
        "keyword_in_path": _bool(contains_any(F.lower(path), URL_KEYWORDS)),
    }
    length = F.col("url_length")
    third = {
        "letter_ratio": F.when(length > 0, F.col("letter_count") / length).otherwise(0.0),
        "digit_ratio": F.when(length > 0, F.col("digit_count") / length).otherwise(0.0),
        "keyword_density": F.when(length > 0, F.col("keyword_count") / (length / 10.0)).otherwise(0.0),
    }
    doubles = [{name: value.cast("double") for name, value in stage.items()} for stage in (first, second, third)]
    return [*parts, *doubles]


def with_url_features(df: DataFrame, intended: bool = False) -> DataFrame:
    """Add the 42 URL features, all doubles, to a frame with the canonical-URL columns.

    Two features read parts that canonicalisation has already cleaned away and so are (nearly) always 0: the port
    and the double slash. ``intended=True`` takes both from the original URL instead.
    """
    return apply_stages(df, _feature_stages(intended)).select(*df.columns, *URL_FEATURES)


def url_vector(df: DataFrame, output: str = "features") -> DataFrame:
    """Assemble the 42 features, in fixed order, into a vector."""
    return VectorAssembler(inputCols=URL_FEATURES, outputCol=output).transform(df)


def char_ids(col: Column, length: int = CHAR_SEQUENCE_LENGTH) -> Column:
    """Fixed-length id sequence: printable ASCII is code - 28, anything else 1, padding 0."""
    text = F.substring(F.coalesce(col, F.lit("")), 1, length)
    ids = F.when(
        text != "",
        F.transform(F.split(text, ""), lambda ch: F.when(ch.between(" ", "~"), F.ascii(ch) - 28).otherwise(1)),
    ).otherwise(F.array().cast("array<int>"))
    return F.concat(ids, F.array_repeat(F.lit(0), F.lit(length) - F.length(text)))


def char_decode(ids: Column) -> Column:
    """Text of an id sequence. Padding vanishes; the three special ids print their names, other ids '?'."""

    def one(i: Column) -> Column:
        return (
            F.when(i == 1, "<UNK>")
            .when(i == 2, "<START>")
            .when(i == 3, "<END>")
            .when(i.between(4, 98), F.char(i + 28))
            .otherwise("?")
        )

    return F.array_join(F.transform(F.filter(ids, lambda i: i != 0), one), "")


def looks_like_url(col: Column) -> Column:
    low = strip(F.lower(col))
    return reduce(
        lambda a, b: a | b, [F.startswith(low, F.lit(p)) for p in ("http://", "https://", "ftp://", "www.")]
    ) | (F.contains(low, F.lit(".")) & F.contains(low, F.lit("/")))
