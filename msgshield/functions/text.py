"""Message text expressions: cleaning, tagging and statistics."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .chars import ALNUM, EDGE, SPACE, WORD, contains_any, count_class, count_not_class, lower_plain, strip
from .chars import token_count, with_ratios
from .fixed import AUDIT_HEADERS, CHANNEL_HEADERS, CHAT_WORDS, HTML_MARKERS, SMS_MAX_LENGTH

# The patterns decide the results; look-arounds only save time.
LINK = rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+"
# The look-aheads name the possible first characters, so most positions are left at once.
PHONE = (
    rf"(?=[+(\p{{Nd}}])(?:\+?\p{{Nd}}{{1,3}}[{SPACE}-]?)?\(?\p{{Nd}}{{3}}\)?[{SPACE}-]?\p{{Nd}}{{3}}[{SPACE}-]?\p{{Nd}}{{4}}"
    rf"|(?=\p{{Nd}})(?<![{WORD}])\p{{Nd}}{{5,6}}(?![{WORD}])"
)


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape_html(col: Column) -> Column:
    """Resolve HTML entities. Only texts that hold an ampersand are sent to Python; the others go as nulls."""
    return F.coalesce(_unescape(F.when(F.contains(col, F.lit("&")), col)), col)


def clean_text(col: Column) -> Column:
    """Entities resolved, control characters dropped, lines trimmed, blank lines removed, joined by one space."""
    text = unescape_html(F.coalesce(col, F.lit("")))
    text = F.replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), F.lit("\r"), F.lit("\n"))
    text = F.regexp_replace(text, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]+"), F.lit(""))
    lines = F.transform(F.split(text, "\n"), strip)
    return F.array_join(F.filter(lines, lambda line: line != ""), " ")


def is_raw_url(col: Column) -> Column:
    text = strip(col)
    return (
        F.startswith(text, F.lit("http://"))
        | F.startswith(text, F.lit("https://"))
        | F.startswith(text, F.lit("www."))
        | (
            (F.length(text) < 200)
            & F.contains(text, F.lit("/"))
            & F.contains(text, F.lit("."))
            & ~F.contains(text, F.lit(" "))
        )
    )


def is_html(col: Column) -> Column:
    return F.contains(col, F.lit("<")) & col.rlike("(?iu)" + "|".join(HTML_MARKERS))


def purge_reason(raw: Column, cleaned: Column) -> Column:
    """First reason to drop a message, null to keep it."""
    return (
        F.when(F.length(cleaned) < 3, "empty")
        .when(is_raw_url(raw), "raw_url")
        .when(is_html(raw), "html")
    )


def with_channel(df: DataFrame, text: str = "cleaned_text", output: str = "channel") -> DataFrame:
    """Add EMAIL, SOCIAL_CHAT or SMS; the first rule that hits decides.

    Substring searches on the lower-cased text settle most rows before a regex is tried.
    """
    t, low = F.col("__text"), F.col("__lower")
    df = df.withColumn("__text", strip(F.col(text))).withColumn("__lower", lower_plain(t))
    header = _at_line_start(t, low, CHANNEL_HEADERS)
    chat = (
        contains_any(low, CHAT_WORDS)
        | (F.contains(t, F.lit("@")) & t.rlike(f"@[{WORD}]"))
        | (F.contains(t, F.lit("#")) & t.rlike(f"#[{WORD}]"))
        | (F.contains(low, F.lit("t.co")) & low.rlike(rf"http[^{SPACE}]*t\.co"))
    )
    channel = (
        F.when(header | F.contains(t, F.lit("mailto:")), "EMAIL")
        .when(chat, "SOCIAL_CHAT")
        .when(F.length(t) <= SMS_MAX_LENGTH, "SMS")
        .otherwise("EMAIL")
    )
    return df.withColumn(output, channel).drop("__text", "__lower")


def _at_line_start(text: Column, lowered: Column, headers: list[str]) -> Column:
    """Any of the header names at the start of a line; only a line feed ends a line."""
    return contains_any(lowered, [h.lower() for h in headers]) & text.rlike("(?iumd)^(" + "|".join(headers) + ")")


def with_message_stats(df: DataFrame, text: str = "cleaned_text") -> DataFrame:
    """Add the eight statistics of a cleaned message."""
    t = F.col(text)
    links = F.when(
        F.contains(t, F.lit("://")) | F.contains(t, F.lit("www.")), F.regexp_count(t, F.lit(LINK))
    ).otherwise(0)
    df = df.withColumns(
        {
            "message_length": F.length(t),
            "word_count": token_count(t),
            "url_count": links,
            "has_phone": t.rlike(PHONE),
            "has_email_header": _at_line_start(t, lower_plain(t), AUDIT_HEADERS),
        }
    )
    length = F.col("message_length")
    return with_ratios(
        df.withColumn("has_url", F.col("url_count") > 0),
        {
            "uppercase_ratio": (count_class(t, r"\p{IsUppercase}"), length),
            "special_char_ratio": (count_not_class(t, ALNUM + SPACE), length),
        },
    )


def label_name(col: Column) -> Column:
    return F.when(col == 1, "Phishing").otherwise("Legitimate")


def channel_prefixed(text: Column, channel: Column) -> Column:
    """Model input: the text with its channel as a leading tag, the same in training and scoring."""
    return F.concat(F.lit("[CHANNEL: "), channel, F.lit("] "), text)


# The patterns of the template placeholders.
EMAIL = EDGE + r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,7}" + EDGE
HANDLE = f"@[{WORD}]+"
# The look-ahead first: few characters are digits, so the costlier look-behind is seldom tried.
NUMBER = rf"(?=\p{{Nd}})(?<![{WORD}])\p{{Nd}}+[\p{{Nd}},.-]*" + EDGE
# White space that is more or other than one space.
GAP = rf"[{SPACE}]{{2,}}|[{SPACE}&&[^ ]]"


def template_skeleton(col: Column) -> Column:
    """Lower-cased text with links, addresses, handles and numbers replaced by placeholders.

    The order matters: a link may hold an address, an address a handle or a number. A substring search decides
    whether a text needs the link and address patterns at all.
    """

    def mark(text: Column, *rules: tuple[str, str]) -> Column:
        for pattern, name in rules:
            text = F.regexp_replace(text, F.lit(pattern), F.lit(name))
        return text

    text = F.lower(F.coalesce(col, F.lit("")))
    has_link = F.contains(text, F.lit("://")) | F.contains(text, F.lit("www."))
    out = F.when(has_link, mark(text, (LINK, "[URL]"))).otherwise(text)
    out = F.when(F.contains(text, F.lit("@")), mark(out, (EMAIL, "[EMAIL]"), (HANDLE, "[USER]"))).otherwise(out)
    return strip(mark(out, (NUMBER, "[NUM]"), (GAP, " ")))
