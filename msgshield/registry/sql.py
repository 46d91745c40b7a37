"""SQL text of the oracle queries: shared CTEs and small expression builders (DuckDB dialect).

The regexes use classes that RE2 and the JVM read alike; a phrase edge is spelled as "start or non-word character".
"""

from __future__ import annotations

import re

from ..functions.chars import SPACE, SPACE_CHARS
from ..functions.fixed import ACCOUNT_THREAT, AUDIT_HEADERS, BRANDS, CHANNEL_HEADERS, CHAT_WORDS, CREDENTIAL
from ..functions.fixed import HTML_MARKERS, MESSAGE_SHORTENERS, OTP, PAYMENT, QR_SHORTENERS, SECOND_LEVEL_LABELS
from ..functions.fixed import SUSPICIOUS_TLDS, URGENCY, URL_KEYWORD_GROUPS, URL_KEYWORDS, URL_SHORTENERS

SP, NSP = f"[{SPACE}]", f"[^{SPACE}]"
W, NW = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
QUAD = r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names(values: list[str]) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def dbl(expr: str) -> str:
    return f"(round(CAST({expr} AS DOUBLE), 6) + 0.0)"


def round_even(x: str, digits: int) -> str:
    """Round half to even on the exact binary value; ``x`` is a plain column."""
    s = f"{10**digits}.0::DOUBLE"
    high = f"({x} * 134217729.0::DOUBLE - ({x} * 134217729.0::DOUBLE - {x}))"
    prod = f"({x} * {s})"
    err = f"(({high} * {s} - {prod}) + ({x} - {high}) * {s})"
    base = f"floor({prod})"
    rest = f"({prod} - {base})"
    up = (
        f"CASE WHEN {rest} > 0.5 OR ({rest} = 0.5 AND ({err} > 0 OR ({err} = 0 AND {base} % 2 = 1))) "
        "THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    )
    return f"(({base} + {up}) / {s})"


def strip(x: str) -> str:
    return f"trim({x}, {lit(SPACE_CHARS)})"


def count_char(x: str, c: str) -> str:
    return f"(length({x}) - length(replace({x}, {lit(c)}, '')))"


def keep(x: str, body: str) -> str:
    """Number of characters of a class."""
    return f"length(regexp_replace({x}, '[^{body}]', '', 'g'))"


def cut(x: str, body: str) -> str:
    return f"length(regexp_replace({x}, '[{body}]', '', 'g'))"


def words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '{SP}+'), lambda w: w <> ''))"


def phrase(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '(^|{NW})({pattern})($|{NW})')"


def any_phrase(x: str, patterns: list[str]) -> str:
    return phrase(x, "|".join(patterns))


def contains_any(x: str, values: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(v)})" for v in values) + ")"


def entropy(x: str) -> str:
    n = f"length({x})"
    p = f"(({n} - length(replace({x}, ch, '')))::DOUBLE / {n})"
    return (
        f"CASE WHEN {n} > 0 THEN -coalesce(list_sum(list_transform(list_distinct(string_split({x}, '')), "
        f"lambda ch: {p} * log2({p}))), 0.0) ELSE 0.0 END"
    )


def root_domain(host: str) -> str:
    h = f"lower({strip(f'split_part({host}, {lit(':')}, 1)')})"
    return (
        f"CASE WHEN regexp_matches({h}, '{QUAD}') THEN {h} "
        f"WHEN len(string_split({h}, '.')) >= 3 AND string_split({h}, '.')[-2] IN {names(SECOND_LEVEL_LABELS)} "
        f"AND length(string_split({h}, '.')[-1]) = 2 THEN array_to_string(string_split({h}, '.')[-3:], '.') "
        f"ELSE array_to_string(string_split({h}, '.')[-2:], '.') END"
    )


LABEL = "CASE WHEN starts_with(url, 'http://') THEN 1 ELSE 0 END"
TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
LINK = f"https?://{NSP}+|www\\.{NSP}+"
LINK_BARE = LINK + rf"|\b[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,6}}/{NSP}*"
SHORT = "(?i)" + "|".join(re.escape(s) for s in MESSAGE_SHORTENERS)

CTE: dict[str, str] = {}

CTE["raw_messages"] = f"""
  SELECT d.doc_id * 8 AS ordinal, d.text, l.toxic AS label FROM documents d LEFT JOIN labels l USING (doc_id)
  UNION ALL SELECT d.doc_id * 8 + 1, d.text || ' see ' || p.url, {LABEL} FROM documents d JOIN pages p ON d.doc_id = p.page_id
  UNION ALL SELECT (conv_id * 1000 + turn) * 8 + 2, text, CASE WHEN role = 'user' THEN 0 ELSE 1 END FROM conversations
  UNION ALL SELECT page_id * 8 + 3, html, {LABEL} FROM pages
  UNION ALL SELECT page_id * 8 + 4, url, {LABEL} FROM pages
  UNION ALL SELECT page_id * 8 + 5, {TITLE}, {LABEL} FROM pages"""

_ENTITIES = "text"
for _name, _char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("nbsp", " "), ("lt", "<"), ("gt", ">"), ("amp", "&")):
    _ENTITIES = f"regexp_replace({_ENTITIES}, '&{_name};?', {lit(_char)}, 'g')"
_LINES = f"string_split(regexp_replace(translate({_ENTITIES}, ' ' || chr(13), ' ' || chr(10)), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), chr(10))"
_STRIPPED = strip("raw_text")
CTE["cleaned"] = f"""
  SELECT ordinal, label, coalesce(text, '') AS raw_text,
    array_to_string(list_filter(list_transform({_LINES}, lambda s: {strip('s')}), lambda s: s <> ''), ' ') AS cleaned_text
  FROM raw_messages WHERE label IN (0, 1)"""
CTE["tagged"] = f"""
  SELECT *, CASE WHEN length(cleaned_text) < 3 THEN 'empty'
    WHEN starts_with({_STRIPPED}, 'http://') OR starts_with({_STRIPPED}, 'https://') OR starts_with({_STRIPPED}, 'www.')
      OR (length({_STRIPPED}) < 200 AND contains({_STRIPPED}, '/') AND contains({_STRIPPED}, '.') AND NOT contains({_STRIPPED}, ' '))
      THEN 'raw_url'
    WHEN regexp_matches(raw_text, '(?i){"|".join(HTML_MARKERS)}') THEN 'html' END AS purge_reason
  FROM cleaned"""
CTE["kept"] = """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cleaned_text ORDER BY ordinal) AS copy FROM tagged
    WHERE purge_reason IS NULL) WHERE copy = 1"""
_T = strip("cleaned_text")
CTE["clean"] = f"""
  SELECT ordinal, label, raw_text, cleaned_text, row_number() OVER (ORDER BY ordinal) AS number,
    CASE WHEN regexp_matches({_T}, '(?im)^({"|".join(CHANNEL_HEADERS)})') OR contains({_T}, 'mailto:') THEN 'EMAIL'
      WHEN regexp_matches({_T}, '(?i)(@{W}+|#{W}+|http{NSP}*t\\.co|{"|".join(CHAT_WORDS)})') THEN 'SOCIAL_CHAT'
      WHEN length({_T}) <= 300 THEN 'SMS' ELSE 'EMAIL' END AS channel
  FROM kept"""
_PHONE = (
    rf"(\+?\p{{Nd}}{{1,3}}[{SPACE}-]?)?\(?\p{{Nd}}{{3}}\)?[{SPACE}-]?\p{{Nd}}{{3}}[{SPACE}-]?\p{{Nd}}{{4}}"
    rf"|(^|{NW})\p{{Nd}}{{5,6}}($|{NW})"
)
CTE["stats"] = f"""
  SELECT *, length(cleaned_text) AS message_length, {words('cleaned_text')} AS word_count,
    len(regexp_extract_all(cleaned_text, '{LINK}')) AS url_count,
    regexp_matches(cleaned_text, '{_PHONE}') AS has_phone,
    regexp_matches(cleaned_text, '(?im)^({"|".join(AUDIT_HEADERS)})') AS has_email_header,
    {keep('cleaned_text', chr(92) + 'p{Lu}')}::DOUBLE / greatest(length(cleaned_text), 1) AS upper_share,
    {cut('cleaned_text', chr(92) + 'p{L}' + chr(92) + 'p{N}' + SPACE)}::DOUBLE / greatest(length(cleaned_text), 1) AS special_share
  FROM clean"""
CTE["links"] = f"""
  SELECT ordinal, cleaned_text AS t, lower(cleaned_text) AS low, regexp_extract_all(cleaned_text, '{LINK_BARE}') AS urls,
    keep_upper, keep_digit, keep_special
  FROM (SELECT *, {keep('cleaned_text', chr(92) + 'p{Lu}')}::DOUBLE / greatest(length(cleaned_text), 1) AS keep_upper,
    {keep('cleaned_text', chr(92) + 'p{Nd}')}::DOUBLE / greatest(length(cleaned_text), 1) AS keep_digit,
    {cut('cleaned_text', chr(92) + 'p{L}' + chr(92) + 'p{N}' + SPACE)}::DOUBLE / greatest(length(cleaned_text), 1) AS keep_special
    FROM clean)"""


def _exists(condition: str) -> str:
    return f"(CASE WHEN len(list_filter(urls, lambda u: {condition})) > 0 THEN 1 ELSE 0 END)"


SIGNALS = {
    "message_length": "length(t)",
    "word_count": words("t"),
    "sentence_count": f"greatest(len(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda s: {strip('s')} <> '')), 1)",
    "uppercase_ratio": round_even("keep_upper", 4),
    "digit_ratio": round_even("keep_digit", 4),
    "special_char_ratio": round_even("keep_special", 4),
    "exclamation_count": count_char("t", "!"),
    "question_count": count_char("t", "?"),
    "has_url": "(CASE WHEN len(urls) > 0 THEN 1 ELSE 0 END)",
    "url_count": "len(urls)",
    "domain_count": "len(list_distinct(list_transform(urls, lambda u: regexp_extract(u, 'https?://([^/]+)|www\\.([^/]+)|([^/]+)', 0))))",
    "has_ip_url": _exists(r"regexp_matches(u, '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b')"),
    "has_shortened_url": _exists(f"regexp_matches(u, '{SHORT}')"),
    "has_http_only": _exists("starts_with(u, 'http://')"),
    "url_length_max": "coalesce(list_max(list_transform(urls, lambda u: length(u))), 0)",
    "urgency_score": " + ".join(f"CAST({phrase('low', p)} AS INT)" for p in URGENCY),
    **{
        name: f"CAST({any_phrase('low', patterns)} AS INT)"
        for name, patterns in {
            "account_threat": ACCOUNT_THREAT,
            "credential_request": CREDENTIAL,
            "otp_request": OTP,
            "payment_request": PAYMENT,
            "impersonation_flag": BRANDS,
        }.items()
    },
}
CTE["signals"] = "  SELECT ordinal, " + ",\n    ".join(f"{v} AS {k}" for k, v in SIGNALS.items()) + " FROM links"

_SKELETON = "lower(cleaned_text)"
for _pattern, _mark in (
    (LINK, "[URL]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,7}\b", "[EMAIL]"),
    (f"@{W}+", "[USER]"),
    (r"\b[0-9]+[0-9,.-]*\b", "[NUM]"),
    (f"{SP}+", " "),
):
    _SKELETON = f"regexp_replace({_SKELETON}, '{_pattern}', '{_mark}', 'g')"
CTE["skeletons"] = f"  SELECT *, {strip(_SKELETON)} AS template_skeleton FROM clean"
CTE["templates"] = """
  SELECT *, row_number() OVER (ORDER BY first_ordinal) - 1 AS template_id FROM (
    SELECT template_skeleton, min(ordinal) AS first_ordinal, count(label) AS size, max(label) AS label,
      arg_min(channel, ordinal) AS channel FROM skeletons GROUP BY template_skeleton)"""
CTE["template_order"] = """
  SELECT template_skeleton, sum(size) OVER (ORDER BY md5('42:' || template_skeleton)
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    (SELECT CAST(floor(count(*) * 0.1::DOUBLE) AS BIGINT) FROM clean) AS target FROM templates"""
CTE["test_b"] = "  SELECT template_skeleton FROM template_order WHERE coalesce(before, 0) < target"
CTE["message_splits"] = """
  SELECT ordinal, channel, label, template_skeleton, CASE WHEN in_b THEN 'test_b' WHEN place <= n_a THEN 'test_a'
      WHEN place <= n_a + n_v THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT *, floor(members::DOUBLE * share) AS n_a, floor(members::DOUBLE * share) AS n_v
    FROM (SELECT *, row_number() OVER (PARTITION BY in_b, channel, label ORDER BY md5('42:' || sha256(cleaned_text))) AS place,
        count(*) OVER (PARTITION BY in_b, channel, label) AS members,
        (count(*) OVER () * 0.1::DOUBLE) / sum(CASE WHEN in_b THEN 0 ELSE 1 END) OVER () AS share
      FROM (SELECT *, template_skeleton IN (SELECT template_skeleton FROM test_b) AS in_b FROM skeletons)))"""

CTE["external"] = """
  SELECT item_id * 2 AS ordinal, text AS cleaned_text, 'spam' AS final_label FROM benchmark
  UNION ALL SELECT doc_id * 2 + 1, text,
    CASE lang WHEN 'en' THEN 'ham' WHEN 'fr' THEN 'smishing' ELSE 'unknown' END FROM documents"""
CTE["holdout"] = f"""
  SELECT ordinal, cleaned_text, CASE WHEN final_label = 'ham' THEN 0 ELSE 1 END AS label FROM (
    SELECT ordinal, t AS cleaned_text, final_label, row_number() OVER (PARTITION BY t ORDER BY ordinal) AS copy
    FROM (SELECT *, {strip('cleaned_text')} AS t FROM external WHERE cleaned_text IS NOT NULL) WHERE length(t) >= 3)
  WHERE copy = 1 AND final_label IN ('ham', 'smishing', 'spam')
    AND cleaned_text NOT IN (SELECT {strip('text')} FROM documents SEMI JOIN labels USING (doc_id) WHERE text IS NOT NULL)"""

_BARE = "replace(replace(url, 'https://', ''), 'http://', '')"
CTE["variants"] = f"""
  SELECT page_id * 8 + 0 AS ordinal, url AS raw_url, {LABEL} AS label FROM pages
  UNION ALL SELECT page_id * 8 + 1, replace(url, '.example.', '.'), {LABEL} FROM pages
  UNION ALL SELECT page_id * 8 + 2, upper(url), {LABEL} FROM pages
  UNION ALL SELECT page_id * 8 + 3, replace(replace(url, 'http://', 'http://user@Secure-Login.paypal.'), '.example.', '.xyz:8080//'), {LABEL} FROM pages
  UNION ALL SELECT page_id * 8 + 4, ' http://10.20.30.40:080/login--verify/%41%zz/' || page_id, {LABEL} FROM pages
  UNION ALL SELECT page_id * 8 + 5, {_BARE}, {LABEL} FROM pages
  UNION ALL SELECT page_id * 8 + 6, 'bit.ly/' || page_id, {LABEL} FROM pages
  UNION ALL SELECT page_id * 8 + 7, 'https://w.a.b.xn--shop' || page_id || '.co.uk:443/account//update/?q=é#' || page_id, {LABEL} FROM pages"""


def canonical(source: str, extra: str) -> list[tuple[str, str]]:
    """CTEs ``url_split`` and ``canonical`` over a source with ``raw_url``; well-formed authorities only."""
    return [
        (
            "url_split",
            f"""
  SELECT *, lower(regexp_extract(full_url, '^([^:]+)://', 1)) AS scheme0,
    regexp_extract(full_url, '^[^:]+://([^/?#]*)', 1) AS netloc,
    regexp_extract(full_url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path0,
    regexp_extract(full_url, '^[^?#]*\\?([^#]*)', 1) AS query,
    regexp_extract(full_url, '^[^#]*#(.*)$', 1) AS fragment
  FROM (SELECT *, regexp_replace(CASE WHEN regexp_matches(original_url, '^[a-zA-Z][a-zA-Z0-9+,.\\-]*://') THEN original_url
      ELSE 'http://' || original_url END, '[\t\r\n]', '', 'g') AS full_url
    FROM (SELECT *, {strip('raw_url')} AS original_url FROM {source}))""",
        ),
        (
            "canonical",
            f"""
  SELECT {extra}, original_url, scheme0 AS scheme, host AS domain, path, query, fragment,
    scheme0 || '://' || userinfo || host || CASE WHEN port = '' OR (scheme0, port) IN (('http', '80'), ('https', '443'), ('ftp', '21'))
      THEN '' ELSE ':' || port END || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END
      || CASE WHEN fragment <> '' THEN '#' || fragment ELSE '' END AS normalized_url
  FROM (SELECT *, lower(split_part(hostport, ':', 1)) AS host,
      regexp_replace(regexp_extract(hostport, '^[^:]*:([0-9]+)(:|$)', 1), '^0+([0-9])', '\\1') AS port,
      CASE WHEN path0 = '' AND query = '' THEN '/' ELSE regexp_replace(path0, '/+', '/', 'g') END AS path
    FROM (SELECT *, regexp_extract(netloc, '^[^@]*@') AS userinfo, regexp_replace(netloc, '^[^@]*@', '') AS hostport FROM url_split))""",
        ),
    ]


def _flag(condition: str) -> str:
    return f"(CASE WHEN {condition} THEN 1 ELSE 0 END)"


_U = "normalized_url"
URL_FEATURE_SQL = {
    "url_length": f"length({_U})",
    "hostname_length": "length(domain)",
    "path_length": "length(path)",
    "query_length": "length(query)",
    "fragment_length": "length(fragment)",
    "digit_count": keep(_U, r"\p{Nd}"),
    "letter_count": keep(_U, r"\p{L}"),
    "special_char_count": cut(_U, r"\p{L}\p{N}"),
    "letter_ratio": f"{keep(_U, chr(92) + 'p{L}')}::DOUBLE / length({_U})",
    "digit_ratio": f"{keep(_U, chr(92) + 'p{Nd}')}::DOUBLE / length({_U})",
    "subdomain_count": "CASE WHEN root = domain THEN 0 ELSE len(string_split(rtrim(sub, '.'), '.')) END",
    **{
        f"{name}_count": count_char(_U, char)
        for name, char in (
            ("dot", "."), ("slash", "/"), ("hyphen", "-"), ("underscore", "_"), ("equal", "="), ("ampersand", "&"),
            ("percent", "%"), ("question_mark", "?"), ("at_symbol", "@"),
        )
    },
    "url_entropy": entropy(_U),
    "hostname_entropy": entropy("domain"),
    "is_https": _flag("scheme = 'https'"),
    "has_ip_host": _flag(f"regexp_matches(domain, '{QUAD}')"),
    "has_non_standard_port": "0",
    "has_punycode": _flag("contains(low, 'xn--')"),
    "has_double_slash_in_path": _flag("contains(path, '//')"),
    "has_shortener": _flag(f"root IN {names(URL_SHORTENERS)}"),
    "has_suspicious_tld": _flag(f"contains(domain, '.') AND string_split(domain, '.')[-1] IN {names(SUSPICIOUS_TLDS)}"),
    "consecutive_hyphens": _flag(f"contains({_U}, '--')"),
    "hex_encoded_char_count": "len(regexp_extract_all(original_url, '%[0-9a-fA-F]{2}'))",
    "tld_length": "CASE WHEN contains(domain, '.') THEN length(string_split(domain, '.')[-1]) ELSE 0 END",
    "keyword_count": " + ".join(f"CAST(contains(low, {lit(k)}) AS INT)" for k in URL_KEYWORDS),
    **{name: _flag(contains_any("low", group)) for name, group in URL_KEYWORD_GROUPS.items()},
    "keyword_in_subdomain": _flag(contains_any("sub", URL_KEYWORDS)),
    "keyword_in_path": _flag(contains_any("lower(path)", URL_KEYWORDS)),
    "keyword_density": "(" + " + ".join(f"CAST(contains(low, {lit(k)}) AS INT)" for k in URL_KEYWORDS)
    + f")::DOUBLE / (length({_U}) / 10.0::DOUBLE)",
}
CTE["url_parts"] = f"""
  SELECT *, substr(domain, 1, length(domain) - length(root)) AS sub, lower(normalized_url) AS low
  FROM (SELECT *, {root_domain('domain')} AS root FROM canonical)"""
CTE["url_features"] = (
    "  SELECT *, " + ",\n    ".join(f"{v} AS {k}" for k, v in URL_FEATURE_SQL.items()) + " FROM url_parts"
)

CTE["decodes"] = f"""
  SELECT *, 'QR_' || lpad(CAST(row_number() OVER (ORDER BY ordinal) AS VARCHAR), 6, '0') AS qr_id,
    'img_' || ordinal || '.png' AS image_filename, CASE WHEN label = 1 THEN 'malicious' ELSE 'benign' END AS source_folder
  FROM (SELECT page_id * 8 AS ordinal, url AS payload, {LABEL} AS label FROM pages
    UNION ALL SELECT page_id * 8 + 1, '0    ' || url || chr(10) || 'Name: url, dtype: object', {LABEL} FROM pages
    UNION ALL SELECT page_id * 8 + 2, 'Scan me: ' || url || ' today', 1 - {LABEL} FROM pages
    UNION ALL SELECT page_id * 8 + 3, {TITLE}, {LABEL} FROM pages
    UNION ALL SELECT page_id * 8 + 4, replace(url, '.example.', '.Xyz:8080/;p=1/a;b=c%20@') || ';s=1', {LABEL} FROM pages
    UNION ALL SELECT event_id * 8 + 7, NULL, CASE WHEN value > 10 THEN 1 ELSE 0 END FROM events WHERE event_type = 'error')"""
CTE["extracted"] = f"""
  SELECT *, CASE WHEN found = '' THEN '' ELSE lower(regexp_extract(found, '^([^:]+)://', 1)) END AS scheme,
    lower(regexp_extract(found, '^[^:]+://([^/?#]*)', 1)) AS netloc,
    regexp_replace(regexp_extract(found, '^[^:]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS path,
    regexp_extract(found, '^[^?#]*\\?([^#]*)', 1) AS query, regexp_extract(found, '^[^#]*#(.*)$', 1) AS fragment
  FROM (SELECT *, regexp_extract(coalesce(payload, ''), '(?i)https?://{NSP}+') AS found,
      {strip("regexp_replace(" + strip("regexp_replace(" + strip("coalesce(payload, '')") + ", '(?s)' || chr(10) || 'Name:.*$', '')") + f", '^[0-9]+{SP}+', '')")} AS content
    FROM decodes)"""
CTE["qr_urls"] = """
  SELECT *, CASE WHEN netloc = '' THEN '' ELSE scheme || '://' || netloc || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END
      || CASE WHEN fragment <> '' THEN '#' || fragment ELSE '' END END AS normalized_url,
    regexp_replace(regexp_replace(netloc, '^.*@', ''), ':.*$', '') AS domain,
    CASE WHEN coalesce(payload, '') = '' THEN 'unknown' WHEN netloc <> '' THEN 'url' ELSE 'non_url' END AS content_type
  FROM extracted"""
QR_FEATURE_SQL = {
    "url_length": "length(normalized_url)",
    "domain": "domain",
    "domain_length": "length(domain)",
    "path_length": "length(path)",
    "query_length": "length(query)",
    "fragment_length": "length(fragment)",
    "subdomain_count": "CASE WHEN domain = '' THEN 0 ELSE greatest(len(string_split(domain, '.')) - 2, 0) END",
    "has_https": _flag("scheme = 'https'"),
    "has_http": _flag("scheme = 'http'"),
    "has_ip_address": _flag(f"regexp_matches(domain, '{QUAD}')"),
    "has_port": _flag("regexp_matches(netloc, ':[0-9]*[1-9][0-9]*$')"),
    "has_at_symbol": _flag("contains(normalized_url, '@')"),
    "has_encoded_characters": _flag("contains(normalized_url, '%')"),
    "has_shortener_pattern": _flag(f"domain IN {names(QR_SHORTENERS)}"),
    "digit_count": keep("normalized_url", r"\p{Nd}"),
    "special_character_count": cut("normalized_url", r"\p{L}\p{N}"),
}
CTE["qr_raw"] = (
    "  SELECT ordinal, qr_id, image_filename, '/qr/' || source_folder || '/' || image_filename AS image_path, source_folder, label,\n"
    "    CASE WHEN payload IS NULL THEN '' ELSE content END AS decoded_content, normalized_url, content_type,\n"
    "    CASE WHEN payload IS NULL THEN 'failed' ELSE 'success' END AS decode_status,\n    "
    + ",\n    ".join(f"{v} AS {k}" for k, v in QR_FEATURE_SQL.items())
    + ",\n    CASE WHEN payload IS NULL THEN 'no_qr_detected_or_unreadable' ELSE '' END AS decode_error FROM qr_urls"
)

CTE["sources"] = f"""
  SELECT replace(url, '.example.', '.') AS raw_url, {LABEL} AS label, 'existing_url' AS source, page_id AS ordinal FROM pages
  UNION ALL SELECT replace(replace(split_part(split_part(replace(url, '.example.', '.'), '#', 1), '?', 1), 'http://', 'HTTP://'),
    'https://m.', 'https://pay.'), {LABEL}, 'qr_decoded', page_id FROM pages"""
CTE["corpus"] = f"""
  SELECT raw_url, normalized_url, domain, {root_domain('domain')} AS root_domain, label, source FROM (
    SELECT *, row_number() OVER (PARTITION BY normalized_url
      ORDER BY CASE WHEN source = 'qr_decoded' THEN 1 ELSE 0 END, label, ordinal) AS copy FROM canonical WHERE normalized_url <> '')
  WHERE copy = 1"""
CTE["unseen"] = """
  SELECT root_domain FROM (SELECT root_domain, row_number() OVER (ORDER BY md5('42:' || root_domain)) AS place,
    count(*) OVER () AS n FROM (SELECT DISTINCT root_domain FROM corpus)) WHERE place <= floor(n * 0.15::DOUBLE)"""


def _stage(name: str, source: str, pool: str, fraction: str, seed: int, mark: str) -> None:
    CTE[name] = f"""
  SELECT *, {pool} AND place <= floor(members::DOUBLE * {fraction}::DOUBLE) AS {mark} FROM (
    SELECT * EXCLUDE (place, members), row_number() OVER (PARTITION BY {pool}, label ORDER BY md5('{seed}:' || normalized_url)) AS place,
      count(*) OVER (PARTITION BY {pool}, label) AS members FROM {source})"""


CTE["domain_split"] = """
  SELECT *, root_domain IN (SELECT root_domain FROM unseen) AS is_unseen, 0 AS place, 0 AS members FROM corpus"""
_stage("qr_split", "domain_split", "(NOT is_unseen AND source = 'qr_decoded')", "0.25", 42, "is_qr")
_stage("random_split", "qr_split", "(NOT is_unseen AND NOT is_qr)", "0.15", 43, "is_random")
_stage("validation_split", "random_split", "(NOT is_unseen AND NOT is_qr AND NOT is_random)", "0.15", 44, "is_validation")
CTE["url_splits"] = """
  SELECT raw_url, normalized_url, domain, root_domain, label, source, CASE WHEN is_unseen THEN 'test_unseen_domain'
    WHEN is_qr THEN 'test_qr_unseen' WHEN is_random THEN 'test_random' WHEN is_validation THEN 'validation' ELSE 'train' END AS split
  FROM validation_split"""
URL_SPLIT_CHAIN = ["corpus", "unseen", "domain_split", "qr_split", "random_split", "validation_split", "url_splits"]

CTE["scored"] = """
  SELECT *, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS pred FROM (
    SELECT vec_id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS label,
      round(1.0::DOUBLE / (1.0::DOUBLE + exp(embedding[1]::DOUBLE * -8.0::DOUBLE)), 6) AS prob,
      CASE WHEN label IN (0, 1, 5, 6) THEN 'EMAIL' WHEN label IN (2, 3, 7) THEN 'SMS' ELSE 'SOCIAL_CHAT' END AS channel,
      CASE WHEN embedding[2]::DOUBLE < -0.05::DOUBLE THEN 'test_a' WHEN embedding[2]::DOUBLE < 0.05::DOUBLE THEN 'test_b' ELSE 'test_c' END AS split,
      CASE WHEN embedding[3]::DOUBLE < -0.05::DOUBLE THEN 'test_random' WHEN embedding[3]::DOUBLE < 0.05::DOUBLE THEN 'test_unseen_domain' ELSE 'test_qr_unseen' END AS suite
    FROM embeddings)"""

CLEAN_CHAIN = ["raw_messages", "cleaned", "tagged", "kept", "clean"]


def query(ctes: list, select: str) -> str:
    parts = [c if isinstance(c, tuple) else (c, CTE[c]) for c in ctes]
    head = ",\n".join(f"{name} AS ({body}\n)" for name, body in parts)
    return f"WITH {head}\n{select}" if parts else select
