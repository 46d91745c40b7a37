"""Input frames of the registered queries, derived from the given tables. All rows of the tables take part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import formatted_id, sequential_id


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table, as it lies."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    """A given table dealt out by its key, for queries with much work per row: a table of one file is one task.

    The plan is the same at every size; a caller with many files passes its table as it lies to the operator.
    """
    return table(spark, sf, name).repartition(key)


def _http_label() -> Column:
    """Stand-in label of a page: 1 for an unencrypted address."""
    return F.when(F.startswith("url", F.lit("http://")), 1).otherwise(0)


def _title() -> Column:
    return F.regexp_extract("html", "<title>([^<]*)</title>", 1)


def raw_messages(spark: SparkSession, sf: str) -> DataFrame:
    """(ordinal, text, label): documents, documents with a link, conversation turns, page sources, links, titles."""
    documents, pages = spread(spark, sf, "documents", "doc_id"), spread(spark, sf, "pages", "page_id")
    linked = documents.join(pages, documents.doc_id == pages.page_id)

    def rows(df: DataFrame, key: Column, kind: int, text: Column, label: Column) -> DataFrame:
        return df.select((key * 8 + kind).alias("ordinal"), text.alias("text"), label.cast("int").alias("label"))

    parts = [
        rows(documents.join(table(spark, sf, "labels"), "doc_id", "left"), F.col("doc_id"), 0, F.col("text"), F.col("toxic")),
        rows(linked, F.col("doc_id"), 1, F.concat("text", F.lit(" see "), "url"), _http_label()),
        rows(
            table(spark, sf, "conversations"),
            F.col("conv_id") * 1000 + F.col("turn"),
            2,
            F.col("text"),
            F.when(F.col("role") == "user", 0).otherwise(1),
        ),
        # Source, address and title of a page, from one scan.
        pages.select("page_id", _http_label().alias("label"), F.posexplode(F.array("html", "url", _title()))).select(
            (F.col("page_id") * 8 + 3 + F.col("pos")).alias("ordinal"), F.col("col").alias("text"), "label"
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def external_messages(spark: SparkSession, sf: str) -> DataFrame:
    """(ordinal, cleaned_text, final_label): benchmark passages and all documents, labelled by language."""
    benchmark = table(spark, sf, "benchmark").select(
        (F.col("item_id") * 2).alias("ordinal"), F.col("text").alias("cleaned_text"), F.lit("spam").alias("final_label")
    )
    label = F.when(F.col("lang") == "en", "ham").when(F.col("lang") == "fr", "smishing").otherwise("unknown")
    documents = table(spark, sf, "documents").select(
        (F.col("doc_id") * 2 + 1).alias("ordinal"), F.col("text").alias("cleaned_text"), label.alias("final_label")
    )
    return benchmark.unionByName(documents)


def master_messages(spark: SparkSession, sf: str) -> DataFrame:
    """(cleaned_text): the labelled documents."""
    labelled = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return labelled.select(F.col("text").alias("cleaned_text"))


def url_variants(spark: SparkSession, sf: str) -> DataFrame:
    """(ordinal, raw_url, label): every page address in eight spellings that exercise ports, user parts, case,
    doubled slashes, addresses by number, short links, deep subdomains and country suffixes."""
    url, page = F.col("url"), F.col("page_id").cast("string")
    bare = F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    spellings = F.array(
        url,
        F.replace(url, F.lit(".example."), F.lit(".")),
        F.upper(url),
        F.replace(
            F.replace(url, F.lit("http://"), F.lit("http://user@Secure-Login.paypal.")),
            F.lit(".example."),
            F.lit(".xyz:8080//"),
        ),
        F.concat(F.lit(" http://10.20.30.40:080/login--verify/%41%zz/"), page),
        bare,
        F.concat(F.lit("bit.ly/"), page),
        F.concat(F.lit("https://w.a.b.xn--shop"), page, F.lit(".co.uk:443/account//update/?q=é#"), page),
    )
    pages = spread(spark, sf, "pages", "page_id").select("page_id", _http_label().alias("label"), F.posexplode(spellings))
    return pages.select((F.col("page_id") * 8 + F.col("pos")).alias("ordinal"), F.col("col").alias("raw_url"), "label")


def qr_decodes(spark: SparkSession, sf: str) -> DataFrame:
    """Decode results: page addresses plain, as a printed column, in a sentence and with ports and parameters; page
    titles as non-URLs; error events as failed decodes."""
    url = F.col("url")
    label = _http_label()
    payloads = F.array(
        F.struct(url.alias("payload"), label.alias("label")),
        F.struct(F.concat(F.lit("0    "), url, F.lit("\nName: url, dtype: object")).alias("payload"), label.alias("label")),
        F.struct(F.concat(F.lit("Scan me: "), url, F.lit(" today")).alias("payload"), (1 - label).alias("label")),
        F.struct(_title().alias("payload"), label.alias("label")),
        F.struct(
            F.concat(F.replace(url, F.lit(".example."), F.lit(".Xyz:8080/;p=1/a;b=c%20@")), F.lit(";s=1")).alias("payload"),
            label.alias("label"),
        ),
    )
    pages = spread(spark, sf, "pages", "page_id").select("page_id", F.posexplode(payloads))
    none = F.lit(None).cast("string")
    decoded = pages.select(
        (F.col("page_id") * 8 + F.col("pos")).alias("ordinal"), "col.payload", "col.label", none.alias("decode_error")
    )
    events = table(spark, sf, "events").filter(F.col("event_type") == "error")
    failed = events.select(
        (F.col("event_id") * 8 + 7).alias("ordinal"),
        none.alias("payload"),
        F.when(F.col("value") > 10, 1).otherwise(0).alias("label"),
        F.lit("no_qr_detected_or_unreadable").alias("decode_error"),
    )
    rows = sequential_id(decoded.unionByName(failed), "ordinal", "__number", start=1)
    name = F.concat(F.lit("img_"), F.col("ordinal").cast("string"), F.lit(".png"))
    folder = F.when(F.col("label") == 1, "malicious").otherwise("benign")
    return rows.select(
        "ordinal",
        formatted_id("QR", F.col("__number")).alias("qr_id"),
        name.alias("image_filename"),
        F.concat(F.lit("/qr/"), folder, F.lit("/"), name).alias("image_path"),
        folder.alias("source_folder"),
        "label",
        "payload",
        "decode_error",
    )


def url_sources(spark: SparkSession, sf: str) -> DataFrame:
    """(raw_url, label, source, ordinal): page addresses without the ``.example`` label, and the same without query
    and fragment, in other case, as QR payloads."""
    short = F.replace("url", F.lit(".example."), F.lit("."))
    pages = spread(spark, sf, "pages", "page_id")
    labelled = pages.select(
        short.alias("raw_url"), _http_label().alias("label"), F.lit("existing_url").alias("source"),
        F.col("page_id").alias("ordinal"),
    )
    cut = F.substring_index(F.substring_index(short, "#", 1), "?", 1)
    payload = F.replace(F.replace(cut, F.lit("http://"), F.lit("HTTP://")), F.lit("https://m."), F.lit("https://pay."))
    qr = pages.select(
        payload.alias("raw_url"), _http_label().alias("label"), F.lit("qr_decoded").alias("source"),
        F.col("page_id").alias("ordinal"),
    )
    return labelled.unionByName(qr)


def scored_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, label, prob, pred, channel, split, suite): one scored row per embedding."""
    e = lambda i: F.col("embedding")[i].cast("double")
    kind = F.col("label")
    part = lambda x, a, b, names: F.when(x < a, names[0]).when(x < b, names[1]).otherwise(names[2])
    rows = table(spark, sf, "embeddings").select(
        "vec_id",
        (kind >= 5).cast("int").alias("label"),
        F.round(1.0 / (1.0 + F.exp(e(0) * -8.0)), 6).alias("prob"),
        F.when(kind.isin(0, 1, 5, 6), "EMAIL").when(kind.isin(2, 3, 7), "SMS").otherwise("SOCIAL_CHAT").alias("channel"),
        part(e(1), -0.05, 0.05, ["test_a", "test_b", "test_c"]).alias("split"),
        part(e(2), -0.05, 0.05, ["test_random", "test_unseen_domain", "test_qr_unseen"]).alias("suite"),
    )
    return rows.withColumn("pred", (F.col("prob") >= 0.5).cast("int"))
