"""Train/test splits. Random order is a hash order, so a row's place depends on its key only.

All splits work by cut-off: a few narrow aggregates find the hash value where a quota is filled, then every row is
placed by comparing its own hash. The rows themselves are never shuffled. Strata are combinations of a few categories
(label, channel, source), and the tables of cut-offs that are broadcast have one row for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .ordering import integer_digits, rank_cutoffs, shuffle_key, weight_cutoff

SEED = 42


def first_per_class(df: DataFrame, strata: list[str], n: int, ordinal: str = "ordinal") -> DataFrame:
    """The first ``n`` rows of every stratum by ordinal."""
    size = lambda total: F.least(total, F.lit(n))
    cutoffs = rank_cutoffs(df, strata, ordinal, {"__cut": size}, digits=integer_digits)
    return df.join(F.broadcast(cutoffs), strata).filter(F.col(ordinal) <= F.col("__cut")).drop("__cut")


def stratified_parts(
    df: DataFrame, strata: list[str], key: str, parts: dict[str, float], rest: str, seed: int = SEED
) -> DataFrame:
    """Add ``split``: per stratum, in hash order of the unique ``key``, the first int(n * f1) rows get the first
    name, the next int(n * f2) the second, the others ``rest``. Reads keys and strata twice; pass a stored table."""
    rows = df.withColumn("__hash", shuffle_key(seed, F.col(key)))
    names = list(parts)

    def quota(count: int):
        return lambda total: sum(
            (F.floor(total.cast("double") * F.lit(parts[name])) for name in names[1:count]),
            F.floor(total.cast("double") * F.lit(parts[names[0]])),
        )

    cuts = {f"__cut{i}": quota(i + 1) for i in range(len(names))}
    rows = rows.join(F.broadcast(rank_cutoffs(rows, strata, "__hash", cuts)), strata, "left")
    split = F.when(F.col("__hash") <= F.col("__cut0"), names[0])
    for i, name in enumerate(names[1:], 1):
        split = split.when(F.col("__hash") <= F.col(f"__cut{i}"), name)
    return rows.withColumn("split", split.otherwise(rest)).select(*df.columns, "split")


def unseen_keys(df: DataFrame, digest: str, fraction: float) -> str | None:
    """The digest up to which a key is unseen: that of the int(fraction * n)-th of the n distinct digests, None for none."""
    units = df.select(digest).distinct()
    cut = rank_cutoffs(units, [], digest, {"cut": lambda n: F.floor(n.cast("double") * F.lit(fraction))}).first()
    return cut["cut"] if cut else None


def split_templates(
    df: DataFrame,
    skeleton: str = "template_skeleton",
    key: str = "ordinal",
    test_a: float = 0.10,
    test_b: float = 0.10,
    validation: float = 0.10,
    seed: int = SEED,
) -> DataFrame:
    """Add ``split``: whole templates make up ``test_b``; the rest is split per channel and label.

    Expects ``channel`` and ``label``; ``key`` is a unique column. The hashes and strata are stored as a narrow table,
    from which all cut-offs are found; the wide rows are read once more, to be placed.
    """
    rows = df.withColumns({"__template": shuffle_key(seed, F.col(skeleton)), "__hash": shuffle_key(seed, F.col(key))})
    narrow = stored(rows.select("channel", "label", "__template", "__hash"), "split-hashes")
    cutoff, total, taken = weight_cutoff(narrow, "__template", test_b)
    in_b = F.col("__template") <= F.lit(cutoff) if cutoff is not None else F.lit(False)
    rest = total - taken
    if rest == 0:
        return rows.withColumn("split", F.lit("test_b")).select(*df.columns, "split")
    share_a, share_v = (total * test_a) / rest, (total * validation) / rest
    first = lambda n: F.floor(n.cast("double") * F.lit(share_a))
    second = lambda n: first(n) + F.floor(n.cast("double") * F.lit(share_v))
    cuts = rank_cutoffs(narrow.filter(~in_b), ["channel", "label"], "__hash", {"__a": first, "__v": second})
    rows = rows.join(F.broadcast(cuts), ["channel", "label"], "left")
    split = (
        F.when(in_b, "test_b")
        .when(F.col("__hash") <= F.col("__a"), "test_a")
        .when(F.col("__hash") <= F.col("__v"), "validation")
        .otherwise("train")
    )
    return rows.withColumn("split", split).select(*df.columns, "split")


def balanced_sample(df: DataFrame, key: str, cap: int | None, label: str = "label", seed: int = SEED) -> DataFrame:
    """Equally many rows of label 0 and 1 in hash order of a unique key: as many as the smaller class has, and at most
    ``cap`` if that is given."""
    rows = df.filter(F.col(label).isin(0, 1)).withColumn("__hash", shuffle_key(seed, F.col(key)))
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    fewest, classes = sizes.agg(F.min("n"), F.count(F.lit(1))).first()
    quota = 0 if classes < 2 else fewest if cap is None else min(fewest, cap)
    cuts = rank_cutoffs(rows, [label], "__hash", {"__cut": lambda n: F.lit(quota)})
    chosen = rows.join(F.broadcast(cuts), label).filter(F.col("__hash") <= F.col("__cut"))
    return chosen.select(*df.columns)


def split_sizes(df: DataFrame) -> DataFrame:
    """Rows and percentage per split."""
    counts = df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    total = F.sum("rows").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("percent", F.round(F.col("rows") * 100.0 / total, 6))
