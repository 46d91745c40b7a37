"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import mixing, shards

CHAT = """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
logs AS (
  SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS l, count(*) AS n
  FROM turns GROUP BY conv_id),
kept AS (
  SELECT a.conv_id, a.n, (SELECT count(*) FROM logs b WHERE b.l = a.l) - 1 AS n_copies FROM logs a
  WHERE NOT EXISTS (
    SELECT 1 FROM logs b WHERE b.conv_id <> a.conv_id
      AND ((b.n > a.n AND b.l[1:a.n] = a.l) OR (b.l = a.l AND b.conv_id < a.conv_id))))
SELECT conv_id, turn >> 6 AS part, n AS n_turns, n_copies, count(*) AS part_turns,
  string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
             ORDER BY turn, role, text) AS text
FROM turns JOIN kept USING (conv_id) GROUP BY ALL
"""


def _draws(tree: list[shards.Shard], name: str) -> str:
    """Three steps down the tree; each keeps the child with the least draw."""
    edges = ", ".join(
        f"('{parent}', '{child}', {weight})" for parent, nodes in shards.children(tree).items() for child, weight in nodes
    )
    steps = [f"{name}_edges(parent, node, weight) AS (VALUES {edges})", f"{name}_0 AS (SELECT r, k, '{shards.ROOT}' AS node FROM rows)"]
    for i in (1, 2, 3):
        steps.append(
            f"""{name}_{i} AS (
  SELECT r, k, e.node FROM {name}_{i - 1} d JOIN {name}_edges e ON e.parent = d.node
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY
    -ln((('0x' || substr(md5(k || '|' || e.node), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / e.weight, e.node) = 1)"""
        )
    return ",\n".join(steps)


def shard_sql(count: int = 24) -> str:
    """Placement on ``count`` shards and on one more, slots, sizes, and CRC-32 by its table."""
    return f"""
WITH RECURSIVE bits(step, i, c) AS (
  SELECT 0, i, i::BIGINT FROM range(256) t(i)
  UNION ALL SELECT step + 1, i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY i) AS l FROM bits WHERE step = 8),
rows AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, '') AS k, coalesce('+' || doc_id, '-') AS key,
    coalesce(text, '') AS text FROM documents),
sums AS (
  SELECT r, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda a, x: xor(a >> 8, l[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32
  FROM rows CROSS JOIN crc),
{_draws(shards.topology(count), 'now')},
{_draws(shards.topology(count + 1), 'grown')},
placed AS (
  SELECT rows.doc_id, key, strlen(text) + 8 AS size, text_crc32, CAST(substr(n.node, 2) AS INTEGER) AS shard,
    CAST(substr(g.node, 2) AS INTEGER) AS grown_shard
  FROM rows JOIN sums USING (r) JOIN now_3 n USING (r) JOIN grown_3 g USING (r))
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(key), doc_id, size, text_crc32) - 1 AS slot, grown_shard
FROM placed
"""


MIX = rf"""
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('{mixing.SEED}:' || coalesce('+' || doc_id, '-')) AS digest,
    coalesce('+' || source, '-') AS skey FROM documents),
classed AS (
  SELECT *, greatest(length(bin(size)) - 8, 0) * 128 + (size >> greatest(length(bin(size)) - 8, 0)) AS class FROM docs),
sizes AS (SELECT source, skey, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY ALL),
ranked AS (
  SELECT *, ([{', '.join(map(str, mixing.WEIGHTS))}]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight,
    row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sizes),
capped AS (SELECT *, source_size * {mixing.CAP} AS cap FROM ranked),
levels AS (
  SELECT *, row_number() OVER filling AS place,
    ((SELECT sum(source_size) FROM sizes) * {mixing.SHARE} - coalesce(sum(cap) OVER (filling ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / ((SELECT sum(weight) FROM ranked) - coalesce(sum(weight) OVER (filling ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level
  FROM capped WINDOW filling AS (ORDER BY cap / weight, rank)),
targets AS (
  SELECT skey, source_size, coalesce(CASE WHEN cap <= weight * level THEN cap
    ELSE weight * (SELECT arg_min(level, place) FROM levels WHERE cap > weight * level) END, 0.0)::DOUBLE AS target FROM levels),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY skey ORDER BY class, digest, size) AS place,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS step,
    (('0x' || substr(md5('{mixing.SEED}@' || skey), 1, 4))::BIGINT % 1024) / 1024.0::DOUBLE AS start
  FROM classed JOIN targets USING (skey)),
chosen AS (
  SELECT *, CAST(least(floor(place * step + start) - floor((place - 1) * step + start), ceil(step)) AS BIGINT) AS copies FROM placed)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM chosen
"""


# CRC-32 of UTF-8 strings by its table; ``crc_of`` reads these two.
CRC_TABLE = """bits(step, i, c) AS (
  SELECT 0, i, i::BIGINT FROM range(256) t(i)
  UNION ALL SELECT step + 1, i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY i) AS l FROM bits WHERE step = 8)"""


def crc_of(text: str) -> str:
    """The unsigned CRC-32 of a string expression, in a query with ``crc`` cross joined."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}),"
        " lambda a, x: xor(a >> 8, l[(xor(a, x) & 255) + 1])), 4294967295)"
    )


def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _tree(prefix: str, leaves: str, levels: int) -> str:
    """Levels of trees of three: (tree, i, h, n) -> (tree, i, h, n, left, right), i and n counted on the level."""
    steps = []
    for k in range(levels + 1):
        below = leaves if k == 0 else (
            f"(SELECT tree, i // 3 AS i, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h,"
            f" (max(n) + 2) // 3 AS n FROM {prefix}{k - 1} GROUP BY ALL)"
        )
        steps.append(
            f"{prefix}{k} AS MATERIALIZED (SELECT *,"
            " coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,"
            " coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r"
            f" FROM {below} WINDOW run AS (PARTITION BY tree, i // 3 ORDER BY i))"
        )
    return ",\n".join(steps)


def _paths(prefix: str, nodes: str, start: str, levels: int) -> str:
    """Proof and folded root along the levels: start has (id, tree, i, proof, f)."""
    steps = [f"{prefix}0 AS ({start})"]
    for k in range(levels):
        steps.append(
            f"{prefix}{k + 1} AS MATERIALIZED (SELECT p.id, p.tree, p.i // 3 AS i, p.proof || t.l || t.r AS proof,"
            f" CASE WHEN t.n > 1 THEN sha256(t.l || p.f || t.r) ELSE p.f END AS f"
            f" FROM {prefix}{k} p JOIN {nodes}{k} t ON t.tree = p.tree AND t.i = p.i)"
        )
    return ",\n".join(steps)


def manifest_sql(levels: int = 10, source_levels: int = 5) -> str:
    """The manifest for up to ``3 ** levels`` rows a source and ``3 ** source_levels`` sources."""
    columns = " || ".join(_field(f"{c}::VARCHAR") for c in ("doc_id", "source", "lang", "n_chars"))
    return f"""
WITH RECURSIVE {CRC_TABLE},
leaves AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, coalesce('1' || source, '0') AS tree,
    sha256({columns} || {_field("text")}) AS leaf,
    CASE WHEN {crc_of("doc_id::VARCHAR")} % 2 = 0
      THEN sha256({columns} || {_field("replace(text, chr(10), '')")}) END AS tampered
  FROM documents CROSS JOIN crc),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n
  FROM leaves),
{_tree("t", "(SELECT tree, i, leaf AS h, n FROM placed)", levels)},
tops AS (SELECT tree AS source, row_number() OVER (ORDER BY tree) - 1 AS i, h, count(*) OVER () AS n FROM t{levels}),
{_tree("s", "(SELECT '' AS tree, i, h, n FROM tops)", source_levels)},
{_paths("p", "t", "SELECT id, tree, i, '' AS proof, coalesce(tampered, leaf) AS f FROM placed", levels)},
{_paths("q", "s", f"SELECT p.id, '' AS tree, o.i, proof, f FROM p{levels} p JOIN tops o ON o.source = p.tree", source_levels)}
SELECT doc_id, leaf, o.h AS subroot, s.h AS root, sha256(q.proof) AS proof_sha256, q.f AS folded_root, q.f = s.h AS verified
FROM placed d JOIN q{source_levels} q USING (id) JOIN tops o ON o.source = d.tree CROSS JOIN s{source_levels} s
"""


RESAMPLE = f"""
WITH RECURSIVE {CRC_TABLE},
texts AS (
  SELECT 'd' AS kind, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
split AS MATERIALIZED (
  SELECT kind, r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
runs AS (
  SELECT kind, r, w, unnest(range(1, len(w) + 1)) AS i FROM split),
features AS MATERIALIZED (
  SELECT kind, r, array_to_string(w[i:i + n - 1], ' ') AS f, count(*) AS c FROM runs, range(1, 4) t(n)
  WHERE i + n - 1 <= len(w) GROUP BY ALL),
buckets AS MATERIALIZED (
  SELECT f, {crc_of('f')} % 10000 AS bucket FROM (SELECT DISTINCT f FROM features) CROSS JOIN crc),
counts AS (
  SELECT bucket, coalesce(sum(c) FILTER (kind = 'd'), 0)::DOUBLE AS s, coalesce(sum(c) FILTER (kind = 'b'), 0)::DOUBLE AS t
  FROM features JOIN buckets USING (f) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts) + 10000) / ((s + 1) * ((SELECT sum(t) FROM counts) + 10000))))::BIGINT AS gain
  FROM counts),
weighed AS (
  SELECT r, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight
  FROM features JOIN buckets USING (f) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY r),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)
      / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM split LEFT JOIN weighed USING (r) WHERE kind = 'd'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS place,
    count(*) FILTER (n_words >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM ranked
"""
