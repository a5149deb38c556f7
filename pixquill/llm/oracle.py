"""DuckDB SQL of the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

from . import decontaminate as leaks
from . import quality_rules as rules
from . import sharding
from . import source_audit as audit

SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def s(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def jump(key: str, shards: int) -> str:
    """The jump hash as a fold over ``shards`` steps."""
    high = "(x.k * {step} + 1) % 18446744073709551616::HUGEINT".format(step=f"{sharding.STEP}::HUGEINT")
    start = f"{{'k': {key}, 'b': -1::BIGINT, 'j': 0::BIGINT}}"
    on = (
        f"{{'k': {high}, 'b': x.j, 'j': CAST(floor((x.j + 1) * (2147483648.0::DOUBLE / "
        f"(({high}) // 8589934592::HUGEINT + 1)::DOUBLE)) AS BIGINT)}}"
    )
    steps = f"list_transform(range({shards}), lambda i: {start})"
    return f"CAST(list_reduce({steps}, lambda x, y: CASE WHEN x.j < {shards} THEN {on} ELSE x END, {start}).b AS INTEGER)"


def crc_table() -> list[int]:
    """What the checksum adds for each value of its last byte."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


CRC = f"""xor(list_reduce(
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
    lambda c, b: xor(c >> 8, ({crc_table()})[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"""

KEY = "('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16))::UBIGINT::HUGEINT"


def strip(expr: str) -> str:
    return f"trim({expr}, {SPACE})"


def chars(expr: str, listed: str) -> str:
    return f"(length({expr}) - length(translate({expr}, {s(listed)}, '')))"


LINE_OK = f"""(s = '' OR (
  regexp_matches(s, {s(rules.ENDINGS)})
  AND NOT (length(s) >= {rules.DENSE_FROM} AND 100 * {chars('s', rules.PUNCTUATION)} > {rules.MAX_PUNCTUATION} * length(s))
  AND {chars('s', rules.SEPARATORS)} < {rules.MIN_SEPARATORS}
  AND NOT regexp_matches(lower(s), {s(rules.BOILERPLATE)})))"""

PLAIN = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def seeds(table: str, key: str) -> str:
    """Windows of all masks, as the kept words in one text."""
    kept = [
        f"SELECT {key}, i - 1 AS pos, {m} || ' ' || " + " || ' ' || ".join(f"w[i + {j}]" for j, bit in enumerate(mask) if bit == "1")
        + f" AS seed FROM {table}, LATERAL (SELECT unnest(range(1, len(w) - {leaks.SPAN - 2})) AS i)"
        for m, mask in enumerate(leaks.MASKS)
    ]
    return " UNION ALL ".join(kept)


SQL = {
    "op8_decontamination": f"""WITH d AS (SELECT doc_id, {PLAIN} AS w FROM documents),
b AS (SELECT item_id, {PLAIN} AS w FROM benchmark),
hits AS (SELECT DISTINCT doc_id, item_id, x.pos - y.pos AS shift
  FROM ({seeds('d', 'doc_id')}) x JOIN ({seeds('b', 'item_id')}) y USING (seed)),
m AS (SELECT doc_id, item_id, least(len(b.w), {leaks.STRETCH}) AS width,
    list_transform(range(len(b.w)), lambda k: CASE WHEN shift + k >= 0 AND d.w[shift + k + 1] = b.w[k + 1] THEN 1 ELSE 0 END) AS same
  FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)),
o AS (SELECT doc_id, item_id,
    list_max(list_transform(range(len(same) - width + 1), lambda i: list_sum(same[i + 1:i + width])::DOUBLE / width)) AS overlap FROM m),
short AS (SELECT d.doc_id, b.item_id, 1.0::DOUBLE AS overlap FROM b JOIN d ON len(b.w) BETWEEN 1 AND {leaks.SPAN - 1}
  AND CASE WHEN len(b.w) >= {leaks.LEAST_WORDS} THEN contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(b.w, ' ') || ' ')
    ELSE d.w = b.w END),
e AS (SELECT doc_id, item_id, overlap FROM o WHERE overlap >= {leaks.SIMILARITY}::DOUBLE UNION ALL SELECT * FROM short),
f AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, max(overlap) AS best FROM e GROUP BY doc_id)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(best, 0.0::DOUBLE) AS best_overlap
FROM documents LEFT JOIN f USING (doc_id)""",
    "op5_jump_shards": f"""WITH d AS (SELECT doc_id, text, {KEY} AS key FROM documents),
p AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, {CRC} AS text_crc32,
  {jump('key', sharding.SHARDS)} AS shard, {jump('key', sharding.SHARDS + 1)} AS grown_shard FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(CAST(doc_id AS VARCHAR)), 1, {sharding.CELLS_DIGITS}), doc_id) - 1 AS slot FROM p""",
    "op3_quality_rules": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM d, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
m AS (SELECT doc_id, line, pos, {strip('line')} AS s FROM l),
k AS (SELECT *, {LINE_OK} AS ok FROM m),
lines AS (SELECT doc_id, CAST(count(*) FILTER (WHERE s <> '') - count(DISTINCT line) FILTER (WHERE s <> '') AS BIGINT) AS n_dup,
    count(*) FILTER (WHERE NOT ok) AS removed,
    coalesce(sum(length(line)) FILTER (WHERE s <> ''), 0) AS whole, coalesce(sum(length(line)) FILTER (WHERE s <> '' AND ok), 0) AS remaining,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE ok), '') AS cleaned
  FROM k GROUP BY doc_id),
f AS (SELECT d.doc_id, len(w) AS n_words, CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS word_chars,
    {chars('text', rules.SYMBOLS)} AS n_symbols, n_dup, coalesce(r.n, 0) AS n_repeat, removed, whole, remaining, cleaned
  FROM d JOIN lines USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat > {rules.MAX_REPEATED} * n_words AS failed FROM f)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup AS n_dup_lines, n_repeat AS n_repeat_words,
  failed AS base_failed, NOT failed AND whole - remaining <= {rules.MAX_LOST} * whole AS kept, removed AS n_lines_removed,
  sha256(cleaned) AS cleaned_sha256 FROM b""",
    "op13_source_divergence": rf"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, r, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS df FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(df) >= {audit.LEAST_DOCUMENTS}),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(n) AS total FROM x GROUP BY ALL),
p AS (SELECT x.*, 1 + ({audit.UNIT}::HUGEINT * (x.n + {audit.ADDED})) // (s.total + {audit.ADDED} * v.v) AS p,
    1 + ({audit.UNIT}::HUGEINT * (x.lang_n + {audit.ADDED})) // (v.total + {audit.ADDED} * v.v) AS q
  FROM x JOIN s USING (lang, source) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, abs(p - q) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM o WHERE part = 'pair' OR rank <= {audit.TOP_TERMS}""",
}
