"""SQL twins, for DuckDB, of the llm queries that SQL can express. The trained and hashed ones (1, 5, 6, 7, 10, 11) are tested against brute force instead."""

from __future__ import annotations

from panelloom.llm import mixing, quality_rules, sharding

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SHARDS, SLOTS = 24, 2 ** mixing.SLOT_BITS

#: CRC-32 byte by byte; the table of 256 remainders is made from its polynomial.
CRC_TABLE = """
crc_table AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(list_concat([n], range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
              FROM (SELECT range::BIGINT AS n FROM range(256))))
"""


def crc(text: str) -> str:
    """CRC-32 of a text, where ``crc_table`` is joined."""
    return f"""xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)),
                                     lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"""


CRC = f"""{CRC_TABLE},
crc AS (SELECT text, {crc("text")} AS text_crc32 FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL), crc_table)
"""

op2 = f"""
WITH {CRC},
sized AS (SELECT doc_id, text, coalesce(octet_length(encode(text)), 0) + {sharding.ROW_BYTES} AS size, md5(text) AS digest FROM documents),
placed AS (SELECT *, coalesce(sum(size) OVER before, 0)::BIGINT AS start, row_number() OVER every - 1 AS index FROM sized
           WINDOW every AS (ORDER BY digest NULLS FIRST, doc_id NULLS FIRST), before AS (ORDER BY digest NULLS FIRST, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cuts AS (SELECT cut, total * cut / {SHARDS}.0 AS place, {sharding.TOLERANCE} * total / {SHARDS} AS slack FROM (SELECT sum(size)::DOUBLE AS total FROM sized), range(1, {SHARDS}) r(cut)),
split AS (SELECT cut, digest FROM cuts JOIN placed ON start < place AND place < start + size),
edges AS (SELECT digest, min(start) AS lo, max(start + size) AS hi FROM placed GROUP BY digest),
near AS (SELECT c.cut, place, slack, CASE WHEN place - lo <= hi - place THEN lo ELSE hi END AS edge FROM cuts c LEFT JOIN split USING (cut) LEFT JOIN edges USING (digest)),
bounds AS (SELECT CASE WHEN abs(edge - place) <= slack THEN edge ELSE place END AS place FROM near),
sharded AS (SELECT placed.*, (SELECT count(*) FROM bounds WHERE bounds.place <= placed.start) AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INT AS shard, index - min(index) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard FROM sharded LEFT JOIN crc USING (text)
"""

_RATES = {"mean_word": "word_chars", "symbol_rate": "n_symbols", "dup_line_rate": "n_dup_lines", "repeat_rate": "n_repeat_words"}
_Q = quality_rules
_RAW = ", ".join(f"quantile_disc({c}, {_Q.MIDDLE}) + {_Q.SPREAD} * (quantile_disc({c}, {_Q.HIGH}) - quantile_disc({c}, {_Q.MIDDLE})) + {_Q.SLACK[c]} AS {c}_limit" for c in _RATES)
_SHRUNK = ", ".join(f"(g.n * g.{c}_limit + {_Q.PRIOR} * up.{c}_limit) / (g.n + {_Q.PRIOR}) AS {c}_limit" for c in _RATES)
op3 = rf"""
WITH docs AS (SELECT row_number() OVER () AS row, *, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
twice AS (SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, k) > 1),
covered AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY row),
counted AS (SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM docs LEFT JOIN covered USING (row)),
rated AS (SELECT *, n_words < {quality_rules.LEAST_WORDS} OR 100 * n_repeat_words > {quality_rules.MOST_REPEATED} * n_words AS base_failed,
                 {", ".join(f"{n} / greatest(n_words, 1)::DOUBLE AS {c}" for c, n in _RATES.items())} FROM counted),
every AS (SELECT {_RAW} FROM rated WHERE NOT base_failed),
languages AS (SELECT g.lang, {_SHRUNK} FROM (SELECT lang, count(*) AS n, {_RAW} FROM rated WHERE NOT base_failed GROUP BY lang) g, every up),
limits AS (SELECT g.lang, g.source, {_SHRUNK} FROM (SELECT lang, source, count(*) AS n, {_RAW} FROM rated WHERE NOT base_failed GROUP BY lang, source) g JOIN languages up ON g.lang IS NOT DISTINCT FROM up.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(f"coalesce({c} <= {c}_limit, true)" for c in _RATES)} AS kept
FROM rated r LEFT JOIN limits l ON r.lang IS NOT DISTINCT FROM l.lang AND r.source IS NOT DISTINCT FROM l.source
"""

_ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
op4 = rf"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_ITEM_WORDS} AS w FROM documents), items AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS k
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT row, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
met AS (SELECT row, i, p.n, item_id FROM places p JOIN windows USING (n, k)),
hit AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS p FROM met) GROUP BY row),
named AS (SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT row, item_id::VARCHAR AS item_id FROM met WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (row) LEFT JOIN named USING (row)
"""

op8 = f"""
WITH sized AS (SELECT doc_id, source, len({WORDS}) AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sized),
sources AS (SELECT source, source_size, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
capped AS (SELECT *, {mixing.MOST_EPOCHS}.0 * source_size AS cap, row_number() OVER (ORDER BY {mixing.MOST_EPOCHS}.0 * source_size / weight, source NULLS LAST) AS place FROM sources),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                     / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped),
firsts AS (SELECT place AS first_place, level AS share FROM levels WHERE level <= cap / weight ORDER BY place LIMIT 1),
targets AS (SELECT source, source_size, (CASE WHEN place >= first_place THEN weight * share ELSE cap END)::DOUBLE AS target FROM levels, firsts),
shares AS (SELECT *, coalesce(lag(high) OVER (ORDER BY source NULLS LAST), 0) AS low, lead(high) OVER (ORDER BY source NULLS LAST) IS NULL AS last
           FROM (SELECT *, sum(target) OVER (ORDER BY source NULLS LAST) / sum(target) OVER () AS high FROM targets WHERE target > 0)),
points AS (SELECT slot, list_sum(list_transform(range({mixing.SLOT_BITS}), lambda b: ((slot >> b) & 1) << ({mixing.SLOT_BITS} - 1 - b)))::BIGINT / {SLOTS}.0 AS point FROM range({SLOTS}) r(slot)),
met AS (SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM points JOIN shares ON point >= low AND (point < high OR last)),
slots AS (SELECT * FROM met UNION ALL
          SELECT source, slot, 0 FROM shares s JOIN points ON point = least(floor(low * {SLOTS}), {SLOTS} - 1) / {SLOTS}.0 WHERE NOT EXISTS (SELECT 1 FROM met WHERE met.source IS NOT DISTINCT FROM s.source)),
sourced AS (SELECT t.*, coalesce(n, 0) AS n, round(target)::BIGINT AS total FROM targets t LEFT JOIN (SELECT source, count(*) AS n FROM slots GROUP BY source) c ON t.source IS NOT DISTINCT FROM c.source),
ends AS (SELECT p.*, source_size, target, total, n, CASE WHEN source_size > 0 THEN (start + size) * (total // source_size) + least(start + size, total % source_size)
                                                                - start * (total // source_size) - least(start, total % source_size) ELSE 0 END AS taken
         FROM placed p JOIN sourced t ON p.source IS NOT DISTINCT FROM t.source),
ranks AS (SELECT *, CASE WHEN total > 0 AND start < total THEN start * n // total END AS r0, CASE WHEN taken > 0 THEN (least(start + size, total) - 1) * n // total END AS r1 FROM ends)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken, a.slot AS first_slot, b.slot AS last_slot
FROM ranks e LEFT JOIN slots a ON e.source IS NOT DISTINCT FROM a.source AND r0 = a.rank LEFT JOIN slots b ON e.source IS NOT DISTINCT FROM b.source AND r1 = b.rank
"""

op9 = r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM docs JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

op12 = rf"""
WITH {CRC_TABLE},
own AS (SELECT conv_id, list({{'k': sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 'words': len({WORDS})}}
                             ORDER BY turn NULLS FIRST, sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
headed AS (SELECT conv_id, turns, conv_id - conv_id % 20 AS base, {crc("conv_id::VARCHAR")} % 4 AS h FROM own, crc_table),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:h], c.turns[h + 1:]) AS turns FROM headed c LEFT JOIN own b ON b.conv_id = c.base),
prefixes AS (SELECT conv_id, d, array_to_string(list_transform(turns[1:d], lambda t: t.k), '') AS node, array_to_string(list_transform(turns[1:d - 1], lambda t: t.k), '') AS up,
                    CASE WHEN d > 0 THEN turns[d].words ELSE 0 END AS words, d = len(turns) AS is_end FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT node, d, CASE WHEN d > 0 THEN min(up) END AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved,
                 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256 FROM prefixes GROUP BY node, d),
children AS (SELECT up AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY up),
known AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (node)),
below AS (SELECT left(node, 64 * a) AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM known) GROUP BY 1)
SELECT k.conv_id, k.d AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM known k JOIN below USING (node) LEFT JOIN nodes p ON p.node = k.up AND k.d > 0
"""

_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _leaf(**changed: str) -> str:
    values = [f"{changed.get(f, f)}::VARCHAR" for f in _FIELDS]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v}))::VARCHAR || ':' || {v}, '-')" for v in values) + ")"


op13 = f"""
WITH RECURSIVE {CRC_TABLE},
rows AS (SELECT doc_id, source, {_leaf()} AS leaf, {_leaf(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS altered FROM documents),
crcs AS (SELECT doc_id, {crc("doc_id::VARCHAR")} % 5 = 0 AS tampered FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crc_table),
leaves AS (SELECT r.*, coalesce(tampered, false) AS tampered, row_number() OVER (PARTITION BY source ORDER BY r.doc_id NULLS FIRST, leaf) - 1 AS i FROM rows r LEFT JOIN crcs c ON c.doc_id = r.doc_id),
up AS (SELECT source, 0 AS level, list(leaf ORDER BY i) AS hs FROM leaves GROUP BY source
       UNION ALL SELECT source, level + 1, list_transform(range((len(hs) + 15) // 16), lambda k: sha256(array_to_string(hs[k * 16 + 1:k * 16 + 16], ''))) FROM up WHERE len(hs) > 1),
subroots AS (SELECT source, hs[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM up WHERE len(hs) = 1),
top AS (SELECT 0 AS level, list(subroot ORDER BY i) AS hs FROM subroots
        UNION ALL SELECT level + 1, list_transform(range((len(hs) + 15) // 16), lambda k: sha256(array_to_string(hs[k * 16 + 1:k * 16 + 16], ''))) FROM top WHERE len(hs) > 1),
steps AS (SELECT l.doc_id, l.source, l.i AS row, level, (l.i // pow(16, level)::BIGINT) AS pos, hs FROM leaves l JOIN up u ON l.source IS NOT DISTINCT FROM u.source AND len(hs) > 1
          UNION ALL SELECT l.doc_id, l.source, l.i, 100 + level, (s.i // pow(16, level)::BIGINT), hs FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source JOIN top ON len(hs) > 1),
sides AS (SELECT source, row, level, array_to_string(hs[pos - pos % 16 + 1:pos], '') AS l, array_to_string(hs[pos + 2:pos - pos % 16 + 16], '') AS r FROM steps),
proof AS (SELECT source, row, list(l || '|' || r ORDER BY level) AS way FROM sides GROUP BY source, row),
known AS (SELECT e.*, subroot, (SELECT hs[1] FROM top WHERE len(hs) = 1) AS root, coalesce(way, []) AS way
          FROM leaves e JOIN subroots s ON e.source IS NOT DISTINCT FROM s.source LEFT JOIN proof p ON e.source IS NOT DISTINCT FROM p.source AND e.i = p.row),
fold AS (SELECT *, list_reduce(list_concat([CASE WHEN tampered THEN altered ELSE leaf END], way), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root FROM known)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(way, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM fold
"""

ORACLES: dict[str, str] = {"op2_sharding": op2, "op3_quality_rules": op3, "op4_decontamination": op4, "op8_mixing": op8, "op9_near_dedup": op9, "op12_conversation_trie": op12,
                           "op13_merkle_manifest": op13}
