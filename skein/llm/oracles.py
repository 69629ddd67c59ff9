"""The operators' rows in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from skein.llm.common import LOWER, UPPER
from skein.llm.licenses import BASE, COMMON, template_words
from skein.llm.mixing import WEIGHTS

_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
#: Words of the token queries, and those between blanks.
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BLANK_WORDS = rf"regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+')"
#: The first 60 bits of an MD5 sum as a number.
_DRAW = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"

#: The same rows in DuckDB, for the operators that SQL can express.
TOP_K = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def licenses(least: float = 0.6) -> str:
    parts = ", ".join(f"({t}, '{label}', {place}, '{word}', {must})" for t, label, place, word, must in template_words())
    base = ", ".join(f"('{phrase}', '{label}', {len(phrase.split())})" for phrase, label in BASE)
    common = ", ".join(f"'{w}'" for w in sorted(COMMON))
    return f"""
WITH tok AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
parts(template, label, place, word, must) AS (VALUES {parts}),
base(phrase, label, n) AS (VALUES {base}),
pos AS (
  SELECT * FROM (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS pos FROM tok)
  WHERE word IN (SELECT word FROM parts) OR word IN (SELECT unnest(string_split(phrase, ' ')) FROM base)
),
idf AS (
  SELECT p.word, CASE WHEN p.word IN ({common}) THEN 0.0
    ELSE ln((1 + (SELECT count(*) FROM tok)) / (1.0 + coalesce(d.df, 0))) + 0.01 END AS idf
  FROM (SELECT DISTINCT word FROM parts) p
  LEFT JOIN (SELECT word, count(DISTINCT rid) AS df FROM pos GROUP BY word) d ON p.word = d.word
),
start AS (
  SELECT pos.rid, t.template, t.label, pos.pos - t.place AS start, sum(idf.idf) AS met, count(*) FILTER (t.must) AS musts
  FROM pos JOIN parts t ON pos.word = t.word JOIN idf ON idf.word = t.word
  GROUP BY pos.rid, t.template, t.label, pos.pos - t.place
),
whole AS (SELECT template, sum(idf) AS idf, count(*) FILTER (must) AS all_musts FROM parts JOIN idf USING (word) GROUP BY template),
matched AS (
  SELECT rid, label, round(met / idf, 6) AS share FROM start JOIN whole USING (template)
  WHERE musts = all_musts AND met / idf >= {least}
),
placed AS (
  SELECT rid, label, spot FROM tok, base, unnest(range(len(w) - n + 1)) AS r(spot)
  WHERE array_to_string(w[spot + 1 : spot + n], ' ') = phrase
),
counted AS (
  SELECT rid, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM placed GROUP BY rid
),
named AS (
  SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT rid, label FROM placed UNION ALL SELECT rid, label FROM matched) GROUP BY rid
),
best AS (SELECT rid, max(share) AS share FROM matched GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM tok LEFT JOIN counted USING (rid) LEFT JOIN named USING (rid) LEFT JOIN best USING (rid)
"""


def decontamination(width: int = 10, near: float = 0.8) -> str:
    return f"""
WITH tok AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least({width}, len(w)) AS n, w[spot + 1 : spot + {width}] AS terms
  FROM items, unnest(range(greatest(len(w) - {width} + 1, 1))) AS r(spot) WHERE len(w) > 0
),
hit AS (
  SELECT DISTINCT rid, item_id, spot, n
  FROM (
    SELECT rid, spot, n, w[spot + 1 : spot + n] AS terms
    FROM tok, (SELECT DISTINCT n FROM win), unnest(range(len(w) - n + 1)) AS r(spot)
  ) JOIN win USING (n, terms)
),
places AS (SELECT rid, count(DISTINCT p) AS n_hit FROM hit, unnest(range(spot, spot + n)) AS r(p) GROUP BY rid),
named AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY rid),
term AS (SELECT item_id, n, terms, unnest(terms) AS word, unnest(range(n)) AS place FROM win),
post AS (SELECT * FROM (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS pos FROM tok) WHERE word IN (SELECT word FROM term)),
close AS (
  SELECT rid, item_id FROM post JOIN term USING (word) GROUP BY rid, item_id, terms, n, pos - place
  HAVING count(*) >= ceil(n * {near})
),
near AS (SELECT rid, count(DISTINCT item_id) AS n_near FROM close ANTI JOIN hit USING (rid, item_id) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM tok LEFT JOIN places USING (rid) LEFT JOIN named USING (rid) LEFT JOIN near USING (rid)
"""


#: CRC-32 of a text's bytes, by the reflected polynomial's table.
_CRC = """
crc_step AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
  FROM range(256) r(i)
),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_step)"""
_CRC_OF = """xor(4294967295, list_reduce(
  list_prepend(4294967295::BIGINT, list_transform(range(0, CAST(length(bytes) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(bytes, 2 * i + 1, 2) AS BIGINT))),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])))"""


def sharding(shards: int = 16, seed: int = 20) -> str:
    unit = "least(CAST({} AS DOUBLE) / 1152921504606846976.0, 1.0 - 2.220446049250313e-16)"
    return f"""
WITH {_CRC},
raw AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS bytes FROM documents),
row AS (
  SELECT doc_id, source, size, {_CRC_OF} AS text_crc32, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS stratum FROM raw, crc_table
),
shuffled AS (SELECT *, {_DRAW.format(f"concat_ws('|', '{seed}', doc_id, text_crc32)")} AS shuffle FROM row),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY shuffle, doc_id NULLS FIRST, text_crc32, size) AS rank, count(*) OVER (PARTITION BY stratum) AS n FROM shuffled
),
shared AS (
  SELECT *, least((rank - 1 + {unit.format(_DRAW.format(f"concat_ws('|', '{seed + 1}', stratum)"))}) / n, 1.0 - 2.220446049250313e-16) AS share FROM ranked
),
placed AS (
  SELECT *, row_number() OVER (ORDER BY share, stratum, shuffle, doc_id NULLS FIRST, text_crc32, size) - 1 AS place, count(*) OVER () AS whole FROM shared
),
dealt AS (SELECT *, place * {shards} // whole AS spot FROM placed)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(spot AS INTEGER) AS shard,
  CAST(place - (spot * whole + {shards - 1}) // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM dealt
"""


def near_duplicates(width: int = 5, percent: int = 75) -> str:
    return f"""
WITH RECURSIVE tok AS (SELECT row_number() OVER () AS rid, doc_id, {_BLANK_WORDS} AS w FROM documents),
sets AS (
  SELECT rid, doc_id, CASE WHEN len(w) >= {width}
    THEN list_distinct(list_transform(range(len(w) - {width} + 1), lambda i: array_to_string(w[i + 1 : i + {width}], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM tok
),
entry AS (SELECT rid, len(s) AS n, unnest(s) AS shingle FROM sets),
link AS (
  SELECT a.rid AS x, b.rid AS y FROM entry a JOIN entry b ON a.shingle = b.shingle AND a.rid <> b.rid
  GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
),
reach(rid, other) AS (
  SELECT rid, rid FROM sets UNION SELECT reach.rid, link.y FROM reach JOIN link ON reach.other = link.x
)
SELECT a.doc_id, CAST(len(a.s) AS BIGINT) AS n_shingles, min(b.doc_id) AS component_id
FROM reach JOIN sets a ON reach.rid = a.rid JOIN sets b ON reach.other = b.rid GROUP BY a.rid, a.doc_id, len(a.s)
"""


def mixing(repeats: int = 3, seed: int = 9) -> str:
    """For rows of one source each, where the flow has a single way: each
    source's quota, in whole passes and a rest. Sources whose targets are cut
    come first in the order of size by weight."""
    weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    return f"""
WITH row AS (SELECT doc_id, source, len({_BLANK_WORDS}) AS size, md5(coalesce(text, '')) AS digest FROM documents),
src AS (
  SELECT source, sum(size) AS own, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} {weight} END AS weight
  FROM row GROUP BY source
),
filled AS (
  SELECT *, (SELECT sum(size) FROM row) - coalesce(sum({repeats} * own) OVER before, 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open_weight,
    row_number() OVER (ORDER BY own / weight, source NULLS LAST) AS nth
  FROM src WINDOW before AS (ORDER BY own / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
level AS (SELECT min(nth) AS nth FROM filled WHERE CAST(rest AS DOUBLE) * weight / open_weight <= {repeats} * own),
target AS (
  SELECT f.source, f.own, CASE WHEN l.nth IS NULL OR f.nth < l.nth THEN CAST({repeats} * f.own AS DOUBLE)
    ELSE CAST(g.rest AS DOUBLE) * f.weight / g.open_weight END AS target
  FROM filled f, level l LEFT JOIN filled g ON g.nth = l.nth
),
quota AS (
  SELECT *, CASE WHEN own > 0 THEN least(CAST(floor(target + 0.5) AS BIGINT), {repeats} * own) // own ELSE 1 END AS passes,
    CASE WHEN own > 0 THEN least(CAST(floor(target + 0.5) AS BIGINT), {repeats} * own) % own ELSE 0 END AS need
  FROM target
),
drawn AS (
  SELECT r.*, q.own, q.target, q.passes, q.need, {_DRAW.format(f"concat_ws('|', '{seed}', r.doc_id, r.digest)")} AS draw
  FROM row r JOIN quota q ON r.source IS NOT DISTINCT FROM q.source
),
run AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id NULLS FIRST, digest ROWS UNBOUNDED PRECEDING) AS upto FROM drawn
),
gaps AS (SELECT source, max(need) - coalesce(max(upto) FILTER (upto <= need), 0) AS gap FROM run GROUP BY source),
fill AS (
  SELECT r.source, arg_min((r.draw, r.upto), (abs(gap - size), draw, upto)) AS pick
  FROM run r JOIN gaps g ON r.source IS NOT DISTINCT FROM g.source
  WHERE upto > need AND size > 0 AND abs(gap - size) < gap GROUP BY r.source
),
out AS (
  SELECT r.*, passes + CASE WHEN size > 0 AND need > 0 AND (upto <= need OR coalesce((r.draw, r.upto) = f.pick, FALSE)) THEN 1 ELSE 0 END AS copies
  FROM run r LEFT JOIN fill f ON r.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(own AS BIGINT) AS source_size, target, CAST(copies * size AS BIGINT) AS taken,
  CAST(copies AS INTEGER) AS copies, source
FROM out
"""


def manifest(levels: int = 5, fanout: int = 16) -> str:
    """Trees of up to fanout ** levels leaves a source, and sources: each level
    keeps a node for every group, which is its own parent where it is alone."""
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR) END"
    covered = [field.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = [*covered[:-1], field.format(f"translate(text, '{UPPER}', '{LOWER}')")]

    def tree(name: str, base: str) -> str:
        """Tables name_0 to name_levels of (grp, place, digest, n, before, after)."""
        out = [f"{name}_0 AS ({base})"]
        for i in range(1, levels + 1):
            out.append(f"""{name}_{i} AS (
  SELECT grp, place // {fanout} AS place, CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY place)) END AS digest,
    CAST((any_value(n) + {fanout - 1}) // {fanout} AS BIGINT) AS n
  FROM {name}_{i - 1} GROUP BY grp, place // {fanout}
)""")
        for i in range(levels):
            out.append(f"""{name}_{i}s AS (
  SELECT *, n = 1 AS alone, coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}_{i} WINDOW run AS (PARTITION BY grp, place // {fanout} ORDER BY place)
)""")
        return ",\n".join(out)

    def climb(name: str, grp: str, place: str) -> str:
        return " ".join(f"JOIN {name}_{i}s {name}{i} ON {name}{i}.grp = {grp} AND {name}{i}.place = {place} // {fanout**i}" for i in range(levels))

    proof = []
    for name in ("a", "b"):
        for i in range(levels):
            proof.append(f"CASE WHEN {name}{i}.alone THEN '' ELSE {name}{i}.l || {name}{i}.r END")
    steps, last = [], "f0"
    for k, (name, i) in enumerate([(n, i) for n in ("a", "b") for i in range(levels)], 1):
        node = f"{name}{i}"
        steps.append(f"f{k} AS (SELECT * REPLACE (CASE WHEN {node}_alone THEN digest ELSE sha256({node}_l || digest || {node}_r) END AS digest) FROM {last})")
        last = f"f{k}"
    sides = ", ".join(f"{n}{i}.alone AS {n}{i}_alone, {n}{i}.l AS {n}{i}_l, {n}{i}.r AS {n}{i}_r" for n in ("a", "b") for i in range(levels))
    return f"""
WITH {_CRC},
raw AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), ''))) AS bytes FROM documents),
leaf AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS grp, sha256({" || ".join(covered)}) AS digest,
    CASE WHEN doc_id IS NOT NULL AND {_CRC_OF} % 5 = 0 THEN sha256({" || ".join(tampered)}) END AS tampered
  FROM raw, crc_table
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest) - 1 AS place, count(*) OVER (PARTITION BY grp) AS n FROM leaf),
{tree("a", "SELECT grp, place, digest, n FROM ranked")},
named AS (SELECT grp AS name, digest, row_number() OVER (ORDER BY encode(grp)) - 1 AS place, count(*) OVER () AS n FROM a_{levels}),
{tree("b", "SELECT '' AS grp, place, digest, n FROM named")},
f0 AS (
  SELECT ranked.doc_id, ranked.digest AS leaf, named.digest AS subroot, top.digest AS root, sha256({" || ".join(proof)}) AS proof_sha256,
    coalesce(ranked.tampered, ranked.digest) AS digest, {sides}
  FROM ranked JOIN named ON ranked.grp = named.name JOIN b_{levels} top ON TRUE
  {climb("a", "ranked.grp", "ranked.place")} {climb("b", "''", "named.place")}
),
{", ".join(steps)}
SELECT doc_id, leaf, subroot, root, proof_sha256, digest AS folded_root, digest = root AS verified FROM {last}
"""


def conversations() -> str:
    """Row by row, the best (cost, letters, lines) of each of the four states."""
    far = "{'c': 1000000000, 'a': '', 't': CAST([] AS VARCHAR[])}"

    def add(state: str, cost: str, letter: str, line: str | None = None) -> str:
        lines = f"list_append({state}.t, {line})" if line else f"{state}.t"
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {lines}}}"

    def best(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    def insert(state: str, role: str) -> str:
        return add(state, "2", "I", f"'{role}:'")

    def takes(state: str, role: str) -> list[str]:
        stays = "f.fate IN ('clean', 'cut')"
        kept = f"CASE WHEN {stays} AND f.initial = '{role[0]}' THEN {add(state, 'f.more', 'K', 'f.line')} END"
        return [kept, f"CASE WHEN {stays} THEN {add(state, '2 + f.more', 'R', f"'{role}:' || f.text")} END"]

    system = f"CASE WHEN f.fate IN ('clean', 'cut') AND f.initial = 's' THEN {add('s0', 'f.more', 'K', 'f.line')} END"
    after_user = [w for q in ("s0", "s1", "s3") for w in takes(q, "user")]
    return rf"""
WITH RECURSIVE {_CRC},
spaced AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, md5(coalesce(role, ' ') || ':' || coalesce(text, ' ')) AS tie,
    hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS bytes
  FROM conversations
),
drawn AS (SELECT *, {_CRC_OF} % 20 AS draw FROM spaced, crc_table),
hurt AS (
  SELECT conv_id, turn, tie, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
    CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM drawn, range(CASE draw WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) c(copy)
),
told AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tie, copy) AS i,
    CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE 'o' END AS initial,
    regexp_replace(text, '[ 	-]+$', '') AS stem
  FROM hurt
),
fact AS (
  SELECT *, CASE WHEN stem = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN substr(stem, -1) NOT IN ('.', '!', '?') THEN 'cut' ELSE 'clean' END AS fate,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before, role || ':' || text AS line
  FROM told
),
priced AS (SELECT *, CASE WHEN fate = 'cut' THEN 1 ELSE 0 END AS more FROM fact),
run(conv_id, i, s0, s1, s2, s3) AS (
  SELECT conv_id, CAST(0 AS BIGINT), {{'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])}}, {far}, {insert("{'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])}", "user")},
    {{'c': 4, 'a': 'II', 't': ['user:', 'assistant:']}}
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, r0, r1, q2, {best("r3", insert("q2", "assistant"))}
  FROM (
    SELECT *, {best("r2", insert("r0", "user"), insert("r1", "user"), insert("r3", "user"))} AS q2
    FROM (
      SELECT f.conv_id, f.i, {add("s0", "3", "D")} AS r0, {best(add("s1", "3", "D"), system)} AS r1,
        {best(add("s2", "3", "D"), *after_user)} AS r2, {best(add("s3", "3", "D"), *takes("s2", "assistant"))} AS r3
      FROM run JOIN priced f ON f.conv_id IS NOT DISTINCT FROM run.conv_id AND f.i = run.i + 1
    )
  )
),
ends AS (
  SELECT conv_id, {best("s0", "s3")} AS s FROM run
  WHERE i = (SELECT count(*) FROM priced WHERE priced.conv_id IS NOT DISTINCT FROM run.conv_id)
),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fate = 'blank') AS blank,
    count(*) FILTER (fate = 'duplicate') AS duplicate, count(*) FILTER (fate = 'cut') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM priced GROUP BY conv_id
)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(e.s.c AS BIGINT) AS cost, e.s.a AS audit,
  sha256(array_to_string(e.s.t, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN counted c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def sql() -> dict[str, str]:
    return {
        "op2_license_scan": licenses(),
        "op3_exact_top_k": TOP_K,
        "op5_benchmark_decontamination": decontamination(),
        "op7_sharding": sharding(),
        "op8_ngram_jaccard_join": near_duplicates(),
        "op9_source_mixing": mixing(),
        "op11_conversation_repair": conversations(),
        "op12_merkle_manifest": manifest(),
    }
