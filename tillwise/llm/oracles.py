"""DuckDB SQL for the corpus operators that SQL can express."""

from __future__ import annotations

_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP3 = """
WITH lines AS (
  SELECT doc_id, i - 1 AS place, list_extract(l, i) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS r(i)
), held AS (
  SELECT doc_id, place, line,
    lead(place, 1) OVER w AS b, lead(line, 1) OVER w AS line_b,
    lead(place, 2) OVER w AS c, lead(line, 2) OVER w AS line_c
  FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
  WINDOW w AS (PARTITION BY doc_id ORDER BY place)
), windows AS (
  SELECT *, row_number() OVER (PARTITION BY line, line_b, line_c ORDER BY doc_id, place) AS n
  FROM held WHERE c IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, unnest([place, b, c]) AS place FROM windows WHERE n > 1
), marked AS (
  SELECT l.doc_id, l.place, l.line, g.place IS NOT NULL AS gone
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.place = g.place
), islands AS (
  SELECT doc_id, min(place) AS a, max(place) AS b FROM (
    SELECT doc_id, place, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS island FROM gone
  ) GROUP BY doc_id, island
), spans AS (
  SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS removed FROM islands GROUP BY doc_id
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  coalesce(removed, '') AS removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN spans s ON d.doc_id = s.doc_id
"""

OP8 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS phrase
  FROM d, unnest(range(1, len(w) - 18)) AS r(i)
), later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY phrase ORDER BY doc_id, i) AS n FROM windows
  ) WHERE n > 1
), gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 20)))) AS g FROM later GROUP BY doc_id
), words AS (
  SELECT d.doc_id, i, w[i] AS word, g IS NOT NULL AND list_contains(g, i) AS gone
  FROM d LEFT JOIN gone USING (doc_id), unnest(range(1, len(w) + 1)) AS r(i)
), kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed,
    sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
  FROM words GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed,
  coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP2 = f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM d
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
  FROM d, unnest(range(1, len(w) - 1)) AS r(i)
), repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, unnest([0, 1, 2]) AS t(k) WHERE n > 1 GROUP BY doc_id
), classes AS (
  SELECT doc_id, lang, length(text) AS n, unnest([
    length(text) - length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')),
    length(text) - length(regexp_replace(text, '[a-z]', '', 'g')),
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')),
    length(text) - length(regexp_replace(text, '[0-9]', '', 'g')),
    length(regexp_replace(text, '[a-zA-Z]', '', 'g')) - length(regexp_replace(text, '\\p{{L}}', '', 'g')),
    length(text) - length(regexp_replace(text, '[.,;:!?''"()-]', '', 'g')),
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')),
    length(regexp_replace(text, '[\\x20\\x09-\\x0D0-9\\p{{L}}.,;:!?''"()#*$%&|<>-]', '', 'g'))
  ]) AS c, generate_subscripts([1, 2, 3, 4, 5, 6, 7, 8], 1) AS k FROM d
), class_sums AS (
  SELECT lang, k, sum(c) AS c, sum(sum(c)) OVER (PARTITION BY lang) AS n FROM classes GROUP BY lang, k
), char_far AS (
  SELECT doc_id, sqrt(greatest(0, sum(
    CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END
  ) / 2)) AS far
  FROM (
    SELECT a.doc_id, a.c / a.n AS p, b.c / b.n AS q
    FROM classes a JOIN class_sums b ON a.lang IS NOT DISTINCT FROM b.lang AND a.k = b.k WHERE a.n >= 200
  ) GROUP BY doc_id
), spoken AS (SELECT doc_id, lang, unnest(w) AS word FROM d
), said AS (
  SELECT lang, word, count(*) AS c, sum(count(*)) OVER (PARTITION BY lang) AS n FROM spoken GROUP BY lang, word
), common AS (SELECT * FROM said WHERE c >= 0.01 * n
), rest AS (
  SELECT lang, n - sum(c) AS c, n FROM common GROUP BY lang, n
), bins AS (
  SELECT lang, word, c / n AS q FROM common UNION ALL SELECT lang, NULL, c / n FROM rest
), held AS (
  SELECT s.doc_id, c.word, count(*) AS c
  FROM spoken s LEFT JOIN common c ON s.lang IS NOT DISTINCT FROM c.lang AND s.word = c.word
  GROUP BY s.doc_id, c.word
), word_far AS (
  SELECT doc_id, sqrt(greatest(0, sum(
    CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END
  ) / 2)) AS far
  FROM (
    SELECT d.doc_id, coalesce(h.c, 0) / len(d.w) AS p, b.q
    FROM d JOIN bins b ON d.lang IS NOT DISTINCT FROM b.lang
    LEFT JOIN held h ON h.doc_id = d.doc_id AND h.word IS NOT DISTINCT FROM b.word
    WHERE len(d.w) >= 100
  ) GROUP BY doc_id
), counted AS (
  SELECT d.doc_id, len(w) AS n_words,
    length(text) - length(regexp_replace(text, '[^\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words
  FROM d JOIN lines USING (doc_id) LEFT JOIN repeated r USING (doc_id)
), failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT f.*, NOT base_failed AND coalesce(c.far, 0) <= 0.32 AND coalesce(x.far, 0) <= 0.22 AS kept
FROM failed f LEFT JOIN char_far c USING (doc_id) LEFT JOIN word_far x USING (doc_id)
"""


def _crc32(text: str) -> str:
    """The crc32 of a text's UTF-8 bytes, four bits at a time; the table follows from the polynomial."""
    table = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ 0xEDB88320 if n & 1 else n >> 1
        table.append(n)
    nibbles = (
        f"list_transform(range(0, 2 * octet_length(encode({text}))), "
        f"lambda k: instr('0123456789ABCDEF', hex(encode({text}))[xor(k, 1) + 1]) - 1)"
    )
    step = f"lambda c, b: xor(c >> 4, ({table}::BIGINT[])[(xor(c, b) & 15) + 1])"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {nibbles}::BIGINT[]), {step}), 4294967295)"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _field(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(CAST(octet_length(encode({text})) AS VARCHAR) || ':' || {text}, '-')"


def _climb(name: str, levels: int) -> str:
    """Levels of the trees of ``name`` (tree, place, digest): name_k has each node's siblings to the left
    and right; a tree of one node has ended and is handed on as it is."""
    steps = []
    for k in range(levels):
        source = name if k == 0 else f"{name}_up{k}"
        steps.append(f"""{name}_{k} AS (
  SELECT *, count(*) OVER (PARTITION BY tree) AS n,
    coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
    coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
  FROM (SELECT tree, place, digest FROM {source}) WINDOW w AS (PARTITION BY tree, place // 8 ORDER BY place)
), {name}_up{k + 1} AS (
  SELECT tree, place // 8 AS place, CASE WHEN any_value(n) = 1 THEN any_value(digest)
    ELSE sha256(string_agg(digest, '' ORDER BY place)) END AS digest
  FROM {name}_{k} GROUP BY tree, place // 8
)""")
    return ", ".join(steps)


def _fold(source: str, name: str, tree: str, place: str, levels: int) -> str:
    """``source`` with start, proof and place carried through the levels of ``name``."""
    steps, last = [], source
    for k in range(levels):
        steps.append(f"""{source}_{name}{k} AS (
  SELECT s.* EXCLUDE (now, proof), s.proof || l.a || l.b AS proof,
    CASE WHEN l.n > 1 THEN sha256(l.a || s.now || l.b) ELSE s.now END AS now
  FROM {last} s JOIN {name}_{k} l ON s.{tree} = l.tree AND s.{place} // {8**k} = l.place
)""")
        last = f"{source}_{name}{k}"
    return ", ".join(steps)


#: Unrolled for 8^8 documents of a language and 8^4 languages.
_LEVELS, _TOP_LEVELS = 8, 4

OP12 = f"""
WITH leaves AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree,
    sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
    CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN
      sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))} || {_field(_LOWER.format("text"))})
    END AS altered
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS place FROM leaves
), node AS (SELECT tree, place, leaf AS digest FROM placed),
{_climb("node", _LEVELS)}, subroots AS (
  SELECT tree AS lang_tree, digest AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS top_place
  FROM node_up{_LEVELS}
), top AS (SELECT 0 AS tree, top_place AS place, subroot AS digest FROM subroots),
{_climb("top", _TOP_LEVELS)}, held AS (
  SELECT p.*, s.subroot, s.top_place, 0 AS top_tree, coalesce(altered, leaf) AS now, '' AS proof
  FROM placed p JOIN subroots s ON p.tree = s.lang_tree
), {_fold("held", "node", "tree", "place", _LEVELS)},
{_fold(f"held_node{_LEVELS - 1}", "top", "top_tree", "top_place", _TOP_LEVELS)}
SELECT doc_id, leaf, subroot, t.digest AS root, sha256(proof) AS proof_sha256, now AS folded_root,
  now = t.digest AS verified
FROM held_node{_LEVELS - 1}_top{_TOP_LEVELS - 1}, top_up{_TOP_LEVELS} t
"""

_RUNS = """list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"""
_ALNUM = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP13 = f"""
WITH d AS (SELECT doc_id, {_ALNUM.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
q AS (SELECT {_ALNUM.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
said AS (SELECT doc_id, unnest({_RUNS}) AS f FROM d),
counted AS (SELECT doc_id, f, count(*) AS n FROM said GROUP BY doc_id, f),
wanted AS (SELECT f, count(*) AS n FROM (SELECT unnest({_RUNS}) AS f FROM q) GROUP BY f),
hashed AS (
  SELECT f, {_crc32("f")} % 10000 AS bucket FROM (SELECT f FROM counted UNION SELECT f FROM wanted)
), source AS (
  SELECT bucket, sum(n) AS s FROM counted JOIN hashed USING (f) GROUP BY bucket
), target AS (
  SELECT bucket, sum(n) AS t FROM wanted JOIN hashed USING (f) GROUP BY bucket
), sums AS (
  SELECT (SELECT coalesce(sum(s), 0) FROM source) AS s_all, (SELECT coalesce(sum(t), 0) FROM target) AS t_all
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(
    ((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)
  )) AS BIGINT) AS gain
  FROM source LEFT JOIN target USING (bucket), sums
), weights AS (
  SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight
  FROM counted JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, len(w) >= 20 AS able, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features,
    CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln(
      (CAST('0x' || sha256('42:' || CAST(d.doc_id AS VARCHAR))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE
    ))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (doc_id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS r,
    5 * count(*) OVER (PARTITION BY able) // 100 AS drawn
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= drawn THEN r END AS rank FROM ranked
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": OP2, "op3_line_dedup": OP3, "op8_substring_dedup": OP8,
        "op12_merkle_manifest": OP12, "op13_importance_resampling": OP13,
    }
