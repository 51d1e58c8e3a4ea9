"""The thin queries opN_<name> over the numbered operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, ctw, decontaminate, jaccard, licenses, merkle, mixing, pii, quality, repair, repeats, token_counts, toxicity
from .common import id_remainder, table, text_or_empty


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, repeated so that a source of n documents gets a share in proportion to the square root of n."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"), alpha=0.5, epochs=1.0, seed="mix")


OP1_SQL = """
WITH RECURSIVE s AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY source),
t AS (SELECT sum(pow(n_docs::DOUBLE, 0.5)) AS w, sum(n_docs) AS n FROM s),
r AS (SELECT source, (1.0::DOUBLE * n / w) * pow(n_docs::DOUBLE, 0.5) / n_docs AS rate FROM s, t),
cdf AS (
  SELECT source, rate, 0 AS k, -rate AS lp, exp(-rate) AS c FROM r
  UNION ALL
  SELECT source, rate, k + 1, lp + ln(rate) - ln((k + 1)::DOUBLE), c + exp(lp + ln(rate) - ln((k + 1)::DOUBLE))
  FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 20)),
drawn AS (
  SELECT d.*, ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents d),
n AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
         (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM d.source AND c.c <= d.u) AS n
  FROM drawn d)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::INTEGER AS copy_no FROM n WHERE n > 0
"""


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (
  SELECT item_id, least(5, len(w)) AS k, unnest(list_distinct(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda p: array_to_string(w[p:p + least(5, len(w)) - 1], ' ')))) AS g
  FROM i WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_shingles FROM g GROUP BY item_id),
d AS (
  SELECT doc_id, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' ')))) AS g
  FROM w, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)
SELECT d.doc_id, g.item_id, count(*) AS n_shared, any_value(n_shingles) AS n_shingles, count(*) / any_value(n_shingles) AS containment
FROM d JOIN g USING (k, g) JOIN n USING (item_id)
GROUP BY d.doc_id, g.item_id HAVING 100 * count(*) >= 80 * any_value(n_shingles)
"""


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", F.octet_length(text_or_empty("text")).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


#: The queries' key; a deployment passes its own.
PII_KEY = b"waymark queries"


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, PII_KEY, count_col="n_replaced")


def op5_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_texts(table(spark, sf_dir, "documents"), id_remainder("doc_id", 7) == 2)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scanned.drop("text")


def _op6_sql() -> str:
    """Every place of every template is tried, without an index."""
    rows = ", ".join(f"({t.label!r}, {t.base}, {t.words!r}, {[k for _, k in t.places()]!r}, {[p for p, _ in t.places()]!r})" for t in licenses.TEMPLATES)
    return rf"""
WITH t(label, base, tw, keys, spot) AS (VALUES {rows}),
w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (
  SELECT doc_id, w, label, base, tw, keys, spot, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(keys[1])] = keys[1])) AS p
  FROM w, t WHERE len(list_intersect(w, keys[1])) > 0),
f AS (
  SELECT doc_id, label, base, p, len(list_filter(range(len(tw)), lambda j: p - spot[1] + j >= 0 AND w[p - spot[1] + j + 1] = tw[j + 1])) / len(tw)::DOUBLE AS s
  FROM p WHERE len(keys) = 1 OR len(list_filter(range(p + len(keys[1]), p + spot[2] - spot[1] + {licenses.SLACK} + 1), lambda q: w[q + 1:q + len(keys[2])] = keys[2])) > 0)
SELECT w.doc_id, any_value(len(w.w)) AS n_words, count(f.p) FILTER (f.base) AS n_base, min(f.p) FILTER (f.base) AS first_word, max(f.p) FILTER (f.base) AS last_word,
  coalesce(string_agg(DISTINCT f.label, ',' ORDER BY f.label) FILTER (f.base), '') AS base_labels, coalesce(string_agg(DISTINCT f.label, ',' ORDER BY f.label), '') AS labels, coalesce(max(f.s), 0.0::DOUBLE) AS score
FROM w LEFT JOIN f ON f.doc_id IS NOT DISTINCT FROM w.doc_id GROUP BY w.doc_id
"""


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 100)
    return left.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), 3, 90)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.c = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(c) AS c FROM r GROUP BY node) m ON m.node = d.doc_id
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality.fit_on(docs, labels, "quality", id_remainder("doc_id", 5) != 0)
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.fit_on(docs, labels, "toxic", id_remainder("doc_id", 5) != 0)
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence_ids")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


#: crc32 of ASCII text, as DuckDB has none: the table by its rule, then a fold over the characters.
CRC_TABLE_SQL = """
crc(i, c, k) AS (
  SELECT range, range::UBIGINT, 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8)"""


def _crc_sql(text: str) -> str:
    folded = f"list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length({text}) + 1), lambda i: ascii(({text})[i])::UBIGINT)), lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT]))"
    return f"xor({folded}, 4294967295::UBIGINT)"


def _op12_sql() -> str:
    """Forward over each conversation's rows: for each state the least (cost, letters) with the repaired text, as structs in a list."""
    far = "{'c': 1000000000::BIGINT, 'a': '', 't': ''}"

    def step(frm: str, cost: str, letter: str, text: str = "''") -> str:
        return f"{{'c': {frm}.c + {cost}, 'a': {frm}.a || '{letter}', 't': {frm}.t || {text}}}"

    def least(*xs: str) -> str:
        return f"list_min([{', '.join(xs)}])"

    # after inserts: state 3 (a user row was last) from the others, then 4 (an assistant row) from 3
    p = [f"p.s[{k}]" for k in range(1, 5)]
    ins_u = least(p[2], *(step(x, "5", "I", "chr(10) || 'user:'") for x in (p[0], p[1], p[3])))
    inserted = f"[{p[0]}, {p[1]}, u, {least(p[3], step('u', '5', 'I', "chr(10) || 'assistant:'"))}]"
    # an assistant row inserted first may lead to a user row only at a higher cost, so one round is enough
    q = [f"q[{k}]" for k in range(1, 5)]
    row_text = "chr(10) || r.role || ':' || r.text"
    keep_cost = "CASE WHEN r.f IN ('blank', 'duplicate') THEN 1000000000 WHEN r.f = 'truncated' THEN 5 ELSE 0 END"

    def keep(x: str, initial: str) -> str:
        return step(x, f"CASE WHEN r.i = '{initial}' THEN {keep_cost} ELSE 1000000000 END", "K", row_text)

    def rerole(x: str, role: str) -> str:
        return step(x, f"1 + {keep_cost}", "R", f"chr(10) || '{role}:' || r.text")

    gone = [step(x, "2", "D") for x in q]
    after = [
        gone[0],
        least(gone[1], keep(q[0], "s")),
        least(gone[2], *(keep(x, "u") for x in (q[0], q[1], q[3])), *(rerole(x, "user") for x in (q[0], q[1], q[3]))),
        least(gone[3], keep(q[2], "a"), rerole(q[2], "assistant")),
    ]
    empty = f"{{'s': [{{'c': 0::BIGINT, 'a': '', 't': ''}}, {far}, {far}, {far}], 'r': {{'role': '', 'text': '', 'i': '', 'f': ''}}}}"
    none = "{'role': '', 'text': '', 'i': '', 'f': ''}"
    closed = f"list_transform([{ins_u}], lambda u: {inserted})[1]"
    folded = f"list_reduce(list_prepend({empty}, list_transform(rows, lambda x: {{'s': [{far}], 'r': x}})), lambda p, y: {{'s': list_transform([{closed}], lambda q: list_transform([y.r], lambda r: [{', '.join(after)}])[1])[1], 'r': {none}}})"
    return rf"""
WITH RECURSIVE {CRC_TABLE_SQL},
k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, kind,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM (SELECT k.*, {_crc_sql('key')} % 20 AS kind FROM k, crc_table)),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n FROM d WHERE kind <> 0),
f AS (
  SELECT *, left(role, 1) AS i, CASE
    WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 'truncated' ELSE '' END AS f,
    left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) NOT IN ('su', 'ua', 'au') AS illegal
  FROM o),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (f = 'blank') AS blank, count(*) FILTER (f = 'duplicate') AS duplicate,
         count(*) FILTER (f = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal, list({{'role': role, 'text': text, 'i': i, 'f': f}} ORDER BY n) AS rows
  FROM f GROUP BY conv_id),
b AS (SELECT * EXCLUDE (rows), {folded} AS p FROM c),
e AS (SELECT * EXCLUDE (p), list_min([q[1], q[4]]) AS z FROM (SELECT *, {closed} AS q FROM b))
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(z.c, 0) AS cost, coalesce(z.a, '') AS audit, sha256(coalesce(substr(z.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.build_manifest(table(spark, sf_dir, "documents"))


def _op13_sql() -> str:
    """All levels of all trees by recursion; a path for each document, first in its source's tree, then in that of the sources."""

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ('doc_id::VARCHAR', 'source', 'lang', 'n_chars::VARCHAR', text))})"

    def climb(name: str, runs: str, start: str) -> str:
        """(id, node, siblings) at the end of each way up."""
        return f"""
{name}_way AS (
  {start}
  UNION ALL
  SELECT w.id, w.tree, w.level + 1, w.i // 16, sha256(array_to_string(list_transform(r.hs, lambda h, j: CASE WHEN j = w.i % 16 + 1 THEN w.node ELSE h END), '')),
         w.siblings || array_to_string(list_filter(r.hs, lambda h, j: j <> w.i % 16 + 1), '')
  FROM {name}_way w JOIN {runs} r ON r.tree = w.tree AND r.level = w.level AND r.run = w.i // 16),
{name} AS (SELECT id, arg_max(node, level) AS node, arg_max(siblings, level) AS siblings FROM {name}_way GROUP BY id)"""

    def levels(name: str, start: str) -> str:
        return f"""
{name} AS (
  {start}
  UNION ALL
  SELECT tree, level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 15) // 16 FROM {name} WHERE n > 1 GROUP BY tree, level, i // 16),
{name}_runs AS (SELECT tree, level, i // 16 AS run, list(h ORDER BY i) AS hs FROM {name} WHERE n > 1 GROUP BY tree, level, i // 16)"""

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE {CRC_TABLE_SQL},
l AS (
  SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {_crc_sql('doc_id::VARCHAR')} % 5 = 0 THEN {leaf(low)} END AS tampered FROM documents, crc_table),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM l),
{levels('nodes', 'SELECT tree, 0 AS level, i, leaf AS h, n FROM ranked')},
subroots AS (SELECT tree, h FROM nodes WHERE n = 1),
{levels('tops', 'SELECT 0 AS tree, 0 AS level, tree AS i, h, (SELECT count(*) FROM subroots) AS n FROM subroots')},
root AS (SELECT h AS root FROM tops WHERE n = 1),
{climb('kept', 'nodes_runs', "SELECT id, tree, 0 AS level, i, leaf AS node, '' AS siblings FROM ranked")},
{climb('changed', 'nodes_runs', "SELECT id, tree, 0 AS level, i, coalesce(tampered, leaf) AS node, '' AS siblings FROM ranked")},
{climb('folded', 'tops_runs', "SELECT r.id, 0 AS tree, 0 AS level, r.tree AS i, c.node, c.siblings FROM ranked r JOIN changed c USING (id)")}
SELECT r.doc_id, r.leaf, k.node AS subroot, root.root, sha256(f.siblings) AS proof_sha256, f.node AS folded_root, f.node = root.root AS verified
FROM ranked r JOIN kept k USING (id) JOIN folded f USING (id), root
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mix_sources, op2_decontaminate, op3_token_counts, op4_surrogates, op5_ctw, op6_licenses, op7_repeats, op8_jaccard, op9_quality, op10_nearest, op11_toxicity, op12_repair, op13_merkle)}
ORACLE_SQL: dict[str, str] = {"op1_mix_sources": OP1_SQL, "op2_decontaminate": OP2_SQL, "op6_licenses": _op6_sql(), "op8_jaccard": OP8_SQL, "op12_repair": _op12_sql(), "op13_merkle": _op13_sql()}
