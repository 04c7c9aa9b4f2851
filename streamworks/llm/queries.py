"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, bytebpe, chat, fingerprint, license, linededup, merkle, packing, pii, quality, simhash, topk, whitening
from .common import table


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine; files are never copied into the library."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.measured(table(spark, sf_dir, "documents"))
    model = quality.fit_on_labels(found, table(spark, sf_dir, "labels"))
    scored = quality.with_score(found, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_next(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = linededup.dedup_lines(docs, out="n_lines_deleted")
    return found.select("doc_id", "n_lines_deleted", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trips(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    records = chat.records_of_rows(rows.unionByName(more))
    return chat.turn_digests(chat.format_conversations(records))


def op7_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whitened_components(vectors, whitening.fit(vectors))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked_manifest(table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bytebpe.round_trips(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_exact_topk, op2_quality, op3_fingerprints, op4_line_dedup, op5_bpe, op6_chat, op7_license, op8_pii, op9_packing, op10_simhash, op11_whitening, op12_merkle, op13_byte_bpe, pipeline)
    return {f.__name__: f for f in own}


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: The rule: a line goes if a run of three words or more that holds it stands earlier too, apart. Of lines of a word at least, three weigh enough.
OP4_SQL = """
WITH d AS (
  SELECT doc_id, md5(text) AS k, any_value(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY 1, 2
), l AS (
  SELECT doc_id, k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM d
), p AS (
  SELECT *, len(string_split(trim(line, ' '), ' ')) AS words, row_number() OVER (PARTITION BY doc_id, k ORDER BY pos) AS q FROM l WHERE trim(line, ' ') <> ''
), e1 AS (SELECT doc_id, k, q, 1 AS e, words, line AS run, [pos] AS ats FROM p),
e2 AS (
  SELECT a.doc_id, a.k, a.q, 2 AS e, a.words + b.words AS words, a.run || chr(10) || b.line AS run, list_append(a.ats, b.pos) AS ats
  FROM e1 a JOIN p b ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.k = b.k AND b.q = a.q + 1
), e3 AS (
  SELECT a.doc_id, a.k, a.q, 3 AS e, a.words + b.words AS words, a.run || chr(10) || b.line AS run, list_append(a.ats, b.pos) AS ats
  FROM e2 a JOIN p b ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.k = b.k AND b.q = a.q + 2
), m AS (
  SELECT *, first_value({'doc_id': doc_id, 'k': k, 'q': q}) OVER (PARTITION BY e, run ORDER BY doc_id NULLS FIRST, k, q) AS f
  FROM (FROM e1 UNION ALL FROM e2 UNION ALL FROM e3) WHERE words >= 3
), gone AS (
  SELECT DISTINCT doc_id, k, unnest(ats) AS pos FROM m WHERE doc_id IS DISTINCT FROM f.doc_id OR k <> f.k OR q >= f.q + e
),
g AS (SELECT doc_id, k, list(pos) AS ats FROM gone GROUP BY 1, 2),
o AS (
  SELECT documents.doc_id, text, ats, CASE WHEN ats IS NULL THEN text ELSE
    array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(ats, i - 1)), chr(10)) END AS new
  FROM documents LEFT JOIN g ON documents.doc_id IS NOT DISTINCT FROM g.doc_id AND md5(text) = g.k
)
SELECT doc_id, CAST(coalesce(len(ats), 0) AS BIGINT) AS n_lines_deleted, CAST(length(new) AS BIGINT) AS n_chars, sha256(new) AS text_sha256 FROM o
"""

OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, length(regexp_replace(text, '\[(\\*)(/?(INST|SYS|ROLE)\]|TEXT\])|<(\\*)(/?s>)', '.', 'g')) AS kept,
    length(text) + len(regexp_extract_all(text, '\[(\\*)(/?(INST|SYS|ROLE)\]|TEXT\])|<(\\*)(/?s>)')) AS escaped,
    length(role) + len(regexp_extract_all(role, '\[(\\*)(/?(INST|SYS|ROLE)\]|TEXT\])|<(\\*)(/?s>)')) AS escaped_role
  FROM c
), g AS (
  SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    CAST(sum(escaped + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 7 ELSE 19 + escaped_role END) AS BIGINT) AS formatted_chars
  FROM f GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, 'turns' AS layout FROM g
"""


def _op7_sql(threshold: float = 0.8) -> str:
    """All windows against all templates by exact containment, without bands and without the filter on words."""
    own = {name: license.words_of(t) for name, t in license.TEMPLATES.items()}
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    k = license.SHINGLE

    def once(w: list[str]) -> str:
        every = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
        return ", ".join(quoted(x) if every.count(x) == 1 else "NULL" for x in license.shingles_of(w))

    values = ", ".join(
        f"({quoted(name)}, {license.size_class(len(w))}, {len(w)}, [{', '.join(map(quoted, license.shingles_of(w)))}], [{once(w)}])" for name, w in own.items()
    )
    return f"""
WITH t(template, size, n_words, own, ordered) AS (VALUES {values}),
u AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, md5(text) AS k, list_filter(list_transform(string_split_regex(lower(text), '\\s+'), lambda w: regexp_replace(w, {quoted(license.EDGES)}, '', 'g')), lambda w: w <> '') AS w FROM u),
s AS (SELECT doc_id, k, w, size, unnest(range(0, greatest(0, len(w) - 1 - size) + 1, size)) AS start FROM d, (SELECT DISTINCT size FROM t) WHERE len(w) > 0),
v AS (SELECT doc_id, k, size, start, w[start + 1 : start + 2 * size] AS w FROM s),
g AS (SELECT doc_id, k, size, start, list_transform(range(1, greatest(1, len(w) - {k - 1}) + 1), lambda i: array_to_string(w[i : i + {k - 1}], ' ')) AS sh FROM v),
m AS (SELECT doc_id, k, template, n_words, start, own, ordered, sh, size FROM g JOIN t USING (size) WHERE list_has_any(own, sh) AND len(list_intersect(own, sh)) / len(own) >= {threshold} - 1e-9),
h AS (SELECT * FROM (SELECT *, list_position(ordered, sh[i + 1]) AS p FROM (SELECT *, unnest(range(len(sh))) AS i FROM m)) WHERE p > 0),
n AS (SELECT *, CASE WHEN p <= lag(p) OVER b OR i - lag(i) OVER b > n_words THEN 1 ELSE 0 END AS new FROM h WINDOW b AS (PARTITION BY doc_id, k, template, start ORDER BY i)),
o AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, k, template, start ORDER BY i ROWS UNBOUNDED PRECEDING) AS occurrence FROM n),
e AS (SELECT doc_id, k, template, n_words, start, any_value(own) AS own, any_value(sh) AS sh, min(i) AS a, max(i) AS b FROM o GROUP BY doc_id, k, template, n_words, start, occurrence),
p AS (SELECT DISTINCT doc_id, k, template, start + a AS start_word, start + b + least({k}, n_words) AS end_word, len(list_intersect(own, sh[a + 1 : b + 1])) AS held, len(own) AS size FROM e),
q AS (SELECT *, held / size AS containment, row_number() OVER (PARTITION BY doc_id, k ORDER BY held DESC, held / size DESC, start_word, end_word, template DESC) AS r FROM p WHERE held / size >= {threshold} - 1e-9)
SELECT doc_id, template, CAST(start_word AS INTEGER) AS start_word, CAST(end_word AS INTEGER) AS end_word, containment FROM q x WHERE NOT EXISTS (
  SELECT 1 FROM q y WHERE x.doc_id IS NOT DISTINCT FROM y.doc_id AND x.k = y.k AND y.r < x.r
    AND 2 * (least(x.end_word, y.end_word) - greatest(x.start_word, y.start_word)) > least(x.end_word - x.start_word, y.end_word - y.start_word))
"""



def _op12_sql() -> str:
    """The definition level by level: nodes of every level, siblings of each by windows, and each leaf folded along them, first in its source, then above."""
    quoted = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    own = lambda text: "sha256(" + " || ".join(map(quoted, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    step = "list_reduce(range(8), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)), xor(c, x))"
    crc = f"xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)), lambda c, x: {step}, 4294967295), 4294967295)"

    def tree(first: str, nodes: str, own_siblings: str) -> str:
        run = "(PARTITION BY lvl, tree, pos // 3 ORDER BY pos ROWS BETWEEN {} AND {})"
        before, after = run.format("2 PRECEDING", "1 PRECEDING"), run.format("1 FOLLOWING", "2 FOLLOWING")
        return f"""{nodes} AS (
  SELECT CAST(0 AS BIGINT) AS lvl, tree, CAST(pos AS BIGINT) AS pos, CAST(cnt AS BIGINT) AS cnt, node FROM {first}
  UNION ALL SELECT lvl + 1, tree, pos // 3, (min(cnt) + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM {nodes} WHERE cnt > 1 GROUP BY lvl + 1, tree, pos // 3
), {own_siblings} AS (
  SELECT lvl, tree, pos, coalesce(string_agg(node, '') OVER {before}, '') AS b, coalesce(string_agg(node, '') OVER {after}, '') AS a FROM {nodes} WHERE cnt > 1
)"""

    def fold(first: str, own_siblings: str, folded: str) -> str:
        return f"""{folded} AS (
  SELECT CAST(0 AS BIGINT) AS lvl, rid, tree, CAST(pos AS BIGINT) AS pos, node, proof FROM {first}
  UNION ALL SELECT lvl + 1, rid, tree, pos // 3, sha256(b || node || a), proof || b || a FROM {folded} JOIN {own_siblings} USING (lvl, tree, pos)
)"""

    return f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, coalesce('s' || source, '') AS tree, doc_id, {own("text")} AS node,
    CASE WHEN doc_id IS NOT NULL AND {crc} % 2 = 0 THEN {own("replace(text, chr(10), '')")} ELSE {own("text")} END AS claimed FROM documents
), l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS cnt FROM d),
{tree("l", "u", "us")}, k AS (SELECT rid, tree, pos, claimed AS node, '' AS proof FROM l), {fold("k", "us", "f")},
s AS (SELECT '' AS tree, tree AS own, node, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS cnt FROM u WHERE cnt = 1),
{tree("s", "v", "vs")}, top AS (SELECT node AS root FROM v WHERE cnt = 1),
h AS (SELECT f.rid, s.tree, s.pos, f.node, f.proof, s.own, s.node AS subroot FROM f JOIN u ON f.tree = u.tree AND f.lvl = u.lvl AND f.pos = u.pos AND u.cnt = 1 JOIN s ON s.own = f.tree),
{fold("h", "vs", "g")}, e AS (SELECT g.rid, g.node, g.proof FROM g JOIN v ON g.tree = v.tree AND g.lvl = v.lvl AND g.pos = v.pos AND v.cnt = 1)
SELECT doc_id, l.node AS leaf, subroot, root, sha256(e.proof) AS proof_sha256, e.node AS folded_root, e.node = root AS verified FROM l JOIN h USING (rid) JOIN e USING (rid), top
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_topk": OP1_SQL, "op4_line_dedup": OP4_SQL, "op6_chat": OP6_SQL, "op7_license": _op7_sql(), "op12_merkle": _op12_sql()}
