"""The queries of the training-data operators, one for each, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, embedjoin, linededup, media, minhash, packing, pii, quality, runs, simhash, spelling, urltree
from .common import table

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.tiktoken"


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dropped_lines_digests(table(spark, sf_dir, "documents"))


#: The conversation whose texts hold the template's control strings.
CONTROL_ID, CONTROL_TEXT = -7, "\\### Assistant: </turn> ok"


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(CONTROL_ID, k, role, CONTROL_TEXT) for k, role in enumerate(("user", "assistant"))], turns.schema)
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return chat.format_conversations(turns.unionByName(control)).select(*columns)


#: Fixed rules.
RULES = [
    urltree.Rule("com", "/en/", "block"),
    urltree.Rule("example.com", "/en/7", "allow"),
    urltree.Rule("net", "/de/", "allow"),
    urltree.Rule("example.net", "/de/8", "block"),
    urltree.Rule("org", "/es/", "block"),
]


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document whose doc_id is the number in its url's path; page_id is no doc_id."""
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    labels = table(spark, sf_dir, "labels").select("doc_id", good.alias("good"))
    return urltree.judge_urls(table(spark, sf_dir, "pages"), labels, RULES, key="doc_id")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedjoin.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def pages_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences of all pages, their references resolved against the images of all documents."""
    store = media.media_features(media.pages_and_media(table(spark, sf_dir, "documents")).filter("media is not null"))
    return media.page_sequences(table(spark, sf_dir, "pages"), store)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer(WORD_BPE))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encoding_digests(table(spark, sf_dir, "documents"), _tokenizer(BYTE_BPE), public_tokenizers.PATTERN)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_digests(table(spark, sf_dir, "documents"))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def fingerprint_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents near those whose id is divisible by 20, counted."""
    return simhash.near_documents(table(spark, sf_dir, "documents"), F.col("doc_id") % 20 == 0)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(table(spark, sf_dir, "documents"))


#: One run of letters in so many loses a letter.
DAMAGE = 97


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), damage=DAMAGE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality_classifier, op2_line_dedup, op3_chat_formatting, op4_url_filters, op5_minhash_near_dedup, op6_embedding_near_dedup, op7_media_columns, op8_best_fit_packing, op9_byte_bpe, op10_pii, op11_document_fingerprints, op12_periodic_runs, op13_spelling_variants, fingerprint_search, pages_media_sequences]
    return {f.__name__: f for f in found}


_LINE_KEY = r"""translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""

OP2_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, {_LINE_KEY} AS key FROM l),
f AS (SELECT key FROM (SELECT DISTINCT doc_id, key FROM k WHERE key <> '') GROUP BY key HAVING count(*) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
"""

OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(replace(replace(replace(replace(text, '\', '\\'), '### ', '\h'), '</turn>', '\e'), ': ', '\c')) AS n_text,
         length(replace(replace(replace(replace(role, '\', '\\'), '### ', '\h'), '</turn>', '\e'), ': ', '\c')) AS n_role FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(4 + n_role + 2 + n_text + 7 + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingles FROM w),
c AS (SELECT min(doc_id) AS doc_id, list_sort(shingles) AS shingles FROM s WHERE len(shingles) > 0 GROUP BY list_sort(shingles)),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM c),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) AS n, any_value(b.n) AS m
  FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT a, b FROM p WHERE 100 * shared >= 75 * (n + m - shared)),
links AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
reach AS (SELECT doc_id AS a, doc_id AS b FROM c UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
cls AS (SELECT s.doc_id, len(s.shingles) AS n, c.doc_id AS rep FROM s LEFT JOIN c ON list_sort(s.shingles) = c.shingles)
SELECT cls.doc_id, n::BIGINT AS n_shingles, coalesce(component_id, cls.doc_id)::BIGINT AS component_id,
       coalesce(component_id, cls.doc_id) = cls.doc_id AS kept
FROM cls LEFT JOIN least ON least.doc_id = rep
"""

OP6_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
k AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, k.b FROM reach r JOIN k ON r.b = k.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM k GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, component_id = vec_id AS kept
FROM embeddings LEFT JOIN degree ON degree.a = vec_id LEFT JOIN least ON least.a = vec_id
"""


def _op4_sql() -> str:
    """The tree by the same steps as the operator: a recursion over levels, in which each row is a distinct generalised path."""
    prior, least_support = urltree.PRIOR, urltree.LEAST_SUPPORT
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    longest = sorted(RULES, key=lambda r: (-len(r.name), r.name))
    chosen = lambda part: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{getattr(r, part)}'" for r in longest) + " END"
    purity = lambda good, labelled, parent: f"(({good} + {prior} * {parent}) / ({labelled} + {prior}))"
    far = lambda good, labelled, p: f"(abs({good} - {labelled} * {p}) > {urltree.SIMILAR} * sqrt({labelled} * {p} * (1 - {p})))"
    sums = lambda by: ", ".join(f"sum({x}) OVER (PARTITION BY {by}) AS {x}_" for x in ("n", "good", "labelled"))
    shared = "coalesce(list_min(list_filter(range(1, greatest(len(least), len(most)) + 1), lambda k: least[k] IS DISTINCT FROM most[k])) - 1, greatest(len(least), len(most)))"
    going = lambda n, good, labelled, p: f"(least <> most AND {n} >= {least_support} AND ({far(good, good, p)} OR {far('0', f'({labelled} - {good})', p)}))"
    return rf"""
WITH RECURSIVE cut AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
named AS (
  SELECT *, list_transform(string_split(path, '/')[2:], lambda s: CASE WHEN regexp_matches(s, '^[0-9a-f]{{8,}}$') THEN '{{h}}' ELSE regexp_replace(s, '[0-9]+', '{{n}}', 'g') END) AS segments,
         try_cast(regexp_extract(path, '/([0-9]+)(?:[.][^/]*)?/*$', 1) AS BIGINT) AS doc_id FROM cut),
known AS (SELECT doc_id, min((quality = 1 AND toxic = 0)::INT) AS g FROM labels WHERE (quality = 1 AND toxic = 0) IS NOT NULL GROUP BY doc_id),
paths AS (
  SELECT host, segments, count(*)::DOUBLE AS n, coalesce(sum(g), 0)::DOUBLE AS good, count(g)::DOUBLE AS labelled FROM named LEFT JOIN known USING (doc_id) GROUP BY ALL),
whole AS (SELECT coalesce(sum(good) / nullif(sum(labelled), 0), 1.0) AS p FROM paths),
tree AS (
  SELECT host, segments, n, good, labelled, node, rest, shared, {going('n_', 'good_', 'labelled_', 'purity')} AS going, labelled_ AS all_labelled, purity
  FROM (SELECT *, {shared} AS shared, {purity('good_', 'labelled_', 'p')} AS purity FROM (
    SELECT host, segments, n, good, labelled, p, [host] AS node, segments AS rest, {sums('host')}, min(segments) OVER (PARTITION BY host) AS least, max(segments) OVER (PARTITION BY host) AS most
    FROM paths, whole))
  UNION ALL
  SELECT host, segments, n, good, labelled, node, rest, {shared} AS shared, {going('n_', 'good_', 'labelled_', 'purity')} AS going, labelled_ AS all_labelled, purity
  FROM (
    SELECT *, min(rest) OVER (PARTITION BY node) AS least, max(rest) OVER (PARTITION BY node) AS most,
           CASE WHEN labelled_ = all_labelled THEN p ELSE {purity('good_', 'labelled_', 'p')} END AS purity FROM (
      SELECT host, segments, n, good, labelled, list_append(node, branch) AS node, rest, all_labelled, p, {sums('node, branch')} FROM (
        SELECT *, CASE WHEN {far('good_', 'labelled_', 'p')} THEN segment ELSE '{urltree.MERGED}' END AS branch FROM (
          SELECT *, {sums('node, segment')} FROM (
            SELECT *, CASE WHEN sum(n) OVER (PARTITION BY node, own) < {least_support} THEN '*' ELSE own END AS segment FROM (
              SELECT host, segments, n, good, labelled, node, all_labelled, purity AS p, coalesce(rest[shared + 1], '') AS own, rest[shared + 2:] AS rest FROM tree WHERE going))) x) y) z)),
blocked AS (SELECT host, segments, 'block' AS found FROM tree WHERE NOT going AND purity < {urltree.LEAST_PURITY})
SELECT page_id, host, path, {chosen("name")} AS rule, coalesce({chosen("verdict")}, found, 'allow') AS verdict
FROM named LEFT JOIN blocked USING (host, segments)
"""


def _crc32_sql(text: str) -> str:
    """zlib's crc32 of a string of code points under 2048, bit by bit."""
    codes = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 | (unicode(c) >> 6))::BIGINT, (128 | (unicode(c) & 63))::BIGINT] END))"
    bits = "list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda r, b: {bits}), 4294967295::BIGINT)"


OP12_SQL = rf"""
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, {_crc32_sql('doc_id::VARCHAR')} AS h FROM documents),
sized AS (
  SELECT *, len(words) AS n, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) END AS a,
         1 + (len(words) - (h // 10) % nullif(len(words), 0)) // (3 + (h // 10) % 8) AS p FROM split),
w0 AS (SELECT doc_id, unnest(range(n)) AS i, unnest(words) AS word, a, p FROM sized),
w AS (
  SELECT x.doc_id, x.i, y.word FROM w0 x JOIN w0 y ON y.doc_id = x.doc_id AND y.i = CASE WHEN x.i >= x.a THEN x.a + (x.i - x.a) % x.p ELSE x.i END),
grams AS (
  SELECT doc_id, i, concat_ws(' ', word, {', '.join(f'lead(word, {k}) OVER o' for k in range(1, 6))}) AS gram, lead(word, 5) OVER o IS NOT NULL AS whole
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
same AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON y.doc_id = x.doc_id AND y.gram = x.gram AND y.i > x.i WHERE x.whole AND y.whole),
island AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM same),
stretch AS (SELECT doc_id, q, min(i) AS s, max(i) + 6 - min(i) + q AS l FROM island GROUP BY doc_id, q, k HAVING max(i) + 6 - min(i) + q >= greatest(12, 2 * q)),
run AS (SELECT * FROM stretch r WHERE NOT EXISTS (SELECT 1 FROM stretch z WHERE z.doc_id = r.doc_id AND z.q < r.q AND z.s <= r.s AND z.s + z.l >= r.s + r.l)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM w
  WHERE NOT EXISTS (SELECT 1 FROM run r WHERE r.doc_id = w.doc_id AND w.i >= r.s + r.q AND w.i < r.s + r.l) GROUP BY doc_id),
whole AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM run GROUP BY doc_id),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l DESC, s, q) = 1)
SELECT sized.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, q::BIGINT AS period, (1000 * l // q)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256, n::BIGINT AS n_words
FROM sized LEFT JOIN whole USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN best USING (doc_id)
"""

OP13_SQL = rf"""
WITH RECURSIVE found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS c FROM found WHERE length(run) >= {spelling.LEAST_LETTERS} GROUP BY ALL),
hashed AS (SELECT *, {_crc32_sql("doc_id || ':' || run")} AS h FROM counted),
damaged AS (SELECT c, CASE WHEN h % {DAMAGE} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
v AS (SELECT word, sum(c)::BIGINT AS n FROM damaged WHERE length(word) >= {spelling.LEAST_LETTERS} GROUP BY word HAVING sum(c) >= {spelling.LEAST_COUNT}),
d AS (SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS k FROM v)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON b.less = a.less AND b.k = a.k AND b.word <> a.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.less UNION SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.less),
best AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {spelling.FACTOR} * v.n THEN near END AS form, CASE WHEN near_n >= {spelling.FACTOR} * v.n THEN near_n END AS form_n
  FROM v LEFT JOIN best USING (word)),
path AS (SELECT word, coalesce(form, word) AS root, form IS NOT NULL AS going FROM forms
         UNION ALL SELECT p.word, coalesce(f.form, p.root), f.form IS NOT NULL FROM path p JOIN forms f ON f.word = p.root WHERE p.going)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM forms JOIN (SELECT word, root FROM path WHERE NOT going) USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": OP2_SQL, "op3_chat_formatting": OP3_SQL, "op4_url_filters": _op4_sql(), "op5_minhash_near_dedup": OP5_SQL,
        "op6_embedding_near_dedup": OP6_SQL, "op12_periodic_runs": OP12_SQL, "op13_spelling_variants": OP13_SQL,
    }
