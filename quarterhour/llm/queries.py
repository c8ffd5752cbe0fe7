"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterhour.llm import chat_tree, hamming_search, language_id, license_scan, merkle_manifest, mixing, near_dedup, packing, quality_rules, secret_scan, site_tree, token_counts, vector_codes
from quarterhour.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op2_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    hostile = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)], "conv_id long, turn long, role string, text string")
    steps = chat_tree.steps(turns.union(planted))
    return chat_tree.conversations(steps, chat_tree.nodes(steps))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    profiles = language_id.learn(docs.where(~held_out & F.col("doc_id").isNotNull()))
    return docs.select("doc_id", held_out.alias("held_out"), language_id.predicted("text", profiles).alias("p")).select("doc_id", "held_out", "p.*")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", secret_scan.secrets("text").alias("s"))
    return found.select("doc_id", "s.n_assign", "s.n_access", "s.n_hex", "s.base_sha256", "s.spans", "s.n_entropy", "s.max_entropy")


def op5_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = table(spark, sf_dir, "embeddings").select("vec_id", hamming_search.sign_code("embedding").alias("code"))
    return hamming_search.nearest(coded, coded.where("vec_id % 50 = 0"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "full_epochs")


def op8_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", token_counts.token_counts("text").alias("t")).select("doc_id", "t.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = table(spark, sf_dir, "documents").select("doc_id", quality_rules.ledger("text").alias("m")).select("doc_id", "m.*")
    failed, kept = quality_rules.fails(judged.bits, quality_rules.BASE), ~quality_rules.fails(judged.bits, quality_rules.POLICIES[quality_rules.CURRENT])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "n_lines", "bits")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    joined_lines = {**{c: F.col(c) for c in merkle_manifest.COLUMNS}, "text": F.replace("text", F.lit("\n"), F.lit(""))}
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, merkle_manifest.leaf_hash(*joined_lines.values()))
    return merkle_manifest.proofs(merkle_manifest.manifest(merkle_manifest.leaves(docs, tampered)))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("base_places", lambda p: p["at"].cast("long"))
    return found.select("row.doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), "base_labels", "labels", "score")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


QUERIES = {q.__name__: q for q in (op1_packing, op2_chat_tree, op3_language_id, op4_secret_scan, op5_hamming_search, op6_near_dedup, op7_mixing, op8_site_tree, op9_token_counts, op10_quality_rules, op11_merkle_manifest, op12_license_scan, op13_vector_codes)}

#: The templates of op12 as rows: number, label, share, word, position, whether the word is in the key phrase.
TEMPLATE_ROWS = ", ".join(f"({k}, '{t.label}', {t.percent}, '{w}', {i}, {int(t.key_at[0] <= i < t.key_at[1])})" for k, t in enumerate(license_scan.TEMPLATES) for i, w in enumerate(t.words))


def _rounds_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """The rounds of assigning every part to the nearest entry of all, and of averaging."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS (SELECT row_id, part, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d FROM (
  SELECT row_id, part, entry, list_sum(list_transform(range(1, 17), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS d FROM p JOIN c{r} USING (part)) GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""
s{r} AS (SELECT part, entry, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT part, entry, unnest(v) AS x, unnest(range(16)) AS i FROM a{r} JOIN p USING (row_id, part)) GROUP BY ALL),
m{r} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS mean FROM s{r} GROUP BY ALL),
c{r + 1} AS (SELECT part, entry, coalesce(mean, c) AS c FROM c{r} LEFT JOIN m{r} USING (part, entry))""")
    return ",".join(steps)


SQL = {
    "op5_hamming_search": r"""
WITH signs AS (SELECT DISTINCT vec_id, list_transform(range(1, 65), lambda i: coalesce(embedding[i] > 0, false)) AS s FROM embeddings WHERE len(embedding) = 64 AND vec_id IS NOT NULL),
pairs AS (SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN q.s[i] <> d.s[i] THEN 1 ELSE 0 END))::INTEGER AS distance
          FROM signs q, signs d WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs) WHERE rank <= 10""",
    "op7_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(concat_ws('|', '7', coalesce(doc_id::VARCHAR, ''), coalesce(source, ''), coalesce(text, ''))) AS k
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place FROM sized GROUP BY source),
weighed AS (SELECT source, source_size, CASE place WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, 3.0::DOUBLE * source_size AS most FROM sources),
levels AS (
  -- for each source a candidate level: those below it full, the rest shared by weight
  SELECT a.source, (SELECT sum(source_size) FROM weighed)::DOUBLE - coalesce(sum(b.most), 0) AS left_words,
         (SELECT sum(w) FROM weighed) - coalesce(sum(b.w), 0) AS left_w
  FROM weighed a LEFT JOIN weighed b ON b.most / b.w < a.most / a.w GROUP BY a.source),
level AS (SELECT arg_min(left_words / left_w, most / w) AS v FROM levels JOIN weighed USING (source) WHERE most / w > left_words / left_w),
goals AS (SELECT source, source_size, least(most, w * coalesce((SELECT max(v) FROM level), 1e300)) AS target FROM weighed),
placed AS (
  SELECT doc_id, size, g.source_size, g.target, round(g.target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
cut AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS full_epochs FROM placed)
SELECT doc_id, size, source_size, round(target, 6) AS target, (full_epochs * size + least(size, greatest(0, budget - full_epochs * source_size - before)))::BIGINT AS taken, full_epochs::BIGINT AS full_epochs
FROM cut""",
    "op10_quality_rules": r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, row_number() OVER () AS row_id FROM documents),
windows AS (SELECT row_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT row_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, a, b, c) AS n FROM windows) WHERE n > 1),
covered AS (SELECT row_id, count(DISTINCT i + d) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY row_id),
lines AS (SELECT row_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT row_id, unnest(string_split(t, chr(10))) AS line FROM w)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row_id),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars,
         (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(lines.n, 0)::BIGINT AS n_lines
  FROM w LEFT JOIN covered USING (row_id) LEFT JOIN lines USING (row_id)),
bits AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 8 ELSE 0 END
    + CASE WHEN 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END)::BIGINT AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & 3 <> 0 AS base_failed, bits = 0 AS kept, n_lines, bits FROM bits""",
    # Every word of every template votes for every beginning, without an index.
    "op12_license_scan": rf"""
WITH template(k, label, percent, word, j, in_key) AS (VALUES {TEMPLATE_ROWS}),
d AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT row_id, word, pos FROM (SELECT row_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM d) WHERE word IN (SELECT word FROM template)),
df AS (SELECT word, count(DISTINCT row_id) AS n FROM w GROUP BY word),
tw AS (SELECT t.*, greatest(1, round(1000 * ln(((SELECT count(*) FROM d) + 1) / (coalesce(n, 0) + 1))))::BIGINT AS weight FROM template t LEFT JOIN df USING (word)),
whole AS (SELECT k, label, percent, sum(weight)::BIGINT AS total, sum(in_key) AS n_key FROM tw GROUP BY ALL),
stand AS (
  SELECT row_id, k, label, place, matched::DOUBLE / total AS share
  FROM (SELECT row_id, k, pos - j AS place, sum(weight)::BIGINT AS matched, sum(in_key) AS keys FROM w JOIN tw USING (word) GROUP BY ALL) JOIN whole USING (k)
  WHERE keys = n_key AND 100 * matched >= percent * total),
found AS (
  SELECT row_id, count(*) FILTER (k < {len(license_scan.BASE)}) AS n_base, min(place) FILTER (k < {len(license_scan.BASE)}) AS first_word, max(place) FILTER (k < {len(license_scan.BASE)}) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (k < {len(license_scan.BASE)}) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM stand GROUP BY row_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       round(coalesce(score, 0), 6)::DOUBLE AS score
FROM d LEFT JOIN found USING (row_id)""",
    # Distances to all entries, without the order of sums.
    "op13_vector_codes": f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT row_id, part, v[part * 16 + 1 : part * 16 + 16] AS v FROM kept, (SELECT unnest(range(4)) AS part)),
c0 AS (SELECT part, row_id AS entry, v AS c FROM p WHERE row_id < 256),{_rounds_sql()},
coded AS (SELECT row_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{vector_codes.ROUNDS} GROUP BY row_id),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{vector_codes.ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (row_id), books""",
}
