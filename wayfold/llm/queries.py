"""The queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import brown_lm, decontamination, edit_counts, fingerprints, jaccard_join, packing, quality_classifier, sharding, source_divergence, suffix_dedup, token_alignment, token_files, url_filters
from wayfold.llm._shared import keep, read, remainder, shared_path


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality_classifier.fit(docs, labels.where(remainder(F.col("doc_id"), 5) != 0))
    return quality_classifier.score(docs, model).select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "difference"
    )


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 7) == 2
    model = brown_lm.train(docs.where(~held_out))
    return brown_lm.score(docs, model, held_out.alias("held_out"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def edits_by_rule() -> Column:
    """Three edits a document, at places that follow from its id: a word changed, a deletion, a long insertion."""
    n, place = F.char_length(F.coalesce("text", F.lit(""))), lambda k: F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"#{k}")))
    at = lambda k: (place(k) % (n + 1)).cast("int")
    one = lambda k, removed, inserted: F.struct(at(k).alias("start"), F.lit(removed).alias("removed"), F.lit(inserted).alias("inserted"))
    return F.array(one(1, 4, "edit"), one(2, 23, ""), one(3, 0, " It's new:  2024\n\tthe text's second part, "))


def op6_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    trees = keep(edit_counts.build(read(spark, sf_dir, "documents"), ranks, pattern), "trees")
    return edit_counts.counted(edit_counts.apply(trees, edits_by_rule(), ranks, pattern))


SHARD_BYTES = 1 << 20


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(read(spark, sf_dir, "documents"), limit=SHARD_BYTES)
    return found.select(F.col("key").alias("doc_id"), F.col("bytes").alias("n_bytes"), "shard", "depth")


OP7 = f"""
WITH r AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), n AS (
  SELECT d, h >> (60 - d)::INT AS p, sum(n_bytes) AS b FROM r, generate_series(0, 40) AS g(d) GROUP BY ALL
), leaf AS (
  SELECT r.doc_id, r.n_bytes, r.h, min(n.d) AS d FROM r JOIN n ON n.p = r.h >> (60 - n.d)::INT
  WHERE n.b <= {SHARD_BYTES} GROUP BY ALL
)
SELECT doc_id, n_bytes, CASE WHEN d = 0 THEN '' ELSE lpad(bin(h >> (60 - d)::INT), d::INT, '0') END AS shard, d::INT AS depth FROM leaf
"""

#: A capture's fetch time follows from its id: some minute of the year 2024.
YEAR, MINUTES = 1704067200, 366 * 1440


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries by rule, for hosts and domains that occur: listed, removed, and some listed again."""
    names = pages.select(url_filters.host(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    named = names.select(F.concat(F.lit("host:"), "host").alias("pattern"), F.lit("spam").alias("list")).unionAll(
        names.select(F.concat(F.lit("domain:"), F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)), F.lit("adult")).distinct()
    )
    h = F.conv(F.substring(F.md5(F.col("pattern").cast("binary")), 1, 8), 16, 10).cast("long")
    day = lambda n, shift=0: F.lit(YEAR) + 86400 * (h % n + shift)
    rows = F.array(
        F.struct(day(200).alias("at"), F.lit("add").alias("action")),
        F.struct((day(200) + 86400 * (20 + h % 61)).alias("at"), F.lit("remove").alias("action")),
        F.struct(day(90, 270).alias("at"), F.when(h % 2 == 0, F.lit("add")).otherwise(F.lit("remove")).alias("action")),
    )
    return named.where(h % 3 != 0).select("list", "pattern", F.inline(rows))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", (F.lit(YEAR) + 60 * F.pmod(F.col("page_id") * 7919, F.lit(MINUTES))).alias("fetched_at"))
    return url_filters.evaluate(captures, list_entries(pages)).withColumnRenamed("capture_id", "page_id")


OP8 = f"""
WITH c AS (
  SELECT page_id, url, {YEAR} + 60 * ((page_id * 7919) % {MINUTES}) AS fetched_at,
    nullif(lower(regexp_extract(url, '{url_filters.HOST}', 1)), '') AS host FROM pages
), p AS (
  SELECT DISTINCT 'spam' AS list, 'host:' || host AS pattern FROM c WHERE host IS NOT NULL
  UNION SELECT DISTINCT 'adult', 'domain:' || regexp_extract(host, '([^.]+\\.[^.]+)$', 1) FROM c WHERE host IS NOT NULL
), h AS (SELECT * FROM (SELECT *, ('0x' || substr(md5(pattern), 1, 8))::BIGINT AS k FROM p) WHERE k % 3 <> 0
), e AS (
  SELECT list, pattern, {YEAR} + 86400 * (k % 200) AS t, 'add' AS action FROM h
  UNION ALL SELECT list, pattern, {YEAR} + 86400 * (k % 200) + 86400 * (20 + k % 61), 'remove' FROM h
  UNION ALL SELECT list, pattern, {YEAR} + 86400 * (k % 90 + 270), CASE WHEN k % 2 = 0 THEN 'add' ELSE 'remove' END FROM h
), u AS (SELECT list, pattern, t, max(action = 'add') AS listed FROM e GROUP BY ALL
), i AS (SELECT *, lead(t) OVER (PARTITION BY list, pattern ORDER BY t) AS until FROM u
), m AS (
  SELECT c.page_id, i.list FROM c JOIN i ON listed AND c.fetched_at >= i.t AND (until IS NULL OR c.fetched_at < until)
    AND (i.pattern = 'host:' || c.host OR (starts_with(i.pattern, 'domain:') AND ('.' || c.host) LIKE '%.' || substr(i.pattern, 8)))
), a AS (SELECT page_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM m GROUP BY page_id)
SELECT c.page_id, c.url, c.fetched_at, c.host, coalesce(a.n, 0) AS n_entries, coalesce(a.lists, '') AS lists, a.n IS NOT NULL AS blocked
FROM c LEFT JOIN a USING (page_id)
"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.removed(read(spark, sf_dir, "documents")))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_alignment.align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "token-files")
    token_files.write(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(read(spark, sf_dir, "documents"))


OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3
), v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang
), g AS (SELECT DISTINCT lang, source FROM d
), c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL
), s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(s.n, 0) + v.v))::BIGINT AS p, (1 + 1000000000::HUGEINT * (k.total + 1) // (v.n + v.v))::BIGINT AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
), r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM o)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""


QUERIES = {"op12_token_alignment": op12_token_alignment, "op11_source_divergence": op11_source_divergence, "op13_token_files": op13_token_files, "op10_suffix_dedup": op10_suffix_dedup, "op9_decontamination": op9_decontamination, "op1_brown_lm": op1_brown_lm, "op2_jaccard_join": op2_jaccard_join, "op3_fingerprints": op3_fingerprints, "op4_packing": op4_packing, "op5_quality": op5_quality, "op6_edit_counts": op6_edit_counts, "op7_sharding": op7_sharding, "op8_url_filters": op8_url_filters}
ORACLE_SQL: dict[str, str] = {"op7_sharding": OP7, "op11_source_divergence": OP11, "op8_url_filters": OP8}
