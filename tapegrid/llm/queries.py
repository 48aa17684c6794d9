"""One query per operator over its whole table, and the checking SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapegrid.llm import (
    alignment,
    dialogue,
    exact,
    mixing,
    packing,
    pieces,
    pii,
    preference,
    quality,
    simhash,
    site_lines,
    toxicity,
    warc,
)
from tapegrid.llm.text import read

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def model_path() -> str:
    """The SentencePiece file of the public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_level_path() -> str:
    """The byte-level BPE file of the public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


SPANS = """coalesce(list_aggregate(list_transform(list_filter({x}, lambda t: t.trained),
 lambda t: (t.start + t.head)::VARCHAR || '-' || (t.start + t.size)::VARCHAR), 'string_agg', ' '), '')"""

PREFERENCE_SQL = f"""
WITH rows AS (
  SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
), last AS (
  SELECT conv_id, turn AS last, max(text) AS answer
  FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS top FROM rows WHERE role = 'assistant')
  WHERE turn = top GROUP BY 1, 2
), chosen AS (SELECT conv_id AS pair_id, turn, role, text FROM rows
), rejected AS (
  SELECT r.conv_id AS pair_id, turn, role, text FROM rows r LEFT JOIN last l USING (conv_id)
  WHERE l.last IS NULL OR r.turn < l.last
  UNION
  SELECT l.conv_id, l.last, 'assistant', o.answer FROM last l JOIN last o ON o.conv_id = xor(l.conv_id, 1)
), met AS (
  SELECT pair_id, turn, role, text, sum(side) AS sides FROM (
    SELECT *, 1 AS side FROM chosen UNION ALL SELECT *, 2 AS side FROM rejected) GROUP BY ALL
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn, role, text) AS place FROM met
), parted AS (
  SELECT *, coalesce(min(CASE WHEN sides <> 3 THEN place END) OVER (PARTITION BY pair_id), 1e9) AS parting,
    '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown
  FROM numbered
), parts AS (
  SELECT *, unnest(CASE WHEN place < parting THEN ['prompt'] WHEN sides = 1 THEN ['chosen']
    WHEN sides = 2 THEN ['rejected'] ELSE ['chosen', 'rejected'] END) AS part FROM parted
), placed AS (
  SELECT *, sum(length(shown)) OVER (PARTITION BY pair_id, part ORDER BY place) - length(shown) AS start FROM parts
), lists AS (
  SELECT pair_id, part, string_agg(shown, '' ORDER BY place) AS text, count(*) AS n,
    list({{'start': start::BIGINT, 'size': length(shown)::BIGINT, 'head': (length(role) + 5)::BIGINT,
          'trained': role = 'assistant'}} ORDER BY place) AS spans
  FROM placed GROUP BY 1, 2
)
SELECT p.pair_id, coalesce(a.text, '') AS prompt, coalesce(b.text, '') AS chosen,
  coalesce(c.text, '') AS rejected, {SPANS.format(x="b.spans")} AS chosen_mask,
  {SPANS.format(x="c.spans")} AS rejected_mask, coalesce(a.n, 0) AS prompt_turns
FROM (SELECT DISTINCT pair_id FROM parts) p
LEFT JOIN lists a ON a.pair_id = p.pair_id AND a.part = 'prompt'
LEFT JOIN lists b ON b.pair_id = p.pair_id AND b.part = 'chosen'
LEFT JOIN lists c ON c.pair_id = p.pair_id AND c.part = 'rejected'
"""


@query("op2_preference_format", PREFERENCE_SQL)
def preference_format(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation against its history with the neighbour's last answer."""
    pairs = preference.format_pairs(*preference.neighbour_pairs(read(spark, folder, "conversations")))

    def spans(mask: str):
        return F.array_join(
            F.transform(mask, lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))), " "
        )

    return pairs.withColumns({m: spans(m) for m in ("chosen_mask", "rejected_mask")})


@query("op3_toxicity")
def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return toxicity.scored(docs, toxicity.train(docs, read(spark, folder, "labels")))


WARC_SQL = """
WITH marked AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), dealt AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload) AS first, sha1(payload) AS digest FROM marked
), spelled AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(digest, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '')
    AS payload_digest
  FROM dealt
)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM spelled
"""


@query("op4_warc_transactions", WARC_SQL)
def warc_transactions(spark: SparkSession, folder: str) -> DataFrame:
    rows = warc.round_trip(read(spark, folder, "pages"), with_payload=False)
    return rows.select(
        F.col("capture_id").alias("page_id"),
        F.col("full_bytes").alias("payload_bytes"),
        F.col("full_digest").alias("payload_digest"),
        F.col("answer.record_type").alias("record_type"),
        F.col("refers_to_id").alias("refers_to"),
    )


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    1.0::DOUBLE + (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source
), sorted AS (
  SELECT *, 3.0::DOUBLE * source_size / weight AS ratio, sum(source_size) OVER ()::DOUBLE AS total FROM totals
), prefixed AS (
  SELECT *, sum(weight) OVER (ORDER BY ratio DESC, source)::DOUBLE AS open_weight,
    total - (3.0 * (sum(source_size) OVER () - sum(source_size) OVER (ORDER BY ratio DESC, source)))::DOUBLE AS open_size
  FROM sorted
), level AS (
  SELECT max(open_size / open_weight) AS level FROM prefixed
), targets AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, weight * coalesce(level, 0)) AS target
  FROM totals, level
), drawn AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END AS rate,
    ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM drawn
"""


@query("op5_mix_sources", MIX_SQL)
def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mixture(read(spark, folder, "documents"))
    return mixed.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.round("_target", 6).alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"),
    )


@query("op6_pii_pseudonyms")
def pii_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pseudonymise(read(spark, folder, "documents"))


def _nested(expression: str, *steps: str) -> str:
    for step in steps:
        expression = step.format(expression)
    return expression


PAGE_TEXT_SQL = _nested(
    "coalesce(html, '')",
    "regexp_replace({}, '" + site_lines.DROPPED.replace("(?is)", "") + "', chr(10), 'gis')",
    "regexp_replace({}, '" + site_lines.BREAKS.replace("(?i)", "") + "', chr(10), 'gi')",
    "regexp_replace({}, '" + site_lines.TAG + "', '', 'g')",
    *[f"replace({{}}, '{code}', chr({ord(char)}))" for code, char in site_lines.ENTITIES],
    r"regexp_replace({}, '[ \t\r\x0B\f]+', ' ', 'g')",
)
SITE_SQL = rf"""
WITH lined AS (
  SELECT page_id,
    lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    list_filter(list_transform(string_split({PAGE_TEXT_SQL}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines
  FROM pages
), pages_of AS (SELECT host, count(*) AS pages FROM lined GROUP BY 1
), common AS (
  SELECT host, line FROM (SELECT page_id, host, unnest(list_distinct(lines)) AS line FROM lined) JOIN pages_of USING (host)
  GROUP BY host, line, pages HAVING count(*) >= 3 AND count(*) > 0.3::DOUBLE * pages
), lists AS (SELECT host, list(line) AS common FROM common GROUP BY 1
), kept AS (
  SELECT page_id, host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(common, []), x)) AS kept
  FROM lined LEFT JOIN lists USING (host)
)
SELECT page_id, host, array_to_string(kept, chr(10)) AS text, len(lines)::BIGINT AS n_lines,
  (len(lines) - len(kept))::BIGINT AS n_dropped FROM kept
"""


@query("op7_site_line_dedup", SITE_SQL)
def site_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return site_lines.without_boilerplate(read(spark, folder, "pages"))


QUALITY_SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), windows AS (
  SELECT doc_id, i, words[i:i + 2] AS w FROM (
    SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM base WHERE len(words) >= 3)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM again)
  GROUP BY 1
), doubled AS (
  SELECT doc_id, sum(n - 1)::BIGINT AS n FROM (
    SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM base)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2) GROUP BY 1
), normal AS (
  SELECT doc_id, source, text, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM (
    SELECT doc_id, source, text, trim(unnest(string_split(regexp_replace(regexp_replace(lower(text),
      '[\x20\x09\x0B-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g'), chr(10))), ' ') AS line FROM base) WHERE line <> ''
), hosts AS (SELECT source, count(DISTINCT text) AS docs FROM base GROUP BY 1
), common AS (
  SELECT n.source, line FROM normal n JOIN hosts h ON n.source IS NOT DISTINCT FROM h.source
  GROUP BY n.source, line, docs HAVING count(DISTINCT text) >= 10 AND count(DISTINCT text) > 0.1::DOUBLE * docs
), lefts AS (
  SELECT doc_id, sum(words)::BIGINT AS n FROM normal n WHERE NOT EXISTS (
    SELECT 1 FROM common c WHERE c.source IS NOT DISTINCT FROM n.source AND c.line = n.line) GROUP BY 1
), facts AS (
  SELECT b.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(d.n, 0)::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n, 0)::BIGINT AS words_left
  FROM base b LEFT JOIN repeats r USING (doc_id) LEFT JOIN doubled d USING (doc_id) LEFT JOIN lefts l USING (doc_id)
), verdict AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM facts
)
SELECT *, NOT base_failed AND words_left >= 50 AND words_left >= 0.5::DOUBLE * n_words AS kept FROM verdict
"""


@query("op8_quality_rules", QUALITY_SQL)
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(read(spark, folder, "documents"))


EXACT_SQL = r"""
WITH normal AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
  sha256(text) AS text_sha256
FROM normal WINDOW w AS (PARTITION BY text)
"""


@query("op9_exact_dedup_stream", EXACT_SQL)
def exact_dedup_stream(spark: SparkSession, folder: str) -> DataFrame:
    groups = exact.group_rows(read(spark, folder, "documents"))
    return groups.withColumnRenamed("digest", "text_sha256")


@query("op10_sentencepiece")
def sentencepiece_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    coded = pieces.encoded(read(spark, folder, "documents"), model_path(), back=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(pieces.id_text(), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op11_cross_tokenizer_alignment")
def cross_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    found = alignment.aligned(read(spark, folder, "documents"), byte_level_path(), model_path())
    return found.withColumnRenamed("groups", "groups_sha256")


@query("op12_retrieval_packing")
def retrieval_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces_of = packing.packed(read(spark, folder, "documents"), byte_level_path())
    return pieces_of.withColumn("ids_crc32", packing.crc32()).drop("tokens")


@query("op13_conversation_repair")
def conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.audited(read(spark, folder, "conversations"))
