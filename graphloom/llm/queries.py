"""The operators bound to the supplied tables, with SQL that gives the same rows where it can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import ann, chat, itq, line_dedup, mixing, negatives, packing, pieces, quality, sharding, simhash
from graphloom.llm import token_files, whitening
from graphloom.storage import StageTables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op4_token_files")
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_and_read(table(spark, sf_dir, "documents"))


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op7_interleaved_shards")
def op7_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = sharding.interleave(docs, tie=("doc_id", "text_crc32"))
    return placed.drop("source").select(
        "*", F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    )


@query(
    "op8_line_dedup",
    r"""
WITH lines AS (
  SELECT doc_id, i AS pos, string_split(text, chr(10)) AS all_lines, string_split(text, chr(10))[i] AS line
  FROM documents, generate_series(1, len(string_split(text, chr(10)))) AS g(i)
),
sums AS (
  SELECT doc_id, pos, n, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS upto
  FROM (SELECT doc_id, pos, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines)
),
ends AS (
  SELECT doc_id, upto, min(pos) AS stop FROM sums GROUP BY 1, 2
),
starts AS (
  SELECT doc_id, upto - n AS before, max(pos) AS start FROM sums GROUP BY 1, 2
),
-- A run of 30 words is made of the fewest lines that hold them, from its first line or back from its last.
spans AS (
  SELECT s.doc_id, s.pos, e.stop
  FROM sums s ASOF JOIN ends e ON s.doc_id = e.doc_id AND s.upto - s.n + 30 <= e.upto
  UNION
  SELECT s.doc_id, b.start, s.pos
  FROM sums s ASOF JOIN starts b ON s.doc_id = b.doc_id AND s.upto - 30 >= b.before
),
copies AS (
  SELECT doc_id, pos, stop FROM (
    SELECT s.doc_id, s.pos, s.stop,
      row_number() OVER (PARTITION BY array_to_string(list_slice(l.all_lines, s.pos, s.stop), chr(10))
                         ORDER BY s.doc_id, s.pos) AS turn
    FROM spans s JOIN lines l ON l.doc_id = s.doc_id AND l.pos = s.pos)
  WHERE turn > 1
),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(pos, stop)) AS pos FROM copies
),
left_over AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS removed_lines,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos
  GROUP BY 1
)
SELECT doc_id, text, CAST(n_lines AS INT) AS n_lines, CAST(removed_lines AS INT) AS removed_lines FROM left_over
""",
)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.remove_repeated_lines(docs)


@query(
    "op9_mixing",
    r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM sized GROUP BY source
),
rates AS (
  SELECT *, 3 * source_size AS most, 3 * source_size / w AS ratio, sum(source_size) OVER () AS whole,
    sum(3 * source_size) OVER (ORDER BY 3 * source_size / w RANGE UNBOUNDED PRECEDING)
      + 3 * source_size / w * (sum(w) OVER () - sum(w) OVER (ORDER BY 3 * source_size / w RANGE UNBOUNDED PRECEDING))
      <= sum(source_size) OVER () AS capped
  FROM sources
),
goals AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(most AS DOUBLE) ELSE
    CAST(whole - coalesce(sum(most) FILTER (WHERE capped) OVER (), 0) AS DOUBLE) * w
      / sum(w) FILTER (WHERE NOT capped) OVER () END AS target
  FROM rates
),
ordered AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, CAST(floor(g.target + 0.5) AS BIGINT) AS budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('42|' || d.doc_id), d.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE
  budget // source_size * size + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM ordered
""",
)
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    return mixing.mix(docs, StageTables(spark, "mix")).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_line_crf")
def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model).drop("text")
    return scored.select(
        "doc_id",
        F.coalesce(~quality.in_training(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query("op2_curve_neighbours")
def op2_curve_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op3_chat_format")
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.format_and_read(rows.unionByName(own))


@query("op6_itq_near_copies")
def op6_itq_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.classes_of_vectors(table(spark, sf_dir, "embeddings"))


@query("op11_piece_agenda")
def op11_piece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op12_bidiagonal_whitening")
def op12_bidiagonal_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query(
    "op13_residue_negatives",
    """
WITH usable AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id,
    CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
pairs AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM pairs p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
""",
)
def op13_residue_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)
