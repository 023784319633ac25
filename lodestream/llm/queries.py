"""The queries opN_* over the tables, and their SQL where SQL can express them.

Each takes whole tables and whole texts, whatever their length.  Unless a
query says otherwise: a null text counts as an empty one, rows that repeat
(also a doc_id alone) give a row each, a null doc_id stays null, columns that
aren't named are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labelled, language_id, mixing, quality, toxicity
from .decontamination import leaks
from .embedding_duplicates import embedding_duplicates
from .line_dedup import line_report
from .lm_scoring import lm_scores
from .near_duplicates import near_duplicates
from .shared import documents, prepare, remainder
from .token_counts import token_counts


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document; a null source is the last one."""
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors; null, zero and non-finite ones link with nothing, equal ones are linked."""
    return embedding_duplicates(prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores, and (start, end, score) in bytes of the sentences that reach 0.3; without labels of both kinds all texts score alike."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts, y = labelled.sample(docs, labels, "toxic", remainder("doc_id", 4) != 2)
    out = toxicity.score(docs, toxicity.fit(texts, y))
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", predicted, F.col("sentences").alias("offending"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets, components and representatives; texts without words link with nothing, ties go to the smallest doc_id."""
    return near_duplicates(documents(spark, sf_dir), width=3, percent=85)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, distance, start, end) of the benchmark items found; documents without one, or with a null doc_id, have no row."""
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base's and the model's log10 probability; a null or empty text is its end alone, no training text gives the base of V = 0."""
    out = lm_scores(documents(spark, sf_dir), remainder("doc_id", 7) != 2)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores; without labels of both kinds all texts have the same score."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts, y = labelled.sample(docs, labels, "quality", remainder("doc_id", 5) != 0, quality.MAX_ROWS, quality.MAX_BYTES)
    out = quality.score(docs, quality.fit(texts, y))
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed): the first occurrence by (doc_id, line) stays; see line_report."""
    return line_report(documents(spark, sf_dir), short=True)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTF-8 bytes and tokens of each text; null texts have none of either."""
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best language; texts that are null or have no letter are und with score 0, ties go to the first by name."""
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs.filter(remainder("doc_id", 5) != 0))
    out = language_id.predict(docs, model, keep=["doc_id"])
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def queries() -> dict:
    return {
        "op1_mixing": op1_mixing,
        "op2_embedding_duplicates": op2_embedding_duplicates,
        "op3_toxicity": op3_toxicity,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_decontamination": op5_decontamination,
        "op6_lm_scoring": op6_lm_scoring,
        "op7_quality": op7_quality,
        "op8_line_dedup": op8_line_dedup,
        "op9_token_counts": op9_token_counts,
        "op10_language": op10_language,
    }


#: Reachability over links (a, b) among ids: (id, component), the smallest id reachable.
_REACH = """reach(id, r) AS (SELECT id, id FROM ids UNION SELECT reach.id, l.b FROM reach JOIN links l ON l.a = reach.r),
component AS (SELECT id, min(r) AS component FROM reach GROUP BY id)"""


def _embedding_sql() -> str:
    """All pairs of usable vectors."""
    return f"""WITH RECURSIVE ids AS (SELECT vec_id AS id FROM embeddings),
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e) AND list_cosine_similarity(p.e, q.e) >= 0.95),
{_REACH}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, component AS component_id, id = component AS kept FROM component"""


def _near_duplicate_sql(width: int = 3, percent: int = 85) -> str:
    """All pairs of documents that share a shingle."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""WITH RECURSIVE ids AS (SELECT doc_id AS id FROM documents),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {width} THEN list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width} - 1], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
{_REACH}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component AS component_id, id = component AS kept FROM component LEFT JOIN n ON n.doc_id = id"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the exact result: op2 and op4 by all pairs."""
    return {"op2_embedding_duplicates": _embedding_sql(), "op4_near_duplicates": _near_duplicate_sql()}
