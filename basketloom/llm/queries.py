"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules that the url query judges by.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("allow", "example.net/de/8"), ("block", "org/es/")]
BYTE_RANKS = "byte_bpe_50k.tiktoken"
#: Nodes reachable by links, and the least of them.
_REACH = "reach AS (SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a), least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY 1)"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import linededup

    out = linededup.report(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", "kept_text")


#: Runs of 50 words that aren't longer than needed at one end; those that stand earlier as well go.
OP1_SQL = """
WITH cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
trimmed AS (SELECT *, trim(line, chr(32) || chr(9) || chr(13) || chr(12) || chr(11)) AS t FROM cut),
full_lines AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, len(regexp_extract_all(t, '[^ \\t\\r\\f\\v]+')) AS w FROM trimmed WHERE t <> ''),
sums AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM full_lines),
whole AS (SELECT doc_id, list(t ORDER BY pos) AS ts FROM full_lines GROUP BY 1),
runs AS (SELECT a.doc_id, a.pos, b.pos AS last FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + 49
    WHERE b.upto - a.upto + a.w >= 50 AND (b.upto - a.upto + a.w - b.w < 50 OR b.upto - a.upto < 50)),
named AS (SELECT r.*, array_to_string(ts[pos + 1:last + 1], chr(10)) AS content FROM runs r JOIN whole USING (doc_id)),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, pos) AS copy FROM named) WHERE copy > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, last + 1)) AS pos FROM later),
n_of AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE before IS NULL OR before <> pos - 1) AS n_runs
    FROM (SELECT *, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM gone) GROUP BY 1),
kept AS (SELECT c.doc_id, string_agg(c.line, chr(10) ORDER BY c.i) FILTER (WHERE g.pos IS NULL) AS kept_text, count(f.pos) AS n_lines
    FROM cut c LEFT JOIN full_lines f ON f.doc_id = c.doc_id AND f.i = c.i LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.pos = f.pos GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
    CASE WHEN n_removed IS NULL THEN d.text WHEN n_removed = n_lines THEN '' ELSE kept_text END AS kept_text
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN n_of USING (doc_id)
"""


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import urlfilter

    return urlfilter.judge(table(spark, sf_dir, "pages"), [urlfilter.parse(*r) for r in URL_RULES], keep=["page_id"])


OP2_SQL = """
WITH parts AS (
  SELECT page_id,
         CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
hosts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
judged AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/7%' THEN 'example.com/en/7'
              WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/de/8%' THEN 'example.net/de/8'
              WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/en/%' THEN 'com/en/'
              WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/de/%' THEN 'net/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/es/%' THEN 'org/es/' END AS rule
  FROM hosts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/en/', 'net/de/', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


OP4_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
linked AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
{_REACH}, counted AS (SELECT a, count(*) AS n FROM linked GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, least(vec_id, coalesce(m, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN counted c ON c.a = vec_id LEFT JOIN least_of o ON o.a = vec_id
"""


def token_digests(docs: DataFrame) -> DataFrame:
    """Digest columns of encoded documents, and of the bytes decoded from the ids."""
    from . import bytebpe

    ranks = public_tokenizers.path(BYTE_RANKS)
    encoded = bytebpe.encode(docs, ranks).select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
    )
    decoded = bytebpe.decode(encoded, ranks, keep=("doc_id", "n_tokens", "ids_sha256"))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


OP3_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
linked AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
{_REACH}
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, least(d.doc_id, coalesce(m, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least_of ON a = d.doc_id
"""


def op4_embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embdedup

    return embdedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    return decontam.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 3 == 1
    model = langid.train(docs, ~held_out)
    out = langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tokenstore, util

    path = util.Scratch(spark, "token-store").path("files")
    tokenstore.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    out = tokenstore.read(spark, path)
    return out.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    out = sharding.interleave(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


#: Up to so many marked ids are broadcast (about 50 MB); more are joined by a merge, which moves the texts.
MARKS = 1_000_000


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lmscore, util

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    good = util.Scratch(spark, "lm-marks").keep(good.withColumn("chosen", F.lit(True)), "marks")
    marked = docs.join(F.broadcast(good) if good.count() <= MARKS else good.hint("merge"), "doc_id", "left")
    return lmscore.score(marked, lmscore.fit(marked, F.col("chosen"), text_bytes=lmscore.length(docs)))


def queries() -> dict:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op2_url_filter": OP2_SQL, "op3_minhash": OP3_SQL, "op4_embedding_neighbours": OP4_SQL}
