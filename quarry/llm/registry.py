"""The corpus operators' queries over the test tables, with DuckDB oracles where SQL can
express them. Each query reads whole tables and returns its operator's full result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.ann import ann_search
from quarry.llm.exact_dedup import exact_dedup
from quarry.llm.line_dedup import line_dedup
from quarry.llm.mixing import mix_plan
from quarry.llm.ngram_join import ngram_components
from quarry.llm.packing import pack
from quarry.llm.suffix_dedup import suffix_dedup
from quarry.llm.toxicity import toxicity
from quarry.llm.url_filter import RULES, url_verdicts
from quarry.llm.warc import read_warc, write_warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark, d):
    return toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


def op2_ann(spark, d):
    vectors = table(spark, d, "embeddings")
    return ann_search(vectors, vectors.where("vec_id % 100 = 0"))


def op3_exact_dedup(spark, d):
    return exact_dedup(table(spark, d, "documents"))


def op4_mixing(spark, d):
    plan = mix_plan(table(spark, d, "documents"))
    ordered = plan.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
    return ordered.select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("position", 9).alias("position")
    )


def op5_ngram_jaccard(spark, d):
    return ngram_components(table(spark, d, "documents"))


def op6_line_dedup(spark, d):
    out = line_dedup(table(spark, d, "documents"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", "n_lines", "n_removed", digest.alias("text_sha256"))


def op7_url_filter(spark, d):
    return url_verdicts(table(spark, d, "pages"))


def op8_packing(spark, d):
    return pack(table(spark, d, "documents"))


def op9_warc(spark, d):
    index = write_warc(table(spark, d, "pages"))
    return read_warc(index, with_payload=False).drop("payload", "url")


def op10_suffix_dedup(spark, d):
    return suffix_dedup(table(spark, d, "documents"), with_text=False).drop("kept_text")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_ann": op2_ann,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_mixing": op4_mixing,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_line_dedup": op6_line_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_packing": op8_packing,
    "op9_warc": op9_warc,
    "op10_suffix_dedup": op10_suffix_dedup,
}

_WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"
_RULES = ", ".join(
    f"('{h}', '{p}', '{v}', {i})"
    for i, (h, p, v) in enumerate(sorted(RULES, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))))
)

ORACLE_SQL = {
    "op3_exact_dedup": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)""",
    "op4_mixing": f"""
WITH s AS (SELECT doc_id, source, {_WORDS}::BIGINT AS size, md5(doc_id::VARCHAR) AS o FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY ALL),
p AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place FROM g),
w AS (SELECT *, [5.0, 2.0, 1.0][place + 1]::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM p),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lv
      FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT source, source_size, [-0.5, 0.0, 0.5][place + 1]::DOUBLE AS slope, CASE WHEN cap <= w * lv THEN cap
      ELSE w * max(CASE WHEN cap > w * lv THEN lv END) OVER () END AS target FROM l),
d AS (SELECT s.doc_id, s.size, f.source_size, f.target, f.slope,
      coalesce(floor(f.target / nullif(f.source_size, 0)), 0)::BIGINT AS full_,
      coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY o, s.size, s.doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM s JOIN f ON s.source IS NOT DISTINCT FROM f.source),
e AS (SELECT *, least(before / nullif(target, 0), 1.0) AS share,
  (full_ * size + greatest(0, least(size, floor(target - full_ * source_size)::BIGINT - before)))::BIGINT AS taken FROM d)
SELECT doc_id, size, source_size, round(target, 6) AS target, taken, round(CASE WHEN taken = 0 THEN NULL WHEN slope = 0 THEN share
  ELSE abs(sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / abs(2 * slope) END, 9) AS position FROM e""",
    "op5_ngram_jaccard": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 4)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n l ON l.doc_id = x JOIN n r ON r.doc_id = y WHERE 100 * c >= 75 * (l.n + r.n - c)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, u.y FROM reach JOIN u ON u.x = reach.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.y) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.x = d.doc_id GROUP BY ALL""",
    "op6_line_dedup": """
WITH l AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, ls, unnest(range(len(ls) - 2)) AS pos FROM l WHERE len(ls) >= 3),
w AS (SELECT doc_id, pos, ls[pos + 1] AS a, ls[pos + 2] AS b, ls[pos + 3] AS c FROM x
      WHERE length(trim(ls[pos + 1] || ls[pos + 2] || ls[pos + 3], ' ')) > 0),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS k FROM w),
c AS (SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS i FROM r WHERE k > 1),
e AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM l),
k AS (SELECT e.doc_id, count(*) AS n_lines, count(c.i) AS n_removed,
      coalesce(string_agg(e.line, chr(10) ORDER BY e.i) FILTER (WHERE c.i IS NULL), '') AS x
      FROM e LEFT JOIN c USING (doc_id, i) GROUP BY e.doc_id)
SELECT k.doc_id, CASE WHEN l.text IS NULL THEN 0 ELSE n_lines END AS n_lines, n_removed, sha256(x) AS text_sha256
FROM k JOIN l USING (doc_id)""",
    "op7_url_filter": rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM u),
r(rh, rp, v, k) AS (VALUES {_RULES}),
m AS (SELECT h.page_id, h.host, h.path, arg_max(rh || rp, k) AS rule, arg_max(v, k) AS v
      FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m""",
    "op10_suffix_dedup": """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 400)) AS k, md5(substr(h, 2 * i + 1, 400)) AS m
      FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 199)) AS i FROM t WHERE len(h) >= 400)),
r AS (SELECT k, m FROM w GROUP BY ALL HAVING count(*) > 1),
c AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w SEMI JOIN r USING (k, m)),
g AS (SELECT doc_id, i, count(CASE WHEN p IS NULL OR i > p + 200 THEN 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM c),
x AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, n),
y AS (SELECT x.doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER o, 0) + 1, 2 * (a - coalesce(lag(b) OVER o, 0))) AS gap, h
      FROM x JOIN t USING (doc_id) WINDOW o AS (PARTITION BY x.doc_id ORDER BY a)),
z AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
      string_agg(gap, '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM y GROUP BY doc_id)
SELECT t.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM t LEFT JOIN z USING (doc_id)""",
    "op9_warc": """
WITH t AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
g AS (SELECT *, strlen(x) AS n, min(page_id) OVER (PARTITION BY x) AS first FROM t)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(x) AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM g""",
}
