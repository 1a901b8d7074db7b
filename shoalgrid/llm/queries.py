"""The opN queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    return toxicity.predictions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    return bpe.token_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op2_multi_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import multiindex

    return multiindex.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses

    return licenses.license_report(_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    return secrets.secret_digests(_table(spark, sf_dir, "documents"))


def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffixes

    return suffixes.repeat_digests(_table(spark, sf_dir, "documents"))


def op10_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import crosspolytope

    return crosspolytope.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_multi_index_dedup": op2_multi_index_dedup,
        "op3_license_scan": op3_license_scan,
        "op4_secret_scan": op4_secret_scan,
        "op5_simhash_dedup": op5_simhash_dedup,
        "op6_toxicity": op6_toxicity,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_arc_to_warc": op8_arc_to_warc,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_cross_polytope": op10_cross_polytope,
    }


_OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM m
"""


def _clock(v: str) -> str:
    """Slots passed when each source has been due w * v blocks."""
    return f"list_reduce(list_transform(range(1, len(n) + 1), lambda q: least(n[q], w[q] * ({v}))), lambda a, x: a + x)"


def _pick(latest: str) -> str:
    """Released before not released, then the earliest deadline, then the first source: as one number whose last four digits are the source."""
    return (
        f"list_min(list_filter(list_transform(range(1, len(n) + 1), lambda j: CASE WHEN sent[j] < ends[j] THEN "
        f"CASE WHEN CAST(floor({_clock('sent[j] / w[j]')} + 1e-5) AS BIGINT) > t THEN 100000000000000000 ELSE 0 END + "
        f"least({latest}, CAST(ceil({_clock('(sent[j] + 1) / w[j]')} - 1e-5) AS BIGINT)) * 10000 + j END), lambda x: x IS NOT NULL))"
    )


# The folds over a chunk's slots as recursions: `warm` up to each chunk's start, `sim` over its slots.
_OP1 = f"""
WITH RECURSIVE
r AS (SELECT doc_id, source, coalesce('s' || source, 'null') AS src,
             row_number() OVER (PARTITION BY coalesce('s' || source, 'null')
                                ORDER BY coalesce(md5(CAST(doc_id AS VARCHAR)), ''), doc_id NULLS FIRST) - 1 AS rnk FROM documents),
s AS (SELECT src, (count(*) + 15) // 16 AS blocks, sqrt(CAST(count(*) AS DOUBLE)) AS w FROM r GROUP BY src),
g AS (SELECT list(src ORDER BY src) AS names, list(CAST(blocks AS DOUBLE) ORDER BY src) AS n, list(w ORDER BY src) AS w, CAST(sum(blocks) AS BIGINT) AS total,
             CAST(ceil(sum(w) / min(w) - 1e-9) AS BIGINT) AS ahead, greatest(256, CAST(ceil(sum(w) / min(w) - 1e-9) AS BIGINT)) AS length FROM s),
c AS (SELECT unnest(range(0, (total + length - 1) // length + 1)) AS c FROM g),
o AS (SELECT c, greatest(0, c * length - ahead) AS t0, c * length AS stop, unnest(range(1, len(n) + 1)) AS j, n, w, names FROM c, g WHERE c > 0 AND c * length < total),
kn AS (SELECT list_reduce(list_transform(range(1, len(n) + 1), lambda q: CASE WHEN n[q] / w[q] <= u THEN n[q] ELSE 0.0 END), lambda a, x: a + x) AS past,
              list_reduce(list_transform(range(1, len(n) + 1), lambda q: CASE WHEN n[q] / w[q] > u THEN w[q] ELSE 0.0 END), lambda a, x: a + x) AS rate
       FROM (SELECT n, w, unnest(list_prepend(CAST(-1 AS DOUBLE), list_transform(range(1, len(n) + 1), lambda q: n[q] / w[q]))) AS u FROM g)),
v AS (SELECT c, max((t0 - past) / rate) AS v FROM (SELECT DISTINCT c, t0 FROM o), kn WHERE rate > 0 GROUP BY c),
f AS (SELECT o.*, least(n[j], w[j] * v) AS f, floor(least(n[j], w[j] * v) + 1e-5) AS low FROM o JOIN v USING (c)),
d AS (SELECT *, ceil({_clock('(low + 1) / w[j]')} - 1e-5) AS due FROM f),
e AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY f - low <= 1e-5, due, j) AS nth, t0 - sum(low) OVER (PARTITION BY c) AS more FROM d),
warm AS (
  SELECT c, t0 AS t, stop, list(CAST(low + CASE WHEN f - low > 1e-5 AND nth <= more THEN 1 ELSE 0 END AS BIGINT) ORDER BY j) AS sent FROM e GROUP BY c, t0, stop
  UNION ALL
  SELECT c, t + 1, stop, list_transform(sent, lambda x, i: x + CASE WHEN i = pick % 10000 THEN 1 ELSE 0 END)
  FROM (SELECT warm.*, {_pick('total')} AS pick FROM (SELECT *, n AS ends FROM g) g, warm WHERE t < stop)
),
st AS (SELECT c, sent FROM warm WHERE t = stop
       UNION ALL SELECT 0, list_transform(n, lambda x: CAST(0 AS BIGINT)) FROM g
       UNION ALL SELECT (total + length - 1) // length, list_transform(n, lambda x: CAST(x AS BIGINT)) FROM g),
sim AS (
  SELECT a.c, a.c * length AS t, least((a.c + 1) * length, total) AS stop, a.sent, z.sent AS ends, CAST(NULL AS BIGINT) AS i, CAST(NULL AS BIGINT) AS k FROM st a JOIN st z ON z.c = a.c + 1, g
  UNION ALL
  SELECT c, t + 1, stop, list_transform(sent, lambda x, i: x + CASE WHEN i = pick % 10000 THEN 1 ELSE 0 END), ends, pick % 10000, sent[pick % 10000]
  FROM (SELECT sim.*, {_pick('stop')} AS pick FROM g, sim WHERE t < stop)
),
slots AS (SELECT names[i] AS src, k, t - 1 AS slot FROM sim, g WHERE i IS NOT NULL)
SELECT r.doc_id, r.source, CAST(r.rnk AS BIGINT) AS mix_rank, CAST(slot AS BIGINT) AS mix_block, CAST(slot * 16 + rnk % 16 AS BIGINT) AS mix_position
FROM r JOIN slots ON slots.src = r.src AND slots.k = r.rnk // 16
"""


_OP2 = """
WITH RECURSIVE
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
f AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
        AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
t(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.b, t.y FROM t JOIN p ON p.a = t.x WHERE t.y < p.b),
c AS (SELECT x, min(y) AS component_id FROM t GROUP BY x),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON x = vec_id LEFT JOIN n ON a = vec_id
"""

_OP9 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, hex(b[p:p + 49]) AS s FROM (SELECT doc_id, b, unnest(range(1, n - 48)) AS p FROM d WHERE n >= 50)),
lo AS (SELECT s, min(doc_id) AS lo FROM w GROUP BY s HAVING count(*) > 1),
m AS (SELECT doc_id, p FROM w JOIN lo USING (s) WHERE lo < doc_id),
g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS start FROM m),
i AS (SELECT doc_id, p, sum(start) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g),
r AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS z FROM i GROUP BY doc_id, k),
q AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS c0, a - 1 AS c1 FROM r
      UNION ALL SELECT doc_id, max(z), (SELECT n FROM d WHERE d.doc_id = r.doc_id) FROM r GROUP BY doc_id),
t AS (SELECT doc_id, string_agg(hex(b[c0:c1]), '' ORDER BY c0) AS kept FROM q JOIN d USING (doc_id) WHERE c1 >= c0 GROUP BY doc_id),
u AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(CASE WHEN removed IS NULL THEN b ELSE from_hex(coalesce(kept, '')) END) AS kept_sha256
FROM d LEFT JOIN u USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": _OP1,
        "op2_multi_index_dedup": _OP2,
        "op8_arc_to_warc": _OP8,
        "op9_suffix_dedup": _OP9,
    }
