"""The registered queries of this folder and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity, url_filters
from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .filter_audit import filter_audit
from .html_region import extract
from .jaccard_join import jaccard_components
from .line_dedup import line_dedup
from .odd_sketches import near_duplicates
from .packing import pack
from .runtime import read
from .substring_dedup import passages
from .token_store import token_store
from .tokens import vocabulary
from .vector_codes import ENTRIES, PARTS, ROUNDS, vector_codes

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


OP1_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
"""


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL)),
bk AS (SELECT item_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS k FROM b WHERE n > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM bk),
dk AS (SELECT r, n, w, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM bw)),
hits AS (SELECT r, k, dw.n, item_id FROM (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS win FROM dk) dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + n - 1)) AS p FROM (SELECT DISTINCT r, k, n FROM hits)) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS named FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(named, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return url_filters.filter_captures(url_filters.sample_captures(pages), url_filters.sample_entries(pages))


OP7_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, url, TIMESTAMP '2024-01-01' + to_hours((('0x' || substr(md5(page_id::VARCHAR), 1, 8))::BIGINT % 8784)) AS fetched_at,
       nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host,
       regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
seen AS (SELECT host, min(regexp_extract(path, '^(/[^/]+)', 1)) AS path FROM p WHERE host IS NOT NULL GROUP BY host),
n AS (SELECT host, path, k, md5(host || ':' || k) AS m FROM seen, (SELECT unnest([0, 1, 2, 3]) AS k)),
entries AS (SELECT CASE WHEN k < 2 THEN host WHEN k = 2 THEN regexp_replace(host, '^[^.]*\.', '') ELSE host || path END AS pattern,
       ['block', 'allow', 'remove'][1 + ('0x' || substr(m, 5, 4))::BIGINT % 3] AS action, DATE '2024-01-01' + (('0x' || substr(m, 9, 4))::BIGINT % 366)::INTEGER AS listed_on
       FROM n WHERE ('0x' || substr(m, 1, 4))::BIGINT % 3 > 0),
daily AS (SELECT pattern, listed_on, max_by(action, CASE action WHEN 'block' THEN 2 WHEN 'allow' THEN 1 ELSE 0 END) AS action FROM entries GROUP BY ALL),
spans AS (SELECT * FROM (SELECT pattern, action, listed_on AS valid_from, lead(listed_on) OVER (PARTITION BY pattern ORDER BY listed_on) AS valid_to FROM daily) WHERE action <> 'remove'),
c AS (SELECT r, fetched_at, host AS asked FROM p WHERE host IS NOT NULL
      UNION ALL SELECT r, fetched_at, array_to_string(l[i:len(l)], '.') FROM (SELECT r, fetched_at, l, unnest(generate_series(2, len(l) - 1)) AS i FROM (SELECT r, fetched_at, string_split(host, '.') AS l FROM p WHERE host IS NOT NULL))
      UNION ALL SELECT r, fetched_at, host || '/' || array_to_string(s[1:i], '/') FROM (SELECT r, fetched_at, host, s, unnest(generate_series(1, len(s))) AS i FROM (SELECT r, fetched_at, host, [x FOR x IN string_split(path, '/') IF x <> ''] AS s FROM p WHERE host IS NOT NULL))),
best AS (SELECT r, arg_max({'pattern': pattern, 'action': action}, {'n': length(pattern), 'pattern': pattern}) AS b
         FROM c JOIN spans ON asked = pattern AND fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to) GROUP BY r)
SELECT page_id, url, fetched_at, b.pattern AS pattern, b.action AS action, coalesce(b.action = 'block', false) AS blocked FROM p LEFT JOIN best USING (r)
"""


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS k FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS sh FROM k),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 75 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS doc, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON r.doc = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT doc AS doc_id, min(root) AS component_id FROM r GROUP BY doc) c USING (doc_id)
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(read(spark, sf_dir, "embeddings"))


def _op11_sql() -> str:
    """Rounds unrolled: parts, entries and assignments as rows ``(p, k, vector)``."""
    steps = []
    for r in range(ROUNDS + 1):
        near = f"SELECT vec_id, x.p, min({{'d': list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'k': c.k}}) AS b FROM parts x JOIN c{r} c ON x.p = c.p GROUP BY vec_id, x.p"
        steps.append(f"a{r} AS MATERIALIZED ({near})")
        if r < ROUNDS:
            sums = f"SELECT p, b.k AS k, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r} JOIN parts USING (vec_id, p), (SELECT unnest(generate_series(1, (SELECT max(len(v)) FROM parts))) AS i) GROUP BY ALL"
            mean = f"SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM ({sums}) GROUP BY p, k"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.p, c.k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN ({mean}) m ON c.p = m.p AND c.k = m.k)")
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
parts AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // {PARTS} + 1:(p + 1) * len(v) // {PARTS}] AS v FROM kept, (SELECT unnest(generate_series(0, {PARTS - 1})) AS p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, v FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})),
{', '.join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', b.k), '' ORDER BY p) AS code, sum(b.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) AS digest FROM c{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256 FROM coded JOIN kept USING (vec_id), book
"""


OP11_SQL = _op11_sql()


def op12_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS k FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 3], ' ') AS sh FROM k),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS doc, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON r.doc = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT doc AS doc_id, min(root) AS component_id FROM r GROUP BY doc) c USING (doc_id)
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
      regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails FROM d),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS bad FROM labels GROUP BY doc_id),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
      FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) a, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) b, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) c,
           (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) d, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, [position(substr(filter_order, i, 1) IN 'ABCDE') FOR i IN generate_series(1, step - 1)] AS before, position(substr(filter_order, step, 1) IN 'ABCDE') AS k
      FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
g AS (SELECT part, filter_order, step, k, n, good, bad, fails[k] AS fail, len(list_filter(before, lambda j: fails[j])) > 0 AS gone, len(list_filter(fails, lambda x: x)) = 1 AS one FROM s, m),
c AS (SELECT part, filter_order, step, k, coalesce(sum(n) FILTER (NOT gone AND NOT fail), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND fail), 0)::BIGINT AS removed,
      coalesce(sum(n) FILTER (gone AND fail), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fail AND one), 0)::BIGINT AS unique_fails,
      coalesce(sum(good) FILTER (NOT gone AND fail), 0)::BIGINT AS good_lost, coalesce(sum(bad) FILTER (NOT gone AND fail), 0)::BIGINT AS toxic_lost FROM g GROUP BY ALL)
SELECT * EXCLUDE (k), sum(removed) OVER (PARTITION BY part, k)::BIGINT AS shapley FROM c
"""


QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_store": op2_token_store,
    "op3_html_extraction": op3_html_extraction,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_url_filters": op7_url_filters,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_toxicity": op10_toxicity,
    "op11_vector_codes": op11_vector_codes,
    "op12_odd_sketches": op12_odd_sketches,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op6_decontamination": OP6_SQL,
    "op7_url_filters": OP7_SQL,
    "op9_jaccard_join": OP9_SQL,
    "op11_vector_codes": OP11_SQL,
    "op12_odd_sketches": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}
