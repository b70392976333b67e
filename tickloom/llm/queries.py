"""One query for each operator, over whole tables, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, quality
from . import url_filter as urls
from .decontaminate import decontaminate
from .divergence import source_divergence
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives
from .line_dedup import remove_repeated_lines
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .repeats import remove_repeats
from .token_files import token_files
from .topk_search import top_k

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages give evidence of their own; every fifth (by its hash) gives none, to be judged by the others' alone."""
    pages = table(spark, sf_dir, "pages")
    learned = F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 8), 16, 10).cast("long") % 5 != 0
    return urls.url_filter(pages, urls.evidence(pages.filter(learned)))


def op1_sql() -> str:
    fits = lambda h: f"(host = '{h}' OR ends_with(host, '.{h}'))"
    rules = sorted(urls.RULES, key=lambda r: -len(r[0] + r[1]))
    case = lambda pick: "CASE " + " ".join(
        f"WHEN {fits(h)} AND starts_with(path, '{p}') THEN '{pick(h, p, v)}'" for h, p, v in rules) + " END"
    levels, m, z = 8, urls.MAX_CHILDREN, urls.SIMILAR_Z  # the tables' paths have fewer levels
    steps = []
    for i in range(1, levels + 1):
        steps.append(f"""
t{i} AS (SELECT *, coalesce(shape[{i}], '') AS seg FROM a{i - 1} WHERE len(shape) >= {i - 1}),
c{i} AS (SELECT host, prefix, seg, sum(lab) AS lab, sum(bad) AS bad FROM t{i} GROUP BY ALL),
n{i} AS (SELECT host, prefix, sum(lab) AS nlab, sum(bad) AS nbad, count(*) AS children FROM c{i} GROUP BY ALL),
m{i} AS (SELECT host, prefix, seg, CASE WHEN seg <> '' AND (children > {m} OR (children > 1 AND lab > 0))
  AND (lab = 0 OR pow(bad / greatest(lab, 1.0) - p, 2) * lab <= {z}::DOUBLE * {z}::DOUBLE * p * (1.0 - p)) THEN '*' ELSE seg END AS t
  FROM (SELECT *, nbad / greatest(nlab, 1.0) AS p FROM c{i} JOIN n{i} USING (host, prefix))),
a{i} AS (SELECT host, shape, lab, bad, prefix || '/' || t AS prefix FROM t{i} JOIN m{i} USING (host, prefix, seg)
  UNION ALL SELECT host, shape, lab, bad, prefix FROM a{i - 1} WHERE len(shape) < {i - 1})""")
    words = ", ".join(f"'{w}'" for w in urls.BAD_WORDS)
    return f"""
WITH u AS (SELECT page_id, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UP}', '{LOW}'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, regexp_replace(html, '<[^>]*>', ' ', 'g') AS t FROM pages),
s AS (SELECT *, string_split(regexp_replace(regexp_replace(path, '^/', ''), '[0-9]+', '#', 'g'), '/') AS shape,
  list_has_any(regexp_split_to_array(host, '[.-]'), [{words}]) OR length(t) - length(replace(t, '|', '')) >= {urls.BARS} * greatest(length(t) - length(replace(t, ' ', '')), 1) AS bad FROM u),
l AS (SELECT page_id, count(*)::DOUBLE AS lab, sum(bad::INT)::DOUBLE AS bad FROM s
  WHERE bad IS NOT NULL AND ('0x' || substr(md5(page_id::VARCHAR), 1, 8))::BIGINT % 5 <> 0 GROUP BY 1),
a0 AS (SELECT host, shape, coalesce(sum(l.lab), 0.0) AS lab, coalesce(sum(l.bad), 0.0) AS bad, '' AS prefix
  FROM s LEFT JOIN l USING (page_id) GROUP BY host, shape),
r AS (SELECT coalesce(sum(bad), 0.0) / greatest(coalesce(sum(lab), 0.0), 1.0) AS rate FROM a0),{','.join(steps)},
q AS (SELECT host, prefix, (sum(bad) + {urls.SMOOTHING} * any_value(rate)) / (sum(lab) + {urls.SMOOTHING}) AS purity
  FROM a{levels}, r GROUP BY ALL)
SELECT page_id, host, path, {case(lambda h, p, v: h + p)} AS rule,
  coalesce({case(lambda h, p, v: v)}, CASE WHEN purity >= {urls.REJECT} THEN 'block' ELSE 'allow' END) AS verdict, prefix AS template
FROM s JOIN a{levels} USING (host, shape) JOIN q USING (host, prefix)"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_lines(table(spark, sf_dir, "documents")).drop("text")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text", "items")


WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '{up}', '{low}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(up=UP, low=LOW)

OP3_SQL = f"""
WITH b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
k AS (SELECT DISTINCT item_id, len(least(w, w)[i:i + least(13, len(w)) - 1]) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
d AS (SELECT doc_id, {WORDS} AS w FROM documents),
m AS (SELECT DISTINCT m FROM k),
p AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win FROM d, m, unnest(range(1, len(w) - m + 2)) AS t(i)),
h AS (SELECT p.doc_id, p.m, p.i, k.item_id FROM p JOIN k ON p.win = k.win AND p.m = k.m),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, m, i FROM h), unnest(range(i, i + m)) AS t(j) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""


def op4_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources get the same share; as many rows as documents are expected."""
    return mix_sources(table(spark, sf_dir, "documents"), seed=42)


OP4_SQL = """
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
s AS (SELECT sum(n)::DOUBLE AS total, count(*)::DOUBLE AS k FROM n),
r AS (SELECT source, total * 1.0 / k / n AS rate, greatest(1, ceil(total * 1.0 / k / n / 64.0))::INT AS draws FROM n, s),
d AS (SELECT documents.*, rate / draws AS mean, j,
  ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || j), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents JOIN r ON documents.source IS NOT DISTINCT FROM r.source, unnest(range(draws)) AS t(j)),
p AS (SELECT source, 0 AS k, exp(-(rate / draws)) AS p, exp(-(rate / draws)) AS cum, rate / draws AS mean FROM r
  UNION ALL SELECT source, k + 1, p * mean / (k + 1), cum + p * mean / (k + 1), mean FROM p WHERE k < 255),
c AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.j, count(p.k) AS k FROM d
  LEFT JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.u >= p.cum GROUP BY ALL),
t AS (SELECT doc_id, text, lang, source, n_chars, sum(k)::BIGINT AS n_copies FROM c GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, n_copies, copy,
  md5('42:order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy) AS shuffle_key
FROM t, unnest(range(n_copies)) AS x(copy)"""


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


OP5_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), tokenizer_path())


#: Each 100 bytes as 200 hexadecimal digits, cut from pieces, as cutting from a long text is slow.
OP7_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, k, substr(h, k * 800 + 1, 998) AS s FROM d, unnest(range((len(h) + 799) // 800)) AS t(k)),
w AS (SELECT doc_id, k * 400 + i AS p, substr(s, 2 * i + 1, 200) AS g FROM c, unnest(range(400)) AS t(i) WHERE 2 * i + 200 <= len(s)),
r AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1),
n AS (SELECT *, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, true) AS new FROM r),
i AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM n),
s AS (SELECT doc_id, island, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY ALL),
x AS (SELECT doc_id, island, a, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY island) AS z FROM s
  UNION ALL SELECT d.doc_id, 1000000000, len(any_value(h)) // 2, coalesce(max(b), 0) FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id),
k AS (SELECT doc_id, string_agg(substr(h, (2 * z + 1)::BIGINT, (2 * (a - z))::BIGINT), '' ORDER BY island) AS kept FROM x JOIN d USING (doc_id) GROUP BY doc_id),
t AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS runs FROM s GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)"""


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("text")


def held_out(folds: int, fold: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(4, 2))
    model = language.train(docs.filter(~F.col("held_out")).select("text", "lang"))
    return language.identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out(5, 0))
    model = quality.train(docs, labels)
    return quality.quality_scores(docs.withColumn("held_out", held_out(5, 0)), model).drop("text")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP9_SQL = f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UP}', '{LOW}') AS t FROM documents) WINDOW g AS (PARTITION BY t)"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose vec_id is divisible by 7 bear the next label."""
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    return hard_negatives(rows)


def integers_sql(scale: int) -> str:
    return f"""SELECT row_number() OVER () AS row, *, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


OP11_SQL = f"""
WITH r AS (SELECT row, vec_id, x, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM ({integers_sql(256)}) WHERE label IS NOT NULL),
s AS (SELECT a.row, a.vec_id AS anchor_id, b.row AS other, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM r a JOIN r b ON a.row <> b.row WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER w::INT AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.row = p.row AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.row, p.other ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 10"""


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT doc, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(any_value(s.total), 0) AS total FROM d LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) s USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (g.total + 5 * v.v))::BIGINT AS p,
  (1 + 1000000000::HUGEINT * (k.n + 5) // (v.total + 5 * v.v))::BIGINT AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
o AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(o.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN o ON o.lang = a.lang AND o.source = a.source AND o.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER w::INT AS rank FROM r WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))
QUALIFY part = 'pair' OR row_number() OVER w <= 50"""


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP13_SQL = f"""
WITH r AS ({integers_sql(1024)})
SELECT q.vec_id AS query_id, row_number() OVER w::INT AS rank, r.vec_id, list_inner_product(q.x, r.x)::BIGINT AS score
FROM r q JOIN r ON q.row <> r.row WHERE q.vec_id % 100 = 0
WINDOW w AS (PARTITION BY q.row ORDER BY list_inner_product(q.x, r.x) DESC, r.vec_id) QUALIFY row_number() OVER w <= 10"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_url_filter, op2_line_dedup, op3_decontaminate, op4_poisson_mix, op5_near_dedup, op6_token_files, op7_suffix_dedup, op8_language_id,
                                         op9_exact_dedup, op10_quality,
                                         op11_hard_negatives, op12_source_divergence, op13_top_k)}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": op1_sql(), "op3_decontaminate": OP3_SQL, "op4_poisson_mix": OP4_SQL, "op5_near_dedup": OP5_SQL, "op7_suffix_dedup": OP7_SQL, "op9_exact_dedup": OP9_SQL,
            "op11_hard_negatives": OP11_SQL, "op12_source_divergence": OP12_SQL, "op13_top_k": OP13_SQL}
