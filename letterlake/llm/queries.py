"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterlake.llm import centroids, collocations, decontaminate, jaccard, langid, licenses, lines, mixing, passages, pii, quality, secrets, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: DuckDB: the words of a text column, A-Z lower-cased.
SQL_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@registered
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in windows of benchmark items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


SQL["op1_decontaminate"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({SQL_WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, coalesce({SQL_WORDS.format("text")}, []) AS w FROM benchmark),
p AS (SELECT item, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS k
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM p),
dw AS (SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS k
       FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lengths WHERE len(w) >= m)),
occ AS (SELECT r, i, dw.m, item FROM dw JOIN p ON dw.k = p.k AND dw.m = p.m),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS j FROM occ) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT r, item FROM occ WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""


@registered
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures of every document and the verdict of the adaptive rules."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.quality(docs, keep_text=False).select("doc_id", *quality.BASE, "base_failed", "kept")


def _sql_quality(source: str = "documents") -> str:
    """Measures, sketches and verdict of op8 over a relation, all columns of it kept."""
    words = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"
    rates = {"symbol_rate": "1000 * n_symbols // greatest(n_words, 1)", "dup_line_rate": "1000 * n_dup_lines // greatest(n_lines, 1)", "repeat_rate": "1000 * n_repeat_words // greatest(n_words, 1)", "word_length": "100 * word_chars // greatest(n_words, 1)"}
    measured = [*rates, *quality.SIZES]
    low = lambda q: f"(CASE WHEN {q} < 16 THEN {q} ELSE CAST((16 + ({q}) % 16) * pow(2, ({q}) // 16 - 1) AS BIGINT) END)"
    parts = []
    for k, keys in ((2, "lang, source,"), (1, "lang,"), (0, "")):
        group = keys.rstrip(",")
        quartiles = ", ".join([f"max({low('q1')}) FILTER (measure = '{c}') AS low_{c}" for c in measured] + [f"max({low('q3 + 1')} - 1) FILTER (measure = '{c}') AS high_{c}" for c in rates])
        bounds = []
        for c, (size, event) in quality.MEASURES.items():
            scale = f"greatest(high_{c} - low_{c}, {f'{event} // greatest(low_{size}, 1)' if size else 0})"
            bounds += [f"high_{c} + {quality.SPREAD} * {scale} AS max_{c}", f"greatest(low_{c} - {quality.SPREAD} * {scale}, 0) AS min_{c}"]
        parts.append(f"""
q{k} AS (SELECT {keys} measure, max(al) AS docs, min(bucket) FILTER (upto * 4 >= al) AS q1, min(bucket) FILTER (upto * 4 >= al * 3) AS q3
  FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys} measure) AS al
        FROM (SELECT {keys} measure, bucket, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY {keys} measure),
w{k} AS (SELECT {keys} max(docs) AS docs, {quartiles} FROM q{k}{f" GROUP BY {group}" if group else ""}),
f{k} AS (SELECT {keys} docs, {", ".join(bounds)} FROM w{k})""")
    drawn = lambda c: f"((f2.{c} * f2.docs + ((f1.{c} * f1.docs + f0.{c} * {quality.MIN_DOCS}) // (f1.docs + {quality.MIN_DOCS})) * {quality.MIN_DOCS}) // (f2.docs + {quality.MIN_DOCS}))"
    beyond = " OR ".join(f"{c} > {drawn(f'max_{c}')} OR {c} < {drawn(f'min_{c}')}" for c in rates)
    return f"""
WITH doc AS (SELECT row_number() OVER () AS r, * FROM {source}),
w AS (SELECT r, {words} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls, coalesce(text, '') AS t FROM doc),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1) GROUP BY r),
base AS (SELECT r, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep USING (r)),
m AS (SELECT doc.* EXCLUDE (r), base.*, {", ".join(f"{e} AS {c}" for c, e in rates.items())} FROM doc JOIN base USING (r)),
sketch AS (SELECT lang, source, measure, CASE WHEN v < 16 THEN v ELSE (length(bin(v)) - 5) * 16 + (v // CAST(pow(2, length(bin(v)) - 5) AS BIGINT)) END AS bucket, count(*) AS n
  FROM (SELECT lang, source, unnest([{", ".join(f"'{c}'" for c in measured)}]) AS measure, unnest([{", ".join(measured)}]) AS v FROM m) GROUP BY ALL),
{",".join(parts)}
SELECT m.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR {beyond}) AS kept
FROM m JOIN f2 ON m.lang IS NOT DISTINCT FROM f2.lang AND m.source IS NOT DISTINCT FROM f2.source
  JOIN f1 ON m.lang IS NOT DISTINCT FROM f1.lang CROSS JOIN f0
"""


SQL["op8_quality_rules"] = f"SELECT doc_id, {', '.join(quality.BASE)}, base_failed, kept FROM ({_sql_quality()})"


@registered
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of the sources takes from each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken")


def _sql_filled(name: str, rows: str, keys: str) -> str:
    """``rows`` has lim, weight, total: adds words, as mixing.filled()."""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""
{name}_a AS (SELECT *, lim / weight AS ratio, sum(weight) OVER ({part}) - coalesce(sum(weight) OVER ({part} ORDER BY lim / weight, lim, weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  coalesce(sum(lim) OVER ({part} ORDER BY lim / weight, lim, weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM {rows}),
{name}_b AS (SELECT *, (total - CAST(used AS DOUBLE)) / rest AS level FROM {name}_a),
{name}_c AS (SELECT *, min(CASE WHEN CAST(lim AS DOUBLE) >= level * weight THEN struct_pack(a := ratio, b := level) END) OVER ({part}) AS lv FROM {name}_b),
{name} AS (SELECT * EXCLUDE (ratio, rest, used, level, lv), CASE WHEN lv IS NULL OR lim < lv.b * weight THEN CAST(lim AS DOUBLE) ELSE lv.b * weight END AS words FROM {name}_c)"""


def _sql_mix(source: str = "documents") -> str:
    return f"""
WITH doc AS (SELECT *, CAST(len(coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), [])) AS BIGINT) AS size,
  md5(concat_ws('|', '{mixing.SEED}', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) AS k FROM {source}),
cls AS (SELECT source, CAST(length(bin(size)) - 1 AS BIGINT) AS class, CAST(sum(size) AS BIGINT) AS class_size FROM doc GROUP BY ALL),
src AS (SELECT source, CAST(sum(class_size) AS BIGINT) AS source_size FROM cls GROUP BY source),
s1 AS (SELECT source, source_size, source_size * {mixing.MOST} AS lim, [{', '.join(map(str, mixing.WEIGHTS))}][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(mixing.WEIGHTS)}] AS weight,
  CAST(sum(source_size) OVER () AS DOUBLE) * {mixing.SHARE} AS total FROM src),
s2 AS (SELECT * FROM s1 WHERE source_size > 0), {_sql_filled('s3', 's2', '')},
tgt AS (SELECT source, source_size, words AS target FROM s3 UNION ALL SELECT source, source_size, 0.0 FROM s1 WHERE source_size = 0),
c1 AS (SELECT cls.*, source_size, target, target AS total, class_size * {mixing.MOST} AS lim, class_size * (class + 8) AS weight FROM cls JOIN tgt ON cls.source IS NOT DISTINCT FROM tgt.source),
c2 AS (SELECT * FROM c1 WHERE class_size > 0), {_sql_filled('c3', 'c2', 'source')},
c4 AS (SELECT source, class, class_size, source_size, target, words / class_size AS expected FROM c3 UNION ALL SELECT source, class, class_size, source_size, target, 0.0 FROM c1 WHERE class_size = 0),
plan AS (SELECT *, expected - floor(expected) AS p, CAST(floor(expected) AS BIGINT) AS certain FROM c4),
goal AS (SELECT source, least(max(target) - sum(class_size * certain), CAST(coalesce(sum(class_size) FILTER (p > 0), 0) AS DOUBLE)) AS goal FROM plan GROUP BY source),
r0 AS (SELECT doc.*, class, source_size, target, certain, p, goal, (CAST('0x' || substr(k, 1, 12) AS BIGINT) + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM doc JOIN plan ON doc.source IS NOT DISTINCT FROM plan.source AND length(bin(size)) - 1 = class JOIN goal ON doc.source IS NOT DISTINCT FROM goal.source),
r AS (SELECT *, CASE WHEN p > 0 AND size > 0 AND goal > 0 THEN u / (1 - u) * (1 - p) / p END AS q FROM r0),
al AS (SELECT source, k, q, size, goal, sum(size) AS words FROM r WHERE q IS NOT NULL GROUP BY ALL),
o AS (SELECT *, goal - coalesce(sum(words) OVER (PARTITION BY source ORDER BY q, k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= words / 2 AS inside FROM al)
SELECT r.* EXCLUDE (k, class, certain, p, goal, u, q), certain + CAST(coalesce(inside, false) AS BIGINT) AS copies, CAST(r.size * (certain + CAST(coalesce(inside, false) AS BIGINT)) AS BIGINT) AS taken
FROM r LEFT JOIN o ON r.source IS NOT DISTINCT FROM o.source AND r.k = o.k AND r.size = o.size
"""


SQL["op5_mix_sources"] = f"SELECT doc_id, size, source_size, target, taken FROM ({_sql_mix()})"


@registered
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filtered(pages).select("page_id", "host", "path", "rule", "verdict")


_FITS = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{k}}}'" for k, (_, h, p) in sorted(enumerate(urls.RULES), key=lambda x: -len(x[1][1] + x[1][2])))
_LISTED = r"(^|[.-])(" + "|".join(urls.LISTED_WORDS) + r")([.-]|$)"

SQL["op2_url_filters"] = f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
s AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest[length(raw) + 1:], '^[^?#]*') AS path FROM h),
listed AS (SELECT DISTINCT host FROM s WHERE regexp_matches(host, '{_LISTED}')),
bad AS (SELECT DISTINCT s.host FROM s JOIN listed l ON s.host = l.host OR ends_with(s.host, '.' || l.host))
SELECT page_id, host, path, CASE {_FITS.format(*(h + p for _, h, p in urls.RULES))} END AS rule,
  CASE {_FITS.format(*(v for v, _, _ in urls.RULES))} WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END AS verdict
FROM s
"""


@registered
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scanned(docs)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


@registered
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of known forms and random tokens in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.scanned(docs, keep_text=False))


@registered
def op7_sanitise_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, and the words that would give it away."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.sanitised(docs, keep_text=False))


@registered
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.near_classes(docs, keep_text=False).select("doc_id", "class_id", "n_links")


def _sql_jaccard(source: str = "documents") -> str:
    """r (row number over the source), class_id and n_links."""
    return f"""
jd AS (SELECT row_number() OVER () AS r, * FROM {source}),
jw AS (SELECT r, doc_id, coalesce({SQL_WORDS.format("text")}, []) AS w FROM jd),
js AS (SELECT DISTINCT r, doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM jw WHERE len(w) > 0)),
jk AS (SELECT r, doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM js GROUP BY r, doc_id),
jc AS (SELECT k, any_value(n) AS n, count(*) AS copies, min(doc_id) AS rep, min(r) AS r FROM jk GROUP BY k),
jg AS (SELECT jc.k, jc.n, js.g FROM jc JOIN js ON jc.r = js.r),
jp AS (SELECT a.k AS a, b.k AS b FROM jg a JOIN jg b ON a.g = b.g AND a.k <> b.k GROUP BY a.k, b.k, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
jr AS (SELECT k AS node, k AS reach FROM jc UNION SELECT jr.node, jp.b FROM jr JOIN jp ON jr.reach = jp.a),
jx AS (SELECT node AS k, min(rep) AS class_id FROM jr JOIN jc ON jr.reach = jc.k GROUP BY node),
jl AS (SELECT a AS k, sum(copies) AS links FROM jp JOIN jc ON jp.b = jc.k GROUP BY a),
jaccard AS (SELECT jd.r, coalesce(class_id, jd.doc_id) AS class_id, CAST(coalesce(copies - 1 + coalesce(links, 0), 0) AS BIGINT) AS n_links
  FROM jd LEFT JOIN jk USING (r) LEFT JOIN jc ON jk.k = jc.k LEFT JOIN jx ON jk.k = jx.k LEFT JOIN jl ON jk.k = jl.k)"""


SQL["op6_ngram_jaccard"] = f"WITH RECURSIVE {_sql_jaccard()} SELECT jd.doc_id, class_id, n_links FROM jaccard JOIN jd USING (r)"


@registered
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that each document loses to equal or nearly equal lines that stand before."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = lines.deduplicated(docs, short=True)
    return found.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@registered
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    model = langid.learned(docs.where(~langid.is_held_out(F.col("doc_id"))).select("text", "lang"))
    found = langid.predicted(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(langid.is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


@registered
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


SQL["op11_collocations"] = r"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM piece),
g AS (SELECT lang, m, w[i:i + m - 1] AS g, count(*) AS f FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m) GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM g WHERE m > 1 AND f >= 100),
inner_ AS (SELECT DISTINCT s.lang, s.g FROM c s JOIN (SELECT lang, f, g AS longer, m AS size, unnest(range(2, m)) AS k FROM c) b
  ON s.lang = b.lang AND s.m = b.k AND 100 * b.f >= 100 * s.f AND len(list_filter(range(1, b.size - b.k + 2), lambda j: b.longer[j:j + b.k - 1] = s.g)) > 0),
cut AS (SELECT c.lang, c.g, c.f AS a, k, p.f AS l, q.f AS r, CAST(1000 AS HUGEINT) * c.f * n // (CAST(p.f AS HUGEINT) * q.f) AS score, n
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c JOIN total USING (lang)
  JOIN g p ON p.lang = c.lang AND p.g = c.g[1:c.k] JOIN g q ON q.lang = c.lang AND q.g = c.g[c.k + 1:]),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
kept AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM best ANTI JOIN inner_ USING (lang, g))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000
"""


@registered
def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertia of every embedding."""
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def _sql_clusters(k: int = centroids.CLUSTERS, rounds: int = centroids.ROUNDS, width: int = centroids.COMPONENTS) -> str:
    parts = []
    for n in range(rounds + 1):
        parts.append(f"""
a{n} AS MATERIALIZED (SELECT r, c, d FROM (SELECT x.r, c, CAST(list_sum(list_transform(list_zip(x.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM x, m{n} m)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if n < rounds:
            parts.append(f"""
s{n} AS (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT c, v, unnest(range(1, {width + 1})) AS i FROM a{n} JOIN x USING (r)) GROUP BY c, i),
m{n + 1} AS MATERIALIZED (SELECT c, coalesce(n.v, m.v) AS v FROM m{n} m LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{n} GROUP BY c) n USING (c))""")
    return f"""
WITH x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor({centroids.SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0),
m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v FROM x QUALIFY c < {k}),
{",".join(parts)},
t AS (SELECT c, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, cluster_inertia, CAST((SELECT sum(d) FROM a{rounds}) AS BIGINT) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN x USING (r) JOIN t USING (c) JOIN m{rounds} m USING (c)
"""


SQL["op12_centroid_clusters"] = _sql_clusters()


@registered
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document keeps of its words when passages of smaller documents go."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = passages.deduplicated(docs, keep_text=False)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op13_substring_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
home AS (SELECT k, min(doc_id) AS home FROM win GROUP BY k),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS j FROM win JOIN home USING (k) WHERE doc_id > home),
word AS (SELECT r, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS t FROM word ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
