"""The registered queries over the archive operators, and the same questions in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterlake.functions import text
from letterlake.operators import attribution, backup, check, places, reconcile, search, store
from letterlake.plans import adapters, projection

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


# --- orders as mail ---------------------------------------------------------------------------

MAIL = """
message AS (SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS store_id, '<' || o_custkey || '@mail>' AS email_id,
  CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS date, o_orderpriority AS subject FROM orders),
sender AS (SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS store_id, lower(c_name) AS address FROM orders JOIN customer ON o_custkey = c_custkey),
recipient AS (SELECT DISTINCT sha256(CAST(l_orderkey AS VARCHAR)) AS store_id, 's' || l_suppkey || '@supply' AS address FROM lineitem),
location AS (SELECT DISTINCT sha256(CAST(l_orderkey AS VARCHAR)) AS store_id, CASE WHEN l_returnflag <> 'N' THEN c_mktsegment END AS mailbox, l_linestatus AS folder
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _has(column: str, value: str) -> str:
    return f"contains({FOLD.format(column)}, '{value.lower()}')"


def _search_sql(where: str, limit: str = "") -> str:
    return f"""WITH {MAIL},
lab AS (SELECT store_id, string_agg(place, '|' ORDER BY place) AS places FROM (SELECT store_id, nullif(concat_ws('::', mailbox, folder), '') AS place FROM location) GROUP BY store_id)
SELECT m.store_id, date, (SELECT min(address) FROM sender s WHERE s.store_id = m.store_id) AS sender, subject, coalesce(places, '') AS places
FROM message m LEFT JOIN lab ON m.store_id = lab.store_id WHERE {where} ORDER BY date ASC NULLS LAST, m.store_id {limit}"""


def _searched(**given) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits = search.search(adapters.order_mail(spark, sf_dir), **given)
        return hits.withColumn("places", F.array_join("places", "|"))

    return run


def _percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects with signs that other languages read as wildcards: they stand for themselves."""
    frames = adapters.order_mail(spark, sf_dir)
    frames["message"] = frames["message"].withColumn("subject", F.replace("subject", F.lit("-"), F.lit("%")))
    return search.search(frames, subject="%u").withColumn("places", F.array_join("places", "|"))


_exists = lambda side, column, value: f"EXISTS (SELECT 1 FROM {side} x WHERE x.store_id = m.store_id AND {_has('x.' + column, value)})"

query("search_all", _searched(), _search_sql("true"))
query("search_sender", _searched(sender="CUSTOMER#00000001"), _search_sql(_exists("sender", "address", "CUSTOMER#00000001")))
query("search_recipient", _searched(recipient="S7@"), _search_sql(_exists("recipient", "address", "S7@")))
query("search_subject", _searched(subject="urgent"), _search_sql(_has("subject", "urgent")))
query("search_mailbox", _searched(mailbox="build"), _search_sql(_exists("location", "mailbox", "build")))
query("search_folder", _searched(folder="f"), _search_sql(_exists("location", "folder", "f")))
query("search_days", _searched(since="1995", until="1995-06-30"), _search_sql("substr(date, 1, 10) >= '1995' AND substr(date, 1, 10) <= '1995-06-30'"))
query("search_limit", _searched(subject="-", limit=25), _search_sql(_has("subject", "-"), "LIMIT 25"))
query("search_wildcards", lambda s, d: _percent(s, d), _search_sql(_has("replace(subject, '-', '%')", "%u")).replace("AS sender, subject,", "AS sender, replace(subject, '-', '%') AS subject,"))
query(
    "search_combined",
    _searched(recipient="s1", mailbox="a", folder="o", since="1996-01-01"),
    _search_sql(f"{_exists('recipient', 'address', 's1')} AND {_exists('location', 'mailbox', 'a')} AND {_exists('location', 'folder', 'o')} AND substr(date, 1, 10) >= '1996-01-01'"),
)
query("search_preview", lambda s, d: search.preview(search.search(adapters.order_mail(s, d), subject="high")).drop("places"),
      f"WITH {MAIL} SELECT substr(m.store_id, 1, 12) AS store_id, date, (SELECT min(address) FROM sender s WHERE s.store_id = m.store_id) AS sender, subject FROM message m WHERE {_has('subject', 'high')}")
query("v_messages", lambda s, d: projection.v_messages(adapters.order_mail(s, d)), f"""WITH {MAIL}
SELECT m.store_id, email_id, date, subject, s.address AS sender, r.address AS recipient, mailbox, folder FROM message m
LEFT JOIN sender s ON m.store_id = s.store_id LEFT JOIN recipient r ON m.store_id = r.store_id LEFT JOIN location l ON m.store_id = l.store_id""")
query("v_duplicates", lambda s, d: projection.v_duplicates(adapters.order_mail(s, d)["message"]), f"""WITH {MAIL}
SELECT DISTINCT a.* FROM message a JOIN message b ON a.email_id = b.email_id AND a.date = b.date AND a.store_id <> b.store_id""")
query("place_counts", lambda s, d: adapters.order_mail(s, d)["location"].groupBy(text.place_label(F.col("mailbox"), F.col("folder")).alias("place")).agg(F.count(F.lit(1)).alias("n")),
      f"""WITH {MAIL} SELECT CASE WHEN mailbox IS NULL AND folder IS NULL THEN '?' ELSE concat_ws('::', mailbox, folder) END AS place, count(*) AS n FROM location GROUP BY 1""")

# --- documents as a store, labelled ones as its log -----------------------------------------

STORE = """
stored AS (SELECT DISTINCT sha256(text) AS store_id, CAST(strlen(text) AS BIGINT) AS stored_bytes FROM documents WHERE text IS NOT NULL),
observation AS (SELECT sha256(coalesce(source, '') || '|' || coalesce(lang, '') || '|' || d.doc_id % 5) AS log_hash, source AS mailbox, lang AS folder,
  '2026-0' || (d.doc_id % 5 + 1) || '-01T00:00:00+00:00' AS log_date, CASE WHEN toxic = 1 THEN sha256('gone' || text) ELSE sha256(text) END AS store_id, d.doc_id AS line_no
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE text IS NOT NULL),
log_file AS (SELECT log_hash AS hash, mailbox, folder, log_date AS date, lag(log_hash) OVER (PARTITION BY mailbox, folder ORDER BY log_date) AS prev
  FROM (SELECT DISTINCT log_hash, mailbox, folder, log_date FROM observation)),
heads AS (SELECT mailbox, folder, arg_max(hash, date) AS log FROM log_file GROUP BY mailbox, folder)"""


def _log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's files, each linked to the one before it at its place."""
    from pyspark.sql import Window as W

    own = adapters.document_log(spark, sf_dir).select(F.col("log_hash").alias("hash"), "mailbox", "folder", F.col("log_date").alias("date")).distinct()
    prev = F.lag("hash").over(W.partitionBy("mailbox", "folder").orderBy("date"))
    return own.withColumn("prev", prev).select("*", F.lit(True).alias("readable"), F.lit(True).alias("intact"))


def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's files with the number of entries that they say they have, some of them wrong."""
    n = adapters.document_log(spark, sf_dir).groupBy(F.col("log_hash").alias("hash")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("hash", (F.col("n") + F.when(F.col("hash") < "4", 2).when(F.col("hash") >= "c", -1).otherwise(0)).alias("declared"), F.lit(True).alias("readable"))


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log_files(spark, sf_dir).groupBy("mailbox", "folder").agg(F.max_by("hash", "date").alias("log"))


_st, _ob = adapters.document_store, adapters.document_log

query("places_summary", lambda s, d: places.summary(_ob(s, d)), f"WITH {STORE} SELECT mailbox, folder, count(DISTINCT store_id) AS messages, max(log_date) AS last_seen FROM observation GROUP BY ALL")
query("places_totals", lambda s, d: places.totals(_ob(s, d)), f"WITH {STORE} SELECT count(DISTINCT store_id) AS messages, count(*) AS observations, count(DISTINCT (mailbox, folder)) AS places FROM observation")
query("log_compacted", lambda s, d: places.log_files(places.compacted(_ob(s, d)), algorithm="sha256").select("mailbox", "folder", "messages", "hash"), f"""WITH {STORE},
one AS (SELECT mailbox, folder, max(log_date) AS date, count(DISTINCT store_id) AS messages, string_agg(DISTINCT '{{"store_id": "' || store_id || '"}}' || chr(10), '' ORDER BY '{{"store_id": "' || store_id || '"}}' || chr(10)) AS lines FROM observation GROUP BY mailbox, folder)
SELECT mailbox, folder, messages, sha256('{{"version": 2, "mailbox": ' || coalesce('"' || mailbox || '"', 'null') || ', "folder": ' || coalesce('"' || folder || '"', 'null') || ', "date": ' || coalesce('"' || date || '"', 'null')
  || ', "messages": ' || messages || ', "prev": null}}' || chr(10) || lines) AS hash FROM one""")
query("short_logs", lambda s, d: check.short_logs(_declared(s, d), _ob(s, d)), f"""WITH {STORE}
SELECT hash, entries + CASE WHEN hash < '4' THEN 2 ELSE -1 END AS declared, entries FROM (SELECT log_hash AS hash, count(*) AS entries FROM observation GROUP BY 1) WHERE hash < '4' OR hash >= 'c'""")
query("log_compaction_counts", lambda s, d: places.compaction_counts(_ob(s, d)),
      f"WITH {STORE} SELECT count(DISTINCT log_hash) AS files_before, count(*) AS entries_before, count(DISTINCT (mailbox, folder)) AS files_after, count(DISTINCT (mailbox, folder, store_id)) AS entries_after FROM observation")
query("missing_messages", lambda s, d: check.missing(_ob(s, d), _st(s, d)), f"""WITH {STORE}
SELECT store_id, mailbox, folder FROM observation WHERE store_id NOT IN (SELECT store_id FROM stored)
QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY log_hash, line_no) = 1""")
query("orphan_messages", lambda s, d: check.orphans(_st(s, d), _ob(s, d)), f"WITH {STORE} SELECT store_id FROM stored EXCEPT SELECT store_id FROM observation")
query("damaged_messages", lambda s, d: check.damaged(_st(s, d).withColumn("store_id", F.when(F.startswith("store_id", F.lit("0")), F.reverse("store_id")).otherwise(F.col("store_id"))), 256),
      f"WITH {STORE} SELECT reverse(store_id) AS store_id, substr(store_id, 1, 2) || '/' || store_id || '.eml' AS path FROM stored WHERE store_id[1] = '0' AND reverse(store_id) <> store_id")
query("adoption", lambda s, d: places.adopted(_st(s, d), _ob(s, d), "found"), f"WITH {STORE} SELECT CAST(NULL AS VARCHAR) AS mailbox, 'found' AS folder, store_id FROM (SELECT store_id FROM stored EXCEPT SELECT store_id FROM observation)")
query("adoption_counts", lambda s, d: places.adoption_counts(_st(s, d), _ob(s, d), "found"), f"WITH {STORE} SELECT (SELECT count(*) FROM (SELECT store_id FROM stored EXCEPT SELECT store_id FROM observation)) AS found, (SELECT count(DISTINCT store_id) FROM observation WHERE mailbox IS NULL AND folder = 'found') AS held")
query("replay_counts", lambda s, d: projection.replay_counts(_st(s, d), _ob(s, d)), f"""WITH {STORE}
SELECT count(*) AS entries, count(*) FILTER (s.store_id IS NULL) AS unknown, count(DISTINCT s.store_id) AS messages FROM observation o LEFT JOIN stored s ON o.store_id = s.store_id WHERE mailbox IS NOT NULL OR folder IS NOT NULL""")
query("projected_locations", lambda s, d: projection.placed(_ob(s, d)).join(_st(s, d).select("store_id"), "store_id", "left_semi").select("store_id", "mailbox", "folder").distinct(),
      f"WITH {STORE} SELECT DISTINCT store_id, mailbox, folder FROM observation SEMI JOIN stored USING (store_id) WHERE mailbox IS NOT NULL OR folder IS NOT NULL")
query("unapplied_logs", lambda s, d: projection.unapplied(_log_files(s, d), _log_files(s, d).where("date < '2026-04'")).select("hash", "mailbox", "folder", "date"),
      f"WITH {STORE} SELECT hash, mailbox, folder, date FROM log_file WHERE hash NOT IN (SELECT hash FROM log_file WHERE date < '2026-04')")
query("freshness", lambda s, d: projection.behind(_heads(s, d), _heads(s, d).where("folder <> 'de'").withColumn("log", F.when(F.col("mailbox") < "src2", F.col("log")))),
      f"""WITH {STORE}, r AS (SELECT mailbox, folder, CASE WHEN mailbox < 'src2' THEN log END AS log FROM heads WHERE folder <> 'de')
SELECT h.mailbox, h.folder, h.log, r.log AS recorded FROM heads h LEFT JOIN (SELECT *, 1 AS known FROM r) r ON h.mailbox IS NOT DISTINCT FROM r.mailbox AND h.folder IS NOT DISTINCT FROM r.folder
WHERE known IS NULL OR h.log IS DISTINCT FROM r.log""")  # fmt: skip
query("check_counters", lambda s, d: check.counters(_st(s, d), _ob(s, d), _log_files(s, d)), f"""WITH {STORE}
SELECT (SELECT count(*) FROM stored) AS entries, (SELECT count(*) FROM observation) AS observations, (SELECT count(DISTINCT store_id) FROM observation) AS referenced,
  (SELECT count(*) FROM (SELECT DISTINCT mailbox, folder FROM observation)) AS places, (SELECT count(*) FROM log_file) AS log_files, CAST(0 AS BIGINT) AS unreadable_logs, CAST(0 AS BIGINT) AS damaged_logs""")
_lost = "(SELECT hash FROM log_file WHERE hash LIKE 'a%')"
query("broken_chains", lambda s, d: check.broken_chains(_heads(s, d), _log_files(s, d).where("NOT startswith(hash, 'a')")), f"""WITH RECURSIVE {STORE},
kept AS (SELECT * FROM log_file WHERE hash NOT LIKE 'a%'),
walk AS (SELECT log AS hash, mailbox, folder FROM heads UNION SELECT k.prev, w.mailbox, w.folder FROM walk w JOIN kept k ON w.hash = k.hash WHERE k.prev IS NOT NULL)
SELECT hash, min(mailbox) AS mailbox, min(folder) AS folder FROM walk WHERE hash NOT IN (SELECT hash FROM kept) GROUP BY hash""")
query("unchained_logs", lambda s, d: check.unchained(_heads(s, d).where("folder <> 'de'"), _log_files(s, d).where("NOT startswith(hash, 'a')")), f"""WITH RECURSIVE {STORE},
kept AS (SELECT * FROM log_file WHERE hash NOT LIKE 'a%'),
walk AS (SELECT log AS hash FROM heads WHERE folder <> 'de' UNION SELECT k.prev FROM walk w JOIN kept k ON w.hash = k.hash WHERE k.prev IS NOT NULL)
SELECT hash FROM kept WHERE hash NOT IN (SELECT hash FROM walk)""")
query("check_verdict", lambda s, d: check.verdict(_damaged_store(s, d), _ob(s, d), _log_files(s, d).where("NOT startswith(hash, 'a')"), _heads(s, d).where("folder <> 'de'"), 256).select("entries", "referenced", "missing", "orphans", "damaged", "broken_chains", "unchained", "findings", "sound"), f"""WITH RECURSIVE {STORE},
kept AS (SELECT * FROM log_file WHERE hash NOT LIKE 'a%'),
there AS (SELECT CASE WHEN store_id[1] = '0' THEN reverse(store_id) ELSE store_id END AS store_id, store_id[1] = '0' AND reverse(store_id) <> store_id AS bad FROM stored),
walk AS (SELECT log AS hash FROM heads WHERE folder <> 'de' UNION SELECT k.prev FROM walk w JOIN kept k ON w.hash = k.hash WHERE k.prev IS NOT NULL),
x AS (SELECT (SELECT count(*) FROM there) AS entries, (SELECT count(DISTINCT store_id) FROM observation) AS referenced,
  (SELECT count(*) FROM (SELECT store_id FROM observation EXCEPT SELECT store_id FROM there)) AS missing, (SELECT count(*) FROM (SELECT store_id FROM there EXCEPT SELECT store_id FROM observation)) AS orphans,
  (SELECT count(*) FROM there WHERE bad) AS damaged, (SELECT count(*) FROM (SELECT hash FROM walk EXCEPT SELECT hash FROM kept)) AS broken_chains, (SELECT count(*) FROM (SELECT hash FROM kept EXCEPT SELECT hash FROM walk)) AS unchained)
SELECT *, missing + damaged + broken_chains AS findings, missing + damaged + broken_chains = 0 AS sound FROM x""")
query("store_statistics", lambda s, d: store.statistics(_st(s, d)), f"WITH {STORE} SELECT count(*) AS messages, CAST(sum(stored_bytes) AS BIGINT) AS stored_bytes FROM stored")
_incoming = lambda s, d: adapters.table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("store_id"))
_part = lambda s, d: _st(s, d).where("store_id < '8'")
query("add_outcomes", lambda s, d: store.outcomes(_incoming(s, d), _part(s, d)), f"WITH {STORE} SELECT doc_id, sha256(text) AS store_id, CASE WHEN sha256(text) < '8' THEN 'EXISTS' ELSE 'NEW' END AS status FROM documents")
query("added_messages", lambda s, d: store.added(_incoming(s, d), _part(s, d)).select("store_id"), f"WITH {STORE} SELECT store_id FROM stored WHERE store_id >= '8'")
query("import_counts", lambda s, d: store.import_counts(_incoming(s, d), _part(s, d)), """
SELECT count(DISTINCT sha256(text)) FILTER (sha256(text) >= '8') AS stored, count(text) - count(DISTINCT sha256(text)) FILTER (sha256(text) >= '8') AS present, count(*) FILTER (text IS NULL) AS failed FROM documents""")
query("largest_per_directory", lambda s, d: _largest(s, d), f"""WITH {STORE}
SELECT directory, path, stored_bytes FROM (SELECT substr(store_id, 1, 2) AS directory, substr(store_id, 1, 2) || '/' || store_id || '.eml' AS path, stored_bytes FROM stored)
QUALIFY row_number() OVER (PARTITION BY directory ORDER BY stored_bytes DESC, path) = 1""")
query("deletable", lambda s, d: store.deletable(_ob(s, d).select("line_no", "mailbox", "folder", "store_id"), _st(s, d), _ob(s, d).where("log_date < '2026-04'")), f"""WITH {STORE}
SELECT line_no, o.mailbox, o.folder, o.store_id, o.store_id IN (SELECT store_id FROM stored) AND EXISTS (SELECT 1 FROM observation r WHERE r.log_date < '2026-04' AND r.store_id = o.store_id
  AND r.mailbox IS NOT DISTINCT FROM o.mailbox AND r.folder IS NOT DISTINCT FROM o.folder) AS deletable FROM observation o""")


def _damaged_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store with some entries under a name that is not their content's hash."""
    return _st(spark, sf_dir).withColumn("store_id", F.when(F.startswith("store_id", F.lit("0")), F.reverse("store_id")).otherwise(F.col("store_id")))


def _largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from letterlake.sources.archive import largest_per_directory

    return largest_per_directory(_st(spark, sf_dir).select("path", "stored_bytes"))


query("entry_names", lambda s, d: _st(s, d).select(text.entry_hash(F.concat(F.upper("store_id"), F.when(F.col("stored_bytes") % 3 == 0, ".eml.zst").when(F.col("stored_bytes") % 3 == 1, ".eml").otherwise(".tmp"))).alias("hash")).groupBy(F.col("hash").isNull().alias("foreign")).agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("first")),
      f"WITH {STORE} SELECT stored_bytes % 3 = 2 AS \"foreign\", count(*) AS n, CASE WHEN stored_bytes % 3 <> 2 THEN min(store_id) END AS first FROM stored GROUP BY stored_bytes % 3 = 2, CASE WHEN stored_bytes % 3 <> 2 THEN 1 END".replace("CASE WHEN stored_bytes % 3 <> 2 THEN min(store_id) END", "min(CASE WHEN stored_bytes % 3 <> 2 THEN store_id END)").replace(", CASE WHEN stored_bytes % 3 <> 2 THEN 1 END", ""))

# --- events as a server's listing -------------------------------------------------------------

LISTING = """
listing AS (SELECT event_type AS mailbox, CAST(user_id % 20 AS VARCHAR) AS folder, event_id AS ord, CASE WHEN value < 5 THEN '' ELSE CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) END AS mid FROM events),
archived AS (SELECT mailbox, folder, mid, count(*) AS n FROM listing WHERE ord % 3 <> 0 AND mid <> '' GROUP BY ALL),
claimed AS (SELECT l.*, CASE WHEN mid = '' OR n IS NULL THEN 'ABSENT' WHEN row_number() OVER (PARTITION BY mailbox, folder, mid ORDER BY ord) <= n THEN 'TAKEN' ELSE 'EXHAUSTED' END AS claim
  FROM listing l LEFT JOIN archived a USING (mailbox, folder, mid))"""
_li, _ar = adapters.event_listing, adapters.event_archive
query("reconcile_claims", lambda s, d: reconcile.claims(_li(s, d), _ar(s, d)), f"WITH {LISTING} SELECT mailbox, folder, ord, mid, claim FROM claimed")
query("reconcile_verdicts", lambda s, d: reconcile.verdicts(reconcile.claims(_li(s, d), _ar(s, d))), f"WITH {LISTING} SELECT mailbox, folder, count(*) AS listed, count(*) FILTER (claim = 'ABSENT') AS missing, count(*) FILTER (claim = 'EXHAUSTED') AS extra_copies FROM claimed GROUP BY ALL")
query("archived_counts", lambda s, d: reconcile.archived_counts(_ob(s, d), _st(s, d).select("store_id", F.substring("store_id", 1, 2).alias("mid"))), f"""WITH {STORE}
SELECT mailbox, folder, substr(store_id, 1, 2) AS mid, count(*) AS n FROM (SELECT DISTINCT mailbox, folder, store_id FROM observation WHERE mailbox IS NOT NULL) SEMI JOIN stored USING (store_id) GROUP BY ALL""")
query("uid_watermarks", lambda s, d: _li(s, d).groupBy("mailbox", "folder").agg(F.max("ord").alias("uid")), f"WITH {LISTING} SELECT mailbox, folder, max(ord) AS uid FROM listing GROUP BY ALL")
query("incremental_scan", lambda s, d: _li(s, d).join(_li(s, d).where("ord % 7 = 0").groupBy("mailbox", "folder").agg(F.max("ord").alias("uid")), ["mailbox", "folder"], "left").where("uid IS NULL OR ord > uid").drop("uid"), f"""WITH {LISTING},
w AS (SELECT mailbox, folder, max(ord) AS uid FROM listing WHERE ord % 7 = 0 GROUP BY ALL) SELECT l.* FROM listing l LEFT JOIN w USING (mailbox, folder) WHERE uid IS NULL OR ord > uid""")
SCAN = f"""{LISTING},
point AS (SELECT mailbox, folder, max(ord) AS uid FROM listing WHERE ord % 7 = 0 AND folder <> '3' GROUP BY ALL),
scan AS (SELECT c.*, 1 + length(mailbox) % 2 AS validity, CASE WHEN uid IS NULL THEN 'FIRST' WHEN length(mailbox) % 2 = 1 THEN 'LOST' WHEN ord > uid THEN 'ABOVE' ELSE 'BELOW' END AS scan
  FROM claimed c LEFT JOIN point USING (mailbox, folder)),
wanted AS (SELECT * FROM scan WHERE scan IN ('FIRST', 'ABOVE') OR scan = 'LOST' AND claim <> 'TAKEN')"""
_scan = lambda s, d: backup.scanned(*adapters.event_scan(s, d))
query("backup_scan", _scan, f"WITH {SCAN} SELECT mailbox, folder, ord, mid, CAST(validity AS BIGINT) AS validity, scan FROM scan")
query("backup_wanted", lambda s, d: backup.wanted(_scan(s, d), _ar(s, d)).select("mailbox", "folder", "ord", "mid", "scan"), f"WITH {SCAN} SELECT mailbox, folder, ord, mid, scan FROM wanted")
query("backup_points", lambda s, d: backup.advanced(_scan(s, d), backup.wanted(_scan(s, d), _ar(s, d)).withColumn("store_id", F.when(F.col("ord") % 50 != 0, F.sha2("mid", 256)))), f"""WITH {SCAN}
SELECT mailbox, folder, '{{"kind":"imap-uid","uidvalidity":' || max(validity) || ',"uid":' || max(ord) || '}}' AS resume FROM scan GROUP BY mailbox, folder
HAVING (mailbox, folder) NOT IN (SELECT (mailbox, folder) FROM wanted WHERE ord % 50 = 0)""")
query("unknown_jobs", lambda s, d: reconcile.guard(adapters.table(s, d, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("name")), _heads(s, d), _ob(s, d)), f"WITH {STORE} SELECT 'src' || n_nationkey AS name FROM nation WHERE 'src' || n_nationkey NOT IN (SELECT mailbox FROM heads WHERE mailbox IS NOT NULL)")

# --- lineitem as an old archive: orders' segments and flags apart ------------------------------

LEGACY = """
l_mail AS (SELECT DISTINCT l_orderkey AS message_id, 'mb' || l_suppkey % 6 AS mailbox FROM lineitem),
l_fold AS (SELECT DISTINCT l_orderkey AS message_id, 'f' || l_suppkey % 6 || CASE WHEN l_linenumber = 2 THEN 'x' ELSE '' END AS folder FROM lineitem),
l_snap AS (SELECT 'f0' AS folder, 'mb0' AS mailbox),
single AS (SELECT message_id, min(mailbox) AS mailbox FROM l_mail GROUP BY message_id HAVING count(*) = 1)"""


def _legacy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mailboxes and folders of every order's items, as ``LEGACY`` has them."""
    items = adapters.table(spark, sf_dir, "lineitem")
    sixth = (F.col("l_suppkey") % 6).cast("string")
    mailbox = items.select(F.col("l_orderkey").alias("message_id"), F.concat(F.lit("mb"), sixth).alias("mailbox")).distinct()
    folder = items.select(F.col("l_orderkey").alias("message_id"), F.concat(F.lit("f"), sixth, F.when(F.col("l_linenumber") == 2, "x").otherwise("")).alias("folder")).distinct()
    return mailbox, folder, spark.createDataFrame([("f0", "mb0")], "folder string, mailbox string")


query("folder_witnesses", lambda s, d: attribution.witnesses(*_legacy(s, d)), f"WITH {LEGACY} SELECT folder, mailbox FROM l_fold JOIN single USING (message_id) UNION SELECT folder, mailbox FROM l_snap")
query("witnessed_places", lambda s, d: attribution.attributed(_legacy(s, d)[0].select("message_id", F.col("message_id").cast("string").alias("store_id")).distinct(), *_legacy(s, d)[:2], attribution.witnesses(*_legacy(s, d))), f"""WITH {LEGACY},
own AS (SELECT folder, mailbox FROM l_fold JOIN single USING (message_id) UNION SELECT folder, mailbox FROM l_snap),
sure AS (SELECT message_id, folder, min(mailbox) AS mailbox FROM l_fold JOIN own USING (folder) JOIN l_mail USING (message_id, mailbox) GROUP BY message_id, folder HAVING count(*) = 1)
SELECT CAST(m.message_id AS VARCHAR) AS store_id, m.mailbox, folder FROM l_mail m LEFT JOIN sure USING (message_id, mailbox)""")

# --- conversations as raw messages --------------------------------------------------------------


def _threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    from letterlake.functions.mail import with_headers

    c = adapters.table(spark, sf_dir, "conversations")
    turn = F.col("turn").cast("string")
    raw = F.concat(F.lit("From: "), F.coalesce("role", F.lit("nobody")), F.lit("@Example.COM\r\nTo: List: all@example.org;\r\nMessage-ID: <"), F.col("conv_id").cast("string"), F.lit("."), turn, F.lit("@t>\r\nDate: Wed, 20 Feb 2026 12:00:0"), F.substring(turn, -1, 1), F.lit(" +0100\r\nSubject: turn "), turn, F.lit("\r\n\r\n"), F.coalesce("text", F.lit("")))
    df = with_headers(c.select("conv_id", "turn", F.encode(raw, "UTF-8").alias("content")))
    return df.select("conv_id", "turn", "email_id", "date", "subject", F.array_join("senders", ",").alias("senders"), F.array_join("recipients", ",").alias("recipients"))


query("parsed_headers", _threads, """
SELECT conv_id, turn, '<' || conv_id || '.' || turn || '@t>' AS email_id, '2026-02-20T12:00:0' || turn % 10 || '+01:00' AS date, 'turn ' || turn AS subject,
  lower(coalesce(role, 'nobody')) || '@example.com' AS senders, 'all@example.org' AS recipients FROM conversations""")


# --- functions over columns, and what is left ---------------------------------------------------


def _message_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from letterlake.functions.mail import message_id_key

    raw = F.concat(F.lit(" <Order."), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "@MAIL.Example>").otherwise("@mail.example>\r\n "))
    return adapters.table(spark, sf_dir, "orders").select("o_orderkey", message_id_key(raw).alias("mid"))


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from letterlake.functions.mail import date_text

    zone = F.when(F.col("o_orderkey") % 3 == 0, " +9900").when(F.col("o_orderkey") % 3 == 1, " +0200").otherwise("")
    raw = F.concat(F.lit("Thur, "), F.date_format("o_orderdate", "d MMM yyyy HH:mm:ss"), zone)
    return adapters.table(spark, sf_dir, "orders").select("o_orderkey", date_text(raw).alias("date"))


def _repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    claimed = reconcile.claims(_li(spark, sf_dir), _ar(spark, sf_dir))
    fetched = _li(spark, sf_dir).select("mailbox", "folder", "ord", F.when(F.col("ord") % 5 != 0, F.sha2((F.col("ord") % 700).cast("string"), 256)).alias("store_id"))
    there = adapters.table(spark, sf_dir, "events").select(F.sha2(F.floor("value").cast("string"), 256).alias("store_id"))
    return reconcile.repairs(claimed, fetched, there)


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from letterlake.sources.archive import classified

    e = adapters.table(spark, sf_dir, "events")
    own = F.sha2(F.col("event_id").cast("string"), 256)
    name = F.element_at(F.array(F.concat(own, F.lit(".eml")), F.concat(own, F.lit(".eml.zst")), F.concat(own, F.lit(".eml.q1.tmp")), F.concat(own, F.lit(".eml.corrupt.2")), F.lit("state.json.x.tmp")), (F.col("event_id") % 5 + 1).cast("int"))
    listing = e.select(name.alias("name"), F.col("ts").alias("modified"))
    return classified(listing, F.lit("2024-01-15").cast("timestamp")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


query("message_id_keys", _message_ids, "SELECT o_orderkey, 'order.' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '@mail.example' ELSE '@mail.example' END AS mid FROM orders")
query("date_texts", _dates, "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE WHEN o_orderkey % 3 = 1 THEN '+02:00' ELSE '' END AS date FROM orders")
query("reconcile_repairs", _repairs, f"""WITH {LISTING},
g AS (SELECT mailbox, folder, claim, CASE WHEN ord % 5 <> 0 THEN sha256(CAST(ord % 700 AS VARCHAR)) END AS store_id, ord FROM claimed WHERE claim <> 'TAKEN'),
k AS (SELECT *, CASE WHEN store_id IS NULL THEN 'failed' WHEN claim = 'ABSENT' THEN 'restored' WHEN store_id NOT IN (SELECT sha256(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)) FROM events WHERE value IS NOT NULL) THEN 'recovered' ELSE 'known' END AS kind FROM g)
SELECT mailbox, folder, count(*) FILTER (kind = 'restored') AS restored, count(*) FILTER (kind = 'recovered') AS recovered, count(*) FILTER (kind = 'known') AS known, count(*) FILTER (kind = 'failed') AS failed FROM k GROUP BY ALL""")
query("classified_files", _kinds, """SELECT CASE WHEN event_id % 5 < 2 THEN 'entry' WHEN event_id % 5 = 2 AND ts <= TIMESTAMP '2024-01-14' THEN 'stale' WHEN event_id % 5 = 2 THEN 'live' WHEN event_id % 5 = 3 THEN 'quarantined' ELSE 'foreign' END AS kind,
count(*) AS n FROM events GROUP BY 1""")
query("usable_resume_points", lambda s, d: adapters.table(s, d, "events").select(text.usable_resume(F.concat(F.lit('{"kind": '), F.when(F.col("event_id") % 3 == 0, '"imap-uid"').when(F.col("event_id") % 3 == 1, '""').otherwise("7"), F.lit(', "uid": 1}'))).alias("usable")).groupBy("usable").agg(F.count(F.lit(1)).alias("n")),
      "SELECT event_id % 3 = 0 AS usable, count(*) AS n FROM events GROUP BY 1")
query("attribution_counts", lambda s, d: attribution.attribution_counts(_legacy_messages(s, d), *_legacy(s, d)[:2], attribution.witnesses(*_legacy(s, d))), f"""WITH {LEGACY},
own AS (SELECT folder, mailbox FROM l_fold JOIN single USING (message_id) UNION SELECT folder, mailbox FROM l_snap),
sure AS (SELECT message_id, folder, min(mailbox) AS mailbox FROM l_fold JOIN own USING (folder) JOIN l_mail USING (message_id, mailbox) GROUP BY message_id, folder HAVING count(*) = 1)
SELECT (SELECT count(*) FROM orders) AS messages, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT message_id FROM l_mail)) + (SELECT count(*) FROM l_mail ANTI JOIN sure USING (message_id, mailbox)) AS placeless,
  (SELECT count(*) FROM l_fold) - (SELECT count(*) FROM sure) AS undecidable""")
query("attribution_owners", lambda s, d: attribution.owners(*_legacy(s, d), check._cut))


def _legacy_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("message_id"), F.col("o_orderkey").cast("string").alias("store_id"))


# --- events as a mail server -------------------------------------------------------------------


def _server(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    path = adapters.served(adapters.table(spark, sf_dir, "events"), check.shared_dir(spark))
    return {"client": "letterlake.plans.adapters:EventServer", "path": path}


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from letterlake.sources import mailbox

    mailbox.register(spark)
    found = spark.read.format("mail_uid").options(**_server(spark, sf_dir)).load()
    return found.where(F.col("folder").isin("click", "view") & (F.col("ord") > 2_000)).select("folder", "ord", "message_id")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages of all folders by a stream that stops when it has them, into a table in the shared folder."""
    import uuid

    from letterlake.sources import mailbox

    mailbox.register(spark)
    root = f"{check.shared_dir(spark)}/streamed-{uuid.uuid4().hex}"
    messages = spark.readStream.format("mail_uid").options(**_server(spark, sf_dir)).load()
    messages.writeStream.format("parquet").option("path", f"{root}/table").option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(messages.schema).parquet(f"{root}/table")
    return got.groupBy("folder").agg(F.count(F.lit(1)).alias("messages"), F.max("ord").alias("top"), F.sum(F.length("content")).cast("long").alias("bytes"), F.count_distinct("message_id").alias("ids"))


query("mailbox_listing", _listed, """SELECT event_type AS folder, event_id + 1 AS ord, '<' || event_id || '@' || user_id || '>' AS message_id FROM events WHERE event_type IN ('click', 'view') AND event_id + 1 > 2000""")
query("mailbox_stream", _streamed, """SELECT event_type AS folder, count(*) AS messages, max(event_id) + 1 AS top, CAST(sum(strlen(coalesce(props, ''))) AS BIGINT) AS bytes, count(DISTINCT '<' || event_id || '@' || user_id || '>') AS ids
FROM events WHERE event_type IS NOT NULL GROUP BY event_type""")


# --- shapes of dates and of Received fields -----------------------------------------------------


def _shaped(spark: SparkSession, sf_dir: str, shapes: list[str]) -> DataFrame:
    """Orders with ``shape`` (in turn) and ``raw``: their shape with day, month, year, time and customer put in."""
    o = adapters.table(spark, sf_dir, "orders").withColumn("shape", F.pmod("o_orderkey", F.lit(len(shapes))).cast("int"))
    raw = F.get(F.array(*map(F.lit, shapes)), F.col("shape"))
    for mark, fmt in (("DAY", "d"), ("MONTH", "MMM"), ("YEAR", "yyyy"), ("TIME", "HH:mm:ss"), ("DOTS", "dd.MM.yyyy"), ("CODED", "HH'=3A'mm'=3A'ss")):
        raw = F.replace(raw, F.lit(mark), F.date_format("o_orderdate", fmt))
    raw = F.replace(raw, F.lit("ADDRESS"), F.concat(F.lit("C"), F.col("o_custkey").cast("string"), F.lit("@mail.example")))
    return o.select("o_orderkey", raw.alias("raw"))


# a date as it is read, or null: SQL over d (the date) and n (the shape)
DATE_SHAPES = {
    "Thur, DAY MONTH YEAR": "strftime(d, '%Y-%m-%dT00:00:00')",
    "DAY MONTH YEAR TIMEEST": "strftime(d, '%Y-%m-%dT%H:%M:%S-05:00')",
    "DOTS TIME": "CASE WHEN day(d) > 12 THEN strftime(d, '%Y-%m-%dT%H:%M:%S') END",
    "room DAY may seat YEAR people": "NULL",
    "DAY of May and 14 YEAR pages": "NULL",
    "Sa, DAY Dez YEAR TIME +0100": "strftime(d, '%Y-12-%dT%H:%M:%S+01:00')",
    "Mon, DAY MONTH YEAR PST": "strftime(d, '%Y-%m-%dT00:00:00-08:00')",
    "=?utf-8?Q?Thu=2C_DAY_MONTH_YEAR_CODED_+0200?=": "strftime(d, '%Y-%m-%dT%H:%M:%S+02:00')",
    "Fri, DAY MONTH YEAR TIME +9752": "strftime(d, '%Y-%m-%dT%H:%M:%S')",
    "yesterday afternoon": "NULL",
    "Wed, DAY MONTH   GMT Daylight Time": "NULL",
    "Do, DAY März YEAR TIME (late)": "strftime(d, '%Y-03-%dT%H:%M:%S')",
    "the DAY. MONTH YEAR": "NULL",
}
# the address of a Received field, or none: SQL over a (the customer's)
RECEIVED_SHAPES = {
    "from x by y for <ADDRESS>; DAY MONTH YEAR": "a",
    "from x by y for Me@localhost; DAY MONTH YEAR": "'me@localhost'",
    "by y (for information only) for ADDRESS; DAY": "a",
    "by y for ADDRESS": "a",
    "by y (queued; for <ADDRESS>) on DAY": "a",
    "by y for <me+you@mail.example>; DAY": "''",
    "by y for ADDRESS.; DAY": "a",
    "by y FOR\r\n\t ADDRESS": "a",
    "by y therefor ADDRESS": "''",
    "by y with id for": "''",
    "by y for two for <x@y> for <ADDRESS>": "a",
}


def _date_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from letterlake.functions.mail import date_text

    return _shaped(spark, sf_dir, list(DATE_SHAPES)).select("o_orderkey", date_text("raw").alias("date"))


def _received_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from letterlake.functions.mail import with_headers

    raw = _shaped(spark, sf_dir, list(RECEIVED_SHAPES))
    content = F.encode(F.concat(F.lit("Received: "), F.col("raw"), F.lit("\r\nSubject: x\r\n\r\nfor <body@mail.example>")), "UTF-8")
    return with_headers(raw.withColumn("content", content)).select("o_orderkey", F.array_join("recipients", ",").alias("recipients"))


def _by_shape(shapes: dict[str, str]) -> str:
    return "CASE n " + " ".join(f"WHEN {k} THEN {sql}" for k, sql in enumerate(shapes.values())) + " END"


query("date_shapes", _date_shapes, f"SELECT o_orderkey, {_by_shape(DATE_SHAPES)} AS date FROM (SELECT o_orderkey, o_orderdate AS d, o_orderkey % {len(DATE_SHAPES)} AS n FROM orders)")
query("received_shapes", _received_shapes, f"SELECT o_orderkey, {_by_shape(RECEIVED_SHAPES)} AS recipients FROM (SELECT o_orderkey, 'c' || o_custkey || '@mail.example' AS a, o_orderkey % {len(RECEIVED_SHAPES)} AS n FROM orders)")
