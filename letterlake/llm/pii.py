"""Information-theoretic removal of personal data.  DataFrame functions only.

Known forms (e-mail, IP address, card and phone numbers) are found by pattern and are the
protected entities.  Over the corpus, the pointwise mutual information of a word and an entity,
counted by whole documents, says how strongly the word gives the entity away; it discloses the
entity if that reaches ``DISCLOSED`` of the entity's own information, which is the case when

    n_word <= n_both * (n / n_entity) ** (1 - DISCLOSED)

for ``n`` documents, of which ``n_entity`` hold the entity, ``n_word`` the word and ``n_both``
both.  In the documents that hold the entity such words would bring back what its removal hides.
Words that stand with it in different texts are removed (``term``).  Where one text alone, however
often copied, says so, the word is rare rather than known to belong, and is generalised (``rare``).

Rows of words and entities exist for documents with entities only.  A word that is too frequent for
the bound above among those alone cannot disclose anything and is dropped before words meet
entities; pairs are formed for entities and words of at least two documents each, while the words
of one text need no pairs, as the least known entity of their document decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterlake.llm.common import is_small, materialise, small, spread_join, without
from letterlake.llm.spans import Kind, counted, listed, no_spans, overlaps, replaced, with_spans

#: Share of an entity's information that a word may not reach.
DISCLOSED = 0.8
#: A word is a run of at least two letters (with their marks): one letter names nobody.
WORD = r"[\p{L}\p{M}]{2,}+"


def _luhn(digits: Column) -> Column:
    at = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, 1).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(at, F.lit(0), add) % 10 == 0


def _is_card(m: Column) -> Column:
    digits = F.translate(m, " -", "")
    return F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)


def _is_ip(m: Column) -> Column:
    # by length first, so that no number is too long to cast
    return F.forall(F.split(m, r"\."), lambda p: F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))).cast("int") <= 255).otherwise(False))


# The same matches as the plain patterns, in linear time: no start inside a run that has failed
# from its beginning, unless the match before ends there, and no giving back where nothing follows.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
KINDS = (
    Kind("email", _EMAIL, lambda t: t.contains("@"), lambda m: F.lit(True)),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]"), _is_ip),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), _is_card),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+"), lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")).between(10, 15)),
)


def entity(span: Column) -> Column:
    """The protected value: lower-cased address, or digits."""
    return F.concat_ws(":", span["kind"], F.when(span["kind"] == "email", F.lower(span["match"])).when(span["kind"] == "ip", span["match"]).otherwise(F.regexp_replace(span["match"], "[^0-9]", "")))


def words_of(text: Column) -> Column:
    """Distinct lower-cased words, without those of addresses."""
    # only whole addresses, from the blank before them on: no start within a run of other characters
    bare = F.when(text.contains("@"), F.regexp_replace(text, r"(?<!\S)[^\s@]*+@\S*+", " ")).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(F.lower(bare), F.lit(WORD), F.lit(0)))


def _key(docs: DataFrame, doc_id: str, text: str) -> Column:
    return F.md5(F.concat_ws("|", F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")))))


def contexts(found: DataFrame, text: str, spans: str = "base_spans", key: str = "__key") -> DataFrame:
    """key, digest (of the text), entities and words, both distinct, of each document with entities."""
    entities = F.array_distinct(F.transform(spans, entity))
    return found.where(F.size(spans) > 0).select(F.col(key).alias("key"), F.xxhash64(text).alias("digest"), entities.alias("entities"), words_of(F.col(text)).alias("words"))


def disclosing(docs: DataFrame, near: DataFrame, text: str = "text", disclosed: float = DISCLOSED) -> DataFrame:
    """key, word and kind (``term`` or ``rare``) of the words that give an entity of their document away.

    ``near`` has the contexts of the documents with entities.
    """
    entities = near.select("key", "digest", F.explode("entities").alias("entity"))
    by_entity = materialise(entities.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), F.count(F.lit(1)).alias("weight")), "pii-entities")
    top, held = by_entity.agg(F.max("n_entity"), F.sum("weight")).first()
    if not top:
        return near.select("key", F.lit("").alias("word"), F.lit("").alias("kind")).limit(0)
    total = float(docs.count())

    def most(n_both: Column, n_entity: Column) -> Column:
        """The documents in which a word may stand that discloses an entity; none where all documents hold the entity."""
        return F.when(n_entity < total, n_both * F.pow(F.lit(total) / n_entity, F.lit(1 - disclosed))).otherwise(0.0)

    # of each document the documents of its least known entity, and the entities that others hold too
    marks = spread_join(entities, by_entity, ["entity"], "weight", held).groupBy("key").agg(F.min("n_entity").alias("least"), F.collect_set(F.when(F.col("n_entity") > 1, F.struct("entity", "n_entity"))).alias("shared"))
    # among documents with entities a word stands in no more documents than in all: too frequent ones go at once
    by_word = materialise(near.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n_near")), "pii-words")
    bound = float(top) ** disclosed * total ** (1 - disclosed)
    common = by_word.where(F.col("n_near") > bound).select("word")
    rest = by_word.where(F.col("n_near") <= bound)
    words = near.join(marks, "key").select("key", "digest", "least", "shared", F.explode("words").alias("word"))
    if is_small(common):
        words = words.join(F.broadcast(common), "word", "left_anti").join(rest, "word")
    else:
        words = spread_join(words, rest.withColumn("weight", F.col("n_near")), ["word"], "weight", rest.agg(F.sum("n_near")).first()[0])
    words = materialise(words, "pii-candidates")
    pairs = words.where("n_near > 1").select("key", "digest", "word", "n_near", F.explode("shared").alias("e"))
    pairs = pairs.groupBy("e.entity", "word").agg(F.first("e.n_entity").alias("n_entity"), F.first("n_near").alias("n_near"), F.count(F.lit(1)).alias("n_both"), F.min("digest").alias("one"), F.max("digest").alias("other"))
    pairs = pairs.where((F.col("one") != F.col("other")) & (F.col("n_near") <= most(F.col("n_both"), F.col("n_entity"))))
    pairs = materialise(pairs.drop("one", "other"), "pii-pairs")
    alone = words.where(F.col("n_near") <= most(F.lit(1), F.col("least")))

    # documents that hold each word that is still in question, over the whole corpus
    asked = materialise(alone.select("word").union(pairs.select("word")).distinct(), "pii-asked")
    every = docs.select(F.explode(words_of(F.coalesce(F.col(text), F.lit("")))).alias("word"))
    if is_small(asked):
        every = every.join(F.broadcast(asked), "word", "left_semi")
    n_word = materialise(every.groupBy("word").agg(F.count(F.lit(1)).alias("n_word")).join(asked, "word", "left_semi"), "pii-counts")

    strong = pairs.join(n_word, "word").where(F.col("n_word") <= most(F.col("n_both"), F.col("n_entity"))).select("entity", "word")
    terms = words.where("n_near > 1").select("key", "word", F.explode("shared").alias("e")).select("key", "word", "e.entity").join(small(materialise(strong, "pii-strong")), ["entity", "word"], "left_semi")
    rare = alone.join(n_word, "word").where(F.col("n_word") <= most(F.lit(1), F.col("least")))
    both = terms.select("key", "word", F.lit("term").alias("kind")).union(rare.select("key", "word", F.lit("rare").alias("kind")))
    return both.groupBy("key", "word").agg(F.max("kind").alias("kind"))


def sanitised(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", disclosed: float = DISCLOSED, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``base_spans`` of the known forms, ``spans`` (those and disclosing ``term`` and ``rare`` ones) and ``redacted``.

    Spans have start, rank, end (code points, end exclusive), kind and match, sorted by start and
    kind; a word never overlaps a known form.  ``redacted`` is the text with known forms
    generalised to their kind in brackets, rare words to ``[WORD]``, and terms removed;
    ``keep_text=False`` leaves both texts out.  Words are looked for in the documents that hold the
    entity: one that names the person without the entity stays as it is.

    Null and empty texts have no spans (``redacted`` of null is null), and an empty table gives an
    empty result.  Rows with the same id and text get the same result each, and equally frequent
    words are treated alike; input columns named like results are replaced, others stay.  Whole
    texts of any length are read, in time linear in the text but for the lists of very many words.
    An entity in every document carries no information, so nothing discloses it.
    """
    names = ["base_spans", "spans", "redacted"]
    kept = [c for c in without(docs, names) if keep_text or c != text]
    found = with_spans(docs.select(*dict.fromkeys([*kept, text, doc_id])), text, KINDS, "base_spans")
    keyed = found.withColumn("__key", F.when(F.size("base_spans") > 0, _key(docs, doc_id, text)))
    if not keep_text:
        keyed = keyed.withColumn(text, F.when(F.size("base_spans") > 0, F.col(text)))
    # written once: a filter on spans would otherwise search all texts again, below and above it
    keyed = materialise(keyed, "pii-spans")
    near = materialise(contexts(keyed, text), "pii-contexts")
    told = materialise(disclosing(docs, near, text, disclosed), "pii-disclosing")
    if told.isEmpty():
        df = keyed.withColumn("spans", F.col("base_spans"))
    else:
        # each word of these documents is a row that meets its kind by key and word: lists of words in a
        # row would be searched anew for every word of the text.  The kinds come as further rows of the
        # same document, so that all of this needs one shuffle, by document
        kinds = told.groupBy(F.col("key").alias("__key")).agg(F.collect_list(F.struct("word", "kind")).alias("__told"))
        texts = keyed.where(F.size("base_spans") > 0).select("__key", F.col(text).alias("__text")).dropDuplicates(["__key"]).join(kinds, "__key")
        hits = F.regexp_extract_all("__text", F.lit(WORD), F.lit(0))
        parts = F.arrays_zip(F.split("__text", WORD, -1).alias("piece"), hits.alias("match"))
        found = F.transform(parts, lambda x, i: F.struct(i.alias("at"), F.length(x["piece"]).alias("gap"), x["match"].alias("match"), F.lower(x["match"]).alias("word"), F.lit(None).cast("string").alias("kind")))
        given = F.transform("__told", lambda t: F.struct(F.lit(-1).alias("at"), F.lit(0).alias("gap"), F.lit("").alias("match"), t["word"].alias("word"), t["kind"].alias("kind")))
        rows = texts.select(F.col("__key").alias("key"), F.explode(F.concat(found, given)).alias("x")).select("key", "x.*").where(F.col("match").isNotNull())
        # a place is the running length of the words before and of what stands between them
        rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(Window.partitionBy("key").orderBy("at")).cast("int"))
        rows = rows.withColumn("kind", F.first("kind").over(Window.partitionBy("key", "word").orderBy("at"))).where((F.col("at") >= 0) & F.col("kind").isNotNull())
        rank = F.when(F.col("kind") == "rare", len(KINDS) + 1).otherwise(len(KINDS))
        span = F.struct((F.col("end") - F.length("match")).alias("start"), rank.alias("rank"), "end", "kind", "match")
        lists = materialise(rows.groupBy(F.col("key").alias("__k")).agg(F.collect_list(span).alias("__found")), "pii-lists")
        df = keyed.join(small(lists), F.col("__key") == F.col("__k"), "left").drop("__k").withColumn("__found", F.coalesce("__found", no_spans()))
        free = F.filter("__found", lambda s: ~F.exists("base_spans", lambda b: overlaps(s, b)))
        df = df.withColumn("spans", F.array_sort(F.concat("base_spans", F.when(F.size("__found") > 0, free).otherwise(no_spans()))))
    if not keep_text:
        return df.select(*kept, "base_spans", "spans")
    mark = lambda kind: F.when(kind == "term", F.lit("")).when(kind == "rare", F.lit("[WORD]")).otherwise(F.concat(F.lit("["), F.upper(kind), F.lit("]")))
    return df.select(*kept, "base_spans", "spans", F.when(F.size("spans") > 0, replaced(F.col(text), F.col("spans"), mark)).otherwise(F.col(text)).alias("redacted"))


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns from ``base_spans`` and ``spans``."""
    return df.select("doc_id", *(counted(F.col("base_spans"), k.name).alias(f"n_{k.name}") for k in KINDS), F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
