"""Text path: every document is a review of its source."""

from __future__ import annotations

from pyspark.sql import functions as F

from guestsignal.functions.numbers import rounded
from guestsignal.functions.text import clean_text, split_sentences
from guestsignal.functions.vectors import norm
from guestsignal.operators import evidence, explain, ingest, labels, search, sentences
from guestsignal.operators.scale import materialise
from guestsignal.plans import oracle_views as o
from guestsignal.plans.registry import query, r
from guestsignal.sources import driver_views as v

KEYS = v.DOCUMENT_ASPECTS
WITH = f"with {o.DOCS}"
WITH_LABELS = f"{WITH}, {o.labels_sql(v.DOCUMENT_LEXICON, KEYS)}"
P = 6
A_SOURCE = "src3"

# --- sources --------------------------------------------------------------------------


@query("scan_reviews", f"{WITH} select review_id, hotel_id, review_text from docv")
def scan_reviews(spark, sf):
    return v.document_reviews(spark, sf).select("review_id", "hotel_id", "review_text")


@query(
    "scan_profiles",
    """select cast(p_partkey as varchar) as profile_id,
    lower(p_name || ' ' || p_type || ' ' || p_brand) as description from part""",
)
def scan_profiles(spark, sf):
    return ingest.load_profiles(v.part_profiles(spark, sf).select("profile_id", "description"))


@query(
    "scan_embeddings",
    f"""select cast(vec_id as varchar) as sentence_id, cast(len(embedding) as bigint) as size,
    {r('sqrt(list_dot_product(embedding::double[], embedding::double[]))', 5)} as length
    from embeddings""",
)
def scan_embeddings(spark, sf):
    return v.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("sentence_id"),
        F.size("embedding").cast("bigint").alias("size"),
        rounded(norm(F.col("embedding")), 5).alias("length"),
    )


# --- cleaning -------------------------------------------------------------------------


@query("clean_text", f"select doc_id, {o.CLEAN.replace('{t}', 'text')} as cleaned from documents")
def clean_text_query(spark, sf):
    docs = v.table(spark, sf, "documents")
    return docs.select("doc_id", clean_text(F.col("text")).alias("cleaned"))


RAW_SQL = f"""raw as (
  select md5(text) as review_id, source as hotel_id, {o.CLEAN.replace('{t}', 'text')} as review_text,
    (n_chars % 13) / 2e0 as number, case when doc_id % 29 <> 0 then {o.DOC_DAY} end as day,
    coalesce(quality = 1, false) as verified,
    case when lang <> 'en' then lang else 'unknown' end as traveler_type, doc_id
  from documents left join labels using (doc_id)),
valid as (
  select * from raw where length(review_text) > 0 and number between 1 and 5 and day is not null),
unique_reviews as (
  select * from (select *, row_number() over (partition by review_id order by doc_id) as place
    from valid) where place = 1)"""


@query(
    "reviews_clean",
    f"""with {RAW_SQL} select review_id, hotel_id, cast(trunc(number) as bigint) as rating,
    strftime(day, '%Y-%m-%d') as review_date, verified, traveler_type,
    {r('''pow(0.5e0, date_diff('day', day, (select max(day) from unique_reviews)) / 365e0)''', P)}
      as recency_weight,
    case when verified then 1e0 else 0.8e0 end as trust_weight from unique_reviews""",
)
def reviews_clean(spark, sf):
    loaded = ingest.load_reviews(v.raw_documents(spark, sf), [F.col("doc_id")])
    return loaded.select(
        "review_id",
        "hotel_id",
        F.col("rating").cast("bigint").alias("rating"),
        F.date_format("review_date", "yyyy-MM-dd").alias("review_date"),
        "verified",
        "traveler_type",
        rounded(F.col("recency_weight"), P).alias("recency_weight"),
        "trust_weight",
    )


@query(
    "rejected_reviews",
    f"""with {RAW_SQL} select doc_id, case when length(review_text) = 0 then 'empty text'
      when not number between 1 and 5 then 'rating outside 1..5' else 'unreadable date' end
      as reject_reason from raw
    where length(review_text) = 0 or not number between 1 and 5 or day is null""",
)
def rejected_reviews(spark, sf):
    return ingest.rejected_reviews(v.raw_documents(spark, sf)).select("doc_id", "reject_reason")


# --- sentences ------------------------------------------------------------------------


@query(
    "split_sentences",
    f"""{WITH} select review_id, cast(count(*) as bigint) as n_sentences,
    cast(max(length(sentence_text)) as bigint) as longest from sents group by review_id""",
)
def split_sentences_query(spark, sf):
    parts = v.document_reviews(spark, sf).select(
        "review_id", split_sentences(F.col("review_text")).alias("parts")
    )
    return parts.select(
        "review_id",
        F.size("parts").cast("bigint").alias("n_sentences"),
        F.array_max(F.transform("parts", F.length)).cast("bigint").alias("longest"),
    )


@query("sentence_instances", f"{WITH} select review_id, sentence_pos, sentence_text from sents")
def sentence_instances(spark, sf):
    return v.document_sentences(spark, sf).select(
        "review_id", F.col("sentence_pos").cast("bigint").alias("sentence_pos"), "sentence_text"
    )


@query("distinct_sentences", f"{WITH} select distinct sentence_text from sents")
def distinct_sentences(spark, sf):
    return sentences.distinct_sentences(v.document_sentences(spark, sf))


@query(
    "corpus_stats",
    f"""{WITH} select (select count(*) from docv) as n_reviews, count(*) as n_instances,
    count(distinct sentence_text) as n_unique from sents""",
)
def corpus_stats(spark, sf):
    return sentences.corpus_stats(
        v.table(spark, sf, "documents"), v.document_sentences(spark, sf)
    )


@query(
    "corpus_stats_by_source",
    f"""{WITH} select hotel_id, count(*) as n_instances, count(distinct sentence_text) as n_unique
    from sents group by hotel_id""",
)
def corpus_stats_by_source(spark, sf):
    """Exact counts per source: pairs first, so that no task holds all sentences of one."""
    each = v.document_sentences(spark, sf).groupBy("hotel_id", "sentence_text")
    return each.agg(F.count(F.lit(1)).alias("n")).groupBy("hotel_id").agg(
        F.sum("n").alias("n_instances"), F.count(F.lit(1)).alias("n_unique")
    )


# --- labels ---------------------------------------------------------------------------


def _packed():
    return F.array_join("aspects", "|").alias("aspects")


@query(
    "label_sentences",
    f"""{WITH_LABELS} select sentence_text, array_to_string(aspects, '|') as aspects, polarity,
    top_score as top_aspect_score from lab""",
)
def label_sentences(spark, sf):
    return v.document_labels(spark, sf).select(
        "sentence_text", _packed(), "polarity", "top_aspect_score"
    )


@query(
    "threshold_aspects",
    f"""{WITH_LABELS} select array_to_string(aspects, '|') as aspects, count(*) as n
    from lab group by 1""",
)
def threshold_aspects(spark, sf):
    return v.document_labels(spark, sf).groupBy(_packed()).agg(F.count(F.lit(1)).alias("n"))


@query("polarity", f"{WITH_LABELS} select polarity, count(*) as n from lab group by polarity")
def polarity(spark, sf):
    return v.document_labels(spark, sf).groupBy("polarity").agg(F.count(F.lit(1)).alias("n"))


_PACKED_SQL = " || ';' || ".join(
    f"'{k}:' || printf('%.2f', {r('s_' + k, 2)})" for k in KEYS
)


@query(
    "top_aspect_score",
    f"{WITH_LABELS} select sentence_text, top_score, {_PACKED_SQL} as packed from lab",
)
def top_aspect_score(spark, sf):
    return v.document_labels(spark, sf).select(
        "sentence_text",
        F.col("top_aspect_score").alias("top_score"),
        labels.pack_scores(F.col("aspect_scores"), KEYS).alias("packed"),
    )


@query(
    "unlabelled_sentences",
    f"""{WITH} select distinct sentence_text from sents where sentence_text not in (
      select sentence_text from sents where review_id in (
        select cast(doc_id as varchar) from labels))""",
)
def unlabelled_sentences(spark, sf):
    """Sentences of documents nobody has rated, unless a rated document has them too."""
    instances = v.document_sentences(spark, sf)
    rated = v.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("review_id"))
    known = sentences.distinct_sentences(instances.join(rated, "review_id", "left_semi"))
    return labels.unlabelled_sentences(instances, known)


OVERRIDES_SQL = """ovr as (
  select sentence_text, case when length(sentence_text) % 2 = 0 then ['service', 'value'] end
      as new_aspects,
    case when length(sentence_text) % 3 <> 0 then -0.5e0 end as new_polarity,
    case when length(sentence_text) % 2 = 0 then 'wrong aspect' else 'wrong tone' end as reason
  from (select distinct sentence_text from sents where sentence_pos = 0 and review_id in (
    select cast(doc_id as varchar) from labels where toxic = 1)))"""


@query(
    "apply_overrides",
    f"""{WITH_LABELS}, {OVERRIDES_SQL} select sentence_text,
    array_to_string(coalesce(new_aspects, aspects), '|') as aspects,
    coalesce(new_polarity, polarity) as polarity, reason is not null as overridden
    from lab left join ovr using (sentence_text)""",
)
def apply_overrides(spark, sf):
    corrected = labels.apply_overrides(
        v.document_labels(spark, sf), v.document_overrides(spark, sf)
    )
    return corrected.select("sentence_text", _packed(), "polarity", "overridden")


@query(
    "override_audit",
    f"""{WITH}, {OVERRIDES_SQL} select reason, count(*) as n_overridden from ovr group by reason""",
)
def override_audit(spark, sf):
    overrides = v.document_overrides(spark, sf)
    corrected = labels.apply_overrides(v.document_labels(spark, sf), overrides)
    return labels.override_audit(corrected, overrides)


# --- aspect instances -----------------------------------------------------------------


@query(
    "label_join",
    f"""{WITH_LABELS} select review_id, sentence_pos,
    array_to_string(case when rated then aspects else ['general'] end, '|') as aspects,
    case when rated then polarity else 0e0 end as polarity
    from (select sents.*, lab.aspects, lab.polarity, sentence_text in (
        select sentence_text from sents where review_id in (
          select cast(doc_id as varchar) from labels)) as rated
      from sents join lab using (sentence_text))""",
)
def label_join(spark, sf):
    """Labels exist only for the sentences of rated documents; the others turn into filler."""
    columns = ["review_id", "sentence_pos", "sentence_text"]
    instances = materialise(v.document_sentences(spark, sf).select(columns), "sentences")
    rated = v.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("review_id"))
    known = sentences.distinct_sentences(instances.join(rated, "review_id", "left_semi"))
    scorer = labels.lexicon_scorer(v.DOCUMENT_LEXICON)
    labelled = labels.label_sentences(known, scorer, KEYS)
    return evidence.join_labels(instances, labelled).select(
        "review_id",
        F.col("sentence_pos").cast("bigint").alias("sentence_pos"),
        _packed(),
        "polarity",
    )


@query(
    "aspect_explode",
    f"""{WITH_LABELS} select aspect, count(*) as n, {r('sum(polarity)', 4)} as polarity
    from dins group by aspect""",
)
def aspect_explode(spark, sf):
    return (
        v.document_instances(spark, sf)
        .groupBy("aspect")
        .agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("polarity"), 4).alias("polarity"))
    )


@query(
    "aspect_instances",
    f"""{WITH_LABELS} select review_id, sentence_pos, hotel_id, aspect, polarity, season,
    year_month, traveler_type, verified, {r('weight', P)} as weight, is_general from dins""",
)
def aspect_instances(spark, sf):
    return v.document_instances(spark, sf).select(
        "review_id",
        F.col("sentence_pos").cast("bigint").alias("sentence_pos"),
        "hotel_id",
        "aspect",
        "polarity",
        "season",
        "year_month",
        "traveler_type",
        "verified",
        rounded(F.col("weight"), P).alias("weight"),
        "is_general",
    )


# --- quotes ---------------------------------------------------------------------------

QUALITY = "round(polarity * recency_weight * trust_weight, 12)"
QUOTE_ORDER = "quality desc, review_date desc, review_id, sentence_text, aspect"
QUOTES_SQL = f"""quoted as (
  select * exclude (copy) from (
    select *, row_number() over (partition by hotel_id, aspect, sentence_text
      order by {QUOTE_ORDER}) as copy
    from (select *, {QUALITY} as quality from dins where not is_general and polarity > 0.15e0))
  where copy = 1),
quotes as (
  select * from (select *, row_number() over (partition by hotel_id, aspect
    order by {QUOTE_ORDER}) as place from quoted) where place <= 3)"""


@query(
    "evidence_quality",
    f"""{WITH_LABELS} select hotel_id, aspect, count(*) as n, {r('sum(q)', P)} as total_quality,
    {r('max(q)', P)} as best_quality
    from (select *, polarity * recency_weight * trust_weight as q from dins where not is_general)
    group by hotel_id, aspect""",
)
def evidence_quality(spark, sf):
    return (
        explain.with_quality(v.document_instances(spark, sf))
        .groupBy("hotel_id", "aspect")
        .agg(
            F.count(F.lit(1)).alias("n"),
            rounded(F.sum("quality"), P).alias("total_quality"),
            rounded(F.max("quality"), P).alias("best_quality"),
        )
    )


@query(
    "best_quotes",
    f"""{WITH_LABELS}, {QUOTES_SQL} select hotel_id, aspect, cast(place as bigint) as place,
    review_id, sentence_text, {r('quality', P)} as quality from quotes""",
)
def best_quotes(spark, sf):
    return explain.best_quotes(v.document_instances(spark, sf)).select(
        "hotel_id",
        "aspect",
        F.col("place").cast("bigint").alias("place"),
        "review_id",
        "sentence_text",
        rounded(F.col("quality"), P).alias("quality"),
    )


# --- search ---------------------------------------------------------------------------

QUERY_VECTOR = "(select embedding::double[] from embeddings where vec_id = 0)"
SIM = f"list_dot_product(embedding::double[], {QUERY_VECTOR})"


def the_query(spark, sf):
    """The vector of sentence 0 is what is searched for."""
    chosen = v.table(spark, sf, "embeddings").filter("vec_id = 0")
    return chosen.agg(F.first("embedding").alias("q")).scalar()


def search_tables(spark, sf):
    """Sentences of the documents that have a vector, under the vector's label as aspect, and
    vectors of sentences: number n belongs to the first sentence of document n, the smallest
    number to a sentence that opens several documents. Copies of documents repeat sentences."""
    vectors = v.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("review_id"), "vec_id", "label", "embedding"
    )
    asked = v.document_sentences(spark, sf).join(vectors.drop("embedding"), "review_id")
    polarity = (F.col("rating") - 3) / F.lit(2.0)
    pool = materialise(
        asked.withColumns({"aspect": F.col("label").cast("string"), "polarity": polarity}), "pool"
    )
    openings = pool.filter("sentence_pos = 0").groupBy("sentence_text").agg(F.min("vec_id").alias("vec_id"))
    return pool, openings.join(vectors, "vec_id").select("sentence_text", "embedding")


POOL_SQL = f"""pool as (
  select sents.*, vec_id, cast(label as varchar) as aspect, (rating - 3) / 2e0 as polarity
  from sents join embeddings on review_id = cast(vec_id as varchar)),
openings as (
  select sentence_text, min(vec_id) as vec_id from pool where sentence_pos = 0 group by sentence_text),
near as (
  select sentence_text, {SIM} as similarity from openings join embeddings using (vec_id))"""


def _search_sql(condition: str) -> str:
    return f"""{WITH}, {POOL_SQL}, shown as (
      select *, row_number() over (partition by sentence_text
        order by recency_weight desc, review_id, aspect) as copy from pool where {condition})
    select review_id, hotel_id, hotel_name, sentence_text, aspect, polarity,
      strftime(review_date, '%Y-%m-%d') as review_date, verified, {r('similarity', P)} as similarity
    from shown join near using (sentence_text) where copy = 1 and similarity > 0
    order by near.similarity desc, recency_weight desc, review_id, sentence_text limit 10"""


@query(
    "cosine_scores",
    f"select vec_id, {r(SIM, P)} as similarity from embeddings",
)
def cosine_scores(spark, sf):
    scored = search.sentence_similarity(
        v.table(spark, sf, "embeddings"), the_query(spark, sf), "vec_id"
    )
    return scored.withColumn("similarity", rounded(F.col("similarity"), P))


def _shown(found):
    return found.withColumn("review_date", F.date_format("review_date", "yyyy-MM-dd"))


def _found(spark, sf, **filters):
    pool, vectors = search_tables(spark, sf)
    return _shown(search.search(pool, vectors, the_query(spark, sf), **filters))


@query("filtered_search", _search_sql(f"hotel_id = '{A_SOURCE}'"))
def filtered_search(spark, sf):
    return _found(spark, sf, hotel_id=A_SOURCE)


@query("semantic_search", _search_sql("true"))
def semantic_search(spark, sf):
    return _found(spark, sf)


@query("search_by_aspect", _search_sql("aspect = '3'"))
def search_by_aspect(spark, sf):
    return _found(spark, sf, aspect="3")
