"""Queries over the test tables: one for each operator, applied to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twintext.functions import text as T
from twintext.functions import tokens as K
from twintext.operators import audit, business, glossary, matching, memory, qa, search, segmentation, views
from twintext.sources import writers
from twintext.stages import materialise

KEY = ["doc_id", "ord"]
LANG = ("lang",)
TODAY = "1998-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return matching.segments(table(spark, d, "documents"))


def hashed_lines(spark: SparkSession, d: str) -> DataFrame:
    return matching.normalized(lines(spark, d), "line")


def statused(rows: DataFrame) -> DataFrame:
    """Segments of every third document are confirmed."""
    return rows.withColumn("confirmed", F.col("doc_id") % 3 == 0)


def memory_of(spark: SparkSession, d: str) -> DataFrame:
    """Two memories: benchmark items, and the lines of documents labelled good."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("tu_id"), F.lit("en").alias("lang"), F.col("text").alias("line"), F.lit(1).alias("priority"), F.lit(3).alias("quality"), F.lit("2024-01-01").alias("updated_at"))
    good = matching.segments(table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi"))
    docs = good.select((F.col("doc_id") * 100_000 + F.col("ord") + 1_000_000).alias("tu_id"), "lang", "line", F.lit(2).alias("priority"), (F.col("doc_id") % 5).cast("int").alias("quality"), F.lit("2024-02-01").alias("updated_at"))
    return matching.normalized(items.unionByName(docs), "line").drop("line")


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Each turn of a conversation as source, the next as target."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("source"), F.lead("text").over(w).alias("target"))
    return rows.where("target is not null").withColumn("status", F.lit("translated"))


def line_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each line as source, the document's next one as target.

    A document's lines lie in one row, so neighbours are paired there: no text is shuffled.
    """
    numbered = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("ord"), line.alias("line")))
    found = table(spark, d, "documents").select("doc_id", F.filter(numbered, lambda x: F.trim(x["line"]) != "").alias("x"))
    after = F.greatest(F.size("x") - 1, F.lit(0))
    rows = found.select("doc_id", F.explode(F.arrays_zip(F.slice("x", 1, after).alias("a"), F.slice("x", 2, after).alias("b"))).alias("p"))
    return rows.select("doc_id", F.col("p.a.ord").alias("ord"), F.col("p.a.line").alias("source"), F.col("p.b.line").alias("target"), F.lit("translated").alias("status"))


def normalize_hash(spark, d):
    rows = table(spark, d, "documents").select("doc_id", T.normalize(F.col("text")).alias("plain"))
    return rows.select("doc_id", F.length("plain").cast("long").alias("n"), T.text_hash(F.col("plain")).alias("hash"))


def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.count_words(F.col("text")).alias("words"), T.has_spaced_words(F.col("lang")).alias("spaced"))


def repetition_analysis(spark, d):
    rows = hashed_lines(spark, d).withColumn("words", T.count_words(F.col("line")))
    # The first occurrence of each text counts for its source; all others are repeats.
    first = rows.groupBy("hash").agg(F.min(F.struct("doc_id", "ord", "source", "words")).alias("x"))
    first = first.groupBy(F.col("x.source").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum("x.words").alias("w"))
    every = rows.groupBy("source").agg(F.count(F.lit(1)).alias("segments"), F.sum("words").alias("words"))
    out = every.join(first, every["source"].eqNullSafe(first["source"]), "left").drop(first["source"])
    return out.select("source", "segments", "words", (F.col("segments") - F.coalesce("n", F.lit(0))).alias("repeated"), (F.col("words") - F.coalesce("w", F.lit(0))).alias("repeated_words"))


def exact_match(spark, d):
    # A hit is by hash: the units' texts would only be carried along.
    return matching.exact_match(hashed_lines(spark, d), memory_of(spark, d).drop("plain"), KEY, LANG).select(*KEY, "tu_id", "priority", "quality")


def propagation(spark, d):
    return matching.propagation(statused(hashed_lines(spark, d)), KEY, LANG).drop("hash")


def segment_context(spark, d):
    return matching.segment_context(hashed_lines(spark, d)).select(*KEY, "hash", "prev_hash", "next_hash")


def context_match(spark, d):
    rows = matching.segment_context(hashed_lines(spark, d))
    known = rows.where("doc_id % 2 = 0").select((F.col("doc_id") * 100_000 + F.col("ord")).alias("tu_id"), "hash", "prev_hash", "next_hash")
    return matching.context_match(rows, known, KEY)


def ambiguous_siblings(spark, d):
    rows = hashed_lines(spark, d).withColumn("unit_group", F.when(F.length("line") < 200, F.length("line") % 3))
    return matching.ambiguous_siblings(rows).select(*KEY, "n")


def fuzzy_match(spark, d):
    return matching.fuzzy_match(hashed_lines(spark, d), memory_of(spark, d), KEY, langs=LANG)


def _cascade(spark, d):
    """All lines with their outcome; of their texts the words are counted first."""
    rows = statused(hashed_lines(spark, d)).drop("line").withColumn("words", T.count_words(F.col("plain")))
    return matching.pretranslate(rows, memory_of(spark, d), KEY, langs=LANG, keep=("words",))


def pretranslate_summary(spark, d):
    out = _cascade(spark, d)
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("segments"), F.sum("words").alias("words"))


def tier_analysis(spark, d):
    out = _cascade(spark, d)
    return out.where("outcome <> 'skipped'").groupBy(T.tier_for_origin(F.col("origin")).alias("tier")).agg(F.sum("words").alias("words"))


def concordance(spark, d):
    return search.concordance(lines(spark, d), "the", KEY)


def term_document_frequency(spark, d):
    return search.document_frequency(table(spark, d, "documents"))


def vector_topk(spark, d):
    v = table(spark, d, "embeddings")
    return search.top_by_dot(v, v.where("vec_id % 20 = 0"), 5).select("query_id", "vec_id", F.round("dot", 4).alias("dot"), F.col("rank").cast("long").alias("rank"))


def unembedded(spark, d):
    return search.without_vector(table(spark, d, "documents").select("doc_id"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), ["doc_id"])


def _versions(spark, d):
    o = table(spark, d, "orders")
    ours = o.where("o_orderkey % 3 <> 0").select("o_orderkey", (F.col("o_orderkey") % 4).cast("int").alias("rev"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"), F.col("o_orderpriority").alias("plain"), (F.col("o_custkey") % 5).cast("int").alias("quality"), (F.col("o_orderkey") % 7).alias("usage_count"))
    theirs = o.where("o_orderkey % 4 <> 1").select("o_orderkey", (F.col("o_orderkey") % 5).cast("int").alias("rev"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"), F.concat("o_orderpriority", F.lit("!")).alias("plain"), (F.col("o_custkey") % 4).cast("int").alias("quality"), (F.col("o_orderkey") % 5).alias("usage_count"))
    return ours, theirs


def memory_merge(spark, d):
    return memory.merge_variants(*_versions(spark, d), ["o_orderkey"])


def write_back_upsert(spark, d):
    ours, theirs = _versions(spark, d)
    return memory.write_back(ours.drop("usage_count"), theirs.where("o_orderkey % 7 = 0").select("o_orderkey", "plain", "quality", "updated_at"), ["o_orderkey"])


def memory_languages(spark, d):
    docs = table(spark, d, "documents")
    return memory.describe(docs.select(F.col("doc_id").alias("tu_id"), "lang"))


def qa_issues(spark, d):
    return qa.issues(line_pairs(spark, d), KEY, "en", "en", ("seg.empty", "seg.untranslated", "punct.terminal", "punct.brackets", "punct.spacing"))


def qa_inverted(spark, d):
    return qa.issues(line_pairs(spark, d), KEY, "en", "es", ("punct.inverted",))


def qa_numbers(spark, d):
    return qa.issues(line_pairs(spark, d), KEY, "en", "de", ("num.missing", "num.altered"))


def qa_marks(spark, d):
    return qa.marks(qa_issues(spark, d), KEY)


def qa_consistency(spark, d):
    return qa.inconsistent(line_pairs(spark, d).select(*KEY, F.lower("source").alias("source"), F.lower("target").alias("target")), KEY)


def qa_rule_counts(spark, d):
    now = materialise(qa_issues(spark, d), "issues")
    found = qa.carried(now, now.withColumn("dismissed", F.col("doc_id") % 2 == 0), KEY)
    return found.groupBy("rule").agg(F.count(F.when(~F.col("dismissed"), 1)).alias("open"), F.count(F.when(F.col("dismissed"), 1)).alias("dismissed"))


#: Kinds of the elements of web pages; all others are hidden.
KINDS = {"b": "b", "strong": "b", "i": "i", "em": "i", "a": "link", "br": "br", "img": "image", "p": "style", "h1": "style", "li": "style"}


def page_tokens(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    return pages.select("page_id", "html", K.markup_tokens(F.col("html"), KINDS).alias("m")).select("page_id", "html", "m.tokens", "m.formats")


def page_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each page as source, the next one's tokens as target."""
    pages = page_tokens(spark, d)
    return pages.join(pages.select((F.col("page_id") - 1).alias("page_id"), F.col("tokens").alias("target_tokens"), F.col("formats").alias("target_formats")), "page_id")


def qa_tags(spark, d):
    return qa.tag_issues(page_pairs(spark, d).withColumnRenamed("tokens", "source_tokens"), ["page_id"])


def term_candidates(spark, d):
    """Terms of each language with stop words."""
    return glossary.term_candidates_by_language(hashed_lines(spark, d).select(*KEY, "lang", "plain"), KEY)


def term_mismatch(spark, d):
    """Frequent words of the benchmark as terms: each one's rendering is itself, one with ``ed`` will do, its plural is forbidden."""
    words = table(spark, d, "benchmark").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))).alias("term")).groupBy("term").count().where("count >= 2")
    terms = words.select("term", F.col("term").alias("preferred"), F.concat("term", F.lit("s")).alias("forbidden"), F.array(F.concat("term", F.lit("ed"))).alias("alternatives"))
    return glossary.term_mismatch(turns(spark, d).select("conv_id", "turn", "source", "target"), terms, ["conv_id", "turn"], "en", "en")


def _decisions(spark, d):
    """Events as a glossary's decisions: mostly exceptions, now and then a ruling, in two languages with a region each."""
    e = table(spark, d, "events")
    i = F.col("event_id")
    kind = F.when(i % 40 == 0, "deprecation").when(i % 30 == 1, "choice").when(i % 30 == 7, "override").otherwise("segment_exception")
    lang = F.when(i % 4 == 0, "de").when(i % 4 == 1, "fr").when(i % 4 == 2, "de-AT").otherwise("fr_CA")
    return e.select(i.alias("id"), (F.col("user_id") % 40).alias("term_id"), lang.alias("lang"), F.concat(F.lit("r"), i % 5).alias("chosen"), kind.alias("kind"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("decided_at"), F.when(i % 11 != 0, F.col("event_type")).alias("project"), F.col("user_id").alias("segment"))


def _variants(x):
    """A rendering for each text that was chosen in a language; some are forbidden."""
    seen = x.groupBy("term_id", "lang", F.col("chosen").alias("plain")).agg(F.min("id").alias("variant_id"))
    return seen.withColumn("forbidden", F.col("variant_id") % 4 == 0)


def preferred_variant(spark, d):
    x = _decisions(spark, d)
    return glossary.preferred_variant(_variants(x), x)


def exception_proposals(spark, d):
    x = _decisions(spark, d)
    return glossary.exception_proposals(x, _variants(x), x.select("term_id", (F.col("term_id") % 13 == 0).alias("deleted")).distinct())


def _flag_inputs(spark, d):
    e = table(spark, d, "events")
    key = F.col("user_id") % 200
    rendering = F.when(key % 3 == 0, "click").otherwise(F.col("event_type"))
    found = e.where("user_id % 7 <> 0").select(key.alias("term_key"), rendering.alias("rendering_key"), (F.col("value") / 500).alias("confidence"))
    keys = e.select(key.alias("term_key")).distinct()
    return keys, found, keys.where("term_key % 5 = 0").select("term_key", F.when(F.col("term_key") % 2 == 0, "click").otherwise("view").alias("preferred_key"))


def flag_terms(spark, d):
    out = glossary.flag_terms(*_flag_inputs(spark, d))
    return out.select("term_key", "renderings", F.array_join("reasons", ",").alias("reasons"))


def flag_unaligned(spark, d):
    keys, _, decided = _flag_inputs(spark, d)
    out = glossary.flag_terms(keys, None, decided)
    return out.select("term_key", "renderings", F.array_join("reasons", ",").alias("reasons"))


def changed_words(spark, d):
    rows = hashed_lines(spark, d).select(F.col("source").alias("file"), "hash", T.count_words(F.col("line")).alias("words"), "doc_id")
    return business.changed_words(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1").drop("doc_id"))


def client_rates(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("pair"), (F.col("n_nationkey") * 0.01).alias("rate"), (F.col("n_regionkey") * 5.0).alias("minimum"))
    own = table(spark, d, "customer").where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("pair")).agg(F.round(F.avg("c_acctbal") / 10000, 4).alias("rate"), F.lit(None).cast("double").alias("minimum"))
    return business.client_rates(n, own, ["pair"], ["rate", "minimum"])


def order_estimate(spark, d):
    files = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linestatus").alias("tgt_lang"), F.floor(F.col("l_quantity") * 10).alias("words"))
    rates = spark.createDataFrame([("O", 0.12, 40.0, 100), ("F", 0.09, None, None)], "tgt_lang string, rate double, minimum double, per_file long")
    return business.estimate(files, rates).select("order_id", "tgt_lang", F.col("words").cast("long").alias("words"), F.round("price", 4).alias("price"))


def deadline_agenda(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "submitted").when(F.col("o_orderstatus") == "F", "delivered").otherwise("in_progress")
    due = F.when(F.col("o_orderkey") % 11 != 0, F.to_date("o_orderdate"))
    return business.agenda(o.select("o_orderkey", status.alias("status"), due.alias("due_at")), F.lit(TODAY).cast("date")).select("o_orderkey", "status", "bucket")


def notices_due(spark, d):
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("due_at"), (F.col("o_orderdate") - F.expr("interval 2 days")).alias("created_at"))
    leads = spark.createDataFrame([(24,), (72,)], "lead_hours int")
    fired = table(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("job_id"), F.lit(24).alias("lead_hours"))
    return business.notices_due(jobs, leads, fired, F.lit(TODAY + " 00:00:00").cast("timestamp_ntz" if dict(jobs.dtypes)["due_at"] == "timestamp_ntz" else "timestamp")).select("job_id", "lead_hours", F.date_format("notice_at", "yyyy-MM-dd HH:mm:ss").alias("notice_at"))


def _tier_of(percent):
    return F.when(percent == 0, "exact").when(percent <= 2, "fuzzy_95_99").when(percent <= 4, "fuzzy_85_94").when(percent <= 6, "fuzzy_75_84").otherwise("no_match")


RATES = (("exact", 10_000), ("fuzzy_95_99", 30_000), ("fuzzy_85_94", 60_000), ("no_match", 120_000))


def tier_payable(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("vendor_id"), _tier_of(F.round(F.col("l_discount") * 100)).alias("tier"), F.col("l_quantity").cast("long").alias("words"))  # noqa: E741
    return business.payable(l, spark.createDataFrame(list(RATES), "tier string, micros long"), ["vendor_id"])


def currency_totals(spark, d):
    s = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    currency = F.when(F.col("n_regionkey") == 3, None).otherwise(F.concat(F.lit("C"), F.col("n_regionkey").cast("string")))
    micros = F.when(F.col("l_tax") > 0.01, F.round(F.col("l_extendedprice") * 100).cast("long") * 10_000)
    return business.currency_totals(s.select(currency.alias("currency"), micros.alias("micros"), (F.col("l_returnflag") == "R").alias("paid")))


def vendor_record(spark, d):
    status = F.when(F.col("l_returnflag") == "R", "declined").when(F.col("l_linestatus") == "F", "delivered").otherwise("accepted")
    a = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return business.vendor_record(a.select(F.col("l_suppkey").alias("vendor_id"), status.alias("status"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("deadline"), F.col("l_shipdate").alias("delivered_at")))


def eligibility(spark, d):
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "region").select("r_regionkey", "r_name")))
    capacity = F.when(F.col("s_acctbal") < 0, "away").when(F.col("s_acctbal") < 3000, "busy").otherwise("free")
    reasons = business.exclusion_reasons(F.col("s_nationkey") % 5 == F.col("r_regionkey"), F.col("s_suppkey") % 3 != 0, capacity, F.col("s_suppkey") % 7 != 0)
    return s.select("s_suppkey", "r_name", F.array_join(reasons, ",").alias("reasons"))


def status_counts(spark, d):
    o = table(spark, d, "orders")
    return business.status_counts(o, o.select("o_orderpriority"), spark.createDataFrame([("O",), ("F",), ("P",), ("X",)], "o_orderstatus string"), "o_orderpriority", "o_orderstatus")


def illegal_transitions(spark, d):
    """Users' events read as the states of an order."""
    states = {"view": "submitted", "click": "approved", "signup": "in_progress", "purchase": "delivered", "error": "cancelled"}
    state = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in states.items()])
    log = table(spark, d, "events").withColumn("state", state)
    return business.illegal_moves(log, business.order_moves(spark), "user_id", ["ts", "event_id"], "state").select("event_id", "from_state", "to_state")


def progress(spark, d):
    rows = lines(spark, d).select("source", T.count_words(F.col("line")).alias("words"), F.when(F.col("doc_id") % 3 == 0, "confirmed").otherwise("draft").alias("status"), (F.col("doc_id") % 10 == 9).alias("locked"))
    return business.progress(rows, "source")


def next_open(spark, d):
    rows = lines(spark, d).withColumn("status", F.when((F.col("doc_id") + F.col("ord")) % 3 == 0, "draft").otherwise("confirmed"))
    return qa.next_open(rows).select(*KEY, "next_open")


def payment_ledger(spark, d):
    return business.ledger(table(spark, d, "events").select((F.col("event_id") % 1000).alias("assignment_id"), "event_id", F.col("event_type").alias("kind")))


def membership_union(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("tenant"), F.col("c_name").alias("member"), F.lit("client").alias("role"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("tenant"), F.col("s_name").alias("member"), F.lit("vendor").alias("role"))
    return c.unionByName(s)


def fold_export(spark, d):
    rows = lines(spark, d).select("doc_id", "ord", F.col("line").alias("source"), F.when(F.col("ord") % 2 == 0, F.concat(F.lit("["), "line", F.lit("]"))).alias("target"))
    out = business.fold_file(rows, ["doc_id"])
    return out.select("doc_id", F.sha2("text", 256).alias("text_hash"), "translated", "segments")


def find_replace(spark, d):
    found = lines(spark, d).withColumn("n", F.regexp_count("line", F.lit("the")))
    return found.where("n > 0").select(*KEY, F.col("n").cast("long").alias("n"), F.sha2(F.replace("line", F.lit("the"), F.lit("THE")), 256).alias("replaced"))


def grid_filter(spark, d):
    hit = F.contains(F.lower("line"), F.lit("tion")) & (F.length("line") > 40)
    return lines(spark, d).where(hit).groupBy("source").agg(F.count(F.lit(1)).alias("shown"))


def csv_cells(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.csv_cell(F.col("text")), 256).alias("cell"))


def audit_chain(spark, d):
    """Every user's log, with the body of every event whose id is divisible by 1,000 changed after the fact."""
    e = table(spark, d, "events").select("user_id", "event_id", audit.canonical("event_id", "event_type", "props").alias("body"))
    log = audit.chained(e, "user_id", "event_id")
    forged = F.when(F.col("event_id") % 1000 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body"))
    return audit.verify_chain(log.withColumn("body", forged), "user_id", "event_id")


def panel_counts(spark, d):
    return views.panel_counts(qa_issues(spark, d), severities=("warning",), rules=("punct.brackets", "punct.terminal"))


def tier_forecast(spark, d):
    l = table(spark, d, "lineitem").select("l_suppkey", _tier_of(F.round(F.col("l_discount") * 100)).alias("tier"), F.col("l_quantity").cast("long").alias("words"))  # noqa: E741
    card = spark.createDataFrame([(t, m, "EUR") for t, m in RATES], "tier string, micros long, currency string")
    return views.tier_forecast(l, card, "l_suppkey")


def draft_selection(spark, d):
    out = views.draft_selection(statused(hashed_lines(spark, d)), memory_of(spark, d), KEY)
    return out.select(*KEY, F.sha2("plain", 256).alias("plain"), F.sha2("context", 256).alias("context"))


def source_preview(spark, d):
    return views.source_preview(lines(spark, d).select("doc_id", "ord", F.sha2("line", 256).alias("line")), "doc_id", "ord", "line")


def quote_lines(spark, d):
    orders = order_estimate(spark, d).groupBy("order_id").agg((F.sum("price") + F.when(F.col("order_id") % 3 == 0, 1.0).otherwise(0.001)).alias("price"))
    return views.quote_lines(order_estimate(spark, d), orders)


def term_entries(spark, d):
    x = _decisions(spark, d)
    return views.term_entries(_variants(x), glossary.preferred_variant(_variants(x), x))


def stale_scan(spark, d):
    return views.stale_uses(term_mismatch(spark, d))


def segment_sentences(spark, d):
    return segmentation.segment_texts(table(spark, d, "documents"))


def tmx_export(spark, d):
    v = line_pairs(spark, d).select((F.col("doc_id") * 100_000 + F.col("ord")).alias("tu_id"), F.array(F.struct(F.lit("en").alias("lang"), F.col("source").alias("plain")), F.struct(F.lit("xx").alias("lang"), F.col("target").alias("plain"))).alias("v"))
    v = v.select("tu_id", F.col("tu_id").cast("string").alias("uuid"), (F.col("tu_id") % 9 == 0).alias("deleted"), F.inline("v"))
    return writers.tmx_units(v).select("tu_id", F.sha2("value", 256).alias("unit"))


def pair_choices(spark, d):
    langs = table(spark, d, "documents").select("lang").distinct()
    return langs.select(F.col("lang").alias("src")).join(F.broadcast(langs.select(F.col("lang").alias("tgt"))), F.col("src") != F.col("tgt"))


_ALL = (
    normalize_hash, word_counts, repetition_analysis, exact_match, propagation, segment_context, context_match, ambiguous_siblings, fuzzy_match, pretranslate_summary, tier_analysis,
    concordance, term_document_frequency, vector_topk, unembedded, memory_merge, write_back_upsert, memory_languages, qa_issues, qa_inverted, qa_numbers, qa_marks, qa_consistency,
    qa_rule_counts, qa_tags, term_candidates, term_mismatch, preferred_variant, exception_proposals, flag_terms, flag_unaligned, changed_words, client_rates, order_estimate, deadline_agenda, notices_due,
    tier_payable, currency_totals, vendor_record, eligibility, status_counts, illegal_transitions, progress, next_open, payment_ledger, membership_union, fold_export, find_replace,
    grid_filter, csv_cells, audit_chain, panel_counts, tier_forecast, draft_selection, source_preview, quote_lines, term_entries, stale_scan, segment_sentences, tmx_export, pair_choices,
)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}
