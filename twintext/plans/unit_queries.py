"""Queries over tokens, memory units, glossaries, orders and logs, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twintext.functions import text as T
from twintext.functions import tokens as K
from twintext.operators import audit, business, glossary, matching, search, units, views
from twintext.plans.queries import KEY, hashed_lines, line_pairs, page_pairs, page_tokens, qa_issues, table
from twintext.plans.sql import HASHED, LINE_PAIRS, QA, words
from twintext.stages import materialise

def token_text(spark: SparkSession, d: str) -> DataFrame:
    p, t, f = page_tokens(spark, d), F.col("tokens"), F.col("formats")
    return p.select("page_id", F.sha2(K.plain_text(t), 256).alias("plain"), F.sha2(K.render(t, f), 256).alias("rendered"), F.size(F.filter(K.without_hidden(t, f), lambda x: x["t"] != "text")).cast("long").alias("visible_tags"), K.is_blank(t, f).alias("blank"))


def token_replace(spark, d):
    p = page_tokens(spark, d)
    found = K.replace_in_tokens(F.col("tokens"), F.col("formats"), K.find_pattern("THE", case=False), "$the")
    return p.select("page_id", found.alias("x")).select("page_id", F.col("x.n").cast("long").alias("n"), F.sha2(K.plain_text(F.col("x.tokens")), 256).alias("plain"))


def placed_matches(spark, d):
    """The next page's tokens as a memory's, placed on each page."""
    pairs = page_pairs(spark, d)
    memory = K.to_memory(F.col("target_tokens"), F.col("target_formats"))
    pairs = materialise(pairs.select("page_id", "tokens", "formats", memory.alias("memory")), "page-pairs")
    t, f = F.col("tokens"), F.col("formats")
    placed = pairs.select("page_id", K.place_match(F.col("memory"), t, f).alias("p"), K.slot_difference(K.slots(K.without_hidden(t, f), f), K.slots(F.col("memory"))).alias("difference"))
    return materialise(placed, "placed").select("page_id", F.col("p.tags_matched").alias("tags_matched"), "difference")


def confirmed_context(spark, d):
    rows = hashed_lines(spark, d).withColumn("confirmed", (F.col("doc_id") + F.col("ord")) % 3 == 0)
    return matching.confirmed_context(rows, hash_col="hash").select(*KEY, "prev_target", "next_target")


def _memory(spark: SparkSession, d: str, theirs: bool) -> units.Memory:
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")  # noqa: E741
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    k, mark = F.col("o_orderkey"), "!" if theirs else ""
    attrs = F.create_map(F.lit("p"), F.concat("o_orderpriority", F.lit(mark)), F.lit("t" if theirs else "o"), F.col("o_orderstatus"))
    rows = o.where("o_orderkey % 4 <> 1" if theirs else "o_orderkey % 3 <> 0")
    u = rows.select(k.alias("uuid"), (k % (5 if theirs else 4)).cast("int").alias("rev"), day("o_orderdate").alias("updated_at"), day("o_orderdate").alias("created_at"), F.concat("o_orderpriority", F.lit(mark)).alias("created_by"), (k % (13 if theirs else 11) == 0).alias("deleted"), attrs.alias("attrs"))
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    rows = l.where("l_orderkey % 4 <> 1" if theirs else "l_orderkey % 3 <> 0")
    last = F.max(F.struct("l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus")).alias("x")
    rows = rows.groupBy("l_orderkey", "l_linenumber").agg(last).select("l_orderkey", "l_linenumber", "x.*")
    text = F.col("l_linestatus" if theirs else "l_returnflag")
    v = rows.select(
        F.col("l_orderkey").alias("uuid"), F.concat(F.lit("l"), "l_linenumber").alias("lang"), (part % (3 if theirs else 2)).cast("int").alias("rev"), day("l_shipdate").alias("updated_at"), text.alias("tokens"), text.alias("plain"),
        F.sha2(text, 256).alias("hash"), F.when(supp % 3 == 0, F.lit("x")).alias("prev_hash"), F.lit(None).cast("string").alias("next_hash"), (supp % (4 if theirs else 5)).cast("int").alias("quality"),
        (part % (7 if theirs else 5)).alias("usage_count"), day("l_shipdate").alias("last_used_at"), day("l_shipdate").alias("created_at"),
    )
    h = v.where("quality = 1").select("uuid", "lang", F.lit(0).alias("rev"), F.concat("tokens", F.lit("0")).alias("tokens"), "quality")
    vec = v.where("quality > 1").select("uuid", "lang", F.array(F.col("quality").cast("float")).alias("vec"))
    profiles = table(spark, d, "nation").where("n_nationkey % 2 = 0" if theirs else "n_nationkey % 3 = 0").select(F.col("n_name").alias("lang"), F.concat(F.col("n_regionkey").cast("string"), F.when(F.col("n_nationkey") % 4 == 0, F.lit(mark)).otherwise(F.lit(""))).alias("delta"))
    return units.Memory(u, v, h, vec, profiles)


def unit_merge(spark, d):
    out = units.merge_units(_memory(spark, d, False).units, _memory(spark, d, True).units)
    return out.select("uuid", "rev", "updated_at", "created_at", "created_by", "deleted", *[F.col("attrs")[x].alias(f"attr_{x}") for x in "pot"], "is_new", "retired")


def variant_merge(spark, d):
    out = units.merge_variants(_memory(spark, d, False).variants, _memory(spark, d, True).variants)
    return out.select("uuid", "lang", "rev", "tokens", "quality", "usage_count", "outcome")


def history_merge(spark, d):
    return units.merge_history(_memory(spark, d, False), _memory(spark, d, True)).select("uuid", "lang", "rev", "tokens", "quality", "origin", "conflict")


def vector_merge(spark, d):
    return units.merge_vectors(_memory(spark, d, False), _memory(spark, d, True)).select("uuid", "lang")


def profile_merge(spark, d):
    return units.merge_profiles(_memory(spark, d, False).profiles, _memory(spark, d, True).profiles)


def merge_counts(spark, d):
    return units.merge_counts(_memory(spark, d, False), _memory(spark, d, True))


def unit_edits(spark, d):
    """One edit for each part: some empty, too long, stale, unchanged, of tagged or retired units, or of none."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    name = K.token("text", F.col("p_name"))
    tokens = F.when(F.col("p_partkey") % 7 == 0, F.array(K.token("ph", id_=F.lit(1), k=F.lit("br")), name)).otherwise(F.array(name))
    v = p.where("p_partkey % 17 <> 0").select(F.col("p_partkey").alias("uuid"), F.lit("en").alias("lang"), F.col("p_size").alias("rev"), tokens.alias("tokens"), T.normalize(F.col("p_name")).alias("plain"), F.lit(1).alias("quality"))
    u = p.select(F.col("p_partkey").alias("uuid"), (F.col("p_partkey") % 11 == 0).alias("deleted"))
    text = F.when(F.col("p_partkey") % 9 == 0, "  ").when(F.col("p_partkey") % 8 == 0, F.repeat(F.lit("long "), 1001)).when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(F.upper("p_name"))
    e = p.select(F.col("p_partkey").alias("uuid"), F.lit("en").alias("lang"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("base_rev"), text.alias("text"))
    return units.edit_reasons(e, v, u).select("uuid", "reason")


def concordance_pairs(spark, d):
    pairs = line_pairs(spark, d).select((F.col("doc_id") * 100_000 + F.col("ord")).alias("tu_id"), "source", "target")
    side = lambda n, lang, c: F.struct((F.col("tu_id") * 2 + n).alias("tuv_id"), F.lit(lang).alias("lang"), F.col(c).alias("plain"))
    v = pairs.select("tu_id", F.explode(F.array(side(0, "en-GB", "source"), side(1, "xx", "target"))).alias("v")).select("tu_id", "v.*")
    v = v.select("*", (F.col("tu_id") % 2).cast("int").alias("priority"), F.lit(1).alias("quality"), F.lit("2024").alias("updated_at"), (F.col("tu_id") % 10 == 9).alias("deleted"))
    out = search.concordance_pairs(v, "the", "xx", "en", 40)
    return out.select("rank", "tu_id", F.sha2("plain", 256).alias("plain"), F.sha2("other", 256).alias("other"), "more")


def find_rendering(spark, d):
    p = table(spark, d, "part")
    form = lambda n, lang, text: F.struct(F.lit(n).alias("variant_id"), F.lit(lang).alias("lang"), text.alias("plain"))
    forms = p.select((F.col("p_size") % 3).alias("priority"), F.col("p_partkey").alias("term_id"), (F.col("p_partkey") % 10 == 0).alias("deleted"), F.explode(F.array(form(1, "en", F.lower("p_type")), form(2, "de-AT", F.lower("p_brand")))).alias("v"))
    variants = forms.select("priority", "term_id", "deleted", "v.*")
    preferred = variants.where("variant_id = 2").select("priority", "term_id", "lang", "variant_id")
    wanted = p.select("p_type").distinct().select("p_type", F.lit("en-US").alias("src_lang"), F.lit("de").alias("tgt_lang"), F.concat(F.lit(" "), "p_type").alias("text"))
    return glossary.find_rendering(wanted, variants, preferred, ["p_type"])


def origin_counts(spark, d):
    return views.origin_counts(table(spark, d, "events").select(F.nullif(F.col("event_type"), F.lit("error")).alias("origin")))


def panel_issues(spark, d):
    rows = qa_issues(spark, d).withColumn("dismissed", F.col("doc_id") % 2 == 0)
    return views.panel_issues(rows, KEY, ("warning", "error")).select(*KEY, "rule", "severity")


def segment_grid(spark, d):
    pairs = line_pairs(spark, d).withColumn("status", F.when(F.col("doc_id") % 3 == 0, "confirmed").otherwise("draft")).withColumn("origin", F.when(F.col("ord") % 2 == 0, "tm_exact"))
    rows = pairs.select("*", (F.col("doc_id") * 100_000 + F.col("ord")).alias("id"), F.when(F.col("ord") % 5 == 0, "error").when(F.col("ord") % 5 == 1, "info").alias("worst"))
    return views.grid(rows, ("draft",), "tm_exact", "errors", "THE", 1).select(*KEY)


def order_list(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("client_id"), F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"))
    events = table(spark, d, "events").select((F.col("event_id") % 5000).alias("order_id"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    return business.orders_with_events(business.order_list(o, ("O", "P")), events)


def _ledger(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("assignment_id"), (F.col("o_custkey") % 7).alias("vendor_id"), F.to_date("o_orderdate").alias("at"), F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("C"), (F.col("o_orderkey") % 3).cast("string"))).alias("currency"), (F.col("o_orderkey") % 1000 * 10_000).alias("micros"))
    payments = table(spark, d, "events").select((F.col("event_id") % 9000).alias("assignment_id"), "event_id", F.when(F.col("event_type") == "purchase", "paid").otherwise("unpaid").alias("kind"))
    return a, payments


def ledger_lines(spark, d):
    a, payments = _ledger(spark, d)
    return business.ledger_lines(a, payments, vendor=3, since=F.lit("1995-01-01").cast("date")).select("assignment_id", "payment", "micros")


def payable_lines(spark, d):
    return business.payable_lines(business.ledger_lines(*_ledger(spark, d)))


def _log(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"), F.concat(F.lit("name "), F.col("user_id").cast("string")).alias("actor_label"), F.col("event_type").alias("subject_type"), (F.col("user_id") % 50).cast("string").alias("subject_id"), F.when(F.col("event_id") % 10 != 0, F.col("event_id") - F.col("event_id") % 10).alias("batch_id"), (F.col("user_id") % 5).alias("tenant_id"), F.col("props").alias("detail"))


def audit_subject(spark, d):
    return audit.by_subject(_log(spark, d), "purchase", "7").select("id", "actor")


def audit_batch(spark, d):
    return audit.by_batch(_log(spark, d), 500).select("id", "actor")


def audit_page(spark, d):
    return audit.page_of(_log(spark, d), 3, before=5000).select("id", "actor")


def audit_changes(spark, d):
    """A later snapshot in which some events are gone, changed, or had their label erased or renamed."""
    log = _log(spark, d)
    after = audit.erased(log, "u7").where("id % 997 <> 0")
    after = after.withColumn("detail", F.when(F.col("id") % 991 == 0, F.lit("{}")).otherwise(F.col("detail"))).withColumn("actor_label", F.when(F.col("id") % 983 == 0, F.lit("else")).otherwise(F.col("actor_label")))
    return audit.forbidden_changes(log, after)


#: States that orders are read as.
ORDER_STATES = ("submitted", "approved", "in_progress", "delivered", "cancelled", "pool_open", "claimed", "reviewed")


def next_statuses(spark, d):
    """Orders by where their state can go next: O is submitted, P in progress, F delivered, others are read by their customer."""
    nexts = business.next_statuses(business.order_moves(spark).unionByName(business.assignment_moves(spark).drop("party")))
    names = F.array(*[F.lit(x) for x in ORDER_STATES])
    state = F.when(F.col("o_custkey") % 3 == 0, F.get(names, (F.col("o_custkey") % len(ORDER_STATES)).cast("int"))).when(F.col("o_orderstatus") == "O", "submitted").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("delivered")
    orders = table(spark, d, "orders").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("orders"))
    return orders.join(F.broadcast(nexts), "state", "left").select("state", "next", "terminal", "orders")


def assignment_moves(spark, d):
    """Orders' lines read as the states of assignments, each moved by a party."""
    names = [*dict.fromkeys(s for a, b, _ in business.ASSIGNMENT_MOVES for s in (a, b))]
    state = F.element_at(F.lit(names).cast("array<string>"), (F.col("l_partkey") % len(names)).cast("int") + 1)
    log = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", state.alias("state"), F.when(F.col("l_suppkey") % 2 == 0, "pm").otherwise("vendor").alias("who"), "l_partkey", "l_suppkey")
    return business.illegal_moves(log, business.assignment_moves(spark), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "state", "who").groupBy("from_state", "to_state", "party").agg(F.count(F.lit(1)).alias("n"))


def field_texts(spark, d):
    c = table(spark, d, "customer")
    email = F.concat(F.lit("  "), "c_name", F.lit("@Example.ORG "))
    return c.select("c_custkey", T.slugify(F.concat("c_name", F.lit("  & Söhne!"))).alias("slug"), T.is_slug(T.slugify(F.col("c_name"))).alias("is_slug"), T.email_key(email).alias("email"), T.term_key(F.concat("c_mktsegment", F.lit(" “X”"))).alias("term"), T.format_micros(F.round(F.col("c_acctbal") * 100).cast("long") * 10_000).alias("money"))


def date_texts(spark, d):
    o = table(spark, d, "orders")
    tmx = T.iso_to_tmx(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    text = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.date_format("o_orderdate", "yyyy-"), F.lit("02-30"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", tmx.alias("tmx"), T.tmx_to_iso(tmx).alias("iso"), T.is_calendar_date(text).alias("is_date"), business.days_to_pay(F.to_date("o_orderdate"), F.lit("1996-01-01").cast("date")).cast("long").alias("days"))


def segment_word_counts(spark, d):
    rows = hashed_lines(spark, d)
    return rows.groupBy("source").agg(F.sum(T.segment_words(F.col("line"), F.col("doc_id") % 4 == 0, F.col("ord") % 5 == 4)).alias("words"), F.count(F.when(business.file_problem(F.octet_length("line"), F.col("line"), F.col("lang")).isNotNull(), 1)).alias("problems"))


def file_sums(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_partkey") % 50 != 0, F.col("l_quantity").cast("long")).alias("words"))
    return rows.groupBy("l_orderkey").agg(business.complete_sum("words").alias("words"))


_ALL = (
    token_text, token_replace, placed_matches, confirmed_context, unit_merge, variant_merge, history_merge, vector_merge, profile_merge, merge_counts, unit_edits, concordance_pairs, find_rendering,
    origin_counts, panel_issues, segment_grid, order_list, ledger_lines, payable_lines, audit_subject, audit_batch, audit_page, audit_changes, next_statuses, assignment_moves, field_texts, date_texts,
    segment_word_counts, file_sums,
)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


_MEM = """li AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey DESC, l_suppkey DESC, l_shipdate DESC, l_returnflag DESC, l_linestatus DESC),
ou AS (SELECT o_orderkey AS k, (o_orderkey % 4)::INT AS rev, strftime(o_orderdate, '%Y-%m-%d') AS at, o_orderpriority AS p, o_orderstatus AS s, o_orderkey % 11 = 0 AS del FROM orders WHERE o_orderkey % 3 <> 0),
tu AS (SELECT o_orderkey AS k, (o_orderkey % 5)::INT AS rev, strftime(o_orderdate, '%Y-%m-%d') AS at, o_orderpriority || '!' AS p, o_orderstatus AS s, o_orderkey % 13 = 0 AS del FROM orders WHERE o_orderkey % 4 <> 1),
u AS (SELECT coalesce(o.k, t.k) AS uuid, o.k IS NOT NULL AS ho, t.k IS NOT NULL AS ht, o.rev AS orev, t.rev AS trev, o.at AS oat, t.at AS tat, o.p AS op, t.p AS tp, o.s AS os, t.s AS ts, o.del AS od, t.del AS td FROM ou o FULL JOIN tu t ON o.k = t.k),
ov AS (SELECT l_orderkey AS uuid, 'l' || l_linenumber AS lang, (l_partkey % 2)::INT AS rev, strftime(l_shipdate, '%Y-%m-%d') AS at, l_returnflag AS tok, CASE WHEN l_suppkey % 3 = 0 THEN 'x' END AS prev, (l_suppkey % 5)::INT AS q, l_partkey % 5 AS uses FROM li WHERE l_orderkey % 3 <> 0),
tv AS (SELECT l_orderkey AS uuid, 'l' || l_linenumber AS lang, (l_partkey % 3)::INT AS rev, strftime(l_shipdate, '%Y-%m-%d') AS at, l_linestatus AS tok, CASE WHEN l_suppkey % 3 = 0 THEN 'x' END AS prev, (l_suppkey % 4)::INT AS q, l_partkey % 7 AS uses FROM li WHERE l_orderkey % 4 <> 1),
v AS (SELECT coalesce(o.uuid, t.uuid) AS uuid, coalesce(o.lang, t.lang) AS lang, o.uuid IS NOT NULL AS ho, t.uuid IS NOT NULL AS ht, o.rev AS orev, t.rev AS trev, o.tok AS otok, t.tok AS ttok, o.q AS oq, t.q AS tq, o.uses AS ouse, t.uses AS tuse,
  CASE WHEN o.uuid IS NULL THEN 'add' WHEN t.uuid IS NULL THEN 'keep' WHEN t.rev > o.rev OR (t.rev = o.rev AND (t.at > o.at OR (t.at = o.at AND (t.tok > o.tok OR (t.tok = o.tok AND (t.q > o.q OR (t.q = o.q AND coalesce(t.prev, '') > coalesce(o.prev, '')))))))) THEN 'src' ELSE 'dst' END AS outcome,
  o.uuid IS NOT NULL AND t.uuid IS NOT NULL AND (o.tok <> t.tok OR o.q <> t.q OR o.prev IS DISTINCT FROM t.prev) AS differs FROM ov o FULL JOIN tv t ON o.uuid = t.uuid AND o.lang = t.lang),
lost AS (SELECT uuid, lang, CASE outcome WHEN 'src' THEN orev ELSE trev END AS rev, CASE outcome WHEN 'src' THEN otok ELSE ttok END AS tokens, CASE outcome WHEN 'src' THEN oq ELSE tq END AS quality FROM v WHERE differs),
hist AS (SELECT uuid, lang, 0 AS rev, tok || '0' AS tokens, q AS quality, 0 AS rank FROM ov WHERE q = 1 UNION ALL SELECT *, 1 FROM lost UNION ALL SELECT uuid, lang, 0, tok || '0', q, 2 FROM tv WHERE q = 1),
h AS (SELECT uuid, lang, rev, arg_min(tokens, (rank, tokens, quality)) AS tokens, arg_min(quality, (rank, tokens, quality)) AS quality, min(rank) AS rank, count(DISTINCT (tokens, quality)) > 1 AS conflict FROM hist GROUP BY 1, 2, 3)"""
_UNITS = "SELECT uuid, greatest(orev, trev) AS rev, greatest(oat, tat) AS updated_at, least(oat, tat) AS created_at, least(op, tp) AS created_by, coalesce(od, FALSE) OR coalesce(td, FALSE) AS deleted, CASE WHEN ho AND ht THEN CASE WHEN trev > orev OR (trev = orev AND tat >= oat) THEN tp ELSE op END ELSE coalesce(op, tp) END AS attr_p, os AS attr_o, ts AS attr_t, NOT ho AS is_new, coalesce(NOT od, FALSE) AND coalesce(td, FALSE) AS retired FROM u"
_LOG = """log AS (SELECT event_id AS id, 'u' || user_id AS actor, event_type AS subject_type, (user_id % 50)::VARCHAR AS subject_id, CASE WHEN event_id % 10 <> 0 THEN event_id - event_id % 10 END AS batch_id, user_id % 5 AS tenant_id FROM events)"""
_STATES = [*dict.fromkeys(s for a, b, _ in business.ASSIGNMENT_MOVES for s in (a, b))]
_LEDGER = """a AS (SELECT o_orderkey AS assignment_id, o_custkey % 7 AS vendor_id, o_orderdate::DATE AS day, CASE WHEN o_orderkey % 4 <> 0 THEN 'C' || o_orderkey % 3 END AS currency, o_orderkey % 1000 * 10000 AS micros FROM orders),
p AS (SELECT event_id % 9000 AS assignment_id, arg_max(CASE WHEN event_type = 'purchase' THEN 'paid' ELSE 'unpaid' END, event_id) AS payment FROM events GROUP BY 1),
led AS (SELECT a.*, coalesce(payment, 'unpaid') AS payment FROM a LEFT JOIN p USING (assignment_id))"""

SQL = {
    "confirmed_context": f"""WITH {HASHED}, c AS (SELECT *, CASE WHEN (doc_id + ord) % 3 = 0 THEN hash END AS known FROM hashed)
SELECT doc_id, ord, last_value(known IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_target,
first_value(known IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_target FROM c""",
    "unit_merge": f"WITH {_MEM} {_UNITS}",
    "variant_merge": f"""WITH {_MEM} SELECT uuid, lang, CASE WHEN outcome IN ('add', 'src') THEN trev ELSE orev END + (differs AND orev = trev)::INT AS rev, CASE WHEN outcome IN ('add', 'src') THEN ttok ELSE otok END AS tokens,
CASE WHEN outcome IN ('add', 'src') THEN tq ELSE oq END AS quality, greatest(ouse, tuse) AS usage_count, outcome FROM v""",
    "history_merge": f"WITH {_MEM} SELECT uuid, lang, rev, tokens, quality, ['held', 'retained', 'copied'][rank + 1] AS origin, conflict FROM h",
    "vector_merge": f"WITH {_MEM} SELECT uuid, lang FROM v WHERE ho AND oq > 1 AND NOT (outcome = 'src' AND otok <> ttok)",
    "profile_merge": """WITH o AS (SELECT n_name AS lang, n_regionkey::VARCHAR AS delta FROM nation WHERE n_nationkey % 3 = 0), t AS (SELECT n_name AS lang, n_regionkey || CASE WHEN n_nationkey % 4 = 0 THEN '!' ELSE '' END AS delta FROM nation WHERE n_nationkey % 2 = 0)
SELECT coalesce(o.lang, t.lang) AS lang, coalesce(o.delta, t.delta) AS delta, CASE WHEN o.delta <> t.delta THEN 'segmentation rules for "' || o.lang || '" differ; ours were kept' END AS warning FROM o FULL JOIN t ON o.lang = t.lang""",
    "merge_counts": f"""WITH {_MEM}, a AS ({_UNITS}) SELECT (SELECT count(*) FILTER (is_new) FROM a) AS units_added, (SELECT count(*) FILTER (retired) FROM a) AS tombstones,
count(*) FILTER (outcome = 'add') AS variants_added, count(*) FILTER (outcome = 'src' AND differs) AS variants_replaced, count(*) FILTER (outcome = 'dst' AND differs) AS variants_kept,
(SELECT count(*) FILTER (rank = 1) FROM h) AS history_retained, (SELECT count(*) FILTER (rank = 2) FROM h) AS history_copied, (SELECT count(*) FILTER (conflict) FROM h) AS history_conflicts FROM v""",
    "unit_edits": f"""SELECT p_partkey AS uuid, CASE WHEN p_partkey % 9 = 0 THEN 'blank' WHEN p_partkey % 8 = 0 THEN 'too_long' WHEN p_partkey % 17 = 0 OR p_partkey % 11 = 0 THEN 'not_found' WHEN p_partkey % 5 = 0 THEN 'stale' WHEN p_partkey % 7 = 0 THEN 'tagged'
WHEN p_partkey % 4 = 0 OR p_name = upper(p_name) THEN 'unchanged' END AS reason FROM part""",
    "concordance_pairs": f"""WITH {LINE_PAIRS}, t AS (SELECT doc_id * 100000 + ord AS tu_id, source, target FROM line_pairs WHERE (doc_id * 100000 + ord) % 10 <> 9),
hits AS (SELECT *, row_number() OVER (ORDER BY tu_id % 2, tu_id DESC)::INT AS rank, count(*) OVER () > 40 AS more FROM t WHERE contains(' ' || lower(strip_accents(array_to_string(regexp_extract_all(target, '[\\p{{L}}\\p{{M}}\\p{{N}}]+'), ' '))) || ' ', ' the '))
SELECT rank, tu_id, sha256(target) AS plain, sha256(source) AS other, more FROM hits WHERE rank <= 40""",
    "find_rendering": """WITH t AS (SELECT p_size % 3 AS priority, p_partkey AS term_id, lower(p_type) AS s, lower(p_brand) AS r FROM part WHERE p_partkey % 10 <> 0), k AS (SELECT DISTINCT p_type FROM part)
SELECT p_type, min((priority, term_id, r))[1] AS priority, min((priority, term_id, r))[2] AS term_id, min((priority, term_id, r))[3] AS rendering FROM k JOIN t ON t.s = lower(p_type) GROUP BY p_type""",
    "origin_counts": "SELECT CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS origin, count(*) AS n FROM events GROUP BY 1",
    "panel_issues": f"WITH {QA} SELECT doc_id, ord, rule, severity FROM issues WHERE severity IN ('warning', 'error') AND doc_id % 2 <> 0",
    "segment_grid": f"""WITH {LINE_PAIRS} SELECT doc_id, ord FROM line_pairs WHERE (doc_id % 3 <> 0 AND ord % 2 = 0 AND ord % 5 = 0 AND (contains(lower(source), 'the') OR contains(lower(target), 'the'))) OR doc_id * 100000 + ord = 1""",
    "order_list": """WITH e AS (SELECT event_id % 5000 AS order_id, count(*) AS events, arg_max(event_type, event_id) AS last_event FROM events GROUP BY 1)
SELECT o_orderkey AS order_id, o_custkey AS client_id, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS created_at, coalesce(events, 0) AS events, last_event FROM orders LEFT JOIN e ON order_id = o_orderkey WHERE o_orderstatus IN ('O', 'P')""",
    "ledger_lines": f"WITH {_LEDGER} SELECT assignment_id, payment, micros FROM led WHERE vendor_id = 3 AND day >= DATE '1995-01-01'",
    "payable_lines": f"WITH {_LEDGER} SELECT currency, payment, count(*) AS n, sum(micros)::BIGINT AS micros FROM led GROUP BY 1, 2",
    "audit_subject": f"WITH {_LOG} SELECT id, actor FROM log WHERE subject_type = 'purchase' AND subject_id = '7'",
    "audit_batch": f"WITH {_LOG} SELECT id, actor FROM log WHERE batch_id = 500 OR id = 500",
    "audit_page": f"WITH {_LOG} SELECT id, actor FROM log WHERE tenant_id = 3 AND id < 5000 ORDER BY id DESC LIMIT 100",
    "audit_changes": "SELECT event_id AS id, CASE WHEN event_id % 997 = 0 THEN 'deleted' ELSE 'updated' END AS change FROM events WHERE event_id % 997 = 0 OR (event_id % 991 = 0 AND props <> '{}') OR event_id % 983 = 0",
    "next_statuses": f"""WITH m(a, b) AS (VALUES ('submitted', 'approved'), ('submitted', 'cancelled'), ('approved', 'in_progress'), ('approved', 'cancelled'), ('in_progress', 'delivered'), ('in_progress', 'cancelled'),
('offered', 'accepted'), ('offered', 'declined'), ('pool_open', 'claimed'), ('claimed', 'accepted'), ('claimed', 'declined'), ('accepted', 'in_progress'), ('delivered', 'reviewed')),
s AS (SELECT DISTINCT unnest([a, b]) AS state FROM m), n AS (SELECT state, coalesce(string_agg(DISTINCT b, ',' ORDER BY b), '') AS next, count(b) = 0 AS terminal FROM s LEFT JOIN m ON a = state GROUP BY state),
o AS (SELECT CASE WHEN o_custkey % 3 = 0 THEN {list(ORDER_STATES)}[(o_custkey % {len(ORDER_STATES)})::INT + 1] WHEN o_orderstatus = 'O' THEN 'submitted' WHEN o_orderstatus = 'P' THEN 'in_progress' ELSE 'delivered' END AS state, count(*) AS orders FROM orders GROUP BY 1)
SELECT state, next, terminal, orders FROM o LEFT JOIN n USING (state)""",
    "assignment_moves": f"""WITH l AS (SELECT l_orderkey, {_STATES}[(l_partkey % {len(_STATES)})::INT + 1] AS st, CASE WHEN l_suppkey % 2 = 0 THEN 'pm' ELSE 'vendor' END AS party, l_linenumber, l_partkey, l_suppkey FROM lineitem),
w AS (SELECT *, lag(st) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS before FROM l)
SELECT before AS from_state, st AS to_state, party, count(*) AS n FROM w WHERE before IS NOT NULL AND before <> st AND (before, st, party) NOT IN ({', '.join(str(m) for m in business.ASSIGNMENT_MOVES)}) GROUP BY 1, 2, 3""",
    "field_texts": f"""SELECT c_custkey, trim(regexp_replace(lower(strip_accents(c_name || '  & Söhne!')), '[^a-z0-9]+', '-', 'g'), '-') AS slug, TRUE AS is_slug, lower(c_name) || '@example.org' AS email, lower(c_mktsegment) || ' "x"' AS term,
CASE WHEN round(c_acctbal * 100) < 0 THEN '-' ELSE '' END || (abs(round(c_acctbal * 100)::BIGINT) // 100) || '.' || lpad((abs(round(c_acctbal * 100)::BIGINT) % 100)::VARCHAR, 2, '0') AS money FROM customer""",
    "date_texts": """SELECT o_orderkey, strftime(o_orderdate, '%Y%m%dT%H%M%SZ') AS tmx, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS iso, o_orderkey % 5 <> 0 AS is_date,
CASE WHEN o_orderdate::DATE <= DATE '1996-01-01' THEN DATE '1996-01-01' - o_orderdate::DATE END AS days FROM orders""",
    "segment_word_counts": f"""WITH {HASHED}, n AS (SELECT source, doc_id, ord, {words('line')} AS w, regexp_matches(line, '[\\x00-\\x08\\x0E-\\x1F]') AS bad FROM hashed)
SELECT source, coalesce(sum(w) FILTER (doc_id % 4 <> 0 AND ord % 5 <> 4), 0)::BIGINT AS words, count(*) FILTER (bad) AS problems FROM n GROUP BY source""",
    "file_sums": "SELECT l_orderkey, CASE WHEN count(*) FILTER (l_partkey % 50 = 0) = 0 THEN sum(l_quantity::BIGINT)::BIGINT END AS words FROM lineitem GROUP BY 1",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
