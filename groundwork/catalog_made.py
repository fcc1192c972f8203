"""Registered queries over answers, packages and documents that are made from the tables, so that SQL alone can say what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import problems, sinks
from .catalog import _BASE, _audited, flagship
from .functions.kernels import fold_function
from .operators import drafts, grounding as g
from .operators import evaluation as ev
from .plans import audit as plan
from .plans import orders, results
from .registry import query
from .runtime import by_key, shared_folder, table
from .sources import corpus, generation, packages

#: The order answers as SQL writes them, and where segments and tokens of each lie.
_TEXTS = _BASE + r"""
, txt as (select *, length(q::varchar) as lq, length(p) as lp, case k
    when 0 then 'The parcel weighs ' || q || ' kg.' when 1 then 'The parcel weighs ' || (q + 700) || ' kg.' when 2 then 'The parcel weighs ' || q || ' mg.'
    when 3 then 'It left on ' || d || ' and cost $' || p || '.' when 4 then 'It left on 1901-02-03 in a rush.' when 5 then 'The parcel went out as planned.'
    when 6 then 'The parcel weighs ' || q || ' kg. It left on ' || d || '. It holds 98765 bolts.'
    when 7 then '```' || chr(10) || 'weight = ' || q || chr(10) || '```' when 8 then '# Weight ' || q || ' kg' || chr(10) || '- left on ' || d || chr(10) || '- cost $' || p
    else 'The parcel weighs ' || (q + 900) || ' kg and left on ' || d || '. Nothing else is known.' end as answer from facts),
spans as (
    select pkg, 0 as seg, 0 as a, case when k = 6 then 22 + lq when k = 8 then 12 + lq when k = 9 then 48 else length(answer) end as b from txt
    union all select pkg, 1, case k when 6 then 23 + lq when 8 then 13 + lq else 49 end, case k when 6 then 45 + lq when 8 then 33 + lq else 71 end from txt where k in (6, 8, 9)
    union all select pkg, 2, case k when 6 then 46 + lq else 34 + lq end, case k when 6 then 67 + lq else 42 + lq + lp end from txt where k in (6, 8)),
tokens as (
    select t.*, case when k in (0, 1, 2) then 18 when k in (3, 4) then case tok when 0 then 11 else 31 end
      when k = 6 then case t.seg when 0 then 18 when 1 then 34 + lq else 55 + lq end when k = 8 then case t.seg when 0 then 9 when 1 then 23 + lq else 41 + lq end
      else case tok when 0 then 18 else 37 end end as a
    from token t join txt on txt.pkg = t.pkg),
found as (
    select t.*, l.item, case t.kind when 'quantity' then 18 when 'date' then 34 + length(l.q::varchar) else 60 + length(l.q::varchar) end as pos
    from tokens t join line l on l.pkg = t.pkg and ((t.kind = 'quantity' and t.text = l.q || ' kg') or (t.kind = 'date' and t.text = l.d) or (t.kind = 'money' and t.text = '$' || l.p)))
"""


@query(_TEXTS + """
select pkg as audit, seg, tok, text, a as "start", a + length(text) as "end", 'line-' || item as item_id, 'order-' || pkg || '-' || item as document_id, pos as place_start,
  pos + length(text) as place_end, case when item % 3 = 0 then 'interpretation' else 'fact' end as layer
from found
""")
def locations_orders(spark, sf_dir):
    """PRJ1, MAT2, JN1, ORD1: where tokens stand in answers and in evidence, to the character."""
    admitted = plan.admit(orders.answers(spark, sf_dir))
    tokens = g.placed_tokens(plan.segments_of(admitted), orders.evidence(spark, sf_dir))
    rows = tokens.select("audit", "seg", "tok", "text", "start", "end", F.explode("locations").alias("l"))
    long = lambda c, name: F.col(c).cast("long").alias(name)
    return rows.select(
        "audit", "seg", "tok", "text", long("start", "start"), long("end", "end"), "l.item_id", "l.document_id", long("l.start", "place_start"), long("l.end", "place_end"), "l.layer",
    )


_REPORT = (
    "struct<contract:string,report_id:string,audited:struct<response_hash:string>,counts:struct<grounded_share:double>,"
    "segments:array<struct<segment_id:string,span:array<int>,verdict:string,particulars:array<struct<text:string,standing:string,span:array<int>>>>>>"
)


@query(_TEXTS + """
select s.pkg as audit, 'seg_00' || (s.seg + 1) as segment_id, cast(s.a as bigint) as "start", cast(s.b as bigint) as "end", seg.verdict, 'sha256:' || sha256(txt.answer) as response_hash,
  string_agg(t.text || case when t.places > 0 then ' grounded ' else ' floating ' end || t.a, '; ' order by t.tok) as tokens
from spans s join seg on seg.pkg = s.pkg and seg.seg = s.seg join txt on txt.pkg = s.pkg left join tokens t on t.pkg = s.pkg and t.seg = s.seg group by all
""")
def report_documents_orders(spark, sf_dir):
    """OP1, SNK1, AGG15, ORD2, WIN5, PRJ1: published documents, read back field by field."""
    documents = sinks.rendered(flagship(spark, sf_dir), "json").select("audit", F.from_json("document", _REPORT).alias("r"))
    rows = documents.select("audit", "r.audited.response_hash", F.explode("r.segments").alias("s"))
    told = F.array_join(F.transform("s.particulars", lambda t: F.concat(t["text"], F.lit(" "), t["standing"], F.lit(" "), t["span"][0].cast("string"))), "; ")
    return rows.select("audit", "s.segment_id", F.col("s.span")[0].cast("long").alias("start"), F.col("s.span")[1].cast("long").alias("end"), "s.verdict", "response_hash", told.alias("tokens"))


@query(_TEXTS + """
, per as (select pkg, string_agg(text, '; ' order by seg, tok) filter (where places > 0) as up, string_agg(text, '; ' order by seg, tok) filter (where places = 0) as down,
    count(*) filter (where places > 0) / count(*) as share from token group by pkg),
skip as (select pkg, string_agg('seg_00' || (seg + 1) || ': ' || case when verdict = 'unchecked' then 'not_prose' else 'no_particulars' end, '; ' order by seg) as skipped
  from seg where verdict in ('unbearing', 'unchecked') group by pkg),
near as (select distinct pkg, text from token where places = 0 and kind in ('quantity', 'date') and not exists (select 1 from facts f where f.pkg = token.pkg and f.k = 2 and f.same_q = 1))
select f.pkg as audit, per.share as grounded_share, coalesce(per.up, '') as grounded, coalesce(per.down, '') as floating, coalesce((select string_agg(text, '; ' order by text) from near where near.pkg = f.pkg), '') as near,
  coalesce(skip.skipped, '') as unchecked, exists (select 1 from seg where seg.pkg = f.pkg and seg.verdict in ('floating', 'contradicted')) as has_findings,
  cast((select count(*) from seg where seg.pkg = f.pkg and seg.verdict <> 'unchecked') as bigint) as examined
from facts f left join per on per.pkg = f.pkg left join skip on skip.pkg = f.pkg
""")
def accessors_orders(spark, sf_dir):
    """OP5, PRJ6, PRJ7: what a result gives of its report."""
    rows = results.accessors(flagship(spark, sf_dir))
    joined = lambda c: F.array_join(c, "; ")
    near = joined(F.array_sort(F.map_keys("nearby")))
    return rows.select("audit", "grounded_share", joined("grounded").alias("grounded"), joined("floating").alias("floating"), near.alias("near"), joined("unchecked").alias("unchecked"), "has_findings", F.col("examined").cast("long").alias("examined"))


@query(_TEXTS + """
select t.pkg as audit, 'seg_00' || (t.seg + 1) as segment_id, t.text, string_agg('order-' || t.pkg || '-' || item || '[' || pos || ':' || (pos + length(t.text)) || ']', '; ' order by item) as places,
  bool_and(item % 3 = 0) as in_an_interpretation
from found t join seg on seg.pkg = t.pkg and seg.seg = t.seg where verdict not in ('floating', 'contradicted') group by t.pkg, t.seg, t.tok, t.text
""")
def traced_orders(spark, sf_dir):
    """PRJ10, PRJ11: where the grounded tokens of segments without findings stand."""
    rows = results.traced(flagship(spark, sf_dir, neighbours=False))
    return rows.select("audit", "segment_id", "text", F.array_join("places", "; ").alias("places"), "in_an_interpretation")


@query(_TEXTS + "select pkg as audit, 'order' as subject, sha256(answer) as digest, 'https://in-toto.io/Statement/v1' as kind from txt")
def statements_orders(spark, sf_dir):
    """SNK4, HSH1: statements over the hash of the answer, the report as predicate."""
    made = sinks.rendered(flagship(spark, sf_dir).withColumn("audit", F.col("audit")), "statement")
    got = lambda path: F.get_json_object("document", path)
    return made.select("audit", F.when(got("$.subject[0].name") == F.col("audit").cast("string"), "order").alias("subject"), got("$.subject[0].digest.sha256").alias("digest"), got("$._type").alias("kind"))


@query(_TEXTS + """
, n as (select pkg, count(*) filter (where places > 0) as up, count(*) filter (where places = 0) as down from token group by pkg)
select f.pkg as audit, cast((select count(*) from seg where seg.pkg = f.pkg and verdict = 'grounded') as bigint) as grounded, cast((select count(*) from seg where seg.pkg = f.pkg and verdict = 'contradicted') as bigint) as contradicted,
  cast(coalesce(n.up, 0) as bigint) as grounded_tokens, cast(coalesce(n.down, 0) as bigint) as floating_tokens, true as has_limits
from facts f left join n on n.pkg = f.pkg
""")
def flat_rows_orders(spark, sf_dir):
    """SNK7: one flat row for each report."""
    rows = plan.flat_rows(flagship(spark, sf_dir, neighbours=False))
    return rows.select("audit", "grounded", "contradicted", "grounded_tokens", "floating_tokens", (F.length("limits") > 0).alias("has_limits"))


@query(_TEXTS + """
, s as (select pkg, count(*) as segments, count(*) filter (where verdict in ('unbearing', 'unchecked')) as skipped, count(*) filter (where verdict in ('floating', 'contradicted')) as found from seg group by pkg),
n as (select pkg, count(*) filter (where places > 0) as up, count(*) as every from token group by pkg)
select s.pkg as audit, skipped || ' of ' || segments || ' segments not checked; ' || case when every is null then 'nothing in it could be checked' else up || ' of ' || every || ' tokens grounded' end
  || '; ' || found || ' findings' as summary
from s left join n on n.pkg = s.pkg
""")
def summaries_orders(spark, sf_dir):
    """Report summaries: what wasn't checked is said before the share."""
    return results.summaries(flagship(spark, sf_dir, neighbours=False))


@query(_BASE + """
select pkg as audit, case when verdict = 'unchecked' then 'not_prose' else 'no_particulars' end as rule, cast(count(*) as bigint) as n from seg where verdict in ('unbearing', 'unchecked') group by 1, 2
""")
def skip_counts_orders(spark, sf_dir):
    """AGG10: how many segments each rule passed over."""
    return results.skip_counts(flagship(spark, sf_dir, neighbours=False))


@query("""
select o_orderkey as audit, 'path' as part, 'audited.engine_version' as path, '"1"' as archived, '"2"' as fresh from orders
union all select o_orderkey, 'id', 'report_id', 'differs', 'differs' from orders
""")
def recheck_orders(spark, sf_dir):
    """OP6, ORD4: reports of two engine versions compared leaf by leaf; the version and the id differ, nothing else does."""
    made = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("audit"), F.col("o_orderkey").alias("pkg"), F.concat(F.lit("It holds "), F.col("o_orderkey").cast("string"), F.lit(" bolts.")).alias("answer"))
    items = _items(made.select("pkg"), F.concat(F.lit("Bolts: "), F.col("pkg").cast("string")))
    documents = {v: sinks.rendered(plan.audit(made, items, version=v), "json") for v in ("1", "2")}
    told = plan.recheck_documents(documents["1"], documents["2"])
    is_id = F.col("path") == "report_id"
    shown = lambda c: F.when(is_id, "differs").otherwise(F.col(c)).alias(c)
    return told.select("audit", F.when(is_id, "id").otherwise("path").alias("part"), "path", shown("archived"), shown("fresh"))


def _items(keys, text, document=None, item=None):
    """Evidence items with plain anchors; one item of one document if neither is said."""
    none, document, item = F.lit(None).cast("string"), F.lit("d") if document is None else document, F.lit(0) if item is None else item
    rows = keys.withColumn("text", text)
    return rows.select(
        "pkg", item.alias("item"), F.concat(F.lit("i"), item.cast("string")).alias("item_id"), document.alias("document_id"), none.alias("source_path"), none.alias("section"), F.lit(0).alias("start"),
        F.length("text").alias("end"), none.alias("layer"), F.lit("").alias("producer"), "text",
    )


# --- answers under protection, in other scripts, and at the caps ----------------------------------------------------------


@query("""
with o as (select o_orderkey as audit, o_orderkey % 3 as k from orders)
select audit, 1 as n, case when k = 0 then 'unverifiable' else 'grounded' end as verdict, case when k = 0 then 'protected' end as rule, k in (0, 1) as limited from o
union all select audit, 2, case when k = 1 then 'unverifiable' else 'floating' end, case when k = 1 then 'protected' end, k in (0, 1) from o where k < 2
union all select audit, 2, 'floating', null, false from o where k = 2
""")
def unverifiable_orders(spark, sf_dir):
    """JN7, PRT1, PRJ3, AGG10: segments that a placeholder reaches into, in answers redacted for good."""
    key = F.col("o_orderkey")
    k = key % 3
    first = F.when(k == 0, "Paid 5 kg to <PERSON_1>.").otherwise("Paid 5 kg to Ada.")
    second = F.when(k == 1, F.lit("The box of [IBAN_22] is 9 m long.")).otherwise("The box is 9 m long.")
    shield = F.struct(F.lit("redactor").alias("by"), F.lit("names").alias("scope"), F.lit(False).alias("reversible"))
    made = table(spark, sf_dir, "orders").select(key.alias("audit"), key.alias("pkg"), F.concat(first, F.lit(" "), second).alias("answer"), shield.alias("protection"))
    reports = plan.audit(made, _items(made.select("pkg"), F.lit("It is 5 kg.")), plain=False, neighbours=False)
    limited = F.array_contains("limits", plan.IRREVERSIBLE_LIMIT)
    rows = reports.select("audit", "unchecked", limited.alias("limited"), F.posexplode("segments").alias("n", "s"))
    rules = F.map_from_entries(F.transform("unchecked", lambda u: F.struct(u["segment_id"], u["rule"])))
    return rows.select("audit", (F.col("n") + 1).alias("n"), "s.verdict", F.try_element_at(rules, F.col("s.segment_id")).alias("rule"), "limited")


@query("""
with s as (select l_orderkey as pkg, l_linenumber as item, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity from lineitem),
one as (select pkg, arg_min(cast(l_quantity as int), (item, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity)) as q, arg_min(strftime(l_shipdate, '%Y-%-m-%-d'), (item, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity)) as d from s group by pkg),
t as (select pkg, q, string_split(d, '-') as d from one)
select pkg as audit, 'ja' as script, 'quantity' as kind, q || 'キログラム' as text, 1 as places, 'grounded' as verdict from t where pkg % 2 = 0
union all select pkg, 'ja', 'quantity', q || 'トン', 0, 'floating' from t where pkg % 2 = 1
union all select pkg, 'ja', 'date', d[1] || '年' || d[2] || '月' || d[3] || '日', 1, 'grounded' from t
union all select pkg, 'zh', 'quantity', q || ' 公斤', 1, 'grounded' from t
union all select pkg, 'ja', 'reference', '第' || q || '条', 0, 'floating' from t
""")
def languages_orders(spark, sf_dir):
    """SEG6-SEG8, EXT7, TXT1-TXT3: answers in Japanese and Chinese against evidence in full-width digits."""
    lines = orders.numbered_lines(spark, sf_dir).where("item = 1")
    q, pkg = F.col("l_quantity").cast("int").cast("string"), F.col("l_orderkey")
    wide = F.translate(q, "0123456789", "０１２３４５６７８９")
    day = F.date_format("l_shipdate", "yyyy年M月d日")
    weight = F.concat(q, F.when(pkg % 2 == 0, "キログラム").otherwise("トン"))
    answer = F.concat(F.lit("重さは"), weight, F.lit("です。発送は"), day, F.lit("でした。箱重 "), q, F.lit(" 公斤。根拠は第"), q, F.lit("条にある。"))
    made = lines.select(pkg.alias("audit"), pkg.alias("pkg"), answer.alias("answer"), wide.alias("w"), day.alias("d"))
    items = _items(made.select("pkg", "w", "d"), F.concat(F.lit("箱は"), F.col("w"), F.lit("キログラムで、"), F.col("d"), F.lit("に発送。重"), F.col("w"), F.lit("公斤。")))
    _, segs, tokens = plan.audited(made.select("audit", "pkg", "answer"), items, neighbours=False)
    both = by_key(tokens, segs.select("audit", "seg", "script", "verdict"), ["audit", "seg"])
    return both.select("audit", "script", "kind", "text", F.size("locations").alias("places"), "verdict")


@query("""
with o as (select o_orderkey as audit, 28 + o_orderkey % 10 as n from orders)
select audit, cast(case when n >= 33 then 32 else n + 1 end as bigint) as places, n >= 32 as told from o
""")
def sources_cap_orders(spark, sf_dir):
    """WIN2, AGG8, OP18: a token of more than 32 documents; the last item is of a document already counted and is cut with the rest."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("audit"), F.col("o_orderkey").alias("pkg"))
    n = (28 + F.col("pkg") % 10).cast("int")
    rows = keys.select("pkg", F.explode(F.sequence(F.lit(0), n)).alias("k"), n.alias("n"))
    document = F.concat(F.lit("d"), F.when(F.col("k") == F.col("n"), 0).otherwise(F.col("k")).cast("string"))
    items = _items(rows.select("pkg", "k", "n"), F.lit("It is 7 kg."), document, F.col("k"))
    reports = plan.audit(keys.select("audit", "pkg", F.lit("It is 7 kg.").alias("answer")), items, neighbours=False)
    places = F.size(F.col("segments")[0]["tokens"][0]["locations"]).cast("long")
    return reports.select("audit", places.alias("places"), F.exists("bounds", lambda b: b["name"] == "SOURCE_LIMIT").alias("told"))


@query("""
with s as (select s_suppkey as audit, 58 + s_suppkey % 13 as n from supplier)
select audit, cast(least(n, 64) as bigint) as sent, cast(n as bigint) as total, cast(least(n, 64) as bigint) as judged, n > 64 as told, 'only short texts' as scope from s
""")
def claims_cap_suppliers(spark, sf_dir):
    """WIN4, AGG19, AGG20, OP9, OP18: answers with more claims than a judge is sent, and what the report says of that."""
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("audit"), F.col("s_suppkey").alias("pkg"))
    n = (58 + F.col("pkg") % 13).cast("int")
    answer = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("It holds "), (k + 1000).cast("string"), F.lit(" bolts."))), " ")
    made = keys.select("audit", "pkg", answer.alias("answer"))
    reports = plan.audit(made, _items(keys.select("pkg"), F.lit("Nothing.")))
    asked = plan.claims(reports)
    contexts = keys.select("audit", F.lit(0).alias("item"), F.lit("Nothing.").alias("premise"))
    judged = plan.judge(asked, contexts, lambda premise, claim: F.lit(0.9), model="stub", scope="only short texts")
    whole = plan.with_judgements(reports, judged, asked)
    sums = asked.groupBy("audit").agg(F.count("*").alias("sent"), F.max("total").cast("long").alias("total"))
    last = F.element_at("limits", -1)
    told = F.exists("bounds", lambda b: b["name"] == "MAX_CLAIMS")
    return whole.join(sums, "audit").select("audit", "sent", "total", F.size("judged").cast("long").alias("judged"), told.alias("told"), last.alias("scope"))


@query("""
with s as (select s_suppkey as audit, 1 + s_suppkey % 64 as claims, s_suppkey % 90 as contexts from supplier)
select audit, case when contexts = 0 then 'there is no context to judge by' else claims || ' claims and ' || contexts || ' contexts make more than 4096 pairs' end as refused, cast(0 as bigint) as judged
from s where contexts = 0 or claims * contexts > 4096
union all select audit, null, cast(claims as bigint) from s where contexts > 0 and claims * contexts <= 4096
""")
def unjudgeable_suppliers(spark, sf_dir):
    """JN21, OP10: claims that make too many pairs, or have no context, aren't paired with any."""
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("audit"))
    none = F.lit(None).cast("string")
    asked = keys.select("audit", F.explode(F.sequence(F.lit(1), (1 + F.col("audit") % 64).cast("int"))).alias("n"), F.lit("seg_001").alias("segment_id"), F.lit("t").alias("text"), none.alias("particular"))
    m = (F.col("audit") % 90).cast("int")
    contexts = keys.where(m > 0).select("audit", F.explode(F.sequence(F.lit(1), m)).alias("item"), F.lit("p").alias("premise"))
    refused = plan.unjudgeable(asked, contexts)
    judged = plan.judge(asked, contexts, lambda premise, claim: F.lit(0.5)).groupBy("audit").agg(F.count("*").alias("judged"))
    return keys.join(refused, "audit", "left").join(judged, "audit", "left").select("audit", "refused", F.coalesce("judged", F.lit(0)).cast("long").alias("judged"))


# --- documents read: packages, records, reports, cases --------------------------------------------------------------------

_BAD = (
    (0, None), (1, "items[0].text is missing or of another type than its contract says"), (2, "items[0].anchor.start is missing or of another type than its contract says"),
    (3, "provenance.protection.reversible is missing or of another type than its contract says"), (4, "an item's text and anchor differ in length"), (5, "an anchor ends before it starts"),
    (6, "an item has an unknown layer"), (7, "unknown contract x.context-package/2"), (8, "two items share an id"), (9, "not a package document"), (10, "package_id is missing or of another type than its contract says"),
    (11, "the document is nested too deeply"),
)


@query(
    "with c(k, refused) as (values " + ", ".join(f"({k}, {'null' if why is None else chr(39) + why.replace(chr(39), chr(39) * 2) + chr(39)})" for k, why in _BAD) + ") "
    "select o_orderkey as pkg, c.refused, case when k = 0 then o_orderkey % 2 = 0 end as declares_protection, "
    "case when k = 0 then 'surprise; items[0].extra; provenance.more' end as unrecognised from orders join c on c.k = o_orderkey % 12"
)
def package_refusals(spark, sf_dir):
    """SRC1-SRC9, SRC14, SET3: packages as JSON with every kind of fault, by their typed fields; null and absent protection told apart."""
    key = F.col("o_orderkey")
    k = key % 12
    one = F.when(k == 1, '"text": 12345').otherwise('"text": "abc"')
    start = F.when(k == 2, '"start": true').when(k == 5, '"start": 9').otherwise('"start": 2')
    end = F.when(k == 4, '"end": 4').otherwise('"end": 5')
    layer = F.when(k == 6, ', "provenance": {"layer": "guess"}').otherwise(', "provenance": {"layer": "fact"}')
    item = F.concat(F.lit('{"item_id": "a", "extra": 1, '), one, F.lit(', "anchor": {"document_id": "d", '), start, F.lit(", "), end, F.lit("}"), layer, F.lit("}"))
    items = F.concat(F.lit("["), item, F.when(k == 8, F.concat(F.lit(", "), item)).otherwise(""), F.lit("]"))
    guard = F.when(k == 3, '"protection": {"by": "r", "scope": "s", "reversible": "true"}, ').when(key % 2 == 0, '"protection": null, ').otherwise("")
    contract = F.when(k == 7, "x.context-package/2").otherwise("x.context-package/1-draft")
    package = F.when(k == 10, "7").otherwise('"p"')
    raw = F.concat(F.lit('{"contract": "'), contract, F.lit('", "surprise": [1], "package_id": '), package, F.lit(', "items": '), items, F.lit(', "omissions": [], "provenance": {'), guard, F.lit('"more": 1}}'))
    made = table(spark, sf_dir, "orders").select(key.alias("pkg"), F.when(k == 9, "nothing").when(k == 11, F.concat(F.repeat(F.lit("["), F.lit(70)), F.repeat(F.lit("]"), F.lit(70)))).otherwise(raw).alias("raw"))
    read = packages.read(made)
    good = F.col("refused").isNull()
    return read.select("pkg", "refused", F.when(good, F.col("declares_protection")).alias("declares_protection"), F.when(good, F.array_join("unrecognised", "; ")).alias("unrecognised"))


@query("""
select o_orderkey as pkg, 'below_threshold' as rule, 3 as "start", greatest(3, cast(o_orderkey % 7 as int)) as "end" from orders
""")
def package_omissions(spark, sf_dir):
    """SRC4: what packages withheld; an anchor never ends before it starts."""
    key = F.col("o_orderkey")
    raw = F.concat(F.lit('{"contract": "x.context-package/1", "package_id": "p", "items": [], "omissions": [{"rule": "below_threshold", "reason": "r", "anchor": {"document_id": "d", "start": 3, "end": '), (key % 7).cast("string"), F.lit("}}]}"))
    return packages.omissions_of(packages.read(table(spark, sf_dir, "orders").select(key.alias("pkg"), raw.alias("raw")))).select("pkg", "rule", "start", "end")


@query("""
select o_orderkey as audit, o_orderkey % 6 = 1 as reversible, case o_orderkey % 6 when 2 then 'surrogates can''t be told from real values' when 3 then 'unknown protection contract' when 4 then 'the record lacks a field'
  when 5 then 'not a protection record' end as refused from orders where o_orderkey % 6 <> 5
union all select o_orderkey, false, 'not a protection record' from orders where o_orderkey % 6 = 5
""")
def protection_records(spark, sf_dir):
    """SRC13: protection records, reversible ones, surrogates, other contracts, missing fields, no JSON."""
    key = F.col("o_orderkey")
    k = key % 6
    contract = F.when(k == 2, "x.protection-scope/1+surrogate").when(k == 3, "x.protection-scope/2").otherwise("x.protection-scope/1")
    body = F.concat(F.lit('{"contract": "'), contract, F.lit('", "by": "'), F.when(k == 4, "").otherwise("r"), F.lit('", "scope": "s"'), F.when(k == 1, ', "reversible": true').otherwise(""), F.lit("}"))
    made = table(spark, sf_dir, "orders").select(key.alias("audit"), packages.protection_record(F.when(k == 5, "junk").otherwise(body)).alias("r"))
    return made.select("audit", "r.reversible", "r.refused")


@query("""
select o_orderkey as audit, case when o_orderkey % 5 < 2 then 'r' || o_orderkey end as report_id, case o_orderkey % 5 when 2 then 'unknown contract x.audit-report/2' when 3 then 'the report lacks a field'
  when 4 then 'the statement has no predicate' end as refused from orders
""")
def archived_reports(spark, sf_dir):
    """SRC15, SRC16: archived reports and statements around them, with what keeps one from being read."""
    key = F.col("o_orderkey")
    k = key % 5
    contract = F.when(k == 2, "x.audit-report/2").otherwise("x.audit-report/1")
    answer = F.when(k == 3, "").otherwise(', "answer": "a"')
    report = F.concat(F.lit('{"contract": "'), contract, F.lit('", "report_id": "r'), key.cast("string"), F.lit('", "audited": {"package_id": "", "response_hash": "h", "packs": [], "engine_version": "", "matcher": "exact"}'), answer, F.lit("}"))
    head = F.lit('{"_type": "https://in-toto.io/Statement/v1"')
    raw = F.when(k == 1, F.concat(head, F.lit(', "predicate": '), report, F.lit("}"))).when(k == 4, F.concat(head, F.lit("}"))).otherwise(report)
    got = corpus.archived_reports(table(spark, sf_dir, "orders").select(key.alias("audit"), raw.alias("raw")))
    return got.select("audit", F.when(F.col("refused").isNull(), F.col("report.report_id")).alias("report_id"), "refused")


@query("select o_orderkey as bad from orders where o_orderkey % 3 <> 0")
def unreachable_sources_orders(spark, sf_dir):
    """JN16: plants whose source is in no item of the package, or where the item holds other text than they were."""
    key = F.col("o_orderkey")
    k = key % 3
    plant = F.struct(
        F.lit("unit_swap").alias("kind"), F.array(F.lit(0), F.lit(4)).alias("span"), F.when(k == 1, "9 kg").otherwise("5 kg").alias("was"),
        F.struct(F.lit("d").alias("document_id"), F.when(k == 2, F.array(F.lit(16), F.lit(40))).otherwise(F.array(F.lit(16), F.lit(20))).alias("span")).alias("source"),
    )
    case = F.struct(key.cast("string").alias("case_id"), F.array(plant).alias("plants"))
    item = '{"item_id": "i", "text": "It is 5 kg.", "anchor": {"document_id": "d", "start": 10, "end": 21}}'
    rows = table(spark, sf_dir, "orders").select(key.alias("key"), case.alias("case"))
    raws = rows.select(F.col("key").cast("string").alias("pkg"), F.lit(f'{{"contract": "x.context-package/1", "package_id": "p", "items": [{item}], "omissions": []}}').alias("raw"))
    return corpus.unreachable_sources(rows.select("case"), raws).select(F.col("bad").cast("long").alias("bad"))


# --- made cases, drafts, agreement ------------------------------------------------------------------------------------------


def _made(spark, sf_dir):
    """Documents and sentences of one genre for each nation."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("g"), F.col("n_nationkey").cast("string")).alias("genre"))
    weight = (F.col("k") + 10).cast("string")
    documents = nations.select(
        "genre", F.lit("en").alias("language"), F.lit("What of it?").alias("question"), (F.col("k") % 5 == 0).alias("protected"), F.lit(0).alias("document"), F.lit("doc").alias("document_id"),
        F.lit("a/b.md").alias("source_path"), F.lit(None).cast("string").alias("section"),
        F.array(F.lit("Nothing of note here."), F.concat(F.lit("The box weighs {{F:w}}"), weight, F.lit(" kg{{/F}} in all.")), F.lit("Nor here.")).alias("paragraphs"),
    )
    none = F.lit(None).cast("string")
    names = ("sentence", "text", "kind", "target", "fact")
    one = lambda *cells: F.struct(*(x.alias(n) for n, x in zip(names, cells, strict=True)))
    kg, mg = F.concat(weight, F.lit(" kg")), F.concat(weight, F.lit(" mg"))
    sentences = F.array(
        one(F.lit(0), F.concat(F.lit("It weighs "), kg, F.lit(".")), F.lit("grounded"), kg, F.lit("w")), one(F.lit(1), F.concat(F.lit("It weighs "), mg, F.lit(".")), F.lit("unit_swap"), mg, F.lit("w")),
        one(F.lit(2), F.lit("It holds 987654 bolts."), F.lit("invented_particular"), F.lit("987654"), none), one(F.lit(3), F.lit("It is heavy."), F.lit("faithful_paraphrase"), none, none),
    )
    rows = nations.select("genre", "k", F.explode(sentences).alias("s")).select("genre", "s.*", none.alias("expect_verdict"))
    return documents, rows


@query("""
with n as (select 'g' || n_nationkey as genre, n_nationkey % 5 = 0 as protected, n_nationkey + 10 as w from nation)
select genre, kind, case kind when 'grounded' then w || ' kg' when 'unit_swap' then w || ' mg' when 'invented_particular' then '987654' else 'It is heavy.' end as text,
  case when kind in ('grounded', 'unit_swap') then w || ' kg' end as was, case when kind in ('grounded', 'unit_swap') then 38 end as source_start,
  case kind when 'grounded' then 'grounded' when 'unit_swap' then 'contradicted' when 'invented_particular' then 'floating' else 'unbearing' end as expect_verdict, protected as refusal_due, true as stands
from n, (values ('grounded'), ('unit_swap'), ('invented_particular'), ('faithful_paraphrase')) as v(kind)
""")
def generated_plants(spark, sf_dir):
    """OP15, JN17, WIN8, SRC19: cases made from marked documents; every plant stands in its answer where it says."""
    cases, plants, _ = generation.build(*_made(spark, sf_dir), seed=7, total=2)
    both = plants.join(cases.select("audit", "genre", "answer", "refusal_due", "refused"), "audit")
    stands = F.col("refused").isNull() & (F.expr("substring(answer, start + 1, end - start)") == F.col("text"))
    return both.select("genre", "kind", "text", "was", "source_start", "expect_verdict", "refusal_due", stands.alias("stands"))


@query("""
select 'en-g' || n_nationkey || '-' || i as audit, cast(1 as bigint) as items, cast(2 as bigint) as omissions, case i when '02' then 'held_out' else 'train' end as split, n_nationkey % 5 = 0 as protected
from nation, (values ('01'), ('02')) as v(i)
""")
def generated_packages(spark, sf_dir):
    """JN17, SNK8: packages of made cases, read back: a paragraph with a fact is evidence, the others are withheld."""
    cases, _, raws = generation.build(*_made(spark, sf_dir), seed=7, total=2)
    read = packages.read(raws).where("refused is null")
    p = F.col("package")
    told = read.select("pkg", F.size(p["items"]).cast("long").alias("items"), F.size(p["omissions"]).cast("long").alias("omissions"), p["provenance"]["protection"].isNotNull().alias("protected"))
    return cases.select("audit", "pkg", "split").join(told, "pkg").select("audit", "items", "omissions", "split", "protected")


@query("""
with p(kind, verdict) as (values ('grounded', 'grounded'), ('unit_swap', 'contradicted'), ('invented_particular', 'floating'), ('faithful_paraphrase', 'unbearing'))
select 'g' || n_nationkey as genre, kind, verdict as expect_verdict, kind in ('unit_swap', 'invented_particular') as expect_detected, cast(null as varchar) as refused from nation, p
""")
def corpus_cases(spark, sf_dir):
    """SRC17, PRJ12, PRJ13, ORD3, JN16: made cases written to the shared folder and read back as a corpus of both splits."""
    root = shared_folder(spark)
    cases, plants, raws = generation.build(*_made(spark, sf_dir), seed=7, total=2)
    generation.write(generation.files_of(cases, plants, raws, seed=7), root)
    read, told, _ = corpus.cases(spark, root, ("train", "held_out"), tier="ci")
    return told.join(read.select("audit", "genre", "refused"), "audit").select("genre", "kind", "expect_verdict", "expect_detected", "refused")


@query("""
select 'en-g' || n_nationkey || '-' || i || '/' || f as path, case when f = 'response.txt' and n_nationkey % 4 = 1 then 'differs' when n_nationkey % 4 = 2 then 'missing' end as problem
from nation, (values ('01'), ('02')) as v(i), (values ('case.json'), ('package.json'), ('response.txt')) as w(f)
where (f = 'response.txt' and n_nationkey % 4 = 1) or n_nationkey % 4 = 2
union all select 'stray/case.json', 'not made'
""")
def generated_drift(spark, sf_dir):
    """SNK8: files of made cases against stored ones, some of which are changed, missing or strange."""
    made = generation.files_of(*generation.build(*_made(spark, sf_dir), seed=7, total=2), seed=7)
    k = F.regexp_extract("path", r"^en-g(\d+)-", 1).cast("int") % 4
    kept = made.where(k != 2).withColumn("body", F.when((k == 1) & F.endswith("path", F.lit("response.txt")), F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    stray = spark.createDataFrame([("stray/case.json", "{}")], "path string, body string")
    return generation.drift(made, kept.unionByName(stray))


_DRAFTS = (
    ("en", "tent", "stove", "weight", "How heavy is it?", "2.4kg", "2.6kg", "The tent weighs 2.4kg.", "", "taken"),
    ("en", "tent", "TENT", "weight", "What weight is it?", "2.4kg", "２.4KG", "The tent is light.", "the sentence doesn't hold the value; the neighbour repeats the subject; the superseded value repeats the value; the paraphrase uses the attribute", "missed"),
    ("en", "", "stove", "weight", "How heavy?", "2.4kg", "2.6kg", "It is 2.4kg.", "missing subject", "taken"),
    ("en", "beer", "wine", "strength", "How strong?", "5.2% ABV", "5.4% ABV", "It has 5.2% ABV.", "", "taken"), ("en", "panel", "door", "size", "How big?", "2.4m x 1.2m", "2m x 1m", "It is 2.4m x 1.2m.", "", "taken"),
    ("en", "tank", "pipe", "volume", "How much?", "320 kmx", "20 m", "It is 320 kmx.", "", "taken"), ("zh", "药", "水", "量", "多少?", "每次25毫克", "20毫克", "服用每次25毫克。", "", "clause"),
    ("en", "beer", "wine", "strength", "How strong?", "5.5%vol", "5%", "It has 5.5%vol now.", "", "cut"), ("en", "box", "bag", "colour", "Which hue?", "blue", "red", "The box is blue.", "", "missed"),
)


@query("select * from (values " + ", ".join("(" + ", ".join(str(k) if i < 0 else "'" + str(x).replace("'", "''") + "'" for i, x in ((-1, k), (0, d[8]), (1, d[9]))) + ")" for k, d in enumerate(_DRAFTS)) + ") as t(draft, problems, outcome)")
def draft_triage(spark, sf_dir):
    """OP19: drafts that contradict themselves, and what extraction makes of their values; the expected rows are written down."""
    names = ("draft int, language string, subject string, neighbour string, attribute string, paraphrase string, value string, superseded_value string, sentence string")
    rows = spark.createDataFrame([(k, *d[:8]) for k, d in enumerate(_DRAFTS)], names)
    told = drafts.unextracted(drafts.malformed(rows))
    return told.select("draft", F.array_join("problems", "; ").alias("problems"), "outcome")


@query(_TEXTS + r"""
, pair as (select f.pkg, f.seg, f.tok, f.item, f.kind, f.text, substr(t.answer, s.a + 1, s.b - s.a) as mine,
    case when f.kind = 'money' then 'Its price was $' || l.p || '.' else 'The parcel weighs ' || l.q || ' kg and left on ' || l.d || '.' end as theirs
  from found f join spans s on s.pkg = f.pkg and s.seg = f.seg join txt t on t.pkg = f.pkg join line l on l.pkg = f.pkg and l.item = f.item),
bare as (select *, lower(trim(regexp_replace(replace(mine, text, ' '), '\s+', ' ', 'g'))) as a, lower(trim(regexp_replace(replace(theirs, text, ' '), '\s+', ' ', 'g'))) as b from pair),
grams as (select *, list_distinct(list_transform(range(1, greatest(length(a), 1)), lambda i: substr(a, i, 2))) as x, list_distinct(list_transform(range(1, greatest(length(b), 1)), lambda i: substr(b, i, 2))) as y from bare),
shares as (select len(list_intersect(x, y)) / least(len(x), len(y)) as share from grams)
select cast(count(*) filter (where share = 0) as bigint) as "none", cast(count(*) filter (where share > 0 and share <= 0.1) as bigint) as "to_0.1", cast(count(*) filter (where share > 0.1 and share <= 0.25) as bigint) as "to_0.25",
  cast(count(*) filter (where share > 0.25 and share <= 0.5) as bigint) as "to_0.5", cast(count(*) filter (where share > 0.5 and share <= 1.01) as bigint) as "to_1.01" from shares
""")
def subject_agreement_orders(spark, sf_dir):
    """JN18, MSR1, SET4, AGG17: how alike the sentences around a grounded value are in answer and evidence."""
    _, segs, tokens = _audited(spark, sf_dir)
    return ev.overlap_bins(ev.subject_agreement(tokens, segs, orders.evidence(spark, sf_dir)))


@query("select kind, outcome, retryable from (values " + ", ".join(f"('{k}', '{o}', {str(a).lower()})" for k, o, a, _ in problems.CATALOGUE) + ") as t(kind, outcome, retryable)")
def error_catalogue(spark, sf_dir):
    """SNK9: kinds of refusal."""
    return problems.catalogue(spark, "a test").select("kind", "outcome", "retryable")


# --- written-down values: the weaker kind of twin ---------------------------------------------------------------------------

#: A text, a kind and a token for each rule of the language packs, by pack.
TOKENS = (
    ("On 2025-01-31.", "date", "2025-01-31"), ("On 2025/1/31.", "date", "2025/1/31"), ("At 9:45:10.5.", "time", "9:45:10.5"), ("Up 4.5％.", "percentage", "4.5％"), ("Cost €1,200.", "money", "€1,200"),
    ("Paid 500 EUR.", "money", "500 EUR"), ("Runs v1.2.3-rc1 now.", "identifier", "v1.2.3-rc1"), ("By ISO 9001.", "identifier", "ISO 9001"), ("A 40' box.", "quantity", "40'"), ("At -20℃.", "quantity", "-20℃"),
    ("There were 42.", "number", "42"),
    ("By Dr. Adeyemi.", "proper_noun", "Adeyemi"), ("Signed with Harbour Systems Inc.", "proper_noun", "Harbour Systems Inc."), ("See Section 4.2(a).", "reference", "Section 4.2(a)"), ("In March 2024.", "date", "March 2024"),
    ("On May 3rd, 2024.", "date", "May 3rd, 2024"), ("On 3 May 2024.", "date", "3 May 2024"), ("In 10 business days.", "duration", "10 business days"), ("For 5 million dollars.", "money", "5 million dollars"),
    ("Over 120 sq ft.", "quantity", "120 sq ft"), ("Some 2.40 kilograms.", "quantity", "2.40 kilograms"),
    ("令和6年5月1日に。", "date", "令和6年5月1日"), ("2025年1月31日に。", "date", "2025年1月31日"), ("1月31日に。", "date", "1月31日"), ("二〇二五年一月に。", "date", "二〇二五年一月"), ("第十二条による。", "reference", "第十二条"),
    ("費用は3,400万円。", "money", "3,400万円"), ("箱は5キログラム。", "quantity", "5キログラム"), ("2時間15分でした。", "duration", "2時間15分"), ("15人が来た。", "quantity", "15人"), ("数は三千だ。", "number", "三千"),
    ("担当は木村医師。", "proper_noun", "木村"), ("株式会社あおばと契約。", "proper_noun", "株式会社あおば"), ("東和証券が引受。", "proper_noun", "東和証券"), ("甲社と契約。", "proper_noun", "甲社"), ("番号は四五六だ。", "number", "四五六"),
    ("有12辆车。", "quantity", "12辆"), ("第3款规定。", "reference", "第3款"), ("用时2小时15分。", "duration", "2小时15分"), ("付3,400万元。", "money", "3,400万元"), ("重5公斤。", "quantity", "5公斤"), ("甲公司负责。", "proper_noun", "甲公司"),
    ("主治医师为陈医生。", "proper_noun", "陈"), ("由东方证券承销。", "proper_noun", "东方证券"), ("共两千。", "number", "两千"), ("3月5日。", "date", "3月5日"),
)


def _listed(rows, names):
    shown = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "select * from (values " + ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows) + f") as t({names})"


@query(_listed(TOKENS, "text, kind, particular"))
def tokens_golden(spark, sf_dir):
    """EXT1-EXT7: one text for each rule."""
    texts = spark.createDataFrame([(a, a) for a, _, _ in TOKENS], "key string, text string")
    rows = g.segments(texts, "text").select("key", F.explode("tokens").alias("t"))
    return rows.select(F.col("key").alias("text"), "t.kind", F.col("t.text").alias("particular"))


#: A text and its segments with their kind and what ended them.
SEGMENTS = (
    ("It is light. It weighs 2.4kg. Yes", (("It is light.", "prose", "terminator"), ("It weighs 2.4kg.", "prose", "terminator"), ("Yes", "prose", "end"))),
    ("軽い。The box is light. 重い", (("軽い。", "prose", "terminator"), ("The box is light.", "prose", "terminator"), ("重い", "prose", "end"))),
    ("Ask Dr. Sato, e.g. by J. Lee... now.", (("Ask Dr. Sato, e.g. by J. Lee... now.", "prose", "terminator"),)), ("「軽い。」と書く。重い。", (("「軽い。」と書く。", "prose", "terminator"), ("重い。", "prose", "terminator"))),
    ("# Head\n- one\n2) two\n| a |\n> q", (("# Head", "heading", "structure"), ("- one", "list_item", "structure"), ("2) two", "list_item", "structure"), ("| a |", "table_row", "structure"), ("> q", "quote", "structure"))),
    ("Run.\n\n```\nx = 1. y\n```", (("Run.", "prose", "terminator"), ("```\nx = 1. y\n```", "code", "structure"))), ("箱は 7kg\n袋は 8g", (("箱は 7kg", "prose", "line"), ("袋は 8g", "prose", "line"))),
)


@query(_listed([(k, n, *s) for k, (_, cut) in enumerate(SEGMENTS) for n, s in enumerate(cut)], "place, seg, body, kind, boundary"))
def segments_golden(spark, sf_dir):
    """SEG1-SEG7: texts cut by structure, by sentences of every script, and by lines."""
    texts = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(SEGMENTS)], "place int, text string")
    return g.segments(texts, "text").select("place", "seg", "body", "kind", "boundary")


#: Texts and what folding makes of them.
FOLDS = (("Straße", "strasse"), ("ＡＢＣ　１２", "abc 12"), ("  a \t b ", "a b"), ("が", "が"), ("㎏", "kg"), ("İ", "i̇"), ("½", "1⁄2"))


@query(_listed(FOLDS, "text, folded"))
def folds_golden(spark, sf_dir):
    """TXT1-TXT3: compatibility and case folding, white space."""
    texts = spark.createDataFrame(FOLDS, "text string, expected string")
    return texts.select("text", fold_function()(F.col("text")).alias("folded"))


#: A token, a text and the places where the token stands alone in it.
PLACES = (
    ("2.4", "it weighs 2.40kg", ""), ("2.4kg", "it weighs 2.4 kg", "10:16"), ("45", "cap 45,000", ""), ("45,000", "cap ４５,000 or 45,000", "4:10 14:20"), ("5", "见第3，5，7条", "4:5"), ("三千人", "一万三千人、三千人", "6:9"),
    ("iso 9001", "ISO 9001 and ISO 90012", "0:8"), ("12", "2024-12,345", "5:7"), ("田中", "担当は田中医師", "3:5"), ("7", "7 7 17 7.5 7.", "0:1 2:3 11:12"),
)


@query(_listed([(k, p) for k, (_, _, p) in enumerate(PLACES)], "place, spans"))
def places_golden(spark, sf_dir):
    """MAT1, MAT2, PRJ9, TXT4, TXT5: tokens inside longer numbers, thousands groups, free spacing, Han numerals."""
    from .functions.kernels import places_function

    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(PLACES)], "place int, form string, text string")
    spans = places_function()(F.col("form"), F.col("text"))
    told = F.array_join(F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), " ")
    return rows.select("place", told.alias("spans"))
