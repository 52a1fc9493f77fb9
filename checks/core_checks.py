"""Checks of linking, pricing, validation, exports and views."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from checks.registry import FRAGMENTS, check
from checks.scalar_checks import key_sql
from draftweave.functions import geometry as geo
from draftweave.functions import scalars as sc
from draftweave.operators import diff, procure, reconcile, skew, validate, views
from draftweave.plans.workspace import build_workspace
from draftweave.sinks import documents, exports
from draftweave.sources import workspaces
from draftweave.sources.catalog import catalog, merge_catalog

FRAGMENTS["keyed_bom"] = f"""
    select *, count(*) over (partition by doc_id, key) as bom_n,
           row_number() over (partition by doc_id, key order by bom_ord) as bom_rn
    from (select *, {key_sql('item_number', 'item_kind')} as key from @bom) where key is not null"""
FRAGMENTS["keyed_calls"] = f"""
    select *, count(*) over (partition by doc_id, key) as call_n,
           row_number() over (partition by doc_id, key order by call_ord) as call_rn
    from (select *, {key_sql('bubble_number', 'bubble_kind')} as key from @callouts) where key is not null"""
FRAGMENTS["linked"] = """
    select coalesce(b.doc_id, c.doc_id) as doc_id, coalesce(b.key, c.key) as key,
           case when b.doc_id is not null and c.doc_id is not null then 0 when b.doc_id is not null then 1 else 2 end as section,
           b.bom_ord, b.bom_rn, b.item_number as raw_item, b.item_kind, b.part_number, b.part_name, b.description, b.quantity,
           b.material_specification, b.material, b.revision, b.confidence_score as bom_conf,
           c.call_ord, c.call_rn, c.bubble_number as raw_bubble, c.location_description, c.xmin, c.ymin, c.xmax, c.ymax, c.confidence_score as call_conf
    from @keyed_bom b full join @keyed_calls c
      on b.doc_id = c.doc_id and b.key = c.key and (b.bom_n = 1 or b.bom_rn = c.call_rn)
    union all
    select doc_id, null, 3, bom_ord, null, item_number, item_kind, part_number, part_name, description, quantity,
           material_specification, material, revision, confidence_score, null, null, null, null, null, null, null, null, null
    from @bom where ({bom_key}) is null
    union all
    select doc_id, null, 4, null, null, null, null, null, null, null, null, null, null, null, null,
           call_ord, null, bubble_number, location_description, xmin, ymin, xmax, ymax, confidence_score
    from @callouts where ({call_key}) is null""".replace("{bom_key}", key_sql("item_number", "item_kind")).replace(
    "{call_key}", key_sql("bubble_number", "bubble_kind"))
FRAGMENTS["comp"] = """
    select l.*, row_number() over (partition by l.doc_id order by section, cast(l.key as hugeint) nulls last, coalesce(call_ord, bom_ord)) as seq,
           coalesce(bn.n, 0) > 1 as dup_item, coalesce(cn.n, 0) > 1 and coalesce(bn.n, 0) <> 1 as dup_bubble,
           case section when 0 then 'matched' when 1 then 'bom_only' when 2 then 'callout_only' else 'ambiguous' end as link_status,
           case when bom_ord is not null then l.key end as item, case when call_ord is not null then l.key end as bubble,
           case when nullif(description, '') is not null then description else nullif(part_name, '') end as name,
           coalesce(description, '') as descr, coalesce(material_specification, material) as mat, coalesce(revision, '') as rev,
           coalesce(location_description, '') as loc,
           case when bom_conf is null then call_conf when call_conf is null then bom_conf else least(bom_conf, call_conf) end as conf,
           xmin is not null and ymin is not null and xmax is not null and ymax is not null as boxed
    from @linked l
    left join (select doc_id, key, count(*) as n from @keyed_bom group by all) bn on l.doc_id = bn.doc_id and l.key = bn.key
    left join (select doc_id, key, count(*) as n from @keyed_calls group by all) cn on l.doc_id = cn.doc_id and l.key = cn.key"""
FRAGMENTS["priced"] = """
    select c.*, case when coalesce(c.part_number, '') <> '' and k.estimated_unit_cost_usd >= 0 then round(k.estimated_unit_cost_usd, 2) end as unit_cost,
           case when coalesce(c.part_number, '') <> '' and k.estimated_unit_cost_usd >= 0 and quantity > 0 then round(k.estimated_unit_cost_usd * quantity, 2) end as total_cost,
           case when coalesce(c.part_number, '') <> '' and k.estimated_unit_cost_usd >= 0 then k.supplier_source end as supplier,
           case when coalesce(c.part_number, '') <> '' and k.estimated_unit_cost_usd >= 0 then coalesce(k.stock_status, 'unknown') else 'unknown' end as stock,
           case when coalesce(c.part_number, '') = '' then 'No part number available for pricing lookup.'
                when k.part_number is null then 'No supplier pricing found for part number ''' || c.part_number || '''.'
                when not coalesce(k.estimated_unit_cost_usd >= 0, false) then 'Catalog entry for ''' || c.part_number || ''' has no valid unit cost.'
                when quantity > 0 then 'Mock/estimated procurement data for demonstration purposes only. Not a real quotation.'
                else 'Mock/estimated procurement data for demonstration purposes only. Not a real quotation. Total cost omitted: quantity is missing or invalid.' end as note
    from @comp c left join @catalog k on c.part_number = k.part_number"""
FRAGMENTS["issue_rows"] = """
    select doc_id, seq, pos, type, severity, message from (
      select doc_id, seq, 0 as pos, 'ambiguous_identifier' as type, 'error' as severity, 'Identifier ''' ||
             case when section = 3 then case when item_kind = 'bool' then 'True' when raw_item is null or raw_item = '' then 'None' else raw_item end
                  else coalesce(raw_bubble, 'None') end ||
             ''' could not be normalized to a single unambiguous number and was not auto-matched.' as message from @comp where section >= 3
      union all select doc_id, seq, 1, 'missing_callout', 'error', 'BOM item ' || item || ' has no matching drawing callout.' from @comp where section = 1
      union all select doc_id, seq, 2, 'missing_bom_item', 'error', 'Drawing bubble ' || bubble || ' has no matching BOM item.' from @comp where section = 2
      union all select doc_id, seq, 3, 'duplicate_bom_item', 'error', 'Item number ' || coalesce(item, 'None') || ' appears more than once in the BOM.' from @comp where section < 3 and dup_item
      union all select doc_id, seq, 4, 'duplicate_callout', 'error', 'Bubble number ' || coalesce(bubble, 'None') || ' appears more than once on the drawing.' from @comp where section < 3 and dup_bubble
      union all select doc_id, seq, 5, 'confidence_unavailable', 'info', 'No confidence score was available from either the BOM or the drawing extraction.' from @comp where section < 3 and conf is null
      union all select doc_id, seq, 6, 'low_confidence', 'warning', 'Combined confidence ' || printf('%.2f', conf) || ' is below the review threshold of 0.75.' from @comp where section < 3 and conf < 0.75
      union all select doc_id, seq, 7, 'missing_field', 'warning', 'Part name is missing.' from @comp where section < 2 and name is null
      union all select doc_id, seq, 8, 'missing_field', 'warning', 'Quantity is missing.' from @comp where section < 2 and quantity is null
      union all select doc_id, seq, 9, 'invalid_quantity', 'warning', 'Quantity ' || quantity || ' is not a valid positive count.' from @comp where section < 2 and quantity <= 0
      union all select doc_id, seq, 10, 'missing_field', 'info', 'Material specification is missing.' from @comp where section < 2 and coalesce(mat, '') = '')"""
FRAGMENTS["validated"] = """
    select c.*, coalesce(i.n, 0) as issue_count, coalesce(i.low, false) as low, coalesce(i.messages, '') as messages, coalesce(i.types, '') as types,
           case when section = 0 and i.n is null then 'linked' when section = 0 then 'review_required'
                when section = 1 then 'missing_callout' when section = 2 then 'missing_bom_item' else 'invalid' end as status
    from @priced c left join (
      select doc_id, seq, count(*) as n, bool_or(type = 'low_confidence') as low, string_agg(message, ' / ' order by pos) as messages,
             string_agg(type || ':' || severity, ',' order by pos) as types from @issue_rows group by all) i on c.doc_id = i.doc_id and c.seq = i.seq"""

COMPONENT_ID = "'cmp_' || case when seq < 1000 then lpad(cast(seq as varchar), 3, '0') else cast(seq as varchar) end"


def callouts(t):
    box = geo.box(*[F.col(e) for e in geo.EDGES])
    return t.callouts.withColumn("bubble_bbox", box).drop(*geo.EDGES)


def components(t):
    return reconcile.reconcile(t.bom, callouts(t))


def workspace(t):
    return build_workspace(t.bom, callouts(t), t.catalog)


@check("j01_reconcile", f"""select doc_id, seq, {COMPONENT_ID} as component_id, item as item_number, bubble as bubble_number, link_status,
    part_number, name as part_name, descr as description, quantity, mat as material_specification, rev as revision, loc as location_description,
    conf as confidence_score, dup_item as duplicate_item_number, dup_bubble as duplicate_bubble_number,
    case when boxed then xmin end as xmin, case when boxed then ymax end as ymax, bom_ord, call_ord from @comp""", bench=True)
def _(t):
    return components(t).select(
        "doc_id", "seq", "component_id", "item_number", "bubble_number", "link_status", "part_number", "part_name",
        "description", "quantity", "material_specification", "revision", "location_description", "confidence_score",
        "duplicate_item_number", "duplicate_bubble_number", F.col("bounding_box.xmin").alias("xmin"),
        F.col("bounding_box.ymax").alias("ymax"), "bom_ord", "call_ord")


@check("w01_pairing_ordinals", "select doc_id, bom_ord, bom_n, bom_rn from @keyed_bom")
def _(t):
    key = W.partitionBy("doc_id", "key")
    rows = reconcile.bom_rows(t.bom).filter("key is not null")
    hot = skew.hot_groups(rows, ["doc_id", "key"])
    sizes = rows.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("bom_n")) if hot is not None else None
    numbered = skew.ranked(rows, ["doc_id", "key"], [F.col("bom_ord")], "bom_rn", hot)
    numbered = numbered.withColumn("bom_n", F.count(F.lit(1)).over(key)) if hot is None else skew.lookup(numbered, sizes, ["doc_id", "key"], hot)
    return numbered.select("doc_id", "bom_ord", "bom_n", "bom_rn")


@check("w02_component_sequence", "select doc_id, seq, link_status, coalesce(item, bubble) as key, coalesce(call_ord, bom_ord) as ord from @comp")
def _(t):
    return components(t).select("doc_id", "seq", "link_status", F.coalesce("item_number", "bubble_number").alias("key"), F.coalesce("call_ord", "bom_ord").alias("ord"))


@check("o01_key_order", "select doc_id, key, row_number() over (partition by doc_id order by cast(key as hugeint)) as pos from (select distinct doc_id, key from @keyed_bom)")
def _(t):
    keys = reconcile.bom_rows(t.bom).filter("key is not null").select("doc_id", "key").distinct()
    hot = skew.hot_groups(keys, ["doc_id"])
    return skew.ranked(keys, ["doc_id"], sc.key_order(F.col("key")), "pos", hot)


@check("u01_key_union", "select distinct doc_id, key from (select doc_id, key from @keyed_bom union all select doc_id, key from @keyed_calls)")
def _(t):
    b = reconcile.bom_rows(t.bom).select("doc_id", "key")
    c = reconcile.callout_rows(callouts(t)).select("doc_id", "key")
    return b.unionAll(c).filter("key is not null").distinct()


@check("p13_component_projection", "select doc_id, bom_ord, name as part_name, descr as description, rev as revision, mat as material_specification, quantity from @comp where bom_ord is not null and section in (1, 3)")
def _(t):
    rows = components(t).filter("link_status = 'bom_only' or ambiguous_item_number")
    return rows.select("doc_id", "bom_ord", "part_name", "description", "revision", "material_specification", "quantity")


@check("u03_section_union", "select doc_id, link_status, count(*) as n from @comp group by all")
def _(t):
    return components(t).groupBy("doc_id", "link_status").agg(F.count(F.lit(1)).alias("n"))


# --- side lists --------------------------------------------------------------------


@check("a03_duplicate_item_numbers", "select doc_id, key as item_number, row_number() over (partition by doc_id order by cast(key as hugeint)) as position from (select doc_id, key from @keyed_bom group by all having count(*) > 1)")
def _(t):
    return reconcile.duplicate_item_numbers(components(t))


@check("a04_duplicate_bubble_numbers", """select c.doc_id, c.key as bubble_number, row_number() over (partition by c.doc_id order by cast(c.key as hugeint)) as position
    from (select doc_id, key, count(*) as n from @keyed_calls group by all) c left join (select doc_id, key, count(*) as n from @keyed_bom group by all) b
    on c.doc_id = b.doc_id and c.key = b.key where c.n > 1 and coalesce(b.n, 0) <> 1""")
def _(t):
    return reconcile.duplicate_bubble_numbers(components(t))


@check("a05_ambiguous_identifiers", """select doc_id, side, raw, row_number() over (partition by doc_id order by seq) as position from (
    select doc_id, seq, case section when 3 then 'bom' else 'callout' end as side, coalesce(raw_item, raw_bubble) as raw from @comp where section >= 3)""")
def _(t):
    return reconcile.ambiguous_identifiers(components(t))


@check("a06_unmatched_rows", f"""select doc_id, case when section in (1, 3) then 'bom' else 'callout' end as side, {COMPONENT_ID} as component_id, link_status, key,
    coalesce(bom_ord, call_ord) as ord from @comp where section > 0""")
def _(t):
    return reconcile.unmatched_rows(components(t))


# --- prices ------------------------------------------------------------------------

PRICE_SQL = "select doc_id, seq, unit_cost, total_cost, supplier, stock, note from @priced"


@check("j05_price", PRICE_SQL)
def _(t):
    p = F.col("procurement_data")
    return procure.price(components(t), t.catalog).select(
        "doc_id", "seq", p["estimated_unit_cost_usd"].alias("unit_cost"), p["estimated_total_cost_usd"].alias("total_cost"),
        p["supplier_source"].alias("supplier"), p["stock_status"].alias("stock"), p["note"].alias("note"))


@check("j06_merge_catalog", """select * from @override union all select * from @catalog where part_number not in (select part_number from @override)""")
def _(t):
    return merge_catalog(t.catalog, t.override)


# Fixed values of the base catalogue, repeated here so the oracle stands alone.
S06_SQL = """select part_number, estimated_unit_cost_usd, supplier_source from @override union all
    select * from (values ('FB-M8-001', 35.0::double, 'Chennai Fastener Works'), ('WSH-M8-002', 6.0, 'Coimbatore Precision Components'),
    ('BRK-STD-100', 950.0, 'Salem Metal Fabricators'), ('BRG-6202-Z', 240.0, 'Tiruchirappalli Bearing Traders'), ('GSK-RUB-045', 85.0, 'Erode Rubber & Seals Co.'),
    ('SHF-ST-303', 640.0, 'Hosur Precision Engineering'), ('PL-6061-014', 1650.0, 'Coimbatore Metal Fabricators'), ('SHCS-M6-025', 11.0, 'Tiruppur Fastener Industries'),
    ('WSH-M8-STD', 5.0, 'Madurai Engineering Supplies'), ('HB-M8-001', 8.0, 'Chennai Fastener Works'), ('WS-M8-001', 3.0, 'Coimbatore Precision Components'),
    ('BH-001', 420.0, 'Salem Metal Fabricators'), ('BR-6204', 260.0, 'Tiruchirappalli Bearing Traders'), ('SH-001', 150.0, 'Hosur Precision Engineering'),
    ('EC-001', 180.0, 'Salem Metal Fabricators'), ('NT-M8-001', 4.0, 'Chennai Fastener Works')) v"""


@check("s06_catalog", S06_SQL)
def _(t):
    return catalog(t.spark, t.override).select("part_number", "estimated_unit_cost_usd", "supplier_source")


@check("a02_procurement_summary", """select d.doc_id, 'INR' as currency, coalesce(cast(sum(cast(total_cost as decimal(28, 2))) as double), 0) as estimated_total_cost_usd,
    count(unit_cost) as items_with_price, count(p.doc_id) - count(unit_cost) as items_without_price
    from (select o_orderkey as doc_id from @orders) d left join @priced p on d.doc_id = p.doc_id group by d.doc_id""")
def _(t):
    docs = t.shared("orders").select(F.col("o_orderkey").alias("doc_id"))
    out = procure.procurement_summary(procure.price(components(t), t.catalog), docs)
    return out.select("doc_id", "currency", "estimated_total_cost_usd", "items_with_price", "items_without_price")


# --- validation --------------------------------------------------------------------


@check("g07_validate_component", "select doc_id, seq, status, issue_count, messages, types from @validated", bench=True)
def _(t):
    rows = validate.validate(components(t))
    return rows.select(
        "doc_id", "seq", "status", F.size("issues").alias("issue_count"),
        F.array_join(F.transform("issues", lambda x: x["message"]), " / ").alias("messages"),
        F.array_join(F.transform("issues", lambda x: F.concat(x["type"], F.lit(":"), x["severity"])), ",").alias("types"))


SUMMARY_SQL = """select doc_id, count(*) filter (section in (0, 1, 3)) as total_bom_items, count(*) filter (section in (0, 2, 4)) as total_callouts,
    count(*) filter (section = 0) as linked_items, count(*) filter (section = 1) as missing_callouts, count(*) filter (section = 2) as missing_bom_items,
    count(*) filter (low) as low_confidence_items, count(*) filter (dup_item) as duplicate_bom_items, count(*) filter (dup_bubble) as duplicate_callouts,
    count(*) filter (section >= 3) as ambiguous_identifiers, count(*) filter (status = 'review_required') as review_required_items,
    count(*) filter (status = 'invalid') as invalid_items, 0.75 as confidence_threshold from @validated group by doc_id"""


@check("a01_validation_summary", SUMMARY_SQL)
def _(t):
    return validate.validation_summary(validate.validate(components(t)))


@check("a07_status_counts", "select doc_id, status, count(*) as components from @validated group by all")
def _(t):
    return validate.status_counts(validate.validate(components(t)))


# --- documents and exports ------------------------------------------------------------

FRAGMENTS["nested"] = """select doc_id, count(*) as total_components, count(*) filter (status = 'invalid') as invalid_items,
    string_agg(item, ',' order by seq) as items, string_agg(status, ',' order by seq) as statuses,
    coalesce(cast(sum(cast(total_cost as decimal(28, 2))) as double), 0) as total_cost,
    coalesce((select string_agg(key, ',' order by cast(key as hugeint)) from (select k.key from @keyed_bom k where k.doc_id = v.doc_id group by all having count(*) > 1)), '') as duplicate_items,
    coalesce(string_agg(raw_bubble, ',' order by seq) filter (section = 4), '') as ambiguous_callouts
    from @validated v group by doc_id"""
DOC_SQL = """select o_orderkey as doc_id, 0 as part, coalesce(total_components, 0) as total_components, coalesce(invalid_items, 0) as invalid_items, items,
    coalesce(statuses, '') as statuses, coalesce(total_cost, 0) as total_cost, coalesce(duplicate_items, '') as duplicate_items,
    coalesce(ambiguous_callouts, '') as ambiguous_callouts, case when n.doc_id is null then 'partial' else 'ok' end as pipeline_status, o_custkey % 5 as pages_processed
    from @orders left join @nested n on n.doc_id = o_orderkey"""


def _runs(t):
    return t.shared("orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 5).alias("pages_processed"))


def _document_columns(docs):
    return docs.select(
        "doc_id", "part", "metadata.total_components", "validation.summary.invalid_items",
        sc.blank_to_null(F.array_join(F.transform("components", lambda c: c["item_number"]), ",")).alias("items"),
        F.array_join(F.transform("validation.issues", lambda r: r["status"]), ",").alias("statuses"),
        F.col("procurement_summary.estimated_total_cost_usd").alias("total_cost"),
        F.array_join("metadata.duplicate_item_numbers", ",").alias("duplicate_items"),
        F.array_join("metadata.ambiguous_callout_identifiers", ",").alias("ambiguous_callouts"),
        "metadata.pipeline_status", "metadata.pages_processed")


@check("k01_write_workspace", DOC_SQL, bench=True)
def _(t):
    return _document_columns(workspace(t).documents_of(_runs(t)))


@check("s02_read_workspace", "select cast(doc_id as varchar) as doc_id, " + COMPONENT_ID + " as component_id, item as item_number, conf as confidence_score, case when boxed then xmin end as xmin, total_cost from @validated")
def _(t):
    ws = workspace(t)
    documents.write_workspace(ws.documents, f"{t.scratch}/workspaces", slices=ws.slices)
    rows = workspaces.component_rows(workspaces.read_workspace(t.spark, f"{t.scratch}/workspaces"))
    return rows.select("doc_id", "component_id", "item_number", "confidence_score", F.col("bounding_box.xmin").alias("xmin"),
                       F.col("procurement_data.estimated_total_cost_usd").alias("total_cost"))


@check("s02b_incomplete_workspaces", """select cast(doc_id as varchar) as doc_id, count(*) as expected, count(*) - least(2, count(*) - 2) as found
    from @validated where doc_id % 5 < 2 group by doc_id having count(*) > 2""")
def _(t):
    ws = workspace(t)
    nested = documents.workspace_documents(ws.components, part_rows=2)
    documents.write_workspace(nested.filter("not (part = 1 and doc_id % 5 < 2)"), f"{t.scratch}/workspaces", slices=ws.slices)
    return workspaces.incomplete_documents(workspaces.read_workspace(t.spark, f"{t.scratch}/workspaces"))


def _plain(sheet):
    """Sheet columns under names both engines spell alike."""
    return sheet.toDF(*[c.lower().replace(" (₹)", "").replace(" ", "_") for c in sheet.columns])


@check("k02_bom_export", """select doc_id, seq, item as item_number, part_number, name as part_name, descr as description, quantity, mat as material, rev as revision,
    loc as drawing_location, conf as confidence, unit_cost, total_cost as estimated_total, supplier, stock as stock_status from @validated""")
def _(t):
    return _plain(exports.bom_export(workspace(t).components))


@check("k03_procurement_export", "select doc_id, seq, item as item_number, name as part_name, quantity, unit_cost, total_cost as estimated_total, supplier, stock as availability from @validated")
def _(t):
    return _plain(exports.procurement_export(workspace(t).components))


ISSUE_SHEET = f"""select v.doc_id, v.seq, {COMPONENT_ID.replace('seq', 'v.seq')} as component_id, item as item_number, coalesce(i.type, '') as issue_type, coalesce(i.severity, '') as severity,
    coalesce(i.message, 'No issues.') as message, status from @validated v left join @issue_rows i on v.doc_id = i.doc_id and v.seq = i.seq"""


@check("k04_issues_export", ISSUE_SHEET)
def _(t):
    return _plain(exports.issues_export(workspace(t).components)).drop("issue_pos")


@check("k05_export_bundle", """select 'bom' as sheet, count(*) as n, sum(quantity) as q from @validated union all
    select 'procurement_estimate', count(*), sum(quantity) from @validated union all
    select 'validation_issues', count(*), null from @validated v left join @issue_rows i on v.doc_id = i.doc_id and v.seq = i.seq""")
def _(t):
    stored = workspace(t).stored(f"{t.scratch}/components")
    exports.export_bundle(stored.components, f"{t.scratch}/bundle", "csv")
    out = None
    for sheet in exports.SHEETS:
        rows = t.spark.read.option("header", True).csv(f"{t.scratch}/bundle/{sheet}")
        q = F.sum(F.col("Quantity").cast("bigint")) if "Quantity" in rows.columns else F.lit(None).cast("bigint")
        one = rows.agg(F.count(F.lit(1)).alias("n"), q.alias("q")).withColumn("sheet", F.lit(sheet))
        out = one if out is None else out.unionByName(one)
    return out


@check("k05b_bundle_rows", """
    select 'bom' as sheet, cast(doc_id as varchar) as doc_id, cast(seq as varchar) as seq, concat_ws('|', coalesce(item, '~'), coalesce(nullif(name, ''), '~'), coalesce(cast(quantity as varchar), '~'), coalesce(nullif(supplier, ''), '~')) as row from @validated union all
    select 'procurement_estimate', cast(doc_id as varchar), cast(seq as varchar), concat_ws('|', coalesce(item, '~'), coalesce(nullif(name, ''), '~'), coalesce(cast(quantity as varchar), '~'), coalesce(nullif(supplier, ''), '~')) from @validated union all
    select 'validation_issues', cast(v.doc_id as varchar), cast(v.seq as varchar), concat_ws('|', coalesce(v.item, '~'), coalesce(i.type, '~'), coalesce(i.message, 'No issues.'), v.status)
    from @validated v left join @issue_rows i on v.doc_id = i.doc_id and v.seq = i.seq""")
def _(t):
    stored = workspace(t).stored(f"{t.scratch}/components")
    exports.export_bundle(stored.components, f"{t.scratch}/bundle", "csv")
    sheets = exports.read_bundle(t.spark, f"{t.scratch}/bundle")
    fields = {"bom": ["Item Number", "Part Name", "Quantity", "Supplier"], "procurement_estimate": ["Item Number", "Part Name", "Quantity", "Supplier"],
              "validation_issues": ["Item Number", "Issue Type", "Message", "Status"]}
    out = None
    for name, sheet in sheets.items():
        one = sheet.select(F.lit(name).alias("sheet"), "doc_id", "seq", F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("~")) for c in fields[name]]).alias("row"))
        out = one if out is None else out.unionByName(one)
    return out


@check("k06_failed_workspace", """select o_orderkey as doc_id, 'failed' as pipeline_status, 'extraction' as stage, 'Document processing produced no pages' as message,
    0 as linked_items, 'USD' as currency from @orders where o_orderkey not in (select l_orderkey from @lineitem)""")
def _(t):
    docs = t.shared("orders").select(F.col("o_orderkey").alias("doc_id"))
    done = t.shared("lineitem").select(F.col("l_orderkey").alias("doc_id"))
    failed = documents.failed_workspaces(documents.missing_results(docs, done, "extraction", "Document processing produced no pages"))
    e = F.get("metadata.pipeline_errors", F.lit(0))
    return failed.select("doc_id", "metadata.pipeline_status", e["stage"].alias("stage"), e["message"].alias("message"),
                         F.col("validation.summary.linked_items").alias("linked_items"), "procurement_summary.currency")


# --- views -----------------------------------------------------------------------------

FRAGMENTS["parts"] = f"""
    select *, {COMPONENT_ID} as component_id, coalesce(nullif(trim(descr), ''), name, '(unidentified part)') as shown,
           case status when 'linked' then 'matched' when 'review_required' then 'warning' else 'missing' end as badge,
           cast(floor(conf * 100 + 0.5) as int) as pct from @validated"""


def parts(t):
    return workspace(t).parts


@check("e04_parts_view", "select doc_id, component_id, shown as part_name, status as backend_status, badge as status, pct as confidence_pct, coalesce(bubble, item, '—') as label from @parts")
def _(t):
    return parts(t).select("doc_id", "component_id", "part_name", "backend_status", "status", "confidence_pct", "label")


@check("p17_display_name", "select doc_id, component_id, shown as part_name from @parts")
def _(t):
    return parts(t).select("doc_id", "component_id", "part_name")


@check("p18_badge", "select doc_id, component_id, status as backend_status, badge as status from @parts")
def _(t):
    return parts(t).select("doc_id", "component_id", "backend_status", "status")


@check("p19_confidence_percent", "select doc_id, component_id, pct as confidence_pct from @parts")
def _(t):
    return parts(t).select("doc_id", "component_id", "confidence_pct")


@check("p25_display_label", "select doc_id, component_id, coalesce(bubble, item, '—') as label from @parts")
def _(t):
    return parts(t).select("doc_id", "component_id", "label")


@check("a08_stats_cards", """select doc_id, count(*) as total, count(*) filter (badge = 'matched') as matched, count(*) filter (badge = 'warning') as warnings,
    count(*) filter (badge = 'missing') as missing from @parts group by doc_id""")
def _(t):
    return views.stats_cards(parts(t))


@check("e02_flatten_issues", """select p.doc_id, component_id, type, severity, message, status, item as item_number, bubble as bubble_number, shown as part_name,
    coalesce('Item ' || item, 'Bubble ' || bubble, component_id) as label from @parts p join @issue_rows i on p.doc_id = i.doc_id and p.seq = i.seq""")
def _(t):
    return views.flatten_issues(parts(t)).drop("issue_pos")


@check("f11_located_parts", "select doc_id, component_id, xmin / 10 as l, (ymax - ymin) / 10 as h from @parts where boxed")
def _(t):
    return views.overlay(parts(t)).select("doc_id", "component_id", F.col("left").alias("l"), F.col("height").alias("h"))


@check("j08_attach_validation", "select doc_id, component_id, case when seq % 3 = 0 then 'linked' else status end as status, case when seq % 3 = 0 then 0 else issue_count end as n from @parts")
def _(t):
    # Components and records are read from one table, so the inputs are linked once.
    ws = workspace(t).stored(f"{t.scratch}/components")
    records = ws.issues.filter("seq % 3 <> 0").select("doc_id", "component_id", F.col("seq").alias("record_ord"), "status", "issues")
    bare = ws.components.drop("status", "issues")
    return views.attach_validation(bare, records).select("doc_id", "component_id", "status", F.size("issues").alias("n"))


@check("j12_locate", """select 'item' as way, doc_id, component_id, null::bigint as click from @parts where item = '3'
    union all select 'click', p.doc_id, component_id, o_custkey from @parts p join @orders on p.doc_id = o_orderkey
    join @callouts k on k.doc_id = p.doc_id and k.call_ord = p.call_ord
    where boxed and o_custkey % 900 between p.xmin and p.xmax and o_orderkey % 900 between p.ymin and p.ymax and k.page_id = 'page_00' || (o_custkey % 2 + 1)""")
def _(t):
    c = components(t)
    clicks = t.shared("orders").select(
        F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("page_00"), F.col("o_custkey") % 2 + 1).alias("page_id"), F.col("o_custkey").alias("click"),
        (F.col("o_custkey") % 900).cast("double").alias("x"), (F.col("o_orderkey") % 900).cast("double").alias("y"))
    by_item = views.locate(c, "3").select(F.lit("item").alias("way"), "doc_id", "component_id", F.lit(None).cast("bigint").alias("click"))
    by_click = views.parts_at(c, clicks).select(F.lit("click").alias("way"), "doc_id", "component_id", "click")
    return by_item.unionByName(by_click)


# --- diff and exact join ------------------------------------------------------------------

FRAGMENTS["balloons"] = """
    select l_orderkey as doc_id, {by_supplier} as ord, concat('c', cast(l_suppkey as STR), '-', cast(l_partkey as STR), '-', cast(l_linenumber as STR)) as crop_id,
           l_partkey % 3 <> 0 as is_balloon, case when l_suppkey % 9 = 0 then null else l_linenumber end as number from @lineitem"""
FRAGMENTS["bom_keys"] = "select doc_id, key, count(*) as bom_count from @keyed_bom group by all"
FRAGMENTS["balloon_keys"] = """select doc_id, cast(number as varchar) as key, count(*) as balloon_count
    from @balloons where is_balloon and number is not null group by all"""


def balloons(t):
    return t.sql(FRAGMENTS["balloons"])


@check("j02_diff", """select coalesce(b.doc_id, c.doc_id) as doc_id, coalesce(b.key, c.key) as key,
    case when c.key is null then 'missing' when b.key is null then 'extra' else 'matched' end as kind,
    coalesce(bom_count, 0) as bom_count, coalesce(balloon_count, 0) as balloon_count
    from @bom_keys b full join @balloon_keys c on b.doc_id = c.doc_id and b.key = c.key""", bench=True)
def _(t):
    return diff.diff(t.bom, balloons(t))


@check("u02_key_sets", """select kind, doc_id, key from (
    select 'both' as kind, * from (select doc_id, key from @bom_keys intersect select doc_id, key from @balloon_keys) union all
    select 'bom only', * from (select doc_id, key from @bom_keys except select doc_id, key from @balloon_keys) union all
    select 'drawing only', * from (select doc_id, key from @balloon_keys except select doc_id, key from @bom_keys))""")
def _(t):
    kinds = {"matched": "both", "missing": "bom only", "extra": "drawing only"}
    named = F.create_map(*[F.lit(x) for p in kinds.items() for x in p])
    return diff.diff(t.bom, balloons(t)).select(named[F.col("kind")].alias("kind"), "doc_id", "key")


@check("a09_balloon_duplicates", "select doc_id, key, balloon_count as count from @balloon_keys where balloon_count > 1")
def _(t):
    return diff.balloon_duplicates(balloons(t))


@check("a09b_balloon_crops", """select doc_id, cast(number as varchar) as key, row_number() over (partition by doc_id, number order by ord) as position, crop_id
    from @balloons where is_balloon and number is not null""")
def _(t):
    return diff.balloon_crops(balloons(t))


@check("f03_balloons_only", "select doc_id, ord, crop_id, cast(number as varchar) as key from @balloons where is_balloon and number is not null")
def _(t):
    return diff._balloons(balloons(t))


@check("j03_build_components", """select b.doc_id, b.bom_ord, 'cmp_' || case when regexp_matches(item_number, '^[0-9]+$') and length(item_number) < 3 then lpad(item_number, 3, '0') else item_number end as component_id,
    item_number, description as part_name, least(b.confidence_score, c.confidence_score) as confidence_score, c.xmin
    from @bom b join (select * from (select *, row_number() over (partition by doc_id, bubble_number order by call_ord) as rn from @callouts) where rn = 1) c
    on b.doc_id = c.doc_id and b.item_number = c.bubble_number""")
def _(t):
    return diff.exact_components(t.bom, callouts(t)).select(
        "doc_id", "bom_ord", "component_id", "item_number", "part_name", "confidence_score", F.col("bounding_box.xmin").alias("xmin"))


@check("o04_first_match", "select doc_id, bubble_number as item_number, min(call_ord) as first_ord, arg_min(confidence_score, call_ord) as confidence_score from (select * replace (coalesce(confidence_score, -1) as confidence_score) from @callouts) group by all")
def _(t):
    rows = callouts(t).withColumn("confidence_score", F.coalesce("confidence_score", F.lit(-1.0)))
    first = diff.first_callouts(rows)
    ords = rows.groupBy("doc_id", F.col("bubble_number").alias("item_number")).agg(F.min("call_ord").alias("first_ord"))
    return first.join(ords, ["doc_id", "item_number"]).select("doc_id", "item_number", "first_ord", "callout.confidence_score")


@check("j04_orphans", """select doc_id, 0 as side, bom_ord as ord, 'BOM item ' || item_number || ': No callout detected.' as warning from @bom b
    where item_number is not null and not exists (select 1 from @callouts c where c.doc_id = b.doc_id and c.bubble_number = b.item_number)
    union all select doc_id, 1, call_ord, 'Callout ' || bubble_number || ' has no matching BOM row.' from @callouts c
    where not exists (select 1 from @bom b where b.doc_id = c.doc_id and b.item_number = c.bubble_number)""")
def _(t):
    return diff.orphans(t.bom.filter("item_number is not null"), callouts(t))
