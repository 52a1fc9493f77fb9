"""Input tables derived from the shared tables.

Each input is one SQL text that Spark and DuckDB read alike, so both sides of
a check start from the same rows. ``STR`` stands for the text type and ``LIST``
for the list constructor of the dialect, ``@name`` for another input or a
shared table. Ordinals are arithmetic on unique columns: building an input
never sorts or groups anything.
"""

from __future__ import annotations

import re
import tempfile
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

SHARED = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

BY_LINE = "(l_linenumber * 1000000000000000000 + l_partkey * 100000000 + l_suppkey)"
BY_PAGE_LINE = "(((l_orderkey % 64) * 10 + l_linenumber) * 10000000000000000 + l_partkey * 1000000000 + l_suppkey * 100 + cast(l_quantity as bigint))"
BY_SUPPLIER = "(l_suppkey * 10000000000000 + l_linenumber * 1000000000000 + l_partkey)"
PAGE_OF_LINE = """cast(floor(l_orderkey / 64) as bigint) as doc_id,
       concat('page_00', cast(cast(floor(l_orderkey / 16) as bigint) % 4 + 1 as STR)) as page_id"""
PAGE_OF_ORDER = PAGE_OF_LINE.replace("l_orderkey", "o_orderkey")

INPUTS = {
    # untyped scalars: text and kind
    "scalars": """
        select l_orderkey as doc_id, {by_line} as ord,
               case l_suppkey % 8 when 0 then 'int' when 1 then 'float' when 2 then 'bool' when 3 then 'null'
                    else 'string' end as kind,
               case l_suppkey % 8
                    when 0 then cast(l_partkey - 500 as STR)
                    when 1 then concat(cast(l_linenumber as STR), case l_partkey % 2 when 0 then '.0' else '.5' end)
                    when 2 then case l_partkey % 2 when 0 then 'true' else 'false' end
                    when 3 then null
                    else case l_partkey % 14
                         when 0 then cast(l_linenumber as STR) when 1 then concat('00', cast(l_linenumber as STR))
                         when 2 then concat('Item ', cast(l_partkey as STR)) when 3 then concat('Bubble-', cast(l_linenumber as STR))
                         when 4 then '3-4' when 5 then 'N/A' when 6 then '' when 7 then concat('  ', cast(l_partkey as STR), ' ')
                         when 8 then concat(cast(l_linenumber as STR), 'd') when 9 then concat(cast(l_partkey as STR), '.0')
                         when 10 then concat('0.', cast(l_linenumber as STR)) when 11 then concat('-', cast(l_linenumber as STR))
                         when 12 then concat('+', cast(l_partkey as STR)) else '1e2' end
               end as txt
        from @lineitem""",
    "bom": """
        select l_orderkey as doc_id, {by_line} as bom_ord,
               case when l_partkey % 37 = 0 then 'float' when l_partkey % 37 = 1 then 'bool'
                    when l_partkey % 37 = 2 then 'null' else 'string' end as item_kind,
               case when l_partkey % 37 = 0 then concat(cast(l_linenumber as STR), '.0')
                    when l_partkey % 37 = 1 then 'true' when l_partkey % 37 = 2 then null
                    else case l_partkey % 11 when 0 then '3-4' when 1 then concat('Item ', cast(l_linenumber as STR))
                         when 2 then concat('0', cast(l_linenumber as STR)) when 3 then '2' when 4 then ''
                         else cast(l_linenumber as STR) end
               end as item_number,
               case l_partkey % 13 when 0 then null when 1 then '' else concat('P-', cast(l_partkey as STR)) end as part_number,
               case when l_suppkey % 5 = 0 then null else concat('Part ', cast(l_partkey as STR)) end as part_name,
               case l_partkey % 6 when 0 then '' when 1 then null else concat('Item of ', l_returnflag) end as description,
               case l_suppkey % 11 when 0 then null when 1 then 0 when 2 then -3 else cast(l_quantity as bigint) end as quantity,
               case l_partkey % 4 when 0 then null when 1 then '' else 'Steel' end as material_specification,
               case when l_suppkey % 3 = 0 then null else 'Brass' end as material,
               case l_linenumber % 2 when 0 then null else 'A' end as revision,
               case when l_suppkey % 7 = 0 then null else cast(l_partkey % 51 + 50 as double) / 100 end as confidence_score
        from @lineitem""",
    "callouts": """
        select l_orderkey as doc_id, concat('page_00', cast(l_linenumber % 2 + 1 as STR)) as page_id, {by_supplier} * 2 + case l_linestatus when 'O' then 1 else 0 end as call_ord,
               'string' as bubble_kind,
               case when l_partkey % 5 = 0 then concat('9', cast(l_linenumber as STR)) else case l_suppkey % 13 when 0 then 'A/B' when 1 then concat('Bubble-', cast(l_linenumber as STR))
                    when 2 then '2' else cast(l_linenumber as STR) end end as bubble_number,
               case l_linenumber % 3 when 0 then null else concat('zone ', l_linestatus) end as location_description,
               cast((l_partkey * 3) % 900 as double) as xmin, cast((l_suppkey * 11) % 900 as double) as ymin,
               cast((l_partkey * 3) % 900 + 60 as double) as xmax,
               case when l_partkey % 9 = 0 then null else cast((l_suppkey * 11) % 900 + 60 as double) end as ymax,
               case when l_suppkey % 7 = 0 and l_partkey % 3 = 0 then null
                    else cast((l_partkey * 7) % 51 + 50 as double) / 100 end as confidence_score
        from @lineitem""",
    "catalog": """
        select concat(case when p_partkey % 4 = 0 then 'Q-' else 'P-' end, cast(p_partkey as STR)) as part_number,
               case when p_partkey % 17 = 0 then -1.0 when p_partkey % 19 = 0 then null
                    else cast(p_size as double) + 0.25 end as estimated_unit_cost_usd,
               p_brand as supplier_source,
               case when p_partkey % 5 = 0 then null else 'In Stock' end as stock_status
        from @part""",
    "override": """
        select concat(case when p_partkey % 6 = 0 then 'P-' else 'R-' end, cast(p_partkey as STR)) as part_number, cast(p_size as double) + 100.5 as estimated_unit_cost_usd,
               'Override' as supplier_source, 'Made to Order' as stock_status
        from @part""",
    "boxes": """
        select {page_of_line}, {by_page_line} as call_ord,
               cast(l_linenumber as STR) as bubble_number, cast(50 + l_partkey % 51 as double) / 100 as confidence_score,
               cast((l_partkey * 3) % 300 as double) as xmin, cast((l_suppkey * 11) % 300 as double) as ymin,
               cast((l_partkey * 3) % 300 + 60 + l_quantity as double) as xmax,
               cast((l_suppkey * 11) % 300 + 60 + l_quantity as double) as ymax
        from @lineitem""",
    "geometry": """
        select l_orderkey as doc_id, {by_line} as ord,
               cast((l_partkey * 7) % 1400 as double) - 100 as xmin, cast((l_suppkey * 13) % 1300 as double) - 50 as ymin,
               cast((l_partkey * 7) % 1400 as double) + l_quantity * 3 as xmax,
               cast((l_suppkey * 13) % 1300 as double) + l_quantity * 2 as ymax,
               cast(1200 + l_partkey % 7 * 900 as int) as width, cast(900 + l_suppkey % 5 * 1100 as int) as height,
               cast((l_partkey * 5) % 400 as double) as rx0, cast((l_suppkey * 7) % 400 as double) as ry0,
               cast((l_partkey * 5) % 400 + 100 + l_linenumber * 50 as double) as rx1,
               cast((l_suppkey * 7) % 400 + 120 + l_linenumber * 40 as double) as ry1
        from @lineitem""",
    "contours": """
        select {page_of_line}, {by_page_line} as contour_ord,
               cast(case when l_partkey % 31 = 0 then 0.5 when l_suppkey % 29 = 0 then 90 else 8 + l_partkey % 40 end as double) as radius,
               case when l_partkey % 41 = 0 then 0.0
                    else (case when cast(floor(l_orderkey / 16) as bigint) % 3 = 0 then cast(55 + (l_suppkey * 31) % 44 as double)
                               when l_linenumber <= 4 then cast(50 + (l_suppkey * 31 + l_linenumber * 7) % 22 as double)
                               else cast(90 + (l_suppkey * 3 + l_partkey) % 9 as double) end) / 100
                         * pi() * cast(case when l_partkey % 31 = 0 then 0.5 when l_suppkey % 29 = 0 then 90 else 8 + l_partkey % 40 end as double)
                         * cast(case when l_partkey % 31 = 0 then 0.5 when l_suppkey % 29 = 0 then 90 else 8 + l_partkey % 40 end as double)
               end as area,
               cast((l_partkey * 13) % 4000 as double) + 0.25 as cx, cast((l_suppkey * 37) % 3000 as double) + 0.5 as cy
        from @lineitem""",
    "sheets": """
        select {page_of_order}, cast(floor(o_orderkey / 16) as bigint) % 4 + 1 as page_number,
               cast(4000 as int) as width, cast(3000 as int) as height,
               case when cast(floor(o_orderkey / 16) as bigint) % 2 = 0 then cast(50 as double) end as dx0,
               case when cast(floor(o_orderkey / 16) as bigint) % 2 = 0 then cast(20 as double) end as dy0,
               case when cast(floor(o_orderkey / 16) as bigint) % 2 = 0 then cast(950 as double) end as dx1,
               case when cast(floor(o_orderkey / 16) as bigint) % 2 = 0 then cast(850 as double) end as dy1,
               case o_orderkey % 7 when 0 then 'blurred' end as error,
               case o_orderkey % 5 when 0 then '' when 1 then null else concat('DWG-', cast(o_custkey as STR)) end as drawing_number,
               case o_orderkey % 3 when 0 then '' else concat('R', cast(o_custkey % 9 as STR)) end as revision
        from (select min(o_orderkey) as o_orderkey, min(o_custkey) as o_custkey from @orders group by floor(o_orderkey / 16)) as one""",
    "words": """
        select {page_of_line}, region_id, word_ord, text, x, y, w, h from (
        select l_orderkey, case when l_orderkey % 32 < 16 then 'page' else '1' end as region_id,
               {by_page_line} as word_ord, cast(l_linenumber as STR) as text, 50 as x,
               cast(100 + ((l_orderkey % 16) * 7 + l_linenumber) * 25 + l_partkey % 6 as int) as y, 14 as w, 12 as h from @lineitem
        union all
        select l_orderkey, case when l_orderkey % 32 < 16 then 'page' else '1' end, {by_page_line},
               concat('x', cast(cast(l_quantity as int) as STR)), 150,
               cast(100 + ((l_orderkey % 16) * 7 + l_linenumber) * 25 + l_suppkey % 6 as int), 20, 12 from @lineitem
        union all
        select l_orderkey, case when l_orderkey % 32 < 16 then 'page' else '1' end, {by_page_line},
               concat('Part', l_returnflag), 300,
               cast(100 + ((l_orderkey % 16) * 7 + l_linenumber) * 25 as int), 40, 12 from @lineitem
        union all
        select l_orderkey, case when l_orderkey % 32 < 16 then 'page' else '1' end, {by_page_line},
               concat('type', cast(l_partkey % 10 as STR)), 346 + cast(l_partkey % 3 as int),
               cast(100 + ((l_orderkey % 16) * 7 + l_linenumber) * 25 + l_partkey % 3 as int), 36, 12 from @lineitem
        union all
        select l_orderkey, case when l_orderkey % 32 < 16 then 'page' else '1' end, {by_page_line},
               case l_partkey % 3 when 0 then '|' else 'Steel' end, 600,
               cast(100 + ((l_orderkey % 16) * 7 + l_linenumber) * 25 as int), 38, 12 from @lineitem
        union all
        select o_orderkey, case when o_orderkey % 32 < 16 then 'page' else '1' end, 1, 'PARTS', 200, 20, 50, 12
          from @orders where o_orderkey % 16 = 0 and o_orderkey % 64 <> 0
        union all
        select o_orderkey, case when o_orderkey % 32 < 16 then 'page' else '1' end, 2, 'ITEM', 50, 60, 30, 12
          from @orders where o_orderkey % 16 = 0 and o_orderkey % 48 <> 0
        union all
        select o_orderkey, case when o_orderkey % 32 < 16 then 'page' else '1' end, 3, 'QTY', 150, 60, 25, 12
          from @orders where o_orderkey % 16 = 0 and o_orderkey % 48 <> 0
        union all
        select o_orderkey, case when o_orderkey % 32 < 16 then 'page' else '1' end, 4, 'DESCRIPTION', 300, 61, 90, 12
          from @orders where o_orderkey % 16 = 0 and o_orderkey % 48 <> 0
        union all
        select o_orderkey, case when o_orderkey % 32 < 16 then 'page' else '1' end, 5, 'MATERIAL', 600, 59, 70, 12
          from @orders where o_orderkey % 16 = 0 and o_orderkey % 48 <> 0
        ) as t(l_orderkey, region_id, word_ord, text, x, y, w, h)""",
    "digits": """
        select {page_of_order}, case when o_orderkey % 32 < 16 then 'page' else '1' end as region_id,
               cast(o_orderkey % 16 + 3 as int) as row_no, 0 as cell_no,
               case o_orderkey % 3 when 0 then '' else concat(cast(o_custkey % 40 as STR), ' .') end as digits
        from @orders""",
    "segments": """
        select {page_of_order}, o_orderkey as seg_ord,
               cast(40 + (o_custkey % 3) * 7 + (o_orderkey % 2) * 400 as int) as x, cast(100 + (o_orderkey % 16) * 25 as int) as y,
               cast(case when o_custkey % 10 = 0 then 100 else 600 + o_custkey % 20 end as int) as w, 2 as h
        from @orders""",
    # two pages in three have no table that gives rows
    "cell_tables": """
        select {page_of_order}, o_orderkey + 3000000000 as table_ord,
               case case when cast(floor(o_orderkey / 16) as bigint) % 3 = 0 then o_orderkey % 5 else o_orderkey % 2 + 2 end
                    when 0 then LIST(LIST('Item No', 'Description', 'Qty', 'Material'),
                                     LIST(concat('Item 0', cast(o_custkey % 7 as STR)), 'Hex  bolt ', concat('x', cast(o_custkey % 30 as STR)), 'Steel'),
                                     LIST('', ' ', null, ''),
                                     LIST(cast(o_custkey % 9 as STR), 'Washer', '4 pcs', ''))
                    when 1 then LIST(LIST('PART NUMBER', 'DESCRIPTION', 'ITEM', 'MATERIAL', 'QTY'),
                                     LIST(concat('P-', cast(o_custkey as STR)), 'Bracket', cast(o_custkey % 12 as STR), null, '2'))
                    when 2 then LIST(LIST('alpha', 'beta'), LIST('1', '2'))
                    when 3 then LIST(LIST('Item', 'Qty'))
                    else LIST(LIST('PART NO.', 'Desc', 'Item'), LIST(concat('A', cast(o_custkey as STR)), 'Plate'))
               end as cells
        from @orders""",
    "headers": """
        select o_orderkey as doc_id,
               case o_orderkey % 6
                    when 0 then LIST('#', 'Desc', 'Q''ty', 'Matl') when 1 then LIST('ITEM', 'PART NUMBER', 'DESCRIPTION', 'MATERIAL', 'QTY')
                    when 2 then LIST('PART NO.', 'NAME', 'ref') when 3 then LIST('alpha', '', null)
                    when 4 then LIST(concat('Bal ', cast(o_custkey as STR)), 'P/N', 'Part Description')
                    else LIST(o_orderstatus, o_orderpriority, 'Spec', 'Quantity', 'no.') end as cells
        from @orders""",
    "files": """
        select page_id as doc_id,
               concat('/in/', cast(page_id as STR), case page_id % 8 when 0 then '.pdf' when 1 then '.PNG' when 2 then '.jpeg'
                      when 3 then '.txt' when 4 then '' when 5 then '.jpg' when 6 then '.png' else '.pdf' end) as path,
               case when page_id % 13 = 0 then null when page_id % 11 = 0 then 0 else length(html) end as length,
               case page_id % 8 when 0 then '255044462D312E37' when 1 then '89504E470D0A1A0A' when 2 then 'FFD8FFE0'
                    when 5 then '89504E470D0A1A0A' when 6 then 'FFD8FFE0' else '3C21444F' end as header_hex
        from @pages""",
    # one extraction record per order
    "extractions": """
        select cast(o_orderkey as STR) as doc_id,
               concat('{"doc_id":"', cast(o_orderkey as STR), '","page_id":"page_00', cast(o_orderkey % 3 + 1 as STR),
                 '","drawing_number":"D-', cast(o_custkey as STR), '","bom_items":[{"item_number":',
                 case o_orderkey % 4 when 0 then '3.0' when 1 then '"03"' when 2 then '3' else 'true' end,
                 ',"part_number":"P-', cast(o_custkey as STR), '","description":"Bolt","quantity":',
                 case o_orderkey % 3 when 0 then '"4"' when 1 then '4.0' else '4.5' end,
                 ',"confidence_score":0.9},{"item_number":"', cast(o_custkey % 9 as STR), '","part_name":"Nut","quantity":',
                 cast(o_custkey % 7 as STR), '}],"callouts":[{"bubble_number":', cast(o_orderkey % 4 + 1 as STR),
                 ',"bubble_bbox":', case o_orderkey % 3 when 0 then '{}' when 1 then '{"xmin":1,"ymin":2,"xmax":"30","ymax":4.5}' else '{"xmin":1}' end,
                 ',"bounding_box":{"xmin":10,"ymin":20,"xmax":30,"ymax":40},"confidence_score":0.8}],"extraction_warnings":["w',
                 cast(o_custkey as STR), '"]}') as json
        from @orders""",
    # raw model responses
    "bom_responses": """
        select {page_of_order}, 'bom' as stage, concat('r', cast(o_orderkey as STR)) as tile,
               concat(case when o_orderkey % 9 = 0 then concat('```json', chr(10)) else '' end,
                 case when o_orderkey % 11 = 0 then '{"bom_items": [' when o_orderkey % 17 = 0 then '[1, 2]' when o_orderkey % 19 = 0 then '  '
                      when o_orderkey % 23 = 0 then '{"bom_items": "none"}'
                 else concat('{"bom_items":[{"item_number":"', cast(o_custkey % 9 as STR), '","description":"Bolt","quantity":',
                      case o_custkey % 8 when 0 then '"4"' when 1 then '" 4 "' when 2 then '4.0' when 3 then 'true' when 4 then '4.5'
                           when 5 then '-2' when 6 then 'null' else '12' end,
                      ',"material":"Steel","part_name":"guess","confidence_score":',
                      case o_orderkey % 4 when 0 then '0.65' when 1 then '"0.9"' when 2 then '5.0' else 'null' end,
                      '},{"item_number":', case o_custkey % 3 when 0 then '7' when 1 then '"7"' else 'null' end,
                      ',"material_specification":"Al","material":"x","confidence_score":0.95}',
                      case when o_orderkey % 5 = 0 then ',"junk"' else '' end,
                      '],"drawing_number":"D', cast(o_custkey as STR), '"}') end,
                 case when o_orderkey % 9 = 0 then concat(chr(10), '```') else '' end) as response_text
        from @orders""",
    "call_responses": """
        select {page_of_order}, 'callouts' as stage, concat('r', cast(o_orderkey as STR)) as tile,
               cast(4000 as int) as width, cast(3000 as int) as height,
               case when o_orderkey % 29 = 0 then '{"callouts": 5}'
               else concat('{"callouts":[{"bubble_number":', case o_custkey % 4 when 0 then '3' when 1 then '"3"' when 2 then 'null' else '"3A"' end,
                 ',"bubble_bbox":', case o_custkey % 5 when 0 then '{"xmin":400,"ymin":800,"xmax":1200,"ymax":1600}'
                       when 1 then '{"xmin":10,"ymin":20,"xmax":30,"ymax":40}' when 2 then '{"xmin":30,"ymin":20,"xmax":10,"ymax":40}'
                       when 3 then '"none"' else '{"xmin":"5","ymin":5.5,"xmax":15,"ymax":25}' end,
                 ',"confidence_score":', case o_orderkey % 3 when 0 then '0.84' when 1 then '0.95' else '0.85' end,
                 case o_custkey % 7 when 0 then ',"leader_line_status":"clear","leader_endpoint":{"x":100,"y":200}'
                       when 1 then ',"leader_line_status":"clear"' when 2 then ',"leader_line_status":"Unclear","leader_endpoint":{"x":1,"y":2}'
                       when 3 then ',"leader_line_status":"maybe"' when 4 then ',"leader_endpoint":{"x":1,"y":2}'
                       when 5 then ',"leader_line_status":"unclear"' else '' end,
                 '},{"bubble_number":"3","bounding_box":{"xmin":1,"ymin":2,"xmax":3,"ymax":4},"confidence_score":0.9},"junk"',
                 case when o_orderkey % 2 = 0 then ',{"bubble_bbox":{"xmin":1,"ymin":2,"xmax":3,"ymax":4},"confidence_score":0.99}' else '' end,
                 ']}') end as response_text
        from @orders""",
    # four orders a tile; those after the first of a tile repeat across neighbouring tiles
    "tile_responses": """
        select {page_of_order}, concat('tile[r', cast(cast(floor((o_orderkey % 4) / 2) as int) as STR), 'c', cast(o_orderkey % 2 as STR), ']') as tile,
               case when o_orderkey % 31 = 0 then 'sorry' else
               concat('{"callouts":[{"bubble_number":"', cast(o_custkey % 2 + 1 + (o_orderkey % 16 - o_orderkey % 4) * 10 as STR), '","bubble_bbox":{"xmin":',
                 cast(case when o_orderkey % 2 = 0 then 900 when o_orderkey % 16 < 4 then 50 else 13 end as STR), ',"ymin":400,"xmax":', cast(case when o_orderkey % 2 = 0 then 950 when o_orderkey % 16 < 4 then 100 else 63 end as STR),
                 ',"ymax":450},"confidence_score":0.', cast(86 + o_custkey % 13 as STR), '},{"bubble_number":"', cast(9 + (o_orderkey % 16 - o_orderkey % 4) * 10 as STR), '","bubble_bbox":{"xmin":100,"ymin":100,"xmax":200,"ymax":200},"confidence_score":0.9}]}')
               end as response_text
        from @orders""",
    "crop_responses": """
        select {page_of_order},
               concat('page_00', cast(cast(floor(o_orderkey / 16) as bigint) % 4 + 1 as STR), '_c00',
                      case when o_orderkey % 16 < 9 then '0' else '' end, cast(o_orderkey % 16 + 1 as STR)) as crop_id,
               case o_orderkey % 13 when 0 then 'no json here' when 1 then '{"is_balloon": tru}'
                    when 2 then concat('Sure: {"is_balloon": true, "number": ', cast(o_custkey % 12 as STR), ', "confidence": 0.9} ok')
                    when 3 then '{"is_balloon": "false", "number": 4, "confidence": 5.0}' when 4 then '{"is_balloon": true, "number": null, "confidence": 0.8}'
                    when 5 then '{"is_balloon": false, "number": 3, "confidence": 0.7}' when 6 then '{"is_balloon": 1, "number": "7", "confidence": "0.5"}'
                    when 7 then '{"is_balloon": true, "number": 7.9}' when 8 then '{"number": 2, "confidence": 0.4}'
                    else concat('{"is_balloon": true, "number": ', cast(o_custkey % 12 as STR), ', "confidence": 0.', cast(50 + o_custkey % 49 as STR), '}') end as response_text
        from @orders""",
    "order_callouts": """
        select {page_of_order}, o_orderkey as call_ord, cast(o_custkey % 12 as STR) as bubble_number,
               concat('near ', o_orderstatus) as location_description,
               cast(o_custkey % 800 as double) as xmin, cast(o_orderkey % 700 as double) as ymin,
               cast(o_custkey % 800 + 50 as double) as xmax, cast(o_orderkey % 700 + 40 as double) as ymax,
               0.9 as confidence_score,
               case o_orderkey % 2 when 0 then cast(o_custkey % 900 as double) end as end_x,
               case o_orderkey % 2 when 0 then cast(o_orderkey % 900 as double) end as end_y,
               case o_orderkey % 2 when 0 then 'clear' else 'missing' end as leader_line_status
        from @orders""",
    "verdict_responses": """
        select {page_of_order}, case when o_orderkey % 10 = 7 then -o_orderkey else o_orderkey end as call_ord,
               case o_orderkey % 9 when 0 then 'oops' when 1 then '{"valid": false, "reason": "not a balloon"}' when 2 then '{"valid": false}'
                    when 3 then concat('{"valid": true, "bubble_number": "', cast(o_custkey % 12 + 1 as STR), '", "leader_visible": true, "endpoint_visible": true, "confidence_score": 0.93}')
                    when 4 then concat('{"valid": true, "bubble_number": "', cast(o_custkey % 12 as STR), '", "leader_visible": true, "endpoint_visible": false, "bbox_surrounds_bubble": true, "confidence_score": 0.97}')
                    when 5 then '{"valid": true, "bubble_number": "5", "leader_visible": false, "endpoint_visible": false, "confidence_score": 0.88}'
                    when 6 then '{"valid": true, "bubble_number": "5", "leader_visible": true, "endpoint_visible": true, "bbox_surrounds_bubble": false, "confidence_score": 0.9}'
                    when 7 then '{"valid": true, "bubble_number": "5", "leader_visible": true, "confidence_score": 0.9}'
                    else '[1]' end as response_text
        from @orders""",
}

_NAMES = re.compile(r"@([a-z_]+)")


def _filled(sql: str) -> str:
    parts = {
        "{by_line}": BY_LINE, "{by_page_line}": BY_PAGE_LINE, "{by_supplier}": BY_SUPPLIER,
        "{page_of_line}": PAGE_OF_LINE, "{page_of_order}": PAGE_OF_ORDER,
    }
    for mark, text in parts.items():
        sql = sql.replace(mark, text)
    return sql


def duckdb_text(sql: str) -> str:
    """A text in the oracle's dialect."""
    out = re.sub(r"\bSTR\b", "varchar", _filled(sql))
    return re.sub(r"@([a-z_]+)", r"\1", re.sub(r"\bLIST\(", "list_value(", out))


def duckdb_query(sql: str, fragments: dict[str, str] | None = None) -> str:
    """A query with every input and fragment it mentions in front of it."""
    texts = {**INPUTS, **(fragments or {})}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _NAMES.findall(text):
            if name in texts and name not in order:
                visit(texts[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    ctes = [f"{name} as ({duckdb_text(texts[name])})" for name in order]
    head = "with " + ",\n".join(ctes) + "\n" if ctes else ""
    return head + duckdb_text(sql)


class Inputs:
    """Lazy Spark frames of the inputs over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def shared(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in INPUTS:
            return self.sql(INPUTS[name])
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        """Run a text over shared tables and inputs."""
        text = re.sub(r"\bSTR\b", "string", _filled(text))
        text = re.sub(r"\bLIST\(", "array(", text)
        names = sorted(set(_NAMES.findall(text)), key=len, reverse=True)
        for name in names:
            frame = self.shared(name) if name in SHARED else getattr(self, name)
            view = f"checks_{name}"
            frame.createOrReplaceTempView(view)
            text = re.sub(rf"@{name}\b", view, text)
        return self.spark.sql(text)

    @cached_property
    def scratch(self) -> str:
        """A new folder below the one the cluster shares."""
        import uuid

        context = self.spark.sparkContext
        base = context.getCheckpointDir() or self.spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            base = tempfile.mkdtemp(prefix="draftweave-")
        return f"{base}/checks-{uuid.uuid4().hex}"
