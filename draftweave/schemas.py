"""Schemas of the input tables."""

BOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"

BOM_ITEM = (
    "item_number variant, part_number string, part_name string, description string, "
    "quantity variant, material_specification string, material string, revision string, "
    "confidence_score variant"
)
CALLOUT = (
    "bubble_number variant, location_description string, bubble_bbox variant, "
    "bounding_box variant, confidence_score variant, leader_endpoint struct<x:double,y:double>, "
    "leader_line_status string"
)


def _struct(fields: str) -> str:
    return "struct<" + ", ".join(f.replace(" ", ":", 1) for f in fields.split(", ")) + ">"


EXTRACTION = (
    "doc_id string, page_id string, drawing_number string, revision string, "
    f"bom_items array<{_struct(BOM_ITEM)}>, callouts array<{_struct(CALLOUT)}>, "
    "extraction_warnings array<string>, extraction_source string, _corrupt_record string"
)

ISSUE = "struct<type:string,severity:string,message:string>"
PROCUREMENT = (
    "struct<estimated_unit_cost_usd:double,estimated_total_cost_usd:double,supplier_source:string,"
    "stock_status:string,estimated:boolean,mock_data:boolean,note:string>"
)
COMPONENT = (
    "struct<id:string,item_number:string,bubble_number:string,part_number:string,part_name:string,"
    "description:string,quantity:bigint,material_specification:string,revision:string,"
    f"location_description:string,bounding_box:{BOX},confidence_score:double,"
    f"procurement_data:{PROCUREMENT}>"
)
SUMMARY = (
    "struct<total_bom_items:bigint,total_callouts:bigint,linked_items:bigint,missing_callouts:bigint,"
    "missing_bom_items:bigint,low_confidence_items:bigint,duplicate_bom_items:bigint,"
    "duplicate_callouts:bigint,ambiguous_identifiers:bigint,review_required_items:bigint,"
    "invalid_items:bigint,confidence_threshold:double>"
)
WORKSPACE = (
    f"doc_id string, part bigint, components array<{COMPONENT}>, "
    f"validation struct<summary:{SUMMARY},issues:array<struct<component_id:string,issues:array<{ISSUE}>,status:string>>>, "
    "procurement_summary struct<currency:string,estimated_total_cost_usd:double,items_with_price:bigint,items_without_price:bigint,"
    "estimated:boolean,mock_data:boolean,note:string>, "
    "metadata struct<schema_version:string,generated_at:timestamp,generated_by:string,total_components:bigint,confidence_threshold:double,"
    "duplicate_item_numbers:array<string>,duplicate_bubble_numbers:array<string>,"
    "ambiguous_bom_identifiers:array<string>,ambiguous_callout_identifiers:array<string>,"
    "pipeline_status:string,pipeline_errors:array<struct<stage:string,message:string>>,original_filename:string,pages_processed:bigint,"
    "drawing_number:string,revision:string,extraction_source:string,using_mock_vision_extraction:boolean,extraction_warnings:array<string>>"
)
RESPONSE = "doc_id string, page_id string, stage string, tile string, crop_id string, response_text string"
