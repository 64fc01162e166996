"""Explicit schemas of every file this engine reads; nothing is inferred."""

FIELD = "struct<field_conf:double,loc_conf:double,ocr_conf:double,parse_ok:boolean,parse_norm:string,ocr_text:string,ocr_lang:string,meets_threshold:boolean,validation:struct<ok:boolean,code:string>,bbox:array<int>,source:string>"
CORRECTION = "struct<reviewer_id:string,field:string,before:string,after:string,reason:string,at:string>"
DECISION = "struct<decision:string,stp:boolean,overall_conf:double,low_conf_fields:array<string>,reasons:array<string>>"
AUDIT = f"schema_version int, generated_at string, correlation_id string, bank string, file string, source_csv string, decision {DECISION}, fields map<string,{FIELD}>, corrections array<{CORRECTION}>, meta struct<source:string,processing:boolean,env:string>, imageUrl string, version bigint, _corrupt string"

_POINT = "struct<x:double,y:double>"
OCR_LINE = f"struct<text:string,raw_text:string,confidence:double,lang:string,engine:string,pos:array<double>,center:array<double>,pos_norm:array<double>,center_norm:array<double>,bbox_rect:array<double>,center_x:double,center_y:double,bbox:array<{_POINT}>>"
OCR_DOCUMENT = f"bank string, file string, count int, image_metadata struct<height:int,width:int>, image_height int, image_width int, lines array<{OCR_LINE}>, raw_ocr_results array<{OCR_LINE}>, _corrupt string"
FIELD_CSV = "file string, bank string, field string, method string, loc_conf string, ocr_text string, ocr_conf string, ocr_lang string, parse_norm string, parse_ok string, field_conf string, meets_threshold string, bbox_x1 string, bbox_y1 string, bbox_x2 string, bbox_y2 string"
CORRECTION_CSV = "bank string, file string, field string, before string, after string, reason string, reviewer_id string, at string"
TEMPLATE = "bank_id string, template_id string, version string, fields array<struct<name:string,roi_norm:array<double>,region_norm:array<double>,pattern:string,ocr_engine:string,confidence_weight:double>>, anchors array<struct<name:string,region_norm:array<double>,pattern:string>>, _corrupt string"
LOCATED = "bank string, file string, results map<string,struct<bbox:array<int>,confidence:double,method:string,text:string>>, _corrupt string"
PROFILE = "meta map<string,string>, spans array<struct<name:string,ts:double,dur:double,parent:int>>, _corrupt string"
