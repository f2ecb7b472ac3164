"""Schemas of the engine's tables as DDL; every read states one, none is inferred."""

from __future__ import annotations

BOX = "struct<x:double,y:double,w:double,h:double>"
SEGMENTS = "media_id string, seg_id int, start_sec double, end_sec double, text string, confidence double, flags array<string>, speaker string"
REGIONS = "media_id string, region_id int, start_sec double, end_sec double"
TURNS = "media_id string, turn_no int, start_sec double, end_sec double, speaker string, confidence double"
FRAME_HASHES = "media_id string, idx int, pts double, dhash bigint"
CANDIDATES = "media_id string, pts double, sources array<string>, dhash bigint, distance int"
BLOCKS = f"media_id string, frame_idx int, tile int, text string, confidence int, bbox {BOX}"
FINDINGS = "media_id string, frame_idx int, pts double, kind string, masked string, length int, confidence string, signals array<string>, context string"
DOCS = "doc_id string, job_id string, kind string, text string, start_sec double, end_sec double, speaker string, source string, job_ord int, doc_ord int, embedding array<float>"
REVIEW_FINDINGS = "media_id string, ord int, check string, severity string, title string, detail string, at_sec double, data string"
JOBS = (
    "schema_version int, id string, kind string, params string, status string, stage string, fraction double, message string, created_at timestamp, started_at timestamp, "
    "finished_at timestamp, updated_at timestamp, heartbeat_at timestamp, error_code string, parent_job_id string"
)
JOB_EVENTS = "job_id string, ts timestamp, stage string, event string, duration_ms bigint, message string, data string"
PCM = "media_id string, chunk_no int, samples array<float>"
PROBE = (
    "format struct<format_name:string,duration:string,size:string,bit_rate:string>, streams array<struct<codec_type:string,codec_name:string,width:int,height:int,r_frame_rate:string,"
    "avg_frame_rate:string,pix_fmt:string,nb_frames:string,channels:int,sample_rate:string,bit_rate:string,duration:string,disposition:struct<attached_pic:int>>>"
)
