"""Tables of the data model: every recording is long rows of channels, chunks and samples.

Times are BIGINT nanoseconds from the start of the recording. A missing value is NaN, no sample is NULL.
"""

from __future__ import annotations

RECORDINGS = (
    "recording_id string, format string, path string, duration_ns bigint, clock string, absolute_start_ns bigint, "
    "absolute_end_ns bigint, clock_offset_ns bigint, session_hint string, timezone string, "
    "identity struct<driver:string,vehicle:string,venue:string,event:string,session:string,date:string,time:string>"
)
CHANNELS = (
    "recording_id string, channel_idx int, id int, name string, unit string, unit_source string, sample_type string, "
    "sample_count bigint, duration_ns bigint"
)
CHUNKS = "recording_id string, channel_idx int, chunk_idx int, sample_period_ns bigint, sample_count bigint, sample_base bigint, time_base_ns bigint"
SAMPLES = "recording_id string, channel_idx int, chunk_idx int, local_idx bigint, t_ns bigint, value double"
LAPS = "recording_id string, number bigint, start_ns bigint, end_ns bigint, duration_ns bigint, complete boolean"
SPANS = (
    "recording_id string, name string, start_ns bigint, end_ns bigint, visible boolean, color string, title string, subtitle string, "
    "meta array<struct<name:string,text:string,ms:int>>"
)
DIAGNOSTICS = "recording_id string, severity string, code string, channel string, message string"
TRACKS = (
    "slug string, name string, aka array<string>, country string, timezone string, latitude double, longitude double, "
    "layouts array<struct<id:string,name:string,length_m:double,centerline:array<struct<lat:double,lon:double>>>>"
)
